"""SimHash near-duplicates: pigeonhole blocks, joined and verified by Hamming distance.

A 64-bit fingerprint is cut into ``distance + 2`` blocks. Two fingerprints that differ in at
most ``distance`` bits agree in at least two blocks, so each fingerprint is dealt to every
pair of blocks (32 key bits at distance 2) and only equal keys are compared.

Equal fingerprints are one node from the start, so copies never make pairs. Where a key
holds more than ``PAIRED`` different fingerprints, pairs give way to an equally exact form:
two fingerprints are within two bits of each other if and only if they share a variant
that differs from each in one bit at most, so all holders of a variant are linked to the
smallest of them, which is linear in the group, and each such link is verified likewise. The two
forms give the same components; the count only chooses the cheaper one.

Defined results: a null text counts as empty; a text without words has fingerprint zero,
linked like any other; a text shorter than a shingle is one shingle; repeated rows and ids
give a row each; null ids take no part in choosing a component's smallest id; an empty
table gives an empty result; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, islice, repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.components import components
from marlstone.session import free_name, read_table, scratch, written

SEED = 42
PIECE = 1 << 15  # hashes in memory at once, however long the text
PAIRED = 16  # different fingerprints under one key that are still compared pair by pair
DISTANCE = 2


def fingerprint(text: str | None, words: int = 3) -> int:
    """The fingerprint of one text, unsigned."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: ASCII only
    if not found:
        return 0
    shingles = map(b" ".join, zip(*(islice(found, i, None) for i in range(words)))) if len(found) >= words else iter([b" ".join(found)])
    hashes = map(xxhash.xxh64_intdigest, shingles, repeat(SEED))
    ones, total = np.zeros(64, np.int64), 0
    while (part := np.fromiter(islice(hashes, PIECE), np.uint64)).size:
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        total += part.size
    return int(np.packbits(2 * ones > total, bitorder="little").view(np.uint64)[0])


def simhash(text: str | Column, words: int = 3) -> Column:
    """Fingerprint of a text column, as a signed long with the same bits."""

    @F.pandas_udf("long")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            yield pd.Series(np.array([fingerprint(t, words) for t in s], np.uint64).view(np.int64))

    return of(text)


def _keys(blocks: int = DISTANCE + 2) -> tuple[list[int], list[list[int]]]:
    """For each pair of blocks the mask of its bits, and the single bits outside it."""
    width = 64 // blocks
    block = [((1 << width) - 1) << (width * i) for i in range(blocks)]
    masks = [a | b for a, b in combinations(block, 2)]
    return masks, [[1 << i for i in range(64) if not m >> i & 1] for m in masks]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(fingerprints: DataFrame) -> DataFrame:
    """Pairs (a, b) that connect all fingerprints (column fp, distinct) within two bits of each other."""
    masks, outside = _keys()
    dealt = F.array(*[F.struct(F.lit(i).alias("part"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in enumerate(masks)])
    blocks = fingerprints.select("fp", F.explode(dealt).alias("b")).select("fp", "b.part", "b.key")
    shared = written(blocks.groupBy("part", "key").agg(F.count("*").alias("n")).where("n > 1"), "simhash-keys")
    held = written(blocks.join(shared, ["part", "key"]), "simhash-blocks")

    few = held.where(F.col("n") <= PAIRED)
    left, right = few.select("part", "key", F.col("fp").alias("a")), few.select("part", "key", F.col("fp").alias("b"))
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE
    pairs = left.join(right, ["part", "key"]).where((F.col("a") < F.col("b")) & close).select("a", "b")

    flips = F.array(*[F.array(F.lit(0).cast("long"), *[F.lit(_signed(x)) for x in bits]) for bits in outside])
    many = held.where(F.col("n") > PAIRED).select("part", "fp", F.explode(flips[F.col("part")]).alias("flip"))
    variants = many.select("part", "fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("variant"))
    stars = variants.groupBy("part", "variant").agg(F.min("fp").alias("a"), F.collect_list("fp").alias("all")).where(F.size("all") > 1)
    return pairs.unionByName(stars.select("a", F.explode("all").alias("b")).where((F.col("a") != F.col("b")) & close)).distinct()


def _grouped(marked: DataFrame) -> DataFrame:
    """(fp, root, component_id) for each fingerprint of ``marked`` (columns key, fp)."""
    with scratch(marked.sparkSession) as own:
        classes = written(marked.groupBy("fp").agg(F.min("key").alias("least")), "simhash-classes")
        roots = written(components(links(classes.select("fp"))), "simhash-roots")
        rooted = classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
        smallest = written(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "simhash-smallest")
        return own.keep(written(rooted.select("fp", "root").join(smallest, "root").select("fp", "root", "component_id"), "simhash-named"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp, component_id), a row per document; component_id is the smallest key reachable.

    The join back to documents is on the fingerprint; where copies make one hot, AQE splits it.
    """
    marked = written(docs.select(F.col(key).alias("key"), simhash(text).alias("fp")), "simhash")
    return marked.join(_grouped(marked), "fp").select(F.col("key").alias(key), "fp", "component_id")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with one row left of each near-duplicate group.

    It is that with the smallest key (rows without a key come last), then the smallest
    fingerprint; of rows equal in both, which are copies of each other, any one. Texts are
    shuffled once: the rows that stay are known by their number in the table written here.
    """
    number, drawn = free_name(docs, "row"), free_name(docs, "simhash")
    held = written(docs.withColumn(drawn, simhash(text)).withColumn(number, F.monotonically_increasing_id()), "simhash-docs")
    marked = held.select(F.col(key).alias("key"), F.col(drawn).alias("fp"), F.col(number).alias("row"))
    first = F.min(F.struct(F.col("key").isNull().alias("last"), "key", "fp", "row")).alias("first")
    kept = written(marked.join(_grouped(marked), "fp").groupBy("root").agg(first).select(F.col("first.row").alias(number)), "simhash-kept")
    return held.join(kept.hint("merge"), number, "left_semi").select(*docs.columns)  # the same plan at every size


def op1_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


QUERIES = {"op1_simhash": op1_simhash}
