"""Near copies by word shingles: SimHash blocks and min-hash bands propose, exact Jaccard similarity decides.

Two texts are linked if the sets of their five-word shingles have a Jaccard similarity of 0.8 or
more; groups are the components of these links. Texts of equal sets are one node from the start.

Proposals. Every node has a 64-bit SimHash of its shingles; pigeonhole blocks find fingerprints
within 2 bits, checked by Hamming distance (``simhash.links``), and each group of such
fingerprints is a key. At a similarity of 0.8 about 10 +- 3 of 64 bits differ, which leaves no
block to look up, so a node also has ``BANDS`` keys of ``ROWS`` min-hash values each: a pair of
similarity s shares one with probability 1 - (1 - s^5)^20, 0.9996 at 0.8, the least that counts.

Decision. Under each key all nodes are held against one of them, that which shares the most keys
with others (the one nearest to all, where a group are near copies of one text); what passes
becomes components. Under keys that still hold several components, their nodes' sets are joined
exactly, by prefixes: of two similar sets, each has one of the common shingles among its rarest
fifth and one more. Only pairs of different components are compared then, all that share one; a
node whose own fifth nobody else has is in no pair. No pair is linked unchecked, none under a key
is left out.

Defined results: words are cut and lowered as in ``simhash``; a null text counts as empty; texts
without words are copies of each other; a text shorter than a shingle is one shingle; null ids
come last when a group's document is chosen; repeated rows are a group; an empty table gives an
empty result; other columns pass through (the operator's own take free names).
"""

from __future__ import annotations

from itertools import islice, repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm import simhash
from marlstone.llm.components import components
from marlstone.session import free_name, scratch, written

SEED = 42
WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 20, 5
PIECE = 1 << 11  # shingles whose minima are taken at once
_DRAWN = np.random.Generator(np.random.PCG64(SEED)).integers(1, 1 << 63, (3, BANDS * ROWS), np.uint64)
MIXED, TIMES, JOINED = _DRAWN[0], _DRAWN[1] * np.uint64(2) + np.uint64(1), _DRAWN[2] * np.uint64(2) + np.uint64(1)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Hashes of a text's different shingles, in order."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: ASCII only
    if not found:
        return np.zeros(0, np.uint64)
    cut = map(b" ".join, zip(*(islice(found, i, None) for i in range(words)))) if len(found) >= words else iter([b" ".join(found)])
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, cut, repeat(SEED)), np.uint64))


def band_keys(found: np.ndarray) -> np.ndarray:
    """A key for each band; equal sets have equal keys."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, found.size, PIECE):
        mixed = (found[at : at + PIECE, None] ^ MIXED) * TIMES
        np.minimum(least, (mixed ^ (mixed >> np.uint64(32))).min(axis=0), out=least)
    return (least * JOINED).reshape(BANDS, ROWS).sum(axis=1, dtype=np.uint64)  # factors differ between bands


def majority(found: np.ndarray) -> int:
    """SimHash of a set: the bits that are set in over half of its hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, found.size, PIECE):
        ones += np.unpackbits(found[at : at + PIECE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > found.size, bitorder="little").view(np.int64)[0])


def sketch(text: str | Column) -> Column:
    """Hash of a text's set, its size, its fingerprint, its keys."""

    @F.pandas_udf("struct<same: long, n: int, fp: long, keys: array<long>>")
    def of(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            s = shingles(t)
            rows.append((xxhash.xxh64_intdigest(s.tobytes(), SEED), s.size, majority(s), band_keys(s).view(np.int64)))
        same, n, fp, keys = zip(*rows, strict=True) if rows else ((), (), (), ())
        return pd.DataFrame({"same": np.array(same, np.uint64).view(np.int64), "n": np.array(n, np.int32), "fp": np.array(fp, np.int64), "keys": list(keys)})

    return of(text)


def hashes(text: str | Column) -> Column:
    """A text's set, as longs with the same bits."""

    @F.pandas_udf("array<long>")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([shingles(t).view(np.int64) for t in texts])

    return of(text)


def _similar(a: Column, b: Column) -> Column:
    """Exact in whole numbers, the bound included: 5 both >= 4 either."""
    both = F.size(F.array_intersect(a, b)).cast("long")
    return both * 100 >= F.lit(round(SIMILARITY * 100)) * (F.size(a) + F.size(b) - both)


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) whose texts are similar."""
    left = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("_a")).hint("merge"), "a")
    both = left.join(sets.select(F.col("node").alias("b"), F.col("set").alias("_b")).hint("merge"), "b")
    return written(both.where(_similar(F.col("_a"), F.col("_b"))).select("a", "b"), "shingles-linked")


def _fit(a: Column, b: Column) -> Column:
    """Sets of sizes further apart can't be similar."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * round(SIMILARITY * 100)


def _least_common(n: Column) -> Column:
    """How much of a set of ``n`` at least is in any set similar to it."""
    return F.floor((n * round(SIMILARITY * 100) + 99) / 100).cast("int")


def _keyed(nodes: DataFrame) -> DataFrame:
    """(key, node, n, rows): the nodes under each key that several share; ``rows`` says how many."""
    prints = nodes.select("fp").distinct()
    named = written(components(simhash.links(prints)), "shingles-prints")
    by_print = nodes.join(named, nodes["fp"] == named["node"], "left").select(nodes["node"], "n", F.xxhash64(F.lit("print"), F.coalesce("root", "fp")).alias("key"))
    dealt = nodes.select("node", "n", F.explode("keys").alias("key")).unionByName(by_print)
    shared = written(dealt.groupBy("key").agg(F.count("*").alias("rows")).where("rows > 1"), "shingles-keys")
    return written(dealt.join(shared, "key").select("key", "node", "n", "rows"), "shingles-held")


def _starred(held: DataFrame) -> DataFrame:
    """Pairs (a, b): each node and the one of its key that shares the most with others."""
    mass = held.groupBy("node").agg(F.sum("rows").alias("mass"))
    most = F.max(F.struct("mass", (-F.col("node")).alias("turned"), F.col("n").alias("hub_n")))
    hubs = written(held.join(mass, "node").groupBy("key").agg(most.alias("hub")).select("key", (-F.col("hub.turned")).alias("hub"), "hub.hub_n"), "shingles-hubs")
    pairs = held.join(hubs, "key").where((F.col("node") != F.col("hub")) & _fit(F.col("n"), F.col("hub_n")))
    return pairs.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()


def _across(held: DataFrame, found: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of different components, under keys that hold several, that can be similar."""
    told = held.select("key", "node", "n").join(found, "node", "left").select("key", "node", "n", F.coalesce("root", "node").alias("root"))
    several = told.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key")
    apart = written(told.join(several, "key", "left_semi").select("node", "n", "root").distinct(), "shingles-apart")
    cut = written(apart.join(sets, "node").select("node", "n", "root", F.explode("set").alias("shingle")), "shingles-cut")
    often = cut.groupBy("shingle").agg(F.count("*").alias("often")).where("often > 1")
    common = cut.join(often, "shingle").groupBy("node", "n", "root").agg(F.sort_array(F.collect_list(F.struct("often", "shingle"))).alias("common"))
    alone = F.col("n") - F.size("common")  # shingles that only this node has come before
    first = F.col("n") - _least_common(F.col("n")) + 1 - alone
    prefix = common.where(first > 0).select("node", "n", "root", F.size("common").alias("c"), alone.alias("alone"), F.posexplode(F.slice("common", 1, F.greatest(first, F.lit(1)))).alias("at", "p"))
    prefix = written(prefix.select("node", "n", "root", "c", (F.col("alone") + F.col("at")).alias("ahead"), "p.shingle"), "shingles-prefixes")
    mixed = prefix.groupBy("shingle").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("shingle")
    rest = written(prefix.join(mixed, "shingle"), "shingles-mixed")
    side = lambda x: rest.select("shingle", *[F.col(c).alias(f"{x}_{c}") for c in ("node", "n", "root", "c", "ahead")])
    # what must be common at least, of sets that are similar; no more can be than from the first common shingle on
    least = F.ceil((F.col("a_n") + F.col("b_n")) * round(SIMILARITY * 100) / (100 + round(SIMILARITY * 100)) - 1e-9)
    most = F.least(F.col("a_c"), F.col("b_c"), F.col("a_n") - F.col("a_ahead"), F.col("b_n") - F.col("b_ahead"))
    pairs = side("a").join(side("b"), "shingle").where((F.col("a_node") < F.col("b_node")) & (F.col("a_root") != F.col("b_root")) & (most >= least))
    return pairs.select(F.col("a_node").alias("a"), F.col("b_node").alias("b")).distinct()


def _roots(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, root) of the nodes (node, n, fp, keys) that have a near copy; texts: (node, text) at least of the nodes."""
    held = _keyed(nodes)
    sets = written(texts.join(held.select("node").distinct().hint("merge"), "node", "left_semi").select("node", hashes("text").alias("set")), "shingles-sets")
    first = _verified(_starred(held), sets)
    found = written(components(first), "shingles-components")
    second = _verified(_across(held, found, sets), sets)
    return components(first.unionByName(second)) if second.limit(1).count() else found


def one_of_similar(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with one row left of each group of near copies.

    It is that with the smallest key (rows without a key come last), then the first by row number.
    """
    number, drawn = free_name(docs, "row"), free_name(docs, "shingles")
    with scratch(docs.sparkSession) as own:
        held = own.keep(written(docs.withColumn(drawn, sketch(text)).withColumn(number, F.monotonically_increasing_id()), "shingles-docs"))
        row = F.struct(F.col(key).isNull().alias("last"), F.col(key).alias("key"), F.col(number).alias("row"))
        classes = held.select(f"{drawn}.*", row.alias("row")).groupBy("same").agg(F.min("row").alias("first"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("keys").alias("keys"))
        nodes = written(classes.select(F.col("first.row").alias("node"), "n", "fp", "keys", "first"), "shingles-nodes")
        roots = written(_roots(nodes, held.select(F.col(number).alias("node"), F.col(text).alias("text"))), "shingles-roots")
        rooted = nodes.select("node", "first").join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("first").alias("first"))
        kept = own.keep(written(rooted.select(F.col("first.row").alias(number)), "shingles-kept"))
    return held.join(kept.hint("merge"), number, "left_semi").select(*docs.columns)  # the same plan at every size
