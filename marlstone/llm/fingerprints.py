"""Document fingerprints that keep edit distance: a randomised embedding, sampled, banded, verified.

Embedding. A pointer walks over a text's characters; at every step the character under it is
written down, and a shared random bit of (step, class of the character) says whether the pointer
moves on. Two walks that meet at equal characters stay together from there, and after an edit
they soon meet again; so texts few edits apart have walks few places apart: edit distance has
become Hamming distance. The number of steps that the pointer stays on a character is looked up,
one look-up a character.

Sampling. A fingerprint has ``SLOTS`` slots of eight bits. Slot k samples a place of the walk
that is uniform over its length and the same for walks of about the same length: the last
prefix minimum of a random sequence of its own, whose places are drawn once. It holds a hash of the
``GRAM`` characters from that place on. Likeness is the share of equal slots.

Banding. With a likeness of 0.8 or more, at most 12 of 64 slots differ, so of 13 bands at least
one is equal: bands lose no such pair, and each pair they propose is verified on all slots.

Defined results: a null text counts as empty; an empty text's slots are zero; equal texts have
equal fingerprints, repeated rows a row each; where ids are null or repeat, the next document
is by text hash, null ids last; an empty table gives an empty result; other columns are ignored, whatever their
names. Long texts are walked in chunks, and only the chunks that hold sampled places are walked twice.
"""

from __future__ import annotations

import hashlib
import math
import random
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.components import components
from marlstone.session import bounded_batches, read_table, scratch, written

SEED = 42
SLOTS = 64
GRAM = 4
CLASSES, PERIOD = 64, 1 << 12  # classes of characters; steps after which the random bits repeat
CHUNK = 1 << 16  # characters
LONGEST = 1 << 44  # steps
LIKENESS = 0.8
DIFFERENT = SLOTS - math.ceil(LIKENESS * SLOTS)
BANDS = DIFFERENT + 1
HOT = 64  # fingerprints under a band that are told apart by a second one


def _stays() -> list[int]:
    """For each class and step (flat), the steps until the pointer has moved on, at least 1."""
    moves = np.random.Generator(np.random.PCG64(SEED)).integers(0, 2, (CLASSES, PERIOD), np.int8)
    out = np.zeros((CLASSES, 2 * PERIOD), np.int64)
    for s in range(2 * PERIOD - 2, -1, -1):
        out[:, s] = np.where(moves[:, s % PERIOD] > 0, 1, out[:, s + 1] + 1)
    return out[:, :PERIOD].ravel().tolist()


def _minima() -> np.ndarray:
    """For each slot the places of the prefix minima of a random sequence, in order, up to LONGEST."""
    rng = random.Random(SEED)
    rows = []
    for _ in range(SLOTS):
        places, least = [0], rng.random()
        while places[-1] < LONGEST:
            places.append(places[-1] + 1 + int(math.log(1.0 - rng.random()) / math.log1p(-least)))  # the wait for a lower value
            least *= rng.random()
        rows.append(places)
    width = max(map(len, rows))
    return np.array([own + [own[-1]] * (width - len(own)) for own in rows], np.int64)


STAYS, MINIMA = _stays(), _minima()
_DRAWN = np.random.Generator(np.random.PCG64(SEED + 1)).integers(1, 1 << 63, GRAM + 1, np.uint64) * np.uint64(2) + np.uint64(1)
GRAM_HASH, CLASS_HASH = _DRAWN[:GRAM], np.uint32(_DRAWN[GRAM] & np.uint64(0xFFFFFFFF))
SHUFFLED = np.random.Generator(np.random.PCG64(SEED + 2)).permutation(SLOTS)


def walked(classes: list[int], step: int) -> list[int]:
    """The step at which the pointer leaves each character, when it comes to the first at ``step``."""
    stays, mask = STAYS, PERIOD - 1
    return [step := step + stays[c + (step & mask)] for c in classes]


def sampled(steps: int) -> np.ndarray:
    """The place of each slot in a walk of so many steps."""
    return MINIMA[np.arange(SLOTS), (MINIMA < steps).sum(axis=1) - 1]


def fingerprint(text: str | None) -> bytes:
    """A byte for each slot."""
    if not text:
        return bytes(SLOTS)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    begins, step = [], 0
    classes = lambda i: ((codes[i : i + CHUNK] * CLASS_HASH >> np.uint32(26)) * np.uint32(PERIOD)).tolist()
    for i in range(0, len(codes), CHUNK):
        begins.append(step)
        left = walked(classes(i), step)
        step = left[-1]
    held, at = len(begins) - 1, np.zeros(SLOTS, np.int64)
    places = sampled(step)
    for slot in np.argsort(-places).tolist():
        place = int(places[slot])
        if place < begins[held]:
            held = bisect_right(begins, place) - 1
            left = walked(classes(held * CHUNK), begins[held])
        at[slot] = held * CHUNK + bisect_right(left, place)
    grams = np.concatenate([codes, np.zeros(GRAM - 1, "<u4")])[at[:, None] + np.arange(GRAM)].astype(np.uint64)
    return ((grams * GRAM_HASH).sum(axis=1, dtype=np.uint64) >> np.uint64(56)).astype(np.uint8).tobytes()


def likeness(a: bytes, b: bytes) -> float:
    """The share of equal slots."""
    return float(np.mean(np.frombuffer(a, np.uint8) == np.frombuffer(b, np.uint8)))


def bands() -> list[list[int]]:
    """The slots of each band."""
    return [own.tolist() for own in np.array_split(SHUFFLED, BANDS)]


def common_bands(a: bytes, b: bytes) -> int:
    """How many bands two fingerprints share."""
    return sum(all(a[i] == b[i] for i in own) for own in bands())


def edited(text: str, following: str) -> str:
    """``text`` with its second half replaced by as much of the next document's beginning."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprints(text: str | Column) -> Column:
    """Fingerprint of a text column, as hexadecimal digits, two for each slot."""

    @F.pandas_udf("string")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t).hex() for t in texts], dtype=object)

    return of(text)


TOLD = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, bands_edited long, bands_next long"


def _told(text: str, own: bytes, following: str, other: bytes) -> tuple:
    new = edited(text, following)
    print_ = own if new == text else fingerprint(new)
    return len(text), hashlib.sha256(new.encode()).hexdigest(), own.hex(), print_.hex(), likeness(own, print_), likeness(own, other), common_bands(own, print_), common_bands(own, other)


def _by_pairs(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[pa.RecordBatch]:
    """Each document of a sorted partition with the next; the first and the last one's texts are passed on."""
    part, before, kind = TaskContext.get().partitionId(), None, pa.null()
    types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.int64()]
    held = lambda what, key, text, own: (key, None, None, own.hex(), *[None] * (len(columns) - 3), part, what, text)

    def shaped(rows: list[tuple]) -> pa.RecordBatch:
        names = ["key", *columns, "part", "kind", "text"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [kind, *types, pa.int32(), pa.string(), pa.string()])], names)

    for batch in batches:
        kind, rows = batch.schema.field("key").type, []
        for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist()):
            now = (key, text, fingerprint(text))
            rows.append((before[0], *_told(*before[1:], *now[1:]), part, "whole", None) if before else held("first", *now))
            before = now
        if rows:
            yield shaped(rows)
    if before:
        yield shaped([held("last", *before)])


def told(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, bands_edited, bands_next).

    The edited text is that of ``edited`` with the next document by key (the first after the last); ``near``
    are likenesses of the fingerprint and ``bands`` the bands it shares. Texts are dealt once, by ranges of the key; a task
    goes through its range in order, and only a range's first and last text are joined to others.
    """
    spark = bounded_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.monotonically_increasing_id().alias("row"))
    order = [F.col("key").asc_nulls_last(), F.xxhash64("text"), F.col("row")]
    columns = [c.split(" ")[0] for c in TOLD.split(", ")]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("key", "text")
    found = ranged.mapInArrow(lambda batches: _by_pairs(batches, columns), f"key {kind}, {TOLD}, part int, kind string, text string")
    found = written(found, "fingerprints")
    first = found.where("kind = 'first'").select("part", F.col("text").alias("next_text"), F.col("fingerprint").alias("next_print"))
    after = Window.orderBy("part")  # a row per task
    places = first.select("part").withColumn("next", F.lead("part").over(after)).crossJoin(F.broadcast(first.agg(F.min("part").alias("least"))))  # one row
    last = found.where("kind = 'last'").select("key", "text", "fingerprint", "part").join(places, "part")
    last = last.join(first.withColumnRenamed("part", "next_part"), F.coalesce("next", "least") == F.col("next_part"))

    @F.pandas_udf(TOLD)
    def closed(texts: pd.Series, own: pd.Series, following: pd.Series, other: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_told(t, bytes.fromhex(a), n, bytes.fromhex(b)) for t, a, n, b in zip(texts, own, following, other)], columns=columns)

    ends = last.select("key", closed.asNondeterministic()("text", "fingerprint", "next_text", "next_print").alias("d")).select("key", "d.*")
    return found.where("kind = 'whole'").select("key", *columns).unionByName(ends).withColumnRenamed("key", key)


def _words(prints: str) -> Column:
    """A fingerprint's digits as eight whole numbers."""
    return F.array(*[F.conv(F.substring(prints, 16 * i + 1, 16), 16, -10).cast("long") for i in range(SLOTS // 8)])


def equal_slots(a: str, b: str) -> Column:
    """How many slots of two arrays of ``_words`` are equal."""

    def differing(x: Column) -> Column:
        for shift in (4, 2, 1):  # a byte's lowest bit becomes the union of its bits
            x = x.bitwiseOR(F.shiftrightunsigned(x, shift))
        return F.bit_count(x.bitwiseAND(F.lit(0x0101010101010101)))

    return SLOTS - F.aggregate(F.zip_with(a, b, lambda x, y: differing(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)


def _under(prints: str, slots: list[list[int]]) -> Column:
    """The text of each band, its number before it."""
    return F.array(*[F.concat(F.lit(f"{n}:"), *[F.substring(prints, 2 * i + 1, 2) for i in own]) for n, own in enumerate(slots)])


def _second() -> Column:
    """For each band, the bands that the other slots are cut into: of these, too, a pair shares one."""
    own = bands()
    others = [[x.tolist() for x in np.array_split([i for i in SHUFFLED if i not in b], BANDS)] for b in own]
    return F.get(F.array(*[_under("node", o) for o in others]), F.substring_index("band", ":", 1).cast("int"))


def similar(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fingerprint, group) of each document; group: the smallest key reachable by links of a likeness of LIKENESS or more.

    Equal fingerprints are one node. Under each band all nodes are held against the least one; what passes becomes components.
    Nodes of different components are then compared under the bands that they share, of which those
    with over ``HOT`` nodes are first cut by a second band. No proposal is linked unverified, and none is left out.
    """
    spark = bounded_batches(docs.sparkSession)
    with scratch(spark) as own:
        prints = own.keep(written(docs.select(F.col(key).alias("key"), fingerprints(text).alias("node")), "prints"))
        nodes = prints.select("node").distinct()
        banded = written(nodes.select("node", _words("node").alias("own"), F.explode(_under("node", bands())).alias("band")), "prints-bands")
        least = banded.groupBy("band").agg(F.min_by(F.struct("node", "own"), "node").alias("least"), F.count("*").alias("n")).where("n > 1")
        held = banded.join(least, "band")
        near = lambda a, b: equal_slots(a, b) >= SLOTS - DIFFERENT
        linked = written(held.where((F.col("node") != F.col("least.node")) & near("own", "least.own")).select(F.col("least.node").alias("a"), F.col("node").alias("b")).distinct(), "prints-links")
        roots = written(components(linked), "prints-roots")
        placed = held.select("band", "node", "own", "n").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        apart = placed.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("band")
        rest = placed.join(apart, "band")
        cut = F.when(F.col("n") > HOT, F.transform(_second(), lambda s: F.concat("band", F.lit("/"), s))).otherwise(F.array("band"))
        rest = written(rest.select("node", "own", "root", F.explode(cut).alias("under")), "prints-rest")
        x, y = rest.alias("x"), rest.alias("y")
        crossed = x.join(y, (F.col("x.under") == F.col("y.under")) & (F.col("x.root") < F.col("y.root"))).where(near("x.own", "y.own"))
        more = crossed.select(F.col("x.root").alias("a"), F.col("y.root").alias("b")).distinct()
        whole = own.keep(written(components(linked.unionByName(more)), "prints-groups"))
    rooted = prints.join(whole, "node", "left").withColumn("root", F.coalesce("root", "node"))
    groups = rooted.groupBy("root").agg(F.min("key").alias("group"))
    return rooted.join(groups, "root").select(F.col("key").alias(key), F.col("node").alias("fingerprint"), "group")


def op12_fingerprints(spark, sf_dir: str) -> DataFrame:
    return told(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op12_fingerprints": op12_fingerprints}
