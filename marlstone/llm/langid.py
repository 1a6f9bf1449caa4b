"""Language identification with a bit-sliced Bloom filter over character n-grams.

Every slot of the filter holds one bit per language. A lookup ANDs the slots of an n-gram's
hashes and so returns, as one bitmask, all languages that have the n-gram. A text's votes
are the per-language counts of set bits over its n-grams, corrected for the share that each
language's false positives would give. The filter is fitted on a bounded sample of labelled
rows (``PER_LANGUAGE`` each); every text is read whole. All labels are learnt: a filter holds
``TOGETHER`` of them, and where there are more, a task goes from one filter to the next and holds one at a time.

Defined results: null texts and texts without a letter are ``und`` with score 0, as is
every text where no labelled row is left to learn from; ties go to the first language by
name; ids may repeat or be null (a null id counts as an empty one when rows are held out);
empty tables give empty results; other columns pass through, one named as the result is
replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.session import read_table, scratch, written

PER_LANGUAGE = 4000  # different labelled texts of a language that the filter is fitted on, at most
TOGETHER = 256  # languages of one filter: a megabyte for each eight
SENT = 1 << 16  # languages whose names and numbers are sent to all tasks
BLOCK = 16  # bits of a slot's number within a packed block
SHARE = 0.01  # of a language's sampled texts must have an n-gram for the filter to take it
ORDERS = (2, 3, 4)
SLOT_BITS = 20
HASH_BITS = 40  # of a text's hash, for the draw
HASHES = 3
PIECE = 1 << 18  # code points hashed at once, however long the text
UNKNOWN = "und"


class Filter(NamedTuple):
    """languages, slots (one row of bytes each, a bit per language), false-positive rate per language."""

    languages: list[str]
    slots: np.ndarray
    false_rate: np.ndarray


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _points(text: str) -> np.ndarray:
    """Lower-case code points; each run of anything but letters is one space; a space at both ends."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    points = np.where(_letters()[points], points, 32)
    points = np.concatenate(([32], points, [32])).astype(np.uint64)
    keep = np.ones(points.size, bool)
    keep[1:] = (points[1:] != 32) | (points[:-1] != 32)
    return points[keep]


def grams(text: str) -> Iterator[np.ndarray]:
    """Hashes of all n-grams, repeats included, piece by piece; none for a text without letters."""
    points = _points(text)
    if points.size < 3:
        return
    for at in range(0, points.size, PIECE):
        part = points[at : at + PIECE + max(ORDERS) - 1]
        here = min(PIECE, points.size - at)
        h, found = np.zeros(part.size, np.uint64), []
        for n in range(1, max(ORDERS) + 1):
            h = h[: part.size - n + 1]
            h = (h + part[n - 1 :] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
            if n in ORDERS:
                found.append(h[:here] ^ (h[:here] >> np.uint64(29)))
        yield np.concatenate(found) * np.uint64(0xD6E8FEB86659FD93)


def _slots(hashes: np.ndarray) -> list[np.ndarray]:
    low = np.uint64((1 << SLOT_BITS) - 1)
    return [((hashes >> np.uint64(s)) & low).astype(np.int64) for s in (44, 23, 3)[:HASHES]]


def _document_frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for lang, texts in b.groupby("lang")["text"]:
            own = [np.unique(np.concatenate(g)) for t in texts if (g := list(grams(t)))]
            if own:
                gram, n = np.unique(np.concatenate(own), return_counts=True)
                yield pd.DataFrame({"lang": lang, "gram": gram.view(np.int64), "n": n})


def _drawn(labelled: DataFrame, per_language: int) -> list[tuple[str, int, int, int]]:
    """For each language (name, number of hash bits that a sampled text may have, how many texts have no more, its number by name).

    Copies of a text are one row from the start. Only a language's counts by number of bits reach the driver.
    """
    counts = labelled.select("lang", "at", "bits").distinct().groupBy("lang").pivot("bits", list(range(1, HASH_BITS + 1))).count()
    found = []
    for number, r in enumerate(sorted(counts.collect(), key=lambda r: r["lang"])):
        within = np.cumsum([r[str(i)] or 0 for i in range(1, HASH_BITS + 1)])
        bits = max(1, int((within <= per_language).sum()))
        found.append((r["lang"], bits, int(within[bits - 1]), number))
    return found


def _placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Where an n-gram of a language sets its bit."""
    for b in batches:
        at = _slots(b["gram"].to_numpy().view(np.uint64))
        bit = b["number"].to_numpy()
        yield pd.DataFrame({"slot": np.concatenate(at), "part": np.tile(bit // 8, len(at)), "bits": np.tile(1 << bit % 8, len(at))})


def _packed(rows: pd.DataFrame) -> pd.DataFrame:
    """A block of slots of eight languages as bytes."""
    own = np.zeros(1 << BLOCK, np.uint8)
    own[rows["slot"].to_numpy(np.int64) % (1 << BLOCK)] = rows["bits"].to_numpy(np.int64)
    return pd.DataFrame({"part": rows["part"].iloc[:1], "block": rows["block"].iloc[:1], "own": [own.tobytes()]})


def filters(docs: DataFrame, text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE) -> Iterator[Filter]:
    """Filters for up to ``TOGETHER`` languages each, by name, fitted on up to ``per_language`` different texts of each language, chosen by a hash of the text.

    The hash is cut at a power of two, so between half of that number and all of it are drawn where
    there are as many; how many were drawn is counted, and an n-gram is judged by its share of them.
    Slots are packed in tasks: what reaches the driver is a megabyte for each eight languages, a filter at a time.
    """
    spark = docs.sparkSession
    at = F.xxhash64(text)
    labelled = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"), at.alias("at"), F.length(F.bin(F.pmod(at, F.lit(1 << HASH_BITS)))).alias("bits"))
    labelled = labelled.where("lang is not null and text is not null")
    drawn = _drawn(labelled, per_language)
    if not drawn:
        return
    # A row for each language. By Arrow: rows of Python objects would start workers of another kind in each executor, which stay.
    told = spark.createDataFrame(pa.table(dict(zip(("lang", "most", "sampled", "number"), map(list, zip(*drawn))))), "lang string, most int, sampled long, number int")
    told = F.broadcast(told) if len(drawn) <= SENT else told  # beyond, Spark joins as it sees fit, and splits a large language
    sample = labelled.join(told, "lang").where("bits <= most").groupBy("lang", "at").agg(F.first("text").alias("text")).drop("at")
    common = sample.mapInPandas(_document_frequencies, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    common = common.join(told, "lang").where(F.col("n") >= F.col("sampled") * SHARE)
    bits = common.select("gram", "number").mapInPandas(_placed, "slot long, part int, bits int").groupBy("slot", "part").agg(F.bit_or("bits").alias("bits"))
    with scratch(spark):
        packed = written(bits.withColumn("block", F.shiftright("slot", BLOCK).cast("int")).groupBy("part", "block").applyInPandas(_packed, "part int, block int, own binary"), "langid-slots")
        for first in range(0, len(drawn), TOGETHER):
            names = [k for k, *_ in drawn[first : first + TOGETHER]]
            slots = np.zeros((1 << SLOT_BITS, -(-len(names) // 8)), np.uint8)
            for r in packed.where(F.col("part").between(first // 8, first // 8 + slots.shape[1] - 1)).collect():
                slots[r["block"] << BLOCK : r["block"] + 1 << BLOCK, r["part"] - first // 8] = np.frombuffer(r["own"], np.uint8)
            load = np.array([(slots[:, i // 8] >> i % 8 & 1).mean() for i in range(len(names))])
            yield Filter(names, slots, load**HASHES)


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE) -> Filter:
    """One filter of all languages: for few of them."""
    found = list(filters(docs, text, lang, per_language))
    if not found:
        return Filter([], np.zeros((1 << SLOT_BITS, 1), np.uint8), np.zeros(0))
    return found[0] if len(found) == 1 else Filter([k for f in found for k in f.languages], np.hstack([f.slots for f in found]), np.concatenate([f.false_rate for f in found]))


_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def votes(model: Filter, text: str) -> tuple[np.ndarray, int]:
    """Corrected counts per language, and the number of n-grams."""
    counts, total = np.zeros(8 * model.slots.shape[1], np.int64), 0
    for hashes in grams(text):
        at = _slots(hashes)
        for part in range(model.slots.shape[1]):
            own = model.slots[:, part]
            mask = own[at[0]]
            for a in at[1:]:
                mask = mask & own[a]
            counts[8 * part : 8 * part + 8] += np.bincount(mask, minlength=256) @ _BITS
        total += hashes.size
    found = counts[: len(model.languages)]
    return np.maximum(found - total * model.false_rate, 0) / (1 - np.minimum(model.false_rate, 0.999)), total


class Verdict(NamedTuple):
    """The best language so far, its votes, and all languages' votes."""

    language: str = UNKNOWN
    best: float = -1.0
    whole: float = 0.0

    def after(self, model: Filter, text: str | None) -> Verdict:
        """With another filter's languages; of equal votes the earlier one stays."""
        found, total = votes(model, text) if text and model.languages else (None, 0)
        if not total:
            return self
        at = int(np.argmax(found))
        name, best = (model.languages[at], float(found[at])) if found[at] > self.best else (self.language, self.best)
        return Verdict(name, best, self.whole + float(found.sum()))

    @property
    def told(self) -> tuple[str, float]:
        return self.language, self.best / self.whole if self.whole > 0 else 0.0


def decide(model: Filter, text: str | None) -> tuple[str, float]:
    """The language and its share of the votes; the share is measured among all languages' votes."""
    return Verdict().after(model, text).told


def predicted(models: Iterator[Filter], text: str | Column, spark) -> Column:
    """Struct (lang, score) of a text column. With several filters, a task has one in memory at a time."""
    shared = [spark.sparkContext.broadcast(m) for m in models]

    def fitted(sent) -> Filter:
        own = Filter(*sent.value)
        if len(shared) > 1:
            del sent._value  # read again from the task's disk when it is asked for next
        return own._replace(slots=np.asfortranarray(own.slots))

    @F.pandas_udf("lang string, score double")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        only = fitted(shared[0]) if len(shared) == 1 else None
        for s in texts:
            found = [Verdict()] * len(s)
            for sent in shared:
                model = only or fitted(sent)
                found = [v.after(model, t) for v, t in zip(found, s)]
            yield pd.DataFrame([v.told for v in found], columns=["lang", "score"])

    return of.asNondeterministic()(text)  # one pass, even if a filter and a column both use it


def held_out(key: str = "doc_id") -> Column:
    """Rows whose crc32 of the key's text leaves 1 modulo 3; nothing is learnt from them."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % 3 == 1


def identify(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", out: str = "found") -> DataFrame:
    """``docs`` with the struct ``out`` (lang, score), learnt from its labelled rows that aren't held out."""
    models = filters(docs.where(~held_out(key)), text, lang)
    return docs.withColumn(out, predicted(models, F.col(text), docs.sparkSession))


def op5_langid(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = identify(docs)
    return found.select("doc_id", held_out().alias("held_out"), F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score"))


QUERIES = {"op5_langid": op5_langid}
