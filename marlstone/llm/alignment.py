"""Alignment of two tokenizers over the bytes of their texts.

A byte-level BPE (A) encodes a space and the text, a piece BPE with byte fallback (B) the text, to
which it adds that space. Each byte gets a label: no token ends here, one of A, one of B, or one of
both. A group reaches up to a ``both``. Tokens whose bytes overlap are linked: a link for each place where
a token ends, between the tokens that hold the byte there.

Both encoders treat what begins with a space behind a non-blank character apart from what is
before it (A's rules never join a non-blank to a following blank; no piece of B has a space mark
behind another character, which is checked). So texts are cut there, both sides' tokens end at a
cut's end, and a text's groups and links are those of its cuts, joined. A worker keeps the written groups and the links
of the cuts that it has met, in two tables of which the older is dropped when the younger is full. New cuts of several texts
are aligned together, as arrays.

How often an id pair is linked in the corpus is an aggregate with partial results. The pairs with more than
1 of 2^16 of all links are fewer than 2^16 whatever the data, and are broadcast; each of the others
is in a small share of the documents, and they are joined by shuffle, evenly dealt.

Defined results: texts that are null, empty, or whose tokens' joined bytes differ from the space and the text have
no tokens, and zeros; special tokens' strings are plain text; repeated rows and null ids give a row each;
an empty table gives an empty result; other columns pass through ``aligned`` and are ignored by
``told``. The tokenizer files are read on the driver and broadcast.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from itertools import chain, islice
from pathlib import Path

import numpy as np
import pandas as pd
import regex
import sentencepiece
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.bpe import byte_names
from marlstone.session import bounded_batches, free_name, read_table, scratch, written

KEPT = 1 << 17  # cuts whose alignment a worker keeps in each of two tables
SHORT = 48  # characters; longer cuts are aligned each time
WINDOW = 1 << 15  # cuts, of one text or several, that are looked up together
PART = 1 << 15  # characters of new cuts that are aligned together, a longer cut alone
HEAVY = 1 << 16  # pairs with more than one in so many of all links are broadcast
# Fixed value: the file's pre-tokenizer, by its published pattern.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CUT = re.compile(r" (?<=\S )")  # a space behind a non-blank; no text begins with it
AMID = re.compile(r"\s ")  # a text without it is cut at every space but one at its beginning
MARK = "▁"
A_END, B_END = 1, 2  # labels; both: 3


def byte_level(spec: str) -> tuple[tiktoken.Encoding, list[bytes]]:
    """The encoder of a byte-level BPE file, and each entry's bytes. Ids must be in the order of merges, as published."""
    found = json.loads(spec)
    rules, model = found["pre_tokenizer"], found["model"]
    if found.get("normalizer") or rules["type"] != "ByteLevel" or rules.get("add_prefix_space") or rules.get("use_regex") is False:
        raise ValueError("not a byte-level BPE without a normalizer")
    byte_of = {c: b for b, c in enumerate(byte_names())}
    special = {x["content"] for x in found["added_tokens"]}
    ranks = {bytes(byte_of[c] for c in name): i for name, i in model["vocab"].items() if name not in special}
    merged = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    if merged != sorted(merged):
        raise ValueError("ids are not in the order of merges")
    entries = [b""] * (max(model["vocab"].values()) + 1)
    for data, i in ranks.items():
        entries[i] = data
    return tiktoken.Encoding("byte level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), entries


class Pieces:
    """A piece model and each piece's bytes; ``apart`` if no piece has a space mark behind another character."""

    def __init__(self, model: bytes) -> None:
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = self.model.vocab_size()
        names = [self.model.id_to_piece(i) for i in range(n)]
        self.entries = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(names)]
        self.apart = not any(regex.search(f"[^{MARK}]{MARK}", p) for p in names)
        self.lead = len(self.model.encode("a"))

    def encode(self, text: str) -> list[int]:
        """Ids of a space and the text. The model has none for an empty text, so that is asked for behind a letter."""
        return self.model.encode(text) if text else self.model.encode("a ")[self.lead :]


# What is known of a cut: its groups as they are written, its links as packed pairs of ids (64-bit), n_a, n_b; of one
# that a side's joined bytes differ from, nothing. A plain tuple, as Python's collector leaves those of plain values out.
Known = tuple[str, bytes, int, int] | tuple[()]


class Aligner:
    """Aligns texts by a byte-level BPE file and a piece model."""

    def __init__(self, spec: str, model: bytes) -> None:
        self.coder, self.entries = byte_level(spec)
        self.pieces = Pieces(model)
        self.width = len(self.pieces.entries)
        self.lengths = tuple(np.array([len(x) for x in own], np.int64) for own in (self.entries, self.pieces.entries))
        self.kept: dict[str, Known] = {}
        self.older: dict[str, Known] = {}
        self.names = [f"{i}{mark}" for i in range(max(len(self.entries), self.width)) for mark in ",|;"]
        self.sizes = np.array([len(x) for x in self.names])

    def _both(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of a string that begins with a space; none if either side's joined bytes differ from it."""
        data = text.encode()
        a, b = self.coder.encode_ordinary(text), self.pieces.encode(text[1:])
        same = all(b"".join(map(own.__getitem__, ids)) == data for ids, own in ((a, self.entries), (b, self.pieces.entries)))
        return (np.array(a, np.int64), np.array(b, np.int64)) if same else None

    def _together(self, cuts: list[str]) -> list[Known]:
        """The alignment of some cuts, encoded in one go; if bytes differ, in ever fewer. All but a last one end in a non-blank."""
        found = self._both(" " + " ".join(cuts))
        if found is None:
            step = max(1, len(cuts) // 64)
            return [x for i in range(0, len(cuts), step) for x in self._together(cuts[i : i + step])] if len(cuts) > 1 else [()]
        a, b = found
        ends_a, ends_b = np.cumsum(self.lengths[0][a]), np.cumsum(self.lengths[1][b])
        labels = np.zeros(ends_a[-1], np.uint8)
        labels[ends_a - 1] = A_END
        labels[ends_b - 1] |= B_END
        at = np.flatnonzero(labels)
        ends = labels[at]
        of_a, of_b, of_both = (ends & A_END) > 0, (ends & B_END) > 0, ends == A_END | B_END
        upto_a, upto_b = np.cumsum(of_a), np.cumsum(of_b)
        group = np.cumsum(of_both) - of_both
        links = (a[upto_a - of_a] * self.width + b[upto_b - of_b]).tobytes()
        last_a, last_b = upto_a[of_both], upto_b[of_both]  # tokens of either side up to each group's end
        at_a = np.arange(len(a)) + np.concatenate([[0], last_b])[group[of_a]]  # all of a group's A ids, then all of its B ids
        at_b = np.arange(len(b)) + last_a[group[of_b]]
        names = np.empty(len(a) + len(b), np.int64)
        names[at_a], names[at_b] = 3 * a, 3 * b
        names[at_a[last_a - 1]] += 1
        names[at_b[last_b - 1]] += 2
        written = "".join(map(self.names.__getitem__, names.tolist()))
        last = np.searchsorted(at, np.cumsum([len(c.encode()) + 1 for c in cuts]) - 1)  # the end that is a cut's end
        n_a, n_b = upto_a[last], upto_b[last]
        stops = np.cumsum(self.sizes[names])[n_a + n_b - 1].tolist()
        ats = (8 * (last + 1)).tolist()
        counts = zip(np.diff(n_a, prepend=0).tolist(), np.diff(n_b, prepend=0).tolist())
        return [(written[i : j - 1], links[k:m], *n) for i, j, k, m, n in zip([0, *stops], stops, [0, *ats], ats, counts)]

    def _learnt(self, cuts: list[str]) -> dict[str, Known]:
        """Sees to it that ``kept`` has all of some cuts; gives those of them that are too long to be kept."""
        if len(self.kept) >= KEPT:
            self.older, self.kept = self.kept, {}
        older, kept, long = self.older, self.kept, {}
        some: list[str] = []
        size = 0

        def learn() -> None:
            for c, found in zip(some, self._together(some)):
                (kept if len(c) <= SHORT else long)[c] = found

        for c in set(cuts).difference(kept):
            found = older.get(c)
            if found is not None:
                kept[c] = found
            elif not self.pieces.apart or not c or c[-1].isspace():  # a whole text, or one's end
                (kept if len(c) <= SHORT else long)[c] = self._together([c])[0]
            else:
                if some and size + len(c) > PART:
                    learn()
                    some, size = [], 0
                some.append(c)
                size += len(c) + 1
        if some:
            learn()
        return long

    def cuts(self, text: str | None) -> list[str]:
        """What is encoded apart, joined by spaces the text. None for a null or empty text."""
        if not text:
            return []
        if not self.pieces.apart:
            return [text]
        return CUT.split(text) if text[0] == " " or AMID.search(text) else text.split(" ")

    def _joined(self, texts: list[list[str]]) -> Iterator[Known]:
        flat, found = list(chain.from_iterable(texts)), []
        for i in range(0, len(flat), WINDOW):
            some = flat[i : i + WINDOW]
            long = self._learnt(some)
            found += map(self.kept.__getitem__, some) if not long else [long[c] if c in long else self.kept[c] for c in some]
        of = iter(found)
        for cuts in texts:
            own = list(islice(of, len(cuts)))
            if own and all(own):
                written, links, n_a, n_b = zip(*own)
                yield ";".join(written), b"".join(links), sum(n_a), sum(n_b)
            else:
                yield ()

    def align(self, texts: Iterable[str | None]) -> Iterator[Known]:
        """Of a space and each text; nothing for a null or empty text, or if a side's joined bytes differ. Texts of WINDOW cuts are held together."""
        held: list[list[str]] = []
        size = 0
        for text in texts:
            held.append(self.cuts(text))
            size += len(held[-1]) + 1
            if size >= WINDOW:
                yield from self._joined(held)
                held, size = [], 0
        yield from self._joined(held)

    def groups(self, text: str | None) -> list[tuple[list[int], list[int]]]:
        """The token groups of a text, each the ids of either side."""
        return next(self.groups_all([text]))

    def groups_all(self, texts: Iterable[str | None]) -> Iterator[list[tuple[list[int], list[int]]]]:
        for found in self.align(texts):
            yield [tuple([int(i) for i in side.split(",")] for side in group.split("|")) for group in found[0].split(";")] if found else []

    def told(self, text: str | None) -> tuple:
        """(n_a, n_b, n_groups, n_links, groups_sha256, pairs, times): pairs are the different links, packed."""
        return next(self.told_all([text]))

    def told_all(self, texts: Iterable[str | None]) -> Iterator[tuple]:
        for found in self.align(texts):
            if not found:
                yield 0, 0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int32)
                continue
            written, links, n_a, n_b = found
            n_links = len(links) // 8
            pairs = np.sort(np.frombuffer(links, np.int64))
            first = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]]))
            times = np.diff(first, append=n_links).astype(np.int32)
            # A group of n tokens has n - 1 places where one ends.
            yield n_a, n_b, n_a + n_b - n_links, n_links, hashlib.sha256(written.encode()).hexdigest(), pairs[first], times


_ALIGNERS: dict[tuple[str, bytes], Aligner] = {}


def aligner(spec: str, model: bytes) -> Aligner:
    """The aligner of two files' contents; a worker keeps the last."""
    if (spec, model) not in _ALIGNERS:
        _ALIGNERS.clear()
        _ALIGNERS[spec, model] = Aligner(spec, model)
    return _ALIGNERS[spec, model]


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def _sent(spark, paths: tuple[str, str] | None):
    a, b = paths or default_paths()
    return spark.sparkContext.broadcast((Path(a).read_text(encoding="utf-8"), base64.b64encode(Path(b).read_bytes())))


def aligned(docs: DataFrame, text: str = "text", out: str = "groups", paths: tuple[str, str] | None = None) -> DataFrame:
    """Adds ``out``: the token groups, an array of (a, b), each an array of ids."""
    files = _sent(docs.sparkSession, paths)

    @F.pandas_udf("array<struct<a: array<int>, b: array<int>>>")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = aligner(files.value[0], base64.b64decode(files.value[1]))
        for s in texts:
            yield pd.Series([[{"a": a, "b": b} for a, b in groups] for groups in own.groups_all(s)], dtype=object)

    return docs.withColumn(out, of(text))


def _digests(text: str | Column, files) -> Column:
    @F.pandas_udf("n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = aligner(files.value[0], base64.b64decode(files.value[1]))
        for s in texts:
            yield pd.DataFrame(list(own.told_all(s)), columns=["n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])

    return of.asNondeterministic()(text)  # one pass, however many columns use it


def _linked(coded: DataFrame) -> DataFrame:
    """(row, pair, times): the different links of each document."""
    return coded.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))


def counted(linked: DataFrame, width: int) -> DataFrame:
    """(pair, total, best): how often each pair is linked, and whether no other A id is linked more often to its B id."""
    totals = linked.groupBy("pair").agg(F.sum("times").alias("total")).withColumn("b", F.col("pair") % width)
    most = totals.groupBy("b").agg(F.max("total").alias("most"))
    return totals.join(most, "b").select("pair", "total", (F.col("total") == F.col("most")).cast("long").alias("best"))


def told(docs: DataFrame, key: str = "doc_id", text: str = "text", paths: tuple[str, str] | None = None) -> DataFrame:
    """(key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each document.

    ``n_best``: links whose count is the highest of their B id; ``count_sum``: sum of the counts over the links.
    """
    spark = bounded_batches(docs.sparkSession)
    files = _sent(spark, paths)
    width = Pieces(base64.b64decode(files.value[1])).model.vocab_size()
    with scratch(spark) as own:
        coded = docs.select(F.col(key).alias("key"), _digests(text, files).alias("d")).select("key", "d.*")
        coded = own.keep(written(coded, "alignment")).withColumn("row", F.monotonically_increasing_id())
        counts = own.keep(written(counted(_linked(coded), width), "alignment-counts"))
    whole = counts.agg(F.sum("total")).first()[0] or 0
    heavy = F.broadcast(counts.where(F.col("total") * HEAVY > whole))  # fewer than HEAVY rows

    def summed(found: DataFrame) -> DataFrame:
        return found.groupBy("row").agg(F.sum(F.col("times") * F.col("best")).alias("n_best"), F.sum(F.col("times") * F.col("total")).alias("count_sum"))

    often = summed(_linked(coded).join(heavy, "pair"))
    seldom = summed(_linked(coded).join(heavy, "pair", "left_anti").join(counts.where(F.col("total") * HEAVY <= whole), "pair"))
    sums = often.unionByName(seldom).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    full = coded.drop("pairs", "times").join(sums, "row", "left")
    return full.select(F.col("key").alias(key), "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", F.lit(0)).alias("n_best"), F.coalesce("count_sum", F.lit(0)).alias("count_sum"), "groups_sha256")


def op11_alignment(spark, sf_dir: str, paths: tuple[str, str] | None = None) -> DataFrame:
    return told(read_table(spark, sf_dir, "documents").select("doc_id", "text"), paths=paths)


QUERIES = {"op11_alignment": op11_alignment}
