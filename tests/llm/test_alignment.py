"""Token groups and links against the two libraries, byte by byte."""

import hashlib
import random
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sentencepiece = pytest.importorskip("sentencepiece")
tokenizers = pytest.importorskip("tokenizers")

from marlstone.llm import alignment  # noqa: E402
from tests.oracles import SMALL  # noqa: E402

PARTS = [" ", "  ", "\n", "\t", "a", "the", "The", "'s", "don't", "é", "日本語", "\U0001f600", "▁", "<s>", "</s>", "<unk>", "<0x41>", "<|endoftext|>", "\x1c", "\x85", "\xa0", " ", "\x00", "123", "...", "!!", "x" * 70, "\r\n", "ﬁ", "é", "​", "﻿", "　", "①"]


class Libraries:
    """Both encoders as published, and groups and links by comparing ends."""

    def __init__(self, a, b):
        self.a, self.b = tokenizers.Tokenizer.from_file(a), sentencepiece.SentencePieceProcessor(model_file=b)
        self.a.encode_special_tokens = True
        self.decoder = tokenizers.decoders.ByteLevel()
        _, self.bytes_a = alignment.byte_level(Path(a).read_text(encoding="utf-8"))

    def tokens(self, text):
        if not text:
            return [], []
        data = (" " + text).encode()
        a = [(i, self.bytes_a[i]) for i in self.a.encode(" " + text, add_special_tokens=False).ids]
        b = [(i, bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()) for i in self.b.encode(text) for p in [self.b.id_to_piece(i)]]
        return (a, b) if all(b"".join(x for _, x in own) == data for own in (a, b)) else ([], [])

    def groups(self, text):
        a, b = self.tokens(text)
        out, at, own, i, j = [], [0, 0], ([], []), 0, 0
        while i < len(a) or j < len(b):
            if at[0] <= at[1]:
                own[0].append(a[i][0])
                at[0], i = at[0] + len(a[i][1]), i + 1
            else:
                own[1].append(b[j][0])
                at[1], j = at[1] + len(b[j][1]), j + 1
            if at[0] == at[1]:
                out.append(own)
                own = ([], [])
        return out

    def links(self, text):
        a, b = self.tokens(text)
        spans = []
        for own in (a, b):
            at, found = 0, []
            for i, x in own:
                found.append((i, at, at + len(x)))
                at += len(x)
            spans.append(found)
        first, out = 0, []
        for i, lo, hi in spans[0]:
            while first < len(spans[1]) and spans[1][first][2] <= lo:
                first += 1
            k = first
            while k < len(spans[1]) and spans[1][k][1] < hi:
                out.append((i, spans[1][k][0]))
                k += 1
        return out


def as_text(groups):
    return ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups)


def expected(libraries, docs):
    """Rows of the query by plain counting."""
    linked = {k: libraries.links(t) for k, t in docs}
    counts = Counter(p for own in linked.values() for p in own)
    most = {}
    for (_, b), n in counts.items():
        most[b] = max(most.get(b, 0), n)
    rows = []
    for k, t in docs:
        groups, own = libraries.groups(t), linked[k]
        digest = hashlib.sha256(as_text(groups).encode()).hexdigest() if groups else ""
        n_a, n_b = (sum(len(g[side]) for g in groups) for side in (0, 1))
        rows.append((k, n_a, n_b, len(groups), len(own), sum(counts[p] == most[p[1]] for p in own), sum(counts[p] for p in own), digest))
    return sorted(rows, key=str)


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def libraries():
    return Libraries(*alignment.default_paths())


@pytest.fixture(scope="module")
def aligner():
    a, b = alignment.default_paths()
    return alignment.Aligner(Path(a).read_text(encoding="utf-8"), Path(b).read_bytes())


def test_random_texts(aligner, libraries):
    rng = random.Random(3)
    for _ in range(3000):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 12)))
        groups = libraries.groups(text)
        assert aligner.groups(text) == groups
        assert aligner.told(text)[4] == (hashlib.sha256(as_text(groups).encode()).hexdigest() if groups else "")


def test_table_of_cuts_is_emptied_and_long_cuts_hold(aligner, libraries, monkeypatch):
    monkeypatch.setattr(alignment, "KEPT", 5)
    rng = random.Random(5)
    for _ in range(300):
        text = " ".join("".join(rng.choice("aeinrst") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(1, 20)))
        assert aligner.groups(text) == libraries.groups(text)
    for text in ["ab" * 20000, "a" * 30000, " " * 5000, "word " * 20000]:
        assert aligner.groups(text) == libraries.groups(text)


def of_libraries(libraries, text):
    """What ``told`` gives of a text, its pairs counted."""
    groups, links = libraries.groups(text), libraries.links(text)
    digest = hashlib.sha256(as_text(groups).encode()).hexdigest() if groups else ""
    return *(sum(len(g[side]) for g in groups) for side in (0, 1)), len(groups), len(links), digest, Counter(a << 32 | b for a, b in links)


def counted(aligner, found):
    *plain, pairs, times = found
    a, b = pairs // aligner.width, pairs % aligner.width
    return *plain, Counter(dict(zip((a << 32 | b).tolist(), times.tolist())))


def encodings(aligner, monkeypatch):
    """The strings that an aligner has encoded since, both tables empty."""
    said, both = [], aligner._both
    monkeypatch.setattr(aligner, "kept", {})
    monkeypatch.setattr(aligner, "older", {}, raising=False)
    monkeypatch.setattr(aligner, "_both", lambda text: said.append(text) or both(text))
    return said


def test_cuts_met_are_not_encoded_again(aligner, monkeypatch):
    said = encodings(aligner, monkeypatch)
    monkeypatch.setattr(alignment, "KEPT", 4)
    first = [str(x) for x in aligner.told("one two three four")]
    aligner.told("five six seven")
    n = len(said)
    assert [str(x) for x in aligner.told("one two three four")] == first and len(said) == n


def test_new_cuts_of_many_texts_are_encoded_together(aligner, libraries, monkeypatch):
    said = encodings(aligner, monkeypatch)
    rng = random.Random(7)
    texts = [" ".join("".join(rng.choice("aeinrst") for _ in range(9)) for _ in range(20)) for _ in range(100)]
    assert [counted(aligner, x) for x in aligner.told_all(texts)] == [of_libraries(libraries, t) for t in texts]
    assert len(said) <= sum(map(len, texts)) // alignment.PART + 1


def test_texts_together(aligner, libraries, monkeypatch):
    """Odd cuts and long ones among others, and cuts of which one side's bytes differ."""
    rng = random.Random(9)
    texts = [None, "", " ", "a▁b c", "x" * 200 + " end ", *("".join(rng.choice(PARTS) for _ in range(rng.randint(0, 30))) for _ in range(400))]
    wanted = [of_libraries(libraries, t) for t in texts]
    for part, window in [(1 << 15, 1 << 15), (40, 7)]:
        encodings(aligner, monkeypatch)
        monkeypatch.setattr(alignment, "PART", part)
        monkeypatch.setattr(alignment, "WINDOW", window)
        assert [counted(aligner, x) for x in aligner.told_all(texts)] == wanted
        assert max(map(len, aligner.kept)) <= alignment.SHORT


def test_texts_are_encoded_apart_if_pieces_hold_spaces(aligner, libraries, monkeypatch):
    said = encodings(aligner, monkeypatch)
    monkeypatch.setattr(aligner.pieces, "apart", False)
    texts = ["one two", "three", "two  three\n", "four five"]
    assert [counted(aligner, x) for x in aligner.told_all(texts)] == [of_libraries(libraries, t) for t in texts]
    assert sorted(said) == sorted(" " + t for t in texts)


def test_query(spark, libraries):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    found = alignment.op11_alignment(spark, SMALL)
    assert found.columns == COLUMNS
    assert sorted(map(tuple, found.collect()), key=str) == expected(libraries, docs)


def test_seldom_pairs_are_joined(spark, libraries, monkeypatch):
    monkeypatch.setattr(alignment, "HEAVY", 50)  # so that most pairs are seldom
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").limit(60).collect()]
    found = alignment.told(spark.createDataFrame(docs, "doc_id long, text string"))
    assert sorted(map(tuple, found.collect()), key=str) == expected(libraries, docs)


def test_odd_rows(spark, libraries):
    texts = [None, "", " ", "a▁b", "one two", "one two", "<|endoftext|> <s>", "word " * 3000 + "x" * 3000]
    docs = [(i if i != 4 else None, t) for i, t in enumerate(texts)]
    table = spark.createDataFrame([(i, t, 1, 2, "x") for i, t in docs], "doc_id long, text string, pair int, row int, groups string")
    assert sorted(map(tuple, alignment.told(table).collect()), key=str) == expected(libraries, docs)
    rows = alignment.aligned(table.drop("groups")).select("text", F.transform("groups", lambda g: F.array(g["a"], g["b"])).alias("g")).collect()
    assert all([(a, b) for a, b in r.g] == libraries.groups(r.text) for r in rows)


def test_empty_table(spark):
    found = alignment.told(spark.createDataFrame([], "doc_id long, text string"))
    assert found.columns == COLUMNS and found.count() == 0
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    found = alignment.op11_alignment(spark, SMALL)
    assert found.columns == COLUMNS
    assert sorted(map(tuple, found.collect()), key=str) == expected(libraries, docs)


def test_seldom_pairs_are_joined(spark, libraries, monkeypatch):
    monkeypatch.setattr(alignment, "HEAVY", 50)  # so that most pairs are seldom
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").limit(60).collect()]
    found = alignment.told(spark.createDataFrame(docs, "doc_id long, text string"))
    assert sorted(map(tuple, found.collect()), key=str) == expected(libraries, docs)


def test_odd_rows(spark, libraries):
    texts = [None, "", " ", "a▁b", "one two", "one two", "<|endoftext|> <s>", "word " * 3000 + "x" * 3000]
    docs = [(i if i != 4 else None, t) for i, t in enumerate(texts)]
    table = spark.createDataFrame([(i, t, 1, 2, "x") for i, t in docs], "doc_id long, text string, pair int, row int, groups string")
    assert sorted(map(tuple, alignment.told(table).collect()), key=str) == expected(libraries, docs)
    rows = alignment.aligned(table.drop("groups")).select("text", F.transform("groups", lambda g: F.array(g["a"], g["b"])).alias("g")).collect()
    assert all([(a, b) for a, b in r.g] == libraries.groups(r.text) for r in rows)


def test_empty_table(spark):
    found = alignment.told(spark.createDataFrame([], "doc_id long, text string"))
    assert found.columns == COLUMNS and found.count() == 0
