"""Walks, samples, neighbours and groups against plain forms; likeness against what was edited."""

import hashlib
import random

import numpy as np
import pytest

from marlstone.llm import fingerprints as fp
from tests.oracles import SMALL

COLUMNS = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "bands_edited", "bands_next"]


def plain(text):
    """The fingerprint by walking step by step."""
    if not text:
        return bytes(fp.SLOTS)
    moves = np.random.Generator(np.random.PCG64(fp.SEED)).integers(0, 2, (fp.CLASSES, fp.PERIOD), np.int8)
    i, walk = 0, []
    while i < len(text):
        walk.append(i)
        i += int(moves[(ord(text[i]) * int(fp.CLASS_HASH) & 0xFFFFFFFF) >> 26][(len(walk) - 1) % fp.PERIOD])
    out = []
    for row in fp.MINIMA.tolist():
        at = walk[max(p for p in row if p < len(walk))]
        gram = [ord(c) for c in text[at : at + fp.GRAM]]
        out.append((sum(c * int(h) for c, h in zip(gram, fp.GRAM_HASH)) & (2**64 - 1)) >> 56)
    return bytes(out)


def prose(rng, words):
    return " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9))) for _ in range(words))


def expected(docs):
    """Rows by plain forms, for documents whose order is certain."""
    rows = []
    for n, (key, text) in enumerate(docs):
        text, after = text or "", docs[(n + 1) % len(docs)][1] or ""
        half = len(text) // 2
        new = text[: len(text) - half] + after[:half]
        own, other, next_one = plain(text), plain(new), plain(after)
        same = [[x == y for x, y in zip(own, o)] for o in (other, next_one)]
        rows.append((key, len(text), hashlib.sha256(new.encode()).hexdigest(), own.hex(), other.hex(), *[sum(s) / fp.SLOTS for s in same], *[sum(all(s[i] for i in b) for b in fp.bands()) for s in same]))
    return sorted(rows, key=str)


def rows_of(frame):
    assert frame.columns == COLUMNS
    return sorted(map(tuple, frame.collect()), key=str)


def test_walks_and_chunks(monkeypatch):
    rng = random.Random(1)
    texts = ["", "a", "ab", "aaaa", "é\U0001f600x", "x" * 500, prose(rng, 200)]
    for text in texts:
        assert fp.fingerprint(text) == plain(text)
    monkeypatch.setattr(fp, "CHUNK", 37)
    for text in texts:
        assert fp.fingerprint(text) == plain(text)


def test_likeness_falls_with_edits():
    rng = random.Random(2)
    means = []
    for edits in (0, 3, 30, 300):
        found = []
        for _ in range(20):
            text = prose(rng, 400)
            new = list(text)
            for _ in range(edits):
                at = rng.randrange(len(new))
                new[at : at + 1] = rng.choice(["", "z", new[at] + "q"])
            found.append(fp.likeness(fp.fingerprint(text), fp.fingerprint("".join(new))))
        means.append(np.mean(found))
    assert means[0] == 1 and means[1] > 0.85 and means[1] > means[2] > means[3]
    halves = [fp.likeness(fp.fingerprint(t), fp.fingerprint(fp.edited(t, prose(rng, 400)))) for t in (prose(rng, 400) for _ in range(40))]
    assert 0.4 < np.mean(halves) < 0.6
    assert np.mean([fp.likeness(fp.fingerprint(prose(rng, 300)), fp.fingerprint(prose(rng, 300))) for _ in range(40)]) < 0.05


def test_places_are_even():
    places = fp.sampled(10_000)
    assert places.min() >= 0 and places.max() < 10_000 and 4000 < places.mean() < 6000
    assert (fp.sampled(10_100) == places).mean() > 0.9


def test_bands_lose_no_pair():
    rng = random.Random(4)
    for _ in range(300):
        a = bytes(rng.randrange(256) for _ in range(fp.SLOTS))
        b = bytearray(a)
        for i in rng.sample(range(fp.SLOTS), fp.DIFFERENT):
            b[i] ^= 1
        assert fp.likeness(a, bytes(b)) >= fp.LIKENESS and fp.common_bands(a, bytes(b))


def test_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").orderBy("doc_id").collect()]
    assert rows_of(fp.op12_fingerprints(spark, SMALL)) == expected(docs)


def test_ranges_meet(spark):
    rng = random.Random(6)
    docs = [(i, prose(rng, rng.randint(0, 30))) for i in range(40)]
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert rows_of(fp.told(table)) == expected(docs)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_odd_rows(spark):
    big = (1 << 62) + 1
    docs = [(-3, None), (1, ""), (2, "x"), (3, "long " * 40_000), (big, "one \U0001f600 two"), (None, "last of all")]
    table = spark.createDataFrame([(k, t, 1, "y", 2) for k, t in docs], "doc_id long, text string, part int, kind string, row int")
    assert rows_of(fp.told(table)) == expected(docs)
    assert rows_of(fp.told(table.where("doc_id = 2"))) == expected([docs[2]])
    repeated = [(7, "same text here")] * 3
    assert rows_of(fp.told(spark.createDataFrame(repeated, "doc_id long, text string"))) == expected(repeated)
    assert rows_of(fp.told(table.limit(0))) == []


@pytest.mark.parametrize("hot", [64, 1])
def test_groups_by_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(fp, "HOT", hot)
    rng = random.Random(7)
    docs = []
    for _ in range(12):
        text = prose(rng, 60)
        for _ in range(rng.randint(1, 12)):
            docs.append((len(docs), text))
            at = rng.randrange(len(text))
            text = text[:at] + prose(rng, 3) + text[at + rng.randint(0, 40) :]
    docs += [(None, docs[0][1]), (len(docs), None), (len(docs) + 1, "")]
    prints = [fp.fingerprint(t) for _, t in docs]
    root = list(range(len(docs)))
    for _ in docs:
        for i in range(len(docs)):
            for j in range(len(docs)):
                if fp.likeness(prints[i], prints[j]) >= fp.LIKENESS:
                    root[i] = root[j] = min(root[i], root[j])
    found = {(r.doc_id, r.fingerprint): r.group for r in fp.similar(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    least = {}
    for i, (k, _) in enumerate(docs):
        if k is not None:
            least[root[i]] = min(k, least.get(root[i], k))
    assert found == {(k, p.hex()): least[root[i]] for i, ((k, _), p) in enumerate(zip(docs, prints))}
    assert 1 < len(set(found.values())) < len(docs) - 3
    assert fp.similar(spark.createDataFrame([], "doc_id long, text string")).count() == 0
