"""Targets, amounts, order and determinism of the mix."""

import random
from collections import Counter, defaultdict

import pytest

from marlstone.llm import mixing


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, repeats=2):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, out, free = share * sum(sizes.values()), {}, set(names)
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] >= repeats * sizes[s]}
        if not over:
            break
        for s in over:
            out[s] = float(repeats * sizes[s])
            left -= out[s]
        free -= over
    return out | {s: level * weight[s] for s in free}


def corpus(spark, n=300):
    rng = random.Random(6)
    rows = [(i if i % 11 else 5, " ".join(["w"] * rng.randrange(0, 90)) if i % 13 else None, rng.choice(["a", "a", "a", "a", "B", "é", "", None, "\U0001f600", "￿"]), 1) for i in range(n)]
    return spark.createDataFrame([*rows, (1000, "long " * 5000, "B", 2)], "doc_id long, text string, source string, size int")


@pytest.mark.parametrize("block", [7, 256])
def test_amounts(spark, block):
    docs = corpus(spark)
    rows = mixing.taken(docs, block=block).collect()
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in rows:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 2 * r.size
    assert len(rows) == docs.count() and all(r.source_size == sizes[r.source] for r in rows)
    expected = brute_targets(sizes)
    assert all(abs(target[s] - expected[s]) < 1e-6 * expected[s] + 1e-9 for s in sizes)
    assert all(taken[s] == int(target[s]) for s in sizes)
    again = mixing.taken(docs.repartition(5), block=block).collect()
    key = lambda r: (r.doc_id, r.source or "", r.size, r.taken)
    assert sorted(map(key, rows)) == sorted(map(key, again))


def test_slots_are_low_discrepancy(spark):
    blocks = {1: 700, 2: 100, 3: 1, 4: 0, 5: 350}
    rows = mixing.schedule(spark.createDataFrame(list(blocks.items()), "number long, blocks long")).orderBy("slot").collect()
    n = sum(blocks.values())
    assert [r.slot for r in rows] == list(range(n))
    seen = defaultdict(int)
    for i, r in enumerate(rows):
        assert r["rank"] == seen[r.number]
        seen[r.number] += 1
        assert all(abs(seen[s] - (i + 1) * b / n) < 4 for s, b in blocks.items())
    assert all(seen[s] == b for s, b in blocks.items())


def test_every_slot_is_a_block_of_its_source(spark):
    placed, rows = mixing.mix(corpus(spark), block=50)
    words = defaultdict(int)
    for r in placed.collect():
        words[r.slot] += r.words
    full = sorted(words.values())
    assert full[-1] == 50 and sum(w < 50 for w in full) <= rows.select("source").distinct().count()
    assert sorted(words) == list(range(len(words)))


def test_empty_and_wordless(spark):
    schema = "doc_id long, text string, source string"
    assert mixing.taken(spark.createDataFrame([], schema)).count() == 0
    rows = mixing.taken(spark.createDataFrame([(1, None, None), (None, " \t", "a")], schema)).collect()
    assert [(r.size, r.target, r.taken) for r in rows] == [(0, 0.0, 0)] * 2


def test_taken_of_each_document(spark):
    """Per document against a plain walk along each source's documents, in the order the hash gives."""
    docs = corpus(spark)
    placed, rows = mixing.mix(docs, block=64)
    took = Counter()
    for r in placed.collect():
        took[r.row] += r.words
    order = {r.row: r.at for r in mixing._dealt(docs.select(*[mixing.F.col(c) for c in ("doc_id", "source")], mixing.n_words("text").alias("size"), mixing.F.xxhash64(mixing.F.lit("mix"), "doc_id", mixing.F.crc32(mixing.F.coalesce("text", mixing.F.lit(""))), mixing.F.length(mixing.F.coalesce("text", mixing.F.lit(""))), "source").alias("at"), mixing.F.monotonically_increasing_id().alias("row"))).collect()}
    by_source = defaultdict(list)
    for r in rows.collect():
        by_source[r.source].append((order[r.row] & (1 << 64) - 1, r.row, r.size, int(r.target)))
    for own in by_source.values():
        left = own[0][3]
        expected = Counter()
        for _, row, size, _ in sorted(own) * 2:  # twice round at most
            expected[row] += min(size, left)
            left -= min(size, left)
        assert left == 0 and all(took[row] == expected[row] for _, row, _, _ in own)


def test_a_third_of_all_rows_are_equal(spark):
    rng = random.Random(1)
    rows = [(None, "same words here", "a")] * 200 + [(i, " ".join(["w"] * rng.randrange(1, 30)), rng.choice("ab")) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    one, other = (sorted((r.doc_id or -1, r.size, r.taken) for r in mixing.taken(x, block=16).collect()) for x in (docs, docs.repartition(7, "text")))
    assert one == other
    sized = docs.select(mixing.F.xxhash64("text").alias("at"), mixing.F.monotonically_increasing_id().alias("row"))
    assert mixing._dealt(sized).select("at").distinct().count() == 600


def test_mixed_emits_the_words_of_the_mix(spark):
    rng = random.Random(4)
    rows = [(i if i % 9 else None, "".join(rng.choice([" ", "\n", "\t "]) + f"w{i}-{j}" for j in range(rng.randrange(0, 60))), rng.choice(["a", "a", "b", None]), i, "x") for i in range(150)]
    rows += [(500, " ".join(f"long{j}" for j in range(4000)), "b", 1, "y"), (501, None, "b", 1, "y"), (502, "", None, 1, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, _mix_row int, _cuts string")
    out = mixing.mixed(docs, block=64)
    assert out.columns == docs.columns
    got = out.collect()
    texts = {r.text for r in docs.collect()}
    words, pieces = defaultdict(int), defaultdict(Counter)
    for r in got:
        words[r.source] += len(r.text.split())
        pieces[r.source].update(r.text.split())
        assert r.text in texts or "  " not in r.text
    target = {r.source: int(r.target) for r in mixing.taken(docs, block=64).collect()}
    assert dict(words) == {s: t for s, t in target.items() if t}
    assert max(n for c in pieces.values() for n in c.values()) <= 2
    assert mixing.mixed(docs.limit(0)).count() == 0


def test_query(spark):
    got = mixing.op9_mixing(spark, "/root/testdata/sf0.001")
    assert [(f.name, f.dataType.simpleString()) for f in got.schema] == [("doc_id", "bigint"), ("size", "bigint"), ("source_size", "bigint"), ("target", "double"), ("taken", "bigint")]
    docs = {r.doc_id: r for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in got.collect():
        doc = docs[r.doc_id]
        assert r.size == len((doc.text or "").encode().split()) and 0 <= r.taken <= 2 * r.size
        sizes[doc.source] += r.size
        taken[doc.source] += r.taken
        target[doc.source] = r.target
    expected = brute_targets(sizes)
    assert all(abs(target[s] - expected[s]) < 1e-6 * expected[s] and taken[s] == int(target[s]) for s in sizes)
