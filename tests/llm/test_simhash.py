"""SimHash against a brute-force version that compares all pairs."""

import random

import pytest
import xxhash
from pyspark.sql import functions as F

from marlstone.llm import simhash
from marlstone.llm.components import components


def brute_print(text):
    words = (text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(keys, links):
    root = {k: k for k in keys}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((top(a), top(b)))
        root[b] = a
    return {k: top(k) for k in keys}


def near(prints):
    return [(i, j) for i in prints for j in prints if i < j and (prints[i] ^ prints[j]).bit_count() <= 2]


def test_against_all_pairs(spark):
    rng = random.Random(3)
    base = " ".join(rng.choice("ab cd ef gh ij kl mn op".split()) + str(rng.randrange(50)) for _ in range(400))
    texts = [None, "", " \t\n", "one", "One TWO", "one two", "ÄÖ ß straße", "x " * 5000, "x " * 4999]
    for _ in range(60):
        words = base.split()
        words[rng.randrange(len(words))] = "changed" + str(rng.randrange(9))
        texts.append(" ".join(words))
    texts += [base.upper()] * 3 + [" ".join(rng.choice("pqrst") for _ in range(rng.randrange(1, 9))) for _ in range(60)]
    rows = [(i * 7 % 1000, t, "x") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs).collect()}
    prints = {i: brute_print(t) for i, t, _ in rows}
    assert {i: r["fp"] & (1 << 64) - 1 for i, r in got.items()} == prints
    expected = brute_components(prints, near(prints))
    assert {i: r["component_id"] for i, r in got.items()} == expected
    assert {r["doc_id"] for r in simhash.one_of_each(docs).collect()} == set(expected.values())


@pytest.mark.parametrize("paired", [1, 16])
def test_crowded_keys(spark, monkeypatch, paired):
    """More fingerprints under one key than are paired off."""
    monkeypatch.setattr(simhash, "PAIRED", paired)
    rng = random.Random(paired)
    seeds = [rng.getrandbits(64) for _ in range(6)]
    prints = {s for s in seeds}
    for s in seeds:
        for _ in range(60):
            x = s
            for _ in range(rng.randrange(1, 5)):
                x ^= 1 << rng.choice([0, 1, 5, 20, 40, 63])
            prints.add(x)
    signed = {x - (1 << 64) if x >> 63 else x: x for x in prints}
    links = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()
    assert all((signed[r.a] ^ signed[r.b]).bit_count() <= 2 for r in links)
    assert brute_components(signed, [(r.a, r.b) for r in links]) == brute_components(signed, near(signed))


def test_components(spark):
    rng = random.Random(1)
    path = list(range(200))
    rng.shuffle(path)
    edges = list(zip(path, path[1:], strict=False)) + [(500, 501), (501, 500), (501, 501), (600, 600)]
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.root for r in got} == {i: 0 for i in range(200)} | {500: 500, 501: 500}


def test_empty_nulls_and_repeats(spark):
    schema = "doc_id long, text string, key string, root long"
    assert simhash.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    docs = spark.createDataFrame([(None, "a b c", "k", 1), (None, "z y x w", "k", 2), (4, "a b c", None, 3), (4, "a b c", None, 3), (4, "totally other words here", None, 4)], schema)
    got = sorted((r.doc_id or -1, r.component_id or -1) for r in simhash.near_duplicates(docs).collect())
    assert got == [(-1, -1), (-1, 4), (4, 4), (4, 4), (4, 4)]
    kept = simhash.one_of_each(docs).select("text").orderBy("text").collect()
    assert [r.text for r in kept] == ["a b c", "totally other words here", "z y x w"]
    assert simhash.near_duplicates(docs.withColumn("doc_id", F.lit(None).cast("long"))).count() == 5


def test_query(spark):
    """Fingerprints and components of the query over the supplied documents, against all pairs."""
    sf_dir = "/root/testdata/sf0.001"
    prints = {r.doc_id: brute_print(r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = simhash.op1_simhash(spark, sf_dir)
    assert [(f.name, f.dataType.simpleString()) for f in got.schema] == [("doc_id", "bigint"), ("fingerprint", "string"), ("component_id", "bigint")]
    rows = {r.doc_id: r for r in got.collect()}
    assert {i: r.fingerprint for i, r in rows.items()} == {i: f"{p:016x}" for i, p in prints.items()}
    assert {i: r.component_id for i, r in rows.items()} == brute_components(prints, near(prints))
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
