"""Near copies by shingles against all pairs."""

import random

import corpus_pipeline as pipeline
from marlstone.llm import shingles
from tests.llm.test_simhash import brute_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute_set(text):
    words = (text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def similar(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def brute_kept(texts):
    sets = {i: brute_set(t) for i, t in texts.items()}
    return set(brute_components(sets, [(i, j) for i in sets for j in sets if i < j and similar(sets[i], sets[j])]).values())


def kept(spark, texts):
    docs = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in texts.items()], SCHEMA)
    return sorted(r.doc_id for r in pipeline.near_dedup(spark, docs, "").collect())


def planted():
    """Copies of long texts with a few changed words, similarities on both sides of 0.8; chains; short and empty texts."""
    rng = random.Random(5)
    texts = [None, "", " \t", "one", "One", "one two", "ÄÖ ß straße"]
    for _ in range(25):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(100, 500))]
        texts.append(" ".join(base))
        for share in (0.004, 0.01, 0.02, 0.022, 0.03, 0.06):
            texts.append(" ".join(f"x{rng.randrange(10**6)}" if rng.random() < share else w for w in base))
    now = [f"c{i}" for i in range(200)]  # each step is near the last, its ends are far apart
    for step in range(12):
        texts.append(" ".join(now))
        now[step * 15 : step * 15 + 15] = [f"d{step}-{i}" for i in range(15)]
    rng.shuffle(texts)
    return dict(enumerate(texts))


def test_stage_against_all_pairs(spark):
    texts = planted()
    found = kept(spark, texts)
    assert found == sorted(brute_kept(texts)) and len(found) < len(texts) - 60


def test_crowded_keys(spark):
    """Many near copies of one text, some of them near others only, and near misses of it."""
    rng = random.Random(8)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for _ in range(120):
        own = list(base)
        for _ in range(rng.randrange(0, 5)):
            own[rng.randrange(120)] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(own))
    texts = dict(enumerate(texts))
    assert kept(spark, texts) == sorted(brute_kept(texts))


def test_nothing_dissimilar_is_linked(spark):
    """One-shingle texts and permuted words share no shingle."""
    texts = {0: "a b c d e", 1: "a b c d f", 2: "e d c b a", 3: "A B c d e"}
    assert kept(spark, texts) == [0, 1, 2]


def test_bound_and_empty_table(spark):
    base = [f"w{i}" for i in range(13)]  # nine shingles
    texts = {0: " ".join(base), 1: " ".join(base[:-1]), 2: " ".join([*base[1:], "y"])}  # 8 of 9; 8 of 10, just enough
    assert similar(brute_set(texts[0]), brute_set(texts[2])) and shingles.SIMILARITY == 0.8
    assert spark.createDataFrame([(0,)], "x int").count() == 1 and kept(spark, {}) == []
    longs = [f"v{i}" for i in range(404)]
    longer = {i: " ".join(longs[:n]) for i, n in enumerate((404, 324, 323))}  # 320 of 400 shingles is 0.8
    sets = {i: brute_set(t) for i, t in longer.items()}
    assert similar(sets[0], sets[1]) and not similar(sets[0], sets[2]) and similar(sets[1], sets[2])
