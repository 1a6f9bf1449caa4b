"""The filter's answers against sets, and held-out accuracy."""

import random

import zlib

import numpy as np
from pyspark.sql import functions as F

from marlstone.llm import langid

SYLLABLES = {"aa": "ta ro mi se".split(), "bb": "zu keß pfo grü".split(), "cc": "lho xe ção ni".split()}


def invented(lang, rng, words):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(words))


def corpus(n=240):
    rng = random.Random(2)
    rows = []
    for i in range(n):
        lang = rng.choice(list(SYLLABLES))
        rows.append((i, invented(lang, rng, rng.randrange(3, 60)), lang if i % 9 else None, "x"))
    return rows


def test_held_out_accuracy(spark):
    rows = corpus()
    docs = spark.createDataFrame([*rows, (900, None, "aa", ""), (901, "12 34 !", "aa", ""), (None, "ta ro", None, ""), (3, rows[3][1] * 3000, "aa", "")], "doc_id long, text string, lang string, score string")
    got = {(r.doc_id, r.lang): r.found for r in langid.identify(docs).collect()}
    named = [r for r in rows if r[2]]
    assert np.mean([got[r[0], r[2]].lang == r[2] for r in named]) > 0.98
    assert got[900, "aa"].lang == got[901, "aa"].lang == "und" and got[None, None].lang == "aa"
    assert all(0 <= f.score <= 1 for f in got.values())


def test_lookup_has_every_learnt_gram_and_few_others(spark):
    docs = spark.createDataFrame(corpus(120), "doc_id long, text string, lang string, x string")
    model = langid.learn(docs.where("lang is not null"))
    sets = {lang: {} for lang in model.languages}
    for r in docs.where("lang is not null").collect():
        for g in np.unique(np.concatenate(list(langid.grams(r.text)))):
            sets[r.lang][int(g)] = sets[r.lang].get(int(g), 0) + 1
    counts = {r.lang: r["n"] for r in docs.groupBy("lang").agg(F.countDistinct("text").alias("n")).collect()}
    text = invented("bb", random.Random(8), 200)
    own = [int(g) for g in np.concatenate(list(langid.grams(text)))]
    found, total = langid.votes(model, text)
    exact = [sum(sets[lang].get(g, 0) >= langid.SHARE * counts[lang] for g in own) for lang in model.languages]
    assert total == len(own) and np.allclose(found, exact, atol=0.02 * total)


def test_nothing_to_learn_from_and_empty(spark):
    schema = "doc_id long, text string, lang string"
    assert langid.identify(spark.createDataFrame([], schema)).count() == 0
    row = langid.identify(spark.createDataFrame([(1, "words", None)], schema)).first()
    assert (row.found.lang, row.found.score) == ("und", 0.0)


def test_pieces_of_long_texts_add_up(monkeypatch):
    text = invented("cc", random.Random(4), 500)
    whole = np.sort(np.concatenate(list(langid.grams(text))))
    monkeypatch.setattr(langid, "PIECE", 101)
    assert (np.sort(np.concatenate(list(langid.grams(text)))) == whole).all()


def test_a_language_whose_rows_are_mostly_copies(spark):
    """1,000 different texts beside 300,000 copies of one: each counts once."""
    rng = random.Random(6)
    own = {lang: [invented(lang, rng, rng.randrange(4, 30)) for _ in range(n)] for lang, n in (("aa", 2000), ("bb", 1000))}
    rows = spark.createDataFrame([(t, k) for k, texts in own.items() for t in texts], "text string, lang string")
    copies = spark.range(300_000).select(F.lit(invented("bb", rng, 12)).alias("text"), F.lit("bb").alias("lang"))
    model = langid.learn(rows.unionByName(copies), per_language=500)
    assert model.languages == ["aa", "bb"]
    for lang, texts in own.items():
        assert np.mean([langid.decide(model, t)[0] == lang for t in texts]) > 0.99


def test_predictions_against_sets(spark):
    """The query's rows against plain sets of n-grams, learnt from the same documents."""
    sf_dir = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang").collect()]
    got = langid.op5_langid(spark, sf_dir)
    assert [(f.name, f.dataType.simpleString()) for f in got.schema] == [("doc_id", "bigint"), ("held_out", "boolean"), ("lang_pred", "string"), ("score", "double")]
    rows = {r.doc_id: r for r in got.collect()}
    assert len(rows) == len(docs) and all(rows[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, _, _ in docs)
    spaced = lambda t: " " + " ".join("".join(c if c.isalpha() else " " for c in t.lower()).split()) + " "
    cut = lambda t: [s[i : i + n] for s in [spaced(t)] for n in (2, 3, 4) for i in range(len(s) - n + 1)] if spaced(t).strip() else []
    texts = {}
    for i, t, lang in docs:
        if not rows[i].held_out and lang is not None and t is not None:
            texts.setdefault(lang, set()).add(t)
    sets = {}
    for lang, own in texts.items():
        n = {}
        for t in own:
            for g in set(cut(t)):
                n[g] = n.get(g, 0) + 1
        sets[lang] = {g for g, c in n.items() if c >= langid.SHARE * len(own)}
    compared = 0
    for i, t, _ in docs:
        grams = cut(t or "")
        votes = sorted(((sum(g in s for g in grams), lang) for lang, s in sets.items()), reverse=True)
        if not grams:
            assert (rows[i].lang_pred, rows[i].score) == ("und", 0.0)
        elif votes[0][0] - votes[1][0] > 0.02 * len(grams):  # beyond what false positives may add
            compared += 1
            assert rows[i].lang_pred == votes[0][1] and abs(rows[i].score - votes[0][0] / sum(v for v, _ in votes)) < 0.02
    assert compared > 0.9 * len(docs)


def test_ties(spark):
    same = spark.createDataFrame([(i, "ta ro mi", lang) for i, lang in enumerate("cab")], "doc_id long, text string, lang string")
    assert {r.found.lang for r in langid.identify(same).collect()} <= {"a", "b", "c"}
    assert langid.decide(langid.learn(same), "ta ro mi")[0] == "a"  # the first by name


def test_all_labels_are_learnt_in_several_filters(spark, monkeypatch):
    """300 languages of their own letters: as one filter, and as filters of 16 that a task has one at a time."""
    rng = random.Random(9)
    word = lambda k: "".join(chr(0x4E00 + 40 * k + rng.randrange(12)) for _ in range(3))
    rows = [(3 * i + j, " ".join(word(i) for _ in range(12)), f"l{i:03}") for i in range(300) for j in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    whole = {r.doc_id: r.found for r in langid.identify(docs).collect()}
    monkeypatch.setattr(langid, "TOGETHER", 16)
    monkeypatch.setattr(langid, "SENT", 100)  # and the languages joined by shuffle
    found = list(langid.filters(docs))
    assert [len(f.languages) for f in found] == [16] * 18 + [12] and sorted(k for f in found for k in f.languages) == sorted({r[2] for r in rows})
    assert {r.doc_id: r.found for r in langid.identify(docs).collect()} == whole
    known = {r.lang for r in docs.where(~langid.held_out()).select("lang").distinct().collect()}
    assert len(known) > 280 and np.mean([whole[i].lang == lang for i, _, lang in rows if lang in known]) > 0.98


def test_no_workers_of_another_kind(spark, monkeypatch):
    docs = spark.createDataFrame([(n, f"{'some plain words' if n % 2 else 'andere kurze saetze'} {n}", "en" if n % 2 else "de") for n in range(40)], "doc_id long, text string, lang string")

    def refused(*_, **__):
        raise AssertionError("rows of Python objects start workers that stay in each executor")

    monkeypatch.setattr(type(spark.sparkContext), "parallelize", refused)
    found = langid.identify(docs, out="found").select("lang", "found.lang").collect()
    assert len(found) == 40 and all(a == b for a, b in found)
