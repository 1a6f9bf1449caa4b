"""Key phrases and texts against a search of every position; the contract's phrases are written out here."""

import random
import re

from pyspark.sql import functions as F

from marlstone.llm import licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BASE = {"mit": "mit license", "apache": "apache license", "gpl": "general public license"}
PARTS = ["MIT", "License", "apache", "general", "public", "GNU", "license,", "Version 2.0", "the", "under", "Licensed", "é", "x9", "lesser", "all rights reserved", "CC BY-NC 4.0", "\x00", "\n", "--", "İ", "of", "\u212a"]


def words_of(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute_base(text):
    words = words_of(text)
    places = sorted((i, k) for k, p in BASE.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split())
    return len(words), places, ",".join(sorted({k for _, k in places}))


def brute(text):
    words, found, score = words_of(text), [], 0.0
    for t in licenses.templates():
        own = t["words"]
        for s in range(-len(own), len(words)):
            n = sum(0 <= s + i < len(words) and words[s + i] == w for i, w in enumerate(own))
            at = s + t["lead"]
            if n >= len(own) - t["off"] and at >= 0 and words[at : at + len(t["phrase"])] == t["phrase"]:
                found.append((s, t["label"], round(n / len(own), 9), t["text"]))
                score = max(score, n / len(own) if t["text"] else licenses.PHRASE_SCORE)
    return sorted(found), ",".join(sorted({x[1] for x in found})), score


def changed(words, rng, n):
    """``n`` words of a text replaced."""
    out = list(words)
    for i in rng.sample(range(len(out)), n):
        out[i] = rng.choice(["x9", "the", "license", "software"])
    return " ".join(out)


def test_every_position(spark):
    rng = random.Random(9)
    texts = [None, "", " .,", "mit license mit license", "general public license general public", "license " * 3000 + "mit license"]
    texts += [" ".join(rng.choice(PARTS) for _ in range(rng.randrange(0, 40))) for _ in range(200)]
    texts += [f"{rng.choice(PARTS)} {t.upper()}. {rng.choice(PARTS)}" for own in licenses.TEXTS.values() for t in own]
    for t in licenses.templates():
        if t["text"]:
            texts += [changed(t["words"], rng, n) for n in {1, t["off"] // 2, t["off"], t["off"] + 1}]
            texts += [" ".join(t["words"][t["lead"] :]), " ".join([*t["words"][: len(t["words"]) // 2], "inserted", *t["words"][len(t["words"]) // 2 :]])]
    docs = spark.createDataFrame([(i if i % 9 else None, t, "label", i, i) for i, t in enumerate(texts)], "doc_id long, text string, labels string, _words int, _HITS int").repartition(8)
    out = licenses.find_licenses(docs)
    assert out.columns == [*docs.columns, "license"]
    counted = 0
    for r in out.collect():
        got = r.license
        based = [(p.start, p.label) for p in got.places if not p.text and p.label in BASE]
        assert (got.n_words, sorted(based), got.base_labels) == brute_base(r.text), r.text
        assert (sorted((p.start, p.label, round(p.share, 9), p.text) for p in got.places), got.labels, got.score) == brute(r.text), r.text
        counted += sum(p.text for p in got.places)
    assert counted > 40


def test_index_begins_with_the_rarest_words(spark):
    docs = spark.createDataFrame([("public license",)] * 5 + [("general",)], "text string")
    frequencies = licenses.document_frequencies(docs)
    assert (frequencies["public"], frequencies["general"], frequencies["mozilla"]) == (5, 1, 0)
    table = spark.range(1).select(F.explode(licenses.index(frequencies)).alias("t")).select("t.*").collect()
    gpl = next(t for t in table if t.label == "gpl" and not t.text)
    assert [(p.word, p.at) for p in gpl.places] == [("general", 0), ("license", 2), ("public", 1)]
    assert licenses.find_licenses(docs.limit(0)).count() == 0


def test_a_file_is_found_by_its_rarest_words_only(spark):
    """Of a text whose common words are all there, out of place, nothing is found; two rare words in place are looked up."""
    text = next(t for t in licenses.templates() if t["label"] == "mpl" and t["text"])
    docs = spark.createDataFrame([(" ".join(text["words"]),), (" ".join(sorted(text["words"])),), ("the of and to " * 500 + " ".join(text["words"]),)], "text string")
    got = [[(p.start, p.text) for p in r.license.places if p.label == "mpl"] for r in licenses.find_licenses(docs).collect()]
    assert got == [[(0, True), (text["lead"], False)], [], [(2000, True), (2000 + text["lead"], False)]]


def test_very_long_text(spark):
    text = "word licence public general software " * 60_000 + " Released under the MIT License. " + "license mit " * 20_000
    r = licenses.find_licenses(spark.createDataFrame([(text,)], "text string")).first().license
    assert (r.n_words, r.base_labels, sum(not p.text for p in r.places)) == (340_005, "mit", 20_000)
