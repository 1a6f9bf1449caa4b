"""The pipeline's stages against brute force, each on its own input."""

import os
import random
from collections import Counter

import pytest

import corpus_pipeline as pipeline
from marlstone.llm import bpe, mixing, secrets
from marlstone import session
from marlstone.session import BATCH_BYTES
from tests.llm.test_shingles import brute_kept

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(12)
    words = {"en": "the of and this with from".split(), "fr": "les des une pour avec où".split()}
    rows = []
    for i in range(150):
        lang = rng.choice(["en", "fr"])
        rows.append((i, " ".join(rng.choice(words[lang]) + rng.choice(["", "s", "ing"]) for _ in range(rng.randrange(3, 80))), lang if i % 5 else None, rng.choice("abc"), 0))
    rows += [(200 + i, rows[3][1], "en", "a", 0) for i in range(20)] + [(300, None, "en", "a", 0), (301, "12 34", None, "b", 0), (302, rows[9][1] + ' token = "0123456789abcdef0123" done', "en", None, 0)]
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    inputs, now = {}, docs
    for name, stage in pipeline.STAGES:
        inputs[name] = now.collect()
        out = stage(spark, now, folder)
        now = spark.createDataFrame(out.collect(), out.schema)
        if name != pipeline.STAGES[-1][0]:
            assert now.columns == COLUMNS, name
    inputs["end"] = now.collect()
    names = [*[n for n, _ in pipeline.STAGES], "end"]
    given = dict(zip(names, (inputs[n] for n in names), strict=True))

    assert {r.doc_id for r in given[names[0]]} - {r.doc_id for r in given[names[1]]} == {300, 301}
    assert all(r.lang in ("en", "fr") for r in given[names[1]])

    assert {r.doc_id for r in given[names[2]]} == brute_kept({r.doc_id: r.text for r in given[names[1]]})

    scan = secrets.scanner(secrets.compiled())
    before = {r.doc_id: r for r in given[names[2]]}
    for r in given[names[3]]:
        found = secrets.scan(scan, before[r.doc_id].text)
        assert (r.text == before[r.doc_id].text) == (not found) and not secrets.scan(scan, r.text) and r.n_chars == len(r.text)
    assert len(given[names[3]]) == len(given[names[2]])

    held = {r.doc_id: r.text.split() for r in given[names[3]]}
    times = {k: Counter() for k in held}
    for r in given[names[4]]:
        times[r.doc_id].update(r.text.split())
        assert r.n_chars == len(r.text)
    assert all(n <= 2 * Counter(held[k])[w] for k, c in times.items() for w, n in c.items())
    target = {r.source: int(r.target) for r in mixing.taken(spark.createDataFrame(given[names[3]], docs.schema)).collect()}
    assert {s: sum(len(r.text.split()) for r in given[names[4]] if r.source == s) for s in target} == target

    library = __import__("tokenizers").Tokenizer.from_file(bpe.default_path())
    expected = []
    for r in given[names[4]]:
        ids = library.encode(r.text, add_special_tokens=False).ids
        expected.append((r.doc_id, ids, library.decode(ids, skip_special_tokens=False), len(ids)))
    assert sorted(expected) == sorted((r.doc_id, list(r.ids), r.decoded, r.n_tokens) for r in given["end"])


def test_run_is_the_stages_in_order(spark, folder):
    first, second = (sorted((r.doc_id, r.n_tokens) for r in pipeline.run(spark, folder).select("doc_id", "n_tokens").collect()) for _ in range(2))
    assert first == second and first


ODD = "doc_id long, text string, lang string, source string, n_chars long, _found string, _row int, _shingles int, _mix_row long, _coded string, ids string"


@pytest.mark.parametrize("stage", [s for _, s in pipeline.STAGES], ids=[n for n, _ in pipeline.STAGES])
def test_odd_rows(spark, stage):
    """Nulls in every column, repeated rows, empty and long texts, columns that a stage might use itself."""
    more = (0, "f", 1, 2, 3, "c", "i")
    rows = [(1, "the of and this with from that", "en", "a", *more), (2, "les des une pour avec cette dans", "fr", "b", *more), (None, None, None, None, *[None] * 7), (3, "", "en", None, *more), (4, " \t ", None, "a", *more)]
    rows += [(None, "the of and this with from that", None, None, *more)] * 3 + [(5, "the and " * 30_000 + "password = 'abcdefgh12345678'", "en", "a", *more)] * 2 + [(6, "x", None, None, *more)]
    docs = spark.createDataFrame(rows, ODD)
    out = stage(spark, docs, "")
    got = out.collect()
    if stage is pipeline.bpe_coding:
        assert len(got) == len(rows) and all(r.n_tokens == len(r.ids) for r in got)
        return
    assert out.columns == docs.columns
    ids = Counter(r.doc_id for r in got)
    if stage is pipeline.language_id:
        assert ids == {1: 1, 2: 1, None: 3, 5: 2, 6: 1} and all(r.lang in ("en", "fr") for r in got)
    elif stage is pipeline.near_dedup:
        assert ids == {1: 1, 2: 1, 3: 1, 5: 1, 6: 1}  # no words: 3; the copies without an id come after 1
    elif stage is pipeline.secret_scan:
        assert ids == Counter(r[0] for r in rows) and sum("[secret]" in (r.text or "") for r in got) == 2
    else:
        words = Counter()
        for r in got:
            words[r.source] += len(r.text.split())
        assert words == {r.source: int(r.target) for r in mixing.taken(docs).collect() if r.target}
    assert all(r._found == "f" and r._mix_row == 2 + 1 and r._row == 1 for r in got if r.doc_id)


@pytest.mark.parametrize("stage", [s for _, s in pipeline.STAGES], ids=[n for n, _ in pipeline.STAGES])
def test_empty_tables(spark, stage):
    assert stage(spark, spark.createDataFrame([], ODD), "").count() == 0


def test_run_leaves_the_session_and_only_its_result(spark, folder):
    shared = session.shared_dir(spark)
    before, held = spark.conf.get(BATCH_BYTES), set(os.listdir(shared))
    pipeline.run(spark, folder)
    assert spark.conf.get(BATCH_BYTES) == before
    assert [x.rpartition("-")[0] for x in set(os.listdir(shared)) - held] == ["pipeline-BPE-coding"]
