"""Ids and decoded texts against the tokenizers library."""

import random

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

tokenizers = pytest.importorskip("tokenizers")

from pathlib import Path  # noqa: E402

from marlstone.llm import bpe  # noqa: E402

PARTS = ["<|startoftext|>", "<|endoftext|>", "<|", " ", "the", "'s", "'T", "İ", "Σ", "ς", "é", "é", "ẛ̣", "\x1c", "\x85", "½", "²", "x9", "einstein", "thththe", "\n", "日本", "\U0001f600"]


@pytest.fixture(scope="module")
def both():
    path = bpe.default_path()
    return bpe.Encoder(Path(path).read_text(encoding="utf-8")), tokenizers.Tokenizer.from_file(path)


def same(both, text):
    mine, library = both
    ids = mine.encode(text).tolist()
    assert ids == library.encode(text, add_special_tokens=False).ids
    assert mine.decode(ids) == library.decode(ids, skip_special_tokens=False)


@settings(deadline=None, max_examples=300)
@given(text=st.one_of(st.text(), st.lists(st.sampled_from(PARTS), max_size=30).map("".join), st.text("aeinorst", max_size=60)))
def test_any_text(both, text):
    same(both, text)


def test_every_low_character_and_long_words(both):
    for c in range(0x260):
        same(both, f"a{chr(c)}b {chr(c)}{chr(c)}")
    rng = random.Random(1)
    for n in (1000, 30_000):
        same(both, "".join(rng.choice("abcdeinrst") for _ in range(n)))


def test_columns(spark):
    texts = [None, "", "Hello hello", "a " * 50_000]
    docs = spark.createDataFrame([(i, t, "n_tokens") for i, t in enumerate(texts)], "doc_id long, text string, d string")
    path = bpe.default_path()
    ids = docs.withColumn("ids", bpe.encoded("text", path, spark))
    rows = ids.withColumn("back", bpe.decoded("ids", path, spark)).orderBy("doc_id").collect()
    library = tokenizers.Tokenizer.from_file(path)
    assert [r.ids for r in rows] == [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert rows[0].back == "" and rows[2].back == "hello</w> hello</w>"
    assert docs.limit(0).select(bpe.digests("text", path, spark)).count() == 0


def test_query_and_null_ids(spark, tmp_path):
    """Numbers and digests of the query against the library, null ids and repeated rows among them."""
    import hashlib

    texts = [None, "", "the the", "Ünïcode 日本 \U0001f600", "x" * 3000, "the the"]
    rows = [(i if i % 2 else None, t, None) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, ids_sha256 string").write.parquet(f"{tmp_path}/documents.parquet")
    library = tokenizers.Tokenizer.from_file(bpe.default_path())
    expected = []
    for i, t, _ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        whole = b"".join(x.to_bytes(4, "little") for x in ids)
        expected.append((i or 0, len(ids), hashlib.sha256(whole).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    got = bpe.op6_bpe(spark, str(tmp_path))
    assert [(f.name, f.dataType.simpleString()) for f in got.schema] == [("doc_id", "bigint"), ("n_tokens", "bigint"), ("ids_sha256", "string"), ("decoded_sha256", "string")]
    assert sorted((r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got.collect()) == sorted(expected)


def test_coding_holds_a_part_of_a_batch(spark):
    own = bpe.encoder(Path(bpe.default_path()).read_text(encoding="utf-8"))
    texts = [None, "", *[f"word {n} of a text " * (n % 50) for n in range(3000)], "long " * (bpe.PART // 2), "last"]
    parts = list(bpe.coded_parts(own, pd.Series(texts, dtype=object)))
    assert [x.tolist() for p in parts for x in p["ids"]] == [own.encode(t).tolist() for t in texts]
    assert [x for p in parts for x in p["decoded"]] == [own.decode(own.encode(t)) for t in texts]
    assert len(parts) > 4 and not list(bpe.coded_parts(own, pd.Series([], dtype=object)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = docs.coalesce(1).withColumn("c", bpe.coded("text", bpe.default_path(), spark)).orderBy("doc_id").collect()
    assert [(r.c.ids, r.c.decoded) for r in found] == [(own.encode(t).tolist(), own.decode(own.encode(t))) for t in texts]


def made_up(rng, n):
    parts = ["an", "th", "ere", "tion", "ou", "é", "ción", "schw", "x", "9", "ß", "lich", "'s", "_", "Q", "ñ"]
    return ["".join(rng.choices(parts, k=rng.randint(1, 14))) for _ in range(n)]


def test_new_words_are_encoded_together(both, monkeypatch):
    """Words that no worker has met, most of made-up text, are not encoded one by one; long words only are."""
    mine, library = both
    words = made_up(random.Random(2), 20_000)
    texts = [None, "", *[" ".join(words[i : i + 500]) for i in range(0, len(words), 500)], "a" * 300 + " <|endoftext|> 日本 the," + "?" * 60, " ".join(words[:900])]
    alone = []
    one = bpe.Encoder.word
    monkeypatch.setattr(bpe.Encoder, "word", lambda self, data: alone.append(data) or one(self, data))
    ids = [mine.encode(t) for t in texts[:2]] + [x for x in mine.encode_all(texts[2:])]
    assert all(len(data) > bpe.SHORT for data in alone) and b"a" * 300 in alone
    for t, x in zip(texts, ids):
        assert x.tolist() == library.encode(t or "", add_special_tokens=False).ids
        assert mine.decode(x) == library.decode(x.tolist(), skip_special_tokens=False)


def test_tables_that_are_dropped_and_windows(both, monkeypatch):
    """Texts of more runs than a window, tables that are full at once, few places for tests, small groups."""
    mine, library = both
    for name, value in (("MEMORY", 50), ("WINDOW", 70), ("GROUP", 9), ("TESTED", 3)):
        monkeypatch.setattr(bpe, name, value)
    monkeypatch.setattr(mine.together, "tested", mine.together.tested[:8] * 0 - 1)
    rng = random.Random(3)
    texts = [" ".join(rng.choices(made_up(rng, 40), k=rng.choice([0, 5, 200]))) for _ in range(60)]
    assert [x.tolist() for x in mine.encode_all(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(mine.known) <= 50 + 70 and len(mine.older) <= 50 + 70


def test_lookup():
    rng = random.Random(4)
    found = {rng.randrange(1 << 39): rng.randrange(1 << 24) for _ in range(5000)}
    keys = [*found, *[rng.randrange(1 << 39) for _ in range(5000)], 0]
    assert bpe.Lookup(found)(pd.Series(keys).to_numpy()).tolist() == [found.get(k, -1) for k in keys]
    assert bpe.Lookup({})(pd.Series([0, 5]).to_numpy()).tolist() == [-1, -1]
