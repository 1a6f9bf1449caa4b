"""Buckets, gains, scores and ranks by plain counting; the query's SQL is in test_oracles."""

import hashlib
import math
import re
import zlib
from collections import Counter

from marlstone.llm import resampling

COLUMNS = ["doc_id", "n_words", "n_features", "weight", "score", "rank"]


def features(text, run):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return len(words), [" ".join(words[i : i + n]) for n in range(1, run + 1) for i in range(len(words) - n + 1)]


def expected(docs, target, run=1, buckets=10_000, share=10, least=20):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(bucket(f) for x in texts for f in features(x, run)[1]) for texts in ([x for _, x in docs], target))
    whole_s, whole_t = s.total(), t.total()
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (whole_s + buckets) / ((s[b] + 1) * (whole_t + buckets))))
    rows = []
    for k, text in docs:
        n, own = features(text, run)
        weight = sum(gain(bucket(f)) for f in own)
        h = int(hashlib.sha256(f"2024:{'' if k is None else k}".encode()).hexdigest()[:8], 16)
        rows.append([k, n, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    enough = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0]))
    for place, r in enumerate(enough[: share * len(enough) // 100], 1):
        r[5] = place
    return sorted(map(tuple, rows), key=str)


def rows_of(frame):
    assert frame.columns == COLUMNS
    return sorted(map(tuple, frame.collect()), key=str)


def tables(spark, docs, target):
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(x,) for x in target], "text string")


DOCS = [(i, " ".join(f"w{(i * j) % 17}é" if j % 3 else "The" for j in range(i % 40))) for i in range(200)]
TARGET = ["the w1é w2é", "w3é THE w3é", None, ""]


def test_ranks_and_runs_of_words(spark):
    for how in ({}, {"run": 2, "buckets": 97}, {"run": 3, "share": 50, "least": 1}):
        assert rows_of(resampling.resampled(*tables(spark, DOCS, TARGET), **how)) == expected(DOCS, TARGET, **how)


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (None, "alone " * 30), (4, "İstanbul K A-b_c d \U0001f600x"), (5, "same " * 20), (5, "same " * 20), (6, "word " * 50_000), (7, "-- ..")]
    for target in (TARGET, []):
        assert rows_of(resampling.resampled(*tables(spark, docs, target), share=100)) == expected(docs, target, share=100)


def test_other_columns_and_empty_tables(spark):
    docs, target = tables(spark, DOCS[:50], TARGET)
    more = docs.selectExpr("doc_id", "text", "1 as key", "2 as score", "3 as rank", "4 as bucket", "5 as _row", "6 as own")
    assert rows_of(resampling.resampled(more, target)) == expected(DOCS[:50], TARGET)
    assert rows_of(resampling.resampled(docs.limit(0), target)) == []


def test_nothing_but_totals_is_shuffled_for_scores(spark):
    docs, target = tables(spark, DOCS, TARGET)
    plan = resampling.scored(docs, target)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan and "Join" not in plan
