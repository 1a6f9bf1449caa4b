"""Importance resampling towards a target distribution, by hashed word features.

Every document's features (words and runs of words) become an array of bucket numbers, made by
higher-order functions in place. All arrays of the corpus, and all of the target, are counted per
bucket: the only shuffle is that of these totals, ``buckets`` rows a task at most. A bucket's gain
is the logarithm of its share in the target over its share in the corpus; the gains are one
constant array, and a document's weight is an aggregate over its own array that looks them up. So
scoring explodes nothing and joins nothing. A Gumbel variable drawn from the document's id is
added, and the highest scores are drawn: a sample without replacement in proportion to
exp(weight / 1000).

Defined results: a null text has no words; only A to Z are lowered; a document without features
has weight 0; a null id is hashed as an empty one and comes last among equal scores; equal rows
have different ranks, in any order; an empty target or corpus counts as nothing in each bucket;
empty tables give an empty result; other columns are ignored, whatever their names. The totals
that reach the driver have ``buckets`` rows.
"""

from __future__ import annotations

from math import floor, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.operators.ordered import numbered
from marlstone.session import read_table, written

BUCKETS = 10_000
RUN = 1  # words in a feature, at most
SHARE = 10  # percent of the documents that are long enough
LEAST = 20  # words
SALT = "2024:"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # what parts words; to split is many times faster than to extract
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: str | Column) -> Column:
    """Runs of digits, letters and all that isn't ASCII, A to Z in lower case; none for null."""
    body = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    return F.array_remove(F.split(F.translate(body, UPPER, LOWER), BETWEEN), "")


def features_of(words: Column, run: int = RUN) -> Column:
    """All runs of 1 to ``run`` consecutive words, joined by a space, repeats included."""
    if run == 1:
        return words
    starts = lambda n: F.sequence(F.lit(1), F.size(words) - (n - 1))
    longer = [F.when(F.size(words) >= n, F.transform(starts(n), lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>")) for n in range(2, run + 1)]  # noqa: B023
    return F.concat(words, *longer)


def buckets_of(features: Column, buckets: int = BUCKETS) -> Column:
    """The bucket of each feature: CRC-32 of its UTF-8 bytes, modulo ``buckets``."""
    return F.transform(features, lambda f: (F.crc32(f.cast("binary")) % buckets).cast("int"))


def totals(corpus: DataFrame, target: DataFrame, text: str, target_text: str, run: int = RUN, buckets: int = BUCKETS) -> list[tuple[int, int]]:
    """How often each bucket occurs in the corpus and in the target; partial counts are all that is shuffled."""
    one = lambda df, column, own: df.select(F.explode(buckets_of(features_of(words_of(column), run), buckets)).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n")).withColumn("own", F.lit(own))
    found = [[0, 0] for _ in range(buckets)]
    for r in one(corpus, text, 0).unionByName(one(target, target_text, 1)).collect():  # two rows a bucket
        found[r["bucket"]][r["own"]] = r["n"]
    return [(s, t) for s, t in found]


def gains(counted: list[tuple[int, int]]) -> list[int]:
    """Thousandths of the logarithm of (share in the target / share in the corpus), a one added to each count, rounded down."""
    n = len(counted)
    whole_s, whole_t = sum(s for s, _ in counted), sum(t for _, t in counted)
    return [floor(1000 * log(float(t + 1) * float(whole_s + n) / (float(s + 1) * float(whole_t + n)))) for s, t in counted]


def weight_of(bucketed: Column, table: list[int]) -> Column:
    """Sum of the gains of an array of buckets."""
    constant = F.split(F.lit(",".join(map(str, table))), ",").cast("array<bigint>")  # folded to one constant
    return F.aggregate(bucketed, F.lit(0).cast("bigint"), lambda whole, b: whole + F.element_at(constant, b + 1))


def gumbel(key: str | Column, salt: str = SALT) -> Column:
    """Thousandths of a standard Gumbel variable, drawn from a key's hash, rounded down."""
    named = F.concat(F.lit(salt), F.coalesce(F.col(key).cast("string") if isinstance(key, str) else key.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(named, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))


def scored(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text", run: int = RUN, buckets: int = BUCKETS, salt: str = SALT) -> DataFrame:
    """(key, n_words, n_features, weight, score) of each document."""
    table = gains(totals(docs, target, text, target_text, run, buckets))
    words = words_of(text)
    cut = docs.select(F.col(key).alias("key"), F.get(F.transform(F.array(words), lambda w: F.struct(F.size(w).alias("n"), buckets_of(features_of(w, run), buckets).alias("b"))), 0).alias("own"))
    weighed = cut.select("key", F.col("own.n").cast("long").alias("n_words"), F.size("own.b").cast("long").alias("n_features"), weight_of(F.col("own.b"), table).alias("weight"))
    return weighed.withColumn("score", F.col("weight") + gumbel("key", salt))


def resampled(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text", share: int = SHARE, least: int = LEAST, **how) -> DataFrame:
    """``scored`` and the rank of each drawn document, from 1; null for those not drawn.

    Of the N documents with ``least`` words or more, floor(share * N / 100) are drawn. Ranks are
    counted within ranges of the score and over the ranges ahead, so no task sorts them all.
    """
    rows = written(scored(docs, target, key, text, target_text, **how), "resampling").withColumn("_row", F.monotonically_increasing_id())
    enough = F.col("n_words") >= least
    drawn = share * rows.where(enough).count() // 100
    placed = numbered(rows.where(enough), [], [-F.col("score"), F.col("key").isNull(), F.col("key"), F.col("_row")], "rank")
    placed = placed.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    others = rows.where(~enough).withColumn("rank", F.lit(None).cast("long"))
    return placed.unionByName(others).select(F.col("key").alias(key), "n_words", "n_features", "weight", "score", "rank")


def op13_resampling(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    target = read_table(spark, sf_dir, "benchmark").select("text")
    return resampled(docs, target).drop("n_words")


QUERIES = {"op13_resampling": op13_resampling}
ORACLES = {
    "op13_resampling": r"""
    WITH crc AS (SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS step FROM range(256) AS r(i)),
    words AS (SELECT 0 AS own, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
              UNION ALL SELECT 1, NULL, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
    each AS (SELECT own, doc_id, unnest(w) AS word FROM words),
    hexed AS (SELECT word, hex(encode(word)) AS h FROM (SELECT DISTINCT word FROM each)),
    bytes AS (SELECT word, list_transform(range(len(h) // 2), lambda i: ('0x' || substr(h, 2 * i::INT + 1, 2))::BIGINT) AS b FROM hexed),
    bucketed AS (SELECT word, xor(list_reduce(b, lambda c, x: xor(c >> 8, step[(xor(c, x) & 255) + 1]), 4294967295), 4294967295) % 10000 AS bucket FROM bytes, crc),
    counted AS (SELECT bucket, count(*) FILTER (own = 0) AS s, count(*) FILTER (own = 1) AS t FROM each JOIN bucketed USING (word) GROUP BY bucket),
    whole AS (SELECT coalesce(sum(s), 0)::DOUBLE AS all_s, coalesce(sum(t), 0)::DOUBLE AS all_t FROM counted),
    gained AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (all_s + 10000) / ((s + 1)::DOUBLE * (all_t + 10000))))::BIGINT AS gain FROM counted, whole),
    weighed AS (SELECT doc_id, count(*) AS n, sum(gain)::BIGINT AS weight FROM each JOIN bucketed USING (word) JOIN gained USING (bucket) WHERE own = 0 GROUP BY doc_id),
    scores AS (SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
                  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
               FROM documents LEFT JOIN weighed USING (doc_id)),
    places AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS long_enough FROM scores WHERE n_features >= 20)
    SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * long_enough // 100 THEN place END AS rank FROM scores LEFT JOIN places USING (doc_id)"""
}
