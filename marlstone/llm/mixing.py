"""Mixing sources to target weights with a low-discrepancy schedule.

Targets: the sources' weights share ``share`` times all words; a target stops at ``repeats``
times its source's size and the excess goes to the others by weight.

A source's documents are shuffled by a hash and laid end to end, ``repeats`` times over; the
first ``target`` words are cut into blocks of ``block`` words. The mix has a slot for each
block. Slot n has the lattice point n * g mod N, with g next to N / golden ratio and coprime
to N: the golden-ratio sequence rounded to N-ths, which visits every N-th once, so each
source's share of the cumulative weights holds exactly as many points as it has blocks, and
any stretch of slots is close to the weights. Slots are ranked within their source, and the
slot of rank k is joined to the source's block k.

Running sums and ranks are taken in two levels (within hash or slot ranges, then over the
ranges' totals), so a source with a third of all rows is spread over many tasks. The number of
ranges grows with the rows; rows equal in everything that counts are numbered first and dealt by
that number, so a group of them is spread likewise.

Defined results: null texts have size 0; sizes of 0 take no words; null sources are a source
of their own, last by name; a source without words has target 0; repeated rows and ids are
rows of their own (equal rows in any order); an empty table gives an empty result; other
columns are ignored, and pass through ``mixed`` (the operator's own take free names).
"""

from __future__ import annotations

from math import gcd

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.session import free_name, read_table, scratch, written

WEIGHTS = (3, 1, 2)
SHARE = 1.5
REPEATS = 2
BLOCK = 1024  # words
CHUNK = 1 << 14  # slots ranked together
BINS = 512  # hash ranges a source's documents are dealt to, at least
BIN_ROWS = 1 << 13  # rows in a range, about
BLANK = r"[\x20\x09-\x0D]++"


def n_words(text: str | Column) -> Column:
    """Number of runs of anything but ASCII white space."""
    body = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    return F.regexp_count(body, F.lit(r"[^\x20\x09-\x0D]++")).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """(source, source_size, target) of ``sizes`` (columns source, size), a row per source.

    The level x with sum(min(repeats * size, x * weight)) = share * total is found by rounds of
    one aggregate each; only that row of sums reaches the driver.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))  # a row per source
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(order - 1, F.lit(len(weights))) + 1)
    named = written(totals.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * float(repeats)).alias("cap")), "mix-sources")
    wanted = float(share * (named.agg(F.sum("source_size")).first()[0] or 0))
    full = F.lit(False)
    free = named.agg(F.sum("weight")).first()[0] or 0.0
    level, held = (wanted / free if free else 0.0), -1
    while True:
        full = F.col("cap") <= level * F.col("weight")
        n, capped, free = named.agg(F.count_if(full), F.sum(F.when(full, F.col("cap"))), F.sum(F.when(~full, F.col("weight")))).first()
        if n == held or not free:
            break
        level, held = (wanted - (capped or 0.0)) / free, n
    return named.select("source", "source_size", F.when(full, F.col("cap")).otherwise(level * F.col("weight")).alias("target"))


def _before(df: DataFrame, group: list[str], part: str, order: list, amount: str, label: str) -> DataFrame:
    """Adds ``before``: the sum of ``amount`` over the rows ahead, by ``part`` and then ``order``, in each group."""
    df = written(df, label)
    sums = df.groupBy(*group, part).agg(F.sum(amount).alias("_sum"))
    ahead = Window.partitionBy(*group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = written(sums.select(*group, part, F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_offset")), f"{label}-offsets")
    within = Window.partitionBy(*group, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = df.select("*", F.coalesce(F.sum(amount).over(within), F.lit(0)).alias("_within"))
    same = [own[c].eqNullSafe(offsets[c]) for c in [*group, part]]
    joined = own.join(offsets, same)
    return joined.select(*[own[c] for c in df.columns], (F.col("_offset") + F.col("_within")).alias("before"))


def _dealt(sized: DataFrame) -> DataFrame:
    """Equal rows (column ``at``) numbered, and ``at`` drawn anew from that number; column ``row`` tells rows apart."""
    repeated = written(sized.groupBy("at").agg(F.count("*").alias("_n")).where("_n > 1").select("at"), "mix-repeated")
    told = sized.join(repeated, "at").withColumn("_part", F.shiftright("row", 33)).withColumn("_one", F.lit(1).cast("long"))
    places = _before(told, ["at"], "_part", ["row"], "_one", "mix-equal")
    places = places.select(*sized.columns, "before").unionByName(sized.join(repeated, "at", "left_anti").withColumn("before", F.lit(0).cast("long")))
    return written(places.withColumn("at", F.xxhash64("at", "before")).drop("before"), "mix-dealt")


def _step(n: int) -> int:
    """The number next to n / golden ratio that is coprime to n."""
    g = max(1, round(n * (5**0.5 - 1) / 2))
    while gcd(g, n) > 1:
        g += 1
    return g


def schedule(aims: DataFrame, block: int = BLOCK) -> DataFrame:
    """(slot, number, rank): the mix's slots in order, the number of each one's source, its rank there.

    ``aims``: (number, blocks), a row per source.
    """
    spark = aims.sparkSession
    n = aims.agg(F.sum("blocks")).first()[0] or 0
    ahead = Window.orderBy("number").rowsBetween(Window.unboundedPreceding, -1)  # a row per source
    ranges = aims.where("blocks > 0").select("number", F.coalesce(F.sum("blocks").over(ahead), F.lit(0)).alias("lo"), "blocks")
    # a source's share of the points is looked up by equal-width cells: an equi-join, evenly dealt
    width = max(1, n // 4096)
    cells = ranges.select("number", "lo", (F.col("lo") + F.col("blocks")).alias("hi"))
    cells = cells.select("*", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width))).alias("cell"))
    point = F.pmod(F.col("id").cast("decimal(38,0)") * F.lit(_step(max(n, 1))).cast("decimal(19,0)"), F.lit(max(n, 1)).cast("decimal(19,0)")).cast("long")
    slots = spark.range(n).select(F.col("id").alias("slot"), point.alias("point"))
    slots = slots.withColumn("cell", F.floor(F.col("point") / width))
    owned = slots.join(cells, "cell").where("point >= lo and point < hi")
    owned = owned.select("slot", "number", F.floor(F.col("slot") / CHUNK).alias("chunk"), F.lit(1).cast("long").alias("one"))
    return _before(owned, ["number"], "chunk", ["slot"], "one", "mix-slots").select("slot", "number", F.col("before").alias("rank"))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS, share: float = SHARE, repeats: int = REPEATS, block: int = BLOCK, row: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The mix, and the documents it is made of.

    Mix: (slot, row, key, epoch, first, words): the words of document ``row`` from ``first`` on that
    the slot holds. Documents: (row, key, source, size, source_size, target). ``row`` is the column
    of that name, or else a number given here.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    given = F.col(row) if row else F.monotonically_increasing_id()
    sized = docs.select(F.col(key).alias("key"), F.col(source).alias("source"), n_words(text).alias("size"), F.xxhash64(F.lit("mix"), key, F.crc32(body), F.length(body), source).alias("at"), given.alias("row"))
    sized = _dealt(written(sized, "mix-sizes"))
    aims = targets(sized, weights, share, repeats)
    number = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())).cast("long")  # a row per source
    aims = written(aims.select("*", number.alias("number"), F.ceil(F.floor("target") / block).alias("blocks")), "mix-targets")

    named = sized.join(aims, sized["source"].eqNullSafe(aims["source"])).select("key", sized["source"], "size", "at", "number", "source_size", "target", F.floor("target").alias("words"), "row")
    bins = max(BINS, 1 << (sized.count() // BIN_ROWS).bit_length())
    binned = named.withColumn("bin", F.shiftrightunsigned("at", 64 - bins.bit_length() + 1))
    laid = written(_before(binned, ["number"], "bin", ["at", "key", "size"], "size", "mix-laid"), "mix-rows")

    runs = laid.where("size > 0 and source_size > 0").select("row", "key", "number", "words", "size", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("epoch"), "before", "source_size")
    runs = runs.withColumn("start", F.col("before") + F.col("epoch") * F.col("source_size")).withColumn("stop", F.least(F.col("start") + F.col("size"), "words")).where("start < stop")
    pieces = runs.select("*", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("stop") - 1) / block))).alias("rank"))
    begin, end = F.greatest("start", F.col("rank") * block), F.least("stop", (F.col("rank") + 1) * block)
    pieces = pieces.select("number", "rank", "row", "key", "epoch", (begin - F.col("start")).alias("first"), (end - begin).alias("words"))
    slots = schedule(aims.select("number", "blocks"), block)
    placed = pieces.join(slots, ["number", "rank"]).select("slot", "row", "key", "epoch", "first", "words")
    return placed, laid.select("row", "key", "source", "size", "source_size", "target")


def taken(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **how) -> DataFrame:
    """(key, source, size, source_size, target, taken), a row per document: what the mix takes of it."""
    placed, rows = mix(docs, key, text, source, **how)
    words = placed.groupBy("row").agg(F.sum("words").alias("taken"))
    return rows.join(words, "row", "left").select(F.col("key").alias(key), "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **how) -> DataFrame:
    """``docs`` as the mix takes them: a row for each piece of a document that a slot holds.

    The words of the rows are those of the mix, so each source meets its target to a word. A document
    taken whole keeps its text; a piece has its words, one blank between them. Documents without
    words have nothing to take and go. The mix's order is that of ``mix``'s slots, and isn't kept here.
    """
    number, cuts = free_name(docs, "mix_row"), free_name(docs, "cuts")
    with scratch(docs.sparkSession) as own:
        held = own.keep(written(docs.withColumn(number, F.monotonically_increasing_id()), "mix-docs"))
        placed, rows = mix(held, key, text, source, row=number, **how)
        placed = placed.join(rows.select("row", "size"), "row")  # a document's cuts are as many as its blocks
        taken_as = own.keep(written(placed.groupBy(F.col("row").alias(number)).agg(F.collect_list(F.struct("first", "words", (F.col("words") == F.col("size")).alias("whole"))).alias(cuts)), "mix-cuts"))
    joined = held.join(taken_as.hint("merge"), number)  # the same plan at every size

    def cut(words):
        return lambda c: F.when(c["whole"], F.col(text)).otherwise(F.array_join(F.slice(words, (c["first"] + 1).cast("int"), c["words"].cast("int")), " "))

    partly = F.exists(cuts, lambda c: ~c["whole"])
    words = F.when(partly, F.array_remove(F.split(text, BLANK), "")).otherwise(F.array().cast("array<string>"))
    pieces = F.flatten(F.transform(F.array(words), lambda w: F.transform(cuts, cut(w))))
    others = [c for c in docs.columns if c != text]
    return joined.select(*others, F.explode(pieces).alias(text)).select(*docs.columns)


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return taken(docs).drop("source")


QUERIES = {"op9_mixing": op9_mixing}
