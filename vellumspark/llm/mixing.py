"""Mixing sources to target weights by entropy balancing, in DataFrame operations only.

Each document i of source s gets a rate r_i = min(cap, exp(lambda_s * x_i)), x_i
being its size over its source's mean size: the weights of least relative entropy
to "every document once" that meet the token constraint sum(r_i * size_i) =
target_s under r_i <= cap. The convex dual is solved for all sources at once by
Newton iterations, bisection taking over where a step leaves the bracket. Rates
are then rounded into whole copies by carrying the remainder along documents of
rising size, so a source misses its target by about one document, and single
copies are added or removed to close what is left.

All sums are of integers or decimals, so reruns agree to the last digit.

Defined results: a null text has size 0 and takes 0 words; a null source is a
source of its own, last in order; repeated rows count once each, and equal rows
(same id, source and size) may get copies that differ by one; an empty table
gives an empty table; a source without words has target 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, WORD, pick

WEIGHTS = (1, 2, 3)
CAP = 3
#: Newton iterations stop once each source's tokens are this near its target, relatively.
TOLERANCE = 1e-7
MAX_ITERATIONS = 60
#: Sources at most: targets are shared out over one row a source in one task, and more are refused.
MOST_SOURCES = 2_000_000
#: Parts that documents of one source and nearly one size are dealt over for rounding.
SALTS = 64
#: Rounds of repair after rounding.
REPAIRS = 3
MICRO = 1_000_000


def document_sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, size in words."""
    rows = pick(docs, doc_id=id_col, text=text_col, source=source_col)
    return rows.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def source_targets(sources: DataFrame, weights: tuple = WEIGHTS, cap: int = CAP) -> DataFrame:
    """Add weight and target to (source, source_size), one row a source.

    Targets share the whole size by weight; those above ``cap`` times their
    source's size stop there and the excess goes to the others by weight, until
    none is above. With sources in the order of cap * size / weight, exactly a
    prefix is capped: source j is if the level that the sources from j on would
    share exceeds its own ratio. One row a source goes through the windows.
    """
    order = Window.orderBy(F.col("source").cast("binary").asc_nulls_last())
    place = F.row_number().over(order) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(place, F.lit(len(weights))) + 1).cast("int"))
    rows = sources.withColumn("weight", weight).withColumn("limit", F.col("source_size") * F.lit(float(cap)))
    by_ratio = Window.orderBy((F.col("limit") / F.col("weight")).asc(), F.col("source").cast("binary").asc_nulls_last())
    before, after = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    spent = F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    level = (F.sum("source_size").over(everything) - spent) / F.sum("weight").over(after)
    rows = rows.withColumn("level", level).withColumn("capped", F.col("level") * F.col("weight") >= F.col("limit"))
    # the sources that are not capped share one level
    common = F.min(F.when(~F.col("capped"), F.struct((F.col("limit") / F.col("weight")).alias("ratio"), F.col("level")))).over(everything)
    target = F.when(F.col("capped"), F.col("limit")).otherwise(common["level"] * F.col("weight"))
    return rows.withColumn("target", F.least(target, F.col("limit"))).select("source", "source_size", "weight", "target")


def _rate(lam: Column, x: Column, cap: int) -> Column:
    return F.least(F.lit(float(cap)), F.exp(F.least(lam * x, F.lit(50.0))))


def solve_dual(classes: DataFrame, sources: DataFrame, scratch: Scratch, cap: int = CAP,
               tolerance: float = TOLERANCE, max_iterations: int = MAX_ITERATIONS) -> DataFrame:
    """lambda per source. classes: source, size, n; sources: source, source_size, n_docs, target.

    Each iteration is one aggregation over the size classes. Its sums are of
    decimals and thus the same in any order. Sources that ``max_iterations``
    leave unsettled are an error, not an answer.
    """
    bound = F.lit(1e6)
    free = (F.col("target") > 0) & (F.col("target") < F.col("source_size") * F.lit(float(cap)))
    state = scratch.save(sources.select(
        "source", "target", (F.col("source_size") / F.col("n_docs")).alias("mean"), F.lit(0.0).alias("lam"),
        (-bound).alias("low"), bound.alias("high"), (~free).alias("done")), few_rows=True)

    def total(c: Column) -> Column:
        return F.sum(c.cast("decimal(38,8)")).cast("double")

    for _ in range(max_iterations):
        open_sources = state.filter(~F.col("done"))
        if open_sources.isEmpty():
            break
        x = F.col("size") / F.col("mean")
        rate = _rate(F.col("lam"), x, cap)
        words = F.col("n") * F.col("size")
        sums = (classes.join(open_sources, F.col("s").eqNullSafe(F.col("source")))
                .groupBy(F.col("source").alias("t"))
                .agg(total(words * rate).alias("now"), total(words * F.when(rate < cap, rate * x).otherwise(0.0)).alias("slope")))
        above = F.col("now") > F.col("target")
        low = F.when(above, F.col("low")).otherwise(F.col("lam"))
        high = F.when(above, F.col("lam")).otherwise(F.col("high"))
        # Newton on the logarithm of the token sum, which is nearly straight in lambda
        step = F.round(F.col("lam") - F.ln(F.col("now") / F.col("target")) * F.col("now") / F.nullif(F.col("slope"), F.lit(0.0)), 12)
        inside = (F.col("now") > 0) & (step > low) & (step < high)
        reached = F.abs(F.col("now") - F.col("target")) <= F.col("target") * tolerance
        moved = state.join(sums, F.col("source").eqNullSafe(F.col("t")), "left")
        following = scratch.save(moved.select(
            "source", "target", "mean",
            F.when(F.col("done") | reached, F.col("lam")).when(inside, step).otherwise((low + high) / 2).alias("lam"),
            F.when(F.col("done"), F.col("low")).otherwise(low).alias("low"),
            F.when(F.col("done"), F.col("high")).otherwise(high).alias("high"),
            (F.col("done") | reached | (high - low < 1e-11)).alias("done")), few_rows=True)
        scratch.drop(state)
        state = following
    else:
        if not state.filter(~F.col("done")).isEmpty():
            raise RuntimeError(f"a source's rates have not settled after {max_iterations} iterations")
    return state.select("source", "mean", "lam")


def mix_documents(docs: DataFrame, weights: tuple = WEIGHTS, cap: int = CAP, id_col: str = "doc_id",
                  text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, size, source_size, target, rate, copies, taken for every document.

    The texts are read once, for their sizes; all else works on the written
    (id, source, size) rows and on counts by source and size.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mixing")
    sizes = scratch.save(document_sizes(docs, id_col, text_col, source_col))
    classes = scratch.save(sizes.groupBy(F.col("source").alias("s"), "size").agg(F.count("*").alias("n")))
    totals = classes.groupBy(F.col("s").alias("source")).agg(
        F.sum(F.col("n") * F.col("size")).alias("source_size"), F.sum("n").alias("n_docs"))
    if totals.count() > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    targets = source_targets(totals.select("source", "source_size"), weights, cap)
    sources = scratch.save(targets.join(totals.select(F.col("source").alias("t"), "n_docs"), F.col("source").eqNullSafe(F.col("t"))).drop("t"), few_rows=True)
    solved = solve_dual(classes, sources, scratch, cap)
    solution = scratch.save(
        solved.select(F.col("source").alias("t"), "mean", "lam")
        .join(sources, F.col("t").eqNullSafe(F.col("source"))).drop("t"), few_rows=True)
    full = F.col("target") >= F.col("source_size") * F.lit(float(cap))
    rate = (F.when(F.col("size") == 0, 0).when(full, F.lit(cap * MICRO))
            .otherwise(F.round(_rate(F.col("lam"), F.col("size") / F.col("mean"), cap) * MICRO)).cast("long"))
    bucket = F.floor(F.col("size") / 16)
    # a rate, in millionths, for each size of each source; then carried sums in the order source, bucket, salt, size
    salt = F.pmod(F.xxhash64("doc_id", "size"), F.lit(SALTS)).cast("int")
    source_key = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("-"))
    rated = (sizes.select("doc_id", F.col("source").alias("s"), "size")
             .join(solution, F.col("s").eqNullSafe(F.col("source"))).drop("s")
             .select(F.monotonically_increasing_id().alias("row"), "doc_id", "source", "size", "source_size", "target", rate.alias("rate"), bucket.alias("bucket"), salt.alias("salt"),
                     source_key.alias("key")))
    rated = scratch.save(rated)
    cells = rated.groupBy("key", "bucket", "salt").agg(F.sum("rate").alias("rates"))
    cells = scratch.save(cells)
    starts = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = cells.groupBy("key", "bucket").agg(F.sum("rates").alias("rates"))
    buckets = buckets.select("key", "bucket", F.coalesce(F.sum("rates").over(starts), F.lit(0)).alias("bucket_start"))
    inner = Window.partitionBy("key", "bucket").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    cells = (cells.select("key", "bucket", "salt", F.coalesce(F.sum("rates").over(inner), F.lit(0)).alias("cell_start"))
             .join(buckets, ["key", "bucket"])
             .select("key", "bucket", "salt", (F.col("bucket_start") + F.col("cell_start") + F.lit(MICRO // 2)).alias("start")))
    along = Window.partitionBy("key", "bucket", "salt").orderBy("size", F.xxhash64("doc_id"), "doc_id")
    before = F.coalesce(F.sum("rate").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("start")
    copies = F.expr(f"(before + rate) div {MICRO} - before div {MICRO}")
    mixed = scratch.save(
        rated.join(cells, ["key", "bucket", "salt"]).withColumn("before", before)
        .select("row", "doc_id", "source", "size", "source_size", "target", (F.col("rate") / F.lit(float(MICRO))).alias("rate"),
                copies.cast("long").alias("copies")))
    return _repair(mixed, scratch, cap).withColumn("taken", F.col("copies") * F.col("size")).drop("row")


def _repair(mixed: DataFrame, scratch: Scratch, cap: int) -> DataFrame:
    """Add or remove one copy of the document whose size is nearest to what its source still misses.

    A rounded source misses its target by about one document at most. Each round
    picks one document a source (an aggregation of one row a source) and cuts
    the miss to the distance between it and the nearest size.
    """
    for _ in range(REPAIRS):
        missing = (mixed.groupBy(F.col("source").alias("t"))
                   .agg((F.round(F.first("target")).cast("long") - F.sum(F.col("copies") * F.col("size"))).alias("missing")))
        miss = F.col("missing")
        allowed = F.when(miss > 0, F.col("copies") < cap).otherwise(F.col("copies") > 0) & (F.col("size") > 0)
        left = F.abs(F.abs(miss) - F.col("size"))
        best = (mixed.join(missing.filter(miss != 0), F.col("source").eqNullSafe(F.col("t")))
                .filter(allowed & (left < F.abs(miss)))
                .groupBy("t").agg(F.min(F.struct(left.alias("left"), "doc_id", "row", F.signum(miss).cast("long").alias("change"))).alias("best"))
                .select(F.col("best.row").alias("r"), F.col("best.change").alias("change")))
        mixed = (mixed.join(scratch.save(best, few_rows=True), F.col("row") == F.col("r"), "left").drop("r")
                 .withColumn("copies", F.col("copies") + F.coalesce(F.col("change"), F.lit(0))).drop("change"))
    return mixed
