"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each source gets a token target (shares of the total by weight, at most a fixed
multiple of its size). Whole epochs of a source come first; the rest of its budget
is filled by documents in the order of exponential keys -ln(u) / weight, where u is
a hash of the id and weight is the document's quality. The order is cut where the
running sum of sizes reaches the budget; what the document at the cut would exceed is
filled with the next smaller ones.

The running sum is taken in two steps, so a source of any size never meets in one
task: keys are monotone in p = 1 - exp(-key), p is cut into bins (about
``bin_rows`` documents each), the bins of a source are summed and prefix-summed, and
only the one bin that holds the cut is ordered row by row.

Cases: a null source is a source of its own, the last in order; null texts have
size 0; repeated rows have equal keys and equal sizes, so either may be taken;
ties are ordered by id; an empty table gives no rows; a null weight counts as 1.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from paneltide.llm.common import blank_words, wrap
from paneltide.session import cut

MAX_EPOCHS = 3
CYCLE = (1, 2, 3)
BIN_ROWS = 2_000
SEED = 11
FILL_PASSES = 3


def targets(sizes: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, n_docs, target) from (source, size) rows.

    Weights follow the code point order of sources. Capped shares in closed form:
    sources ordered by cap over weight are capped up to the first whose fair share
    of what is left fits under its cap. The tables here have one row per source.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    cycle = F.array(*[F.lit(float(w)) for w in CYCLE])
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weighed = by_source.withColumn("w", F.get(cycle, place % len(CYCLE))).withColumn(
        "cap", F.col("source_size").cast("double") * max_epochs
    )
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rate = (F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (
        F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    )
    fair = weighed.withColumn("rate", rate).withColumn("free", F.col("rate") * F.col("w") <= F.col("cap"))
    level = F.first(F.when(F.col("free"), F.col("rate")), ignorenulls=True).over(whole)
    first = F.first(F.when(F.col("free"), F.col("cap") / F.col("w")), ignorenulls=True).over(whole)
    return fair.withColumn("level", level).withColumn("first", first).select(
        "source",
        "source_size",
        "n_docs",
        F.when(F.col("cap") / F.col("w") < F.col("first"), F.col("cap"))
        .otherwise(F.least(F.col("level") * F.col("w"), F.col("cap")))
        .alias("target"),
    )


def _fill(cutting: DataFrame, passes: int = FILL_PASSES) -> DataFrame:
    """Pick rows of each cutting bin by running sums up to its ``gap``.

    Each pass takes, in key order, documents that fit into what the passes before
    it left, so the gap ends below about the smallest documents of the bin.
    """
    bin_ = Window.partitionBy("source", "bin")
    order = bin_.orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    out = cutting.withColumn("picked", F.lit(0).cast("long"))
    for _ in range(passes):
        fits = (F.col("picked") == 0) & (F.col("size") <= F.col("gap"))
        out = out.withColumn("end", F.sum(F.when(fits, F.col("size")).otherwise(0)).over(order))
        now = fits & (F.col("end") <= F.col("gap"))
        out = out.withColumn("now", now.cast("long"))
        out = out.withColumn("gap", F.col("gap") - F.sum(F.col("now") * F.col("size")).over(bin_)).withColumn(
            "picked", F.col("picked") + F.col("now")
        )
    return out.drop("gap", "end", "now")


def mix(docs: DataFrame, weights: DataFrame | None = None, max_epochs: int = MAX_EPOCHS, bin_rows: int = BIN_ROWS, seed: int = SEED) -> DataFrame:
    """(doc_id, source, key, size, source_size, target, copies) per input row.

    ``weights`` has (doc_id, weight), one row per id, weight over 0. Stored in the
    shared folder: narrow rows, no texts. ``key`` orders the sample; with doc_id and
    size it names a row up to repetition.
    """
    words = wrap(docs.select("doc_id", "source", "text")).select("row.doc_id", "row.source", blank_words(F.col("text")).alias("words"))
    sized = words.select("doc_id", "source", F.size("words").cast("long").alias("size"))
    if weights is not None:
        sized = sized.join(weights, "doc_id", "left")
    else:
        sized = sized.withColumn("weight", F.lit(1.0))
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id")), 11) + 0.5) / float(1 << 53)
    keyed = cut(
        sized.select("doc_id", "source", "size", (-F.log(u) / F.coalesce("weight", F.lit(1.0))).alias("key"))
    )
    plan = cut(targets(keyed, max_epochs))
    rows = keyed.withColumnRenamed("source", "own").join(
        plan, F.col("own").eqNullSafe(F.col("source"))
    ).drop("own")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    bins = F.ceil(F.col("n_docs") / bin_rows)
    rows = (
        rows.withColumn("epochs", epochs)
        .withColumn("budget", F.col("target") - F.col("epochs") * F.col("source_size"))
        .withColumn("bin", F.floor((1 - F.exp(-F.col("key"))) * bins).cast("long"))
    )
    summed = rows.groupBy("source", "bin").agg(F.sum("size").alias("bin_size"))
    run = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut(summed.withColumn("start", F.coalesce(F.sum("bin_size").over(run), F.lit(0))))
    rows = rows.alias("r").join(
        starts.alias("s"), F.col("r.source").eqNullSafe(F.col("s.source")) & (F.col("r.bin") == F.col("s.bin"))
    ).select("r.*", "s.start", "s.bin_size")
    # a bin that ends within the budget is taken, one that starts beyond it is not
    inside = F.col("start") + F.col("bin_size") <= F.col("budget")
    beyond = F.col("start") >= F.col("budget")
    cutting = _fill(rows.where(~inside & ~beyond).withColumn("gap", F.col("budget") - F.col("start")))
    picked = rows.where(inside | beyond).select("*", inside.cast("long").alias("picked")).unionByName(cutting)
    return picked.select(
        "doc_id", "source", "key", "size", "source_size", "target", (F.col("epochs") + F.col("picked")).alias("copies")
    )


def apply(docs: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """The mix itself: every input row as often as it is taken, all columns kept.

    Rows find their number of copies by id and source; rows that share both (repeated
    rows) share their copies evenly: the sum over them is dealt to them in turn.
    """
    taken = mix(docs, weights).groupBy("doc_id", "source").agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("same"))
    taken = cut(taken.select(F.col("doc_id").alias("id"), F.col("source").alias("from"), "copies", "same").where("copies > 0"))
    held = wrap(docs)
    match = held["row.doc_id"].eqNullSafe(F.col("id")) & held["row.source"].eqNullSafe(F.col("from"))
    every = held.join(taken.where("same = 1"), match).select("row", "copies")
    repeated = taken.where("same > 1")
    if not repeated.isEmpty():
        turn = F.row_number().over(Window.partitionBy("id", "from").orderBy("text"))
        own = F.floor(F.col("copies") / F.col("same")) + (F.col("turn") <= F.col("copies") % F.col("same")).cast("long")
        shared = held.join(repeated, match).withColumn("turn", turn).select("row", own.alias("copies"))
        every = every.unionByName(shared.where("copies > 0"))
    return every.select(F.explode(F.sequence(F.lit(1).cast("long"), "copies")), "row").select("row.*")
