"""Mixing sources to target weights: Efraimidis-Spirakis sampling to token budgets, natively.

Each row draws an exponential key, divided by its quality weight; within a source
rows are taken in the order of their keys until the budget is used.  Whole epochs
come first, so only the rest of a budget is sampled.  Running sums are taken over
a histogram of the keys; the bin in which a source's budget ends is parted again
until few rows are left to put in order.  Rows with one key (equal or null ids)
are counted by size and input part first, so no number of them makes a large task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearfield.llm.common import JAVA_SPACE, staged

BINS = 1 << 10
#: Rows of the bin in which a budget ends; with more the bin is parted again, as far as keys differ in forty bits.
MOST_INSIDE = 50_000
FINEST = 1 << 40
#: Sources up to this number are broadcast (their number is counted first); more are joined by shuffle.
MOST_BROADCAST = 100_000


def word_count(text: Column) -> Column:
    """Words of ``text``: runs of other characters than the six ASCII spaces; 0 for null."""
    one = F.regexp_replace(text, f"[{JAVA_SPACE}]*+[^{JAVA_SPACE}]++[{JAVA_SPACE}]*+", "x")
    return F.when(text.rlike(f"[^{JAVA_SPACE}]"), F.char_length(one)).otherwise(0).cast("long")


def default_quality(text: Column, size: Column) -> Column:
    """Weight in [0.1, 1] that falls with the distance of the mean word length from five."""
    mean = (F.char_length(text) - size + 1) / F.greatest(size, F.lit(1))
    return F.coalesce(F.greatest(F.lit(0.1), 1 / (1 + F.abs(mean - 5) / 5)), F.lit(0.1))


def targets(sources: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """(key, source_size, target) from (key, source_size): weights repeat along the keys' order.

    A target stops at ``most`` times its source; with sources in the order of cap
    over weight, the common rate is the largest that any prefix of capped sources leaves.
    """
    every = Window.partitionBy()
    table = sources.withColumn("place", F.row_number().over(Window.orderBy("key")) - 1)
    table = table.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")).cast("double"))
    table = table.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "key")
    capped = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    free = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    rate = (F.sum("source_size").over(every) * F.lit(float(share)) - capped) / free
    table = table.withColumn("rate", rate)
    return table.withColumn("target", F.least("cap", F.col("weight") * F.max("rate").over(every))).select("key", "source_size", "target")


def mix(docs: DataFrame, keep: list[str], weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, quality: Column | None = None, seed: int = 7) -> DataFrame:
    """The columns ``keep`` of ``docs(doc_id, text, source)``, with size, source_size, target and taken, for every row.

    size: words of the text (null: 0); target: words that the row's source
    should give; taken: words of this row in the mix, repeats counted (0, once or
    twice its size).  A null source is a source of its own, last in order.
    Reruns agree: keys depend on doc_id, quality and seed alone; rows with equal doc_id are
    ordered by size, and equal rows are alike.  Sources without words have target 0.
    Texts of any length are read whole.  An empty table gives no rows.
    Kept columns with the names of the added ones are left out.
    quality: a positive weight; by default from the words' mean length.
    """
    keep = [c for c in keep if c.lower() not in ("size", "source_size", "target", "taken")]
    rows = docs.select(
        F.col("doc_id").alias("_id"),
        F.concat(F.when(F.col("source").isNull(), "1").otherwise("0"), F.coalesce("source", F.lit(""))).alias("key"),
        word_count(F.col("text")).alias("size"),
        F.col("text").alias("_text"),
        *(F.col(c).alias(f"_keep_{i}") for i, c in enumerate(keep)),
        *((quality.alias("_quality"),) if quality is not None else ()),
    )
    weight = F.col("_quality") if quality is not None else default_quality(F.col("_text"), F.col("size"))
    rows = rows.withColumn("draw", -F.log(_unit("_id", seed)) / weight)
    # The result is read from this table, so it goes with the driver.
    rows = staged(rows.withColumn("slot", F.spark_partition_id()).drop("_text", "_quality"), stays=True)
    return _taken(rows, weights, share, most).select(*(F.col(f"_keep_{i}").alias(c) for i, c in enumerate(keep)), "size", "source_size", "target", "taken")


def _bin(bins: int) -> Column:
    return F.floor((1 - F.exp(-F.col("draw"))) * bins)


def _ends(rows: DataFrame, plan: DataFrame, bins: int) -> DataFrame:
    """(key, rest, bin, before, inside): the bin in which each budget ``rest`` ends, the words before it, and its rows.

    plan: (key, rest, before), before: the words of the bins that ``rows`` leaves out.
    """
    by_bin = rows.groupBy("key", _bin(bins).alias("bin")).agg(F.sum("size").alias("words"), F.count("*").alias("inside"))
    along = Window.partitionBy("key").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    ends = by_bin.withColumn("up_to", F.sum("words").over(along)).join(plan, "key").withColumn("up_to", F.col("up_to") + F.col("before")).where("up_to > rest")
    ends = ends.groupBy("key", "rest").agg(F.min(F.struct("bin", (F.col("up_to") - F.col("words")).alias("before"), "inside")).alias("end"))
    return ends.select("key", "rest", "end.bin", "end.before", "end.inside")


def _taken(rows: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """``rows(key, size, draw, slot, ..)`` with source_size, target and taken."""
    small = lambda t: F.broadcast(t) if t.count() <= MOST_BROADCAST else t
    plan = staged(targets(rows.groupBy("key").agg(F.sum("size").alias("source_size")), weights, share, most), stays=True)
    plan = plan.withColumn("epochs", F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0)))
    plan = plan.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    bins, done = BINS, None
    left = staged(_ends(rows, plan.select("key", "rest", F.lit(0).cast("long").alias("before")), bins), stays=True)
    while True:
        found = left.withColumn("bins", F.lit(bins).cast("long"))
        last = bins >= FINEST or not left.where(F.col("inside") > MOST_INSIDE).limit(1).count()
        ready = found if last else found.where(F.col("inside") <= MOST_INSIDE)
        done = ready if done is None else done.unionByName(ready)
        if last:
            break
        crowded = left.where(F.col("inside") > MOST_INSIDE).select("key", "rest", "bin", "before")
        inner = rows.join(small(crowded.select("key", "bin")), "key").where(_bin(bins) == F.col("bin")).drop("bin")
        bins *= BINS
        left = staged(_ends(inner, crowded.select("key", "rest", "before"), bins), stays=True)
    plan = plan.join(done.select("key", F.col("bin").alias("end_bin"), "before", "bins"), "key", "left")
    rows = rows.join(small(plan), "key").withColumn("at", F.floor((1 - F.exp(-F.col("draw"))) * F.col("bins")))

    # Of the end bins: equal rows of one input part are one entry, and entries are put in order.
    inside = rows.where("at = end_bin")
    alike = ("key", "draw", "_id", "size", "slot")
    entries = inside.groupBy(*alike, "rest", "before").agg(F.count("*").alias("rows"))
    order = Window.partitionBy("key").orderBy("draw", "_id", "size", "slot").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("before") + F.coalesce(F.sum(F.col("size") * F.col("rows")).over(order), F.lit(0))
    entries = entries.withColumn("start", start).select(*(F.col(c).alias(f"e_{c}") for c in alike), "start")
    inside = inside.withColumn("number", F.row_number().over(Window.partitionBy(*alike).orderBy(F.lit(0))) - 1)
    same = [F.col(c).eqNullSafe(F.col(f"e_{c}")) for c in alike]
    fits = F.col("start") + F.col("number") * F.col("size") + F.col("size") / 2 <= F.col("rest")
    inside = inside.join(entries, same).withColumn("more", fits.cast("long")).drop("number", "start", *(f"e_{c}" for c in alike))
    outside = rows.where("end_bin IS NULL OR at <> end_bin").withColumn("more", F.when(F.col("end_bin").isNull(), F.col("rest") > 0).otherwise(F.col("at") < F.col("end_bin")).cast("long"))
    return inside.unionByName(outside).withColumn("taken", ((F.col("epochs") + F.col("more")) * F.col("size")).cast("long"))


def _unit(column: str, seed: int) -> Column:
    """A number in (0, 1) drawn by the column's MD5: its first 13 hexadecimal digits."""
    text = F.concat(F.coalesce(F.col(column).cast("string"), F.lit("")), F.lit(f":{seed}"))
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
