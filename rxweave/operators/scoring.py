"""Measures of predicted spans and of scores, from counts that are small wherever something has to be put in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written


def _share(x: Column, y: Column) -> Column:
    return F.coalesce(F.try_divide(x.cast("double"), y), F.lit(0.0))


def rates(tp: Column, fp: Column, fn: Column, digits: int = 6) -> list[Column]:
    """precision_, recall and f1; 0 where nothing can be counted."""
    return [F.round(x, digits).alias(n) for n, x in (("precision_", _share(tp, tp + fp)), ("recall", _share(tp, tp + fn)), ("f1", _share(2 * tp, 2 * tp + fp + fn)))]


def strict_counts(gold: DataFrame, predicted: DataFrame, keys: list[str]) -> DataFrame:
    """(kind, tp, fp, fn): spans that are the same on both sides, each once; keys name a span within its kind."""
    g, p = gold.select("kind", *keys).distinct().withColumn("g", F.lit(1)), predicted.select("kind", *keys).distinct().withColumn("p", F.lit(1))
    both = g.join(p, ["kind", *keys], "full_outer")
    return both.groupBy("kind").agg(F.count_if(F.expr("g is not null and p is not null")).alias("tp"), F.count_if(F.col("g").isNull()).alias("fp"), F.count_if(F.col("p").isNull()).alias("fn"))


def lenient_counts(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """(kind, tp, fp, fn) of spans (note_id, kind, s, e): each gold span in order takes the first predicted span that it overlaps and that is free."""
    side = lambda df, name: df.select("note_id", "kind", "s", "e").distinct().groupBy("note_id", "kind").agg(F.sort_array(F.collect_list(F.struct("s", "e"))).alias(name))
    both = side(gold, "g").join(side(predicted, "p"), ["note_id", "kind"], "full_outer")
    none = F.array().cast("array<struct<s:int,e:int>>")

    def take(free: Column, x: Column) -> Column:
        at = F.array_position(F.transform(free, lambda p: (p["s"] < x["e"]) & (x["s"] < p["e"])), F.lit(True)).cast("int")
        return F.when(at > 0, F.concat(F.slice(free, 1, at - 1), F.slice(free, at + 1, F.size(free)))).otherwise(free)

    g, p = F.coalesce("g", none), F.coalesce("p", none)
    left = F.size(F.aggregate(g, p, take))
    counted = both.select("kind", F.size(p).alias("n_p"), F.size(g).alias("n_g"), left.alias("left"))
    tp = F.sum(F.col("n_p") - F.col("left"))
    return counted.groupBy("kind").agg(tp.alias("tp"), F.sum("left").alias("fp"), (F.sum("n_g") - tp).alias("fn"))


def with_micro(counts: DataFrame) -> DataFrame:
    """counts by kind, and their sums as kind micro, with rates."""
    total = counts.agg(*(F.sum(c).cast("long").alias(c) for c in ("tp", "fp", "fn"))).select(F.lit("micro").alias("kind"), "tp", "fp", "fn")
    both = counts.select("kind", *(F.col(c).cast("long").alias(c) for c in ("tp", "fp", "fn"))).unionByName(total)
    return both.select("kind", "tp", "fp", "fn", *rates(F.col("tp"), F.col("fp"), F.col("fn")))


def running(rows: DataFrame, by: Column, sums: list[str]) -> DataFrame:
    """rows with before_<c>, the sum of each column over all rows before in the order of by, whose values must differ.

    Rows are dealt into ranges and summed within them; only the ranges' totals, a row for each, are summed up in one task.
    """
    dealt = written(rows.repartitionByRange(by).withColumn("part", F.spark_partition_id()))
    totals = dealt.groupBy("part").agg(*(F.sum(c).alias(c) for c in sums))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("part", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"offset_{c}") for c in sums))
    w = Window.partitionBy("part").orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    joined = dealt.join(F.broadcast(offsets), "part")  # a row for each range
    return joined.withColumns({f"before_{c}": F.col(f"offset_{c}") + F.coalesce(F.sum(c).over(w), F.lit(0)) for c in sums}).drop("part", *(f"offset_{c}" for c in sums))


def by_score(scores: DataFrame) -> DataFrame:
    """(score, p, n): rows of each class (toxic 1 and 0) with each score."""
    return scores.groupBy("score").agg(F.count_if(F.col("toxic") == 1).alias("p"), F.count_if(F.col("toxic") == 0).alias("n"))


def auc(scores: DataFrame) -> DataFrame:
    """Area under the ROC curve; pairs with equal scores count half."""
    r = running(by_score(scores), F.col("score").asc(), ["n"])
    return r.agg(F.round(F.sum(F.col("p") * (F.col("before_n") + F.col("n") / 2.0)) / (F.sum("p") * F.sum("n")), 6).alias("auc"))


def precision_curve(scores: DataFrame) -> DataFrame:
    """(score, p, tp, taken): at each score, from the highest down, the rows taken so far and those of class 1 among them."""
    counts = by_score(scores).withColumn("all", F.col("p") + F.col("n"))
    r = running(counts, F.col("score").desc(), ["p", "all"])
    return r.select("score", "p", (F.col("before_p") + F.col("p")).alias("tp"), (F.col("before_all") + F.col("all")).alias("taken"))


def average_precision(scores: DataFrame) -> DataFrame:
    """Mean of the precision at each score, weighed by the recall that it adds."""
    return precision_curve(scores).agg(F.round(F.sum(F.col("p") * F.col("tp") / F.col("taken")) / F.sum("p"), 6).alias("average_precision"))


def best_threshold(scores: DataFrame) -> DataFrame:
    """The score with the best F1, the highest of several, if all from it on are taken."""
    curve = precision_curve(scores)
    total = curve.agg(F.sum("p").alias("total"))
    f1 = curve.join(F.broadcast(total)).select("score", (2 * F.col("tp") / (F.col("taken") + F.col("total"))).alias("f1"))  # one row on the other side
    return f1.agg(F.round(F.max("f1"), 6).alias("f1"), F.max_by("score", F.struct(F.round("f1", 9), F.col("score"))).alias("threshold"))


def resampled(blocks: DataFrame, spark, resamples: int, seed: int = 42) -> DataFrame:
    """blocks, drawn with replacement as often as there are, for each of many resamples r; a block is a row with block from 0 on.

    Draws come from a hash, so that every engine draws alike.  Blocks are a bounded number of groups of documents, whatever the number of these.
    """
    n = blocks.agg((F.max("block") + 1).alias("n"))
    draws = spark.range(resamples).select(F.col("id").alias("r")).join(F.broadcast(n)).select("r", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("j"))
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("r").cast("string"), F.col("j").cast("string")).cast("binary"))
    drawn = draws.select("r", (F.conv(F.substring(key, 1, 7), 16, 10).cast("long") % F.col("n")).alias("block"))
    return drawn.join(F.broadcast(blocks), "block")  # a row for each block


def interval(values: Column) -> list[Column]:
    return [F.round(F.percentile(values, F.lit(q)), 5).alias(n) for n, q in (("low", 0.025), ("high", 0.975))]
