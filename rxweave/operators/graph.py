"""Link features over an undirected graph, and similarity of bit vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def adjacency(pairs: DataFrame) -> DataFrame:
    """(u, v), both directions of each pair (a, b), once."""
    return pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).union(pairs.select("b", "a")).distinct()


def link_features(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """Features of pairs (a, b), as if the link between a and b were not there.

    Degrees are less one where the pair is linked; common neighbours weigh by their whole degrees, those of degree one not
    at all in the logarithmic sum.  Common neighbours are looked for from the end that has fewer, so a hub costs a pair no more than its other end does.
    """
    degree = edges.groupBy("u").agg(F.count("*").alias("degree"))
    linked = edges.select(F.col("u").alias("a"), F.col("v").alias("b"), F.lit(1).alias("linked"))
    of = lambda name: degree.select(F.col("u").alias(name), F.col("degree").alias(f"degree_{name}"))
    fewer = F.col("degree_a") <= F.col("degree_b")
    ends = pairs.select("a", "b").join(of("a"), "a").join(of("b"), "b").select("a", "b", F.when(fewer, F.col("a")).otherwise(F.col("b")).alias("few"), F.when(fewer, F.col("b")).otherwise(F.col("a")).alias("many"))
    x, y = edges.select(F.col("u").alias("few"), F.col("v").alias("w")), edges.select(F.col("u").alias("many"), F.col("v").alias("w"))
    common = ends.join(x, "few").join(y, ["many", "w"]).join(degree.withColumnRenamed("u", "w"), "w")
    shared = common.groupBy("a", "b").agg(
        F.count("*").alias("common"), F.sum(F.when(F.col("degree") > 1, 1 / F.log("degree")).otherwise(0.0)).alias("adamic"), F.sum(1 / F.col("degree")).alias("allocation")
    )
    joined = pairs.select("a", "b").join(linked, ["a", "b"], "left").join(shared, ["a", "b"], "left").join(of("a"), "a", "left").join(of("b"), "b", "left")
    own = F.coalesce("linked", F.lit(0))
    da, db = (F.coalesce(f"degree_{x}", F.lit(0)) - own for x in "ab")
    n = F.coalesce("common", F.lit(0))
    share = lambda x, y: F.round(F.coalesce(F.try_divide(x.cast("double"), y), F.lit(0.0)), 6)
    return joined.select(
        "a", "b", da.cast("long").alias("degree_a"), db.cast("long").alias("degree_b"), n.cast("long").alias("common"),
        F.round(F.coalesce(F.try_divide(n.cast("double"), da + db - n), F.lit(0.0)), 6).alias("jaccard"),
        F.round(F.coalesce("adamic", F.lit(0.0)), 6).alias("adamic"), F.round(F.coalesce("allocation", F.lit(0.0)), 6).alias("allocation"), (da * db).cast("long").alias("preferential"),
        F.least(da, db).cast("long").alias("degree_min"), F.greatest(da, db).cast("long").alias("degree_max"), share(2 * n, da + db).alias("sorensen"),
        share(n, F.least(da, db)).alias("hub_promoted"), share(n, F.greatest(da, db)).alias("hub_depressed"),
    )


def negatives(rows: DataFrame, positives: DataFrame) -> DataFrame:
    """Pairs from (d1, d2, neg): neg is 'id$t' to replace the second, 'id$h' the first; no malformed, self or positive pairs."""
    other, side = F.split("neg", "[$]")[0], F.split("neg", "[$]")[1]
    made = rows.filter("neg rlike '^[^$]+[$][ht]$'").select(F.when(side == "t", F.col("d1")).otherwise(other).alias("x"), F.when(side == "t", other).otherwise(F.col("d2")).alias("y"))
    made = made.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    return made.join(positives.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")


def bits(vector: Column) -> Column:
    """Positive components of up to 64, as the bits of a long."""
    return F.aggregate(F.sequence(F.lit(0), F.size(vector) - 1), F.lit(0).cast("long"), lambda acc, i: acc.bitwiseOR(F.when(F.get(vector, i) > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))))


def tanimoto(x: Column, y: Column) -> Column:
    return F.coalesce(F.try_divide(F.bit_count(x.bitwiseAND(y)).cast("double"), F.bit_count(x.bitwiseOR(y))), F.lit(0.0))


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """(ids, bits): rows (id, bits) packed by size."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, size):
                part = batch.slice(i, size)
                yield pa.RecordBatch.from_arrays([pa.array([part.column(k).to_numpy()]) for k in (0, 1)], ["ids", "bits"])

    return rows.select(F.col("id").cast("long"), F.col("bits").cast("long")).mapInArrow(pack, "ids array<long>, bits array<long>")


def _nearest_in_blocks(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                query, q, ids, bits = (batch.column(c)[row].values.to_numpy() for c in range(4))
                q, bits = q.view(np.uint64), bits.view(np.uint64)
                both, either = np.bitwise_count(q[:, None] & bits).astype(np.float64), np.bitwise_count(q[:, None] | bits)
                near = np.divide(both, either, out=np.zeros_like(both), where=either > 0)
                near[query[:, None] == ids] = -1.0
                order = np.lexsort((np.broadcast_to(ids, near.shape), -near), axis=1)[:, :k]
                score = np.take_along_axis(near, order, 1)
                keep = score >= 0
                yield pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(query[:, None], order.shape)[keep]), pa.array(ids[order][keep]), pa.array(score[keep])], ["query", "id", "similarity"])

    return run


def nearest(queries: DataFrame, rows: DataFrame, k: int, block: int = 2048) -> DataFrame:
    """The k most similar rows (id, bits) of each query (id, bits), ties by id: a stated query set against all rows, block by block.

    Each pair of blocks leaves k rows a query; only those are shuffled and put in order.
    """
    q = _blocks(queries, block).select(F.col("ids").alias("query"), F.col("bits").alias("q"))
    pairs = q.crossJoin(_blocks(rows, block))  # of blocks, not of rows
    found = pairs.mapInArrow(_nearest_in_blocks(k), "query long, id long, similarity double")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.col("similarity").desc(), "id"))
    return found.withColumn("place", place).filter(F.col("place") <= k)


def corrupted(positives: DataFrame, everything: DataFrame, n_nodes: int, ratio: int, tries: int = 8, seed: int = 7) -> DataFrame:
    """Negatives (a, b) like the positives (a, b of numbered nodes): one side is replaced by a node from a hash; up to ratio of each positive's tries that are no pair of everything, each pair once."""
    h = lambda salt: F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(salt), F.col("a").cast("string"), F.col("b").cast("string"), F.col("t").cast("string")).cast("binary")), 1, 7), 16, 10).cast("long")
    tried = positives.select("a", "b", F.explode(F.sequence(F.lit(0), F.lit(tries - 1))).alias("t")).withColumns({"w": h("node") % n_nodes, "first": h("side") % 2 == 0})
    made = tried.select("a", "b", "t", F.when(F.col("first"), F.col("a")).otherwise(F.col("w")).alias("u"), F.when(F.col("first"), F.col("w")).otherwise(F.col("b")).alias("v")).filter("u <> v")
    made = made.withColumns({"x": F.least("u", "v"), "y": F.greatest("u", "v")}).join(everything.select(F.col("a").alias("x"), F.col("b").alias("y")), ["x", "y"], "left_anti")
    taken = made.withColumn("place", F.row_number().over(Window.partitionBy("a", "b").orderBy("t"))).filter(F.col("place") <= ratio)
    return taken.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()


def partner_similarity(pairs: DataFrame, edges: DataFrame, bits_of: DataFrame) -> DataFrame:
    """pairs (u, v) with the highest similarity of each to the other's partners, itself left out: to_v (u to partners of v) and to_u; 0 without any."""
    b = bits_of.select("id", "bits")

    def side(one: str, other: str, name: str) -> DataFrame:
        near = pairs.join(edges.select(F.col("u").alias(other), F.col("v").alias("w")), other).filter(F.col("w") != F.col(one))
        known = near.join(b.select(F.col("id").alias(one), F.col("bits").alias("x")), one).join(b.select(F.col("id").alias("w"), F.col("bits").alias("y")), "w")
        return known.groupBy("u", "v").agg(F.max(tanimoto(F.col("x"), F.col("y"))).alias(name))

    both = pairs.join(side("u", "v", "to_v"), ["u", "v"], "left").join(side("v", "u", "to_u"), ["u", "v"], "left")
    return both.na.fill(0.0, ["to_v", "to_u"])


def neighbour_links(pairs: DataFrame, near: DataFrame, edges: DataFrame, k: int) -> DataFrame:
    """pairs (u, v) with the share of links among the k nearest of each (near: query, id)."""
    x, y = near.select(F.col("query").alias("u"), F.col("id").alias("x")), near.select(F.col("query").alias("v"), F.col("id").alias("y"))
    e = edges.select(F.col("u").alias("x"), F.col("v").alias("y"))
    linked = pairs.join(x, "u").join(e, "x").join(y, ["v", "y"]).filter("x <> y and not (least(x, y) = least(u, v) and greatest(x, y) = greatest(u, v))").groupBy("u", "v").agg(F.count("*").alias("n"))
    return pairs.join(linked, ["u", "v"], "left").select("u", "v", F.round(F.coalesce("n", F.lit(0)) / (k * k), 6).alias("share"))


def which_model(degree_a: Column, degree_b: Column, known: Column) -> Column:
    """warm where both have recorded links, cold where one has none, null where one has no vector."""
    return F.when(known, F.when((F.coalesce(degree_a, F.lit(0)) > 0) & (F.coalesce(degree_b, F.lit(0)) > 0), "warm").otherwise("cold"))


def hidden(a: Column, b: Column, seed: int = 42) -> Column:
    """Which of a pair's nodes to hide in training, from a hash: both for half of the pairs, one or the other else."""
    h = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), a.cast("string"), b.cast("string")).cast("binary")), 1, 7), 16, 10).cast("long") % 4
    return F.when(h < 2, "both").when(h == 2, "first").otherwise("second")


def link_models(rows: DataFrame, inputs: list[str], rounds: int = 50):
    """(boosted trees, logistic regression on standardised inputs) from rows with label and is_validation, which the trees stop early by."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier, LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    assemble = VectorAssembler(inputCols=inputs, outputCol="inputs")
    trees = GBTClassifier(featuresCol="inputs", maxIter=rounds, maxDepth=5, stepSize=0.1, seed=42, validationIndicatorCol="is_validation")
    plain = [StandardScaler(inputCol="inputs", outputCol="scaled", withMean=True), LogisticRegression(featuresCol="scaled", maxIter=200)]
    return Pipeline(stages=[assemble, trees]).fit(rows), Pipeline(stages=[assemble, *plain]).fit(rows.filter("not is_validation"))


def top_inputs(model, inputs: list[str], n: int = 15) -> list[tuple[str, float]]:
    """The inputs of boosted trees that gain most."""
    gains = model.stages[-1].featureImportances.toArray()
    return sorted(zip(inputs, map(float, gains), strict=True), key=lambda x: (-x[1], x[0]))[:n]
