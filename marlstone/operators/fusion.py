"""Reciprocal Rank Fusion of ranked lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The constant that lessens the weight of first places.
K = 60


def fuse(ranked: DataFrame, *, by: list[str], weights: DataFrame | None = None, k: int = K, most: int | None = None) -> DataFrame:
    """``by, id, score, n_lists, best_pos, rank``: the lists of each ``by`` fused into one.

    ranked: columns ``by``, list_no, pos (from 0, in the whole list) and id. An id counts once in
    a list, where it comes first; those it repeats keep their places. score is the sum of
    weight / (k + pos + 1), added up in the order of the lists so that it is the same to the last
    bit whatever the partitions. Equal scores go by more lists, the better place, then the first
    list and place. weights: list_no and weight of every list; a list without one is an error.
    """
    first = ranked.groupBy(*by, "list_no", "id").agg(F.min("pos").alias("pos"))
    if weights is not None:
        first = first.join(weights, "list_no", "left").withColumn("weight", F.coalesce("weight", F.raise_error(F.lit("a list has no weight")).cast("double")))
    else:
        first = first.withColumn("weight", F.lit(1.0))
    held = F.array_sort(F.collect_list(F.struct("list_no", "pos", "weight")))
    fused = first.groupBy(*by, "id").agg(held.alias("held")).select(
        *by,
        "id",
        F.aggregate("held", F.lit(0.0), lambda s, x: s + x["weight"] / (F.lit(k) + x["pos"] + 1)).alias("score"),
        F.size("held").cast("long").alias("n_lists"),
        F.array_min(F.transform("held", lambda x: x["pos"])).cast("long").alias("best_pos"),
        F.col("held")[0]["list_no"].alias("_list"),
        F.col("held")[0]["pos"].alias("_pos"),
    )
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.desc("n_lists"), "best_pos", "_list", "_pos", "id")
    out = fused.withColumn("rank", F.row_number().over(order))
    out = out.where(F.col("rank") <= most) if most else out
    return out.withColumn("rank", F.col("rank").cast("long")).drop("_list", "_pos")
