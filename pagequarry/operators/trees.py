"""Trees as tables of (id, parent): paths, levels, qualified names, votes on values."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.folders import kept, shared_folder


def descend(level: DataFrame, below: Callable[[DataFrame], DataFrame], limit: int) -> DataFrame:
    """The first level of a tree and all that ``below`` makes of each level in turn. Levels
    are written to the shared folder, so none is made twice; beyond ``limit`` levels it raises."""
    spark, folder, depth = level.sparkSession, shared_folder(level.sparkSession), 0
    while True:
        level = kept(level, f"{folder}/{depth}")
        if level.isEmpty():
            return spark.read.schema(level.schema).parquet(*[f"{folder}/{i}" for i in range(depth + 1)])
        if depth > limit:
            raise RecursionError(f"deeper than {limit}")
        level, depth = below(level), depth + 1


def walk(nodes: DataFrame, name: str, limit: int = 200) -> DataFrame:
    """id, depth, path (names from the root) of every node below a root (parent null).

    One join a level; a cycle has no root and is never entered. Beyond ``limit``
    levels it raises.
    """
    roots = nodes.where("parent is null").select("id", F.lit(0).alias("depth"), F.array(name).alias("path"))
    children = nodes.where("parent is not null").select(F.col("id").alias("_c"), F.col("parent").alias("_p"), F.col(name).alias("_n"))

    def below(level: DataFrame) -> DataFrame:
        return level.join(children, F.col("id") == F.col("_p")).select(F.col("_c").alias("id"), (F.col("depth") + 1).alias("depth"), F.array_append("path", F.col("_n")).alias("path"))

    return descend(roots, below, limit)


def qualified(path: Column) -> Column:
    """Dotted name of a path."""
    return F.array_join(path, ".")


def majority(votes: DataFrame, keys: list[str], value: str, least: int = 2, share: float = 0.9) -> DataFrame:
    """keys, value, votes where the most frequent value has enough votes and share; ties are settled for none."""
    counted = votes.groupBy(*keys, value).agg(F.count("*").alias("votes"))
    all_of, order = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy(F.desc("votes"))
    ranked = counted.withColumns({"_all": F.sum("votes").over(all_of), "_rank": F.rank().over(order)}).withColumn("_ties", F.sum((F.col("_rank") == 1).cast("int")).over(all_of))
    return ranked.where((F.col("_rank") == 1) & (F.col("_ties") == 1) & (F.col("votes") >= least) & (F.col("votes") >= F.col("_all") * share)).select(*keys, value, "votes")
