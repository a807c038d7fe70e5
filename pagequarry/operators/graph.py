"""Object graphs: revisions, reachability, identical objects, inheritance, diff, renumbering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.folders import kept, shared_folder


def latest_revision(entries: DataFrame, number: list[str], revision: str) -> DataFrame:
    """Entries of the newest revision that mentions each object number, all generations of it."""
    r = F.rank().over(Window.partitionBy(*number).orderBy(F.desc(revision)))
    return entries.withColumn("_r", r).where("_r = 1").drop("_r")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def reachable(roots: DataFrame, edges: DataFrame, directory: str) -> DataFrame:
    """(id, depth) of all that can be reached over (src, dst), cycles included. Each round
    writes what it found anew; the plan of a round reads those tables and stays short."""
    spark = roots.sparkSession
    front, k = roots.select("id").distinct(), 0
    while True:
        front.withColumn("depth", F.lit(k)).write.mode("overwrite").parquet(f"{directory}/{k}")
        seen = spark.read.schema("id " + dict(front.dtypes)["id"] + ", depth int").parquet(*[f"{directory}/{i}" for i in range(k + 1)])
        last = spark.read.schema(seen.schema).parquet(f"{directory}/{k}")
        if last.isEmpty():
            return seen
        step = edges.join(last.select(F.col("id").alias("src")), "src").select(F.col("dst").alias("id")).distinct()
        front, k = step.join(seen.select("id"), "id", "left_anti"), k + 1


def identical(objects: DataFrame, key: str, content: list[str]) -> DataFrame:
    """keep_key and n for each distinct content."""
    return objects.groupBy(*content).agg(F.min(key).alias("keep_key"), F.count("*").alias("n"))


def inherited(own: Column, *ancestors: Column) -> Column:
    """The nearest value that is set."""
    return F.coalesce(own, *ancestors)


def diff(old: DataFrame, new: DataFrame, key: str, content: list[str]) -> DataFrame:
    """key and change (added, removed, changed) between two versions, by digest of content."""
    digest = F.sha2(F.to_json(F.struct(*content)), 256)
    a = old.select(key, digest.alias("_a"))
    b = new.select(key, digest.alias("_b"))
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.col("_a") != F.col("_b"), "changed")
    return a.join(b, key, "full").select(key, change.alias("change")).where("change is not null")


def append_renumbered(base: DataFrame, more: DataFrame, key: str, references: list[str]) -> DataFrame:
    """UNION ALL with the keys and references of ``more`` moved past those of ``base``."""
    top = base.agg(F.coalesce(F.max(key), F.lit(0)).alias("_top"))
    moved = more.crossJoin(F.broadcast(top)).withColumns({c: F.col(c) + F.col("_top") for c in (key, *references)}).drop("_top")
    return base.unionByName(moved)


def resolve_roles(roles: DataFrame) -> DataFrame:
    """role, standard, cyclic: the end of each chain of a role map (role, target), however
    long; a chain that returns to itself is cyclic. One join a step until none moves, so a
    map costs as many steps as its longest chain."""
    out = roles.select("role", F.col("target").alias("standard"), F.array("role").alias("_path"), F.lit(False).alias("cyclic"))
    step = roles.select(F.col("role").alias("_at"), F.col("target").alias("_next"))
    folder, k = shared_folder(roles.sparkSession), 0
    while True:
        loop = F.array_contains("_path", F.col("standard"))
        moved = out.where("not cyclic").join(step, F.col("standard") == F.col("_at"), "left").withColumns({"_loop": loop, "_go": ~loop & F.col("_next").isNotNull()})
        path = F.when(F.col("_go"), F.array_append("_path", F.col("standard"))).otherwise(F.col("_path"))
        made = moved.select("role", F.when(F.col("_go"), F.col("_next")).otherwise(F.col("standard")).alias("standard"), path.alias("_path"), F.col("_loop").alias("cyclic"), F.col("_go"))
        made = kept(made.unionByName(out.where("cyclic").withColumn("_go", F.lit(False))), f"{folder}/{k}")
        out, k = made.drop("_go"), k + 1
        if made.where("_go").isEmpty():
            return out.select("role", "standard", "cyclic")


def resolve_destinations(names: DataFrame, pages: DataFrame, keys: list[str], target: str, index: str) -> DataFrame:
    """Each destination with the index of the page it names, null where no page has that object."""
    return names.join(pages.select(*keys, F.col(target), F.col(index)), [*keys, target], "left")


def take(rows: DataFrame, wanted: DataFrame, keys: list[str], index: str, indices: str) -> DataFrame:
    """The rows of each key at the listed indices, in that order (``place`` from 0) and as
    often as listed; an index without a row gives none."""
    order = wanted.select(*keys, F.posexplode(indices).alias("place", index))
    return order.withColumn("place", F.col("place").cast("long")).join(rows, [*keys, index])
