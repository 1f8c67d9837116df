"""Connected components, cutting lineage, numbering rows in an order and finding middles without gathering them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


_ROOTS: dict[str, str] = {}


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir; where that is unset a temporary one, in local mode only."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named:
        held = sc.getCheckpointDir()
        if held is None and not sc.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = held.rsplit("/", 1)[0] if held else tempfile.mkdtemp(prefix="checkpoint-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage by writing Parquet into the shared folder: it outlives executors, and its size is known to the planner.

    All that an application cuts lies in one folder, which goes when the application ends; discard() drops one sooner.
    """
    spark = df.sparkSession
    app = spark.sparkContext.applicationId
    if app not in _ROOTS:
        _ROOTS[app] = f"{checkpoint_dir(spark).rstrip('/')}/cuts-{uuid.uuid4().hex}"
        fs, root = _path(spark, _ROOTS[app])
        fs.deleteOnExit(root)
    path = f"{_ROOTS[app]}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete what cut() wrote for these frames; nothing that still reads them may be evaluated afterwards."""
    for df in frames:
        if path := getattr(df, "_cut_path", None):
            fs, p = _path(df.sparkSession, path)
            fs.delete(p, True)


def _summary(df: DataFrame) -> tuple[int, int]:
    row = df.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64(*df.columns)).alias("x")).first()
    return row["n"], row["x"] or 0


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, rep): the smallest node that each node of the edges (a, b) can reach.

    Alternating large-star and small-star rounds. Every round aggregates with map-side combine and joins two
    shuffled sides, so that a hub's edges can be split over tasks; lineage is cut each round. No component is
    gathered anywhere. Nodes without an edge aren't returned; an edge from a node to itself counts for nothing.
    """
    e = cut(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = _summary(e)
    while before[0]:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lows = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = cut(both.join(lows, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = cut(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        old, e = e, cut(small.union(low.select("u", F.col("m").alias("v"))).distinct())
        discard(old, lows, large, low)
        now = _summary(e)
        if now == before:
            break
        before = now
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("rep")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("rep")).union(roots)


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df with the rows' numbers from 0 in the order of columns that are unique together.

    Rows are range-partitioned and numbered within their ranges; only the ranges' sizes go to the driver.
    """
    parts = cut(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    sizes = sorted((r["__part"], r["n"]) for r in parts.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).collect())
    start, before = {}, 0
    for part, n in sizes:
        start[part] = before
        before += n
    if not start:
        return df.withColumn(name, F.lit(0).cast("long"))
    table = F.create_map(*(F.lit(x) for kv in start.items() for x in kv))
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    return parts.withColumn(name, (inside + F.element_at(table, F.col("__part"))).cast("long")).drop("__part")


def middles(values: DataFrame, keys: list[str], value: str, n: str) -> DataFrame:
    """(keys, total, lower, upper) of each group of values that occur n times: how many there are, and the two in the middle,
    which are one value where the number is odd. Nulls, and groups with a null key, are left out.

    Equal values are counted first, the rest is range-partitioned and counted within its ranges, so a group of any size
    spreads over tasks; only a number for each range and group is ordered in one place.
    """
    counts = values.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.sum(n).alias("__n"))
    parts = cut(counts.repartitionByRange(*keys, value).withColumn("__part", F.spark_partition_id()))
    group = Window.partitionBy(*keys)
    sizes = parts.groupBy(*keys, "__part").agg(F.sum("__n").alias("__size"))
    sizes = sizes.select(*keys, "__part", (F.sum("__size").over(group.orderBy("__part")) - F.col("__size")).alias("__start"), F.sum("__size").over(group).alias("total"))
    ends = F.col("__start") + F.sum("__n").over(Window.partitionBy(*keys, "__part").orderBy(value))
    rows = parts.join(sizes, [*keys, "__part"]).withColumn("__end", ends)
    holds = lambda at: F.max(F.when((at < F.col("__end")) & (at >= F.col("__end") - F.col("__n")), F.col(value)))
    return rows.groupBy(*keys, "total").agg(holds(F.floor((F.col("total") - 1) / 2)).alias("lower"), holds(F.floor(F.col("total") / 2)).alias("upper"))
