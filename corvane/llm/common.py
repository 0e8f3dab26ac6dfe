"""What the operators of this subpackage share: tables in the shared folder, prefix sums, connected components."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, or the checkpoint folder set by hand; only with a local master a temporary one."""
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if configured:
        return configured
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='corvane-')}")
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def table_path(spark: SparkSession, name: str) -> str:
    """A new path in the application's part of the shared folder."""
    return f"{shared_dir(spark)}/corvane-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def clear_tables(spark: SparkSession) -> None:
    """Removes all tables of this application, once none of its results is read any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/corvane-{spark.sparkContext.applicationId}")
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


#: Where recorded() notes the tables that are made.
_RECORDS: list[list[str]] = []


@contextlib.contextmanager
def recorded():
    """A list of the paths of the tables that are made inside of the block."""
    made: list[str] = []
    _RECORDS.append(made)
    try:
        yield made
    finally:
        _RECORDS.remove(made)


def materialize(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Writes df once to the shared folder and reads it back: it cuts lineage and survives lost executors. zstd as codec takes less disk for texts."""
    spark = df.sparkSession
    path = table_path(spark, name)
    for made in _RECORDS:
        made.append(path)
    (df.write.option("compression", codec) if codec else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def number_rows(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Adds a number of its own to each row of df, stored: read again, every row has the same."""
    return materialize(df.withColumn(name, F.monotonically_increasing_id()), "numbered", codec)


def unused(df: DataFrame, name: str) -> str:
    """name, with as many underscores before it as no column of df has."""
    while name in df.columns:
        name = f"_{name}"
    return name


def folders(df: DataFrame) -> set[str]:
    """The folders of the files that df reads."""
    return {f.rpartition("/")[0] for f in df.inputFiles()}


def delete_table(df: DataFrame) -> None:
    """Removes a table of materialize() that nothing reads any more."""
    delete_paths(df.sparkSession, folders(df))


def delete_paths(spark: SparkSession, paths) -> None:
    for path in paths:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def whole_groups(batches, key: list[str]):
    """Tables of whole groups of rows that lie together, from Arrow batches in the order of key."""
    import pyarrow as pa

    held: list = []  # batches of the group that is still open
    for batch in batches:
        t = pa.Table.from_batches([batch])
        if not t.num_rows:
            continue
        starts = _group_starts(t, key)
        if held and any(held[-1].column(c)[-1].as_py() != t.column(c)[0].as_py() for c in key):
            yield pa.concat_tables(held).combine_chunks()
            held = []
        if len(starts) > 1:
            yield pa.concat_tables([*held, t.slice(0, starts[1])]).combine_chunks()
            for a, b in zip(starts[1:], starts[2:], strict=False):
                yield t.slice(a, b - a).combine_chunks()
            held = []
        held.append(t.slice(starts[-1]))
    if held:
        yield pa.concat_tables(held).combine_chunks()


def key_chunks(batches, key: str, least: int):
    """Tables of least rows or more, of whole groups, from Arrow batches in the order of key."""
    import pyarrow as pa

    held: list = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(pa.Table.from_batches([batch]))
        if sum(t.num_rows for t in held) >= least:
            table = pa.concat_tables(held).combine_chunks()
            last = _group_starts(table, [key])[-1]
            if last:
                yield table.slice(0, last).combine_chunks()
            held = [table.slice(last)]
    if held:
        yield pa.concat_tables(held).combine_chunks()


def _group_starts(t, key: list[str]) -> list[int]:
    new = np.zeros(t.num_rows - 1, bool)
    for c in key:
        v = t.column(c).to_numpy()
        new |= v[1:] != v[:-1]
    return [0, *(np.flatnonzero(new) + 1).tolist()]


def running_start(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """Adds to the rows of df the sum of value over all rows before them in the order of keys, which no two rows share.

    The rows are dealt into ranges of keys; only one total for each range is added up in one place, so
    that part grows with the number of partitions, not with the rows.
    """
    ranged = materialize(df.repartitionByRange(*keys).withColumn("_range", F.spark_partition_id()), "ranges")
    totals = ranged.groupBy("_range").agg(F.sum(value).alias("_total"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("_range", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("_range").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    return (
        ranged.withColumn(out, F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .join(F.broadcast(bases), "_range")
        .withColumn(out, (F.col(out) + F.col("_base")).cast("long"))
        .drop("_range", "_base")
    )


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of edges (a, b): rows (node, component), component the smallest node reachable.

    Alternates large-star and small-star: every node hands its larger (smaller) neighbours to the smallest
    node it knows, until nothing changes. Each round is two aggregations and two joins by node, written to
    the shared folder; no adjacency list is ever gathered, so a hub with very many links stays many rows.
    """
    spark = edges.sparkSession
    links = materialize(
        edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
        "links",
    )
    if links.isEmpty():
        return spark.createDataFrame([], f"node {dict(edges.dtypes)['a']}, component {dict(edges.dtypes)['a']}")
    nodes = None
    for _ in range(max_rounds):
        # large star: node x with neighbours N gives every larger neighbour the smallest of N and x
        both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.union(least.where(F.col("m") < F.col("u")).select("u", F.col("m").alias("v"))).distinct()
        # small star: node u with smaller neighbours gives each of them, and itself, the smallest
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = materialize(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "links")
        # a star forest: no node that is pointed at points on, and none points to two
        tops = after.select("v").distinct().join(after.select(F.col("u").alias("v")).distinct(), "v", "left_semi")
        double = after.groupBy("u").count().where("count > 1")
        delete_table(links)
        links = after
        if tops.isEmpty() and double.isEmpty():
            nodes = links
            break
    if nodes is None:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return nodes.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        nodes.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
