"""Tables between jobs: lineage is cut by writing them in the folder that driver and executors share."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset a local session gets one of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = os.path.join(tempfile.gettempdir(), "checkpoints")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def materialize(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Cut the lineage: write df as a table in the shared folder and read it back.

    The table lies on storage that outlives executors, so a later stage never recomputes what led to it. discard()
    deletes it; what nobody discards, as a result that is still to be read, goes when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    jpath, fs = filesystem(spark, path)
    fs.deleteOnExit(jpath)
    out = spark.read.schema(df.schema).parquet(path)
    out._table_path = path
    return out


def discard(df: DataFrame | None) -> None:
    """Delete a table that materialize() wrote and that no later plan reads."""
    path = getattr(df, "_table_path", None)
    if path:
        jpath, fs = filesystem(df.sparkSession, path)
        fs.delete(jpath, True)


def spread(df: DataFrame, *by: str, least: int = 0) -> DataFrame:
    """df dealt evenly to tasks for all cores, `least` or more, by columns if named: a small file is one task's, however much work its rows are."""
    spark = df.sparkSession
    tasks = max(least, 4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(tasks, *by)


def filesystem(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath, jpath.getFileSystem(spark._jsc.hadoopConfiguration())


def spare(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    while name.lower() in (c.lower() for c in df.columns):
        name += "_"
    return name


def replace_file(spark: SparkSession, fs, source, target) -> None:
    """Rename a file over another in one step, so that readers see the old one or the new one."""
    rename = getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(source, target, how)


def numbered(df: DataFrame, order: list[str], name: str, first: int = 1) -> DataFrame:
    """df as a table with `name`: first, first + 1, ... by `order`. Sorted by ranges; only a count of each range's rows reaches the driver."""
    mark = spare(df, "__mark")
    rows = materialize(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(mark, F.monotonically_increasing_id()), "numbered")
    part, place = F.shiftright(mark, 33), F.col(mark).bitwiseAND(F.lit((1 << 33) - 1))
    before, total = {}, first
    for r in rows.groupBy(part.alias("part")).count().orderBy("part").collect():
        before[r["part"]] = total
        total += r["count"]
    if not before:
        return rows.withColumn(name, F.lit(None).cast("bigint")).drop(mark)
    starts = F.create_map(*[F.lit(x) for k, v in before.items() for x in (k, v)])
    return rows.withColumn(name, (place + F.element_at(starts, part)).cast("bigint")).drop(mark)
