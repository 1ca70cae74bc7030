"""Session helpers, table access, lineage cuts and skew-safe joins shared by all operators."""

from __future__ import annotations

import atexit
import functools
import gc
import shutil
import tempfile
import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W


def local_session(name: str = "graphloom", cores: str = "8", **conf: str) -> SparkSession:
    """A session for tests and benches; a cluster brings its own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(name)
    base = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        "spark.sql.adaptive.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    for key, value in (base | conf).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@functools.cache
def _local_checkpoint_dir() -> str:
    folder = tempfile.mkdtemp(prefix="graphloom-checkpoint-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the folder of spark.checkpoint.dir.

    A folder of this machine is taken only where none is set and the master is local.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local[") and context.master != "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = _local_checkpoint_dir()
        context.setCheckpointDir(folder)
    return df.checkpoint()


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files and checkpoints of frames that nothing holds any more.

    Spark removes them when the driver collects its garbage, which may come only after many of them have piled up. What the last query holds
    goes with a later collection than the first.
    """
    for pause in (0.4, 0.4, 0):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(pause)


HOT_GROUPS = 1000  # at most so many groups can each hold more than a 1/HOT_GROUPS part of the rows


def numbered(df: DataFrame, order: list[str], name: str = "row") -> DataFrame:
    """Rows with their number from 0 in the order of columns that tell all rows apart, without ordering all of them in one task.

    Rows are sorted into ranges, written, and numbered within the ranges, whose sizes are summed first.
    """
    parts = cut(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    inner = F.row_number().over(W.Window.partitionBy("_part").orderBy(*order))
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    before = W.Window.orderBy("_part").rowsBetween(W.Window.unboundedPreceding, -1)
    bases = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))  # one row a partition
    return parts.withColumn("_k", inner).join(F.broadcast(bases), "_part").withColumn(name, F.col("_base") + F.col("_k") - 1).select(*df.columns, name)


def attach_groups(rows: DataFrame, groups: DataFrame, keys: list[str], count: str, total: int, confirm: Column | None = None) -> DataFrame:
    """Inner join of rows with one-row-per-key groups that stands any skew of the keys; rows are computed once.

    `count` holds the rows of a group and `total` the rows of all. Groups with more than total / HOT_GROUPS rows are at
    most HOT_GROUPS, so a list of them is broadcast; their rows are split by a hash of the row over parts of that
    size, each with its own copy of the group. `confirm` is an extra condition over the aliases r (rows) and g (groups).
    """
    least = max(1000, total // HOT_GROUPS)
    parts = F.when(F.col(count) > least, F.ceil(F.col(count) / least)).otherwise(1)
    hot = groups.where(F.col(count) > least).groupBy(*keys).agg(F.max(parts).alias("_parts"))
    salt = F.when(F.col("_parts").isNotNull(), F.pmod(F.xxhash64(*rows.columns), F.col("_parts"))).otherwise(0).cast("int")
    left = rows.join(F.broadcast(hot), keys, "left").select(*rows.columns, salt.alias("_salt"))
    # groups that share a key take the parts of the largest
    right = groups.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), (F.coalesce("_parts", F.lit(1)) - 1).cast("int")))).drop("_parts")
    on = functools.reduce(lambda a, b: a & b, [F.col(f"r.{k}") == F.col(f"g.{k}") for k in [*keys, "_salt"]])
    keep = [F.col(f"r.{c}") for c in rows.columns] + [F.col(f"g.{c}") for c in groups.columns if c not in keys]
    return left.alias("r").join(right.alias("g"), on if confirm is None else on & confirm).select(*keep)


def lookup(rows: DataFrame, values: DataFrame, key: str) -> DataFrame:
    """Left join of rows with one-row-per-key values that stands any skew of the key.

    Keys with more than a HOT_GROUPS-th of the rows are at most HOT_GROUPS; their values are broadcast, and their rows take no
    part in the shuffle join: they carry a null key there. A null key has no value.
    """
    counts = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n").alias("_total"))
    hot = counts.join(F.broadcast(total)).where((F.col("_n") > 1000) & (F.col("_n") > F.col("_total") / HOT_GROUPS)).select(key)
    new = [c for c in values.columns if c != key]
    known = F.broadcast(values.join(F.broadcast(hot), key, "left_semi").select(key, F.struct(*new).alias("_hot")))
    near = rows.join(known, key, "left").withColumn("_cold", F.when(F.col("_hot").isNull(), F.col(key)))
    far = values.select(F.col(key).alias("_cold"), F.struct(*new).alias("_far"))
    joined = near.join(far, "_cold", "left")
    return joined.select(*rows.columns, *[F.coalesce(F.col(f"_hot.{c}"), F.col(f"_far.{c}")).alias(c) for c in new])
