"""Where jobs keep what must outlive a lost executor, and joins that a hot key does not hold up."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key with more than 1 / HEAVY of all rows is spread; there are at most HEAVY such keys, whatever the table's size.
HEAVY = 1024


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir. Where none is named, a folder of this machine serves
    a local master, as in tests; on a cluster its executors could not read each other's, so that is an error."""
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def kept(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again: computed once, compressed, and independent of its lineage."""
    path = f"{checkpoint_folder(df.sparkSession)}/kept-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.kept_path = path
    return out


def released(df: DataFrame) -> None:
    """Deletes the folder of a kept table. Only for tables that nothing to come reads: what was made of them is kept itself."""
    jvm, path = df.sparkSession._jvm, df.kept_path
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def partitions(df: DataFrame, rows: int, rows_each: int) -> int:
    """Partitions for a shuffle of so many rows: the session's number, or as many as leave rows_each in each."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // rows_each))


def spread(left: DataFrame, key: str, rows: int, by: Column, counts: DataFrame | None = None):
    """left with a ``__salt``, and a function that copies a table with one row per key to the salts of its key.

    Keys that hold more than 1 / HEAVY of ``rows`` are dealt to salts by the hash ``by``. There are few such keys, however long
    left is (HEAVY, if rows is its length), so their list is broadcast; and they are copied at most that often, all together.
    counts: (key, __n), where the keys are counted already."""
    most = max(1, rows // HEAVY)
    counts = left.groupBy(key).agg(F.count("*").alias("__n")) if counts is None else counts
    heavy = F.broadcast(counts.filter(F.col("__n") > most).select(F.col(key).alias("__hk"), F.ceil(F.col("__n") / most).cast("int").alias("__salts")))

    def copies(right: DataFrame) -> DataFrame:
        known = right.join(heavy, F.col(key) == F.col("__hk"), "left")
        return known.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce("__salts", F.lit(1)) - 1))).drop("__hk", "__salts")

    salted = left.join(heavy, F.col(key) == F.col("__hk"), "left")
    return salted.withColumn("__salt", F.coalesce(F.pmod(by, F.col("__salts")).cast("int"), F.lit(0))).drop("__hk", "__salts"), copies


def join_spread(left: DataFrame, right: DataFrame, key: str, rows: int, by: Column, how: str = "left", counts: DataFrame | None = None) -> DataFrame:
    """left joined with right by key, where right has one row per key and left may have very many: see :func:`spread`."""
    salted, copies = spread(left, key, rows, by, counts)
    return salted.join(copies(right), [key, "__salt"], how).drop("__salt")
