"""Session defaults and lineage cutting."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def local_session(cores: int = 8, shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session on this machine, for tests and the bench; a cluster brings its own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("corpuskiln").config("spark.driver.memory", memory)
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    spark = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions)).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir of the session. Only where that is unset and the master is
    this machine (tests) a temporary folder is made and kept for the session; on a cluster it must be set."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        given = spark.sparkContext._jsc.sc().getCheckpointDir()
        if given.isDefined():
            known = given.get()
        elif spark.sparkContext.master.split("[")[0] == "local":
            known = f"file://{tempfile.mkdtemp(prefix='corpuskiln-')}"
            spark.sparkContext.setCheckpointDir(known)
        else:
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
    return known.rstrip("/")


def staged(df: DataFrame, instead_of: DataFrame | None = None) -> DataFrame:
    """Write df as a Parquet table into the shared folder and read it back. Cuts the lineage like a reliable checkpoint,
    survives lost executors, and gives later joins exact sizes. `instead_of` is a staged table of the round before, of
    which nothing is read any more: it is deleted."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/staged-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._staged = path
    old = getattr(instead_of, "_staged", None)
    if old:
        place = spark._jvm.org.apache.hadoop.fs.Path(old)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    return table


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, slices: int | None = None) -> DataFrame:
    """A scan in at least as many partitions as the cluster has cores (or `slices`), where its few input files would
    otherwise leave most cores idle in a heavy stage; unchanged where it already has enough. For scans only: a plan with
    shuffles would run them just to be counted."""
    spark = df.sparkSession
    wanted = slices or spark.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= wanted else df.repartition(wanted)


def placed(df: DataFrame, *columns: str) -> DataFrame:
    """df by key in as many partitions as the session shuffles into. It serves the join or aggregation by these columns
    that follows, like the exchange Spark would add, but is not coalesced for being small: for heavy stages on few bytes."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)
