"""Structured Streaming: exact deduplication, resumable reading, stateful detectors, windows of event time."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing as H
from ..functions import text as X
from ..operators import sequence
from ..session import shared_dir


def run_into(stream: DataFrame, path: str, mode: str = "append") -> None:
    """Run a stream over all that is there now, into `path`/data, with its cursor in `path`/checkpoint: run again, with a
    stream of the same source, it goes on behind the last file that it took, and no row comes twice."""
    if mode == "append":
        writer = stream.writeStream.format("parquet").option("path", f"{path}/data").outputMode("append")
    else:
        writer = stream.writeStream.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{path}/data")).outputMode(mode)
    query = writer.option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()


def drain(stream: DataFrame, name: str, mode: str = "append", spark: SparkSession | None = None) -> DataFrame:
    """Run a stream over all that is there now and return what it gave, as a table in the shared folder."""
    spark = spark or stream.sparkSession
    path = f"{shared_dir(spark)}/stream-{name}-{uuid.uuid4().hex}"
    run_into(stream, path, mode)
    return spark.read.schema(stream.schema).parquet(f"{path}/data")


def read_stream(spark: SparkSession, path: str, per_batch: int = 4) -> DataFrame:
    """A growing folder, or one file, of Parquet as a stream."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(path if not path.endswith(".parquet") or "part-" in name else f"{folder}/{name}*")


def exact_dedup(stream: DataFrame, text: str = "text") -> DataFrame:
    """One row for each text, white space aside, over all batches. The state holds a key for every text that ever came:
    with a time column and a watermark it can be bounded."""
    return stream.withColumn("exact_key", X.exact_key(X.text_of(text))).dropDuplicates(["exact_key"])


def tumbling(stream: DataFrame, time: str, width: str, late: str, by: str, value: str) -> DataFrame:
    """Counts and sums by window of event time and group; rows later than `late` behind the newest are dropped."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), by).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), by, "n", "total")


def plateau_states(stream: DataFrame, by: str, step: str, value: str, alpha: float = 0.01, patience: int = 100, min_delta: float = 0.0) -> DataFrame:
    """The state of a plateau detector of each group after each batch: (by, seen, smoothed, best, bad_steps, stop), by an
    exponential mean that goes on across batches."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        seen, smoothed, best, bad = state.get if state.exists else (0, float("nan"), float("nan"), 0)
        for loss in pd.concat(list(frames)).sort_values(step)[value]:
            smoothed = loss if seen == 0 else alpha * loss + (1 - alpha) * smoothed
            if seen == 0 or smoothed < best - min_delta:
                best, bad = smoothed, 0
            else:
                bad += 1
            seen += 1
        state.update((seen, smoothed, best, bad))
        yield pd.DataFrame({by: [key[0]], "seen": [seen], "smoothed": [smoothed], "best": [best], "bad_steps": [bad], "stop": [bad >= patience]})

    kind = stream.schema[by].dataType.simpleString()
    return stream.select(by, step, value).groupBy(by).applyInPandasWithState(update, f"{by} {kind}, seen long, smoothed double, best double, bad_steps long, stop boolean", "seen long, smoothed double, best double, bad long", "append", "NoTimeout")


# order and cursors of training streams


def passes(rows: DataFrame, key: str, seed: int, first: int, n: int, after: tuple[int, int] | None = None) -> DataFrame:
    """(pass, at, key) of `n` passes over rows from pass `first` on, each in an order of its own: by a digest of seed, pass
    and key. `after` is the cursor (pass, at) of the last row taken; resumed, a stream goes on in the order of the pass it
    was in, not in that of the first one."""
    each = rows.select(key).distinct().select(F.explode(F.sequence(F.lit(first).cast("long"), F.lit(first + n - 1).cast("long"))).alias("pass"), key)
    ordered = sequence.digest_rank(each, ["pass"], H.joined_hash(F.lit(str(seed)), F.col("pass").cast("string"), F.col(key).cast("string")), key, "at")
    return ordered if after is None else ordered.where((F.col("pass") > after[0]) | ((F.col("pass") == after[0]) & (F.col("at") > after[1])))


def fast_forward(ordered: DataFrame, at: str, steps: int, accumulated: int, batch: int) -> DataFrame:
    """The rows that are left after `steps` steps of `accumulated` batches of `batch` rows, with the batch of each."""
    numbered = ordered.withColumn("batch", F.floor(F.col(at) / batch))
    return numbered.where(F.col("batch") >= steps * accumulated)


def mixed(streams: dict[str, tuple[DataFrame, float]], key: str, seed: int) -> DataFrame:
    """(source, key, k, due) of several sources with weights: the k-th row of a source, in an order of its digest, is due at
    (k + 1/2) / weight; taken in the order of `due` the sources come in proportion to their weights, and the number of rows
    taken of each is the cursor."""

    def one(name: str, rows: DataFrame, weight: float) -> DataFrame:
        ordered = passes(rows, key, seed, 0, 1).select(F.lit(name).alias("source"), key, F.col("at").alias("k"))
        return ordered.withColumn("due", (F.col("k") + 0.5) / weight)

    parts = [one(name, *given) for name, given in sorted(streams.items())]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


class Ledger:
    """Claims in a folder of any shared store: a claim is a file that is created once."""

    def __init__(self, spark: SparkSession, path: str):
        self.fs = spark._jvm.org.apache.hadoop.fs
        self.path = path
        self.store = self.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
        self.store.mkdirs(self.fs.Path(path))

    def claim(self, name: str) -> bool:
        """Whether the claim was free; from then on it is taken."""
        return self.store.createNewFile(self.fs.Path(f"{self.path}/{name}"))

    def claimed(self) -> set[str]:
        return {s.getPath().getName() for s in self.store.listStatus(self.fs.Path(self.path))}


class TransactionalSampler:
    """Batches of a fixed order that are drawn in two steps: `prepare` gives the next batch, the same one again until
    `commit`; committed batches stay committed when the sampler is opened anew on the same ledger."""

    def __init__(self, ordered: DataFrame, at: str, batch: int, ledger: Ledger):
        self.ordered, self.at, self.batch, self.ledger = ordered, at, batch, ledger
        self.next = len(ledger.claimed())

    def prepare(self) -> DataFrame:
        return self.ordered.where((F.col(self.at) >= self.next * self.batch) & (F.col(self.at) < (self.next + 1) * self.batch))

    def commit(self) -> int:
        if not self.ledger.claim(f"batch-{self.next:012d}"):
            raise RuntimeError(f"batch {self.next} is committed already")
        self.next += 1
        return self.next - 1
