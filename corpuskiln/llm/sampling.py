"""Samples that match target proportions of categories.

A record's priority is a hash of its key. In one pass every partition keeps a reservoir of each category, the records of
lowest priority, and counts what it has seen. How many it keeps follows from the largest quota that any draw can have of
the category: a fraction of all records, hence about that fraction of the records of the partition, and a minimum. The
reservoirs merge by union and the counts by addition. Once the counts are final each draw trims the merged reservoir to its
feasible quota, the records of lowest priority, which is a uniform sample of the category. A reservoir also knows the
lowest priority it has dropped; should a quota reach that far, the pass is repeated with more room, so no draw depends on
luck. The draws of one seed are nested: a larger quota of a category contains a smaller one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import staged
from .splits import label_of

#: Ranges of priority that locate the end of a quota: only records of one range are ranked.
CELLS = 4096
#: Rows of the target table at most: it is broadcast.
TARGETS = 100_000


def bucket_of() -> Column:
    """The quota bucket of a sample: the recorded one, or print, or handwritten with its difficulty; else null."""
    return F.coalesce(F.col("quota_buckets"), label_of(F.col("style"), F.col("difficulty")))


def bucketed(samples: DataFrame) -> DataFrame:
    """(sample_id, bucket) of each distinct sample that has a bucket; of several deliveries the last one counts."""
    known = samples.where("sample_id is not null").select("sample_id", bucket_of().alias("bucket"), "updated_at")
    last = known.groupBy("sample_id").agg(F.max_by("bucket", F.struct(F.coalesce("updated_at", F.lit("1900-01-01").cast("timestamp_ntz")), F.coalesce("bucket", F.lit("")))).alias("bucket"))
    return last.where("bucket is not null")


class Reservoir:
    """The records of lowest priority of one category in one partition."""

    def __init__(self):
        self.n, self.dropped = 0, None
        self.priorities, self.ids, self.size = [], [], 0

    def add(self, priorities: np.ndarray, ids: pa.Array) -> None:
        self.priorities.append(priorities)
        self.ids.append(ids)
        self.size += len(ids)

    def trim(self, room: int) -> None:
        """Keep the `room` records of lowest priority."""
        if self.size <= room:
            return
        priorities, ids = np.concatenate(self.priorities), pa.concat_arrays(self.ids)
        order = np.argsort(priorities, kind="stable")
        lowest = int(priorities[order[room]])
        self.dropped = lowest if self.dropped is None else min(self.dropped, lowest)
        order = order[:room]
        self.priorities, self.ids, self.size = [priorities[order]], [ids.take(pa.array(order))], len(order)


def reservoirs(keyed: DataFrame, wanted: dict[str, tuple[float, int]], slack: float = 8.0) -> DataFrame:
    """One pass over (bucket, priority, sample_id): the kept records of every partition, and for each of its buckets a row
    with n, the records seen, and dropped, the lowest priority that was not kept. `wanted` names of each bucket the largest
    fraction of all records and the least rows that are asked of it; of other buckets only n is kept."""
    schema = "bucket string, priority bigint, sample_id string, n bigint, dropped bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Reservoir] = {}
        seen = 0
        room = lambda b: 0 if b not in wanted else math.ceil(wanted[b][0] * seen + slack * math.sqrt(wanted[b][0] * seen)) + wanted[b][1] + int(4 * slack)
        for batch in batches:
            seen += batch.num_rows
            codes = batch.column(0).dictionary_encode()
            which = np.asarray(codes.indices)
            priorities, ids = np.asarray(batch.column(1)), batch.column(2)
            for code, bucket in enumerate(codes.dictionary.to_pylist()):
                at = np.flatnonzero(which == code)
                reservoir = held.setdefault(bucket, Reservoir())
                reservoir.n += len(at)
                if bucket in wanted:
                    reservoir.add(priorities[at], ids.take(pa.array(at)))
                    if reservoir.size > 2 * room(bucket) + 100_000:
                        reservoir.trim(room(bucket))
        for bucket, reservoir in held.items():
            reservoir.trim(room(bucket))
            yield pa.RecordBatch.from_pydict({"bucket": [bucket], "priority": pa.nulls(1, pa.int64()), "sample_id": pa.nulls(1, pa.string()), "n": [reservoir.n], "dropped": pa.array([reservoir.dropped], pa.int64())})
            for priorities, ids in zip(reservoir.priorities, reservoir.ids):
                none = pa.nulls(len(ids), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([bucket] * len(ids), pa.string()), pa.array(priorities), ids, none, none], names=["bucket", "priority", "sample_id", "n", "dropped"])

    return keyed.select("bucket", "priority", "sample_id").mapInArrow(run, schema)


def draw_samples(samples: DataFrame, targets: DataFrame, seed: int = 11, slack: float = 8.0) -> tuple[DataFrame, DataFrame]:
    """The samples of every draw, and the report of every row of `targets`.

    `targets` has (draw_id, quota_bucket, target_share, min_rows, draw_fraction); null figures are 0, a repeated row
    counts once, rows without draw or bucket are left out, more than TARGETS rows raise. A draw takes of each bucket the
    larger of min_rows and target_share * draw_fraction * N, rounded up, or all where the bucket holds fewer; N counts the
    samples that have a bucket. The sample has (draw_id, quota_bucket, sample_id), each sample at most once in a draw. The
    report adds held (samples of the bucket), quota, taken, the share of the draw that was taken and short, whether the
    bucket holds less than the quota. Empty tables give quotas of min_rows that all fall short.
    """
    wanted = targets.select("draw_id", "quota_bucket", *(F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("target_share", "min_rows", "draw_fraction"))).where("draw_id is not null and quota_bucket is not null").dropDuplicates(["draw_id", "quota_bucket"])
    if wanted.count() > TARGETS:
        raise ValueError(f"more than {TARGETS} targets")
    # a row for each bucket that is asked for, not more than there are targets
    most = wanted.groupBy("quota_bucket").agg(F.max(F.col("target_share") * F.col("draw_fraction")).alias("f"), F.max("min_rows").cast("long").alias("m")).collect()
    asked = {r["quota_bucket"]: (min(max(float(r["f"]), 0.0), 1.0), max(int(r["m"]), 0)) for r in most}
    keyed = bucketed(samples).select("bucket", F.xxhash64(F.lit(seed), "sample_id").alias("priority"), "sample_id")
    while True:
        pool = staged(reservoirs(keyed, asked, slack))
        kept = pool.where("n is null").select("bucket", "priority", "sample_id")
        states = pool.where("n is not null").groupBy("bucket").agg(F.sum("n").alias("held"), F.min("dropped").alias("dropped"))
        everything = states.agg(F.sum("held")).first()[0] or 0
        quota = F.greatest(F.col("min_rows").cast("double"), F.col("target_share") * F.col("draw_fraction") * F.lit(float(everything)))
        plan = wanted.join(states, F.col("quota_bucket") == F.col("bucket"), "left").drop("bucket").na.fill(0, ["held"]).withColumn("quota", quota)
        plan = plan.withColumn("take", F.least("held", F.ceil(F.col("quota") - 1e-9).cast("long")))
        need = plan.groupBy(F.col("quota_bucket").alias("bucket"), "dropped").agg(F.max("take").alias("need"))
        sure = kept.join(F.broadcast(need), "bucket").groupBy("bucket", "need").agg(F.count_if(F.col("dropped").isNull() | (F.col("priority") < F.col("dropped"))).alias("sure"))
        if sure.where("sure < need").isEmpty():
            break
        slack *= 4
    # ranges of the priorities of a bucket, and in which one the quota of a draw ends
    ends = F.broadcast(kept.groupBy("bucket").agg(F.min("priority").cast("double").alias("_lo"), F.max("priority").cast("double").alias("_hi")))
    width = F.col("_hi") - F.col("_lo")
    placed = kept.join(ends, "bucket").select("bucket", "priority", "sample_id", F.when(width > 0, F.floor((F.col("priority").cast("double") - F.col("_lo")) / width * CELLS)).otherwise(0).alias("cell"))
    cells = placed.groupBy("bucket", "cell").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("bucket").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    steps = cells.withColumn("before", before)
    hit = (F.col("quota_bucket") == F.col("bucket")) & (F.col("before") < F.col("take")) & (F.col("take") <= F.col("before") + F.col("n"))
    last = staged(steps.join(F.broadcast(plan.where("take > 0").select("draw_id", "quota_bucket", "take")), hit).select("draw_id", "quota_bucket", F.col("cell").alias("last"), (F.col("take") - F.col("before")).alias("rest")))
    met = placed.join(F.broadcast(last), (F.col("bucket") == F.col("quota_bucket")) & (F.col("cell") <= F.col("last")))
    inside = met.where("cell < last").select("draw_id", "quota_bucket", "sample_id")
    rank = F.row_number().over(Window.partitionBy("draw_id", "quota_bucket").orderBy("priority", "sample_id"))
    edge = met.where("cell = last").withColumn("rank", rank).where("rank <= rest").select("draw_id", "quota_bucket", "sample_id")
    whole = Window.partitionBy("draw_id")
    share = F.when(F.sum("take").over(whole) > 0, F.col("take") / F.sum("take").over(whole)).otherwise(0.0)
    report = plan.select("draw_id", "quota_bucket", "target_share", "held", "quota", F.col("take").alias("taken"), share.alias("share"), (F.col("held") < F.col("quota")).alias("short"))
    return inside.unionByName(edge), report
