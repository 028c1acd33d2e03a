"""Sinks and receipts: sharded output, content digests, contracts that are checked on read."""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from collections.abc import Iterable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import set_digest
from ..operators.sequence import prefix_sum, row_index


def canonical_json(value: object) -> bytes:
    """JSON in one form: sorted keys, no spaces, characters as they are, no NaN."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False).encode()


def digest(value: object) -> str:
    return hashlib.sha256(canonical_json(value)).hexdigest()


def write_text_lines(df: DataFrame, path: str, text: str = "text", mode: str = "error") -> None:
    """Lines of {"text": …}, as JSON."""
    df.select(F.col(text).alias("text")).write.mode(mode).json(path)


def write_row_shards(df: DataFrame, path: str, order: str, rows: int) -> None:
    """Shards of `rows` rows in order, one folder each: shard=0, shard=1, …"""
    numbered = row_index(df, order, "_i").withColumn("shard", F.floor(F.col("_i") / rows)).drop("_i")
    numbered.repartition("shard").sortWithinPartitions("shard", order).write.partitionBy("shard").mode("error").parquet(path)


def token_shards(df: DataFrame, order: str, size: str, budget: int) -> DataFrame:
    """df with the shard of each row: a new one at every `budget` tokens of the running total. A shard can exceed the
    budget by less than one row; unlike a sequential rotation this needs no pass in order."""
    return prefix_sum(df, order, F.col(size), "_before").withColumn("shard", F.floor(F.col("_before") / budget)).drop("_before")


def rotated(rows: Iterable[int], most: int, budget: int) -> Iterator[int]:
    """The shard of each row in order, by its tokens: a new one after `most` rows, or where the row would exceed the token
    budget, but never before the first row of a shard."""
    shard = held = tokens = 0
    for size in rows:
        if held and (held >= most or tokens + size > budget):
            shard, held, tokens = shard + 1, 0, 0
        held, tokens = held + 1, tokens + size
        yield shard


def rotating_shards(df: DataFrame, by: str, order: str, size: str, most: int, budget: int) -> DataFrame:
    """(by, order, shard): the rotation of the rows of each writer `by` in order. It is sequential, so a writer is one task
    and its rows should be bounded; `token_shards` has no such bound."""

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(order)
        return pd.DataFrame({by: group[by], order: group[order], "shard": pd.Series(rotated(group[size].tolist(), most, budget), index=group.index, dtype="int64")})

    schema = f"{by} {df.schema[by].dataType.simpleString()}, {order} {df.schema[order].dataType.simpleString()}, shard long"
    return df.select(by, order, size).groupBy(by).applyInPandas(fold, schema)


def shard_name(unit: Column | str) -> Column:
    """The name of a unit's file: everything but letters, digits, dots, dashes and underscores becomes an underscore."""
    return F.regexp_replace(unit, "[^0-9A-Za-z._-]", "_")


def write_units(df: DataFrame, path: str, unit: str) -> None:
    """The rows of every unit in a folder of its name."""
    df.withColumn("shard", shard_name(F.col(unit))).write.partitionBy("shard").mode("error").parquet(path)


def write_report(spark: SparkSession, facts: dict, path: str) -> None:
    """A report as one JSON file in any store, written whole before it has its name."""
    fs = spark._jvm.org.apache.hadoop.fs
    place = fs.Path(path)
    store = place.getFileSystem(spark._jsc.hadoopConfiguration())
    held = fs.Path(f"{path}.{uuid.uuid4().hex}")
    stream = store.create(held, False)
    try:
        stream.write(bytearray(canonical_json(facts)))
    finally:
        stream.close()
    if store.exists(place) or not store.rename(held, place):
        store.delete(held, False)
        raise FileExistsError(path)


def shard_states(shards: DataFrame, sentinels: DataFrame, on: list[str], facts: list[str]) -> DataFrame:
    """(on, state) of every shard against its sentinel: missing where it has none, changed where they differ in one of the
    `facts`, several where the sentinel is not unique, else complete."""
    marks = sentinels.groupBy(*on).agg(F.count("*").alias("_marks"), *(F.first(f).alias(f"_of_{f}") for f in facts))
    same = reduce(lambda a, b: a & b, (F.col(f).eqNullSafe(F.col(f"_of_{f}")) for f in facts))
    state = F.when(F.col("_marks").isNull(), "missing").when(F.col("_marks") > 1, "several").when(same, "complete").otherwise("changed")
    return shards.join(marks, on, "left").select(*on, state.alias("state"))


def listing_signature(files: DataFrame, **facts) -> DataFrame:
    """(signature, n_files, n_bytes) of a listing (path, size and, if it counts, modified): equal as long as no file and no
    fact changes, so a run with the signature of the last one can be skipped."""
    modified = [F.col("modified").cast("string")] if "modified" in files.columns else []
    whole = files.agg(set_digest(F.concat_ws("\0", "path", F.col("size").cast("string"), *modified)).alias("d"), F.count("*").alias("n_files"), F.coalesce(F.sum("size"), F.lit(0)).alias("n_bytes"))
    return whole.select(F.sha2(F.concat("d", F.lit(canonical_json(facts).decode())), 256).alias("signature"), "n_files", "n_bytes")


def fan_out(df: DataFrame, path: str, routes: str = "route") -> None:
    """Every route into its own folder in one pass."""
    df.write.partitionBy(routes).mode("error").parquet(path)


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(name, size, sha256) of all files below a path, by the tasks that read them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.length("content").cast("long").alias("size"), F.sha2("content", 256).alias("sha256"))


def receipt(spark: SparkSession, path: str, **facts) -> dict:
    """The contract of a written data set: its files, sorted, a digest of them, given facts, and a digest of itself."""
    entries = [r.asDict() for r in file_digests(spark, path).where("name not like '\\_%' and name not like '.%'").orderBy("name", "sha256").collect()]
    body = {"files": entries, "files_sha256": digest(entries), **facts}
    return body | {"sha256": digest(body)}


def verify(spark: SparkSession, path: str, contract: dict) -> list[str]:
    """What differs between a data set and its contract; nothing if it is as promised."""
    body = {k: v for k, v in contract.items() if k != "sha256"}
    faults = [] if contract.get("sha256") == digest(body) else ["the contract's own digest"]
    now = {(r["name"], r["size"], r["sha256"]) for r in receipt(spark, path)["files"]}
    then = {(r["name"], r["size"], r["sha256"]) for r in contract["files"]}
    return faults + [f"missing or changed: {n}" for n, *_ in sorted(then - now)] + [f"unknown: {n}" for n, *_ in sorted(now - then)]


def publish(contract: dict, path: str) -> None:
    """Write a contract so that it is there whole or not at all, and never twice."""
    held = f"{path}.{os.getpid()}"
    with open(held, "xb") as file:
        file.write(canonical_json(contract))
        file.flush()
        os.fsync(file.fileno())
    try:
        os.link(held, path)
    finally:
        os.unlink(held)
