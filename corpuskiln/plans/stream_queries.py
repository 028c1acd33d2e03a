"""Queries on streams; the SQL is that of the same question on the whole table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import read_table, shared_dir
from ..streaming import streams
from .text_queries import T, _sql_collapse

QUERIES: dict = {}
SQL: dict[str, str] = {}


def stream_st4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct texts of the documents as they stream in."""
    source = streams.read_stream(spark, f"{sf_dir}/documents.parquet")
    return streams.drain(streams.exact_dedup(source.select("text")).select("exact_key"), "dedup")


def stream_st8_plateau(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of a plateau detector for each user when all events have come."""
    source = streams.read_stream(spark, f"{sf_dir}/events.parquet").select("user_id", "event_id", "value")
    return streams.drain(streams.plateau_states(source, "user_id", "event_id", "value", patience=20), "plateau")


def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by hour and type, with a watermark."""
    source = streams.read_stream(spark, f"{sf_dir}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    found = streams.drain(streams.tumbling(source, "ts", "1 hour", "1 day", "event_type", "value"), "windows", "complete")
    return found.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


def stream_st1_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two passes over the documents, each in its own order, resumed behind the tenth row of pass 3."""
    return streams.passes(read_table(spark, sf_dir, "documents"), "doc_id", 11, 3, 2, after=(3, 9))


def stream_st2_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream over the documents of some languages, stopped, and resumed when the others have come: every document once."""
    root = f"{shared_dir(spark)}/st2-{uuid.uuid4().hex}"
    documents = read_table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    for turn, part in enumerate((F.col("lang") == "en", ~F.coalesce(F.col("lang") == "en", F.lit(False)))):
        documents.where(part).withColumn("turn", F.lit(turn)).write.mode("append").parquet(f"{root}/in")
        streams.run_into(streams.read_stream(spark, f"{root}/in"), root)
    return spark.read.parquet(f"{root}/data").select("doc_id", "n_chars", "turn")


def stream_st3_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and transcriptions mixed three to one."""
    documents = read_table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"))
    reviews = read_table(spark, sf_dir, "reviews").where("review_id is not null").select(F.col("review_id").alias("id"))
    found = streams.mixed({"documents": (documents, 3.0), "reviews": (reviews, 1.0)}, "id", 5)
    return found.withColumn("due", F.round("due", 6))


def stream_st6_fast_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of a pass after five steps of two batches of four."""
    return streams.fast_forward(streams.passes(read_table(spark, sf_dir, "documents"), "doc_id", 11, 0, 1), "at", 5, 2, 4).select("doc_id", "at", "batch")


QUERIES |= {f.__name__: f for f in (stream_st1_passes, stream_st2_resumed, stream_st3_mixed, stream_st6_fast_forward, stream_st4_exact_dedup, stream_st8_plateau, stream_windows)}
_PASS = "row_number() over (partition by pass order by sha256('11' || chr(0) || cast(pass as varchar) || chr(0) || cast(doc_id as varchar)), doc_id) - 1"
SQL |= {
    "stream_st1_passes": f"with p as (select pass, doc_id, {_PASS} as at from (select distinct doc_id from documents), (select unnest([3, 4]) as pass)) select cast(pass as bigint) as pass, doc_id, at from p where pass > 3 or at > 9".replace(" as at", ' as "at"').replace("doc_id, at from", 'doc_id, "at" from').replace("or at >", 'or "at" >'),
    "stream_st2_resumed": "select doc_id, n_chars, case when coalesce(lang, '') = 'en' then 0 else 1 end as turn from documents",
    "stream_st3_mixed": """with d as (select 'documents' as source, id, row_number() over (order by sha256('5' || chr(0) || '0' || chr(0) || id), id) - 1 as k, 3.0 as w from (select distinct cast(doc_id as varchar) as id from documents)
        union all select 'reviews', id, row_number() over (order by sha256('5' || chr(0) || '0' || chr(0) || id), id) - 1, 1.0 from (select distinct review_id as id from reviews where review_id is not null)) select source, id, k, round((k + 0.5) / cast(w as double), 6) as due from d""",
    "stream_st6_fast_forward": f"with p as (select doc_id, {_PASS} as i from (select distinct doc_id from documents), (select 0 as pass)) select doc_id, i as \"at\", i // 4 as batch from p where i // 4 >= 10",
    "stream_st4_exact_dedup": f"select distinct sha1({_sql_collapse(T)}) as exact_key from documents",
    "stream_windows": "select date_trunc('hour', ts) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by all",
}
