"""Queries that write the test tables in other formats and read them back, shard arithmetic, sentinels and contracts; and
the SQL they must agree with."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import hashing as H
from ..functions import text as X
from ..operators import sequence
from ..session import read_table as table
from ..session import shared_dir
from ..sources import readers, sinks
from .text_queries import T, _sql_strip

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(function):
        QUERIES[function.__name__] = function
        if sql:
            SQL[function.__name__] = sql
        return function

    return keep


def _place(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _sql_set_digest(line: str) -> str:
    d = f"sha256({line})"
    parts = ", ".join(f"coalesce(sum(cast('0x' || substr({d}, {at}, 15) as bigint)), 0)" for at in (1, 16, 31, 46))
    return f"sha256(concat_ws(':', count(*), {parts}))"


_LINE = rf"regexp_replace({T}, '[\x{{a}}-\x{{d}}\x{{1c}}-\x{{1e}}\x{{85}}\x{{2028}}\x{{2029}}]', ' ', 'g')"


def _one_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, line) of all documents, line breaks as spaces."""
    return table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace(X.text_of("text"), r"[\x{a}-\x{d}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]", " ").alias("line"))


def _digests(rows: DataFrame) -> DataFrame:
    return rows.groupBy(F.md5("text").alias("digest")).agg(F.count("*").alias("n"), F.max(F.length("text")).cast("long").alias("n_chars"))


def _sql_digests(text: str, rest: str = "") -> str:
    return f"with t as (select {text} as text from documents{rest}) select md5(text) as digest, count(*) as n, max(length(text)) as n_chars from t where text <> '' group by 1"


@query(_sql_digests(_sql_strip(_LINE)))
def scan_s3_text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written one a line, and read back."""
    path = _place(spark, "s3")
    _one_line(spark, sf_dir).select("line").write.text(path)
    return _digests(readers.text_lines(spark, path))


@query("""with f as (select unnest([{'part': 'documents.jsonl', 'field': 'text', 'text': text}, {'part': 'documents.jsonl', 'field': 'domain', 'text': domain}]) as x from documents
        union all select {'part': 'names', 'field': 'text', 'text': source} from mix_sources)
    select x.part as part, x.field as field, count(*) as n, cast(sum(length(x.text)) as bigint) as n_chars from f where x.text is not null and x.text <> '' group by all""")
def scan_s7_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bundle of a JSON and a text part, by fields."""
    root = _place(spark, "s7")
    table(spark, sf_dir, "documents").select("text", "domain").write.json(f"{root}/documents.jsonl")
    table(spark, sf_dir, "mix_sources").select("source").write.text(f"{root}/names")
    rows = readers.bundle(spark, root, [("documents.jsonl", "lines", ["text", "domain"]), ("names", "text", [])])
    return rows.groupBy("part", "field").agg(F.count("*").alias("n"), F.sum(F.length("text")).cast("long").alias("n_chars"))


@query(_sql_digests("text"))
def scan_s9_parquet_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One column of a Parquet table."""
    return _digests(readers.parquet_column(spark, f"{sf_dir}/documents.parquet"))


@query(_sql_digests("text", " where coalesce(lang, '') = 'en'"))
def scan_s10_wiki_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of one language, written as a dump and read by its path."""
    root = _place(spark, "s10")
    table(spark, sf_dir, "documents").where("lang = 'en'").select("text").write.parquet(f"{root}/20260101.en")
    return _digests(readers.wiki_dump(spark, root, "20260101", "en"))


@query(_sql_digests("text"))
def scan_s12_json_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One field of line-delimited JSON."""
    path = _place(spark, "s12")
    table(spark, sf_dir, "documents").select("text", "lang", "source").write.json(path)
    return _digests(readers.json_column(spark, path))


@query(_sql_digests("text", " where length(text) >= 200"))
def scan_s25_long_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of at least 200 characters."""
    path = _place(spark, "s25")
    table(spark, sf_dir, "documents").select("text").write.json(path)
    return _digests(readers.long_documents(spark, path, least=200))


@query("select regexp_extract(raw_relpath, '[^/]+$') as name, count(*) as n from sources where raw_relpath is not null group by 1 having count(*) > 1")
def scan_s17_repeated_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base names that more than one path of the inventory has: such a list is no set of shards."""
    names = table(spark, sf_dir, "sources").where("raw_relpath is not null").select(F.regexp_extract("raw_relpath", "[^/]+$", 0).alias("name"))
    return names.groupBy("name").agg(F.count("*").alias("n")).where("n > 1")


@query(f"with t as (select {_sql_strip(T)} as text from documents) select md5(text) as digest, count(*) as n, max(length(text)) as n_chars from t where length(text) >= 20 group by 1")
def scan_s15_source_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts of a source in Parquet, stripped, of at least 20 characters."""
    path = _place(spark, "s15")
    table(spark, sf_dir, "documents").select("text").write.parquet(path)
    return _digests(readers.source_texts(spark, path, min_chars=20))


@query(f"with t as (select {_sql_strip(_LINE)} as text from documents union all select {_sql_strip(_LINE.replace(T, 'source'))} from mix_sources) select md5(text) as digest, count(*) as n, max(length(text)) as n_chars from t where text <> '' group by 1")
def scan_s30_several_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts of several files."""
    root = _place(spark, "s30")
    _one_line(spark, sf_dir).select("line").write.text(f"{root}/a")
    table(spark, sf_dir, "mix_sources").select("source").write.text(f"{root}/b")
    return _digests(readers.text_lines(spark, [f"{root}/a", f"{root}/b"]))


@query("""with r as (select sample_id, length(reference_model.text) as target, reference_token_count as frames from samples where reference_model.text is not null)
    select distinct sample_id, sha256('3' || chr(0) || sample_id) as place from r where target <= frames""")
def scan_s31_shuffled_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows in the order of a seed, without those whose text is longer than their frames."""
    rows = table(spark, sf_dir, "samples").where("reference_model.text is not null").select("sample_id", F.length("reference_model.text").alias("target"), F.col("reference_token_count").alias("frames"))
    return readers.shuffled_rows(rows, "sample_id", 3, "target", "frames").select("sample_id", "place").distinct()


@query("""with f as (select source, row_number() over (order by source) - 1 as i from mix_sources), r as (select unnest(generate_series(0, 63)) as rank)
    select i, rank, i % 2 as worker from f, r where (select count(*) from f) < 64 union all select i, i % 8 as rank, i // 8 % 2 as worker from f""")
def scan_s26_dealt_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards dealt to 8 ranks; and to 64, of which each gets all where there are fewer shards."""
    numbered = table(spark, sf_dir, "mix_sources").select((F.row_number().over(Window.orderBy("source")) - 1).cast("long").alias("i"))  # a manifest
    many = readers.dealt_shards(numbered, "i", 64, 2)
    return readers.dealt_shards(numbered, "i", 8, 2).unionByName(many if numbered.count() < 64 else many.limit(0))


@query("select doc_id, n_chars, row_number() over (order by doc_id) - 1 as at from documents")
def scan_s29_random_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by their place: each can be asked for alone."""
    return sequence.row_index(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id", "at")


@query("select doc_id, text is not null and text <> '' as filled from documents order by doc_id limit 100")
def scan_o8_early_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hundred rows by key: the limit is the feature."""
    return table(spark, sf_dir, "documents").select("doc_id", (X.text_of("text") != "").alias("filled")).orderBy("doc_id").limit(100)


@query("select source, path, lang, row_number() over (order by source) - 1 as at from mix_sources")
def order_o1_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest in the order of its key: as many rows as it has sources."""
    return table(spark, sf_dir, "mix_sources").select("source", "path", "lang", (F.row_number().over(Window.orderBy("source")) - 1).cast("long").alias("at")).orderBy("source")


# sinks


@query("with n as (select doc_id, row_number() over (order by doc_id) - 1 as i from documents) select i // 100 as shard, count(*) as n, min(doc_id) as first, max(doc_id) as last from n group by 1")
def sink_k3_row_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards of 100 rows each, written and read back."""
    path = _place(spark, "k3")
    sinks.write_row_shards(table(spark, sf_dir, "documents").select("doc_id", "text"), path, "doc_id", 100)
    return spark.read.parquet(path).groupBy(F.col("shard").cast("long").alias("shard")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))


@query("select regexp_replace(source, '[^0-9A-Za-z._-]', '_', 'g') as shard, count(*) as n, count(distinct doc_id) as docs from documents where source is not null group by 1")
def sink_k6_unit_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of every source in a folder of its name, written and read back."""
    path = _place(spark, "k6")
    sinks.write_units(table(spark, sf_dir, "documents").where("source is not null").select("doc_id", "source"), path, "source")
    return spark.read.parquet(path).groupBy(F.col("shard").cast("string").alias("shard")).agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"))


@query()
def sink_k2_rotating_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards of at most 20 rows or 4,000 characters, rotated by each source's writer in blocks of 10,000 keys."""
    rows = table(spark, sf_dir, "documents").where("source is not null").select(F.concat_ws("/", "source", F.floor(F.col("doc_id") / 10_000).cast("string")).alias("writer"), "doc_id", F.col("n_chars").alias("size"))
    return sinks.rotating_shards(rows, "writer", "doc_id", "size", 20, 4000)


# receipts and sentinels


@query("""with s as (select source, count(*) as docs, cast(sum(n_chars) as bigint) as chars from documents where source is not null group by source),
    m as (select source, max(docs) as docs, max(chars) as chars, count(*) as n from source_stats where run_id = 'run-0000001' group by source)
    select s.source, case when m.n is null then 'missing' when m.n > 1 then 'several' when m.docs is not distinct from s.docs and m.chars is not distinct from s.chars then 'complete' else 'changed' end as state
    from s left join m using (source)""")
def join_j12_sentinels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source's shard of documents against the figures that a run recorded for it."""
    shards = table(spark, sf_dir, "documents").where("source is not null").groupBy("source").agg(F.count("*").alias("docs"), F.sum("n_chars").alias("chars"))
    return sinks.shard_states(shards, table(spark, sf_dir, "source_stats").where("run_id = 'run-0000001'").select("source", "docs", "chars"), ["source"], ["docs", "chars"])


@query()
def receipt_r4_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The signature of the listing of all tables with the parameters of a run."""
    return sinks.listing_signature(readers.listed(spark, sf_dir, "*.parquet"), seed=7, max_epochs=4)


@query(f"""with d as (select raw_relpath as path, cast(length(raw_relpath) as bigint) as size from sources where raw_relpath is not null)
    select sha256({_sql_set_digest("path || chr(0) || cast(size as varchar)")} || '{{}}') as signature, count(*) as n_files, cast(sum(size) as bigint) as n_bytes from d""")
def receipt_r5_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The signature of the inventory by names and sizes only, for which lengths of names stand."""
    files = table(spark, sf_dir, "sources").where("raw_relpath is not null").select(F.col("raw_relpath").alias("path"), F.length("raw_relpath").cast("long").alias("size"))
    return sinks.listing_signature(files)


@query("""with s as (select split, sample_id, reference_model.utf8_sha256 as h, reference_token_count as k from samples where split is not null),
    x as (select h from s where h is not null group by h having count(distinct split) > 1)
    select split, count(distinct sample_id) as n_samples, cast(sum(k) as bigint) as tokens, count(distinct h) as n_texts, count(*) filter (h in (select h from x)) as n_leaked from s group by split""")
def contract_r6_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Splits with their samples, tokens and texts, and how many rows have a text that another split has too."""
    rows = table(spark, sf_dir, "samples").where("split is not null").select("split", "sample_id", F.col("reference_model.utf8_sha256").alias("h"), F.col("reference_token_count").alias("k"))
    crossing = rows.where("h is not null").groupBy("h").agg(F.countDistinct("split").alias("s")).where("s > 1").select("h", F.lit(True).alias("leaked"))
    return rows.join(crossing, "h", "left").groupBy("split").agg(F.countDistinct("sample_id").alias("n_samples"), F.sum("k").alias("tokens"), F.countDistinct("h").alias("n_texts"), F.count_if("leaked").alias("n_leaked"))


@query("""with b as (select coalesce(quota_buckets, 'none') as bucket, count(*) as n, count(distinct sample_id) as ids, count(distinct asset_id) as assets from samples group by 1)
    select bucket, n, n = ids as unique_ids, n = assets as unique_assets, n >= 2 as enough, n = (select max(n) from b) and n = (select min(n) from b) as equal from b""")
def contract_r8_locked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a manifest can be locked: ids and assets unique, two rows a bucket at least, equal counts."""
    counts = table(spark, sf_dir, "samples").groupBy(F.coalesce("quota_buckets", F.lit("none")).alias("bucket")).agg(F.count("*").alias("n"), F.countDistinct("sample_id").alias("ids"), F.countDistinct("asset_id").alias("assets"))
    every = Window.partitionBy(F.lit(0))  # a row for each bucket
    return counts.select("bucket", "n", (F.col("n") == F.col("ids")).alias("unique_ids"), (F.col("n") == F.col("assets")).alias("unique_assets"), (F.col("n") >= 2).alias("enough"), (F.min("n").over(every) == F.max("n").over(every)).alias("equal"))


@query(f"""select sample_id, {_sql_set_digest("review_id || chr(9) || coalesce(reference_raw, '')")} as digest, count(*) as n from (select distinct sample_id, review_id, reference_raw from reviews where sample_id is not null and review_id is not null) group by sample_id""")
def digest_a29_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A digest of the rows of each sample, repeated deliveries once."""
    rows = table(spark, sf_dir, "reviews").where("sample_id is not null and review_id is not null").select("sample_id", "review_id", "reference_raw").distinct()
    return rows.groupBy("sample_id").agg(H.set_digest(F.concat("review_id", F.lit("\t"), X.text_of("reference_raw"))).alias("digest"), F.count("*").alias("n"))


@query(_sql_digests("text"))
def scan_s1_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as lines of JSON, with blank and broken lines between, read leniently."""
    path = _place(spark, "s1")
    held = table(spark, sf_dir, "documents").where("text is not null").select(F.to_json(F.struct("text", "lang")).alias("line"))
    noise = spark.range(20).select(F.when(F.col("id") % 2 == 0, "  ").otherwise('{"text": "cut').alias("line"))
    held.unionByName(noise).write.text(path)
    return _digests(readers.json_lines(spark, path).select("text").where("text <> ''"))


@query(_sql_digests(_sql_strip(_LINE)))
def scan_s2_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that blank lines separate."""
    path = _place(spark, "s2")
    _one_line(spark, sf_dir).select("line").write.option("lineSep", "\n\n").text(path)
    return _digests(readers.paragraphs(spark, path))


def _arrays(spark: SparkSession, sf_dir: str) -> str:
    """A folder of files that hold an array of 256 documents each, every other one under `data`."""
    path = _place(spark, "s5")
    parts = table(spark, sf_dir, "documents").where("text is not null").groupBy(F.floor(F.col("doc_id") / 256).alias("part")).agg(F.to_json(F.collect_list(F.struct("doc_id", "text"))).alias("json"))
    wrapped = parts.select("part", F.when(F.col("part") % 2 == 0, F.col("json")).otherwise(F.concat(F.lit('{"data": '), "json", F.lit("}"))).alias("value"))
    wrapped.repartition("part").write.partitionBy("part").text(path)
    return path


@query("select doc_id, md5(text) as digest from documents where text is not null")
def scan_s5_json_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents out of arrays, bare and wrapped."""
    return readers.json_array(spark, _arrays(spark, sf_dir), "doc_id bigint, text string").select("doc_id", F.md5("text").alias("digest"))


@query("select case when doc_id // 256 % 2 = 0 then 'array' else 'lines' end as layout, count(distinct doc_id // 256) as n from documents where text is not null group by 1")
def scan_s6_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files by their layout: an array where the first printed character is a bracket."""
    return readers.layout(spark, f"{_arrays(spark, sf_dir)}/*/*.txt").groupBy("layout").agg(F.count("*").alias("n"))


@query("""with d as (select case when text is null then 'other fields' when lang is null then 'type of lang' end as error from documents) select coalesce(error, 'none') as error, count(*) as n from d group by 1
    union all select 'repeated field', 3 union all select 'no JSON', 3""")
def scan_s28_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that must have exactly the fields text and lang, by what is wrong with them."""
    path = _place(spark, "s28")
    line = F.when(F.col("text").isNull(), F.to_json(F.struct("lang"))).otherwise(F.to_json(F.struct("text", "lang"), {"ignoreNullFields": "false"}))
    odd = spark.range(6).select(F.when(F.col("id") % 2 == 0, '{"text": "a", "text": "b", "lang": "c"}').otherwise("{").alias("line"))
    table(spark, sf_dir, "documents").select(line.alias("line")).unionByName(odd).write.text(path)
    checked = readers.strict_json_lines(spark, path, {"text": "string", "lang": "string"})
    return checked.groupBy(F.coalesce("error", F.lit("none")).alias("error")).agg(F.count("*").alias("n"))


@query(_sql_digests("text"))
def sink_k1_text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts written as lines of JSON, in two goes, and read back."""
    path = _place(spark, "k1")
    documents = table(spark, sf_dir, "documents").where("text <> ''")
    sinks.write_text_lines(documents.where("lang = 'en'"), path)
    sinks.write_text_lines(documents.where("lang is null or lang <> 'en'"), path, mode="append")
    return _digests(readers.json_lines(spark, path).select("text"))


@query("select case when coalesce(text, '') = '' then 'empty' when n_chars < 100 then 'short' when n_chars < 2000 then 'middle' else 'long' end as route, count(*) as n, cast(sum(n_chars) as bigint) as n_chars from documents group by 1")
def sink_k7_fan_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four routes written in one pass and read back."""
    path = _place(spark, "k7")
    route = X.first_reason((X.text_of("text") == "", "empty"), (F.col("n_chars") < 100, "short"), (F.col("n_chars") < 2000, "middle"), (F.lit(True), "long"))
    sinks.fan_out(table(spark, sf_dir, "documents").select("doc_id", "n_chars", route.alias("route")), path)
    return spark.read.parquet(path).groupBy(F.col("route").cast("string").alias("route")).agg(F.count("*").alias("n"), F.sum("n_chars").alias("n_chars"))


@query("select true as intact, true as changed_is_seen")
def receipt_r9_verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A written table against its contract, and after a file was added."""
    path = _place(spark, "r9")
    table(spark, sf_dir, "mix_sources").coalesce(2).write.parquet(path)
    contract = sinks.receipt(spark, path, rows=60)
    intact = sinks.verify(spark, path, contract) == []
    table(spark, sf_dir, "split_policy").coalesce(1).write.mode("append").parquet(path)
    return spark.createDataFrame([(intact, sinks.verify(spark, path, contract) != [])], "intact boolean, changed_is_seen boolean")
