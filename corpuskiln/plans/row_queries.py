"""Queries on rows of arrays, validators, digests and summaries; and the SQL they must agree with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import hashing as H
from ..functions import patterns as P
from ..functions import text as X
from ..operators import components, sequence
from ..session import read_table as table
from ..session import spread
from .text_queries import T

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(function):
        QUERIES[function.__name__] = function
        if sql:
            SQL[function.__name__] = sql
        return function

    return keep


_SPECIAL = r"<\|[^|<>\s]{1,40}\|>"
_MN_RUN = r"[\x{1800}-\x{18af}]+(?:\x{202f}[\x{1800}-\x{18af}]+)*"
#: Special tokens, spaces, Mongolian, the rest up to the next special token. The SQL engine cannot look ahead: there special
#: tokens are set between marks first, which end a segment and are in none.
SEGMENT = rf"{_SPECIAL}|[ \t\r\n]+|{_MN_RUN}|(?:(?!{_SPECIAL})[^ \t\r\n\x{{1800}}-\x{{18af}}])+"
_SEGMENT_SQL = rf"{_SPECIAL}|[ \t\r\n]+|{_MN_RUN}|[^ \t\r\n\x{{1800}}-\x{{18af}}\x{{f8ff}}]+"
_MARKED_SQL = rf"regexp_replace({T}, '({_SPECIAL})', chr(63743) || '\1' || chr(63743), 'g')"
_TRACK_SQL = r"case when regexp_matches(s, '^<\|[^|<>\s]{1,40}\|>$') then 'special' when regexp_matches(s, '^[ \t\r\n]') then 'space' when regexp_matches(s, '^[\x{1800}-\x{18af}]') then 'mn' else 'general' end"


@query(rf"""with s as (select doc_id, unnest(regexp_extract_all({_MARKED_SQL}, '{_SEGMENT_SQL}')) as s from documents)
    select doc_id, {_TRACK_SQL} as track, count(*) as n, cast(sum(length(s)) as bigint) as chars from s group by all""")
def text_f38_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of each text by track: special tokens, spaces, Mongolian (with narrow spaces between its words), the rest."""
    segments = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.explode(X.found(X.text_of("text"), SEGMENT)).alias("s"))
    track = F.when(F.col("s").rlike(r"\A<\|[^|<>\s]{1,40}\|>\z"), "special").when(F.col("s").rlike(r"^[ \t\r\n]"), "space").when(F.col("s").rlike(r"^[\x{1800}-\x{18af}]"), "mn").otherwise("general")
    return segments.groupBy("doc_id", track.alias("track")).agg(F.count("*").alias("n"), F.sum(F.length("s")).cast("long").alias("chars"))


_ROWS = "(select sample_id, reference_model.codepoints as c, reference_token_count as k, split from samples where reference_model.codepoints is not null qualify row_number() over (partition by sample_id order by updated_at) = 1)"


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = table(spark, sf_dir, "samples").where("reference_model.codepoints is not null")
    first = held.groupBy("sample_id").agg(F.min_by(F.struct(F.col("reference_model.codepoints").alias("c"), F.col("reference_token_count").alias("k"), "split"), "updated_at").alias("r"))
    return first.select("sample_id", "r.c", "r.k", "r.split")


@query(f"""select count(*) as n_rows, round(avg(len(c)), 6) as mean_length, max(len(c)) as longest, cast(sum(len(list_filter(c, lambda x: x = 65533))) as bigint) as unknown, cast(sum(len(list_filter(c[2:], lambda x: x >= 6144))) as bigint) as supervised from {_ROWS}""")
def count_a7_build_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, lengths, unknown tokens and supervised targets; the first token of a row is no target."""
    c = F.col("c")
    return rows(spark, sf_dir).agg(
        F.count("*").alias("n_rows"), F.round(F.avg(F.size(c)), 6).alias("mean_length"), F.max(F.size(c)).cast("long").alias("longest"),
        F.sum(F.size(F.filter(c, lambda x: x == 65533))).cast("long").alias("unknown"), F.sum(F.size(F.filter(F.slice(c, F.lit(2), F.size(c)), lambda x: x >= 6144))).cast("long").alias("supervised"),
    )


@query(rf"""with p as (select doc_id, unnest(list_transform(regexp_extract_all({_MARKED_SQL}, '{_SEGMENT_SQL}'), lambda s: length(s))) as n, unnest(generate_series(1, len(regexp_extract_all({_MARKED_SQL}, '{_SEGMENT_SQL}')))) as i from documents),
    o as (select doc_id, i, sum(n) over (partition by doc_id order by i) - n as a, sum(n) over (partition by doc_id order by i) as b from p), g as (select *, lag(b) over (partition by doc_id order by i) as before from o)
    select doc_id, count(*) filter (b <= a) as empty, count(*) filter (before is not null and a <> before) as gaps, cast(max(b) as bigint) as reach from g group by doc_id""")
def count_a14_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Empty spans and gaps between the spans of segments, and how far they reach."""
    placed = table(spark, sf_dir, "documents").select("doc_id", X.text_of("text").alias("t")).repartition("doc_id")
    pieces = placed.select("doc_id", F.posexplode(F.transform(X.found(F.col("t"), SEGMENT), F.length)).alias("i", "n"))
    w = Window.partitionBy("doc_id").orderBy("i")
    spans = pieces.withColumn("b", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("a", F.col("b") - F.col("n")).withColumn("before", F.lag("b").over(w))
    return spans.groupBy("doc_id").agg(F.count_if(F.col("b") <= F.col("a")).alias("empty"), F.count_if(F.col("a") != F.col("before")).alias("gaps"), F.max("b").cast("long").alias("reach"))


@query("""with r as (select distinct source, doc_id, sha256(coalesce(text, '')) as h from documents where source is not null)
    select source, count(*) as n, sha256(string_agg(cast(doc_id as varchar) || ':' || h, chr(10) order by doc_id)) as digest from (select source, doc_id // 64 as part, doc_id, h from r) group by source, part""".replace("select source, count(*)", "select source, part, count(*)"))
def digest_a28_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A digest of the rows of each shard in order; shards are of at most 64 rows, so collecting them is bounded."""
    held = spread(table(spark, sf_dir, "documents").select("source", "doc_id", "text")).where("source is not null").select("source", "doc_id", F.sha2(X.text_of("text"), 256).alias("h")).distinct()
    parts = held.groupBy("source", F.floor(F.col("doc_id") / 64).alias("part")).agg(F.array_sort(F.collect_list(F.struct("doc_id", "h"))).alias("l"), F.count("*").alias("n"))
    return parts.select("source", "part", "n", F.sha2(F.array_join(F.transform("l", lambda x: F.concat(x.doc_id.cast("string"), F.lit(":"), x.h)), "\n"), 256).alias("digest"))


@query("""select case when sample_id is null then 'no_id' when schema_version is null or schema_version <> 1 then 'schema' when not coalesce(regexp_matches(raw_relpath, '^[^/].*\\.[A-Za-z0-9]+$'), false) then 'path'
    when captured_at is null then 'no_time' when received_at < captured_at then 'time_order' when style is null then 'style' else 'ok' end as reason, count(*) as n from sources group by 1""".replace("\\\\", "\\"))
def gate_g16_source_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inventory rows by the first thing that is wrong with them."""
    reason = X.first_reason(
        (F.col("sample_id").isNull(), "no_id"), (F.coalesce(F.col("schema_version"), F.lit(0)) != 1, "schema"), (~F.coalesce(F.col("raw_relpath").rlike(r"^[^/].*\.[A-Za-z0-9]+$"), F.lit(False)), "path"),
        (F.col("captured_at").isNull(), "no_time"), (F.col("received_at") < F.col("captured_at"), "time_order"), (F.col("style").isNull(), "style"), (F.lit(True), "ok"),
    )
    return table(spark, sf_dir, "sources").groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query(r"""select case when not coalesce(regexp_matches(raw_sha256, '^[0-9a-f]{64}$'), false) then 'digest' when not coalesce(regexp_matches(reviewed_at, '^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(Z|[+-]\d\d:\d\d)$'), false) then 'time_zone'
    when reference_raw is null then 'no_text' when trim(reference_raw) = '' then 'blank' when list_sort(reading_order_window_indices) <> generate_series(0, len(reading_order_window_indices) - 1) then 'order' else 'ok' end as reason, count(*) as n from reviews group by 1""")
def gate_g16_review_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews by the first thing that is wrong with them: digest, time zone, text, reading order."""
    order = F.col("reading_order_window_indices")
    whole = F.when(F.size(order) > 0, F.sequence(F.lit(0), F.size(order) - 1)).otherwise(F.array().cast("array<int>"))
    reason = X.first_reason(
        (~F.coalesce(F.col("raw_sha256").rlike("^[0-9a-f]{64}$"), F.lit(False)), "digest"),
        (~F.coalesce(F.col("reviewed_at").rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(Z|[+-]\d\d:\d\d)$"), F.lit(False)), "time_zone"),
        (F.col("reference_raw").isNull(), "no_text"), (F.trim("reference_raw") == "", "blank"), (order.isNotNull() & (F.array_sort(order) != whole), "order"), (F.lit(True), "ok"),
    )
    return table(spark, sf_dir, "reviews").groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query("""select p.split, coalesce(n, 0) as n, coalesce(n, 0) > 0 and coalesce(b, 0) >= 2 as ready from split_policy p left join (select split, count(distinct sample_id) as n, count(distinct quota_buckets) as b from samples group by split) s on s.split = p.split""")
def gate_g14_ready(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each split of the policy has samples of at least two buckets."""
    counts = table(spark, sf_dir, "samples").groupBy("split").agg(F.countDistinct("sample_id").alias("n"), F.countDistinct("quota_buckets").alias("b"))
    return table(spark, sf_dir, "split_policy").select("split").join(counts, "split", "left").na.fill(0).select("split", "n", ((F.col("n") > 0) & (F.col("b") >= 2)).alias("ready"))


@query("select source, round(count(*) filter (coalesce(text, '') = '') / cast(count(*) as double), 6) as skipped, count(*) filter (coalesce(text, '') = '') * 100 > count(*) as warn from documents group by source")
def gate_g15_skip_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources that lose more than one in a hundred rows."""
    empty = F.count_if(X.text_of("text") == "")
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.round(empty / F.count("*"), 6).alias("skipped"), (empty * 100 > F.count("*")).alias("warn"))


@query()
def rows_p22_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows cut at 48 tokens, but never inside a span; payloads of spans past the cutoff are dropped. The tables hold no
    media, so bracketed tokens stand for spans, as in P23, and the tokens of a span for its payload."""
    c = F.col("c")
    held = rows(spark, sf_dir).select("sample_id", "c", sequence.bracket_spans(c, 40, 41).alias("spans"))
    held = held.withColumn("payloads", F.transform("spans", lambda s: F.slice(c, s.start + 1, s.end - s.start)))
    cut = held.withColumn("r", sequence.truncated(c, F.col("spans"), F.col("payloads"), 48))
    return cut.select("sample_id", F.size(c).cast("long").alias("n"), F.size("r.c").cast("long").alias("kept"), F.size("spans").cast("long").alias("n_spans"), F.size("r.spans").cast("long").alias("kept_spans"), F.size(F.flatten("r.payloads")).cast("long").alias("payload_tokens"), (F.size(c) > F.size("r.c")).alias("cut"))


@query(rf"""with e as (select sample_id, unnest(c) as x, unnest(generate_series(1, len(c))) as i from {_ROWS}), d as (select *, sum(case when x = 40 then 1 else 0 end) over w as opened, sum(case when x = 41 then 1 else 0 end) over w as closed from e window w as (partition by sample_id order by i))
    select sample_id, count(*) filter (opened > closed or (x = 41 and opened >= closed and opened > 0)) as masked, count(*) as n from d group by sample_id""")
def rows_p23_span_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens from an opening to its closing bracket, both included; an open one masks to the end. Places of brackets are
    counted by running sums in the row's own partition."""
    pieces = rows(spark, sf_dir).select("sample_id", F.posexplode("c").alias("i", "x"))
    w = Window.partitionBy("sample_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    counted = pieces.withColumn("opened", F.sum((F.col("x") == 40).cast("int")).over(w)).withColumn("closed", F.sum((F.col("x") == 41).cast("int")).over(w))
    masked = (F.col("opened") > F.col("closed")) | ((F.col("x") == 41) & (F.col("opened") >= F.col("closed")) & (F.col("opened") > 0))
    return counted.groupBy("sample_id").agg(F.count_if(masked).alias("masked"), F.count("*").alias("n"))


@query("select run_id, source, case when isfinite(weight) then weight end as weight, case when isfinite(target_tokens) then round(target_tokens, 3) end as target from source_stats")
def rows_p28_finite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures that are no finite numbers as null."""
    finite = lambda c: F.when(~F.isnan(c) & (F.abs(c) != float("inf")), F.col(c))
    return table(spark, sf_dir, "source_stats").select("run_id", "source", finite("weight").alias("weight"), F.round(finite("target_tokens"), 3).alias("target"))


@query("select doc_id, to_json({'domain': coalesce(domain, 'text'), 'lang': coalesce(lang, 'unknown'), 'source': source}) as meta from documents where source is not null")
def rows_p20_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known fields of a row, with defaults, as one JSON object."""
    meta = F.to_json(F.struct(F.coalesce("domain", F.lit("text")).alias("domain"), F.coalesce("lang", F.lit("unknown")).alias("lang"), "source"))
    return table(spark, sf_dir, "documents").where("source is not null").select("doc_id", meta.alias("meta"))


@query(f"""with e as (select sample_id, unnest(c) as x, unnest(generate_series(1, len(c))) as i from {_ROWS}), t as (select *, case when x between 6176 and 6319 then 1 when x between 97 and 122 or x between 1072 and 1103 then 2 else 0 end as track from e),
    l as (select *, coalesce(lag(track) over (partition by sample_id order by i), 0) as before from t) select sample_id, count(*) filter (track > 0 and track <> before) as n_words, count(*) filter (track = 0) as resets from l group by sample_id""")
def window_w2_track_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of a row by the tracks of its tokens alone: a word goes on while the track does."""
    x = F.col("x")
    track = F.when(x.between(6176, 6319), 1).when(x.between(97, 122) | x.between(1072, 1103), 2).otherwise(0)
    pieces = rows(spark, sf_dir).select("sample_id", F.posexplode("c").alias("i", "x")).withColumn("track", track)
    before = F.coalesce(F.lag("track").over(Window.partitionBy("sample_id").orderBy("i")), F.lit(0))
    return pieces.withColumn("before", before).groupBy("sample_id").agg(F.count_if((F.col("track") > 0) & (F.col("track") != F.col("before"))).alias("n_words"), F.count_if(F.col("track") == 0).alias("resets"))


@query("with n as (select doc_id, row_number() over (order by doc_id) - 1 as i from documents) select i // 32 as batch, count(*) as n, min(doc_id) as first from n group by 1")
def window_w17_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of 32 rows."""
    numbered = sequence.row_index(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")
    return numbered.groupBy(F.floor(F.col("idx") / 32).alias("batch")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))


@query("""select sample_id, list_transform(list_sort(list_transform(generate_series(1, len(view_ids)), lambda i: {'k': case when writing_mode = 'vertical-lr' then i else -i end, 'v': view_ids[i]})), lambda x: x.v)[1] as first_view
    from samples where len(view_ids) > 0 qualify row_number() over (partition by sample_id order by updated_at) = 1""")
def order_o12_reading(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first view of the reading order that the writing mode proposes."""
    held = table(spark, sf_dir, "samples").where("size(view_ids) > 0").groupBy("sample_id").agg(F.min_by(F.struct("view_ids", "writing_mode"), "updated_at").alias("r")).select("sample_id", "r.*")
    keyed = F.array_sort(F.transform("view_ids", lambda v, i: F.struct(F.when(F.col("writing_mode") == "vertical-lr", i + 1).otherwise(-(i + 1)).alias("k"), v.alias("v"))))
    return held.select("sample_id", keyed[0].v.alias("first_view"))


FRACTIONS = [("train", 0.88), ("sft_validation", 0.06), ("kl_selection", 0.03), ("formal_monitor", 0.03)]


@query()
def split_d7_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of samples that share a document, capture, writer, pixel digest or near-duplicate cluster, and the split
    of each: the one that accepted samples lock for any of its identities, else by hash. Where locks contradict each
    other the split is null and the origin conflict."""
    sample = F.concat(F.lit("sample:"), "sample_id")

    def related(df: DataFrame, parts: dict[str, str], *kept: str) -> DataFrame:
        keys = F.array_compact(F.array(*(F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{k}:"), F.col(c))) for k, c in parts.items())))
        return df.where("sample_id is not null").select(sample.alias("a"), F.explode(keys).alias("b"), *kept)

    sources = table(spark, sf_dir, "sources").where("sample_id is not null")
    known = sources.select("sample_id").distinct()
    reviews, samples = table(spark, sf_dir, "reviews"), table(spark, sf_dir, "samples")
    pixel, near = {"pixel": "canonical_pixel_sha256"}, {"near_duplicate": "group_ids.near_duplicate_cluster"}
    edges = related(sources, {"document": "source_document_id", "capture": "source_capture_id", "writer": "writer_id"})
    edges = edges.union(related(reviews.join(known, "sample_id", "left_semi"), pixel)).union(related(samples.join(known, "sample_id", "left_semi"), near))
    edges = edges.union(known.select(sample.alias("a"), sample.alias("b"))).distinct()
    roots = components.connected_components(edges)
    # what an accepted sample locks: itself and every identity it has
    held = samples.where("split is not null")
    locks = related(held, {"document": "group_ids.document_id", "capture": "group_ids.capture_id", "writer": "group_ids.writer_id", **near}, "split").select(F.col("b").alias("node"), "split")
    locks = locks.union(held.where("sample_id is not null").select(sample.alias("node"), "split"))
    locks = locks.union(related(reviews.join(held.select("sample_id", "split").distinct(), "sample_id"), pixel, "split").select("b", "split")).distinct()
    locked = roots.join(locks, "node").groupBy("root").agg(F.min("split").alias("locked"), F.countDistinct("split").alias("n"))
    hashed = H.split_of(H.unit(H.joined_hash(F.lit("17"), F.col("root"))), FRACTIONS)
    joined = roots.where("node like 'sample:%'").join(locked, "root", "left")
    split = F.when(F.col("n").isNull(), hashed).when(F.col("n") == 1, F.col("locked"))
    origin = F.when(F.col("n").isNull(), "hash").when(F.col("n") == 1, "lock").otherwise("conflict")
    return joined.select(F.expr("substring(node, 8)").alias("sample_id"), F.col("root").alias("component"), split.alias("split"), origin.alias("origin"))


@query("select qa_state, writing_mode, count(*) as n, min(reference_token_count) as low, cast(sum(reference_token_count) as bigint) as total, max(reference_token_count) as high from samples group by qa_state, writing_mode")
def count_a32_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and token totals by state and writing mode."""
    k = "reference_token_count"
    return table(spark, sf_dir, "samples").groupBy("qa_state", "writing_mode").agg(F.count("*").alias("n"), F.min(k).alias("low"), F.sum(k).alias("total"), F.max(k).alias("high"))


@query("""select doc_id from documents d where source is not null order by sha256(cast(doc_id as varchar)), doc_id limit 200""")
def order_o10_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 200 rows in the order of a digest, as a report shows them: the limit is the feature."""
    return table(spark, sf_dir, "documents").where("source is not null").select("doc_id").orderBy(F.sha2(F.col("doc_id").cast("string"), 256), "doc_id").limit(200)


@query(f"""with d as (select doc_id, length({T}) * 37 as n from documents), t as (select *, case when n >= 1000000 then 100000 else 100 end as unit from d)
    select doc_id, case when n < 1000 then cast(n as varchar) else cast((n + unit // 2) // unit // 10 as varchar) || '.' || cast((n + unit // 2) // unit % 10 as varchar) || case when n >= 1000000 then 'M' else 'K' end end as label from t""")
def format_f34_throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts in thousands and millions, to a tenth, in whole numbers throughout."""
    n = (F.length(X.text_of("text")) * 37).cast("long")
    unit = F.when(n >= 1_000_000, 100_000).otherwise(100)
    tenths = F.floor((n + F.floor(unit / 2)) / unit)
    label = F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), F.pmod(tenths, F.lit(10)).cast("string"), F.when(n >= 1_000_000, "M").otherwise("K"))
    return table(spark, sf_dir, "documents").select("doc_id", F.when(n < 1000, n.cast("string")).otherwise(label).alias("label"))
