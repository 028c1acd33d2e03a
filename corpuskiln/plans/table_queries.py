"""Queries on tables: joins, sets, duplicates, leakage, splits, sampling; and the SQL they must agree with."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import hashing as H
from ..functions import patterns as P
from ..functions import text as X
from ..operators import dedup, joins, sequence
from ..session import read_table as table
from ..session import placed, shared_dir, spread
from .text_queries import T, _sql_collapse

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(function):
        QUERIES[function.__name__] = function
        if sql:
            SQL[function.__name__] = sql
        return function

    return keep


FRACTIONS = [("train", 0.88), ("sft_validation", 0.06), ("kl_selection", 0.03), ("formal_monitor", 0.03)]
UNIT_SQL = "cast('0x' || substr({0}, 1, 13) as bigint) / 4503599627370496.0"
SPLIT_SQL = "case when {0} < 0.88 then 'train' when {0} < 0.94 then 'sft_validation' when {0} < 0.97 then 'kl_selection' else 'formal_monitor' end"
FRACTION_STEPS = [("train", 0.88), ("sft_validation", 0.94 - 0.88), ("kl_selection", 0.97 - 0.94), ("formal_monitor", 0.03)]


# joins


@query("""with a as (select sample_id, count(*) as n from reviews where decision = 'approved' group by sample_id)
    select s.sample_id, coalesce(a.n, 0) as n_approved, case when a.n is null then 'no_review' when a.n > 1 then 'several_reviews' else 'reviewed' end as state
    from (select distinct sample_id from sources) s left join a using (sample_id)""")
def join_j1_reviewed_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source with its approved reviews; one without is set apart, one with several too."""
    approved = table(spark, sf_dir, "reviews").where("decision = 'approved'").groupBy("sample_id").agg(F.count("*").alias("n"))
    joined = table(spark, sf_dir, "sources").select("sample_id").distinct().join(approved, "sample_id", "left")
    state = F.when(F.col("n").isNull(), "no_review").when(F.col("n") > 1, "several_reviews").otherwise("reviewed")
    return joined.select("sample_id", F.coalesce("n", F.lit(0)).alias("n_approved"), state.alias("state"))


@query("select distinct sample_id from reviews r where sample_id is not null and not exists (select 1 from samples s where s.sample_id = r.sample_id)")
def join_j2_orphan_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviewed samples that were never accepted."""
    return table(spark, sf_dir, "reviews").where("sample_id is not null").select("sample_id").distinct().join(table(spark, sf_dir, "samples").select("sample_id"), "sample_id", "left_anti")


@query("""with v as (select distinct sample_id, asset_id, view_id from (select sample_id, asset_id, unnest(view_ids) as view_id from samples)), k as (select view_id, count(distinct sample_id) as owners from v group by view_id)
    select case when v.sample_id not in (select sample_id from sources where sample_id is not null) then 'orphan' when replace(v.asset_id, 'asset-', 'view-') <> substr(v.view_id, 1, 14) then 'asset' when owners > 1 then 'shared' else 'ok' end as state, count(*) as n from v join k using (view_id) group by 1""")
def join_j3_view_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views by the state of their keys: of a sample that is not in the inventory, of another asset than their sample, of
    more than one sample, or in order."""
    views = table(spark, sf_dir, "samples").select("sample_id", "asset_id", F.explode("view_ids").alias("view_id")).distinct()
    owners = views.groupBy("view_id").agg(F.countDistinct("sample_id").alias("owners"))
    known = table(spark, sf_dir, "sources").select("sample_id", F.lit(True).alias("known")).distinct()
    joined = views.join(known, "sample_id", "left").join(owners, "view_id")
    other = F.replace(F.col("asset_id"), F.lit("asset-"), F.lit("view-")) != F.substring("view_id", 1, 14)
    return joined.groupBy(F.when(F.col("known").isNull(), "orphan").when(other, "asset").when(F.col("owners") > 1, "shared").otherwise("ok").alias("state")).agg(F.count("*").alias("n"))


@query("""select distinct sample_id, len(view_ids) as n_views, coalesce(list_sort(view_ids) = list_sort(reading_order), false) as complete from samples""")
def join_j4_reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the reading order of a sample is a permutation of its views."""
    same = F.coalesce(F.array_sort("view_ids") == F.array_sort("reading_order"), F.lit(False))
    return table(spark, sf_dir, "samples").select("sample_id", F.when(F.col("view_ids").isNotNull(), F.size("view_ids")).cast("long").alias("n_views"), same.alias("complete")).distinct()


@query("""with k as (select unnest([{'kind': 'document', 'id': group_ids.document_id}, {'kind': 'capture', 'id': group_ids.capture_id},
        {'kind': 'writer', 'id': group_ids.writer_id}, {'kind': 'near_duplicate', 'id': group_ids.near_duplicate_cluster}, {'kind': 'text', 'id': reference_model.utf8_sha256}]) as e, split from samples)
    select e.kind as kind, e.id as identity, count(distinct split) as n_splits from k where e.id is not null and split is not null group by all having count(distinct split) > 1""")
def leakage_j5_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identities (document, capture, writer, cluster, text) whose samples are in more than one split."""
    parts = {"document": "group_ids.document_id", "capture": "group_ids.capture_id", "writer": "group_ids.writer_id", "near_duplicate": "group_ids.near_duplicate_cluster", "text": "reference_model.utf8_sha256"}
    pairs = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(c).alias("id")) for k, c in parts.items()))).alias("e")
    rows = table(spark, sf_dir, "samples").select("split", pairs).where("e.id is not null and split is not null")
    return rows.groupBy(F.col("e.kind").alias("kind"), F.col("e.id").alias("identity")).agg(F.countDistinct("split").alias("n_splits")).where("n_splits > 1")


_WINDOWS = "list_distinct(list_concat([sha256({0})], list_transform(generate_series(1, length({0}) - 12), lambda i: sha256(substr({0}, i, 13)))))"


@query(f"""with s as (select distinct split, reference_model.text as t from samples where split is not null and reference_model.text is not null),
    w as (select split, unnest({_WINDOWS.format('t')}) as h from s)
    select h as digest, count(distinct split) as n_sides from w group by h having count(distinct split) > 1""")
def leakage_j6_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of texts and of their windows of 13 characters that occur in more than one split."""
    texts = placed(table(spark, sf_dir, "samples").select("split", F.col("reference_model.text").alias("t")).where("split is not null and t is not null"), "split", "t").distinct()
    return joins.crossing(texts.select("split", F.explode(joins.window_hashes(F.col("t"))).alias("digest")), "digest", "split")


@query(f"""with s as (select review_id, unnest({_WINDOWS.format('reference_raw')}) as h from (select distinct review_id, reference_raw from reviews where reference_raw is not null)),
    x as (select distinct unnest({_WINDOWS.format('t')}) as h from (select distinct reference_model.text as t from samples where split = 'formal_monitor' and reference_model.text is not null))
    select review_id, count(*) as hits from s where h in (select h from x) group by review_id""")
def leakage_g11_excluded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews that share windows with the texts of a held-out split, and how many."""
    held = table(spark, sf_dir, "samples").where("split = 'formal_monitor'").select(F.col("reference_model.text").alias("t")).where("t is not null").distinct()
    excluded = held.select(F.explode(joins.window_hashes(F.col("t"))).alias("h")).distinct()
    rows = placed(table(spark, sf_dir, "reviews").where("reference_raw is not null").select("review_id", "reference_raw"), "review_id", "reference_raw").distinct()
    return rows.select("review_id", F.explode(joins.window_hashes(F.col("reference_raw"))).alias("h")).join(excluded.hint("merge"), "h", "left_semi").groupBy("review_id").agg(F.count("*").alias("hits"))


@query("""with a as (select sample_id, max(reference_raw) as t from reviews where decision = 'approved' group by sample_id), b as (select sample_id, max(reference_model.text) as t from samples group by sample_id)
    select sample_id, a.t is null as no_review, b.t is null as no_sample, coalesce(a.t = b.t, false) as same from a full join b using (sample_id)""")
def join_j9_paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approved transcriptions against accepted texts, both sides complete."""
    a = table(spark, sf_dir, "reviews").where("decision = 'approved'").groupBy("sample_id").agg(F.max("reference_raw").alias("ta"))
    b = table(spark, sf_dir, "samples").groupBy("sample_id").agg(F.max("reference_model.text").alias("tb"))
    joined = a.join(b, "sample_id", "full")
    return joined.select("sample_id", F.col("ta").isNull().alias("no_review"), F.col("tb").isNull().alias("no_sample"), F.coalesce(F.col("ta") == F.col("tb"), F.lit(False)).alias("same"))


@query("""with l as (select group_ids.document_id as d, min(split) as s, count(distinct split) as n from samples where split is not null and group_ids.document_id is not null group by 1)
    select sample_id, min(case when n = 1 then l.s end) as locked, coalesce(max(n), 0) > 1 as conflict from sources left join l on source_document_id = d group by sample_id""")
def join_j10_split_lock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The split that earlier samples lock for a source by its document, and whether they contradict each other."""
    lock = table(spark, sf_dir, "samples").where("split is not null").select(F.col("group_ids.document_id").alias("d"), "split").where("d is not null").groupBy("d").agg(F.min("split").alias("s"), F.countDistinct("split").alias("n"))
    joined = table(spark, sf_dir, "sources").select("sample_id", F.col("source_document_id").alias("d")).join(lock, "d", "left")
    return joined.groupBy("sample_id").agg(F.min(F.when(F.col("n") == 1, F.col("s"))).alias("locked"), (F.coalesce(F.max("n"), F.lit(0)) > 1).alias("conflict"))


@query("""select s.sample_id, s.raw_relpath from (select distinct sample_id, raw_relpath from sources) s where not exists (select 1 from reviews r where r.sample_id = s.sample_id and r.raw_sha256 is not null)""")
def join_j13_missing_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inventory rows whose file no review has a digest of."""
    seen = table(spark, sf_dir, "reviews").where("raw_sha256 is not null").select("sample_id")
    return table(spark, sf_dir, "sources").select("sample_id", "raw_relpath").distinct().join(seen, "sample_id", "left_anti")


_BOXES = """select l_suppkey as g, l_orderkey * 10 + l_linenumber as id, cast(l_partkey % 400 as int) as x0, cast(l_orderkey % 300 as int) as y0,
    cast(l_partkey % 400 + l_quantity as int) as x1, cast(l_orderkey % 300 + l_quantity / 2 as int) as y1 from lineitem"""


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("g"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), (F.col("l_partkey") % 400).cast("int").alias("x0"), (F.col("l_orderkey") % 300).cast("int").alias("y0"),
        F.round(F.col("l_partkey") % 400 + F.col("l_quantity")).cast("int").alias("x1"), F.bround(F.col("l_orderkey") % 300 + F.col("l_quantity") / 2).cast("int").alias("y1"),
    )


@query(f"""with a as ({_BOXES}), b as ({_BOXES})
    select a.g, a.id as a_id, b.id as b_id, cast((least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)) as bigint) as area,
    a.x0 <= b.x0 and a.y0 <= b.y0 and b.x1 <= a.x1 and b.y1 <= a.y1 as inside from a join b using (g)
    where a.x0 < b.x1 and b.x0 < a.x1 and a.y0 < b.y1 and b.y0 < a.y1 and a.x1 > a.x0 and a.y1 > a.y0 and b.x1 > b.x0 and b.y1 > b.y0""")
def join_j14_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping boxes of a group, by cells of a grid: every row against every row. A row meets itself too: ids repeat,
    so they cannot tell a row from another one of its id."""
    boxes = _boxes(spark, sf_dir)
    return joins.box_join(boxes, boxes, ["g"])


@query("select distinct source from documents d where source is not null and not exists (select 1 from source_stats s where s.source = d.source and s.run_id = 'run-0000001')")
def join_j15_undone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of documents that a run has not done yet."""
    done = table(spark, sf_dir, "source_stats").where("run_id = 'run-0000001'").select("source")
    return table(spark, sf_dir, "documents").where("source is not null").select("source").distinct().join(done, "source", "left_anti")


# sets


@query("select cast(doc_id as varchar) as id, text as t from documents union all select review_id, reference_raw from reviews")
def set_u1_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corpora one after the other."""
    documents = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("t"))
    return documents.unionByName(table(spark, sf_dir, "reviews").select(F.col("review_id").alias("id"), F.col("reference_raw").alias("t")))


@query("select distinct source from documents where source is not null except select source from mix_sources")
def set_u2_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("source is not null").select("source").exceptAll(table(spark, sf_dir, "mix_sources").select("source")).distinct().join(table(spark, sf_dir, "mix_sources").select("source"), "source", "left_anti")


@query("select source from documents where source is not null intersect select source from source_stats")
def set_u3_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("source is not null").select("source").intersect(table(spark, sf_dir, "source_stats").select("source"))


@query("""select (select count(*) from (select sample_id from samples except select sample_id from sources)) as left_only,
    (select count(*) from (select sample_id from sources except select sample_id from samples)) as right_only""")
def set_u4_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many keys each of two tables has alone: one aggregation over both."""
    a, b = (table(spark, sf_dir, t).select("sample_id", F.lit(k).alias("side")) for k, t in ((1, "samples"), (2, "sources")))
    sides = a.unionByName(b).groupBy("sample_id").agg(F.min("side").alias("low"), F.max("side").alias("high"))
    return sides.agg(F.count_if(F.col("high") == 1).alias("left_only"), F.count_if(F.col("low") == 2).alias("right_only"))


@query("select distinct lang, domain from documents")
def set_u5_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("lang", "domain").distinct()


# duplicates

_SIGNS = "list_sum(list_transform(generate_series({0}, {1}), lambda i: case when embedding[i] > 0 then cast(1 as bigint) << ({1} - i) else 0 end))"


def embedding_signs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The signs of 64 components as a 64-bit signature."""
    bits = F.transform(F.slice("embedding", 1, 64), lambda x: F.when(x > 0, "1").otherwise("0"))
    hexed = F.array_join(bits, "")
    high, low = (F.conv(F.substring(hexed, k, 32), 2, 10).cast("long") for k in (1, 33))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.shiftleft(high, 32).bitwiseOR(low).alias("sig"))


@query(f"""with k as (select doc_id, sha1({_sql_collapse(T)}) as exact_key from documents)
    select doc_id, exact_key from k qualify row_number() over (partition by exact_key order by doc_id) = 1""")
def dedup_d1_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first document of each text, white space aside."""
    return dedup.keep_first(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), X.exact_key(X.text_of("text")), "doc_id").select("doc_id", "exact_key")


@query()
def dedup_d2_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact and near duplicates by the keep-first rule."""
    return dedup.near_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query(f"""with k as (select doc_id, coalesce(lang, '') = 'en' as old, sha1({_sql_collapse(T)}) as exact_key from documents),
    f as (select doc_id, exact_key, row_number() over (partition by exact_key order by doc_id) as rn from k where not old)
    select doc_id, exact_key in (select exact_key from k where old) or rn > 1 as exact from f""")
def dedup_d3_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that come after those of one language, against the state that was written of these: exact repetitions."""
    path = f"{shared_dir(spark)}/d3-{uuid.uuid4().hex}"
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    dedup.dedup_state(documents.where("lang = 'en'"), path)
    later = dedup.new_rows(documents.where("lang is null or lang <> 'en'"), path)
    return later.select("doc_id", F.coalesce(F.col("reason") == "exact", F.lit(False)).alias("exact"))


@query()
def dedup_d4_by_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the number of characters in place of terms."""
    return dedup.near_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), by_chars=True)


@query()
def dedup_f15_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.signatures(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query(f"""with w as (select doc_id, case when len(m) > 0 then m else g end as w from (select doc_id, regexp_extract_all({T}, '[{P.SCRIPTS['mongolian']}]+') as m, regexp_extract_all({T}, '{P.TOKEN}') as g from documents))
    select doc_id, len(w) as n_terms, case when len(w) = 0 then 0 else greatest(len(w) - 3, 1) end as n_shingles, md5(array_to_string(w[1:4], ' ')) as first from w""")
def dedup_f14_shingles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms and shingles of four of each document, and the digest of the first."""
    t = X.text_of("text")
    both = table(spark, sf_dir, "documents").select("doc_id", X.found(t, f"[{P.SCRIPTS['mongolian']}]+").alias("m"), X.found(t, P.TOKEN).alias("g"))
    words = both.select("doc_id", F.when(F.size("m") > 0, F.col("m")).otherwise(F.col("g")).alias("w"))
    shingles = F.when(F.size("w") == 0, 0).otherwise(F.greatest(F.size("w") - 3, F.lit(1)))
    return words.select("doc_id", F.size("w").cast("long").alias("n_terms"), shingles.cast("long").alias("n_shingles"), F.md5(F.array_join(F.slice("w", 1, 4), " ")).alias("first"))


_SIG_SQL = f"select vec_id, {_SIGNS.format(1, 32)} as h, {_SIGNS.format(33, 64)} as l from embeddings"


@query(f"""with s as ({_SIG_SQL}) select a.vec_id as a, b.vec_id as b, cast(bit_count(xor(cast(a.h as bigint), cast(b.h as bigint))) + bit_count(xor(cast(a.l as bigint), cast(b.l as bigint))) as int) as dist
    from s a join s b on a.vec_id < b.vec_id where bit_count(xor(cast(a.h as bigint), cast(b.h as bigint))) + bit_count(xor(cast(a.l as bigint), cast(b.l as bigint))) <= 20""")
def dedup_j8_signature_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of signatures that differ in at most 20 bits, found exactly by probing bands."""
    return dedup.near_pairs(embedding_signs(spark, sf_dir), 20, "vec_id")


@query()
def dedup_d5_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single-linkage clusters of signatures within 14 bits."""
    sigs = embedding_signs(spark, sf_dir)
    return dedup.clusters(dedup.near_pairs(sigs, 14, "vec_id"), sigs.select(F.col("vec_id").alias("node")))


@query(f"with w as (select unnest(regexp_extract_all({T}, '{P.WORD}')) as word from documents) select word, count(*) as n from w group by word")
def dedup_d8_word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.explode(X.found(X.text_of("text"), P.WORD)).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


@query("select review_id, count(*) as n from reviews group by review_id having count(*) > 1")
def dedup_d9_repeated_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "reviews").groupBy("review_id").agg(F.count("*").alias("n")).where("n > 1")


# splits and hash order


@query(f"select source_document_id as component, {SPLIT_SQL.format(UNIT_SQL.format('h'))} as split from (select distinct source_document_id, sha256('17' || chr(0) || source_document_id) as h from sources where source_document_id is not null)")
def split_f26_by_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The split of each document by a digest of seed and id against the cumulated fractions."""
    ids = table(spark, sf_dir, "sources").where("source_document_id is not null").select(F.col("source_document_id").alias("component")).distinct()
    draw = H.unit(H.joined_hash(F.lit("17"), F.col("component")))
    return ids.select("component", F.when(draw < 0.88, "train").when(draw < 0.94, "sft_validation").when(draw < 0.97, "kl_selection").otherwise("formal_monitor").alias("split"))


@query("""with d as (select unnest(generate_series(0, 199)) as i) select i, (cast('0x' || substr(sha256('plan' || chr(0) || '42' || chr(0) || cast(i as varchar) || chr(0) || 'text'), 1, 8) as bigint)) as seed from d""")
def split_f27_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A seed of 32 bits for each of 200 attempts."""
    digest = H.joined_hash(F.lit("plan"), F.lit("42"), F.col("id").cast("string"), F.lit("text"))
    return spark.range(200).select(F.col("id").alias("i"), F.conv(F.substring(digest, 1, 8), 16, 10).cast("long").alias("seed"))


_ORDER = "sha256('7' || chr(0) || quota_buckets || chr(0) || '{0}' || chr(0) || sample_id || chr(0) || 'order')"


def bucket_order(samples: DataFrame, epochs: DataFrame | None = None) -> DataFrame:
    """Samples of each bucket in the order of a digest: of epoch 0, or of each (quota_buckets, epoch) of `epochs`."""
    rows = samples.where("quota_buckets is not null").select("quota_buckets", "sample_id").distinct()
    rows = rows.withColumn("epoch", F.lit(0).cast("long")) if epochs is None else rows.join(epochs, "quota_buckets")
    digest = H.joined_hash(F.lit("7"), F.col("quota_buckets"), F.col("epoch").cast("string"), F.col("sample_id"), F.lit("order"))
    return sequence.digest_rank(rows, ["quota_buckets", "epoch"], digest, "sample_id")


@query(f"""select quota_buckets, sample_id, row_number() over (partition by quota_buckets order by {_ORDER.format(0)}, sample_id) - 1 as pos
    from (select distinct quota_buckets, sample_id from samples where quota_buckets is not null)""")
def order_o2_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of each bucket in the order of a digest."""
    return bucket_order(table(spark, sf_dir, "samples")).drop("epoch")


def quota_cycle(quotas: dict[str, int]) -> list[str]:
    """One cycle of smooth weighted round-robin: each turn everyone gains its quota, the richest is drawn and pays the
    total; ties go to the first."""
    total, credit, drawn = sum(quotas.values()), dict.fromkeys(quotas, 0), []
    for _ in range(total):
        credit = {b: c + quotas[b] for b, c in credit.items()}
        best = max(credit, key=credit.get)
        credit[best] -= total
        drawn.append(best)
    return drawn


QUOTAS = {"print": 12, "handwritten_good": 2, "handwritten_medium": 4, "handwritten_poor": 2}
CYCLE = quota_cycle(QUOTAS)


_EPOCH_ORDER = "sha256('7' || chr(0) || quota_buckets || chr(0) || cast(epoch as varchar) || chr(0) || sample_id || chr(0) || 'order')"


@query(f"""with s as (select distinct quota_buckets, sample_id from samples where quota_buckets is not null),
    c as (select unnest([{", ".join(f"'{b}'" for b in CYCLE)}]) as bucket, unnest(generate_series(0, 19)) as slot),
    d as (select i as draw, bucket, row_number() over (partition by bucket order by i) - 1 as occurrence from (select unnest(generate_series(0, (select count(*) from s) - 1)) as i) join c on i % 20 = slot),
    n as (select quota_buckets, count(*) as size from s group by quota_buckets),
    a as (select draw, bucket, occurrence // size as epoch, occurrence % size as pos from d left join n on bucket = quota_buckets),
    e as (select distinct bucket, epoch from a where epoch is not null),
    o as (select bucket, epoch, sample_id, row_number() over (partition by bucket, epoch order by {_EPOCH_ORDER}, sample_id) - 1 as pos from s join e on quota_buckets = bucket)
    select draw, bucket, epoch, sample_id from a left join o using (bucket, epoch, pos)""")
def order_o3_quota_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quota schedule of as many draws as there are samples, in every epoch that the draws reach."""
    samples = table(spark, sf_dir, "samples")
    return quota_schedule(samples, samples.where("quota_buckets is not null").select("quota_buckets", "sample_id").distinct().count())


def quota_schedule(samples: DataFrame, n: int) -> DataFrame:
    """(draw, bucket, epoch, sample_id) of the first n draws in closed form: draw to bucket and occurrence, occurrence to
    an epoch and a place in the bucket's hash order of that epoch. Draws of a bucket without samples have null epochs.
    Only epochs that occur are ordered: of each bucket at most n rows more than it has samples."""
    slots, before = F.array(*(F.lit(b) for b in CYCLE)), F.array(*(F.lit(CYCLE[:k].count(b)) for k, b in enumerate(CYCLE)))
    each = F.array(*(F.lit(QUOTAS[b]) for b in CYCLE))
    slot = (F.col("draw") % len(CYCLE)).cast("int")
    draws = samples.sparkSession.range(n).select(F.col("id").alias("draw")).select("draw", slots[slot].alias("bucket"), (F.floor(F.col("draw") / len(CYCLE)) * each[slot] + before[slot]).alias("occurrence"))
    # a row for each bucket of the cycle
    sizes = samples.where(F.col("quota_buckets").isin(*QUOTAS)).groupBy(F.col("quota_buckets").alias("bucket")).agg(F.countDistinct("sample_id").alias("size")).where("size > 0")
    at = draws.join(F.broadcast(sizes), "bucket", "left").select("draw", "bucket", F.floor(F.col("occurrence") / F.col("size")).alias("epoch"), F.pmod("occurrence", "size").alias("pos"))
    epochs = at.where("epoch is not null").select(F.col("bucket").alias("quota_buckets"), "epoch").distinct()
    order = bucket_order(samples, epochs).withColumnRenamed("quota_buckets", "bucket")
    return at.join(order, ["bucket", "epoch", "pos"], "left").select("draw", "bucket", "epoch", "sample_id")


@query(f"""with r as (select doc_id, {UNIT_SQL.format("sha256('5' || chr(0) || cast(doc_id as varchar))")} as u, case when lang = 'en' then 0.35 else 2.4 end as rate from documents)
    select doc_id, cast(floor(rate) + case when u < rate - floor(rate) then 1 else 0 end as bigint) as copies from r""")
def sample_o4_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of each document: its rate rounded down, and up with the chance of the fraction."""
    draw = H.unit(H.joined_hash(F.lit("5"), F.col("doc_id").cast("string")))
    rows = table(spark, sf_dir, "documents").select("doc_id", draw.alias("u"), F.when(F.col("lang") == "en", 0.35).otherwise(2.4).alias("rate"))
    return rows.select("doc_id", (F.floor("rate") + F.when(F.col("u") < F.col("rate") - F.floor("rate"), 1).otherwise(0)).cast("long").alias("copies"))


@query(f"""with r as (select doc_id, {UNIT_SQL.format("sha256('5' || chr(0) || cast(doc_id as varchar))")} as u, case when lang = 'en' then 0.35 else 2.4 end as rate from documents),
    c as (select doc_id, unnest(generate_series(1, cast(floor(rate) + case when u < rate - floor(rate) then 1 else 0 end as bigint))) as copy from r)
    select doc_id, copy, sha256('5' || chr(0) || cast(doc_id as varchar) || chr(0) || cast(copy as varchar)) as place from c""")
def sample_o5_shuffled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every copy with its place in the shuffled mix: a global order by digest instead of a buffer."""
    copies = sample_o4_copies(spark, sf_dir).where("copies > 0").select("doc_id", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"))
    return copies.withColumn("place", H.joined_hash(F.lit("5"), F.col("doc_id").cast("string"), F.col("copy").cast("string")))


# counts, quantiles, groups


@query("select coalesce(quota_buckets, 'none') as bucket, count(distinct sample_id) as n from samples group by 1")
def count_a31_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "samples").groupBy(F.coalesce("quota_buckets", F.lit("none")).alias("bucket")).agg(F.countDistinct("sample_id").alias("n"))


@query("""with c as (select quota_buckets as b, count(distinct sample_id) as n from samples where quota_buckets is not null group by 1)
    select b as bucket, n, n * 100 = (select sum(n) from c) * (case b when 'print' then 60 when 'handwritten_good' then 10 when 'handwritten_medium' then 20 else 10 end) as exact from c""")
def count_g13_exact_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each bucket holds exactly its part of the samples."""
    counts = table(spark, sf_dir, "samples").where("quota_buckets is not null").groupBy(F.col("quota_buckets").alias("bucket")).agg(F.countDistinct("sample_id").alias("n"))
    part = F.when(F.col("bucket") == "print", 60).when(F.col("bucket") == "handwritten_good", 10).when(F.col("bucket") == "handwritten_medium", 20).otherwise(10)
    return counts.withColumn("exact", F.col("n") * 100 == F.sum("n").over(Window.partitionBy(F.lit(0))) * part)


@query("select lang, min(n_chars) as low, quantile_disc(n_chars, 0.5) as median, round(quantile_cont(n_chars, 0.95), 6) as p95, max(n_chars) as high, cast(sum(n_chars) as bigint) as total from documents group by lang")
def count_a30_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths by language: extremes, nearest-rank median, interpolated quantile, total."""
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.min("n_chars").alias("low"), F.expr("percentile_disc(0.5) within group (order by n_chars)").cast("long").alias("median"), F.round(F.percentile("n_chars", 0.95), 6).alias("p95"), F.max("n_chars").alias("high"), F.sum("n_chars").alias("total"))


@query("""with s as (select distinct split, sample_id, group_ids.document_id as d, reference_token_count as k from samples where split is not null)
    select split, count(*) as n_samples, count(distinct d) as n_docs, cast(sum(k) as bigint) as numerator, count(k) as denominator, min(k) as low, max(k) as high from s group by split""")
def count_a9_token_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples, documents and tokens of each split; the mean as numerator and denominator."""
    rows = table(spark, sf_dir, "samples").where("split is not null").select("split", "sample_id", F.col("group_ids.document_id").alias("d"), F.col("reference_token_count").alias("k")).distinct()
    return rows.groupBy("split").agg(F.count("*").alias("n_samples"), F.countDistinct("d").alias("n_docs"), F.sum("k").alias("numerator"), F.count("k").alias("denominator"), F.min("k").alias("low"), F.max("k").alias("high"))


@query("""with s as (select split, reference_token_count as k from samples where split is not null and reference_token_count is not null),
    r as (select split, k, row_number() over (partition by split order by k) - 1 as i, count(*) over (partition by split) as n from s), q as (select unnest([0.5, 0.9, 0.99]) as p)
    select split, p, k as value from r, q where i = cast(round_even((n - 1) * p, 0) as bigint)""")
def count_f30_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest-rank percentiles of token counts by split. Equal values are counted first, so only distinct values of a split
    meet, however many rows it has."""
    held = table(spark, sf_dir, "samples").where("split is not null and reference_token_count is not null").groupBy("split", F.col("reference_token_count").alias("k")).agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy("split").orderBy("k").rowsBetween(Window.unboundedPreceding, 0))
    ranked = held.withColumn("upto", upto).withColumn("n", F.sum("c").over(Window.partitionBy("split"))).withColumn("p", F.explode(F.array(*map(F.lit, (0.5, 0.9, 0.99)))))
    at = F.rint((F.col("n") - 1) * F.col("p"))
    return ranked.where((at >= F.col("upto") - F.col("c")) & (at < F.col("upto"))).select("split", F.col("p").cast("decimal(3,2)").alias("p"), F.col("k").alias("value"))


@query("""with r as (select sample_id, reference_model.codepoints as c, updated_at from samples where reference_model.codepoints is not null qualify row_number() over (partition by sample_id order by updated_at) = 1),
    h as (select c from r order by sample_id limit 500) select count(*) as n_rows, cast(sum(len(c)) as bigint) as tokens, cast(sum(len(list_filter(c, lambda x: x >= 6144))) as bigint) as supervised, round(sum(len(list_filter(c, lambda x: x >= 6144))) / cast(sum(len(c)) as double), 6) as rate from h""")
def count_a8_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supervised tokens among those of the first 500 rows, labels unshifted: the head is the feature of this report."""
    head = table(spark, sf_dir, "samples").where("reference_model.codepoints is not null").groupBy("sample_id").agg(F.min_by(F.col("reference_model.codepoints"), "updated_at").alias("c")).orderBy("sample_id").limit(500)
    supervised = F.sum(F.size(F.filter("c", lambda x: x >= 6144)))
    return head.agg(F.count("*").alias("n_rows"), F.sum(F.size("c")).alias("tokens"), supervised.alias("supervised"), F.round(supervised / F.sum(F.size("c")), 6).alias("rate"))


@query("""select event_id, user_id, round(case when max(value) over w - min(value) over w <= 0.5 then 0.0 else (value - avg(value) over w) / (stddev_pop(value) over w + 1e-6) end, 5) as advantage
    from events window w as (partition by user_id, event_type)""")
def group_a26_advantage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each value against its group, in deviations; 0 where the group hardly spreads. Group figures are aggregated and
    joined back, so a large group is no single task."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    figures = events.groupBy("user_id", "event_type").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"), (F.max("value") - F.min("value")).alias("spread"))
    joined = events.join(figures, ["user_id", "event_type"])
    return joined.select("event_id", "user_id", F.round(F.when(F.col("spread") <= 0.5, 0.0).otherwise((F.col("value") - F.col("m")) / (F.col("s") + 1e-6)), 5).alias("advantage"))


@query("select round(avg(f), 6) as value from (select cast(count(distinct lower(lang)) as double) / count(*) as f from documents group by source)")
def group_a36_unique_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean over groups of the share of distinct values."""
    groups = table(spark, sf_dir, "documents").groupBy("source").agg((F.countDistinct(F.lower("lang")) / F.count("*")).alias("f"))
    return groups.agg(F.round(F.avg("f"), 6).alias("value"))


@query("select source, lang, count(*) as n, grouping(source) * 2 + grouping(lang) as level from documents group by rollup (source, lang)")
def count_a3_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by source and language, by source, and of all."""
    return table(spark, sf_dir, "documents").rollup("source", "lang").agg(F.count("*").alias("n"), F.grouping_id("source", "lang").alias("level"))
