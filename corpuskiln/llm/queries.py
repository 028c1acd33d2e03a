"""Queries over the test tables, one or more for each operator of this package, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import read_table as table
from .budget import audit_estimates, document_tokens, token_budget
from .encode import encode_texts
from .mixing import mix_documents, plan_runs
from .normalize import look_alike_classes, look_alike_pairs, normalize_texts, transcriptions
from .packing import pack_documents, packed_sources, packing_report
from .quality import no_prose, quality_statistics
from .sampling import draw_samples
from .splits import assign_splits, split_report

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return look_alike_pairs(transcriptions(spark, table(spark, sf_dir, "reviews"), table(spark, sf_dir, "samples")))


def p1_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every transcription with its one form."""
    return normalize_texts(transcriptions(spark, table(spark, sf_dir, "reviews"), table(spark, sf_dir, "samples")))


def p1_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every transcription with the class of those that look like it."""
    return look_alike_classes(transcriptions(spark, table(spark, sf_dir, "reviews"), table(spark, sf_dir, "samples")))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Related samples, as the split search has them: each with its group."""
    assigned = assign_splits(table(spark, sf_dir, "sources"), table(spark, sf_dir, "split_policy"))
    return assigned.where("sample_id <> group_id").select("group_id", "sample_id")


def p2_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sample with its group and split."""
    return assign_splits(table(spark, sf_dir, "sources"), table(spark, sf_dir, "split_policy"))


def p2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size and share of each split."""
    policy = table(spark, sf_dir, "split_policy")
    return split_report(assign_splits(table(spark, sf_dir, "sources"), policy), policy)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_estimates(table(spark, sf_dir, "source_stats")).where("wrong").select("run_id", "source")


def p3_doc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document."""
    return document_tokens(table(spark, sf_dir, "documents"))


def p3_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, characters and tokens by source, language and domain."""
    return token_budget(table(spark, sf_dir, "documents"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan_runs(table(spark, sf_dir, "source_stats"), table(spark, sf_dir, "mix_runs")).where("exhausted").select("run_id", "source")


def p4_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target, repetition and emission of every source of every run."""
    return plan_runs(table(spark, sf_dir, "source_stats"), table(spark, sf_dir, "mix_runs"))


def p4_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of a source of the manifest, with its rate and copies."""
    return mix_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_sources"))[0]


def p4_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Asked and actual share of every source in the mix of documents."""
    return mix_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_sources"))[1]


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return draw_samples(table(spark, sf_dir, "samples"), table(spark, sf_dir, "quota_targets"))[1].where("short").select("draw_id", "quota_bucket")


def p5_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The samples of every draw."""
    return draw_samples(table(spark, sf_dir, "samples"), table(spark, sf_dir, "quota_targets"))[0]


def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quota, held and taken samples of every bucket of every draw."""
    return draw_samples(table(spark, sf_dir, "samples"), table(spark, sf_dir, "quota_targets"))[1]


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(table(spark, sf_dir, "documents"))


def p7_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pack_bins"), table(spark, sf_dir, "mix_sources"))


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bins, unused room and distance from the mixture of every kind."""
    return packing_report(p7_bins(spark, sf_dir), table(spark, sf_dir, "mix_sources"))


def p7_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens and bins of every source, against its target share."""
    return packed_sources(p7_bins(spark, sf_dir), table(spark, sf_dir, "mix_sources"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return no_prose(table(spark, sf_dir, "documents"))


def p8_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All statistics of every document."""
    return quality_statistics(table(spark, sf_dir, "documents"), keep=("doc_id", "lang", "source"))


QUERIES: dict[str, Query] = {
    "p1_found": p1_found,
    "p1_texts": p1_texts,
    "p1_classes": p1_classes,
    "p2_found": p2_found,
    "p2_splits": p2_splits,
    "p2_report": p2_report,
    "p3_found": p3_found,
    "p3_doc_tokens": p3_doc_tokens,
    "p3_budget": p3_budget,
    "p4_found": p4_found,
    "p4_plan": p4_plan,
    "p4_mix": p4_mix,
    "p4_shares": p4_shares,
    "p5_found": p5_found,
    "p5_draws": p5_draws,
    "p5_report": p5_report,
    "p6_ids": p6_ids,
    "p7_bins": p7_bins,
    "p7_report": p7_report,
    "p7_sources": p7_sources,
    "p8_found": p8_found,
    "p8_statistics": p8_statistics,
}

#: Last delivery of each row of source_stats with its measured size.
_STATS = """
    select *, case when chars is null or sampled_chars is null or sampled_tokens is null then null
                   when sampled_chars = 0 then cast(sampled_tokens as double)
                   else cast(chars as double) * sampled_tokens / sampled_chars end as measured
    from source_stats
    qualify row_number() over (partition by run_id, source order by received_at desc nulls last) = 1"""

SQL: dict[str, str] = {
    "p3_found": f"""
        select run_id, source from ({_STATS})
        where measured is not null and (est_tokens is null or abs(est_tokens - measured) > 1)""",
    "p4_found": f"""
        with s as ({_STATS}),
        k as (select run_id, source, coalesce(weight, 1) as w, coalesce(measured, cast(est_tokens as double)) as size from s),
        t as (select run_id, sum(w) as ws, sum(size) as sizes from k group by run_id)
        select k.run_id, k.source
        from k join t using (run_id) left join mix_runs r using (run_id)
        where case when t.ws > 0 then k.w / t.ws else 0 end
              * case when coalesce(r.total_tokens, 0) = 0 then t.sizes else cast(r.total_tokens as double) end
              > coalesce(r.max_epochs, 4) * k.size""",
    "p5_found": """
        with b as (
            select sample_id, coalesce(quota_buckets, case when style = 'print' then 'print'
                       when style = 'handwritten' and difficulty in ('good', 'medium', 'poor') then 'handwritten_' || difficulty end) as bucket
            from samples where sample_id is not null
            qualify row_number() over (partition by sample_id order by updated_at desc nulls last) = 1),
        c as (select bucket, count(*) as held from b where bucket is not null group by bucket)
        select draw_id, quota_bucket from quota_targets q left join c on c.bucket = q.quota_bucket
        where coalesce(held, 0) < greatest(cast(min_rows as double), target_share * draw_fraction * (select sum(held) from c))""",
}
