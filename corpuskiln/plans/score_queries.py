"""Queries on scores, mixing figures and tokens; and the SQL they must agree with."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as X
from ..operators import planning, scoring
from ..session import read_table as table
from ..session import placed, spread, staged
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


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A transcription against the accepted text of its sample, with the bucket of the sample: one row a review."""
    reviews = table(spark, sf_dir, "reviews").groupBy("review_id").agg(F.min("sample_id").alias("sample_id"), F.min("reference_raw").alias("pred")).where("pred is not null")
    samples = table(spark, sf_dir, "samples").groupBy("sample_id").agg(F.min("reference_model.text").alias("ref"), F.min("quota_buckets").alias("bucket"), F.min("writing_mode").alias("mode")).where("ref is not null")
    return placed(reviews, "sample_id").join(placed(samples, "sample_id"), "sample_id")


@query()
def score_a17_error_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error rates by writing mode."""
    return scoring.error_rates(pairs(spark, sf_dir), ["mode"])


@query()
def score_a18_by_script(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.script_rates(pairs(spark, sf_dir), "review_id")


@query()
def score_a19_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confusions of digits, punctuation and Mongolian controls."""
    return scoring.symbol_confusions(scoring.alignments(pairs(spark, sf_dir), "review_id", "pred", "ref"))


@query()
def score_f21_alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operations of the alignment of every pair."""
    aligned = scoring.alignments(pairs(spark, sf_dir), "review_id", "pred", "ref")
    return aligned.groupBy("review_id").agg(*(F.count_if(F.col("op") == o).alias(o) for o in ("match", "substitution", "deletion", "insertion")))


@query()
def score_a23_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interval of the difference of two weighted error rates, raw and folded, by 2,000 paired resamples of the test
    set: all pairs of each bucket."""
    p, r = F.col("pred"), F.col("ref")
    rows = pairs(spark, sf_dir).where("bucket is not null").select("bucket", "review_id", scoring.char_distance(p, r).alias("a"), scoring.char_distance(X.nominal_fold(p), X.nominal_fold(r)).alias("b"), F.greatest(F.length("ref"), F.lit(1)).alias("n"))
    held = scoring_set(rows)
    weights = {"print": 0.6, "handwritten_good": 0.1, "handwritten_medium": 0.2, "handwritten_poor": 0.1}
    deltas = scoring.paired_bootstrap(spark, {b: v for b, v in held.items() if b in weights}, weights)
    return deltas.agg(F.round(F.avg("delta"), 9).alias("mean"), F.round(F.percentile("delta", 0.025), 9).alias("low"), F.round(F.percentile("delta", 0.975), 9).alias("high"), F.count("*").alias("resamples"))


def scoring_set(rows: DataFrame, limit: int = 2_000_000) -> dict[str, np.ndarray]:
    """The test set by bucket, in the order of its keys. A test set is evaluated by hand and bounded: more rows than
    `limit` raise instead of filling the driver."""
    if rows.count() > limit:
        raise ValueError(f"a test set of more than {limit} rows")
    frame = rows.orderBy("review_id").toPandas()
    return {b: g[["a", "b", "n"]].to_numpy(np.int64) for b, g in frame.groupby("bucket")}


@query("""with r as (select review_id, min(sample_id) as sample_id, min(reference_raw) as pred from reviews group by review_id), s as (select sample_id, min(reference_model.text) as ref, min(quota_buckets) as bucket from samples group by sample_id),
    p as (select bucket, abs(length(pred) - length(ref)) as d, greatest(length(ref), 1) as n from r join s using (sample_id) where pred is not null and ref is not null and bucket is not null)
    select round(sum(w * rate), 6) as weighted from (select case bucket when 'print' then 0.6 when 'handwritten_good' then 0.1 when 'handwritten_medium' then 0.2 else 0.1 end as w, cast(sum(d) as double) / sum(n) as rate from p group by bucket)""")
def score_a22_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A weighted mean of ratios of sums, of the differences in length."""
    rows = pairs(spark, sf_dir).where("bucket is not null").groupBy("bucket").agg((F.sum(F.abs(F.length("pred") - F.length("ref"))) / F.sum(F.greatest(F.length("ref"), F.lit(1)))).alias("rate"))
    weight = F.when(F.col("bucket") == "print", 0.6).when(F.col("bucket") == "handwritten_good", 0.1).when(F.col("bucket") == "handwritten_medium", 0.2).otherwise(0.1)
    return rows.agg(F.round(F.sum(weight * F.col("rate")), 6).alias("weighted"))


def _graphemes(text: str) -> str:
    return f"len(regexp_extract_all({text}, '{P.GRAPHEME}'))"


@query(f"""with r as (select review_id, min(sample_id) as sample_id, min(reference_raw) as pred from reviews group by review_id), s as (select sample_id, min(reference_model.text) as ref from samples group by sample_id)
    select review_id, round(least(1.0, greatest(0.0, (cast({_graphemes('pred')} as double) / greatest({_graphemes('ref')}, 1) - 1.0) / 1.0)), 6) as penalty from r join s using (sample_id) where pred is not null and ref is not null""")
def score_f24_length_excess(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many more graphemes a transcription has than its reference, clamped."""
    ratio = X.count(F.col("pred"), P.GRAPHEME) / F.greatest(X.count(F.col("ref"), P.GRAPHEME), F.lit(1))
    return pairs(spark, sf_dir).select("review_id", F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), ratio - 1)), 6).alias("penalty"))


DEPLOYED = {"print": 0.6, "handwritten_good": 0.1, "handwritten_medium": 0.2, "handwritten_poor": 0.1}


@query()
def score_a20_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One report of all pairs: error rates and exact matches of those that are not rejected (blank transcriptions are),
    and the share of rejected ones."""
    rows = pairs(spark, sf_dir).withColumn("rejected", X.strip(F.col("pred")) == "")
    scored = scoring.error_rates(rows.where("not rejected").withColumn("all", F.lit("all")), ["all"])
    counts = rows.agg(F.count("*").alias("n_pairs"), F.count_if("rejected").alias("n_rejected")).withColumn("all", F.lit("all"))
    return counts.join(scored, "all", "left").withColumn("rejection_rate", F.round(F.col("n_rejected") / F.col("n_pairs"), 6)).drop("all")


@query()
def score_a21_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error rates by bucket, the mean weighted by what is deployed, over the buckets there are, and the worst bucket."""
    rates = scoring.error_rates(pairs(spark, sf_dir).where(F.col("bucket").isin(*DEPLOYED)), ["bucket"])
    weight = F.lit(0.0)
    for name, share in DEPLOYED.items():
        weight = F.when(F.col("bucket") == name, share).otherwise(weight)
    every = Window.partitionBy(F.lit(0))  # a row for each bucket
    weighed = rates.withColumn("weight", weight)
    worst = F.max(F.struct("cer", "bucket")).over(every)["bucket"]
    return weighed.withColumn("weighted_cer", F.round(F.sum(F.col("weight") * F.col("cer")).over(every) / F.sum("weight").over(every), 6)).withColumn("worst", F.col("bucket") == worst)


@query()
def score_a24_mean_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean length of the transcriptions of each bucket with its interval by 2,000 resamples. Rows of one value are
    exchangeable, so a resample draws how often each value occurs."""
    rows = pairs(spark, sf_dir).where("bucket is not null").select("bucket", F.length("pred").alias("v"))
    return scoring.mean_intervals(rows, "bucket", "v")


# mixing by the first rows of each source, as the plain plan does


_PROXY = f"greatest(len(regexp_extract_all({T}, '{P.WORD}')), length({T}) // 4, 1)"
_MEASURE = f"""with d as (select source, length({T}) as n, {_PROXY} as t, row_number() over (partition by source order by doc_id) <= 20 as sampled from documents where source is not null and length({T}) > 0),
    m as (select source, count(*) as docs, cast(sum(n) as bigint) as chars, count(*) filter (sampled) as sampled_docs, cast(sum(n) filter (sampled) as bigint) as sampled_chars, cast(sum(t) filter (sampled) as bigint) as sampled_tokens from d group by source),
    e as (select *, cast(round_even(cast(chars as double) * sampled_tokens / sampled_chars, 0) as bigint) as est_tokens from m)"""


@query(_MEASURE + " select * from e")
def mix_a4_measure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, characters and estimated tokens of each source: tokens of its first 20 documents, scaled by characters."""
    from ..operators.sequence import row_index

    t = X.text_of("text")
    rows = spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).where(F.col("source").isNotNull() & (F.length(t) > 0)).select("doc_id", "source", F.length(t).alias("n"), F.greatest(X.count(t, P.WORD), F.floor(F.length(t) / 4).cast("int"), F.lit(1)).alias("t"))
    sampled = F.col("i") < 20
    measured = row_index(staged(rows), "doc_id", "i", ("source",)).groupBy("source").agg(
        F.count("*").alias("docs"), F.sum("n").cast("long").alias("chars"), F.count_if(sampled).alias("sampled_docs"), F.sum(F.when(sampled, F.col("n"))).cast("long").alias("sampled_chars"), F.sum(F.when(sampled, F.col("t"))).cast("long").alias("sampled_tokens"),
    )
    return measured.withColumn("est_tokens", F.rint(F.col("chars").cast("double") * F.col("sampled_tokens") / F.col("sampled_chars")).cast("long"))


_PLAN = _MEASURE + """, p as (select s.source, lang, domain, coalesce(weight, 1) as weight, coalesce(docs, 0) as docs, coalesce(est_tokens, 0) as est from mix_sources s left join e using (source)),
    t as (select *, weight / sum(weight) over () * sum(est) over () as target from p),
    f as (select *, case when est > 0 then least(target / est, 4) else 0.0 end as repeat_factor from t)"""


@query(_PLAN + " select source, round(target, 3) as target_tokens, round(repeat_factor, 6) as repeat_factor, round(case when repeat_factor > 1 then repeat_factor / ceil(repeat_factor) else repeat_factor end, 6) as emit_prob from f")
def mix_a5_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target tokens, repetition and chance of each source, from its weight."""
    return _plan(spark, sf_dir).select("source", F.round("target", 3).alias("target_tokens"), F.round("repeat_factor", 6).alias("repeat_factor"), F.round(F.when(F.col("repeat_factor") > 1, F.col("repeat_factor") / F.ceil("repeat_factor")).otherwise(F.col("repeat_factor")), 6).alias("emit_prob"))


def _plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = Window.partitionBy(F.lit(0))  # as many rows as the manifest has sources
    held = table(spark, sf_dir, "mix_sources").select("source", "lang", "domain", F.coalesce("weight", F.lit(1.0)).alias("weight")).join(mix_a4_measure(spark, sf_dir).select("source", "docs", F.col("est_tokens").alias("est")), "source", "left").na.fill(0, ["docs", "est"])
    planned = held.withColumn("target", F.col("weight") / F.sum("weight").over(every) * F.sum("est").over(every))
    return planned.withColumn("repeat_factor", F.when(F.col("est") > 0, F.least(F.col("target") / F.when(F.col("est") > 0, F.col("est")), F.lit(4.0))).otherwise(0.0))


@query(_PLAN + """, g as (select source, lang, domain, round(repeat_factor * est / sum(repeat_factor * est) over (), 4) as share from f)
    select case when grouping(source) = 0 then 'source' when grouping(lang) = 0 then 'lang' else 'domain' end as slice, coalesce(source, lang, domain) as value, round(sum(share), 4) as share from g group by grouping sets ((source), (lang), (domain))""")
def mix_a6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected shares by source, and the rounded shares summed by language and by domain."""
    every = Window.partitionBy(F.lit(0))
    mass = F.col("repeat_factor") * F.col("est")
    shares = _plan(spark, sf_dir).select("source", "lang", "domain", F.round(mass / F.sum(mass).over(every), 4).alias("share"))
    sets = shares.groupingSets([[F.col("source")], [F.col("lang")], [F.col("domain")]], F.col("source"), F.col("lang"), F.col("domain"))
    summed = sets.agg(F.round(F.sum("share"), 4).alias("share"), F.grouping("source").alias("gs"), F.grouping("lang").alias("gl"))
    return summed.select(F.when(F.col("gs") == 0, "source").when(F.col("gl") == 0, "lang").otherwise("domain").alias("slice"), F.coalesce("source", "lang", "domain").alias("value"), "share")


# tokens


@query(rf"select doc_id, unnest(list_filter(regexp_split_to_array({T}, '[ \t\r\n]+'), lambda x: x <> '')) as token from documents")
def token_t1_ascii_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(F.filter(F.split(X.text_of("text"), r"[ \t\r\n]+"), lambda x: x != "")).alias("token"))


@query(rf"""with t as (select doc_id, unnest(regexp_extract_all({T}, '\p{{L}}+|\p{{N}}+|[^\p{{L}}\p{{N}}]')) as w from documents)
    select case when regexp_matches(w, '^[\x{{1800}}-\x{{18af}}]') then 'mn' when regexp_matches(w, '^\p{{L}}') then 'letter' when regexp_matches(w, '^\p{{N}}') then 'number' else 'other' end as track,
    count(*) as tokens, cast(sum(length(w)) as bigint) as chars, round(sum(length(w)) / cast(count(*) as double), 6) as chars_per_token from t group by rollup (track)""")
def token_a10_chars_per_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters a token by track, and overall."""
    words = table(spark, sf_dir, "documents").select(F.explode(X.found(X.text_of("text"), r"\p{L}+|\p{N}+|[^\p{L}\p{N}]")).alias("w"))
    track = F.when(F.col("w").rlike(r"^[\x{1800}-\x{18af}]"), "mn").when(F.col("w").rlike(r"^\p{L}"), "letter").when(F.col("w").rlike(r"^\p{N}"), "number").otherwise("other")
    return words.select(track.alias("track"), F.length("w").alias("n")).rollup("track").agg(F.count("*").alias("tokens"), F.sum("n").cast("long").alias("chars"), F.round(F.sum("n") / F.count("*"), 6).alias("chars_per_token"))


@query("""with c as (select sample_id, len(reference_model.codepoints) as n, length(reference_model.text) as m, reference_token_count as k, list_aggregate(list_transform(reference_model.codepoints, lambda x: chr(x)), 'string_agg', '') = reference_model.text as same from samples where reference_model.text is not null)
    select count(*) as n_rows, count(*) filter (n <> m) as wrong_length, count(*) filter (not same) as wrong_text, count(*) filter (k is null) as no_count from c""")
def gate_g9_row_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose code points do not spell their text, by kind of failure."""
    model = table(spark, sf_dir, "samples").where("reference_model.text is not null").select("reference_token_count", "reference_model.*")
    # a code point as four bytes in big-endian order is a character of UTF-32; the mark before them, and only that, is taken off
    spelled = F.decode(F.unhex(F.concat(F.lit("0000FEFF"), F.array_join(F.transform("codepoints", lambda c: F.lpad(F.hex(c), 8, "0")), ""))), "UTF-32")
    return model.select(F.size("codepoints").alias("n"), F.length("text").alias("m"), (spelled == F.col("text")).alias("same"), F.col("reference_token_count").isNull().alias("none")).agg(
        F.count("*").alias("n_rows"), F.count_if(F.col("n") != F.col("m")).alias("wrong_length"), F.count_if(~F.col("same")).alias("wrong_text"), F.count_if("none").alias("no_count"),
    )


@query()
def plan_o11_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows within a budget of 64 patches for the image of every order line, by its distinct sizes."""
    sizes = table(spark, sf_dir, "lineitem").select((F.col("l_quantity") * 40).cast("int").alias("w"), (F.pmod("l_partkey", F.lit(50)) * 40 + 40).cast("int").alias("h")).groupBy("w", "h").agg(F.count("*").alias("n_images"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            plans = [planning.window_plan(w, h, 16, 64) for w, h in zip(batch["w"], batch["h"])]
            yield batch.assign(n_windows=[len(p) for p in plans], covered=[planning.union_and_overlap(p)[0] for p in plans], doubled=[planning.union_and_overlap(p)[1] for p in plans])

    return sizes.mapInPandas(run, "w int, h int, n_images long, n_windows long, covered long, doubled long")


@query()
def plan_a34_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area covered, and covered more than once, by the boxes of each group."""
    boxes = table(spark, sf_dir, "lineitem").select("l_orderkey", F.pmod("l_partkey", F.lit(400)).cast("int").alias("x0"), F.pmod("l_suppkey", F.lit(300)).cast("int").alias("y0"), F.col("l_quantity").cast("int").alias("s"))
    grouped = boxes.groupBy("l_orderkey").agg(F.collect_list(F.array("x0", "y0", F.col("x0") + F.col("s"), F.col("y0") + F.col("s"))).alias("b"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            areas = [planning.union_and_overlap([tuple(b) for b in bs]) for bs in batch["b"]]
            yield pd.DataFrame({"l_orderkey": batch["l_orderkey"], "covered": [a for a, _ in areas], "doubled": [d for _, d in areas]})

    return grouped.mapInPandas(run, "l_orderkey long, covered long, doubled long")
