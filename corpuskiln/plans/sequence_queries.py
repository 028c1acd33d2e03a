"""Queries on order: windows over tokens, numbering, schedules, packing, time series; and the SQL they must agree with."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as X
from ..operators import sequence as S
from ..session import read_table as table
from ..session import spread, staged
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


def sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document, as its size in tokens."""
    documents = spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return staged(documents.select("doc_id", "source", X.count(X.text_of("text"), P.WORD).cast("long").alias("n")))


_SIZES = f"(select doc_id, source, len(regexp_extract_all({T}, '{P.WORD}')) as n from documents)"


@query(rf"""with t as (select doc_id, regexp_extract_all({T}, '\p{{L}}{{1,4}}|\p{{N}}+|(?s).') as p from documents),
    e as (select doc_id, unnest(p) as s, unnest(generate_series(1, len(p))) as pos from t),
    o as (select *, sum(length(s)) over (partition by doc_id order by pos) - length(s) as start, case when regexp_matches(s, '^[\x{{1800}}-\x{{18af}}]') and regexp_matches(s, '^\p{{L}}') then 'mn' when regexp_matches(s, '^\p{{L}}') then 'general' else 'none' end as track from e),
    w as (select *, track in ('mn', 'general') as word, coalesce(track in ('mn', 'general') and lag(track) over z = track and lag(start + length(s)) over z = start, false) as goes_on from o window z as (partition by doc_id order by pos)),
    n as (select *, sum(case when word and not goes_on then 1 else 0 end) over (partition by doc_id order by pos) as k from w)
    select doc_id, cast(max(k) as bigint) as n_words, cast(max(d) as bigint) as deepest, cast(sum(d) as bigint) as depths from
    (select doc_id, k, case when word then row_number() over (partition by doc_id, k, word order by pos) - 1 else 0 end as d from n) group by doc_id""")
def window_w1_word_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and depths of the pieces of each document: texts are placed by document once, then exploded, so that the
    windows shuffle nothing."""
    placed = table(spark, sf_dir, "documents").select("doc_id", X.text_of("text").alias("t")).repartition("doc_id")
    pieces = placed.select("doc_id", F.posexplode(X.found(F.col("t"), r"\p{L}{1,4}|\p{N}+|(?s).")).alias("at", "s"))
    upto = Window.partitionBy("doc_id").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    track = F.when(F.col("s").rlike(r"^[\x{1800}-\x{18af}]") & F.col("s").rlike(r"^\p{L}"), "mn").when(F.col("s").rlike(r"^\p{L}"), "general").otherwise("none")
    ends = pieces.withColumn("end", F.sum(F.length("s")).over(upto)).withColumn("start", F.col("end") - F.length("s")).withColumn("track", track)
    found = S.morphology(ends, "doc_id", "at", "track", "start", "end")
    words = F.when(F.col("track") != "none", F.col("word_pos") + 1).otherwise(F.col("word_pos"))
    return found.groupBy("doc_id").agg(F.coalesce(F.max(F.when(F.col("track") != "none", F.col("word_pos") + 1)), F.lit(0)).cast("long").alias("n_words"), F.max("depth").cast("long").alias("deepest"), F.sum("depth").cast("long").alias("depths"))


@query("""with o as (select *, row_number() over (partition by event_type order by event_id) as rn from events) select event_type, event_id from o where rn <= 25""")
def window_w3_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 25 rows of each shard."""
    return S.capped(table(spark, sf_dir, "events").select("event_type", "event_id"), ["event_type"], ["event_id"], 25)


@query("select doc_id, (row_number() over (order by doc_id) - 1) // 64 as shard, (row_number() over (order by doc_id) - 1) % 64 as at from documents")
def window_w4_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows in shards of 64, by number."""
    numbered = S.row_index(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")
    return numbered.select("doc_id", F.floor(F.col("idx") / 64).alias("shard"), F.pmod("idx", F.lit(64)).alias("at"))


@query(f"""with s as {_SIZES}, w as (select doc_id, n, unnest(case when n <= 128 then [0] else generate_series(0, n - 2, 127) end) as token_start from s where n > 0)
    select doc_id, cast(token_start as bigint) as token_start, least(token_start + 128, n) as token_end from w""")
def window_w5_token_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 128 tokens that overlap by one."""
    return S.token_windows(sizes(spark, sf_dir), "doc_id", "n", 128)


@query(f"""with s as (select doc_id, n, sum(n) over (order by doc_id) - n as start, sum(n) over () as total from {_SIZES} where n > 0),
    p as (select *, unnest(generate_series(cast(start // 512 as bigint), cast((start + n - 1) // 512 as bigint))) as chunk from s)
    select chunk, doc_id, cast(greatest(start, chunk * 512) - start as bigint) as first, cast(least(start + n, (chunk + 1) * 512) - greatest(start, chunk * 512) as bigint) as n from p where chunk < total // 512""")
def window_w6_fixed_chop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts end to end, cut at every 512 tokens; the tail is dropped."""
    return S.fixed_chop(sizes(spark, sf_dir), "doc_id", "n", 512)


@query()
def window_w7_next_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Next-fit packs of 512 tokens with separators, in shards of 1,024 documents; texts above 400 tokens stand alone."""
    shards = S.row_index(sizes(spark, sf_dir), "doc_id").select("doc_id", "n", F.floor(F.col("idx") / 1024).alias("shard"), (F.col("n") > 400).alias("alone"))
    return S.next_fit_packs(shards, "shard", "doc_id", "n", 512, words="n", alone="alone")


@query("""with o as (select user_id, event_id, lead(event_id) over (partition by user_id order by event_id) as nx, first(event_id) over (partition by user_id order by event_id) as f, count(*) over (partition by user_id) as n from events)
    select event_id, user_id, coalesce(nx, f) as next from o where n > 1""")
def window_w9_next_in_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next row of the same group, the first after the last, by numbers and a join."""
    rows = table(spark, sf_dir, "events").select(F.col("event_id"), "user_id", F.col("event_id").alias("at_event"))
    return S.next_in_group(rows, "event_id", "user_id", "at_event")


@query("with o as (select event_id, row_number() over (order by event_id) - 1 as i from events) select event_id, i % 4 as rank, i // 4 as turn from o")
def window_w10_rank_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows dealt to four ranks in turn."""
    numbered = S.row_index(table(spark, sf_dir, "events").select("event_id"), "event_id")
    return numbered.select("event_id", F.pmod("idx", F.lit(4)).alias("rank"), F.floor(F.col("idx") / 4).alias("turn"))


@query("""with w as (select event_id, user_id, value, avg(value) over z as m, count(*) over z as n from events window z as (partition by user_id order by event_id rows between 9 preceding and current row))
    select event_id, user_id, case when n = 10 then round(m, 6) end as smoothed from w""")
def window_w11_rolling_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean of the last ten values, once there are ten."""
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(-9, 0)
    return table(spark, sf_dir, "events").select("event_id", "user_id", F.when(F.count("*").over(w) == 10, F.round(F.avg("value").over(w), 6)).alias("smoothed"))


@query()
def window_w11_plateau(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the smoothed values of each user stop to improve: (user_id, step, smoothed, best, bad_steps, stop)."""
    import pandas as pd

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("event_id")
        rows = list(S.plateau(enumerate(group["value"].tolist()), 5, 10, 0.01, 8))
        return pd.DataFrame(rows, columns=["step", "smoothed", "best", "bad_steps", "stop"]).assign(user_id=group["user_id"].iloc[0])[["user_id", "step", "smoothed", "best", "bad_steps", "stop"]]

    return table(spark, sf_dir, "events").select("user_id", "event_id", "value").groupBy("user_id").applyInPandas(fold, "user_id long, step long, smoothed double, best double, bad_steps long, stop boolean")


@query("select user_id, event_id, value from events qualify row_number() over (partition by user_id order by event_id desc) <= 5")
def window_w12_last_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last five rows of each user, as a trimmed history holds them."""
    return S.capped(table(spark, sf_dir, "events").select("user_id", "event_id", "value", (-F.col("event_id")).alias("_o")), ["user_id"], ["_o"], 5).drop("_o")


@query("""with d as (select doc_id, row_number() over (order by doc_id) - 1 as k, count(*) over () as n from documents),
    p as (select step, unnest(generate_series(0, 7)) as j from (select unnest(generate_series(0, (select (count(*) * 5 // 2 + 7) // 8 - 1 from documents))) as step)) select step, j, doc_id from p join d on (step * 8 + j) % n = k""")
def window_w13_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts of batches of eight, two and a half times round all documents."""
    numbered = S.row_index(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", "k")
    n = numbered.count()
    plan = spark.range((n * 5 // 2 + 7) // 8 * 8).select(F.floor(F.col("id") / 8).alias("step"), F.pmod("id", F.lit(8)).alias("j"), F.pmod("id", F.lit(max(n, 1))).alias("k"))
    return plan.join(numbered, "k").select("step", "j", "doc_id")


@query("""with e as (select event_id, event_type = 'purchase' as mix, row_number() over (partition by event_type = 'purchase' order by event_id) - 1 as i from events)
    select event_id, mix, case when mix then i * 5 + 4 else i // 4 * 5 + i % 4 end as place from e""")
def window_w14_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth place from the second stream."""
    rows = table(spark, sf_dir, "events").select("event_id", (F.col("event_type") == "purchase").alias("mix"))
    i = F.col("i")
    return S.row_index(rows, "event_id", "i", ("mix",)).select("event_id", "mix", F.when(F.col("mix"), i * 5 + 4).otherwise(F.floor(i / 4) * 5 + F.pmod(i, F.lit(4))).alias("place"))


@query("""with e as (select event_id, event_type in ('view', 'click') as main, row_number() over (partition by event_type in ('view', 'click') order by event_id) - 1 as i from events),
    k as (select *, case when main then i // 2 else i end as a, case when main then i % 2 else 2 end as b from e) select event_id, row_number() over (order by a, b) - 1 as place from k""")
def window_w15_two_to_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rows of one source, then one of the other, while they last."""
    rows = table(spark, sf_dir, "events").select("event_id", F.col("event_type").isin("view", "click").alias("main"))
    i = F.col("i")
    keyed = S.row_index(rows, "event_id", "i", ("main",)).withColumn("turn", F.when(F.col("main"), F.floor(i / 2) * 4 + F.pmod(i, F.lit(2))).otherwise(i * 4 + 2))
    return S.row_index(keyed.select("event_id", "turn"), "turn", "place").select("event_id", "place")


@query("""with e as (select user_id, event_id, row_number() over (partition by user_id order by event_id) - 1 as i, count(*) over (partition by user_id) as n from events)
    select event_id, user_id, greatest(least(i // 2, n // 2 - 1), 0) as batch from e""")
def window_w16_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of two, with a last one of three where the number is odd."""
    numbered = S.row_index(table(spark, sf_dir, "events").select("user_id", "event_id"), "event_id", "i", ("user_id",))
    n = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    return numbered.join(n, "user_id").select("event_id", "user_id", F.greatest(F.least(F.floor(F.col("i") / 2), F.floor(F.col("n") / 2) - 1), F.lit(0)).alias("batch"))


@query("""with e as (select user_id, event_id, cast(floor(value) as bigint) % 3 as token from events), l as (select *, lag(token) over (partition by user_id order by event_id) as before from e)
    select user_id, event_id, token from l where token <> 0 and (before is null or token <> before)""")
def window_w18_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A token sequence without repeats in a row, then without blanks."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    tokens = table(spark, sf_dir, "events").select("user_id", "event_id", F.pmod(F.floor("value").cast("long"), F.lit(3)).alias("token"))
    return tokens.withColumn("before", F.lag("token").over(w)).where("token <> 0 and (before is null or token <> before)").select("user_id", "event_id", "token")


@query("""with l as (select user_id, event_id, value, row_number() over (partition by user_id order by event_id desc) as r from events qualify r <= 60),
    m as (select *, min(value) over (partition by user_id) as lo, max(value) over (partition by user_id) as hi from l)
    select user_id, event_id, case when hi > lo then cast(floor((value - lo) / (hi - lo) * 7) as bigint) else 3 end as level from m""")
def window_w19_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 60 values of each user on a scale of eight levels."""
    last = S.capped(table(spark, sf_dir, "events").select("user_id", "event_id", "value", (-F.col("event_id")).alias("_o")), ["user_id"], ["_o"], 60)
    w = Window.partitionBy("user_id")
    lo, hi = F.min("value").over(w), F.max("value").over(w)
    return last.select("user_id", "event_id", F.when(hi > lo, F.floor((F.col("value") - lo) / (hi - lo) * 7)).otherwise(F.lit(3).cast("long")).alias("level"))


# scans and sinks as plans


@query("select doc_id, row_number() over (order by doc_id) - 1 as kept_idx from (select doc_id, row_number() over (order by doc_id) - 1 as i from documents) where i % 7 = 0")
def scan_s21_strided(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh row, numbered anew: the stride is the feature."""
    strided = S.row_index(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", "i").where(F.pmod("i", F.lit(7)) == 0)
    return strided.select("doc_id", F.floor(F.col("i") / 7).alias("kept_idx"))


@query("select source, doc_id from documents where source is not null qualify row_number() over (partition by source order by doc_id) <= greatest(200 // (select count(distinct source) from documents), 1)")
def scan_s27_even_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample of 200 rows, spread evenly over the files."""
    rows = table(spark, sf_dir, "documents").where("source is not null").select("source", "doc_id")
    return S.capped(rows, ["source"], ["doc_id"], max(200 // max(rows.select("source").distinct().count(), 1), 1))


@query("""with x as (select distinct source from mix_sources), p as (select path, cast(regexp_extract(path, '(\\d+)', 1) as varchar) as n from mix_sources)
    select source, split_part(path, '.', -1) as format from mix_sources""".replace("\\\\", "\\"))
def scan_s16_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The format of each source of the manifest by its path."""
    return table(spark, sf_dir, "mix_sources").select("source", F.element_at(F.split("path", r"\."), -1).alias("format"))


@query("select doc_id, coalesce(nullif(text, ''), nullif(domain, '')) as t from documents where coalesce(nullif(text, ''), nullif(domain, '')) is not null")
def scan_s14_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first column of a list that holds something."""
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.nullif("text", F.lit("")), F.nullif("domain", F.lit(""))).alias("t")).where("t is not null")


@query("""select doc_id, unnest(list_filter([{'field': 'text', 'value': text}, {'field': 'domain', 'value': domain}, {'field': 'lang', 'value': lang}], lambda x: x.value is not null and x.value <> '')) .field as field from documents""".replace(") .field", ")['field']"))
def scan_s4_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each field that holds something."""
    fields = F.filter(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in ("text", "domain", "lang"))), lambda x: x.value.isNotNull() & (x.value != ""))
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(fields).alias("x")).select("doc_id", "x.field")


@query("""with n as (select doc_id, source, row_number() over (partition by source order by doc_id) as rn, coalesce(length(text), 0) as n from documents where source is not null)
    select doc_id, case when n = 0 then 'empty' when n > 2000 then 'over_length' when doc_id % 10 = 0 and rn > 20 then 'val_cap' when doc_id % 10 = 0 then 'val' else 'train' end as route from n""")
def gate_g8_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each row of a shard goes: the first reason that holds, with a cap on validation rows."""
    rows = S.row_index(table(spark, sf_dir, "documents").where("source is not null").select("doc_id", "source", F.length(X.text_of("text")).alias("n")), "doc_id", "rn", ("source",))
    val = F.pmod("doc_id", F.lit(10)) == 0
    return rows.select("doc_id", X.first_reason((F.col("n") == 0, "empty"), (F.col("n") > 2000, "over_length"), (val & (F.col("rn") >= 20), "val_cap"), (val, "val"), (F.lit(True), "train")).alias("route"))


# arithmetic on rows


def _patches(w: Column, h: Column, patch: int, merge: int) -> Column:
    return F.greatest(F.ceil(F.ceil(w / patch) / merge) * F.ceil(F.ceil(h / patch) / merge), F.lit(1)).cast("long")


@query("""select l_orderkey, l_linenumber, cast(greatest(ceil(ceil(l_quantity * 20 / 14) / 2) * ceil(ceil(cast(l_partkey as double) / 14) / 2), 1) as bigint) as n_patches,
    cast(ceil(l_quantity * 20 / 16) * ceil(cast(l_partkey as double) / 32) as bigint) as n_raw from lineitem""")
def measure_p17_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patches of an image of given width and height, merged two by two, and raw ones."""
    w, h = F.col("l_quantity") * 20, F.col("l_partkey").cast("double")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", _patches(w, h, 14, 2).alias("n_patches"), (F.ceil(w / 16) * F.ceil(h / 32)).cast("long").alias("n_raw"))


@query("""with q as (select l_orderkey, l_linenumber, cast(round_even(l_quantity / 50 * 999, 0) as int) as x, cast(round_even(least(l_partkey / 2000.0, 1) * 999, 0) as int) as y from lineitem)
    select l_orderkey, l_linenumber, '<' || lpad(cast(x as varchar), 3, '0') || '><' || lpad(cast(y as varchar), 3, '0') || '>' as token from q""")
def measure_p18_box_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coordinates in a thousand bins, rounded half to even, as tokens."""
    x = F.rint(F.col("l_quantity") / 50 * 999).cast("int")
    y = F.rint(F.least(F.col("l_partkey") / 2000.0, F.lit(1.0)) * 999).cast("int")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("<"), F.lpad(x.cast("string"), 3, "0"), F.lit("><"), F.lpad(y.cast("string"), 3, "0"), F.lit(">")).alias("token"))


@query("""with q as (select l_orderkey, l_linenumber, cast(round_even(l_quantity / 50 * 999, 0) as int) as x, cast(round_even(least(l_partkey / 2000.0, 1) * 999, 0) as int) as y from lineitem)
    select l_orderkey, l_linenumber, x, y, round(x / 999.0 * 50, 6) as left, round(y / 999.0 * 2000, 6) as top from q""".replace("as left,", 'as "left",').replace("as top", 'as "top"'))
def measure_p18_box_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bins that box tokens name, and the coordinates they stand for."""
    tokens = measure_p18_box_tokens(spark, sf_dir)
    x, y = (F.regexp_extract("token", r"\A<(\d{3,4})><(\d{3,4})>\z", k).cast("int") for k in (1, 2))
    return tokens.select("l_orderkey", "l_linenumber", x.alias("x"), y.alias("y"), F.round(x / 999.0 * 50, 6).alias("left"), F.round(y / 999.0 * 2000, 6).alias("top"))


_CODES = "(select sample_id, reference_model.codepoints as c from samples where reference_model.codepoints is not null qualify row_number() over (partition by sample_id order by updated_at) = 1)"


def _codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "samples").where("reference_model.codepoints is not null").groupBy("sample_id").agg(F.min_by(F.col("reference_model.codepoints"), "updated_at").alias("c"))


@query(f"select sample_id, len(l) as n, len(list_filter(l, lambda x: x = -100)) as n_ignored, l[1] as first, l[len(l)] as last from (select sample_id, list_transform(c, lambda x: case when x < 6144 then -100 else x end) as l from {_CODES})")
def rows_p21_label_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels with ignored tokens masked."""
    masked = _codes(spark, sf_dir).select("sample_id", F.transform("c", lambda x: F.when(x < 6144, -100).otherwise(x)).alias("l"))
    return masked.select("sample_id", F.size("l").cast("long").alias("n"), F.size(F.filter("l", lambda x: x == -100)).cast("long").alias("n_ignored"), F.try_element_at("l", F.lit(1)).alias("first"), F.try_element_at("l", F.lit(-1)).alias("last"))


@query(f"""with p as (select sample_id, list_concat([1, 2, 3], c, [0]) as ids, list_concat([-100, -100, -100], c, [0]) as labels from {_CODES})
    select sample_id, len(ids) as n, list_position(list_transform(labels, lambda x: case when x <> -100 then 1 else 0 end), 1) as first_supervised, len(list_filter(labels, lambda x: x <> -100)) as n_supervised from p""")
def rows_p19_training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompt, target and end of a training row, with the prompt masked; and its inverse, where supervision starts."""
    built = _codes(spark, sf_dir).select("sample_id", F.concat(F.array(*map(F.lit, (1, 2, 3))), "c", F.array(F.lit(0))).alias("ids"), F.concat(F.array(*(F.lit(-100) for _ in range(3))), "c", F.array(F.lit(0))).alias("labels"))
    first = F.array_position(F.transform("labels", lambda x: F.when(x != -100, 1).otherwise(0)), 1)
    return built.select("sample_id", F.size("ids").cast("long").alias("n"), first.cast("long").alias("first_supervised"), F.size(F.filter("labels", lambda x: x != -100)).cast("long").alias("n_supervised"))


@query(f"select sample_id, len(c) as n, md5(array_to_string(c, ',')) as digest, true as contiguous from {_CODES} where len(c) > 0")
def rows_p19_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target of a training row taken out of it again: from the first label that counts to the end token, with no
    masked label between."""
    built = _codes(spark, sf_dir).where(F.size("c") > 0).select("sample_id", F.concat(F.array(*(F.lit(-100) for _ in range(3))), "c", F.array(F.lit(0))).alias("labels"))
    first = F.array_position(F.transform("labels", lambda x: (x != -100).cast("int")), 1).cast("int")
    tail = built.select("sample_id", F.slice("labels", first, F.size("labels") - first + 1).alias("tail"))
    target = F.slice("tail", F.lit(1), F.size("tail") - 1)
    return tail.select("sample_id", F.size(target).cast("long").alias("n"), F.md5(F.array_join(target, ",")).alias("digest"), F.forall("tail", lambda x: x != -100).alias("contiguous"))


@query(f"""with b as (select sample_id, c, (row_number() over (order by sample_id) - 1) // 16 as batch from {_CODES}), m as (select batch, (max(len(c)) + 7) // 8 * 8 as width from b group by batch)
    select sample_id, batch, width - len(c) as n_pad, width from b join m using (batch)""")
def rows_p25_batch_padding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of 16 rows padded to the longest, in multiples of eight."""
    codes = _codes(spark, sf_dir).select("sample_id", F.size("c").alias("n"), F.regexp_extract("sample_id", r"(\d+)", 1).cast("long").alias("o"))
    numbered = S.row_index(codes, "o").select("sample_id", "n", F.floor(F.col("idx") / 16).alias("batch"))
    width = numbered.groupBy("batch").agg((F.floor((F.max("n") + 7) / 8) * 8).alias("width"))
    return numbered.join(width, "batch").select("sample_id", "batch", (F.col("width") - F.col("n")).alias("n_pad"), "width")


@query("select unnest(generate_series(0, 999)) as step".replace("select unnest", """with s as (select unnest""") + """)
    select step, round(case when step < 100 then step / 100.0 when step < 800 then 1.0 else greatest(1 - (step - 800) / 200.0, 0.0) end, 9) as wsd,
    round(case when step < 100 then step / 100.0 else 0.1 + 0.9 * 0.5 * (1 + cos(pi() * (step - 100) / 900.0)) end, 9) as cosine from s""")
def schedule_f33_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Warm-up, stable and decay; and cosine schedules as functions of the step."""
    s = F.col("id")
    wsd = F.when(s < 100, s / 100.0).when(s < 800, 1.0).otherwise(F.greatest(1 - (s - 800) / 200.0, F.lit(0.0)))
    cosine = F.when(s < 100, s / 100.0).otherwise(0.1 + 0.9 * 0.5 * (1 + F.cos(F.lit(math.pi) * (s - 100) / 900.0)))
    return spark.range(1000).select(s.alias("step"), F.round(wsd, 9).alias("wsd"), F.round(cosine, 9).alias("cosine"))


@query("""with r as (select doc_id, coalesce(length(text), 0) as s from documents) select doc_id, case when s < 360000 then lpad(cast(s // 3600 as varchar), 2, '0') || ':' || lpad(cast(s % 3600 // 60 as varchar), 2, '0') || ':' || lpad(cast(s % 60 as varchar), 2, '0') end as eta from r""")
def format_f39_eta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds as hours, minutes and seconds."""
    s = F.length(X.text_of("text")).cast("long")
    part = lambda c: F.lpad(c.cast("string"), 2, "0")
    return table(spark, sf_dir, "documents").select("doc_id", F.concat_ws(":", part(F.floor(s / 3600)), part(F.floor(F.pmod(s, F.lit(3600)) / 60)), part(F.pmod(s, F.lit(60)))).alias("eta"))
