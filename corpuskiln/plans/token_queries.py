"""Queries on vocabularies and two-track tokens; and the SQL they must agree with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as X
from ..operators import tokens
from ..session import read_table as table
from ..session import spread, staged
from .text_queries import T

QUERIES: dict = {}
SQL: dict[str, str] = {}
#: Occurrences of a word that is in the vocabulary.
LEAST = 5


def query(sql: str | None = None):
    def keep(function):
        QUERIES[function.__name__] = function
        if sql:
            SQL[function.__name__] = sql
        return function

    return keep


_SEGMENT_SQL = rf"[{P.SCRIPTS['mongolian']}]+(?:\x{{202f}}[{P.SCRIPTS['mongolian']}]+)*|[^{P.SPACE}\p{{P}}\p{{S}}{P.SCRIPTS['mongolian']}]+|(?s:.)"
_WORDS_SQL = f"""w as (select doc_id, unnest(regexp_extract_all({T}, '{_SEGMENT_SQL}')) as word, unnest(generate_series(1, len(regexp_extract_all({T}, '{_SEGMENT_SQL}')))) as i from documents),
    c as (select word, count(*) as n, case when regexp_matches(word, '{tokens.MONGOLIAN}') then 'mn' else 'general' end as track from w where regexp_matches(word, '[\\p{{L}}\\p{{N}}]') group by word having count(*) >= {LEAST}),
    v as (select word, case when track = 'mn' then 256 else 24576 end + row_number() over (partition by track order by n desc, encode(word)) - 1 as id from c)"""


def word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(word, n) of the words of the documents that occur five times at least; counted once, though ranks read them twice."""
    words = spread(table(spark, sf_dir, "documents").select("text")).select(F.explode(X.found(X.text_of("text"), tokens.SEGMENT)).alias("word")).where(F.col("word").rlike(r"[\p{L}\p{N}]"))
    return staged(words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST))


def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of the documents that occur five times at least, with ids as SQL counts them: past the end of a segment
    they go on."""
    return tokens.running_vocabulary(word_counts(spark, sf_dir), LEAST).select("word", "id")


def coding_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same words with an id of their own each, so that what is encoded can be decoded."""
    return tokens.running_vocabulary(word_counts(spark, sf_dir), LEAST).select("word", F.col("token").alias("id"))


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text").repartition("doc_id")
    return tokens.encode_spans(documents, "doc_id", "text", staged(vocabulary(spark, sf_dir)))


def _counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(piece, n, track, ids) of the distinct segments of the documents; counted once, for words and ids."""
    pieces = spread(table(spark, sf_dir, "documents").select("text")).select(F.explode(X.found(X.text_of("text"), tokens.SEGMENT)).alias("piece"))
    counts = staged(pieces.groupBy("piece").agg(F.count("*").alias("n")))
    words = counts.where(F.col("piece").rlike(r"[\p{L}\p{N}]")).withColumnRenamed("piece", "word")
    return tokens.encode_counted(counts, tokens.running_vocabulary(words, LEAST))


@query(f"with {_WORDS_SQL} select word, id from v")
def token_t8_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vocabulary in segments: Mongolian words from 256, others from 24,576, the most frequent first. Past the end of a
    segment ids go on."""
    return vocabulary(spark, sf_dir)


@query(f"""with {_WORDS_SQL}, p as (select doc_id, i, word, sum(length(word)) over (partition by doc_id order by i) as e from w)
    select doc_id, cast(i - 1 as int) as "at", case when regexp_matches(p.word, '{tokens.MONGOLIAN}') then 'mn' else 'general' end as track, cast(e - length(p.word) as bigint) as start, cast(e as bigint) as "end",
    v.id as id, case when v.id is null then strlen(p.word) else 1 end as n_tokens from p left join v on p.word = v.word""")
def token_t4_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of every document by track, with their place, the id of their word and their number of tokens."""
    word = (F.size("ids") == 1) & (F.element_at("ids", 1) >= 256)
    return _spans(spark, sf_dir).select("doc_id", "at", "track", "start", "end", F.when(word, F.element_at("ids", 1)).alias("id"), F.size("ids").cast("long").alias("n_tokens"))


@query(f"select doc_id, md5({T}) as digest, true as same from documents")
def token_t5_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded, decoded and compared."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    words = staged(coding_vocabulary(spark, sf_dir))
    back = tokens.decode_ids(tokens.encode_ids(documents, "doc_id", "text", words), "doc_id", "ids", words).withColumnRenamed("text", "back")
    joined = documents.join(back, "doc_id", "left")
    again = F.coalesce("back", F.lit(""))
    return joined.select("doc_id", F.md5(again).alias("digest"), (again == X.text_of("text")).alias("same"))


@query("select count(*) as n, cast(0 as bigint) as n_failed, 1.0 as rate from documents")
def token_a13_round_trip_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents come back from their ids."""
    tripped = tokens.round_trips(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text", staged(coding_vocabulary(spark, sf_dir)))
    return tripped.agg(F.count("*").alias("n"), F.count_if(~F.col("same")).alias("n_failed"), F.round(F.avg(F.col("same").cast("double")), 6).alias("rate"))


_HITS_SQL = f"""{_WORDS_SQL}, h as (select case when regexp_matches(w.word, '{tokens.MONGOLIAN}') then 'mn' else 'general' end as track, v.id is not null as hit, case when v.id is null then strlen(w.word) else 1 end as n from w left join v on w.word = v.word where trim(w.word, ' ') <> '')"""


@query(f"""with {_HITS_SQL} select track, count(*) as n_pieces, count(*) filter (hit) as word_hits, cast(sum(n) as bigint) as n_tokens, cast(sum(case when hit then 0 else n end) as bigint) as byte_tokens,
    round(count(*) filter (hit) / cast(count(*) as double), 6) as hit_rate, round(sum(case when hit then 0 else n end) / cast(sum(n) as double), 6) as byte_rate from h group by track""")
def token_a11_hit_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that are tokens, and tokens that are bytes, by track."""
    return tokens.hit_report(_counted(spark, sf_dir), "n")


@query(f"""with {_WORDS_SQL}, t as (select distinct reference_model.text as t from samples where reference_model.text is not null), x as (select unnest(regexp_extract_all(t, '{_SEGMENT_SQL}')) as word from t),
    k as (select word, count(*) as n from x group by word), j as (select v.word, v.id, coalesce(k.n, 0) as hits from v left join k on v.word = k.word)
    select case when id < 24576 then 'mn' else 'general' end as track, count(*) as vocabulary, count(*) filter (hits = 0) as zero_hits, count(*) filter (hits < 5) as rare, round(count(*) filter (hits = 0) / cast(count(*) as double), 6) as zero_share,
    count(*) filter (hits = 0) / cast(count(*) as double) <= 0.5 as passes from j group by 1""")
def token_a12_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the vocabulary that the transcriptions never or hardly use, by track, and whether few enough are unused:
    the coverage gate."""
    texts = table(spark, sf_dir, "samples").select(F.col("reference_model.text").alias("t")).where("t is not null").distinct()
    hits = texts.select(F.explode(X.found(F.col("t"), tokens.SEGMENT)).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    joined = vocabulary(spark, sf_dir).join(hits, "word", "left").select(F.when(F.col("id") < 24_576, "mn").otherwise("general").alias("track"), F.coalesce("n", F.lit(0)).alias("hits"))
    zero, n = F.count_if(F.col("hits") == 0), F.count("*")
    return joined.groupBy("track").agg(n.alias("vocabulary"), zero.alias("zero_hits"), F.count_if(F.col("hits") < 5).alias("rare"), F.round(zero / n, 6).alias("zero_share"), (zero / n <= 0.5).alias("passes"))


@query(f"""with {_HITS_SQL}, b as (select count(*) as pieces, cast(sum(n) as bigint) as tokens from h), z as (select cast(sum(length({T})) as bigint) as chars, cast(sum(strlen({T})) as bigint) as bytes from documents)
    select tokens, chars, bytes, round(tokens / cast(chars as double), 6) as per_char, round(tokens / cast(bytes as double), 6) as per_byte from b, z""")
def token_a16_baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens that print something, against characters and bytes as tokens."""
    n = F.col("n")
    held = _counted(spark, sf_dir).agg(F.sum(F.when(F.trim("piece") != "", n * F.size("ids")).otherwise(0)).alias("tokens"), F.sum(n * F.length("piece")).alias("chars"), F.sum(n * F.octet_length("piece")).alias("bytes"))
    return held.select("tokens", "chars", "bytes", F.round(F.col("tokens") / F.col("chars"), 6).alias("per_char"), F.round(F.col("tokens") / F.col("bytes"), 6).alias("per_byte"))


@query(f"""with b as (select doc_id, regexp_extract_all(hex(encode({T})), '..') as h from documents) select doc_id, len(h) as n_bytes, md5(array_to_string(list_transform(h, lambda x: '<0x' || x || '>'), '')) as digest from b""")
def token_t9_byte_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The byte tokens of every document."""
    written = table(spark, sf_dir, "documents").select("doc_id", tokens.byte_tokens(X.text_of("text")).alias("b"))
    return written.select("doc_id", F.size("b").cast("long").alias("n_bytes"), F.md5(F.array_join("b", "")).alias("digest"))


@query(f"select doc_id, {T} as text from documents")
def token_t10_stream_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents cut into chunks of seven bytes, whatever they cut, and decoded as a stream."""
    raw = F.hex(F.encode(X.text_of("text"), "UTF-8"))
    chunks = table(spark, sf_dir, "documents").select("doc_id", F.transform(F.regexp_extract_all(raw, F.lit(".{1,14}"), F.lit(0)), lambda h: F.unhex(h)).alias("chunks"))
    return tokens.stream_decode(chunks, "doc_id", "chunks").select("doc_id", F.array_join("pieces", "").alias("text"))


@query("""with r as (select sample_id, reference_model.codepoints as c from samples where reference_model.codepoints is not null qualify row_number() over (partition by sample_id order by updated_at) = 1), e as (select sample_id, unnest(c) as id from r),
    t as (select distinct id, case when id between 6144 and 6319 then 'mn' when id = 8239 then 'mn' when id < 128 then 'ascii' else 'other' end as track from e) select sample_id, track, count(*) as n from e join t using (id) group by all""")
def join_j11_token_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every row by the track that a table has for them. The table has a row for each id that occurs, at most as
    many as there are code points."""
    samples = table(spark, sf_dir, "samples").where("reference_model.codepoints is not null")
    rows = samples.groupBy("sample_id").agg(F.min_by(F.col("reference_model.codepoints"), "updated_at").alias("c")).select("sample_id", F.explode("c").alias("id"))
    known = samples.select(F.explode("reference_model.codepoints").alias("id")).distinct()
    track = F.when(F.col("id").between(6144, 6319) | (F.col("id") == 8239), "mn").when(F.col("id") < 128, "ascii").otherwise("other")
    return rows.join(F.broadcast(known.select("id", track.alias("track"))), "id").groupBy("sample_id", "track").agg(F.count("*").alias("n"))


#: An id beyond the vocabulary that ends a completion.
END = 70_000


@query(f"select doc_id, {T} as text from documents")
def token_t15_completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as completions: ids, an end and ids behind it that count for nothing."""
    words = staged(coding_vocabulary(spark, sf_dir))
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    ids = documents.select("doc_id").join(tokens.encode_ids(documents, "doc_id", "text", words), "doc_id", "left")
    completed = ids.select("doc_id", F.concat(F.coalesce("ids", F.array().cast("array<bigint>")), F.array(F.lit(END), F.lit(300), F.lit(END)).cast("array<bigint>")).alias("ids"))
    return tokens.decode_ids(completed, "doc_id", "ids", words, eos=END)


@query(f"select doc_id, strlen({T}) as n_bytes, md5({T}) as digest from documents")
def token_t16_byte_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The byte targets of training rows: a masked prompt, the ids of a document, and an end."""
    words = staged(coding_vocabulary(spark, sf_dir))
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    ids = documents.select("doc_id").join(tokens.encode_ids(documents, "doc_id", "text", words), "doc_id", "left")
    prompt, end = F.array(F.lit(-100), F.lit(-100)).cast("array<bigint>"), F.array(F.lit(END)).cast("array<bigint>")
    rows = ids.select("doc_id", F.concat(prompt, F.coalesce("ids", F.array().cast("array<bigint>")), end).alias("labels"))
    return tokens.byte_targets(rows, "doc_id", "labels", words, end=END).select("doc_id", F.octet_length("bytes").cast("long").alias("n_bytes"), F.md5("bytes").alias("digest"))
