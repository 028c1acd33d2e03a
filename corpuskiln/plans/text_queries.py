"""Queries on texts: projections, measures, gates and their accounting; and the SQL they must agree with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import morphology as M
from ..functions import patterns as P
from ..functions import text as X
from ..operators import chunks
from ..session import read_table, spread, staged

T = "coalesce(text, '')"


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(read_table(spark, sf_dir, "documents"))


def _sql_strip(x: str) -> str:
    return rf"regexp_replace({x}, '\A[{P.SPACE}]+|[{P.SPACE}]+\z', '', 'g')"


def _sql_collapse(x: str) -> str:
    return _sql_strip(f"regexp_replace({x}, '[{P.SPACE}]+', ' ', 'g')")


def _sql_count(pattern: str, x: str = T) -> str:
    return f"len(regexp_extract_all({x}, '{pattern}'))"


def _sql_ratio(top: str, bottom: str, empty: str = "0.0") -> str:
    return f"case when ({bottom}) > 0 then cast({top} as double) / ({bottom}) else {empty} end"


SQL_FULL_LINES = f"list_filter(list_transform(string_split({T}, chr(10)), lambda x: {_sql_strip('x')}), lambda x: x <> '')"
SQL_PRINTED = _sql_count(f"[^{P.SPACE}]")
SQL_REPEATED = f"case when len({SQL_FULL_LINES}) > 0 then cast(len({SQL_FULL_LINES}) - len(list_distinct({SQL_FULL_LINES})) as double) / len({SQL_FULL_LINES}) else 0.0 end"
SQL_SYMBOLS = _sql_ratio(_sql_count(P.JUNK), _sql_count(P.TOKEN), "1.0")
SQL_WORDS = f"list_filter(regexp_extract_all({T}, '{P.WORD}'), lambda w: not regexp_matches(w, '[{P.WORDLESS}]') and regexp_matches(w, '\\p{{L}}'))"
SQL_MEAN_WORD = f"case when len({SQL_WORDS}) >= 5 then cast(list_sum(list_transform({SQL_WORDS}, lambda w: length(w))) as double) / len({SQL_WORDS}) end"
SQL_REASON = f"""case when length({_sql_strip(T)}) < 40 then 'too_short'
    when {SQL_REPEATED} > 0.4 then 'repeated_lines' when {SQL_SYMBOLS} > 0.5 then 'symbol_spam'
    when {SQL_MEAN_WORD} < 1.5 or {SQL_MEAN_WORD} > 40 then 'word_len'
    when {" or ".join(f"contains({T}, '{b}')" for b in P.BOILERPLATE)} then 'boilerplate' end"""


def _digest(name: str, make):
    """A query of the length and digest of a rewritten text."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        new = docs(spark, sf_dir).select("doc_id", make(X.text_of("text")).alias("new"))
        return new.select("doc_id", F.length("new").cast("long").alias("n_chars"), F.md5("new").alias("digest"))

    query.__name__ = name
    return query


def _sql_digest(expression: str) -> str:
    return f"select doc_id, length(new) as n_chars, md5(new) as digest from (select doc_id, {expression} as new from documents)"


def _value(name: str, make, places: int = 6):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return docs(spark, sf_dir).select("doc_id", F.round(make(X.text_of("text")).cast("double"), places).alias("value"))

    query.__name__ = name
    return query


def _sql_value(expression: str) -> str:
    return f"select doc_id, round(cast({expression} as double), 6) as value from documents"


def _count_value(name: str, make):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return docs(spark, sf_dir).select("doc_id", make(X.text_of("text")).cast("long").alias("value"))

    query.__name__ = name
    return query


QUERIES = {}
SQL = {}

# projections, 1 row to 1 row
_lines = f"string_split({T}, chr(10))"
for name, make, sql in (
    ("text_p1_source_clean", X.source_clean, "case when lower(c) in ('none', 'null', 'nan', 'n/a') then '' else c end"),
    ("text_p2_web_normalize", X.web_normalize, None),
    ("text_p3_boilerplate_lines", X.strip_boilerplate_lines,
     _sql_strip(rf"regexp_replace(array_to_string(list_filter({_lines}, lambda x: not ({_sql_strip('x')} <> '' and regexp_matches(x, '{P.WEB_LINE}'))), chr(10)), '\n{{3,}}', chr(10) || chr(10), 'g')")),
    ("text_p4_url_lines", X.strip_url_lines,
     _sql_strip(rf"array_to_string(list_filter({_lines}, lambda x: not ({_sql_strip('x')} <> '' and not contains({_sql_strip('x')}, ' ') and regexp_matches(lower({_sql_strip('x')}), '\A(?:https?://|www\.)'))), chr(10))")),
    ("text_p5_script_lines", lambda t: X.keep_script_lines(t, "mongolian"),
     _sql_strip(f"array_to_string(list_filter({_lines}, lambda x: {_sql_strip('x')} = '' or regexp_matches(x, '[{P.SCRIPTS['mongolian']}]')), chr(10))")),
    ("text_p8_mongolian_normalize", X.mongolian_normalize, None),
    ("text_p9_collapse", X.collapse, _sql_collapse(T)),
    ("text_p10_strip_controls", X.strip_controls, rf"regexp_replace({T}, '[\x{{180b}}-\x{{180f}}\x{{200b}}-\x{{200d}}\x{{2060}}\x{{feff}}]', '', 'g')"),
    ("text_p11_nominal_fold", X.nominal_fold,
     rf"replace(regexp_replace({T}, '[\x{{180b}}-\x{{180d}}\x{{180f}}\x{{200b}}-\x{{200d}}\x{{2060}}\x{{feff}}]', '', 'g'), chr(8239), chr(6158))"),
    ("text_p12_native_spaces", X.native_spaces, None),
    ("text_p13_layout", X.layout_spaces, None),
):
    QUERIES[name] = _digest(name, make)
    if sql:
        SQL[name] = _sql_digest(sql)
_COMPOSED = f"nfc_normalize(replace({T}, chr(65279), ''))"
_BARE = _sql_strip(rf"replace(regexp_replace({_COMPOSED}, '[\x00-\x08\x0b-\x1f\x7f-\x{{9f}}\p{{Cf}}\p{{Co}}]', ' ', 'g'), chr(10), ' ')")
SQL["text_p1_source_clean"] = SQL["text_p1_source_clean"].replace("from documents", f"from (select doc_id, {_BARE} as c from documents)")


def text_p16_graphemes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grapheme clusters of each text, and those of more than one character."""
    found = docs(spark, sf_dir).select("doc_id", X.graphemes(X.text_of("text")).alias("g"))
    return found.select("doc_id", F.size("g").cast("long").alias("n"), F.size(F.filter("g", lambda x: F.length(x) > 1)).cast("long").alias("n_marked"))


def text_p14_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts in chunks of at most 400 characters, by paragraphs, lines, words and characters."""
    return chunks.split_texts(docs(spark, sf_dir), max_chars=400)


def text_p15_word_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words in groups of a budget of 50."""
    words = docs(spark, sf_dir).select("doc_id", X.found(X.text_of("text"), P.WORD).alias("w"))
    return chunks.word_groups(words, "w", 50).select("doc_id", F.col("chunk").cast("long").alias("chunk"), F.size("words").cast("long").alias("n_words"), F.md5(F.array_join("words", " ")).alias("digest"))


def source_p27_identity_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identity keys: the kind and the digest of the JSON string of the value."""
    from ..functions import hashing as H

    rows = read_table(spark, sf_dir, "sources").where("source_document_id is not null")
    return rows.select("sample_id", H.identity_key("document", F.col("source_document_id")).alias("identity")).distinct()


QUERIES |= {"text_p16_graphemes": text_p16_graphemes, "text_p14_chunks": text_p14_chunks, "text_p15_word_budget": text_p15_word_budget, "source_p27_identity_keys": source_p27_identity_keys}
SQL |= {
    "text_p16_graphemes": f"""select doc_id, len(g) as n, len(list_filter(g, lambda x: length(x) > 1)) as n_marked
        from (select doc_id, regexp_extract_all({T}, '{P.GRAPHEME}') as g from documents)""",
    "text_p15_word_budget": f"""with w as (select doc_id, regexp_extract_all({T}, '{P.WORD}') as w from documents),
        c as (select doc_id, w, unnest(generate_series(0, (len(w) - 1) // 50)) as chunk from w where len(w) > 0)
        select doc_id, chunk, len(w[chunk * 50 + 1 : chunk * 50 + 50]) as n_words, md5(array_to_string(w[chunk * 50 + 1 : chunk * 50 + 50], ' ')) as digest from c""",
    "source_p27_identity_keys": r"""select distinct sample_id, 'document:' || sha256('"' || replace(replace(replace(source_document_id, '\', '\\'), '"', '\"'), chr(9), '\t') || '"') as identity
        from sources where source_document_id is not null""",
}

# measures
for name, make, sql in (
    ("measure_f1_script_ratio", lambda t: X.script_ratio(t, "mongolian"), _sql_ratio(_sql_count(f"[{P.SCRIPTS['mongolian']}]"), SQL_PRINTED)),
    ("measure_f1_script_ratio_latin", lambda t: X.script_ratio(t, "latin"), _sql_ratio(_sql_count(f"[{P.SCRIPTS['latin']}]"), SQL_PRINTED)),
    ("measure_f2_repeated_lines", X.repeated_line_fraction, SQL_REPEATED),
    ("measure_f3_symbol_ratio", X.symbol_to_word_ratio, SQL_SYMBOLS),
    ("measure_f5_mean_word_length", X.mean_word_length, SQL_MEAN_WORD),
    ("measure_f6_chinese_ratio", lambda t: X.script_ratio(t, "zh"), _sql_ratio(_sql_count(f"[{P.SCRIPTS['zh']}]"), SQL_PRINTED)),
    ("measure_f7_digit_ratio", X.digit_ratio, _sql_ratio(_sql_count(r"\p{Nd}"), SQL_PRINTED)),
    ("measure_f8_garble_ratio", X.garble_ratio, _sql_ratio(_sql_count(r"[\x{fffd}\x{e000}-\x{f8ff}]"), SQL_PRINTED)),
    ("measure_f11_sentence_marks", X.sentence_mark_ratio, _sql_ratio(_sql_count("[。！？!?…]"), _sql_count(f"[{P.SCRIPTS['zh']}]"))),
):
    QUERIES[name] = _value(name, make)
    SQL[name] = _sql_value(sql)
for name, make, sql in (
    ("measure_f4_tokens", lambda t: X.count(t, P.TOKEN), _sql_count(P.TOKEN)),
    ("measure_f12_script_counts", lambda t: X.count(t, f"[{P.SCRIPTS['mongolian']}]"), _sql_count(f"[{P.SCRIPTS['mongolian']}]")),
    ("measure_f12_printed", X.printed, SQL_PRINTED),
    ("measure_f28_token_proxy", lambda t: F.greatest(X.count(t, P.WORD), F.floor(F.length(t) / 4), F.lit(1)), f"greatest({_sql_count(P.WORD)}, length({T}) // 4, 1)"),
):
    QUERIES[name] = _count_value(name, make)
    SQL[name] = f"select doc_id, cast({sql} as bigint) as value from documents"


def measure_f9_ngram_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of character 3-grams and 4-grams that repeat an earlier one."""
    t = X.text_of("text")
    return docs(spark, sf_dir).select("doc_id", *(F.round(X.ngram_repeat_fraction(t, n), 6).alias(f"dup{n}") for n in (3, 4)))


def measure_f10_top_ngram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the text that the most frequent character 2-gram covers: pre-aggregated counts by document and gram."""
    t = X.text_of("text")
    base = docs(spark, sf_dir).select("doc_id", F.length(X.squeezed(t)).alias("size"), X.char_ngrams(t, 2).alias("grams"))
    top = base.where("size >= 3").select("doc_id", "size", F.explode("grams").alias("gram")).groupBy("doc_id", "size", "gram").agg(F.count("*").alias("n")).groupBy("doc_id", "size").agg(F.max("n").alias("n"))
    return base.select("doc_id").join(top, "doc_id", "left").select("doc_id", F.round(F.coalesce(F.col("n") * 2 / F.col("size"), F.lit(0.0)), 6).alias("value"))


def measure_f37_invalid_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with a null character or a replacement character."""
    return docs(spark, sf_dir).where(X.text_of("text").rlike(r"[\x00\x{fffd}]")).select("doc_id")


def measure_f22_script_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters of each text by script: Mongolian, CJK, Latin and the rest."""
    t = X.text_of("text")
    mn, cjk, latin = (X.count(t, f"[{P.SCRIPTS[s]}]") for s in ("mn", "cjk", "latin"))
    return docs(spark, sf_dir).select("doc_id", mn.cast("long").alias("mn"), cjk.cast("long").alias("cjk"), latin.cast("long").alias("latin"), (F.length(t) - mn - cjk - latin).cast("long").alias("other"))


def measure_f23_symbol_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digits, punctuation and Mongolian controls of each text."""
    t = X.text_of("text")
    classes = {"digit": r"\p{Nd}", "punctuation": r"\p{P}", "fvs": r"[\x{180b}-\x{180d}\x{180f}]", "mvs": r"\x{180e}", "nnbsp": r"\x{202f}"}
    return docs(spark, sf_dir).select("doc_id", *(X.count(t, p).cast("long").alias(n) for n, p in classes.items()))


QUERIES |= {f.__name__: f for f in (measure_f9_ngram_repeats, measure_f10_top_ngram, measure_f37_invalid_text, measure_f22_script_shares, measure_f23_symbol_classes)}
_SQUEEZED = f"regexp_replace({T}, '[{P.SPACE}]+', '', 'g')"
_GRAMS = "list_transform(generate_series(1, length(s) - {n} + 1), lambda i: substr(s, i, {n}))"
SQL |= {
    "measure_f9_ngram_repeats": f"""with s as (select doc_id, {_SQUEEZED} as s from documents),
        g as (select doc_id, length(s) as size, case when length(s) >= 4 then {_GRAMS.format(n=3)} end as g3, case when length(s) >= 5 then {_GRAMS.format(n=4)} end as g4 from s)
        select doc_id, round(coalesce(1 - cast(len(list_distinct(g3)) as double) / len(g3), 0.0), 6) as dup3, round(coalesce(1 - cast(len(list_distinct(g4)) as double) / len(g4), 0.0), 6) as dup4 from g""",
    "measure_f10_top_ngram": f"""with s as (select doc_id, {_SQUEEZED} as s from documents),
        g as (select doc_id, length(s) as size, unnest({_GRAMS.format(n=2)}) as gram from s where length(s) >= 3),
        c as (select doc_id, size, gram, count(*) as n from g group by all), t as (select doc_id, size, max(n) as n from c group by all)
        select d.doc_id, round(coalesce(n * 2 / cast(size as double), 0.0), 6) as value from documents d left join t using (doc_id)""",
    "measure_f37_invalid_text": rf"select doc_id from documents where contains({T}, chr(65533)) or regexp_matches({T}, '\x00')",
    "measure_f22_script_shares": f"""select doc_id, mn, cjk, latin, length({T}) - mn - cjk - latin as other from (select doc_id, text,
        {_sql_count(f"[{P.SCRIPTS['mn']}]")} as mn, {_sql_count(f"[{P.SCRIPTS['cjk']}]")} as cjk, {_sql_count(f"[{P.SCRIPTS['latin']}]")} as latin from documents)""",
    "measure_f23_symbol_classes": "select doc_id, " + ", ".join(f"{_sql_count(p)} as {n}" for n, p in (("digit", r"\p{Nd}"), ("punctuation", r"\p{P}"), ("fvs", r"[\x{180b}-\x{180d}\x{180f}]"), ("mvs", r"\x{180e}"), ("nnbsp", r"\x{202f}"))) + " from documents",
}


# gates and their accounting


def gate_g1_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by language and first failing reason of the general gate."""
    return chunks.general_gate(docs(spark, sf_dir), keep=("lang",)).select("lang", F.coalesce("reason", F.lit("kept")).alias("reason")).groupBy("lang", "reason").agg(F.count("*").alias("n"))


def gate_g3_mongolian_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", X.mongolian_reason(X.text_of("text")).alias("reason"))


def gate_g2_web_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gate of web texts, on normalized text without boilerplate lines: cheap reasons first, the counting of n-grams
    only for what is left."""
    return chunks.web_gate(docs(spark, sf_dir)).select("doc_id", "reason")


def gate_g4_spam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", X.is_spam(X.text_of("text")).alias("spam"))


def gate_g5_min_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are long enough for their source, after its cleaning."""
    sources = read_table(spark, sf_dir, "mix_sources").select("source", F.coalesce("min_chars", F.lit(1)).alias("min_chars"), F.coalesce("strip_url_lines", F.lit(False)).alias("strip"))
    joined = docs(spark, sf_dir).join(sources, "source")
    clean = F.when(F.col("strip"), X.strip_url_lines(X.text_of("text"))).otherwise(X.strip(X.text_of("text")))
    return joined.where(F.length(clean) >= F.greatest("min_chars", F.lit(1))).select("doc_id", F.length(clean).cast("long").alias("n_chars"))


def gate_g6_byte_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that are not empty and of at most 600 bytes."""
    return docs(spark, sf_dir).where("text <> '' and octet_length(text) <= 600").select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"))


def measure_f31_harmony(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mongolian words of the documents by the harmony of their vowels."""
    words = docs(spark, sf_dir).select(F.explode(X.found(X.text_of("text"), f"[{P.SCRIPTS['mongolian']}]+")).alias("w"))
    return words.groupBy(M.harmony(F.col("w")).alias("harmony")).agg(F.count("*").alias("n"), F.countDistinct("w").alias("words"))


def gate_g7_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row with its band: ids from 97 % of the largest on are test, from 94 % on validation, the rest training."""
    rows = docs(spark, sf_dir).select("doc_id")
    high = rows.agg(F.max("doc_id")).first()[0] or 0
    return rows.select("doc_id", X.band(F.col("doc_id"), high * 94 // 100, high * 97 // 100).alias("band"))


def a1_quality_dedup_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gate, then exact deduplication among the survivors, then accounting by language."""
    rows = staged(chunks.general_gate(docs(spark, sf_dir).withColumn("key", X.exact_key(X.text_of("text"))), keep=("doc_id", "lang", "key")))
    first = rows.where("reason is null").groupBy("key").agg(F.min("doc_id").alias("first"))
    joined = rows.join(first, "key", "left")
    final = F.coalesce("reason", F.when(F.col("doc_id") != F.col("first"), "duplicate"))
    sums = [F.count_if(F.col("final") == r).alias(f"drop_{r}") for r in ("too_short", "repeated_lines", "symbol_spam", "word_len", "boilerplate", "duplicate")]
    return joined.withColumn("final", final).groupBy("lang").agg(F.count("*").alias("total"), F.count_if(F.col("final").isNull()).alias("kept"), *sums)


def a2_character_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records, kept records, kept characters and kept Mongolian characters of each source."""
    t = X.text_of("text")
    counted = docs(spark, sf_dir).withColumns({"n": F.length(t), "m": X.count(t, f"[{P.SCRIPTS['mongolian']}]")})
    rows = chunks.general_gate(counted, keep=("source", "n", "m"))
    kept = F.col("reason").isNull()
    return rows.groupBy("source").agg(F.count("*").alias("input_records"), F.count_if(kept).alias("kept_records"), F.sum(F.when(kept, F.col("n")).otherwise(0)).cast("long").alias("kept_chars"), F.sum(F.when(kept, F.col("m")).otherwise(0)).cast("long").alias("kept_mongolian"))


QUERIES |= {f.__name__: f for f in (gate_g1_reasons, gate_g2_web_reasons, gate_g3_mongolian_reasons, gate_g4_spam, gate_g5_min_length, gate_g6_byte_length, gate_g7_bands, measure_f31_harmony, a1_quality_dedup_report, a2_character_accounting)}
_URLLESS = _sql_strip(rf"array_to_string(list_filter({_lines}, lambda x: not ({_sql_strip('x')} <> '' and not contains({_sql_strip('x')}, ' ') and regexp_matches(lower({_sql_strip('x')}), '\A(?:https?://|www\.)'))), chr(10))")
SQL |= {
    "gate_g1_reasons": f"select lang, coalesce({SQL_REASON}, 'kept') as reason, count(*) as n from documents group by all",
    "gate_g3_mongolian_reasons": rf"""select doc_id, case when length({_sql_strip(T)}) < 40 then 'too_short'
        when regexp_matches({T}, '[\x{{e000}}-\x{{f8ff}}]') then 'pua' when regexp_matches({T}, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]') then 'control'
        when {SQL_PRINTED} = 0 then 'empty' when {_sql_ratio(_sql_count(f"[{P.SCRIPTS['mongolian']}]"), SQL_PRINTED)} < 0.5 then 'script_impurity'
        when cast({_sql_count('[A-Za-z]')} as double) / {SQL_PRINTED} > 0.2 then 'latin_noise'
        when {_sql_count(r'[\x{400}-\x{4ff}]')} > 0 then 'cyrillic_noise' when {SQL_SYMBOLS} > 0.5 then 'symbol_spam' when {SQL_REPEATED} > 0.4 then 'repeated_lines' end as reason from documents""",
    "gate_g4_spam": f"select doc_id, regexp_matches({T}, '{P.SPAM_GAMBLING}') or (regexp_matches({T}, '{P.SPAM_CONTACT}') and regexp_matches({T}, '{P.SPAM_OFFER}')) as spam from documents",
    "gate_g5_min_length": f"""select doc_id, length(clean) as n_chars from (select doc_id, coalesce(min_chars, 1) as min_chars,
        case when coalesce(strip_url_lines, false) then {_URLLESS} else {_sql_strip(T)} end as clean from documents join mix_sources using (source)) where length(clean) >= greatest(min_chars, 1)""",
    "measure_f31_harmony": f"""with w as (select unnest(regexp_extract_all({T}, '[{P.SCRIPTS['mongolian']}]+')) as w from documents) select case when regexp_matches(w, '[{M.MASCULINE}]') and regexp_matches(w, '[{M.FEMININE}]') then 'mixed'
        when regexp_matches(w, '[{M.MASCULINE}]') then 'masculine' when regexp_matches(w, '[{M.FEMININE}]') then 'feminine' else 'neutral' end as harmony, count(*) as n, count(distinct w) as words from w group by 1""",
    "gate_g6_byte_length": "select doc_id, strlen(text) as n_bytes from documents where text <> '' and strlen(text) <= 600",
    "gate_g7_bands": "with h as (select max(doc_id) as high from documents) select doc_id, case when doc_id >= high * 97 // 100 then 'test' when doc_id >= high * 94 // 100 then 'val' else 'train' end as band from documents, h",
    "a1_quality_dedup_report": f"""with r as (select doc_id, lang, {SQL_REASON} as reason, sha1({_sql_collapse(T)}) as key from documents),
        f as (select *, case when reason is null and doc_id <> min(doc_id) filter (reason is null) over (partition by key) then 'duplicate' else reason end as final from r)
        select lang, count(*) as total, count(*) filter (final is null) as kept, {", ".join(f"count(*) filter (final = '{x}') as drop_{x}" for x in ("too_short", "repeated_lines", "symbol_spam", "word_len", "boilerplate", "duplicate"))} from f group by lang""",
    "a2_character_accounting": f"""select source, count(*) as input_records, count(*) filter (reason is null) as kept_records, cast(sum(case when reason is null then n else 0 end) as bigint) as kept_chars,
        cast(sum(case when reason is null then m else 0 end) as bigint) as kept_mongolian from (select source, {SQL_REASON} as reason, length({T}) as n, {_sql_count(f"[{P.SCRIPTS['mongolian']}]")} as m from documents) group by source""",
}
