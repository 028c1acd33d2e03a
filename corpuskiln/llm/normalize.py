"""One form for texts that look the same.

Distinct texts are exploded to positioned code points; a broadcast join (a table of some 6,000 rows, built by rule from
the Unicode data and of fixed size) replaces each by its decomposition into look-alike representatives; combining marks
are ordered by class; the text is rebuilt and recomposed. Only distinct texts are exploded, and all their code points
stay in the partition of the text: the one exchange before it moves each distinct text once.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import staged

# Letters of other scripts that print as a Latin letter. Covered are the scripts whose letters do so in plain
# upright type: Cyrillic, Greek, Armenian, Cherokee, Lisu, Coptic, Deseret, and Latin letters of other blocks.
LOOK_ALIKES = {
    # Cyrillic
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h",
    "ԁ": "d", "ԛ": "q", "ԝ": "w", "ѵ": "v", "ӏ": "l", "ә": "ə", "ӕ": "æ", "ԍ": "ɢ",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y",
    "Х": "X", "Ѕ": "S", "І": "I", "Ј": "J", "Ԁ": "D", "Ԛ": "Q", "Ԝ": "W", "Ѵ": "V", "Ӏ": "I", "Ԍ": "G", "Ӕ": "Æ",
    "Ә": "Ə",
    # Greek
    "ο": "o", "ν": "v", "ϳ": "j", "ϲ": "c",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P",
    "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J", "Ϝ": "F",
    # Armenian
    "օ": "o", "ս": "u", "հ": "h", "ո": "n", "ց": "g", "զ": "q", "Օ": "O", "Ս": "U",
    # Cherokee
    "Ꭰ": "D", "Ꭱ": "R", "Ꭲ": "T", "Ꭹ": "Y", "Ꭺ": "A", "Ꭻ": "J", "Ꭼ": "E", "Ꮃ": "W", "Ꮇ": "M", "Ꮋ": "H", "Ꮍ": "Y", "Ꮐ": "G",
    "Ꮓ": "Z", "Ꮟ": "b", "Ꮢ": "R", "Ꮤ": "W", "Ꮥ": "S", "Ꮩ": "V", "Ꮪ": "S", "Ꮮ": "L", "Ꮯ": "C", "Ꮲ": "P", "Ꮶ": "K", "Ᏼ": "B",
    "Ꮒ": "h", "Ᏻ": "G", "Ꮖ": "I",
    # Lisu
    "ꓐ": "B", "ꓑ": "P", "ꓓ": "D", "ꓔ": "T", "ꓖ": "G", "ꓗ": "K", "ꓙ": "J", "ꓚ": "C", "ꓜ": "Z", "ꓝ": "F", "ꓟ": "M", "ꓠ": "N",
    "ꓡ": "L", "ꓢ": "S", "ꓣ": "R", "ꓦ": "V", "ꓧ": "H", "ꓪ": "W", "ꓫ": "X", "ꓬ": "Y", "ꓮ": "A", "ꓰ": "E", "ꓲ": "I", "ꓳ": "O",
    "ꓴ": "U", "ꓱ": "Ǝ", "ꓵ": "Ո",
    # Coptic
    "Ⲃ": "B", "Ⲏ": "H", "Ⲓ": "I", "Ⲕ": "K", "Ⲙ": "M", "Ⲛ": "N", "Ⲟ": "O", "Ⲣ": "P", "Ⲥ": "C", "Ⲧ": "T", "Ⲩ": "Y", "Ⲭ": "X", "Ⲍ": "Z",
    "ⲟ": "o", "ⲣ": "p", "ⲥ": "c", "ⲭ": "x",
    # Deseret
    "𐐄": "O", "𐐬": "o", "𐐕": "C", "𐐽": "c", "𐐛": "L", "𐐠": "S", "𐑈": "s",
    # Latin letters of other blocks, and one shape that Unicode has twice
    "ɡ": "g", "ɑ": "α", "ᴏ": "o", "ᴄ": "c", "ᴠ": "v", "ᴡ": "w", "ᴢ": "z", "ᴜ": "u", "ꜱ": "s", "Ð": "Đ", "Ɖ": "Đ", "ǝ": "ə",
    # Cyrillic and Latin barred o
    "ө": "ɵ", "Ө": "Ɵ",
}
# Mongolian letters that share all their printed forms, and hyphens, apostrophes and middle dots of one shape.
SAME_SHAPE = {"ᠤ": "ᠣ", "ᠦ": "ᠥ", "‐": "-", "‑": "-", "⁃": "-", "﹣": "-", "ʼ": "’", "∙": "·", "⋅": "·"}
# Code points that print nothing, besides the format characters.
PRINT_NOTHING = [*range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0), 0x034F, 0x115F, 0x1160, 0x3164, 0xFFA0, 0x17B4, 0x17B5]
#: Seen, although format characters: the Mongolian vowel separator.
VOWEL_SEPARATOR = "\u180e"
NARROW = "\u202f"
#: Decompositions whose parts do not look like the whole: raised, lowered, circled, squared, stacked or turned.
OTHER_LOOK = ("<super>", "<sub>", "<circle>", "<square>", "<fraction>", "<vertical>")
# Compatibility characters whose own shape differs from that of their decomposition.
OWN_SHAPE = "ſẛϐϑϒϓϔϕϖϰϱϴϵ϶ℵℶℷℸ№℡℻…‥"


def _parts(ch: str) -> str:
    """The full decomposition of a character into representatives of one shape each."""
    given = unicodedata.decomposition(ch)
    if given and ch not in OWN_SHAPE:
        tag, *rest = given.split() if given.startswith("<") else ("", *given.split())
        inner = "".join(chr(int(code, 16)) for code in rest)
        if tag not in OTHER_LOOK and not (tag and inner.startswith(" ") and len(inner) > 1):
            return "".join(map(_parts, inner))
    return SAME_SHAPE.get(ch) or LOOK_ALIKES.get(ch, ch)


def _shape(ch: str) -> str:
    """What stands for a character: nothing, a gap, a line break, or its parts."""
    kind, code = unicodedata.category(ch), ord(ch)
    if ch in "\n\r\x0b\x0c\x85\u2028\u2029":
        return "\r" if ch == "\r" else "\n"
    if ch == NARROW or ch == VOWEL_SEPARATOR:
        return ch
    if kind == "Zs" or ch == "\t":
        return " "
    if kind in ("Cf", "Cc") or code in PRINT_NOTHING:
        return ""
    return _parts(ch)


@cache
def shape_table() -> list[tuple[str, list[tuple[int, str]]]]:
    """Every code point that is not its own shape or has a combining class, with its parts and their classes."""
    skipped = lambda c: 0xD800 <= c < 0xE000 or 0xAC00 <= c < 0xD7A4 or 0x20000 <= c < 0x2F800
    rows = []
    for code in (c for c in range(0xE01F0) if not skipped(c)):
        ch = chr(code)
        if 0x323B0 <= code < 0xE0000 or unicodedata.category(ch) == "Cn":
            continue
        shape = _shape(ch)
        if shape != ch or unicodedata.combining(ch):
            rows.append((ch, [(unicodedata.combining(p), p) for p in shape]))
    return rows


def _mark_class() -> str:
    """A pattern for the characters with a combining class."""
    marks = [c for c in range(0x300, 0x1F000) if unicodedata.combining(chr(c))]
    ranges, first = [], None
    for c, following in zip(marks, [*marks[1:], -1]):
        first = c if first is None else first
        if following != c + 1:
            ranges.append(f"\\x{{{first:x}}}-\\x{{{c:x}}}")
            first = None
    return "".join(ranges)


SHAPES = T.StructType([
    T.StructField("unit", T.StringType()),
    T.StructField("parts", T.ArrayType(T.StructType([T.StructField("ccc", T.IntegerType()), T.StructField("ch", T.StringType())]))),
])


def _recomposed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = pa.array([unicodedata.normalize("NFC", t) for t in batch.column(2).to_pylist()], pa.string())
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], text], names=["h1", "h2", "canonical"])


def _settled(text: Column) -> Column:
    """Gaps and line breaks of a rebuilt text: a narrow no-break space stays only between two Mongolian letters, any
    other run of gaps is one space, white space at the ends of the text and of its lines goes."""
    letter, selectors = r"[\u1820-\u1878\u1880-\u18aa]", r"[\u180b-\u180d\u180f]"
    text = F.regexp_replace(text, r"\r\n?", "\n")
    text = F.regexp_replace(text, rf"(?<!{letter}{selectors}{{0,3}})\u202f|\u202f(?!{letter})", " ")
    text = F.regexp_replace(text, " {2,}", " ")
    text = F.regexp_replace(text, " ?\n ?", "\n")
    return F.regexp_replace(text, r"\A[ \n]+|[ \n]+\z", "")


def text_key(text: Column) -> list[Column]:
    """Two independent 64-bit hashes that stand for a text."""
    return [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit("second"), text).alias("h2")]


def canonical_texts(texts: DataFrame, text: str = "text") -> DataFrame:
    """One row (h1, h2, canonical) for each distinct text: `h1` and `h2` identify the text (`text_key`), `canonical` is
    its one form; texts look the same exactly if their canonical forms are equal.

    Null texts are left out; an empty or blank text has the empty form. Texts of any length are handled whole. Repeated
    texts give one row. Other columns are not read, so their names cannot clash.
    """
    spark = texts.sparkSession
    # by hash, not by text: the exploded code points are then where they are put together again
    rows = texts.select(F.col(text).alias("text")).where(F.col("text").isNotNull())
    distinct = rows.select(*text_key(F.col("text")), "text").groupBy("h1", "h2").agg(F.first("text").alias("text"))
    marked = F.col("text").rlike(r"[\p{M}&&[^\u180b-\u180d\u180f]]")
    # without marks every code point is its own cluster; with marks each keeps the number of the cluster it is in
    plain = F.transform(F.split("text", ""), lambda c, i: F.struct(i.alias("at"), F.lit(0).alias("k"), c.alias("unit")))
    marks = _mark_class()
    clusters = F.regexp_extract_all(F.col("text"), F.lit(f"(?s)[^{marks}][{marks}]*|[{marks}]+"), F.lit(0))
    split = F.flatten(F.transform(clusters, lambda u, i: F.transform(F.split(u, ""), lambda c, k: F.struct(i.alias("at"), k.alias("k"), c.alias("unit")))))
    units = F.when(marked, split).otherwise(plain)
    # one more, empty unit keeps texts that have no other
    units = F.concat(units, F.array(F.struct(F.lit(2**31 - 1).alias("at"), F.lit(0).alias("k"), F.lit("").alias("unit"))))
    exploded = distinct.select("h1", "h2", marked.alias("marked"), F.explode(units).alias("u")).select("h1", "h2", "marked", "u.at", "u.k", "u.unit")
    shapes = F.broadcast(spark.createDataFrame(shape_table(), SHAPES))
    own = F.array(F.struct(F.lit(0).alias("ccc"), F.col("unit").alias("ch")))
    parts = F.coalesce("parts", own)
    joined = exploded.join(shapes, "unit", "left").select(
        "h1", "h2", "at", "k", "marked",
        F.when(~F.col("marked"), F.when(F.col("parts").isNull(), F.col("unit")).otherwise(F.array_join(F.transform("parts", lambda p: p.ch), ""))).alias("s"),
        F.when(F.col("marked"), parts).alias("parts"),
    )
    collected = joined.groupBy("h1", "h2").agg(F.first("marked").alias("marked"), F.collect_list(F.struct("at", "k", "s", "parts")).alias("units"))
    ordered = F.array_sort("units")
    rebuilt = F.array_join(F.transform(ordered, lambda u: u.s), "")
    placed = F.flatten(F.transform(ordered, lambda u: F.transform(u.parts, lambda p, j: F.struct(u["at"], p.ccc, u.k, j.alias("j"), p.ch))))
    sorted_marks = F.array_join(F.transform(F.array_sort(placed), lambda p: p.ch), "")
    whole = collected.select("h1", "h2", F.when(F.col("marked"), sorted_marks).otherwise(rebuilt).alias("text"))
    return whole.select("h1", "h2", _settled(F.col("text")).alias("text")).mapInArrow(_recomposed, "h1 bigint, h2 bigint, canonical string")


def normalize_texts(df: DataFrame, text: str = "text", out: str = "canonical") -> DataFrame:
    """df with the canonical form of its text as column `out` (null for null). Only distinct texts are normalized; the
    forms come back by a join on the text's key, that Spark splits where one text is hot (adaptive skew join)."""
    forms = canonical_texts(df, text).select(F.col("h1").alias("_h1"), F.col("h2").alias("_h2"), F.col("canonical").alias("_form"))
    h1, h2 = text_key(F.col(text))
    joined = df.withColumn("_k1", h1).withColumn("_k2", h2).join(forms, F.expr(f"_k1 = _h1 and _k2 = _h2 and `{text}` is not null"), "left")
    return joined.select(*(F.col(f"`{c}`") for c in df.columns if c != out), F.col("_form").alias(out))


def look_alike_pairs(keyed: DataFrame, key: str = "key", text: str = "text") -> DataFrame:
    """Pairs (text_a, text_b) of keys, smaller first, whose texts look the same but are not the same characters.

    Null and blank texts are left out, also those of which nothing prints. Keys with equal texts are no pair. Pairs are
    formed between distinct texts of one form first, so copies of a text never meet each other; every pair of keys is
    in the result, however many share a form. Rows that repeat count once.
    """
    rows = keyed.select(F.col(key).alias("key"), F.col(text).alias("text")).where(F.col("key").isNotNull() & F.col("text").isNotNull())
    forms = canonical_texts(rows).where("canonical <> ''").select("h1", "h2", F.xxhash64("canonical").alias("c1"), F.xxhash64(F.lit("second"), "canonical").alias("c2"))
    forms = staged(forms)
    shared = forms.groupBy("c1", "c2").agg(F.count("*").alias("n")).where("n > 1").select("c1", "c2")
    a = forms.join(shared, ["c1", "c2"])
    keys = rows.select("key", *text_key(F.col("text"))).distinct()
    held = a.join(keys, ["h1", "h2"])
    left = held.select("c1", "c2", F.struct("h1", "h2").alias("ta"), F.col("key").alias("ka"))
    right = held.select("c1", "c2", F.struct("h1", "h2").alias("tb"), F.col("key").alias("kb"))
    met = left.join(right, ["c1", "c2"]).where("ta <> tb and ka < kb")
    return met.select(F.col("ka").alias("text_a"), F.col("kb").alias("text_b")).distinct()


def look_alike_classes(keyed: DataFrame, key: str = "key", text: str = "text") -> DataFrame:
    """One row for each distinct key with a text that prints something: (key, class_id, n_texts, n_keys). `class_id` is a
    digest of the form, `n_texts` the distinct texts of it, `n_keys` its keys: the same classes as the pairs, without a
    row for each pair. A key with several texts has a row for each of its forms. Null and blank texts are left out."""
    rows = keyed.select(F.col(key).alias("key"), F.col(text).alias("text")).where(F.col("key").isNotNull() & F.col("text").isNotNull())
    forms = staged(canonical_texts(rows).where("canonical <> ''").select("h1", "h2", F.md5("canonical").alias("class_id")))
    held = staged(rows.select("key", *text_key(F.col("text"))).join(forms, ["h1", "h2"]).select("key", "class_id").distinct())
    sizes = forms.groupBy("class_id").agg(F.count("*").alias("n_texts")).join(held.groupBy("class_id").agg(F.count("*").alias("n_keys")), "class_id")
    return held.join(sizes, "class_id").select("key", "class_id", "n_texts", "n_keys")


def transcriptions(spark: SparkSession, reviews: DataFrame, samples: DataFrame) -> DataFrame:
    """(key, text) of all transcriptions: of reviews under `review_id`, of samples under `sample_id`."""
    return reviews.select(F.col("review_id").alias("key"), F.col("reference_raw").alias("text")).unionByName(samples.select(F.col("sample_id").alias("key"), F.col("reference_model.text").alias("text")))
