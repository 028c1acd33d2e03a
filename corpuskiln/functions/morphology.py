"""Facts of Mongolian word structure as Columns: letters, vowel harmony, which suffix may follow which."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Vowels by harmony, and the blocks of the script.
MASCULINE, FEMININE = "ᠠᠣᠤ", "ᠡᠥᠦ"
BLOCKS = ((0x1800, 0x18AF), (0x11660, 0x1167F))
# The kinds of suffix that may stand outside of a kind, and how often a kind may occur.
OUTER = {
    "voice": "voice tense mood aspect converb participle negation derivational",
    "tense": "negation possessive case",
    "mood": "negation possessive",
    "aspect": "tense mood converb participle negation",
    "converb": "possessive negation case",
    "participle": "case plural possessive negation derivational",
    "plural": "case possessive",
    "case": "possessive",
    "possessive": "case",
    "negation": "case possessive tense",
    "particle": "",
    "derivational": "voice tense mood aspect converb participle plural case possessive negation derivational",
}
AT_MOST = {"plural": 1, "case": 2, "possessive": 2}


def alphabet(spark: SparkSession) -> DataFrame:
    """(code, letter, name) of the letters of the script, by the Unicode data: some two hundred rows."""
    codes = (c for low, high in BLOCKS for c in range(low, high + 1))
    rows = [(c, chr(c), n) for c in codes if "MONGOLIAN" in (n := unicodedata.name(chr(c), "")) and unicodedata.category(chr(c)).startswith("L")]
    return spark.createDataFrame(rows, "code int, letter string, name string")


def harmony(word: Column) -> Column:
    """The harmony of the vowels of a word: masculine, feminine, mixed, or neutral if it has neither."""
    m, f = word.rlike(f"[{MASCULINE}]"), word.rlike(f"[{FEMININE}]")
    return F.when(m & f, "mixed").when(m, "masculine").when(f, "feminine").otherwise("neutral")


def harmonizes(stem: Column, suffix: Column, declared: Column) -> Column:
    """Whether a suffix goes with a stem, by their harmonies and by what the suffix declares (none, neutral, all_variants, or
    the harmony that it wants)."""
    free = declared.isin("none", "neutral") | stem.isin("neutral", "mixed") | suffix.isin("neutral", "mixed")
    return free | F.when(declared == "all_variants", stem == suffix).otherwise(stem == declared)


def stacks(inner: Column, outer: Column) -> Column:
    """Whether a suffix of the kind `outer` may follow one of the kind `inner`; unknown kinds may not."""
    allowed = F.create_map(*(x for kind, others in OUTER.items() for x in (F.lit(kind), F.array(*map(F.lit, others.split())).cast("array<string>"))))
    return F.coalesce(F.array_contains(F.try_element_at(allowed, inner), outer), F.lit(False))


def sane(kinds: Column) -> Column:
    """Whether no kind occurs too often in a sequence of suffixes."""
    result = F.lit(True)
    for kind, most in AT_MOST.items():
        result = result & (F.size(kinds) - F.size(F.array_remove(kinds, kind)) <= most)
    return result
