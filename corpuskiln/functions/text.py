"""Text functions as Columns: whole-stage JVM expressions, no Python. Null texts count as empty."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import patterns as P


def text_of(name: str | Column) -> Column:
    return F.coalesce(F.col(name) if isinstance(name, str) else name, F.lit(""))


def count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def found(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def ratio(top: Column, bottom: Column, empty: float = 0.0) -> Column:
    return F.when(bottom > 0, top / bottom).otherwise(empty)


def strip(text: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(text, rf"\A[{P.SPACE}]+|[{P.SPACE}]+\z", "")


def collapse(text: Column) -> Column:
    """Stripped, runs of white space as one space: the form in which copies are equal."""
    return strip(F.regexp_replace(text, f"[{P.SPACE}]+", " "))


def lines(text: Column) -> Column:
    return F.split(text, "\n")


def full_lines(text: Column) -> Column:
    """Stripped lines that are not empty."""
    return F.filter(F.transform(lines(text), strip), lambda x: x != "")


def printed(text: Column) -> Column:
    """Number of characters that are no white space."""
    return count(text, f"[^{P.SPACE}]")


def exact_key(text: Column) -> Column:
    return F.sha1(collapse(text))


# one row to one row


def unicode_form(text: Column, form: str) -> Column:
    """A Unicode normalization form; the JVM side of Spark has none, so this one crosses to Arrow."""

    @F.arrow_udf(T.StringType())
    def normalized(values: pa.Array) -> pa.Array:
        return pa.array([None if t is None else unicodedata.normalize(form, t) for t in values.to_pylist()], pa.string())

    return normalized(text)


def source_clean(text: Column) -> Column:
    """Composed, on one line, without control characters; literal nulls become empty."""
    composed = unicode_form(F.translate(text, "\ufeff", ""), "NFC")
    plain = strip(F.translate(F.regexp_replace(composed, r"[\x00-\x08\x0b-\x1f\x7f-\x{9f}\p{Cf}\p{Co}\p{Cn}]", " "), "\n", " "))
    return F.when(F.lower(plain).isin("none", "null", "nan", "n/a"), "").otherwise(plain)


def web_normalize(text: Column) -> Column:
    """Compatibility-composed, without invisible and control characters, one space in a gap, one blank line at most."""
    t = F.regexp_replace(unicode_form(text, "NFKC"), P.ZERO_WIDTH, "")
    t = F.regexp_replace(F.regexp_replace(t, r"\r\n?", "\n"), P.CONTROLS, "")
    t = F.array_join(F.transform(lines(t), lambda x: strip(F.regexp_replace(x, f"[{P.INLINE}]+", " "))), "\n")
    return strip(F.regexp_replace(t, r"\n{3,}", "\n\n"))


def strip_boilerplate_lines(text: Column) -> Column:
    kept = F.filter(lines(text), lambda x: ~((strip(x) != "") & x.rlike(P.WEB_LINE)))
    return strip(F.regexp_replace(F.array_join(kept, "\n"), r"\n{3,}", "\n\n"))


def strip_url_lines(text: Column) -> Column:
    bare = lambda x: (strip(x) != "") & (F.instr(strip(x), " ") == 0) & F.lower(strip(x)).rlike(r"\A(?:https?://|www\.)")
    return strip(F.array_join(F.filter(lines(text), lambda x: ~bare(x)), "\n"))


def keep_script_lines(text: Column, script: str) -> Column:
    return strip(F.array_join(F.filter(lines(text), lambda x: (strip(x) == "") | x.rlike(f"[{P.SCRIPTS[script]}]")), "\n"))


def mongolian_line(line: Column) -> Column:
    """A line of Mongolian without controls, addresses, page marks and long decoration."""
    word = r"[\p{L}\p{N}_"
    t = F.regexp_replace(line, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]|[\x{e000}-\x{f8ff}]", "")
    t = F.regexp_replace(t, rf"(?i)https?://[^{P.SPACE}]+|www\.[^{P.SPACE}]+", " ")
    t = F.regexp_replace(t, rf"(?<!{word}]){word}.+-]*{word}]{word}.+-]*@{word}.-]+\.[A-Za-z]{{2,}}(?!{word}])", " ")
    t = F.regexp_replace(t, r"[\t\r\x0c\x0b\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+", " ")
    t = F.regexp_replace(t, rf"(?i)\A[ \t]*(?:\|+[ \t]*)?{P.PAGE}[ \t]*", "")
    t = F.regexp_replace(t, rf"(?i)(?:\A|[ \t]|\|){P.PAGE}(?=[ \t]|\z)", " ")
    t = F.regexp_replace(t, r"([★☆*#=_\-—–·•|])\1{2,}", "$1")
    return strip(F.regexp_replace(t, " {2,}", " "))


def mongolian_line_kept(line: Column) -> Column:
    known = reduce(lambda a, b: a | b, (F.contains(line, F.lit(s)) for s in P.MONGOLIAN_SNIPPETS))
    thin = (count(line, f"[{P.SCRIPTS['mongolian']}]") < 4) & (F.length(line) < 40)
    return (line != "") & ~known & ~line.rlike(rf"\A{P.DECORATION}\z") & ~line.rlike(rf"\A{P.HEADINGS}\z") & ~thin


def mongolian_normalize(text: Column) -> Column:
    """Cleaned lines that are worth keeping; a run of dropped lines leaves one blank line between kept ones."""
    clean = F.transform(lines(F.regexp_replace(text, r"\r\n?", "\n")), mongolian_line)
    marked = F.array_join(F.transform(clean, lambda x: F.when(mongolian_line_kept(x), x).otherwise("")), "\n")
    return F.regexp_replace(F.regexp_replace(marked, r"\A\n+|\n+\z", ""), r"\n{2,}", "\n\n")


def strip_controls(text: Column) -> Column:
    return F.translate(text, P.VARIATION_SELECTORS + P.VOWEL_SEPARATOR + P.ZERO_WIDTH_NOISE, "")


def nominal_fold(text: Column) -> Column:
    """Without variation selectors and zero-width characters, the narrow space as vowel separator."""
    return F.translate(text, P.NARROW_SPACE + P.VARIATION_SELECTORS + P.ZERO_WIDTH_NOISE, P.VOWEL_SEPARATOR)


def native_spaces(text: Column) -> Column:
    """No-break spaces as spaces, but for narrow ones between two Mongolian characters."""
    inside = f"[{P.SCRIPTS['mongolian']}]"
    return F.regexp_replace(text, rf"(?<!{inside})\x{{202f}}|\x{{202f}}(?!{inside})|\x{{a0}}", " ")


def layout_spaces(text: Column) -> Column:
    """White space as it is laid out: runs of it as one space, narrow no-break spaces kept, the vowel separator shown as a
    narrow no-break space."""
    return strip(F.regexp_replace(F.translate(text, P.VOWEL_SEPARATOR, P.NARROW_SPACE), rf"[{P.SPACE}&&[^\x{{202f}}]]+", " "))


def band(number: Column, val_min: int, test_min: int) -> Column:
    """The band of a row by its number: test from `test_min` on, validation from `val_min` on, else training."""
    return F.when(number >= test_min, "test").when(number >= val_min, "val").otherwise("train")


def graphemes(text: Column) -> Column:
    """Clusters of a character and the marks and variation selectors behind it."""
    return found(text, P.GRAPHEME)


# measures


def script_ratio(text: Column, script: str) -> Column:
    return ratio(count(text, f"[{P.SCRIPTS[script]}]"), printed(text))


def repeated_line_fraction(text: Column) -> Column:
    held = full_lines(text)
    return ratio(F.size(held) - F.size(F.array_distinct(held)), F.size(held))


def symbol_to_word_ratio(text: Column) -> Column:
    return ratio(count(text, P.JUNK), count(text, P.TOKEN), 1.0)


def long_words(text: Column) -> Column:
    """Words by white space that have a letter and no character of a wordless script."""
    return F.filter(found(text, P.WORD), lambda w: ~w.rlike(f"[{P.WORDLESS}]") & w.rlike(r"\p{L}"))


def mean_word_length(text: Column) -> Column:
    """Null where there are fewer than five words to measure."""
    held = long_words(text)
    return F.when(F.size(held) >= 5, F.aggregate(held, F.lit(0), lambda a, w: a + F.length(w)) / F.size(held))


def digit_ratio(text: Column) -> Column:
    return ratio(count(text, r"\p{Nd}"), printed(text))


def garble_ratio(text: Column) -> Column:
    return ratio(count(text, r"[\x{fffd}\x{e000}-\x{f8ff}]"), printed(text))


def sentence_mark_ratio(text: Column) -> Column:
    return ratio(count(text, "[。！？!?…]"), count(text, f"[{P.SCRIPTS['zh']}]"))


def squeezed(text: Column) -> Column:
    return F.regexp_replace(text, f"[{P.SPACE}]+", "")


def char_ngrams(text: Column, n: int) -> Column:
    """All overlapping n-grams of the text without white space, by zipping its characters with their successors: linear
    in the length of the text."""
    chars = F.split(squeezed(text), "")
    grams = chars
    for k in range(1, n):
        grams = F.zip_with(grams, F.slice(chars, F.lit(k + 1), F.size(chars)), lambda a, b: F.concat(a, b))
    return F.array_compact(grams)


def ngram_repeat_fraction(text: Column, n: int) -> Column:
    grams = char_ngrams(text, n)
    return F.when(F.length(squeezed(text)) >= n + 1, 1 - F.size(F.array_distinct(grams)) / F.size(grams)).otherwise(0.0)


def is_spam(text: Column) -> Column:
    return text.rlike(P.SPAM_GAMBLING) | (text.rlike(P.SPAM_CONTACT) & text.rlike(P.SPAM_OFFER))


def first_reason(*cases: tuple[Column, str]) -> Column:
    """The reason of the first case that holds, null if none does; later cases are not evaluated."""
    result = F.when(cases[0][0], cases[0][1])
    for condition, reason in cases[1:]:
        result = result.when(condition, reason)
    return result


def mongolian_reason(text: Column, min_chars: int = 40, min_script: float = 0.5, max_symbols: float = 0.5, max_repeated: float = 0.4, max_latin: float = 0.2, max_cyrillic: float = 0.0) -> Column:
    size = printed(text)
    return first_reason(
        (F.length(strip(text)) < min_chars, "too_short"),
        (text.rlike(r"[\x{e000}-\x{f8ff}]"), "pua"),
        (text.rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"), "control"),
        (size == 0, "empty"),
        (script_ratio(text, "mongolian") < min_script, "script_impurity"),
        (count(text, "[A-Za-z]") / size > max_latin, "latin_noise"),
        (count(text, r"[\x{400}-\x{4ff}]") / size > max_cyrillic, "cyrillic_noise"),
        (symbol_to_word_ratio(text) > max_symbols, "symbol_spam"),
        (repeated_line_fraction(text) > max_repeated, "repeated_lines"),
    )
