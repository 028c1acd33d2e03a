"""Per-document text quality, and whether a text is natural prose.

A text is read as lines. Three detectors set lines apart as rows or entries before anything is called prose:

- vertical alignment: the same delimiter divides many lines into equally many cells or stands in the same columns of them
  (rows), or the same kind of mark stands at the right edge of most of them, as page numbers or separators do (entries);
- indentation: what stands before the first letter of a line, white space, bullets or numbers, is as wide again and again
  at the same distance (entries);
- line lengths: lines in which hardly a sentence ends, and whose lengths are alike or return periodically by their
  autocorrelation (entries); wrapped prose has lines of alike length too, but sentences that end in them.

What is left is running text, cut into sentences. The prose share is the share of all printed characters that lie in
distinct sentences which read like language: ended, and of several words; of an entry more words are asked. A text is prose
if that is at least half and its characters are in order: less than three in ten of its words are broken by symbols, and
its punctuation marks do not stand before letters or after gaps as if they were strewn, unless its words are common ones.
Common words are those of the corpus itself, by document frequency in each script. No word list and no language is built
in. One pass counts the words, one narrow pass over Arrow batches measures the texts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import spread

# Sentence ends, and what may follow or surround words.
ENDS = ".!?。！？᠃…．"
CLOSERS = "\"'”’»」』）)] \t\r\n"
EDGE = ".,;:!?\"'()“”‘’«»「」『』…-–—。，、！？；：（）᠂᠃*•"
SENTENCE = re.compile(r"[^.!?。！？᠃…．]+[.!?。！？᠃…．]+[\"'”’»」』）)\]]*|[^.!?。！？᠃…．]+\Z")
WORD = re.compile(r"[^\W\d_]+(?:[\u180b-\u180e\u0300-\u036f\-'’‑]*[^\W\d_]+)*")
CLEAN = re.compile(r"[^\W\d_]+(?:[\u180b-\u180e\u0300-\u036f\u200b-\u200d\u2060\ufeff\u00ad\-'’‑]+[^\W\d_]+|[\u180b-\u180e\u0300-\u036f])*\Z|\d+(?:[.,:/-]\d+)*\Z")
HAN = re.compile(r"[㐀-鿿豈-﫿]")
HAN_NOISE = re.compile(r"[$@%&#~`|\\/^_=*<>+·!1lI]")
SYMBOL = re.compile(r"[^\w\s.,;:!?'\"()\-–—。，、！？；：（）“”‘’«»「」『』…᠀-\u180f\u0300-\u036f\u200b-\u200f\u202f\u2060\ufeff\u00ad‐‑]")
MARKER = re.compile(r"\s*(?:[-*•·▪■□●○◦‣–—>+]|\[[ xX✓]?\]|\[\d+\]|\(?\d{1,4}[.)、:]|\(\d+\)|№\s*\d+|\(?[a-zA-Zа-я][.)]|[IVXLCDM]+[.)])\s+(?=\S)")
LEADER = re.compile(r"(?:\.{3,}|…+|\s·{3,})\s*\d+\s*$")
PAGES = re.compile(r"(?:,\s*\d{1,5}){1,}\s*$")
REFERENCE = re.compile(r"\s*(?:\[\d+\]\s*)?(?:https?://|www\.)\S+\s*\Z")
RULE = re.compile(r"[\s+\-|=_:*]{5,}$")
# Marks that end or divide sentences, and those of them that are out of place: after a gap, or before a letter.
MARKS = re.compile(r"[.,!?᠂᠃]")
MISPLACED = re.compile(r"(?:(?<=\s)[.,᠂᠃]|[.,!?᠂᠃](?=[^\W\d_]))")
LETTER = re.compile(r"[^\W\d_]")
# What divides the cells of a row, and in how many places at least.
DELIMITERS = ((re.compile(r"\t"), 1), (re.compile(r"</t[dh]>"), 1), (re.compile(r"\|"), 2), (re.compile(r" \| "), 1), (re.compile(r";(?! )"), 2), (re.compile(r",(?! )"), 2), (re.compile(r"(?: {2,}|\u3000+)(?=\S)"), 1), (re.compile(r"\S=\S*"), 2))
#: Characters that a cell has at most, on average, where the delimiter is one that prose has too.
CELL = 60
#: Of each script so many words, the most frequent by documents, are common, if in at least a twentieth of the documents of
#: the first of them.
COMMON_WORDS, COMMON_SHARE = 150, 0.05
# Scripts by their names in the Unicode standard; other scripts together are one more.
SCRIPTS = ("Latin", "Cyrillic", "Mongolian", "Han", "Greek", "Arabic", "Hebrew", "Devanagari", "Bengali", "Thai", "Tibetan", "Hangul", "Hiragana", "Katakana", "Armenian", "Georgian", "Ethiopic", "Tamil", "Telugu", "Khmer")

#: How many of them no prose has.
STRONG = 4
ENDING = re.compile(r"[^\s\d.][.!?。！？᠃…．]+[\"'”’»」』）)\]]*(?:\s|$)|[。！？᠃]")

FIELDS = [
    ("n_chars", T.LongType()), ("n_lines", T.LongType()), ("word_count", T.LongType()), ("mean_word_length", T.DoubleType()),
    ("symbol_ratio", T.DoubleType()), ("end_punctuation", T.DoubleType()), ("common_words", T.DoubleType()),
    ("delimiter_alignment", T.DoubleType()), ("indent_periodicity", T.DoubleType()), ("length_autocorrelation", T.DoubleType()), ("misplaced_marks", T.DoubleType()),
    ("table_share", T.DoubleType()), ("list_share", T.DoubleType()), ("repeated_share", T.DoubleType()), ("prose_share", T.DoubleType()),
    ("kind", T.StringType()), ("is_prose", T.BooleanType()),
]


def autocorrelation(series: list[int]) -> float:
    """The highest autocorrelation of a series over all lags up to half of its length, less what chance gives the highest
    of so many lags; 1 for a constant series, 0 for a short one."""
    n = len(series)
    if n < 4:
        return 0.0
    x = np.asarray(series, float)
    x -= x.mean()
    power = float(x @ x)
    if power <= 1e-9:
        return 1.0
    spectrum = np.fft.rfft(x, 1 << (2 * n - 1).bit_length())
    lags = np.fft.irfft(spectrum * spectrum.conj())[1 : n // 2 + 1] / power
    return max(float(lags.max()) - float(np.sqrt(2 * np.log(len(lags) + 1) / n)), 0.0)


def alike(lengths: list[int]) -> float:
    """1 less the coefficient of variation of line lengths, the autocorrelation at any lag if that is more."""
    x = np.asarray(lengths, float)
    return max(1 - float(x.std() / x.mean()), autocorrelation(lengths)) if len(lengths) > 3 else 0.0


def printed(text: str) -> int:
    return len("".join(text.split()))


def table_rows(lines: list[str]) -> tuple[set[int], float]:
    """Which lines are rows of cells, and the largest share of lines that one delimiter divides alike."""
    rows, aligned, n = set(), 0.0, len(lines)
    for k, line in enumerate(lines):
        if "</td>" in line or "</tr>" in line or RULE.match(line):
            rows.add(k)
    if n < 2:
        return rows, aligned
    whole = "\n".join(lines)
    for kind, (pattern, least) in enumerate(DELIMITERS):
        if not pattern.search(whole):
            continue
        counts = [len(pattern.findall(line.strip())) for line in lines]
        fits = lambda k, cells: kind < STRONG or len(lines[k]) <= CELL * (cells + 1)  # noqa: B023, E731
        for cells, held in Counter(c for c in counts if c >= least).items():
            if held < 2 or held < 0.25 * n or (held == 2 and (cells < 2 or n > 4)):
                continue
            same = [k for k, c in enumerate(counts) if c == cells and fits(k, cells)]
            if len(same) >= 2:
                rows.update(same)
                aligned = max(aligned, len(same) / n)
        # the same columns: a row may lack cells if its delimiters stand where those of other rows do
        places = [{m.end() for m in pattern.finditer(line) if line[: m.start()].strip()} for line in lines]
        columns = {at for at, held in Counter(at for p in places if len(p) >= least for at in p).items() if held >= 3 and held >= 0.4 * n}
        if columns:
            same = [k for k, p in enumerate(places) if p & columns and fits(k, counts[k])]
            if len(same) >= 3 and len(same) >= 0.4 * n:
                rows.update(same)
                aligned = max(aligned, len(same) / n)
    return rows, aligned


def indented_entries(lines: list[str]) -> tuple[set[int], float]:
    """Lines before whose first letter the same width stands again and again at the same distance, and their share."""
    widths: dict[int, list[int]] = {}
    for k, line in enumerate(lines):
        found = LETTER.search(line)
        if found and found.start():
            widths.setdefault(found.start(), []).append(k)
    entries: set[int] = set()
    for held in widths.values():
        if len(held) >= 3:
            gaps = Counter(b - a for a, b in zip(held, held[1:]))
            if max(gaps.values()) >= 0.4 * (len(held) - 1):
                entries.update(held)
    return entries, len(entries) / max(len(lines), 1)


def edge_entries(lines: list[str], bare: list[str], open_: list[int], chars: int) -> set[int]:
    """Lines that end alike as no sentence does: in page numbers, or in one separator."""
    n, entries = len(lines), {k for k in open_ if LEADER.search(lines[k])}
    pages = [k for k in open_ if PAGES.search(lines[k])]
    if len(pages) >= max(3, 0.5 * n):
        entries.update(pages)
    separated = [k for k in range(n) if bare[k] and bare[k][-1] in ",;,，；、᠂"]
    if n >= 4 and len(separated) >= 0.6 * n and chars / n < 80:
        entries.update(open_)
    return entries


def even_entries(lines: list[str], open_: list[int]) -> tuple[set[int], float]:
    """Lines in which hardly a sentence ends, if their lengths are alike or return; and how much they are or do."""
    rhythm = alike([len(lines[k]) for k in open_])
    if len(open_) < 4:
        return set(), rhythm
    ends = sum(bool(ENDING.search(lines[k])) for k in open_)
    return (set(open_) if ends <= 0.1 * len(open_) and rhythm >= 0.3 else set()), rhythm


def reads_like_language(sentence: str, entry: bool) -> bool:
    """Whether a sentence is ended and has enough words. In a list entry more is asked."""
    bare = sentence.rstrip(CLOSERS)
    if not bare or bare[-1] not in ENDS:
        return False
    words = WORD.findall(sentence)
    han = len(HAN.findall(sentence)) if words and not bare.isascii() else 0
    if han >= 4 and han >= len(words):
        return han >= (8 if entry else 5) and not (entry and bare[-1] == ".")
    if entry:
        return len(words) >= (8 if words and words[0].isascii() else 5)
    return len(words) >= 4


@lru_cache(maxsize=200_000)
def is_broken(token: str) -> bool:
    """Whether symbols or digits break a word, or it is all symbols; dashes and bullets alone are not broken."""
    bare = token.strip(EDGE)
    return not CLEAN.match(bare) if bare else token not in ("-", "–", "—", "*", "•")


def broken_share(text: str, tokens: list[str], chars: int) -> float:
    """The share of words that symbols or digits break, of Chinese text the share of such characters."""
    han = len(HAN.findall(text)) if not text.isascii() else 0
    if han > 0.25 * chars:
        return len(HAN_NOISE.findall(text)) / chars * 2
    return sum(map(is_broken, tokens)) / max(len(tokens), 1)


def measure(text: str | None, common: frozenset[str] = frozenset()) -> tuple:
    """The values of FIELDS for one text; of null, empty and blank texts all figures are 0 and kind and is_prose null.
    `common` are the common words of the corpus; without any, words count for nothing."""
    chars = printed(text) if text else 0
    if not chars:
        return (len(text or ""), 0, 0, *[0.0] * 12, None, None)
    lines = [line for line in text.split("\n") if line.strip()]
    n = len(lines)
    bare = [line.rstrip(CLOSERS) for line in lines]
    ended = [bool(b) and b[-1] in ENDS for b in bare]
    rows, aligned = table_rows(lines)
    open_ = [k for k in range(n) if k not in rows]
    indented, period = indented_entries(lines)
    marked = (indented | edge_entries(lines, bare, open_, chars)) - rows
    even, rhythm = even_entries(lines, [k for k in open_ if k not in marked])
    marked |= even
    held = sum(printed(lines[k]) for k in rows)
    listed = sum(printed(lines[k]) for k in marked)

    pieces: list[tuple[str, bool]] = []
    run: list[str] = []
    for k, line in enumerate(lines):
        if k in rows:
            continue
        if k in marked:
            if run:
                pieces.append(("\n".join(run), False))
                run = []
            marker = MARKER.match(line)
            pieces.append((line[marker.end() :] if marker else line, True))
        else:
            run.append(line)
    if run:
        pieces.append(("\n".join(run), False))
    good = repeated = 0
    seen: set[str] = set()
    for piece, entry in pieces:
        for sentence in SENTENCE.findall(piece):
            key = "".join(sentence.split())
            if len(key) < 4:
                continue
            if key in seen:
                repeated += len(key)
                continue
            seen.add(key)
            if reads_like_language(sentence, entry):
                good += len(key)
    words = WORD.findall(text)
    known = sum(map(common.__contains__, map(str.lower, words))) if common else 0
    if common and not text.isascii() and (han := HAN.findall(text)):
        # a run of such characters is many words
        runs = sum(bool(HAN.match(w)) for w in words)
        known, n_words = known + sum(c in common for c in han), len(words) - runs + len(han)
    else:
        n_words = len(words)
    common_share = known / n_words if n_words else 0.0
    tokens = text.split()
    broken = broken_share(text, tokens, chars)
    marks = len(MARKS.findall(text))
    strewn = len(MISPLACED.findall(text)) / marks if marks else 0.0
    # a heading and bare references around running sentences do not count against them
    beside = sum(printed(line) for line in lines if REFERENCE.match(line))
    if n > 1 and not ended[0] and len(lines[0]) <= max(map(len, lines[1:])) and "\n\n" in text.lstrip()[: len(lines[0]) + 2]:
        beside += printed(lines[0])
    share = good / max(chars - beside, good) if good else 0.0
    prose = share >= 0.5 and broken < 0.3 and (strewn < 0.4 or common_share >= 0.3)
    kind = "prose" if prose else "table" if held >= 0.4 * chars else "list" if listed >= 0.4 * chars else "junk"
    return (
        len(text), n, len(words), sum(map(len, words)) / len(words) if words else 0.0, len(SYMBOL.findall(text)) / chars,
        sum(ended) / n, common_share, aligned, period, rhythm, strewn,
        held / chars, listed / chars, repeated / chars, share, kind, prose,
    )


def common_words(df: DataFrame, text: str = "text", most: int = COMMON_WORDS) -> frozenset[str]:
    """The common words of a corpus: of each script the `most` words that are in most documents, if in at least
    COMMON_SHARE as many as the first. All documents count; at most `most` words a script come to the driver."""
    word = r"\p{IsHan}|[\p{L}\p{Mn}&&[^\p{IsHan}]][\p{L}\p{Mn}\x{180b}-\x{180e}'’\x{2010}\x{2011}\-&&[^\p{IsHan}]]*"
    words = spread(df.select(text)).select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(word), F.lit(0)))).alias("w"))
    counted = words.groupBy("w").agg(F.count("*").alias("n")).where("n > 1")
    script = F.lit("other")
    for name in reversed(SCRIPTS):
        script = F.when(F.col("w").rlike(rf"^\p{{Is{name}}}"), name).otherwise(script)
    ranked = counted.withColumn("s", script).withColumn("r", F.row_number().over(Window.partitionBy("s").orderBy(F.desc("n"), "w"))).where(F.col("r") <= most)
    first = F.max("n").over(Window.partitionBy("s"))
    return frozenset(r["w"] for r in ranked.withColumn("top", first).where(F.col("n") >= COMMON_SHARE * F.col("top")).select("w").collect())


def quality_statistics(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), common: frozenset[str] | None = None) -> DataFrame:
    """The columns `keep` and the statistics FIELDS of each row's text: word count, mean word length, symbols and broken
    characters per printed character, share of lines that end a sentence, share of common words, alignment of
    delimiters, periodicity of indentation and line lengths, share of punctuation marks out of place, shares of table rows,
    list entries, repeated sentences and prose sentences, the kind of the text (prose, list, table, junk) and whether it is
    natural prose. `common` are the common words; without it they are those of the texts themselves.

    Null, empty and blank texts have figures of 0 and a null kind. Very long texts are measured whole. Repeated rows are
    measured each, an empty table gives an empty table, columns not in `keep` are not read.
    """
    schema = T.StructType([*(df.schema[c] for c in keep), *(T.StructField(name, kind) for name, kind in FIELDS)])
    known = df.sparkSession.sparkContext.broadcast(common_words(df, text) if common is None else common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                columns = zip(*(measure(t, known.value) for t in batch.column(batch.num_columns - 1).to_pylist()))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(c, t) for c, t in zip(columns, ARROW))], names=[*keep, *(name for name, _ in FIELDS)])

    return spread(df).select(*keep, text).mapInArrow(run, schema)


ARROW = [{T.LongType: pa.int64(), T.DoubleType: pa.float64(), T.StringType: pa.string(), T.BooleanType: pa.bool_()}[type(kind)] for _, kind in FIELDS]


def no_prose(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The keys of the texts that are mostly no natural prose; null, empty and blank texts are none of them."""
    return quality_statistics(df, text, (key,)).where("is_prose = false").select(key)
