"""One text to many rows, and gates in two phases."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import patterns as P
from ..functions import text as X


class _Filler:
    """Pieces joined by a separator, started anew when the next one would exceed the limit."""

    def __init__(self, limit: int, gap: str, overlap: int = 0):
        self.limit, self.gap, self.overlap = limit, gap, overlap
        self.done: list[str] = []
        self.held: list[str] = []

    @property
    def size(self) -> int:
        return sum(map(len, self.held)) + len(self.gap) * max(len(self.held) - 1, 0)

    def add(self, piece: str, extra: int = 0) -> None:
        if self.held and self.size + len(self.gap) + len(piece) + extra > self.limit:
            self.done.append(self.gap.join(self.held))
            self.held = self.held[-self.overlap :] if self.overlap else []
        self.held.append(piece)

    def close(self) -> list[str]:
        if self.held:
            self.done.append(self.gap.join(self.held))
            self.held = []
        return self.done


def line_parts(line: str, limit: int) -> list[str]:
    """A line in parts of at most `limit` characters, between words where they allow it."""
    if len(line) <= limit:
        return [line]
    parts: list[str] = []
    filler = _Filler(limit, " ")
    for word in line.split(" "):
        if len(word) > limit:
            parts += filler.close()
            filler = _Filler(limit, " ")
            parts += [word[k : k + limit] for k in range(0, len(word), limit)]
        else:
            filler.add(word)
    return parts + filler.close()


def split_text(text: str, limit: int, overlap: int = 0) -> list[str]:
    """A text in chunks of at most `limit` characters (more only by the lines of an overlap): whole paragraphs while
    they fit, else lines, else words, else slices of characters."""
    if limit <= 0 or len(text) <= limit:
        return [text]
    filler = _Filler(limit, "\n\n", overlap)
    for paragraph in [p.strip() for p in re.split(r"\n{2,}", text) if p.strip()] or [text]:
        if len(paragraph) <= limit:
            filler.add(paragraph)
            continue
        lines = _Filler(limit, "\n", overlap)
        for line in [x for x in paragraph.splitlines() if x.strip()] or [paragraph]:
            for part in line_parts(line, limit):
                lines.add(part, 1)
        for piece in lines.close():
            for part in line_parts(piece, limit) if len(piece) > limit else [piece]:
                filler.add(part)
    return [c.strip() for c in filler.close() if c.strip()]


def split_texts(df: DataFrame, max_chars: int, overlap_lines: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(`key`, chunk_index, chunk): the chunks of every text; chunk_index is null where the text is its only chunk.
    Null and empty texts have no chunk."""
    schema = T.StructType([df.schema[key], T.StructField("chunk_index", T.LongType()), T.StructField("chunk", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, index, chunk = [], [], []
            for k, value in enumerate(batch.column(1).to_pylist()):
                parts = split_text(value, max_chars, overlap_lines) if value else []
                rows += [k] * len(parts)
                index += [None] if len(parts) == 1 and len(value) <= max_chars else range(len(parts))
                chunk += parts
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(index, pa.int64()), pa.array(chunk, pa.string())], names=[key, "chunk_index", "chunk"])

    return df.select(key, text).mapInArrow(run, schema)


def word_groups(df: DataFrame, words: str, budget: int) -> DataFrame:
    """Rows of `budget` words each, in order, numbered by `chunk`; rows without words give none."""
    starts = F.sequence(F.lit(0), F.floor((F.size(words) - 1) / budget).cast("int"))
    rest = [c for c in df.columns if c != words]
    numbered = df.where(F.size(words) > 0).select(*rest, words, F.explode(starts).alias("chunk"))
    return numbered.select(*rest, "chunk", F.slice(words, F.col("chunk") * budget + 1, budget).alias("words"))


def general_gate(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), min_chars: int = 40, script: str = "", min_script: float = 0.5, max_repeated: float = 0.4, max_symbols: float = 0.5, word_length: tuple[float, float] = (1.5, 40.0)) -> DataFrame:
    """The columns `keep` and why each text fails the general gate, null if it passes: too_short, script_impurity (only
    with a script), repeated_lines, symbol_spam, word_len, boilerplate, whichever comes first.

    What the reasons compare is measured once, in a step of its own: an array inside a condition would be built anew for
    each comparison.
    """
    t = X.text_of(text)
    measured = df.select(
        *keep, F.length(X.strip(t)).alias("_size"), X.full_lines(t).alias("_lines"), X.count(t, P.JUNK).alias("_junk"), X.count(t, P.TOKEN).alias("_tokens"),
        F.transform(X.long_words(t), F.length).alias("_words"), reduce(lambda a, b: a | b, (F.contains(t, F.lit(s)) for s in P.BOILERPLATE)).alias("_furniture"),
        *([X.script_ratio(t, script).alias("_script")] if script else []),
    )
    lines, words = F.size("_lines"), F.size("_words")
    mean = F.when(words >= 5, F.aggregate("_words", F.lit(0), lambda a, n: a + n) / words)
    figures = measured.select(*keep, "_size", "_furniture", *(["_script"] if script else []), X.ratio(lines - F.size(F.array_distinct("_lines")), lines).alias("_repeated"), X.ratio(F.col("_junk"), F.col("_tokens"), 1.0).alias("_symbols"), mean.alias("_mean"))
    cases = [(F.col("_size") < min_chars, "too_short")]
    if script:
        cases.append((F.col("_script") < min_script, "script_impurity"))
    cases += [(F.col("_repeated") > max_repeated, "repeated_lines"), (F.col("_symbols") > max_symbols, "symbol_spam"), ((F.col("_mean") < word_length[0]) | (F.col("_mean") > word_length[1]), "word_len"), (F.col("_furniture"), "boilerplate")]
    return figures.select(*keep, X.first_reason(*cases).alias("reason"))


def web_gate(df: DataFrame, key: str = "doc_id", text: str = "text", script: str = "zh", min_chars: int = 200, min_script: float = 0.55, max_digits: float = 0.25, max_garble: float = 0.002, min_marks: float = 0.003, max_repeated: float = 0.3, max_top: float = 0.2, max_dup3: float = 0.5, max_dup4: float = 0.42) -> DataFrame:
    """(`key`, clean, reason): the cleaned text and why it fails, null if it passes. What needs n-grams is evaluated in a
    second step, only for rows that passed the first."""
    clean = df.select(key, X.web_normalize(X.text_of(text)).alias("plain"))
    stripped = X.strip_boilerplate_lines(F.col("plain"))
    clean = clean.select(key, F.when(stripped != "", stripped).otherwise(F.col("plain")).alias("clean"))
    t: Column = F.col("clean")
    first = X.first_reason(
        (t == "", "empty"),
        (F.length(t) < min_chars, "too_short"),
        (X.is_spam(t), "spam"),
        (X.garble_ratio(t) > max_garble, "garbled"),
        (X.script_ratio(t, script) < min_script, "low_chinese"),
        (X.digit_ratio(t) > max_digits, "digit_heavy"),
        (X.sentence_mark_ratio(t) < min_marks, "no_sentences"),
        (X.repeated_line_fraction(t) > max_repeated, "repeated_lines"),
    )
    gated = clean.withColumn("first", first)
    held = gated.where("first is null").select(key, X.char_ngrams(t, 2).alias("grams"), F.length(X.squeezed(t)).alias("size"))
    top = held.where("size >= 3").select(key, "size", F.explode("grams").alias("gram")).groupBy(key, "size", "gram").agg(F.count("*").alias("n")).groupBy(key, "size").agg((F.max("n") * 2 / F.col("size")).alias("top"))
    second = X.first_reason(
        (F.col("top") > max_top, "ngram_spam"),
        (X.ngram_repeat_fraction(t, 3) > max_dup3, "repetitive"),
        (X.ngram_repeat_fraction(t, 4) > max_dup4, "repetitive"),
    )
    joined = gated.join(top.select(key, "top"), key, "left")
    return joined.select(key, "clean", F.when(F.col("first").isNotNull(), F.col("first")).otherwise(second).alias("reason"))
