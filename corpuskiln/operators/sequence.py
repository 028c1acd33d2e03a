"""Order-based operators: running totals, numbering, windows over tokens, schedules, packing.

Totals over a whole table do not pass through one task: rows fall into blocks of their integer order key, blocks are
summed first, the few block totals are accumulated, and only rows of one block meet in a window.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import repeat

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1 << 14


def block_width(df: DataFrame, order: str, rows: int = BLOCK) -> int:
    """How many keys a block spans so that it has about `rows` rows: ids with gaps, or hashes, span more of them."""
    found = df.agg(F.min(order).alias("low"), F.max(order).alias("high"), F.count(order).alias("n")).first()
    if not found["n"]:
        return rows
    return max(rows, (int(found["high"]) - int(found["low"]) + 1) * rows // found["n"])


def prefix_sum(df: DataFrame, order: str, value: Column, out: str, by: tuple[str, ...] = (), block: int | None = None) -> DataFrame:
    """df with the sum of `value` over all rows before each, in the order of the unique integer column `order`. Blocks span
    so many keys that they hold about BLOCK rows if keys are spread evenly, as dense ids and hashes are."""
    width = block or block_width(df, order)
    # doubles are monotonic in the key, so blocks are ranges of keys even where they round
    keyed = df.withColumn("_value", value).withColumn("_block", F.floor(F.col(order).cast("double") / float(width)))
    keys = [*by, "_block"]
    over_blocks = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = keyed.groupBy(*keys).agg(F.sum("_value").alias("_sum")).withColumn("_start", F.coalesce(F.sum("_sum").over(over_blocks), F.lit(0)))
    starts = starts.select(*(F.col(k).alias(f"_at_{i}") for i, k in enumerate(keys)), "_start")
    condition = F.lit(True)
    for i, name in enumerate(keys):
        condition = condition & F.col(name).eqNullSafe(F.col(f"_at_{i}"))
    inside = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    joined = keyed.join(starts, condition)
    return joined.withColumn(out, (F.col("_start") + F.coalesce(F.sum("_value").over(inside), F.lit(0))).cast("long")).select(*df.columns, out)


def row_index(df: DataFrame, order: str, out: str = "idx", by: tuple[str, ...] = ()) -> DataFrame:
    """df with the number of rows before each."""
    return prefix_sum(df, order, F.lit(1), out, by)


def digest_rank(df: DataFrame, by: list[str], digest: Column, tie: str, out: str = "pos") -> DataFrame:
    """df with the place of each row of its group in the order of a hexadecimal digest, ties by `tie`. Rows of one range of
    digests are ranked together, and the ranges before are counted, so that a large group is not one task."""
    keyed = df.withColumn("_digest", digest).withColumn("_range", F.substring("_digest", 1, 3))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = keyed.groupBy(*by, "_range").agg(F.count("*").alias("_n")).withColumn("_start", before).drop("_n")
    inside = F.row_number().over(Window.partitionBy(*by, "_range").orderBy("_digest", tie)) - 1
    return keyed.withColumn("_inside", inside).join(starts, [*by, "_range"]).withColumn(out, (F.col("_start") + F.col("_inside")).cast("long")).select(*df.columns, out)


def fixed_chop(df: DataFrame, order: str, size: str, length: int) -> DataFrame:
    """Texts laid end to end and cut at every `length` tokens: (chunk, order key, first, n) for each piece. The last chunk
    is dropped if it is not full."""
    placed = prefix_sum(df.where(F.col(size) > 0).select(order, size), order, F.col(size), "start")
    full = F.floor(F.lit(df.agg(F.sum(size)).first()[0] or 0) / length)
    pieces = placed.select(order, size, "start", F.explode(F.sequence(F.floor(F.col("start") / length), F.floor((F.col("start") + F.col(size) - 1) / length))).alias("chunk"))
    first = F.greatest(F.col("start"), F.col("chunk") * length)
    last = F.least(F.col("start") + F.col(size), (F.col("chunk") + 1) * length)
    return pieces.where(F.col("chunk") < full).select(F.col("chunk").cast("long").alias("chunk"), order, (first - F.col("start")).cast("long").alias("first"), (last - first).cast("long").alias("n"))


def token_windows(df: DataFrame, key: str, size: str, length: int) -> DataFrame:
    """(key, token_start, token_end) of windows of `length` tokens that overlap by one; a text that fits is one window."""
    starts = F.when(F.col(size) <= length, F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col(size).cast("long") - 2, F.lit(length - 1).cast("long")))
    return df.where(F.col(size) > 0).select(key, size, F.explode(starts).alias("token_start")).select(key, "token_start", F.least(F.col("token_start") + length, F.col(size)).cast("long").alias("token_end"))


def morphology(pieces: DataFrame, key: str, at: str, track: str, start: str, end: str) -> DataFrame:
    """Word number and depth inside the word of every piece: a piece on a word track (mn, general) that starts where the
    piece before it on the same track ends goes on with its word, any other starts one; other tracks reset, and carry
    the number of the last word. Pieces of one key should be in one partition already: the windows then shuffle
    nothing."""
    w = Window.partitionBy(key).orderBy(at)
    word = F.col(track).isin("mn", "general") & (F.col(start) >= 0) & (F.col(end) >= 0)
    goes_on = word & (F.lag(track).over(w) == F.col(track)) & (F.lag(end).over(w) == F.col(start)) & F.lag("_word").over(w)
    marked = pieces.withColumn("_word", word).withColumn("_new", F.when(F.col("_word") & ~F.coalesce(goes_on, F.lit(False)), 1).otherwise(0))
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    numbered = marked.withColumn("_n", F.sum("_new").over(upto))
    depth = F.row_number().over(Window.partitionBy(key, "_n", "_word").orderBy(at)) - 1
    return numbered.withColumn("word_pos", F.greatest(F.col("_n") - 1, F.lit(0))).withColumn("depth", F.when(F.col("_word"), depth).otherwise(0)).drop("_word", "_new", "_n")


def capped(df: DataFrame, by: list[str], order: list[str], cap: int) -> DataFrame:
    """The first `cap` rows of each group; Spark limits the groups before the shuffle already."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_rank") <= cap).drop("_rank")


def next_in_group(df: DataFrame, key: str, by: str, order: str) -> DataFrame:
    """(key, by, next): the following row of the group, the first one after the last; a group of one has no next."""
    numbered = row_index(df.select(key, by, order), order, "idx", (by,))
    sizes = numbered.groupBy(by).agg(F.count("*").alias("n"))
    a = numbered.join(sizes, by).select(key, by, F.pmod(F.col("idx") + 1, F.col("n")).alias("at"), "n")
    b = numbered.select(F.col(key).alias("next"), F.col(by).alias("_by"), F.col("idx").alias("_at"))
    return a.where("n > 1").join(b, (F.col(by) == F.col("_by")) & (F.col("at") == F.col("_at"))).select(key, by, "next")


def next_fit(sizes: Iterable[int], capacity: int, gap: int = 1, alone: Iterable[bool] | None = None) -> Iterator[tuple[int, int]]:
    """(pack, start) of each item in order: a new pack where the item and the separator after the one before no longer fit.
    Items above the capacity and items of `alone` close the open pack and stand alone."""
    pack, used = -1, None
    for size, apart in zip(sizes, alone if alone is not None else repeat(False)):
        if apart or size > capacity:
            pack, used, start = pack + 1, None, 0
        elif used is None or used + gap + size > capacity:
            pack, used, start = pack + 1, size, 0
        else:
            start = used + gap
            used = start + size
        yield pack, start


def next_fit_packs(df: DataFrame, by: str, order: str, size: str, capacity: int, words: str | None = None, alone: str | None = None) -> DataFrame:
    """(by, order, pack, start, word_start): next-fit packing of the rows of each group in order, each with the place of its
    first token in its pack and, if `words` has the number of words of a row, that of its first word. The order makes it
    sequential: a group is one task, so `by` should be a shard of bounded size."""

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(order)
        flags = group["_alone"].tolist() if alone else None
        placed = pd.DataFrame(list(next_fit(group[size].tolist(), capacity, 1, flags)), columns=["pack", "start"], index=group.index)
        before = group["_words"].groupby(placed["pack"]).cumsum() - group["_words"]
        return pd.DataFrame({by: group[by], order: group[order], "pack": placed["pack"], "start": placed["start"], "word_start": before})

    schema = f"{by} {df.schema[by].dataType.simpleString()}, {order} {df.schema[order].dataType.simpleString()}, pack long, start long, word_start long"
    extra = [(F.col(words) if words else F.lit(0)).cast("long").alias("_words"), *([F.col(alone).alias("_alone")] if alone else [])]
    return df.where(F.col(size) > 0).select(by, order, size, *extra).groupBy(by).applyInPandas(fold, schema)


def plateau(losses: Iterable[tuple[int, float]], window: int, min_steps: int, min_delta: float, patience: int) -> Iterator[tuple[int, float | None, float | None, int, bool]]:
    """(step, smoothed, best, bad_steps, stop) of a series of losses, smoothed by the mean of the last `window`."""
    held: list[float] = []
    best, bad = None, 0
    for step, loss in losses:
        held = [*held, loss][-window:]
        smoothed = sum(held) / len(held)
        if len(held) < window:
            bad = 0
            yield step, None, best, bad, False
            continue
        if step < min_steps:
            best, bad = smoothed, 0
            yield step, smoothed, best, bad, False
            continue
        if best is None or smoothed < best - min_delta:
            best, bad = smoothed, 0
        else:
            bad += 1
        yield step, smoothed, best, bad, bad >= patience


def bracket_spans(c: Column, opening: int, closing: int) -> Column:
    """[start, end) of every outermost bracketed run of tokens, from 0; an open one goes to the end, and a closing bracket
    without an opening one counts for nothing."""
    marks = F.filter(F.transform(c, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda m: m.x.isin(opening, closing))
    none = F.array().cast("array<struct<start:int,end:int>>")

    def step(s: Column, m: Column) -> Column:
        depth = F.when(m.x == opening, s.depth + 1).otherwise(F.greatest(s.depth - 1, F.lit(0)))
        first = F.when((m.x == opening) & (s.depth == 0), m.i).otherwise(s.first)
        ends = (m.x == closing) & (s.depth == 1)
        spans = F.when(ends, F.concat(s.spans, F.array(F.struct(s.first.alias("start"), (m.i + 1).alias("end"))))).otherwise(s.spans)
        return F.struct(depth.alias("depth"), first.alias("first"), spans.alias("spans"))

    zero = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("first"), none.alias("spans"))
    rest = lambda s: F.when(s.depth > 0, F.concat(s.spans, F.array(F.struct(s.first.alias("start"), F.size(c).alias("end"))))).otherwise(s.spans)
    return F.aggregate(marks, zero, step, rest)


def truncated(c: Column, spans: Column, payloads: Column, limit: int) -> Column:
    """(c, spans, payloads) of a row cut to `limit` tokens, at the start of a span that the cut would fall into. Spans that
    end past the cutoff go, and with them their payloads, one for each span. Spans are taken from the last one back, so
    those of several kinds may overlap."""
    back = F.reverse(F.array_sort(spans))
    cutoff = F.when(F.size(c) <= limit, F.size(c)).otherwise(F.aggregate(back, F.lit(limit), lambda at, s: F.when((s.start < at) & (at < s.end), s.start).otherwise(at)))
    whole = F.filter(F.arrays_zip(spans.alias("span"), payloads.alias("payload")), lambda z: z.span.end <= cutoff)
    return F.struct(F.slice(c, F.lit(1), cutoff).alias("c"), F.transform(whole, lambda z: z.span).alias("spans"), F.transform(whole, lambda z: z.payload).alias("payloads"))
