"""A word vocabulary in segments, two-track encoding with byte fallback, decoding, and reports on both.

A text is cut into segments: Mongolian words, other words, and single characters of all else. A word that its track's
segment of the vocabulary holds is one token; everything else is as many tokens as it has bytes. Ids below 256 are bytes.
A vocabulary of up to HELD words goes to every task, and texts are encoded and decoded row by row; with a larger one they
are exploded and joined. Neither takes Python.
"""

from __future__ import annotations

import codecs
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as X

# The segments of the vocabulary, special ids and bytes first.
SEGMENTS = {"mn": (256, 24_576), "general": (24_576, 65_536)}
#: Ids of words beyond their segment begin here: above the segments, special ids and the ends of completions.
BEYOND = 1_048_576
#: Words of a vocabulary that every task holds (some 100 bytes each); a larger one is joined by shuffles.
HELD = 700_000
#: Words of a vocabulary that are broadcast to exploded texts.
BROADCAST = 500_000
#: Groups by hash in which tasks look words up.
BUCKETS = 65_536
#: Words of Mongolian (with narrow spaces inside), other words, single characters of all else.
SEGMENT = rf"[{P.SCRIPTS['mongolian']}]+(?:\x{{202f}}[{P.SCRIPTS['mongolian']}]+)*|[^{P.SPACE}\p{{P}}\p{{S}}{P.SCRIPTS['mongolian']}]+|(?s)."
MONGOLIAN = rf"^[{P.SCRIPTS['mongolian']}]"
UNKNOWN = "�"


def track_of(word: Column) -> Column:
    return F.when(word.rlike(MONGOLIAN), "mn").otherwise("general")


def segments(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, at, piece, track, start, end) of every text, in order; the pieces put together are the text. Null and empty
    texts have none; rows of one key count as texts of their own only if the key is unique."""
    pieces = df.select(key, F.posexplode(X.found(X.text_of(text), SEGMENT)).alias("at", "piece"))
    upto = F.sum(F.length("piece")).over(Window.partitionBy(key).orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    return pieces.withColumn("track", track_of(F.col("piece"))).withColumn("end", upto.cast("long")).withColumn("start", F.col("end") - F.length("piece"))


def frequency_rank(counts: DataFrame, by: str, word: str = "word", n: str = "n", out: str = "rank") -> DataFrame:
    """counts with the place of each word of its group `by`, the most frequent first, ties in byte order. Words of one count
    and one beginning are ranked together, so neither a group nor its many rare words are one task."""
    keyed = counts.withColumn("_head", F.hex(F.substring(F.encode(word, "UTF-8"), 1, 3)))
    groups = keyed.groupBy(by, n, "_head").agg(F.count("*").alias("_k"))
    before = F.coalesce(F.sum("_k").over(Window.partitionBy(by).orderBy(F.desc(n), "_head").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = groups.withColumn("_start", before).drop("_k")
    inside = F.row_number().over(Window.partitionBy(by, n, "_head").orderBy(F.encode(word, "UTF-8"))) - 1
    return keyed.withColumn("_inside", inside).join(starts, [by, n, "_head"]).withColumn(out, (F.col("_start") + F.col("_inside")).cast("long")).select(*counts.columns, out)


def unified_vocabulary(counts: DataFrame, least: int = 1) -> DataFrame:
    """(word, id) of the words (word, n) that occur at least `least` times: each track's in its segment, the most frequent
    first. A word too many for its segment raises: nothing is dropped in silence."""
    running = running_vocabulary(counts, least)
    return running.select("word", F.when(F.col("token") < BEYOND, F.col("id")).otherwise(F.raise_error(F.lit("a segment of the vocabulary is full"))).cast("long").alias("id"))


def running_vocabulary(counts: DataFrame, least: int = 1) -> DataFrame:
    """(word, id, token) of the words (word, n) that occur at least `least` times, however many they are, each track's the
    most frequent first. `id` counts on from the start of the track's segment; past its end an id may be that of a word of
    the other track too. `token` is the id within the segment and past its end one from BEYOND on, so no two words share one."""
    held = counts.where(F.col("n") >= least).withColumn("track", track_of(F.col("word")))
    mongolian = F.col("track") == "mn"
    low, high = (F.when(mongolian, SEGMENTS["mn"][k]).otherwise(SEGMENTS["general"][k]) for k in (0, 1))
    ranked = frequency_rank(held, "track").withColumn("id", (low + F.col("rank")).cast("long"))
    beyond = BEYOND + 2 * (F.col("id") - high) + F.when(mongolian, 0).otherwise(1)
    return ranked.select("word", "id", F.when(F.col("id") < high, F.col("id")).otherwise(beyond).cast("long").alias("token"))


def byte_ids(piece: Column) -> Column:
    """The bytes of a text as ids."""
    several = F.transform(F.regexp_extract_all(F.hex(F.encode(piece, "UTF-8")), F.lit(".."), F.lit(0)), lambda b: F.conv(b, 16, 10).cast("long"))
    return F.when(F.octet_length(piece) == 1, F.array(F.ascii(piece).cast("long"))).otherwise(several)


def byte_tokens(piece: Column) -> Column:
    """The bytes of a text as they are written in a vocabulary: <0x41>."""
    return F.transform(F.regexp_extract_all(F.hex(F.encode(piece, "UTF-8")), F.lit(".."), F.lit(0)), lambda b: F.concat(F.lit("<0x"), b, F.lit(">")))


def held(vocabulary: DataFrame, *columns: Column) -> DataFrame:
    """Columns of a vocabulary as a side of a join. It is counted first, so it should be staged."""
    known = vocabulary.select(*columns)
    return F.broadcast(known) if vocabulary.count() <= min(HELD, BROADCAST) else known


def encode_spans(df: DataFrame, key: str, text: str, vocabulary: DataFrame) -> DataFrame:
    """(key, at, piece, track, start, end, ids) of every segment. `vocabulary` has (word, id)."""
    known = held(vocabulary, F.col("word").alias("_word"), F.col("id").alias("_id"))
    joined = segments(df, key, text).join(known, F.col("piece") == F.col("_word"), "left")
    return joined.select(key, "at", "piece", "track", "start", "end", F.when(F.col("_id").isNotNull(), F.array("_id")).otherwise(byte_ids(F.col("piece"))).alias("ids"))


def encode_counted(counts: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(piece, n, track, ids) of distinct segments (piece, n). `vocabulary` has (word, id)."""
    joined = counts.join(vocabulary.select(F.col("word").alias("_word"), F.col("id").alias("_id")), F.col("piece") == F.col("_word"), "left")
    return joined.select("piece", "n", track_of(F.col("piece")).alias("track"), F.when(F.col("_id").isNotNull(), F.array("_id")).otherwise(byte_ids(F.col("piece"))).alias("ids"))


def _bucket(c: Column) -> Column:
    return F.pmod(F.hash(c), F.lit(BUCKETS))


def lookup(known: DataFrame, key: str, value: str) -> Column:
    """known (key, value) as one value, for found_in: an array of small maps, by hash of the key. Keys are distinct, else it
    raises; HELD rows at most. Given to a query as a column of its own and read at one place, it is held once by each task
    and never copied to rows: Spark puts it where it is read."""
    empty = known.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("b"), F.lit(None).alias("e"))
    lists = known.select(_bucket(F.col(key)).alias("b"), F.struct(F.col(key), F.col(value)).alias("e")).unionByName(empty).groupBy("b").agg(F.collect_list("e").alias("e"))
    return lists.agg(F.transform(F.array_sort(F.collect_list(F.struct("b", "e"))), lambda x: F.map_from_entries(x.e)).alias("m")).scalar()


def found_in(table: Column, c: Column) -> Column:
    """The value that a lookup has for c, else null."""
    return F.try_element_at(F.get(table, _bucket(c)), c)


def encode_ids(df: DataFrame, key: str, text: str, vocabulary: DataFrame) -> DataFrame:
    """(key, ids) of every row that has a token; what lies in one text is put together in one row."""
    if vocabulary.count() <= HELD:
        known = df.where(X.text_of(text) != "").withColumn("_known", lookup(vocabulary.select("word", F.array("id").alias("ids")), "word", "ids"))
        ids = F.transform(X.found(X.text_of(text), SEGMENT), lambda p: F.coalesce(found_in(F.col("_known"), p), byte_ids(p)))
        return known.select(key, F.flatten(ids).alias("ids"))
    spans = encode_spans(df, key, text, vocabulary).select(key, F.struct("at", "ids").alias("s"))
    return spans.groupBy(key).agg(F.flatten(F.transform(F.array_sort(F.collect_list("s")), lambda s: s.ids)).alias("ids"))


def decode_ids(df: DataFrame, key: str, ids: str, vocabulary: DataFrame, eos: int | None = None, unfinished: bool = False) -> DataFrame:
    """(key, text) of rows of ids: words by the vocabulary, bytes put together before they are read as UTF-8, broken ones
    as U+FFFD, and so unknown ids. With `eos` a row ends before the first of it; `unfinished` adds U+FFFD where it is
    missing. Null ids give an empty text."""
    values = F.coalesce(F.col(ids), F.array().cast("array<bigint>"))
    if eos is not None:
        place = F.array_position(values, F.lit(eos).cast("long"))
        cut = F.when(place > 0, F.slice(values, F.lit(1), (place - 1).cast("int"))).otherwise(values)
        values = F.when((place == 0) & F.lit(unfinished), F.concat(cut, F.array(F.lit(-1).cast("long")))).otherwise(cut)

    def written(id_: Column, word: Column) -> Column:
        return F.coalesce(word, F.when(id_.between(0, 255), F.lpad(F.hex(id_), 2, "0")), F.lit("EFBFBD"))

    known = vocabulary.select(F.col("id").alias("_id"), F.hex(F.encode("word", "UTF-8")).alias("_hex"))
    if vocabulary.count() <= HELD:
        words = df.select(key, values.alias("_ids")).withColumn("_known", lookup(known, "_id", "_hex"))
        joined = words.select(key, F.array_join(F.transform("_ids", lambda i: written(i, found_in(F.col("_known"), i))), "").alias("_raw"))
    else:
        spread_ = df.select(key, F.posexplode_outer(values).alias("at", "id")).join(known, F.col("id") == F.col("_id"), "left")
        piece = F.when(F.col("at").isNotNull(), F.struct("at", written(F.col("id"), F.col("_hex")).alias("h")))
        joined = spread_.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda x: x.h), "").alias("_raw"))
    return joined.select(key, F.make_valid_utf8(F.unhex("_raw").cast("string")).alias("text"))


def round_trips(df: DataFrame, key: str, text: str, vocabulary: DataFrame) -> DataFrame:
    """(key, same): whether each text comes back from its ids."""
    back = decode_ids(encode_ids(df, key, text, vocabulary), key, "ids", vocabulary).withColumnRenamed("text", "_back")
    return df.select(key, X.text_of(text).alias("_text")).join(back, key, "left").select(key, (F.col("_text") == F.coalesce("_back", F.lit(""))).alias("same"))


def hit_report(spans: DataFrame, n: str | None = None) -> DataFrame:
    """By track, of segments that are no white space: n_pieces, word_hits (one token of the vocabulary), n_tokens,
    byte_tokens, and the shares of both. `n` is how often a segment counts, once if not given."""
    times = F.col(n) if n else F.lit(1)
    held = spans.where(F.trim("piece") != "").withColumn("_hit", (F.size("ids") == 1) & (F.element_at("ids", 1) >= 256))
    counted = held.groupBy("track").agg(F.sum(times).alias("n_pieces"), F.sum(F.when(F.col("_hit"), times).otherwise(0)).alias("word_hits"), F.sum(times * F.size("ids")).alias("n_tokens"), F.sum(F.when(F.col("_hit"), 0).otherwise(times * F.size("ids"))).alias("byte_tokens"))
    return counted.withColumn("hit_rate", F.round(F.col("word_hits") / F.col("n_pieces"), 6)).withColumn("byte_rate", F.round(F.col("byte_tokens") / F.col("n_tokens"), 6))


def stream_decode(df: DataFrame, key: str, chunks: str) -> DataFrame:
    """(key, pieces) of rows of chunks of bytes: what each chunk adds to the text. A character that a chunk cuts is held back
    until it is whole; what is still held back at the end comes as U+FFFD, in a piece of its own."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for held in batch[chunks]:
                decoder = codecs.getincrementaldecoder("utf-8")("replace")
                pieces = [decoder.decode(bytes(c)) for c in (held if held is not None else [])]
                rest = decoder.decode(b"", True)
                rows.append([*pieces, rest] if rest else pieces)
            yield pd.DataFrame({key: batch[key], "pieces": rows})

    return df.select(key, chunks).mapInPandas(run, f"{key} {df.schema[key].dataType.simpleString()}, pieces array<string>")


# encoding with given merges


def constrained_merges(word: str, ranks: dict[tuple[str, str], int], cuts: frozenset[int] = frozenset(), controls: str = P.VARIATION_SELECTORS + P.VOWEL_SEPARATOR) -> list[str]:
    """The tokens of a word by merges of given ranks: the best pair, the leftmost of several, again and again. No merge
    crosses a place of `cuts` (a number of characters), and controls stay tokens of their own."""
    tokens, ends = list(word), list(range(1, len(word) + 1))
    while True:
        best = None
        for k in range(len(tokens) - 1):
            rank = ranks.get((tokens[k], tokens[k + 1]))
            if rank is not None and ends[k] not in cuts and tokens[k] not in controls and tokens[k + 1] not in controls and (best is None or rank < best[0]):
                best = rank, k
        if best is None:
            return tokens
        k = best[1]
        tokens[k : k + 2] = [tokens[k] + tokens[k + 1]]
        del ends[k]


def encode_words(words: DataFrame, merges: list[tuple[str, str]], word: str = "word", cuts: str | None = None) -> DataFrame:
    """(word, tokens) of distinct words; `merges` in order of rank, `cuts` a column of places that no merge may cross."""
    held = words.sparkSession.sparkContext.broadcast({pair: rank for rank, pair in reversed(list(enumerate(merges)))})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            places = batch["_cuts"] if cuts else [None] * len(batch)
            yield pd.DataFrame({"word": batch["word"], "tokens": [constrained_merges(w, held.value, frozenset(() if c is None else c)) for w, c in zip(batch["word"], places)]})

    chosen = words.where(F.col(word).isNotNull()).select(F.col(word).alias("word"), *([F.col(cuts).alias("_cuts")] if cuts else [])).distinct()
    return chosen.mapInPandas(run, "word string, tokens array<string>")


def boundary_recall(tokens: DataFrame, boundaries: str = "boundaries") -> DataFrame:
    """(n_boundaries, n_kept, recall): of the given inner places of words, how many are places between tokens. `tokens` has
    (word, tokens) and the places as an array."""
    ends = F.aggregate("tokens", F.array().cast("array<int>"), lambda acc, t: F.concat(acc, F.array((F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + F.length(t)).cast("int"))))
    counted = tokens.select(F.size(boundaries).alias("n"), F.size(F.array_intersect(F.col(boundaries), ends)).alias("k")).where("n > 0")
    return counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_boundaries"), F.coalesce(F.sum("k"), F.lit(0)).alias("n_kept"), F.round(F.sum("k") / F.sum("n"), 6).alias("recall"))


def byte_targets(rows: DataFrame, key: str, labels: str, vocabulary: DataFrame, ignored: int = -100, end: int = 0) -> DataFrame:
    """(key, bytes) of training rows: the labels that count, up to the end token, decoded and as bytes. A masked label
    among them raises, since such a row has no one target. Rows of a masked prompt and a target go without a function for
    each label; the rest are looked through one by one."""
    kept = F.array_remove(labels, ignored)
    plain = ~F.array_contains(F.slice(labels, F.size(labels) - F.size(kept) + 1, F.size(kept)), ignored)
    first = F.array_position(F.transform(labels, lambda x: (x != ignored).cast("int")), 1).cast("int")
    tail = F.when(first > 0, F.slice(labels, first, F.size(labels) - first + 1)).otherwise(F.slice(labels, F.lit(1), F.lit(0)))
    whole = F.when(F.forall(tail, lambda x: x != ignored), tail).otherwise(F.raise_error(F.lit("masked labels within a target")).cast("array<bigint>"))
    targets = rows.select(key, F.when(plain, kept).otherwise(whole).alias("_ids"))
    text = decode_ids(targets, key, "_ids", vocabulary, eos=end)
    return text.select(key, F.encode("text", "UTF-8").alias("bytes"))


def bytes_text(raw: Column) -> Column:
    """Bytes as text, broken ones as U+FFFD."""
    return F.make_valid_utf8(raw.cast("string"))
