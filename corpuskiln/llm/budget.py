"""Token budget of a corpus: tokens of every document, and totals by source, language and domain.

Texts are split into words and counted by document; the distinct words of the corpus are brought into byte order by
range, so that every partition holds one stretch of their prefix trie. The nodes of the trie are taken level by level, all
nodes of a level at once: each keeps the state of the tokenization after its byte, the last token and the number of
tokens, found from the states of the nodes above it, and words that share a prefix share these states. The state is exact:
of the tokens that end a prefix (an automaton over the vocabulary names the longest one, and from each the next shorter)
exactly one continues the encoding of what is before it, namely the one that stays apart from the last token there when
both are encoded together. The counts at the ends of words are joined back to the documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import spread, staged
from .bpe import DEFAULT_TOKENIZER, NONE, ByteBpe
from .encode import shared_vocabulary
from .mixing import measured_size, once

#: Pairs of tokens whose compatibility a worker remembers; beyond, it starts anew. It bounds memory and changes no result.
REMEMBERED = 2_000_000
#: Bytes up to which words are walked level by level; the tails of longer ones, of which few share a level, byte by byte.
LEVELS = 96


class Automaton:
    """All tokens as a trie with suffix links: `end` names the longest token that ends at a state."""

    def __init__(self, model: ByteBpe):
        tokens = model.token_bytes()
        self.length = np.zeros(max(tokens) + 1, np.int32)
        steps: list[dict[int, int]] = [{}]
        own = {0: -1}
        for token, raw in tokens.items():
            self.length[token] = len(raw)
            state = 0
            for byte in raw:
                following = steps[state].get(byte)
                if following is None:
                    following = steps[state][byte] = len(steps)
                    steps.append({})
                state = following
            own[state] = token
        fail, end, self.shorter = [0] * len(steps), [-1] * len(steps), np.full(max(tokens) + 1, -1, np.int32)
        level = [0]
        while level:
            below = []
            for state in level:
                for byte, following in steps[state].items():
                    back = fail[state]
                    while state and byte not in steps[back] and back:
                        back = fail[back]
                    fail[following] = steps[back].get(byte, 0) if state else 0
                    token = own.get(following, -1)
                    end[following] = token if token >= 0 else end[fail[following]]
                    if token >= 0:
                        self.shorter[token] = end[fail[following]]
                    below.append(following)
            level = below
        keys = np.array([state << 8 | byte for state, step in enumerate(steps) for byte in step], np.int64)
        order = np.argsort(keys)
        self.keys = keys[order]
        self.to = np.array([following for step in steps for following in step.values()], np.int32)[order]
        self.fail, self.end = np.array(fail, np.int32), np.array(end, np.int32)

    def step(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The states after one more byte each. Every byte is a token, so the root always goes on."""
        state, out, open_ = state.astype(np.int64), np.zeros(len(state), np.int32), np.arange(len(state))
        while len(open_):
            wanted = state[open_] << 8 | byte[open_]
            at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
            hit = self.keys[at] == wanted
            out[open_[hit]] = self.to[at[hit]]
            open_ = open_[~hit]
            state[open_] = self.fail[state[open_]]
        return out


@cache
def _automaton(path: str) -> Automaton:
    return Automaton(ByteBpe(path))


_shared: dict[tuple[str, str], object] = {}


def shared_automaton(spark, path: str):
    """The automaton as a broadcast of this application: some megabytes, of fixed size."""
    key = (spark.sparkContext.applicationId, path)
    if key not in _shared:
        _shared[key] = spark.sparkContext.broadcast(_automaton(path))
    return _shared[key]


class PrefixStates:
    """Incremental tokenization along the prefix trie of words in byte order."""

    def __init__(self, model: ByteBpe, automaton: Automaton):
        self.model, self.automaton = model, automaton
        # the merge that makes a token: its rank, its left and its right part; none makes a byte
        size = len(automaton.length)
        self.made_at, self.left, self.right = (np.full(size, -1, np.int64) for _ in range(3))
        self.made_at[model.made], self.left[model.made], self.right[model.made] = model.ranks, model.keys >> 16, model.keys & 0xFFFF
        self.pairs, self.apart = np.zeros(0, np.int64), np.zeros(0, bool)

    def _apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether no merge ever crosses the border of two tokens: the merges that made them are undone, the later one
        first (of equal ones the right one is later), and at each moment the two parts at the border must form no pair that
        would have been merged before."""
        apart = np.ones(len(a), bool)
        open_, a, b = np.arange(len(a)), a.astype(np.int64), b.astype(np.int64)
        limit = np.full(len(a), NONE, np.int64)
        while len(open_):
            at = self.model.lookup(a << 16 | b)
            crossed = (at >= 0) & (self.model.ranks[at] < limit)
            apart[open_[crossed]] = False
            last_left, last_right = self.made_at[a], self.made_at[b]
            on = ~crossed & (np.maximum(last_left, last_right) >= 0)
            open_, a, b, last_left, last_right = open_[on], a[on], b[on], last_left[on], last_right[on]
            right_later = last_right >= last_left
            limit = np.where(right_later, last_right + 1, last_left)
            a, b = np.where(right_later, a, self.right[a]), np.where(right_later, self.left[b], b)
        return apart

    def stay_apart(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether two tokens next to each other are the encoding of their bytes; pairs met before are remembered."""
        wanted = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self.pairs, wanted)
        known = at < len(self.pairs)
        known[known] = self.pairs[at[known]] == wanted[known]
        if not known.all():
            new = np.unique(wanted[~known])
            if len(self.pairs) > REMEMBERED:
                self.pairs, self.apart = np.zeros(0, np.int64), np.zeros(0, bool)
                return self.stay_apart(left, right)
            into = np.searchsorted(self.pairs, new)
            self.apart = np.insert(self.apart, into, self._apart(new >> 32, new & 0xFFFFFFFF))
            self.pairs = np.insert(self.pairs, into, new)
            at = np.searchsorted(self.pairs, wanted)
        return self.apart[at]

    def tokens(self, words: list[bytes]) -> np.ndarray:
        """The number of tokens of each word; words are in byte order, none is empty."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        first = np.concatenate([[0], np.cumsum(lengths)])[:-1]
        flat = np.frombuffer(b"".join(words), np.uint8)
        shared = self._shared(flat, first, lengths)
        last, count = np.zeros(len(flat), np.int32), np.zeros(len(flat), np.int32)
        state = np.zeros(len(words), np.int32)
        for depth in range(min(LEVELS, int(lengths.max(initial=0)))):
            active = np.flatnonzero(lengths > depth)
            new = shared[active] <= depth
            node, at = np.cumsum(new) - 1, first[active[new]]
            reached = self.automaton.step(state[active[new]], flat[at + depth])
            token, counted = self.automaton.end[reached].copy(), np.ones(len(at), np.int32)
            open_ = np.arange(len(at))
            while len(open_):
                start = depth + 1 - self.automaton.length[token[open_]]
                inner = open_[start > 0]
                before = at[inner] + start[start > 0] - 1
                fits = self.stay_apart(last[before], token[inner])
                counted[inner[fits]] = count[before[fits]] + 1
                open_ = inner[~fits]
                token[open_] = self.automaton.shorter[token[open_]]
            state[active] = reached[node]
            last[first[active] + depth], count[first[active] + depth] = token[node], counted[node]
        for k in np.flatnonzero(lengths > LEVELS).tolist():
            self._tail(flat, int(first[k]), int(lengths[k]), int(state[k]), last, count)
        return count[first + lengths - 1]

    @staticmethod
    def _shared(flat: np.ndarray, first: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The bytes, up to LEVELS, that each word has in common with the one before it."""
        shared = np.zeros(len(first), np.int64)
        alike = np.arange(1, len(first))
        for depth in range(LEVELS):
            alike = alike[(lengths[alike] > depth) & (lengths[alike - 1] > depth)]
            alike = alike[flat[first[alike] + depth] == flat[first[alike - 1] + depth]]
            if not len(alike):
                break
            shared[alike] = depth + 1
        return shared

    def _tail(self, flat: np.ndarray, first: int, length: int, state: int, last: np.ndarray, count: np.ndarray) -> None:
        """The states of one word beyond LEVELS bytes, from those of its first bytes. The automaton runs through the bytes
        first, then the states follow in order."""
        auto = self.automaton
        steps: dict[int, int] = {}
        longest = []
        for byte in flat[first + LEVELS : first + length].tolist():
            key = state << 8 | byte
            if key not in steps:
                steps[key] = int(auto.step(np.array([state]), np.array([byte]))[0])
            state = steps[key]
            longest.append(int(auto.end[state]))
        fits: dict[tuple[int, int], bool] = {}
        sizes, shorter = auto.length.tolist(), auto.shorter.tolist()
        ranks = self._rank_table()
        made_at, left, right = self._parts
        ends, counts = last[first : first + LEVELS].tolist(), count[first : first + LEVELS].tolist()
        for depth, token in enumerate(longest, LEVELS):
            start = depth + 1 - sizes[token]
            while start:
                pair = ends[start - 1], token
                if pair not in fits:
                    fits[pair] = _stay_apart(*pair, ranks, made_at, left, right)
                if fits[pair]:
                    break
                token = shorter[token]
                start = depth + 1 - sizes[token]
            ends.append(token)
            counts.append(counts[start - 1] + 1 if start else 1)
        last[first : first + length], count[first : first + length] = ends, counts

    def _rank_table(self) -> dict[int, int]:
        if not hasattr(self, "_ranks"):
            self._ranks = dict(zip(self.model.keys.tolist(), self.model.ranks.tolist()))
            self._parts = self.made_at.tolist(), self.left.tolist(), self.right.tolist()
        return self._ranks


def _stay_apart(a: int, b: int, ranks: dict[int, int], made_at: list[int], left: list[int], right: list[int]) -> bool:
    """`PrefixStates._apart` of one pair."""
    limit = int(NONE)
    while True:
        if ranks.get(a << 16 | b, limit) < limit:
            return False
        if made_at[a] < 0 and made_at[b] < 0:
            return True
        if made_at[b] >= made_at[a]:
            limit, b = made_at[b] + 1, left[b]
        else:
            limit, a = made_at[a], right[a]


def document_pieces(documents: DataFrame, key: str, text: str, tokenizer: str = DEFAULT_TOKENIZER) -> DataFrame:
    """(`key`, piece, n): the words of each row's text, before merges, and how often each occurs."""
    vocabulary = shared_vocabulary(documents.sparkSession, tokenizer)
    schema = T.StructType([documents.schema[key], T.StructField("piece", T.StringType(), False), T.StructField("n", T.IntegerType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, 500):
                batch = whole.slice(first, 500)
                keys, texts = batch.column(0), batch.column(1).to_pylist()
                filled = [k for k, t in enumerate(texts) if t]
                if not filled:
                    continue
                words, counts = vocabulary.value.split_words([texts[k] for k in filled])
                index: dict[str, int] = {}
                code = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, len(words))
                held, n = np.unique(np.repeat(np.array(filled, np.int64), counts) << 32 | code, return_counts=True)
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(held >> 32)), pa.array(list(index), pa.string()).take(pa.array(held & 0xFFFFFFFF)), pa.array(n.astype(np.int32))], names=[key, "piece", "n"])

    return spread(documents).select(key, text).mapInArrow(run, schema)


def piece_tokens(pieces: DataFrame, tokenizer: str = DEFAULT_TOKENIZER) -> DataFrame:
    """(piece, n_tokens) of distinct pieces, from the prefix tries of their ranges."""
    spark = pieces.sparkSession
    vocabulary, automaton = shared_vocabulary(spark, tokenizer), shared_automaton(spark, tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states = None
        for batch in batches:
            if batch.num_rows:
                states = states or PrefixStates(vocabulary.value, automaton.value)
                column = batch.column(0)
                counts = states.tokens([w.encode() for w in column.to_pylist()])
                yield pa.RecordBatch.from_arrays([column, pa.array(counts, pa.int64())], names=["piece", "n_tokens"])

    slices = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = pieces.select("piece").distinct().repartitionByRange(slices, "piece").sortWithinPartitions("piece")
    return ordered.mapInArrow(run, "piece string, n_tokens bigint")


def document_tokens(documents: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = DEFAULT_TOKENIZER) -> DataFrame:
    """(`key`, n_tokens) of every distinct key: tokens of its text, of all its rows together where the key repeats.

    0 for null and empty texts; rows of the null key count together under null. A word that is in most documents is no hot
    task: words are counted by document first, distinct words are few, and adaptive skew handling splits the join by word.
    """
    counted = staged(document_pieces(documents, key, text, tokenizer))
    known = piece_tokens(counted, tokenizer)
    sums = counted.join(known, "piece").groupBy(key).agg(F.sum(F.col("n") * F.col("n_tokens")).alias("n_tokens"))
    return _by_key(documents.select(key).distinct(), sums, key, "left").na.fill(0, ["n_tokens"])


def _by_key(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """A join by a key that may be null, with the key once."""
    other = right.withColumnRenamed(key, "_right_key")
    return left.join(other, left[key].eqNullSafe(other["_right_key"]), how).drop("_right_key")


def language_of(lang: Column) -> Column:
    """One spelling for a language: main tag in lower case, script in title case; names of one language together."""
    bare = F.lower(F.regexp_replace(F.trim(lang), "_", "-"))
    # fixed values: other names of the corpus' languages
    for name, others in (("mn", ["mon"]), ("en", ["eng"]), ("zh", ["zho", "zh-hans", "chi"])):
        bare = F.when(bare.isin(*others), name).otherwise(bare)
    return F.when(bare == "", None).otherwise(F.regexp_replace(bare, "-mong$", "-Mong")).alias("lang")


def token_budget(documents: DataFrame, key: str = "doc_id", tokenizer: str = DEFAULT_TOKENIZER) -> DataFrame:
    """Documents, characters and tokens by source, by language and by domain, and of all: (slice, value, n_docs, n_chars,
    n_tokens). `slice` is source, lang, domain or all; documents without a value are under null. Rows of one key, the null
    key too, count as one document with the tokens of all its rows."""
    rows = documents.groupBy(key).agg(F.first("source", True).alias("source"), F.first(language_of(F.col("lang")), True).alias("lang"), F.first("domain", True).alias("domain"), F.sum(F.coalesce(F.length("text"), F.lit(0))).cast("long").alias("n_chars"))
    whole = _by_key(rows, document_tokens(documents, key, tokenizer=tokenizer), key)
    slices = F.array(*(F.struct(F.lit(name).alias("slice"), F.col(name).alias("value")) for name in ("source", "lang", "domain")), F.struct(F.lit("all").alias("slice"), F.lit(None).cast("string").alias("value")))
    return whole.select(F.explode(slices).alias("s"), "n_chars", "n_tokens").groupBy("s.slice", "s.value").agg(F.count("*").alias("n_docs"), F.sum("n_chars").alias("n_chars"), F.sum("n_tokens").alias("n_tokens"))


def audit_estimates(stats: DataFrame) -> DataFrame:
    """Every (run_id, source) with its measured size and whether the recorded est_tokens agrees: `wrong` is true where it
    is null or differs by more than 1, null where a measured figure is null. A row delivered twice counts once."""
    known = once(stats).withColumn("measured", measured_size())
    wrong = F.col("est_tokens").isNull() | (F.abs(F.col("est_tokens") - F.col("measured")) > 1)
    return known.select("run_id", "source", "est_tokens", "measured", F.when(F.col("measured").isNotNull(), wrong).alias("wrong"))
