"""Deduplication: exact keys, SimHash signatures, near-duplicate pairs and the keep-first rule."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import combinations
from math import comb, inf

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import patterns as P
from ..functions import text as X
from ..session import spread, staged
from .components import connected_components

BANDS, BITS = 4, 16


def keep_first(df: DataFrame, key: Column, order: str) -> DataFrame:
    """The first row of every key, with the key as exact_key. The order column is unique; only it and the keys, computed
    once, are aggregated: whole rows move only when the kept ones are picked out."""
    keyed = staged(df.select(order, key.alias("exact_key")))
    first = keyed.groupBy("exact_key").agg(F.min(order).alias("_first")).select(F.col("exact_key").alias("_key"), "_first")
    kept = keyed.join(first, (F.col("exact_key") == F.col("_key")) & (F.col(order) == F.col("_first"))).select(F.col(order).alias("_first"), "exact_key")
    return kept.select(F.col("_first").alias(order), "exact_key") if df.columns == [order] else df.join(kept, F.col(order) == F.col("_first")).select(*df.columns, "exact_key")


def _python(pattern: str) -> str:
    return re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: re.escape(chr(int(m[1], 16))) if int(m[1], 16) < 0x80 else chr(int(m[1], 16)), pattern)


_MONGOLIAN = re.compile(_python(f"[{P.SCRIPTS['mongolian']}]+"))
_TOKEN = re.compile(_python(P.TOKEN))


def terms(text: str) -> list[str]:
    """Mongolian words if there are any, else words and single characters of wordless scripts."""
    return _MONGOLIAN.findall(text) or _TOKEN.findall(text)


def simhash(words: list[str], k: int = 4) -> int:
    """64 bits, signed: the sign of the votes of all shingles of k words, as often as each occurs; a tie gives 0."""
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(max(len(words) - k + 1, 1))]
    raw = b"".join(hashlib.blake2b(s.encode(), digest_size=8).digest() for s in shingles)
    ones = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(shingles)).tobytes(), "big", signed=True)


def signatures(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_terms, sig) of every row; null and empty texts have 0 terms and signature 0."""
    schema = T.StructType([df.schema[key], T.StructField("n_terms", T.LongType()), T.StructField("sig", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [terms(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(map(len, words)), pa.int64()), pa.array(list(map(simhash, words)), pa.int64())], names=[key, "n_terms", "sig"])

    return spread(df).select(key, text).mapInArrow(run, schema)


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)).cast("int")


def band_places(parts: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of each of `parts` bands of 64 bits; none is empty, the first ones are a bit wider."""
    if not 2 <= parts <= 64:
        raise ValueError(f"64 bits in {parts} bands")
    width, wider = divmod(64, parts)
    return [(i * width + min(i, wider), width + (i < wider)) for i in range(parts)]


def flips(width: int, radius: int) -> list[int]:
    """All patterns of at most `radius` bits among `width`."""
    return [sum(1 << bit for bit in bits) for r in range(radius + 1) for bits in combinations(range(width), r)]


def band_plan(limit: int, n: int) -> tuple[int, int]:
    """How many bands to cut signatures into, and in how many bits of a band to look for neighbours. Of two signatures
    within `limit` bits at least one of m bands differs in at most limit // m: with limit + 1 bands one is equal, with fewer
    and wider ones neighbours are probed. The plan is the one with the fewest probes and expected meetings among n."""

    def cost(m: int) -> float:
        wide, radius = 64 // m, limit // m
        probes = sum(comb(wide + (64 % m > 0), r) for r in range(radius + 1))
        return m * probes * (1 + n / 2**wide) if probes <= 4096 else inf

    parts = min((m for m in range(2, min(limit + 1, 64) + 1)), key=lambda m: (cost(m), m), default=2)
    return parts, limit // parts


def _part(low: int, width: int) -> Column:
    return F.shiftrightunsigned("sig", low).bitwiseAND(F.lit((1 << width) - 1).cast("long"))


def _probed(band: int, low: int, width: int, radius: int) -> Column:
    """The band and all its neighbours within `radius` bits."""
    return F.transform(F.lit(flips(width, radius)).cast("array<bigint>"), lambda mask: F.struct(F.lit(band).alias("band"), _part(low, width).bitwiseXOR(mask).alias("part")))


def near_pairs(sigs: DataFrame, limit: int, key: str = "doc_id", sig: str = "sig", bands: int | None = None) -> DataFrame:
    """(a, b, dist) of all pairs of different keys, a before b, whose signatures differ in at most `limit` bits.

    Rows of one signature meet as one: pairs are found between distinct signatures, then the keys of equal and of close
    signatures are brought together. The search is exact, by bands and probes as `band_plan` has them; given `bands`, it
    finds only pairs that share one. Null keys and signatures are left out.
    """
    held = staged(sigs.select(F.col(key).alias("key"), F.col(sig).alias("sig")).where("key is not null and sig is not null"))
    distinct = staged(held.select("sig").distinct())
    parts, radius = (bands, 0) if bands else band_plan(limit, distinct.count())
    places = band_places(parts)
    own = F.array(*(F.struct(F.lit(i).alias("band"), _part(low, width).alias("part")) for i, (low, width) in enumerate(places)))
    probes = F.flatten(F.array(*(_probed(i, low, width, radius) for i, (low, width) in enumerate(places))))
    right = distinct.select(F.col("sig").alias("sb"), F.explode(own).alias("b")).select("sb", "b.band", "b.part")
    left = distinct.select(F.col("sig").alias("sa"), F.explode(probes if radius else own).alias("b")).select("sa", "b.band", "b.part")
    # exploded sides are many times the size that is estimated for them: they are merged, never broadcast
    close = left.join(right.hint("merge"), ["band", "part"]).where(F.col("sa") < F.col("sb")).where(distance(F.col("sa"), F.col("sb")) <= limit).select("sa", "sb").distinct()
    near = close.select("sa", "sb", distance(F.col("sa"), F.col("sb")).alias("dist")).union(distinct.select("sig", "sig", F.lit(0)))
    a, b = held.select(F.col("key").alias("ka"), F.col("sig").alias("sa")), held.select(F.col("key").alias("kb"), F.col("sig").alias("sb"))
    pairs = near.join(a, "sa").join(b, "sb").where("ka <> kb")
    return pairs.select(F.least("ka", "kb").alias("a"), F.greatest("ka", "kb").alias("b"), "dist").distinct()


def dedup_state(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> None:
    """Write what deduplication has to remember of a batch, or add it to what is there: exact keys and signatures."""
    df.select(X.exact_key(X.text_of(text)).alias("exact_key")).distinct().write.mode("append").parquet(f"{path}/exact_keys")
    signatures(df, key, text).select("n_terms", "sig").distinct().write.mode("append").parquet(f"{path}/signatures")


def new_rows(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", limit: int = 3, min_terms: int = 120) -> DataFrame:
    """(key, reason) of every row of a new batch against the state at `path` and the batch itself: null if it is kept, else
    exact or near."""
    spark = df.sparkSession
    known = spark.read.parquet(f"{path}/exact_keys").distinct()
    seen = staged(df.select(key, text, X.exact_key(X.text_of(text)).alias("exact_key")))
    old = seen.join(known, "exact_key", "left_semi").select(key)
    fresh = staged(seen.join(known, "exact_key", "left_anti").select(key, text))
    within = near_dedup(fresh, key, text, limit, min_terms)
    long = spark.read.parquet(f"{path}/signatures").where(F.col("n_terms") >= min_terms).select(F.concat(F.lit("old:"), F.col("sig").cast("string")).alias("k"), "sig")
    mine = staged(signatures(fresh, key, text).where(F.col("n_terms") >= min_terms).select(F.concat(F.lit("new:"), F.col(key).cast("string")).alias("k"), "sig", key))
    # the old side sorts behind the new one
    close = near_pairs(mine.select("k", "sig").unionByName(long.distinct()), limit, "k").where("a like 'new:%' and b like 'old:%'").select(F.col("a").alias("k")).distinct()
    near = mine.join(close, "k", "left_semi").select(key).distinct().withColumn("_near", F.lit(True))
    verdict = within.join(near, key, "left").select(key, F.when(F.col("_near") & F.col("reason").isNull(), "near").otherwise(F.col("reason")).alias("reason"))
    return verdict.unionByName(old.select(key, F.lit("exact").alias("reason")))


def first_independent(nodes: DataFrame, pairs: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, kept): taken in order, a node is kept unless a kept node before it is its neighbour; what is dropped drops
    nothing. Rounds decide all nodes whose earlier neighbours are decided, until none is left."""
    now = staged(nodes.select("node").distinct().withColumn("kept", F.lit(None).cast("boolean")))
    edges = staged(pairs.select(F.col("b").alias("node"), F.col("a").alias("earlier")).where("node <> earlier").distinct())
    for _ in range(rounds):
        before = edges.join(now.select(F.col("node").alias("earlier"), F.col("kept").alias("was")), "earlier")
        seen = before.groupBy("node").agg(F.max(F.coalesce("was", F.lit(False))).alias("hit"), F.count_if(F.col("was").isNull()).alias("waiting"))
        verdict = F.when(F.col("hit"), False).when(F.coalesce("waiting", F.lit(0)) == 0, True)
        now = staged(now.join(seen, "node", "left").select("node", F.coalesce("kept", verdict).alias("kept")), instead_of=now)
        if now.where("kept is null").isEmpty():
            return now
    raise RuntimeError(f"not decided in {rounds} rounds")


def near_dedup(df: DataFrame, key: str = "doc_id", text: str = "text", limit: int = 3, min_terms: int = 120, by_chars: bool = False) -> DataFrame:
    """(key, reason) of every row: null if it is kept, else exact or near.

    Of rows with one exact key the first is kept. Of the rest, texts with fewer than `min_terms` terms (or characters)
    are always kept and drop nothing; longer ones are dropped if a kept longer one before them differs in at most
    `limit` bits and shares one of four bands.
    """
    first = staged(keep_first(df.select(key, text), X.exact_key(X.text_of(text)), key).select(key, text))
    sigs = staged(signatures(first, key, text).join(first.select(key, F.length(text).alias("n_chars")), key))
    long = sigs.where((F.col("n_chars") if by_chars else F.col("n_terms")) >= min_terms)
    kept = first_independent(long.select(F.col(key).alias("node")), near_pairs(long, limit, key, bands=BANDS))
    state = df.select(key).join(first.select(key, F.lit(True).alias("_first")), key, "left").join(kept.withColumnRenamed("node", key), key, "left")
    return state.select(key, F.when(F.col("_first").isNull(), "exact").when(~F.coalesce("kept", F.lit(True)), "near").alias("reason"))


def clusters(pairs: DataFrame, nodes: DataFrame, key: str = "node") -> DataFrame:
    """(node, root, cluster_id, size): single-linkage clusters of pairs; the id is a digest of the sorted members. The
    members of one cluster are collected for the digest: clusters, not the table, must fit a task."""
    edges = pairs.select("a", "b").union(nodes.select(F.col(key).alias("a"), F.col(key).alias("b")))
    roots = connected_components(edges)
    ids = roots.groupBy("root").agg(F.sha2(F.to_json(F.array_sort(F.collect_list(F.col("node").cast("string")))), 256).alias("cluster_id"), F.count("*").alias("size"))
    return roots.join(ids, "root")
