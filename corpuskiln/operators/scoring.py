"""Scoring of transcriptions: edit distances over characters, graphemes and words, alignments, error rates, bootstrap.

Spark's own levenshtein works on code points in the JVM. Sequences of graphemes or words are first written as strings of
one private character for each different unit of the pair, so the same function serves them.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as X


def as_symbols(units: Column, known: Column) -> Column:
    """Units written as one character each: the place of the unit among the distinct units of the pair."""
    return F.array_join(F.transform(units, lambda u: F.decode(F.unhex(F.lpad(F.hex(F.array_position(known, u) + 0x4E00), 4, "0")), "UTF-16BE")), "")


def unit_distance(a: str, b: str, known: str) -> Column:
    """Edit distance of two columns of string arrays; `known` is the column of their distinct units, fewer than 20,000: a
    pair with more raises. All three are columns, not expressions, which a lambda would evaluate for every unit."""
    k = F.col(known)
    return F.when(F.size(k) < 20_000, F.levenshtein(as_symbols(F.col(a), k), as_symbols(F.col(b), k))).otherwise(F.raise_error(F.lit("too many distinct units")).cast("int"))


def char_distance(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b)


def align(pred: str, ref: str) -> list[tuple[str, str | None, str | None]]:
    """A minimal alignment (operation, reference, prediction); among equal costs the back-trace takes a match first, then
    a substitution, a deletion, an insertion."""
    p, r = np.array(list(pred) or [""], object)[: len(pred)], list(ref)
    table = np.zeros((len(r) + 1, len(p) + 1), np.int32)
    table[0] = np.arange(len(p) + 1)
    offsets = np.arange(len(p) + 1)
    for i, c in enumerate(r, 1):
        step = np.minimum(table[i - 1][1:] + 1, table[i - 1][:-1] + (p != c)) if len(p) else np.zeros(0, np.int32)
        # insertions run along the row: a running minimum of the values less their place
        table[i] = np.minimum.accumulate(np.concatenate([[i], step]) - offsets) + offsets
    i, j, steps = len(r), len(p), []
    while i or j:
        here = table[i][j]
        if i and j and r[i - 1] == p[j - 1] and here == table[i - 1][j - 1]:
            i, j = i - 1, j - 1
            steps.append(("match", r[i], p[j]))
        elif i and j and here == table[i - 1][j - 1] + 1:
            i, j = i - 1, j - 1
            steps.append(("substitution", r[i], p[j]))
        elif i and here == table[i - 1][j] + 1:
            i -= 1
            steps.append(("deletion", r[i], None))
        else:
            j -= 1
            steps.append(("insertion", None, p[j]))
    return steps[::-1]


def alignments(df: DataFrame, key: str, pred: str, ref: str) -> DataFrame:
    """(key, at, op, ref_char, pred_char) of every row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, n, *step) for k, p, r in zip(batch[key], batch[pred], batch[ref]) for n, step in enumerate(align(p or "", r or ""))]
            yield pd.DataFrame(rows, columns=[key, "at", "op", "ref_char", "pred_char"])

    return df.select(key, pred, ref).mapInPandas(run, f"{key} {df.schema[key].dataType.simpleString()}, at int, op string, ref_char string, pred_char string")


def symbol_class(char: Column) -> Column:
    """The class of a symbol that is counted on its own, null for letters and the rest."""
    return (
        F.when(char.rlike(r"[\x{180b}-\x{180d}\x{180f}]"), "fvs").when(char == P.VOWEL_SEPARATOR, "mvs").when(char == P.NARROW_SPACE, "nnbsp")
        .when(char.rlike(r"\p{Nd}"), "digit").when(char.rlike(r"\p{P}"), "punctuation")
    )


def symbol_confusions(aligned: DataFrame) -> DataFrame:
    """Counts by symbol class: in the reference, in the prediction, correct, substituted, deleted, inserted. What another
    class is read as counts as an insertion there."""
    both = aligned.withColumn("rc", symbol_class(F.col("ref_char"))).withColumn("pc", symbol_class(F.col("pred_char")))
    sides = F.array(F.struct(F.col("rc").alias("c"), F.lit("ref").alias("side")), F.struct(F.col("pc").alias("c"), F.lit("pred").alias("side")))
    rows = both.select("op", "rc", "pc", F.explode(sides).alias("s")).where("s.c is not null")
    ref, other = F.col("s.side") == "ref", ~F.col("rc").eqNullSafe(F.col("pc"))
    return rows.groupBy(F.col("s.c").alias("symbol")).agg(
        F.count_if(ref).alias("n_ref"), F.count_if(~ref).alias("n_pred"), F.count_if(ref & (F.col("op") == "match")).alias("correct"),
        F.count_if(ref & (F.col("op") == "substitution")).alias("substitutions"), F.count_if(ref & (F.col("op") == "deletion")).alias("deletions"),
        F.count_if(~ref & ((F.col("op") == "insertion") | ((F.col("op") == "substitution") & other))).alias("insertions"),
    )


def error_rates(pairs: DataFrame, by: list[str], pred: str = "pred", ref: str = "ref") -> DataFrame:
    """Micro-averaged error rates of characters, graphemes and words by group, plain and nominally folded, and exact
    matches. Each row weighs at least one unit, so insertions against nothing count."""
    texts = pairs.select(*by, X.text_of(pred).alias("p"), X.text_of(ref).alias("r"))
    texts = texts.withColumns({"fp": X.nominal_fold(F.col("p")), "fr": X.nominal_fold(F.col("r"))})
    units = texts.withColumns({"gp": X.graphemes(F.col("p")), "gr": X.graphemes(F.col("r")), "wp": X.found(F.col("fp"), P.WORD), "wr": X.found(F.col("fr"), P.WORD)})
    known = units.withColumns({"gk": F.array_distinct(F.concat("gp", "gr")), "wk": F.array_distinct(F.concat("wp", "wr"))})
    rows = known.select(
        *by, char_distance(F.col("p"), F.col("r")).alias("cd"), F.greatest(F.length("r"), F.lit(1)).alias("cl"), char_distance(F.col("fp"), F.col("fr")).alias("fd"), F.greatest(F.length("fr"), F.lit(1)).alias("fl"),
        unit_distance("gp", "gr", "gk").alias("gd"), F.greatest(F.size("gr"), F.lit(1)).alias("gl"),
        unit_distance("wp", "wr", "wk").alias("wd"), F.greatest(F.size("wr"), F.lit(1)).alias("wl"), (F.col("p") == F.col("r")).alias("raw"), (F.col("fp") == F.col("fr")).alias("folded"),
    )
    rate = lambda d, n, name: F.round(F.sum(d) / F.sum(n), 6).alias(name)
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"), rate("cd", "cl", "cer"), rate("fd", "fl", "folded_cer"), rate("gd", "gl", "grapheme_cer"), rate("wd", "wl", "wer"),
        F.count_if("raw").alias("exact"), F.count_if("folded").alias("folded_exact"),
    )


def script_rates(pairs: DataFrame, key: str, pred: str = "pred", ref: str = "ref") -> DataFrame:
    """Error rate by script, by projection: each side keeps only its graphemes of the script. Scripts without reference
    have no row."""
    kinds = {"mn": f"^[{P.SCRIPTS['mn']}]", "cjk": f"^[{P.SCRIPTS['cjk']}]", "latin": f"^[{P.SCRIPTS['latin']}]"}

    def script(c: Column) -> Column:
        result = F.when(c.rlike(kinds["mn"]), "mn")
        for name in ("cjk", "latin"):
            result = result.when(c.rlike(kinds[name]), name)
        return result.otherwise("other")

    units = pairs.select(key, X.graphemes(X.nominal_fold(X.text_of(pred))).alias("p"), X.graphemes(X.nominal_fold(X.text_of(ref))).alias("r"))
    buckets = F.explode(F.array(*map(F.lit, ("mn", "cjk", "latin", "other")))).alias("bucket")
    projected = units.select("p", "r", buckets).select("bucket", F.filter("p", lambda c: script(c) == F.col("bucket")).alias("p"), F.filter("r", lambda c: script(c) == F.col("bucket")).alias("r"))
    known = projected.withColumn("k", F.array_distinct(F.concat("p", "r")))
    scored = known.select("bucket", unit_distance("p", "r", "k").alias("d"), F.size("r").alias("n"))
    return scored.groupBy("bucket").agg(F.round(F.sum("d") / F.sum(F.greatest("n", F.lit(1))), 6).alias("cer"), F.sum("n").alias("n_ref")).where("n_ref > 0")


def lcg_jumps(count: int) -> tuple[np.ndarray, np.ndarray]:
    """Factor and summand that take the state of the 64-bit congruential generator 1 to `count` steps on."""
    factor = np.full(count, 6_364_136_223_846_793_005, np.uint64).cumprod(dtype=np.uint64)
    sums = np.concatenate([np.ones(1, np.uint64), factor[:-1]]).cumsum(dtype=np.uint64)
    return factor, sums * np.uint64(1_442_695_040_888_963_407)


def lcg_draws(seed_text: str, jumps: tuple[np.ndarray, np.ndarray], size: int) -> np.ndarray:
    """Indices below `size` of the generator seeded by a digest, one for each jump."""
    state = np.uint64(int(hashlib.sha256(seed_text.encode()).hexdigest()[:16], 16))
    return ((jumps[0] * state + jumps[1]) % np.uint64(size)).astype(np.int64)


def paired_bootstrap(spark, rows: dict[str, np.ndarray], weights: dict[str, float], resamples: int = 2000, seed: int = 42) -> DataFrame:
    """(resample, delta): weighted differences of ratios of sums over resampled rows. `rows` holds for each bucket the
    columns left errors, right errors, units: a test set, small by nature, so resamples and not rows are distributed."""
    held = spark.sparkContext.broadcast({b: np.asarray(v, np.int64) for b, v in rows.items()})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        jumps = {b: lcg_jumps(len(v)) for b, v in held.value.items()}
        for batch in batches:
            deltas = []
            for resample in batch["resample"]:
                total = 0.0
                for bucket, values in held.value.items():
                    text = json.dumps({"bucket": bucket, "resample": int(resample), "schema_version": 1, "seed": seed}, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
                    left, right, units = values[lcg_draws(text, jumps[bucket], len(values))].sum(axis=0)
                    total += weights[bucket] * (left / units - right / units)
                deltas.append(total)
            yield pd.DataFrame({"resample": batch["resample"], "delta": deltas})

    return spark.range(resamples).withColumnRenamed("id", "resample").mapInPandas(run, "resample long, delta double")


def mean_intervals(rows: DataFrame, by: str, value: str, resamples: int = 2000, seed: int = 42) -> DataFrame:
    """(by, n, mean, low, high): the mean of each group and its bootstrap interval. The values are counted first; a task
    holds the distinct values of one group, not its rows, and draws counts of them. The ends are the resampled means at
    the places int(0.025 R) - 1 and int(0.975 R) - 1."""
    counted = rows.where(F.col(value).isNotNull()).groupBy(by, F.col(value).cast("double").alias("v")).agg(F.count("*").alias("c"))

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("v")
        values, counts = group["v"].to_numpy(), group["c"].to_numpy()
        n, name = int(counts.sum()), group[by].iloc[0]
        drawn = np.random.default_rng([seed, int(hashlib.sha256(str(name).encode()).hexdigest()[:8], 16)])
        means = np.sort([drawn.multinomial(n, counts / n) @ values / n for _ in range(resamples)])
        low, high = (means[max(int(q * resamples) - 1, 0)] for q in (0.025, 0.975))
        return pd.DataFrame({by: [name], "n": [n], "mean": [counts @ values / n], "low": [low], "high": [high]})

    return counted.groupBy(by).applyInPandas(fold, f"{by} {rows.schema[by].dataType.simpleString()}, n long, mean double, low double, high double")
