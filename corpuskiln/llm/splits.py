"""Splits that keep related records together.

Records are related by identifiers, directly or through others. Connected components are found on the graph of the
identifiers (not of the records). Components then get a split: by hash at first, then
a search by parallel annealing moves and exchanges whole components to bring sizes and labels near the fractions, and
the best assignment of all rounds is kept.
"""

from __future__ import annotations

import math
import random

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..session import staged

#: Rows of the table whose split columns relate them.
RELATIONS = ("source_document_id", "source_capture_id", "writer_id")
#: Labels whose shares each split should have.
LABELS = ("print", "handwritten_good", "handwritten_medium", "handwritten_poor")
#: Components that one annealing task handles.
BLOCK = 4000
#: Components above this share of all records are placed first, together: there are fewer than 1 / LARGE of them.
LARGE = 0.0005


def identifier(raw: Column, kind: str) -> Column:
    """The letters and digits of an identifier, behind its kind; null where it is null or has no digit."""
    bare = F.lower(F.regexp_replace(raw, r"[^\p{L}\p{Nd}]", ""))
    return F.when(bare.rlike(r"\p{Nd}"), F.concat(F.lit(f"{kind}:"), bare))


def related_groups(df: DataFrame, key: str = "sample_id", relations: tuple[str, ...] = RELATIONS) -> DataFrame:
    """(`key`, group_id) of every distinct non-null key: the smallest key of all that it is related to.

    Two records are related if they share an identifier of one kind: a null identifier, or one without a digit, relates
    nothing. A record that repeats with other identifiers joins what either names. Records without identifiers are
    groups of their own. Extra columns are not read; an empty table gives an empty table.
    """
    names = [identifier(F.col(f"`{c}`"), str(k)) for k, c in enumerate(relations)]
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).alias("_key"), F.array_compact(F.array(*names)).alias("_names"))
    rows = rows.distinct().withColumn("_ids", F.transform("_names", lambda n: F.xxhash64(n)))
    rows = staged(rows.withColumn("_first", F.try_element_at("_ids", F.lit(1))))
    # nodes are 64-bit hashes of identifiers; should two identifiers share one, they are the identifiers themselves
    named = rows.select(F.explode(F.arrays_zip("_ids", "_names")).alias("n")).groupBy("n._ids").agg(F.min("n._names").alias("low"), F.max("n._names").alias("high"))
    if not named.where("low <> high").isEmpty():
        rows = rows.withColumn("_ids", F.col("_names")).withColumn("_first", F.try_element_at("_names", F.lit(1)))
    inside = rows.where("size(_ids) > 1").select(F.col("_first").alias("a"), F.explode(F.slice("_ids", 2, len(relations))).alias("b"))
    keys = staged(rows.groupBy("_key").agg(F.min("_first").alias("a"), F.max("_first").alias("_last")))
    across = rows.join(keys.where("a <> _last").select("_key", "a"), "_key").select("a", F.col("_first").alias("b"))
    roots = connected_components(inside.union(across))
    rooted = staged(keys.select("_key", "a").join(roots, F.col("a") == F.col("node"), "left").select("_key", F.coalesce("root", "a").alias("root")))
    least = rooted.where("root is not null").groupBy("root").agg(F.min("_key").alias("_least"))
    return rooted.join(least, "root", "left").select(F.col("_key").alias(key), F.coalesce("_least", "_key").alias("group_id"))


def label_of(style: Column, difficulty: Column) -> Column:
    """The label of a record: print, or handwritten with its difficulty, in one spelling; null where it is neither."""
    style, difficulty = F.lower(F.regexp_replace(style, r"[^\p{L}]", "")), F.lower(F.trim(difficulty))
    hand = F.when((style == "handwritten") & difficulty.isin("good", "medium", "poor"), F.concat(F.lit("handwritten_"), difficulty))
    return F.when(style == "print", "print").otherwise(hand)


class _Search:
    """Annealing of the splits of some components against wanted totals by split and feature."""

    def __init__(self, features: list[list[float]], start: list[int], wanted: list[list[float]], scale: list[list[float]], seed: int):
        self.features, self.place, self.random = features, list(start), random.Random(seed)
        self.weight = [[1 / max(s, 1e-9) ** 2 for s in row] for row in scale]
        self.off = [[-w for w in row] for row in wanted]
        for item, split in zip(features, start):
            for f, x in enumerate(item):
                self.off[split][f] += x

    def cost(self) -> float:
        return sum(w * o * o for ws, os in zip(self.weight, self.off) for w, o in zip(ws, os))

    def change(self, moves: list[tuple[int, int]]) -> tuple[float, dict[int, list[float]]]:
        """By how much the cost changes if each of the components goes to its split."""
        shift: dict[int, list[float]] = {}
        for item, to in moves:
            for split, sign in ((self.place[item], -1), (to, 1)):
                row = shift.setdefault(split, [0.0] * len(self.features[item]))
                for f, x in enumerate(self.features[item]):
                    row[f] += sign * x
        delta = 0.0
        for split, row in shift.items():
            for w, o, x in zip(self.weight[split], self.off[split], row):
                delta += w * x * (2 * o + x)
        return delta, shift

    def run(self, steps: int) -> tuple[list[int], float]:
        cost = best = self.cost()
        kept, splits, n = list(self.place), len(self.off), len(self.features)
        heat = max(cost / max(n, 1), 1e-9)
        cooling = 1e-4 ** (1 / max(steps, 1))
        for _ in range(steps):
            item, to = self.random.randrange(n), self.random.randrange(splits)
            moves = [(item, to)]
            if self.random.random() < 0.5:
                other = self.random.randrange(n)
                moves = [(item, self.place[other]), (other, self.place[item])]
                to = self.place[other]
            if to != self.place[item]:
                delta, shift = self.change(moves)
                if delta < 0 or self.random.random() < math.exp(-delta / heat):
                    for split, row in shift.items():
                        self.off[split] = [o + x for o, x in zip(self.off[split], row)]
                    for item, to in moves:
                        self.place[item] = to
                    cost += delta
                    if cost < best - 1e-12:
                        best, kept = cost, list(self.place)
            heat *= cooling
        return kept, best


def _totals(table: DataFrame, features: list[str], by: str) -> dict[int, list[float]]:
    """Sums of the features by split: as many rows as there are splits."""
    rows = table.groupBy(by).agg(*(F.sum(f).cast("double").alias(f) for f in features)).collect()
    return {r[by]: [r[f] or 0.0 for f in features] for r in rows}


def assign_splits(df: DataFrame, policy: DataFrame, key: str = "sample_id", relations: tuple[str, ...] = RELATIONS, style: str = "style", difficulty: str = "difficulty", rounds: int = 2, chains: int = 2, steps_each: int = 8) -> DataFrame:
    """(`key`, group_id, split) of every distinct non-null key.

    All records of a group get one split of `policy` (split, fraction, seed: a few rows; null or non-positive fractions
    get nothing, fractions are scaled to sum to 1). Groups start where a hash of their id falls among the fractions.
    Groups above LARGE of all records are annealed first, in one task, since their number is bounded; then blocks of
    about BLOCK groups, each against its part of the deviation that is left, `chains` searches side by side. After each
    round the deviation of the whole is measured and the best assignment so far, the start included, is kept. The
    result is the same for the same rows, however they are partitioned.
    """
    fractions = [r for r in policy.select("split", F.col("fraction").cast("double"), F.col("seed").cast("long")).orderBy("split").collect() if r["fraction"] and r["fraction"] > 0]
    if not fractions:
        raise ValueError("the policy has no split with a positive fraction")
    whole = sum(r["fraction"] for r in fractions)
    shares = [r["fraction"] / whole for r in fractions]
    seed = fractions[0]["seed"] or 0

    groups = related_groups(df, key, relations)
    label = label_of(F.col(f"`{style}`"), F.col(f"`{difficulty}`"))
    labels = df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias(key)).agg(F.min(label).alias("_label"))
    members = staged(groups.join(labels, key))
    features = ["_n", *(f"_l{k}" for k in range(len(LABELS)))]
    parts = members.groupBy("group_id").agg(F.count("*").alias("_n"), *(F.count_if(F.col("_label") == name).alias(f"_l{k}") for k, name in enumerate(LABELS)))
    draw = F.pmod(F.xxhash64(F.lit(str(seed)), "group_id"), F.lit(2**53)) / 2.0**53
    start = F.lit(len(shares) - 1)
    for k in reversed(range(len(shares) - 1)):
        start = F.when(draw < sum(shares[: k + 1]), k).otherwise(start)
    parts = staged(parts.withColumn("_split", start))
    size = parts.agg(F.count("*").alias("groups"), *(F.sum(f).alias(f) for f in features)).first()
    total = [float(size[f] or 0) for f in features]
    scale = [[max(t * share, 1.0) for t in total] for share in shares]
    blocks = max(1, math.ceil(size["groups"] / BLOCK))
    huge = F.col("_n") > LARGE * total[0]
    parts = parts.withColumn("_block", F.when(huge, -1).otherwise(F.pmod(F.xxhash64("group_id", F.lit("block")), F.lit(blocks)).cast("int")))

    def deviation(table: DataFrame) -> list[list[float]]:
        now = _totals(table, features, "_split")
        return [[now.get(k, [0.0] * len(features))[f] - share * t for f, t in enumerate(total)] for k, share in enumerate(shares)]

    cost = lambda off: sum((o / s) ** 2 for os, ss in zip(off, scale) for o, s in zip(os, ss))

    def annealed(table: DataFrame, only: Column, off: list[list[float]], turn: int) -> DataFrame:
        """The components of the blocks `only`, with their splits after the search."""
        chosen = table.where(only)
        weight = chosen.agg(F.sum("_n")).first()[0] or 0
        if not weight:
            return table

        def search(block: pd.DataFrame) -> pd.DataFrame:
            block = block.sort_values("group_id")
            items = block[features].astype(float).values.tolist()
            part = block["_n"].sum() / weight
            at = block["_split"].tolist()
            held = [[0.0] * len(features) for _ in shares]
            for item, split in zip(items, at):
                for f, x in enumerate(item):
                    held[split][f] += x
            wanted = [[h - part * o for h, o in zip(hs, os)] for hs, os in zip(held, off)]
            # the more of the whole a block is, the finer its totals must be; all blocks are weighed alike otherwise
            runs = [_Search(items, at, wanted, scale, hash((seed, turn, chain)) & 0x7FFFFFFF).run(steps_each * len(items) + 2000) for chain in range(chains)]
            return pd.DataFrame({"group_id": block["group_id"], "_new": min(runs, key=lambda r: r[1])[0]})

        # a number of partitions of our own: small blocks would else be put into few tasks, and annealing is CPU
        slices = min(blocks, 4 * table.sparkSession.sparkContext.defaultParallelism)
        found = chosen.repartition(slices, "_block").groupBy("_block").applyInPandas(search, "group_id string, _new int")
        return staged(table.join(found, "group_id", "left").withColumn("_split", F.coalesce("_new", "_split")).drop("_new"))

    off = deviation(parts)
    best, best_cost, now = parts, cost(off), parts
    for turn in range(rounds):
        for only in (F.col("_block") == -1, F.col("_block") >= 0):
            now = annealed(now, only, off, turn)
            off = deviation(now)
            if cost(off) < best_cost:
                best, best_cost = now, cost(off)
    names = F.array(*(F.lit(r["split"]) for r in fractions))
    return members.join(best.select("group_id", names[F.col("_split")].alias("split")), "group_id").select(key, "group_id", "split")


def split_report(assigned: DataFrame, policy: DataFrame) -> DataFrame:
    """Rows of each split of the policy, their share and the share asked for; a split without rows has 0."""
    counts = assigned.groupBy("split").agg(F.count("*").alias("n_rows"), F.countDistinct("group_id").alias("n_groups"))
    joined = policy.select("split", "fraction").join(counts, "split", "left").na.fill(0, ["n_rows", "n_groups"])
    return joined.withColumn("share", F.col("n_rows") / F.sum("n_rows").over(Window.partitionBy(F.lit(0))))
