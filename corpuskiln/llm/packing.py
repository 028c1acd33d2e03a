"""Filling of bins of fixed capacity with whole texts, in the proportions of a mixture.

Every text is an item of as many tokens as it has; only an item above the capacity is cut, into full bins and a rest.
Items are spread over packing partitions by hash; a partition holds a queue for each source. Bins are filled by deficit
round-robin. A source has a deficit while it has given fewer tokens than its pace, and in every bin a quantum, its target
share of the capacity; the sources with the largest sum of both give an item each, of a size that fits their deficit, and
the rest of the room is filled by best fit. As every item is placed, no bin order can give a source more than it holds: its
pace is its share of the partition's tokens, so that scarce sources last to the last bin instead of filling the first ones
only. Deficits go from bin to bin, and from partition to partition: what the partitions before one leave over follows from
their totals by a prefix sum, without waiting. How far bins are from the target, and how far all tokens together are, is
in the report.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import staged
from .bpe import DEFAULT_TOKENIZER
from .encode import count_tokens

#: Items of a packing partition, on average.
PART_ITEMS = 20_000
#: Sources at most: their shares are known to every task.
SOURCES = 10_000
#: Kinds of bins at most.
KINDS = 1000
#: Sizes that the best fit looks at, and a quarter of the sources that a bin looks at.
LOOK = 16
#: Share of a bin that is left to the best fit.
SPARE = 0.1


class Queues:
    """Items of one partition by source, each queue in the order of size, and the bins they are filled into.

    A source is due once it has given less than its pace, the share of the partition's tokens that it holds; so every
    source lasts to the last bin, and none runs ahead of it. `carried` are tokens by which sources are behind when the
    partition starts; they count up to the pace of one bin, so that no source takes the first bins for itself.
    """

    def __init__(self, target: dict[str, float], carried: dict[str, float], capacity: int):
        self.target, self.carried, self.capacity = target, carried, capacity
        self.sizes: list[int] = []
        self.holders: dict[int, dict[str, list]] = {}
        self.of_source: dict[str, list[int]] = {}
        self.held: dict[str, int] = {}
        self.given: dict[str, float] = {}

    def put(self, source: str, size: int, item) -> None:
        holders = self.holders.get(size)
        if holders is None:
            holders = self.holders[size] = {}
            insort(self.sizes, size)
        if source not in holders:
            holders[source] = []
            insort(self.of_source.setdefault(source, []), size)
        holders[source].append(item)
        self.held[source] = self.held.get(source, 0) + size

    def _take(self, source: str, size: int, chosen: list[tuple]) -> None:
        holders = self.holders[size]
        chosen.append((holders[source].pop(), size))
        self.given[source] += size
        if not holders[source]:
            del holders[source]
            sizes = self.of_source[source]
            del sizes[bisect_left(sizes, size)]
            if not holders:
                del self.holders[size], self.sizes[bisect_left(self.sizes, size)]

    def _best_fit(self, room: int, present: set[str]) -> tuple[str, int] | None:
        """A source with the largest item that fits; of the few largest sizes one of a source that is not present, if its
        item fills most of the room."""
        at = bisect_right(self.sizes, room)
        if not at:
            return None
        for size in reversed(self.sizes[max(0, at - LOOK) : at]):
            if size < 0.8 * room:
                break
            for source in self.holders[size]:
                if source not in present:
                    return source, size
        size = self.sizes[at - 1]
        return min(islice(self.holders[size], LOOK), key=lambda s: self.given[s] / self.held[s]), size

    def bins(self) -> Iterator[list[tuple]]:
        """The bins in order, each as its (item, size)."""
        whole = sum(self.held.values())
        pace = {s: n / whole for s, n in self.held.items()}
        limit = {s: pace[s] * self.capacity for s in pace}
        self.given = {s: -min(max(self.carried.get(s, 0.0), -limit[s]), limit[s]) for s in pace}
        due = [(self.given[s] / pace[s], s) for s in pace]
        heapq.heapify(due)
        now = 0.0
        while self.sizes:
            now += min(self.capacity, whole)
            room, chosen, present = self.capacity, [], set()
            # the largest item of all opens the bin: what is large finds no room later
            size = self.sizes[-1]
            source = max(self.holders[size], key=lambda s: (now - self.given[s] / pace[s], s))
            self._take(source, size, chosen)
            room -= size
            present.add(source)
            # then the sources that are due, in the order of their deficit and their quantum of this bin: an item of each that
            # is not present, then further items of those that still have a deficit
            waiting = []
            while due and len(waiting) < LOOK * 4 and due[0][0] < now:
                at, source = heapq.heappop(due)
                if at < self.given[source] / pace[source]:
                    if self.of_source[source]:
                        heapq.heappush(due, (self.given[source] / pace[source], source))
                elif self.of_source[source]:
                    waiting.append(source)
            waiting.sort(key=lambda s: (-(now * pace[s] - self.given[s]) - self.target.get(s, 0.0) * self.capacity, s))
            given = True
            while given and room > SPARE * self.capacity:
                given, first = False, present.copy()
                for source in waiting:
                    sizes, credit = self.of_source[source], now * pace[source] - self.given[source]
                    if source in first and (credit <= 0 or len(first) < len(present)) or not sizes or sizes[0] > room:
                        continue
                    size = sizes[max(bisect_right(sizes, min(room, credit)) - 1, 0)]
                    self._take(source, size, chosen)
                    room -= size
                    present.add(source)
                    given = True
                    if room <= SPARE * self.capacity:
                        break
            while room > 0 and (found := self._best_fit(room, present)):
                self._take(*found, chosen)
                room -= found[1]
                present.add(found[0])
            for source in waiting:
                if self.of_source[source]:
                    heapq.heappush(due, (self.given[source] / pace[source], source))
            yield chosen


def _target(per_source: DataFrame, sources: DataFrame | None) -> DataFrame:
    """(source, n, share): tokens and target share of each source, of `per_source` (source, n)."""
    if sources is None:
        weighed = per_source.withColumn("w", F.col("n").cast("double"))
    else:
        weights = sources.where("source is not null").groupBy("source").agg(F.max(F.coalesce("weight", F.lit(1.0))).alias("w"))
        weighed = per_source.join(weights, "source", "left").na.fill(0.0, ["w"])
    # as many rows as there are sources
    whole = F.sum("w").over(Window.partitionBy(F.lit(0)))
    return weighed.select("source", "n", F.when(whole > 0, F.col("w") / whole).otherwise(1 / F.count("*").over(Window.partitionBy(F.lit(0)))).alias("share"))


def _bounded(df: DataFrame, limit: int, what: str) -> list:
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} {what}")
    return rows


def pack_documents(documents: DataFrame, bins: DataFrame, sources: DataFrame | None = None, key: str = "doc_id", tokenizer: str = DEFAULT_TOKENIZER, part_items: int = PART_ITEMS) -> DataFrame:
    """Where every text lies in the bins of every kind: (bin_kind, capacity, part, bin, `key`, source, first_token,
    n_tokens).

    `bins` has (bin_kind, capacity_tokens), more than KINDS rows raise; null and non-positive capacities are left out and
    a repeated kind counts once, with its largest capacity. The target shares of the sources are the weights of `sources`
    (null is 1, a source without a row has 0) or, without it, their shares of the tokens. A text is whole, with
    first_token 0, unless it alone exceeds the capacity: then it is cut into full bins of its own and a rest that shares a
    bin. Texts without tokens (null, empty) take no room and are in no bin. Repeated rows and rows with a null key are
    packed each, documents without a source as one source. An empty table gives an empty result.
    """
    wanted = bins.where("bin_kind is not null and capacity_tokens > 0").groupBy("bin_kind").agg(F.max("capacity_tokens").alias("capacity_tokens"))
    kinds = {r["bin_kind"]: r["capacity_tokens"] for r in _bounded(wanted, KINDS, "bin kinds")}
    if not kinds:
        raise ValueError("no bins")
    counted = count_tokens(documents, keep=(key, "source"), tokenizer=tokenizer).where("n_tokens > 0")
    counted = staged(counted.select(F.col(key).cast("string").alias("_key"), F.coalesce("source", F.lit("")).alias("source"), "n_tokens"))
    parts = max(1, math.ceil(counted.count() / part_items))
    items = counted.withColumn("part", F.pmod(F.xxhash64("_key"), F.lit(parts)).cast("int"))

    totals = items.groupBy("part", "source").agg(F.sum("n_tokens").alias("n"))
    # one row for each source, a bounded number
    known = _bounded(_target(totals.groupBy("source").agg(F.sum("n").alias("n")), sources), SOURCES, "sources")
    if not known:
        schema = f"bin_kind string, capacity int, part int, bin int, {key} {documents.schema[key].dataType.simpleString()}, source string, first_token long, n_tokens long"
        return documents.sparkSession.createDataFrame([], schema)
    target = {r["source"]: r["share"] for r in known}
    supply = F.broadcast(documents.sparkSession.createDataFrame([(r["source"], r["n"] / sum(k["n"] for k in known)) for r in known], "source string, supply double"))
    kind_names = F.array(*(F.struct(F.lit(k).alias("bin_kind"), F.lit(int(c)).alias("capacity")) for k, c in kinds.items()))
    # what each source of a partition is behind by when it starts: its share of all tokens before, less its own; only
    # pairs of partition and source that occur have a row, and the totals of the partitions, one number each, one window
    ahead = lambda *by: Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.groupBy("part").agg(F.sum("n").alias("_all")).select("part", F.coalesce(F.sum("_all").over(ahead(F.lit(0))), F.lit(0)).alias("_before"))
    own = totals.withColumn("_own", F.coalesce(F.sum("n").over(ahead("source")), F.lit(0)))
    owed = own.join(before, "part").join(supply, "source").select(F.col("part").alias("owed_part"), F.col("source").alias("owed_source"), (F.col("supply") * F.col("_before") - F.col("_own")).alias("behind"), F.explode(kind_names).alias("b"))
    owed = owed.select(F.col("b.bin_kind").alias("owed_kind"), "owed_part", "owed_source", "behind")
    spreaded = items.select("part", "_key", "source", "n_tokens", F.explode(kind_names).alias("b")).select("b.bin_kind", "part", "_key", "source", "n_tokens")
    schema = f"bin_kind string, capacity int, part int, bin int, {key} string, source string, first_token long, n_tokens long"

    def pack(group: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        kind, part = start.iloc[0]["owed_kind"], int(start.iloc[0]["owed_part"])
        capacity = int(kinds[kind])
        queues = Queues(target, dict(zip(start["owed_source"], start["behind"])), capacity)
        rows, number = [], 0
        group = group.sort_values("_key", kind="stable")
        for item, source, size in zip(group["_key"].tolist(), group["source"].tolist(), group["n_tokens"].tolist()):
            at = 0
            while size - at > capacity:
                rows.append((number, item, source, at, capacity))
                number, at = number + 1, at + capacity
            queues.put(source, size - at, (item, source, at))
        for chosen in queues.bins():
            rows.extend((number, item, source, at, size) for (item, source, at), size in chosen)
            number += 1
        out = pd.DataFrame(rows, columns=["bin", key, "source", "first_token", "n_tokens"])
        return out.assign(bin_kind=kind, capacity=capacity, part=part)[["bin_kind", "capacity", "part", "bin", key, "source", "first_token", "n_tokens"]]

    packed = spreaded.groupBy("bin_kind", "part").cogroup(owed.groupBy("owed_kind", "owed_part")).applyInPandas(pack, schema)
    return packed.withColumn("source", F.when(F.col("source") != "", F.col("source"))).withColumn(key, F.col(key).cast(documents.schema[key].dataType))


def packing_report(packed: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """Of every kind: n_bins, n_tokens, unused (the share of room), deviation (the mean over bins of the total variation
    between the shares of its sources and the target), supply_deviation (the same between all tokens and the target: no
    packing of all items has a mean below it) and single_source (the share of bins with one source)."""
    packed = staged(packed.withColumn("source", F.coalesce("source", F.lit(""))).groupBy("bin_kind", "capacity", "part", "bin", "source").agg(F.sum("n_tokens").alias("n")))
    by_kind = packed.groupBy("bin_kind", "source").agg(F.sum("n").alias("n"))
    shares = _target(by_kind.groupBy("source").agg(F.max("n").alias("n")), sources).select("source", "share")
    _bounded(shares, SOURCES, "sources")
    joined = packed.join(F.broadcast(shares), "source")
    whole = F.sum("n").over(Window.partitionBy("bin_kind", "part", "bin"))
    bins = joined.withColumn("_near", F.least(F.col("n") / whole, "share")).groupBy("bin_kind", "capacity", "part", "bin").agg(F.sum("n").alias("n"), F.sum("_near").alias("near"), F.count("*").alias("k"))
    result = bins.groupBy("bin_kind", "capacity").agg(
        F.count("*").alias("n_bins"), F.sum("n").alias("n_tokens"), (1 - F.sum("n") / (F.count("*") * F.first("capacity"))).alias("unused"), (1 - F.avg("near")).alias("deviation"), (F.count_if(F.col("k") == 1) / F.count("*")).alias("single_source"),
    )
    total = F.sum("n").over(Window.partitionBy("bin_kind"))
    least = by_kind.join(F.broadcast(shares), "source").withColumn("_near", F.least(F.col("n") / total, "share")).groupBy("bin_kind").agg((1 - F.sum("_near")).alias("supply_deviation"))
    return result.join(least, "bin_kind")


def packed_sources(packed: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """Of every kind and source: n_tokens, share (of all tokens placed), target_share, and n_bins that hold it."""
    counted = packed.groupBy("bin_kind", F.coalesce("source", F.lit("")).alias("source"), "part", "bin").agg(F.sum("n_tokens").alias("n")).groupBy("bin_kind", "source").agg(F.sum("n").alias("n_tokens"), F.count("*").alias("n_bins"))
    counted = staged(counted)
    shares = _target(counted.groupBy("source").agg(F.max("n_tokens").alias("n")), sources).select("source", F.col("share").alias("target_share"))
    joined = counted.join(shares, "source")
    return joined.select("bin_kind", F.when(F.col("source") != "", F.col("source")).alias("source"), "n_tokens", (F.col("n_tokens") / F.sum("n_tokens").over(Window.partitionBy("bin_kind"))).alias("share"), "target_share", "n_bins")
