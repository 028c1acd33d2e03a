"""Mixing of sources to target weights by entropy balancing.

Each source asks for a number of tokens; each unit (a document, or a whole source of a planned run) gets a rate, how
often it is repeated on average, between 0 and the cap. Of all rates that give every source its tokens the closest to 1
(in relative entropy) are exponentially tilted: rate = exp(lambda * size / mean size), cut at the cap. The dual is convex
and one lambda for each source solves it: Newton steps on the logarithm of the tokens, guarded by a bracket, run as
aggregations over all units at once. They start where equal rates would meet the target, which is the solution where all
units of a source are of one size, as a planned source is. Units of one source and size are exchangeable and are counted together first, so a
step reads sizes, not documents. A source whose target is more than the cap times its size has no solution: its dual
is unbounded. The steps then drive all its rates to the cap while the target stays ahead; it is reported as exhausted.
Rates are rounded to copies systematically along the sizes of a source, so that its tokens miss the target by about one
document. What exhausted sources leave of the budget is handed to the others in proportion to their weights.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import staged
from .bpe import DEFAULT_TOKENIZER
from .encode import count_tokens

#: Repetitions of a record at most, where nothing else is said.
MAX_EPOCHS = 4.0
#: Relative gap between tokens and target at which a source is solved at once, and at the end of the bracket.
TOLERANCE, LOOSE = 1e-9, 1e-6
#: Sources of a manifest at most: their weights and sizes are known to the driver.
SOURCES = 10_000
#: Documents of a source whose rounding is one stretch.
STRETCH = 500_000


def measured_size() -> Column:
    """Tokens of a source by its measurements: characters times the sampled tokens per character, the sampled tokens
    where no character was sampled, null where a measured figure is null."""
    per_char = F.when(F.col("sampled_chars") == 0, F.col("sampled_tokens").cast("double")).otherwise(F.col("chars").cast("double") * F.col("sampled_tokens") / F.when(F.col("sampled_chars") != 0, F.col("sampled_chars")))
    return F.when(F.col("chars").isNotNull() & F.col("sampled_chars").isNotNull() & F.col("sampled_tokens").isNotNull(), per_char)


def once(stats: DataFrame) -> DataFrame:
    """One row for each (run_id, source), the last received where a row was delivered more than once."""
    rest = [c for c in stats.columns if c not in ("run_id", "source")]
    last = stats.groupBy("run_id", "source").agg(F.max_by(F.struct(*rest), F.coalesce(F.col("received_at"), F.lit("1900-01-01").cast("timestamp_ntz"))).alias("_row"))
    return last.select("run_id", "source", *(F.col(f"_row.{c}").alias(c) for c in rest))


def balance(units: DataFrame, asked: DataFrame, keys: list[str], rounds: int = 80) -> DataFrame:
    """The dual solution of every source of `asked` (`keys`, target, cap), for `units` (`keys`, size).

    Columns: keys, target, cap, available (tokens of its units), n_units, mean (size), lam, gap, state: `solved`,
    `exhausted` (the target is above the cap times what is available: all rates are the cap), `full` (it is just that much:
    they are the cap too), `empty` (nothing is asked) or `unsolved` (not within LOOSE of the target after all rounds). `gap` is the expected tokens over the target, less 1.
    Units of unknown sources, null sizes and sizes not above 0 count for nothing; a null target is 0.
    """
    held = staged(units.where("size > 0").groupBy(*keys, "size").agg(F.count("*").alias("n")))
    sums = held.groupBy(*keys).agg(F.sum(F.col("n") * F.col("size")).alias("available"), F.sum("n").alias("n_units"))
    reach = F.col("cap") * F.col("available")
    start = asked.withColumn("target", F.coalesce("target", F.lit(0.0))).join(sums, keys, "left").na.fill(0.0, ["available"]).na.fill(0, ["n_units"])
    start = start.withColumn("mean", F.when(F.col("n_units") > 0, F.col("available") / F.col("n_units")))
    state = F.when(F.col("target") <= 0, "empty").when(F.col("n_units") == 0, "exhausted").when((F.col("target") <= reach) & (F.col("target") >= reach * (1 - 1e-12)), "full").otherwise("open")
    start = start.withColumn("state", state).withColumn("lam", F.when(F.col("state") == "open", F.log(F.col("target") / F.col("available")))).withColumn("gap", F.when(F.col("state") == "exhausted", -1.0).when(F.col("state") == "full", 0.0))
    now = staged(start.withColumn("lo", F.lit(-1e6)).withColumn("hi", F.lit(1e6)))
    rate = tilted(F.col("lam"), F.col("size"), F.col("mean"), F.col("cap"))
    target = F.col("target")
    for _ in range(rounds):
        at_work = now.where("state = 'open'")
        if at_work.isEmpty():
            break
        tokens = F.col("n") * F.col("size") * rate
        free = F.when(rate < F.col("cap"), tokens * F.col("size") / F.col("mean")).otherwise(0.0)
        step = held.join(at_work.select(*keys, "lam", "mean", "cap"), keys).groupBy(*keys).agg(F.sum(tokens).alias("_f"), F.sum(free).alias("_slope"))
        lo = F.when(F.col("_f") < target, F.col("lam")).otherwise(F.col("lo"))
        hi = F.when(F.col("_f") > target, F.col("lam")).otherwise(F.col("hi"))
        newton = F.col("lam") - (F.log("_f") - F.log(target)) * F.col("_f") / F.when(F.col("_slope") > 0, F.col("_slope"))
        middle = (F.col("_lo") + F.col("_hi")) / 2
        moved = now.join(step, keys, "left").withColumn("_lo", lo).withColumn("_hi", hi).withColumn("gap", F.when(F.col("state") == "open", F.col("_f") / target - 1).otherwise(F.col("gap")))
        near, closed = F.abs("gap") <= TOLERANCE, F.col("_hi") - F.col("_lo") < 1e-14
        # every rate is at the cap and the target is still ahead: the dual grows without bound. The comparison with the
        # reach tells a target that is met by the last digit from one that is not
        at_cap = (F.col("_slope") == 0) & (F.col("gap") < 0)
        after = F.when(near | at_cap | closed, F.when(target > reach, "exhausted").when(near | at_cap | (F.abs("gap") <= LOOSE), "solved").otherwise("unsolved")).otherwise("open")
        moved = moved.withColumn("_after", F.when(F.col("state") == "open", after).otherwise(F.col("state")))
        inside = (newton > F.col("_lo")) & (newton < F.col("_hi"))
        lam = F.when(F.col("_after") != "open", F.col("lam")).when(F.coalesce(inside, F.lit(False)), newton).otherwise(middle)
        moved = moved.withColumn("lam", lam).withColumn("state", F.col("_after"))
        now = staged(moved.withColumn("lo", F.col("_lo")).withColumn("hi", F.col("_hi")).select(*now.columns), instead_of=now)
    rest = F.when((F.col("state") == "open") & (F.abs("gap") <= LOOSE), "solved").when(F.col("state") == "open", "unsolved").otherwise(F.col("state"))
    return now.withColumn("state", rest).drop("lo", "hi")


def tilted(lam: Column, size: Column, mean: Column, cap: Column) -> Column:
    return F.least(cap, F.exp(F.least(lam * size / mean, F.lit(700.0))))


def rate_of(size: Column) -> Column:
    """The rate of a unit next to the solution of its source."""
    return F.when(F.col("state").isin("exhausted", "full"), F.col("cap")).when(F.col("state") == "empty", 0.0).when(size > 0, tilted(F.col("lam"), size, F.col("mean"), F.col("cap"))).otherwise(F.least(F.lit(1.0), F.col("cap")))


def plan_runs(stats: DataFrame, runs: DataFrame) -> DataFrame:
    """The plan of every (run_id, source): size, target_tokens, repeat_factor (the rate), emit_prob (the chance of each of
    ceil(repeat_factor) copies), planned_tokens, and exhausted, whether the target is beyond the cap.

    A row delivered twice counts once. The size is the measured one, or est_tokens where a measured figure is null; a
    source without either has size null, weighs like any other and can give nothing, but is not called exhausted. A
    null weight is 1; a null cap, or a run that is not in `runs`, has MAX_EPOCHS; total_tokens of null or 0 is the sum
    of the run's sizes. If all weights of a run are 0, its targets are 0. Rows without run or source have no plan.
    """
    known = once(stats).where("run_id is not null and source is not null").select("run_id", "source", F.coalesce("weight", F.lit(1.0)).alias("weight"), F.coalesce(measured_size(), F.col("est_tokens").cast("double")).alias("size"))
    whole = known.groupBy("run_id").agg(F.sum("weight").alias("_weights"), F.sum("size").alias("_sizes"))
    settings = runs.groupBy("run_id").agg(F.first("total_tokens", True).alias("total_tokens"), F.first("max_epochs", True).alias("max_epochs"))
    budget = F.when(F.coalesce("total_tokens", F.lit(0)) == 0, F.col("_sizes")).otherwise(F.col("total_tokens").cast("double"))
    share = F.when(F.col("_weights") > 0, F.col("weight") / F.col("_weights")).otherwise(0.0)
    asked = known.join(whole, "run_id").join(settings, "run_id", "left").select("run_id", "source", "size", (share * budget).alias("target"), F.coalesce("max_epochs", F.lit(MAX_EPOCHS)).alias("cap"))
    asked = staged(asked)
    keys = ["run_id", "source"]
    solved = balance(asked.select(*keys, "size"), asked.select(*keys, "target", "cap"), keys)
    rate = F.coalesce(rate_of(F.col("size")), F.lit(0.0))
    rate = F.when(F.coalesce("size", F.lit(0.0)) > 0, rate).otherwise(0.0)
    joined = asked.select(*keys, "size").join(solved, keys)
    return joined.select(
        *keys, "size", F.col("target").alias("target_tokens"), rate.alias("repeat_factor"),
        F.when(rate > 0, rate / F.ceil(rate)).otherwise(0.0).alias("emit_prob"), (rate * F.coalesce("size", F.lit(0.0))).alias("planned_tokens"),
        ((F.col("state") == "exhausted") & F.col("size").isNotNull()).alias("exhausted"),
    )


def fill_targets(sources: list[tuple[str, float, float]], budget: float, cap: float) -> dict[str, float]:
    """Tokens asked of each (source, share, available): its share of the budget, but where that is beyond its cap, what the
    cap allows; what is left over goes to the others in proportion to their shares, until it is placed or all are at
    their caps."""
    given: dict[str, float] = {}
    open_ = {s: (share, cap * held) for s, share, held in sources}
    left = budget
    while open_:
        whole = sum(share for share, _ in open_.values())
        if whole <= 0 or left <= 0:
            break
        full = {s for s, (share, reach) in open_.items() if share / whole * left > reach}
        if not full:
            return given | {s: share / whole * left for s, (share, _) in open_.items()}
        for s in full:
            given[s] = open_.pop(s)[1]
            left -= given[s]
    return given | dict.fromkeys(open_, 0.0)


def mix_documents(documents: DataFrame, sources: DataFrame, cap: float = MAX_EPOCHS, total_tokens: float | None = None, seed: int = 17, key: str = "doc_id", tokenizer: str = DEFAULT_TOKENIZER) -> tuple[DataFrame, DataFrame]:
    """The mix of the documents of all sources of the manifest, and the report of its shares.

    The mix has (`key`, source, n_tokens, rate, copies): copies is the rate rounded down or up. The fractions of the rates
    are added up along the sizes of a source, in stretches of about STRETCH documents by hash; a document is rounded up
    where the sum passes a whole number, of documents of one size those with the lowest hash of the key. The report has a
    row for each source of the manifest: weight, target_share, target_tokens (its share of the budget), filled_tokens
    (with what exhausted sources leave over), available_tokens, mixed_tokens, actual_share, repeat_factor, gap (of the
    solution, to filled_tokens) and state: exhausted where target_tokens is beyond the cap, else that of `balance`. A null
    weight is 1. The budget is the tokens of all documents of the manifest's sources unless `total_tokens` is given.
    Documents of other or null sources are in no mix; null and empty texts have 0 tokens and are kept once where their
    source is asked for. Rows that repeat are mixed each. More than SOURCES sources raise.
    """
    spark = documents.sparkSession
    manifest = sources.where("source is not null").groupBy("source").agg(F.max(F.coalesce("weight", F.lit(1.0))).alias("weight"))
    sized = count_tokens(documents.where("source is not null"), keep=(key, "source"), tokenizer=tokenizer).select(F.col(key), "source", F.col("n_tokens").cast("double").alias("size"))
    sized = staged(sized)
    known = manifest.join(sized.groupBy("source").agg(F.sum("size").alias("available")), "source", "left").na.fill(0.0, ["available"]).limit(SOURCES + 1).collect()
    if len(known) > SOURCES:
        raise ValueError(f"more than {SOURCES} sources")
    weights = sum(r["weight"] for r in known) or 1.0
    budget = total_tokens if total_tokens is not None else float(sum(r["available"] for r in known))
    filled = fill_targets(sorted((r["source"], r["weight"] / weights, r["available"]) for r in known), budget, cap)
    rows = [(r["source"], float(r["weight"]), r["weight"] / weights, r["weight"] / weights * budget, float(filled[r["source"]]), float(cap)) for r in known]
    asked = F.broadcast(spark.createDataFrame(rows, "source string, weight double, target_share double, target_tokens double, target double, cap double"))
    solved = F.broadcast(balance(sized.select("source", "size"), asked.select("source", "target", "cap"), ["source"]))
    draw = F.xxhash64(F.lit(seed), F.col(key).cast("string"))
    stretch = F.pmod(F.xxhash64(draw, F.lit("stretch")), F.greatest(F.ceil(F.col("n_units") / STRETCH), F.lit(1))).cast("int")
    rated = sized.join(solved, "source").select(F.col(key), "source", "size", rate_of(F.col("size")).alias("rate"), draw.alias("_draw"), stretch.alias("_stretch"))
    part = rated.select("source", "_stretch", "size", (F.col("rate") - F.floor("rate")).alias("_part")).groupBy("source", "_stretch", "size").agg(F.count("*").alias("_n"), F.first("_part").alias("_part"))
    upto = F.sum(F.col("_n") * F.col("_part")).over(Window.partitionBy("source", "_stretch").orderBy("size").rowsBetween(Window.unboundedPreceding, 0))
    offset = F.pmod(F.xxhash64(F.lit(seed), "source", "_stretch"), F.lit(2**53)) / 2.0**53
    # sums of fractions are rounded to 9 digits, so that a sum that is whole is taken for whole
    passed = part.withColumn("_upto", upto).withColumn("_ups", (F.floor(F.round(F.col("_upto"), 9) + offset) - F.floor(F.round(F.col("_upto") - F.col("_n") * F.col("_part"), 9) + offset)))
    ups = passed.select(F.col("source").alias("_s"), F.col("_stretch").alias("_t"), F.col("size").alias("_z"), "_ups")
    rank = F.row_number().over(Window.partitionBy("source", "_stretch", "size").orderBy("_draw", F.col(key)))
    numbered = rated.withColumn("_rank", rank).join(ups, (F.col("source") == F.col("_s")) & (F.col("_stretch") == F.col("_t")) & (F.col("size") == F.col("_z")))
    mix = numbered.select(key, "source", F.col("size").cast("long").alias("n_tokens"), "rate", (F.floor("rate") + (F.col("_rank") <= F.col("_ups")).cast("int")).cast("int").alias("copies"))
    mixed = mix.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("mixed_tokens"))
    report = asked.drop("cap").withColumnRenamed("target", "filled_tokens").join(solved.drop("target", "cap"), "source").join(mixed, "source", "left").na.fill(0, ["mixed_tokens"])
    # as many rows as the manifest has sources
    total = F.sum("mixed_tokens").over(Window.partitionBy(F.lit(0)))
    state = F.when((F.col("target_tokens") > 0) & (F.col("target_tokens") > F.col("available") * float(cap)), "exhausted").otherwise(F.col("state"))
    report = report.select(
        "source", "weight", "target_share", "target_tokens", "filled_tokens", F.col("available").alias("available_tokens"), "mixed_tokens",
        F.when(total > 0, F.col("mixed_tokens") / total).otherwise(0.0).alias("actual_share"), F.when(F.col("available") > 0, F.col("mixed_tokens") / F.col("available")).otherwise(0.0).alias("repeat_factor"), "gap", state.alias("state"),
    )
    return mix, report
