"""Mixing sources to target weights: temperature, budget, block permutations.

A source with token share p gets the weight p**a / sum(q**a): a = 1 keeps the natural mix, a = 0 makes all
sources equal. The exponent is found by bisection over [0, 1] so that either the entropy of the weights
(nats) reaches ``target_entropy``, or no source is repeated more than ``max_repeats`` times; both want the
smallest such exponent (the flattest mix) for repeats, the largest for entropy. The budget is
``budget_tokens``, or by default the smallest one with which every source is used in full at least once, so
that nothing is lost.

Each source's share of the budget is realised as blocks. A block is a permutation of the whole source: by
the MD5 of id and block number, so every block has another order and every run the same. The blocks of a
source are full but for the last, which is the longest prefix of its permutation that fits the rest of
the budget. Rows with the same id share their place, and are in or out together.

Texts never move: the plan is one small row per source, with the last MD5 that still fits the last block,
and documents are expanded where they are scanned. Running token sums are taken in two levels, over 4,096
key ranges of a source and then inside the one range where the budget ends; slots likewise inside every
range, so a source with a third of all rows is spread over as many groups.

Tokens are words. Null is a source of its own; sources without tokens are used once; null and empty texts
have no tokens and travel with their source; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthlog.llm.text import words
from hearthlog.session import cut

MAX_REPEATS = 2.0
_STEPS = 6  # passes over the sources
_HALVINGS = 4  # bisection steps settled in each pass
_RANGE_DIGITS = 3


def _source(source_col: str) -> Column:
    """A join key that keeps null apart from every name."""
    return F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit(""))


def _key(id_: Column, block: Column) -> Column:
    return F.md5(F.concat_ws(":", id_.cast("string"), block.cast("string")))


def _narrow(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return cut(
        docs.select(
            F.col(id_col).alias("id"),
            _source(source_col).alias("mix_source"),
            F.size(words(F.col(text_col))).cast("long").alias("tokens"),
        )
    )


def find_exponent(
    sources: DataFrame,
    budget_tokens: int | None = None,
    max_repeats: float | None = MAX_REPEATS,
    target_entropy: float | None = None,
) -> float:
    """The exponent that meets the target, from (mix_source, tokens); each pass returns a few numbers."""
    filled = sources.filter("tokens > 0")
    total = filled.agg(F.sum("tokens")).first()[0]
    if not total:
        return 1.0
    low, high = 0, 1 << (_STEPS * _HALVINGS)  # in units of the final resolution
    unit = 1.0 / high

    def meets(s) -> bool:
        if target_entropy is not None:
            return s["log_sum"] - s["mean_log"] <= target_entropy
        budget = s["cover"] * s["weight_sum"] if budget_tokens is None else budget_tokens
        return s["most"] / s["weight_sum"] * budget <= max_repeats

    while high - low > 1:
        step = (high - low) >> _HALVINGS
        points = [low + step * k for k in range(1, 1 << _HALVINGS)]
        share = F.col("tokens") / F.lit(total)
        power = F.pow(share, F.col("a"))
        tried = (
            filled.withColumn("at", F.explode(F.array(*[F.lit(p) for p in points])))
            .withColumn("a", F.col("at") * unit)
            .groupBy("at")
            .agg(
                F.sum(power).alias("weight_sum"),
                F.log(F.sum(power)).alias("log_sum"),
                (F.sum(power * F.log(power)) / F.sum(power)).alias("mean_log"),
                F.max(F.col("tokens") / power).alias("cover"),
                F.max(power / F.col("tokens")).alias("most"),
            )
        )
        at = {row["at"]: row for row in tried.collect()}  # at most 15 rows
        for _ in range(_HALVINGS):
            middle = (low + high) >> 1
            low, high = (low, middle) if meets(at[middle]) else (middle, high)
    return high * unit


def source_plan(
    rows: DataFrame,
    budget_tokens: int | None,
    max_repeats: float | None,
    target_entropy: float | None,
) -> DataFrame:
    """One row per source: tokens, weight, budget, number of full blocks, tokens left for the last one."""
    sources = cut(rows.groupBy("mix_source").agg(F.sum("tokens").alias("tokens")))
    exponent = find_exponent(sources, budget_tokens, max_repeats, target_entropy)
    total = sources.agg(F.sum("tokens")).first()[0] or 0
    power = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / F.lit(total), F.lit(exponent))).otherwise(0.0)
    powered = sources.withColumn("power", power)
    sums = powered.filter("tokens > 0").agg(F.sum("power"), F.max(F.col("tokens") / F.col("power"))).first()
    power_sum, cover = (F.lit(x or 1.0) for x in sums)
    weighted = powered.withColumn("weight", F.col("power") / power_sum)
    if budget_tokens is None:
        own = F.greatest(F.col("tokens"), F.round(F.col("power") * cover).cast("long"))
    else:
        own = F.round(F.col("weight") * budget_tokens).cast("long")
    full = F.when(F.col("tokens") > 0, F.expr("budget DIV tokens")).otherwise(1).cast("long")
    return weighted.withColumn("budget", own).select(
        "mix_source",
        "tokens",
        "weight",
        "budget",
        full.alias("full_blocks"),
        F.when(F.col("tokens") > 0, F.col("budget") - full * F.col("tokens")).otherwise(0).alias("rest"),
    )


def _with_last_key(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """The plan with ``last_key``: the largest key of the last block whose running sum fits ``rest``."""
    tail = rows.join(plan.filter("rest > 0").select("mix_source", "full_blocks", "rest"), "mix_source")
    tail = tail.withColumn("key", _key(F.col("id"), F.col("full_blocks")))
    tail = tail.withColumn("range", F.substring("key", 1, _RANGE_DIGITS))
    ranges = tail.groupBy("mix_source", "range").agg(F.sum("tokens").alias("n"), F.max("key").alias("top"), F.first("rest").alias("rest"))
    upto = F.sum("n").over(Window.partitionBy("mix_source").orderBy("range"))
    summed = cut(ranges.withColumn("upto", upto))
    whole = summed.filter("upto <= rest").groupBy("mix_source").agg(F.max("top").alias("whole_top"))
    crossing = summed.filter("upto > rest AND upto - n < rest").select(
        "mix_source", "range", (F.col("rest") - F.col("upto") + F.col("n")).alias("left")
    )
    inside = tail.select("mix_source", "range", "key", "tokens").join(crossing, ["mix_source", "range"])
    running = F.sum("tokens").over(Window.partitionBy("mix_source", "range").orderBy("key"))
    part = inside.withColumn("run", running).filter("run <= left").groupBy("mix_source").agg(F.max("key").alias("part_top"))
    ends = whole.join(part, "mix_source", "full").select("mix_source", F.coalesce("part_top", "whole_top").alias("last_key"))
    return plan.join(ends, "mix_source", "left")


def plan_mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    *,
    budget_tokens: int | None = None,
    max_repeats: float | None = MAX_REPEATS,
    target_entropy: float | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(plan, rows): one row per source, and the narrow row of every document."""
    rows = _narrow(docs, id_col, text_col, source_col)
    # Staged, so that Spark knows its size when it plans the joins with the documents.
    plan = cut(source_plan(rows, budget_tokens, max_repeats, target_entropy))
    return cut(_with_last_key(rows, plan)), rows


def _expanded(rows: DataFrame, plan: DataFrame, id_: Column) -> DataFrame:
    """``rows`` (with ``mix_source``) once for every block they are in, with ``block`` and ``key``."""
    ends = plan.select("mix_source", "full_blocks", "last_key")
    blocks = F.sequence(F.lit(0).cast("long"), F.col("full_blocks"))
    each = rows.join(ends, "mix_source").withColumn("block", F.explode(blocks))
    each = each.withColumn("key", _key(id_, F.col("block")))
    return each.filter("block < full_blocks OR key <= last_key").drop("full_blocks", "last_key")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **target) -> DataFrame:
    """The input rows, each as often as its source's blocks hold it."""
    plan, _ = plan_mix(docs, id_col, text_col, source_col, **target)
    whole = F.struct(*[F.col(c) for c in docs.columns])
    packed = docs.select(whole.alias("_row"), F.col(id_col).alias("_id"), _source(source_col).alias("mix_source"))
    return _expanded(packed, plan, F.col("_id")).select("_row.*")


def permutations(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **target
) -> DataFrame:
    """One narrow row per use of a document: source, tokens, block, and slot in the block's permutation."""
    plan, rows = plan_mix(docs, id_col, text_col, source_col, **target)
    used = _expanded(rows, plan, F.col("id")).withColumn("range", F.substring("key", 1, _RANGE_DIGITS))
    sizes = used.groupBy("mix_source", "block", "range").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("mix_source", "block").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("mix_source", "block", "range", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("mix_source", "block", "range").orderBy("key", "tokens"))
    slots = used.withColumn("place", place).join(before, ["mix_source", "block", "range"])
    return slots.select(
        F.col("id").alias(id_col),
        F.when(F.col("mix_source") != "", F.expr("substring(mix_source, 2)")).alias("source"),
        F.col("tokens").alias("n_tokens"),
        "block",
        (F.col("before") + F.col("place") - 1).alias("slot"),
    )
