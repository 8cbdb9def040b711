"""Mixing sources to target weights along a time-varying curriculum.

The sources' shares of all words follow their weights, no target above ``cap``
times the source's words. Each source has a schedule: how its weight runs over
training time, as linear pieces. Its integral is the source's cumulative demand of
words; a document takes the time at which the demand reaches it, and the mix is the
documents sorted by that time. A source that must give more than it has is gone
through again, in the same order, up to ``cap`` times.

The order inside a source is that of a hash of the ids, so the words before a
document are a prefix sum over hash ranges: sums of (source, range), then a window
inside each range. No window holds a whole source.

Defined results: a null text has no words; a null source is a source of its own,
ordered last; documents without words take part (they cost nothing); equal ids are
told apart by their size, equal rows are interchangeable; an empty table gives an
empty mix; columns of the documents are carried along untouched, whatever their
names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spark_climbs.llm import words

#: Weights of the sources in order of their names, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: Schedules of the weights, as (time, relative weight) knots: the heaviest sources
#: fade, the middle ones stay, the light ones come late.
SCHEDULES = (
    ((0.0, 1.5), (0.5, 1.0), (1.0, 0.5)),
    ((0.0, 1.0), (1.0, 1.0)),
    ((0.0, 0.4), (0.6, 1.0), (1.0, 1.6)),
)
#: A source is gone through at most so many times.
CAP = 3
#: Hex digits of the id's hash that name a range: 4096 ranges a source.
RANGE_DIGITS = 3

SOURCE, SIZE, RANK, BUCKET, KEY = "__mix_source", "__mix_size", "__mix_hash", "__mix_range", "__mix_key"


def _pieces(knots: Sequence[tuple[float, float]]) -> list[tuple[float, float, float, float]]:
    """Pieces of a schedule scaled to the integral 1: start, demand until there, weight
    there and slope. This is the integral of the piecewise linear weight."""
    whole = sum((t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(knots, knots[1:]))
    out, before = [], 0.0
    for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
        out.append((t0, before, w0 / whole, (w1 - w0) / (t1 - t0) / whole))
        before += (t1 - t0) * (w0 + w1) / 2 / whole
    return out


def position(share: Column, phase: Column, schedules=SCHEDULES) -> Column:
    """Time at which the demand of a source reaches ``share`` of its target: the inverse
    of the integrated schedule, a root of a quadratic in each piece."""
    out = None
    for k, knots in enumerate(schedules):
        own = None
        for t0, before, w, slope in _pieces(knots):
            rest = share - F.lit(before)
            root = F.lit(t0) + F.lit(2.0) * rest / (F.lit(w) + F.sqrt(F.lit(w * w) + F.lit(2 * slope) * rest))
            own = F.when(share >= F.lit(before), root) if own is None else F.when(share >= F.lit(before), root).otherwise(own)
        out = F.when(phase == k, own) if out is None else out.when(phase == k, own)
    return out


def targets(sources: DataFrame, weights: Sequence[float] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """One row per source: ``key``, ``source_size``, ``phase`` (which weight and
    schedule) and ``target``. ``sources`` has ``key``, ``source`` and ``source_size``.

    Sharing the excess again by weight until no source is above its cap gives every
    source below it the same multiple of its weight. In order of cap / weight, the
    capped sources come first, so the multiple follows from running sums.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    level = Window.orderBy("ratio", "key").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    ranked = sources.withColumn("phase", (F.row_number().over(order) - 1) % len(weights))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("phase") + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight).withColumn("limit", F.col("source_size") * F.lit(cap))
    ranked = ranked.withColumn("ratio", F.col("limit") / F.col("weight"))
    ranked = (
        ranked.withColumn("total", F.sum("source_size").over(every))
        .withColumn("weights", F.sum("weight").over(every))
        .withColumn("full", F.coalesce(F.sum("limit").over(level), F.lit(0)))
        .withColumn("gone", F.coalesce(F.sum("weight").over(level), F.lit(0.0)))
    )
    lift = (F.col("total") - F.col("full")).cast("double") / (F.col("weights") - F.col("gone"))
    ranked = ranked.withColumn("lift", lift).withColumn("open", F.col("ratio") >= F.col("lift"))
    ranked = ranked.withColumn("common", F.min(F.when(F.col("open"), F.struct("ratio", "key", "lift"))).over(every))
    target = F.when(
        F.col("common").isNotNull() & (F.struct("ratio", "key") >= F.struct("common.ratio", "common.key")),
        F.least(F.col("weight") * F.col("common.lift"), F.col("limit").cast("double")),
    ).otherwise(F.col("limit").cast("double"))
    return ranked.select("key", "source_size", "phase", target.alias("target"))


def assign(documents: DataFrame, weights: Sequence[float] = WEIGHTS, schedules=SCHEDULES, cap: int = CAP) -> DataFrame:
    """Every document with ``__mix_size``, ``__mix_source_size``, ``__mix_target``,
    ``__mix_copies`` (how often the mix takes it) and ``__mix_positions`` (when)."""
    docs = documents.withColumns(
        {
            KEY: F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")),
            SIZE: words.count(F.col("text")),
            RANK: F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))),
        }
    ).withColumn(BUCKET, F.substring(RANK, 1, RANGE_DIGITS))
    ranges = docs.groupBy(KEY, BUCKET).agg(F.sum(SIZE).alias("words"))
    so_far = Window.partitionBy(KEY).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.withColumn("start", F.coalesce(F.sum("words").over(so_far), F.lit(0))).select(KEY, BUCKET, "start")
    sources = ranges.groupBy(KEY).agg(F.sum("words").alias("source_size"))
    name = F.when(F.col(KEY) != "", F.substr(F.col(KEY), F.lit(2)))
    goals = targets(sources.select(F.col(KEY).alias("key"), name.alias("source"), "source_size"), weights, cap)
    starts = starts.join(goals.withColumnRenamed("key", KEY), KEY).select(
        F.col(KEY).alias("__mix_k"),
        F.col(BUCKET).alias("__mix_b"),
        F.col("start").alias("__mix_start"),
        F.col("source_size").alias("__mix_source_size"),
        F.col("phase").alias("__mix_phase"),
        F.col("target").alias("__mix_target"),
    )
    within = Window.partitionBy(KEY, BUCKET).orderBy(RANK, F.col("doc_id"), SIZE).rowsBetween(Window.unboundedPreceding, -1)
    placed = docs.withColumn("__mix_in", F.coalesce(F.sum(SIZE).over(within), F.lit(0)))
    placed = placed.join(starts, (F.col(KEY) == F.col("__mix_k")) & (F.col(BUCKET) == F.col("__mix_b")))
    middle = F.col("__mix_start") + F.col("__mix_in") + F.col(SIZE) / F.lit(2.0)
    placed = placed.withColumn("__mix_middle", middle)
    rounds = F.array(*[F.col("__mix_middle") + F.col("__mix_source_size") * F.lit(e) for e in range(cap)])
    placed = placed.withColumn("__mix_at", F.filter(rounds, lambda at: at <= F.col("__mix_target")))
    placed = placed.withColumn("__mix_copies", F.size("__mix_at"))
    share = lambda at: F.when(F.col("__mix_target") > 0, at / F.col("__mix_target")).otherwise(F.lit(0.0))
    times = F.transform("__mix_at", lambda at: position(share(at), F.col("__mix_phase"), schedules))
    return placed.withColumn("__mix_positions", times)


def mix(documents: DataFrame, weights: Sequence[float] = WEIGHTS, schedules=SCHEDULES, cap: int = CAP) -> DataFrame:
    """The training order: a row for every time a document is taken, sorted by
    position over the partitions, with the columns of ``documents``."""
    inner, outer = words.carried(documents, "doc_id", "source", "text")
    placed = assign(inner, weights, schedules, cap).withColumn("__mix_position", F.explode("__mix_positions"))
    spread = placed.repartitionByRange("__mix_position", RANK).sortWithinPartitions("__mix_position", RANK)
    return outer(spread)


def shares(documents: DataFrame, weights: Sequence[float] = WEIGHTS, schedules=SCHEDULES, cap: int = CAP) -> DataFrame:
    """What the mix takes of every document, in the order in which training first meets
    them: ``doc_id, size, source_size, target, taken, position`` (of the first time;
    null if never)."""
    narrow = documents.select("doc_id", "source", "text")
    placed = assign(narrow, weights, schedules, cap).select(
        "doc_id",
        F.col(SIZE).alias("size"),
        F.col("__mix_source_size").alias("source_size"),
        F.col("__mix_target").alias("target"),
        (F.col(SIZE) * F.col("__mix_copies")).alias("taken"),
        F.get("__mix_positions", F.lit(0)).alias("position"),
    )
    return placed.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id")
