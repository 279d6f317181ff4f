"""Mixing sources to target weights by pivotal dependent rounding."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from usagelens.llm.common import ROW, WORD, Stored, numbered

MAX_RATE = 3.0
FAN_IN = 128
SEED = 20
_BITS = 53


def source_targets(sizes: DataFrame, weights: Sequence[float], max_rate: float = MAX_RATE) -> DataFrame:
    """(source, source_size) with the words that each source contributes to the mix.

    Sources in code point order, null last, weigh ``weights`` in turn and share the whole size; a target stops at
    ``max_rate`` times its source, and the excess is shared among the others by weight until none is above. That is
    target = least(max_rate * size, level * weight) with one level for all: sources reach their limit in the order of
    limit by weight, so the level follows from running sums along that order. One row per source is all that is read here.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    limit = F.col("source_size") * F.lit(float(max_rate))
    all_rows = Window.partitionBy(F.lit(0))
    in_order = all_rows.orderBy("reached", "weight", F.col("source").asc_nulls_last())
    before = in_order.rowsBetween(Window.unboundedPreceding, -1)
    ranked = sizes.withColumn("weight", weight).withColumn("limit", limit).withColumn("reached", F.col("limit") / F.col("weight"))
    rest = F.sum("source_size").over(all_rows) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    level = rest / F.sum("weight").over(in_order.rowsBetween(0, Window.unboundedFollowing))
    leveled = ranked.withColumn("level", level)
    # The first source that the level does not lift to its limit sets it for itself and all later ones, whose own are lower.
    common = F.max(F.when(F.col("level") < F.col("reached"), F.col("level"))).over(all_rows)
    open_ = F.col("reached") > F.coalesce(common, F.lit(float("inf")))
    target = F.when(open_, common * F.col("weight")).otherwise(F.col("limit"))
    return leveled.select("source", "source_size", "weight", target.alias("target"))


def _uniform(level: int, seed: int) -> Column:
    """A number in [0, 1) for each unit and level, the same on each run."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(level), "draw"), 64 - _BITS)
    return bits.cast("double") / F.lit(float(1 << _BITS))


def _rounded(units: DataFrame) -> DataFrame:
    """Pivotal rounding within each (source, bucket): (source, bucket, up, rest).

    Units stand in order of size, largest first, so that what is open last is small. The open unit and the next one compete: if their probabilities stay under one, one of
    them takes all of it and the other is out; else one of them is taken and the other keeps what is left. ``up`` lists
    the units that were taken, ``rest`` is the one that is still open.
    """
    unit = F.struct("size", "draw", "place", "p", "u")
    ordered = units.groupBy("source", "bucket").agg(F.sort_array(F.collect_list(unit), asc=False).alias("units"))
    none = F.lit(None).cast("bigint")
    start = F.struct(
        none.alias("size"),
        none.alias("draw"),
        none.alias("place"),
        F.lit(0.0).alias("p"),
        F.array().cast("array<bigint>").alias("up"),
    )

    def step(s: Column, x: Column) -> Column:
        both = s["p"] + x["p"]
        under = both < 1.0 - 1e-12
        # The chance that the new unit is the one that stays in the game (under one) or stays open (one and over).
        stays = F.when(under, x["p"] / both).otherwise((1.0 - s["p"]) / (2.0 - both))
        new = s["place"].isNull() | F.when(under, x["u"] < stays).otherwise(x["u"] >= stays)
        left = F.when(s["place"].isNull(), x["p"]).when(under, both).otherwise(F.greatest(both - 1.0, F.lit(0.0)))
        taken = F.when(new, s["place"]).otherwise(x["place"])
        return F.struct(
            *(F.when(new, x[c]).otherwise(s[c]).alias(c) for c in ("size", "draw", "place")),
            left.alias("p"),
            F.when(s["place"].isNull() | under, s["up"]).otherwise(F.concat(s["up"], F.array(taken))).alias("up"),
        )

    folded = ordered.select("source", "bucket", F.aggregate("units", start, step).alias("s"))
    return folded.select("source", "bucket", F.col("s.up").alias("up"), F.struct("s.size", "s.draw", "s.place", "s.p").alias("rest"))


def mix(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), max_rate: float = MAX_RATE, fan_in: int = FAN_IN, seed: int = SEED) -> DataFrame:
    """How often the mix takes each row of ``docs`` (doc_id, text, source, ..), so that sources reach their targets.

    A source whose target is r times its size takes each document floor(r) times, and once more with probability
    r - floor(r). Which ones is settled by pivotal rounding: documents of similar size compete in buckets of about
    ``fan_in``, one document of each bucket stays open, and the open ones meet in the next level of a reduction tree until
    one is left in each source. Each transfer of probability keeps the sum of copies, so a source misses its target by
    about the size differences inside buckets, not by chance over all of it.

    All that is random hashes the seed, the doc_id and the text, and for rows that repeat both their number in the stored
    files, so that reruns agree.

    Size is the number of words; null text has none. Null sources form one source, which comes last. Empty texts are never
    taken more than their source's rate, and add nothing. Null doc_ids compete like others. Rows that repeat a doc_id are
    units of their own, and are dealt over the buckets even if they are equal. An empty table gives no rows. Other columns are not read.

    Returns _row, doc_id, source, size, source_size, target, copies, taken.
    """
    store = Stored(docs.sparkSession)
    text = F.coalesce("text", F.lit(""))
    size = F.regexp_count(text, F.lit(WORD)).cast("long").alias("size")
    draw = F.xxhash64(F.lit(seed), "doc_id", "text").alias("draw")
    rows = store.keep(numbered(docs, "doc_id", "source", size, draw), "sizes")
    targets = store.keep(source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_rate), "targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rates = targets.withColumn("rate", F.least(rate, F.lit(float(max_rate)))).select(
        F.col("source").alias("of"), "source_size", "target", F.floor("rate").cast("long").alias("whole"), (F.col("rate") - F.floor("rate")).alias("p")
    )

    # Buckets: rows of a source in one class of sizes, dealt by hash into as many as give about fan_in each.
    size_class = F.floor(F.log2(F.col("size") + 1.0) * 16).cast("long").alias("size_class")
    classes = rows.groupBy("source", size_class).agg(F.count("*").alias("n"))
    classes = classes.withColumn("n_buckets", F.ceil(F.col("n") / fan_in).cast("long"))
    # Bucket numbers run on from class to class, so that neighbours in number are neighbours in size.
    upto = Window.partitionBy("source").orderBy("size_class").rowsBetween(Window.unboundedPreceding, -1)
    classes = classes.withColumn("first_bucket", F.coalesce(F.sum("n_buckets").over(upto), F.lit(0)).cast("long"))
    plan = classes.join(rates, F.col("source").eqNullSafe(F.col("of"))).select(
        "of", F.col("size_class").alias("of_class"), "n_buckets", "first_bucket", "whole", "p", "source_size", "target"
    )
    # Rows that repeat id and text draw by their number too, else they would all meet in one bucket.
    repeated = store.keep(rows.groupBy("draw").agg(F.count("*").alias("n")).filter("n > 1").select("draw", F.lit(True).alias("again")), "repeated")
    own = F.when(F.col("again"), F.xxhash64("draw", ROW)).otherwise(F.col("draw"))
    sized = rows.join(repeated, "draw", "left").withColumn("draw", own).drop("again").withColumn("size_class", size_class)
    planned = sized.join(plan, F.col("source").eqNullSafe(F.col("of")) & (F.col("size_class") == F.col("of_class"))).select(
        ROW, "doc_id", "source", "size", "draw", "source_size", "target", "whole", "p",
        (F.col("first_bucket") + F.pmod(F.col("draw"), F.col("n_buckets"))).alias("bucket"),
    )
    planned = store.keep(planned, "planned")

    units = planned.filter("p > 0").select("source", "bucket", "size", "draw", F.col(ROW).alias("place"), "p")
    taken, level = [], 0
    while True:
        drawn = units.withColumn("u", _uniform(level, seed))
        result = store.keep(_rounded(drawn), "rounded")
        taken.append(result.select(F.explode("up").alias(ROW)))
        level += 1
        rest = result.select("source", "bucket", "rest.*").filter("p > 0")
        if rest.groupBy("source").count().filter("count > 1").isEmpty():
            # One open unit in each source: the last draw decides.
            last = rest.withColumn("u", _uniform(level, seed)).filter("u < p")
            taken.append(last.select(F.col("place").alias(ROW)))
            break
        units = rest.withColumn("bucket", F.expr(f"bucket div {fan_in}"))
    extra = taken[0]
    for more in taken[1:]:
        extra = extra.union(more)
    copies = F.col("whole") + F.when(F.col("more"), 1).otherwise(0)
    return (
        planned.join(extra.withColumn("more", F.lit(True)), ROW, "left")
        .withColumn("copies", copies)
        .select(ROW, "doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
    )
