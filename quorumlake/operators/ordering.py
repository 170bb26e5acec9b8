"""Global order without a window over everything: range partitions, counts of each, offsets by prefix sums."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, functions as F

from quorumlake.runtime import free_name, materialize

_IN_TASK = (1 << 33) - 1  # monotonically_increasing_id: partition number above, place in the partition in these bits


def _ranged(df: DataFrame, order: list[Column], place: str) -> DataFrame:
    """``df`` written in order, with the number of each row's range and its place there in one long."""
    return materialize(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(place, F.monotonically_increasing_id()), "ordered")


def _offsets(written: DataFrame, place: str) -> Column:
    """How many rows the ranges before a row's hold. One number a range comes to the driver."""
    held = {r[0]: r[1] for r in written.groupBy(F.shiftright(place, 33)).agg(F.count("*")).collect()}
    ranges = sorted(held)
    before = dict(zip(ranges, accumulate([0, *[held[k] for k in ranges]]), strict=False))
    known = F.create_map(*[x for k, n in before.items() for x in (F.lit(k), F.lit(n))]) if before else F.create_map()
    return F.coalesce(F.try_element_at(known.cast("map<bigint,bigint>"), F.shiftright(place, 33)), F.lit(0).cast("long"))


def numbered(df: DataFrame, *order: str | Column, name: str = "ordinal", start: int = 1) -> DataFrame:
    """``df`` with numbers from ``start`` in the given order, gapless; rows that agree in it are numbered as they come.

    Rows are sorted by ranges, each written with its rows' places; the counts of the ranges give the first number of each.
    No task sees more than a range. Where many rows agree in the order, add a column that tells them apart: a range can't be
    split between equal rows.
    """
    keys = [F.col(o) if isinstance(o, str) else o for o in order]
    place = free_name("_place", df)
    written = _ranged(df, keys, place)
    return written.withColumn(name, F.col(place).bitwiseAND(_IN_TASK) + _offsets(written, place) + start).drop(place)


def exact_quantiles(df: DataFrame, by: list[str], value: str, quantiles: dict[str, float]) -> DataFrame:
    """(by, n, and a column for each quantile): linear between the two nearest ranks, as ``percentile`` gives, for any number of rows.

    Ranks are found by selection: rows are sorted by ranges of (by, value), the counts of each group and range tell in which
    range a rank lies and where, and only the rows at these places are read. Nothing holds a group's values, as the buffer of
    ``percentile`` does. Nulls are left out; a group without values has none. NaN is above all numbers. Null groups are groups.
    """
    rows = df.select(*by, F.col(value).cast("double").alias("_v")).filter("_v IS NOT NULL")
    salt = F.xxhash64(F.monotonically_increasing_id())  # equal rows may be dealt to several ranges
    written = _ranged(rows.withColumn("_salt", salt), [*[F.col(b) for b in by], F.col("_v"), F.col("_salt")], "_place").drop("_salt")
    range_, place = F.shiftright("_place", 33), F.col("_place").bitwiseAND(_IN_TASK)
    counts = written.groupBy(*by, range_.alias("_range")).agg(F.count("*").alias("_n"), F.min(place).alias("_first"))
    listed = counts.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_range", "_n", "_first"))).alias("_parts"), F.sum("_n").alias("n"))  # a row for each range that a group is in
    wanted = []
    for name, q in quantiles.items():
        at = F.lit(float(q)) * (F.col("n") - 1)
        wanted += [F.struct(F.lit(name).alias("q"), F.floor(at).alias("rank"), (1 - (at - F.floor(at))).alias("share")), F.struct(F.lit(name).alias("q"), (F.floor(at) + 1).alias("rank"), (at - F.floor(at)).alias("share"))]
    ranks = listed.withColumn("_w", F.explode(F.array(*wanted))).filter("_w.share > 0")
    start = F.lit(0).cast("long")
    found = F.aggregate(
        "_parts",
        F.struct(start.alias("seen"), start.alias("range"), F.lit(-1).cast("long").alias("place")),
        lambda s, p: F.struct((s["seen"] + p["_n"]).alias("seen"), F.when((s["place"] < 0) & (F.col("_w.rank") < s["seen"] + p["_n"]), p["_range"]).otherwise(s["range"]).alias("range"), F.when((s["place"] < 0) & (F.col("_w.rank") < s["seen"] + p["_n"]), p["_first"] + F.col("_w.rank") - s["seen"]).otherwise(s["place"]).alias("place")),
    )
    at = ranks.withColumn("_at", found).select(*by, "n", F.col("_w.q").alias("_q"), F.col("_w.share").alias("_share"), (F.shiftleft(F.col("_at.range"), 33) + F.col("_at.place")).alias("_place"))
    picked = at.join(written.select("_place", "_v"), "_place")
    per = picked.groupBy(*by, "n").agg(*[F.sum(F.when(F.col("_q") == name, F.col("_share") * F.col("_v"))).alias(name) for name in quantiles])
    return per
