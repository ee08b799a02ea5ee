"""Overlap joins of intervals, by dyadic segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _levels(high: Column) -> Column:
    return F.sequence(F.lit(0), high)


def _covered(intervals: DataFrame, keys: list[str], top: Column) -> DataFrame:
    """The dyadic segments ``(level, at)`` that an interval is made of: at most two of each level, none within another."""
    rows = intervals.select(*keys, "_id", "_low", "_high", F.explode(_levels(top)).alias("_level"))
    first, after = F.expr("shiftright(_low + shiftleft(1L, _level) - 1, _level)"), F.expr("shiftright(_high + 1, _level)")
    whole = rows.withColumns({"_from": first, "_to": after}).where("_from < _to")
    at = F.explode(F.filter(F.array(F.when(F.col("_from") % 2 != 0, F.col("_from")), F.when(F.col("_to") % 2 != 0, F.col("_to") - 1)), lambda x: x.isNotNull()))
    return whole.select(*keys, "_id", "_level", at.alias("_at"))


def overlapping(left: DataFrame, right: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``(left, right)``: ids of all pairs of closed intervals ``(id, start, end)`` that have a place in common, each once.

    With ``by``, only intervals of equal values there meet. Two intervals overlap if the right one starts
    inside the left one, or else the left one starts after the right one's start and inside it; so
    starts are looked up in intervals, both ways. An interval is a few dyadic segments, a start lies in one segment
    of each size, and the two meet in an equi-join whose every match is an overlap: nothing is
    compared in vain, and no place or value gathers rows beyond its own overlaps. Intervals that
    end before they start, or lack an end, overlap nothing.
    """
    by = by or []
    sides = [side.select(*by, F.col("id").alias("_id"), F.col("start").cast("bigint").alias("_low"), F.col("end").cast("bigint").alias("_high")).where("_low <= _high") for side in (left, right)]

    def starts_inside(points: DataFrame, intervals: DataFrame, skip: int) -> DataFrame:
        """Ids of points and of intervals; ``skip`` leaves out the interval's own first place."""
        longest = intervals.agg(F.max(F.col("_high") - F.col("_low") + 1)).first()[0] or 1
        top = F.lit(int(longest).bit_length() - 1)
        placed = points.select(*by, F.col("_id").alias("_point"), F.col("_low").alias("_place"), F.explode(_levels(top)).alias("_level")).withColumn("_at", F.expr("shiftright(_place, _level)")).drop("_place")
        return placed.join(_covered(intervals.withColumn("_low", F.col("_low") + skip).where("_low <= _high"), by, top), [*by, "_level", "_at"]).select("_point", "_id")

    one = starts_inside(sides[1], sides[0], 0).select(F.col("_id").alias("left"), F.col("_point").alias("right"))
    other = starts_inside(sides[0], sides[1], 1).select(F.col("_point").alias("left"), F.col("_id").alias("right"))
    return one.unionByName(other)
