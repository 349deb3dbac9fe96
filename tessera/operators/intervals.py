"""Joins of points with intervals, which may overlap and be of any length, by equal keys, and with the last mark before each."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.sinks import written

#: The widest bin is 1 << TOP; longer intervals are in many of these, so that none of their points come together.
TOP = 26


def containing(points: DataFrame, intervals: DataFrame, at: str, first: str, last: str, key: str = "image_id", top: int = TOP) -> DataFrame:
    """points with the columns of every interval of the same key that holds them: first <= at <= last, a row for each.

    An interval of n places has the level of the power of two that is n or more, up to top, and is in the bins of that
    width that it reaches into: two at most below the top. Points ask in one bin for each level that occurs, a few
    dozen at most. So rows meet by (key, level, bin), and nothing is compared that isn't near. Nulls are in nothing.
    """
    size = F.col(last) - F.col(first) + 1
    level = F.least(F.ceil(F.log2(size.cast("double"))).cast("int"), F.lit(top))
    bin_ = lambda c: F.call_function("shiftright", F.col(c), F.col("level"))
    lined = intervals.filter(size > 0).withColumn("level", level).withColumn("bin", F.explode(F.sequence(bin_(first), bin_(last))))
    lined = written(lined, "intervals")  # needed twice, and its size is then known
    levels = sorted(r.level for r in lined.select("level").distinct().collect())  # top + 1 at most
    asked = points.filter(F.col(at).isNotNull()).withColumn("level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>"))).withColumn("bin", bin_(at))
    found = asked.join(lined, [key, "level", "bin"]).filter((F.col(at) >= F.col(first)) & (F.col(at) <= F.col(last)))
    return found.drop("level", "bin")


def last_mark(points: DataFrame, marks: DataFrame, at: str, value: str, key: str = "image_id", bits: int = TOP) -> DataFrame:
    """points with the column value of the last of the marks (key, at, value; one a place) at or before each; null before the first.

    Points and marks meet once, in stretches of 1 << bits places, in order. A stretch with points also gets what holds at
    its start: the last mark of the stretches before, from a row for each stretch that has anything. So nothing is copied
    for what a mark's value reaches over.
    """
    stretch = F.call_function("shiftright", F.col(at).cast("long"), F.lit(bits))
    m = written(marks.filter(F.col(key).isNotNull() & F.col(at).isNotNull()).select(key, F.col(at).cast("long").alias(at), F.struct(value).alias("held"), stretch.alias("stretch")), "marks")
    asked = points.select(key, stretch.alias("stretch")).distinct().withColumn("asked", F.lit(True))
    tails = m.groupBy(key, "stretch").agg(F.max_by("held", at).alias("held"))
    earlier = Window.partitionBy(key).orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    came = tails.join(asked, [key, "stretch"], "full").withColumn("held", F.last("held", ignorenulls=True).over(earlier)).filter("asked and held is not null")
    came = came.select(key, F.call_function("shiftleft", "stretch", F.lit(bits)).alias(at), "held", "stretch", F.lit(0).alias("turn"))
    rows = points.withColumns({"stretch": stretch, "turn": F.lit(2)}).unionByName(m.withColumn("turn", F.lit(1)).unionByName(came), allowMissingColumns=True)
    so_far = Window.partitionBy(key, "stretch").orderBy(at, "turn").rowsBetween(Window.unboundedPreceding, 0)
    found = rows.withColumn("held", F.last("held", ignorenulls=True).over(so_far)).filter("turn = 2")
    return found.withColumn(value, F.col("held")[value]).drop("held", "stretch", "turn")
