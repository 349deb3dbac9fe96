"""Scans along an image in two passes over stretches, so that no image is ever in one place.

Rows (image_id, first_block, ...) are in order of first_block within an image. A stretch is 1 << BITS blocks. The
first pass works within stretches and sums each of them up in one row; a window over an image sees those rows only, a
few hundred thousand for 10 TB. What they say of the stretches before goes back to the rows by a join.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BITS = 16
KEY = ["image_id", "stretch"]


def _within():
    return Window.partitionBy(*KEY).orderBy("first_block")


def _along():
    return Window.partitionBy("image_id").orderBy("stretch")


def stretched(df: DataFrame, bits: int = BITS) -> DataFrame:
    return df.withColumn("stretch", F.call_function("shiftright", F.col("first_block").cast("long"), F.lit(bits)))


def islands(df: DataFrame, carried: list[str], link: Callable[[Column, Column], Column], sums: tuple[str, ...] = (), bits: int = BITS) -> DataFrame:
    """df with prev (a struct of the carried columns of the row before, null at an image's first), island and before_<sum>.

    link(before, row), structs of the carried columns, says whether a row goes on with the island of the one before;
    an island is named by its first row's first_block. before_<sum>: the sum over the image's rows before. df is read
    twice.
    """
    past = _within().rowsBetween(Window.unboundedPreceding, -1)
    earlier = _along().rowsBetween(Window.unboundedPreceding, -1)
    d = stretched(df, bits).withColumn("own", F.struct(*carried)).withColumn("prev", F.lag("own").over(_within()))
    linked = lambda a, b: F.coalesce(link(F.col(a), F.col(b)), F.lit(False))
    d = d.withColumn("starts", F.when(F.col("prev").isNotNull(), ~linked("prev", "own")))  # null in a stretch's first row
    s = d.groupBy(*KEY).agg(
        F.min("first_block").alias("first"), F.min_by("own", "first_block").alias("head"), F.max_by("own", "first_block").alias("tail"),
        F.max(F.when(F.col("starts"), F.col("first_block"))).alias("last_start"), *(F.sum(c).alias(f"sum_{c}") for c in sums),
    )
    s = s.withColumn("came", F.lag("tail").over(_along())).withColumn("head_starts", F.when(F.col("came").isNull(), True).otherwise(~linked("came", "head")))
    s = s.withColumn("opens", F.coalesce("last_start", F.when(F.col("head_starts"), F.col("first"))))
    s = s.select(*KEY, "came", "head_starts", F.last("opens", ignorenulls=True).over(earlier).alias("open"), *(F.coalesce(F.sum(f"sum_{c}").over(earlier), F.lit(0)).alias(f"sum_{c}") for c in sums))
    j = d.join(s, KEY).withColumns({"prev": F.coalesce("prev", "came"), "starts": F.coalesce("starts", "head_starts")})
    begun = F.last(F.when(F.col("starts"), F.col("first_block")), ignorenulls=True).over(_within().rowsBetween(Window.unboundedPreceding, 0))
    j = j.withColumns({"island": F.coalesce(begun, "open"), **{f"before_{c}": F.col(f"sum_{c}") + F.coalesce(F.sum(c).over(past), F.lit(0)) for c in sums}})
    return j.drop("stretch", "own", "came", "head_starts", "open", *(f"sum_{c}" for c in sums))


def nearest(df: DataFrame, where: Column, bits: int = BITS) -> DataFrame:
    """df with last_before (the largest last_block of the rows before where it holds) and first_after (the least first_block of such rows after)."""
    past, ahead = _within().rowsBetween(Window.unboundedPreceding, -1), _within().rowsBetween(1, Window.unboundedFollowing)
    earlier, later = _along().rowsBetween(Window.unboundedPreceding, -1), _along().rowsBetween(1, Window.unboundedFollowing)
    d = stretched(df, bits).withColumns({"ends": F.when(where, F.col("last_block")), "begins": F.when(where, F.col("first_block"))})
    s = d.groupBy(*KEY).agg(F.max("ends").alias("most"), F.min("begins").alias("least"))
    s = s.select(*KEY, F.max("most").over(earlier).alias("most"), F.min("least").over(later).alias("least"))
    j = d.join(s, KEY)
    return j.withColumns({"last_before": F.greatest(F.max("ends").over(past), "most"), "first_after": F.least(F.min("begins").over(ahead), "least")}).drop("stretch", "ends", "begins", "most", "least")


def numbered(df: DataFrame, name: str, bits: int = BITS) -> DataFrame:
    """df with each row's number in its image, from 1 on."""
    d = stretched(df, bits)
    s = d.groupBy(*KEY).agg(F.count("*").alias("rows"))
    s = s.select(*KEY, F.coalesce(F.sum("rows").over(_along().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("rows"))
    return d.join(s, KEY).withColumn(name, F.col("rows") + F.row_number().over(_within())).drop("stretch", "rows")
