"""Running sums and places in an order without one task that holds a whole group."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tagloom.operators.components import materialised


def running(rows: DataFrame, order: Sequence[Column], sums: Mapping[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """rows with, for each name in ``sums``, the sum of its column over the rows of equal ``by`` up to this one in ``order``.

    Rows are range-partitioned by group and order, so that a large group spans many partitions; a row's sum is that within
    its partition and those of the group's earlier partitions, of which there is a row for each partition and group.
    """
    by = list(by)
    keys = [*(F.col(c) for c in by), *order]
    spread = materialised(rows.repartitionByRange(*keys).withColumn("__part", F.spark_partition_id()), "running")
    totals = spread.groupBy(*by, "__part").agg(*(F.sum(v).alias(n) for n, v in sums.items()))
    earlier = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(*(F.col(c).alias(f"__b_{c}") for c in by), F.col("__part").alias("__b"), *(F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"__b_sum_{n}") for n in sums))
    here = Window.partitionBy(*by, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    within = spread.select("*", *(F.sum(v).over(here).alias(f"__sum_{n}") for n, v in sums.items()))
    same = reduce(lambda a, c: a & F.col(c).eqNullSafe(F.col(f"__b_{c}")), by, F.col("__part") == F.col("__b"))
    return within.join(before, same).select(*rows.columns, *((F.col(f"__sum_{n}") + F.col(f"__b_sum_{n}")).alias(n) for n in sums))


def preceding(rows: DataFrame, order: Sequence[str], values: Mapping[str, Column], by: Sequence[str]) -> DataFrame:
    """rows with, for each name in ``values``, the last value that isn't null among the earlier rows of equal ``by`` in
    ``order`` (rising columns, nulls first).

    As in ``running`` a large group spans many partitions; what a row misses within its own comes from the last values of the
    group's earlier partitions.
    """
    keys = [F.col(c) for c in (*by, *order)]
    spread = materialised(rows.withColumns({f"__v_{n}": v for n, v in values.items()}).repartitionByRange(*keys).withColumn("__part", F.spark_partition_id()), "preceding")
    place = F.struct(*order)
    ends = spread.groupBy(*by, "__part").agg(*(F.max_by(f"__v_{n}", F.when(F.col(f"__v_{n}").isNotNull(), place)).alias(f"__e_{n}") for n in values))
    earlier = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = ends.select(*(F.col(c).alias(f"__b_{c}") for c in by), F.col("__part").alias("__b"), *(F.last(f"__e_{n}", True).over(earlier).alias(f"__l_{n}") for n in values))
    here = Window.partitionBy(*by, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    within = spread.select("*", *(F.last(f"__v_{n}", True).over(here).alias(f"__w_{n}") for n in values))
    same = reduce(lambda a, c: a & F.col(c).eqNullSafe(F.col(f"__b_{c}")), by, F.col("__part") == F.col("__b"))
    return within.join(before, same).select(*rows.columns, *(F.coalesce(f"__w_{n}", f"__l_{n}").alias(n) for n in values))
