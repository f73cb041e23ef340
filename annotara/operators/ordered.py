"""Numbers and running sums over a whole table without one task that sorts it.

Rows are range-partitioned by the order and sorted within partitions; the
partitions' totals (one row each) give every partition its start, and the rest
is a window inside a partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annotara.session import cut, partitions


def _placed(rows: DataFrame, order: list[Column]) -> DataFrame:
    """Rows in range partitions with the partition's number, cut so it stays."""
    spread = rows.repartitionByRange(partitions(rows.sparkSession), *order)
    return cut(spread.withColumn("_part", F.spark_partition_id()))


def running(rows: DataFrame, order: list[Column], sums: dict[str, str]) -> DataFrame:
    """A running sum {new column: column} up to and with each row of a total
    order; ties in the order may come in any order."""
    placed = _placed(rows, order)
    totals = placed.groupBy("_part").agg(*[F.sum(c).alias(n) for n, c in sums.items()]).orderBy("_part").collect()
    start = {n: 0 for n in sums}
    at: dict[int, dict[str, object]] = {}
    for t in totals:
        at[t["_part"]] = dict(start)
        start = {n: start[n] + (t[n] or 0) for n in sums}
    w = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = placed
    for n, c in sums.items():
        base = F.lit(0)
        if at:
            base = F.element_at(F.create_map(*[F.lit(x) for p, s in at.items() for x in (p, s[n])]), F.col("_part"))
        out = out.withColumn(n, F.coalesce(F.sum(c).over(w), F.lit(0)) + base)
    return out.drop("_part")


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """0-based numbers of the rows in a total order."""
    out = running(rows.withColumn("_one", F.lit(1)), order, {name: "_one"})
    return out.withColumn(name, (F.col(name) - 1).cast("bigint")).drop("_one")
