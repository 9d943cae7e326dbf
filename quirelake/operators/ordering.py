"""Ordering operators: numbering, islands, gap filling, as-of and interval joins.

numbered() stays even when one group holds much of the table: a group is cut into blocks of its numeric order column,
blocks are summed with map-side combination, and only the short table of block sums is put through a window per group.
The others run plain windows over a group, which is a book's pages, notes or chapters: bounded by the book, not split.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1 << 12


def _columns(names: list[str]) -> list[Column]:
    return [F.col(n) for n in names]


def numbered(df: DataFrame, group: list[str], order: str, name: str, block: int = BLOCK, then: tuple[str, ...] = ()) -> DataFrame:
    """row_number() over (partition by group order by order, then) for an integer order column, which cuts the blocks; the
    order columns together are unique per group."""
    df = df.withColumn("_block", F.floor(F.col(order) / block))
    sums = df.groupBy(*group, "_block").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = Window.partitionBy(*group, "_block").orderBy(order, *then)
    out = df.withColumn("_row", F.row_number().over(inside)).join(sums, [*group, "_block"])
    return out.withColumn(name, (F.col("_row") + F.col("_before")).cast("int")).drop("_row", "_before", "_block")


def islands(df: DataFrame, group: list[str], position: str, gap: int = 1) -> DataFrame:
    """Maximal runs of distinct positions whose neighbours differ by at most `gap`: start, end and size of each."""
    rows = df.where(F.col(position) > 0).select(*group, position).distinct()
    w = Window.partitionBy(*group).orderBy(position)
    rows = rows.withColumn("_new", F.coalesce((F.col(position) - F.lag(position).over(w) > gap).cast("int"), F.lit(1)))
    rows = rows.withColumn("_run", F.sum("_new").over(w))
    return rows.groupBy(*group, "_run").agg(F.min(position).alias("start"), F.max(position).alias("end"), F.count("*").alias("size")).drop("_run")


def strict_runs(df: DataFrame, group: list[str], position: str, tie: str) -> DataFrame:
    """As islands(), but duplicates are kept and break a run: a new run starts wherever the step is not one."""
    w = Window.partitionBy(*group).orderBy(position, tie)
    rows = df.withColumn("_new", F.coalesce((F.col(position) - F.lag(position).over(w) != 1).cast("int"), F.lit(1)))
    rows = rows.withColumn("_run", F.sum("_new").over(w))
    return rows.groupBy(*group, "_run").agg(F.min(position).alias("start"), F.max(position).alias("end"), F.count("*").alias("size")).drop("_run")


def merged_runs(df: DataFrame, group: list[str], gap: int) -> DataFrame:
    """Intervals (start, end) of a group joined where the next starts at most `gap` after all earlier ends."""
    w = Window.partitionBy(*group).orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = df.withColumn("_new", F.coalesce((F.col("start") > reach + gap).cast("int"), F.lit(1)))
    rows = rows.withColumn("_run", F.sum("_new").over(w))
    return rows.groupBy(*group, "_run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("parts")).drop("_run")


def ranges_from_starts(df: DataFrame, group: list[str], start: str, last: str) -> DataFrame:
    """end of each range: one before the next start, or the group's last position."""
    w = Window.partitionBy(*group).orderBy(start)
    return df.withColumn("end", F.coalesce(F.lead(start).over(w) - 1, F.col(last)))


def as_of(left: DataFrame, right: DataFrame, group: list[str], at: str, start: str, take: list[str]) -> DataFrame:
    """Each left row with the right row of the greatest start <= at. Both sides are merged and filled forward, so no
    pair of rows is ever built."""
    value = F.struct(F.col(start).alias("_start"), *_columns(take))
    names = [*left.columns]
    a = left.select(*names, F.lit(1).alias("_side"), F.lit(None).cast(_struct_type(right, start, take)).alias("_right"), F.col(at).alias("_at"))
    b = right.select(*[F.col(n) if n in group else F.lit(None).cast(left.schema[n].dataType).alias(n) for n in names], F.lit(0).alias("_side"), value.alias("_right"), F.col(start).alias("_at"))
    w = Window.partitionBy(*group).orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    out = a.unionByName(b).withColumn("_found", F.last("_right", ignorenulls=True).over(w)).where("_side = 1")
    return out.select(*names, *(F.col(f"_found.{t}").alias(t) for t in take))


def _struct_type(df: DataFrame, start: str, take: list[str]) -> str:
    fields = ", ".join(f"{n}: {df.schema[c].dataType.simpleString()}" for n, c in [("_start", start), *((t, t) for t in take)])
    return f"struct<{fields}>"


def interval_join(points: DataFrame, ranges: DataFrame, group: list[str], at: str, start: str, end: str, width: int = 32, how: str = "inner") -> DataFrame:
    """Points inside ranges, as an equi-join on bins of `width` positions; ranges list each bin they touch."""
    binned = ranges.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))
    keyed = points.withColumn("_bin", F.floor(F.col(at) / width))
    on = reduce(lambda a, b: a & b, [keyed[g].eqNullSafe(binned[g]) for g in group] + [keyed["_bin"] == binned["_bin"], keyed[at] >= binned[start], keyed[at] <= binned[end]])
    return keyed.join(binned, on, how).drop(*(binned[g] for g in group)).drop("_bin")


def filled(df: DataFrame, group: list[str], order: str, value: str) -> DataFrame:
    """Linear filling of missing values between known ones, where the values' step equals the positions' step."""
    w = Window.partitionBy(*group).orderBy(order)
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(order).alias("o"), F.col(value).alias("v")))
    before = F.last(known, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(known, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    df = df.withColumn("_a", before).withColumn("_b", after)
    even = (F.col("_b.v") - F.col("_a.v")) == (F.col("_b.o") - F.col("_a.o"))
    return df.withColumn(f"{value}_filled", F.coalesce(F.col(value), F.when(even, F.col("_a.v") + F.col(order) - F.col("_a.o")))).drop("_a", "_b")


def interpolated(df: DataFrame, group: list[str], order: str, value: str) -> DataFrame:
    """Linear interpolation between the nearest known values, rounded half to even; known values win."""
    w = Window.partitionBy(*group).orderBy(order)
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(order).alias("o"), F.col(value).alias("v")))
    df = df.withColumn("_a", F.last(known, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_b", F.first(known, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    slope = (F.col("_b.v") - F.col("_a.v")) * (F.col(order) - F.col("_a.o")) / F.nullif(F.col("_b.o") - F.col("_a.o"), F.lit(0))
    between = F.bround(F.col("_a.v") + slope, 0)
    return df.withColumn(f"{value}_filled", F.coalesce(F.col(value), between.cast("int"))).drop("_a", "_b")


def latest(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The newest row of each key, by max over a struct: combined map-side, unlike a window."""
    rest = [c for c in df.columns if c not in key]
    top = df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_top"))
    return top.select(*key, *(F.col(f"_top.{c}").alias(c) for c in rest)).select(*df.columns)


def first_of(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in an order."""
    rest = [c for c in df.columns if c not in key]
    top = df.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_top"))
    return top.select(*key, *(F.col(f"_top.{c}").alias(c) for c in rest)).select(*df.columns)


def upserted(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """old with new laid over it; a null in new keeps the old value."""
    rest = [c for c in old.columns if c not in key]
    a, b = old.alias("o"), new.alias("n")
    on = reduce(lambda x, y: x & y, [F.col(f"o.{k}") == F.col(f"n.{k}") for k in key])
    return a.join(b, on, "full").select(*(F.coalesce(F.col(f"n.{k}"), F.col(f"o.{k}")).alias(k) for k in key), *(F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) for c in rest))
