"""Running sums and places in an order over whole tables, in two levels.

The order is cut into ranges at places of a random sample of rows. What stands before a range is added up from one
row a range and group; within a range a window does the rest. Ranges are of the whole order, ties broken by all its
columns: a hot group or a hot value lies in many of them. So no task holds a table, a group or a value, and results
are exact wherever the cuts are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Least and most ranges (their number follows spark.sql.shuffle.partitions) and sampled rows for each.
LEAST_RANGES, MOST_RANGES, SAMPLE_EACH = 16, 1024, 16
UP_TO_HERE = (Window.unboundedPreceding, Window.currentRow)


def number_of_ranges(df: DataFrame) -> int:
    return min(MOST_RANGES, max(LEAST_RANGES, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def range_of(df: DataFrame, order: list[str], ranges: int | None = None) -> Column:
    """The range of a row by ``order``, nulls first, from 0: how many cuts are not above it.

    One job draws the sample; what reaches the driver is ``ranges * SAMPLE_EACH`` rows of these columns, made cuts there.
    """
    n = ranges or number_of_ranges(df)
    schema = df.select(*order).schema
    own = F.struct(*(F.col(c).alias(f"o{i}") for i, c in enumerate(order)))
    sample = df.select(own.alias("o")).orderBy(F.rand(17)).limit(n * SAMPLE_EACH)
    drawn = sample.agg(F.array_sort(F.array_distinct(F.collect_list("o"))).alias("o")).first()["o"]
    cuts = [drawn[i * len(drawn) // n] for i in range(1, n)] if len(drawn) >= n else drawn
    if not cuts:
        return F.lit(0)
    literal = F.array(*(F.struct(*(F.lit(v).cast(f.dataType).alias(f"o{i}") for i, (v, f) in enumerate(zip(c, schema, strict=True)))) for c in cuts))
    steps = [1 << b for b in range(len(cuts).bit_length() - 1, -1, -1)]

    def further(at: Column, step: Column) -> Column:
        reached = (at + step <= len(cuts)) & (F.get(literal, at + step - 1) <= own)
        return F.when(reached, at + step).otherwise(at)

    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), further)


def running(df: DataFrame, by: list[str], order: list[str], sums: dict[str, Column], whole: dict[str, Column] | None = None, ranges: int | None = None) -> DataFrame:
    """``df`` with running sums ``sums`` up to each row, and sums ``whole`` of all its group's rows, groups by ``by``.

    Rows are in ascending order of ``order``, nulls first; ``order`` should tell the rows of a group apart: equal ones
    come in any order, and very many of them would meet in one task. Groups may be null. Make columns by higher-order
    functions after this rather than before: Spark's optimizer fails on some that a union would carry.
    """
    whole = whole or {}
    values = {f"_v{i}": v for i, v in enumerate([*sums.values(), *whole.values()])}
    rows = df.withColumn("_range", range_of(df, [*by, *order], ranges)).withColumns(values)
    parts = rows.groupBy(*by, "_range").agg(*(F.sum(v).alias(v) for v in values))
    running_, all_ = [f"_v{i}" for i in range(len(sums))], [f"_v{i}" for i in range(len(sums), len(values))]
    if by:  # a row for each group and range: of a group as many as there are ranges
        before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
        marks = parts.select(*by, "_range", *(F.sum(v).over(before).alias(f"_b{v}") for v in running_), *(F.sum(v).over(Window.partitionBy(*by)).alias(f"_b{v}") for v in all_))
    else:
        marks = _marks(parts, running_, all_)
    both = rows.withColumn("_mark", F.lit(1)).unionByName(marks.withColumn("_mark", F.lit(0)), allowMissingColumns=True)
    w = Window.partitionBy(*by, "_range").orderBy("_mark", *order).rowsBetween(*UP_TO_HERE)
    value = lambda v: F.when(F.col("_mark") == 0, F.col(f"_b{v}")).otherwise(F.col(v))
    out = both.withColumns({name: F.sum(value(v)).over(w) for name, v in zip(sums, running_, strict=True)} | {name: F.first(f"_b{v}", True).over(w) for name, v in zip(whole, all_, strict=True)})
    kept = [c for c in df.columns if c not in sums and c not in whole]
    return out.filter("_mark = 1").select(*kept, *sums, *whole)


def _marks(parts: DataFrame, running_: list[str], all_: list[str]) -> DataFrame:
    """Without groups the ranges' sums, at most ``MOST_RANGES`` rows, are added up on the driver."""
    rows = sorted(parts.collect(), key=lambda r: r["_range"])
    names = [*running_, *all_]
    totals = {v: None for v in names}
    before = []
    for r in rows:
        before.append([r["_range"], *(totals[v] for v in running_)])
        for v in names:
            if r[v] is not None:
                totals[v] = r[v] if totals[v] is None else totals[v] + r[v]
    schema = "_range int" + "".join(f", _b{v} {parts.schema[v].dataType.simpleString()}" for v in names)
    return parts.sparkSession.createDataFrame([tuple([*b, *(totals[v] for v in all_)]) for b in before], schema)
