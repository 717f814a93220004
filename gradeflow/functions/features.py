"""Families of feature columns: flattening, projections, flags, labels and audits of columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as Y

#: Fixed value: overlap that an alias match must have to count as verified.
VERIFIED = 0.8


def flag_is(path: str, expected: bool) -> Column:
    """A nested flag that has the value; a missing one has neither."""
    return F.coalesce(F.col(path) == F.lit(expected), F.lit(False))


def resolved(error: str, truncated: str) -> Column:
    """Rows with a label that weren't cut off; a missing flag counts as not cut off."""
    return F.col(error).isNotNull() & ~F.coalesce(F.col(truncated), F.lit(False))


def flattened(df: DataFrame, column: str, sizes: dict[str, int] | None = None) -> dict[str, Column]:
    """Every number and flag of a nested record as a double, by its path; lists of a stated size by place, ``name_00`` on."""
    out: dict[str, Column] = {}

    def walk(x: Column, kind: Y.DataType, path: str) -> None:
        if isinstance(kind, Y.StructType):
            for f in kind.fields:
                walk(x[f.name], f.dataType, f"{path}_{f.name}" if path else f.name)
        elif isinstance(kind, Y.ArrayType):
            if path not in (sizes or {}):
                raise ValueError(f"the list {path} has no stated size")
            for i in range(sizes[path]):
                walk(F.get(x, F.lit(i)), kind.elementType, f"{path}_{i:02d}")
        elif isinstance(kind, (Y.NumericType, Y.BooleanType)):
            out[path] = x.cast("double")

    walk(F.col(column), df.schema[column].dataType, "")
    return dict(sorted(out.items()))


def bad_leaves(df: DataFrame, column: str) -> Column:
    """How many numbers anywhere in a nested record aren't finite; a null isn't a number."""
    wild = lambda x: F.isnan(x) | (F.abs(x) == float("inf"))

    def walk(x: Column, kind: Y.DataType) -> list[Column]:
        if isinstance(kind, Y.StructType):
            return [c for f in kind.fields for c in walk(x[f.name], f.dataType)]
        if isinstance(kind, Y.ArrayType):
            inner = lambda v: reduce(lambda a, b: a + b, walk(v, kind.elementType), F.lit(0))
            return [F.coalesce(F.aggregate(x, F.lit(0), lambda s, v: s + inner(v)), F.lit(0))]
        if isinstance(kind, (Y.DoubleType, Y.FloatType)):
            return [F.coalesce(wild(x).cast("int"), F.lit(0))]
        return []

    return reduce(lambda a, b: a + b, walk(F.col(column), df.schema[column].dataType), F.lit(0))


def _needed(df: DataFrame, names: list[str]) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise KeyError(f"no columns {missing}")


def family(df: DataFrame, key: str, families: dict[str, list[str]], chosen: tuple[str, ...]) -> DataFrame:
    """The columns of the chosen families in their order, rows with a null among them left out."""
    names = [c for f in chosen for c in families[f]]
    _needed(df, names)
    return df.select(key, *names).dropna(subset=names)


def compact(df: DataFrame, key: str, names: tuple[str, ...]) -> DataFrame:
    _needed(df, list(names))
    return df.select(key, *names)


def without(df: DataFrame, parts: tuple[str, ...]) -> DataFrame:
    """All columns but those whose name holds one of the parts."""
    return df.select(*(c for c in df.columns if not any(p in c for p in parts)))


def matrix(df: DataFrame, key: str, families: tuple[str, ...]) -> DataFrame:
    """All fields of some struct columns as ``family_field``, in order of these names."""
    names = sorted((f, x.name) for f in families for x in df.schema[f].dataType.fields)
    return df.select(key, *(F.col(f"{f}.{x}").alias(f"{f}_{x}") for f, x in names))


def by_prefix(df: DataFrame, prefix: str) -> list[str]:
    return sorted(c for c in df.columns if c.startswith(prefix))


def prefer(df: DataFrame, record: str, field: str) -> Column:
    """A field of a sub-record where it is there and has it, else of the row itself."""
    inner = [f.name for f in df.schema[record].dataType.fields]
    return F.coalesce(F.col(f"{record}.{field}"), F.col(field)) if field in inner else F.col(field)


def error_variants(strict: Column, alias: Column, f1: Column) -> dict[str, Column]:
    """Three ways to call a response wrong."""
    return {"strict": (~strict).cast("int"), "alias": (~alias).cast("int"), "verified": (~(alias & (f1 >= VERIFIED))).cast("int")}


def relabelled(records: DataFrame, labels: DataFrame, key: str, target: str) -> DataFrame:
    return records.join(labels.filter(F.col(target).isNotNull()).select(key, target), key)


def one_hot(df: DataFrame, column: str, prefix: str) -> DataFrame:
    """A double for each level in order but the last; the levels are read from the rows."""
    levels = [r[0] for r in df.select(column).filter(F.col(column).isNotNull()).distinct().orderBy(column).collect()]  # one row a level
    return df.select(*(c for c in df.columns if c != column), *((F.col(column) == v).cast("double").alias(prefix + str(v).lower()) for v in levels[:-1]))


def first_verdict(error: str, *verdicts: str, present: Column | None = None) -> Column:
    """Correctness from an error label if there is one, else the first verdict that is there, else false.

    Where records tell a null label from none, ``present`` says where the field is there: a null label that is means no error.
    """
    rest = F.coalesce(*verdicts, F.lit(False))
    there = F.col(error).isNotNull() if present is None else present
    return F.when(there, F.coalesce(F.col(error), F.lit(0)) == 0).otherwise(rest)


def bucket(x: Column, width: int, most: int = 3) -> Column:
    """Fixed-width buckets, the last one open."""
    return F.least(F.lit(most), F.floor(x / width)).cast("string")


def distributions(df: DataFrame, fields: dict[str, Column]) -> DataFrame:
    """(field, value, n) of several fields in one pass."""
    pairs = F.array(*(F.struct(F.lit(k).alias("field"), c.cast("string").alias("value")) for k, c in fields.items()))
    return df.select(F.explode(pairs).alias("x")).groupBy("x.field", "x.value").agg(F.count("*").alias("n"))


def equal_columns(df: DataFrame, key: str, columns: list[str]) -> list[list[str]]:
    """Groups of columns that are equal in every row.

    One aggregate gives each column a sum of hashes of (row, value); columns of equal sums are then compared row by row.
    """
    sums = df.agg(*(F.sum(F.xxhash64(F.col(key), F.col(c)).cast("decimal(38,0)")).alias(c) for c in columns)).first()
    by: dict = {}
    for c in columns:
        by.setdefault(sums[c], []).append(c)
    alike = [g for g in by.values() if len(g) > 1]
    if not alike:
        return []
    same = df.agg(*(F.bool_and(F.col(g[0]).eqNullSafe(F.col(c))).alias(c) for g in alike for c in g[1:])).first()
    groups = [[g[0], *(c for c in g[1:] if same[c])] for g in alike]
    return sorted(g for g in groups if len(g) > 1)
