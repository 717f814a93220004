"""Key-set checks, checksums, gates and leakage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.canonical import canonical_json


def missing_and_unexpected(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """One row: keys expected but not found, found but not expected, and found more than once."""
    a, b = expected.select(key).distinct(), found.groupBy(key).agg(F.count("*").alias("k"))
    both = a.withColumn("e", F.lit(1)).join(b, key, "full_outer")
    return both.agg(F.count_if(F.col("k").isNull()).alias("missing"), F.count_if(F.col("e").isNull()).alias("unexpected"), F.coalesce(F.sum(F.col("k") - 1), F.lit(0)).cast("long").alias("duplicates"))


def checksum(df: DataFrame, *columns: str) -> Column:
    """SHA-256 of the canonical JSON of some columns: keys in order, no blanks, nulls as such."""
    return F.sha2(canonical_json(df, *columns), 256)


def leakage(a: DataFrame, b: DataFrame, key: str, a_id: str, b_id: str) -> DataFrame:
    """Ids of the second split whose non-empty key the first has too, with the smallest id there and how many there are.

    One row for each id of the second split: keys that both sides repeat make no pairs.
    """
    left = a.filter(F.col(key) != "").groupBy(key).agg(F.min(a_id).alias("left_id"), F.count("*").alias("left_rows"))
    return b.filter(F.col(key) != "").select(F.col(b_id).alias("right_id"), key).join(left, key).select("left_id", "left_rows", "right_id")


def sample_size(accuracy: Column, guard: float = 0.0) -> Column:
    """Rows needed for a hundred of each class at this accuracy; null at 0 and 1."""
    need = F.greatest(F.lit(100.0) / accuracy, F.lit(100.0) / (1.0 - accuracy))
    return F.when((accuracy > 0) & (accuracy < 1), F.ceil(need - guard).cast("long"))


def reasons(*checks: tuple[str, Column]) -> Column:
    """The names of the checks that fail, comma-joined; empty if all hold."""
    return F.concat_ws(",", *(F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in checks))


def split_checksum(df: DataFrame, by: list[str], key: str, fold: str, width: int = 1024, levels: int | None = None) -> DataFrame:
    """(by, digest, lines): the root of the hash tree over the key:fold lines in key order, of ``width`` lines or nodes each; with ``levels`` of each tree of so many levels."""
    from ..sources.ordered import tree_digests

    return tree_digests(df.withColumn("_pair", F.concat_ws(":", F.col(key).cast("string"), F.col(fold).cast("string"))), by, [key, "_pair"], "_pair", width, levels)


def iso_utc(at: Column) -> Column:
    """A time as text in UTC, whatever the session's zone."""
    return F.concat(F.date_format(F.to_utc_timestamp(at, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))


def seeded_order(key: Column, options: Column) -> Column:
    """Options in the order of sha256("seed:option"); the seed is the first 16 hex digits of the key's digest, as a number."""
    seed = F.conv(F.substring(F.sha2(key, 256), 1, 16), 16, 10)  # an unsigned 64-bit number, kept as text
    keyed = F.transform(options, lambda x: F.struct(F.sha2(F.concat(seed, F.lit(":"), x), 256).alias("h"), x.alias("x")))
    return F.transform(F.array_sort(keyed), lambda s: s["x"])


def is_subset(a: DataFrame, b: DataFrame, key: str) -> bool:
    """Whether every key of ``a`` stands in ``b``."""
    return a.select(key).join(b.select(key), key, "left_anti").isEmpty()


def forbidden(df: DataFrame, names: tuple[str, ...]) -> list[str]:
    """Fields of a table, nested ones too, that it must not have."""

    def walk(schema) -> list[str]:
        out = []
        for f in schema.fields:
            kind = getattr(f.dataType, "elementType", f.dataType)
            out += [f.name] + (walk(kind) if hasattr(kind, "fields") else [])
        return out

    return sorted({x for x in walk(df.schema) if x.lower() in names})


def overlay(df: DataFrame, corrections: DataFrame, key: str) -> DataFrame:
    """``df`` with the fields of ``corrections`` where it has a row of the same key."""
    changed = [c for c in corrections.columns if c != key]
    new = corrections.select(key, F.struct(*changed).alias("_new"))
    out = df.join(new, key, "left")
    return out.select(*(F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in changed else F.col(c) for c in df.columns))


def matched_by_digest(manifest: DataFrame, records: DataFrame, key: str, digest: str) -> DataFrame:
    """The manifest's records by id; one that is missing, or whose digest isn't the manifest's, is an error."""
    from ..functions.canonical import record_digest

    own = records.withColumn("_own", record_digest(records))
    out = manifest.join(own, key, "left")
    wrong = F.raise_error(F.concat(F.lit("another record than the manifest's: "), F.col(key).cast("string"))).cast("string")
    return out.withColumn(digest, F.when(F.col("_own").eqNullSafe(F.col(digest)), F.col(digest)).otherwise(wrong)).drop("_own")


def balance(df: DataFrame, by: list[str], most: int) -> DataFrame:
    """One row: how many cells there are, their least and most rows, and whether these differ by at most ``most``."""
    cells = df.groupBy(*by).agg(F.count("*").alias("n"))
    return cells.agg((F.max("n") - F.min("n") <= most).alias("balanced"), F.count("*").alias("cells"), F.min("n").alias("low"), F.max("n").alias("high"))
