"""Canonical JSON: keys in order, no blanks, non-ASCII kept, numbers as Python writes them.

What built-in functions can write stays with them. Numbers with fractions, decimals, maps and what holds such are
written by a function compiled from the schema, column by column over Arrow arrays.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as Y

from ..sources.ship import ship_package

#: The short escapes of JSON strings; other control characters are written with their number.
ESCAPES = (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f"))
_LEFT = [chr(i) for i in range(32) if chr(i) not in "\n\r\t\b\f"]


Writer = Callable[[pa.Array], list[str]]


def decimal_text(x: Decimal) -> str:
    """As Python writes the number as a float if those digits are all of it, else all its digits."""
    short = repr(float(x))
    return short if Decimal(short) == x else format(x, "f")


def compiled(kind: Y.DataType, item: str, pair: str) -> Writer:
    """A function that writes an Arrow array of ``kind`` as JSON texts; a kind that JSON or Python has no text for raises here."""

    def of_values(write: Callable) -> Writer:
        return lambda a: ["null" if v is None else write(v) for v in a.to_pylist()]

    if isinstance(kind, (Y.DoubleType, Y.FloatType)):
        return of_values(lambda v: json.dumps(float(v)))
    if isinstance(kind, Y.DecimalType):
        return of_values(lambda v: str(int(v))) if kind.scale == 0 else of_values(decimal_text)
    if isinstance(kind, Y.BooleanType):
        return of_values(lambda v: "true" if v else "false")
    if isinstance(kind, Y.IntegralType):
        return of_values(str)
    if isinstance(kind, (Y.StringType, Y.VarcharType, Y.CharType)):
        return of_values(lambda v: json.dumps(v, ensure_ascii=False))
    if isinstance(kind, Y.NullType):
        return lambda a: ["null"] * len(a)
    if isinstance(kind, Y.ArrayType):
        inner = compiled(kind.elementType, item, pair)

        def array(a: pa.Array) -> list[str]:
            first, texts = a.offsets.to_pylist(), inner(a.values)
            return [f"[{item.join(texts[x:y])}]" if ok else "null" for x, y, ok in zip(first[:-1], first[1:], a.is_valid().to_pylist(), strict=True)]

        return array
    if isinstance(kind, Y.MapType):
        if not isinstance(kind.keyType, (Y.StringType, Y.IntegralType)):
            raise TypeError(f"keys of {kind.simpleString()} have no JSON text")
        value = compiled(kind.valueType, item, pair)

        def mapping(a: pa.Array) -> list[str]:
            first, keys, texts, out = a.offsets.to_pylist(), a.keys.to_pylist(), value(a.items), []
            for x, y, ok in zip(first[:-1], first[1:], a.is_valid().to_pylist(), strict=True):
                entries = sorted(zip(keys[x:y], texts[x:y], strict=True), key=lambda e: e[0])
                out.append("{" + item.join(f"{json.dumps(str(k), ensure_ascii=False)}{pair}{v}" for k, v in entries) + "}" if ok else "null")
            return out

        return mapping
    if isinstance(kind, Y.StructType):
        fields = sorted(((f.name, json.dumps(f.name, ensure_ascii=False) + pair, compiled(f.dataType, item, pair)) for f in kind.fields), key=lambda f: f[0])

        def record(a: pa.Array) -> list[str]:
            columns = [[head + t for t in write(a.field(name))] for name, head, write in fields]
            rows = map(item.join, zip(*columns, strict=True)) if columns else [""] * len(a)
            return ["{" + t + "}" if ok else "null" for t, ok in zip(rows, a.is_valid().to_pylist(), strict=True)]

        return record
    raise TypeError(f"{kind.simpleString()} has no JSON text: cast it first")


def _by_arrow(x: Column, kind: Y.DataType, item: str, pair: str) -> Column:
    write = compiled(kind, item, pair)

    @F.arrow_udf(Y.StringType())
    def text(a: pa.Array) -> pa.Array:
        return pa.array(write(a), pa.string())

    return text(x)


def _string(x: Column) -> Column:
    for raw, escaped in ESCAPES:
        x = F.replace(x, F.lit(raw), F.lit(escaped))
    rare = x
    for c in _LEFT:
        rare = F.replace(rare, F.lit(c), F.lit(f"\\u{ord(c):04x}"))
    return F.concat(F.lit('"'), F.when(x.rlike(r"[\x00-\x1f]"), rare).otherwise(x), F.lit('"'))


def _value(x: Column, kind: Y.DataType, item: str, pair: str) -> Column:
    if isinstance(kind, Y.StructType):
        out = _object([(f.name, x[f.name], f.dataType) for f in kind.fields], item, pair)
    elif _needs_arrow(kind):
        return _by_arrow(x, kind, item, pair)
    elif isinstance(kind, Y.ArrayType):
        out = F.concat(F.lit("["), F.array_join(F.transform(x, lambda v: _value(v, kind.elementType, item, pair)), item), F.lit("]"))
    elif isinstance(kind, (Y.IntegralType, Y.BooleanType)):
        out = x.cast("string")
    elif isinstance(kind, (Y.StringType, Y.VarcharType, Y.CharType, Y.DateType, Y.TimestampType, Y.TimestampNTZType, Y.NullType)):
        out = _string(x.cast("string"))
    else:
        raise TypeError(f"{kind.simpleString()} has no JSON text: cast it first")
    return F.when(x.isNull(), "null").otherwise(out)


def _object(fields: list[tuple[str, Column, Y.DataType]], item: str, pair: str) -> Column:
    parts = [F.concat(F.lit(json.dumps(name, ensure_ascii=False) + pair), _value(x, kind, item, pair)) for name, x, kind in sorted(fields, key=lambda f: f[0])]
    return F.concat(F.lit("{"), F.concat_ws(item, *parts), F.lit("}"))


def _needs_arrow(kind: Y.DataType) -> bool:
    """Whether a column of this kind has parts that built-in functions don't write as Python does; of a struct each field is by itself."""
    if isinstance(kind, Y.ArrayType):
        return _any_needs(kind.elementType)
    return isinstance(kind, (Y.DoubleType, Y.FloatType, Y.DecimalType, Y.MapType))


def _any_needs(kind: Y.DataType) -> bool:
    return any(_any_needs(f.dataType) for f in kind.fields) if isinstance(kind, Y.StructType) else _needs_arrow(kind)


def canonical_json(df: DataFrame, *columns: str, item: str = ",", pair: str = ":") -> Column:
    """The JSON text of some columns of ``df`` (all if none are named), equal to Python's ``json.dumps`` with sorted keys.

    Dates and times are texts as Spark casts them; decimals are numbers with all their digits. Binary values and
    intervals, maps with keys that aren't texts or whole numbers, and dates inside maps or arrays of doubles raise.
    """
    fields = [f for f in df.schema.fields if not columns or f.name in columns]
    if any(_any_needs(f.dataType) for f in fields):
        ship_package(df.sparkSession)
    return _object([(f.name, F.col(f"`{f.name}`"), f.dataType) for f in fields], item, pair)


def record_digest(df: DataFrame, *columns: str) -> Column:
    """SHA-256 of a record as a line of a file: blanks after commas and colons, and a newline."""
    return F.sha2(F.concat(canonical_json(df, *columns, item=", ", pair=": "), F.lit("\n")), 256)


def identity(prefix: str, config: dict) -> str:
    """A run's name: the prefix and 16 hex digits of its settings' digest."""
    import hashlib

    text = json.dumps(config, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    return f"{prefix}_{hashlib.sha256(text.encode()).hexdigest()[:16]}"
