"""Deterministic samples, strata and folds: every order is by a hash of the id, never by chance."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.canonical import canonical_json
from .prefix import running


def hash_order(*columns: str, seed: str | Column = "") -> Column:
    return F.md5(F.concat_ws(":", seed if isinstance(seed, Column) else F.lit(seed), *(F.col(c).cast("string") for c in columns)))


def ranked(df: DataFrame, value: str, key: str, by: list[str] | None = None, total: str | None = None, ranges: int | None = None) -> DataFrame:
    """``df`` with ``rank`` by (value, key) within ``by``, rows ``n`` and, if asked for, the running sum ``so_far`` of ``total``; nulls come first."""
    sums = {"rank": F.lit(1).cast("long")} | ({"so_far": F.col(total)} if total else {})
    return running(df, by or [], [value] if value == key else [value, key], sums, {"n": F.lit(1).cast("long")}, ranges)


def tile(rank: Column, n: Column, tiles: int) -> Column:
    """Which of ``tiles`` equal parts a rank falls into, from 0; the first parts take what is left over."""
    q, rest = F.floor(n / tiles), n % tiles
    head = rest * (q + 1)
    return F.when(rank <= head, F.floor((rank - 1) / (q + 1))).otherwise(rest + F.floor((rank - 1 - head) / F.greatest(q, F.lit(1)))).cast("int")


def quartiles(df: DataFrame, value: str, key: str, out: str) -> DataFrame:
    return ranked(df, value, key).withColumn(out, tile(F.col("rank"), F.col("n"), 4)).drop("rank", "n")


def per_class(df: DataFrame, label: str, key: str, k: int, seed: str) -> DataFrame:
    """The first ``k`` rows of each class in hash order."""
    w = Window.partitionBy(label).orderBy(hash_order(key, seed=seed), key)
    return df.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)


def quotas(df: DataFrame, stratum: str, size: int) -> DataFrame:
    """(stratum, quota): one of each stratum at least, the rest in proportion by largest remainder.

    The quotas sum to ``size``, or to the number of strata or rows if those bind. One row a stratum.
    """
    share = df.groupBy(stratum).agg(F.count("*").alias("k"))
    everything = Window.partitionBy()
    share = share.withColumns({"n": F.sum("k").over(everything), "strata": F.count("*").over(everything)})
    want = F.least(F.lit(size), F.col("n"))
    exact = F.col("k") * want / F.col("n")
    share = share.withColumn("base", F.least(F.col("k"), F.greatest(F.floor(exact), F.lit(1)))).withColumn("rest", exact - F.floor(exact))
    short = want - F.sum("base").over(everything)
    open_first = Window.orderBy(F.when(F.col("base") < F.col("k"), 0).otherwise(1), F.desc("rest"), stratum)
    over = Window.orderBy(F.when(F.col("base") > 1, 0).otherwise(1), "rest", F.desc(stratum))
    share = share.withColumns({"short": short, "up": F.row_number().over(open_first), "down": F.row_number().over(over)})
    change = F.when((F.col("short") > 0) & (F.col("up") <= F.col("short")) & (F.col("base") < F.col("k")), 1).when((F.col("short") < 0) & (F.col("down") <= -F.col("short")) & (F.col("base") > 1), -1).otherwise(0)
    return share.select(stratum, (F.col("base") + change).alias("quota"))


def _placed(df: DataFrame, by: list[str], key: str, seed: str | Column) -> DataFrame:
    """``df`` with ``place``, from 1 on, in hash order within ``by``."""
    rows = df.withColumn("_hash", hash_order(key, seed=seed))
    return running(rows, by, ["_hash", key], {"place": F.lit(1).cast("long")}).drop("_hash")


def proportional(df: DataFrame, stratum: str, key: str, size: int, seed: str) -> DataFrame:
    """``size`` rows, each stratum by its share and at least one of each."""
    return _placed(df, [stratum], key, seed).join(quotas(df, stratum, size), stratum).filter("place <= quota")


def crossed(df: DataFrame, first: str, second: str, key: str, size: int, seed: str) -> DataFrame:
    """``size`` rows by the shares of the cells of two columns' quartiles."""
    cells = quartiles(quartiles(df, first, key, "first_quartile"), second, key, "second_quartile")
    cells = cells.withColumn("stratum", F.concat_ws("|", F.concat(F.lit("first:"), "first_quartile"), F.concat(F.lit("second:"), "second_quartile")))
    return proportional(cells, "stratum", key, size, seed)


def unique_balanced(df: DataFrame, context: str, label: str, key: str, each: int, seed: str) -> DataFrame:
    """``each`` rows of every class, no context twice: of a context the row that comes first in hash order."""
    at = F.struct(hash_order(key, seed=seed), F.col(key))
    one = df.groupBy(context).agg(F.min_by(F.struct(*[c for c in df.columns if c != context]), at).alias("_r")).select(context, "_r.*")
    return per_class(one, label, key, each, seed)


def limited(df: DataFrame, order: str, key: str, size: int) -> DataFrame:
    """The first ``size`` rows by (order, key), numbered again from 0; a missing order counts as 0, too few rows are an error."""
    few = df.withColumn(order, F.coalesce(order, F.lit(0))).orderBy(order, key).limit(size)
    found = few.count()
    if found < size:
        raise ValueError(f"{found} rows, not {size}")
    return few.withColumn("selection_order", (F.row_number().over(Window.orderBy(order, key)) - 1).cast("long"))  # of ``size`` rows


def first_by_selector(df: DataFrame, key: str, selectors: list[tuple[str, Column]]) -> DataFrame:
    """For each selector in turn its first row by key that no earlier selector has taken: (selector, key); none if there is none."""
    taken, out = df.limit(0).select(key), None
    for name, condition in selectors:
        row = df.filter(condition).join(F.broadcast(taken), key, "left_anti").orderBy(key).limit(1).select(F.lit(name).alias("selector"), key)
        taken = taken.unionByName(row.select(key))
        out = row if out is None else out.unionByName(row)
    return out


def folds(df: DataFrame, label: str, stratum: str | None, key: str, k: int, seed: str | Column, by: list[str] | None = None) -> DataFrame:
    """Round-robin folds: classes and strata are dealt out in turn, each class goes on where its last stratum ended.

    Without ``stratum`` classes alone are dealt out; with ``by``, such as a column of seeds, each of its groups by itself.
    """
    by = by or []
    rows = df if stratum else df.withColumn("_one", F.lit(0))
    inner = stratum or "_one"
    sizes = rows.groupBy(*by, label, inner).agg(F.count("*").alias("size"))
    before = F.sum("size").over(Window.partitionBy(*by, label).orderBy(inner).rowsBetween(Window.unboundedPreceding, -1))
    keys = [*by, label, inner]
    offsets = sizes.select(*(F.col(c).alias(f"_of{i}") for i, c in enumerate(keys)), F.coalesce(before, F.lit(0)).alias("offset"))
    placed = _placed(rows, keys, key, seed).join(offsets, [F.col(c).eqNullSafe(F.col(f"_of{i}")) for i, c in enumerate(keys)])
    return placed.withColumn("fold", ((F.col("offset") + F.col("place") - 1) % k).cast("int")).drop("place", "offset", *(f"_of{i}" for i in range(len(keys))), *([] if stratum else ["_one"]))


def fold_count(minority: Column, most: int = 5, least: int = 2) -> Column:
    """Folds that the smaller class allows; null where it is too small for any."""
    return F.when(minority >= least, F.least(F.lit(most), minority))


def leave_one_out(df: DataFrame, key: str) -> DataFrame:
    """Each row is its own fold, numbered by key from 0."""
    return ranked(df, key, key).withColumn("fold", F.col("rank") - 1).drop("rank", "n")


def variant(*options: tuple[str, Column]) -> Column:
    """The name of the first variant whose audit is clean."""
    return reduce(lambda out, x: out.when(x[1], x[0]), options[1:], F.when(options[0][1], options[0][0]))


#: The protocols of a question with options.
PROTOCOLS = ("MC1", "MC2")


def choice_manifest(df: DataFrame, key: str, right: str, wrong: str, best: str, stratum: Column) -> DataFrame:
    """One row a question, its options in the order of sha256("seed:text"), the seed from the key's own digest; no option's text.

    (key, selection_order, sampling_stratum, option_count, correct_option_index of the best answer, correct_option_indices,
    mc_protocols, option_order_checksum). Questions are numbered from 0 by key. An index is null where the best answer
    isn't an option.
    """
    seed = F.conv(F.substring(F.sha2(F.col(key).cast("string"), 256), 1, 16), 16, 10)
    option = lambda x, ok: F.struct(F.sha2(F.concat(seed, F.lit(":"), x), 256).alias("h"), x.alias("text"), F.lit(ok).alias("correct"))
    keyed = F.array_sort(F.concat(F.transform(right, lambda x: option(x, True)), F.transform(wrong, lambda x: option(x, False))))
    placed = running(df.select(key, right, wrong, best, stratum.alias("sampling_stratum")), [], [key], {"_place": F.lit(1).cast("long")})
    rows = placed.select(key, "_place", F.col(best).alias("_best"), "sampling_stratum", keyed.alias("_o"))
    places = lambda ok: F.filter(F.transform("_o", lambda o, i: F.when(ok(o), i)), lambda i: i.isNotNull())
    rows = rows.withColumns({"correct_option_indices": places(lambda o: o["correct"]), "_at": places(lambda o: o["correct"] & (o["text"] == F.col("_best")))})
    texts = F.transform("_o", lambda o: o["text"])
    escaped = canonical_json(rows.select(texts.alias("x")), "x")  # {"x":[...]}
    rows = rows.withColumn("x", texts)
    checksum = F.sha2(F.substring(escaped, F.lit(6), F.length(escaped) - 6), 256)
    return rows.withColumn("option_order_checksum", checksum).select(key, (F.col("_place") - 1).alias("selection_order"), "sampling_stratum", F.size("_o").alias("option_count"), F.get("_at", F.lit(0)).alias("correct_option_index"), "correct_option_indices", F.array(*map(F.lit, PROTOCOLS)).alias("mc_protocols"), "option_order_checksum")
