"""Gates that a calibration run must pass before a full one, and what a collection must fulfil."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tails import normal_below

from .integrity import sample_size

#: The most that may be cut off, fail to parse or loop, the least of each class, and of a projection.
MOST_BAD, LEAST_CLASS, LEAST_ACCURACY, SIZE, GUARD = 0.05, 20, 0.05, 100, 1e-12
Z95, LEAST_POWER = 1.96, 0.8


def rate(condition: Column) -> Column:
    """Share of rows; 1 of no rows, so that an empty run fails."""
    return F.coalesce(F.count_if(condition) / F.nullif(F.count("*"), F.lit(0)), F.lit(1.0))


def label_gate(df: DataFrame, by: list[str], error: str, expected: int) -> DataFrame:
    """Passed if the count is as expected, at most 5 % are unresolved (null) and each class has 20."""
    out = df.groupBy(*by).agg(F.count("*").alias("n"), rate(F.col(error).isNull()).alias("unresolved_rate"), F.count_if(F.col(error) == 1).alias("wrong"), F.count_if(F.col(error) == 0).alias("right"))
    ok = (F.col("n") == expected) & (F.col("unresolved_rate") <= MOST_BAD) & (F.col("wrong") >= LEAST_CLASS) & (F.col("right") >= LEAST_CLASS)
    return out.withColumn("passed", ok)


def response_gate(df: DataFrame, by: list[str], truncated: Column, unparsed: Column, loops: Column, correct: Column, expected: int = SIZE) -> DataFrame:
    """As many records as expected, few cut off, unparsed or looping, some right, and a size to collect that is defined."""
    out = df.groupBy(*by).agg(F.count("*").alias("n"), rate(truncated).alias("truncation"), rate(unparsed).alias("parse_failure"), rate(loops).alias("loop_rate"), F.coalesce(F.avg(correct.cast("double")), F.lit(0.0)).alias("accuracy"))
    out = out.withColumn("projected", sample_size(F.col("accuracy")))
    ok = (F.col("n") == expected) & (F.col("truncation") <= MOST_BAD) & (F.col("parse_failure") <= MOST_BAD) & (F.col("loop_rate") <= MOST_BAD) & (F.col("accuracy") >= LEAST_ACCURACY) & F.col("projected").isNotNull()
    return out.withColumn("passed", ok)


def model_gate(df: DataFrame, by: list[str], truncated: Column, status: Column, correct: Column, verified: Column, available: Column, expected: int = SIZE) -> DataFrame:
    """(by, n, accuracy, projected, reasons): every reason against a model, in their fixed order, else ``passed``.

    A parsing status of null or ok is no failure. A projection beyond what is available leaves too few of the rarer class.
    """
    out = df.groupBy(*by).agg(F.count("*").alias("n"), rate(truncated).alias("t"), rate(status.isNotNull() & (status != "ok")).alias("p"), F.avg(correct.cast("double")).alias("accuracy"), F.bool_and(verified).alias("v"), F.max(available).alias("available"))
    out = out.withColumn("projected", sample_size(F.col("accuracy"), GUARD))
    one_class = F.coalesce((F.col("accuracy") == 0) | (F.col("accuracy") == 1), F.lit(True))
    found = F.array_compact(
        F.array(
            F.when(F.col("n") != expected, "record_count_mismatch"),
            F.when(F.col("t") > MOST_BAD, "truncation_above_5_percent"),
            F.when(F.col("p") > MOST_BAD, "parsing_failure_above_5_percent"),
            F.when(~F.coalesce("v", F.lit(False)), "artifact_verification_failure"),
            F.when(one_class, "one_class_calibration").when(F.col("projected") > F.col("available"), "projected_minority_below_100"),
        )
    )
    return out.select(*by, "n", "accuracy", "projected", F.concat_ws(",", F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("passed")))).alias("reasons"))


def first_gate(df: DataFrame, order: str, truncated: Column, status: Column, size: int = SIZE) -> DataFrame:
    """One row on the first ``size`` records: few cut off, and not one whose parsing status isn't ok."""
    few = df.orderBy(order).limit(size)
    out = few.agg(F.count("*").alias("n"), rate(truncated).alias("truncation"), F.count_if(~status.eqNullSafe(F.lit("ok"))).alias("parse_failures"))
    return out.withColumn("passed", (F.col("n") == size) & (F.col("truncation") <= MOST_BAD) & (F.col("parse_failures") == 0))


def require(gate: DataFrame, version: str) -> DataFrame:
    """``gate``, which must have one row, of this version and passed; anything else is an error."""
    rows = gate.limit(2).collect()
    if len(rows) != 1 or rows[0]["version"] != version or not rows[0]["passed"]:
        raise PermissionError(f"no passed gate of version {version}")
    return gate


def power(gain: Column, low: Column, high: Column, n: Column, target: Column) -> Column:
    """Chance to find a gain at ``target`` rows, by the normal approximation of its interval at ``n``."""
    error = (high - low) / (2 * Z95) * F.sqrt(n / target)
    z = F.abs(gain) / F.nullif(error, F.lit(0.0))
    return F.when(error <= 0, (gain != 0).cast("double")).otherwise(normal_below(z - Z95) + normal_below(-z - Z95))


def power_gate(gain: Column, low: Column, high: Column, n: Column, target: Column) -> Column:
    """Whether collecting more is worth it: the interval holds 0, and the target is larger and strong enough."""
    return (low <= 0) & (high >= 0) & (power(gain, low, high, n, target) >= LEAST_POWER) & (target > n)


def authorised(dataset: Column, passed: Column) -> tuple[Column, Column]:
    """Whether a full run may start, and why not: ambiguous questions wait for a look by hand, whatever the gate says."""
    waits = dataset == "ambignq"
    return passed & ~waits, F.when(waits, "evaluator_validation_pending").when(~passed, "technical_or_class_balance")


def verification(expected: DataFrame, found: DataFrame, key: str, checked: Column, numbers: list[str]) -> DataFrame:
    """One row: how many records are valid, missing, unexpected, double, changed or hold a number that isn't finite."""
    bad = F.lit(False)
    for c in numbers:
        bad = bad | F.isnan(c) | (F.abs(F.col(c)) == float("inf"))
    per = found.groupBy(key).agg(F.count("*").alias("k"), F.count_if(~checked).alias("changed"), F.count_if(bad).alias("wild"))
    both = expected.select(key).distinct().withColumn("e", F.lit(1)).join(per, key, "full_outer")
    at = both.agg(
        F.count_if(F.col("e").isNotNull()).alias("expected"),
        F.count_if((F.col("k") == 1) & F.col("e").isNotNull() & (F.col("changed") == 0) & (F.col("wild") == 0)).alias("valid"),
        F.count_if(F.col("k").isNull()).alias("missing"),
        F.count_if(F.col("e").isNull()).alias("unexpected"),
        F.coalesce(F.sum(F.col("k") - 1), F.lit(0)).alias("duplicates"),
        F.coalesce(F.sum("changed"), F.lit(0)).alias("changed"),
        F.coalesce(F.sum("wild"), F.lit(0)).alias("nonfinite"),
    )
    return at.withColumn("passed", (F.col("valid") == F.col("expected")) & (F.col("unexpected") == 0) & (F.col("duplicates") == 0))


def integrity(df: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """One row: for each condition whether all rows fulfil it, and ``passed`` if all do."""
    out = df.agg(*(F.coalesce(F.bool_and(c), F.lit(False)).alias(name) for name, c in conditions.items()))
    everything = F.lit(True)
    for name in conditions:
        everything = everything & F.col(name)
    return out.withColumn("passed", everything)


def collection_integrity(predictions: DataFrame, signatures: DataFrame, canonical: DataFrame, experiment: str, each: int, key: str = "example_id") -> DataFrame:
    """One row: what is wrong with a collection of predictions and signatures of the same examples, and whether it ``passed``.

    Predictions have dataset, experiment_id, prompt, prompt_checksum and ``intact`` (whether the record's own checksum
    holds), signatures dataset, experiment_id and ``intact``; canonical records the key. Each dataset must have ``each``
    records on both sides; keys stand once, on both sides, and among the canonical ones; every record belongs to the
    experiment, fits its checksum, and each prompt its own.
    """
    wrong = lambda ok: F.count_if(~F.coalesce(ok, F.lit(False)))
    own = F.col("experiment_id") == experiment
    a = predictions.groupBy(key).agg(F.count("*").alias("p"), wrong(own).alias("pe"), wrong(F.col("intact")).alias("pc"), wrong(F.sha2("prompt", 256) == F.col("prompt_checksum")).alias("pp"))
    b = signatures.groupBy(key).agg(F.count("*").alias("s"), wrong(own).alias("se"), wrong(F.col("intact")).alias("sc"))
    both = a.join(b, key, "full_outer").join(canonical.select(key).distinct().withColumn("c", F.lit(1)), key, "left")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    rows = both.agg(
        total("p").alias("predictions"),
        total("s").alias("signatures"),
        total(F.col("p") - 1).alias("double_predictions"),
        total(F.col("s") - 1).alias("double_signatures"),
        F.count_if(F.col("s").isNull()).alias("without_signature"),
        F.count_if(F.col("p").isNull()).alias("without_prediction"),
        F.count_if(F.col("p").isNotNull() & F.col("c").isNull()).alias("not_canonical"),
        (total("pe") + total("se")).alias("other_experiments"),
        total("pc").alias("changed_predictions"),
        total("sc").alias("changed_signatures"),
        total("pp").alias("changed_prompts"),
    )
    sizes = predictions.groupBy("dataset").count().unionByName(signatures.groupBy("dataset").count()).agg(F.count_if(F.col("count") != each).alias("uneven_datasets"))
    clean = (F.col("predictions") == F.col("signatures")) & (F.col("predictions") > 0)
    for name in ("double_predictions", "double_signatures", "without_signature", "without_prediction", "not_canonical", "other_experiments", "changed_predictions", "changed_signatures", "changed_prompts", "uneven_datasets"):
        clean = clean & (F.col(name) == 0)
    return rows.crossJoin(sizes).withColumn("passed", clean)  # one row each


#: What a manifest must not hold.
BANNED = ("question", "response", "reference_answers", "text", "prompt")


def manifest_faults(df: DataFrame, key: str, order: str, expected: int, banned: tuple[str, ...] = BANNED) -> DataFrame:
    """One row: what is wrong with a manifest: its count, double keys, orders other than 0 to n - 1, and content it must not hold."""
    content = len({c.lower() for c in df.columns} & set(banned))
    per = df.groupBy(key).agg(F.count("*").alias("k"), F.min(order).alias("low"), F.max(order).alias("high"))
    out = per.agg(F.coalesce(F.sum("k"), F.lit(0)).alias("n"), F.count_if(F.col("k") > 1).alias("double_keys"), F.min("low").alias("low"), F.max("high").alias("high"))
    orders = df.agg(F.countDistinct(order).alias("orders"))
    x = out.crossJoin(orders)  # one row each
    x = x.select("n", "double_keys", F.lit(content).alias("banned_fields"), ((F.col("low") == 0) & (F.col("high") == F.col("n") - 1) & (F.col("orders") == F.col("n"))).alias("in_order"))
    return x.withColumn("passed", (F.col("n") == expected) & (F.col("double_keys") == 0) & (F.col("banned_fields") == 0) & F.col("in_order"))


def stops_at_answer(text: Column) -> Column:
    """Whether what is generated so far ends a line that states the final answer."""
    return text.rlike(r"(?i)(?:^|\n)Final answer:[^\n]*[0-9][^\n]*\n")


def stops_at_line(text: Column) -> Column:
    """Whether a first line with text is complete, or the one word of an abstention stands there."""
    return text.rlike(r"^\s*\S[^\n]*\n") | text.rlike(r"(?i)^\s*unanswerable\b")
