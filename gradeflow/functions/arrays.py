"""Array columns: vectors, distributions and profiles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-8


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_distance(a: Column, b: Column) -> Column:
    return 1.0 - dot(a, b) / (F.greatest(norm(a), F.lit(EPSILON)) * F.greatest(norm(b), F.lit(EPSILON)))


def relative_change(a: Column, b: Column) -> Column:
    gap = F.zip_with(a, b, lambda x, y: y.cast("double") - x.cast("double"))
    return norm(gap) / F.greatest(norm(a), F.lit(EPSILON))


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once a row: where a lambda function holds an expression, Spark evaluates it for every element."""
    return F.get(F.transform(F.array(value), use), 0)


def softmax(a: Column) -> Column:
    e = bound(F.array_max(a), lambda top: F.transform(a, lambda x: F.exp(x.cast("double") - top.cast("double"))))
    total = lambda e: F.aggregate(e, F.lit(0.0), lambda s, x: s + x)
    return bound(e, lambda e: bound(total(e), lambda t: F.transform(e, lambda x: x / t)))


def entropy(p: Column) -> Column:
    return -F.aggregate(p, F.lit(0.0), lambda s, x: s + F.when(x > 0, x * F.log(x)).otherwise(0.0))


def rank_of(a: Column, value: Column) -> Column:
    """1 + the number of larger entries."""
    return 1 + F.size(F.filter(a, lambda x: x > value))


def margin(p: Column) -> Column:
    ordered = F.sort_array(p, asc=False)
    return ordered[0] - ordered[1]


def interior(n: Column) -> tuple[Column, Column]:
    """First and last (exclusive) index of the middle 80 %; everything if that is empty."""
    low, high = F.ceil(n * F.lit(0.1)), F.floor(n * F.lit(0.9))
    return F.when(high > low, low).otherwise(F.lit(0)), F.when(high > low, high).otherwise(n)


def resampled(a: Column, points: int = 32) -> Column:
    """Linear interpolation at ``points`` equally spaced places over the whole array."""

    def at(i: Column) -> Column:
        x = i * (F.size(a) - 1) / F.lit(float(points - 1))
        low = F.least(F.floor(x).cast("int"), F.size(a) - 1)
        high = F.least(low + 1, F.size(a) - 1)
        return F.get(a, low) + (x - low) * (F.get(a, high) - F.get(a, low))

    return F.transform(F.sequence(F.lit(0), F.lit(points - 1)), at)


def tail(a: Column, k: int) -> Column:
    """The last ``k`` entries, all of a shorter array."""
    return F.slice(a, F.greatest(F.size(a) - k + 1, F.lit(1)), F.lit(k))


def depth_regions(n: int) -> tuple[range, range, range]:
    """Early, middle and late third of ``n`` transitions; what is left over goes to the first ones."""
    if n < 3:
        raise ValueError(f"{n} transitions have no three regions")
    sizes = [n // 3 + (i < n % 3) for i in range(3)]
    edges = [0, sizes[0], sizes[0] + sizes[1], n]
    return tuple(range(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True))


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def mean(a: Column) -> Column:
    return F.when(F.size(a) > 0, total(a) / F.size(a))


def deviation(a: Column) -> Column:
    """Population standard deviation."""
    m = mean(a)
    return F.when(F.size(a) > 0, F.sqrt(total(F.transform(a, lambda x: (x - m) * (x - m))) / F.size(a)))


def slope(a: Column) -> Column:
    """Least-squares slope against the place; 0 under two entries."""
    n = F.size(a).cast("double")
    at = (n - 1) / 2
    top = total(F.transform(a, lambda x, i: (i - at) * x))
    return F.when(F.size(a) < 2, 0.0).otherwise(F.try_divide(top, n * (n * n - 1) / 12))


def roughness(a: Column) -> Column:
    """Mean absolute step; 0 under two entries."""
    steps = F.transform(F.slice(a, 2, F.greatest(F.size(a) - 1, F.lit(0))), lambda x, i: F.abs(x - F.get(a, i)))
    return F.when(F.size(a) < 2, 0.0).otherwise(mean(steps))


def curvature(a: Column) -> Column:
    """Mean absolute second difference; 0 under three entries."""
    bends = F.transform(F.slice(a, 3, F.greatest(F.size(a) - 2, F.lit(0))), lambda x, i: F.abs(x - 2 * F.get(a, i + 1) + F.get(a, i)))
    return F.when(F.size(a) < 3, 0.0).otherwise(mean(bends))


def first_peak(a: Column) -> Column:
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def span(a: Column) -> Column:
    return F.array_max(a) - F.array_min(a)


def dynamics(a: Column) -> dict[str, Column]:
    """What a sequence does from token to token."""
    return {"mean": mean(a), "std": deviation(a), "min": F.array_min(a), "max": F.array_max(a), "range": span(a), "first": F.get(a, F.lit(0)), "last": F.element_at(a, -1), "slope": slope(a), "roughness": roughness(a), "peak": first_peak(a)}


def profile(cells: Column, n: int, points: int = 32) -> dict[str, Column]:
    """Features of a profile over ``n`` transitions; ``cells`` has an array of them for each token."""
    regions = dict(zip(("early", "middle", "late"), depth_regions(n), strict=True))
    p = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda l: mean(F.transform(cells, lambda c: F.get(c, l))))
    out = {"mean": mean(p), "std": deviation(p), "slope": slope(p), "roughness": roughness(p), "curvature": curvature(p), "maximum": F.array_max(p), "peak_place": first_peak(p) / F.lit(float(max(1, n - 1))), "peak": first_peak(p)}
    means = {}
    cut = lambda first, n: F.flatten(F.transform(cells, lambda c: F.slice(c, first, n)))
    for name, r in regions.items():
        flat = cut(r.start + 1, len(r))
        means[name] = mean(flat)
        out |= {f"{name}_mean": means[name], f"{name}_std": deviation(flat), f"{name}_max": F.array_max(flat), f"{name}_range": span(flat)}
    for a, b in (("early", "middle"), ("middle", "late"), ("early", "late")):
        out[f"{a}_to_{b}"] = means[a] / (means[b] + F.lit(EPSILON))
    return out


def aligned(tokens: Column, prompt: Column, levels: int) -> Column:
    """Hidden states of the answer: the embedding level dropped, tokens of the prompt left out; what doesn't fit is an error.

    ``tokens`` has for each token an array of ``levels`` vectors.
    """
    answer = F.transform(F.slice(tokens, prompt + 1, F.greatest(F.size(tokens) - prompt, F.lit(0))), lambda t: F.slice(t, 2, levels - 1))
    wrong = (
        F.when(F.lit(levels) < 2, "no level besides the embedding")
        .when(prompt < 0, "negative prompt length")
        .when(F.size(tokens) <= prompt, "no answer tokens")
        .when(F.exists(tokens, lambda t: F.size(t) != levels), "tokens of different depth")
        .when(F.exists(tokens, lambda t: F.exists(t, lambda v: F.exists(v, not_finite))), "numbers that are not finite")
    )
    return F.when(wrong.isNull(), answer).otherwise(F.raise_error(wrong).cast("array<array<array<double>>>"))


def not_finite(x: Column) -> Column:
    return x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))


def finite(a: Column) -> Column:
    """The array itself; one with a number that isn't finite is an error."""
    return F.when(~F.exists(a, not_finite), a).otherwise(F.raise_error(F.lit("numbers that are not finite")).cast("array<double>"))


def floored_entropy(p: Column, floor: float = 1e-12) -> Column:
    return -total(F.transform(p, lambda x: F.greatest(x, F.lit(floor)) * F.log(F.greatest(x, F.lit(floor)))))
