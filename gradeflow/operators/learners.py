"""Small learners by sums: ridge from Gram matrices and balanced logistic regression by Newton's method.

Many models are fitted at once. Each row belongs to some groups (folds, inner folds, sources), each model leaves some
groups out. Every model's inputs are an affine map of the same columns, so a step is a few matrix products a block of
rows, for all models together: rows times weights, errors times columns, curvatures times products of columns. Tasks
add such sums up in Arrow blocks, a second stage adds up those of many tasks, and only sums, weights and metrics reach
the driver. No model's rows ever meet in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from ..sources.ship import ship_package
from ..sources.shared import kept
from . import metrics, sampling
from .prefix import running

#: Strengths of regularisation to choose from, that of folds too small to choose in, most inner folds,
#: and the range under which a column counts as constant.
STRENGTHS, DEFAULT_STRENGTH, INNER_FOLDS, CONSTANT = (0.1, 1.0, 10.0), 1.0, 3, 1e-12
#: Most models fitted in one go, numbers in a block's matrices, and partial sums that one reader adds up.
MOST_MODELS, BLOCK, FEW = 4096, 1 << 18, 32
#: Rows ranked together by a task, rows of a range of scores, most ranges and sampled rows for each.
RANKED, RANGE, MOST_RANGES, SAMPLE_EACH = 8192, 1 << 16, 1024, 16


def gram(df: DataFrame, columns: list[str]) -> np.ndarray:
    """Sums of products of all columns and 1, in one aggregate; only (d + 1)^2 numbers reach the driver."""
    cols = [F.lit(1.0), *(F.col(c).cast("double") for c in columns)]
    row = df.agg(*(F.sum(a * b).alias(f"s{i}_{j}") for i, a in enumerate(cols) for j, b in enumerate(cols) if j >= i)).first()
    return _square(row, len(cols), "s")


def _square(row, n: int, name: str) -> np.ndarray:
    out = np.zeros((n, n))
    for i in range(n):
        for j in range(i, n):
            out[i, j] = out[j, i] = row[f"{name}{i}_{j}"] or 0.0
    return out


def added(parts: DataFrame, combine, many: bool) -> list[bytes]:
    """``parts(value binary)`` combined by ``combine(iterator of bytes) -> bytes``, in a stage of its own where there are many."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = (v for batch in batches for v in batch.column(0).to_pylist())
        first = next(values, None)
        if first is not None:
            yield pa.RecordBatch.from_arrays([pa.array([combine(first, values)], pa.binary())], names=["value"])

    if many:
        parts = parts.repartition(FEW // 2).mapInArrow(scan, "value binary")
    return [r["value"] for r in parts.collect()]  # at most FEW rows of a bounded size


def triangle(df: DataFrame, columns: list[str]) -> np.ndarray:
    """R of a QR decomposition of the columns' matrix: factors of blocks, decomposed again in a tree. Rows with a null are left out."""
    ship_package(df.sparkSession)
    d = len(columns)

    def factor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, d))
        for batch in batches:
            r = np.linalg.qr(np.vstack([r, np.column_stack([c.to_numpy() for c in batch.columns])]), mode="r")
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([np.vstack([r, np.zeros((d, d))])[:d].tobytes()], pa.binary())], names=["value"])

    def combine(first: bytes, rest: Iterator[bytes]) -> bytes:
        r = np.frombuffer(first).reshape(d, d)
        for other in rest:
            r = np.linalg.qr(np.vstack([r, np.frombuffer(other).reshape(d, d)]), mode="r")
        return r.tobytes()

    rows = df.select(*(F.col(c).cast("double").alias(c) for c in columns)).dropna()
    found = added(rows.mapInArrow(factor, "value binary"), combine, rows.rdd.getNumPartitions() > FEW)
    return np.frombuffer(combine(found[0], iter(found[1:]))).reshape(d, d) if found else np.zeros((d, d))


def rank_and_condition(df: DataFrame, columns: list[str], standardised: bool = True) -> tuple[int, float]:
    """Rank of the columns' matrix and the ratio of its largest to its smallest singular value above the tolerance.

    The tolerance is the largest singular value times rows times the precision of doubles. Singular values are those of
    a triangular factor, so nothing is squared. ``standardised`` centres and scales columns and leaves constant ones out.
    """
    one = df.select(*(F.col(c).cast("double").alias(c) for c in columns)).dropna()
    stats = one.agg(F.count("*").alias("n"), *(f(c).alias(f"{n}{i}") for i, c in enumerate(columns) for n, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    if standardised:
        free = [i for i in range(len(columns)) if (stats[f"s{i}"] or 0.0) > CONSTANT * max(1.0, abs(stats[f"m{i}"] or 0.0))]
        one = one.select(*(((F.col(columns[i]) - stats[f"m{i}"]) / stats[f"s{i}"]).alias(columns[i]) for i in free))
    if not one.columns:
        return 0, float("inf")
    values = np.linalg.svd(triangle(one, one.columns), compute_uv=False)
    good = values[values > values.max() * max(stats["n"], len(columns)) * np.finfo(float).eps]
    return len(good), float(good.max() / good.min()) if len(good) else float("inf")


def ranks(df: DataFrame, sets: dict[str, list[str]]) -> dict[str, int]:
    """The rank of each set of columns as they are, all from one triangular factor: a set's singular values are those of its columns of it.

    Rows with a null in any of the columns are left out.
    """
    columns = list(dict.fromkeys(c for s in sets.values() for c in s))
    rows = df.select(*(F.col(c).cast("double").alias(c) for c in columns)).dropna()
    n, r = rows.count(), triangle(rows, columns)
    out = {}
    for name, own in sets.items():
        values = np.linalg.svd(r[:, [columns.index(c) for c in own]], compute_uv=False)
        out[name] = int((values > values.max(initial=0.0) * max(n, len(own)) * np.finfo(float).eps).sum())
    return out


def _ridge(g: np.ndarray, d: int, y: int, alpha: float) -> tuple[float, np.ndarray]:
    """From a Gram matrix of 1, d inputs and targets: intercept and weights of the target in column ``y``."""
    n = g[0, 0]
    if not n:
        return 0.0, np.zeros(d)
    mean = g[0] / n
    cov = g - n * np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cov)[1 : d + 1] / n, 0.0))
    sd[sd == 0] = 1.0
    a = cov[1 : d + 1, 1 : d + 1] / np.outer(sd, sd) + alpha * np.eye(d)
    w = np.linalg.solve(a, cov[1 : d + 1, y] / sd) / sd
    return float(mean[y] - w @ mean[1 : d + 1]), w


def ridge(train: DataFrame, x: list[str], y: str, alpha: float = 1.0) -> tuple[float, dict[str, float]]:
    """Intercept and weights of ridge regression on standardised inputs (population deviation), mapped back to raw inputs."""
    base, w = _ridge(gram(train, [*x, y]), len(x), len(x) + 1, alpha)
    return base, dict(zip(x, w.tolist(), strict=True))


def residuals(df: DataFrame, train: DataFrame, x: list[str], y: str, alpha: float = 1.0) -> DataFrame:
    """``df`` with ``residual`` of ``y`` after ridge on ``x``, fitted on ``train`` alone."""
    base, weights = ridge(train, x, y, alpha)
    fitted = F.lit(base)
    for c, w in weights.items():
        fitted = fitted + F.col(c).cast("double") * w
    return df.withColumn("residual", F.col(y) - fitted)


@dataclass
class Model:
    """A model to fit: rows of the groups in ``exclude`` are left out, those of a group in ``test`` are scored unless one of ``skip`` holds them."""

    name: str
    exclude: list[str]
    test: list[str]
    skip: list[str] = field(default_factory=list)
    c: float = 1.0
    use: tuple[str, ...] | None = None  # inputs of the design that it may use, residual ones as ``~name``; all if None
    ridges: Model | None = None  # the model whose ridges on the controls it takes over; its own rows' if None
    rows: int = 0
    ones: int = 0
    weights: np.ndarray | None = None  # of standardised features, the intercept last; None where a class or every feature is missing
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None  # 0 for a constant column
    base: np.ndarray | None = None  # of residual features: their ridge on the controls
    on_controls: np.ndarray | None = None
    link: np.ndarray | None = None  # of raw columns, the constant first

    def coefficients(self, features: list[str]) -> dict[str, float]:
        """Weights of standardised features, 0 for constant ones."""
        return dict(zip(features, ([0.0] * len(features) if self.weights is None else self.weights[:-1].tolist()), strict=True))


@dataclass
class Design:
    """Which columns are features, which of them only by what the controls don't explain."""

    features: list[str]
    residual: list[str] = field(default_factory=list)
    controls: list[str] = field(default_factory=list)
    alpha: float = 1.0

    @property
    def all(self) -> list[str]:
        return [*self.features, *(f"~{c}" for c in self.residual)]

    @property
    def columns(self) -> list[str]:
        return list(dict.fromkeys([*self.features, *self.residual, *self.controls]))


class _Members:
    """Which rows of a batch belong to which of some groups."""

    def __init__(self, names: list[str]):
        self.names = pa.array(names, pa.string())

    def of(self, groups: pa.Array) -> np.ndarray:
        """Rows x (groups and a last one that holds none)."""
        out = np.zeros((len(groups), len(self.names) + 1), bool)
        code = pc.index_in(groups.flatten(), value_set=self.names)
        row = pc.list_parent_indices(groups).to_numpy()
        known = code.is_valid().to_numpy(zero_copy_only=False)
        out[row[known], code.drop_null().to_numpy()] = True
        return out

    def places(self, lists: list[list[str]]) -> np.ndarray:
        """Of each list its groups' columns, filled up with the one that holds none."""
        at = {n: i for i, n in enumerate(self.names.to_pylist())}
        most = max([1, *map(len, lists)])
        return np.array([[at[g] for g in x] + [len(at)] * (most - len(x)) for x in lists])


def _any(members: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Rows x models: whether a row is in one of the model's groups."""
    out = members[:, places[:, 0]]
    for j in range(1, places.shape[1]):
        out |= members[:, places[:, j]]
    return out


class _Sums:
    """Passes over the rows of a fit: sums of all models, of standardised columns and 1."""

    def __init__(self, rows: DataFrame, columns: list[str]):
        self.rows, self.k, self.many = rows, len(columns), rows.rdd.getNumPartitions() > FEW
        stats = rows.agg(*(f(c).alias(f"{n}{i}") for i, c in enumerate(columns) for n, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
        self.mean = np.array([stats[f"m{i}"] or 0.0 for i in range(self.k)])
        self.scale = np.array([stats[f"s{i}"] or 1.0 for i in range(self.k)])
        self.left, self.right = np.triu_indices(self.k + 1)

    def square(self, packed: np.ndarray) -> np.ndarray:
        """Symmetric matrices from their upper triangles."""
        out = np.zeros((*packed.shape[:-1], self.k + 1, self.k + 1))
        out[..., self.left, self.right] = packed
        out[..., self.right, self.left] = packed
        return out

    def over(self, models: list[Model], links: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Without ``links`` (models x k + 1) of each model its products and its sums of the label; with them curvature and gradient."""
        members = _Members(sorted({g for m in models for g in m.exclude}))
        out_of = members.places([m.exclude for m in models])
        balance = np.array([[m.rows / (2 * (m.rows - m.ones)), m.rows / (2 * m.ones)] for m in models]) if links is not None else None
        mean, scale, left, right, width = self.mean, self.scale, self.left, self.right, self.k + 1
        size = max(16, BLOCK // max(len(models), 1))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            squares, vectors = np.zeros((len(models), len(left))), np.zeros((len(models), width))
            for batch in batches:
                inside = members.of(batch.column(0))
                y_all = batch.column(1).to_numpy()
                x_all = (np.column_stack([c.to_numpy() for c in batch.columns[2:]]) - mean) / scale if width > 1 else np.zeros((len(y_all), 0))
                for at in range(0, len(y_all), size):
                    y = y_all[at : at + size, None]
                    x = np.column_stack([np.ones(len(y)), x_all[at : at + size]])
                    train = ~_any(inside[at : at + size], out_of)
                    if links is None:
                        vectors[:, 0] += (train * y).sum(0)
                        weight = train.astype(float)
                    else:
                        p = 1 / (1 + np.exp(-np.clip(x @ links.T, -35.0, 35.0)))
                        balanced = np.where(y == 1, balance[:, 1], balance[:, 0]) * train
                        vectors += (balanced * (p - y)).T @ x
                        weight = balanced * p * (1 - p)
                    squares += weight.T @ (x[:, left] * x[:, right])
            yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([squares.ravel(), vectors.ravel()]).tobytes()], pa.binary())], names=["value"])

        def combine(first: bytes, rest: Iterator[bytes]) -> bytes:
            total = np.frombuffer(first).copy()
            for other in rest:
                total += np.frombuffer(other)
            return total.tobytes()

        found = added(self.rows.mapInArrow(scan, "value binary"), combine, self.many)
        total = np.frombuffer(combine(found[0], iter(found[1:]))) if found else np.zeros(len(models) * (len(left) + width))
        split = len(models) * len(left)
        return self.square(total[:split].reshape(len(models), -1)), total[split:].reshape(len(models), width)


def fit_many(df: DataFrame, design: Design, label: str, models: list[Model], steps: int = 50) -> list[Model]:
    """Class-balanced L2 logistic regressions, all at once; ``df`` has ``groups`` array<string>.

    Columns that don't vary in training get weight 0; without both classes or any varying column in training a model
    has no weights. Rows with a null among features or label are left out. A step reads the rows once for all models;
    it is the last once no weight moves by more than 1e-6, after which Newton's method has converged quadratically.
    """
    ship_package(df.sparkSession)
    rows = df.select("groups", F.col(label).cast("double").alias("_label"), *(F.col(c).cast("double").alias(c) for c in design.columns)).dropna().persist()  # read in every step; lost parts are made again
    try:
        sums = _Sums(rows, design.columns)
        for a in range(0, len(models), MOST_MODELS):
            _fit(sums, design, models[a : a + MOST_MODELS], steps)
        return models
    finally:
        rows.unpersist()


def _standard(m: Model, i: int, target: int, controls: list[int], sums: _Sums) -> tuple[float, np.ndarray]:
    """The i-th ridge of a fitted model in standardised columns."""
    w, unit = m.on_controls[i], sums.scale[target]
    return (m.base[i] + w @ sums.mean[controls] - sums.mean[target]) / unit, w * sums.scale[controls] / unit


def _prepare(m: Model, g: np.ndarray, ones: float, design: Design, sums: _Sums) -> np.ndarray:
    """The map of standardised columns and 1 to the model's inputs and 1; sets what the model keeps of it, in raw units."""
    at = {c: i + 1 for i, c in enumerate(design.columns)}
    m.rows, m.ones = int(round(g[0, 0])), int(round(ones))
    n, d = max(g[0, 0], 1.0), len(design.all)
    inputs = np.zeros((d, len(g)))
    for i, c in enumerate(design.features):
        inputs[i, at[c]] = 1.0
    on = [0, *(at[c] for c in design.controls)]
    m.base, m.on_controls = np.zeros(len(design.residual)), np.zeros((len(design.residual), len(design.controls)))
    for i, c in enumerate(design.residual):
        if m.ridges is None:
            base, w = _ridge(g[np.ix_([*on, at[c]], [*on, at[c]])], len(design.controls), len(on), design.alpha)
        else:
            base, w = _standard(m.ridges, i, at[c] - 1, [at[x] - 1 for x in design.controls], sums)
        row = inputs[len(design.features) + i]
        row[at[c]] = 1.0
        row[0] -= base
        for x, v in zip(design.controls, w, strict=True):
            row[at[x]] -= v
        unit = sums.scale[at[c] - 1]
        m.on_controls[i] = [v * unit / sums.scale[at[x] - 1] for x, v in zip(design.controls, w, strict=True)]
        m.base[i] = sums.mean[at[c] - 1] + unit * base - sum(v * sums.mean[at[x] - 1] for x, v in zip(design.controls, m.on_controls[i], strict=True))
    mean = inputs @ g[0] / n
    spread = np.sqrt(np.maximum(np.einsum("ij,jk,ik->i", inputs, g, inputs) / n - mean**2, 0.0))
    free = np.array([m.use is None or name in m.use for name in design.all], bool)
    varies = free & (spread > 1e-7 * (1.0 + np.abs(mean)))  # sums of squares tell no smaller spread from none
    scale = np.where(varies, 1 / np.where(varies, spread, 1.0), 0.0)
    unit = np.array([sums.scale[at[c.lstrip("~")] - 1] for c in design.all])
    shift = np.array([sums.mean[at[c] - 1] for c in design.features] + [0.0] * len(design.residual))
    m.mean, m.scale = shift + unit * mean, scale / unit
    if 0 < m.ones < m.rows and varies.any():
        m.weights = np.zeros(d + 1)
    out = np.zeros((len(g), d + 1))
    out[:, :d] = (inputs * scale[:, None]).T
    out[0, :d] -= mean * scale
    out[0, d] = 1.0
    return out


def _fit(sums: _Sums, design: Design, models: list[Model], steps: int) -> None:
    grams, ones = sums.over(models)
    maps = np.stack([_prepare(m, g, o, design, sums) for m, g, o in zip(models, grams, ones[:, 0], strict=True)])
    todo = np.array([i for i, m in enumerate(models) if m.weights is not None], int)
    d = len(design.all)
    weights = np.zeros((len(models), d + 1))
    penalty = np.array([[1.0 / m.c] * d + [0.0] for m in models])
    for _ in range(steps):
        if not len(todo):
            break
        t, w = maps[todo], weights[todo]
        curvature, gradient = sums.over([models[i] for i in todo], np.einsum("mkd,md->mk", t, w))
        g = np.einsum("mkd,mk->md", t, gradient) + penalty[todo] * w
        h = np.einsum("mkd,mkl,mle->mde", t, curvature, t) + (penalty[todo] + 1e-12)[:, :, None] * np.eye(d + 1)
        move = np.linalg.solve(h, g[..., None])[..., 0]
        weights[todo] = w - move
        todo = todo[np.abs(move).max(1) > 1e-6]
    for i, m in enumerate(models):
        if m.weights is not None:
            m.weights = weights[i]
            a = maps[i] @ weights[i]
            m.link = np.append(a[0] - (a[1:] * sums.mean / sums.scale).sum(), a[1:] / sums.scale)


def scores(df: DataFrame, design: Design, key: str, label: str, models: list[Model]) -> DataFrame:
    """(name, key, label, score) of the rows that each model is to score; null where it has no weights."""
    ship_package(df.sparkSession)
    rows = df.select(key, label, "groups", *(F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(design.columns))).dropna(subset=[f"_x{i}" for i in range(len(design.columns))])
    members = _Members(sorted({g for m in models for g in (*m.test, *m.skip)}))
    tested, skipped = members.places([m.test for m in models]), members.places([m.skip for m in models])
    links = np.stack([np.full(len(design.columns) + 1, np.nan) if m.link is None else m.link for m in models])
    names = pa.array([m.name for m in models], pa.string())
    size = max(16, BLOCK // max(len(models), 1))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, size):
                batch = whole.slice(at, size)
                inside = members.of(batch.column(2))
                row, model = np.nonzero(_any(inside, tested) & ~_any(inside, skipped))
                x = np.column_stack([np.ones(batch.num_rows), *(c.to_numpy() for c in batch.columns[3:])])
                p = 1 / (1 + np.exp(-np.clip((x[row] * links[model]).sum(1), -35.0, 35.0)))
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([names.take(pa.array(model)), batch.column(0).take(take), batch.column(1).take(take), pa.array(p, pa.float64(), from_pandas=True)], names=["name", key, label, "score"])

    kinds = [StructField("name", StringType()), rows.schema[key], rows.schema[label], StructField("score", DoubleType())]
    return rows.mapInArrow(scan, StructType([StructField(f.name, f.dataType, True) for f in kinds]))


def _linked(x: np.ndarray, links: np.ndarray, row: np.ndarray, model: np.ndarray) -> np.ndarray:
    """Scores of some pairs of a row and a model, added up column by column: equal rows get equal scores."""
    z = links[model, 0]
    for j in range(x.shape[1]):
        z += x[row, j] * links[model, j + 1]
    return 1 / (1 + np.exp(-np.clip(z, -35.0, 35.0)))


def _counted(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, ascending, and how often each stands there."""
    values = np.sort(values)
    heads = np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.zeros(0, int)
    return values[heads], np.diff(np.append(heads, len(values)))


def _above(pos: np.ndarray, pos_n: np.ndarray, neg: np.ndarray, neg_n: np.ndarray) -> float:
    """Pairs of a positive and a lower negative, equal ones as halves."""
    order = np.argsort(neg, kind="stable")
    neg, below = neg[order], np.append(0, np.cumsum(neg_n[order]))
    return float((pos_n * (below[np.searchsorted(neg, pos, "left")] + below[np.searchsorted(neg, pos, "right")])).sum() / 2)


def aurocs(df: DataFrame, design: Design, label: str, models: list[Model], of: Callable[[Model], str]) -> dict[str, float]:
    """AUROC of all scores that the models named alike by ``of`` give to the rows they are to score; none where a class is missing.

    A task sorts blocks of scores and sends them on as arrays, by name and range of scores, repeated scores as a count;
    a range is worked on by itself, and sums of ranges are added up in order. Cuts come from a sample and balance the
    ranges: the result is exact wherever they are. Scores as rows would be many times as much to shuffle.
    """
    ship_package(df.sparkSession)
    columns = [f"_x{i}" for i in range(len(design.columns))]
    rows = df.select(F.col(label).cast("double").alias("_label"), "groups", *(F.col(c).cast("double").alias(x) for x, c in zip(columns, design.columns, strict=True))).dropna(subset=["_label", *columns])
    models = sorted((m for m in models if m.link is not None), key=of)
    if not models:
        return {}
    names = list(dict.fromkeys(map(of, models)))
    heads = [0, *(i for i in range(1, len(models)) if of(models[i]) != of(models[i - 1])), len(models)]
    members = _Members(sorted({g for m in models for g in (*m.test, *m.skip)}))
    tested, skipped = members.places([m.test for m in models]), members.places([m.skip for m in models])
    links = np.stack([m.link for m in models])
    n = rows.count()
    ranges = min(MOST_RANGES, -(-n // RANGE))
    cuts = np.zeros((len(names), 0))
    if ranges > 1:
        drawn = np.array(rows.select(*columns).sample(min(1.0, 2.0 * ranges * SAMPLE_EACH / n), 17).limit(4 * ranges * SAMPLE_EACH).collect()).reshape(-1, len(columns))
        if len(drawn):
            by = np.sort(np.stack([_linked(drawn, links[a : a + 1], np.arange(len(drawn)), np.zeros(len(drawn), int)) for a in heads[:-1]]), axis=1)
            cuts = by[:, [i * len(drawn) // ranges for i in range(1, ranges)]]
    width = cuts.shape[1] + 1
    steps, at = [0], 0  # names of as many models as a block may hold
    for g in range(len(names)):
        if g > steps[-1] and heads[g + 1] - at > (16 * BLOCK) // RANKED:
            steps.append(g)
            at = heads[g]
    steps.append(len(names))

    def block(part: pa.RecordBatch) -> Iterator[tuple]:
        inside, y = members.of(part.column(1)), part.column(0).to_numpy() == 1
        x = np.column_stack([np.zeros((part.num_rows, 0)), *(c.to_numpy() for c in part.columns[2:])])
        for a, b in zip(steps[:-1], steps[1:], strict=True):
            first, last = heads[a], heads[b]
            model, row = np.nonzero((_any(inside, tested[first:last]) & ~_any(inside, skipped[first:last])).T)
            p, one = _linked(x, links, row, model + first), y[row]
            ends = np.searchsorted(model, np.array(heads[a : b + 1]) - first)
            for g in range(a, b):
                own = slice(ends[g - a], ends[g - a + 1])
                sides = [_counted(p[own][one[own] == c]) for c in (True, False)]
                places = [[0, *np.searchsorted(v, cuts[g], "left").tolist(), len(v)] for v, _ in sides]
                for r in range(width):
                    spans = [slice(x[r], x[r + 1]) for x in places]
                    if any(s.stop > s.start for s in spans):
                        yield (g, r, *(x for (v, k), s in zip(sides, spans, strict=True) for x in (v[s].tobytes(), b"" if (k[s] == 1).all() else k[s].tobytes())))

    kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
    labels = ["name", "range", "pos", "pos_n", "neg", "neg_n"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _blocks(batches, RANKED):
            found = []
            for row in block(part):
                found.append(row)
                if len(found) == 512:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)], names=labels)
                    found = []
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)], names=labels)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def done() -> pa.RecordBatch:
            sides = []
            for v, k in ((0, 1), (2, 3)):
                values = [np.frombuffer(r[v]) for r in held]
                sides += [np.concatenate(values), np.concatenate([np.frombuffer(r[k], np.int64) if r[k] else np.ones(len(x), np.int64) for r, x in zip(held, values, strict=True)])]
            row = (*now, int(sides[1].sum()), int(sides[3].sum()), _above(*sides))
            return pa.RecordBatch.from_pylist([dict(zip(("name", "range", "p", "n", "u"), row, strict=True))], schema)

        schema = pa.schema([("name", pa.int32()), ("range", pa.int32()), ("p", pa.int64()), ("n", pa.int64()), ("u", pa.float64())])
        for batch in batches:
            for name, r, *values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is not None and now != (name, r):
                    yield done()
                    held = []
                now = (name, r)
                held.append(values)
        if now is not None:
            yield done()

    parts = rows.mapInArrow(scan, "name int, range int, pos binary, pos_n binary, neg binary, neg_n binary")
    sums = parts.repartition("name", "range").sortWithinPartitions("name", "range").mapInArrow(gather, "name int, range int, p long, n long, u double")
    below = F.coalesce(F.sum("n").over(Window.partitionBy("name").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    whole = sums.withColumn("below", below).groupBy("name").agg(F.sum("p").alias("p"), F.sum("n").alias("n"), F.sum(F.col("u") + F.col("p") * F.col("below")).alias("u"))
    return {names[r["name"]]: r["u"] / (float(r["p"]) * r["n"]) for r in whole.collect() if r["p"] and r["n"]}  # a row a name


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of ``size``, whatever size they come in."""
    held, n = [], 0

    def joined() -> pa.RecordBatch:
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        for at in range(0, batch.num_rows, size):
            part = batch.slice(at, size)
            while n + part.num_rows >= size:
                held.append(part.slice(0, size - n))
                yield joined()
                part, held, n = part.slice(size - n), [], 0
            if part.num_rows:
                held.append(part)
                n += part.num_rows
    if n:
        yield joined()


def by_fold(fold: str = "fold") -> Column:
    return F.array(F.concat(F.lit("f"), F.col(fold).cast("string")))


def fold_models(folds: list, c: float = 1.0) -> list[Model]:
    return [Model(f"f{k}", [f"f{k}"], [f"f{k}"], c=c) for k in folds]


def _folds_of(df: DataFrame, fold: str) -> list:
    return sorted(r[0] for r in df.select(fold).distinct().collect())  # one row a fold


def out_of_fold(df: DataFrame, key: str, label: str, features: list[str], fold: str = "fold", c: float = 1.0) -> DataFrame:
    """(key, fold, label, score) with scores from models that never saw the row's fold."""
    design = Design(features)
    rows = kept(df.select(key, fold, label, *features)).withColumn("groups", by_fold(fold))
    models = fit_many(rows, design, label, fold_models(_folds_of(rows, fold), c))
    return scores(rows, design, key, label, models).select(key, F.substring("name", 2, 20).cast("int").alias(fold), label, "score")


def dealt(df: DataFrame, label: str, stratum: str | None, key: str, seeds: tuple[str, ...], folds: int, inner: int = INNER_FOLDS, fold: str | None = None) -> DataFrame:
    """``df`` with ``groups``: for each seed the fold ``s{seed}f{k}`` of each row, and for each other fold k the inner fold ``s{seed}k{k}i{i}`` that it falls into when k is left out.

    Folds are stratified by class and stratum, or given in the column ``fold`` as numbers from 0 to ``folds - 1``. Inner
    folds are stratified by class and dealt out among the rows that are left when k is, in hash order; they are
    ``inner``, or as many as the smaller class has rows; with one row a class there are none. Rows without a label are
    left out. All seeds are dealt at once.
    """
    thin = df.filter(F.col(label).isNotNull()).select(key, label, *([stratum] if stratum and not fold else []), *([F.col(fold).alias("fold")] if fold else []))
    thin = thin.withColumn("_seed", F.explode(F.array(*map(F.lit, seeds))))
    rows = (thin if fold else sampling.folds(thin, label, stratum, key, folds, F.col("_seed"), ["_seed"])).persist()  # read three times; lost parts are made again
    sizes: dict = {}
    for r in rows.groupBy("_seed", label, "fold").count().collect():  # seeds x folds x classes
        sizes.setdefault((r["_seed"], r[label]), [0] * folds)[r["fold"]] = r["count"]
    classes = sorted({y for _, y in sizes})
    parts = {(s, k): min([inner, *(sum(sizes.get((s, y), [0])) - sizes.get((s, y), [0] * folds)[k] for y in classes)]) if len(classes) > 1 else 0 for s in seeds for k in range(folds)}
    counts = F.create_map(*(F.lit(x) for s in seeds for x in (s, [max(1, parts[s, k]) for k in range(folds)])))
    placed = running(rows.withColumn("_hash", sampling.hash_order(key, seed=F.concat(F.lit("inner"), "_seed"))), ["_seed", label], ["_hash", key], {"_up": F.lit(1)} | {f"_up{k}": (F.col("fold") == k).cast("int") for k in range(folds)})
    own = F.concat(F.lit("s"), F.col("_seed"))

    def within(k: int) -> Column:
        i = (F.col("_up") - F.col(f"_up{k}") - 1) % F.get(counts[F.col("_seed")], F.lit(k))
        return F.when(F.col("fold") != k, F.concat(own, F.lit(f"k{k}i"), i.cast("string")))

    groups = F.array(F.concat(own, F.lit("f"), F.col("fold").cast("string")), *(within(k) for k in range(folds)))
    lists = placed.groupBy(key).agg(F.flatten(F.collect_list(F.array_compact(groups))).alias("groups"))
    return df.join(lists, key)


def chosen(df: DataFrame, design: Design, key: str, label: str, wanted: list[Model], inner: int = INNER_FOLDS) -> None:
    """Gives each model named ``name|seed|fold`` the strength with the best AUROC of inner out-of-fold scores, the smaller on a tie.

    ``df`` has the groups of ``dealt``. Where inner folds aren't possible, or no score is, the strength is the default.
    Inner models take over the ridges of the model they choose for.
    """
    if design.residual:
        fit_many(df, design, label, wanted, steps=0)
    models = []
    for m in wanted:
        _, seed, k = m.name.split("|")
        groups = [f"s{seed}k{k}i{i}" for i in range(inner)]
        models += [Model(f"{m.name}|{i}|{c}", [*m.exclude, g], [g], c=c, use=m.use, ridges=m if design.residual else None) for i, g in enumerate(groups) for c in STRENGTHS]
    found = aurocs(df, design, label, fit_many(df, design, label, models), lambda m: "|".join((*m.name.split("|")[:3], m.name.split("|")[4])))
    best: dict = {}
    for name, c, _ in sorted(((*name.rsplit("|", 1), value) for name, value in found.items()), key=lambda x: (-round(x[2], 12), float(x[1]))):
        best.setdefault(name, float(c))
    for m in wanted:
        m.c = best.get(m.name, DEFAULT_STRENGTH)


def merged(comparisons: dict[str, Design]) -> Design:
    """One design with the columns of all, of which each model uses its own."""
    first = lambda part: list(dict.fromkeys(c for d in comparisons.values() for c in getattr(d, part)))
    return Design(first("features"), first("residual"), first("controls"))


def fitted(df: DataFrame, comparisons: dict[str, Design], key: str, label: str, stratum: str | None, seeds: tuple[str, ...] = ("2026",), folds: int = 5, fold: str | None = None, only: tuple[int, ...] = ()) -> tuple[DataFrame, Design, list[Model]]:
    """The models of several designs on several splits, each fold with its own strength, with the rows and the design that they score.

    Models are named ``comparison|seed|fold``. All folds of all splits and designs are fitted together, first those that
    choose the strengths, on inner folds of each fold's training rows. With ``fold`` the split is given; with ``only``
    no other folds are scored. Rows are few bytes but much work each: they are dealt out by number, not by size.
    """
    whole = merged(comparisons)
    tasks = min(FEW, 2 * df.sparkSession.sparkContext.defaultParallelism)
    rows = kept(dealt(df, label, stratum, key, seeds, folds, fold=fold).select(key, label, "groups", *whole.columns).repartition(tasks, key))
    models = [Model(f"{name}|{seed}|{k}", [f"s{seed}f{k}"], [f"s{seed}f{k}"], use=tuple(d.all)) for name, d in comparisons.items() for seed in seeds for k in only or range(folds)]
    chosen(rows, whole, key, label, models)
    return rows, whole, fit_many(rows, whole, label, models)


def scored_by(rows: DataFrame, whole: Design, key: str, label: str, models: list[Model]) -> DataFrame:
    """(comparison, seed, fold, key, label, score) of models of ``fitted``."""
    scored = scores(rows, whole, key, label, models)
    part = lambda i: F.split_part("name", F.lit("|"), F.lit(i))
    return scored.select(part(1).alias("comparison"), part(2).alias("seed"), part(3).cast("int").alias("fold"), key, label, "score")


def split_aurocs(rows: DataFrame, whole: Design, label: str, models: list[Model]) -> DataFrame:
    """(comparison, seed, auroc) of the out-of-fold scores of each design and split of ``fitted``; null where a class is missing."""
    of = lambda m: m.name.rsplit("|", 1)[0]
    found = aurocs(rows, whole, label, models, of)
    names = dict.fromkeys(of(m) for m in models if m.link is not None)
    return rows.sparkSession.createDataFrame([(*name.split("|"), found.get(name)) for name in names], "comparison string, seed string, auroc double")  # a row a design and split


def compared(df: DataFrame, comparisons: dict[str, Design], key: str, label: str, stratum: str | None, seeds: tuple[str, ...] = ("2026",), folds: int = 5, fold: str | None = None, only: tuple[int, ...] = ()) -> tuple[DataFrame, list[Model]]:
    """Out-of-fold scores (comparison, seed, fold, key, label, score) of the models of ``fitted``; and these."""
    rows, whole, models = fitted(df, comparisons, key, label, stratum, seeds, folds, fold, only)
    return scored_by(rows, whole, key, label, models), models


def fold_details(models: list[Model], comparisons: dict[str, Design]) -> list[tuple]:
    """(comparison, seed, fold, strength, training rows, training errors, constant inputs left out, weights of the others by input) of each model of ``compared``."""
    inputs, out = merged(comparisons).all, []
    for m in models:
        name, seed, k = m.name.split("|")
        own = [(x, w, s) for x, w, s in zip(inputs, [0.0] * len(inputs) if m.weights is None else m.weights[:-1].tolist(), m.scale, strict=True) if x in m.use]
        out.append((name, seed, int(k), m.c if m.weights is not None else None, m.rows, m.ones, int(sum(s == 0 for _, _, s in own)), {x: float(w) for x, w, s in own if s > 0}))
    return out


def transferred(df: DataFrame, comparisons: dict[str, Design], key: str, label: str, group: str, source: str) -> DataFrame:
    """(comparison, group, key, label, score) of all other groups by models of one group, without a refit."""
    rows = df.withColumn("groups", F.array(F.col(group)))
    whole = merged(comparisons)
    others = [g for g in sorted(r[0] for r in df.select(group).distinct().collect()) if g != source]  # one row a group
    models = fit_many(rows, whole, label, [Model(name, others, others, use=tuple(d.all)) for name, d in comparisons.items()])
    return scores(rows, whole, key, label, models).withColumnRenamed("name", "comparison").join(df.select(key, group), key)


def bundle(scored: DataFrame, key: str, label: str, by: list[str]) -> DataFrame:
    """AUROC, average precision, area under the risk curve, Brier score, log-likelihood, calibration error and reliability of each group."""
    rows = scored.filter("score is not null")
    curve = metrics.risk_curve(rows, "score", label, key, by)
    out = metrics.auroc(rows, "score", label, by)
    for part in (metrics.average_precision(rows, "score", label, by), metrics.aurc(curve, by, key).drop("n", "mean_risk"), metrics.calibration(rows, "score", label, by)):
        out = out.join(part, by)
    return out.withColumn("reliability", metrics.reliability(F.least("positives", F.col("n") - F.col("positives"))))


def averaged(scored: DataFrame, key: str, label: str) -> DataFrame:
    """(comparison, key, label, score, spread) over seeds."""
    return scored.groupBy("comparison", key, label).agg(F.avg("score").alias("score"), F.coalesce(F.stddev_pop("score"), F.lit(0.0)).alias("spread"))


def designs(families: dict[str, list[str]], names: list[str], controls: str = "") -> dict[str, Design]:
    """Designs by name: ``P+L`` joins families, ``P+L~I`` adds what the controls don't explain of family I."""
    out = {}
    for name in names:
        plain, _, rest = name.partition("~")
        pick = lambda part: [c for f in part.split("+") if f for c in families[f]]
        out[name] = Design(pick(plain), pick(rest), pick(controls) if rest else [])
    return out


def stability(models: list[Model], features: list[str]) -> list[tuple[str, float, float, float]]:
    """(feature, mean, deviation, share above 0) of its weights over fits, 0 where it was left out, and the row ``norm`` of all weights."""
    table = np.array([[m.coefficients(features)[f] for f in features] for m in models]).reshape(len(models), len(features))
    norms = np.sqrt((table**2).sum(1))
    rows = [(f, float(c.mean()), float(c.std()), float((c > 0).mean())) for f, c in zip(features, table.T, strict=True)]
    return [*rows, ("norm", float(norms.mean()), float(norms.std()), 1.0)]
