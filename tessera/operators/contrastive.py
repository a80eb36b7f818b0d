"""Contrastive losses of two views with their gradients, and linear towers fitted by them.

A batch is at most `size` units of one sample: a sample's units in seeded hash order are dealt to the fewest batches that
hold them, so that batches differ by one unit at most.  A batch is one row, its pairs are never rows; tasks hold one batch
at a time and add up gradients, the driver holds the towers.

Units without one of the views, or with a number in it that is not finite, are in no batch; a sample of one unit has none,
as it has no pair."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import cells
from tessera.operators.permute import numbered
from tessera.operators.tables import materialise

LOSSES = ("infonce", "aninfonce", "supcon", "barlow")


def _log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(axis=1, keepdims=True)
    return x - np.log(np.exp(x).sum(axis=1, keepdims=True))


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


@dataclass(frozen=True)
class Loss:
    """tau: temperature of similarities; tau_target: of the weights' similarities; off: weight of what isn't the diagonal."""

    kind: str = "infonce"
    tau: float = 0.07
    tau_target: float = 0.1
    off: float = 5e-3

    def __post_init__(self) -> None:
        if self.kind not in LOSSES:
            raise ValueError(f"loss {self.kind}, not one of {LOSSES}")

    def of(self, left: np.ndarray, right: np.ndarray, weights: np.ndarray | None = None, scale: np.ndarray | None = None) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
        """(loss, its slopes by left, right and scale) of a batch of rows.  weights: soft classes, for supcon; scale: log
        scale of each dimension, for aninfonce."""
        if self.kind == "barlow":
            return self._barlow(left, right)
        scaled = scale is not None and self.kind == "aninfonce"
        n, stretch = len(left), np.exp(2 * scale) if scaled else np.ones(left.shape[1])
        logits = (left * stretch) @ right.T / self.tau
        forth, back = _log_softmax(logits), _log_softmax(logits.T)
        want = np.eye(n)
        if self.kind == "supcon":
            w = unit(weights)
            want = np.exp(_log_softmax(w @ w.T / self.tau_target))
        loss = -(want * (forth + back)).sum() / (2 * n)
        slope = (np.exp(forth) - want + (np.exp(back) - want).T) / (2 * n * self.tau)
        toward = slope @ right
        return loss, toward * stretch, slope.T @ (left * stretch), scaled * 2 * stretch * (left * toward).sum(axis=0)

    def _barlow(self, left: np.ndarray, right: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
        n = len(left)
        sides = [(x - x.mean(axis=0), x.std(axis=0, ddof=1)) for x in (left, right)]
        a, b = (c / (s + 1e-8) for c, s in sides)
        cross = a.T @ b / n
        weight = np.full(cross.shape, self.off)
        np.fill_diagonal(weight, 1.0)
        apart = cross - np.eye(len(cross))
        slope = 2 * weight * apart / n
        out = []
        for (c, s), g in zip(sides, (b @ slope.T, a @ slope), strict=True):
            out.append((g - g.mean(axis=0)) / (s + 1e-8) - c * (g * c).sum(axis=0) / (np.maximum(s, 1e-300) * (n - 1) * (s + 1e-8) ** 2))
        return float((weight * apart**2).sum()), *out, np.zeros(left.shape[1])


def batches(units: DataFrame, key: str, sample: str, left: str, right: str, size: int, seed: int, weights: str | None = None) -> DataFrame:
    """(sample, batch, n, left, right, weights), a row for each batch with its vectors one behind the other, in the order of
    the units; a written table."""
    if size < 2:
        raise ValueError("a batch needs two units")
    finite = F.lit(True)
    for c in [left, right, *([weights] if weights else [])]:
        finite = finite & F.col(c).isNotNull() & F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    own = units.where(finite).select(F.col(sample).alias("sample"), F.md5(F.concat_ws(":", F.lit(seed), key)).alias("h"), F.col(key).alias("key"), F.col(left).cast("array<double>").alias("l"), F.col(right).cast("array<double>").alias("r"), (F.col(weights).cast("array<double>") if weights else F.array().cast("array<double>")).alias("w"))
    dealt = numbered(own, ["sample"], ["h", "key"]).where("n > 1")
    by = dealt.groupBy("sample", (F.col("place") % F.ceil(F.col("n") / size)).alias("batch"))
    rows = by.agg(F.array_sort(F.collect_list(F.struct("place", "l", "r", "w"))).alias("u"))
    flat = lambda c: F.flatten(F.transform("u", lambda x: x[c]))
    return materialise(rows.select("sample", "batch", F.size("u").alias("n"), flat("l").alias("left"), flat("r").alias("right"), flat("w").alias("weights")), "batches")


def _unpacked(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    n = batch.column("n")[i].as_py()
    one = lambda c: batch.column(c).slice(i, 1).flatten().to_numpy().reshape(n, -1)
    w = one("weights")
    return one("left"), one("right"), w if w.shape[1] else None


def losses(batched: DataFrame, kinds: tuple[Loss, ...]) -> DataFrame:
    """(sample, batch, kind, n, loss) of the units' vectors, made unit vectors, with dimensions all of one scale."""
    kind = dict(batched.dtypes)["sample"]

    def each(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b for b in rows if b.num_rows):
            found = [loss.of(unit(x), unit(y), w)[0] for x, y, w in (_unpacked(batch, i) for i in range(batch.num_rows)) for loss in kinds]
            take = pa.array(np.repeat(np.arange(batch.num_rows), len(kinds)))
            yield pa.RecordBatch.from_arrays([batch.column("sample").take(take), batch.column("batch").take(take), pa.array([k.kind for k in kinds] * batch.num_rows), batch.column("n").take(take), pa.array(found, pa.float64())], ["sample", "batch", "kind", "n", "loss"])

    return batched.mapInArrow(each, f"sample {kind}, batch long, kind string, n int, loss double")


@dataclass
class Towers:
    """left and right: width x dimensions; scale: of aninfonce; history: (epoch, loss, held_out_cosine), before each step."""

    left: np.ndarray
    right: np.ndarray
    scale: np.ndarray
    history: list[tuple[int, float, float]] = field(default_factory=list)
    best: int = 0


def _pass(batched: DataFrame, towers: Towers, loss: Loss | None) -> tuple[float, float, list[np.ndarray]]:
    """(mean loss of batches, mean cosine of matched units, slopes of the mean loss) in one pass; only the cosine if there is
    no loss."""
    a, b, scale = towers.left, towers.right, towers.scale

    def partial(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = cells.Open()
        for batch in (r for r in rows if r.num_rows):
            for i in range(batch.num_rows):
                x, y, w = _unpacked(batch, i)
                p, q = x @ a, y @ b
                u, v = unit(p), unit(q)
                value, slopes = 0.0, np.zeros(0)
                if loss is not None:
                    value, du, dv, ds = loss.of(u, v, w, scale)
                    back = lambda g, z, raw: (g - z * (g * z).sum(axis=1, keepdims=True)) / np.maximum(np.linalg.norm(raw, axis=1, keepdims=True), 1e-12)
                    slopes = np.concatenate([(x.T @ back(du, u, p)).ravel(), (y.T @ back(dv, v, q)).ravel(), ds])
                held.add(("", "towers", 0), 1, a.shape[1], np.array([value, (u * v).sum(), len(x)]), slopes)
        if held.sums:
            yield held.taken()

    got = cells.added(batched.select("n", "left", "right", "weights").mapInArrow(partial, cells.SUMS)).collect()  # one row
    if not got:
        return float("nan"), float("nan"), []
    value, cosine, units = got[0]["sums"]
    slopes = np.split(np.asarray(got[0]["products"]) / got[0]["n"], np.cumsum([a.size, b.size])) if loss is not None else []
    return value / got[0]["n"], cosine / units, [g.reshape(w.shape) for g, w in zip(slopes, (a, b, scale), strict=False)]


def fit(train: DataFrame, held_out: DataFrame, loss: Loss, dims: int, seed: int, epochs: int = 100, rate: float = 0.01, patience: int = 10) -> Towers:
    """Linear towers fitted on the batches of `train` by Adam, a step an epoch, kept as they were where the mean cosine of
    matched units of `held_out` was best; ends after `patience` epochs without a better one."""
    first = train.select(F.size("left") / F.col("n"), F.size("right") / F.col("n")).first()
    if first is None or held_out.first() is None:
        raise ValueError("no batch to fit on, or none held out")
    rng = np.random.default_rng(seed)
    now = Towers(*[rng.normal(size=(int(w), dims)) / w**0.5 for w in first], np.zeros(dims))
    parts = [now.left, now.right, now.scale]
    mean, spread = ([np.zeros_like(p) for p in parts] for _ in range(2))
    kept, best = [p.copy() for p in parts], -np.inf
    for epoch in range(epochs):
        value, _, slopes = _pass(train, now, loss)
        cosine = _pass(held_out, now, None)[1]
        now.history.append((epoch, value, cosine))
        if cosine > best:
            best, now.best, kept = cosine, epoch, [p.copy() for p in parts]
        elif epoch - now.best >= patience:
            break
        for p, g, m, s in zip(parts, slopes, mean, spread, strict=True):
            m += 0.1 * (g - m)
            s += 0.001 * (g * g - s)
            p -= rate * (m / (1 - 0.9 ** (epoch + 1))) / (np.sqrt(s / (1 - 0.999 ** (epoch + 1))) + 1e-8)
    now.left, now.right, now.scale = kept
    return now


def embedded(units: DataFrame, towers: Towers, left: str, right: str) -> DataFrame:
    """units with z_left and z_right, unit vectors; null where the view is null or of another width."""
    sides = {"z_left": (left, towers.left), "z_right": (right, towers.right)}

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            arrays = []
            for c, w in sides.values():
                out: list = [None] * batch.num_rows
                good = [i for i, v in enumerate(batch.column(c).to_pylist()) if v is not None and len(v) == len(w) and None not in v]
                if good:
                    z = unit(cells.matrix(batch.column(c).take(pa.array(good))) @ w)
                    for i, v in zip(good, z, strict=True):
                        out[i] = v
                arrays.append(pa.array(out, pa.list_(pa.float64())))
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], [*batch.schema.names, *sides])

    clear = units.drop("z_left", "z_right")
    return clear.mapInArrow(rows, ", ".join(f"`{n}` {t}" for n, t in clear.dtypes) + ", z_left array<double>, z_right array<double>")
