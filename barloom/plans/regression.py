"""Robust linear models of windows, fitted by repeated weighted least squares."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.operators.panel import along
from barloom.operators.windows import STEPS, windows
from barloom.session import cut_lineage


@dataclass
class HuberModel:
    """``coefficients`` of the flattened features, and what the last step saw of the data."""

    intercept: float
    coefficients: np.ndarray
    delta: float
    n: int
    iterations: int
    converged: bool

    def step_weights(self, steps: int) -> list[list[float]]:
        """Coefficients as weights of each step of a window, oldest first."""
        return self.coefficients.reshape(steps, -1).tolist()


#: Windows that a stored row of a packed panel holds, and rows that a task works on at once.
CHUNK_WINDOWS = 128
BLOCK_WINDOWS = 2048


@cache
def _upper(wide: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(wide)


@dataclass
class _Block:
    """Rows in date order, where the labelled windows of ``steps`` rows among them end, and their labels.

    What is linear in a window is made per row and added up along the rows; only products take windows out.
    """

    rows: np.ndarray
    ends: np.ndarray
    y: np.ndarray
    steps: int

    def products(self, which: np.ndarray | slice = slice(None), weights: np.ndarray | None = None) -> np.ndarray:
        """Products of (1, window, label) among each other, added up over the chosen windows by weight: the upper half."""
        ends, y, width = self.ends[which], self.y[which], self.rows.shape[1]
        flat = sliding_window_view(self.rows.ravel(), self.steps * width)[::width][ends - self.steps + 1]
        root = np.ones(len(y)) if weights is None else np.sqrt(weights)
        if weights is not None:
            flat *= root[:, None]
        sides = np.vstack([root, root * y])
        out = np.zeros((flat.shape[1] + 2, flat.shape[1] + 2))
        out[1:-1, 1:-1] = flat.T @ flat
        out[0, 1:-1], out[1:-1, -1] = sides @ flat
        out[0, 0], out[0, -1], out[-1, -1] = root @ root, root @ sides[1], sides[1] @ sides[1]
        return out[_upper(len(out))]

    def errors(self, beta: np.ndarray) -> np.ndarray:
        shares = beta[1:].reshape(self.steps, -1) @ self.rows.T
        count = len(self.rows) - self.steps + 1
        fitted = np.full(count, beta[0])
        for step, share in enumerate(shares):
            fitted += share[step : step + count]
        return self.y - fitted[self.ends - self.steps + 1]

    def added(self, factors: np.ndarray) -> np.ndarray:
        """(1, window) times each window's factor, added up."""
        along_rows = np.zeros(len(self.rows) + self.steps - 1)
        along_rows[self.ends] = factors
        # A row is the last of the window that ends with it, the one before the last of the next.
        by_step = np.ascontiguousarray(sliding_window_view(along_rows, len(self.rows))[::-1])
        return np.append(factors.sum(), by_step @ self.rows)


Blocks = Callable[[pa.RecordBatch], Iterator[_Block]]


def _row_blocks(width: int) -> Blocks:
    """Rows with ``x``, all of one length, and ``y``, each a window."""

    def blocks(batch: pa.RecordBatch) -> Iterator[_Block]:
        y = batch.column("y").to_numpy(zero_copy_only=False)
        if len(y):
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(len(y), width)
            yield _Block(x.astype(float), np.arange(len(y)), y, 1)

    return blocks


def _window_blocks(width: int, steps: int) -> Blocks:
    """Rows of a packed panel, some at a time with those that lead into them."""

    def blocks(batch: pa.RecordBatch) -> Iterator[_Block]:
        y = batch.column("y").flatten().to_numpy(zero_copy_only=False)
        x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(len(y), width)
        for at in range(0, len(y), BLOCK_WINDOWS):
            first = max(at - steps + 1, 0)
            ends = at + np.flatnonzero(~np.isnan(y[at : at + BLOCK_WINDOWS]))
            if len(ends):
                yield _Block(x[first : at + BLOCK_WINDOWS].astype(float), ends - first, y[ends], steps)

    return blocks


def _added(rows: DataFrame, blocks: Blocks, size: int, terms: Callable[[_Block], np.ndarray]) -> DataFrame:
    """``terms`` of every block, ``size`` numbers, added up: ``cell``, ``value`` and ``n``, the windows. A task sends one
    number per cell."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(size), 0
        for batch in batches:
            for block in blocks(batch):
                total += terms(block)
                n += len(block.y)
        cells = [pa.array(np.arange(size)), pa.array(total), pa.array(np.full(size, n))]
        yield pa.RecordBatch.from_arrays(cells, names=["cell", "value", "n"])

    sums = rows.mapInArrow(add, "cell bigint, value double, n bigint")
    return sums.groupBy("cell").agg(F.sum("value").alias("value"), F.sum("n").alias("n"))


def _collected(sums: DataFrame, size: int) -> tuple[int, np.ndarray]:
    out, n = np.zeros(size), 0
    for cell, value, n in sums.collect():  # as many as the sums have cells
        out[cell] = value
    return n, out


def _whole(half: np.ndarray, wide: int) -> np.ndarray:
    """The symmetric matrix of an upper half."""
    out = np.zeros((wide, wide))
    out[_upper(wide)] = half
    return out + np.triu(out, 1).T


def _gram(rows: DataFrame, blocks: Blocks, width: int) -> tuple[int, np.ndarray]:
    """Windows, and products of (1, features, label) among each other, summed over the windows."""
    wide = width + 2

    half = wide * (wide + 1) // 2
    n, sums = _collected(_added(rows, blocks, half, _Block.products), half)
    return n, _whole(sums, wide)


@dataclass
class _Point:
    """Coefficients and the threshold of errors there."""

    beta: np.ndarray
    bound: float


@dataclass
class _Beyond:
    """What a point adds to the products of the windows within the threshold of the point before, the signs of errors
    beyond it times (1, features), the loss of all windows, and the number of those beyond."""

    change: np.ndarray
    signs: np.ndarray
    loss: float
    n: int


def _beyond(rows: DataFrame, blocks: Blocks, before: _Point, now: _Point) -> _Beyond:
    """Few windows cross the threshold between two steps, and only their products are made."""
    wide = len(now.beta) + 1
    half = wide * (wide + 1) // 2

    def terms(block: _Block) -> np.ndarray:
        error = block.errors(now.beta)
        off = np.abs(error)
        far = off > now.bound
        was = np.abs(block.errors(before.beta)) > before.bound if np.isfinite(before.bound) else np.zeros_like(far)
        change = np.zeros(half)
        for crossed, sign in ((was & ~far, 1), (far & ~was, -1)):
            if crossed.any():
                change += sign * block.products(crossed)
        near = error[~far]
        loss = near @ near / 2 + now.bound * (off[far] - now.bound / 2).sum()
        return np.concatenate([change, block.added(np.sign(error) * far), [loss, far.sum()]])

    size = half + wide - 1 + 2
    _, sums = _collected(_added(rows, blocks, size, terms), size)
    return _Beyond(_whole(sums[:half], wide), sums[half:-2], float(sums[-2]), int(sums[-1]))


def _weighted(rows: DataFrame, blocks: Blocks, at: _Point) -> np.ndarray:
    """Products of the windows beyond the threshold, weighted down to it."""
    wide = len(at.beta) + 1

    def terms(block: _Block) -> np.ndarray:
        off = np.abs(block.errors(at.beta))
        far = off > at.bound
        return block.products(far, at.bound / off[far])

    _, sums = _collected(_added(rows, blocks, wide * (wide + 1) // 2, terms), wide * (wide + 1) // 2)
    return _whole(sums, wide)


def _solve(gram: np.ndarray, moments: np.ndarray) -> np.ndarray:
    return np.linalg.lstsq(gram, moments, rcond=1e-12)[0]


def _fit(
    rows: DataFrame, blocks: Blocks, width: int, delta: float, max_iter: int, tolerance: float, scaled: bool = False
) -> tuple[HuberModel, float]:
    """Model of the least loss and the scale of its errors; see :func:`huber` and :func:`scaled_windows`."""
    n, gram = _gram(rows, blocks, width)
    if not n:
        raise ValueError("no rows to fit")
    beta, scale = _solve(gram[:-1, :-1], gram[:-1, -1]), 1.0
    if scaled:
        fitted = np.append(-beta, 1.0)
        scale = float(np.sqrt(max(fitted @ gram @ fitted, 0.0) / n))
    steps, moved, least = 1, np.inf, np.inf
    near, seen, trusted = gram, _Point(beta, np.inf), None
    while steps < max_iter and moved > tolerance * max(1.0, np.abs(beta).max()) and scale > 0:
        now = _Point(beta, delta * scale)
        far = _beyond(rows, blocks, seen, now)
        near, seen = near + far.change, now
        loss = far.loss / scale + n * scale / 2 if scaled else far.loss
        rose = trusted is not None and loss > least * (1 + 1e-12)
        few = not scaled and n - far.n < len(beta)
        if rose or few:
            # The windows beyond the threshold changed too much, or leave too few within it to tell a lowest point;
            # weighing them down never adds to the loss.
            at, within, scale = trusted if rose else (now, near, scale)
            base = within + _weighted(rows, blocks, at)
            found = _solve(base[:-1, :-1], base[:-1, -1])
            if not rose:
                least, moved = loss, float(np.abs(found - beta).max())
            beta, trusted, steps = found, None, steps + 1
            continue
        least, trusted = loss, (now, near, scale)
        # With the same windows beyond the threshold the loss is a quadratic, whose lowest point is known.
        level = _solve(near[:-1, :-1], near[:-1, -1])
        slope = _solve(near[:-1, :-1], delta * far.signs)
        wider = scale
        if scaled:
            rest = n - delta * delta * far.n - slope @ near[:-1, :-1] @ slope
            spread = near[-1, -1] - near[:-1, -1] @ level
            wider = float(np.sqrt(spread / rest)) if rest > 0 and spread > 0 else scale
        found = level + wider * slope
        moved = float(max(np.abs(found - beta).max(), abs(wider - scale)))
        beta, scale, steps = found, wider, steps + 1
    converged = moved <= tolerance * max(1.0, np.abs(beta).max()) or not scale > 0
    return HuberModel(float(beta[0]), beta[1:], delta * scale, n, steps, converged), scale


def huber(
    rows: DataFrame, width: int, delta: float = 1.0, max_iter: int = 100, tolerance: float = 1e-10
) -> HuberModel:
    """Linear model of ``y`` on the array ``x`` of ``width`` numbers with the least mean Huber loss.

    The loss is half the square of an error up to ``delta`` and linear beyond. The first step is least squares,
    from one aggregate of (width + 2) squared sums. Each further one reads the rows once, adds up those whose
    errors crossed ``delta`` since the step before and goes to the lowest point of the loss with the same rows
    beyond; where that raises the loss, or too few rows are within, errors beyond ``delta`` are weighted down
    instead. It ends when no coefficient moves by more than ``tolerance`` of the largest. Rows with a null ``y`` or ``x`` do not count. Features that say the
    same share their effect. Give it rows whose lineage is cut or cheap.
    """
    if delta <= 0:
        raise ValueError("delta must be positive")
    known = rows.select("x", "y").filter("x is not null and y is not null")
    return _fit(known, _row_blocks(width), width, delta, max_iter, tolerance)[0]


def _slopes(rows: DataFrame, blocks: Blocks, model: HuberModel) -> DataFrame:
    beta, delta = np.append(model.intercept, model.coefficients), model.delta

    def terms(block: _Block) -> np.ndarray:
        return block.added(np.clip(-block.errors(beta), -delta, delta))

    each = _added(rows, blocks, len(beta), terms).filter(F.col("n") > 0)
    return each.select((F.col("cell") - 1).cast("int").alias("position"), "n", (F.col("value") / F.col("n")).alias("slope"))


def stationarity(rows: DataFrame, model: HuberModel) -> DataFrame:
    """Mean slope of the loss in every coefficient, all zero at the least loss: ``position`` (-1 for the
    intercept, then that of the feature), ``n`` and ``slope``."""
    known = rows.select("x", "y").filter("x is not null and y is not null")
    return _slopes(known, _row_blocks(len(model.coefficients)), model)


def window_rows(train: DataFrame, steps: int = STEPS, features: Sequence[int] | None = None) -> DataFrame:
    """``x`` and ``y`` of every window: its features step by step, all or the given ones, and its label."""
    if features is not None:
        chosen = F.array(*[F.get("feature", F.lit(i)) for i in features])
        train = train.withColumn("feature", chosen)
    flat = F.transform(F.flatten("window"), lambda value: value.cast("double"))
    return windows(train, steps).select("ticker", "date", flat.alias("x"), F.col("label").cast("double").alias("y"))


@dataclass
class Packed:
    """A panel written for many passes over its windows: no pass moves a row or stores a window."""

    rows: DataFrame
    width: int
    steps: int

    @property
    def blocks(self) -> Blocks:
        return _window_blocks(self.width, self.steps)


def pack(train: DataFrame, steps: int = STEPS, features: Sequence[int] | None = None) -> Packed:
    """Write the features, all or the given ones, and the labels of each ticker's rows in their order, some hundred rows to
    a stored row with those that lead into them. Labels stay where a window ends; elsewhere they are NaN. Windows of one
    row are packed where they lie."""
    x = F.col("feature") if features is None else F.array(*[F.get("feature", F.lit(i)) for i in features])
    place = F.row_number().over(along()) if steps > 1 else F.lit(1)
    flat = train.select(x.cast("array<float>").alias("x"), F.col("label").cast("double").alias("y"), place.alias("place"))
    lead_in = steps - 1

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, last = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            place = batch.column("place").to_numpy()
            if steps > 1 and ((place != 1) & (np.diff(place, prepend=last) != 1)).any():
                raise ValueError("a ticker's rows are out of order")
            y = np.where(place >= steps, batch.column("y").to_numpy(zero_copy_only=False), np.nan)
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(len(y), -1)
            if before is not None:
                x, y = np.vstack([before, x]), np.concatenate([np.full(len(before), np.nan), y])
            fresh = len(y) - len(place)
            parts = {"x": [], "y": []}
            for at in range(fresh, len(y), CHUNK_WINDOWS):
                first = max(at - lead_in, 0)
                parts["x"].append(x[first : at + CHUNK_WINDOWS].ravel())
                parts["y"].append(np.concatenate([np.full(at - first, np.nan), y[at : at + CHUNK_WINDOWS]]))
            yield pa.RecordBatch.from_arrays([_lists(parts["x"]), _lists(parts["y"])], names=["x", "y"])
            before, last = x[max(len(x) - lead_in, 0) :], place[-1]

    rows = cut_lineage(flat.mapInArrow(chunks, "x array<float>, y array<double>"))
    first = rows.select(F.size("x"), F.size("y")).first()
    if first is None:
        raise ValueError("no rows to fit")
    return Packed(rows, first[0] // first[1], steps)


def _lists(parts: Sequence[np.ndarray]) -> pa.Array:
    return pa.ListArray.from_arrays(np.cumsum([0, *map(len, parts)], dtype=np.int32), np.concatenate(parts))


def fit_packed(panel: Packed, delta: float = 1.0, max_iter: int = 100, tolerance: float = 1e-10) -> HuberModel:
    """:func:`huber` of the label on the flattened window."""
    if delta <= 0:
        raise ValueError("delta must be positive")
    return _fit(panel.rows, panel.blocks, panel.steps * panel.width, delta, max_iter, tolerance)[0]


def packed_stationarity(panel: Packed, model: HuberModel) -> DataFrame:
    """:func:`stationarity` over the windows."""
    return _slopes(panel.rows, panel.blocks, model)


def fit_windows(train: DataFrame, steps: int = STEPS, features: Sequence[int] | None = None, delta: float = 1.0) -> HuberModel:
    """Huber regression of the label on the flattened window, from rows that are written once, ticker by ticker."""
    return fit_packed(pack(train, steps, features), delta)


def scaled_windows(
    train: DataFrame, steps: int = STEPS, epsilon: float = 1.35, max_iter: int = 50, tolerance: float = 1e-8
) -> HuberModel:
    """The same with a threshold of ``epsilon`` times the scale of the errors, which is fitted too.

    The loss is Spark ML's ``huber``: per row ``scale + scale * h(error / scale)``, with ``h`` the square up to
    ``epsilon`` and linear beyond.
    """
    panel = pack(train, steps)
    return _fit(panel.rows, panel.blocks, panel.steps * panel.width, epsilon, max_iter, tolerance, scaled=True)[0]
