"""Flows integrated with error control: an embedded Runge-Kutta pair with a step of its own for each row.

A batch's rows move together through numpy, each with its time and step: where
the difference of the pair's two orders is within atol + rtol * |x| (root mean
square over the numbers), a row's step is taken, else it is made smaller and
tried again. The number of tries is bounded; rows that don't get to the end say so.
Nothing meets between rows, so this is one map without a shuffle.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: drift(x, t): the velocity of rows x (n, numbers) at times t (n,).
Drift = Callable[[np.ndarray, np.ndarray], np.ndarray]

# The pair of orders 5 and 4 of Dormand and Prince (1980).
NODES = (0, 1 / 5, 3 / 10, 4 / 5, 8 / 9, 1, 1)
STAGES = (
    (),
    (1 / 5,),
    (3 / 40, 9 / 40),
    (44 / 45, -56 / 15, 32 / 9),
    (19372 / 6561, -25360 / 2187, 64448 / 6561, -212 / 729),
    (9017 / 3168, -355 / 33, 46732 / 5247, 49 / 176, -5103 / 18656),
    (35 / 384, 0, 500 / 1113, 125 / 192, -2187 / 6784, 11 / 84),
)
FIFTH = (35 / 384, 0, 500 / 1113, 125 / 192, -2187 / 6784, 11 / 84, 0)
FOURTH = (5179 / 57600, 0, 7571 / 16695, 393 / 640, -92097 / 339200, 187 / 2100, 1 / 40)
SAFETY, SHRINK, GROW = 0.9, 0.2, 10.0


def solve(x: np.ndarray, drift: Drift, t0: float, t1: float, rtol: float, atol: float, tries: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(x at t1 or where the tries ended, steps taken, steps rejected, whether t1 was reached) for each row of x."""
    x = np.array(x, dtype=np.float64)
    n, way = len(x), t1 - t0
    if not x.shape[1]:
        return x, np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64), np.ones(n, dtype=bool)
    t, h = np.full(n, float(t0)), np.full(n, way / 100)
    taken, rejected = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    live = np.full(n, way != 0)
    for _ in range(tries):
        on = np.flatnonzero(live)
        if not len(on):
            break
        # The last step ends at t1 exactly.
        last = np.abs(h[on]) >= np.abs(t1 - t[on])
        step = np.where(last, t1 - t[on], h[on])
        ks: list[np.ndarray] = []
        for node, row in zip(NODES, STAGES, strict=True):
            at = x[on] + step[:, None] * sum((a * k for a, k in zip(row, ks, strict=True) if a), np.zeros_like(x[on]))
            ks.append(drift(at, t[on] + node * step))
        high, low = (step[:, None] * sum(b * k for b, k in zip(weights, ks, strict=True) if b) for weights in (FIFTH, FOURTH))
        scale = atol + rtol * np.maximum(np.abs(x[on]), np.abs(x[on] + high))
        with np.errstate(invalid="ignore", over="ignore"):
            error = np.sqrt((((high - low) / scale) ** 2).mean(axis=1))
        error = np.where(np.isfinite(error), error, np.inf)
        good = error <= 1
        x[on[good]] += high[good]
        t[on[good]] = np.where(last[good], t1, t[on[good]] + step[good])
        taken[on] += good
        rejected[on] += ~good
        with np.errstate(divide="ignore"):
            factor = np.clip(SAFETY * error ** (-1 / 5), SHRINK, np.where(good, GROW, 1.0))
        h[on] = step * factor
        live[on[good & last]] = False
    return x, taken, rejected, ~live


def _by_length(vectors: list) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, rows) of the vectors of each length; null ones, and ones with null numbers, are left out."""
    lengths: dict[int, list[int]] = {}
    for i, v in enumerate(vectors):
        if v is not None and None not in v:
            lengths.setdefault(len(v), []).append(i)
    for places in lengths.values():
        yield np.array(places), np.array([vectors[i] for i in places], dtype=np.float64).reshape(len(places), -1)


def _map(rows: DataFrame, vector: str, made: list[tuple[str, str, pa.DataType]], work: Callable) -> DataFrame:
    """rows with columns made by work(batch, places, x), which returns a list of values for each; null where x is."""
    kept = [c for c in rows.columns if c not in {m[0] for m in made}]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[None] * batch.num_rows for _ in made]
            for places, x in _by_length(batch.column(vector).to_pylist()):
                for column, values in zip(out, work(batch, places, x), strict=True):
                    for i, v in zip(places, values, strict=True):
                        column[i] = v
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *(pa.array(c, m[2]) for c, m in zip(out, made, strict=True))], names=[*kept, *(m[0] for m in made)])

    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in kept), *(f"{m[0]} {m[1]}" for m in made)])
    return rows.select(*{c: None for c in [*kept, vector]}).mapInArrow(run, schema)


DOUBLES = pa.list_(pa.float64())


def adaptive_ode(rows: DataFrame, vector: str, drift: Drift, t0: float = 0.0, t1: float = 1.0, rtol: float = 1e-3, atol: float = 1e-6, tries: int = 1000) -> DataFrame:
    """rows with end (the vector carried along the drift from t0 to t1), taken, rejected and finished.

    A row that is not at t1 after so many tries (a drift that blows up, say) has finished false and the place where it stopped.
    A null vector has nulls.
    """

    def work(batch: pa.RecordBatch, places: np.ndarray, x: np.ndarray) -> list:
        end, taken, rejected, finished = solve(x, drift, t0, t1, rtol, atol, tries)
        return [end.tolist(), taken.tolist(), rejected.tolist(), finished.tolist()]

    return _map(rows, vector, [("end", "array<double>", DOUBLES), ("taken", "bigint", pa.int64()), ("rejected", "bigint", pa.int64()), ("finished", "boolean", pa.bool_())], work)


def probe(key: object, n: int) -> np.ndarray:
    """n numbers of -1 or 1 from a key, the same on every run."""
    bits = b"".join(hashlib.md5(f"{key}:{i}".encode()).digest() for i in range(-(-n // 128)))
    return np.unpackbits(np.frombuffer(bits, dtype=np.uint8))[:n].astype(np.float64) * 2 - 1


def flow_likelihood(rows: DataFrame, vector: str, key: str, drift: Drift, t0: float = 0.0, t1: float = 1.0, rtol: float = 1e-3, atol: float = 1e-6, tries: int = 1000, probes: int = 1, step: float = 1e-4) -> DataFrame:
    """rows with logp (of the vector, as the flow from standard normal noise at t0 to data at t1 has it), prior_end, taken, rejected and finished.

    The vector is carried back to t0; the divergence along the way is
    estimated by probe vectors of -1 and 1 (Hutchinson), drawn by key: e . (J e), the
    derivative along e by a central difference. It is exact where the drift's Jacobian is diagonal.
    """

    def work(batch: pa.RecordBatch, places: np.ndarray, x: np.ndarray) -> list:
        n, d = x.shape
        keys = batch.column(key).take(pa.array(places)).to_pylist()
        own = np.stack([[probe(f"{k}:{p}", d) for p in range(probes)] for k in keys]).reshape(n, probes, d)
        # A row's place in the batch goes along as a number of its own, since solve() moves only some rows at a time.
        state = np.concatenate([x, np.zeros((n, 1)), np.arange(n, dtype=np.float64)[:, None]], axis=1)

        def back(s: np.ndarray, t: np.ndarray) -> np.ndarray:
            at, mine = s[:, :d], own[s[:, d + 1].round().astype(int)]
            now = t0 + t1 - t
            along = np.zeros(len(s))
            for p in range(probes):
                e = mine[:, p]
                along += ((drift(at + step * e, now) - drift(at - step * e, now)) * e).sum(axis=1) / (2 * step)
            return np.concatenate([-drift(at, now), (along / probes)[:, None], np.zeros((len(s), 1))], axis=1)

        end, taken, rejected, finished = solve(state, back, t0, t1, rtol, atol, tries)
        noise = end[:, :d]
        logp = -0.5 * (noise**2).sum(axis=1) - 0.5 * d * math.log(2 * math.pi) - end[:, d]
        return [logp.tolist(), noise.tolist(), taken.tolist(), rejected.tolist(), finished.tolist()]

    return _map(rows, vector, [("logp", "double", pa.float64()), ("prior_end", "array<double>", DOUBLES), ("taken", "bigint", pa.int64()), ("rejected", "bigint", pa.int64()), ("finished", "boolean", pa.bool_())], work)
