"""Variogram models fitted to variogram maps: each generation of candidates is judged in one pass over the map."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithospark.operators.spatial import _gamma_np, cut
from lithospark.spec import Structure, VariogramModel


def model_of(p: np.ndarray, kinds: list[str], nugget: float = 0.0) -> VariogramModel:
    """Horizontal structures from rows of major range, minor by major range, azimuth, sill."""
    return VariogramModel(nugget, tuple(Structure(k, float(s), (float(a), float(a * r), float(a)), float(az)) for k, (a, r, az, s) in zip(kinds, np.reshape(p, (len(kinds), 4)))))


def misfits(varmap: DataFrame, candidates: np.ndarray, kinds: list[str], cell: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """candidate, misfit: sums of squared differences of varmap(di, dj, gamma) and each candidate's surface.

    A lag of distance d weighs 1 / d / (6.28 d / mean cell size), the center nothing; lags without gamma take no part."""
    models, spacing = [model_of(p, kinds) for p in np.atleast_2d(candidates)], sum(cell) / len(cell)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(models))
        for b in batches:
            x, y, g = b.column("di").to_numpy() * cell[0], b.column("dj").to_numpy() * cell[1], b.column("gamma").to_numpy()
            d = np.hypot(x, y)
            w = np.where(d < 0.0001, 0.0, spacing / (6.28 * np.maximum(d, 0.0001) ** 2))
            total += [float((w * (_gamma_np(x, y, np.zeros(len(x)), m) - g) ** 2).sum()) for m in models]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(models), dtype=np.int32)), pa.array(total)], ["candidate", "misfit"])

    rows = varmap.where(F.col("gamma").isNotNull()).select(F.col("di").cast("double").alias("di"), F.col("dj").cast("double").alias("dj"), F.col("gamma").cast("double").alias("gamma"))
    return rows.mapInArrow(run, "candidate int, misfit double").groupBy("candidate").agg(F.sum("misfit").alias("misfit"))


def _genetic(u: np.ndarray, f: np.ndarray, rng: np.random.Generator, state: dict) -> np.ndarray:
    """Winners of tournaments are crossed and changed a little, less from generation to generation; the best stays."""
    n, m = u.shape
    pick = lambda: np.array([min(rng.integers(n, size=3), key=lambda i: f[i]) for _ in range(n)])
    a, b, t = u[pick()], u[pick()], rng.uniform(-0.25, 1.25, (n, m))
    state["step"] = state.get("step", 0.2) * 0.93
    out = a + t * (b - a) + rng.normal(0, state["step"], (n, m)) * (rng.random((n, m)) < 0.5)
    out[0] = u[f.argmin()]
    return out


def _swarm(u: np.ndarray, f: np.ndarray, rng: np.random.Generator, state: dict) -> np.ndarray:
    """Each candidate is drawn towards its own best place and the best of all."""
    if "best" not in state:
        state |= {"best": u.copy(), "at": f.copy(), "speed": np.zeros_like(u)}
    better = f < state["at"]
    state["best"][better], state["at"][better] = u[better], f[better]
    top = state["best"][state["at"].argmin()]
    state["speed"] = 0.72 * state["speed"] + 1.49 * rng.random(u.shape) * (state["best"] - u) + 1.49 * rng.random(u.shape) * (top - u)
    return u + state["speed"]


def _annealing(u: np.ndarray, f: np.ndarray, rng: np.random.Generator, state: dict) -> np.ndarray:
    """Independent walks: a worse place is taken with a chance that falls with the temperature, as the steps do."""
    if "u" not in state:
        state |= {"u": u.copy(), "f": f.copy(), "t": float(np.median(f)) or 1.0, "step": 0.3}
    take = (f < state["f"]) | (rng.random(len(f)) < np.exp(-np.clip((f - state["f"]) / state["t"], 0, 700)))
    state["u"][take], state["f"][take] = u[take], f[take]
    state["t"], state["step"] = 0.7 * state["t"], max(0.005, 0.9 * state["step"])
    worst = state["f"] > np.quantile(state["f"], 0.75)
    state["u"][worst], state["f"][worst] = state["u"][state["f"].argmin()], state["f"].min()
    return state["u"] + rng.normal(0, state["step"], u.shape) * (rng.random(u.shape) < 0.4)


METHODS: dict[str, Callable] = {"genetic": _genetic, "swarm": _swarm, "annealing": _annealing}


def fit_variogram(varmap: DataFrame, kinds: list[str], method: str = "genetic", cell: tuple[float, float] = (1.0, 1.0), population: int = 40, generations: int = 40, seed: int = 1) -> tuple[VariogramModel, float]:
    """The best model found, with these kinds of structures, and its misfit.

    Ranges go up to the map's half extent, minor ranges down to a tenth of the major ones, sills up to the largest gamma."""
    rows = cut(varmap.select("di", "dj", "gamma"))
    far_i, far_j, top = rows.agg(F.max(F.abs("di")), F.max(F.abs("dj")), F.max("gamma")).first()
    if not top:
        raise ValueError("a map without values above 0 has no model")
    far = max(far_i * cell[0], far_j * cell[1])
    low, high = np.tile([min(cell), 0.1, 0.0, 0.0], len(kinds)), np.tile([far, 1.0, 180.0, 1.1 * top], len(kinds))
    turns = np.tile([False, False, True, False], len(kinds))
    rng, state = np.random.default_rng(seed), {}
    u = rng.random((population, 4 * len(kinds)))
    best, least = u[0], np.inf
    for _ in range(generations):
        u = np.where(turns, u % 1.0, np.abs(1 - np.abs(1 - u) % 2))  # azimuths go round, others are reflected at the bounds
        u = np.clip(u, 0, 1)
        f = np.full(population, np.inf)
        for r in misfits(rows, low + u * (high - low), kinds, cell).collect():  # a row a candidate
            f[r["candidate"]] = r["misfit"]
        if f.min() < least:
            best, least = u[f.argmin()].copy(), float(f.min())
        u = METHODS[method](u, f, rng, state)
    return model_of(low + best * (high - low), kinds), least
