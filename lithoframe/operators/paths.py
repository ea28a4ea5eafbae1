"""Operators that are sequential within a well: beam search, particle filter, self-correlation, spectrum.

A well is one task's group, as its steps depend on each other; wells run side
by side. A well that would be too long for that is to be cut before.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Beam size, cost of a move, scale of the GR error, smoothing half-width, name: fixed values.
BEAMS = [(10, 20.0, 144.0, 2, "cons"), (10, 8.0, 64.0, 2, "loose"), (8, 35.0, 220.0, 1, "vcons"), (10, 14.0, 90.0, 5, "sm5"), (20, 4.0, 36.0, 3, "vloose"), (12, 12.0, 100.0, 3, "mid"), (15, 25.0, 180.0, 2, "stiff")]


def smoothed(v: np.ndarray, half: int) -> np.ndarray:
    """Centred mean over what is there; gaps stay with the nearest values' mean."""
    ok = np.isfinite(v)
    kernel = np.ones(2 * half + 1)
    total, n = np.convolve(np.where(ok, v, 0), kernel, "same"), np.convolve(ok.astype(float), kernel, "same")
    filled = np.where(n > 0, total / np.maximum(n, 1), np.nan)
    return np.where(np.isfinite(filled), filled, np.nanmean(v) if ok.any() else 0.0)


def beam_path(gr: np.ndarray, tw_gr: np.ndarray, start: int, size: int = 10, move_cost: float = 20.0, emit_scale: float = 144.0, reach: int = 1) -> np.ndarray:
    """Typewell indices along ``gr``: the cheapest path that moves at most ``reach`` a row, of the ``size`` best kept each time. Ties go to the lesser index."""
    states, costs = np.array([start]), np.zeros(1)
    back: list[tuple[np.ndarray, np.ndarray]] = []
    moves = np.arange(-reach, reach + 1)
    for g in gr:
        to = (states[:, None] + moves).ravel()
        cost = (costs[:, None] + move_cost * np.abs(moves)).ravel()
        parent = np.repeat(np.arange(len(states)), len(moves))
        inside = (to >= 0) & (to < len(tw_gr))
        to, cost, parent = to[inside], cost[inside], parent[inside]
        order = np.lexsort((parent, cost, to))
        first = np.concatenate([[True], to[order][1:] != to[order][:-1]])
        best = order[first]
        to, cost, parent = to[best], cost[best] + (g - tw_gr[to[best]]) ** 2 / emit_scale, parent[best]
        keep = np.sort(np.lexsort((to, cost))[:size])
        states, costs = to[keep], cost[keep]
        back.append((states, parent[keep]))
    out, at = np.zeros(len(gr), np.int64), int(np.argmin(costs))
    for t in range(len(gr) - 1, -1, -1):
        out[t] = back[t][0][at]
        at = back[t][1][at]
    return out


def particle_path(gr: np.ndarray, z: np.ndarray, md: np.ndarray, tw_tvt: np.ndarray, tw_gr: np.ndarray, start: float, speed: float, seed: int, n: int = 500, momentum: float = 0.998, sigma: float = 20.0, on: str = "tvt", noise: tuple[float, float] = (0.005, 0.01)) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of TVT along hidden rows, by a particle filter on TVT or on S = TVT + Z. Resamples when half the particles count."""
    rng = np.random.default_rng(seed)
    base = z if on == "s" else np.zeros(len(z))
    x, v, w = np.full(n, start + (base[0] if len(base) else 0)) + rng.normal(0, 0.5, n), np.full(n, speed) + rng.normal(0, 0.01, n), np.full(n, 1 / n)
    mean, sd = np.zeros(len(gr)), np.zeros(len(gr))
    for t in range(len(gr)):
        dm = md[t] - md[t - 1] if t else 1.0
        v = momentum * v + rng.normal(0, noise[1], n)
        x = x + v * dm + rng.normal(0, noise[0], n)
        tvt = x - base[t]
        if np.isfinite(gr[t]):
            logw = np.log(w + 1e-300) - 0.5 * ((gr[t] - np.interp(tvt, tw_tvt, tw_gr)) / sigma) ** 2
            w = np.exp(logw - logw.max())
            w /= w.sum()
        mean[t] = w @ tvt
        sd[t] = np.sqrt(max(0.0, w @ tvt**2 - mean[t] ** 2))
        if 1 / (w @ w) < n / 2:
            pick = np.searchsorted(np.cumsum(w), (rng.random() + np.arange(n)) / n).clip(0, n - 1)
            x, v, w = x[pick], v[pick], np.full(n, 1 / n)
    return mean, sd


def self_match(seen_gr: np.ndarray, seen_tvt: np.ndarray, gr: np.ndarray, half: int, stride: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Per hidden row, the TVT at the centre of the visible window that correlates best with the row's own, and that correlation; NaN if too little is visible.

    A window is the rows within ``half``; a hidden log's ends are repeated
    beyond it, visible windows start every ``stride`` rows. Windows of equal
    values are compared once. Correlations are products of blocks of scaled
    windows, so a block and the distinct visible windows are held. Of
    correlations that agree to nine places the first window wins.
    """
    win, n = 2 * half + 1, len(gr)
    starts = len(seen_gr) - win + 1
    if starts < 1 or not n:
        return np.full(n, np.nan), np.full(n, np.nan)
    level = seen_gr.mean()
    seen, own = seen_gr - level, np.concatenate([np.full(half, gr[0]), gr, np.full(half, gr[-1])]) - level

    def scaled(v: np.ndarray, at: np.ndarray) -> np.ndarray:
        w = np.lib.stride_tricks.sliding_window_view(v, win)[at]
        w = w - w.mean(axis=1, keepdims=True)
        return w / (np.sqrt((w * w).mean(axis=1, keepdims=True)) + 1e-6)

    first = np.sort(np.unique(window_numbers(seen, win)[::stride], return_index=True)[1]) * stride
    _, rows, which = np.unique(window_numbers(own, win), return_index=True, return_inverse=True)
    held = scaled(seen, first)
    best, where = np.full(len(rows), -np.inf), np.zeros(len(rows), np.int64)
    for a in range(0, len(rows), 256):
        mine, now, place = scaled(own, rows[a : a + 256]) / win, best[a : a + 256], where[a : a + 256]
        for b in range(0, len(first), 4096):
            c = mine @ held[b : b + 4096].T
            top = np.round(c.max(axis=1), 9)
            better = np.flatnonzero(top > now)
            # The first that rounds to the best.
            place[better] = first[b + (c[better] >= top[better, None] - 5e-10).argmax(axis=1)]
            now[better] = top[better]
    return seen_tvt[where[which] + half], best[which]


def window_numbers(v: np.ndarray, win: int) -> np.ndarray:
    """A number for each window of ``win`` values; windows have one number if and only if their values are equal."""
    ids = np.unique(v, return_inverse=True)[1].astype(np.int64)
    width = 1
    while width < win:
        step = min(width, win - width)
        ids = np.unique(ids[:-step] * (len(v) + 1) + ids[step:], return_inverse=True)[1]
        width += step
    return ids


def spectrum(v: np.ndarray) -> tuple[float, float]:
    """Dominant frequency (a share of the sampling rate) and log power; NaN for fewer than 3 values."""
    v = v[np.isfinite(v)]
    if len(v) < 3:
        return float("nan"), float("nan")
    power = np.abs(np.fft.rfft(v - v.mean())) ** 2
    k = int(np.argmax(power[1:])) + 1
    return k / len(v), float(np.log1p(power[k]))


def _per_well(h: DataFrame, t: DataFrame | None, run, schema: str, key: str, order: str) -> DataFrame:
    if t is None:
        return h.groupBy(key).applyInPandas(lambda p: run(p.sort_values(order, kind="stable"), None), schema)
    both = h.groupBy(key).cogroup(t.groupBy(key))
    return both.applyInPandas(lambda p, q: run(p.sort_values(order, kind="stable"), q.sort_values("TVT", kind="stable")), schema)


def _anchor(p: pd.DataFrame) -> float:
    seen = p["TVT_input"].dropna()
    return float(seen.iloc[-1]) if len(seen) else float("nan")


def beam_features(h: DataFrame, t: DataFrame, beams=BEAMS, key: str = "well", order: str = "row_idx") -> DataFrame:
    """Per hidden row, each beam's TVT less the last visible, and their mean, deviation and median. ``t`` has the wells' typewells by ``key``."""
    names = [f"beam_{b[4]}_d" for b in beams]

    def run(p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        hid, last = p[p["TVT_input"].isna()], _anchor(p)
        out = hid[[key, order]].copy()
        tvt, gr = q["TVT"].to_numpy(float), q["GR"].to_numpy(float)
        paths = []
        for size, move, scale, half, _ in beams:
            if not len(hid) or not len(q) or not np.isfinite(last):
                paths.append(np.full(len(hid), np.nan))
                continue
            start = int(np.argmin(np.abs(tvt - last)))
            paths.append(tvt[beam_path(smoothed(hid["GR"].to_numpy(float), half), smoothed(gr, 0), start, size, move, scale)] - last)
        m = np.array(paths).reshape(len(beams), len(hid))
        out[names] = m.T
        out["beam_mean_d"], out["beam_std_d"], out["beam_med_d"] = m.mean(0), m.std(0), np.median(m, 0)
        return out

    kind = dict(h.dtypes)
    return _per_well(h, t, run, f"{key} {kind[key]}, {order} {kind[order]}, " + ", ".join(f"{n} double" for n in [*names, "beam_mean_d", "beam_std_d", "beam_med_d"]), key, order)


def particle_features(h: DataFrame, t: DataFrame, on: str = "tvt", key: str = "well", order: str = "row_idx", **options) -> DataFrame:
    """Per hidden row, the filter's TVT less the last visible, and its deviation; seeded by the well's key."""

    def run(p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        hid, last = p[p["TVT_input"].isna()], _anchor(p)
        out = hid[[key, order]].copy()
        mean = sd = np.full(len(hid), np.nan)
        if len(hid) and len(q) and np.isfinite(last):
            seen = p[p["TVT_input"].notna()]
            level = seen["TVT_input"] + (seen["Z"] if on == "s" else 0)
            speed = float(np.median(np.diff(level.to_numpy()))) if len(seen) > 1 else 0.0
            seed = zlib.crc32(str(p[key].iloc[0]).encode())
            mean, sd = particle_path(*(hid[c].to_numpy(float) for c in ("GR", "Z", "MD")), q["TVT"].to_numpy(float), q["GR"].to_numpy(float), last, speed, seed, on=on, **options)
        out["pf_d"], out["pf_std"] = mean - last, sd
        return out

    kind = dict(h.dtypes)
    return _per_well(h, t, run, f"{key} {kind[key]}, {order} {kind[order]}, pf_d double, pf_std double", key, order)


def self_match_features(h: DataFrame, halves: tuple[int, ...] = (8, 15, 25), stride: int = 3, key: str = "well", order: str = "row_idx") -> DataFrame:
    """Per hidden row and window size, the matched TVT less the last visible, and the score."""

    def run(p: pd.DataFrame, _) -> pd.DataFrame:
        seen, hid, last = p[p["TVT_input"].notna()], p[p["TVT_input"].isna()], _anchor(p)
        out = hid[[key, order]].copy()
        for half in halves:
            tvt, score = self_match(smoothed(seen["GR"].to_numpy(float), 0), seen["TVT_input"].to_numpy(float), smoothed(hid["GR"].to_numpy(float), 0), half, stride)
            out[f"sc{half}_d"], out[f"sc{half}_score"] = tvt - last, score
        return out

    kind = dict(h.dtypes)
    return _per_well(h, None, run, f"{key} {kind[key]}, {order} {kind[order]}, " + ", ".join(f"sc{x}_d double, sc{x}_score double" for x in halves), key, order)


def spectrum_features(h: DataFrame, key: str = "well", order: str = "row_idx") -> DataFrame:
    def run(p: pd.DataFrame, _) -> pd.DataFrame:
        f, power = spectrum(p.loc[p["TVT_input"].isna(), "GR"].to_numpy(float))
        return pd.DataFrame({key: [p[key].iloc[0]], "fft_freq": [f], "fft_log_power": [power]})

    return _per_well(h, None, run, f"{key} {dict(h.dtypes)[key]}, fft_freq double, fft_log_power double", key, order)


def typewell_of(t: DataFrame, wells: DataFrame) -> DataFrame:
    """One shared typewell given to each of ``wells``, a column of distinct names; its rows for each, as each well's task reads all of them."""
    return t.crossJoin(wells)
