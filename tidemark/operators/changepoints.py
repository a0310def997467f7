"""Change points of level, trend or volatility: one group of Arrow rows per series, any number of series.

The series are what is distributed; a group is one series, whose exact optimal partition takes time nearly in
proportion to its points. The cost is the squared deviation from segment means of the standardised signal,
the penalty a multiple of log n.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

# Penalty multiples of log n by sensitivity, and grades by how many of them agree.
MULTIPLES = {"low": 3.0, "medium": 2.0, "high": 1.0}
GRADES = {3: "solid", 2: "moderate", 1: "tentative"}
PER_YEAR = ((1.5, 365), (8, 52), (35, 12), (100, 4), (float("inf"), 1))
SCHEMA = "period date, before double, after double, shift double, shift_in_sd double, direction string, support int, confidence string, recent boolean, shape string, seasonal double, n_obs int"


def partitions(z: np.ndarray, penalties: list[float], least: int) -> list[list[int]]:
    """For each penalty the segment ends that minimise squared deviations plus the penalty a segment, each of
    ``least`` points or more; exact, for all penalties in one pass.

    A start is kept only while some level of the segment that begins there makes it the cheapest. The costs of
    starts by level are parabolas that rise alike with each point, so one that lies above others everywhere does
    so for good. The lowest ones over all levels are a few pieces, and a start that becomes possible can only take
    levels outside an interval of each piece.
    """
    n, kinds = len(z), len(penalties)
    s, q = np.concatenate([[0], np.cumsum(z)]), np.concatenate([[0], np.cumsum(z * z)])
    best, back = np.full((kinds, n + 1), np.inf), np.zeros((kinds, n + 1), np.int64)
    penalty = np.asarray(penalties, float)
    best[:, 0] = -penalty
    # Pieces in order of penalty and level: the levels from low to high, for which start gives the least cost.
    low, high, start, kind = (np.zeros(0), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64))
    bottom, top = (float(z.min()), float(z.max())) if n else (0.0, 0.0)
    for end in range(least, n + 1):
        new = end - least
        if np.isfinite(best[:, new]).all():
            if not len(start):
                low, high, start, kind = np.full(kinds, bottom), np.full(kinds, top), np.full(kinds, new), np.arange(kinds)
            else:
                # Where the new start's parabola is not lower: between the roots of a difference that bends down.
                a = (start - new).astype(float)
                b = 2.0 * (s[new] - s[start])
                c = best[kind, new] - best[kind, start] + (q[start] - q[new]) + 1e-10
                gap = b * b - 4 * a * c
                root = np.sqrt(np.maximum(gap, 0.0))
                one, two = (-b + root) / (2 * a), (-b - root) / (2 * a)
                one, two = np.where(gap > 0, np.clip(one, low, high), high), np.where(gap > 0, np.clip(two, low, high), high)
                edges = np.stack([low, one, two, high])
                keep = (edges[1:] > edges[:-1]).T.ravel()
                keep |= np.stack([np.zeros_like(a, bool), (low == high) & (gap > 0) & (c - b * b / (4 * a) > 0), np.zeros_like(a, bool)]).T.ravel()
                lows, highs = edges[:-1].T.ravel()[keep], edges[1:].T.ravel()[keep]
                starts = np.stack([np.full_like(start, new), start, np.full_like(start, new)]).T.ravel()[keep]
                kinds_of = np.repeat(kind, 3)[keep]
                head = np.concatenate([[True], (starts[1:] != starts[:-1]) | (kinds_of[1:] != kinds_of[:-1])])
                at = np.flatnonzero(head)
                low, high, start, kind = lows[at], highs[np.append(at[1:], len(highs)) - 1], starts[at], kinds_of[at]
        if len(start):
            cost = best[kind, start] + q[end] - q[start] - (s[end] - s[start]) ** 2 / (end - start) + penalty[kind]
            for k in range(kinds):
                mine = np.flatnonzero(kind == k)
                least_cost = cost[mine].min()
                best[k, end] = least_cost
                back[k, end] = start[mine[cost[mine] == least_cost]].min()
    out = []
    for k in range(kinds):
        ends, at = [], n
        while at > 0:
            ends.append(at)
            at = int(back[k, at])
        out.append(ends[::-1])
    return out


def partition(z: np.ndarray, penalty: float, least: int) -> list[int]:
    """`partitions` for one penalty."""
    return partitions(z, [penalty], least)[0]


#: Windows whose quartiles are taken at a time.
WINDOWS = 4096


def trailing(x: np.ndarray, window: int, ahead: int) -> list[tuple[int, bool, float]]:
    """Outliers against the ``window`` points before: position, whether it starts a regime, and its fence."""
    found = []
    past = np.lib.stride_tricks.sliding_window_view(x, window)[: max(0, len(x) - window)]
    for at in range(0, len(past), WINDOWS):
        some, here = past[at : at + WINDOWS], x[window + at : window + at + WINDOWS]
        mean, std = some.mean(axis=1), some.std(axis=1)
        q1, q3 = np.percentile(some, [25, 75], axis=1)
        low, high = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
        for j in np.flatnonzero((std > 0) & (np.abs(here - mean) >= 3 * std) & ~((low <= here) & (here <= high))):
            i = window + at + int(j)
            after = x[i + 1 : i + 1 + ahead]
            up = here[j] > mean[j]
            stays = (after > high[j] if up else after < low[j]).mean() >= 0.5 if len(after) else False
            found.append((i, bool(stays), float(high[j] if up else low[j])))
    return found


def capped(x: np.ndarray, window: int, ahead: int, passes: int = 3) -> np.ndarray:
    """The signal with spikes set to their fence, up to ``passes`` times; starts of regimes stay."""
    out, seen = x.copy(), set()
    for _ in range(passes if len(x) > window else 0):
        new = [f for f in trailing(out, window, ahead) if f[0] not in seen]
        if not new:
            break
        for i, starts, fence in new:
            seen.add(i)
            if not starts:
                out[i] = fence
    return out


def shape_of(z: np.ndarray, ends: list[int], penalty: float) -> tuple[str, np.ndarray]:
    """stepwise, gradual or flat, and what the better description leaves over."""
    steps = z.copy()
    for a, b in zip([0, *ends[:-1]], ends, strict=True):
        steps[a:b] -= z[a:b].mean()
    t = np.arange(len(z))
    slope, level = np.polyfit(t, z, 1)
    line = z - slope * t - level
    total = float(((z - z.mean()) ** 2).sum()) or 1.0
    straight = 1 - float((line**2).sum()) / total >= 0.2
    if len(ends) > 1:
        gradual = straight and (line**2).sum() + penalty <= (steps**2).sum() + penalty * (len(ends) - 1)
        return ("gradual", line) if gradual else ("stepwise", steps)
    return ("gradual", line) if straight else ("flat", steps)


def breaks_of(periods: pd.Series, values: pd.Series, kind: str, sensitivity: str, in_points: bool) -> pd.DataFrame:
    """The breaks of one series in order; an empty frame if it is too short or has none."""
    known = pd.DataFrame({"p": pd.to_datetime(periods), "v": values.astype(float)}).dropna().sort_values("p")
    none = pd.DataFrame(columns=[c.split()[0] for c in SCHEMA.split(", ")])
    if len(known) < 3:
        return none
    gaps = np.diff(known["p"].to_numpy()).astype("timedelta64[D]").astype(float)
    per_year = next(n for limit, n in PER_YEAR if np.median(gaps) <= limit)
    least = max(4, round(per_year / 4))
    x, at = known["v"].to_numpy(), known["p"].to_numpy()
    if kind != "level":
        if (x <= 0).any():
            return none
        x, at = np.diff(np.log(x)) * 100 / np.maximum(1, np.round(gaps / np.median(gaps))), at[1:]
        if kind == "volatility":
            x = (x - x.mean()) ** 2
    if len(x) < 2 * least:
        return none
    if kind != "volatility":
        x = capped(x, max(12, per_year), least)
    spread = x.std()
    z = (x - x.mean()) / spread if spread > 0 else np.zeros(len(x))
    ends = dict(zip(MULTIPLES, partitions(z, [m * np.log(len(x)) for m in MULTIPLES.values()], least), strict=True))
    mine = ends[sensitivity]
    shape, rest = shape_of(z, mine, MULTIPLES[sensitivity] * np.log(len(x)))
    seasonal = float(np.corrcoef(rest[per_year:], rest[:-per_year])[0, 1]) if per_year > 1 and len(rest) >= 2 * per_year + 2 and rest.std() > 0 else None
    bounds, near = [0, *mine], max(1, round(least / 2))
    means = [float(x[a:b].mean()) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    if kind == "volatility":
        means = [float(np.sqrt(m)) for m in means]
    rows = []
    for i, cut in enumerate(mine[:-1]):
        support = sum(any(abs(cut - c) <= near for c in e[:-1]) for e in ends.values())
        before, after = means[i], means[i + 1]
        shift = after - before if in_points or kind != "level" else (100 * (after / before - 1) if before else None)
        last = i == len(mine) - 2 and mine[-1] - cut < 2 * least
        rows.append((pd.Timestamp(at[cut]).date(), before, after, shift, abs(after - before) / spread if spread > 0 else 0.0, "up" if after > before else "down", support, GRADES[support], bool(last), shape, seasonal, len(known)))
    return pd.DataFrame(rows, columns=none.columns)


def change_points(df: DataFrame, keys: list[str], kind: str = "level", sensitivity: str = "medium", value: str = "value", period: str = "period", in_points: bool = False) -> DataFrame:
    """All breaks of all series of a long table.

    ``kind`` is level, trend or volatility; for trend and volatility a series must be positive. A
    break's support says at how many of the three sensitivities it appears.
    """
    if kind not in ("level", "trend", "volatility") or sensitivity not in MULTIPLES:
        raise ValueError(f"unknown kind {kind!r} or sensitivity {sensitivity!r}")
    fields = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        out = breaks_of(pdf[period], pdf[value], kind, sensitivity, in_points)
        for i, k in enumerate(keys):
            out.insert(i, k, pdf[k].iloc[0])
        return out

    return df.select(*keys, period, value).groupBy(*keys).applyInPandas(one, f"{fields}, {SCHEMA}")
