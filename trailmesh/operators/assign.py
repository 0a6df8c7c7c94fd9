"""Optimal one-to-one assignment within groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Rows of many groups that a task solves at a time, and cells of their matrices.
HELD, CELLS = 50_000, 2_000_000


def hungarian(cost: np.ndarray) -> list[tuple[int, int]]:
    """Row-column pairs of least total cost, by shortest augmenting paths; any shape."""
    cost = np.asarray(cost, float)
    if not cost.size:
        return []
    if cost.shape[0] > cost.shape[1]:
        return sorted((r, c) for c, r in hungarian(cost.T))
    n, m = cost.shape
    if n == 1:
        return [(0, int(np.argmin(np.where(cost[0] < np.inf, cost[0], np.inf))))]
    u, v, owner = np.zeros(n + 1), np.zeros(m + 1), np.full(m + 1, -1)
    for i in range(n):
        owner[m], j = i, m
        least, via, done = np.full(m, np.inf), np.full(m, m), np.zeros(m + 1, bool)
        while owner[j] >= 0:
            done[j] = True
            row = owner[j]
            free = ~done[:m]
            slack = cost[row] - u[row] - v[:m]
            better = free & (slack < least)
            least[better], via[better] = slack[better], j
            nxt = int(np.argmin(np.where(free, least, np.inf)))
            delta = least[nxt]
            u[owner[done]] += delta
            v[done] -= delta
            least[free] -= delta
            j = nxt
        while j != m:
            owner[j] = owner[via[j]]
            j = via[j]
    return sorted((int(owner[j]), j) for j in range(m) if owner[j] >= 0)


def hungarians(cost: np.ndarray) -> np.ndarray:
    """The same for many matrices of one shape (batch, n, m) at a time: the pairs of each as booleans."""
    batch, n, m = cost.shape
    if n > m:
        return hungarians(cost.transpose(0, 2, 1)).transpose(0, 2, 1)
    u, v, owner = np.zeros((batch, n + 1)), np.zeros((batch, m + 1)), np.full((batch, m + 1), -1)
    for i in range(n):
        owner[:, m] = i
        at, least, via, done = np.full(batch, m), np.full((batch, m), np.inf), np.full((batch, m), m), np.zeros((batch, m + 1), bool)
        open_ = np.arange(batch)
        while len(open_):
            j = at[open_]
            done[open_, j] = True
            row, seen = owner[open_, j], done[open_]
            free = ~seen[:, :m]
            slack = cost[open_, row] - u[open_, row][:, None] - v[open_, :m]
            low = least[open_]
            better = free & (slack < low)
            low = np.where(better, slack, low)
            via[open_] = np.where(better, j[:, None], via[open_])
            nxt = np.argmin(np.where(free, low, np.inf), axis=1)
            delta = low[np.arange(len(open_)), nxt]
            k, c = np.nonzero(seen)
            u[open_[k], owner[open_[k], c]] += delta[k]
            v[open_] -= np.where(seen, delta[:, None], 0.0)
            least[open_] = np.where(free, low - delta[:, None], low)
            at[open_] = nxt
            open_ = open_[owner[open_, nxt] >= 0]
        back = np.arange(batch)
        while len(back):
            before = via[back, at[back]]
            owner[back, at[back]] = owner[back, before]
            at[back] = before
            back = back[before != m]
    out = np.zeros((batch, n, m), bool)
    b, c = np.nonzero(owner[:, :m] >= 0)
    out[b, owner[b, c], c] = True
    return out


def _codes(values: pd.Series, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each value's place among the sorted distinct ones of its group, and how many each group has."""
    code = pd.factorize(values, sort=True, use_na_sentinel=False)[0].astype(np.int64)
    every, own = np.unique(group * (code.max() + 1) + code, return_inverse=True)
    n = np.bincount(every // (code.max() + 1), minlength=group[-1] + 1)
    return own - (np.cumsum(n) - n)[group], n


def match_groups(pairs: DataFrame, keys: list[str], left: str, right: str, score: str, least: float, gate_first: bool = False, carried: list[str] | None = None, laid: bool = False) -> DataFrame:
    """One-to-one matches of greatest total score in each group of candidate pairs, with the columns ``carried``.

    The threshold is applied after the assignment, or before it with ``gate_first``
    (which then puts the number of matches before their scores). ``laid``: the rows of a group lie in one partition already.
    """
    rows = pairs.select(*keys, left, right, score, *(carried or []))
    schema = ", ".join(f"{c} {t}" for c, t in rows.dtypes)

    def starts_of(pdf: pd.DataFrame) -> np.ndarray:
        own, before = pdf[keys], pdf[keys].shift()
        return np.flatnonzero(~((own == before) | (own.isna() & before.isna())).all(axis=1) | (np.arange(len(pdf)) == 0))

    def solved(pdf: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        size = np.diff(np.append(starts, len(pdf)))
        if not len(pdf):
            return pdf
        group, scores = np.repeat(np.arange(len(starts)), size), pdf[score].to_numpy(float)
        (rows, n), (cols, m) = _codes(pdf[left], group), _codes(pdf[right], group)
        free = (n == size) & (m == size)  # nothing competes
        good = free[group] & (scores >= least)
        width = int(m.max()) + 1
        shape = np.where(free, -1, n * width + m)
        order = np.argsort(shape[group], kind="stable")
        cuts = np.flatnonzero(np.diff(shape[group][order], prepend=-2))
        for own in np.split(order, cuts[1:]):
            height, across = divmod(int(shape[group[own[0]]]), width)
            if shape[group[own[0]]] < 0:
                continue
            each = max(1, CELLS // (height * across))
            place = np.cumsum(np.diff(group[own], prepend=group[own[0]]) != 0)
            for some in np.split(own, np.searchsorted(place, np.arange(each, place[-1] + 1, each))):
                b = np.cumsum(np.diff(group[some], prepend=group[some[0]]) != 0)
                value = np.zeros((int(b[-1]) + 1, height, across))
                value[b, rows[some], cols[some]] = scores[some] + gate_first
                kept = hungarians(-value) & (value - gate_first >= least) if len(value) > 1 else np.zeros(value.shape, bool)
                if len(value) == 1:
                    for r, c in hungarian(-value[0]):
                        kept[0, r, c] = value[0, r, c] - gate_first >= least
                good[some] = kept[b, rows[some], cols[some]]
        return pdf[good]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, more = None, []
        for pdf in batches:
            more.append(pdf)
            if sum(map(len, more)) < HELD:
                continue
            pdf = pd.concat([*([] if held is None else [held]), *more], ignore_index=True)
            more.clear()
            if len(pdf):
                starts = starts_of(pdf)
                yield solved(pdf.iloc[: starts[-1]], starts[:-1])
                held = pdf.iloc[starts[-1] :]  # its group may go on
        if held is not None or more:
            pdf = pd.concat([*([] if held is None else [held]), *more], ignore_index=True)
            yield solved(pdf, starts_of(pdf))

    rows = rows.filter(F.col(score) >= least) if gate_first else rows
    return (rows if laid else rows.repartition(*keys)).sortWithinPartitions(*keys).mapInPandas(run, schema)
