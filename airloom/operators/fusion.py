"""Hourly correction factors by coordinate descent, validation and persistent learning.

One group is one variable and hour: a handful of stations by categories, so a group is small whatever the archive's
length, and hours are spread over all tasks. Within a group, numpy arrays hold all candidate moves at once.
"""

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Weight factor of a station's penalty class, from good to outlier.
PENALTY = np.array([1.0, 0.6, 0.4, 0.2, 0.1, 0.05])
#: Exponent of the cost of penalty classes, by strength.
STRENGTH = {"high": -1.0, "medium": -1.2, "low": -1.5, "costless": -30.0}
#: Learning.
RATE, SPLASH, LOW, HIGH = 0.01, 0.33, 0.7, 2.0


def weights(imprecision, covar, previous, history=0.4, power=1.0, own=0.7, missing=2.0):
    """Normalized weights: imprecise and unsteady stations count less, the hour before counts ``history``."""
    covar = np.where(covar > 0, np.maximum(covar, 0) ** power, 0.0)
    mean = covar.mean() if len(covar) else 0.0
    spread = np.where(covar > 0, own * covar + (1 - own) * mean, missing * mean)
    w = np.where(previous, history, 1.0) / np.maximum(np.maximum(1.0, imprecision) * spread, 1e-9)
    return w / w.sum()


#: Changes of a penalty class by one and two steps down and up: (class, size, direction) -> new class, and where there is none.
TO = np.arange(len(PENALTY))[:, None, None] + np.array([[-1, 1], [-2, 2]])
NONE = np.where((TO < 0) | (TO >= len(PENALTY)), np.inf, 0.0)
TO = np.clip(TO, 0, len(PENALTY) - 1)
GAIN = PENALTY[TO] - PENALTY[:, None, None]


@lru_cache
def prices(exponent):
    """(price of each class, its change by each move)."""
    price = PENALTY**exponent
    return price, price[TO] - price[:, None, None]


def penalties(e2, w, exponent, live=None):
    """(cost, class of each station) of each problem, a row of errors and weights over its ``live`` stations: class changes of one or two steps, the best first, while the cost falls.

    The cost is a weighted error sum times a mean price, so each change's cost follows from both and one station's terms;
    ties go to the smaller step, then to the station, then to the class below. One problem may come without the first axis."""
    if e2.ndim == 1:
        cost, state = penalties(e2[None], w[None], exponent)
        return cost[0], state[0]
    live = np.ones(e2.shape, bool) if live is None else live
    price, dear = prices(exponent)
    n, count, wide = e2.shape[1], live.sum(axis=1), (slice(None), None, None, None)
    load, state, barred = np.where(live, w * e2, 0.0), np.zeros(e2.shape, int), np.where(live, 0.0, np.inf)[:, :, None, None]
    total, paid = load.sum(axis=1), count * price[0]
    best, left = total * paid / count, np.arange(len(e2))
    while len(left):
        own = state[left]
        costs = (total[left][wide] + load[left][:, :, None, None] * GAIN[own]) * (paid[left][wide] + dear[own]) / count[left][wide] + NONE[own] + barred[left]
        costs = costs.transpose(0, 2, 1, 3).reshape(len(left), -1)
        at = costs.argmin(axis=1)
        better = costs[np.arange(len(left)), at] < best[left] - 1e-12
        left, at = left[better], at[better]
        size, k, way = at // (2 * n), at // 2 % n, at % 2
        state[left, k] = TO[state[left, k], size, way]
        total[left], paid[left] = (load[left] * PENALTY[state[left]]).sum(axis=1), (price[state[left]] * live[left]).sum(axis=1)
        best[left] = total[left] * paid[left] / count[left]
    return best, state


def search_space(low, high, step):
    return np.round(np.arange(low, high + step / 2, step), 9) if step > 0 else np.array([1.0])


def descent(problems, additive, exponent):
    """``[(factors, cost, classes)]`` of problems ``(observed, parts, w, spaces)``: from the middle of each category's space, single moves of growing size while any lowers the
    cost. ``parts`` is stations by categories; an additive category's factor is added, the others multiply. All moves
    are costed at once under the stations' present classes, and the classes follow each accepted move. The problems share the arrays, padded to the longest."""
    m, n, n_cat = len(problems), max(len(p[0]) for p in problems), len(additive)
    observed, parts, w, live = np.zeros((m, n)), np.zeros((m, n, n_cat)), np.zeros((m, n)), np.zeros((m, n), bool)
    size_of = np.array([[len(s) for s in p[3]] for p in problems])
    table = np.zeros((m, n_cat, size_of.max()))
    for k, (o, x, own, spaces) in enumerate(problems):
        observed[k, : len(o)], parts[k, : len(o)], w[k, : len(o)], live[k, : len(o)] = o, x, own, True
        for c, s in enumerate(spaces):
            table[k, c, : len(s)] = s
    slope = np.where(additive, 1.0, parts)
    at, steps, (price, _) = size_of // 2, np.array([-1, 1, -2, 2]), prices(exponent)
    value = np.take_along_axis(table, at[:, :, None], axis=2)[:, :, 0]
    model = np.where(additive, parts, 0.0).sum(axis=2) + np.einsum("pnc,pc->pn", slope, value)
    best, state = penalties((observed - np.maximum(model, 0)) ** 2, w, exponent, live)
    size, count = np.ones(m, int), live.sum(axis=1)
    left = np.flatnonzero((size_of > 1).any(axis=1))
    while len(left):
        to = at[left][:, :, None] + size[left][:, None, None] * steps
        legal = (to >= 0) & (to < size_of[left][:, :, None]) & (size_of[left] > 1)[:, :, None]
        change = np.take_along_axis(table[left], np.where(legal, to, 0), axis=2) - value[left][:, :, None]
        trial = model[left][:, :, None, None] + slope[left][:, :, :, None] * change[:, None]
        e2 = (observed[left][:, :, None, None] - np.maximum(trial, 0)) ** 2
        mean = (price[state[left]] * live[left]).sum(axis=1) / count[left]
        costs = np.where(legal, np.einsum("pn,pnck->pck", w[left] * PENALTY[state[left]], e2) * mean[:, None, None], np.inf).reshape(len(left), -1)
        k, rows = costs.argmin(axis=1), np.arange(len(left))
        c, s = k // len(steps), k % len(steps)
        cost, classes = penalties(e2[rows, :, c, s], w[left], exponent, live[left])
        better = np.isfinite(costs[rows, k]) & (cost < best[left] - 1e-12)
        go, r, cb, sb = left[better], rows[better], c[better], s[better]
        at[go, cb] = to[r, cb, sb]
        value[go, cb] = table[go, cb, at[go, cb]]
        model[go], best[go], state[go], size[go] = trial[r, :, cb, sb], cost[better], classes[better], 1
        size[left[~better]] += 1
        left = left[size[left] <= 4]
    return [(value[k], float(best[k]), state[k, : len(p[0])]) for k, p in enumerate(problems)]


FITTED = T.StructType([T.StructField("var", T.StringType()), T.StructField("sys_hour", T.LongType()), T.StructField("factors", T.ArrayType(T.DoubleType())), T.StructField("cost", T.DoubleType()), T.StructField("stations", T.ArrayType(T.StringType())), T.StructField("classes", T.ArrayType(T.IntegerType())), T.StructField("permille", T.ArrayType(T.DoubleType()))])


def spaces_for(observed, parts):
    """The background (first) is additive between the observations' gaps; a category below 2 % is fixed at its default."""
    total = parts.sum()
    gap = observed.min() - parts[:, 0].min()
    first = search_space(min(gap, 0.0), max(gap, 0.0) + 1.0, 1.0)
    return [first] + [search_space(0.4, 2.0, 0.1) if total > 0 and parts[:, k].sum() / total >= 0.02 else np.array([1.0]) for k in range(1, parts.shape[1])]


def problem(observed, parts, imprecision, covar, previous):
    """An hour's fit, for ``descent``."""
    return observed, parts, weights(imprecision, covar, previous), spaces_for(observed, parts)


def columns(pdf, n_cat):
    return pdf["value"].to_numpy(float), np.array(pdf["parts"].tolist(), float).reshape(len(pdf), n_cat), pdf["imprecision"].to_numpy(float), pdf["covar"].to_numpy(float), pdf["previous"].to_numpy(bool)


def by_hour(inputs: DataFrame, solve, kind: T.StructType, pack: int = 64) -> DataFrame:
    """``solve([(var, sys_hour, rows)])`` -> tuples of ``kind`` for each variable and hour. Hours stream through the tasks in order; ``pack`` hours' stations are
    held at a time and solved together."""

    def hours(batches):
        held = []
        for batch in batches:
            key = (batch["sys_hour"].ne(batch["sys_hour"].shift()) | batch["var"].ne(batch["var"].shift())).to_numpy()
            starts = [0, *[int(x) for x in np.flatnonzero(key) if x], len(batch)]
            for lo, hi in zip(starts, starts[1:]):
                part = batch.iloc[lo:hi]
                if held and (held[0]["var"].iloc[0], held[0]["sys_hour"].iloc[0]) != (part["var"].iloc[0], part["sys_hour"].iloc[0]):
                    yield pd.concat(held, ignore_index=True)
                    held = []
                held.append(part)
        if held:
            yield pd.concat(held, ignore_index=True)

    def run(batches):
        held = []
        for pdf in hours(b for b in batches if len(b)):
            held.append((pdf["var"].iloc[0], int(pdf["sys_hour"].iloc[0]), pdf))
            if len(held) == pack:
                yield pd.DataFrame(solve(held), columns=kind.names)
                held = []
        if held:
            yield pd.DataFrame(solve(held), columns=kind.names)

    n = int(inputs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a number, as the rows are few but each hour takes time: small partitions must not be put together
    return inputs.repartition(n, "var", "sys_hour").sortWithinPartitions("var", "sys_hour", "source_id", "previous").mapInPandas(run, kind)


def fitted(inputs: DataFrame, n_cat: int, strength: str = "medium") -> DataFrame:
    """``inputs(var, sys_hour, source_id, value, parts, imprecision, covar, previous)`` -> one row of factors an hour."""
    exponent, additive = STRENGTH[strength], np.arange(n_cat) == 0

    def solve(held):
        problems, rows = [problem(*columns(pdf, n_cat)) for _, _, pdf in held], []
        for (var, hour, pdf), (_, _, w, _), (factors, cost, state) in zip(held, problems, descent(problems, additive, exponent)):
            applied = w * PENALTY[state]
            rows.append((var, hour, factors.tolist(), cost, pdf["source_id"].tolist(), state.tolist(), (1000 * applied / applied.sum()).tolist()))
        return rows

    return by_hour(inputs, solve, FITTED)


LEFT_OUT = T.StructType([T.StructField("var", T.StringType()), T.StructField("sys_hour", T.LongType()), T.StructField("source_id", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("predicted", T.DoubleType())])


def left_out(inputs: DataFrame, n_cat: int, strength: str = "medium") -> DataFrame:
    """Prediction at each station from a fit without it; the fits of many hours are made at once."""
    exponent, additive = STRENGTH[strength], np.arange(n_cat) == 0

    def solve(held):
        problems, asked = [], []
        for var, hour, pdf in held:
            data, source = columns(pdf, n_cat), pdf["source_id"].to_numpy()
            now = ~data[-1]
            for station in sorted(set(source[now])):
                rest = source != station
                if rest.any():
                    i = int(np.flatnonzero(~rest & now)[0])
                    problems.append(problem(*[x[rest] for x in data]))
                    asked.append((var, hour, station, float(data[0][i]), data[1][i]))
        found = descent(problems, additive, exponent) if problems else []
        return [(*a[:4], float(max(0.0, (a[4][1:] * f[1:]).sum() + a[4][0] + f[0]))) for a, (f, _, _) in zip(asked, found)]

    return by_hour(inputs, solve, LEFT_OUT)


def day_type(sys_hour):
    """0 weekday, 1 Saturday, 2 Sunday (hour 0 of 1970 was a Thursday)."""
    dow = (sys_hour // 24 + 3) % 7
    return 1 if dow == 5 else 2 if dow == 6 else 0


class Learned:
    """Long-term factor of one category and variable: a master and a table of day types by hours."""

    def __init__(self, additive=False, state=None):
        self.additive = additive
        start = 0.0 if additive else 1.0
        self.master, self.table, self.last = start, np.full((3, 24), start), -1
        if state:
            self.master, self.table, self.last = state[0], np.array(state[1], float).reshape(3, 24), state[2]

    def step(self, old, factor, rate):
        new = rate * factor + (1 - rate) * old if self.additive else old * (1 + rate * (factor - 1))
        return new if self.additive else min(HIGH, max(LOW, new))

    def update(self, sys_hour, factor):
        """Learns one hour, in order; an hour is learned once."""
        if sys_hour <= self.last:
            return
        self.last = sys_hour
        self.master = self.step(self.master, factor, RATE * 0.1)
        for near in (0, 1, -1):
            h = sys_hour + near
            kind = day_type(h)
            rate = RATE * (1.5 if kind == 0 else 4.0) * (SPLASH if near else 1.0)
            self.table[kind, h % 24] = self.step(self.table[kind, h % 24], factor, rate)

    def state(self):
        return float(self.master), self.table.ravel().tolist(), int(self.last)


LEARNED = T.StructType([T.StructField("var", T.StringType()), T.StructField("cat", T.LongType()), T.StructField("master", T.DoubleType()), T.StructField("cells", T.ArrayType(T.DoubleType())), T.StructField("last_hour", T.LongType())])


def learned(adjustments: DataFrame) -> DataFrame:
    """``adjustments(var, cat, sys_hour, factor, filled)``: the state after all hours in order; filled hours teach nothing.

    A (variable, category) has one row an hour, which are folded in order as they stream through the task; none is held."""

    def fold(batches):
        key, state = None, None
        for pdf in batches:
            for var, cat, h, f in pdf.itertuples(index=False):
                if (var, cat) != key:
                    if state:
                        yield pd.DataFrame([(*key, *state.state())], columns=LEARNED.names)
                    key, state = (var, cat), Learned(additive=cat == 0)
                state.update(int(h), float(f))
        if state:
            yield pd.DataFrame([(*key, *state.state())], columns=LEARNED.names)

    rows = adjustments.filter("not filled").select("var", "cat", "sys_hour", "factor")
    return rows.repartition("var", "cat").sortWithinPartitions("var", "cat", "sys_hour", "factor").mapInPandas(fold, LEARNED)
