import numpy as np
import pytest

from airloom.operators import fusion as f
from airloom.operators import temporal as t
from airloom.plans import fusion_queries, statistics_queries as s

SF = "/root/testdata/sf0.001"


def test_statistics_of_the_fit(spark):
    fit = {(r["var"], r.sys_hour): r.factors for r in fusion_queries.x34(spark, SF).collect()}
    got = {(r["var"], r.sys_hour): [r.c0, r.c1, r.c2, r.c3] for r in s.k6_fitted(spark, SF).collect()}
    assert set(got) == set(fit) and all(got[k] == pytest.approx(fit[k], abs=1e-4) for k in fit)
    weeks = {}
    for (var, hour), factors in fit.items():
        for k, x in enumerate(factors):
            weeks.setdefault((var, k, hour // 168), []).append(x)
    got = {(r["var"], r.cat, r.week): (r.mean, r.n) for r in s.k13_fitted(spark, SF).collect()}
    assert set(got) == set(weeks) and all(got[k] == (pytest.approx(np.mean(v), abs=1e-4), len(v)) for k, v in weeks.items())
    got = {(r["var"], r.cat, r.slot): (r.master, r.cell, r.last_hour) for r in s.x38_fitted(spark, SF).collect()}
    series = {}
    for (var, hour), factors in sorted(fit.items()):
        for k, x in enumerate(factors):
            series.setdefault((var, k), []).append((hour, x))
    for (var, k), rows in series.items():
        state = f.Learned(additive=k == 0)
        for hour, x in rows:
            state.update(hour, x)
        for slot, cell in enumerate(state.table.ravel()):
            assert got[var, k, slot] == (pytest.approx(state.master, abs=1e-5), pytest.approx(cell, abs=1e-5), rows[-1][0])
    got = {(r["var"], r.cat, r.sys_hour): r.value for r in s.x39_fitted(spark, SF).filter("filled").collect()}
    for (var, k), rows in series.items():
        late = [x for x in rows if x[0] > rows[-1][0] - 72]
        for hour, value in t.forecast([x for _, x in late], [h for h, _ in late], 24):
            assert got[var, k, hour] == pytest.approx(value, abs=1e-5)
