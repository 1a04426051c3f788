"""Property tests: random inputs against brute force."""

import math

import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from cohortlens.operators import clean as C
from cohortlens.operators import distribution as Q
from cohortlens.operators import hypothesis as T

SETTINGS = settings(max_examples=12, deadline=None,
                    suppress_health_check=[HealthCheck.function_scoped_fixture])

values = st.lists(st.one_of(st.integers(0, 30).map(lambda i: i / 2.0),
                            st.floats(-50, 50, allow_nan=False, allow_infinity=False)),
                  min_size=1, max_size=80)


@SETTINGS
@given(vals=values, nb=st.integers(1, 9))
def test_ecdf_brute_force(spark, vals, nb):
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    got = {r.value: (r.n, r.cum, r.total) for r in Q.ecdf(df, "v", n_buckets=nb).collect()}
    for v, (n, cum, total) in got.items():
        assert n == vals.count(v) and cum == sum(1 for x in vals if x <= v) and total == len(vals)
    assert set(got) == set(vals)


@SETTINGS
@given(vals=values, nb=st.integers(1, 6))
def test_quantiles_match_numpy(spark, vals, nb):
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    ps = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    arr = np.array(sorted(vals))
    for method, np_method in (("type7", "linear"), ("type5", "hazen")):
        got = {r.p: r.q for r in Q.quantiles(df, "v", ps, n_buckets=nb, method=method).collect()}
        for p in ps:
            assert math.isclose(got[p], float(np.quantile(arr, p, method=np_method)),
                                rel_tol=1e-9, abs_tol=1e-9)


@SETTINGS
@given(vals=values, probes=st.lists(st.floats(-60, 60, allow_nan=False), min_size=1, max_size=20),
       nb=st.integers(1, 7))
def test_percentile_many_brute_force(spark, vals, probes, nb):
    pop = spark.createDataFrame([(v,) for v in vals], "v double")
    pr = spark.createDataFrame([(i, p) for i, p in enumerate(probes + vals[:3])], "i long, p double")
    n = len(vals)
    for r in Q.percentile_many(pop, "v", pr, "p", n_buckets=nb).collect():
        assert r.percentile == 100.0 * (sum(1 for x in vals if x <= r.p) / n)
        assert r.below == 100.0 * (sum(1 for x in vals if x < r.p) / n)


@SETTINGS
@given(cells=st.lists(st.tuples(st.integers(0, 3), st.integers(0, 4), st.integers(1, 30)),
                      min_size=2, max_size=20))
def test_chi_square_statistic(spark, cells):
    rows = [(a, b) for a, b, k in cells for _ in range(k)]
    df = spark.createDataFrame(rows, "a int, b int")
    r = T.chi_square(df, "a", "b").first()
    la, lb = sorted({a for a, _ in rows}), sorted({b for _, b in rows})
    m = np.zeros((len(la), len(lb)))
    for a, b in rows:
        m[la.index(a), lb.index(b)] += 1
    e = m.sum(1, keepdims=True) * m.sum(0, keepdims=True) / m.sum()
    assert r.dof == (len(la) - 1) * (len(lb) - 1)
    assert math.isclose(r.statistic, float(((m - e) ** 2 / e).sum()), rel_tol=1e-9, abs_tol=1e-9)
    assert 0.0 <= r.p_value <= 1.0


@SETTINGS
@given(rows=st.lists(st.tuples(st.one_of(st.none(), st.floats(0, 100)),
                               st.one_of(st.none(), st.floats(100, 250)),
                               st.one_of(st.none(), st.floats(0, 200))), min_size=1, max_size=40))
def test_valid_and_quarantine_partition(spark, rows):
    df = spark.createDataFrame(rows, "age double, height double, weight double")
    ok, bad = C.valid(df).count(), C.quarantine(df).count()
    want = sum(1 for a, h, w in rows if a is not None and h is not None and w is not None
               and 18 <= a <= 60 and 144 <= h <= 210 and 34 <= w <= 120)
    assert ok == want and ok + bad == len(rows)
