import math

import numpy as np
import pytest

from quarry.operators.quantiles import exact_quantiles

PROBS = (0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0)


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(11)
    g = rng.integers(0, 3, 6000)
    cont = rng.lognormal(0, 2, 6000)
    ties = rng.integers(0, 7, 6000).astype(float)
    rows = [(int(a), float(b), float(c) if i % 97 else float("nan"), None if i % 131 == 0 else int(a))
            for i, (a, b, c) in enumerate(zip(g, cont, ties))]
    df = spark.createDataFrame(rows, "g long, cont double, ties double, gnull long")
    return df, g, cont, ties


def _disc(v, p):
    s = np.sort(v)
    return s[max(1, math.ceil(p * len(s))) - 1]


def test_global_exact(data):
    df, g, cont, ties = data
    ties_ok = np.array([t for i, t in enumerate(ties) if i % 97])
    for interp in (True, False):
        got = {(r.variable, r.p): r.value for r in
               exact_quantiles(df, ["cont", "ties"], PROBS, interp).collect()}
        for name, v in (("cont", cont), ("ties", ties_ok)):
            for p in PROBS:
                want = np.quantile(v, p) if interp else _disc(v, p)
                assert got[(name, p)] == pytest.approx(want, rel=1e-12, abs=1e-12), (name, p, interp)


def test_grouped_with_null_group(data):
    df, g, cont, _ = data
    got = {(r.gnull, r.p): r.value for r in
           exact_quantiles(df, ["cont"], (0.25, 0.5), True, by=["gnull"]).collect()}
    idx = np.arange(len(g))
    for key in (0, 1, 2, None):
        mask = (idx % 131 == 0) if key is None else ((g == key) & (idx % 131 != 0))
        for p in (0.25, 0.5):
            assert got[(key, p)] == pytest.approx(np.quantile(cont[mask], p), rel=1e-12)
