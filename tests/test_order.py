"""Places, exact quantiles and the unbroken history against plain versions, with buckets much smaller than the tables."""

import datetime as dt
import random

import numpy as np
import pytest

from quern.operators import monitor, order


def test_places(spark):
    r = random.Random(1)
    rows = [(r.choice([None, "a", "b"]), r.choice([None, 1, 2, 2, 2, 3]), k) for k in range(500)]
    df = spark.createDataFrame(rows, "g string, v int, id int").repartition(5)
    out = order.numbered(df, ["v", "id"], ("g",)).collect()
    for g in (None, "a", "b"):
        own = sorted((x for x in rows if x[0] == g), key=lambda x: (x[1] is not None, x[1] or 0, x[2]))
        assert [(x.v, x.id) for x in sorted((x for x in out if x.g == g), key=lambda x: x.i)] == [x[1:] for x in own]
        assert all(x._n == len(own) for x in out if x.g == g) and sorted(x.i for x in out if x.g == g) == list(range(len(own)))


@pytest.mark.parametrize("n", [1, 2, 999])
def test_quantiles(spark, n):
    r = random.Random(n)
    rows = [(k % 3 if k % 7 else None, r.choice([None, 5.0, 5.0, 5.0, r.gauss(0, 9)])) for k in range(n)]
    df = spark.createDataFrame(rows, "g int, v double").repartition(4)
    ps = (0.0, 0.25, 0.5, 0.99, 1.0)
    got = {x.g: x.q for x in order.exact_quantiles(df, "v", ps, ("g",)).collect()}
    want = {}
    for g in {x[0] for x in rows}:
        own = [x[1] for x in rows if x[0] == g and x[1] is not None]
        if own:
            want[g] = np.quantile(own, ps)
    assert got.keys() == want.keys() and all(np.allclose(got[g], want[g]) for g in want)
    whole = order.exact_quantiles(df, "v", ps).collect()
    own = [x[1] for x in rows if x[1] is not None]
    assert len(whole) == bool(own) and (not own or np.allclose(whole[0].q, np.quantile(own, ps)))


@pytest.mark.parametrize(("bucket_rows", "bucket_seconds"), [(20_000, 21_600), (1, 1)])
def test_history(spark, bucket_rows, bucket_seconds):
    r = random.Random(3)
    start, rows, at = dt.datetime(2024, 1, 1), [], 0
    for k in range(700):
        at += r.choice([0, 0, 1, 60, 200, 4000 if k % 50 == 0 else 30])
        rows.append((k, start + dt.timedelta(seconds=at), 0.9 - 0.6 * (300 < k < 400) + r.gauss(0, 0.05)))
    df = spark.createDataFrame([*rows, (999, None, 0.1)], "id long, ts timestamp, overall double").repartition(4)
    got = {x.id: x for x in monitor.degradation(df, rows=20, bucket_rows=bucket_rows, bucket_seconds=bucket_seconds).collect()}
    assert got.keys() == {x[0] for x in rows} and any(x.degraded for x in got.values())
    for k, (i, ts, _) in enumerate(rows):
        near = [x[2] for x in rows if 0 <= (ts - x[1]).total_seconds() <= 1800]
        last = [x[2] for x in rows[max(0, k - 19) : k + 1]]
        x = got[i]
        assert (x.seen, x.n) == (k + 1, len(near)) and abs(x.recent - np.mean(near)) < 1e-9 and abs(x.base - np.mean(last)) < 1e-9
        assert x.degraded == (len(near) >= 5 and k + 1 > 20 and round(np.mean(near) - np.mean(last), 6) < -0.15)
