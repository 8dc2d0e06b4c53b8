"""Blocks of queries against streamed chunks."""

import numpy as np
import pyarrow as pa

from mailsift.operators import neighbours, tiles


def points(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id bigint, x array<double>")


def test_a_point_asks_in_one_task_and_meets_each_point_once(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 50)
    x = np.vstack([np.random.default_rng(1).normal(0, 1, (700, 3)), np.full((300, 3), 0.5)])
    x[700:] += np.random.default_rng(2).normal(0, 1e-6, (300, 3))  # a part that fills several blocks
    parts = neighbours.divide(neighbours.merge_copies(points(spark, x)))

    def fold(q):
        met = []

        def step(h):
            met.append(h.pid)
            yield from ()

        def finish():
            all_ = np.concatenate(met)
            yield from tiles.batches_of({
                "pid": pa.array(q.pid), "met": pa.array(np.full(q.size, len(np.unique(all_)))),
                "rows": pa.array(np.full(q.size, len(all_))), "held": pa.array(np.full(q.size, q.size)), "most": pa.array(np.full(q.size, max(map(len, met))))})
        return step, finish

    rows = parts.points.select("pid", "x", "part")
    got = tiles.stream(rows, rows, parts.rows, parts.rows, fold, "pid bigint, met bigint, rows bigint, held bigint, most bigint", 50, 100).toPandas()
    assert sorted(got.pid) == list(range(1000))
    assert set(got.met) == {1000} and set(got["rows"]) == {1000} and got.held.max() < 250 and got.most.max() < 150


def test_nearest_points_leave_their_task_once(spark, monkeypatch):
    """No row for each part that a point asks: 1,000 points in 20 parts of one ball give 1,000 rows."""
    monkeypatch.setattr(neighbours, "BLOCK", 50)
    x = np.random.default_rng(3).normal(0, 1, (1000, 30))
    made, plain = [], neighbours.tiles.stream

    def counted(*args):
        out = plain(*args)
        made.append(out.count())
        return out

    monkeypatch.setattr(neighbours.tiles, "stream", counted)
    got = {r["id"]: r["kdist"] for r in neighbours.k_distances(points(spark, x), 4).collect()}
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    assert np.allclose([got[i] for i in range(1000)], np.sort(d, 1)[:, 3], atol=1e-12) and made == [1000]


def test_nests_lie_together():
    x = np.random.default_rng(4).uniform(0, 1, (2048, 2))
    order = tiles.nested(x)
    assert sorted(order) == list(range(2048))
    assert all(np.prod(np.ptp(x[order][i:i + tiles.NEST], axis=0)) < 0.2 for i in range(0, 2048, tiles.NEST))
    low = tiles.least_apart(x[:5], x[order][:tiles.NEST])
    true = neighbours.distances(x[:5], x[order][:tiles.NEST]).min(axis=1)
    assert (low <= true + 1e-12).all()
    assert len(tiles.nested(x[:3])) == 3
