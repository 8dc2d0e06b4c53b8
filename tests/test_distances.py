"""Distance joins, density clustering and components against brute force, with tiny blocks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from mailsift.operators import cftree, cluster_metrics, clustering, components, neighbours, prep


@pytest.fixture(autouse=True)
def small_blocks(monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 40)


def cloud(hot=70):
    """Two blobs, a line, scattered points, and one point repeated ``hot`` times (a third of all)."""
    rng = np.random.default_rng(5)
    x = np.vstack([
        rng.normal(0, 0.3, (60, 3)), rng.normal(3, 0.3, (50, 3)),
        np.c_[np.linspace(6, 9, 20), np.zeros(20), np.zeros(20)], rng.uniform(-8, 8, (15, 3)),
        np.tile([[0.1, 0.1, 0.1]], (hot, 1))])
    return x[rng.permutation(len(x))]


@pytest.fixture(scope="module")
def data(spark):
    x = cloud()
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id bigint, x array<double>")
    return x, np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)), df


def brute_dbscan(d, eps, m):
    near = d <= eps
    core = near.sum(1) >= m
    out = np.full(len(d), -1)
    label = 0
    for i in range(len(d)):
        if out[i] >= 0 or not core[i]:
            continue
        stack, out[i] = [i], label
        while stack:
            p = stack.pop()
            if core[p]:
                for q in np.nonzero(near[p] & (out < 0))[0]:
                    out[q] = label
                    stack.append(q)
        label += 1
    return out


def test_counts(data):
    _, d, df = data
    got = {r["id"]: r["n_neighbours"] for r in clustering.neighbour_table(df, 0.5, 4).collect()}
    assert [got[i] for i in range(len(d))] == list((d <= 0.5).sum(1))


@pytest.mark.parametrize("k", [1, 5, 100])
def test_k_distance(data, k):
    _, d, df = data
    got = {r["id"]: r["kdist"] for r in neighbours.k_distances(df, k).collect()}
    assert np.allclose([got[i] for i in range(len(d))], np.sort(d, 1)[:, k - 1], atol=1e-12)


def test_hashed_neighbours_reach_nine_in_ten(spark, data, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 2048)
    rng = np.random.default_rng(1)
    x = np.vstack([rng.normal(c, 1, (800, 6)) for c in (0, 4, 8)])
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id bigint, x array<double>")
    work = spark.sparkContext.accumulator(0)
    r = neighbours.recall(neighbours.nearest(df, 10), neighbours.hashed_nearest(df, 10, work=work)).head()
    assert r["n"] == len(x) and r["recall"] >= 0.9 and 0 < work.value < 0.4 * len(x) ** 2
    # Copies count as neighbours, and what is found has its exact distance.
    _, d, df = data
    got = neighbours.hashed_nearest(df, 5, with_self=False, tables=20).collect()
    far = np.sort(d + np.where(np.eye(len(d)), np.inf, 0), 1)[:, :5]
    for row in got:
        assert all(abs(d[row["id"], n["id"]] - n["dist"]) < 1e-12 for n in row["near"])
    assert np.mean([abs(n["dist"] - far[row["id"], i]) < 1e-9 for row in got for i, n in enumerate(row["near"])]) > 0.9
    assert neighbours.hashed_nearest(df.limit(0), 3).collect() == []


def test_nearest_without_self(data):
    _, d, df = data
    e = d + np.where(np.eye(len(d)), np.inf, 0)
    got = {r["id"]: [n["dist"] for n in r["near"]] for r in neighbours.nearest(df, 5, with_self=False).collect()}
    assert np.allclose([got[i] for i in range(len(d))], np.sort(e, 1)[:, :5], atol=1e-12)


@pytest.mark.parametrize("eps,m", [(0.2, 3), (0.5, 5), (1.0, 12)])
def test_dbscan(data, eps, m):
    _, d, df = data
    got = {r["id"]: r["cluster"] for r in clustering.dbscan(df, eps, m).collect()}
    assert [got[i] for i in range(len(d))] == list(brute_dbscan(d, eps, m))


def test_dbscan_on_many_clouds(spark):
    """Chains of cells, bridges of single points, gaps about as wide as the radius, one to four dimensions."""
    rng = np.random.default_rng(11)
    for d, eps, m in [(2, 0.5, 6), (4, 0.9, 5)]:
        x = np.vstack([rng.normal(c, 0.35, (60, d)) for c in (0, 1.6, 4)] + [rng.uniform(-1, 5, (30, d)), np.round(rng.uniform(0, 2, (60, d)), 1)])
        dist = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
        df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id bigint, x array<double>")
        got = {r["id"]: r["cluster"] for r in clustering.dbscan(df, eps, m).collect()}
        assert [got[i] for i in range(len(x))] == list(brute_dbscan(dist, eps, m)), (d, eps, m)


def test_dense_cells_cost_no_distances(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 2048)
    rng = np.random.default_rng(2)
    x = np.vstack([rng.normal(0, 0.4, (5000, 2)), rng.uniform(-6, 6, (300, 2))])
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id bigint, x array<double>")
    work = spark.sparkContext.accumulator(0)
    got = {r["id"]: r["cluster"] for r in clustering.dbscan(df, 0.5, 10, work).collect()}
    dist = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    assert [got[i] for i in range(len(x))] == list(brute_dbscan(dist, 0.5, 10))
    pairs = int((dist <= 0.5).sum())
    assert 0 < work.value < 0.1 * pairs, (work.value, pairs)


def test_dbscan_of_nothing_and_of_one_place(spark):
    none = spark.createDataFrame([], "id bigint, x array<double>")
    assert clustering.dbscan(none, 0.5, 3).collect() == []
    one = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)], "id bigint, x array<double>")
    assert [r["cluster"] for r in clustering.dbscan(one, 0.5, 5).collect()] == [0] * 5
    assert [r["cluster"] for r in clustering.dbscan(one, 0.5, 6).collect()] == [-1] * 5


def test_silhouettes(data, spark):
    x, d, df = data
    labels = np.arange(len(x)) % 3
    labelled = df.withColumn("cluster", (F.col("id") % 3).cast("int"))
    def brute(dist):
        s = []
        for i in range(len(x)):
            own = labels == labels[i]
            a = dist[i][own].sum() / (own.sum() - 1)
            b = min(dist[i][labels == c].mean() for c in range(3) if c != labels[i])
            s.append((b - a) / max(a, b))
        return np.mean(s)
    assert abs(cluster_metrics.silhouette(labelled).head()[0] - brute(d)) < 1e-9
    assert abs(cluster_metrics.silhouette_squared(labelled).head()[0] - brute(d ** 2)) < 1e-9


def test_sampled_silhouette_is_within_its_error(data):
    _, _, df = data
    labelled = df.withColumn("cluster", (F.col("x")[0] > 1.5).cast("int"))
    exact = cluster_metrics.silhouette(labelled).head()[0]
    some = cluster_metrics.silhouette_sampled(labelled, 60, 10).head()
    assert 30 < some["n"] < 110 and 0 < some["error"] < 0.1 and abs(some["silhouette"] - exact) < 3.5 * some["error"]
    whole = cluster_metrics.silhouette_sampled(labelled, 10_000).head()
    assert abs(whole["silhouette"] - exact) < 1e-9 and whole["error"] == 0 and whole["n"] == df.count()


def test_components(spark):
    rng = np.random.default_rng(1)
    chain = [(i, i + 1) for i in range(100, 160)]
    hub = [(500, 500 + i) for i in range(1, 50)]
    loose = [(int(a), int(b)) for a, b in rng.integers(1000, 1060, (40, 2))]
    edges = chain + hub + loose
    parent = {}
    def find(v):
        parent.setdefault(v, v)
        while parent[v] != v:
            v = parent[v]
        return v
    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    got = {r["id"]: r["component"] for r in components.connected_components(
        spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {v: find(v) for v in parent}


def test_ward_on_distinct_points(data):
    x, _, df = data
    got = {r["id"]: r["cluster"] for r in clustering.ward(df, 4, micro=None).collect()}
    uniq, first, inv = np.unique(x, axis=0, return_index=True, return_inverse=True)
    n = np.bincount(inv.ravel())
    want = clustering.ward_merge(n, uniq, 4)[inv.ravel()]
    pairs = {(got[i], want[i]) for i in range(len(x))}
    assert len(pairs) == 4


def test_synthetic_rows(spark, data):
    x, _, df = data
    rows = df.select(F.col("id").alias("email_id"), "x", (F.col("id") < 30).cast("int").alias("label"))
    out = prep.balance_by_synthesis(rows, "x").toPandas()
    assert (out.label == 0).sum() == (out.label == 1).sum()
    minority = x[:30]
    for p in np.stack(out[out.synthetic].x)[:40]:
        # on a segment between two rows of the class
        a, b = minority[:, None], minority[None]
        ab = b - a
        t = np.clip(((p - a) * ab).sum(-1) / np.maximum((ab ** 2).sum(-1), 1e-300), 0, 1)
        assert np.sqrt((((a + t[..., None] * ab) - p) ** 2).sum(-1)).min() < 1e-9


def same_groups(got, want):
    pairs = set(zip(got, want))
    return len(pairs) == len(set(got)) == len(set(want))


def test_spectral_recovers_rings_and_blobs(spark):
    rng = np.random.default_rng(0)
    t = rng.uniform(0, 2 * np.pi, 240)
    r = np.r_[np.full(90, 1.0), np.full(150, 3.0)] + rng.normal(0, 0.05, 240)
    rings = np.c_[r * np.cos(t), r * np.sin(t)]
    blobs = np.vstack([rng.normal(c, 0.5, (50, 2)) for c in ((0, 0), (4, 0), (0, 4))] + [np.tile([[4.0, 0.0]], (60, 1))])
    for x, k, want in [(rings, 2, [0] * 90 + [1] * 150), (blobs, 3, [0] * 50 + [1] * 50 + [2] * 50 + [1] * 60)]:
        df = spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(x)], "id bigint, x array<double>")
        got = {q["id"]: q["cluster"] for q in clustering.spectral(df, k).collect()}
        assert same_groups([got[i] for i in range(len(x))], want)


def test_eigenvectors_as_numpy(spark):
    rng = np.random.default_rng(4)
    edges = {(int(a), int(b)): float(w) for a, b, w in zip(rng.integers(0, 60, 300), rng.integers(0, 60, 300), rng.uniform(0.1, 2, 300)) if a < b}
    w = np.zeros((60, 60))
    for (a, b), v in edges.items():
        w[a, b] = w[b, a] = v
    here = np.flatnonzero(w.sum(1))
    w = w[np.ix_(here, here)]
    want = np.sort(np.linalg.eigvalsh(w / np.sqrt(np.outer(w.sum(1), w.sum(1)))))[::-1][:3]
    df = spark.createDataFrame([(a, b, v) for (a, b), v in edges.items()], "src bigint, dst bigint, weight double")
    _, values, residuals = clustering.eigenvectors(df, 3)
    assert np.allclose(values, want, atol=1e-6) and max(residuals) < 1e-3


def test_feature_trees(data, spark):
    x, _, df = data
    for threshold, entries in [(0.0, 30), (0.3, 500), (0.0, 1000)]:
        for order in (df, df.withColumn("id", -F.col("id"))):
            rows = cftree.cf_leaves(order, threshold, entries).collect()
            n, mean = np.array([r["n"] for r in rows]), np.array([r["centre"] for r in rows])
            radius, limit = np.array([r["radius"] for r in rows]), max(r["threshold"] for r in rows)
            assert len(rows) <= entries and n.sum() == len(x) and (radius <= limit + 1e-9).all() and limit >= threshold
            assert np.allclose(n @ mean, x.sum(0))
            squares = (n * radius ** 2).sum() + (n * (mean ** 2).sum(1)).sum()
            assert abs(squares - (x ** 2).sum()) < 1e-6
    assert len(rows) == len(np.unique(x, axis=0))  # room for all: every distinct point is a leaf


def test_a_tree_stays_balanced():
    rng = np.random.default_rng(1)
    tree = cftree.Tree(2, 0.01)
    x = rng.uniform(0, 1, (4000, 2))
    for p in x[np.argsort(x[:, 0])]:
        tree.insert(1.0, p)
    depths = set()

    def walk(node, depth):
        if node.kids is None:
            depths.add(depth)
        for kid in node.kids or []:
            walk(kid, depth + 1)
    walk(tree.root, 0)
    assert len(depths) == 1 and tree.entries == len(tree.leaves()) > 100
    wide = tree.wider()
    assert wide.threshold > tree.threshold and wide.entries < tree.entries and sum(e[0] for e in wide.leaves()) == 4000


def test_birch_entries(data):
    x, _, df = data
    placed, table = clustering.cf_rows(df, 0.5)
    where = {r["id"]: r["micro"] for r in placed.collect()}
    rows = {r["micro"]: r for r in table.collect()}
    assert set(where.values()) == set(rows) and sum(r["n"] for r in rows.values()) == len(x)
    for i, cell in where.items():
        r = rows[cell]
        assert r["radius"] <= 1.0 + 1e-9 and np.linalg.norm(x[i] - np.array(r["centre"])) <= 1.0 + 1e-9
    got = {r["id"]: r["cluster"] for r in clustering.birch(df, 4, entries=60).collect()}
    assert len(got) == len(x) and len(set(got.values())) == 4


def test_spectral_on_one_point(spark):
    df = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(20)], "id bigint, x array<double>")
    assert {r["cluster"] for r in clustering.spectral(df, 3).collect()} == {0}


def test_hub_and_copies(spark):
    """Nine rows in ten are copies of one point; a star joins all nodes to one."""
    df = spark.createDataFrame([(i, [0.0, 0.0] if i % 10 else [float(i), 1.0]) for i in range(2000)], "id bigint, x array<double>")
    got = clustering.neighbour_table(df, 0.5, 3).collect()
    assert sorted(r["n_neighbours"] for r in got) == [1] * 200 + [1800] * 1800
    star = spark.range(1, 3000).selectExpr("id AS a", "0L AS b")
    rows = components.connected_components(star)
    assert rows.count() == 3000 and rows.where("component <> 0").count() == 0


def test_spectral_with_points_far_from_all_others(spark):
    blob = np.random.default_rng(3).normal(0, 0.1, (14, 2))
    x = np.vstack([blob, [[1000.0, 0.0], [1000.0, 50.0]]])
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id bigint, x array<double>")
    _, edges = clustering.affinity_edges(df)
    values = {(r["src"], r["dst"]): r["a"] for r in clustering.normalised(edges).collect()}
    assert 0 < values[14, 15] <= 1 and all(0 <= v <= 1 + 1e-9 for v in values.values())


def test_products_settle_pairs_as_differences_do():
    rng = np.random.default_rng(8)
    spread = np.vstack([rng.normal(1e6, 1, (40, 5)), rng.integers(0, 3, (60, 5)).astype(float), rng.normal(0, 1e-7, (30, 5))])
    wide = rng.normal(0, 1, (300, 64))
    for a, b in ((spread, spread[::-1]), (wide, wide), (wide[:7], wide[:3]), (np.array([[np.inf] * 5, [np.nan] * 5]), spread)):
        d = neighbours.distances(a, b)
        for eps in (0.0, 1.0, float(np.sqrt(2)), 11.0):
            assert (neighbours.within(a, b, eps) == (d <= eps)).all()
        ids = rng.permutation(len(b))
        by_id = np.argsort(ids)
        for k in (1, 3, 10):
            best, got = neighbours.closest(a, b, ids, min(k, len(b)))
            want = by_id[np.argsort(d[:, by_id], axis=1, kind="stable")[:, :k]]
            assert (best == want).all() and np.array_equal(got, np.take_along_axis(d, want, axis=1), equal_nan=True)
        assert np.allclose(neighbours.far_distances(a, b), d, rtol=1e-9, atol=0, equal_nan=True)
