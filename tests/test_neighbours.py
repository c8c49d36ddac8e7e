"""Neighbour joins against brute force on small vectors, with and without pruning."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from taskloom.operators import clusters as C
from taskloom.operators import similarity as S
from taskloom.operators import blocks
from taskloom.operators.neighbours import Between, Match, linked_components, self_top_k, top_k
from taskloom.operators.ranks import kth_smallest, percentile_linear, with_position, with_total_before

RNG = np.random.default_rng(11)


def _vectors(n, d=8, copies=0):
    """Clustered vectors, a third of them copies of one, and one zero vector."""
    centres = RNG.normal(size=(6, d))
    v = centres[RNG.integers(0, 6, n)] + 0.25 * RNG.normal(size=(n, d))
    if copies:
        v[:copies] = v[0]
    v[-1] = 0.0
    return v


def _cosines(a, b):
    unit = lambda m: m / np.where(np.linalg.norm(m, axis=1, keepdims=True) == 0, 1, np.linalg.norm(m, axis=1, keepdims=True))
    return np.round(unit(a) @ unit(b).T, 12)


def _table(spark, v, prefix="K", extra=None):
    rows = [(f"{prefix}{i:04d}", [float(x) for x in r], *((extra(i),) if extra else ())) for i, r in enumerate(v)]
    schema = "key string, embedding array<double>" + (", tag string" if extra else "")
    return spark.createDataFrame(rows, schema)


def _brute(s, k, threshold, allowed=None):
    out = set()
    for i in range(s.shape[0]):
        c = [
            (-s[i, j], f"K{j:04d}")
            for j in range(s.shape[1])
            if (threshold is None or s[i, j] >= threshold) and (allowed is None or allowed(i, j))
        ]
        out |= {(f"K{i:04d}", key, r) for r, (_, key) in enumerate(sorted(c)[:k], 1)}
    return out


def _got(df):
    return {(r.query_id, r.key, r["rank"]) for r in df.collect()}


@pytest.mark.parametrize("k,threshold,cell", [(5, 0.7, 2048), (4, None, 16), (20, 0.5, 20), (3, 0.9, 5), (6, -0.5, 12)])
def test_top_k_equals_brute_force(spark, k, threshold, cell):
    v = _vectors(90, copies=30)
    t = _table(spark, v)
    got = top_k(t.withColumnRenamed("key", "query_id"), t, k, threshold, cell_rows=cell)
    assert _got(got) == _brute(_cosines(v, v), k, threshold)


@pytest.mark.parametrize("k,threshold,cell", [(5, 0.7, 2048), (3, 0.6, 8), (4, -0.2, 10)])
def test_self_top_k_equals_brute_force(spark, k, threshold, cell):
    """Pairs of blocks are compared once and counted in both directions, copies of a vector included."""
    v = _vectors(90, copies=30)
    got = self_top_k(_table(spark, v), k, threshold, cell_rows=cell).withColumnRenamed("query_key", "query_id")
    assert _got(got) == _brute(_cosines(v, v), k, threshold)


@pytest.mark.parametrize("threshold", [None, 0.6, -0.1])
def test_many_widths(spark, threshold):
    """Vectors of forty widths, which score 0 with each other; one width is several blocks."""
    rng = np.random.default_rng(2)
    rows = [list(rng.normal(size=40) * (np.arange(40) <= i % 40)) [: i % 40 + 1] for i in range(80)]
    rows += [list(rng.normal(size=6) + 3) for _ in range(60)]
    wide = [(f"K{i:04d}", [float(x) for x in r]) for i, r in enumerate(rows)]
    t = spark.createDataFrame(wide, "key string, embedding array<double>")
    s = np.zeros((len(rows),) * 2)
    for i, a in enumerate(rows):
        for j, b in enumerate(rows):
            if len(a) == len(b):
                s[i, j] = round(float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)), 12)
    got = top_k(t.withColumnRenamed("key", "query_id"), t, 5, threshold, cell_rows=20)
    assert _got(got) == _brute(s, 5, threshold)
    tagged = t.withColumn("tag", F.lit("x"))
    got = top_k(tagged.withColumnRenamed("key", "query_id"), tagged, 5, threshold, group="tag", cell_rows=50)
    assert _got(got) == _brute(s, 5, threshold)


def test_bounds_rule_out_most_blocks(spark, caplog):
    """At 0.7 a self-search of 4,000 vectors in clusters compares well under half of the pairs."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 48))
    v = centres[rng.integers(0, 40, 4000)] + 0.35 * rng.normal(size=(4000, 48))
    with caplog.at_level("INFO", logger="taskloom.operators.neighbours"):
        hits = self_top_k(_table(spark, v), 5, 0.7, cell_rows=128).count()
    words = caplog.records[-1].getMessage().split()
    share = int(words[2]) / 4000**2
    print(f"{words[0]} blocks, {share:.3f} of the pairs compared")
    assert hits == 20_000 and int(words[0]) == 125 and share < 0.2


def test_no_bound_is_too_small():
    """Against every vector: what a block holds is never better than its bound, in either metric."""
    v = _vectors(400, d=12)
    for metric in ("cosine", "euclidean"):
        m = blocks.unit_rows(v) if metric == "cosine" else v
        frame = blocks._frame(m[::4], 12, 0, 16)
        at = frame.coordinates(m)
        home = frame.home(at)
        model = blocks.Blocks(metric, {12: frame})
        model.size = np.bincount(home, minlength=16)
        away = model.from_centres(frame, at)[np.arange(400), home]
        model.radius = np.array([away[home == b].max(initial=0) for b in range(16)])
        model.low = np.array([at[home == b].min(axis=0) if (home == b).any() else at[0] for b in range(16)])
        model.high = np.array([at[home == b].max(axis=0) if (home == b).any() else at[0] for b in range(16)])
        score = m @ m.T if metric == "cosine" else np.linalg.norm(m[:, None] - m[None], axis=2)
        for bound in (0.2, 0.7, 0.95):
            can = model.reachable(at, 12, np.full(400, bound))
            near = score >= bound if metric == "cosine" else score <= bound
            assert can[np.arange(400)[:, None], home[None, :]][near].all()


def test_filters_apply_before_the_cut(spark):
    v = _vectors(60)
    t = _table(spark, v, extra=lambda i: "ab"[i % 2])
    q = t.select(F.col("key").alias("query_id"), "embedding", F.when(F.substring("key", 5, 1) != "0", F.array("tag")).alias("wanted"))
    got = top_k(q, t, 4, None, match=[Match("wanted", "tag")], cell_rows=16)
    assert _got(got) == _brute(_cosines(v, v), 4, None, lambda i, j: i % 10 == 0 or i % 2 == j % 2)


def test_range_filter(spark):
    v = _vectors(40)
    n = F.substring("key", 2, 4).cast("double")
    t = _table(spark, v).withColumn("n", n)
    q = t.select(F.col("key").alias("query_id"), "embedding", F.lit(5.0).alias("lo"), F.when(n < 20, 12.0).alias("hi"))
    got = top_k(q, t, 3, None, match=[Between("lo", "hi", "n")])
    assert _got(got) == _brute(_cosines(v, v), 3, None, lambda i, j: j >= 5 and (i >= 20 or j <= 12))


def test_search_inside_groups_splits_a_hot_group(spark):
    v = _vectors(70, copies=20)
    t = _table(spark, v, extra=lambda i: "hot" if i < 50 else f"g{i % 3}")
    q = t.select(F.col("key").alias("query_id"), "embedding", "tag")
    got = top_k(q, t, 6, None, group="tag", cell_rows=8)
    tag = lambda i: "hot" if i < 50 else f"g{i % 3}"
    assert _got(got) == _brute(_cosines(v, v), 6, None, lambda i, j: tag(i) == tag(j))


def test_pairs_are_kept_once_and_named_by_the_smaller_finder(spark):
    v = _vectors(50, copies=15)
    pairs = {(r.original_key, r.similar_key) for r in S.similar_pairs(_table(spark, v), 0.6, 10, cell_rows=12).collect()}
    hits = {(a, b) for a, b, _ in _brute(_cosines(v, v), 10, 0.6) if a != b}
    want = {min((a, b), (b, a)) if (min(a, b), max(a, b)) in hits else (max(a, b), min(a, b)) for a, b in hits}
    assert pairs == want


def _components(near):
    n = len(near)
    root = list(range(n))
    for _ in range(n):
        for i in range(n):
            for j in range(n):
                if near[i, j]:
                    root[i] = root[j] = min(root[i], root[j])
    return root


@pytest.mark.parametrize("metric,eps,cell", [("cosine", 0.05, 2048), ("cosine", 0.08, 9), ("euclidean", 0.6, 9), ("cosine", 0.0, 9)])
def test_density_clusters_equal_brute_force(spark, metric, eps, cell):
    v = _vectors(45, copies=10)
    if metric == "cosine":
        d = np.round(1 - _cosines(v, v), 12)
    else:
        d = np.linalg.norm(v[:, None, :] - v[None, :, :], axis=2)
    same = (v[:, None, :] == v[None, :, :]).all(axis=2)
    near = same if eps == 0 else (d <= eps) | same
    if metric == "cosine":
        near[-1, :] = near[:, -1] = False
    root = _components(near)
    size = {r: root.count(r) for r in root}
    order = sorted(r for r in size if size[r] > 1)
    want = {(f"K{i:04d}", order.index(r)) for i, r in enumerate(root) if size[r] > 1}
    got = C.density_clusters(_table(spark, v), eps, metric, cell_rows=cell)
    assert {(r.key, r.cluster_id) for r in got.collect()} == want


def test_other_min_samples_are_rejected(spark):
    with pytest.raises(ValueError):
        C.density_clusters(_table(spark, _vectors(4)), 0.1, min_samples=3)


def test_connected_components_of_a_chain(spark):
    edges = spark.createDataFrame([(f"n{i:02d}", f"n{i + 1:02d}") for i in range(25)] + [("x", "y")], "a string, b string")
    got = {(r.node, r.root) for r in C.connected_components(edges).collect()}
    assert got == {(f"n{i:02d}", "n00") for i in range(26)} | {("x", "x"), ("y", "x")}


def test_auto_eps_is_the_interpolated_quantile(spark):
    v = _vectors(33, copies=5)
    s = _cosines(v, v)
    nearest = [np.round(1 - max(s[i, j] for j in range(33) if j != i), 12) for i in range(33)]
    assert C.auto_eps(_table(spark, v)).first()[0] == pytest.approx(np.percentile(nearest, 75), abs=1e-9)


def test_order_statistics_and_positions(spark):
    x = [0.5] * 40 + [float(v) for v in RNG.random(61)]
    df = spark.createDataFrame([(i, "hot" if i < 80 else "cold", v) for i, v in enumerate(x)], "i int, g string, x double")
    assert percentile_linear(df, "x", 0.75).first()[0] == pytest.approx(np.percentile(x, 75))
    got = {r.g: r.x for r in kth_smallest(df, ["g"], "x", lambda n: F.floor(n / 5)).collect()}
    assert got == {"hot": sorted(x[:80])[15], "cold": sorted(x[80:])[3]}
    order = {r.i: r.position for r in with_position(df, ["x", "i"]).collect()}
    assert [i for i, _ in sorted(order.items(), key=lambda kv: kv[1])] == sorted(range(101), key=lambda i: (x[i], i))
    before = {r.i: r.spent_before for r in with_total_before(df, ["i"], "x").collect()}
    assert before[100] == pytest.approx(sum(x[:100])) and before[0] == 0


def test_coherence_equals_pairwise_means(spark):
    v = _vectors(30)
    t = _table(spark, v, extra=lambda i: f"E{i % 3}").withColumnRenamed("tag", "epic_key")
    s = _cosines(v, v)
    for r in S.item_coherence(t).collect():
        i = int(r.key[1:])
        others = [s[i, j] for j in range(30) if j % 3 == i % 3 and j != i]
        assert r.mean_similarity == pytest.approx(np.mean(others), abs=1e-9)


def test_epic_coherence_of_one_and_of_equal_items(spark):
    t = spark.createDataFrame(
        [("a", "E1", [1.0, 0.0]), ("b", "E2", [1.0, 0.0]), ("c", "E2", [2.0, 0.0])], "key string, epic_key string, embedding array<double>"
    )
    got = {r.epic_key: r for r in S.epic_coherence(t).collect()}
    assert got["E1"].coherence_score == 1.0 and got["E1"].recommendations == []
    assert got["E2"].coherence_score == pytest.approx(1.0)
    assert got["E2"].recommendations == ["Epic shows good coherence and theme consistency"]


def test_misplaced_keeps_the_first_good_epic(spark):
    """A later candidate must beat the best so far by the margin, not only the current epic."""
    c = lambda a: [float(np.cos(a)), float(np.sin(a))]
    rows = [("x", "E0", c(0.0)), ("o1", "E0", c(2.0)), ("o2", "E0", c(2.0))]
    rows += [(f"a{i}", "EA", c(0.30)) for i in range(2)] + [(f"b{i}", "EB", c(0.31)) for i in range(2)]
    t = spark.createDataFrame(rows, "key string, epic_key string, embedding array<double>")
    got = [r for r in S.misplaced(t, 0.65).collect() if r.work_item_key == "x"]
    assert [(r.current_epic_key, r.suggested_epic_key) for r in got] == [("E0", "EA")]
    assert got[0].confidence_score == pytest.approx(np.cos(0.30), abs=1e-9)
    assert "significantly higher semantic similarity, with Epic EA (high confidence)" in got[0].reasoning


def test_what_tasks_read_and_emit_does_not_grow_with_the_blocks(spark):
    """Ten times the rows have as many tasks to be copied to; a dense table has few edges, however small its cells."""
    from taskloom.operators import neighbours

    assert neighbours._tasks(50_000, 50_000, 64, 2048, 12) == neighbours._tasks(500_000, 500_000, 64, 2048, 12) == (12, 1)
    assert neighbours._tasks(5, 1_000_000, 64, 2048, 12) == (1, 12)
    v = np.random.default_rng(3).normal(size=(300, 8))
    edges = linked_components(_table(spark, v).withColumnRenamed("embedding", "v"), 2.0, "key", cell_rows=4)
    assert edges.count() <= 5 * 300
    assert C.connected_components(edges).select("root").distinct().count() == 1


def test_batches_are_worked_on_in_bounded_slices():
    """Neither a wide batch nor many centres make large temporaries."""
    import pyarrow as pa

    v = np.arange(9000 * 256, dtype=float).reshape(9000, 256)
    batch = pa.RecordBatch.from_arrays([pa.array(list(v), pa.list_(pa.float64()))], names=["v"])
    found = [(w, blocks.matrix(rows.column(0), rows.num_rows, unit=False)) for w, rows in blocks.by_width(batch)]
    assert max(m.nbytes for _, m in found) <= 1 << 21 and (np.concatenate([m for _, m in found]) == v).all()
    cuts = blocks.parts(10_000, 4096)
    assert max((s.stop - s.start) * 4096 for s in cuts) <= 1 << 19 and cuts[-1].stop >= 10_000
