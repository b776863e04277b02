"""Properties of the library: round trips, equal results of different plans, decoders, sources, streams."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vecgrove import types
from vecgrove.functions import signatures, text, vectors
from vecgrove.operators import ann, exact, grouptest, lsh, metrics, pools
from vecgrove.plans import pruned, texts
from vecgrove.sources import matrices
from vecgrove.streaming import append


@given(st.integers(0, 2**20 - 1), st.integers(0, 2**20 - 1))
@settings(max_examples=200, deadline=None)
def test_xor_signatures_decode(i, j):
    words = signatures.xor_words([i, j], 20)
    assert signatures.decode_xor(words[0]) == [i]
    got = signatures.decode_xor(words[0] ^ words[1])
    if i == j:
        assert got == []
    else:
        assert got in ([], sorted([i, j]))
        if any((i ^ j) >> b & 1 for b in signatures.BLOCK_BITS):
            assert got == sorted([i, j])


@given(st.integers(0, 2**18 - 1), st.integers(0, 2**18 - 1))
@settings(max_examples=200, deadline=None)
def test_or_signatures_decode(i, j):
    words = signatures.or_words([i, j], 9)
    assert signatures.decode_or(words[0], []) == [i]
    if i != j:
        assert signatures.decode_or(words[0] | words[1], [i]) == [j]
        assert i not in signatures.decode_or(words[0] | words[1], [])
    assert int(words[0].sum()) == 27


def test_expressions_equal_numpy(spark):
    ids = [0, 1, 127, 128, 8191, 8192, 8320, 131071]
    rows = spark.createDataFrame([(i,) for i in ids], "j long").select(signatures.xor_signature(F.col("j"), 17).alias("x"), signatures.or_signature(F.col("j"), 9).alias("o"), vectors.mix(F.col("j")).alias("m"), vectors.unpack_bits(F.col("j"), 17).alias("b")).collect()
    assert [r.x for r in rows] == signatures.xor_words(ids, 17).tolist()
    assert [r.o for r in rows] == signatures.or_words(ids, 9).tolist()
    assert [r.m for r in rows] == vectors.mix_numpy(np.array(ids, np.int64)).tolist()
    assert [sum(b << k for k, b in enumerate(r.b)) for r in rows] == ids


@pytest.fixture(scope="module")
def sparse(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i), f"d{d}", int(v)) for i in range(150) for d, v in zip(rng.choice(60, 6, replace=False), rng.integers(1, 9, 6))]
    return spark.createDataFrame(rows, "id long, dim string, val long").cache()


def rows_of(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def test_pruned_plans_equal_plain_ones(sparse):
    q = exact.queries_of(sparse.where("id < 30"))
    want = rows_of(exact.linscan(sparse, q, 60), "qid", "id", "score")
    assert want
    for plan in (pruned.threshold(sparse, q, 60, (64, 16, 4)), pruned.double_threshold(sparse, q, 60, 8, 4), pruned.page_threshold(sparse, q, 60, 4, 4)):
        assert rows_of(plan, "qid", "id", "score") == want
    best = rows_of(exact.linscan_topk(sparse, q, 5), "qid", "id", "score", "rank")
    order = sparse.select("id").distinct().withColumn("pos", (F.col("id") * 37) % 150)
    for plan in (pruned.knn(sparse, q, 5, 8), pruned.double_knn(sparse, q, 5, 8, 4), pruned.cascade_knn(sparse, q, 5, (100, 40, 1), (32, 8)), pruned.reordered_knn(sparse, q, 5, order, 8)):
        assert rows_of(plan, "qid", "id", "score", "rank") == best


def test_more_neighbours_than_rows(sparse):
    few = sparse.where("id < 4")
    q = exact.queries_of(few)
    assert rows_of(pruned.cascade_knn(few, q, 50), "qid", "id") == rows_of(exact.linscan(few, q), "qid", "id")


def test_tree_sums(sparse):
    t = pools.tree_sums(sparse, 4)
    assert pools.check_parents(t).isEmpty()
    a, b = sparse.where("id < 70"), sparse.where("id >= 70")
    keys = ["tree", "level", "node", "dim"]
    merged = pools.merge_sums(pools.tree_sums(a, 4), pools.tree_sums(b, 4), keys)
    assert rows_of(merged, *keys, "val") == rows_of(t, *keys, "val")


def test_box_bounds_hold_for_signed_rows(spark):
    rng = np.random.default_rng(2)
    x = spark.createDataFrame([(i, [int(v) for v in rng.integers(-9, 10, 8)]) for i in range(64)], "id long, v array<long>")
    long = x.select("id", F.posexplode("v").alias("dim", "val"))
    q = exact.queries_of(long.where("id < 8"))
    bounds = pruned.box_bounds(long, q, 8)
    scores = exact.linscan(long, q, -(10**9)).withColumn("pool", F.floor(F.col("id") / 8).cast("long"))
    assert scores.join(bounds, ["qid", "pool"]).where("score > bound").isEmpty()


def test_negative_values_are_refused(spark):
    bad = spark.createDataFrame([(0, "a", -1)], "id long, dim string, val long")
    with pytest.raises(Exception, match="non-negative"):
        types.require_non_negative(bad).collect()


def test_dense_joins_and_ties(spark):
    x = spark.createDataFrame([(i, [i % 3, 1]) for i in range(9)], "id long, v array<long>")
    got = rows_of(exact.knn(x, x.where("id = 2"), 4), "rank", "id", "score")
    assert got == [(1, 8, 5), (2, 5, 5), (3, 2, 5), (4, 7, 3)]
    assert exact.knn(x, x.where("false"), 4).count() == 0
    assert exact.threshold(x, x.where("id = 2"), 5).count() == 3


def test_hashes_are_near_for_near_vectors(spark):
    rng = np.random.default_rng(3)
    a = rng.integers(-1000, 1000, 32)
    x = spark.createDataFrame([(0, a.tolist()), (1, (a + rng.integers(-20, 20, 32)).tolist()), (2, (-a).tolist())], "id long, v array<long>")
    t = lsh.tables(lsh.hashes(x, 30, 4, 32))
    n = {r.id: r.n_match for r in lsh.match_counts(t, t.where("id = 0")).collect()}
    assert n[0] == 30 and n[1] > 20 and n.get(2, 0) == 0


def test_decoders_recover_planted_items(spark):
    items = spark.range(200).select("id")
    design = grouptest.Design(90)
    edges = design.edges(items)
    planted = spark.createDataFrame([(q, int(i)) for q in range(6) for i in np.random.default_rng(q).choice(200, 4, replace=False)], "qid long, item long")
    want = set(rows_of(planted, "qid", "item"))
    positive = grouptest.outcomes(planted, edges)
    assert want <= set(rows_of(grouptest.eliminate(edges, positive), "qid", "item"))
    for found in (grouptest.peel(edges, positive), grouptest.recover_omp(edges, positive), grouptest.recover_lsq(edges, positive)):
        got = set(rows_of(found, "qid", "item"))
        assert len(got & want) >= 0.7 * len(want) and len(got - want) <= 6
    assert set(rows_of(grouptest.xor_peel(grouptest.xor_residuals(planted, edges, 8), design), "qid", "item")) == want
    shape = grouptest.saffron_shape(200, 8)
    wide = grouptest.Design(shape["buckets"] // 3 * 3)
    assert set(rows_of(grouptest.or_solve(grouptest.or_outcomes(planted, wide.edges(items), shape["bits"]), wide), "qid", "item")) == want


def test_designs_agree_and_large_ids_stop_the_job(spark):
    ids = [0, 5, 131_072, 2**31 + 3, 2**39 + 7]
    items = spark.createDataFrame([(i,) for i in ids], "id long")
    design = grouptest.Design(90, 3, 11)
    assert rows_of(design.edges(items), "item", "pool") == sorted((i, int(p)) for i, ps in zip(ids, design.homes(ids)) for p in ps)
    found = grouptest.xor_peel(grouptest.xor_residuals(items.selectExpr("1L as qid", "id as item"), design.edges(items), 40), design)
    assert rows_of(found, "item") == [(i,) for i in ids]
    with pytest.raises(Exception, match="more than 20 bits"):
        grouptest.xor_residuals(items.selectExpr("1L as qid", "id as item"), design.edges(items), 20).collect()
    with pytest.raises(Exception, match="invariants"):
        grouptest.spread(design.edges(spark.range(50)), 3, 0).collect()


def test_peeling_to_the_fixpoint_equals_a_plain_version(spark):
    edges, members, positive = grouptest.random_problem(spark, 200, 60, 8)
    homes = {}
    for r in edges.collect():
        homes.setdefault(r.item, set()).add(r.pool)
    pools_ = {r.pool for r in positive.collect()}
    left, want = {i for i, ps in homes.items() if ps <= pools_}, set()
    while True:
        single = {m[0] for p in pools_ for m in [[i for i in left if p in homes[i]]] if len(m) == 1}
        if not single:
            break
        want |= single
        left -= single
        pools_ -= {p for i in single for p in homes[i]}
    assert want and rows_of(grouptest.peel(edges, positive), "item") == sorted((i,) for i in want)


def test_scans_in_several_groups_of_queries(spark):
    rng = np.random.default_rng(4)
    m = rng.integers(0, 9, (60, 4))
    x = spark.createDataFrame([(i, v) for i, v in enumerate(m.tolist())], "id long, v array<long>").repartition(3)
    make = lambda qids, ids, scores: tuple(a[np.nonzero(scores >= 90)[k]] for a, k in ((qids, 1), (ids, 0))) + (scores[scores >= 90],)
    want = sorted((q, i, int(m[q] @ m[i])) for q in range(60) for i in range(60) if m[q] @ m[i] >= 90)
    assert want and rows_of(exact._scan(x, x, make, group_numbers=70), "qid", "id", "score") == want
    best = lambda got: rows_of(got, "qid", "rank", "id", "score")
    assert best(exact.knn_by_tree(x, x, 3, 16)) == best(exact.knn(x, x, 3))
    got = {r.bin: r.n for r in exact.score_histogram(x, x, 100, 10).collect()}
    assert got == {b: n for b in range(10) if (n := int((np.minimum(9, m @ m.T // 10) == b).sum()))}


def test_coded_joins_equal_plain_ones(spark, sparse):
    q = exact.queries_of(sparse.where("id % 10 = 0"))
    assert rows_of(exact.linscan(*exact.coded(sparse, q)), "qid", "id", "score") == rows_of(exact.linscan(sparse, q), "qid", "id", "score")


@pytest.mark.parametrize("least", [1, 6, 30])
def test_selfjoin_leaves_hot_dimensions_out(spark, least):
    rng = np.random.default_rng(least)
    m = (rng.random((50, 12)) < np.linspace(0.95, 0.1, 12)) * rng.integers(1, 5, (50, 12))
    x = spark.createDataFrame([(int(i), f"d{j}", int(m[i, j])) for i, j in zip(*np.nonzero(m))], "id long, dim string, val long")
    want = sorted((a, b, int(m[a] @ m[b])) for a in range(50) for b in range(a + 1, 50) if m[a] @ m[b] >= least)
    assert want and rows_of(exact.selfjoin(x, least), "qid", "id", "score") == want


def test_dual_index_equals_a_plain_version(spark, tmp_path):
    rng = np.random.default_rng(9)
    x = spark.createDataFrame([(i, rng.integers(-9, 9, 8).tolist()) for i in range(60)], "id long, v array<long>")
    design, q = grouptest.Design(6), x.where("id < 3")
    ann.DualIndex(x, design, 4, 8, tables=3, word=2, path=f"{tmp_path}/dual")
    index = ann.DualIndex.load(spark, f"{tmp_path}/dual", 4, 8, tables=3, word=2)
    words = [{r.id: r.hashes for r in lsh.hashes(x, 3, 2, 8, s).collect()} for s in index.seeds]
    near = lambda k, a, b: any(u == w for u, w in zip(words[k][a], words[k][b]))
    sig = signatures.or_words(range(60), 4)
    want = [(a, p, i) for a in range(3) for p in range(6 * 24) for i in range(60) if p // 24 in design.homes([i])[0] and sig[i][p % 24] and near(0, a, i) and near(1, a, i)]
    assert rows_of(index.query(q, spark.range(6 * 24).withColumnRenamed("id", "pool")), "qid", "pool", "id") == sorted(want)


def test_pursuit_equals_a_dense_version():
    rng = np.random.default_rng(8)
    a = (rng.random((15, 30)) < 0.25).astype(float)
    a[0, a.sum(axis=0) == 0] = 1
    y = a[:, 3] + a[:, 8] + a[:, 21]
    rest, chosen = y, []
    while len(chosen) < 5 and np.linalg.norm(rest) > 1e-9:
        gain = np.abs(a.T @ rest)
        gain[chosen] = -1
        chosen.append(int(gain.argmax()))
        rest = y - a[:, chosen] @ np.linalg.pinv(a[:, chosen]) @ y
    pool, item = np.nonzero(a)
    x = grouptest.omp(grouptest.Incidence(item, pool), y, 5)
    assert sorted(np.flatnonzero(x)) == sorted(chosen) and np.allclose(a[:, chosen] @ x[chosen], y - rest)


def test_balanced_pools(spark):
    n = [r["count"] for r in grouptest.balanced(spark.range(300).select("id"), 30).groupBy("pool").count().collect()]
    assert len(n) == 30 and set(n) == {30}


def test_least_squares_is_the_minimum_norm_solution():
    rng = np.random.default_rng(5)
    a = (rng.random((12, 20)) < 0.3).astype(float)
    a[0, a.sum(axis=0) == 0] = 1
    a[a.sum(axis=1) == 0, 0] = 1
    y = rng.random(12)
    pool, item = np.nonzero(a)
    assert np.allclose(grouptest.least_squares(grouptest.Incidence(item, pool), y), np.linalg.pinv(a) @ y, atol=1e-6)


def test_pipelines_return_ranked_rows(spark):
    rng = np.random.default_rng(6)
    x = spark.createDataFrame([(i, rng.integers(-1000, 1000, 16).tolist()) for i in range(120)], "id long, v array<long>")
    h = ann.Hashed(x, x.where("id < 5"), 16, 12, 3)
    for decoder in ("eliminate", "peel", "omp", "lsq"):
        r = ann.by_elimination(h, 60, 3, 10, decoder, rounds=2)
        assert {row.qid for row in r.collect()} == set(range(5))
    assert {row.qid for row in ann.by_xor(h, 300, 7, 3, 8).collect()} == set(range(5))
    assert {row.qid for row in ann.by_bloom_bits(x, x.where("id < 5"), 16, 60, 7, 3, word=8).collect()} == set(range(5))


def test_metrics(spark):
    s = "qid long, id long, score long"
    truth = spark.createDataFrame([(1, 1, 9), (1, 2, 8), (1, 3, 8), (2, 5, 4)], s)
    found = spark.createDataFrame([(1, 1, 9), (1, 4, 8), (3, 1, 1)], s)
    assert rows_of(metrics.verify_knn(found, truth, 3), "qid", "n_good", "recall") == [(1, 2, 0.666667), (2, 0, 0.0)]
    assert rows_of(metrics.verify_sets(found, truth), "qid", "precision", "recall") == [(1, 0.5, 0.333333), (2, 1.0, 0.0), (3, 0.0, 1.0)]
    assert metrics.match_rate(truth, truth).first().rate == 1.0
    assert metrics.weighted_mean(spark.createDataFrame([("a", 1.0, 1), ("a", 4.0, 2)], "k string, t double, n long"), "t", "n", ["k"]).first().t == 3.0


def test_matrix_files_round_trip(spark, tmp_path):
    dense = matrices.random_dense(spark, 20, 5, 0.7)
    matrices.write_npy(dense, f"{tmp_path}/x.npy")
    assert np.load(f"{tmp_path}/x.npy").tolist() == [r.v for r in dense.orderBy("id").collect()]
    assert rows_of(matrices.read_npy(spark, f"{tmp_path}/x.npy"), "id", "v") == rows_of(dense, "id", "v")
    matrices.write_text(dense.coalesce(1), f"{tmp_path}/txt", " ")
    assert sorted(r.v for r in matrices.read_text(spark, f"{tmp_path}/txt", " ").collect()) == sorted(r.v for r in dense.collect())
    sparse = matrices.random_sparse(spark, 15, 40, 4)
    norms = sparse.groupBy("id").agg(F.sum(F.col("val") * F.col("val")).alias("n"), F.count("*").alias("c")).collect()
    assert all(abs(r.n - 1) < 1e-9 and r.c == 4 for r in norms) and len(norms) == 15
    for layout, read in (("sparse", matrices.read_sparse), ("csr", matrices.read_csr)):
        matrices.write_sparse(sparse, f"{tmp_path}/{layout}", 15, 40, layout)
        got = read(spark, f"{tmp_path}/{layout}")
        assert rows_of(got, "id", "dim") == rows_of(sparse, "id", "dim")
        assert max(abs(a[2] - b[2]) for a, b in zip(rows_of(got, "id", "dim", "val"), rows_of(sparse, "id", "dim", "val"))) < 1e-6
    (tmp_path / "t.txt").write_text("2 9 3\n1.5 2 3\n0 4 8\n0 2\n")
    assert rows_of(matrices.read_csr_text(spark, f"{tmp_path}/t.txt"), "id", "dim", "val") == [(0, 0, 1.5), (0, 4, 2.0), (1, 8, 3.0)]
    with pytest.raises(FileNotFoundError):
        matrices.read_npy(spark, f"{tmp_path}/none.npy")


def test_negative_sparse_file_is_an_error(spark, tmp_path):
    bad = spark.createDataFrame([(0, 1, -1.0)], "id long, dim int, val double")
    matrices.write_sparse(bad, f"{tmp_path}/bad", 1, 2)
    with pytest.raises(Exception, match="negative"):
        matrices.read_sparse(spark, f"{tmp_path}/bad").collect()


def test_results_append_and_collate(spark, tmp_path):
    row = spark.createDataFrame([("a", 1.5)], "name string, ms double")
    for _ in range(2):
        matrices.append_results(row, f"{tmp_path}/r")
    assert spark.read.option("header", True).csv(f"{tmp_path}/r").count() == 2
    (tmp_path / "log.out").write_text("time: 3.5 ms\nnoise\nrecall: 0.9\n")
    assert matrices.collate_logs(spark, f"{tmp_path}/log.out", {"ms": r"time: ([0-9.]+)", "recall": r"recall: ([0-9.]+)"}).count() == 2


def test_appended_batches_equal_a_rebuild(spark, tmp_path, sparse):
    index = append.PoolIndex(spark, f"{tmp_path}/index", 3)
    for n, part in enumerate((sparse.where("id < 60"), sparse.where("id >= 60 and id < 61"), sparse.where("id >= 61"))):
        index.append(part, n)
    index.append(sparse.where("id >= 61"), 2)  # a repeated batch
    keys = ["tree", "level", "node", "dim"]
    want = rows_of(pools.tree_sums(sparse, 3), *keys, "val")
    assert rows_of(index.sums(), *keys, "val") == want
    assert rows_of(index.compact(f"{tmp_path}/folded").sums(), *keys, "val") == want


def test_words_keep_their_bits_at_any_size(spark, tmp_path):
    from vecgrove import catalog

    rng = np.random.default_rng(8)
    vectors_ = rng.normal(size=(2500, 64)).astype("float32")  # over 2048 rows
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors_)], "vec_id long, embedding array<float>")
    rows.write.parquet(f"{tmp_path}/embeddings.parquet")
    x = catalog.dense(spark, str(tmp_path))
    t = lsh.tables(lsh.hashes(x, catalog.T, catalog.B, 64)).cache()
    plain = lsh.match_counts(t, t.where("id % 50 = 0"))
    assert rows_of(catalog.QUERIES["hash_match_counts"](spark, str(tmp_path)), "qid", "id", "n_match") == rows_of(plain, "qid", "id", "n_match")
    best = exact.topk(plain.withColumnRenamed("n_match", "score"), catalog.K)
    assert rows_of(catalog.QUERIES["hash_knn"](spark, str(tmp_path)), "qid", "id", "score", "rank") == rows_of(best, "qid", "id", "score", "rank")
    near = lsh.hamming_candidates(t, t.where("id % 50 = 0"), catalog.B, 1, 5)
    h = ann.Hashed(x, catalog.asking(x), 64, catalog.T, catalog.B)
    assert rows_of(lsh.scan_hamming(h.hx, h.hq, 1, 5), "qid", "id", "n_match") == rows_of(near, "qid", "id", "n_match")


def test_scanned_elimination_equals_the_join(spark):
    design, items = grouptest.Design(30), spark.range(400)
    planted = spark.createDataFrame([(q, int(i)) for q in range(8) for i in np.random.default_rng(q).choice(400, 3 + q, replace=False)], "qid long, item long")
    edges = design.edges(items)
    positive = grouptest.outcomes(planted, edges)
    assert rows_of(grouptest.eliminate_scan(items, positive, design), "qid", "item") == rows_of(grouptest.eliminate(edges, positive), "qid", "item")
    want = rows_of(grouptest.peel(edges, positive), "qid", "item")
    assert want and rows_of(grouptest.peel_scan(items, positive, design), "qid", "item") == want


def test_sums_of_many_items_are_no_pair(spark):
    one_pool = spark.createDataFrame([(0, 7, i) for i in (128, 1, 2, 4)] + [(1, 7, 128), (1, 7, 5)] + [(2, 7, i) for i in (1, 2, 4)] + [(3, 7, 9)], "qid long, pool long, item long")
    r = grouptest.fold_signatures(one_pool, 9, held=True)
    assert rows_of(grouptest.decode_pairs(r, 9), "qid", "first", "second") == [(1, 5, 128)]
    assert rows_of(grouptest.decode_singletons(r, 9), "qid", "item") == [(3, 9)]


def test_best_keeps_ties_across_blocks(spark):
    best = exact.Best(np.array([10, 20]), 2)
    best.step(np.array([5, 1, 3]), np.array([[4, 1], [4, 0], [2, 0]]))
    best.step(np.array([9]), np.array([[4, 0]]))
    q, ids, scores = best.end()
    assert list(zip(q.tolist(), ids.tolist(), scores.tolist())) == [(10, 9, 4), (10, 5, 4), (20, 5, 1), (20, 9, 0)]


def test_entry_without_the_optional_package():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_dense_plans_equal_the_joins(spark):
    from vecgrove.plans import dense
    from vecgrove.types import to_array, to_long

    rng = np.random.default_rng(12)
    x = spark.createDataFrame([(i, rng.integers(0, 4, 5).tolist()) for i in range(300)], "id long, v array<long>").repartition(5).cache()
    q = x.where("id % 7 = 0")
    long = to_long(x)
    asks = exact.queries_of(to_long(q))
    for least in (12, 25):
        want = rows_of(exact.linscan(long, asks, least), "qid", "id", "score")
        assert rows_of(dense.threshold(x, q, least, (32, 8)), "qid", "id", "score") == want
        assert rows_of(dense.threshold(x, q, least, (32, 8), 16), "qid", "id", "score") == want
    assert rows_of(dense.candidates(x, q, 100, (32, 8)), "qid", "pool") == rows_of(pruned.candidates(long, asks, 100, (32, 8)), "qid", "pool")
    best = rows_of(exact.linscan_topk(long, asks, 6), "qid", "id", "score", "rank")
    order = x.select("id", ((F.col("id") * 37) % 300).alias("pos"))
    for got in (dense.knn(x, q, 6, 8), dense.reordered_knn(x, q, 6, order, 8), exact.dense_linscan_topk(x, q, 6)):
        assert rows_of(got, "qid", "id", "score", "rank") == best
    every = x.select("id", F.posexplode("v").alias("dim", "val"))
    assert rows_of(dense.box_bounds(x, q, 8), "qid", "pool", "bound") == rows_of(pruned.box_bounds(every, exact.queries_of(every.where("id % 7 = 0")), 8), "qid", "pool", "bound")
    keys = ("of", "tree", "level", "node", "dim", "val")
    assert rows_of(dense.dim_trees(x, 3, 2, 8), *keys) == rows_of(pools.dim_trees(long, 3, 2, 8), *keys)
    assert rows_of(to_array(long.withColumn("pos", F.col("id") + 1), 5, ("id", "pos")), "id", "pos", "v") == sorted((r.id, r.id + 1, r.v) for r in x.where("array_max(v) > 0").collect())


def test_blocks_shrink_with_the_queries(spark):
    x = spark.createDataFrame([(i, [i % 5, 1]) for i in range(2100)], "id long, v array<long>").coalesce(1)
    make = lambda qids, ids, scores: ([scores.size], [len(ids)], [len(qids)])
    sizes = rows_of(exact._scan(x, x, make), "qid", "id", "score")
    assert max(s[0] for s in sizes) <= exact.BLOCK_SCORES and sum(s[1] for s in sizes) == 2100


def test_linear_decoders_solve_each_kind_of_column_once(spark, monkeypatch):
    design, items = grouptest.Design(6), spark.range(300)  # eight kinds of columns
    edges = design.edges(items)
    positive = grouptest.outcomes(spark.createDataFrame([(0, 3), (0, 40), (1, 7)], "qid long, item long"), edges)
    for recover in (grouptest.recover_omp, grouptest.recover_lsq):
        assert rows_of(recover(items, positive, design=design), "qid", "item") == rows_of(recover(edges, positive), "qid", "item")
    item, pool = np.repeat(np.arange(6), 2), np.array([0, 2, 0, 2, 0, 2, 1, 2, 1, 3, 1, 3])
    y = np.ones(4)
    every = grouptest.least_squares(grouptest.Incidence(item, pool), y)
    root = np.sqrt([3, 1, 2])
    kinds = grouptest.least_squares(grouptest.Incidence(np.repeat(np.arange(3), 2), np.array([0, 2, 1, 2, 1, 3]), root), y) / root
    assert np.allclose(kinds[[0, 0, 0, 1, 2, 2]], every)


def test_filters_hold_distinct_keys(spark):
    from vecgrove.operators import bloom

    rng = np.random.default_rng(5)
    x = spark.createDataFrame([(i, rng.integers(-9, 9, 8).tolist()) for i in range(40)], "id long, v array<long>").cache()
    design, length = grouptest.Design(6), 3 * (2 * 6 + 1)
    m, ids = np.array([r.v for r in x.orderBy("id").collect()], float), np.arange(40)
    sig, homes = signatures.xor_words(ids, 6), design.homes(ids)
    for hashes, least in ((2, 2), (3, 2)):
        want = set()
        for p in range(6):
            w = bloom._words(m, p, length, hashes, 3, 7)
            for q in range(0, 40, 9):
                same = (w == w[q]).sum(axis=2) >= least
                want |= {(q, p, k) for k in range(length) if (same[:, k] & (sig[:, k] > 0) & (homes == p).any(axis=1)).any()}
        got = bloom.positive_tests(x, x.where("id % 9 = 0"), design, 8, 6, hashes, 3, least)
        assert want and rows_of(got, "qid", "pool", "pos") == sorted(want)


def test_tree_totals_equal_the_sums_and_move_texts_once(spark):
    from vecgrove.functions import text

    words = ["a", "B", "c9", "d"]
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(rng.choice(words, rng.integers(0, 30)))) for i in range(60)] + [(70, None), (71, ""), (90, "Caf\u00e9 \u212a \u0130 a b c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    t = pools.tree_sums(text.ngram_counts(docs), 3).groupBy("tree", "level", "node").agg(F.count("*").alias("dims"), F.sum("val").alias("total"), F.sum(F.col("val") * F.col("val")).alias("squares"))
    names = ("tree", "level", "node", "dims", "total", "squares")
    got = text.tree_totals(docs, 3)
    assert rows_of(got, *names) == rows_of(t, *names)
    assert rows_of(text.tree_totals(docs, 3, 1), *names) == rows_of(t.where("level <= 1"), *names)
    assert "Generate" not in got._jdf.queryExecution().executedPlan().toString()  # no gram is a row


@pytest.mark.parametrize("group", [1 << 14, 20])
def test_text_plans_equal_the_joins_and_move_no_pairs(spark, monkeypatch, group):
    """Over texts, in one and in several groups of queries; two rows have one id, one has no text."""
    monkeypatch.setattr(texts, "GROUP_QUERIES", group)
    monkeypatch.setattr(texts, "MATCHES", 50)
    rng = np.random.default_rng(5)
    rows = [(int(i) * 3, " ".join(rng.choice(["Ab", "c9", "ab", "d"], rng.integers(0, 40))).replace("d", "d\xe9-")) for i in range(180)]
    docs = spark.createDataFrame([*rows, (9, "ab c9 ab c9 ab"), (1000, None)], "id long, text string")
    q = docs.where("id % 15 = 0 or id = 9")
    x = text.ngram_counts(docs, id_="id").cache()
    asks = exact.queries_of(x.where("id % 15 = 0 or id = 9"))
    pairs = ("qid", "id", "score")
    want = rows_of(exact.linscan(x, asks, 60), *pairs)
    assert want and rows_of(texts.linscan(docs, q), *pairs) == rows_of(exact.linscan(x, asks), *pairs)
    for plan in (texts.linscan(docs, q, 60), texts.threshold(docs, q, 60), texts.page_threshold(docs, q, 60), texts.double_threshold(docs, q, 60, 32, 16)):
        assert rows_of(plan, *pairs) == want
    assert rows_of(texts.dim_threshold(docs, q, 60, 3), *pairs) == rows_of(pruned.dim_threshold(x, asks, 60, 3), *pairs)
    assert rows_of(texts.candidates(docs, q, 400), "qid", "pool") == rows_of(pruned.candidates(x, asks, 400), "qid", "pool")
    best = rows_of(exact.linscan_topk(x, asks, 5), *pairs, "rank")
    for plan in (texts.linscan_topk(docs, q, 5), texts.knn(docs, q, 5), texts.double_knn(docs, q, 5, 32, 16), texts.cascade_knn(docs, q, 5, (100, 40, 1))):
        assert "Join" not in plan._jdf.queryExecution().executedPlan().toString()
        assert rows_of(plan, *pairs, "rank") == best
    dots = ("qid", "n_dots")
    assert rows_of(texts.threshold_dots(docs, q, 400, 4), *dots) == rows_of(pruned.threshold_dots(x, asks, 400, 4), *dots)
    assert rows_of(texts.knn_dots(docs, q, 5, 4), *dots) == rows_of(pruned.knn_dots(x, asks, 5, 4), *dots)
    assert texts.double_dots(docs, q, 400, 4, 2).collect() == pruned.double_dots(x, asks, 400, 4, 2).collect()
    assert rows_of(texts.postings_touched(docs, q), *dots) == rows_of(exact.postings_touched(x, asks), *dots)
    assert rows_of(texts.selfjoin(docs, 150), *pairs) == rows_of(exact.selfjoin(x, 150), *pairs)


@pytest.mark.parametrize("layout", ["sparse", "csr"])
def test_csr_files_are_read_in_pieces_of_whole_rows(spark, tmp_path, monkeypatch, layout):
    """no task gets the file as one record; a row longer than a piece stays whole, rows without entries count."""
    monkeypatch.setattr(matrices, "PART_ENTRIES", 16)
    read = matrices.read_sparse if layout == "sparse" else matrices.read_csr
    rng = np.random.default_rng(9)
    cells = [(i, d, float(rng.integers(1, 9))) for i in (0, 1, 2, 40, 41, 42, 60) for d in range(0, 50 if i == 41 else 7)]
    matrices.write_sparse(spark.createDataFrame(cells, "id long, dim int, val double").repartition(3), f"{tmp_path}/x", layout=layout)
    content = open(f"{tmp_path}/x", "rb").read()
    assert np.frombuffer(content, "<u8" if layout == "sparse" else "<u4", 3).tolist() == [61, 50, len(cells)]  # from the entries
    got = read(spark, f"{tmp_path}/x")
    norm = {i: sum(v * v for j, _, v in cells if j == i) ** 0.5 if layout == "sparse" else 1 for i, _, _ in cells}
    assert rows_of(got, "id", "dim", "val") == [(i, d, pytest.approx(v / norm[i])) for i, d, v in sorted(cells)]
    sizes = [len(open(f.removeprefix("file://"), "rb").read()) for f in got.inputFiles()]
    assert len(sizes) > 4 and sum(x <= 32 + 16 * 16 for x in sizes) == len(sizes) - 1  # all but the long row
    with open(f"{tmp_path}/short", "wb") as f:
        f.write(content[:-4])
    with pytest.raises(ValueError):
        read(spark, f"{tmp_path}/short")
    matrices.write_sparse(got.where("id < 0"), f"{tmp_path}/none", layout=layout)
    assert read(spark, f"{tmp_path}/none").count() == 0


def test_groups_of_queries_share_one_move_of_the_texts(spark, monkeypatch):
    """Several passes read one shuffle; the texts are read once and no second copy of them is kept."""
    monkeypatch.setattr(texts, "GROUP_QUERIES", 8)
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    rows = [(i, "a b c d" if i % 2 else "a b c") for i in range(300)]
    docs = spark.createDataFrame(rows, "id long, text string")
    s = texts.Search(docs.mapInArrow(counted, docs.schema), docs.where("id % 10 = 0"))
    kept = set(spark.sparkContext._jsc.getPersistentRDDs())
    passes = []

    def each(shared):
        passes.append(len(shared.value.qids))
        assert set(spark.sparkContext._jsc.getPersistentRDDs()) <= kept
        return s.scan(shared, lambda blocks, index: ((index.qids, b.scored().sum(axis=0)) for b in blocks), texts.COUNTS)

    got = s.run(each, texts.COUNTS).groupBy("qid").agg(F.sum("n").alias("n")).orderBy("qid").collect()
    assert [tuple(r) for r in got] == [(i, 300) for i in range(0, 300, 10)]
    assert len(passes) > 1 and read.value == len(rows)


def test_maps_of_one_row_compare_without_a_join(spark):
    """the same as the join by n-gram; two rows have one id."""
    docs = spark.createDataFrame([(0, "A b c a b c"), (3, "x y z \xe9 x"), (3, "x y z"), (4, "a b c a b c"), (5, "a b"), (6, None)], "doc_id long, text string")
    x = text.ngram_counts(docs)
    want = rows_of(vectors.compare_sparse(x, x.where("not (id % 3 = 0 and val > 1)")), "id", "equal")
    kept = F.map_filter("m", lambda k, v: ~((F.col("id") % 3 == 0) & (v > 1)))
    got = text.gram_maps(docs).select("id", vectors.equal_maps(F.col("m"), kept).alias("equal"))
    assert rows_of(got, "id", "equal") == want == [(0, False), (3, False), (4, True)]
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()


def test_csr_files_are_written_by_tasks(spark, tmp_path, monkeypatch):
    """The bytes of each layout, from many stretches, without a row of the matrix as a row on the driver."""
    from pyspark.sql import DataFrame

    monkeypatch.setattr(matrices, "PART_ENTRIES", 40)
    monkeypatch.setattr(DataFrame, "toLocalIterator", None)
    rng = np.random.default_rng(3)
    rows = sorted((int(i), int(d), float(v)) for i in range(0, 60, 3) for d, v in zip(rng.choice(900, 11, replace=False), rng.integers(1, 300, 11)))
    x = spark.createDataFrame(rows, "id long, dim long, val double").repartition(5)
    starts = np.searchsorted([r[0] for r in rows], np.arange(63))
    dims, vals = np.array([r[1] for r in rows], "<u4").tobytes(), np.array([r[2] for r in rows], "<f4").tobytes()
    matrices.write_sparse(x, f"{tmp_path}/a", 62, 900)
    assert (tmp_path / "a").read_bytes() == np.array([62, 900, len(rows)], "<u8").tobytes() + starts.astype("<u8").tobytes() + dims + vals
    matrices.write_sparse(x, f"{tmp_path}/b", 62, 900, "csr")
    assert (tmp_path / "b").read_bytes() == np.array([62, 900, len(rows)], "<u4").tobytes() + vals + dims + starts.astype("<u8").tobytes()
    matrices.write_csr_text(x, f"{tmp_path}/c", 62, 900)
    text_ = [f"62 900 {len(rows)}", " ".join(repr(r[2]) for r in rows), " ".join(str(r[1]) for r in rows), " ".join(map(str, starts[:-1])), ""]
    assert (tmp_path / "c").read_text().split("\n") == text_
    matrices.write_sparse(x.where("id < 0"), f"{tmp_path}/none", 2, 900)
    assert matrices.read_sparse(spark, f"{tmp_path}/none").count() == 0
