import json

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from nearvote import schema as S
from nearvote.operators import ivf, knn, search, validate
from nearvote.plans import suite
from nearvote.sources import readers
from nearvote.streaming import score

SF = "/root/testdata/sf0.001"


def brute(q, r, ids, k):
    d = ((q[None, :].astype(np.int64) - r.astype(np.int64)) ** 2).sum(1)
    return sorted(zip(d.tolist(), ids))[:k]


def frame(spark, data, labels=None, first=0):
    rows = [(first + k, int(labels[k]) if labels is not None else 0, *[float(x) / S.SCALE for x in v], *map(int, v)) for k, v in enumerate(data)]
    return spark.createDataFrame(rows, "orig_id bigint, label tinyint, " + ", ".join(f"{c} float" for c in S.V) + ", " + ", ".join(f"{c} smallint" for c in S.Q))


def answers(df):
    return {r.qid: (r.votes, r.d5) for r in df.select("qid", "votes", "d5").collect()}


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 9), st.integers(1, 40), st.integers(0, 2**32 - 1))
def test_kernel_takes_least_by_distance_then_id(nq, nr, seed):
    rng = np.random.default_rng(seed)
    q, r = (rng.integers(-3, 4, (n, 4)).astype(np.int16) * 3333 for n in (nq, nr))
    place, dist = knn.least(q, r, 5)
    for k in range(nq):
        assert list(zip(dist[k].tolist(), place[k].tolist())) == brute(q[k], r, range(nr), 5)


@settings(max_examples=30, deadline=None)
@given(st.integers(1, 6), st.integers(knn.FIRST_ROWS - 3, knn.FIRST_ROWS + 2 * knn.NEXT_ROWS + 3), st.sampled_from([1, 5, 600]), st.booleans(), st.integers(0, 2**32 - 1))
def test_kernel_abandons_only_what_is_beyond_the_worst(nq, nr, k, nearer, seed):
    """More references than are ranked at first, many of them tied, or each nearer than those before it."""
    rng = np.random.default_rng(seed)
    q, r = (rng.integers(-3, 4, (n, 4)).astype(np.int16) * 3333 for n in (nq, nr))
    if nearer:
        r = np.sort(r, axis=0)[::-1]
    place, dist = knn.least(q, r, k)
    for i in range(nq):
        assert list(zip(dist[i].tolist(), place[i].tolist())) == brute(q[i], r, range(nr), k)


def test_leaves_beyond_the_worst_are_not_read():
    """The whole answer from a small part of the references; equal rows are kept k times only, queries with a bound give
    what is within it."""
    rng = np.random.default_rng(6)
    r = np.concatenate([rng.integers(-9999, 9999, (20_000, 3)), np.full((20_000, 3), 77)]).astype(np.int16)
    q = np.concatenate([r[:40], r[-40:], rng.integers(-9999, 9999, (40, 3)).astype(np.int16)])
    leaves, seen = knn.Leaves(r, 5), []

    class Spy(list):
        def __getitem__(self, k):
            seen.append(k)
            return super().__getitem__(k)

    assert (leaves.place < len(r)).sum() <= 20_005
    leaves.back = Spy(leaves.back)
    row, place, dist = leaves.search(q)
    assert len(set(seen)) < len(leaves.back) and list(row) == sorted([*range(len(q))] * 5)
    exact = [brute(x, r, range(len(r)), 5) for x in q]
    for i in range(len(q)):
        assert list(zip(dist[row == i].tolist(), place[row == i].tolist())) == exact[i]
    worst = np.array([x[2][0] for x in exact], np.float64)
    seen.clear()
    row, place, dist = leaves.search(q[:1], worst[:1])
    assert len(seen) < len(leaves.back) // 4
    row, place, dist = leaves.search(q, worst)
    for i in range(len(q)):
        assert sorted(zip(dist[row == i].tolist(), place[row == i].tolist())) == [x for x in exact[i] if x[0] <= worst[i]]


def test_flat_over_many_cells(spark, monkeypatch):
    """More cells than queries need, some without a reference or with less than five, many equal rows."""
    rng = np.random.default_rng(9)
    data = np.concatenate([rng.integers(-9999, 9999, (250, 14)), np.full((150, 14), 40)]).astype(np.int16)
    refs = frame(spark, data, rng.integers(0, 2, len(data)))
    asked = np.concatenate([data[::9], rng.integers(-9999, 9999, (30, 14)).astype(np.int16)])
    queries = frame(spark, asked).withColumnRenamed("orig_id", "qid")
    monkeypatch.setattr(knn, "CELL_ROWS", 6)
    got = {}
    for r in knn.flat(queries, refs, S.Q).collect():
        got.setdefault(r.qid, []).append((r.rank, r.dist, r.orig_id))
    assert {k: [(d, i) for _, d, i in sorted(x)] for k, x in got.items()} == {k: brute(x, data, range(len(data)), 5) for k, x in enumerate(asked)}
    far = refs.filter("orig_id >= 248")  # a fitted sample of few values
    votes = search.flat_search(queries, far).collect()
    assert len(votes) == len(asked) and {r.d5 for r in votes} == {brute(x, data[248:], range(152), 5)[4][0] for x in asked}
    assert {r.votes for r in search.flat_search(queries, refs.limit(0)).collect()} == {0}


def test_lists_of_many_queries_are_split(spark, monkeypatch):
    """Queries of a list over several tasks, and a bound on what is wanted."""
    rng = np.random.default_rng(10)
    data = rng.integers(0, 30, (300, 14))
    refs = frame(spark, data, rng.integers(0, 2, 300))
    index = ivf.build(refs, 2)
    queries = refs.withColumnRenamed("orig_id", "qid")
    monkeypatch.setattr(knn, "CHUNK_ROWS", 20)
    monkeypatch.setattr(knn, "REF_ROWS", 16)
    exact = {k: brute(x, data, range(300), 5) for k, x in enumerate(data)}
    assert {k: d for k, (_, d) in answers(search.probe(queries, index, 1, True)).items()} == {k: x[4][0] for k, x in exact.items()}
    near = search.probes(queries.select("qid", *S.Q), index, 2).withColumn("worst", F.col("qid") % 2 * 2000)
    got = {(r.qid, r.dist, r.orig_id) for r in knn.search_lists(near, index.refs, index.centroids, S.Q, 5).collect()}
    assert got == {(k, d, i) for k, x in exact.items() for d, i in x if d <= k % 2 * 2000}


def test_queries_of_a_list_are_searched_together(spark, monkeypatch):
    """Many blocks of one key in one search, at most ``CHUNK_ROWS`` and a block; the next key by itself."""
    import pyarrow as pa

    rng = np.random.default_rng(13)
    data, calls, search_leaves = rng.integers(-9999, 9999, (700, 14)).astype(np.int16), [], knn.Leaves.search

    def spy(self, q, worst=None):
        calls.append(len(q))
        return search_leaves(self, q, worst)

    def block(list_id, kind, first, q):
        ids = np.arange(first, first + len(q))
        return {"list_id": list_id, "n": len(q), "ids": ids.tobytes(), "labels": np.zeros(len(q), np.int8).tobytes(), "worst": np.full(len(q), np.inf).tobytes(), "data": q.tobytes(), "kind": kind, "salt": 0, "chunk": 0}

    class Held:
        def mapInArrow(self, run, schema):
            return run

    monkeypatch.setattr(knn.Leaves, "search", spy)
    asked = rng.integers(-9999, 9999, (10_000, 14)).astype(np.int16)
    rows = [block(0, 0, 0, data)] + [block(0, 1, a, asked[a : a + 500]) for a in range(0, 10_000, 500)]
    rows += [block(1, 0, 0, data[:300]), block(1, 1, 10_000, asked[:7])]
    got = {}
    for batch in knn._meet(Held(), 14, 5)(iter([pa.RecordBatch.from_pylist(rows[:9]), pa.RecordBatch.from_pylist(rows[9:])])):
        for r in batch.to_pylist():
            got.setdefault(r["qid"], []).append((r["dist"], r["orig_id"]))
    assert calls == [10_000, 7] and len(got) == 10_007
    for k in range(0, 10_000, 997):
        assert sorted(got[k]) == brute(asked[k], data, range(700), 5)
    for k in range(7):
        assert sorted(got[10_000 + k]) == brute(asked[k], data[:300], range(300), 5)


def test_flat_with_ties_and_few_rows(spark):
    rng = np.random.default_rng(1)
    data = rng.integers(-1, 2, (300, 14)) * 10000  # many equal vectors
    labels = rng.integers(0, 2, 300)
    refs = frame(spark, data, labels)
    queries = refs.filter("orig_id % 20 = 0").withColumnRenamed("orig_id", "qid")
    got = {}
    for r in knn.flat(queries, refs, S.Q).collect():
        got.setdefault(r.qid, []).append((r.rank, r.dist, r.orig_id))
    for qid, rows in got.items():
        assert [(d, i) for _, d, i in sorted(rows)] == brute(data[qid], data, range(300), 5)
    few = search.flat_search(queries, refs.filter("orig_id < 4"))
    assert {(r.votes, r.approved, r.d5) for r in few.collect()} == {(0, True, None)}
    assert search.flat_search(queries.limit(0), refs).count() == 0


def test_balanced_lists_and_boxes(spark):
    refs = suite.refs(spark, SF)
    index = ivf.build(refs, 16)
    sizes = [r.n for r in index.centroids.collect()]
    assert sum(sizes) == refs.count() and max(sizes) - min(sizes) <= 4
    joined = index.refs.join(index.boxes, "list_id")
    out = " or ".join(f"q{k} < mn{k} or q{k} > mx{k}" for k in range(14))
    assert joined.count() == refs.count() and joined.filter(out).count() == 0


def test_balanced_lists_with_one_common_value(spark):
    rng = np.random.default_rng(4)
    data = rng.integers(-9000, 9000, (200, 14))
    data[:120] = data[0]
    rows = frame(spark, data)
    lists = ivf.balanced_lists(rows, 4).select("orig_id", "list_id").collect()
    assert sorted(np.bincount([r.list_id for r in lists])) == [50] * 4
    again = ivf.balanced_lists(rows.repartition(7), 4).select("orig_id", "list_id").collect()
    assert sorted(map(tuple, lists)) == sorted(map(tuple, again))
    tiny = ivf.balanced_lists(frame(spark, data[:2]), 8)
    assert sorted(r.list_id for r in tiny.collect()) == [0, 4]


def test_tree_against_sorting(spark, monkeypatch):
    """Nodes sorted and halved by brute force: many ties over blocks of ids, negative ids, and an id on two rows, which
    stay two. Rows are placed where they are."""
    rng = np.random.default_rng(12)
    data = rng.integers(-2, 3, (300, 14)) * 5000
    ids = rng.permutation(np.arange(-900, 900, 6))
    rows = frame(spark, data).withColumn("orig_id", F.element_at(F.lit(ids.tolist()), F.col("orig_id").cast("int") + 1))
    monkeypatch.setattr(ivf, "ID_BLOCK", 32)
    want = {}

    def halve(some, node, depth):
        if depth == 0:
            want.update({int(ids[k]): node for k in some})
            return
        x = [[int(v) for v in data[some, d]] for d in range(14)]
        dim = int(np.argmax([len(v) * sum(a * a for a in v) - sum(v) ** 2 for v in x])) if len(some) else 0
        order = sorted(some, key=lambda k: (data[k, dim], ids[k]))
        half = max(len(some) // 2, 1)
        halve(order[:half], node * 2, depth - 1)
        halve(order[half:], node * 2 + 1, depth - 1)

    halve(list(range(300)), 0, 5)
    lists = ivf.balanced_lists(rows, 32)
    assert {r.orig_id: r.list_id for r in lists.collect()} == want
    twice = ivf.balanced_lists(rows.unionByName(rows), 4)
    assert twice.count() == 600 and twice.columns == ["list_id", *rows.columns]


def test_repair_is_exact_at_any_probe(spark):
    refs, queries = suite.refs(spark, SF), suite.query_set(suite.table(spark, SF))
    index = suite.index(spark, SF)
    exact = answers(search.flat_search(queries, refs))
    for n in (1, 3, 999):
        assert answers(search.probe(queries, index, n, True)) == exact
    recall = []
    for n in (1, 4, 32):
        got = answers(search.probe(queries, index, n))
        recall.append(sum(got[k] == exact[k] for k in exact))
    assert recall == sorted(recall) and recall[-1] == len(exact)


def test_long_lists_are_split(spark, monkeypatch):
    rng = np.random.default_rng(8)
    data = rng.integers(0, 40, (400, 14))  # many ties
    refs = frame(spark, data, rng.integers(0, 2, 400))
    index = ivf.build(refs, 2)
    queries = refs.filter("orig_id % 7 = 0").withColumnRenamed("orig_id", "qid")
    exact, probed = answers(search.flat_search(queries, refs)), answers(search.probe(queries, index, 1))
    monkeypatch.setattr(knn, "REF_ROWS", 8)
    monkeypatch.setattr(knn, "SALT_BLOCKS", 2)
    rows = knn.search_lists(search.probes(queries, index, 1), index.refs, index.centroids, S.Q, 5).collect()
    assert len(rows) == 5 * len(exact) and len({(r.qid, r.orig_id) for r in rows}) == len(rows)
    assert answers(search.probe(queries, index, 1)) == probed
    assert answers(search.probe(queries, index, 1, True)) == exact


def test_probe_with_fewer_than_five_candidates(spark):
    refs = frame(spark, np.arange(8)[:, None].repeat(14, 1) * 1000, np.ones(8))
    index = ivf.build(refs, 4)
    queries = refs.withColumnRenamed("orig_id", "qid")
    assert {v for v, _ in answers(search.probe(queries, index, 1)).values()} == {0}
    assert {v for v, _ in answers(search.probe(queries, index, 1, True)).values()} == {5}


def test_two_separated_lists(spark, tmp_path):
    data = [[500] * 14] * 5 + [[9500] * 14] * 5
    refs = frame(spark, data, [0] * 5 + [1] * 5)
    index = ivf.build(refs, 2)
    index.save(str(tmp_path / "index"))
    back = ivf.load(spark, str(tmp_path / "index"))
    queries = frame(spark, [[500] * 14, [9500] * 14]).withColumnRenamed("orig_id", "qid")
    got = {r.qid: (r.votes, r.approved) for r in search.search(queries, back, S.SearchParams(1, 1, "off")).collect()}
    assert got == {0: (0, True), 1: (5, False)}
    assert ivf.warm(back) == 10
    ivf.close(back)
    with pytest.raises(ValueError):
        ivf.load(spark, str(tmp_path / "none"))
    spark.createDataFrame([("XXXX", 1, 14, 2, 10, 5, 10000)], "magic string, version int, dims int, nlist int, total bigint, k int, scale int").write.mode("overwrite").parquet(str(tmp_path / "index/meta"))
    with pytest.raises(ValueError):
        ivf.load(spark, str(tmp_path / "index"))


@pytest.mark.parametrize("n", [0, 3, 32768])
def test_list_counts(n):
    with pytest.raises(ValueError):
        ivf.depth_of(n)


def test_kmeans_improves_and_keeps_every_row(spark):
    refs = suite.refs(spark, SF)
    lists, log = ivf.kmeans(refs, 8, 500, 4)
    assert lists.count() == refs.count()
    assert log[-1]["inertia"] <= log[0]["inertia"]
    cents = ivf.centroids(lists, 8)
    near = ivf.nearest_list(lists.drop("list_id"), ivf.as_matrix(cents, 14))
    assert near.count() == refs.count()


def test_empty_list_has_zero_centroid_and_its_box(spark):
    rows = frame(spark, [[100] * 14]).withColumn("list_id", F.lit(1))
    cents = ivf.centroids(rows, 2)
    empty = ivf.boxes(rows, cents).filter("list_id = 0").first()
    assert cents.filter("list_id = 0").first().c0 == 0 and empty.mn0 == empty.mx0 == 0 and empty.n == 0
    h = ivf.histogram(cents).first()
    assert (h.vectors, h.lists, h.empty, h.p50, h.max) == (1, 2, 1, 0, 1)


def test_load_score(spark):
    rows = spark.createDataFrame([(24037, 30021, 1, 0, 0, 0.74), (1, 1, 5, 0, 0, 3000.0), (0, 0, 0, 0, 0, 0.0)], "tp bigint, tn bigint, fp bigint, fn bigint, err bigint, p99 double")
    a, b, c = validate.load_score(rows).collect()
    assert a.p99_score == 3000 and a.detection_score == pytest.approx(2909.69, abs=0.01) and a.final_score == pytest.approx(5909.69, abs=0.01)
    assert b.p99_score == b.detection_score == -3000 and b.rate_component is None
    assert c.p99_score == 0 and c.epsilon == 0


def test_report_counts_parse_errors(spark):
    rows = spark.createDataFrame([(True, 0, True, True, 0, 40, False, True, 100, 2), (False, 0, True, False, 5, 0, False, False, 0, 0), (True, 5, False, True, 0, 20, True, False, 50, 0)], "ok boolean, votes int, approved boolean, expected_approved boolean, expected_votes int, used_nprobe int, used_flat boolean, used_bbox boolean, scanned_candidates bigint, repaired_clusters bigint")
    r = validate.report(rows, S.SearchParams()).first()
    assert (r.validated, r.mismatches, r.false_positive, r.false_negative, r.weighted_errors, r.parse_errors, r.fraud_count_diff, r.expanded, r.flat, r.bbox) == (3, 2, 1, 1, 9, 1, 2, 1, 1, 1)
    assert r.avg_candidates == 50 and validate.report(rows.limit(0), S.SearchParams()).first().mismatch_rate == 0
    assert [x[0] for x in spark.createDataFrame([(0.0,), (0.29,), (0.5,), (1.0,), (9.0,)], "s double").select(validate.expected_votes(F.col("s"))).collect()] == [0, 1, 3, 5, 5]


def test_reference_file(spark, tmp_path):
    import gzip

    items = [{"vector": [0.5] * 14, "label": "fraud"}, {"vector": [-1] * 14, "label": "legit"}, {"vector": [0.1] * 14, "label": "fraudulent"}]
    with gzip.open(tmp_path / "refs.json.gz", "wt") as f:
        json.dump(items, f)
    rows = sorted(readers.read_references(spark, str(tmp_path / "refs.json.gz")).collect())
    assert [(r.orig_id, r.label, r.q0) for r in rows] == [(0, 1, 5000), (1, 0, -10000), (2, 1, 1000)]
    (tmp_path / "bad.json").write_text(json.dumps([{"vector": [1], "label": "fraud"}]))
    with pytest.raises(Exception):
        readers.read_references(spark, str(tmp_path / "bad.json")).collect()


def test_entries_and_scores(spark, tmp_path):
    from tests.test_functions import REQUEST

    entries = [{"request": REQUEST, "expected_approved": False, "expected_fraud_score": 1.0}, {"request": {}, "expected_approved": True}]
    (tmp_path / "set.json").write_text(json.dumps({"stats": {}, "entries": entries}))
    rows = readers.read_entries(spark, str(tmp_path / "set.json"))
    assert [(r.idx, r.expected_approved, r.expected_fraud_score) for r in rows.orderBy("idx").collect()] == [(0, False, 1.0), (1, True, 0.0)]
    assert readers.read_entries(spark, str(tmp_path / "set.json"), 1).count() == 1
    index = suite.index(spark, SF, 3)
    got = score.score_bodies(rows.select(F.col("idx").alias("qid"), "body"), index, S.SearchParams(heuristic_only=True))
    assert {r.qid: r.response for r in got.collect()} == {0: '{"approved":false,"fraud_score":1.0}', 1: '{"approved":true,"fraud_score":0.0}'}
    fast = score.score_bodies(rows.select(F.col("idx").alias("qid"), "body"), index, S.SearchParams(2, 4, "always", fast_path=True))
    assert fast.count() == 2


def test_validation_of_files(spark, tmp_path):
    """A saved index and both forms of query files; malformed queries weigh five; mismatches come with a repaired search."""
    data = np.array([[500] * 14] * 5 + [[9500] * 14] * 5, np.int16)
    refs = frame(spark, data, [0] * 5 + [1] * 5)
    refs = refs.select("orig_id", "label", *[(F.col(q) / 10000).cast("float").alias(v) for q, v in zip(S.Q, S.V)], *S.Q)
    ivf.build(refs, 2).save(f"{tmp_path}/index")
    body = {"transaction": {"amount": 250.0, "installments": 6, "requested_at": "2026-01-05T12:00:00Z"}, "customer": {"avg_amount": 100, "tx_count_24h": 10, "known_merchants": []}, "merchant": {"id": "m", "mcc": "5411", "avg_amount": 40}, "terminal": {"is_online": True, "card_present": False, "km_from_home": 5}, "last_transaction": None}
    entries = [{"request": body, "expected_approved": k % 2 == 0} for k in range(4)] + [{"request": {}, "expected_approved": False}, {"request": {"transaction": {}}, "expected_approved": True, "expected_fraud_score": 0.2}]
    (tmp_path / "q.json").write_text(json.dumps({"entries": entries}))
    (tmp_path / "q.jsonl").write_text("\n".join(json.dumps({"idx": k, **e}) for k, e in enumerate(entries)))
    got = []
    for name in ("q.json", "q.jsonl"):
        for more in ([], ["--flat-only"], ["--heuristic-only"], ["--fast-path"], ["--limit", "2"]):
            settings = S.validate_settings(["--index", f"file://{tmp_path}/index", "--queries", f"file://{tmp_path}/{name}", "--base-nprobe", "2", "--ambig-nprobe", "2", "--dump-mismatches", "--out-json", f"file://{tmp_path}/out-{name}", *more])
            report, wrong = validate.validate(spark, settings)
            r = report.first()
            assert spark.read.json(f"file://{tmp_path}/out-{name}").first().validated == r.validated == (2 if more[:1] == ["--limit"] else 6)
            if not more or more == ["--flat-only"]:
                assert (r.parse_errors, r.mismatches, r.false_negative + r.false_positive) == (2, 3, 3)
                assert r.weighted_errors == r.false_positive + 3 * r.false_negative + 10 and r.flat == (4 if more else 0)
                assert wrong.count() == 3 and wrong.filter("ok and repaired_votes is null").count() == 0
            got.append((tuple(more), r.asDict()))
    assert got[:5] == got[5:]
    with pytest.raises(ValueError):
        validate.validate(spark, S.validate_settings(["--index", f"file://{tmp_path}/none", "--queries", "x"]))


def test_settings_from_flags():
    got = S.validate_settings(["--limit", "7", "--bbox-mode", "odd", "--exact-fallback", "--no-exact-fallback", "--base-nprobe", "3", "--unknown", "--heuristic-only"])
    assert (got.limit, got.params.bbox_mode, got.params.exact_fallback, got.params.base_nprobe, got.params.ambig_nprobe, got.params.heuristic_only) == (7, "ambiguous-only", False, 3, 512, True)
    assert S.validate_settings(["--exact-fallback", "--bbox-mode", "always"]).params == S.SearchParams(256, 512, "always", True)
    assert S.build_settings(["--nlist", "64", "--method", "kmeans", "--kmeans-iters", "2"]) == S.BuildSettings(method="kmeans", nlist=64, kmeans_iters=2)


def test_parameters_from_settings():
    p = S.params_from_env({"IVF_NPROBE": "7", "BBOX_MODE": "always", "FAST_PATH": "1"})
    assert (p.base_nprobe, p.ambig_nprobe, p.bbox_mode, p.fast_path) == (7, 24, "always", True)
    with pytest.raises(ValueError):
        S.SearchParams(bbox_mode="sometimes")
