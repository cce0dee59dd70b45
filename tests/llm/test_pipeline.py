"""Queries of the subpackage and the pipeline, on the small driver tables."""

import collections

import pytest

import corpus_pipeline
from nearvote.llm import decontam, queries, secret_scan
from tests.llm.test_operators import group_brute

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query_runs(spark, name):
    got = queries.QUERIES[name](spark, SF)
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    rows = got.collect()
    if name in ("op3_decontamination", "op4_license_scan"):
        assert len({tuple(r)[:2] for r in rows}) == len(rows)
    elif name == "op1_packing":
        assert len({r.doc_id for r in rows}) == n
    elif name == "op7_chat":
        assert -7 in {r.conv_id for r in rows}
    else:
        assert len(rows) == n == len({r.doc_id for r in rows})


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    now, seen = docs, [docs.collect()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = spark.createDataFrame(stage(spark, now, SF).collect(), docs.schema)
        seen.append(now.collect())
        assert now.columns == docs.columns
    ids = [{r.doc_id for r in rows} for rows in seen]
    assert all(b <= a for a, b in zip(ids, ids[1:]))
    want = {d for d, _, _, kept in group_brute([(r.doc_id, r.text) for r in seen[1]], 5, 80) if kept}
    assert ids[2] == want
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    items = [" ".join(decontam.words_of(b.text)) for b in bench]
    held = {r.doc_id for r in seen[2] if any(i in " ".join(decontam.words_of(r.text)) for i in items)}
    assert ids[3] == ids[2] - held and ids[4] == ids[3]
    assert not any(secret_scan.base_spans(r.text) for r in seen[4])
    out = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in out} == ids[4]
    sizes = collections.Counter()
    for r in out:
        sizes[r.sequence_id] += r.length
    assert max(sizes.values()) <= 2048


ODD = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_take_odd_rows(spark, name, stage):
    """Nulls in any column, empty and very long texts, repeated rows, and further columns with names used inside."""
    prose = "of the people and their mother who have been there with another other one in this town "
    rows = [(k, prose * (1 + k % 3) + f"number {k} " * 12, "en", "s", 9) for k in range(40)]
    rows += [(None, prose, "en", "s", 1), (50, None, "en", "s", None), (51, "", None, None, 0), (52, prose + "x " * 300_000, None, "s", 1), (1, rows[1][1], "en", "s", 9), (53, "12 34", "en", "s", 5)]
    more = ", block string, part string, rid string, n string, ids string, name string, cls string, times string, rep string"
    df = spark.createDataFrame([(*r, *"xxxxxxxxx") for r in rows], ODD + more).repartition(3)
    got = stage(spark, df, SF)
    kept = got.collect()
    if name == "packing":
        assert {r.doc_id for r in kept} == {r[0] for r in rows}
    else:
        assert got.columns == df.columns
        ids = collections.Counter(r.doc_id for r in kept)
        assert set(range(40)) <= set(ids) and (ids[1] == 1 if name == "near_duplicates" else ids[1] == 2)
        assert (50 in ids) == (51 in ids) == (53 in ids) == (name != "language_id") or name == "near_duplicates"
    assert stage(spark, df.limit(0), SF).count() == 0
