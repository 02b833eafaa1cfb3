"""The pipeline by stages, against brute force."""

import importlib.util

import pytest

from quillon.llm import pii
from quillon.llm.registry import ORACLE_SQL, QUERIES

from .test_corpus import brute_lines, shingle_sets

pytestmark = pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="the pipeline is not here")


def test_stages(spark, sf_dir, docs, rows, tmp_path):
    import corpus_pipeline as C

    stages = dict(C.STAGES)
    spark.createDataFrame([(r[0], 1) for r in rows], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    kept = stages["quality rules"](spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} <= {r[0] for r in rows}

    cut = stages["line dedup"](spark, docs, "")
    want = {d: t for d, (t, _, gone) in brute_lines(rows).items() if t.strip() or not gone}
    got = {r["doc_id"]: r for r in cut.collect()}
    assert {d: r["text"] for d, r in got.items() if r["text"] is not None} == want
    assert all(r["n_chars"] == len(r["text"]) for r in got.values() if r["text"])

    one = stages["n-gram Jaccard join"](spark, docs, "").collect()
    sets = shingle_sets(rows)
    left = {r["doc_id"] for r in one}
    for a in sets:
        linked = [b for b in sets if b != a and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
        if not linked:
            assert a in left
        elif a not in left:
            assert any(b < a for b in sets)

    df = spark.createDataFrame([(1, "mail a.b@example.org", "en", "s", 20)], docs.schema)
    (hidden,) = stages["PII"](spark, df, "").collect()
    assert hidden["text"] == "mail <EMAIL>" and hidden["n_chars"] == len(hidden["text"])
    assert [name for name, _ in C.STAGES] == ["quality rules", "line dedup", "n-gram Jaccard join", "PII", "best-fit packing"]


def stays(rows):
    """One row of each brute-force component: (doc_id, text) of what the near-duplicate stage may keep, by component."""
    sets = [s for r in rows for s in shingle_sets([r]).values()]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            same = sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])
            if same or not sets[i] and rows[i][0] is not None and rows[i][:2] == rows[j][:2]:
                root = [min(root[i], root[j]) if x in (root[i], root[j]) else x for x in root]
    groups = {}
    for x, r in zip(root, rows):
        groups.setdefault(x, []).append(r)
    return [{r[:2] for r in g if r[0] == min((x[0] for x in g if x[0] is not None), default=None)} for g in groups.values()]


def test_near_duplicates_decide_by_row(spark, docs, rows):
    import corpus_pipeline as C

    a, b, c, d = (" ".join(f"{p}{k}" for k in range(40)) for p in "pqrs")
    more = [(500, b), (500, a), (400, a + " x"), (501, c), (501, c), (501, c), (None, d), (None, d), (None, d + " x"), (None, c), (502, ""), (502, ""), (None, ""), (None, ""), (503, None), (503, "")]
    whole = [*rows, *rows[30:40], *((None, *r[1:]) for r in rows[40:50]), *((i, t, "en", "s", len(t or "")) for i, t in more)]
    got = [(r["doc_id"], r["text"]) for r in C.near_duplicates(spark, spark.createDataFrame(whole, docs.schema).repartition(3), "").collect()]
    want = stays(whole)
    assert len(got) == len(want)
    rest = list(got)
    for group in sorted(want, key=len):
        hit = next(g for g in rest if g in group)
        rest.remove(hit)
    assert not rest and (500, b) in got and (400, a + " x") in got and (500, a) not in got and got.count((501, c)) == 1 and (None, c) not in got
    assert sum(g in ((None, d), (None, d + " x")) for g in got) == 1 and got.count((502, "")) == 1 and got.count((None, "")) >= 2


def test_run_and_empty_tables(spark, sf_dir, none, tmp_path):
    import corpus_pipeline as C

    out = C.run(spark, sf_dir)
    rows = out.collect()
    assert len(rows) > 50 and {"doc_id", "piece", "start", "length", "sequence_id", "offset"} <= set(out.columns)
    docs = none
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    for _, stage in C.STAGES:
        docs = stage(spark, docs, str(tmp_path))
    assert docs.count() == 0


def test_registry():
    numbers = sorted(int(n.split("_")[0][2:]) for n in QUERIES)
    assert numbers == list(range(1, 11)) and set(ORACLE_SQL) <= set(QUERIES)
    assert pii.KINDS == ("email", "ip", "card", "phone")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, sf_dir, name):
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = con.sql(ORACLE_SQL[name]).df()
    got = QUERIES[name](spark, sf_dir).toPandas()
    assert sorted(map(tuple, got[sorted(got)].values.tolist())) == sorted(map(tuple, want[sorted(want)].values.tolist()))
