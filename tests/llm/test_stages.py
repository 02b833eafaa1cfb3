"""Each stage of the pipeline against brute force, on its own input, over several corpora."""

import importlib.util

import numpy as np
import pytest

from quillon.llm import quality

from .conftest import SCHEMA, corpus
from .test_corpus import brute_lines
from .test_documents import brute_counts, brute_pii
from .test_pipeline import stays
from .test_registered import plain_features

pytestmark = pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="the pipeline is not here")


def odd_rows(seed):
    """Rows with repeated ids, null ids, copies and texts with personal data."""
    rows = corpus(seed, 60)
    more = [(7, "tel +1 (555) 234-5678 or a@b.cd, later 555-234-5678 " + "and so on " * 20), (None, rows[30][1]), (None, rows[30][1]), (rows[31][0], "quite another text of the same id, long enough to count as its own")]
    return rows + [(i, t, "en", "s", len(t or "")) for i, t in more]


@pytest.fixture(scope="module", params=[1, 2, 3])
def seeded(request, spark):
    rows = odd_rows(request.param)
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(3)


def test_quality_rules_keep_what_the_trees_keep(spark, seeded, tmp_path):
    import corpus_pipeline as C

    rows, docs = seeded
    labels = spark.createDataFrame([(r[0], k % 2) for k, r in enumerate(rows)], "doc_id long, quality int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    model = quality.train(docs, labels)
    want = []
    for r in rows:
        n = brute_counts(r[1])
        score = float(model.raw(np.array([plain_features(r[1])]))[0])
        if n[0] >= 50 and 100 * n[4] <= 50 * n[0] and score >= 0:
            want.append(r)
    got = [tuple(r) for r in C.quality_rules(spark, docs, str(tmp_path)).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_line_dedup_cuts_what_came_before(spark, seeded):
    import corpus_pipeline as C

    rows = [r for r in seeded[0] if r[0] is not None and r[1] is not None]
    once = list({r[0]: r for r in rows}.values())  # brute force orders documents by id alone
    want = {d: t for d, (t, _, gone) in brute_lines(once).items() if t.strip(" \t\n\r\x0b\x0c") or not gone}
    got = {r["doc_id"]: r for r in C.line_dedup(spark, spark.createDataFrame(once, SCHEMA).repartition(3), "").collect()}
    assert {d: r["text"] for d, r in got.items()} == want and all(r["n_chars"] == len(r["text"]) for r in got.values() if r["text"])


def test_one_row_of_each_group_stays(spark, seeded):
    import corpus_pipeline as C

    rows, docs = seeded
    got = [(r["doc_id"], r["text"]) for r in C.near_duplicates(spark, docs, "").collect()]
    want = stays([(*r[:2],) for r in rows])
    assert len(got) == len(want)
    for group in sorted(want, key=len):
        got.remove(next(g for g in got if g in group))
    assert not got


def test_no_pattern_is_left_and_the_rest_is_untouched(spark, seeded):
    import corpus_pipeline as C

    rows, docs = seeded
    got = sorted((tuple(r) for r in C.personal_data(spark, docs, "").collect()), key=repr)
    assert len(got) == len(rows)
    assert not any(brute_pii(r[1] or "") for r in got)
    clean = sorted((r for r in rows if not any(c.isdigit() or c == "@" for c in r[1] or "")), key=repr)
    kept = {repr((*r[:4], len(r[1]) if r[1] is not None else None)) for r in clean}
    assert kept <= {repr(r) for r in got}
    (hidden,) = [r[1] for r in got if r[0] == 7 and (r[1] or "").startswith("tel ")]
    assert hidden.startswith("tel <PHONE> or <EMAIL>, later <PHONE> and so on")
