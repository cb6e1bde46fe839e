"""The pipeline on a small table and on an empty one: near duplicates and secrets against brute force, the others against what
their operator says (tests of the operators compare these with brute force)."""

import re
from pathlib import Path

import pytest

import corpus_pipeline
from lumigrid.llm import queries, secret_scan
from tests.llm.test_operators import brute_components

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


def one_of_each_group(rows):
    head = {}
    for (doc, _, component), times in brute_components(rows).items():
        assert times == 1
        head[doc] = component
    return [(d, t) for d, t in rows if head[d] == d]


def masked(rows):
    out = []
    for d, t in rows:
        spans = sorted((m.start(), m.end()) for r in secret_scan.RULES for m in re.finditer(r.pattern, t or "") if len(m[r.group]) >= r.least)
        done, at = [], 0
        for a, z in spans:
            if a >= at:
                done += [t[at:a], "[SECRET]"]
            at = max(at, z)
        out.append((d, "".join(done) + t[at:] if spans else t))
    return out


BRUTE = {"near_duplicates": one_of_each_group, "secrets": masked}


def test_empty_tables(spark, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, SF).persist()
        if name in BRUTE:
            rows = {c: [tuple(r) for r in x.select("doc_id", "text").collect()] for c, x in (("before", before), ("after", docs))}
            assert sorted(rows["after"]) == sorted(BRUTE[name](rows["before"]))
        assert docs.columns == columns
        sizes.append(docs.count())
    assert sizes[1] <= sizes[0] and sizes[2] < sizes[1] and sizes[3] == sizes[2]
    assert docs.where("text rlike '(?i)password=[0-9a-f]{10}'").count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in docs.collect()}


def test_run_is_repeatable(spark):
    a, b = (sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in corpus_pipeline.run(spark, SF).collect()) for _ in range(2))
    assert a == b and a


def test_every_operator_has_a_query():
    assert [sum(n.startswith(f"op{i}_") for n in queries.queries()) for i in range(1, 11)] == [1] * 10
