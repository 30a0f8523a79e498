"""The pipeline against its stages' definitions, stage by stage and as a whole."""

import numpy as np
import public_tokenizers as P
import pyarrow as pa
from tokenizers import Tokenizer

import corpus_pipeline
from barloom.llm import nbsvm, risk_rules
from barloom.llm.common import table
from tests.llm.test_jaccard import brute
from tests.llm.test_quality_models import counts

SF = "/root/testdata/sf0.01"


def test_pipeline_against_brute_force(spark):
    docs = table(spark, SF, "documents")
    model, found = nbsvm.fit(docs, table(spark, SF, "labels")), nbsvm.Indicators()
    rows = [r for r in docs.collect() if model.score(found.of((r.text or "").encode())) >= nbsvm.THRESHOLD]
    # 1,000 documents have too few labels for any cutoff, so the base rule alone decides
    rows = [r for r in rows if (n := counts(r.text))[0] >= 20 and 100 * n[5] <= 30 * n[0]]
    first = {c for i, _, c in brute([(r.doc_id, r.text) for r in rows]) if i == c}
    want, t = {}, Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    for r in rows:
        if r.doc_id in first:
            want[r.doc_id] = np.asarray(t.encode(r.text, add_special_tokens=False).ids + [1], "<u4").tobytes()
    got = {}
    for r in sorted(corpus_pipeline.run(spark, SF).collect(), key=lambda r: r.start):
        got[r.doc_id] = got.get(r.doc_id, b"") + bytes(r.ids)
    assert got == want and 0 < len(want) < len(rows) < docs.count()


def test_stages_keep_the_columns(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "quality rules", "n-gram Jaccard join", "packing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, "/root/testdata/sf0.001").schema == docs.schema


def test_stages_on_nothing(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, "/root/testdata/sf0.001").count() == 0
    assert risk_rules.RISK <= 0.05


def test_texts_are_packed_in_small_batches(spark, monkeypatch):
    """Rows of one partition go to Python by the few hundred, not as many as the session allows; the result is stored by then."""
    sizes = lambda docs, path: docs.select("doc_id").mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches), "n bigint")
    monkeypatch.setattr(corpus_pipeline.packing, "pack", sizes)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    docs = spark.range(2000).selectExpr("id AS doc_id", "'some words' AS text").coalesce(1)
    got = corpus_pipeline.packed(spark, docs, SF)
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
    rows = [r.n for r in got.collect()]
    assert sum(rows) == 2000 and max(rows) <= corpus_pipeline.BATCH < 2000
