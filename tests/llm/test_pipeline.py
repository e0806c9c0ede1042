"""The pipeline against its stages' brute-force versions."""

import re

import pytest

import corpus_pipeline
from foliant.llm import quality
from tests.llm.test_operators import brute_components, brute_contamination, brute_spans

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, steps = docs.columns, [docs.collect()]
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, spark.createDataFrame(steps[-1], docs.schema), SF)
        if n < 4:
            assert out.columns == columns
        steps.append(out.collect())
    start, good, unique, clean, masked, mixed = steps
    model = quality.quality_model(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    scores = {r["doc_id"]: r["score"] for r in quality.quality_scores(docs, model, ["doc_id"]).collect()}
    assert {r["doc_id"] for r in good} == {r["doc_id"] for r in start if scores[r["doc_id"]] >= 0.7}
    roots = {c for _, c in brute_components([r["text"] for r in good], [r["doc_id"] for r in good])}
    assert {r["doc_id"] for r in unique} == roots
    bench = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    hits = brute_contamination([r["text"] for r in unique], bench)
    assert {r["doc_id"] for r in clean} == {r["doc_id"] for r, h in zip(unique, hits, strict=True) if not h[1]}
    before = {r["doc_id"]: r["text"] for r in clean}
    assert {r["doc_id"] for r in masked} == set(before)
    for r in masked:
        if not brute_spans(before[r["doc_id"]]):
            assert r["text"] == before[r["doc_id"]] or "[" in r["text"]
        else:
            assert re.search(r"\[(EMAIL|IP|CARD|PHONE|SECRET)\]", r["text"])
            assert not brute_spans(r["text"])
    assert {r["doc_id"] for r in mixed} <= {r["doc_id"] for r in masked}
    assert {r["copies"] for r in mixed} <= {1, 2}
    assert len(mixed) > 0


@pytest.mark.parametrize("n", range(5))
def test_stages_on_odd_rows(spark, n):
    """Nulls in any column, empty and long texts, repeated rows and a further column; and an empty table."""
    schema = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").schema.add("score", "string")
    long = " ".join(f"wort{i % 991}" for i in range(30_000))
    rows = [(1, None, "en", "a", None, "x"), (2, "", None, "a", 0, None), (None, "no id at all here", "en", None, None, None), (3, "one two three mail a@b.org", "en", "b", 26, "x"), (3, "one two three mail a@b.org", "en", "b", 26, "x"), (4, long, None, None, len(long), None)]
    name, stage = corpus_pipeline.STAGES[n]
    out = stage(spark, spark.createDataFrame(rows, schema), SF)
    got = out.collect()
    assert out.columns == schema.names if n < 4 else [*schema.names, "copies"]
    assert len(got) <= len(rows)
    if name == "decontamination":
        assert len(got) == len(rows)
    if name == "pii":
        assert sorted(str(r["text"]) for r in got) == sorted(str(r[1]).replace("a@b.org", "[EMAIL]") for r in rows)
    if name == "near duplicates":
        assert sorted(str(r["doc_id"]) for r in got) == ["1", "2", "3", "4", "None"]
    if n < 4:
        assert all(r["score"] in ("x", None) for r in got)
    assert stage(spark, spark.createDataFrame([], schema), SF).count() == 0
