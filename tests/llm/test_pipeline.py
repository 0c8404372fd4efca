"""The pipeline's stages against the operators' own verdicts, recomputed by brute force where that is possible."""

import corpus_pipeline
from lodestar.llm import packing, tokens, toxicity, quality

from .test_text import brute_components, figures

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, SF)
        rows = [(r.doc_id, r.text) for r in before.collect()]
        kept = {r.doc_id for r in docs.collect()}
        seen.append(name)
        if name != "packing":
            assert docs.columns == columns
            docs = spark.createDataFrame(docs.toArrow())
        if name == "toxicity":
            assert kept == {r.doc_id for r in toxicity.score(before, toxicity.learn(before, labels)).where("predicted = 0").collect()}
        if name == "quality":
            assert kept == {r.doc_id for r in quality.score(before.select("doc_id", "text"), quality.learn(before, labels)).where("kept").collect()}
            assert not any(figures(t)[-1] for i, t in rows if i in kept)
        if name == "near_duplicates":
            assert kept == {i for i, (_, c) in brute_components(rows, 5).items() if i == c}
        if name == "packing":
            assert kept == {i for i, _ in rows}
            assert sorted(map(tuple, docs.select("doc_id", "piece", "ids_crc32").collect())) == sorted(map(tuple, packing.pack(before, tokens.default_path()).select("doc_id", "piece", "ids_crc32").collect()))
    assert seen == ["toxicity", "quality", "near_duplicates", "decontamination", "packing"]
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF).collect()} == kept
