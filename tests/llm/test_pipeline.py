"""The pipeline's stages against brute force over what each was given."""

import duckdb
import pyarrow as pa
from test_neardup import brute
from test_text_operators import brute_decontamination, check_packing

import corpus_pipeline
from tidewire.llm import secretscan, toxicity

SF = "/root/testdata/sf0.001"


def test_stages_in_turn(spark, tmp_path):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "secrets", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path / f"{k}-{name}")
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        assert k == 4 or docs.columns == columns
        kept.append(docs.collect())
    everything = spark.read.parquet(f"{SF}/documents.parquet")
    net = toxicity.train(everything, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = everything.collect()
    scores = toxicity.score_texts(net, pa.array([r.text for r in rows]))
    assert {r.doc_id for r in kept[0]} == {r.doc_id for r, s in zip(rows, scores) if s < 0.5}
    assert {r.doc_id for r in kept[1]} == {r[0] for r in brute([(r.doc_id, r.text) for r in kept[0]], 5) if r[3]}
    items = duckdb.sql(f"select * from '{SF}/benchmark.parquet'").fetchall()
    assert {r.doc_id for r in kept[2]} == {r[0] for r in brute_decontamination([(r.doc_id, r.text) for r in kept[1]], items) if not r[-1]}
    assert {r.doc_id for r in kept[3]} == {r.doc_id for r in kept[2]}
    assert all(not secretscan.base_spans(r.text.replace("[SECRET]", "")) and r.n_chars == len(r.text) for r in kept[3])
    check_packing([(r.doc_id, r.text) for r in kept[3]], kept[4])


def test_run_is_the_stages(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
