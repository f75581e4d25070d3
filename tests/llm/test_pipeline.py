import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import plain  # noqa: E402

import __spark_entry__ as contract  # noqa: E402
import corpus_pipeline  # noqa: E402


def test_stages_against_plain_versions(spark, folder):
    """Each stage is held against a plain version of it on the input it was given."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "quality_classifier" and corpus_pipeline.ORACLE_SQL is None
    before = {r.doc_id: r.text for r in docs.collect()}
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = corpus_pipeline.cut_lineage(stage(spark, docs, folder), "test")
        rows = out.collect()
        if i < 4:
            assert out.columns == names
            now = {r.doc_id: r.text for r in rows}
            assert set(now) <= set(before)
        if i == 0:
            assert 0.5 * len(before) < len(now) < len(before)
        if i == 1:
            assert all(set((t or "").split("\n")) - {""} <= set((before[d] or "").split("\n")) for d, t in now.items())
        if i == 2:
            assert set(now) == {d for d, _, c in plain.groups(before.items()) if d == c}
        if i == 3:
            items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").select("item_id", "text").collect()]
            clean = {d for d, _, hit, _ in plain.contamination(before.items(), items) if not hit}
            assert all(now[d] == before[d] for d in clean)
            assert not any(hit for _, _, hit, _ in plain.contamination(now.items(), items))
        if i == 4:
            assert {r.doc_id: r.decoded_sha256 for r in rows} == {d: plain.sha(t or "") for d, t in before.items()}
        else:
            docs, before = out, now


def test_registered():
    names = set(contract.queries())
    assert "pipeline" in names and {f"op{i}" for i in range(1, 11)} <= {n.split("_")[0] for n in names}
