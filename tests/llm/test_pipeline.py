import json
import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import corpus_pipeline


@pytest.fixture
def base(tmp_path):
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "ter", "un") for b in ("ra", "sel", "to", "ven", "dor", "is")]
    pick = lambda seed, n: " ".join(random.Random(seed).choices(words, k=n))
    good = [(i, f"Doc{i} " + pick(i, 60)) for i in range(60)]
    bad = [(100 + i, " ".join(w.upper() + "!!" for w in pick(1000 + i, 60).split())) for i in range(60)]
    special = [(200, good[3][1]), (201, good[4][1] + " extra"), (202, "Start " + pick(777, 40) + " " + pick(5001, 40)), (203, "Here " + pick(888, 50) + " token=abcdef12345 end"), (204, None), (205, "")]
    docs = good + bad + special
    pq.write_table(pa.table({"doc_id": [d for d, _ in docs], "text": pa.array([t for _, t in docs], pa.string()), "lang": ["en"] * len(docs), "source": ["s"] * len(docs), "n_chars": [len(t or "") for _, t in docs]}), tmp_path / "documents.parquet")
    pq.write_table(pa.table({"doc_id": [d for d, _ in good + bad], "quality": [1] * 60 + [0] * 60, "toxic": [0] * 120}), tmp_path / "labels.parquet")
    pq.write_table(pa.table({"item_id": [1], "text": [pick(5001, 40)]}), tmp_path / "benchmark.parquet")
    return str(tmp_path)


def test_stages_and_run(spark, base):
    docs = spark.read.parquet(f"{base}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, base)
        assert docs.columns == columns
        seen.append({r.doc_id: r for r in docs.collect()})
    quality, dedup, clean, secret = seen
    assert not set(range(100, 160)) & set(quality) and set(range(60)) | {200, 201, 202, 203} <= set(quality)
    assert set(quality) - set(dedup) - {204, 205} == {200, 201}
    assert set(dedup) - set(clean) == {202}
    assert set(secret) == set(clean) and "[SECRET]" in secret[203].text and "abcdef12345" not in secret[203].text
    assert secret[203].n_chars == len(secret[203].text)
    final = corpus_pipeline.run(spark, base).collect()
    assert sorted(r.doc_id for r in final) == sorted(secret)
    assert all((len(r.pieces) > 0) == bool(secret[r.doc_id].text) for r in final)


def test_stages_on_no_rows(spark, base):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, spark.read.parquet(f"{base}/documents.parquet").limit(0), base).collect() == []


def test_registration():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert "pipeline" in names and {f"op{n}" for n in range(1, 14)} == {n.split("_")[0] for n in names if n.startswith("op")}
    assert set(entry.oracle_sql()) <= names and json.dumps(sorted(entry.oracle_sql()))
