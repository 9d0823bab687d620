"""Every stage of the pipeline on its own input, and its edges."""

import corpus_pipeline
from tests.llm.test_decontaminate import brute as leaks
from tests.llm.test_files import expected
from tests.llm.test_jaccard import brute as classes
from tests.llm.test_small import measured

D = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{D}/benchmark.parquet").select("item_id", "text").collect()]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        stage(spark, docs, D).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        after, texts = docs.collect(), [(r.doc_id, r.text) for r in before]
        if i < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if name == "quality rules":
            kept = {r.doc_id for r in after}
            assert all(measured(t)[0] >= 50 for d, t in texts if d in kept) and {d for d, t in texts if measured(t)[0] < 50}.isdisjoint(kept)
            assert len(after) > 0.5 * len(before)
        elif name == "n-gram Jaccard join":
            assert sorted(r.doc_id for r in after) == sorted(d for d, _, c in classes(texts, 5, 80, 100) if d == c)
        elif name == "benchmark decontamination":
            bad = {d for d, _ in leaks(texts, items)}
            assert sorted(r.doc_id for r in after) == sorted(d for d, _ in texts if d not in bad)
        elif name == "mixing to target weights":
            assert {tuple(r) for r in after} <= {tuple(r) for r in before} and len(after) > 0.5 * len(before)
        else:
            assert sorted((r.n_tokens, r.ids_crc32) for r in after) == sorted(x[2:] for x in expected(sorted(texts)))


def test_nulls_and_empty_tables(spark, tmp_path):
    for t in ("benchmark", "labels"):
        spark.read.parquet(f"{D}/{t}.parquet").limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    long = " ".join(f"word{i}" for i in range(80))
    rows = spark.createDataFrame([(None, long, None, None, None), (1, None, "en", "s", 0), (2, long + " x", "en", "s", 1), (2, long + " x", "en", "s", 1)], schema)
    for docs, n in ((rows, 1), (rows.limit(0), 0)):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, str(tmp_path))
        assert docs.count() >= n
