"""The pipeline's stages on a small table with planted copies, and their order."""

import corpus_pipeline
from codexmill.llm import queries


def test_stages_keep_columns_and_take_effect(spark, tmp_path):
    words = [f"w{i}" for i in range(400)]
    long = lambda k: " ".join(words[(i * 7 + k * 13) % 400] for i in range(60))
    rows = [(i, long(i), "en", "ab"[i % 2], 9, "extra") for i in range(30)]
    rows += [(100, long(1), "en", "a", 9, "extra"), (101, long(2) + " more", "en", "a", 9, "extra"), (102, None, None, None, None, None), (103, "", "en", "a", 0, "extra"), (None, "no id at all", "en", "b", 3, "extra")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"out{k}"))
        docs = spark.read.parquet(str(tmp_path / f"out{k}"))
        seen[name] = docs.collect()
        assert name == "encoding" or docs.columns == columns
    assert list(seen) == ["toxicity", "exact_dedup", "near_dedup", "mixing", "encoding"]
    ids = lambda name: {r["doc_id"] for r in seen[name]}
    assert len(seen["toxicity"]) == len(rows)
    assert 1 not in ids("exact_dedup") and 100 in ids("exact_dedup") and len(seen["exact_dedup"]) == len(rows) - 2
    assert len({2, 101} & ids("near_dedup")) == 1 and len(seen["near_dedup"]) == len(rows) - 3
    assert ids("mixing") <= ids("near_dedup") and all(r["n_tokens"] == len(r["ids"]) for r in seen["encoding"])
    assert len(seen["encoding"]) == len(seen["mixing"])


def test_every_operator_is_registered():
    assert {int(n[2:].split("_")[0]) for n in queries.QUERIES} == set(range(1, 11))
