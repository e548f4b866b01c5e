"""The pipeline's stages on a small fixture: each decision takes effect and clean documents stay."""

import corpus_pipeline
from quillgraph.llm.common import table


def test_stages(spark, tmp_path):
    words = lambda k, n: " ".join(f"w{(k * 37 + i * i) % 997}x{i % 89}" for i in range(n))
    docs = [(i, words(i, 60 + i), "en", "src0", 0) for i in range(40)]
    docs += [(100, words(3, 63), "en", "s", 0), (101, words(3, 63) + " tail", "en", "s", 0), (102, words(50, 30) + " alpha beta gamma delta epsilon zeta eta theta " + words(51, 30), "en", "s", 0)]
    docs += [(200 + i, words(60 + i, 40) + " vileword awfulword", "en", "s", 0) for i in range(20)] + [(300, words(90, 40) + " mail me@x.example.com now", "en", "s", 0), (301, None, None, None, None), (302, "", "en", "s", 0)]
    labels = [(i, 1, 0) for i in range(40)] + [(200 + i, 1, 1) for i in range(15)]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, "alpha beta gamma delta epsilon zeta eta theta")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows, kept = table(spark, str(tmp_path), "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, rows, str(tmp_path))
        if name != "byte_bpe":
            assert out.columns == rows.columns, name
        out.write.parquet(f"{tmp_path}/{name}")
        rows = spark.read.parquet(f"{tmp_path}/{name}")
        kept.append({r["doc_id"] for r in rows.select("doc_id").collect()})
    every = {d[0] for d in docs}
    toxic = set(range(200, 220))
    assert kept[0] == every - toxic
    assert kept[1] == kept[0] - {100, 101}
    assert kept[2] == kept[1] - {102}
    assert kept[3] == kept[2] and kept[4] == kept[2]
    redacted = spark.read.parquet(f"{tmp_path}/pii").where("doc_id = 300").first()
    assert "[email]" in redacted["text"] and redacted["n_chars"] == len(redacted["text"])
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == kept[4]
