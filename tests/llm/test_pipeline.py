from collections import Counter

import corpus_pipeline
from trackscan.llm import langid, packing, simhash, toxicity
from trackscan.llm.registry import vocabulary

SF = "/root/testdata/sf0.001"


def test_stages_equal_plain_versions(spark):
    """Each stage against a plain version over what the one before it kept."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "language", "simhash", "packing"]
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}

    machine = toxicity.Machine.load(toxicity.fit(docs, labels, learn=toxicity.learnable()))
    expected = {k for k, t in texts.items() if machine.score([t])[0] < 0.5}
    first = corpus_pipeline.toxic(spark, docs, SF)
    assert {r["doc_id"] for r in first.collect()} == expected and first.columns == docs.columns

    model = langid.Model.load(langid.fit(first, learn=langid.learnable()))
    scored = {k: model.score([texts[k]]) for k in expected}
    expected = {k for k, (lang, score) in scored.items() if lang[0] != "und" and score[0] >= 0.5}
    second = corpus_pipeline.language(spark, first, SF)
    assert {r["doc_id"] for r in second.collect()} == expected and second.columns == docs.columns

    groups = {r["doc_id"]: r["component_id"] for r in simhash.query(second).collect()}
    third = corpus_pipeline.near_copies(spark, second, SF)
    assert {r["doc_id"] for r in third.collect()} == set(groups.values()) and third.columns == docs.columns

    ours = Counter((r["doc_id"], r["piece"], r["ids_crc32"]) for r in corpus_pipeline.run(spark, SF).collect())
    plain = packing.pieces(third, vocabulary("byte_bpe_50k.json")).selectExpr("doc_id", "piece", "crc32(ids) AS ids_crc32").collect()
    assert ours == Counter(map(tuple, plain))


def test_pipeline_without_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0
