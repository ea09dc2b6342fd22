"""The pipeline's stages keep the documents' columns, and each one's decisions show in the next one's input."""
import uuid

import corpus_pipeline
from rowproof.llm.base import table
from rowproof.session import session_folder

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, FOLDER, "documents")
    start = {r.doc_id for r in docs.select("doc_id").collect()}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, FOLDER)
        assert docs.columns == columns, name
    left = {r.doc_id for r in docs.select("doc_id").collect()}
    assert left < start
    out = corpus_pipeline.run(spark, FOLDER)
    assert {r.doc_id for r in out.collect()} == left and out.where("NOT round_trip").count() == 0


def test_mixing_reaches_the_result(spark):
    sizes = {"a": 300, "b": 90, "c": 40}
    rows = [(i, f"text {i} " * (200 if s == "b" else 1), s) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(7)
    path = f"{session_folder(spark)}/mixed-{uuid.uuid4().hex}"
    corpus_pipeline.mix_sources(spark, docs, FOLDER).write.parquet(path)
    out = corpus_pipeline.encode(spark, spark.read.parquet(path), FOLDER).collect()
    assert [r.slot for r in out] == list(range(len(rows)))
    total = sum(n ** 0.5 for n in sizes.values())
    for name, n in sizes.items():
        share = n ** 0.5 / total
        # Until the first source runs out.
        assert all(abs(sum(r.source == name for r in out[:t]) - share * t) < 1 for t in range(1, int(40 * total / 40 ** 0.5)))
