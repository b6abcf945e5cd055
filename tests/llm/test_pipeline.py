"""The corpus pipeline: what each stage decides takes effect, and all of it holds on awkward rows."""

import corpus_pipeline
from passagekit.llm.jaccard_join import jaccard_components
from passagekit.llm.toxicity import score_toxicity
from tests.llm.data import DOCS, awkward

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "line dedup", "n-gram Jaccard join", "mixing sources to target weights", "best-fit packing"]
    kept = stages["toxicity"](spark, docs, FOLDER)
    good = {r[0] for r in score_toxicity(docs, labels).where("predicted = 0").select("doc_id").collect()}
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == good
    lines = stages["line dedup"](spark, kept, FOLDER)
    assert lines.columns == docs.columns and lines.count() == len(good)
    assert lines.where("n_chars <> length(text)").count() == 0
    single = stages["n-gram Jaccard join"](spark, lines, FOLDER)
    smallest = {r[0] for r in jaccard_components(lines, n=5, share=80).select("component_id").distinct().collect()}
    assert single.columns == docs.columns and {r["doc_id"] for r in single.collect()} == smallest and single.count() == len(smallest)
    mixed = stages["mixing sources to target weights"](spark, single, FOLDER)
    assert mixed.columns == docs.columns and {r["doc_id"] for r in mixed.collect()} <= smallest
    packed = stages["best-fit packing"](spark, mixed, FOLDER)
    assert packed.where("piece = 0").count() == mixed.count()


def test_run_is_the_stages(spark):
    out = corpus_pipeline.run(spark, FOLDER)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and out.count() > 0


def test_awkward_documents_and_none(spark):
    for docs in (awkward(spark, [None, "", "a b", "a b", "long " * 50_000], [None, "s", "s", None, "t"], [None, 1, 2, 2, 3]),
                 spark.createDataFrame([], DOCS)):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, FOLDER)
        assert docs.count() >= 0


def test_copied_documents_keep_their_lines(spark):
    docs = awkward(spark, ["first line\nsecond line"] * 4 + [f"other {i}" for i in range(12)])
    out = {r["doc_id"]: r["text"] for r in corpus_pipeline.line_dedup(spark, docs, FOLDER).collect()}
    assert [out[i] for i in range(4)] == ["first line\nsecond line"] * 4
