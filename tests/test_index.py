import gzip
import re

import pyarrow as pa
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from passagekit.catalog.stubs import fingerprint_model
from passagekit.operators.embedding import hash_embed
from passagekit.plans.answering import AnswerConfig
from passagekit.plans.index_build import IndexConfig, build_and_write, build_index
from passagekit.schemas import INDEX
from passagekit.session import ARROW_BYTES, prepare
from passagekit.sources.corpus import list_corpus, number_pages, only_new, pages_from_files, read_html_corpus, write_html_corpus
from passagekit.sources.index_store import (
    create_index_table, insert_index, load_or_build_index, read_index, reset_index, snapshot_index, snapshot_path, write_if_absent,
    write_index,
)
from passagekit.sources.records import append_answer_log, evaluation_name
from passagekit.streaming.jobs import answer_stream, index_stream, read_page_stream, read_question_stream

CONFIG = IndexConfig(model="hash-16", chunk_size=10, chunk_overlap=3, domain=None)
PAGES = [(i, f"u{i}", f'<section id="a">one two three {i}</section><section id="b">four</section>') for i in range(6)]


def pages_of(spark, rows=PAGES):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_files(spark, tmp_path):
    (tmp_path / "d" / "e").mkdir(parents=True)
    (tmp_path / "d" / "e" / "x.html").write_text("<p>é\n</p>", encoding="utf-8")
    (tmp_path / "d" / "y.txt").write_text("no")
    assert [r["text"] for r in read_html_corpus(spark, str(tmp_path)).collect()] == ["<p>é\n</p>"]
    assert [r["path"].rsplit("/", 1)[-1] for r in list_corpus(spark, str(tmp_path)).collect()] == ["x.html"]


def test_pages_are_written_to_few_folders(spark, tmp_path):
    rows = [(i, None if i == 7 else f"<p>é {i}</p>") for i in range(2300)] + [(8, "again")]
    pages = spark.createDataFrame(rows, "page_id long, html string").coalesce(1)
    assert write_html_corpus(pages, str(tmp_path / "c")) == 2300
    assert sorted(len(list(f.iterdir())) for f in (tmp_path / "c").iterdir()) == [300, 1000, 1000]
    read = {int(re.search(r"page_id=(\d+)", r["source"])[1]): r["text"] for r in read_html_corpus(spark, str(tmp_path / "c"), "*.txt").collect()}
    assert len(read) == 2300 and read[9] == "<p>é 9</p>\n" and read[7] == "\n" and sorted(read[8].split("\n")) == ["", "<p>é 8</p>", "again"]


def test_plain_files_are_read_as_bytes_others_unpacked(spark, tmp_path):
    (tmp_path / "a.html").write_bytes(b"\xffx\r\n")
    (tmp_path / "b.html.gz").write_bytes(gzip.compress("é".encode()))
    plain = read_html_corpus(spark, str(tmp_path))
    assert "binaryFile" in plain._jdf.queryExecution().executedPlan().toString()
    assert [r[0] for r in plain.select(F.hex("text")).collect()] == ["FF780D0A"]
    assert [r["text"] for r in read_html_corpus(spark, str(tmp_path), "*.gz").collect()] == ["é"]


def test_many_files_are_not_held_by_the_driver(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"<p>{i}</p>") for i in range(2300)], "page_id long, html string")
    write_html_corpus(pages, str(tmp_path / "c"))
    read, listed = read_html_corpus(spark, str(tmp_path / "c"), "*.txt"), list_corpus(spark, str(tmp_path / "c"), "*.txt")
    assert len(read.inputFiles()) < 200 and len(listed.inputFiles()) < 200
    assert read.rdd.getNumPartitions() == listed.sparkSession.sparkContext.defaultParallelism
    assert {r["text"] for r in read.collect()} == {f"<p>{i}</p>\n" for i in range(2300)}
    assert {r["path"] for r in listed.collect()} == {r["source"] for r in read.select("source").collect()} and listed.count() == 2300


def test_files_listed_by_executors_are_those_of_sparks_readers(spark, tmp_path):
    root = tmp_path / "a b%41é"
    names = ["x.html", "deep/er/y.html", "s p.html", "p%20.html", "ü.html", "#q?.html", "{b}[1].html", "nb\xa0sp.html", "l\nf.html", "\U0001f600.html",
             "c.txt", "x.HTML", "z.html.gz", "_no.html", ".no.html", "_k=v.html", "_no/x.html", ".no/x.html", "_k=w/x.html", "_metadata/x.html",
             "_metadata.html", "y._COPYING_", "dir.html/x.html", "w~'(!)*,@&$;+^`|\"<>.html"]
    for name in names:
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes((gzip.compress if name.endswith(".gz") else bytes)(b"\xff\r\n" + name.encode()))
    (root / "empty.html").touch()
    (root / "link").symlink_to(root / "deep")
    (root / "lost.html").symlink_to(root / "nowhere")
    for glob in ("*.html", "[!p-z]*.{html,txt}", "*", "er*.html"):
        for f in (list_corpus, read_html_corpus):
            few, many = (f(spark, f"{root}/", glob, most) for most in (1_000, 0))
            assert few.schema.simpleString() == many.schema.simpleString()
            assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect())), (f, glob)
    for name in ("b/x.html", "a.html", "c.txt"):
        (tmp_path / "plain" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "plain" / name).write_text(name)
    few, many = (sorted(map(tuple, pages_from_files(spark, str(tmp_path / "plain"), max_listed=most).collect())) for most in (1_000, 0))
    assert few == many and [(i, html) for i, _, html in few] == [(0, "a.html"), (1, "b/x.html")]
    with pytest.raises(PySparkException, match="PATH_NOT_FOUND"):
        list_corpus(spark, str(tmp_path / "none"), max_listed=0)
    assert [r["text"] for r in read_html_corpus(spark, str(root / "d*" / "er"), max_listed=0).select(F.substring("text", 4, 99).alias("text")).collect()] == [
        "deep/er/y.html"]


def test_large_files_are_read_in_batches_of_bounded_bytes(spark, tmp_path):
    texts = {f"{i}.html": str(i) * (ARROW_BYTES // 2 + i) for i in range(7)}
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    read = read_html_corpus(spark, str(tmp_path), max_listed=0)
    assert {r["source"].rsplit("/", 1)[-1]: r["text"] for r in read.coalesce(1).collect()} == texts
    (tmp_path / "3.html").unlink()
    with pytest.raises(PySparkException, match="3.html"):
        read.collect()


def test_files_become_an_index(spark, tmp_path):
    root = tmp_path / "docs.ray.io" / "en"
    root.mkdir(parents=True)
    for name in ("b", "a"):
        (root / f"{name}.html").write_text(f'<section id="s">{name} text</section>')
    rows = build_index(pages_from_files(spark, str(tmp_path)), IndexConfig(model="hash-16")).orderBy("id").collect()
    assert [(r["id"], r["source"], r["text"]) for r in rows] == [
        (i << 28, f"https://docs.ray.io/en/{n}.html#s", f"{n} text") for i, n in enumerate("ab")]


def test_page_numbers(spark):
    rows = spark.createDataFrame([(f"s{i % 40:02d}",) for i in range(120)] + [(None,)], "source string").repartition(6)
    numbered = number_pages(rows, start=5)
    assert {r["source"]: r["page_id"] for r in numbered.collect()} == {**{f"s{i:02d}": 5 + i for i in range(40)}, None: None}
    assert numbered.count() == 121


def test_build_write_and_snapshot(spark, tmp_path):
    path, copy = str(tmp_path / "index"), str(tmp_path / "copy")
    report = build_and_write(pages_of(spark), path, CONFIG)
    built = sorted(map(tuple, build_index(pages_of(spark), CONFIG).collect()))
    stored = sorted(map(tuple, read_index(spark, path, *INDEX.names).collect()))
    assert stored == built and len({r[0] for r in built}) == len(built)
    assert (report["pages"], report["sections"], report["chunks"]) == (6, 12, len(built))
    snapshot_index(spark, path, copy)
    assert read_index(spark, copy).columns == ["id", "text", "source"] and read_index(spark, copy).count() == len(built)
    write_if_absent(build_index(pages_of(spark), CONFIG), path)
    assert read_index(spark, path).count() == len(built)
    reset_index(spark, path)
    assert read_index(spark, path).count() == 0


def test_loading_builds_once(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return build_index(pages_of(spark), CONFIG)

    for _ in range(2):
        load_or_build_index(spark, str(tmp_path), "owner/hash-16", 16, 10, 3, build)
    assert len(calls) == 1 and snapshot_path("r", "owner/m", 300, 50) == "r/m_300_50"


def test_bad_rows_stop_the_write(spark, tmp_path):
    rows = hash_embed(spark.createDataFrame([(1, "a", "s")], "id long, text string, source string"), "text", 4)
    with pytest.raises(PySparkException, match="source is NULL"):
        write_index(rows.withColumn("source", F.lit(None).cast("string")), str(tmp_path / "a"))
    with pytest.raises(PySparkException, match="expected a vector of 5"):
        write_index(rows, str(tmp_path / "b"), dim=5)


def test_table(spark, tmp_path):
    for _ in range(2):
        create_index_table(spark, "document_test", str(tmp_path / "t"))
    rows = hash_embed(spark.createDataFrame([(1, "a", "s")], "id long, text string, source string"), "text", 4)
    insert_index(rows, "document_test")
    assert spark.table("document_test").select("id", "text", "source").collect() == [(1, "a", "s")]
    spark.sql("DROP TABLE document_test")


def test_only_new(spark):
    indexed = spark.createDataFrame([("u1#a",), ("u1#b",), ("u4#a",)], "source string")
    new = only_new(pages_of(spark), indexed, "url", F.substring_index("source", "#", 1))
    assert sorted(r["page_id"] for r in new.collect()) == [0, 2, 3, 5]


def test_index_stream_equals_batch(spark, tmp_path):
    source = str(tmp_path / "pages")
    pages_of(spark, PAGES[:3]).write.parquet(source)

    def run():
        index_stream(read_page_stream(spark, source, 1), str(tmp_path / "index"), str(tmp_path / "state"), CONFIG).awaitTermination()
        return sorted(map(tuple, read_index(spark, str(tmp_path / "index"), *INDEX.names).collect()))

    assert run() == sorted(map(tuple, build_index(pages_of(spark, PAGES[:3]), CONFIG).collect()))
    pages_of(spark, PAGES[3:]).write.mode("append").parquet(source)
    assert run() == sorted(map(tuple, build_index(pages_of(spark), CONFIG).collect()))


def test_answer_stream(spark, tmp_path):
    index = build_index(pages_of(spark), CONFIG)
    asked = spark.createDataFrame([(1, "one two"), (2, "four")], "qid long, query string")
    config = AnswerConfig(embedding_model="hash-16", num_chunks=2)

    def run():
        stream = read_question_stream(spark, str(tmp_path / "q"), 1)
        answer_stream(stream, index, fingerprint_model, str(tmp_path / "a"), str(tmp_path / "s"), config=config).awaitTermination()
        return spark.read.json(str(tmp_path / "a"))

    asked.coalesce(1).write.parquet(str(tmp_path / "q"))
    assert run().count() == 2
    asked.withColumn("qid", F.col("qid") + 10).coalesce(1).write.mode("append").parquet(str(tmp_path / "q"))
    assert sorted(r["qid"] for r in run().select("qid").collect()) == [1, 2, 11, 12]
    assert "batch_id" in run().columns


def test_log_and_names(spark, tmp_path):
    rows = spark.createDataFrame([("q", [1], "m", "a")], "question string, document_ids array<long>, llm string, answer string")
    append_answer_log(rows, str(tmp_path / "log"), "finished chat query")
    row = spark.read.json(str(tmp_path / "log")).first()
    assert (row["event"], row["query"], row["document_ids"]) == ("finished chat query", "q", [1]) and row["ts"]
    assert evaluation_name("e", "Owner/GPT-4") == "e_gpt-4"


def test_arrow_batches_are_bounded_by_bytes(spark):
    prepare(spark)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], names=["rows", "bytes"])

    pages = spark.range(60).selectExpr("repeat('x', 100000) AS html").repartition(1)
    assert max(r["bytes"] for r in pages.mapInArrow(sizes, "rows long, bytes long").collect()) < ARROW_BYTES + 2 * 100_000
    large = spark.range(3).selectExpr(f"repeat('x', {2 * ARROW_BYTES}) AS html").repartition(1)
    assert [r["rows"] for r in large.mapInArrow(sizes, "rows long, bytes long").collect()] == [1, 1, 1]
