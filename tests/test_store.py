import json

import pytest
from pyspark.sql import functions as F

from semaloom.config import EngineConfig, Mode
from semaloom.operators import metrics
from semaloom.operators.corpus import CorpusBuilder
from semaloom.operators.search import search
from semaloom.sources import files, store
from semaloom.sources.token_vectors import DigestVectors
from semaloom.streaming.scoring import score_stream

from test_corpus import DEMO


@pytest.fixture(scope="module", params=[0, 4])
def saved(request, spark, tmp_path_factory):
    docs = spark.createDataFrame([(i, t.split(), f"src/file_{i}.c") for i, t in enumerate(DEMO)], "doc_id long, tokens array<string>, label string")
    corpus = CorpusBuilder(spark, EngineConfig.of(16, sparse_nnz=request.param)).add_tokens(docs).finalize(DigestVectors(16))
    folder = str(tmp_path_factory.mktemp("store") / "corpus")
    store.save(corpus, folder)
    return corpus, folder


def ask(spark):
    return spark.createDataFrame([(0, "handle request file buffer")], "query_id long, text string")


def test_round_trip(spark, saved):
    corpus, folder = saved
    again = store.load(spark, folder)
    for mode in Mode:
        a, b = search(corpus, ask(spark), 8, mode), search(again, ask(spark), 8, mode)
        assert metrics.differences(a, b).count() == 0 and a.count() > 0
    assert again.label(search(again, ask(spark), 8)).filter("label is null").count() == 0
    assert again.config == corpus.config and again.doc_vectors.exceptAll(corpus.doc_vectors).count() == 0
    assert again.token("file").count() == 1 and again.token("nothing").count() == 0


def test_save_again(spark, saved):
    corpus, folder = saved
    store.save(corpus, folder)
    assert store.load(spark, folder).n_docs == 10


@pytest.mark.parametrize("table,change", [
    ("vocab", lambda df: df.withColumn("df", F.lit(99).cast("long"))),
    ("vocab", lambda df: df.withColumn("idf", F.lit(float("nan")))),
    ("vocab", lambda df: df.unionByName(df.limit(1))),
    ("enriched", lambda df: df.withColumn("q", F.slice("q", 1, 3))),
    ("doc_vectors", lambda df: df.withColumn("inv_mag", F.lit(-1.0))),
    ("doc_vectors", lambda df: df.limit(3)),
    ("postings", lambda df: df.unionByName(df.limit(1))),
    ("postings", lambda df: df.withColumn("doc_id", F.col("doc_id") + 5)),
    ("postings", lambda df: df.withColumn("token", F.lit("zz"))),
    ("forward", lambda df: df.withColumn("terms", F.slice("terms", 1, 1))),
    ("doc_mean", lambda df: df.withColumn("mean", F.array(F.lit(1.0)))),
    ("labels", lambda df: df.limit(2)),
    ("about", lambda df: df.withColumn("value", F.lit("{}"))),
    ("about", lambda df: df.withColumn("value", F.regexp_replace("value", '"version": 4', '"version": 2'))),
])
def test_corruption(spark, saved, tmp_path, table, change):
    import shutil

    _, folder = saved
    bad = str(tmp_path / "bad")
    shutil.copytree(folder, bad)
    whole, folder, bad = bad, store.current(spark, folder), store.current(spark, bad)
    read = (lambda p: spark.read.text(p)) if table == "about" else (lambda p: spark.read.parquet(p))
    changed = change(read(f"{folder}/{table}"))
    shutil.rmtree(f"{bad}/{table}")
    changed.write.text(f"{bad}/{table}") if table == "about" else changed.write.parquet(f"{bad}/{table}")
    with pytest.raises(store.CorpusFormatError):
        store.load(spark, whole)


def test_a_writer_that_dies_leaves_the_old_corpus(spark, saved, tmp_path, monkeypatch):
    import shutil

    corpus, folder = saved
    shutil.copytree(folder, kept := str(tmp_path / "kept"))
    monkeypatch.setattr(store, "json", None)
    with pytest.raises(AttributeError):
        store.save(corpus, kept)
    monkeypatch.undo()
    assert store.load(spark, kept).n_docs == 10


def test_missing(spark, tmp_path):
    with pytest.raises(store.CorpusFormatError):
        store.load(spark, str(tmp_path / "none"))


def test_source_files(spark, tmp_path):
    for name, raw in {"a.c": b"int f() { return 1; }\nint g() { return 2; }", "__init__.py": b"x = 1", ".hidden.c": b"no", "notes.txt": b"no", "empty.c": b"", "sub/deep.rs": b"fn main() {}", ".git/x.c": b"no"}.items():
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_bytes(raw)
    (tmp_path / "link.c").symlink_to(tmp_path / "a.c")
    got = files.source_files(spark, str(tmp_path))
    assert {r["path"].removeprefix(str(tmp_path) + "/") for r in got.collect()} == {"a.c", "__init__.py", "sub/deep.rs"}
    parts = files.chunked(got, 5)
    counts = {r["path"].rsplit("/", 1)[1]: r["n"] for r in files.chunk_counts(got, parts).collect()}
    assert counts == {"a.c": 2, "__init__.py": 1, "deep.rs": 1}
    docs = parts.withColumn("doc_id", F.xxhash64("path", "chunk_no"))
    assert CorpusBuilder(spark, EngineConfig.of(16)).add_chunks(docs).finalize(DigestVectors(16)).n_docs == 3  # "x = 1" has no token


def test_jsonl(spark, tmp_path):
    path = tmp_path / "docs.jsonl"
    path.write_text("\n".join(json.dumps({"id": i, "path": f"p{i}", "text": t}) for i, t in enumerate(DEMO)))
    docs = files.jsonl(spark, str(path))
    assert docs.columns == ["doc_id", "label", "text"] and docs.count() == 10


def test_dump(spark, saved, tmp_path):
    corpus, _ = saved
    store.dump(search(corpus, ask(spark), 3), str(tmp_path / "dump"))
    lines = [r[0] for r in spark.read.text(str(tmp_path / "dump")).collect()]
    assert len(lines) == 3 and all(len(x.split()) == 4 for x in lines)


def test_stream(spark, saved, tmp_path):
    corpus, _ = saved
    source = str(tmp_path / "in")
    spark.createDataFrame([(7, "open file read"), (8, "memory page")], "doc_id long, text string").write.parquet(source)
    got = []
    stream = spark.readStream.schema("doc_id long, text string").parquet(source)
    score_stream(stream, corpus, 2, lambda df, n: got.extend(df.collect()), str(tmp_path / "state")).awaitTermination(60)
    assert {r["query_id"] for r in got} == {7, 8}
