"""The commands from layouts to a search, the PDF adapter by a stand-in library, and models loaded in workers."""

import json
import sys
import types

import pytest
from pyspark.sql import functions as F

from quillspark import cli
from quillspark.errors import RetrievalError
from quillspark.operators import embedding
from quillspark.sources import files


def test_from_layouts_to_a_search(spark, tmp_path, capsys):
    line = lambda y, t: {"x0": 1.0, "y0": y, "x1": 90.0, "y1": y + 10, "text": t}
    rows = [{"file": "Night Shift.pdf", "page": p, "raw_text": "", "blocks": [{"lines": [line(50.0, f"Section {p}")]}, {"lines": [line(90.0, "allowance words here. " * 30)]}], "tables": []} for p in (1, 2)]
    (tmp_path / "layout.json").write_text("\n".join(map(json.dumps, rows)))
    at = lambda name: str(tmp_path / name)
    run = lambda *a: cli.main(list(a), spark)
    assert run("pages", at("layout.json"), at("pages")) == 0
    assert run("chunk", at("pages"), at("chunks")) == 0
    assert run("check", at("chunks"), "--pages", at("pages")) == 0
    assert run("compare", at("chunks"), at("pages"), "--doc", "night", "--section", "section 1", "--row", "allowance", "--header", "Section") == 0
    assert run("embed", at("chunks"), at("vectors")) == 0
    assert run("search", at("store"), "words") == 2
    assert run("ingest", at("vectors"), at("store")) == 0 and run("ingest", at("vectors"), at("store")) == 0
    assert run("search", at("store"), "allowance", "words", "--method", "both", "--top-k", "2") == 0
    assert run("compare", at("chunks"), at("pages"), "--overlaps", "--unprotected") == 0
    assert run("ingest", at("vectors"), at("indexed"), "--indexed") == 0 and run("search", at("indexed"), "allowance", "words", "--indexed") == 0
    assert run("graph", at("store"), at("graph"), "--k", "1") == 0
    out = capsys.readouterr().out
    assert "documents=1" in out and "skipped 2" in out and "section-night-shift-00" in out and "of the variance kept" in out
    assert "Chunks that overlap each section" in out and "Windows over tables" in out and "Cosine distance, by the index" in out
    assert "chunking_strategy=section" in out and "has_header=True" in out
    assert spark.read.parquet(at("graph/edges")).count() == 1


def test_pdf_adapter(spark, monkeypatch):
    from quillspark.sources.pdf import parse_pdf

    monkeypatch.setitem(sys.modules, "pymupdf", None)
    with pytest.raises(ImportError, match="pymupdf"):
        list(parse_pdf(b""))

    class Page:
        def get_text(self, kind="text"):
            span = lambda t: {"text": t}
            return "raw" if kind == "text" else {"blocks": [{"image": 1}, {"lines": [{"bbox": (0, 1, 2, 3), "spans": [span("a"), span("b")]}]}]}

        def find_tables(self):
            return types.SimpleNamespace(tables=[types.SimpleNamespace(bbox=(0, 0, 9, 9), extract=lambda: [["x", None]])])

    class File(list):
        __enter__, __exit__ = lambda self: self, lambda self, *a: None

    monkeypatch.setitem(sys.modules, "pymupdf", types.SimpleNamespace(open=lambda stream, filetype: File([Page(), Page()])))
    got = list(parse_pdf(b"x"))
    assert [g[0] for g in got] == [1, 2] and got[0][2][0]["lines"][0]["text"] == "ab" and got[0][3][0]["rows"] == [["x", ""]]


def test_a_model_is_made_once_in_a_worker(spark, tmp_path):
    folder = str(tmp_path)

    def load():
        import os
        import uuid

        open(os.path.join(folder, uuid.uuid4().hex), "w").close()

        class Model:
            def encode(self, texts):
                return [[float(len(t)), 1.0] for t in texts]

            def count(self, text):
                return len(text.split()), len(text)

        return Model()

    df = spark.createDataFrame([(i, "word " * i) for i in range(200)], "i int, embedding_text string").repartition(8)
    rows = embedding.embed(df, embedding.WorkerModel("m", 2, load, 9))
    assert rows.filter(F.col("embedding")[0] != F.length("embedding_text")).count() == 0
    assert rows.filter("token_info.truncated").count() == 190
    import os

    # 16 tasks so far; workers live on from task to task, and Spark starts a few more than run at a time.
    assert 1 <= len(os.listdir(folder)) <= 8
    with pytest.raises(Exception, match="dimensions"):
        embedding.WorkerModel("n", 3, load).embed(["x"])
    with pytest.raises(RetrievalError):
        embedding.WorkerModel("n", 3, load).embed(["x"])


def test_arrays_of_documents(spark, tmp_path):
    df = spark.createDataFrame([(f"d{i}", None if i % 2 else "é") for i in range(40)], "doc string, title string").repartition(3)
    files.write_array(df, str(tmp_path / "a"))
    parts = [json.loads(p.read_text()) for p in (tmp_path / "a").glob("part-*")]
    assert len(parts) == 3 and sorted(r["doc"] for p in parts for r in p) == sorted(f"d{i}" for i in range(40))
    assert files.json_array(spark, str(tmp_path / "a"), "doc string, title string").filter("title = 'é'").count() == 20


def test_lines_of_a_split_file_are_numbered(spark, tmp_path):
    record = lambda v: json.dumps({"chunk_id": "c", "text": "t", "embedding": v, "embedding_model": None})
    path = tmp_path / "v.jsonl"
    path.write_text("\n".join([record([0.5, 0.5])] * 5000 + [""] + [record([0.0, 0.0])] + [record([1.0])] * 3000))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        with pytest.raises(RetrievalError, match="line 5002.*values"):
            files.stored_vectors(spark, str(path), 2, "m")
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
