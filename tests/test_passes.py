"""Texts without headings, chunks of all strategies in one pass, and bounded slices of batches."""

import pyarrow as pa
from pyspark.sql import functions as F

from quillspark.operators import batches, chunking, corpus, quality
from quillspark.plans import queries


def order(k, rows):
    table = "\n".join(f"| {i} | {i} | A |" for i in range(1, rows + 1))
    return (f"o{k}", f"1. Summary:\nOrder {k} has lines.\n2. Line items:\na. Detail\n| no | quantity | flag |\n| --- | --- | --- |\n{table}\n3. Notes:\nNone.")


def test_prose_has_no_headings(spark):
    """A text of one line that looks like a title is a chunk of the document itself (F6, F8)."""
    docs = spark.createDataFrame([(1, "Ered. pathetic loser"), (2, "First words. More of them.")], "doc_id long, text string")
    got = chunking.chunk(queries.as_documents(docs, "doc_id", "prose"), "fixed").orderBy("chunk_id").collect()
    assert [r["section"] for r in got] == ["1", "2"]


def test_one_pass_for_all_strategies(spark):
    docs = spark.createDataFrame([order(k, 3 + 40 * (k % 2)) for k in range(6)], "doc string, text string")
    docs = queries.as_documents(docs, "doc", "sop")
    own = chunking.chunk_all(docs, section_most=120, table_most=200)
    outlined = chunking.with_outline(docs)
    apart = [chunking.records(chunking.units(outlined, s, section_most=120, table_most=200), s, section_most=120, table_most=200) for s in ("fixed", "recursive", "section")]
    as_json = lambda df: sorted(r[0] for r in df.select(F.to_json(F.struct("*"))).collect())
    assert as_json(own) == as_json(apart[0].unionByName(apart[1]).unionByName(apart[2]))
    # The documents are read once for all strategies.
    assert own._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1


def test_overlaps_of_few_and_many_chunks(spark, monkeypatch):
    docs = spark.createDataFrame([order(k, 3 + 40 * (k % 2)) for k in range(6)], "doc string, text string")
    chunks = chunking.chunk_all(queries.as_documents(docs, "doc", "sop"), section_most=120, table_most=200).localCheckpoint()
    want = sorted(map(tuple, quality.content_overlaps(chunks).collect()))
    monkeypatch.setattr(quality, "FEW", 0)
    assert want == sorted(map(tuple, quality.content_overlaps(chunks).collect())) and len(want) > 18


def test_regions_by_marks_and_by_lines(spark):
    texts = ["", "\n", "a", "| a |", "a\n| b |\n| c |\n\nd\n", "| a |\n\n| b |", "  \n| a |\nx\n|\n", "\n\n a \n|b", "a\r\n|b|\r\nc", "| a |\n" * 3000 + "x"]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select(corpus._regions_by_marks(F.col("t")).alias("a"), corpus._regions_by_lines(F.col("t")).alias("b")).collect()
    assert all(r["a"] == r["b"] for r in got)


def test_slices_are_bounded():
    texts = ["x" * 1000] * 500 + [None, "y" * 9000, "z"]
    batch = pa.RecordBatch.from_pydict({"k": list(range(len(texts))), "text": texts})
    got = list(batches.slices([batch, batch.slice(0, 0)], "text", 4000, 100))
    assert [k for b in got for k in b.column(0).to_pylist()] == list(range(len(texts)))
    assert max(b.num_rows for b in got) == 4 or all(b.num_rows <= 100 for b in got)
    assert all(sum(len(t or "") for t in b.column(1).to_pylist()) <= 4000 or b.num_rows == 1 for b in got)
