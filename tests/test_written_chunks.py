"""Chunks on disk: small, whole, and written without a sort by strategy."""

import os

from pyspark.sql import functions as F

from quillspark import schemas as S
from quillspark.operators import chunking
from quillspark.plans import queries
from quillspark.sources import files

KEY = "spark.sql.maxConcurrentOutputFileWriters"


def test_written_chunks_are_small_and_whole(spark, tmp_path, monkeypatch):
    rows = "\n".join(f"| {i} | {i % 50} | A |" for i in range(1, 5))
    docs = spark.range(600).select(F.concat(F.lit("o"), "id").alias("doc"), F.concat(F.lit("1. Summary:\nOrder "), "id", F.lit(f" has lines.\n2. Line items:\na. Detail\n| no | quantity | flag |\n| --- | --- | --- |\n{rows}\n3. Notes:\nNone.")).alias("text"))
    chunks = chunking.chunk_all(queries.as_documents(docs, "doc", "sop")).localCheckpoint()
    seen = []
    made = files.setting
    monkeypatch.setattr(files, "setting", lambda spark, key, value: seen.append((key, value)) or made(spark, key, value))
    monkeypatch.setattr(files, "PART_ROWS", 500)
    before = spark.conf.get(KEY, None)
    path = str(tmp_path / "chunks")
    files.write_chunks(chunks, path)
    # No sort: a task has a writer for each strategy. Other writes of the session are as before.
    assert seen == [(KEY, "3")] and spark.conf.get(KEY, None) == before
    found = [f"{d}/{f}" for d, _, names in os.walk(path) for f in names if f.startswith("part-")]
    assert {os.path.basename(os.path.dirname(f)) for f in found} == {f"chunking_strategy={s}" for s in S.STRATEGIES}
    raw = chunks.agg(F.sum(F.length(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})))).first()[0]
    assert sum(os.path.getsize(f) for f in found) < 0.2 * raw
    back = files.jsonl(spark, path, S.CHUNKS)
    assert {r["count"] for r in back.groupBy(F.input_file_name()).count().collect()} <= set(range(1, 501)) and len(found) > 6
    as_json = lambda df: sorted(r[0] for r in df.select(F.to_json(F.struct(*chunks.columns))).collect())
    assert as_json(back) == as_json(chunks)
