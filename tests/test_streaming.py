"""The streaming extension adds arriving documents once."""

import json

from quillspark.operators.embedding import HashEmbedder
from quillspark.operators.store import Collection
from quillspark.streaming.ingest import ingest_stream


def test_ingest(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    meta = {"page_type": "content", "title": "T"}
    (folder / "a.json").write_text("\n".join(json.dumps({"doc": d, "page": 1, "text": "Some text. " * 20, "metadata": meta}) for d in ("a", "b")))
    store = Collection(spark, str(tmp_path / "store"))
    for _ in range(2):
        ingest_stream(spark, str(folder), store, HashEmbedder(8), str(tmp_path / "state")).awaitTermination()
    assert store.count() == 2
