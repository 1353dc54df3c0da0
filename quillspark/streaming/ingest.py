"""Extension: pages that keep arriving as JSON lines are chunked, embedded and added to a collection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .. import schemas as S
from ..operators import chunking, corpus, embedding
from ..operators.store import Collection


def ingest_stream(spark: SparkSession, folder: str, collection: Collection, embedder, checkpoint: str, strategy: str = S.PRIMARY):
    """Start the stream; a document's pages must arrive in one file. Ids that are stored already are skipped, so a
    batch that is run again after a failure adds nothing twice."""
    pages = spark.readStream.schema(S.PAGES).json(folder)

    def add(batch: DataFrame, _: int) -> None:
        vectors = embedding.embed(chunking.chunk(corpus.stitch(batch), strategy), embedder)
        collection.ingest(vectors)

    return pages.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
