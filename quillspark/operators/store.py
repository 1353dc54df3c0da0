"""A collection of vectors: a Parquet folder, bucketed by id, and a properties file, opened through Spark's file systems.

Appends are not transactions; there is one writer at a time. A path that is being read is never overwritten.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..durable import cut
from ..errors import StorageError
from .index import GraphIndex

#: Buckets of a collection's rows, by the hash of their id.
BUCKETS = 16
#: Metadata fields that a flat store keeps as JSON text.
NESTED = ("token_info", "tables", "params")


@dataclass
class IngestReport:
    loaded: int
    inserted: int
    skipped: int
    count_after: int


class Collection:
    """Opened by get-or-create. Searching by a bare text needs an embedder of the caller's: there is no hidden one."""

    def __init__(self, spark: SparkSession, path: str, metric: str = "cosine", key: str = "chunk_id", indexed: bool = False):
        self.spark, self.path, self.metric, self.key = spark, path.rstrip("/"), metric, key
        #: What is ingested is added to it, if the collection is opened as an indexed one.
        self.index = GraphIndex(spark, f"{self.path}/index", key) if indexed else None
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self._path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        self._fs = self._path(self.path).getFileSystem(conf)
        meta = self._path(f"{self.path}/collection.json")
        if self._fs.exists(meta):
            have = json.loads("".join(r["value"] for r in spark.read.text(f"{self.path}/collection.json").collect()))["metric"]
            if have != metric:
                raise StorageError(f"the collection uses {have}, not {metric}; reset it to change that")
        else:
            self._fs.mkdirs(self._path(self.path))
            out = self._fs.create(meta)
            out.write(bytearray(json.dumps({"metric": metric}).encode()))
            out.close()

    @property
    def _data(self) -> str:
        return f"{self.path}/data"

    @property
    def _table(self) -> str:
        return f"quillspark_{hashlib.md5(self.path.encode()).hexdigest()}"

    def _opened(self, ddl: str) -> str:
        """The name of the stored rows as a table of this session, bucketed by the key, so that joins on it need no exchange of them."""
        if not self.spark.catalog.tableExists(self._table):
            place = self._data.replace("'", "\\'")
            self.spark.sql(f"CREATE TABLE {self._table} ({ddl}) USING parquet CLUSTERED BY (`{self.key}`) INTO {BUCKETS} BUCKETS LOCATION '{place}'")
        return self._table

    def rows(self) -> DataFrame | None:
        if not self._fs.exists(self._path(f"{self._data}/_SUCCESS")):
            return None
        name = self._opened(self.spark.read.parquet(self._data).schema.toDDL())
        self.spark.catalog.refreshTable(name)
        return self.spark.table(name)

    def count(self) -> int:
        rows = self.rows()
        return rows.count() if rows is not None else 0

    def existing(self, ids: DataFrame) -> DataFrame:
        rows = self.rows()
        return ids.limit(0) if rows is None else ids.join(rows.select(self.key).hint("merge"), self.key, "left_semi")

    def fresh(self, records: DataFrame) -> DataFrame:
        """The records whose id is not stored: they are dealt by the buckets of the stored rows, which stay where they are."""
        rows = self.rows()
        return records if rows is None else records.join(rows.select(self.key).hint("merge"), self.key, "left_anti").select(*records.columns)

    def ingest(self, records: DataFrame) -> IngestReport:
        """Add the records whose id is new. Ids that repeat among the records are an error. The records are evaluated once."""
        records = cut(records)
        loaded, different = records.agg(F.count(F.lit(1)), F.count_distinct(F.struct(self.key))).first()
        if different != loaded:
            raise StorageError("ids repeat among the records")
        have = self.count()
        new = cut(self.fresh(records))
        name = self._opened(records.schema.toDDL())
        # Rows are inserted by place, so columns come in the order of the stored ones; what a record lacks is null.
        stored = self.spark.table(name).schema
        if other := set(records.columns) - set(stored.names):
            raise StorageError(f"the collection has no columns {', '.join(sorted(other))}")
        placed = [F.col(f"`{f.name}`") if f.name in records.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in stored]
        # One file for each bucket: what is written is dealt as the buckets are.
        new.select(*placed).repartition(BUCKETS, self.key).write.insertInto(name)
        if self.index is not None:
            self.index.add(new)
        after = self.count()
        return IngestReport(loaded, after - have, loaded - (after - have), after)

    def reset(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self._table}")
        for part in (self._data, f"{self.path}/index"):
            self._fs.delete(self._path(part), True)


def flatten_metadata(df: DataFrame) -> DataFrame:
    """Nested fields as JSON text, nulls kept inside it, so that the way back is exact."""
    return df.withColumns({c: F.to_json(F.col(c), {"ignoreNullFields": "false"}) for c in NESTED if c in df.columns})


def rebuild_metadata(df: DataFrame, schema) -> DataFrame:
    return df.withColumns({c: F.from_json(F.col(c), schema[c].dataType) for c in NESTED if c in df.columns})
