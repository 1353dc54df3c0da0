"""Reading and writing the tables between stages."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas as S
from ..durable import setting
from ..errors import RetrievalError
from ..functions.vectors import finite


def pdf_files(spark: SparkSession, folder: str) -> DataFrame:
    """(file, content, sha256) of a folder's PDF files, by name. None is an error."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(folder)
    if df.select("path").isEmpty():
        raise FileNotFoundError(f"no PDF files in {folder}")
    return df.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content", F.sha2("content", 256).alias("sha256"))


def pdf_layout(files: DataFrame, parse) -> DataFrame:
    """Layout rows of PDF files. `parse(bytes)` yields (page, raw_text, blocks, tables) and comes from the caller, as
    no PDF library is part of this package; layouts that were parsed elsewhere are read by layout_json()."""
    import pandas as pd

    def run(batches):
        for pdf in batches:
            rows = [(f, *page) for f, content in zip(pdf["file"], pdf["content"], strict=True) for page in parse(content)]
            yield pd.DataFrame(rows, columns=["file", "page", "raw_text", "blocks", "tables"])

    return files.select("file", "content").mapInPandas(run, S.LAYOUT)


def layout_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(S.LAYOUT).json(path)


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON-lines file with an explicit schema; blank lines are skipped."""
    return spark.read.schema(schema).json(path)


def json_array(spark: SparkSession, path: str, schema: str = S.DOCUMENTS) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def registry(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, S.REGISTRY)


def vector_faults(lines: DataFrame, dim: int, model: str) -> DataFrame:
    """lines (line, value: JSON text) with `fault`, the first check that fails, or null.

    In this order: json, list, length, values (finite, not all zero), model.
    """
    v = F.try_parse_json("value")
    kinds = F.expr("try_variant_get(v, '$.embedding', 'array<variant>')")
    numeric = F.forall("parts", lambda x: F.coalesce(F.schema_of_variant(x).rlike("^(BIGINT|DOUBLE|DECIMAL.*|FLOAT|INT|SMALLINT|TINYINT|BOOLEAN)"), F.lit(False)))
    rows = lines.withColumn("v", v).withColumn("parts", kinds)
    rows = rows.withColumn("embedding", F.transform("parts", lambda x: F.coalesce(F.try_variant_get(x, "$", "double"), F.try_variant_get(x, "$", "boolean").cast("double"))))
    kept = F.expr("try_variant_get(v, '$.embedding_model', 'string')")
    fault = (
        F.when(F.col("v").isNull(), "json")
        .when(F.col("parts").isNull() | ~numeric, "list")
        .when(F.size("parts") != dim, "length")
        .when(~finite(F.col("embedding")), "values")
        .when(kept.isNotNull() & (kept != model), "model")
    )
    return rows.withColumn("fault", fault).drop("v", "parts")


def stored_vectors(spark: SparkSession, path: str, dim: int, model: str) -> DataFrame:
    """Validated vector records of a JSON-lines file, read in splits. The first faulty line, or no rows at all, is an error.

    `ordinal` (file, place of the split, row) has the order of the lines.
    """
    block = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    lines = spark.read.text(path).select(block.alias("line"), "value")
    checked = vector_faults(lines.filter(F.trim("value") != ""), dim, model)
    bad = checked.filter("fault is not null").orderBy("line").select("line", "fault").first()
    if bad:
        # Its number is only counted now: rows of one file and block keep their order, whatever task reads them.
        at = F.struct(F.lit(bad["line"]["file"]).alias("file"), F.lit(bad["line"]["block"]).alias("block"), F.lit(bad["line"]["row"]).alias("row"))
        number = lines.filter((F.col("line.file") == bad["line"]["file"]) & (F.col("line") <= at)).count()
        raise RetrievalError(f"line {number}: the vector record fails the check {bad['fault']!r}")
    rows = checked.select("line", F.from_json("value", S.VECTORS).alias("r"), "embedding")
    if rows.isEmpty():
        raise RetrievalError(f"{path} holds no vectors")
    return rows.select(F.col("line").alias("ordinal"), "r.*", F.col("embedding").alias("_e")).drop("embedding").withColumnRenamed("_e", "embedding")


def latest(df: DataFrame, key: str = "chunk_id", order: str = "ordinal") -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


#: Rows of a part file of chunks: a compressed file is read by one task.
PART_ROWS = 200_000


def write_chunks(chunks: DataFrame, path: str) -> None:
    """One folder for each strategy, of compressed part files: each record holds its passage twice and names all its fields.

    A task writes the files of all strategies side by side, so that it needn't sort its records by strategy, which would
    spill them to disk.
    """
    with setting(chunks.sparkSession, "spark.sql.maxConcurrentOutputFileWriters", str(len(S.STRATEGIES))):
        rows = chunks.write.mode("overwrite").option("ignoreNullFields", "false").option("compression", "gzip").option("maxRecordsPerFile", PART_ROWS)
        rows.partitionBy("chunking_strategy").json(path)


def write_vectors(vectors: DataFrame, path: str) -> DataFrame:
    """Write as Parquet, read again and compare by id: every vector must have come back."""
    vectors.write.mode("overwrite").parquet(path)
    back = vectors.sparkSession.read.parquet(path)
    a, b = (d.select("chunk_id", F.to_json(F.struct("embedding")).alias("e")) for d in (vectors, back))
    if not a.exceptAll(b).isEmpty() or not b.exceptAll(a).isEmpty():
        raise RetrievalError(f"{path} does not give back what was written")
    return back


def _pretty(batches):
    import pyarrow as pa

    first = True
    yield pa.RecordBatch.from_pydict({"value": ["["]})
    for b in batches:
        rows = [json.dumps(json.loads(r), indent=2, ensure_ascii=False) for r in b.column(0).to_pylist()]
        if rows:
            yield pa.RecordBatch.from_pydict({"value": [(r if first and not i else "," + r) for i, r in enumerate(rows)]})
            first = False
    yield pa.RecordBatch.from_pydict({"value": ["]"]})


def write_array(df: DataFrame, path: str) -> None:
    """Document records as pretty JSON arrays, one in each part file, in parallel; json_array() reads the folder."""
    rows = df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))
    rows.mapInArrow(_pretty, "value string").write.mode("overwrite").text(path)


def document_array(df: DataFrame, most: int = 10_000) -> str:
    """One pretty JSON array of at most `most` document records as a text, for people to read; write_array() has no bound."""
    n = df.count()
    if n > most:
        raise ValueError(f"{n} documents are too many for one text; use write_array()")
    return json.dumps([json.loads(r) for r in df.toJSON().collect()], indent=2, ensure_ascii=False)
