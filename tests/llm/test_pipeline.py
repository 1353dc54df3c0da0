"""The pipeline's stages on the smallest tables, each against its operator by brute force, and the queries with SQL."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillspark.llm import queries

SF = "/root/testdata/sf0.001"


def shingles(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def jaccard(a, b):
    return len(a & b) / len(a | b)


pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("_more", F.lit(1))
    extra = docs.filter("doc_id = 1")
    return docs.union(extra).union(extra.withColumn("doc_id", F.lit(None).cast("long"))).union(extra.withColumn("text", F.lit(None).cast("string")).withColumn("doc_id", F.lit(10**6)))


def test_near_duplicates_keep_one_of_each(spark, documents):
    kept = corpus_pipeline.drop_near_duplicates(spark, documents, SF)
    assert kept.columns == documents.columns
    rows = [(r["doc_id"], shingles(r["text"])) for r in kept.collect()]
    assert len({d for d, _ in rows}) == len(rows) and None not in {d for d, _ in rows}
    # What stays is not similar to each other, and what goes is similar to some other document.
    assert all(jaccard(a, b) < 0.8 for i, (_, a) in enumerate(rows) for _, b in rows[:i])
    every = [(r["doc_id"], shingles(r["text"])) for r in documents.collect()]
    gone = [x for x in every if x not in rows]
    assert gone and all(sum(jaccard(x[1], y) >= 0.8 for _, y in every) > 1 for x in gone)


CLASHES = "_key, key, row, rest, doc_row, row_key, fp, c, n, base_email, more_email, m_email, blocks, spans, item_no, seeds, hit, list, own".split(", ")


def test_stages_keep_columns_of_any_name(spark, documents):
    extra = documents.drop("_more").withColumns({c: F.lit(f"{c}!") for c in CLASHES})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, extra, SF)
        assert out.schema.names == extra.schema.names, name
        assert all(r[c] == f"{c}!" for r in out.select(*CLASHES).distinct().collect() for c in CLASHES), name
    assert corpus_pipeline.pack(spark, extra, SF).count() > 0


def test_stages_take_empty_tables(spark, documents):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, documents.limit(0), SF).count() == 0


def test_rows_of_one_id_are_judged_by_their_own_text(spark):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first()["text"]
    clean = " ".join(f"w{i * i % 977}" for i in range(80))
    docs = spark.createDataFrame([(1, clean), (1, f"start {item} end"), (2, clean + " tail"), (1, clean)], "doc_id long, text string")
    assert [tuple(r) for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF).orderBy("text").collect()] == [(1, f"start {item} end"), (1, clean)]
    assert sorted(r["text"] for r in corpus_pipeline.drop_contaminated(spark, docs, SF).collect()) == [clean, clean, clean + " tail"]


def test_decontamination_drops_leaks_alone(spark, documents):
    kept = corpus_pipeline.drop_contaminated(spark, documents, SF)
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    left = [r["text"] for r in kept.collect()]
    leaks = [r["text"] for r in documents.collect() if r["text"] and any(i in r["text"] for i in items)]
    assert leaks and not set(left) & set(leaks)
    assert len(left) >= documents.count() - len(leaks) - 2


def test_redaction_and_toxicity_keep_columns(spark, documents):
    out = corpus_pipeline.redact(spark, documents, SF)
    assert out.columns == documents.columns and out.count() == documents.count()
    assert out.filter("text is not null and n_chars <> length(text)").count() == 0
    assert out.filter(F.col("text").rlike("[0-9]@mail")).count() == 0
    assert corpus_pipeline.drop_toxic(spark, documents, SF).columns == documents.columns


def test_run(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "pii", "packing"]
    got = corpus_pipeline.run(spark, SF)
    assert got.count() > 0 and got.filter("offset + length > 1024").count() == 0


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    mine = queries.QUERIES[name](spark, SF)
    theirs = con.execute(queries.SQL[name])
    names = [d[0] for d in theirs.description]
    columns = sorted(mine.columns)
    assert sorted(names) == columns
    rows = [tuple(r[names.index(c)] for c in columns) for r in theirs.fetchall()]
    assert sorted(map(repr, (tuple(r[c] for c in columns) for r in mine.collect()))) == sorted(map(repr, rows))
