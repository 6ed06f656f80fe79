"""Registered queries: those with SQL against it, all of them for their columns; the pipeline against plain steps."""

from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as registered
import corpus_pipeline
from millrace.llm.queries import ORACLE_SQL, QUERIES
from millrace.llm.toxicity import fit

from ..oracle import connect, differences
from . import brute

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return connect(SF_DIR)


@pytest.mark.parametrize("key", ORACLE_SQL)
def test_query_agrees_with_sql(spark, connection, key):
    assert differences(spark, connection, SF_DIR, key) is None


def test_every_operator_is_registered():
    assert {k.partition("_")[0] for k in QUERIES} == {f"op{n}" for n in range(1, 14)}
    assert set(QUERIES) | {"pipeline"} <= set(registered.queries())


@pytest.mark.parametrize("key", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_covers_its_whole_table(spark, key):
    source = {"op2": "conversations", "op11": "embeddings"}.get(key.partition("_")[0], "documents")
    whole = spark.read.parquet(f"{SF_DIR}/{source}.parquet")
    found = QUERIES[key](spark, SF_DIR)
    lines = 4 if source == "embeddings" else 1  # one per component
    assert found.count() == lines * whole.count()
    if source == "documents":
        assert sorted(r[0] for r in found.select("doc_id").collect()) == sorted(r[0] for r in whole.select("doc_id").collect())


def test_whitening_query_has_all_vectors_and_types(spark):
    found = QUERIES["op11_embedding_whitening"](spark, SF_DIR)
    whole = spark.read.parquet(f"{SF_DIR}/embeddings.parquet")
    assert found.groupBy("vec_id").count().where("count = 4").count() == whole.select("vec_id").distinct().count()
    kinds = dict(found.dtypes)
    assert [kinds[c] for c in ("component", "n", "deviation", "whitened", "explained", "identity_error")] == ["int", "bigint", "bigint", "double", "double", "double"]
    assert found.agg(F.max("identity_error")).first()[0] < 1e-9 and found.where("deviation IS NULL OR deviation <> exact_deviation").isEmpty()


def test_pipeline_as_plain_steps(spark, tmp_path):
    """The given documents with repeated rows, nulls and a hot source, through each stage and plainly."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").withColumn(
        "source", F.when(F.col("doc_id") % 3 == 0, "src0").otherwise(F.col("source"))
    )
    more = docs.limit(3).unionByName(docs.limit(2).withColumns({"doc_id": F.col("doc_id") + 10_000}))
    odd = spark.createDataFrame([(20_000, None, "en", "src0", None), (20_001, "", "en", None, 0)], docs.schema)
    docs.unionByName(more).unionByName(odd).write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF_DIR}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")

    rows = [tuple(r) for r in docs.collect()]
    model = fit(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    evidence = model.evidence(pa.array([r[1] for r in rows], pa.string()))
    rows = [r for r, x in zip(rows, evidence) if model.slope * x + model.offset < 0]
    toxic_free = len(rows)
    pages, lines = Counter(r[3] for r in rows), defaultdict(int)
    for r in rows:
        for key in {line.strip(" \t\r\x0b\x0c") for line in (r[1] or "").split("\n")} - {""}:
            lines[r[3], key] += 1
    drop = {(s, key) for (s, key), n in lines.items() if s is not None and n >= 5 and n > 0.08 * pages[s]}
    kept = lambda r: "\n".join(x for x in r[1].split("\n") if (r[3], x.strip(" \t\r\x0b\x0c")) not in drop)
    rows = [r if r[1] is None else (r[0], kept(r), *r[2:4], len(kept(r))) for r in rows]
    stays = {i for i, _, _, keep in brute.components([r[:2] for r in rows], 5) if keep}
    rows = list({(r[0], r[1]): r for r in rows if r[0] in stays}.values())
    wanted = brute.windows([(r.item_id, r.text) for r in spark.read.parquet(f"{tmp_path}/benchmark.parquet").collect()])
    rows = [r for r in rows if brute.hits(r[1], wanted)[1] == 0]

    found = corpus_pipeline.run(spark, str(tmp_path))
    assert found.columns == [*docs.columns, "block", "slot", "position"]
    assert Counter(tuple(r) for r in found.select(docs.columns).collect()) == Counter(rows)
    assert found.select("position").distinct().count() == len(rows) < toxic_free < docs.count()
