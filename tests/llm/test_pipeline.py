import zlib

import corpus_pipeline
import __spark_entry__ as contract
import check
import pytest
from isohyet.llm import queries, quality, secrets
from isohyet.llm.common import remainder

from .test_near_duplicates import brute_components, brute_hits

SF = "/root/testdata/sf0.001"


def test_all_queries_are_registered():
    names = {n.split("_")[0] for n in queries.QUERIES}
    assert names == {f"op{i}" for i in range(1, 14)} and "pipeline" in contract.queries()
    assert set(queries.TWINS) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", sorted(queries.TWINS))
def test_twin(spark, name):
    result = contract.queries()[name](spark, SF)
    cursor = check.connect(SF).execute(queries.TWINS[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(result.columns)
    assert check.plain([tuple(r) for r in result.collect()], result.columns) == check.plain(cursor.fetchall(), columns)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.TWINS)))
def test_one_row_for_each_document(spark, name):
    source, times = {"op8": ("pages", 1), "op13": ("embeddings", 8)}.get(name.split("_")[0], ("documents", 1))  # op13: 8 components
    rows = contract.queries()[name](spark, SF).collect()
    assert len(rows) == times * spark.read.parquet(f"{SF}/{source}.parquet").count()
    modulus = {"op2": (5, 0), "op3": (7, 2), "op6": (5, 0), "op10": (4, 2)}.get(name.split("_")[0])
    if modulus:
        assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % modulus[0] == modulus[1]) for r in rows)


def test_pipeline_stage_by_stage(spark, tmp_path):
    read = lambda n: spark.read.parquet(f"{SF}/{n}.parquet")
    documents = read("documents")
    docs = documents
    model = quality.fit(docs, read("labels").filter(remainder("doc_id", 5) != 0))
    kept = {r["doc_id"] for r in quality.score(docs.select("doc_id", "text"), model).collect() if r["predicted"]}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    components = brute_components([(i, texts[i]) for i in kept])
    kept = {i for i in kept if components[i] == i}
    items = [tuple(r) for r in read("benchmark").select("item_id", "text").collect()]
    judged = {i: brute_hits(texts[i], items) for i in kept}
    kept = {i for i in kept if not (judged[i][1] and 20 * len(judged[i][1]) >= judged[i][0])}
    redacted = {r["doc_id"]: r["text"] for r in secrets.redact(documents.filter(documents.doc_id.isin(list(kept)))).collect()}
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"] for r in rows} == kept and len(rows) == len(kept)
    import hashlib

    assert all(r["round_trip"] and r["decoded_sha256"] == hashlib.sha256((redacted[r["doc_id"]] or "").encode()).hexdigest() for r in rows)
    for (name, stage) in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == documents.columns, name


def test_pipeline_on_empty_tables(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
