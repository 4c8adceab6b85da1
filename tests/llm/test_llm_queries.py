import pytest
from conftest import SMALL
from oracle import same

import __spark_entry__
from rookery.llm import queries

#: What the contracts ask of each query, in any order.
COLUMNS = {
    "op1": {"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"},
    "op2": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op3": {"vec_id": "bigint", "n_links": "bigint", "component_id": "bigint", "kept": "boolean"},
    "op4": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
    "op5": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint"},
    "op6": {"doc_id": "bigint", "n_words": "bigint", "n_removed": "bigint", "kept_sha256": "string"},
    "op7": {"doc_id": "bigint", "n_bytes": "bigint", "payload_bytes": "bigint", "payload_sha256": "string", "tail_crc32": "bigint", "media_bytes": "bigint", "media_sha256": "string", "feature": "string"},
    "media": {"doc_id": "bigint", "declared_type": "string", "actual_type": "string", "offset": "bigint", "length": "bigint", "type": "string", "carved_sha256": "string"},
    "op8": {"doc_id": "bigint"},
    "op9": {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"},
    "op10": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
    "op11": {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"},
    "op12": {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"},
    "op13": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"},
}
#: Rows of those that don't give one for each row of their table, on the smallest tables: at most 50 documents for each of 40 items,
#: 8 components of 500 vectors, 5 neighbours of 10 queries.
ROWS = {"op11_lexical": 1_966, "op12_whitening": 4_000, "op13_nearest": 50}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_columns_and_rows(spark, name):
    df = queries.QUERIES[name](spark, SMALL)
    found = dict(df.dtypes)
    assert {c: found.get(c) for c in COLUMNS[name.split("_")[0]]} == COLUMNS[name.split("_")[0]]
    table = "embeddings" if name == "op3_neardup" else "documents"
    assert df.count() == ROWS.get(name, spark.read.parquet(f"{SMALL}/{table}.parquet").count())


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_and_sql_agree(spark, name):
    same(spark, SMALL, queries.QUERIES[name], queries.ORACLE_SQL[name])


def test_entry_adds_them():
    assert {*queries.QUERIES, "pipeline"} <= set(__spark_entry__.queries())
