"""The registered queries on the smallest tables: columns, row counts, reruns and SQL."""

import duckdb
import pytest

from murmuration.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLE = {"op3_warc": "pages", "op4_chat": None, "op6_topk": None, "op9_token_counts": None, "op11_vector_codes": "embeddings", "op12_lexical_search": None, "op13_main_text": "pages"}


@pytest.mark.parametrize("name", QUERIES)
def test_one_row_per_row_and_reruns_agree(spark, name):
    first = sorted(map(str, QUERIES[name](spark, SF).collect()))
    assert first == sorted(map(str, QUERIES[name](spark, SF).collect())) and first
    table = TABLE.get(name, "documents")
    if table:
        assert len(first) == spark.read.parquet(f"{SF}/{table}.parquet").count()


@pytest.mark.parametrize("name", ORACLES)
def test_sql_agrees(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    rows = QUERIES[name](spark, SF)
    cursor = con.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(rows.columns)
    plain = lambda r: tuple(round(x, 6) if isinstance(x, float) else x for x in r)
    assert sorted(map(str, map(plain, rows.select(*names).collect()))) == sorted(map(str, map(plain, cursor.fetchall())))
