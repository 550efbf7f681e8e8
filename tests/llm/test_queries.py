import pytest

import __spark_entry__ as entry
from mnemoframe.llm import queries
from tests.oracle import same


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(name, spark, small):
    same(queries.QUERIES[name], queries.ORACLES[name], spark, small)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_whole_table(name, spark, small):
    tables = {"op1_html_text_density": ("pages", "page_id"), "op12_jacobi_whitening": ("embeddings", "vec_id")}
    table, key = tables.get(name, ("documents", "doc_id"))
    out = queries.QUERIES[name](spark, small)
    if name.startswith("op7_"):  # pages as well, with an id of their own
        assert out.filter("is_page").count() == spark.read.parquet(f"{small}/pages.parquet").count()
        out = out.filter("NOT is_page")
    assert out.select(key).distinct().count() == spark.read.parquet(f"{small}/{table}.parquet").select(key).distinct().count()


def test_registered():
    have = entry.queries()
    assert {n.split("_")[0] for n in have if n.startswith("op")} == {f"op{i}" for i in range(1, 14)}
    assert "pipeline" in have
