import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from semaloom.plans import catalog, sql

FAST = ["tokenize_documents", "vocab_df_idf", "search_auto", "all_pairs_edges", "combined_score", "rri_pass2"]


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", FAST)
def test_oracle(spark, sf_dir, name):
    con = duckdb.connect()
    for t in os.listdir(sf_dir):
        con.sql(f"create view {t.split('.')[0]} as select * from '{sf_dir}/{t}'")
    got = entry.queries()[name](spark, sf_dir).toPandas()
    want = con.sql(entry.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda df: sorted(map(repr, df[columns].itertuples(index=False, name=None)))
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", ["rri_pass1_documents", "rri_pass2_documents"])
def test_enrichment_of_documents(spark, sf_dir, name):
    test_oracle(spark, sf_dir, name)


def test_first_pass_over_documents_makes_no_pairs(spark, sf_dir):
    """No generator makes a row for each pair of neighbours, and no join looks their vectors up row by row."""
    plan = entry.queries()["rri_pass1_documents"](spark, sf_dir)._jdf.queryExecution().toString()
    assert "inline" not in plan and "Join" not in plan


def test_first_pass_over_documents_tokenizes_where_it_packs(spark, sf_dir, monkeypatch):
    """No expression takes a text to pieces: the patterns were two thirds of the query's time."""
    from semaloom.operators import packed

    plans, cut = [], packed.cut
    monkeypatch.setattr(packed, "cut", lambda df: plans.append(df._jdf.queryExecution().toString()) or cut(df))
    entry.queries()["rri_pass1_documents"](spark, sf_dir)
    assert plans and not any("regexp_replace" in p or "split(" in p for p in plans)


def test_describe_functions_has_all_documents(spark, sf_dir):
    """Against the documents' own tokens, counted without Spark."""
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    want = con.sql(f"WITH {sql.documents()} SELECT doc_id, count(*) AS terms FROM post GROUP BY doc_id").fetchall()
    got = [(r["doc_id"], r["terms"]) for r in entry.queries()["describe_functions"](spark, sf_dir).collect()]
    assert sorted(got) == sorted(want) and len(got) > 100


def test_simulated_attention_is_whole(spark, sf_dir, monkeypatch):
    """32 neighbours and 3 rounds, against numpy."""
    import numpy as np

    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").orderBy("vec_id").limit(120).cache()
    monkeypatch.setattr(catalog, "table", lambda *_: rows)
    got = entry.queries()["simulated_attention"](spark, sf_dir)
    x = np.array([r["embedding"] for r in rows.collect()], np.float64)
    for _ in range(3):
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
        sims = u @ u.T
        np.fill_diagonal(sims, -2)
        near = np.argsort(-sims, 1, kind="stable")[:, :32]
        x = 0.7 * x + 0.3 * x[near].mean(1)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = {r["vec_id"]: k for k, r in enumerate(rows.collect())}
    found = np.zeros_like(x)
    for r in got.collect():
        found[ids[r["vec_id"]], r["i"]] = r["x"]
    assert np.abs(found - x).max() < 1e-5


def test_catalogue():
    assert set(catalog.ORACLE_SQL) <= set(catalog.QUERIES)
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_imports_without_optional_parts(tmp_path):
    """The registry works when the optional subpackage and the pipeline are gone."""
    root = os.path.dirname(os.path.abspath(entry.__file__))
    code = (
        "import sys, importlib.abc\n"
        "class Gone(importlib.abc.MetaPathFinder):\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name == 'corpus_pipeline' or name.startswith('semaloom.llm'):\n"
        "            raise ModuleNotFoundError(name=name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "assert 'search_auto' in e.queries() and 'pipeline' not in e.queries() and not any(k.startswith('op1') for k in e.oracle_sql())\n"
    )
    subprocess.run([sys.executable, "-c", code], check=True, cwd=root, timeout=120)
