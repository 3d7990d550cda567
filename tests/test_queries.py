"""Every query against its SQL on the smallest tables; that every query is listed; and that all of it works without the text operators."""

import decimal
import subprocess
import sys
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from tallyframe.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck(small):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return c


def plain(x):
    if pd.isna(x) is True:
        return ""
    if isinstance(x, float | decimal.Decimal):
        return f"{float(x):.6f}"
    return str(x).removesuffix(" 00:00:00")


def rows(pdf):
    pdf = pdf[sorted(pdf.columns)]
    return list(pdf.columns), sorted(tuple(map(plain, r)) for r in pdf.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_matches_sql(spark, duck, small, name):
    assert rows(catalogue.QUERIES[name](spark, small).toPandas()) == rows(duck.execute(catalogue.ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_query_runs(spark, small, name):
    assert catalogue.QUERIES[name](spark, small).count() > 0


def test_nothing_else_imports_the_text_operators():
    root = Path(__file__).resolve().parents[1] / "tallyframe"
    assert not [str(f) for f in root.rglob("*.py") if "llm" not in f.parts and "tallyframe.llm" in f.read_text()]


def test_entry_works_without_the_text_operators(tmp_path):
    root = Path(__file__).resolve().parents[1]
    copy = tmp_path / "repo"
    ignore = lambda d, names: [n for n in names if n in (".git", "__pycache__", "corpus_pipeline.py") or n == "llm"]
    import shutil

    shutil.copytree(root, copy, ignore=ignore)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') or n == 'pipeline' for n in q if n[2:3].isdigit() or n == 'pipeline'), q; assert set(e.oracle_sql()) <= set(q); print('fine')"
    out = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, timeout=120)
    assert out.stdout.strip() == "fine", out.stderr
