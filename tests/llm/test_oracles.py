"""Queries of the subpackage against their SQL, and what all of them return."""

import duckdb
import pytest

import corpus_pipeline
from cuespark.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "embeddings"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    cur = con.execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    want = [tuple(str(r[names.index(c)]) for c in columns) for r in cur.fetchall()]
    assert sorted(names) == columns
    assert sorted(tuple(str(r[c]) for c in columns) for r in df.collect()) == sorted(want)


def test_ten_queries_and_five_stages():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert len(corpus_pipeline.STAGES) == 5


def test_entry_works_without_the_subpackage(tmp_path):
    """A copy of the repository without the folders and the pipeline still imports."""
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))
    shutil.copytree(f"{root}/cuespark", tmp_path / "cuespark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert len(e.queries()) > 100 and not any(n.startswith('op1') for n in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
