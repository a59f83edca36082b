"""The driver's contract, and that the library stands without its training-data parts."""

import ast
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry
from specloom import queries as own

ROOT = Path(__file__).resolve().parent.parent
SF = "/root/testdata/sf0.001"


def test_entry(spark):
    assert entry.entry(spark).columns == ["doc_id", "score"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_else_imports_the_training_data_operators():
    for path in (ROOT / "specloom").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            for node in ast.walk(ast.parse(path.read_text())):
                names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
                assert not any("llm" in n or "corpus_pipeline" in n for n in names), path


def test_entry_without_them(tmp_path):
    import shutil

    shutil.copytree(ROOT / "specloom", tmp_path / "specloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=tmp_path, capture_output=True, text=True)
    assert done.stdout.split() == [str(len(own.QUERIES)), str(len(own.ORACLE_SQL))], done.stderr


@pytest.mark.parametrize("name", ["search_precedence", "search_near", "list_versions", "structural_diff", "reference_extraction", "definition_listing", "api_chunks", "evicted_cache", "paged_text"])
def test_query_equals_its_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        con.execute(f"create view {path.stem} as select * from read_parquet('{path}')")
    found = con.execute(own.ORACLE_SQL[name])
    columns = [d[0] for d in found.description]
    number = lambda v: round(float(v), 6) if isinstance(v, int | float) and not isinstance(v, bool) else v
    want = sorted(str([number(v) for _, v in sorted(zip(columns, row, strict=True))]) for row in found.fetchall())
    got = own.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(str([number(r[c]) for c in sorted(got.columns)]) for r in got.collect()) == want
