"""Every registered query with SQL gives the rows of its SQL; the entry file holds without the llm parts."""

import re
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry
from stratalog.plans import catalog

from .oracle import compare, connect

ROOT = Path(__file__).resolve().parents[1]


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_equals_sql(name, spark, sf, con):
    compare(spark, con, name, catalog.QUERIES[name], catalog.SQL[name], sf)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_library_does_not_import_llm():
    for p in (ROOT / "stratalog").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT / "stratalog").parts:
            assert not re.search(r"\bllm\b", p.read_text()), p


def test_entry_without_llm(tmp_path):
    import shutil

    shutil.copytree(ROOT / "stratalog", tmp_path / "stratalog", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') for n in q) and 'pipeline' not in q"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
