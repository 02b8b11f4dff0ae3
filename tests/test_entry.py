import importlib
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(entry.__file__).parent


def test_names_and_oracles():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 150


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and df.columns == ["ticker", "quarter", "fiscal_year", "score", "qoq", "yoy"]


def test_imports_without_the_llm_subpackage():
    code = "import sys; sys.modules['quartermark.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert len(q) > 150 and not any(k.startswith('op') for k in q)"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_nothing_else_imports_the_llm_subpackage():
    for path in (ROOT / "quartermark").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "llm" not in path.read_text(), path


def test_bench_names_are_queries():
    bench = importlib.import_module("bench")
    own = {n for n in bench.HEADLINE if not n.startswith("op") and n != "pipeline"}  # those may be absent with their subpackage
    assert own <= set(entry.queries())
