"""The entry points work with and without the optional subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).parent.parent


def test_entry_without_the_optional_part(tmp_path):
    """A copy of the repository without those folders and the pipeline beside them."""
    for name in ("__spark_entry__.py", "bench.py"):
        shutil.copy(ROOT / name, tmp_path / name)
    shutil.copytree(ROOT / "roadweave", tmp_path / "roadweave", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e, bench; q = e.queries(); assert 'v1_detour' in q and 'pipeline' not in q; assert not any(n.startswith('op') for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)


def test_entry_returns_rows(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_nothing_imports_the_optional_part():
    for p in (ROOT / "roadweave").rglob("*.py"):
        if "llm" not in p.parts:
            assert "llm" not in p.read_text(), p
