"""The entry module without the corpus operators: everything else is there."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_without_the_corpus_part(tmp_path):
    shutil.copytree(ROOT / "cadence", tmp_path / "cadence", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert not any(n.startswith('op') or n == 'pipeline' for n in q); assert set(o) <= set(q) and len(q) > 80; print('fine')"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
    assert done.stdout.strip() == "fine", done.stderr


def test_nothing_else_imports_it():
    for path in (ROOT / "cadence").rglob("*.py"):
        if "llm" not in path.parts:
            assert "cadence.llm" not in path.read_text(), path


def test_names_of_sql_are_queries():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
