"""The rest of the library works where the subpackage `llm` is missing."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent

CODE = """
import sys
sys.modules["inkwell.llm"] = None
import __spark_entry__ as e
names = set(e.queries())
assert {"p1_found", "p5_found", "unit_counts_by_lang"} <= names, names
assert "p2_found" not in names
assert set(e.oracle_sql()) <= names
"""


def test_entry_without_llm():
    done = subprocess.run([sys.executable, "-c", CODE], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr


def test_nothing_else_imports_it():
    for path in (ROOT / "inkwell").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "inkwell.llm" not in path.read_text(encoding="utf-8"), path


def test_the_other_tests_without_both_folders(tmp_path):
    """The rest is copied without the two folders: everything imports, and tests pass."""
    import shutil

    skip = shutil.ignore_patterns("llm", ".git", "__pycache__", ".pytest_cache")
    shutil.copytree(ROOT, tmp_path / "rest", ignore=skip)
    run = lambda *a: subprocess.run([sys.executable, "-m", "pytest", "-q", "-p", "no:cacheprovider", *a], cwd=tmp_path / "rest", capture_output=True, text=True, timeout=600)
    for args in (("tests/", "--collect-only"), ("tests/test_identifiers.py", "tests/test_integrity.py")):
        done = run(*args)
        assert done.returncode == 0, done.stdout + done.stderr
