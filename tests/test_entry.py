"""The contract's module imports with and without the optional subpackage, and every SQL belongs to a query."""

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
CHECK = """
import importlib.abc, sys
class Hide(importlib.abc.MetaPathFinder):
    def find_spec(self, name, path=None, target=None):
        if name in {"hide": ("corpus_pipeline", "retrova.llm"), "broken": ("retrova.llm.tokens",)}.get(sys.argv[1], ()):
            raise ModuleNotFoundError(name, name=name)
if sys.argv[1] != "show":
    sys.meta_path.insert(0, Hide())
import __spark_entry__ as e
q, o = e.queries(), e.oracle_sql()
assert set(o) <= set(q) and "knn_exact" in q
print(len(q))
"""


def count(mode):
    return int(subprocess.run([sys.executable, "-c", CHECK, mode], cwd=ROOT, capture_output=True, text=True, check=True).stdout.split()[-1])


def test_queries_with_and_without_the_subpackage():
    assert count("hide") >= 60 and count("show") >= count("hide")


def test_a_broken_module_of_the_subpackage_is_told():
    with pytest.raises(subprocess.CalledProcessError):
        count("broken")


def test_nothing_else_imports_the_subpackage():
    for path in (ROOT / "retrova").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "llm" not in path.read_text(), path
