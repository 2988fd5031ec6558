"""The driver's entry without the subpackage of training-data operators."""

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
CODE = """
import importlib.abc, sys

class Away(importlib.abc.MetaPathFinder):
    def find_spec(self, name, path=None, target=None):
        if name in {away!r}:
            raise ModuleNotFoundError(f"No module named {{name!r}}", name=name)

sys.meta_path.insert(0, Away())
import __spark_entry__ as e

names = e.queries()
assert len(names) > 90 and "longest_nonoverlap" in names
assert not [k for k in names if k.startswith("op") or k == "pipeline"], names
assert set(e.oracle_sql()) <= set(names)
assert not [m for m in sys.modules if m.startswith("ontoloom.llm.")]
"""


@pytest.mark.parametrize("away", [("ontoloom.llm", "ontoloom.llm.queries"), ("ontoloom.llm", "corpus_pipeline")])
def test_without_llm(away):
    subprocess.run([sys.executable, "-c", CODE.format(away=away)], cwd=ROOT, check=True)


def test_without_tokenizers():
    code = CODE.format(away=("public_tokenizers",)).rsplit("\nassert not [m", 1)[0]
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_core_never_imports_llm():
    for path in (ROOT / "ontoloom").rglob("*.py"):
        if "llm" not in path.parts:
            assert ".llm" not in path.read_text(), path
