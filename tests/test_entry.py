"""The driver's entry points with and without the training-data subpackage."""

import re
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
PRINT = "import __spark_entry__ as e; from quillon import queries as q; print(len(e.queries()) - len(q.QUERIES), set(e.oracle_sql()) <= set(e.queries()), 'pipeline' in e.queries())"


def printed(where: Path) -> list[str]:
    return subprocess.run([sys.executable, "-c", PRINT], cwd=where, capture_output=True, text=True, check=True).stdout.split()


@pytest.mark.parametrize("pipeline", [True, False])
def test_entry_without_the_subpackage(tmp_path, pipeline):
    where = tmp_path / "repo"
    shutil.copytree(ROOT, where, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__"))
    if not pipeline:
        (where / "corpus_pipeline.py").unlink(missing_ok=True)
    assert printed(where) == ["0", "True", "False"]


@pytest.mark.skipif(not (ROOT / "quillon/llm/queries.py").exists(), reason="needs the subpackage")
def test_entry_with_the_subpackage():
    assert printed(ROOT) == ["11", "True", "True"]


def test_core_imports_nothing_of_the_subpackage():
    for path in (ROOT / "quillon").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert not re.search(r"(from|import)\b.*\bllm\b", path.read_text()), path
