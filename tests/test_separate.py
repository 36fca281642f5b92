"""The library works without its optional part."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("pipeline_stays", [False, True])
def test_entry_without_corpus_operators(tmp_path, pipeline_stays):
    gone = {os.path.join(ROOT, "finsieve", "llm"), os.path.join(ROOT, "tests", "llm")}
    if not pipeline_stays:
        gone.add(os.path.join(ROOT, "corpus_pipeline.py"))

    def left_out(folder, names):
        return [n for n in names if n in (".git", "__pycache__") or os.path.join(folder, n) in gone]

    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=left_out)
    code = "import __spark_entry__ as e; names = set(e.queries()); print(len(names), any(n[:2] == 'op' and n[2].isdigit() for n in names), 'pipeline' in names, set(e.oracle_sql()) <= names)"
    said = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, timeout=300, env={**os.environ, "PYTHONPATH": str(copy)})
    assert said.returncode == 0, said.stderr
    n, *facts = said.stdout.split()
    assert int(n) > 100 and facts == ["False", "False", "True"]
