"""The entry file without the parts that may be absent."""

import os
import shutil
import subprocess
import sys

import pytest

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
ASK = """
import __spark_entry__ as e
q, o = e.queries(), e.oracle_sql()
print(len(q), "pipeline" in q, any(n.startswith("op") and n[2].isdigit() for n in q), set(o) <= set(q))
"""


def asked(folder):
    done = subprocess.run([sys.executable, "-c", ASK], cwd=folder, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": ""})
    return done.returncode, done.stdout.split(), done.stderr


@pytest.fixture
def copy(tmp_path):
    ignore = shutil.ignore_patterns(".git", "__pycache__", "*.parquet", "spark-warehouse")
    return shutil.copytree(REPO, tmp_path / "repo", ignore=ignore)


@pytest.mark.parametrize("without", [["llm"], ["pipeline"], ["llm", "pipeline"]])
def test_imports_without_the_parts(copy, without):
    if "llm" in without and (copy / "corpusloom/llm").exists():
        shutil.rmtree(copy / "corpusloom/llm")
    if "pipeline" in without and (copy / "corpus_pipeline.py").exists():
        (copy / "corpus_pipeline.py").unlink()
    code, out, err = asked(copy)
    assert code == 0, err
    assert int(out[0]) >= 88 and out[1] == "False" and out[3] == "True"
    assert out[2] == str((copy / "corpusloom/llm").exists())


def test_errors_inside_the_parts_are_not_swallowed(copy):
    if not (copy / "corpusloom/llm").exists():
        pytest.skip("no subpackage")
    (copy / "corpusloom/llm/pii.py").write_text("import no_such_module\n")
    code, _, err = asked(copy)
    assert code != 0 and "no_such_module" in err
