"""The register's queries do not need the training-data subpackage or the pipeline file."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
ASK = ("import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); "
       "assert set(o) <= set(q), set(o) - set(q); print(len(q), 'pipeline' in q, any(k.startswith('op1') for k in q))")


@pytest.mark.parametrize("pipeline_stays", [True, False])
def test_entry_without_llm(tmp_path, pipeline_stays):
    """Both llm folders deleted, with and without corpus_pipeline.py."""
    tree = tmp_path / "tree"
    shutil.copytree(os.path.join(ROOT, "riskgrid"), tree / "riskgrid",
                    ignore=lambda folder, names: [n for n in names if n in ("llm", "__pycache__")])
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tree)
    pipeline = os.path.join(ROOT, "corpus_pipeline.py")
    if pipeline_stays and os.path.exists(pipeline):
        shutil.copy(pipeline, tree)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", ASK], cwd=tree, env=env, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    n, has_pipeline, has_llm = done.stdout.split()[-3:]
    assert int(n) >= 88 and has_pipeline == "False" and has_llm == "False"
