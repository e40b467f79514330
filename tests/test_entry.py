"""The entry file works without the training-data operators, whichever of their parts are missing."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("missing", [("marginalia/llm",), ("marginalia/llm", "corpus_pipeline.py"), ("corpus_pipeline.py",)])
def test_queries_without(tmp_path, missing):
    shutil.copytree(ROOT / "marginalia", tmp_path / "marginalia", ignore=shutil.ignore_patterns("__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (ROOT / name).exists():
            shutil.copy(ROOT / name, tmp_path / name)
    for name in missing:
        gone = tmp_path / name
        if gone.is_dir():
            shutil.rmtree(gone)
        elif gone.exists():
            gone.unlink()
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert 'catalog_search' in q and not o.keys() - q.keys(); print('pipeline' in q, any(x.startswith('op') and x[2].isdigit() for x in q))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin"}, capture_output=True, text=True, check=False)
    assert done.returncode == 0, done.stderr
    pipeline, operators = done.stdout.split()
    assert pipeline == "False" and (operators == "False" or "marginalia/llm" not in missing)
