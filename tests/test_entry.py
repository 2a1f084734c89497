"""The driver's contract, with and without the training-data operators."""

import json
import os
import shutil
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SAY = "import json, __spark_entry__ as e; print(json.dumps([sorted(e.queries()), sorted(e.oracle_sql())]))"


def said(at):
    out = subprocess.run([sys.executable, "-c", SAY], cwd=at, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": at, "PYTHONDONTWRITEBYTECODE": "1"})
    assert out.returncode == 0, out.stderr
    return json.loads(out.stdout.strip().split("\n")[-1])


def test_without_the_training_data_operators(tmp_path):
    """Both folders may be deleted, with or without the pipeline at the top: the other queries stay."""
    at = str(tmp_path / "copy")
    shutil.copytree(REPO, at, ignore=shutil.ignore_patterns(".git", "__pycache__", "spark-warehouse"))
    with_all, _ = said(at) if os.path.isdir(f"{at}/pathlake/llm") else ([], [])
    for folder in ("pathlake/llm", "tests/llm"):
        shutil.rmtree(f"{at}/{folder}", ignore_errors=True)
    queries, oracles = said(at)
    assert "search_flagship" in queries and "search_flagship" in oracles
    assert not [q for q in queries if q.startswith("op") or q == "pipeline"] and set(queries) <= set(with_all or queries)
    if os.path.exists(f"{at}/corpus_pipeline.py"):
        os.remove(f"{at}/corpus_pipeline.py")
    assert said(at) == [queries, oracles]


def test_every_oracle_has_a_query():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
