"""The training-data operators can be deleted: the rest imports and answers."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_the_rest_works_without_the_training_data_operators(tmp_path):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache", "spark-warehouse"))
    for folder in ("gleaner/llm", "tests/llm"):
        shutil.rmtree(copy / folder, ignore_errors=True)
    ask = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 40 and not any(n.startswith(('op1', 'pipeline')) for n in q); assert set(e.oracle_sql()) <= set(q); print('fine')"
    for keep in (True, False):
        if not keep:
            (copy / "corpus_pipeline.py").unlink(missing_ok=True)
        done = subprocess.run([sys.executable, "-c", ask], cwd=copy, capture_output=True, text=True, timeout=120)
        assert done.stdout.strip() == "fine", done.stderr
