"""The entry module without the optional parts, and with a dependency of theirs missing."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
COUNT = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q) and 'bm25_topk' in q; print(sum(n[:2] == 'op' or n == 'pipeline' for n in q))"


def run(folder, code):
    done = subprocess.run([sys.executable, "-c", code], cwd=folder, env=os.environ | {"PYTHONPATH": str(folder)}, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    return int(done.stdout.strip().splitlines()[-1])


def test_the_library_stands_alone(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", ".pytest_cache"))
    assert run(copy, COUNT) == 0


def test_a_missing_dependency_takes_only_the_optional_queries():
    assert run(ROOT, "import sys; sys.modules['ahocorasick'] = None; " + COUNT) == 0
