"""Without the corpus subpackage the rest imports, and its queries are there."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = """
import __spark_entry__ as e
names = e.queries()
assert "ema_smooth" in names and not any(n.startswith("op") or n == "pipeline" for n in names), sorted(names)
assert set(e.oracle_sql()) <= set(names)
import curvemill.__main__, bench, curvemill.streaming.live, curvemill.plans.screen
print("fine")
"""


def test_the_rest_stands_alone(tmp_path):
    skip = shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", "*.json", "*.md")
    shutil.copytree(ROOT, tmp_path / "repo", ignore=skip)
    done = subprocess.run([sys.executable, "-c", CODE], cwd=tmp_path / "repo", capture_output=True, text=True, env={**os.environ, "PYTHONPATH": str(tmp_path / "repo")})
    assert done.returncode == 0 and "fine" in done.stdout, done.stderr


def test_nothing_else_imports_it():
    for folder, _, names in os.walk(os.path.join(ROOT, "curvemill")):
        for name in names:
            if name.endswith(".py") and os.path.basename(folder) != "llm":
                with open(os.path.join(folder, name)) as f:
                    assert "curvemill.llm" not in f.read(), name
