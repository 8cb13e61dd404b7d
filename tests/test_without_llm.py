"""The library without the language-data package."""

import json
import os
import shutil
import subprocess
import sys

from conftest import ROOT


def test_import_without_the_package(tmp_path):
    ignored = shutil.ignore_patterns("llm", ".git", "__pycache__", "*.json", ".pytest_cache")
    for keep in (True, False):  # with and without the pipeline file, which imports the package
        copy = tmp_path / str(keep)
        shutil.copytree(ROOT, copy, ignore=ignored)
        if not keep:
            (copy / "corpus_pipeline.py").unlink()
        script = "import json, __spark_entry__ as e; print(json.dumps([sorted(e.queries()), sorted(e.oracle_sql())]))"
        env = {name: value for name, value in os.environ.items() if name != "PYTHONPATH"}
        done = subprocess.run([sys.executable, "-c", script], cwd=copy, env=env, capture_output=True, text=True, check=True, timeout=120)
        queries, oracles = json.loads(done.stdout)
        assert len(queries) >= 100 and set(oracles) <= set(queries)
        assert "pipeline" not in queries and not [name for name in queries if name.startswith("op") and name[2].isdigit()]
