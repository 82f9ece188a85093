"""The entry file works without the text operators and their pipeline."""

import os
import shutil
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SHOW = "import __spark_entry__ as e; q = set(e.queries()); assert set(e.oracle_sql()) <= q; print(len(q), 'op1_decontamination' in q)"


def test_entry_without_text_operators(tmp_path):
    shutil.copytree(os.path.join(REPO, "lotwise"), tmp_path / "lotwise", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(REPO, "__spark_entry__.py"), tmp_path)
    said = subprocess.run([sys.executable, "-c", SHOW], cwd=tmp_path, capture_output=True, text=True, check=True)
    count, present = said.stdout.split()
    assert int(count) > 90 and present == "False"
