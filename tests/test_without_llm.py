"""The rest stands without the optional subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path


def test_entry_imports_without_llm(tmp_path):
    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "brightfold", tmp_path / "brightfold", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') and n[2].isdigit() for n in q) and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path)
