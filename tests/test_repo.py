"""The library stands without the training-data subpackage, and nothing in it imports that."""

from __future__ import annotations

import re
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_stands_alone(tmp_path):
    shutil.copytree(ROOT / "tallyforge", tmp_path / "tallyforge", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'offer_selection' in q and set(e.oracle_sql()) <= set(q) and not any(n.startswith('op') and n[2].isdigit() for n in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"}, check=True)


def test_nothing_else_imports_llm():
    for path in (ROOT / "tallyforge").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT / "tallyforge").parts:
            assert not re.search(r"tallyforge[. ]+(import )?llm", path.read_text()), path
