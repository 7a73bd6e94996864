"""The entry point with, without and with a broken folder of optional operators."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
CODE = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); print(len(q), len(o), set(o) <= set(q), any(n.startswith('op') for n in q), 'pipeline' in q)"


def said(folder):
    run = subprocess.run([sys.executable, "-c", CODE], cwd=folder, capture_output=True, text=True, timeout=120)
    assert run.returncode == 0, run.stderr
    return run


def test_optional_operators(tmp_path):
    for name in ("__spark_entry__.py", "tessella"):
        (shutil.copytree if (ROOT / name).is_dir() else shutil.copy)(ROOT / name, tmp_path / name)
    shutil.rmtree(tmp_path / "tessella/llm", ignore_errors=True)
    without = said(tmp_path)
    assert without.stdout.split()[2:] == ["True", "False", "False"] and not without.stderr
    (tmp_path / "tessella/llm").mkdir()
    (tmp_path / "tessella/llm/__init__.py").write_text("")
    (tmp_path / "tessella/llm/queries.py").write_text("import a_module_that_nobody_has")
    broken = said(tmp_path)
    assert broken.stdout == without.stdout and "a_module_that_nobody_has" in broken.stderr
