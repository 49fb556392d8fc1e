"""The entry point with and without the optional subpackage."""

import os
import re
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def names(root):
    code = "import __spark_entry__ as e; print(*e.queries()); print(*e.oracle_sql())"
    out = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, check=True,
                         env={**os.environ, "PYTHONPATH": str(root)}).stdout.splitlines()
    return [set(line.split()) for line in out]


def test_import_without_the_subpackage(tmp_path):
    shutil.copytree(os.path.join(ROOT, "serpframe"), tmp_path / "serpframe",
                    ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    queries, oracles = names(tmp_path)
    assert len(queries) >= 95 and oracles == queries
    assert not any(q.startswith("op") or q == "pipeline" for q in queries)


def test_nothing_else_imports_the_subpackage():
    for folder, _, files in os.walk(os.path.join(ROOT, "serpframe")):
        if os.path.basename(folder) != "llm":
            for f in files:
                if f.endswith(".py"):
                    with open(os.path.join(folder, f)) as text:
                        assert not re.search(r"import.*\bllm\b|from .*\bllm\b", text.read()), f
