import ast
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

REPO = Path(__file__).resolve().parent.parent


def test_entry_runs(spark):
    assert entry.entry(spark).limit(5).count() >= 0


def test_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_only_the_entry_and_bench_name_the_llm_subpackage():
    for path in REPO.glob("foliospark/**/*.py"):
        if "llm" not in path.parts:
            for node in ast.walk(ast.parse(path.read_text())):
                assert not (isinstance(node, ast.ImportFrom) and node.module and "llm" in node.module), path


def test_imports_without_the_llm_subpackage():
    code = "import sys; sys.modules['foliospark.llm'] = None; import importlib.abc\nclass F(importlib.abc.MetaPathFinder):\n    def find_spec(self, n, p, t=None):\n        if n == 'corpus_pipeline': raise ModuleNotFoundError(name=n)\nsys.meta_path.insert(0, F())\nimport __spark_entry__ as e\nassert not any(k.startswith('op') for k in e.queries()) and len(e.queries()) > 200"
    subprocess.run([sys.executable, "-c", code], cwd=REPO, check=True, timeout=120)
