"""The entry module with and without the training-data subpackage, and the library's import rule."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_entry_works_without_the_subpackage():
    code = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name.startswith("offerlens.llm") or name == "corpus_pipeline":
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert len(e.queries()) > 100 and set(e.oracle_sql()) <= set(e.queries()) and not any(k.startswith("op") for k in e.queries())
"""
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_nothing_else_imports_the_subpackage():
    for path in (ROOT / "offerlens").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "offerlens.llm" not in path.read_text(), path


def test_flagship(spark):
    import __spark_entry__

    rows = __spark_entry__.entry(spark).collect()
    assert rows and {"brand", "title", "price", "rank"} <= set(rows[0].asDict())
