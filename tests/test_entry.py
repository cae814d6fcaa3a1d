"""The driver contract, also without the optional subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).parent.parent


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_without_llm():
    code = (
        "import sys; sys.modules['lodestone.llm'] = None; sys.modules['corpus_pipeline'] = None\n"
        "import __spark_entry__ as e\n"
        "names = e.queries(); assert names and not any(n.startswith('op') or n == 'pipeline' for n in names)"
    )
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


def test_folders_deleted(tmp_path):
    """A copy without the subpackage, its tests and the pipeline imports, and its queries are those of the core."""
    gone = shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__", "*.json", "*.txt")
    shutil.copytree(ROOT, copy := tmp_path / "copy", ignore=gone)
    code = "import __spark_entry__ as e\nfrom lodestone.plans import catalog\nassert set(e.queries()) == set(catalog.queries()) and set(e.oracle_sql()) == set(catalog.oracle_sql())"
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, timeout=120)
