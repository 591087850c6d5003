"""The driver contract, and that the rest stands without the training-data operators."""

import os
import shutil
import subprocess
import sys

import __spark_entry__

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_oracles_belong_to_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_imports_without_the_llm_folders(tmp_path):
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        shutil.copy(f"{ROOT}/{name}", tmp_path)
    shutil.copytree(f"{ROOT}/factloom", tmp_path / "factloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; assert e.llm is None; assert 'r5_purchase_parts' in e.queries(); assert not [q for q in e.queries() if q.startswith('op')]"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, check=True)
