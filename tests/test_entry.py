"""The driver's contract, with and without the optional folders."""

import os
import shutil
import subprocess
import sys

import __spark_entry__

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_flagship(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["chunk_id", "page_id", "rank", "lexical", "vector", "fused", "fusion"] and df.count() == 20


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_imports_without_the_optional_folders_and_without_a_session(tmp_path):
    for name in ("lodestone", "__spark_entry__.py"):
        source = os.path.join(ROOT, name)
        (shutil.copytree if os.path.isdir(source) else shutil.copy)(source, tmp_path / name)
    shutil.rmtree(tmp_path / "lodestone" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e; assert e.corpus_pipeline is None and len(e.queries()) == len(e.oracle_sql()) > 30"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
    assert done.returncode == 0, done.stderr


def test_nothing_else_imports_the_optional_package():
    for base, _, files in os.walk(os.path.join(ROOT, "lodestone")):
        if os.path.basename(base) != "llm":
            for name in files:
                if name.endswith(".py"):
                    text = open(os.path.join(base, name)).read()
                    assert "lodestone.llm" not in text and "from .llm" not in text, name
