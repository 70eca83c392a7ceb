"""The driver contract, with and without the training-data subpackage."""

import os
import shutil
import subprocess
import sys

import __spark_entry__

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_and_names(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_the_rest_works_without_llm(tmp_path):
    there = tmp_path / "repo"
    shutil.copytree(HERE, there, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", "spark-warehouse"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'screening_profile' in q and not any(x.startswith('op') for x in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=there, check=True, timeout=120)


def test_leftover_folders_of_llm_are_no_error(tmp_path):
    there = tmp_path / "repo"
    shutil.copytree(HERE, there, ignore=shutil.ignore_patterns(".git", "corpus_pipeline.py", "__pycache__", "spark-warehouse"))
    for name in os.listdir(there / "millrace" / "llm"):
        os.remove(there / "millrace" / "llm" / name)
    (there / "millrace" / "llm" / "__pycache__").mkdir()
    subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert 'screening_profile' in e.queries(); e.oracle_sql()"], cwd=there, check=True, timeout=120)
