"""Scratch tables, and the driver contract without the subpackage for training data."""

import subprocess
import sys
from pathlib import Path

import pytest

from voxtide import session


def test_release(spark):
    df, path = session.materialise(spark.range(3), "x")
    assert df.count() == 3
    session.release(spark)
    again, _ = session.materialise(spark.range(2), "x")
    assert again.count() == 2
    with pytest.raises(Exception, match="(?i)exist"):
        spark.read.parquet(path).count()


class Cluster:
    class sparkContext:
        master = "spark://somewhere:7077"
        applicationId = "app"

        @staticmethod
        def getConf():
            return {}

    class conf:
        @staticmethod
        def get(name, default=None):
            return default


def test_no_local_folder_on_a_cluster():
    with pytest.raises(RuntimeError, match="checkpoint"):
        session.shared_dir(Cluster)


def test_a_missing_dependency_is_no_missing_subpackage():
    root = Path(__file__).resolve().parent.parent
    run = lambda code: subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True)
    hidden = "import sys; sys.modules['voxtide.llm'] = None; import __spark_entry__ as e; assert 'p4_found' in e.queries() and 'p1_found' not in e.queries()"
    assert run(hidden).returncode == 0
    if (root / "voxtide" / "llm").is_dir():
        lacking = run("import sys; sys.modules['ahocorasick'] = None; import __spark_entry__ as e; e.queries()")
        assert lacking.returncode != 0 and "ahocorasick" in lacking.stderr
