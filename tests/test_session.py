"""Session construction: the submitted master holds, and work folders are shared or local to a local master."""

import os
import subprocess
import sys

import pytest

from shelfcast.session import materialize, path_exists, scratch_folder, shared_dir, work_folder

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_submitted_master_is_kept():
    code = ("from shelfcast.session import get_session; s = get_session(); "
            "print('MASTER', s.sparkContext.master); s.stop()")
    env = {k: v for k, v in os.environ.items() if k != "BENCH_CPUS"}
    env |= {"PYSPARK_SUBMIT_ARGS": "--master local[2] --driver-memory 1g pyspark-shell", "PYTHONPATH": REPO}
    out = subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True, timeout=120)
    assert "MASTER local[2]" in out.stdout


def test_cluster_without_a_shared_folder_is_an_error():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        work_folder("spark://host:7077", None)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        work_folder("local-cluster[2,1,1024]", None)
    assert work_folder("spark://host:7077", "hdfs://x/y") == "hdfs://x/y"
    assert os.path.isdir(work_folder("local[4]", None))


def test_scratch_folder_is_deleted(spark):
    with scratch_folder(spark) as folder:
        assert materialize(spark.range(5), "five").count() == 5
        assert path_exists(spark, folder)
        with scratch_folder(spark) as inner:
            assert inner == folder
        assert path_exists(spark, folder)
    assert not path_exists(spark, folder)
    assert path_exists(spark, shared_dir(spark))
