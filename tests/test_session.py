"""The shared folder: of a plain local session, and settings that lose data on a cluster."""

import os
import subprocess
import sys
from types import SimpleNamespace

import pytest

from tidewatch import session

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
PLAIN = """
import sys
sys.path.insert(0, {repo!r})
from tidewatch.session import build_session, shared_folder, work_path, written, release
from tidewatch.plans import load_all
spark = build_session("plain", "local[2]", spark__sql__shuffle__partitions="2")
assert spark.conf.get("spark.checkpoint.dir", None) is None
assert shared_folder(spark) == shared_folder(spark)
table = written(spark.range(7), "seven")
assert table.count() == 7
release(table)
print("ROWS", load_all()[0]["scan_csv"](spark, "/root/testdata/sf0.001").count(), shared_folder(spark))
"""


def fake(master, folder):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: folder), sparkContext=SimpleNamespace(master=master))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="test data is not present")
def test_file_query_without_a_folder_set(tmp_path):
    bare = {k: v for k, v in os.environ.items() if k != "PYSPARK_SUBMIT_ARGS"} | {"SPARK_CONF_DIR": str(tmp_path)}
    done = subprocess.run([sys.executable, "-c", PLAIN.format(repo=REPO)], capture_output=True, text=True, timeout=300, env=bare)
    assert done.returncode == 0, done.stderr[-2000:]
    rows, folder = done.stdout.split("ROWS ")[1].split()
    assert int(rows) > 0
    # What the queries wrote is gone with the process.
    assert not any(files for _, _, files in os.walk(os.path.join(folder, "tidewatch")))


@pytest.mark.parametrize("folder", ["/tmp/work", "file:///tmp/work", "file:/var/tmp/x", None])
def test_machine_local_folders_are_refused_on_a_cluster(folder):
    with pytest.raises(ValueError):
        session.shared_folder(fake("spark://host:7077", folder))


@pytest.mark.parametrize("master, folder", [("yarn", "hdfs://lake/work/"), ("yarn", "/shared/nfs/work"), ("local[2]", "/tmp/work/")])
def test_other_folders_are_taken(master, folder):
    assert session.shared_folder(fake(master, folder)) == folder.rstrip("/")
