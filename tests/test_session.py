"""Checkpoint-folder handling: the session's setting wins; a local session
without one gets a scratch folder; materialize() writes under it."""

import os
import subprocess
import sys
import tempfile

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate()
from offerscope.session import ensure_checkpoint_dir, materialize
d = ensure_checkpoint_dir(spark)
df = materialize(spark.range(10), 'probe')
print('RESULT', d, df.count(), df.inputFiles()[0])
"""


def test_materialize_uses_configured_folder(spark):
    from offerscope.session import ensure_checkpoint_dir, materialize
    base = ensure_checkpoint_dir(spark)
    df = materialize(spark.range(5), "probe")
    assert df.count() == 5
    assert all(base.replace("file:", "").rstrip("/") in f for f in df.inputFiles())


def test_local_session_without_setting_gets_scratch_folder():
    conf_dir = tempfile.mkdtemp(prefix="offerscope-noconf-", dir="/tmp")
    env = dict(os.environ, SPARK_CONF_DIR=conf_dir)
    out = subprocess.run([sys.executable, "-c", SCRIPT.format(root=ROOT)], env=env, capture_output=True,
                         text=True, timeout=300)
    line = [x for x in out.stdout.splitlines() if x.startswith("RESULT")]
    assert line, out.stderr[-2000:]
    _, folder, n, first = line[0].split(" ", 3)
    assert n == "10" and "offerscope-ckpt-" in folder and "offerscope-tables/probe-" in first
