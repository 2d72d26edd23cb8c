"""The driver imports the entry module from anywhere: Python workers must
still find the package (it is shipped with addPyFile)."""

import os
import subprocess
import sys
import tempfile

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_queries_run_when_started_outside_the_repo():
    code = (
        "import sys; sys.path.insert(0, %r)\n"
        "import __spark_entry__ as E\n"
        "from pyspark.sql import SparkSession\n"
        "s = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate()\n"
        "print('ROWS', E.queries()['function_spans'](s, '/root/testdata/sf0.001').count(),"
        " E.entry(s).count())\n" % ROOT)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tempfile.mkdtemp(prefix="cc-cwd-", dir="/tmp"),
                         env=env, capture_output=True, text=True, timeout=600)
    rows = [line for line in out.stdout.splitlines() if line.startswith("ROWS")]
    assert rows and int(rows[0].split()[1]) > 0, out.stderr[-2000:]
