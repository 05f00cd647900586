"""The entry file must import without a JVM and without Spark's jar folder."""

import os
import subprocess
import sys

from spate.functions import text as tx

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

CODE = """
import os, sys
real = os.listdir
import glob
glob.glob = lambda *a, **k: []
os.environ.pop("JAVA_HOME", None)
os.environ["PATH"] = ""
import __spark_entry__ as e
q, o = e.queries(), e.oracle_sql()
assert len(q) > 60 and set(o) <= set(q), (len(q), set(o) - set(q))
assert all(isinstance(s, str) and s for s in o.values())
print("ok")
"""


def test_queries_import_without_jvm_or_jars(tmp_path):
    out = subprocess.run([sys.executable, "-B", "-c", CODE], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert out.stdout.strip().endswith("ok"), out.stderr[-2000:]


def test_stop_word_files_equal_spark(spark):
    from pyspark.ml.feature import StopWordsRemover

    for language in ("english", "swedish"):
        assert list(tx.default_stop_words(language)) == list(StopWordsRemover.loadDefaultStopWords(language))
