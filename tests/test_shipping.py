"""Tasks must not need the package: a session started elsewhere, without it on the workers' path, runs the passes."""
import os
import subprocess
import sys

CODE = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession, functions as F
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
from tersely.operators import chunks, fidelity, reduce
df = spark.createDataFrame([("In order to  go, `x`",)], "text string")
out = df.select(reduce.reduced(F.col("text")).alias("r"), reduce.code_reduced(F.lit("a # b"), "hash").alias("c"), chunks.chunked(F.col("text")).alias("k"), fidelity.spans(F.col("text")).alias("s")).first()
print("GOT", out.r, "|", out.c, "|", out.k, "|", out.s.code)
"""


def test_from_elsewhere(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", CODE.format(root=root)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "GOT To go, `x` | a | ['In order to  go, `x`'] | ['`x`']" in out.stdout, out.stderr[-2000:]
