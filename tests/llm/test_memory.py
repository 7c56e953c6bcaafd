"""What a task holds at once, and what a worker keeps after its task."""

import os
import re
import subprocess
import sys

import pyarrow as pa
from pyspark.sql import functions as F

from corpusloom.llm import vector

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_python_gets_few_texts_at_once(spark, tmp_path):
    path = str(tmp_path / "texts")
    text = F.concat(F.repeat(F.lit("word "), 800), F.col("id").cast("string"))
    spark.range(0, 3000, 1, 1).select("id", text.alias("text")).write.parquet(path)
    vector.bound_batches(spark)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes]), pa.array([batch.num_rows])], ["size", "n"])

    rows = spark.read.parquet(path).mapInArrow(sizes, "size long, n long").collect()
    assert sum(r["n"] for r in rows) == 3000 and max(r["size"] for r in rows) <= 3 << 20


def test_scans_take_few_rows_at_once(spark):
    spark.conf.unset("spark.sql.parquet.columnarReaderBatchSize")
    vector.bound_batches(spark)
    assert int(spark.conf.get("spark.sql.parquet.columnarReaderBatchSize")) == vector.SCAN_ROWS <= 512


KEPT = """
import re
from corpusloom.llm import vector
def held():
    return int(re.search(r"\\nPrivate_Dirty: +(\\d+)", open("/proc/self/smaps_rollup").read())[1]) >> 10
words = [b"%030d" % i for i in range(2_000_000)]
last = words[-1:]
full = held()
del words
vector.give_back()
print(full, held())
"""


def test_a_worker_gives_memory_back():
    # Plain malloc, as numpy and Arrow's system pool use it; what a later allocation pins stays unless it is trimmed.
    env = os.environ | {"PYTHONPATH": ROOT, "PYTHONMALLOC": "malloc"}
    out = subprocess.run([sys.executable, "-c", KEPT], env=env, capture_output=True, text=True, check=True).stdout
    full, kept = map(int, re.findall(r"\d+", out)[-2:])
    assert kept < full - 100
