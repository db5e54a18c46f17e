"""Tasks run where only the driver can import the package, as on a cluster; and the classifier's bound on labelled rows."""

import os
import subprocess
import sys

import numpy as np
import pytest

from sparkcohort.llm import quality
from tests.llm.helpers import documents, prose

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SCRIPT = """
import sys
sys.path.insert(0, sys.argv[1])
from __spark_entry__ import queries
from sparkcohort.session import local_session
spark = local_session("4", shuffle_partitions=4)
try:
    import_here = spark.range(1).mapInArrow(lambda batches: (__import__("sparkcohort") and b for b in batches), "id long")
    import_here.collect()
    print("importable")
except Exception as error:
    print("not importable" if "ModuleNotFoundError" in str(error) else error)
for name in sys.argv[2:]:
    print(name, queries()[name](spark, "/root/testdata/sf0.001").count() > 0)
"""


@pytest.mark.parametrize("names", [
    ("op3_quality_classifier", "op4_sentencepiece", "op7_html_extraction", "op8_pii", "op9_lm_scoring"),
    ("op11_conversation_trie", "op13_spelling_variants", "pipeline")])
def test_queries_run_without_the_package_on_workers(tmp_path, names):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT, REPO, *names], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert done.stdout.split("\n")[:-1] == ["not importable", *[f"{n} True" for n in names]], done.stderr[-2_000:]


def test_the_bound_counts_labelled_documents_at_hand(spark):
    import random
    rng = random.Random(1)
    docs = documents(spark, [prose(rng, 30) for _ in range(8)])
    docs = docs.unionAll(docs.where("doc_id = 1"))
    labels = spark.createDataFrame([(k, k % 2, 0) for k in [*range(8), *range(1_000, 6_000)]], "doc_id long, quality int, toxic int")
    import zlib
    taken = [k for k in range(8) if zlib.crc32(str(k).encode()) % 5]
    model = quality.fit(docs, labels, sample=8)
    assert len(model.labels) == len(taken) and np.sum(model.labels) == sum(k % 2 for k in taken)
