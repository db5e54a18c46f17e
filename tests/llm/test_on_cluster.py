"""Repeated passages on executors of their own (processes, not threads), row by row against a rolling hash of all windows."""

import os
import random
import subprocess
import sys

import numpy as np
import pandas as pd

from tests.llm.helpers import prose

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SCRIPT = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
from __spark_entry__ import queries
spark = (SparkSession.builder.master(sys.argv[4]).config("spark.checkpoint.dir", "file://" + sys.argv[3] + "/shared")
         .config("spark.executor.memory", "1g").config("spark.sql.shuffle.partitions", "12").config("spark.ui.enabled", "false")
         .config("spark.driver.host", "127.0.0.1").config("spark.sql.files.maxPartitionBytes", "2m").getOrCreate())
queries()["op1_suffix_array_dedup"](spark, sys.argv[2]).write.parquet("file://" + sys.argv[3] + "/found")
"""


def on_cluster(sf_dir: str, out: str, master: str = "local-cluster[2,2,2000]", timeout: int = 600) -> pd.DataFrame:
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT, REPO, sf_dir, out, master], cwd=out, env=env, capture_output=True, text=True, timeout=timeout)
    assert done.returncode == 0, done.stderr[-2_000:]
    return pd.read_parquet(f"{out}/found")


def removed_by_rolling_hash(texts: list[str | None], span: int = 400) -> np.ndarray:
    """Bytes of each text that a window occurring anywhere else covers: sums of byte codes times powers, every window hashed."""
    raw = [(t or "").encode() for t in texts]
    bounds = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    codes = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    base, inverse = np.uint64(6364136223846793005), np.uint64(pow(6364136223846793005, -1, 2**64))
    hashes = []
    for r in raw:
        m = max(len(r) - span + 1, 0)
        if m:
            powers = np.concatenate([[np.uint64(1)], np.full(len(r) - 1, base, np.uint64)]).cumprod(dtype=np.uint64)
            sums = np.concatenate([[np.uint64(0)], np.cumsum(codes[np.frombuffer(r, np.uint8)] * powers, dtype=np.uint64)])
            back = np.concatenate([[np.uint64(1)], np.full(m - 1, inverse, np.uint64)]).cumprod(dtype=np.uint64)
            hashes.append((sums[span:] - sums[:m]) * back)
        else:
            hashes.append(np.zeros(0, np.uint64))
    ordered = np.sort(np.concatenate(hashes))
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    removed = np.zeros(len(raw), np.int64)
    for i, h in enumerate(hashes):
        if len(h) and len(twice):
            hit = twice[np.minimum(np.searchsorted(twice, h), len(twice) - 1)] == h
            edge = np.zeros(len(raw[i]) + 1, np.int64)
            edge[:len(h)] += hit
            edge[span:span + len(h)] -= hit
            removed[i] = np.count_nonzero(np.cumsum(edge)[:-1])
    return removed


def test_rows_of_separate_executors_equal_every_window_hashed(tmp_path):
    rng = random.Random(3)
    docs = pd.read_parquet("/root/testdata/sf0.001/documents.parquet")
    long, short = prose(rng, 150), prose(rng, 60)
    planted = [f"{prose(rng, rng.randint(5, 90))} {(long, short, long[50:520])[k % 3]} {prose(rng, rng.randint(5, 90))}" for k in range(300)]
    extra = pd.DataFrame({"doc_id": np.arange(len(planted)) + 10_000_000, "text": planted}).reindex(columns=docs.columns)
    extra["n_chars"] = extra["text"].str.len()
    for c in ("lang", "source"):
        extra[c] = "x"
    docs = pd.concat([docs, extra]).astype({c: t for c, t in docs.dtypes.items()})
    docs.to_parquet(tmp_path / "documents.parquet", coerce_timestamps="us")
    got = on_cluster(str(tmp_path), str(tmp_path)).set_index("doc_id").sort_index()
    docs = docs.sort_values("doc_id")
    assert got.index.tolist() == docs["doc_id"].tolist()
    assert got["n_removed"].to_numpy().tolist() == removed_by_rolling_hash(docs["text"].tolist()).tolist()
    assert (got["n_removed"] > 0).sum() >= 200
