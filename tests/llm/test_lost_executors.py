"""An executor is killed while an operator runs, and the result is what it is without that."""

import json
import os
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest

from folioscope.llm.embeddings import link_embeddings
from folioscope.llm.neardup import near_duplicates

RNG = np.random.default_rng(3)


def vectors(spark):
    base = RNG.standard_normal((60, 16))
    rows = [(i, (base[i % 60] + RNG.standard_normal(16) * 0.1).tolist(), i % 2) for i in range(1500)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(4)


def documents(spark):
    words = ["".join(RNG.choice(list("abcdefgh"), 5)) for _ in range(2000)]
    base = [" ".join(RNG.choice(words, 120)) for _ in range(80)]
    rows = [(i, base[i % 80] + f" tail {i % 3}" if i % 5 else " ".join(RNG.choice(words, 60))) for i in range(600)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(4)


@pytest.mark.parametrize("name", ["embeddings", "neardup"])
def test_killed_executor(spark, tmp_path, name):
    rows = vectors(spark) if name == "embeddings" else documents(spark)
    rows.write.parquet(str(tmp_path / "in"))
    given = spark.read.parquet(str(tmp_path / "in"))
    out = link_embeddings(given) if name == "embeddings" else near_duplicates(given).select("doc_id", "n_shingles", "component_id")
    want = sorted((tuple(r) for r in out.collect()), key=repr)
    root = Path(__file__).parents[2]
    env = os.environ | {"PYTHONPATH": str(root), "SPARK_LOCAL_IP": "127.0.0.1", "SPARK_SCALA_VERSION": "2.13"}
    env.pop("PYSPARK_GATEWAY_PORT", None)
    log = (tmp_path / "log").open("w")
    done = subprocess.run([sys.executable, str(Path(__file__).with_name("lost_executor.py")), name, str(tmp_path), "kill"], env=env, cwd=tmp_path, stdout=log, stderr=subprocess.STDOUT, timeout=600, check=False)
    said = (tmp_path / "log").read_text().splitlines()
    if "ready" not in said:
        pytest.skip("no cluster of processes can be started here")
    assert done.returncode == 0 and "killed" in said, said[-5:]
    got = next(line for line in said if line.startswith("rows "))
    assert [tuple(r) for r in json.loads(got[5:])] == want
