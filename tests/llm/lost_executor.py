"""Run by the test of lost executors: an operator on a cluster of two executors, one of which is killed once tables have been written."""

import json
import os
import signal
import sys
import threading
import time
from pathlib import Path

from pyspark.sql import SparkSession

name, folder, kill = sys.argv[1], sys.argv[2], sys.argv[3] == "kill"
spark = (
    SparkSession.builder.master("local-cluster[2,1,900]").config("spark.executor.memory", "900m").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    .config("spark.sql.shuffle.partitions", "6").config("spark.driver.host", "127.0.0.1").config("spark.checkpoint.dir", f"file://{folder}/shared").config("spark.sql.warehouse.dir", f"{folder}/warehouse").getOrCreate()
)
spark.sparkContext.setLogLevel("ERROR")
spark.range(10).repartition(2).count()
print("ready", flush=True)
address = f"127.0.0.1:{spark.sparkContext.getConf().get('spark.driver.port')}"


def executors() -> list[int]:
    """Process ids of this session's executors, by the driver's address that they were started with."""
    found = []
    for p in Path("/proc").iterdir():
        if p.name.isdigit():
            try:
                said = (p / "cmdline").read_bytes().decode("utf-8", "replace")
            except OSError:
                continue
            if "CoarseGrainedExecutorBackend" in said and address in said:
                found.append(int(p.name))
    return found


def killer() -> None:
    while len(list(Path(folder, "shared").glob("*/*/_SUCCESS"))) < 4:
        time.sleep(0.1)
    pid = executors()[0]
    os.kill(pid, signal.SIGKILL)
    print("killed", flush=True)


if kill:
    threading.Thread(target=killer, daemon=True).start()
if name == "embeddings":
    from folioscope.llm.embeddings import link_embeddings

    out = link_embeddings(spark.read.parquet(f"{folder}/in"))
else:
    from folioscope.llm.neardup import near_duplicates

    out = near_duplicates(spark.read.parquet(f"{folder}/in")).select("doc_id", "n_shingles", "component_id")
rows = sorted((tuple(r) for r in out.collect()), key=repr)
print("rows " + json.dumps(rows), flush=True)
os._exit(0)
