import gzip
import json
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    import os
    import sys

    root = str(Path(__file__).parent.parent)
    os.environ["PYTHONPATH"] = os.pathsep.join([root, os.environ.get("PYTHONPATH", "")])
    sys.path.insert(0, root)
    session = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def objects(tmp_path_factory):
    """A small collection: five objects with a header, ticks and, but for one, hits."""
    root = tmp_path_factory.mktemp("objects")
    for i in range(5):
        key = f"match/2022/05/{10 + i}/m{i}"
        folder = root / key
        folder.mkdir(parents=True)
        tables = {"header": {"map": [f"map{i % 2}"], "rounds": [20 + i]}, "tick": {"tick": list(range(3 * i)), "player": [f"p{j}" for j in range(3 * i)]}}
        if i != 2:
            tables["hit"] = {"tick": [1, 2], "damage": [10 * i, 5]}
        channels = []
        for name, columns in tables.items():
            pq.write_table(pa.table({k: pa.array(v, pa.string() if k in ("map", "player") else pa.int64()) for k, v in columns.items()}), folder / name)
            channels.append({"channel": name, "key": f"{key}/{name}", "contentType": "application/x-parquet", "columns": [{"name": c} for c in columns]})
        (folder / "match").write_bytes(gzip.compress(json.dumps({"id": f"id{i}", "key": f"{key}/match", "channels": channels}).encode()))
    return root
