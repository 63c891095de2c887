"""Project queries where each executor is a process with temp files of its own, against DuckDB."""

import json
import os
import subprocess
import sys
from pathlib import Path

import pytest
from test_queries import DIR, duck, rows  # noqa: F401  a fixture

from quarrymap.plans import project_queries, queries
from quarrymap.sources import project

NAMES = ["project_analysis", "project_cli", "project_answer", "project_edges", "project_files", "project_edges_stored", "project_meta", "project_nodes", "project_nodes_stored", "project_routes", "project_update"]
_RUN = f"""
import json, sys
from pyspark.sql import SparkSession
from quarrymap.plans import project_queries, queries

spark = SparkSession.builder.getOrCreate()
for name in sys.argv[2:]:
    try:
        frame = queries.QUERIES[name](spark, {DIR!r}).toPandas().astype(str)
        said = [list(frame.columns), frame.values.tolist()]
    except Exception as e:
        said = str(e)
    with open(f"{{sys.argv[1]}}/{{name}}.json", "w") as f:
        json.dump(said, f)
"""


@pytest.fixture(scope="module")
def made(tmp_path_factory):
    """The folder of the results of a run on two executors that share only the checkpoint folder with the driver."""
    import pyspark

    top = tmp_path_factory.mktemp("cluster")
    for name in ("home", "temp", "shared", "out"):
        (top / name).mkdir()
    for p in Path(pyspark.__file__).parent.iterdir():  # the executors' folders go to work in Spark's home
        if p.name != "work":
            (top / "home" / p.name).symlink_to(p)
    conf = {"spark.master": "local-cluster[2,1,1024]", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.sql.shuffle.partitions": "4", "spark.checkpoint.dir": f"file://{top}/shared", "spark.sql.warehouse.dir": f"{top}/warehouse", "spark.driver.host": "127.0.0.1"}
    env = os.environ | {"SPARK_HOME": f"{top}/home", "TMPDIR": f"{top}/temp", "PYSPARK_PYTHON": sys.executable, "SPARK_SCALA_VERSION": "2.13", "SPARK_LOCAL_IP": "127.0.0.1", "PYSPARK_SUBMIT_ARGS": " ".join(f"--conf {k}={v}" for k, v in conf.items()) + " pyspark-shell"}
    env = {k: v for k, v in env.items() if k not in ("PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET")}
    subprocess.run([sys.executable, "-c", _RUN, str(top / "out"), *NAMES], env=env, cwd=top, check=True, timeout=900)
    assert not list((top / "temp").glob("quarrymap-*"))
    return top / "out"


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no corpus")
@pytest.mark.parametrize("name", NAMES)
def test_query_on_a_cluster(made, duck, name):  # noqa: F811
    import pandas as pd

    said = json.loads((made / f"{name}.json").read_text())
    assert isinstance(said, list), said
    assert rows(pd.DataFrame(said[1], columns=said[0])) == rows(duck.execute(queries.SQL[name]).df())


def test_tree_lies_in_the_shared_folder(spark):
    root = Path(project_queries._project(spark, DIR))
    assert root.parent == Path(spark.sparkContext.getCheckpointDir().removeprefix("file:"))
    assert root.stat().st_mode == (root / "n").stat().st_mode


def test_tree_that_a_task_does_not_see(tmp_path):
    reader = project.ListingReader({"path": str(tmp_path / "none")})
    with pytest.raises(FileNotFoundError):
        list(reader.read(reader.partitions()[0]))
