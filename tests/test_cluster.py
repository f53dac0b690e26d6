import os
import subprocess
import sys
from pathlib import Path
from types import SimpleNamespace

import pytest

from linkspan.sources import shared

REPO = Path(__file__).resolve().parents[1]
CODE = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
from linkspan.functions import similarity
from linkspan.sources import shared
spark = SparkSession.builder.master("local-cluster[1,1,1024]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", {folder!r}).getOrCreate()
shared.ship(spark)
df = spark.createDataFrame([("kitten", "sitting")], "a string, b string")
row = shared.written(df.select(similarity.ratios("a", "b", "a", "b").alias("r")), "t").first()
print("RATIO", round(row.r.name_ratio, 4))
spark.stop()
"""


def test_workers_need_neither_path_nor_folder(tmp_path):
    """Executors in processes of their own, started where the package can't be seen."""
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "PYSPARK_PYTHON")} | {"PYSPARK_PYTHON": sys.executable}
    (tmp_path / "shared").mkdir()
    code = CODE.format(repo=str(REPO), folder=f"file://{tmp_path}/shared")
    run = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=180)
    assert "RATIO 0.6154" in run.stdout, run.stderr[-2000:]
    assert list((tmp_path / "shared").glob("linkspan-*")) == []  # the run's folder goes with its session


def test_a_cluster_must_name_its_folder():
    spark = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: default), sparkContext=SimpleNamespace(master="spark://somewhere:7077"))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared.run_folder(spark)


def test_cleanup_empties_the_folder(spark):
    df = shared.written(spark.range(3).toDF("id"), "t")
    folder = Path(shared.run_folder(spark).removeprefix("file:"))
    assert df.count() == 3 and folder.exists()
    shared.dropped(df)
    assert not any(p.name.startswith("t-") for p in folder.iterdir())
    shared.cleanup(spark)
    assert not folder.exists() and shared.written(spark.range(2).toDF("id"), "t").count() == 2
