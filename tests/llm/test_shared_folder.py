import subprocess
import sys
from pathlib import Path
from types import SimpleNamespace

import pytest

from shelfmark.llm import common

RUN = """
import sys
from pyspark.sql import SparkSession
from shelfmark.llm.queries import QUERIES

folder = sys.argv[1]
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").config("spark.sql.warehouse.dir", folder + "/warehouse").getOrCreate()
rows = [(i, f"some words of text {i % 3} and more of them " * 4, "en", "s", 9) for i in range(6)]
spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(folder + "/documents.parquet")
spark.createDataFrame([(i, 1, i % 2) for i in range(6)], "doc_id long, quality int, toxic int").write.parquet(folder + "/labels.parquet")
spark.createDataFrame([(1, "some words of text")], "item_id long, text string").write.parquet(folder + "/benchmark.parquet")
spark.createDataFrame([(1, "http://a.b/c")], "page_id long, url string").write.parquet(folder + "/pages.parquet")
for name, query in QUERIES.items():
    print(name, query(spark, folder).count())
"""


def test_every_operator_runs_where_no_folder_is_named(tmp_path):
    found = subprocess.run([sys.executable, "-c", RUN, str(tmp_path)], cwd=Path(__file__).parents[2], capture_output=True, text=True)
    assert found.returncode == 0, found.stderr[-2000:]
    assert len(found.stdout.strip().split("\n")) == 10


def test_a_cluster_needs_a_folder():
    session = lambda master, folder: SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: {"spark.checkpoint.dir": folder, "spark.sql.warehouse.dir": "/w"}.get(k) or d), sparkContext=SimpleNamespace(master=master))
    assert common.shared_dir(session("spark://x", "/shared")) == "/shared"
    assert common.shared_dir(session("local[2]", None)) == "/w/_stages"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(session("local-cluster[2,1,1024]", None))


def test_discarded_tables_are_empty(spark):
    found = common.staged(spark.range(100), "gone")
    path = common._PATHS[found]
    common.discard(found)
    assert spark.read.parquet(path).count() == 0
