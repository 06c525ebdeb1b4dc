import os

import pytest
from palisade.plans import load_all
from palisade.plans.registry import JOBS
from pyspark.sql import functions as F

load_all()
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    """The tables as folders of 12 part files whose rows are in no order of time."""
    folder = str(tmp_path_factory.mktemp("parts"))
    for name in ("conversations", "events"):
        spark.read.parquet(f"{DATA}/{name}.parquet").repartition(12, F.rand(3)).write.parquet(f"{folder}/{name}.parquet")
        assert sum(f.startswith("part-") for f in os.listdir(f"{folder}/{name}.parquet")) > 8
    spark.read.parquet(f"{DATA}/customer.parquet").write.parquet(f"{folder}/customer.parquet")
    return folder


@pytest.mark.parametrize("key", ["stream_quarantine", "stream_cross_leaks", "stream_score_conversations", "stream_detection_counts", "stream_tainted_context"])
def test_stream_over_part_files_equals_one_file(spark, parts, key):
    rows = lambda folder: sorted(map(str, JOBS[key](spark, folder).collect()))
    want = rows(DATA)
    assert want and rows(parts) == want
