"""Every operator is registered once; those that SQL can express agree with it."""

import pytest

import __spark_entry__ as driver
from tests.compare import connect, differences

FOLDER = "/root/testdata/sf0.001"


def test_names():
    names = [n for n in driver.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in driver.queries()


@pytest.mark.parametrize("name", ["op1_voronoi_knn", "op8_mix_sources", "op9_line_dedup", "op11_conversation_repair", "op12_merkle_manifest",
                                  "op13_hash_ring_shards"])
def test_against_sql(spark, name):
    assert differences(driver.queries()[name](spark, FOLDER), connect(FOLDER).sql(driver.oracle_sql()[name])) is None
