"""Tables of one file are dealt out before work that is dear by row."""

import pytest

import __spark_entry__ as entry_points

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["linkedin_company", "howto_numbered", "faq_accordion", "howto_from_headings"])
def test_parts_are_parsed_by_all_tasks(spark, name):
    sizes = entry_points.queries()[name](spark, SF).rdd.glom().map(len).collect()
    assert len(sizes) == int(spark.conf.get("spark.sql.shuffle.partitions")) and min(sizes) > 0
