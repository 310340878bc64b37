"""Each query over source trees parses its files once, and deals them over all tasks first."""

from __future__ import annotations

import pytest

from loamline.plans import trees

from . import test_oracles


def readings(frame) -> int:
    """How often the plan, as it ran, parses the files."""
    frame.collect()
    return frame._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("MapInArrow")


@pytest.mark.parametrize("name", ["god_class_raw", "tcc", "god_class_report", "god_class_files", "anemic_files", "anemic_report", "touch_counts"])
def test_files_are_parsed_once(spark, sf_dir, name):
    assert readings(trees.QUERIES[name](spark, sf_dir)) == 1


@pytest.mark.parametrize("name", ["god_class_raw", "tcc", "god_class_report", "god_class_files", "anemic_report", "touch_counts"])
def test_same_rows_as_sql(spark, sf_dir, name):
    test_oracles.test_same_rows(spark, sf_dir, name)


def test_one_small_split_is_dealt_to_many_tasks(spark, sf_dir):
    assert trees.read(spark, sf_dir, "classes").rdd.getNumPartitions() == 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
