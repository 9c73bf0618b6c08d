"""Settings files, and that the work on workspaces is dealt to all tasks."""

import pathlib
import re

import pytest
from pyspark.sql import functions as F

from memloom.functions.settings import settings
from memloom.functions.text import strip, trim
from memloom.plans import views as v

SF = "/root/testdata/sf0.001"


def test_strip_is_trim(spark):
    white = [chr(c) for c in range(0x3001) if re.match(r"\s", chr(c)) or c in (0x180E, 0x200B, 0xFEFF)]
    texts = ["", "a", " a b ", *[f"{w}a{w}b{w}{w}" for w in white], "".join(white)]
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string")
    assert df.where(~strip(F.col("t")).eqNullSafe(trim(F.col("t")))).count() == 0


def test_values_of_all_kinds(spark):
    text = ('a = "x # y" # z\nb = \'l"\' \n "c" = 5 # n\n#d = 1\n e = "un\\"q\\\\s"\nf = "open\ng=\n[ s."t" ]\n h = true\n[x]\n[[y]]\ni=\'')
    rows = spark.createDataFrame([(text,)], "t string").select(F.inline(settings(F.col("t")))).collect()
    assert [tuple(r) for r in rows] == [
        ("", "a", "x # y", True), ("", "b", 'l"', True), ("", "c", "5", False), ("", "e", 'un"q\\s', True),
        ("", "f", '"open', True), ("", "g", "", False), ("s.t", "h", "true", False), ("[y", "i", "'", True)]


@pytest.mark.skipif(not pathlib.Path(SF).is_dir(), reason="tables not there")
def test_files_of_customers_are_dealt_to_all_tasks(spark):
    used = v.customer_files(spark, SF).select(F.spark_partition_id().alias("p")).distinct().count()
    assert used == int(spark.conf.get("spark.sql.shuffle.partitions"))


@pytest.mark.skipif(not pathlib.Path(SF).is_dir(), reason="tables not there")
def test_contents_are_not_sorted_for_an_inventory(spark):
    from memloom.operators.report import workspace_inventory

    plan = workspace_inventory(v.customer_files(spark, SF))._jdf.queryExecution().optimizedPlan().toString()
    assert "_own" in plan.split("\n")[1]
