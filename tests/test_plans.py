"""Plans: what is pushed down, how often data is exchanged, and that nothing is a nested loop."""

import glob
import os
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tremolite import timeaxis
from tremolite.operators import intervals, process, select

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data here")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@needs_data
def test_time_range_reaches_the_scan(spark):
    df = select.between(spark.read.parquet(f"{SF}/readings.parquet"), 0, 5, "t").select("rd_id")
    p = plan(df)
    assert "GreaterThanOrEqual(t,0)" in p and "LessThanOrEqual(t,5)" in p
    assert set(re.search(r"ReadSchema: struct<([^>]*)>", p)[1].split(",")) == {"rd_id:bigint", "t:bigint"}


def _windows(p: str) -> list[str]:
    """What the windows of a plan are partitioned by."""
    return re.findall(r"Window \[.*?\], \[(_?[^\]]*)\], \[", p)


@pytest.mark.parametrize("name", ["segments", "collapse", "diff", "int", "taper", "near", "asof", "append", "bag"])
def test_long_channels_are_cut_into_shards(spark, name):
    """Windows over data are partitioned by shard too; those over a whole channel see the table with one row a shard."""
    x = spark.createDataFrame([("a", 1, 1.0)], "id string, t_us bigint, x double").repartition(2)
    s = x.withColumn("seg", F.lit(0))
    packets_ = spark.createDataFrame([("a", 1, 1, 5, 10)], "id string, ord bigint, t0_us bigint, n bigint, dt_us bigint").repartition(2)
    from tremolite.streaming import packets

    df = {
        "segments": lambda: timeaxis.segments_of_samples(x, ["id"], "t_us", 10), "collapse": lambda: timeaxis.collapse(x, ["id"], "t_us", 10),
        "diff": lambda: process.differentiate(s, ["id"], 1.0), "int": lambda: process.integrate(s, ["id"], 1.0), "taper": lambda: process.taper(s, ["id"], 1.0),
        "near": lambda: process.merge_near(x, ["id"], 10), "asof": lambda: select.asof_join(x, x, "id", "t_us", "x"), "append": lambda: packets.segments_batch(packets_),
        "bag": lambda: select.bag_difference(x, x, ["id"], "t_us"),
    }[name]()
    p = plan(df)
    wins = [re.sub(r"#\d+L?", "", w) for w in re.findall(r"windowspecdefinition\(([^()]*(?:\([^()]*\))?[^()]*?) (?:ASC|DESC)", p)]
    assert wins and all("_key" in w and ("_sh," in w or w.endswith("_sh")) for w in wins), wins
    # a window that isn't over shards reads an aggregate by shard
    for line in p.splitlines():
        if "Window [" in line and "], [_key#" in line and "_sh#" not in line.split("], [")[1]:
            assert re.search(r"_(sum|last|n|first|head|before|step|w\d)#|_carry#|_off#", line), line


def test_segments_exchange_data_once(spark):
    df = spark.createDataFrame([("a", 1, 1.0)], "id string, t_us bigint, x double").repartition(2)
    p = plan(timeaxis.segments_of_samples(df, ["id"], "t_us", 10))
    big = re.findall(r"Exchange hashpartitioning\(_key#\d+, _sh#\d+L, \d+\), ENSURE_REQUIREMENTS", p)
    assert len(big) <= 3  # the data (twice the same, run once) and the table of shards


def test_no_window_over_a_whole_channel_for_its_mean(spark):
    df = spark.createDataFrame([("a", 1, 1.0)], "id string, t_us bigint, x double")
    for f in (process.demean, process.nanfill, process.detrend):
        assert "Window" not in plan(f(df, ["id"]))


def test_periods_never_sort_a_whole_channel(spark):
    df = spark.createDataFrame([("a", 1, 2)], "id string, s bigint, e bigint")
    p = plan(intervals.periods_and_gaps(df, "id", "s", "e", F.lit(0)))
    # windows over data run within (channel, shard); those over a channel see one row a shard
    for w in re.findall(r"Exchange hashpartitioning\(([^)]*)\)", p):
        assert "_key" in w
    assert "Cartesian" not in p and "NestedLoop" not in p


#: Queries that join a table of one row (a maximum, a common window, a check): a nested loop over one row is no product.
ONE_ROW = {"append_channels", "law_union", "live_streams", "nodal_append", "note_channels", "sync_first_last_pad", "sync_last_none"}


@needs_data
@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_no_cartesian_products_and_nested_loops(spark, name):
    if name.startswith(("stream_", "p7_", "p8_", "file_", "source_", "sql_")):
        pytest.skip("runs work to be planned, or plans nothing")
    p = plan(entry.queries()[name](spark, SF))
    assert "CartesianProduct" not in p and ("NestedLoop" not in p or name in ONE_ROW)


@needs_data
def test_entry_and_contract(spark):
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) > 60
    assert entry.entry(spark).count() > 0


def test_core_does_not_know_the_llm_package():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for p in glob.glob(f"{root}/tremolite/**/*.py", recursive=True):
        if "/llm/" not in p:
            assert "tremolite.llm" not in open(p).read(), p
