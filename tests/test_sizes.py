"""What is written, moved and held for larger inputs."""

import os
import re

import pytest
from pyspark.sql import functions as F

from scholarflow import session
from scholarflow.operators import panels as P
from scholarflow.operators import ranks
from scholarflow.operators import regression as R

PANEL = "unit int, year int, y double, x double"


def panel(units):
    return [(u, t, float(u % 7 + t * (u % 3)), float((u * 5 + t * t) % 11)) for u in range(units) for t in range(4)]


def above(df, node):
    """The plan's lines before the first that names the node."""
    lines = df._jdf.queryExecution().executedPlan().toString().split("\n")
    return "\n".join(lines[: next(i for i, line in enumerate(lines) if node in line)])


def test_fits_leave_no_tables(spark):
    folder = session.shared_folder(spark)
    before = set(os.listdir(folder))
    R.fixed_effects(spark.createDataFrame(panel(20), PANEL), "y", ["x"], ["unit", "year"], "unit")
    assert set(os.listdir(folder)) == before


def test_passing_deletes_its_own_cuts_only(spark):
    kept = ranks.cut(spark.range(5))
    with ranks.passing(spark):
        gone = ranks.cut(spark.range(3))
        path = gone.inputFiles()[0].removeprefix("file:")
        assert os.path.exists(path)
    assert not os.path.exists(path) and kept.count() == 5


def test_units_meet_once(spark):
    """Effects and what is left are worked out within a unit's row: after it is written no row moves."""
    rows = spark.createDataFrame(panel(20), PANEL).withColumn("by", F.lit("a"))
    held = R._Arrays(rows, ["y", "x"], "unit", ["year"], None, "by")
    held.add([("a", 0, str(t), 0.5 * t, 0.1) for t in range(4)])
    assert "Exchange hashpartitioning(unit" not in (plan := held.left()._jdf.queryExecution().executedPlan().toString()) and "hashpartitioning(by" not in plan
    # each unit's means are gone, with and without arrays
    for large in (R._Arrays, R._Joined):
        some = large(rows, ["y", "x"], "unit", ["year"], None, "by")
        some.add([("a", 0, str(t), 0.5 * t, 0.1) for t in range(4)])
        assert max(abs(r[1]) for r in some.left().groupBy("unit").agg(F.sum("y")).collect()) < 1e-9


def test_large_units_give_the_same_fit(spark, monkeypatch):
    df = spark.createDataFrame(panel(30), PANEL)
    one = R.fixed_effects(df, "y", ["x"], ["unit", "year"], "unit")
    monkeypatch.setattr(R, "MAX_ROWS", 3)
    two = R.fixed_effects(df, "y", ["x"], ["unit", "year"], "unit")
    assert abs(one.beta[0] - two.beta[0]) < 1e-10 and abs(one.se[0] - two.se[0]) < 1e-10 and (one.n, one.groups, one.converged) == (two.n, two.groups, two.converged)


def test_exposures_move_works_not_years(spark):
    totals = spark.createDataFrame([(w, w % 3, 1990 + w % 9) for w in range(30)], "work_id bigint, author_id bigint, pub_year int")
    edges = spark.createDataFrame([(w, w - 3) for w in range(3, 30)], "citing bigint, cited bigint")
    counts = spark.createDataFrame([(w, 1995 + w % 5, 2) for w in range(30)], "work_id bigint, year int, cite_counts bigint")
    out = P.exposure(totals, counts, edges, 1995, 2001, keep=("pub_year",))
    assert "Exchange" not in above(out, "Generate explode") and out.columns[-1] == "pub_year" and out.count() > 30


def test_parts_follow_the_input(spark, tmp_path):
    keys = ("spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.initialPartitionNum")
    old = [spark.conf.get(k, None) for k in keys]
    try:
        spark.conf.set(keys[0], "64MB")
        spark.conf.unset(keys[1])
        with open(tmp_path / "x", "wb") as f:
            f.truncate(100 << 20)
        session.spread(spark, str(tmp_path))
        assert (spark.conf.get(keys[0]), spark.conf.get(keys[1])) == (str(8 << 20), "50")
        spark.conf.set(keys[0], "16k")
        session.spread(spark, str(tmp_path))
        assert spark.conf.get(keys[0]) == "16k"
    finally:
        for k, v in zip(keys, old, strict=True):
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_larger_inputs_have_no_more_batches(spark, tmp_path, monkeypatch):
    from scholarflow.plans import queries as Q

    made = []
    add = Q.incremental.add_counts
    monkeypatch.setattr(Q.incremental, "add_counts", lambda target: lambda batch, n: (made.append(n), add(target)(batch, n))[1])

    def dated(spark, d, root):
        rows = [(i, i % 7, 2000) for i in range(60)]
        spark.createDataFrame(rows, "citing bigint, cited bigint, year int").repartition(30).write.parquet(f"{root}/in")

    monkeypatch.setattr(Q, "_dated_edges", dated)
    got = {(r.work_id, r.year): r.cite_counts for r in Q.a5_running_cite_counts(spark, str(tmp_path)).collect()}
    assert len(made) <= Q.BATCHES and got == {(k, 2000): len(range(k, 60, 7)) for k in range(7)}


def test_json_lines_in_folders_in_one_pass(spark, tmp_path):
    from scholarflow.sources import readers, sinks

    seen = spark.sparkContext.accumulator(0)

    def look(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = spark.createDataFrame([(f"W{i}", "ab"[i % 2]) for i in range(10)], "id string, updated_date string").mapInArrow(look, "id string, updated_date string")
    sinks.write_jsonl(rows, str(tmp_path / "works"), by=["updated_date"])
    assert seen.value == 10
    assert sorted((r.id, r.updated_date) for r in readers.read_works(spark, str(tmp_path / "works")).collect()) == [(f"W{i}", "ab"[i % 2]) for i in range(10)]


def test_only_named_fields_are_parsed(spark):
    from scholarflow.operators import normalize as N
    from scholarflow.sources import readers

    lines = spark.createDataFrame([('{"id": "W1", "title": "t", "publication_year": 2000, "authorships": [{"author": {"id": "A"}}], "referenced_works": ["x"]}',)], "value string")
    some = readers.parse_works(lines, only=N.OF_WORKS)
    assert "authorships" not in some.columns and N.works(some).collect() == N.works(readers.parse_works(lines)).collect()


def test_authorships_move_once(spark):
    from scholarflow.plans import bridge as B

    plan = B.authorships(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "HashAggregate" not in plan[plan.index("Exchange"):]


def test_scans_are_split_for_larger_inputs(spark, tmp_path):
    key = "spark.sql.files.maxPartitionBytes"
    old = spark.conf.get(key)
    try:
        spark.conf.set(key, "128MB")
        session.spread(spark, str(tmp_path))
        assert spark.conf.get(key) == str(8 << 20)
        spark.conf.set(key, "1m")
        session.spread(spark, str(tmp_path))
        assert spark.conf.get(key) == "1m"
    finally:
        spark.conf.set(key, old)


def test_lines_are_collected_where_their_order_is(spark):
    from scholarflow.plans import queries as Q

    plan = Q.json_works(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    last = plan.rindex("ObjectHashAggregate")
    assert "Exchange" in plan[last:] and plan.count("Exchange hashpartitioning(l_orderkey") == 1


JOINED = ("spark.sql.adaptive.enabled", "spark.sql.adaptive.coalescePartitions.enabled")


@pytest.fixture
def unjoined(spark):
    """The session with small shuffle parts left as they are; what spread() sets is taken back."""
    keys = (*JOINED, "spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.initialPartitionNum")
    old = {k: spark.conf.get(k, None) for k in keys}
    spark.conf.unset(keys[-1])
    yield spark
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.mark.parametrize("key", JOINED)
def test_parts_follow_the_input_without_joining(unjoined, tmp_path, key):
    unjoined.conf.set(key, "false")
    with open(tmp_path / "x", "wb") as f:
        f.truncate(100 << 20)
    session.spread(unjoined, str(tmp_path))
    assert unjoined.conf.get("spark.sql.shuffle.partitions") == "50"
    assert len(unjoined.range(100).repartition("id").groupBy("id").count()._jdf.queryExecution().toRdd().partitions()) == 50
    unjoined.conf.set("spark.sql.shuffle.partitions", "60")
    session.spread(unjoined, str(tmp_path))
    assert unjoined.conf.get("spark.sql.shuffle.partitions") == "60"


@pytest.mark.parametrize("name", ["j4_j5_target_cite_counts", "u5_difference", "k14_streamed_cite_counts", "a1_author_totals", "a27_growth_concentration", "a32_parameter_grid", "a14_mean_of_author_means", "a17_pair_deltas"])
def test_queries_have_parts_for_their_input(unjoined, monkeypatch, name):
    """Without joining either, a task's share doesn't grow with the table: every shuffle has parts for the largest one."""
    from scholarflow.plans import queries as Q

    folder = "/root/testdata/sf0.001"
    monkeypatch.setattr(session, "INPUT", 4 << 10)
    needed = os.path.getsize(f"{folder}/lineitem.parquet") // session.INPUT
    unjoined.conf.set(JOINED[0], "false")
    plan = Q.QUERIES[name](unjoined, folder)._jdf.queryExecution().executedPlan().toString()
    made = {int(n) for n in re.findall(r"Exchange hashpartitioning\(.*, (\d+)\)", plan)}
    assert needed > 4 and made == {needed}
