import gzip
import hashlib
import json

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from scholarflow.functions import columns as C
from scholarflow.operators import cite_counts as O
from scholarflow.operators import events as E
from scholarflow.operators import matching as M
from scholarflow.operators import normalize as N
from scholarflow.operators import panels as P
from scholarflow.operators import regression as R
from scholarflow.plans import queries as Q
from scholarflow.sources import leases, readers, sinks

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["q1_normalize_works", "q3_calculated_cite_counts", "q4_hit_events", "q6_hit_panel", "q8_exposure_panel", "q10_threshold_event_study", "q15_event_cells", "q20_coverage_audit", "k14_streamed_cite_counts"])
def test_against_oracle(spark, name):
    con = duckdb.connect()
    for t in ("customer", "orders", "lineitem"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = Q.QUERIES[name](spark, SF).toPandas(), con.execute(Q.ORACLES[name]).fetchdf()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)

    def plain(x):
        x = x[columns].copy()
        for c in columns:
            if x[c].dtype.kind in "fi":
                x[c] = x[c].astype(float).round(6)
        return sorted(x.astype(str).itertuples(index=False, name=None))

    assert plain(got) == plain(want)


def test_functions(spark):
    df = spark.createDataFrame([("12", "Économie & Co!", "Ab, c-D", "a/b/c"), ("3.7", "", None, "x"), (None, None, "", None)], "n string, s string, t string, u string")
    rows = df.select(C.int_or_zero(F.col("n")).alias("a"), C.int_or_zero_json(F.col("n")).alias("b"), C.slugify(F.col("s")).alias("c"), C.normalized_title(F.col("t")).alias("d"), C.last_segment(F.col("u")).alias("e")).collect()
    assert [tuple(r) for r in rows] == [(12, 12, "conomie_co", "ab c d", "c"), (0, 3, "unknown", None, "x"), (0, 0, "unknown", "", None)]
    assert spark.range(1).select(C.blake2b_bucket(F.lit("A1"), 250)).first()[0] == int.from_bytes(hashlib.blake2b(b"A1", digest_size=8).digest(), "big") % 250


def test_normalize_json(spark, tmp_path):
    works = [
        {"id": "W1", "display_name": "", "title": "T", "publication_year": "2001", "cited_by_count": 12.7, "authorships": [{"author": {"id": None}}, {"author_position": "last", "author": {"id": "A2", "display_name": "B"}}], "counts_by_year": [{"year": None, "cited_by_count": 3}, {"year": 2002, "cited_by_count": "4"}], "referenced_works": ["W0", "W2", "W0"]},
        {"id": "W2", "publication_year": 0},
        {"id": "", "publication_year": 1999},
    ]
    with gzip.open(tmp_path / "a.gz", "wt") as f:
        f.write("\n\n".join(map(json.dumps, works)))
    raw = readers.read_works(spark, str(tmp_path))
    made = N.normalize(raw)
    w = made["works"].collect()
    assert [(r.work_id, r.title, r.publication_year, r.cited_by_count, r.fwci, r.referenced_works_count) for r in w] == [("W1", "T", 2001, 12, None, 3)]
    assert [tuple(r) for r in made["work_authors"].collect()] == [("W1", "A2", "B", "last", 2)]
    assert [tuple(r) for r in made["work_cites_by_year"].collect()] == [("W1", 2002, 4)]
    assert sorted(r.referenced_work_id for r in made["work_references"].collect()) == ["W0", "W2"]
    assert N.work_references(raw, dedupe=False).count() == 3
    wanted = spark.createDataFrame([("W1",)], "id string")
    assert readers.references_of(spark, str(tmp_path), wanted).count() == 3


def test_tables_and_chunks(spark, tmp_path):
    (tmp_path / "t").mkdir()
    with gzip.open(tmp_path / "t/part_0000_works.csv.gz", "wt") as f:
        f.write('work_id,title,publication_year,type,cited_by_count,fwci,field_id,field_name,subfield_id,subfield_name,topic_id,topic_name,referenced_works_count\nW1,"a ""q"", b",2001,article,x,,,,,,,,2\n')
    row = readers.read_table(spark, str(tmp_path / "t"), "works").first()
    assert (row.title, row.publication_year, row.cited_by_count, row.fwci, row.referenced_works_count) == ('a "q", b', 2001, None, None, 2)
    with pytest.raises(FileNotFoundError):
        readers.read_table(spark, str(tmp_path / "t"), "work_authors")
    store = sinks.Warehouse(spark, str(tmp_path / "w"))
    df = spark.createDataFrame([("W1", 2001, 3)], "work_id string, year int, cite_counts bigint")
    assert store.load("econ", "work_cites_by_year", df) == 1
    assert store.load("econ", "work_cites_by_year", df) == 0
    assert sinks.plan_chunks(["d", "b", "a", "c"], 2) == [["a", "b"], ["c", "d"]]


def test_coverage(spark):
    focal = spark.createDataFrame([("W1",), ("W2",), ("W3",), ("W4",)], "work_id string")
    recorded = spark.createDataFrame([("W1", 3), ("W2", 0), ("W3", 4), ("W4", 2)], "work_id string, cites bigint")
    calc = spark.createDataFrame([("W1", 1), ("W1", 2), ("W3", 5), ("W4", 1)], "work_id string, cite_counts bigint")
    assert tuple(O.coverage(focal, calc, recorded).first()) == (4, 2, 0, 1, 1, 2)
    assert tuple(O.coverage(focal, calc.where("work_id = 'W1'"), recorded).first()) == (4, 2, 2, 0, 0, 0)


def test_two_way_effects_against_numpy(spark):
    rng = np.random.default_rng(3)
    rows = [(int(w), int(t), float(rng.normal()), float(rng.normal())) for w in range(40) for t in range(6) if rng.random() < 0.8]
    df = spark.createDataFrame(rows, "w int, t int, y double, x double")
    fit = R.fixed_effects(df, "y", ["x"], ["w", "t"], "w", tolerance=1e-10, passes=40)
    w, t, y, x = (np.array(c) for c in zip(*rows, strict=True))
    dummies = np.column_stack([x, *(w == i for i in range(40)), *(t == i for i in range(1, 6))]).astype(float)
    beta, *_ = np.linalg.lstsq(dummies, y, rcond=None)
    assert abs(fit.beta[0] - beta[0]) < 1e-7
    e = y - dummies @ beta
    xr = x - dummies[:, 1:] @ np.linalg.lstsq(dummies[:, 1:], x, rcond=None)[0]
    g = len(set(w.tolist()))
    meat = sum((xr[w == i] @ e[w == i]) ** 2 for i in set(w.tolist()))
    se = np.sqrt(g / (g - 1) * (len(y) - 1) / max(1, len(y) - (g + 6 - 1) - 1) * meat / (xr @ xr) ** 2)
    assert abs(fit.se[0] - se) < 1e-6


def test_panel_states(spark):
    pairs = spark.createDataFrame([(1, 10, 2000, 20, 1, 0.5, 1999)], "author_id int, hit int, hit_year int, hit_cites int, focal int, share double, focal_year int")
    cby = spark.createDataFrame([(1, 2001, 4)], "work_id int, year int, cite_counts bigint")
    got = [(r.event_time, r.cite_counts, r.observed) for r in P.balanced(pairs, cby, 2).orderBy("event_time").collect()]
    assert got == [(-2, 0, 1), (-1, None, 0), (0, None, 0), (1, 4, 1), (2, None, 0)]
    assert [r.cite_counts for r in P.balanced(pairs, cby, 2, zero_fill=True).orderBy("event_time").collect()] == [0, 0, 0, 4, 0]


def test_matching_and_versions(spark):
    w = spark.createDataFrame([(i, i % 5, 2000, "a", i) for i in range(10)], "work_id int, author_id int, pub_year int, type string, cites int")
    got = M.matched_controls(w.where("work_id < 3"), w, ["pub_year", "type"]).collect()
    assert len({r.control for r in got}) == 3 and all(r.control >= 3 for r in got)
    v = spark.createDataFrame([("a", 1, "The Big Result", 2000, 9, ""), ("a", 2, "The big result.", 2001, 3, ""), ("a", 3, "Other", 2000, 1, "d"), ("a", 4, "Quite another", 2010, 0, "d")], "author_id string, work_id int, title string, year int, cites int, doi string")
    assert {r.work_id: r.leader for r in M.version_clusters(v).collect()} == {1: 1, 2: 1, 3: 3, 4: 3}


def test_order_statistics(spark):
    values = [0, 0, 3, 5, 9, 9, 12]
    row = E.order_statistics(spark.createDataFrame([(v,) for v in values], "v bigint"), "v").first()
    assert (row.n, row.p50, row.p90, row.p99, row.max) == (7, values[3], values[5], values[5], 12)


def test_backfill(spark, tmp_path):
    source, target = tmp_path / "source", str(tmp_path / "target")
    for day in ("a", "b"):
        (source / f"updated_date={day}").mkdir(parents=True)
        with gzip.open(source / f"updated_date={day}/part_0.gz", "wt") as f:
            f.write(json.dumps({"authorships": [{"author": {"id": "A1"}}], "id": f"W{day}", "referenced_works": ["R1", "R2"]}) + "\n")
    raw = readers.read_works(spark, str(source))
    assert sorted((r.id, r.updated_date) for r in raw.collect()) == [("Wa", "a"), ("Wb", "b")]
    assert readers.read_works(spark, str(source), max_files=1).count() == 1
    wanted = spark.createDataFrame([("Wa",)], "id string")
    work = lambda files: readers.references_of(spark, files, wanted)
    assert sinks.backfill(spark, str(source), target, work, 1) == [0, 1]
    assert sinks.backfill(spark, str(source), target, work, 1) == []
    assert sorted(r.referenced_work_id for r in spark.read.parquet(f"{target}/chunk=000000").collect()) == ["R1", "R2"]
    assert spark.read.parquet(f"{target}/chunk=000001").count() == 0  # no references are a result too
    part = next((tmp_path / "target/chunk=000000").glob("*.parquet"))
    part.write_bytes(part.read_bytes()[:-1] + b"x")
    (tmp_path / "target/chunk=000000" / f".{part.name}.crc").unlink(missing_ok=True)
    assert sinks.backfill(spark, str(source), target, work, 1) == [0]
    with leases.Lease(spark, f"{target}/_lease"), pytest.raises(RuntimeError):
        sinks.backfill(spark, str(source), target, work, 1)
    (tmp_path / "target/other").mkdir()
    with gzip.open(source / "updated_date=b/part_1.gz", "wt") as f:
        f.write("")
    with pytest.raises(ValueError):
        sinks.backfill(spark, str(source), target, work, 1)
    assert sinks.backfill(spark, str(source), target, work, 1, reset=True) == [0, 1, 2] and (tmp_path / "target/other").exists()


def test_files_and_manifests(spark, tmp_path):
    for day in ("a", "b"):
        (tmp_path / "in" / day).mkdir(parents=True)
        (tmp_path / "in" / day / "part_0.gz").write_bytes(day.encode() * 5)
    root = str(tmp_path / "in")
    known = readers.manifest_of(spark, root)
    assert sorted((r.path, r.bytes) for r in known.collect()) == [("a/part_0.gz", 5), ("b/part_0.gz", 5)]
    manifest = spark.createDataFrame([("a/part_0.gz", 5), ("b/part_0.gz", 6), ("c/part_0.gz", 5)], "path string, expected bigint")
    assert sorted((r.path, r.complete) for r in readers.inventory(spark, root, manifest).collect()) == [("a/part_0.gz", True), ("b/part_0.gz", False), ("c/part_0.gz", False)]
    rows = spark.createDataFrame([(r.path, r.bytes + (r.path[0] == "b"), r.sha256) for r in known.collect()] + [("d", 1, "x")], "path string, bytes bigint, sha256 string")
    assert {r.path: r.problem for r in readers.checked(spark, root, rows).collect()} == {"a/part_0.gz": None, "b/part_0.gz": "size", "d": "missing"}
    (tmp_path / "in/a/part_0.gz").write_bytes(b"xxxxx")
    assert {r.path: r.problem for r in readers.checked(spark, root, rows).collect()}["a/part_0.gz"] == "checksum"
    df = spark.range(3)
    sinks.publish(df, str(tmp_path / "out"), "one")
    sinks.publish(df.union(df), str(tmp_path / "out"), "two")
    assert sinks.published(spark, str(tmp_path / "out")).count() == 6
    made = sinks.export({"n": (df.withColumn("x", F.col("id") * 2.0), ["id"])}, str(tmp_path / "export"))
    assert made.where("path like 'rows/%.csv.gz' and bytes > 0 and length(sha256) = 64").count() > 0


def test_cells_with_null_keys_and_ranks(spark):
    from scholarflow.operators import ranks

    p = spark.createDataFrame([(0, 1, 1, "a"), (0, 2, 1, None), (1, None, 0, None)], "event_time int, cite_counts int, observed int, cohort string")
    got = sorted((r.dimension, r.level, r.event_time, r.rows) for r in E.cells(p, ["cohort"]).collect())
    assert got == [("cohort", "a", 0, 1), ("cohort", "unknown", 0, 1), ("cohort", "unknown", 1, 1), ("event_time", "", 0, 2), ("event_time", "", 1, 1)]
    df = spark.range(200).selectExpr("id", "id % 3 as cell", "pmod(hash(id), 50) as x")
    rows = ranks.ranked(df, ["cell"], ["x", "id"]).collect()
    for c in range(3):
        mine = sorted((r.x, r.id, r["rank"]) for r in rows if r.cell == c)
        assert [k for _, _, k in mine] == list(range(1, len(mine) + 1))
    assert ranks.quantiles(df, ["x"], 0.99)["x"] == pytest.approx(float(np.quantile([r.x for r in rows], 0.99)))


def test_three_ways_against_numpy(spark):
    rng = np.random.default_rng(5)
    rows = [(int(w), int(t), int(rng.integers(4)), float(rng.normal()), float(rng.normal())) for w in range(25) for t in range(6)]
    df = spark.createDataFrame(rows, "w int, t int, k int, y double, x double")
    fit = R.fixed_effects(df, "y", ["x"], ["w", "t", "k"], "w", tolerance=1e-9, passes=60)
    w, t, k, y, x = (np.array(c) for c in zip(*rows, strict=True))
    dummies = np.column_stack([x, *(w == i for i in range(25)), *(t == i for i in range(1, 6)), *(k == i for i in range(1, 4))]).astype(float)
    assert fit.converged and abs(fit.beta[0] - np.linalg.lstsq(dummies, y, rcond=None)[0][0]) < 1e-6
    assert not R.fixed_effects(df, "y", ["x"], ["w", "t", "k"], "w", tolerance=1e-12, passes=0).converged
    plain = R.ols(df, "y", ["x"])
    b = x @ y / (x @ x)
    assert plain.se[0] == pytest.approx(float(np.sqrt(((y - b * x) ** 2).sum() / (len(y) - 1) / (x @ x))))
    free, share = R.partial_out(df, "y", "x", ["t"])
    ty, tx = y - t * (t @ y) / (t @ t), x - t * (t @ x) / (t @ t)
    assert share == pytest.approx(float((ty @ tx) ** 2 / (ty @ ty) / (tx @ tx)))


def test_controls_are_not_by_the_same_author(spark):
    w = spark.createDataFrame([(1, 7, 2000, "a", 5, 99)] + [(i, 7 if i < 6 else 8, 2000, "a", 5 if i < 6 else 6, 0) for i in range(2, 9)], "work_id int, author_id int, pub_year int, type string, topic int, cites int")
    got = M.matched_controls(w.where("cites > 0"), w, ["pub_year", "type"], "topic").collect()
    assert len(got) == 1 and (got[0].control is None or got[0].control_author == 8)
