"""Roll-ups, validation, records, readers, writers and arrivals on small fixtures."""

from __future__ import annotations

import datetime
import json
import math
import random

import pytest
from pyspark.sql import functions as F
from tidewright.functions import scalars
from tidewright.operators import records, resampling, rollup, validate
from tidewright.sources import readers, writers
from tidewright.streaming import arrivals


def test_right_closed_bins(spark):
    df = spark.createDataFrame([(x,) for x in (0.0, 0.5, 1.0, 1.5, 2.0, 2.1)], "x double")
    got = [r[0] for r in df.select(scalars.binned("x", [0, 1, 2], ["a", "b"])).collect()]
    assert got == [None, "a", "a", "b", "b", None]


def test_bits(spark):
    df = spark.createDataFrame([(x,) for x in (0, 1, 4, 256, 1028)], "x long")
    assert [r[0] for r in df.select(scalars.is_clear("x")).collect()] == [True, False, False, False, False]


def test_aggregates_of_a_group(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 2.0), (1, -1.0), (1, None), (2, -3.0), (2, -1.0)], "g int, v double")
    got = {r["g"]: r for r in rollup.grouped(df, ["g"], {"v": ["mode", "sum_positive", "mean_positive", "positive_percentage", "count"]}).collect()}
    assert (got[1]["v_mode"], got[1]["v_sum_positive"], got[1]["v_count"], got[1]["entity_count"]) == (2.0, 4.0, 3, 4)
    assert (got[2]["v_mode"], got[2]["v_sum_positive"], got[2]["v_mean_positive"], got[2]["v_positive_percentage"]) == (-3.0, 0.0, None, 0.0)
    with pytest.raises(ValueError, match="none of"):
        rollup.grouped(df, ["g"], {"v": "no such"})


def test_shares_sum_to_a_hundred(spark):
    df = spark.createDataFrame([(c, v, v > 2) for c in "ab" for v in (-3.0, -1.0, 1.0, 3.0)] + [("a", None, None)], "c string, v double, s boolean")
    got = {r["c"]: r for r in rollup.signed_shares(df, "v", "s", "c", spark.createDataFrame([("a",), ("z",)], "c string")).collect()}
    parts = ("sig_rising", "rising", "sig_falling", "falling")
    assert sum(got["a"][p] for p in parts) == 100 and sum(got["z"][p] for p in parts) == 0


def test_permutation_p_values(spark):
    draw = random.Random(5)
    rows = [(1, draw.gauss(3, 1), draw.gauss(0, 1)) for _ in range(20)] + [(2, draw.gauss(0, 1), draw.gauss(0, 1)) for _ in range(20)] + [(3, None, 1.0)]
    got = {r["g"]: r for r in resampling.permutation_test(spark.createDataFrame(rows, "g int, a double, b double"), "g", "a", "b", 200).collect()}
    assert got[1]["p_greater"] < 0.02 and got[1]["p_less"] > 0.9 and 0.02 < got[2]["p_greater"] < 0.98 and 3 not in got
    assert got[1]["u"] == sum((a > b) + (a == b) / 2 for g, a, _ in rows if g == 1 for h, _, b in rows if h == 1)


def test_bootstrap_and_ks(spark):
    draw = random.Random(6)
    df = spark.createDataFrame([("a", draw.gauss(0, 1), draw.gauss(4, 1)) for _ in range(30)], "c string, v double, w double")
    medians = resampling.bootstrap(df, "c", "v", resamples=100)
    assert medians.count() == 100 and medians.select("value").distinct().count() > 5
    r = resampling.bootstrap_ks(df, "c", "v", "w", 50).first()
    assert r["d"] > 0.8 and r["p"] < 0.05


def test_validation_of_equal_and_shifted_series(spark):
    df = spark.createDataFrame([(1, float(k), float(k)) for k in range(12)] + [(2, float(k), k + 1.0) for k in range(12)] + [(3, 1.0, 1.0)], "id int, t double, p double")
    got = {r["id"]: r for r in validate.metrics(df, "t", "p", ["id"], 12).collect()}
    assert set(got) == {1, 2} and got[1]["r2"] == 1 and got[1]["rmse"] == 0 and got[2]["rmse"] == 1 and got[2]["pearson"] == pytest.approx(1)
    assert validate.spearman(df, "t", "p", ["id"]).where("id = 2").first()["spearman"] == pytest.approx(1)


def test_upsert(spark):
    old = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "k int, s string, v double")
    new = spark.createDataFrame([(2, None, 5.0, "x"), (3, "c", None, "y")], "k int, s string, v double, extra string")
    assert sorted(map(tuple, records.upserted(old, new, "k").collect())) == [(1, "a", 1.0, None), (2, "b", 5.0, "x"), (3, "c", None, "y")]
    assert sorted(map(tuple, records.upserted(None, new, "k").collect())) == sorted(map(tuple, new.collect()))
    again = new.union(spark.createDataFrame([(2, "z", 4.0, "a")], new.schema))
    assert sorted(map(tuple, records.upserted(old, again, "k").collect())) == [(1, "a", 1.0, None), (2, "z", 5.0, "x"), (3, "c", None, "y")]
    over = spark.createDataFrame([(1, 7.0), (1, 9.0), (2, None)], "k int, v double")
    assert sorted(map(tuple, records.overwritten(old, over, "k", ["v"]).collect())) == [(1, "a", 9.0), (2, "b", 2.0)]
    assert records.looked_up(old, "k", 2, ["v"])["v"] == 2.0 and records.looked_up(old, "k", 9, ["v"]) is None
    assert [r["k"] for r in records.discovered(new, old, "k").collect()] == [3]


def test_monthly_files(spark, tmp_path):
    for name, rows in {"12_2001-01-01_2001-02-01_area.csv": "7,1.5", "12_2001-02-01_2001-03-01_x_area.csv": "7,\n8,2", "readme_area.csv": "9,9"}.items():
        (tmp_path / name).write_text(f"id,area\n{rows}\n")
    got = sorted(map(tuple, readers.monthly_csvs(spark, str(tmp_path)).collect()))
    d = datetime.date
    assert got == [(12, d(2001, 1, 1), d(2001, 2, 1), 7, 1.5), (12, d(2001, 2, 1), d(2001, 3, 1), 7, None), (12, d(2001, 2, 1), d(2001, 3, 1), 8, 2.0)]


def test_wide_csv(spark, tmp_path):
    path = tmp_path / "w.csv"
    path.write_text("id,name,2001-01-01,2001-02-01\n5,a,1.0,nan\n")
    got = readers.wide_csv(spark, str(path), "id", ["2001-01-01", "2001-02-01"])
    assert sorted(map(tuple, got.collect())) == [(5, datetime.date(2001, 1, 1), 1.0), (5, datetime.date(2001, 2, 1), None)]


def test_wide_csvs_of_other_column_order(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,"name, long",2001-01-01,2001-02-01\n5,"x, y",1.0,2.0\n')
    (tmp_path / "b.csv").write_text("2001-02-01,id\n4.0,6\n")
    got = readers.wide_csv(spark, str(tmp_path), "id", ["2001-01-01", "2001-02-01"])
    d = datetime.date
    assert sorted(map(tuple, got.collect()), key=str) == [(5, d(2001, 1, 1), 1.0), (5, d(2001, 2, 1), 2.0), (6, d(2001, 1, 1), None), (6, d(2001, 2, 1), 4.0)]


def test_level_file_and_side_files(spark, tmp_path):
    head = ["header"] * 49
    head.insert(10, "Latitude and longitude 10.5 200.25")
    good = " ".join(str(k) for k in range(16))
    (tmp_path / "l.txt").write_text("\n".join([*head, good, good.replace("15", "9999.99"), "too few", good]))
    got = readers.level_files(spark, str(tmp_path / "l.txt")).collect()
    assert len(got) == 2 and (got[0]["lat"], got[0]["lon"], got[0]["f15"]) == (10.5, -159.75, 15.0)
    (tmp_path / "h.json").write_text(json.dumps({"loss": [3.0, 2.0], "iou": [0.1, 0.2]}))
    assert sorted(map(tuple, readers.history_json(spark, str(tmp_path / "h.json")).collect())) == [("iou", 0, 0.1), ("iou", 1, 0.2), ("loss", 0, 3.0), ("loss", 1, 2.0)]
    (tmp_path / "s.tsv").write_text("date\tlevel\n2001-01-05\t1\n2001-01-20\t3\n2001-02-01\tx\n")
    assert sorted(map(tuple, readers.tab_series(spark, str(tmp_path / "s.tsv"), "date", "level").collect())) == [(datetime.date(2001, 1, 1), 2.0), (datetime.date(2001, 2, 1), None)]


def test_sums_do_not_depend_on_order(spark):
    """Sums and means of doubles are the same to the bit in any order, and right to the last one."""
    draw = random.Random(4)
    values = [draw.uniform(-1e4, 1e4) / 7 for _ in range(20_000)]
    wanted = ["sum", "mean", "sum_positive", "sum_negative", "mean_positive", "mean_negative"]
    exact = [math.fsum(own) / n for own, n in ((w, m) for w in (values, [v for v in values if v > 0], [v for v in values if v < 0]) for m in (1, len(w)))]
    for seed in range(3):
        draw.shuffle(values)
        df = spark.createDataFrame([(v,) for v in values], "v double").repartition(5 + seed)
        r = rollup.grouped(df, [], {"v": wanted}).first()
        assert [r["v_sum"], r["v_mean"], r["v_sum_positive"], r["v_mean_positive"], r["v_sum_negative"], r["v_mean_negative"]] == exact
    odd = spark.createDataFrame([(1, None), (2, 1e300), (2, 3.0), (3, float("inf")), (4, float("nan")), (4, 1.0), (5, 1e-30), (5, None)], "k int, v double")
    got = {r["k"]: (r["v_sum"], r["v_mean"], r["v_sum_positive"]) for r in rollup.grouped(odd, ["k"], {"v": ["sum", "mean", "sum_positive"]}).collect()}
    assert got[1] == (None, None, 0.0) and got[2] == (1e300, 5e299, 1e300) and got[3][0] == got[3][1] == math.inf and math.isnan(got[4][0]) and got[5][:2] == (1e-30, 1e-30)


def test_level_files_are_parsed_once(spark, tmp_path):
    """Numbers and place are no expressions of single rows' filters: a line is split once, a header read once a file."""
    (tmp_path / "l.txt").write_text("\n".join(["Latitude and longitude 1 2", *["header"] * 49, " ".join(["1"] * 16)]))
    df = readers.level_files(spark, str(tmp_path))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("Generate")]
    assert "split(" not in above and "regexp_extract_all" not in above and "try_cast" not in above


def test_level_lines_of_all_kinds(spark, tmp_path):
    one = ["1"] * 15
    lines = [" ".join(["5", *one]), "  " + "  ".join(["6", *one]) + "  ", "\t".join(["7", *one]), " ".join(["8", *one]) + "\r", " ".join(["9", *one, "1"]), " ".join(["x", *one]), " ".join(["99999999", *one]), ""]
    for name, own in {"a.txt": lines, "b.txt": []}.items():
        (tmp_path / name).write_bytes("\n".join(["h"] * 49 + ["Latitude and longitude -1.5 -170", *own]).encode())
    got = readers.level_files(spark, str(tmp_path)).collect()
    assert sorted((r["file"], r["lat"], r["lon"], r["f0"]) for r in got) == [("a.txt", -1.5, -170.0, v) for v in (5.0, 6.0, 7.0, 8.0)]


def test_named_files_shuffle_no_heads(spark, tmp_path):
    """Files span batches; the head is made once a file, behind the shuffle."""
    path = f"file:{tmp_path}/f"
    df = spark.range(25_000).select((F.col("id") % 3).alias("k"), "id")
    made = writers.named_files(df, path, F.concat(F.col("k").cast("string"), F.lit(".txt")), F.concat_ws(" ", "k", "id"), "id", F.concat(F.lit("head of "), "k"))
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "head of" in plan and "head of" not in plan[plan.index("Window") :]
    assert sorted(map(tuple, made.collect())) == [("0.txt", 8334), ("1.txt", 8333), ("2.txt", 8333)]
    for k in range(3):
        assert (tmp_path / "f" / f"{k}.txt").read_text() == "\n".join([f"head of {k}", *(f"{k} {i}" for i in range(k, 25_000, 3))]) + "\n"
    assert len([p for p in (tmp_path / "f").iterdir() if not p.name.endswith(".crc")]) == 3


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, 10, [1.0]), (2, 20, [2.0])], "id int, basin int, rings array<double>")
    path = writers.written(df, str(tmp_path / "t.parquet"), "rings")
    assert spark.read.parquet(path).count() == 2 and spark.read.csv(f"{path}.attributes.csv", header=True).columns == ["id", "basin"]
    with pytest.raises(ValueError, match="none of"):
        writers.written(df, str(tmp_path / "t.xyz"))
    writers.by_basin(df, str(tmp_path / "b"), "basin")
    assert (tmp_path / "b" / "basin=10").is_dir()
    assert readers.parts(df.drop("rings"), df).where("rings is null").count() == 2


def test_arrivals_count_once(spark, tmp_path):
    """Files out of order, repeated, with nulls in key and value; a trigger writes the keys of its own rows only."""
    source, table, log = (str(tmp_path / n) for n in ("in", "table", "log"))
    schema = "id int, period string, v double, file int"
    stream = lambda: spark.readStream.schema(schema).parquet(source)
    put = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    rows = [(1, "a", 1.0, 2), (2, "a", 5.0, 1), (None, "a", None, 1), *((k, "b", float(k), 1) for k in range(10, 500))]
    put(rows)
    arrivals.ingest(stream(), table, log, ["id", "period"], ["file"])
    later = [(1, "a", 9.0, 1), (2, "a", 6.0, 3), (2, "a", 7.0, None)]
    put(later)
    state = arrivals.ingest(stream(), table, log, ["id", "period"], ["file"]).recentProgress[0]["stateOperators"][0]
    assert state["numRowsUpdated"] == 2 and state["numRowsTotal"] == 493
    put(later)
    arrivals.ingest(stream(), table, log, ["id", "period"], ["file"])
    arrivals.ingest(stream(), table, log, ["id", "period"], ["file"])
    got = {(r["id"], r["period"]): r["v"] for r in arrivals.current(spark, log).collect()}
    assert len(got) == 493 and (got[1, "a"], got[2, "a"], got[None, "a"], got[77, "b"]) == (1.0, 6.0, None, 77.0)
    assert spark.read.parquet(table).where("batch = 1").count() == 2
    arrivals.compacted(spark, log, str(tmp_path / "whole"))
    assert spark.read.parquet(str(tmp_path / "whole")).count() == 493


def test_many_wide_csvs_in_one_scan(spark, tmp_path):
    """Files with headers of their own, quoted and missing columns; the number of jobs does not follow the number of files."""
    periods = ["2001-01-01", "2001-02-01"]
    for k in range(60):
        head, line = ("id,2001-01-01,2001-02-01", f"{k},{k}.5,nan") if k % 3 == 0 else ('name,"2001-02-01",id', f'"a, b",{k}.25,{k}') if k % 3 == 1 else ("2001-01-01,id", f",{k}")
        (tmp_path / f"{k:03}.csv").write_text(f"{head}\n{line}\n")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("wide", "wide")
    got = {(r["id"], str(r["period"])): r["value"] for r in readers.wide_csv(spark, str(tmp_path), "id", periods).collect()}
    jobs = len(tracker.getJobIdsForGroup("wide"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(got) == 120 and jobs < 20
    assert got[3, "2001-01-01"] == 3.5 and got[4, "2001-02-01"] == 4.25 and got[4, "2001-01-01"] is None and got[5, "2001-01-01"] is None


def test_thresholds(spark):
    df = spark.createDataFrame([(0.0, 1.0), (0.5, 2.0), (99.9, 4.0)], "s double, w double")
    got = {r["threshold"]: r["total"] for r in rollup.below_thresholds(df, "s", "w").collect()}
    assert (got[0.0], got[0.5], got[1.0], got[100.0]) == (0, 1, 3, 7) and len(got) == 201


def test_box_adjacent_values(spark):
    df = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 4, 100)], "v double").withColumn("g", F.lit(1))
    r = rollup.box_statistics(df, ["g"], "v").first()
    assert (r["q1"], r["median"], r["q3"], r["lower"], r["upper"]) == (2, 3, 4, 1, 7)
