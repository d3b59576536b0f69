import json
from datetime import datetime

import numpy as np
import pytest
from pyspark.ml.feature import PCAModel
from pyspark.sql import functions as F

from trialframe.operators import features, light, stats
from trialframe.sources import tables

HEAD = "time,image_name,action.0,action.1,action.2,action.3,action.4,action.5"


@pytest.fixture
def raw(tmp_path):
    for e, z, power in ((11, 1, False), (11, 2, True)):
        d = tmp_path / f"E{e}" / f"zone{z:02d}"
        d.mkdir(parents=True)
        line = f"2024-01-01T0{z}:00:00Z,a.png,1,2,3,4,5,6" + (",7.5" if power else "")
        (d / "raw.csv").write_text(HEAD + (",power" if power else "") + "\n" + line + "\n")
        if z == 2:
            (d / "config.json").write_text(json.dumps({"timezone": "America/Toronto", "other": [1]}, indent=1))
    return tmp_path


def test_telemetry_with_and_without_power(spark, raw):
    df = tables.read_telemetry(spark, [str(p) for p in sorted(raw.glob("E*/zone*/raw.csv"))])
    got = {r["zone"]: r for r in df.collect()}
    assert (got[1]["power"], got[2]["power"]) == (None, 7.5)
    assert got[1]["experiment"] == 11 and got[2]["action_5"] == 6.0 and got[2]["time"] == datetime(2024, 1, 1, 2)
    zones = tables.read_time_zones(spark, f"{raw}/E*/zone*/config.json")
    zoned = {r["zone"]: r["timezone"] for r in tables.attach_time_zones(df, zones).collect()}
    assert zoned == {1: "America/Edmonton", 2: "America/Toronto"}


VALUES = {"time": "2024-01-01T09:00:00Z", "image_name": "a, b.png", "power": "7.5", "note": "x", "action.6": "99"} | {f"action.{i}": f"{i}.5" for i in range(6)}
LAYOUTS = {
    1: HEAD.split(","),
    2: [*reversed(HEAD.split(",")), "power"],
    3: ["power", "note", "action.6", *HEAD.split(",")],
    4: [*HEAD.split(",")[3:], "note", *HEAD.split(",")[:3]],
}


def write_layouts(root, n=2):
    import csv

    for zone, names in LAYOUTS.items():
        d = root / "E7" / f"zone{zone:02d}"
        d.mkdir(parents=True)
        with (d / "raw.csv").open("w", encoding="utf-8-sig" if zone == 4 else "utf-8", newline="") as f:
            out = csv.writer(f, quoting=csv.QUOTE_ALL if zone == 3 else csv.QUOTE_MINIMAL)
            out.writerow([f" {x} " if zone == 2 else x for x in names])
            out.writerows([[VALUES[x] for x in names]] * n)
    (root / "E7" / "zone05").mkdir()
    (root / "E7" / "zone05" / "raw.csv").write_text("")
    return f"{root}/E7/*/*.csv"


@pytest.mark.parametrize("packed", [False, True])
@pytest.mark.parametrize("split", ["128m", "300b"])
def test_telemetry_goes_by_the_names_in_each_header(spark, tmp_path, monkeypatch, packed, split):
    paths, cost = write_layouts(tmp_path, 50), spark.conf.get("spark.sql.files.openCostInBytes")
    if packed:  # a session that does not let go of its own setting
        put = type(spark.conf).set
        monkeypatch.setattr(type(spark.conf), "set", lambda self, key, value: None if key == "spark.sql.files.openCostInBytes" else put(self, key, value))
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        assert tables.file_headers(spark, paths).count() == 4
        rows = tables.read_telemetry(spark, paths).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(rows) == 200 and spark.conf.get("spark.sql.files.openCostInBytes") == cost
    for r in rows:
        assert [r[f"action_{i}"] for i in range(6)] == [0.5, 1.5, 2.5, 3.5, 4.5, 5.5] and r["image_name"] == "a, b.png" and r["time"] == datetime(2024, 1, 1, 9)
        assert r["power"] == (7.5 if r["zone"] in (2, 3) else None) and r["experiment"] == 7


def test_telemetry_without_a_column_names_the_file(spark, tmp_path):
    write_layouts(tmp_path)
    (tmp_path / "E7" / "zone05" / "raw.csv").write_text("time,image_name,action.0,power\n2024-01-01,a,1,2\n")
    with pytest.raises(ValueError, match=r"zone05/raw.csv has no column action.1, action.2"):
        tables.read_telemetry(spark, f"{tmp_path}/E7/*/*.csv")


def test_telemetry_values_that_cannot_be_read_are_null(spark, tmp_path):
    (tmp_path / "raw.csv").write_text(HEAD + "\nnever,a.png,1,x,,4,5\n")
    row = tables.read_telemetry(spark, str(tmp_path / "raw.csv")).first()
    assert (row["time"], row["action_0"], row["action_1"], row["action_2"], row["action_4"], row["action_5"], row["power"], row["zone"]) == (None, 1.0, None, None, 5.0, None, None, None)


def test_zones_are_written_and_replaced_apart(spark, tmp_path):
    path = str(tmp_path / "out")
    schema = "experiment long, zone long, v int"
    tables.write_zones(spark.createDataFrame([(1, 1, 1), (1, 2, 2)], schema), path)
    tables.write_zones(spark.createDataFrame([(1, 2, 5)], schema), path)
    assert sorted((r["zone"], r["v"]) for r in tables.read_columns(spark, path, ["zone", "v"]).collect()) == [(1, 1), (2, 5)]


def test_large_zones_have_several_files(spark, tmp_path):
    path = str(tmp_path / "out")
    tables.write_zones(spark.range(1000).select(F.lit(1).alias("experiment"), (F.col("id") % 2).alias("zone"), "id"), path, file_rows=100)
    assert spark.read.parquet(path).groupBy(F.input_file_name()).count().agg(F.max("count")).first()[0] <= 100
    assert spark.read.parquet(path).count() == 1000


ZONES = "experiment long, zone long, "


def test_only_stale_zones_are_computed_and_replaced(spark, tmp_path):
    path, seen = str(tmp_path / "out"), []
    source = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 2, "c"), (2, 1, "d"), (3, 1, "gone")], ZONES + "v string")
    wanted = lambda *rows: spark.createDataFrame(rows, ZONES + "n_images long")

    def run(counts, mark, keep="v <> ''"):
        def compute(rows):
            seen.append(sorted((r.experiment, r.zone) for r in rows.select("experiment", "zone").distinct().collect()))
            return rows.where(keep).withColumn("mark", F.lit(mark))

        stale = tables.refresh_zones(source, wanted(*counts), path, compute)
        back = sorted((r.v, r.mark) for r in spark.read.parquet(path).collect())
        return sorted((r.experiment, r.zone) for r in stale.collect()), back, sorted(map(tuple, tables.read_manifest(spark, path).collect()))

    first = [(1, 1, 1), (1, 2, 2), (3, 1, 1)]
    stale, back, known = run(first, "one")
    assert stale == seen.pop() == [(1, 1), (1, 2), (3, 1)] and known == first and back == [("a", "one"), ("b", "one"), ("c", "one"), ("gone", "one")]
    assert run(first, "two") == ([], back, first) and not seen
    files = {p: p.stat().st_mtime_ns for p in (tmp_path / "out" / "experiment=1" / "zone=1").iterdir()}
    second = [(1, 1, 1), (1, 2, 5), (2, 1, 1), (3, 1, 0)]
    stale, back, known = run(second, "three", "v <> 'gone'")
    assert stale == seen.pop() == [(1, 2), (2, 1), (3, 1)] and known == second
    assert back == [("a", "one"), ("b", "three"), ("c", "three"), ("d", "three")]
    assert files == {p: p.stat().st_mtime_ns for p in (tmp_path / "out" / "experiment=1" / "zone=1").iterdir()}
    assert len(list((tmp_path / "out" / "_zones").iterdir())) == 1


def test_a_lost_refresh_is_done_again(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "out")
    source = spark.createDataFrame([(1, 1, 1), (1, 2, 1)], ZONES + "v int")
    wanted = lambda n: spark.createDataFrame([(1, 1, n), (1, 2, 1)], ZONES + "n_images long")
    tables.refresh_zones(source, wanted(1), path, lambda rows: rows)
    write = tables.write_zones
    monkeypatch.setattr(tables, "write_zones", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        tables.refresh_zones(source, wanted(2), path, lambda rows: rows.withColumn("v", F.lit(2)))
    monkeypatch.setattr(tables, "write_zones", write)
    assert [tuple(r) for r in tables.read_manifest(spark, path).collect()] == [(1, 2, 1)]
    stale = tables.refresh_zones(source, wanted(1), path, lambda rows: rows.withColumn("v", F.lit(3)))  # the count of before, but not sure to be its rows
    assert [r.zone for r in stale.collect()] == [1] and sorted((r.zone, r.v) for r in spark.read.parquet(path).collect()) == [(1, 3), (2, 1)]
    with pytest.raises(ValueError, match="not asked for"):
        tables.refresh_zones(source, wanted(7), path, lambda rows: rows.withColumn("zone", F.lit(9)))


def test_scan_processed_by_name(spark, tmp_path):
    for e, z in ((1, 1), (1, 2), (2, 1)):
        spark.range(e * 10 + z, e * 10 + z + 1).toPandas().to_parquet(tmp_path / f"E{e}_Z{z}.parquet")
    (tmp_path / "deep").mkdir()
    spark.range(99, 100).toPandas().to_parquet(tmp_path / "deep" / "E3_Z1.parquet")
    spark.range(5).toPandas().to_parquet(tmp_path / "other.parquet")
    assert {r[0] for r in tables.scan_processed(spark, str(tmp_path)).collect()} == {11, 12, 21, 99}
    assert {r[0] for r in tables.scan_processed(spark, str(tmp_path), [1, 3], [1]).collect()} == {11, 99}


def test_stats_round_trip(spark, tmp_path):
    s = features.norm_stats(spark.createDataFrame([(1.0,), (3.0,)], "a double"), ("a",))
    tables.write_stats(s, str(tmp_path / "s"))
    back = tables.read_stats(spark, str(tmp_path / "s")).first()
    assert (back["metric"], back["min"], back["max"], back["mean"]) == ("a", 1.0, 3.0, 2.0)


def test_calibration_spectra_harvest(spark, tmp_path):
    (tmp_path / "c.csv").write_text("ZONE,PPFD_ELEC,COLOR,PPFD_SUN\n" + "".join(f"{z},{z * 10 + k},{c},1\n" for z in (1, 2) for k, c in enumerate("RWB")))
    wide = {r["zone"]: (r["R"], r["W"], r["B"]) for r in light.pivot_calibration(tables.read_calibration(spark, str(tmp_path / "c.csv"))).collect()}
    assert wide == {1: (10, 11, 12), 2: (20, 21, 22)}
    for c, v in (("red", 1), ("white", 2), ("blue", 3)):
        (tmp_path / f"zone3_{c}.txt").write_text(f"wavelength intensity\n400.0 {v}\n410.0\t{v}.5\n")
    got = tables.read_spectra(spark, f"{tmp_path}/zone*_*.txt").orderBy("wavelength").collect()
    assert [(r["zone"], r["wavelength"], r["red"], r["white"], r["blue"]) for r in got] == [(3, 400.0, 1, 2, 3), (3, 410.0, 1.5, 2.5, 3.5)]
    sheet = spark.createDataFrame([("p1", "1.0", "4"), ("p2", "3.0", None), ("AVG", "99", "99")], "plant string, `Zone 1` string, `Zone 2` string")
    assert {r["zone"]: r["biomass"] for r in tables.harvest_long(sheet, "plant").collect()} == {1: 2.0, 2: 4.0}


def test_images(spark, tmp_path):
    (tmp_path / "left_2025-01-31T093000+0000.png").write_bytes(b"abc")
    (tmp_path / "noname.png").write_bytes(b"z")
    got = {r["image_name"]: r for r in tables.image_manifest(spark, str(tmp_path)).collect()}
    assert got["left_2025-01-31T093000+0000.png"]["time"] == datetime(2025, 1, 31, 9, 30) and got["noname.png"]["time"] is None
    files = spark.read.format("binaryFile").load(str(tmp_path)).select("content")
    bright = tables.image_quality(files, lambda b: np.frombuffer(b, np.uint8)[[0]] if len(b) > 1 else 1 / 0)
    assert sorted(r["brightness"] for r in bright.collect()) == [-1.0, 97.0]


def test_stale_zones_and_profile(spark, tmp_path):
    schema = "experiment int, zone int, n_images int"
    wanted = spark.createDataFrame([(1, 1, 5), (1, 2, 7)], schema)
    assert [r["zone"] for r in tables.stale_zones(wanted, spark.createDataFrame([(1, 1, 5), (1, 2, 6)], schema)).collect()] == [2]
    spark.range(1000).withColumn("t", F.lit("same")).write.parquet(str(tmp_path / "p"))
    got = {r["column_name"]: r for r in tables.storage_profile(spark, [str(p) for p in (tmp_path / "p").glob("*.parquet")]).collect()}
    assert set(got) == {"id", "t"} and got["id"]["share"] > got["t"]["share"] and sum(r["share"] for r in got.values()) == pytest.approx(1)


def test_models_and_reports(spark, tmp_path):
    df = spark.createDataFrame([([float(i), float(i % 3), 1.0],) for i in range(20)], "a array<double>")
    models = features.fit_pca(df, "a", 2)
    models[1].write().overwrite().save(str(tmp_path / "m"))
    back = (models[0], PCAModel.load(str(tmp_path / "m")))
    assert features.pca_project(df, "a", back).count() == 20
    fit = stats.origin_slope(spark.createDataFrame([(1.0, 2.0), (2.0, 4.0)], "x double, y double"), "x", "y")
    report = tables.parameter_report({"k": F.round("k", 3), "unit": "W"}, fit).first()["report"]
    assert json.loads(report) == {"k": 2.0, "unit": "W"}


def test_union_widens_and_fills(spark):
    out = tables.union_relaxed(spark.createDataFrame([(1, "a")], "x int, s string"), spark.createDataFrame([(2.5,)], "x double"))
    assert dict(out.dtypes) == {"x": "double", "s": "string"} and out.count() == 2


def test_scratch_is_deleted(spark):
    import os

    from trialframe.sources import scratch

    before = list(scratch._made)
    scratch._made.clear()
    scratch.saved(spark.range(3), "x").count()
    at = scratch._made[0].removeprefix("file://")
    assert os.path.exists(at)
    scratch.forget_all(spark)
    assert not os.path.exists(at) and not scratch._made
    scratch._made += before


def test_means_of_sheets_do_not_depend_on_the_order_of_rows(spark):
    from trialframe.plans.views import mean_to

    first = [90.38, 15.52, 258.77, 134.56, 161.71, 204.94, 74.94, 233.56]  # in this order doubles give 146.79749999999999
    values = [first, sorted(first), first[::-1], [72.27, 149.03, 219.7, 206.27, 132.06, 150.77, 159.08, 195.0]]
    rows = [(k, i, x) for k, v in enumerate(values) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "k int, i int, x double").repartition(1, "k").sortWithinPartitions("k", "i")
    assert [r[1] for r in df.groupBy("k").agg(mean_to(3, "x")).sort("k").collect()] == [146.798, 146.798, 146.798, 160.523]
    odd = spark.createDataFrame([(1, 0.5), (1, float("nan")), (2, 1e300), (2, None), (3, None), (4, -0.0005)], "k int, x double")
    got = {r[0]: r[1] for r in odd.groupBy("k").agg(mean_to(3, "x")).collect()}
    assert got[1] != got[1] and got[2] == 1e300 and got[3] is None and got[4] == -0.001
