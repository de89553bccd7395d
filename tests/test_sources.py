import os
from pathlib import Path

from motorspark.operators import aggregates as A
from motorspark.sources import tables as S


def put(tmp_path: Path, name: str, text: str) -> str:
    p = tmp_path / name
    p.write_text(text)
    return str(p)


def test_table_and_timed_csv(spark, tmp_path):
    d = S.read_table_csv(spark, put(tmp_path, "a.csv", " a , b ,\n1,x,\n2.5,,\n"))
    assert d.dtypes == [("a", "double"), ("b", "string")] and d.count() == 2
    t = S.read_timed_csv(spark, put(tmp_path, "t.csv", "time, x, y\n0.0,1,2\n0.1,nan,3\n"))
    assert sorted((r["channel"], r["t"], r["value"]) for r in t.where("value is not null").collect()) == [("x", 0.0, 1.0), ("y", 0.0, 2.0), ("y", 0.1, 3.0)]


def test_matrix_round_trip(spark, tmp_path):
    f = S.read_matrix_csv(spark, put(tmp_path, "m.csv", "time,r1c1,r2c1,r1c2,r2c2\n1.0,1,2,3,-4\n1.5,2,2,2,2\n"))
    assert f.first()["n_rows"] == 2
    g = S.import_matrices(f, equalize_period=0.2).orderBy("t").collect()
    assert g[0]["t"] == 0.0 and g[0]["sensels"] == [0.0] * 4 and g[1]["sensels"] == [1.0, 0.0, 0.0, 6.0]
    lines = [r["line"] for r in S.frame_lines(f).orderBy("pos").collect()]
    assert lines[0] == "time,r1c1,r2c1,r1c2,r2c2" and lines[1] == "1.0,1.0,2.0,3.0,-4.0"


def test_motion_and_markers(spark, tmp_path):
    m = S.read_motion(spark, put(tmp_path, "a.mot", "name\nendheader\ntime\ta\tb\n0.0\t1\t2\n0.1\t3\t\n"))
    assert m.count() == 4 and m.where("value is null").count() == 1
    lines = [r["line"] for r in S.motion_lines(m, ["a", "b"]).orderBy("pos").collect()]
    assert lines[2] == "nRows=2" and lines[6] == "time\ta\tb" and lines[7] == "0.0\t1.0\t2.0"
    trc = "PathFileType\nDataRate\n50\nFrame#\tTime\tm1\t\t\tm2\n\t\tX1\tY1\tZ1\tX2\tY2\tZ2\n1\t0.0\t1\t2\t3\t4\t\t6\n"
    k = S.read_markers(spark, put(tmp_path, "a.trc", trc))
    assert sorted((r["marker"], r["x"], r["y"]) for r in k.collect()) == [("m1", 1.0, 2.0), ("m2", 4.0, None)]
    two = S.read_markers(spark, put(tmp_path, "b.csv", "bodypart,p,p,p,p\ncoord,x,y,z,confidence\n0,1,2,3,0.9\n"), trc=False)
    assert two.first()["confidence"] == 0.9


def test_contacts_meta_and_units(spark, tmp_path):
    c = S.read_contacts(spark, put(tmp_path, "c.csv", "1.2:thumb:0.5,3.4:index:1\n\n5.6:ring:2\n"))
    assert sorted((r["frame"], r["row"], r["segment"]) for r in c.collect()) == [(0, 1, "thumb"), (0, 3, "index"), (2, 5, "ring")]
    m = S.read_session_meta(spark, put(tmp_path, "m.json", '{"session": "2022_03_01", "hand": "left"}'))
    assert m.first()["hand"] == "left" and m.first()["fps"] == 50.0
    u = spark.createDataFrame([("s", i, [0.1, 0.2, 0.3], k) for i, k in enumerate([2, 2, 3])], "session string, unit_idx int, flat array<double>, stop int")
    assert sorted((r["unit_idx"], r["t"]) for r in S.explode_ragged_units(u).collect()) == [(0, 0.1), (0, 0.2), (2, 0.3)]
    d = S.read_cluster_depths(spark, put(tmp_path, "d.tsv", "cluster_id\tdepth\n1\t20\nx\t3\n"))
    assert d.count() == 1


def test_write_json_rounds(spark, tmp_path):
    d = spark.createDataFrame([("a", 0.123456), ("b", float("nan"))], "session string, v double")
    S.write_table(d, str(tmp_path / "out"), "json", ["session"])
    got = {r["session"]: r["v"] for r in spark.read.schema("session string, v double").json(str(tmp_path / "out")).collect()}
    assert got == {"a": 0.1235, "b": None}


def test_status_from_the_times_of_real_files(spark, tmp_path):
    for path, at in {"s1/raw/t1.csv": 100, "s1/raw/t2.csv": 100, "s1/out/t1.csv": 200, "s1/out/t2.csv": 50, "s1/raw/t3.csv": 100, "s2/out/t1.csv": 300, "s2/notes.txt": 1}.items():
        f = tmp_path / "in" / path
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text("x")
        os.utime(f, (at, at))
    files = S.list_files(spark, f"file://{tmp_path}/in")
    assert {r["path"].split("/in/")[1]: r["length"] for r in files.collect()}["s2/notes.txt"] == 1 and "content" not in files.columns
    trials = spark.createDataFrame([("s1", 1), ("s1", 2), ("s1", 3), ("s2", 1), ("s2", 2)], "session string, trial int")
    manifest = A.file_manifest(files, trials, {"align": ("/in/(s[0-9]+)/raw/t([0-9]+)[.]csv$", "/in/(s[0-9]+)/out/t([0-9]+)[.]csv$")})
    got = {(r["session"], r["trial"]): r["status"] for r in A.stage_status(manifest).collect()}
    assert got == {("s1", 1): "COR", ("s1", 2): "POS", ("s1", 3): "ZER", ("s2", 1): "NEG", ("s2", 2): "NEG"}
    counts = {r["session"]: (r["neg"], r["zer"], r["pos"], r["cor"], r["n"]) for r in A.processing_status(manifest).collect()}
    assert counts == {"s1": (0, 1, 1, 1, 3), "s2": (2, 0, 0, 0, 2)}


def test_many_timed_files_are_written_and_listed_by_few_tasks(spark, tmp_path):
    rows = [(i, c, t / 10, float(i + t)) for i in range(60) for c in ("x", "y") for t in range(3)]
    samples = spark.createDataFrame(rows, "session long, channel string, t double, value double")
    path = f"file://{tmp_path}/timed"
    S.write_timed_csv(samples, path, ["x", "y"], ("session",))
    assert len(list(tmp_path.glob("timed/session=*/*.csv"))) == 60 and not list(tmp_path.glob("timed/session=*/.*.crc"))
    before, context = spark.conf.get(S.LISTING), spark.sparkContext
    context.setJobGroup("timed-files", "")
    try:
        found = S.read_timed_csv(spark, f"{path}/session=*")
        jobs = [context.statusTracker().getJobInfo(j) for j in context.statusTracker().getJobIdsForGroup("timed-files")]
        tasks = [context.statusTracker().getStageInfo(k).numTasks for j in jobs for k in j.stageIds]
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    assert tasks and max(tasks) <= 16 and spark.conf.get(S.LISTING) == before
    got = sorted((int(r["file"].split("session=")[1].split("/")[0]), r["channel"], r["t"], r["value"]) for r in found.collect())
    assert got == sorted(rows)
