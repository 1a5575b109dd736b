"""The worker over uploads, its failures alone, entries by key, and edits that touch their own tracks only."""

import io
import random
import zipfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from trackloom.operators import edit_log, structures, tracks
from trackloom.sources import gpx, providers
from trackloom.streaming import worker

from .test_sequence import plain, same


def document(seed, n=40, lat=46.0, spike=True):
    rng = random.Random(seed)
    spots = "".join(f'<trkpt lat="{lat + i * 1e-4:.6f}" lon="{14.5 + rng.random() * 1e-5:.6f}"><ele>{300 + i * 0.3 + (9 if spike and i in (17, 18) else 0):.2f}</ele></trkpt>' for i in range(n))
    return f"{gpx.HEAD}<trk><name>r{seed}</name><trkseg>{spots}</trkseg></trk></gpx>"


@pytest.fixture
def folder(tmp_path):
    inbox = tmp_path / "in"
    (inbox / "sub").mkdir(parents=True)
    for name, text in {"a.gpx": document(1), "sub/a.gpx": document(2, 50), "c.GPX": document(3), "torn.gpx": "<gpx><trk>", "none.gpx": gpx.HEAD + "</gpx>", "one.gpx": document(4, 1), "far.gpx": document(5, lat=89.999), "x.txt": "no"}.items():
        (inbox / name).write_text(text)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("in/z.gpx", document(6))
        z.writestr("bad.gpx", "nothing")
    (inbox / "more.zip").write_bytes(out.getvalue())
    (inbox / "torn.zip").write_bytes(b"PK\x03\x04")
    return inbox


def steps(spark):
    # Answers for one of the tracks only, and none for the point that it ends with.
    known = [(round(46.0 + i * 1e-4, 6), round(14.5 + random.Random(1).random() * 0, 6), 500.0 + i) for i in range(39)]
    answers = spark.createDataFrame(known, "lat double, lon double, ele double")
    lookup = lambda p: p.where("track_id = 'a.gpx'").select("track_id", "idx", F.round("lat", 6).alias("lat")).join(answers.select(F.round("lat", 6).alias("lat"), "ele"), "lat").select("track_id", "idx", "ele")
    located = lambda g: g.where("track_id = 'c.GPX' and idx in (15, 20)").select(F.col("idx").alias("struct_id"), "track_id", F.lit("tunnel").alias("kind"), F.col("idx").alias("alo"), (F.col("idx") + 4).alias("ahi"))
    return [("elevation", worker.heights([("KNOWN", lookup)])), ("cleaning", worker.cleaned(located))]


FAILED = {"torn.gpx": "not well-formed", "none.gpx": "no track points", "one.gpx": "under two points", "far.gpx": "places that are not on earth", "more.zip!bad.gpx": "not well-formed"}
READY = {"a.gpx", "sub/a.gpx", "c.GPX", "more.zip!in/z.gpx"}


def test_stream_of_uploads_with_broken_files(spark, folder, tmp_path):
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    for _ in range(2):  # the second run finds nothing new
        worker.ingest(spark, str(folder), out, check, steps(spark), per_batch=4).awaitTermination()
    entries = spark.read.option("basePath", f"{out}/entries").parquet(f"{out}/entries/*")
    got = {r["track_id"]: r for r in entries.collect()}
    assert entries.count() == len(got) == len(FAILED) + len(READY) + 1 and entries.select("batch").distinct().count() >= 2
    assert {t: r["error"] for t, r in got.items() if r["status"] == "failed" and t != "torn.zip"} == FAILED and "BadZipFile" in got["torn.zip"]["error"] or "Arrow" in got["torn.zip"]["error"]
    assert {t for t, r in got.items() if r["status"] == "ready"} == READY
    assert got["a.gpx"]["warnings"] == [] and all(got[t]["warnings"] == ["elevation: no heights found"] for t in READY - {"a.gpx"})
    points = spark.read.parquet(f"{out}/points/*")
    # The same as all files worked on at once.
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(str(folder)).select(gpx.within(str(folder)).alias("track_id"), "content")
    whole, _ = worker.worked(worker.expanded(files), steps(spark))
    key = ["track_id", "idx", "ele", "ele_recorded"]
    rows = lambda df: sorted(map(tuple, df.select(*key).collect()))
    assert rows(points) == rows(whole) and {r[0] for r in rows(points)} == READY
    ele = {(t, i): e for t, i, e, _ in rows(points)}
    assert ele["a.gpx", 5] == 505.0 and abs(ele["a.gpx", 39] - (300 + 39 * 0.3)) < 1e-9
    assert ele["sub/a.gpx", 17] < 306 and ele["c.GPX", 17] < 306


def test_one_entry_that_breaks_a_step_fails_alone(spark):
    files = spark.createDataFrame([(f"t{i}", f"t{i}", document(i), None) for i in range(7)], "track_id string, name string, gpx string, error string")

    def touchy(points):
        def look(frames):
            for f in frames:
                if (f["track_id"].isin(["t2", "t5"])).any():
                    raise RuntimeError("cannot stand this one")
                yield f

        return points.mapInPandas(look, points.schema), None

    points, entries = worker.worked(files, [("touchy", touchy), ("cleaning", worker.cleaned())])
    got = {r["track_id"]: (r["status"], "cannot stand" in (r["error"] or "")) for r in entries.collect()}
    assert got == {f"t{i}": ("failed", True) if i in (2, 5) else ("ready", False) for i in range(7)}
    assert {r[0] for r in points.select("track_id").distinct().collect()} == {f"t{i}" for i in range(7)} - {"t2", "t5"}


def test_resolution(spark):
    sparse = [("s", i, 46.0 + i * 1e-3, 14.5, 300.0 + i) for i in range(10)]
    dense = [("d", i, 46.0 + i * 1e-5, 14.5, 300.0 + i) for i in range(10)]
    p = spark.createDataFrame(sparse + dense, "track_id string, idx long, lat double, lon double, ele double")
    got = worker.resolution(p)[0]
    n = {r["track_id"]: r["count"] for r in got.groupBy("track_id").count().collect()}
    assert n == {"d": 10, "s": 1002}  # a kilometre, a metre apart
    ends = got.where("track_id = 's'").agg(F.min_by("ele", "idx").alias("a"), F.max_by("ele", "idx").alias("b")).first()
    assert (ends["a"], ends["b"]) == (300.0, 309.0)


EVENTS = [
    ("a", 1, "queued", None), ("a", 2, "step", "structures"), ("a", 3, "warning", "none near"), ("a", 4, "step", "cleaning"), ("a", 6, "ready", None), ("a", 7, "done", None), ("a", 8, "parked", None),
    ("b", 1, "step", "elevation"), ("b", 2, "failed", "no answer"), ("b", 3, "step", "cleaning"), ("b", 4, "retry", None), ("b", 5, "step", "cleaning"), ("c", 1, "parked", None), ("c", 2, "resumed", None),
    ("d", 1, "ready", None), ("d", 2, "removed", None), ("d", 3, "queued", None), ("e", 5, "odd", None),
]


def test_entries_are_kept_by_key(spark, tmp_path):
    want = {}
    for i, _, kind, text in sorted(EVENTS):
        want[i] = worker.after_event(want.get(i, ("pending", None, [], None, 0)), kind, text)
    assert want["a"][:3] == ("done", "cleaning", ["structures: none near"]) and want["b"][:4] == ("working", "cleaning", [], None) and want["c"][0] == "pending" and want["d"][0] == "removed"
    inbox, out = tmp_path / "events", str(tmp_path / "out")
    inbox.mkdir()
    # Three micro-batches; the last repeats events that were there already.
    for k, rows in enumerate((EVENTS[:3] + EVENTS[7:9], EVENTS[3:7] + EVENTS[9:], EVENTS[:2] + EVENTS[7:8])):
        pd.DataFrame(rows, columns=["id", "seq", "kind", "text"]).to_json(inbox / f"{k}.json", orient="records", lines=True)
        stream = worker.tracked(spark.readStream.schema(worker.EVENT).json(str(inbox)))
        write = lambda df, n: df.withColumn("n", F.lit(n)).write.mode("append").parquet(out)
        stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    last = spark.read.parquet(out).groupBy("id").agg(F.max_by(F.struct("status", "step", "warnings", "error", "events"), "n").alias("e"))
    assert {r["id"]: (r["e"]["status"], r["e"]["step"], r["e"]["warnings"], r["e"]["error"], r["e"]["events"]) for r in last.collect()} == want


def test_edits_in_any_order(spark):
    """Logs of suspect zones, drawn straight, against the same done edit by edit on lists."""
    rng = random.Random(8)
    n, rows, zones, log, want = 60, [], [], [], {}
    for t in ("p", "q", "r"):
        es = [rng.uniform(0, 20) for _ in range(n)]
        ds = [10.0 * i for i in range(n)]
        rows += [(t, i, ds[i], es[i], 0.0) for i in range(n)]
        state = {z: [z * 9 + 2, z * 9 + 8, rng.random() < 0.5, False] for z in range(6)}
        zones += [(t, z, s[0], s[1], "suspect", "none", 0.0, 0.0, s[2], False) for z, s in state.items()]
        out = plain(es, ds, [(s[0], s[1], None, None) for s in state.values() if s[2]])
        draw = lambda lo, hi: None
        for seq in range(30 if t != "r" else 0):
            z, act = rng.randrange(7), rng.choice(["accept", "reject", "drag", "drag", "remove" if seq > 20 else "accept"])
            side, a = rng.choice(["lo", "hi"]), rng.randrange(n)
            log.append((t, seq, act, z, side, a, None))
            if z not in state:
                continue
            s = state[z]
            old = list(s)
            back = again = False
            if act == "accept":
                s[2] = not s[2]
                s[3] = False if s[2] else s[3]
                back, again = not s[2], s[2]
            elif act == "reject":
                s[3] = not s[3]
                s[2] = s[2] and not s[3]
                back, again = s[3], s[2] and not s[3]
            elif act == "drag":
                if side == "lo":
                    s[0] = min(a, s[1] - 1)
                else:
                    s[1] = max(a, s[0] + 1)
                back = again = s[2]
            else:
                back = True
                del state[z]
            if back:
                for i in range(max(0, min(old[0], s[0])), min(n - 1, max(old[1], s[1])) + 1):
                    out[i] = es[i]
            if again:
                out = plain(out, ds, [(s[0], s[1], None, None)])
        want[t] = (out, {z: tuple(s) for z, s in state.items()})
    p = spark.createDataFrame(rows, "track_id string, idx long, dist double, ele double, gr double")
    z = spark.createDataFrame(zones, "track_id string, zone long, alo long, ahi long, type string, interp string, m0 double, m1 double, accepted boolean, rejected boolean")
    e = spark.createDataFrame(log, "track_id string, seq long, action string, zone long, side string, a long, b long")
    profile, left = edit_log.replayed(p, z, e)
    got = {}
    for r in profile.collect():
        got.setdefault(r["track_id"], {})[r["idx"]] = r["ele_fixed"]
    assert all(same([got[t][i] for i in range(n)], want[t][0]) for t in want)
    assert {t: {r["zone"]: (r["alo"], r["ahi"], r["accepted"], r["rejected"]) for r in left.collect() if r["track_id"] == t} for t in want} == {t: w[1] for t, w in want.items()}
    # Only the tracks of the log are worked out anew, with the same result as all.
    done, _ = edit_log.replayed(p, z, e.limit(0))
    marked = done.withColumn("ele_fixed", F.when(F.col("track_id") == "r", F.lit(-1.0)).otherwise(F.col("ele_fixed")))
    again = {(r["track_id"], r["idx"]): r["ele_fixed"] for r in edit_log.revised(marked, p, z, e).collect()}
    assert all(again[t, i] == (-1.0 if t == "r" else got[t][i]) for t in want for i in range(n))


def test_drawn_and_dragged_zones_get_a_shape(spark):
    es = [300.0 + (8 if 20 <= i < 26 else 0) + 0.2 * i for i in range(60)]
    rows = [("t", i, 46.0 + i * 1e-3, 14.5, e) for i, e in enumerate(es)]
    p = tracks.with_gradient(tracks.with_distance(spark.createDataFrame(rows, "track_id string, idx long, lat double, lon double, ele double")))
    z = spark.createDataFrame([("t", 1, 40, 45, "bridge", "uniform", 0.0, 0.0, True, False)], "track_id string, zone long, alo long, ahi long, type string, interp string, m0 double, m1 double, accepted boolean, rejected boolean")
    e = spark.createDataFrame([("t", 1, "draw", 9, None, 27, 18), ("t", 2, "drag", 1, "lo", 17, None), ("t", 3, "accept", 1, None, None, None)], "track_id string, seq long, action string, zone long, side string, a long, b long")
    profile, left = edit_log.replayed(p, z, e)
    got = {r["zone"]: r for r in left.collect()}
    shaped = {(r["alo"], r["ahi"]): r for r in structures.shapes(p, spark.createDataFrame([("t", 18, 27), ("t", 17, 45)], "track_id string, alo long, ahi long")).collect()}
    assert (got[9]["alo"], got[9]["ahi"], got[9]["type"], got[9]["source"]) == (18, 27, shaped[18, 27]["type"], "manual") and got[9]["type"] == "tunnel"
    assert (got[1]["alo"], got[1]["type"], got[1]["accepted"], got[1]["source"]) == (17, shaped[17, 45]["type"], False, None)
    # The drag drew over the zone by hand, and no longer accepting brought the record back from 17 to 45.
    assert [r["ele_fixed"] for r in profile.orderBy("idx").collect()] == es
    assert abs(got[9]["grade"] - 100 * (es[27] - es[18]) / got[9]["span"]) < 1e-9


def test_providers_answers_are_kept_apart(spark):
    p = spark.createDataFrame([("a", 0, 46.0, 14.5, 1.0), ("a", 1, 46.1, 14.5, 2.0)], "track_id string, idx long, lat double, lon double, ele double")
    answers = spark.createDataFrame([(46.0, 14.5, 77.0)], "lat double, lon double, ele double")
    out, said = worker.heights([("R", providers.replay(answers))])(p)
    assert [r["ele"] for r in out.orderBy("idx").collect()] == [77.0, 2.0] and said.count() == 0
