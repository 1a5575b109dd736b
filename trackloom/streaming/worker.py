"""The queue's worker: uploads come as a stream, each is taken through the steps, and what happens to it is kept as
state by entry.

A micro-batch is worked on as a whole. What is wrong with a single entry is found in its data and told of it alone: files
that are no tracks fail, steps that have nothing for an entry leave a warning and its heights as they were. Should a step
break down over a batch, the batch is halved by the hash of its entries until the entry that it breaks down over stands
alone; that one fails, and all others are done. Outputs are written by batch, so one that is run again replaces itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackloom.operators import asof, catalogues, intervals, kernels, structures, tracks
from trackloom.scratch import stored
from trackloom.sources import archives, gpx, providers

WARNING = "track_id string, step string, message string"

#: A step takes points to (points, warnings); warnings are null or rows of WARNING.
Step = Callable[[DataFrame], tuple[DataFrame, DataFrame | None]]


def expanded(files: DataFrame) -> DataFrame:
    """track_id, name, gpx, error of uploaded files (track_id, content): documents, and those inside ZIP archives. Files
    of other kinds are passed over; an archive that can't be read is one row with an error."""
    schema = T.StructType.fromDDL("track_id string, name string, gpx string, error string")

    def run(batches) -> Iterator:
        import io
        import zipfile

        import pyarrow as pa

        def rows(ident: str, data: bytes):
            base = ident.rpartition("/")[2]
            if base.lower().endswith(".gpx"):
                yield ident, base, data.decode("utf-8", "replace"), None
            elif base.lower().endswith(".zip"):
                try:
                    with zipfile.ZipFile(io.BytesIO(data)) as z:
                        for info in z.infolist():
                            if not info.is_dir() and info.filename.lower().endswith(".gpx"):
                                yield f"{ident}!{info.filename}", info.filename.rpartition("/")[2], z.read(info).decode("utf-8", "replace"), None
                except archives.BROKEN as e:
                    yield ident, base, None, f"{type(e).__name__}: {e}"

        for b in batches:
            for i in range(b.num_rows):
                for row in rows(b.column(0)[i].as_py(), b.column(1)[i].as_py() or b""):
                    yield pa.RecordBatch.from_arrays([pa.array([v], pa.string()) for v in row], names=schema.names)

    return files.select("track_id", "content").mapInArrow(run, schema)


def checked(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(points, failures) of files (track_id, name, gpx, error). Failures (track_id, error): files that can't be read,
    are no tracks, have under two points, or places that are not on earth."""
    parsed = stored(gpx.opened(files), "parsed")
    p = gpx.track_points(parsed.where("error is null").drop("name"), "track_id")
    here = F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180)
    judged = p.groupBy("track_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.coalesce(here, F.lit(False))).alias("off"))
    why = F.when(F.col("off") > 0, "places that are not on earth").when(F.col("n") < 2, "under two points")
    bad = parsed.where("error is not null").select("track_id", "error").unionByName(judged.select("track_id", why.alias("error")).where("error is not null"))
    return p.join(bad.select("track_id"), "track_id", "left_anti"), bad


def heights(chain: list[tuple[str, providers.Lookup]]) -> Step:
    """Heights from a chain of providers. Points without an answer keep what was recorded; an entry none of whose points
    has one is warned of."""

    def step(points: DataFrame) -> tuple[DataFrame, DataFrame]:
        own = points.withColumnRenamed("ele", "__ele")
        found = stored(providers.with_elevation(own, chain), "heights")
        none = found.groupBy("track_id").agg(F.count("ele").alias("n")).where("n = 0")
        warned = none.select("track_id", F.lit("elevation").alias("step"), F.lit("no heights found").alias("message"))
        return found.withColumn("ele", F.coalesce("ele", "__ele")).drop("__ele"), warned

    return step


def resolution(points: DataFrame) -> tuple[DataFrame, None]:
    """Tracks that are coarser than the heights there are for them are resampled to the spacing of these."""
    return asof.to_resolution(tracks.with_distance(points), catalogues.target_resolution(points)), None


def cleaned(located: Callable[[DataFrame], DataFrame] | None = None, calm: float = 30.0, source: str = "") -> Step:
    """Corrections of structures in turn, then spike zones that meet none of them, then dips that the heights of `source`
    are known for. `located` gives the structures on the tracks (struct_id, track_id, kind, alo, ahi); without it there
    are none."""

    def step(points: DataFrame) -> tuple[DataFrame, DataFrame]:
        g = stored(tracks.with_gradient(tracks.with_distance(points)), "graded")
        mine = None
        if located is not None:
            mine = stored(structures.corrections(g, located(g)), "corrections")
            g1 = structures.corrected(g, mine).withColumn("ele", F.col("ele_fixed")).drop("ele_fixed", "gr")
            g1 = tracks.with_gradient(g1)
        else:
            g1 = g
        zones = intervals.spike_zones(g1, calm=calm)
        if mine is not None:
            zones = intervals.without_overlap(zones, mine.select("track_id", "alo", "ahi"))
        fixed = intervals.interpolated(g1, zones)
        smooth = kernels.dip_smoothed(fixed.drop("ele", "gr").withColumnRenamed("ele_fixed", "ele"), source)
        lost = smooth.where(F.col("ele").isNull() | F.isnan("ele")).select("track_id").distinct()
        warned = lost.select("track_id", F.lit("cleaning").alias("step"), F.lit("heights are missing").alias("message"))
        return smooth, warned

    return step


def taken_through(points: DataFrame, steps: list[tuple[str, Step]]) -> tuple[DataFrame, DataFrame]:
    """(points, warnings) after all steps, the recorded height as ele_recorded."""
    out, warned = points.withColumn("ele_recorded", F.col("ele")), None
    for name, step in steps:
        out, said = step(out)
        out = stored(out, f"step-{name}")
        if said is not None:
            said = stored(said.select(F.col("track_id").cast("string").alias("track_id"), "step", "message"), "warnings")
            warned = said if warned is None else warned.unionByName(said)
    return out, warned if warned is not None else points.sparkSession.createDataFrame([], WARNING)


def in_halves(points: DataFrame, work: Callable[[DataFrame], object], salt: int = 0) -> tuple[list, list[tuple[str, str]]]:
    """(results, failures): what work(points) gives, or, where it breaks down, what it gives for halves of the tracks, and
    the tracks (track_id, error) that it breaks down over alone. As many tries as failures times the logarithm of the
    entries of a batch."""
    try:
        return [work(points)], []
    except Exception as e:  # noqa: BLE001  whatever an entry makes a step raise is that entry's failure
        some = [r["track_id"] for r in points.select("track_id").distinct().limit(2).collect()]
        if len(some) < 2:
            return [], [(t, f"{type(e).__name__}: {str(e)[:500]}") for t in some]
    done, failed = [], []
    for side in (0, 1):
        half = points.where(F.pmod(F.xxhash64("track_id", F.lit(salt)), F.lit(2)) == side)
        if not half.isEmpty():
            d, f = in_halves(half, work, salt + 1)
            done, failed = done + d, failed + f
    return done, failed


def worked(files: DataFrame, steps: list[tuple[str, Step]]) -> tuple[DataFrame, DataFrame]:
    """(points, entries) of files (track_id, name, gpx, error). entries: track_id, name, status (ready or failed), error,
    warnings (step: message)."""
    spark = files.sparkSession
    files = stored(files, "files")
    points, failures = checked(files)
    points = stored(points, "checked")
    done, broken = in_halves(points, lambda p: taken_through(p, steps))
    failures = failures.unionByName(spark.createDataFrame(broken, "track_id string, error string"))
    blank = points.withColumn("ele_recorded", F.col("ele")).limit(0)
    out, warned = (done[0] if done else (blank, spark.createDataFrame([], WARNING)))
    for p, w in done[1:]:
        out, warned = out.unionByName(p, allowMissingColumns=True), warned.unionByName(w)
    said = warned.groupBy("track_id").agg(F.array_sort(F.collect_list(F.concat_ws(": ", "step", "message"))).alias("warnings"))
    entries = files.select("track_id", "name").join(failures, "track_id", "left").join(said, "track_id", "left")
    status = F.when(F.col("error").isNull(), "ready").otherwise("failed")
    return out, entries.select("track_id", "name", status.alias("status"), "error", F.coalesce("warnings", F.array().cast("array<string>")).alias("warnings"))


def ingest(spark: SparkSession, folder: str, out: str, checkpoint: str, steps: list[tuple[str, Step]], per_batch: int = 100):
    """Work on new uploads (GPX files and ZIP archives of them) of a folder as they come. Points go to `out`/points and
    entries to `out`/entries, by batch. Returns the stream, which ends when all files that are there are done."""
    stream = spark.readStream.format("binaryFile").option("recursiveFileLookup", True).option("maxFilesPerTrigger", per_batch)
    named = stream.schema("path string, modificationTime timestamp, length long, content binary").load(folder).select(gpx.within(folder).alias("track_id"), "content")

    def work(batch: DataFrame, number: int) -> None:
        points, entries = worked(expanded(batch), steps)
        points.write.mode("overwrite").parquet(f"{out}/points/batch={number}")
        entries.write.mode("overwrite").parquet(f"{out}/entries/batch={number}")

    return named.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


EVENT = "id string, seq long, kind string, text string"
ENTRY = "id string, status string, step string, warnings array<string>, error string, events long"

#: What an event makes of an entry's status, but for `failed` and `done` ones, which only `retry` and `removed` change.
STATUS = {"queued": "pending", "step": "working", "warning": None, "ready": "ready", "done": "done", "failed": "failed", "parked": "parked", "resumed": "pending", "retry": "pending", "removed": "removed"}


def after_event(entry: tuple, kind: str, text: str | None) -> tuple:
    """(status, step, warnings, error, events) after one more event."""
    status, step, warnings, error, n = entry
    n += 1
    if status == "removed" or (status in ("done", "failed") and kind not in ("retry", "removed")) or kind not in STATUS:
        return status, step, warnings, error, n
    if kind == "warning":
        return status, step, [*warnings, f"{step or 'queue'}: {text}"], error, n
    if kind == "retry":
        return "pending", None, [], None, n
    return STATUS[kind], text if kind == "step" else step, warnings, text if kind == "failed" else error, n


def tracked(events: DataFrame) -> DataFrame:
    """ENTRY rows from a stream (or table) of EVENT rows: the state of each entry after all its events so far, kept by
    key in the state store. Events of one micro-batch are taken by seq; a retried event (a seq seen already, or earlier
    than the last) is passed over."""
    state = "status string, step string, warnings array<string>, error string, events long, last long"

    def update(key, frames, group) -> Iterator:
        import pandas as pd

        status, step, warnings, error, n, last = group.get if group.exists else ("pending", None, [], None, 0, None)
        entry = (status, step, list(warnings if warnings is not None else []), error, n)
        rows = pd.concat(list(frames)).sort_values(["seq", "kind"])
        for seq, kind, text in zip(rows["seq"], rows["kind"], rows["text"], strict=True):
            if last is None or seq > last:
                entry, last = after_event(entry, kind, text), int(seq)
        group.update((*entry, last))
        yield pd.DataFrame([[key[0], *entry]], columns=["id", "status", "step", "warnings", "error", "events"])

    from pyspark.sql.streaming.state import GroupStateTimeout

    return events.groupBy("id").applyInPandasWithState(update, ENTRY, state, "update", GroupStateTimeout.NoTimeout)
