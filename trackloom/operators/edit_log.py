"""Corrections edited by hand, as a log: zones accepted, rejected, removed, dragged by an end, or drawn anew, and the
profile that the log leaves, for the tracks that it names alone.

log: track_id, seq (order of the edits of a track), action, zone, side, a, b. Actions: `accept` and `reject` turn on and
off again; `remove`; `drag` moves the side `lo` or `hi` of a zone to point a; `draw` makes a new zone from a to b.
zones: track_id, zone, alo, ahi, type, interp, m0, m1, accepted, rejected.

What becomes of a zone follows from its own edits (a fold over these); what becomes of the profile from the order of all
edits of the track: each draws a zone on the profile as it stands, or brings the record back, also where another zone
reached into its range. That is the order that `sequence.drawn_in_turn` keeps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.scratch import stored

from .sequence import drawn_in_turn
from .structures import shapes

STATE = "struct<alo:bigint,ahi:bigint,accepted:boolean,rejected:boolean,gone:boolean,reshaped:boolean,manual:boolean>"
OP = "struct<seq:bigint,step:int,raw:boolean,alo:bigint,ahi:bigint,reshaped:boolean>"

#: Up to so many tracks in a log are broadcast to leave the others alone.
FEW_TRACKS = 1_000_000


def _edited(s: Column, e: Column) -> Column:
    """State of a zone after an edit. One that is gone, or not there yet, only a draw changes."""
    on, act = ~F.coalesce(s["gone"], F.lit(True)), e["action"]
    lo = F.when(e["side"] == "lo", F.least(e["a"], s["ahi"] - 1)).otherwise(s["alo"])
    hi = F.when(e["side"] == "lo", s["ahi"]).otherwise(F.greatest(e["a"], s["alo"] + 1))
    dragged, suspect = act == "drag", F.lit(False)
    made = F.struct(F.least(e["a"], e["b"]), F.greatest(e["a"], e["b"]), F.lit(True), suspect, F.lit(False), F.lit(True), F.lit(True)).cast(STATE)
    accepted = F.when(act == "accept", ~s["accepted"]).when(act == "reject", s["rejected"] & s["accepted"]).otherwise(s["accepted"])
    rejected = F.when(act == "accept", s["rejected"] & s["accepted"]).when(act == "reject", ~s["rejected"]).otherwise(s["rejected"])
    moved = F.struct(
        F.when(dragged, lo).otherwise(s["alo"]), F.when(dragged, hi).otherwise(s["ahi"]), accepted, rejected, act == "remove", s["reshaped"] | dragged, s["manual"]
    ).cast(STATE)
    return F.when(act == "draw", made).when(on, moved).otherwise(s)


def _ops(s: Column, n: Column, e: Column) -> Column:
    """What an edit that turns the state s into n does to the profile, in order."""
    act, on = e["action"], ~F.coalesce(s["gone"], F.lit(True))
    op = lambda step, raw, lo, hi: F.struct(e["seq"], F.lit(step), F.lit(raw), lo, hi, n["reshaped"]).cast(OP)
    draw = lambda step: op(step, False, n["alo"], n["ahi"])
    back = op(0, True, F.least(s["alo"], n["alo"]), F.greatest(s["ahi"], n["ahi"]))
    none = F.array().cast(f"array<{OP}>")
    toggled = F.when(act == "accept", F.when(n["accepted"], F.array(draw(1))).otherwise(F.array(back)))
    toggled = toggled.when(act == "reject", F.when(n["rejected"], F.array(back)).when(n["accepted"], F.array(draw(1))).otherwise(none))
    toggled = toggled.when(act == "remove", F.array(back)).when(act == "drag", F.when(n["accepted"], F.array(back, draw(1))).otherwise(none)).otherwise(none)
    return F.when(act == "draw", F.array(draw(1))).when(on, toggled).otherwise(none)


def zone_histories(zones: DataFrame, log: DataFrame) -> DataFrame:
    """track_id, zone, the zone's fields as they were, state (as the log leaves it) and ops (what its edits do to the
    profile). Zones that only the log has are drawn by hand; edits of zones that never were do nothing."""
    of = F.struct(F.col("seq").cast("long").alias("seq"), "action", "side", F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    edits = log.groupBy("track_id", "zone").agg(F.array_sort(F.collect_list(of)).alias("edits"))
    both = zones.join(edits, ["track_id", "zone"], "full")
    there = F.col("alo").isNotNull()
    first = F.struct(
        F.col("alo"), F.col("ahi"), F.coalesce("accepted", F.lit(False)), F.coalesce("rejected", F.lit(False)), ~there, F.lit(False), F.lit(False)
    ).cast(STATE)
    start = F.struct(first.alias("s"), F.array().cast(f"array<{OP}>").alias("ops"))

    def step(acc: Column, e: Column) -> Column:
        n = _edited(acc["s"], e)
        return F.struct(n.alias("s"), F.concat(acc["ops"], _ops(acc["s"], n, e)).alias("ops"))

    folded = F.aggregate(F.coalesce("edits", F.array().cast(edits.schema["edits"].dataType)), start, step)
    kept = both.withColumn("__f", folded).select("track_id", "zone", "alo", "ahi", "type", "interp", "m0", "m1", "accepted", F.col("__f.s").alias("state"), F.col("__f.ops").alias("ops"))
    return kept


def _shaped(points: DataFrame, rows: DataFrame, lo: str, hi: str, flag: str) -> DataFrame:
    """rows with type, interp, m0, m1 of the profile between lo and hi where `flag` holds and they are no suspects."""
    again = F.col(flag) & ~F.coalesce(F.col("type") == "suspect", F.lit(False))
    spans = rows.where(again).select("track_id", F.col(lo).alias("alo"), F.col(hi).alias("ahi")).distinct()
    found = shapes(points, spans).select("track_id", F.col("alo").alias(lo), F.col("ahi").alias(hi), *[F.col(c).alias(f"__{c}") for c in ("type", "interp", "m0", "m1")])
    out = rows.join(found, ["track_id", lo, hi], "left")
    return out.withColumns({c: F.when(again, F.col(f"__{c}")).otherwise(F.col(c)) for c in ("type", "interp", "m0", "m1")}).drop("__type", "__interp", "__m0", "__m1")


def replayed(points: DataFrame, zones: DataFrame, log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(profile, zones) after the log: points with ele_fixed, and the zones that are left with their ends, state, shape,
    span and grade. At first the accepted zones are drawn along the track. points has dist and gr."""
    seen = stored(zone_histories(zones, log), "zone-histories")
    first = seen.where("accepted").select("track_id", F.lit(-1).cast("long").alias("seq"), F.lit(1).alias("step"), F.lit(False).alias("raw"), "alo", "ahi", F.lit(False).alias("reshaped"), "type", "interp", "m0", "m1")
    later = seen.select("track_id", "type", "interp", "m0", "m1", F.explode("ops").alias("o")).select("track_id", "o.*", "type", "interp", "m0", "m1")
    ops = _shaped(points, first.unionByName(later), "alo", "ahi", "reshaped")
    bends = ~F.coalesce(F.col("interp"), F.lit("none")).isin("uniform", "none")
    ops = ops.select("track_id", "seq", "step", "raw", "alo", "ahi", *[F.when(bends & ~F.col("raw"), F.col(m)).alias(m) for m in ("m0", "m1")])
    profile = drawn_in_turn(points, ops, ["seq", "step"])
    left = seen.where(~F.col("state.gone")).select("track_id", "zone", "state.*", "type", "interp", "m0", "m1")
    left = _shaped(points, left, "alo", "ahi", "reshaped")
    drawn_flat = (F.col("type") == "suspect") & (F.col("interp") == "none") & F.col("accepted")
    left = left.withColumn("interp", F.when(drawn_flat, "uniform").otherwise(F.col("interp"))).withColumn("source", F.when(F.col("manual"), "manual")).drop("gone", "reshaped", "manual")
    at = points.select("track_id", "idx", F.struct("dist", "ele").alias("p"))
    ends = left.join(at.select("track_id", F.col("idx").alias("alo"), F.col("p").alias("p0")), ["track_id", "alo"], "left").join(at.select("track_id", F.col("idx").alias("ahi"), F.col("p").alias("p1")), ["track_id", "ahi"], "left")
    span = F.col("p1.dist") - F.col("p0.dist")
    grade = F.when(span > 0, 100 * (F.col("p1.ele") - F.col("p0.ele")) / F.nullif(span, F.lit(0.0))).otherwise(0.0)
    return profile, ends.select(*left.columns, span.alias("span"), grade.alias("grade"))


def touched(log: DataFrame) -> DataFrame:
    """track_id of the tracks that a log names, each once."""
    return stored(log.select("track_id").distinct(), "touched")


def revised(done: DataFrame, points: DataFrame, zones: DataFrame, log: DataFrame) -> DataFrame:
    """done, the profile of all tracks (columns of points and ele_fixed), with those tracks that the log names worked out
    anew; rows of the others are passed through. The names of up to FEW_TRACKS tracks are broadcast, so that the others
    are not even shuffled."""
    some = touched(log)
    named = F.broadcast(some) if some.count() <= FEW_TRACKS else some
    of = lambda df: df.join(named, "track_id", "left_semi")
    profile, _ = replayed(of(points), of(zones), log)
    return done.join(named, "track_id", "left_anti").unionByName(profile.select(*done.columns))
