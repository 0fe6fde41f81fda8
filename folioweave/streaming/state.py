"""Lifecycle operators over event logs: run state machine, versioned selection, grants, budgets; and streaming twins."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from folioweave.session import materialize

# The states that event types stand for, allowed transitions, grant limits.
STATUS = {"signup": "created", "view": "running", "purchase": "succeeded", "error": "failed", "click": "cancelled"}
ALLOWED = ("created>running", "created>cancelled", "running>succeeded", "running>failed", "running>cancelled")
TTL_MINUTES = 20


def status_of(event: Column) -> Column:
    out = F.lit(None).cast("string")
    for k, v in STATUS.items():
        out = F.when(event == k, v).otherwise(out)
    return out


def run_transitions(events: DataFrame) -> DataFrame:
    """Each event with the state before it and whether the step is allowed (a first event may only create)."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    s = events.withColumn("status", status_of(F.col("event_type"))).withColumn("before", F.lag("status").over(w))
    step = F.concat(F.col("before"), F.lit(">"), F.col("status"))
    return s.select("event_id", "user_id", "before", "status", F.when(F.col("before").isNull(), F.col("status") == "created").otherwise(step.isin(*ALLOWED)).alias("allowed"))


def selection_replay(events: DataFrame, slices: int = 5) -> DataFrame:
    """Compare-and-set replay per user: an event is accepted where its expected version equals the running one.

    Each user's version starts at 0 again every day: the events of a day are folded in order, without the days before.
    ``selection_history`` carries the version over all events.
    """
    keyed = events.select("user_id", F.to_date("ts").alias("day"), F.struct("ts", "event_id", (F.get_json_object("props", "$.k").cast("long") % slices).alias("expected")).alias("e"))
    logs = keyed.groupBy("user_id", "day").agg(F.array_sort(F.collect_list("e")).alias("log"))
    zero = F.struct(F.lit(0).cast("long").alias("version"), F.lit(0).cast("long").alias("accepted"))

    def step(a: Column, x: Column) -> Column:
        hit = x["expected"] == a["version"] % slices
        return F.struct((a["version"] + hit.cast("long")).alias("version"), (a["accepted"] + hit.cast("long")).alias("accepted"))

    return logs.select("user_id", F.col("day").cast("string").alias("day"), F.size("log").cast("long").alias("n_events"), F.aggregate("log", zero, step).alias("a")).select("user_id", "day", "n_events", "a.version")


def selection_history(events: DataFrame, slices: int = 5, slice_rows: int = 50_000) -> DataFrame:
    """The compare-and-set replay over a user's whole log: each day's events, accepted ones and the version after it.

    The log is dealt by ranges of (user, time), so a hot user's log lies in several ranges of about ``slice_rows`` events.
    A stretch of a user's day within a range is folded from every start version modulo ``slices`` to the version's gain;
    the gains are then carried through the user's stretches in order. An event without an expected version conflicts.
    """
    asked = F.pmod(F.get_json_object("props", "$.k").cast("long"), F.lit(slices))
    parts = max(1, -(-events.count() // slice_rows))
    dealt = events.select("user_id", "ts", "event_id", asked.alias("expected")).repartitionByRange(parts, "user_id", "ts", "event_id").withColumn("slice", F.spark_partition_id())
    logs = dealt.groupBy("user_id", F.to_date("ts").alias("day"), "slice").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "expected"))).alias("log"))

    def step(gains: Column, x: Column) -> Column:
        return F.transform(gains, lambda g, start: g + F.coalesce((start + g) % slices == x["expected"], F.lit(False)).cast("long"))

    gains = F.aggregate("log", F.array(*[F.lit(0).cast("long")] * slices), step)
    maps = logs.select("user_id", F.struct("day", "slice", F.size("log").cast("long").alias("n"), gains.alias("gains")).alias("m"))
    zero = F.struct(F.lit(0).cast("long").alias("version"), F.expr("cast(array() AS array<struct<day:date,n:bigint,accepted:bigint,version:bigint>>)").alias("done"))

    def carry(a: Column, m: Column) -> Column:
        gain = F.get(m["gains"], (a["version"] % slices).cast("int"))
        after = a["version"] + gain
        return F.struct(after.alias("version"), F.concat(a["done"], F.array(F.struct(m["day"].alias("day"), m["n"].alias("n"), gain.alias("accepted"), after.alias("version")))).alias("done"))

    carried = maps.groupBy("user_id").agg(F.array_sort(F.collect_list("m")).alias("ms")).select("user_id", F.explode(F.aggregate("ms", zero, carry)["done"]).alias("d"))
    days = carried.groupBy("user_id", F.col("d.day").cast("string").alias("day"))
    return days.agg(F.sum("d.n").alias("n_events"), F.sum("d.accepted").alias("accepted"), F.max("d.version").alias("version"))


def selection_events(events: DataFrame, slices: int = 5, slice_rows: int = 50_000) -> DataFrame:
    """The compare-and-set replay over a user's whole log, event by event: accepted or in conflict, and the version after it.

    Ranges of (user, time) of about ``slice_rows`` events are folded from every start version modulo ``slices`` to their gains; the gains are
    carried through a user's ranges; then each range is folded once more from its own start. No task holds more than one
    range, however long a user's log is. The ranges are written, so both folds see the same ones.
    """
    asked = F.pmod(F.get_json_object("props", "$.k").cast("long"), F.lit(slices))
    parts = max(1, -(-events.count() // slice_rows))
    dealt = events.select("user_id", "ts", "event_id", asked.alias("expected")).repartitionByRange(parts, "user_id", "ts", "event_id").withColumn("slice", F.spark_partition_id())
    logs = materialize(dealt.groupBy("user_id", "slice").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "expected"))).alias("log")), "selection-logs")

    def gain(gains: Column, x: Column) -> Column:
        return F.transform(gains, lambda g, start: g + F.coalesce((start + g) % slices == x["expected"], F.lit(False)).cast("long"))

    gains = logs.select("user_id", F.struct("slice", F.aggregate("log", F.array(*[F.lit(0).cast("long")] * slices), gain).alias("gains")).alias("m"))
    zero = F.struct(F.lit(0).cast("long").alias("version"), F.expr("cast(array() AS array<struct<slice:int,start:bigint>>)").alias("done"))

    def carry(a: Column, m: Column) -> Column:
        after = a["version"] + F.get(m["gains"], (a["version"] % slices).cast("int"))
        return F.struct(after.alias("version"), F.concat(a["done"], F.array(F.struct(m["slice"].alias("slice"), a["version"].alias("start")))).alias("done"))

    starts = gains.groupBy("user_id").agg(F.array_sort(F.collect_list("m")).alias("ms")).select("user_id", F.explode(F.aggregate("ms", zero, carry)["done"]).alias("d")).select("user_id", "d.slice", "d.start")

    def replay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for user, version, log in zip(batch["user_id"], batch["start"], batch["log"], strict=True):
                for x in log:
                    hit = x["expected"] is not None and x["expected"] == version % slices
                    version += hit
                    rows.append((x["event_id"], user, bool(hit), int(version)))
            yield pd.DataFrame(rows, columns=["event_id", "user_id", "accepted", "version"])

    return logs.join(starts, ["user_id", "slice"]).select("user_id", "start", "log").mapInPandas(replay, "event_id long, user_id long, accepted boolean, version long")


def grant_replay(events: DataFrame) -> DataFrame:
    """Retrievals (views) with the last grant (click) of the user before them and whether it is still alive."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    grant = F.last(F.when(F.col("event_type") == "click", F.col("ts")), ignorenulls=True).over(w)
    seen = events.withColumn("granted", grant).where("event_type = 'view'")
    return seen.select("event_id", "user_id", F.coalesce(F.col("ts") <= F.col("granted") + F.expr(f"INTERVAL {TTL_MINUTES} MINUTES"), F.lit(False)).alias("alive"))


def page_budget(pages: DataFrame, pixels: int, most_pages: int) -> DataFrame:
    """Pages admitted within a document's running budget of pixels and pages."""
    w = Window.partitionBy("doc_id").orderBy("page").rowsBetween(Window.unboundedPreceding, 0)
    return pages.select("doc_id", "page", F.sum("px").over(w).alias("used"), F.count(F.lit(1)).over(w).alias("n")).select("doc_id", "page", "used", ((F.col("used") <= pixels) & (F.col("n") <= most_pages)).alias("admitted"))


def hourly_activity(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Events by type and hour; on a stream, hours close one watermark after their end."""
    # Watermarks take instants; files may hold local times.
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events
    return timed.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("hour"), "event_type", "n")


Fold = Callable[[object, tuple], tuple[object, tuple]]


def folded_stream(events: DataFrame, keys: list[str], taken: list[str], fold: Fold, out: str, state: str) -> DataFrame:
    """A stream's events folded by key: ``fold(state, values)`` gives the next state (first None) and the output row.

    Events of one batch are taken in the order of (ts, event_id); batches are taken to follow each other in time. The
    state is one value a key and lives in the checkpoint, so a restarted query goes on where it was.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        now = held.get[0] if held.exists else None
        rows = []
        for values in pd.concat(list(parts)).sort_values(["ts", "event_id"])[["event_id", *taken]].itertuples(index=False, name=None):
            now, row = fold(now, values[1:])
            rows.append((values[0], *key, *row))
        held.update((now,))
        yield pd.DataFrame(rows, columns=names)

    schema = f"event_id long, {out}"
    names = [x.split()[0] for x in schema.split(", ")]
    return events.groupBy(*keys).applyInPandasWithState(step, schema, state, "append", GroupStateTimeout.NoTimeout)


def run_transitions_stream(events: DataFrame) -> DataFrame:
    """The stream twin of ``run_transitions``: each user's last status is the state."""

    def fold(before: str | None, values: tuple) -> tuple[str | None, tuple]:
        (status,) = values
        allowed = None if status is None else status == "created" if before is None else f"{before}>{status}" in ALLOWED
        return status, (before, status, allowed)

    named = events.withColumn("status", status_of(F.col("event_type")))
    return folded_stream(named, ["user_id"], ["status"], fold, "user_id long, before string, status string, allowed boolean", "status string")


def selection_stream(events: DataFrame, slices: int = 5, by_day: bool = True) -> DataFrame:
    """The stream twin of ``selection_replay``: each event with whether it was accepted and the version after it.

    Without ``by_day`` it is the twin of ``selection_history``: the state is kept by the user alone.
    """

    def fold(version: int | None, values: tuple) -> tuple[int, tuple]:
        hit = values[0] == (version or 0) % slices
        after = (version or 0) + int(hit)
        return after, (hit, after)

    asked = events.withColumn("expected", F.get_json_object("props", "$.k").cast("long") % slices).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    keys, named = (["user_id", "day"], "user_id long, day string") if by_day else (["user_id"], "user_id long")
    return folded_stream(asked, keys, ["expected"], fold, f"{named}, accepted boolean, version long", "version long")
