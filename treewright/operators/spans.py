"""Joins over source positions: enclosing spans, latest bindings, nearest places, one-to-one claims."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars

SPAN = ("sl", "sc", "el", "ec")


def _span(prefix: str) -> list:
    return [F.col(f"{prefix}{c}") for c in SPAN]


def _named(df: DataFrame, prefix: str, file: str) -> DataFrame:
    return df.select(F.col(file).alias("file"), *[F.col(c).alias(prefix + c) for c in df.columns if c != file])


def _level(a, b):
    """How many low bits of two line numbers must go until they are equal."""
    return F.when(a == b, 0).otherwise(F.length(F.bin(a.bitwiseXOR(b))))


def tightest_enclosing(inner: DataFrame, outer: DataFrame, inner_id: str, outer_id: str, file: str = "file") -> DataFrame:
    """(inner_id, outer_id): of the spans of the same file that hold a span, the one of least extent, then least id.

    Lines are halved into aligned blocks of 2 ** level. A span lies in the smallest block that holds it, and
    what it holds lies in the same block: so a span meets the spans of the at most 32 blocks around it, which
    cross their block's middle, not all spans of its file. Levels that no outer span has are left out. Both
    sides are sorted, since files compress so well that a table taken for small may not fit the driver.
    """
    a, b = _named(inner, "i_", file), _named(outer, "o_", file)
    b = b.withColumn("level", _level(F.col("o_sl"), F.col("o_el"))).withColumn("block", F.expr("shiftright(o_sl, level)"))
    levels = b.agg(F.collect_set("level").alias("levels"))
    own = _level(F.col("i_sl"), F.col("i_el"))
    a = a.crossJoin(F.broadcast(levels)).withColumn("level", F.explode(F.filter("levels", lambda x: x >= own))).withColumn("block", F.expr("shiftright(i_sl, level)")).drop("levels")
    pairs = a.join(b.hint("merge"), ["file", "level", "block"]).where(scalars.contains(_span("o_"), _span("i_")))
    best = F.min_by(F.col(f"o_{outer_id}"), F.struct(scalars.extent(_span("o_")), f"o_{outer_id}"))
    return pairs.groupBy(F.col(f"i_{inner_id}").alias(inner_id)).agg(best.alias(outer_id))


def latest_before(points: DataFrame, events: DataFrame, keys: list[str], point: str, event: str, value: str, name: str) -> DataFrame:
    """X20, F14, F16 (as-of): points with the value of the last event of the same keys strictly before them.

    One sort over both tables by key and position instead of a range join, so its cost doesn't grow with
    the events per key. point and event must have one type.
    """
    rows = points.withColumns({"_at": F.col(point), "_kind": F.lit(0), "_value": F.lit(None).cast(dict(events.dtypes)[value])})
    rows = rows.unionByName(events.select(*keys, F.col(event).alias("_at"), F.lit(1).alias("_kind"), F.col(value).alias("_value")), allowMissingColumns=True)
    seen = Window.partitionBy(*keys).orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn(name, F.last("_value", ignorenulls=True).over(seen))
    return rows.where("_kind = 0").drop("_at", "_kind", "_value")


def nearest_unique(points: DataFrame, places: DataFrame, key: list[str], point: str, place: str, value: str) -> DataFrame:
    """(point columns, value): the place of the same key nearest to a point, where exactly one is nearest.

    One sort over both tables by key and position: the nearest place is the last before or the first after.
    """
    at = places.groupBy(*key, F.col(place).alias("_at")).agg(F.count("*").alias("_n"), F.min(value).alias("_value"))
    at = at.select(*key, "_at", F.lit(0).alias("_kind"), F.struct(F.col("_at").alias("at"), F.col("_n").alias("n"), F.col("_value").alias("value")).alias("_place"))
    rows = at.unionByName(points.select(*key, F.col(point).alias("_at"), F.lit(1).alias("_kind")).distinct(), allowMissingColumns=True)
    order = Window.partitionBy(*key).orderBy("_at", "_kind")
    before = F.last("_place", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    # From the other end, so that this is a running value too.
    back = Window.partitionBy(*key).orderBy(F.desc("_at"), F.desc("_kind"))
    after = F.last("_place", ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumns({"_before": before, "_after": after}).where("_kind = 1")
    near, far = F.col("_at") - F.col("_before.at"), F.col("_after.at") - F.col("_at")
    left = F.col("_before").isNotNull() & (F.col("_after").isNull() | (near < far))
    right = F.col("_after").isNotNull() & (F.col("_before").isNull() | (far < near))
    found = rows.withColumn("_found", F.when(left, F.col("_before")).when(right, F.col("_after"))).where("_found.n = 1")
    return found.select(*key, F.col("_at").alias(point), F.col("_found.value").alias(value))


def claim_events(calls: DataFrame, events: DataFrame, name_penalty: int = 1_000_000) -> DataFrame:
    """(caller, ord, event): calls take events in source order, each event once.

    calls: caller, ord, name and a span; events: caller, event, name and a span. A call may take an event
    whose span overlaps its own, at the least start distance, a different name costing name_penalty.
    """
    a, b = calls.alias("c"), events.alias("e")
    pairs = a.join(b, F.expr("c.caller = e.caller")).where(scalars.overlaps([F.col(f"c.{x}") for x in SPAN], [F.col(f"e.{x}") for x in SPAN]))
    cost = scalars.start_distance([F.col("c.sl"), F.col("c.sc")], [F.col("e.sl"), F.col("e.sc")]) + F.when(F.expr("c.name <=> e.name"), 0).otherwise(name_penalty)
    rows = pairs.select(F.col("c.caller").alias("caller"), "ord", "event", cost.alias("cost"))
    schema = "caller string, ord int, event long"

    def run(table: pa.Table) -> pa.Table:
        taken, out = set(), []
        rows = sorted(table.to_pylist(), key=lambda r: (r["ord"], r["cost"], r["event"]))
        done = set()
        for r in rows:
            if r["ord"] not in done and r["event"] not in taken:
                done.add(r["ord"])
                taken.add(r["event"])
                out.append({k: r[k] for k in ("caller", "ord", "event")})
        return pa.Table.from_pylist(out, pa.schema([("caller", pa.string()), ("ord", pa.int32()), ("event", pa.int64())]))

    return rows.select("caller", F.col("ord").cast("int").alias("ord"), F.col("event").cast("long").alias("event"), "cost").groupBy("caller").applyInArrow(run, schema)
