"""Time-band joins and counts that survive hot keys.

A *point* asks about events of its key whose time lies in ``[ts + lo, ts + hi]``. Three forms:

* ``band_totals``  - how many / how much, without ever forming a pair;
* ``first_in_band`` - the first k events of each band, fetched by rank, so a point emits at most k rows;
* ``band_pairs``   - every pair, for operators whose result *is* the pair list.

All three cut time into buckets as wide as the band. A point lives in one bucket and an event is
copied into two, so the unit of work is (key, bucket), never a whole key. ``band_totals`` and
``first_in_band`` also collapse events to one row per (key, second) before the window runs, which
bounds a window group by the number of seconds in three buckets however many rows a key holds. Frames of whole
numbers are differences of running totals, so a group costs its rows; sums of fractions slide, as differences would
change their last bits.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_BUCKET, _IS_POINT = "__bucket", "__point"


def _home(ts: Column, lo: int, width: int) -> Column:
    return F.floor((ts + lo) / width).cast("long")


def _copies(ts: Column, width: int) -> Column:
    b = F.floor(ts / width).cast("long")
    return F.explode(F.array(b, b - 1))


def _gridded(events: DataFrame, keys: Sequence[str], ts: str, measures: Mapping[str, Column]) -> DataFrame:
    """One row per (key, second): the map-side combine removes repeated hot keys before the shuffle."""
    present = F.col(ts).isNotNull()
    for k in keys:
        present = present & F.col(k).isNotNull()
    return (events.where(present).groupBy(*keys, F.col(ts).alias("ts"))
            .agg(*[F.sum(expr).alias(name) for name, expr in measures.items()]))


def band_totals(points: DataFrame, events: DataFrame, keys: Sequence[str],
                frames: Mapping[str, tuple[int, int, str]], measures: Mapping[str, Column] | None = None,
                event_ts: str = "ts") -> DataFrame:
    """Distinct ``(keys, ts)`` of ``points`` with one summed column per frame.

    ``frames`` maps an output name to ``(lo, hi, measure)``; ``measures`` maps a measure name to an
    expression on ``events`` (default: ``n`` counts rows). All frames share one pass.
    """
    keys = list(keys)
    measures = dict(measures or {"n": F.lit(1).cast("long")})
    lo = min(f[0] for f in frames.values())
    hi = max(f[1] for f in frames.values())
    width = hi - lo + 1
    ev = (_gridded(events, keys, event_ts, measures)
          .withColumn(_BUCKET, _copies(F.col("ts"), width))
          .select(*keys, "ts", _BUCKET, F.lit(False).alias(_IS_POINT), *measures))
    known = F.col("ts").isNotNull()
    for k in keys:
        known = known & F.col(k).isNotNull()
    pt = points.where(known).select(*keys, "ts").distinct()
    pt = pt.select(*keys, "ts", _home(F.col("ts"), lo, width).alias(_BUCKET), F.lit(True).alias(_IS_POINT),
                   *[F.lit(None).cast(t).alias(n) for n, t in ev.dtypes if n in measures])
    w = W.partitionBy(*keys, _BUCKET).orderBy("ts")
    out = ev.unionByName(pt)
    whole = {n for n, t in ev.dtypes if n in measures and t in ("bigint", "int", "smallint", "tinyint")}
    ends = {(m, at) for f_lo, f_hi, m in frames.values() if m in whole for at in (f_lo - 1, f_hi)}
    out = out.select(*keys, "ts", _IS_POINT, *[_up_to(w, m, at).alias(f"__{m}{at}") for m, at in sorted(ends)], *[
        F.coalesce(F.sum(m).over(w.rangeBetween(f_lo, f_hi)), F.lit(0)).alias(name)
        for name, (f_lo, f_hi, m) in frames.items() if m not in whole])
    return out.where(_IS_POINT).select(*keys, "ts", *[
        (F.col(f"__{m}{f_hi}") - F.col(f"__{m}{f_lo - 1}")).alias(name) if m in whole else F.col(name)
        for name, (f_lo, f_hi, m) in frames.items()])


def _up_to(w, measure: str, at: int) -> Column:
    """Total of all rows up to ``at`` seconds from the row, read once in order. A frame is the difference of two of
    them; a sliding frame would be added up anew for each row, which grows with the square of a busy key's rows."""
    return F.coalesce(F.sum(measure).over(w.rangeBetween(W.unboundedPreceding, at)), F.lit(0).cast("long"))


def with_band_totals(points: DataFrame, events: DataFrame, keys: Mapping[str, str],
                     frames: Mapping[str, tuple[int, int, str]], measures: Mapping[str, Column] | None = None,
                     event_ts: str = "ts", ts: str = "ts") -> DataFrame:
    """``points`` plus the frame columns; ``keys`` maps a point column to its event column."""
    probe = points.select(*[F.col(p).alias(e) for p, e in keys.items()], F.col(ts).alias("ts"))
    totals = band_totals(probe, events, list(keys.values()), frames, measures, event_ts)
    renamed = totals.select(*[F.col(e).alias(f"__k{i}") for i, e in enumerate(keys.values())],
                            F.col("ts").alias("__ts"), *frames)
    cond = F.col(ts) == F.col("__ts")
    for i, p in enumerate(keys):
        cond = cond & (F.col(p) == F.col(f"__k{i}"))
    joined = points.join(renamed, cond, "left").drop("__ts", *[f"__k{i}" for i in range(len(keys))])
    return joined.withColumns({name: F.coalesce(F.col(name), F.lit(0)) for name in frames})


def first_in_band(points: DataFrame, events: DataFrame, keys: Sequence[str], lo: int, hi: int, k: int,
                  event_id: str, payload: Sequence[str], event_ts: str = "ts") -> DataFrame:
    """The ``k`` earliest events of each point's band, ordered by (time, id).

    Returns ``(keys, ts, pos, in_band, event_ts, event_id, payload)`` for distinct points; ``pos``
    starts at 1 and ``in_band`` is the full size of the band.
    Events get a rank inside their bucket; a point turns its band into at most ``k`` consecutive ranks
    and looks them up by equality, so no point-event cross product inside a key is ever formed.
    """
    keys = list(keys)
    width = hi - lo + 1
    grid = _gridded(events, keys, event_ts, {"n": F.lit(1).cast("long")})
    ev = (grid.withColumn(_BUCKET, _copies(F.col("ts"), width))
          .select(*keys, "ts", _BUCKET, F.lit(False).alias(_IS_POINT), "n"))
    known = F.col("ts").isNotNull()
    for c in keys:
        known = known & F.col(c).isNotNull()
    pt = points.where(known).select(*keys, "ts").distinct()
    pt = pt.select(*keys, "ts", _home(F.col("ts"), lo, width).alias(_BUCKET), F.lit(True).alias(_IS_POINT),
                   F.lit(None).cast("long").alias("n"))
    w = W.partitionBy(*keys, _BUCKET).orderBy("ts")
    marked = ev.unionByName(pt).select(
        *keys, "ts", _BUCKET, _IS_POINT, _up_to(w, "n", hi).alias("__to"),
        _up_to(w, "n", lo - 1).alias("__skip"), _up_to(w, "n", -1).alias("__before"),
    ).withColumn("__in", F.col("__to") - F.col("__skip"))
    wanted = (marked.where(F.col(_IS_POINT) & (F.col("__in") > 0))
              .withColumn("pos", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(k).cast("long"), "__in"))))
              .select(*keys, "ts", _BUCKET, "pos", F.col("__in").alias("in_band"),
                      (F.col("__skip") + F.col("pos")).alias("__rank")))
    second = W.partitionBy(*keys, "__ets").orderBy(event_id)
    numbered = (events.where(F.col(event_ts).isNotNull())
                .select(*keys, F.col(event_ts).alias("__ets"), event_id, *payload)
                .withColumn("__in_second", F.row_number().over(second)))
    base = (marked.where(~F.col(_IS_POINT))
            .select(*keys, F.col("ts").alias("__ets"), _BUCKET, "__before"))
    ranked = (numbered.join(base, [*keys, "__ets"])
              .withColumn("__rank", F.col("__before") + F.col("__in_second"))
              .select(*keys, _BUCKET, "__rank", F.col("__ets").alias("event_ts"), event_id, *payload))
    return (wanted.join(ranked, [*keys, _BUCKET, "__rank"])
            .select(*keys, "ts", "pos", "in_band", "event_ts", event_id, *payload))


def band_pairs(points: DataFrame, events: DataFrame, keys: Sequence[str], lo: int, hi: int,
               event_ts: str = "__ets") -> DataFrame:
    """Every (point, event) pair in the band. Equi join on (keys, bucket) with the band as residual.

    The bucket is part of the join key, so one hot phone is spread over all its buckets and adaptive
    skew handling can split what is still large. Columns other than ``keys`` must not clash.
    """
    keys = list(keys)
    width = hi - lo + 1
    p = points.where(F.col("ts").isNotNull()).withColumn(_BUCKET, _home(F.col("ts"), lo, width))
    e = events.where(F.col(event_ts).isNotNull()).withColumn(_BUCKET, _copies(F.col(event_ts), width))
    delta = F.col(event_ts) - F.col("ts")
    return (p.join(e, [*keys, _BUCKET]).where((delta >= lo) & (delta <= hi)).drop(_BUCKET))
