"""Band operators against brute force on random data with a hot key, and boundary cases."""

import random

from pyspark.sql import functions as F

from weftline.operators.bands import band_pairs, band_totals, first_in_band
from weftline.operators.ordering import (linear_quantiles, order_statistics, values_at_most, with_position, with_running,
                                         with_trailing_rows)


def _data(n=300, seed=7):
    rnd = random.Random(seed)
    key = lambda: "hot" if rnd.random() < 0.5 else f"k{rnd.randrange(5)}"
    return ([(f"p{i}", key(), rnd.randrange(0, 5000)) for i in range(n)], [(f"e{i:04d}", key(), rnd.randrange(0, 5000)) for i in range(n)])


def test_bands_match_brute_force(spark):
    pts, evs = _data()
    p = spark.createDataFrame(pts, "pid string, k string, ts long")
    e = spark.createDataFrame(evs, "eid string, k string, ts long")
    for lo, hi in ((-300, 300), (-600, -1), (0, 90), (1, 900)):
        want = {(k, t): sorted((et, eid) for eid, ek, et in evs if ek == k and t + lo <= et <= t + hi) for _, k, t in pts}
        got = {(r.k, r.ts): r.n for r in band_totals(p, e, ["k"], {"n": (lo, hi, "n")}).collect()}
        assert got == {kt: len(v) for kt, v in want.items()}
        first = {}
        for r in first_in_band(p, e, ["k"], lo, hi, 3, "eid", []).collect():
            first.setdefault((r.k, r.ts), []).append((r.pos, r.event_ts, r.eid, r.in_band))
        assert {kt: [(a, b) for _, a, b, _ in sorted(v)] for kt, v in first.items()} == {kt: v[:3] for kt, v in want.items() if v}
        assert all(x[3] == len(want[kt]) for kt, v in first.items() for x in v)
        pairs = band_pairs(p.select("pid", "k", "ts"), e.select("eid", "k", F.col("ts").alias("__ets")), ["k"], lo, hi)
        assert {(r.pid, r.eid) for r in pairs.collect()} == {(pid, eid) for pid, k, t in pts for _, eid in want[(k, t)]}


def test_whole_numbers_are_never_added_up_anew_for_each_row(spark):
    """Running totals only, for several frames and measures at once; fractions keep their sliding sums."""
    pts, evs = _data()
    p = spark.createDataFrame(pts, "pid string, k string, ts long")
    e = spark.createDataFrame([(*x, i % 4) for i, x in enumerate(evs)], "eid string, k string, ts long, w int")
    frames = {"a": (-600, -1, "n"), "b": (0, 90, "w"), "c": (-1, -1, "n"), "d": (-300, 300, "half")}
    out = band_totals(p, e, ["k"], frames, {"n": F.lit(1).cast("long"), "w": F.col("w"), "half": F.col("w") / 2})
    for r in out.collect():
        near = lambda lo, hi: [i % 4 for i, (_, k, t) in enumerate(evs) if k == r.k and lo <= t - r.ts <= hi]
        assert (r.a, r.b, r.c, r.d) == (len(near(-600, -1)), sum(near(0, 90)), len(near(-1, -1)), sum(near(-300, 300)) / 2)
    sliding = lambda df: str(df._jdf.queryExecution().optimizedPlan()).count("RangeFrame, cast(-") + str(df._jdf.queryExecution().optimizedPlan()).count("RangeFrame, -")
    assert sliding(out) == 1
    assert sliding(first_in_band(p, e, ["k"], -300, 300, 3, "eid", [])) == 0


def test_positions_running_and_trailing_across_blocks(spark):
    pts, _ = _data(200)
    d = with_position(spark.createDataFrame(pts, "pid string, k string, ts long"), ["k"], "pid")
    d = with_running(d, ["k"], {"total": ("sum", F.col("ts")), "top": ("max", F.col("ts"))}, block=7)
    d = with_trailing_rows(d, ["k"], 3, {"mean3": ("mean", F.col("ts")), "prev": ("lag", F.col("ts"))}, block=7)
    got = {r.pid: r for r in d.collect()}
    assert len(got) == 200
    for key in {k for _, k, _ in pts}:
        rows = sorted((t, pid) for pid, k, t in pts if k == key)
        for i, (t, pid) in enumerate(rows):
            r = got[pid]
            seen = [x for x, _ in rows[:i + 1]]
            assert (r.pos, r.total, r.top) == (i, sum(seen), max(seen))
            assert abs(r.mean3 - sum(seen[-3:]) / len(seen[-3:])) < 1e-9 and r.prev == (seen[-2] if i else None)


def test_order_statistics_and_quantiles(spark):
    rnd = random.Random(3)
    rows = [("a" if i % 3 else "b", round(rnd.random() * 5000, 2)) for i in range(200)]
    d = spark.createDataFrame(rows, "k string, v double")
    n = F.col("n")
    got = {r.k: r for r in order_statistics(d, ["k"], "v", {"mid": F.floor(n / 2).cast("long"), "last": n - 1}).collect()}
    q = {r.k: r.q for r in linear_quantiles(d, ["k"], "v", {"q": 0.99}).collect()}
    rank = {(r.k, r.v): r.at_most for r in values_at_most(d, ["k"], "v").collect()}
    for k in "ab":
        vs = sorted(v for kk, v in rows if kk == k)
        assert got[k].mid == vs[len(vs) // 2] and got[k].last == vs[-1]
        x = (len(vs) - 1) * 0.99
        lo = int(x)
        assert abs(q[k] - (vs[lo] + (vs[min(lo + 1, len(vs) - 1)] - vs[lo]) * (x - lo))) < 1e-9
        assert all(rank[(k, v)] == i + 1 for i, v in enumerate(vs))


def test_ties_split_by_prefix(spark):
    d = spark.range(500).select(F.md5(F.col("id").cast("string")).alias("h"), F.lit(0.0).alias("v"))
    pos = [r.p for r in with_position(d, [], "h", ts="v", out="p", width=0.5, tie_prefix=2).orderBy("h").collect()]
    assert pos == list(range(500))


def test_running_median_both_ways(spark):
    import statistics

    from weftline.operators.running_median import running_median
    rnd = random.Random(11)
    rows = [("h" if i % 4 else "x", i, float(rnd.randrange(40))) for i in range(90)]
    d = with_position(spark.createDataFrame(rows, "k string, ts long, v double"), ["k"], "ts")
    want = {}
    for key in "hx":
        vs = [v for k, _, v in rows if k == key]
        want.update({(key, i): statistics.median(vs[:i + 1]) for i in range(len(vs))})
    for small in (1000, 30):
        assert {(r.k, r.pos): r.median for r in running_median(d, "k", "v", small=small).collect()} == want
