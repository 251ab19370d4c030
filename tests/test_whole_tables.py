"""Queries that take their whole tables, against brute force."""

import math
from collections import Counter, defaultdict

from pawprint import queries
from pawprint.queries import QUERIES, frames

SMALL = "/root/testdata/sf0.001"


def test_interval_labels_use_every_order(spark):
    by_file = defaultdict(list)
    for o in spark.read.parquet(f"{SMALL}/orders.parquet").collect():
        start = o.o_orderkey % 20
        by_file[str(o.o_custkey % 150)].append((o.o_orderkey, start, start + o.o_custkey % 4, o.o_orderpriority))
    want = {}
    for f in frames(spark, SMALL).select("file", "frame").collect():
        held = [(key, kind) for key, a, z, kind in by_file[f.file] if a <= f.frame / 2 <= z]
        want[f.file, f.frame] = max(held)[1] if held else "None"
    for name in ("interval_labels", "interval_labels_all"):
        assert {(r.file, r.frame): r.label for r in QUERIES[name](spark, SMALL).collect()} == want


def test_explicit_bins_use_every_customer(spark, tmp_path):
    """Customers 1, 151, 301, 451, 601 have the same file and 30 frames from the same place: their bins overlap."""
    keys = [(k, "AB"[k % 2]) for k in [*range(1, 150), *range(151, 160), 301, 451, 601]]
    spark.createDataFrame(keys, "c_custkey bigint, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    spark.read.parquet(f"{SMALL}/events.parquet").write.parquet(f"{tmp_path}/events.parquet")
    by_file = defaultdict(list)
    for k, kind in keys:
        by_file[str(k % 150)].append((kind, k % 30))
    n, valid = Counter(), Counter()
    for f in frames(spark, SMALL).select("file", "frame", "x").collect():
        for kind, lo in by_file[f.file]:
            if lo <= f.frame <= lo + 9:
                n[f.file, kind] += 1
                valid[f.file, kind] += f.x is not None
    for name in ("explicit_bins", "explicit_bins_all"):
        assert {(r.file, r.bin): (r.n, r.valid) for r in QUERIES[name](spark, str(tmp_path)).collect()} == {k: (n[k], valid[k]) for k in n}


def test_directed_contact_counts_right_angles(spark, monkeypatch):
    """Animal 1 at many headings, its nose turned by just 90 degrees from animal 2's; animal 2 faces it."""
    names = [f"{p}_{c}" for p in ("body1", "nose1", "tail1", "body2", "nose2", "tail2") for c in "xy"]
    rows = []
    for i in range(200):
        a = i * 0.7
        u, v = math.cos(a), math.sin(a)
        n2 = (3 + u - 5 * v, 4 + v + 5 * u)
        rows.append(("f", i, 3.0, 4.0, 3 + u, 4 + v, 2.0, 4.0, n2[0] - v, n2[1] + u, *n2, 9.0, 9.0))
    d = spark.createDataFrame(rows, ["file", "frame", *names])
    monkeypatch.setattr(queries, "dyads_from_events", lambda *_: d)
    assert tuple(QUERIES["directed_contact_all"](spark, "").first()) == ("f", 200, 200, 200, 200, 0)
    assert tuple(QUERIES["directed_contact"](spark, "").first()) == ("f", 200, 200, 200, 200, 0)


def test_flat_polygons_give_no_factor(spark):
    """Points on one line, whose area comes out at 1e-15 or so, leave a track as it is."""
    from pawprint.operators.calibrate import calibration_factor, scaling

    rows = [(f"t{i}", p, 0.1 * i + 0.3 * k, 0.7 * i + 0.1 * k) for i in range(30) for k, p in enumerate(("a", "b", "c"))]
    rows += [("whole", "a", 0.0, 0.0), ("whole", "b", 2.0, 0.0), ("whole", "c", 0.0, 1.0)]
    factors = calibration_factor(spark.createDataFrame(rows, "file string, point string, x double, y double"), "area", 25.0, ["a", "b", "c"])
    got = {r.file: r.px_to_cm for r in factors.collect()}
    assert got.pop("whole") == 5.0 and len(got) == 30 and set(got.values()) == {None}
    assert all(r.m00 == (5.0 if r.file == "whole" else 1.0) for r in scaling(factors).collect())
