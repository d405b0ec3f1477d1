"""Pending records and snapshot changes, against plain Python and by hand."""

import datetime as dt
import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from lorekiln.operators.pending import PendingTable, pending_records
from lorekiln.operators.ranks import rank_in_buckets, sum_before
from lorekiln.operators.snapshot_changes import snapshot_changes
from pyspark.sql import functions as F

RECORDS = "id string, scraped_at timestamp, synced_at timestamp, content_hash string, is_indexed boolean, run_id int"
LOG = "run_id bigint, document_id string, content_hash string, outcome string, logged_at timestamp, id string"
HISTORY = "id bigint, status string, content_hash string"
MANIFESTS = "module string, submodule string, version string, manifest_hash string, manifest_json string, fetched_at timestamp, path string"


def day(n):
    return dt.datetime(2025, 1, 1) + dt.timedelta(days=n)


def tables(spark, records, log, history):
    return spark.createDataFrame(records, RECORDS), spark.createDataFrame(log, LOG), spark.createDataFrame(history, HISTORY)


RUNS = [(1, "completed", None), (2, "failed", None), (3, "completed", None), (3, "completed", None)]


def test_pending_rules(spark):
    records = [
        ("same", day(1), day(2), "AB", True, 0), ("same", day(1), day(2), "AB", True, 0),  # repeats, letter case
        ("older", day(1), day(2), "x", False, 0), ("older", day(3), day(4), "y", True, 0),  # the later state counts
        ("failed", day(1), day(2), "f", True, 0), ("unsynced", day(1), None, "u", False, 0), ("never", day(1), day(2), "n", True, 0),
        ("nohash", day(1), day(2), "h", True, 0), ("null", day(1), day(2), None, True, 0), (None, day(1), day(2), "z", True, 0),
    ]
    log = [
        (1, "same", "ab", "ok", day(5), None), (1, "older", "x", "ok", day(2), None), (2, "failed", "f", "ok", day(5), None), (3, "nohash", "h", "ok", day(4), None),
        (3, "nohash", None, "ok", day(6), None), (1, "null", "q", "ok", day(3), None), (3, "never", "n", "error", day(3), None), (None, None, None, None, None, None),
    ]
    got = {r.id for r in pending_records(*tables(spark, records, log, RUNS)).collect()}
    assert got == {"older", "failed", "never", "nohash", "null"}


def test_pending_empty(spark):
    assert pending_records(*tables(spark, [], [], [])).count() == 0


def test_refresh_touches_changed_partitions_only(spark, tmp_path):
    records = [(f"r{i}", day(1), day(2), f"h{i}", False, 0) for i in range(200)]
    log = [(1, f"r{i}", f"h{i}", "ok", day(3), None) for i in range(100)]
    pending = PendingTable(str(tmp_path / "p"), buckets=16)
    assert pending.refresh(*tables(spark, records, log, RUNS)) == list(range(16))
    assert pending.read(spark).count() == 100
    assert pending.refresh(*tables(spark, records[::-1], log, RUNS)) == []  # the order of rows is no change
    log.append((3, "r150", "h150", "ok", day(4), None))
    assert len(pending.refresh(*tables(spark, records, log, RUNS))) == 1
    assert pending.read(spark).count() == 99
    # a run that turns completed changes the buckets of its documents
    log.append((2, "r151", "h151", "ok", day(4), None))
    pending.refresh(*tables(spark, records, log, RUNS))
    assert pending.read(spark).count() == 99
    done = [(2, "completed", None) if r[0] == 2 else r for r in RUNS]
    assert len(pending.refresh(*tables(spark, records, log, done))) == 1
    assert pending.read(spark).count() == 98


def test_refresh_after_failure_repeats_the_work(spark, tmp_path, monkeypatch):
    records = [(f"r{i}", day(1), day(2), f"h{i}", False, 0) for i in range(20)]
    pending = PendingTable(str(tmp_path / "p"), buckets=4)
    real = type(spark).createDataFrame
    calls = []

    def dies(self, *a, **k):
        if "print string" in str(a[1:]) and calls:
            raise RuntimeError("lost")
        calls.append(1)
        return real(self, *a, **k)

    args = tables(spark, records, [], RUNS)
    monkeypatch.setattr(type(spark), "createDataFrame", dies)
    with pytest.raises(RuntimeError):
        calls.append(1)
        pending.refresh(*args)
    monkeypatch.undo()
    assert pending.refresh(*args) == [0, 1, 2, 3]  # no fingerprint was kept, so all is done again
    assert pending.read(spark).count() == 20


def manifest(target, key, when, files, bad=False):
    doc = json.dumps({"generated_at": when, "files": [{"path": p, "content_hash": h, "size_bytes": 1} for p, h in files]})
    return (target, None, "1", key, doc[:-7] if bad else doc, day(0), "x")


def test_snapshot_changes_by_hand(spark):
    rows = [
        manifest("m", "k3", "2025-03-01T00:00:00Z", [("a", "2"), ("c", "1"), ("c", "1")]),
        manifest("m", "k1", "2025-01-01T00:00:00+00:00", [("a", "1"), ("b", "1")]),
        manifest("m", "k1", "2025-01-01T00:00:00Z", [("b", "1"), ("a", "1")]),  # delivered twice
        manifest("m", "kx", "2025-02-01T00:00:00Z", [("zz", "9")], bad=True),  # passed over
        manifest("m", "k4", "2025-03-01T02:00:00+01:00", [("a", "2"), ("b", "1"), ("c", "1")]),  # zone: 01:00 UTC
        manifest("n", "q1", "2025-01-01T00:00:00Z", [("a", "1")]),
        ("m", None, "1", None, None, None, None),
    ]
    got = {(r.manifest_hash, r.path, r.change_type, r.old_hash, r.new_hash) for r in snapshot_changes(spark.createDataFrame(rows, MANIFESTS)).collect()}
    assert got == {
        ("k3", "a", "modified", "1", "2"), ("k3", "b", "removed", "1", None), ("k3", "c", "added", None, "1"), ("k4", "b", "added", None, "1"),
    }


def test_sizes_of_any_json_type(spark):
    doc = lambda when, size: json.dumps({"generated_at": when, "files": [{"path": "a", "content_hash": when[6], "size_bytes": size}]})
    rows = [("m", None, "1", f"k{i}", doc(f"2025-0{i}-01T00:00:00Z", s), day(0), "x") for i, s in enumerate((1, "123", 12.0, "no", None), 1)]
    got = {r.manifest_hash: r.size_bytes for r in snapshot_changes(spark.createDataFrame(rows, MANIFESTS)).collect()}
    assert got == {"k2": 123, "k3": 12, "k4": None, "k5": None}


def test_snapshot_changes_empty(spark):
    assert snapshot_changes(spark.createDataFrame([], MANIFESTS)).count() == 0


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.dictionaries(st.sampled_from("abcd"), st.sampled_from(["1", "2", "A", "a"]), max_size=4), min_size=1, max_size=5))
def test_snapshot_changes_random(spark, states):
    rows = [manifest("m", f"k{i}", f"2025-01-{i + 1:02d}T00:00:00Z", list(s.items())) for i, s in enumerate(states)]
    want = set()
    for i in range(1, len(states)):
        old, new = ({p: h.lower() for p, h in s.items()} for s in (states[i - 1], states[i]))
        for p in {*old, *new}:
            if p not in old:
                want.add((f"k{i}", p, "added"))
            elif p not in new:
                want.add((f"k{i}", p, "removed"))
            elif old[p] != new[p]:
                want.add((f"k{i}", p, "modified"))
    got = {(r.manifest_hash, r.path, r.change_type) for r in snapshot_changes(spark.createDataFrame(rows, MANIFESTS)).collect()}
    assert got == want


def test_rank_in_buckets_equals_one_sort(spark):
    rows = [("g" if i % 3 else None, (i * 37) % 101, i) for i in range(200)]
    df = spark.createDataFrame(rows, "g string, v int, id int")
    ranked = rank_in_buckets(df, ["g"], F.floor(F.col("v") / 10), [F.col("v"), F.col("id")]).collect()
    for g in ("g", None):
        order = sorted((v, i) for k, v, i in rows if k == g)
        assert {(r.v, r.id): r["rank"] for r in ranked if r.g == g} == {x: n for n, x in enumerate(order, 1)}


def test_sum_before(spark):
    df = spark.createDataFrame([("a", i, i + 1) for i in range(50)] + [("b", 0, None)], "g string, n int, v int")
    got = {(r.g, r.n): r.s for r in sum_before(df, ["g"], "n", "v", "s", block=7).collect()}
    assert got[("b", 0)] == 0 and all(got[("a", n)] == n * (n + 1) // 2 for n in range(50))
