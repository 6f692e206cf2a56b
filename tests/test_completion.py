"""Completions against a sequential ledger; counters against a recount; lease ends against a walk over events."""

import random

import pytest
from gristmill.functions.schedule import LADDER
from gristmill.operators import completion
from gristmill.operators.completion import RECORD
from gristmill.operators.state import NEVER
from pyspark.sql import functions as F

LEDGER = "url_key int, host_id int, state int, status int, fetch_count long, change_count long, first_fetch_ms long, last_fetch_ms long, last_change_ms long, content_hash string, fail_streak int, next_due_ms long, lease_id string, lease_until_ms long"
OUTCOMES = "url_key int, seq long, lease_id string, finished_ms long, kind string, status int, content_hash string"
DAY = 86_400_000


def interval(n, changes, observed):
    import math

    x = max(changes - 1, 0)
    guess = DAY if observed <= 0 or n < 2 else 2 * observed if x == 0 else 0.5 / (-math.log((n - x + 0.5) / (n + 0.5)) * n / observed)
    return math.floor(min(max(guess, 5 * 60_000), 180 * DAY))


def sequential(ledger, outcomes, refused=()):
    """One outcome after the other, in order of arrival."""
    ledger = {k: dict(v) for k, v in ledger.items()}
    for key, _, lease, at, kind, status, content in sorted(outcomes, key=lambda o: (o[1], o[3] or 0)):
        row = ledger.get(key)
        if row is None or at is None or kind == "odd":
            continue
        if row["last_fetch_ms"] is not None and at <= row["last_fetch_ms"]:
            if row["lease_id"] is not None and row["lease_id"] == lease:
                row["lease_id"] = row["lease_until_ms"] = None
            continue
        row["last_fetch_ms"], row["lease_id"], row["lease_until_ms"] = at, None, None
        if kind in ("fetched", "not_modified"):
            row.update(state=1, status=status, fetch_count=(row["fetch_count"] or 0) + 1, fail_streak=0)
            row["first_fetch_ms"] = row["first_fetch_ms"] if row["first_fetch_ms"] is not None else at
            if kind == "fetched" and content != row["content_hash"]:
                row.update(change_count=(row["change_count"] or 0) + 1, last_change_ms=at)
            if kind == "fetched":
                row["content_hash"] = content
            row["change_count"] = row["change_count"] or 0
            row["next_due_ms"] = at + interval(row["fetch_count"], row["change_count"], at - row["first_fetch_ms"])
        elif kind == "failed":
            row.update(state=2, status=status or 0, fail_streak=(row["fail_streak"] or 0) + 1)
            row["next_due_ms"] = at + LADDER[min(row["fail_streak"], len(LADDER)) - 1]
        else:
            row.update(state=3 if kind == "gone" else 4, next_due_ms=NEVER, status=status if kind == "gone" else row["status"])
        if row["host_id"] in refused:
            row.update(state=4, next_due_ms=NEVER)
    return ledger


def start(r, n=60):
    out = {}
    for k in range(n):
        fetched = r.random() < 0.5
        out[k] = dict(host_id=k % 7, state=1 if fetched else 0, status=200 if fetched else 0, fetch_count=3 if fetched else 0, change_count=2 if fetched else 0, first_fetch_ms=100 if fetched else None, last_fetch_ms=5000 if fetched else None,
                      last_change_ms=4000 if fetched else None, content_hash="a" if fetched else None, fail_streak=0, next_due_ms=6000, lease_id=f"l{k}" if r.random() < 0.6 else None, lease_until_ms=99 if r.random() < 0.6 else None)
    return out


def batch(r, keys=64, n=150):
    kinds = ["fetched"] * 4 + ["not_modified"] * 2 + ["failed"] * 3 + ["gone", "excluded", "odd"]
    out = [(r.randrange(keys), i, f"l{r.randrange(keys)}", r.choice([None, *range(4000, 9000, 250)]), r.choice(kinds), r.choice([None, 200, 404]), r.choice("abc")) for i in range(n)]
    return out + r.sample(out, 30)


def frame(spark, ledger):
    return spark.createDataFrame([(k, v["host_id"], *(v[c] for c in RECORD)) for k, v in ledger.items()], LEDGER)


def rows_of(df):
    return {x["url_key"]: {"host_id": x["host_id"], **{c: x[c] for c in RECORD}} for x in df.collect()}


def same(got, want):
    for k, row in want.items():
        # Times from logarithms agree to the millisecond.
        assert abs(got[k]["next_due_ms"] - row["next_due_ms"]) <= 1
        assert {**got[k], "next_due_ms": 0, "fail_streak": got[k]["fail_streak"] or 0, "change_count": got[k]["change_count"] or 0} == {**row, "next_due_ms": 0, "fail_streak": row["fail_streak"] or 0, "change_count": row["change_count"] or 0}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_batches_and_counters(spark, seed):
    r = random.Random(seed)
    want = start(r)
    ledger = frame(spark, want)
    counters = completion.counted(ledger, "host_id")
    refused = {2, 5} if seed == 2 else set()
    out = spark.createDataFrame([(h,) for h in refused], "host_id int")
    for _ in range(2):
        outcomes = batch(r)
        changes = completion.change_set(ledger, spark.createDataFrame(outcomes, OUTCOMES).repartition(3), out).persist()
        after = sequential(want, outcomes, refused)
        moved = {x["url_key"] for x in changes.collect()}
        assert moved >= {k for k in want if {**want[k], "next_due_ms": 0} != {**after[k], "next_due_ms": 0}}
        ledger, want = spark.createDataFrame(completion.applied(ledger, changes).collect(), LEDGER), after
        counters = spark.createDataFrame(completion.maintained(counters, changes, "host_id").collect(), "host_id int, state int, urls long, leased long, fetches long")
        same(rows_of(ledger), want)
        assert sorted(map(tuple, counters.collect())) == sorted(map(tuple, completion.counted(ledger, "host_id").collect()))
        # The same batch again, in another order: nothing is newer, so nothing but leases could change.
        again = completion.change_set(ledger, spark.createDataFrame([(o[0], -o[1], *o[2:]) for o in outcomes if o[1] < 10**6], OUTCOMES), out)
        assert all(x["before"]["last_fetch_ms"] == x["after"]["last_fetch_ms"] and x["before"]["fetch_count"] == x["after"]["fetch_count"] for x in again.collect())
        changes.unpersist()


def test_late_outcomes_clear_only_their_own_lease(spark):
    row = dict(host_id=0, state=1, status=200, fetch_count=1, change_count=1, first_fetch_ms=10, last_fetch_ms=100, last_change_ms=10, content_hash="a", fail_streak=0, next_due_ms=7, lease_id="new", lease_until_ms=9)
    ledger = frame(spark, {1: row, 2: row, 3: row})
    outcomes = [(1, 1, "old", 90, "failed", 500, None), (2, 1, "new", 100, "fetched", 200, "b"), (9, 1, "x", 500, "fetched", 200, "b")]
    changes = completion.change_set(ledger, spark.createDataFrame(outcomes, OUTCOMES)).collect()
    assert [x["url_key"] for x in changes] == [2]
    assert changes[0]["after"].asDict() == {**changes[0]["before"].asDict(), "lease_id": None, "lease_until_ms": None}
    assert completion.change_set(ledger, spark.createDataFrame([], OUTCOMES)).count() == 0


def ends_by_hand(events, ttl, now):
    starts = {}
    for k, lease, at, e in events:
        if e == "lease":
            starts[k, lease] = min(at, starts.get((k, lease), at))
    out = []
    for (k, lease), at in starts.items():
        later = sorted((b, i) for (j, i), b in starts.items() if j == k and (b, i) > (at, lease))
        ends = [(at + ttl, 3, "expired")] + ([(later[0][0], 2, "superseded")] if later else [])
        ends += [(b, 0 if e == "complete" else 1, "completed" if e == "complete" else "released") for j, i, b, e in events if (j, i) == (k, lease) and e != "lease" and b >= at]
        end, _, name = min(ends)
        out.append((k, lease, at, end, name) if end <= now else (k, lease, at, None, "open"))
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_lease_ends(spark, seed):
    r = random.Random(seed)
    events = [(r.randrange(12), f"l{r.randrange(5)}", r.randrange(0, 100, 5), r.choice(["lease", "lease", "complete", "release"])) for _ in range(150)]
    want = ends_by_hand(events, 30, 90)
    assert len({w[-1] for w in want}) == 5
    got = completion.lease_ends(spark.createDataFrame(events, "url_key int, lease_id string, at_ms long, event string"), 30, 90)
    assert sorted(map(tuple, got.collect())) == want


def test_pen(spark):
    r = random.Random(4)
    pen = [(r.choice("abc"), r.randrange(30), r.randrange(0, 100, 3)) for _ in range(80)]
    first = {}
    for s, u, at in pen:
        first[s, u] = min(at, first.get((s, u), at))
    fresh = {s: sorted((at, u) for (x, u), at in first.items() if x == s and at + 40 > 90) for s in "abc"}
    want = {(s, u): "expired" if at + 40 <= 90 else "kept" if (at, u) in fresh[s][:4] else "over" for (s, u), at in first.items()}
    got = completion.pen_kept(spark.createDataFrame(pen, "source string, url_key int, at_ms long"), 90, 40, 4)
    assert {(x["source"], x["url_key"]): x["fate"] for x in got.collect()} == want and len(set(want.values())) == 3
