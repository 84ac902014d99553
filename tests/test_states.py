"""Streams that begin with state and forget, payloads of any shape, caps and providers' states against brute force."""

import json
from datetime import date, datetime, timedelta

import numpy as np
import pytest

from almanac.functions import payloads
from almanac.operators import confound, select
from almanac.streaming import jobs, state

DAY = 86_400_000


def emitted(spark, folder, batches, keep_days, initial=None):
    """(user, event) in order of what a stream over one file for each batch lets through."""
    schema = "user_id long, event_id long, ts timestamp"
    for rows in batches:
        spark.createDataFrame([(u, e, datetime(2024, 1, 1) + timedelta(days=d)) for u, e, d in rows], schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    with state.rocks(spark):
        stream = state.recent_capped(jobs.source(spark, f"{folder}/in", spark.read.parquet(f"{folder}/in").schema, files=1), 3, keep_days * DAY, initial=initial)
        jobs.run_once(stream, f"{folder}/out", f"{folder}/checkpoint")
    return sorted((r["user_id"], r["event_id"]) for r in spark.read.schema(schema).parquet(f"{folder}/out").collect())


def test_state_goes_when_a_key_has_been_silent(spark, tmp_path):
    batches = [[(1, e, 0) for e in (10, 11, 11, 12, 13)], [(2, 20, 50)], [(1, e, 51) for e in (10, 12, 14)]]
    first = [(1, 10), (1, 11), (1, 12), (2, 20)]
    assert emitted(spark, f"{tmp_path}/a", batches, 90) == first
    assert emitted(spark, f"{tmp_path}/b", batches, 10) == sorted([*first, (1, 10), (1, 12), (1, 14)])


def test_a_stream_begins_with_an_earlier_runs_rows(spark, tmp_path):
    initial = spark.createDataFrame([(1, [10, 11], datetime(2024, 1, 1)), (3, [30, 31, 32], datetime(2024, 1, 1))], "user_id long, kept array<long>, ts timestamp")
    batches = [[(1, e, 1) for e in (10, 11, 12, 13)] + [(3, 33, 1), (2, 20, 1)]]
    assert emitted(spark, f"{tmp_path}/c", batches, 90, initial) == [(1, 12), (2, 20)]


ITEM = {"id": "5", "full_text": " hello ", "createdAt": "2024-01-02T03:04:05Z", "user": {"screen_name": "x", "username": "@ann"}, "likeCount": 3}


@pytest.mark.parametrize(("payload", "want"), [
    ([ITEM], [(5, "hello", "ann", 3)]),
    ({"results": [ITEM, {**ITEM, "id": 6, "likeCount": {"a": 1}, "likes": "4"}]}, [(5, "hello", "ann", 3), (6, "hello", "ann", 4)]),
    (ITEM, [(5, "hello", "ann", 3)]),
    ({"items": {"no": "list"}, "tweets": [{"tweet": {"rest_id": 7, "text": "t", "created_time": "2024-01-02"}}]}, [(7, "t", None, None)]),
    ([{**ITEM, "type": "Mock_Tweet"}, {**ITEM, "id": -1}, {**ITEM, "id": "x"}, {**ITEM, "full_text": ["a"]}, {**ITEM, "full_text": " "}, {**ITEM, "createdAt": "soon"}, {**ITEM, "id": None}, 5, "s", None, []], []),
    ("[1, 2", []), ("", []), (None, []), ("null", []), ("3", []), ("[]", []),
])
def test_posts_of_payloads(spark, payload, want):
    text = payload if payload is None or isinstance(payload, str) else json.dumps(payload)
    got = payloads.posts_of(spark.createDataFrame([(1, text)], "k int, p string"), ["k"], "p").collect()
    assert sorted((r["post_id"], r["text"], r["handle"], r["likes"]) for r in got) == want
    assert all(r["created_at"] is not None for r in got)


def test_the_largest_cap_that_keeps_the_top_share(spark):
    rng = np.random.default_rng(0)
    for counts in ([5] * 12, rng.integers(1, 60, 40).tolist(), [1000, 900, 3, 2, 2, 1, 1, 1], [7, 1], [10] * 6 + [100] * 3, []):
        for top, most in ((5, 0.3), (2, 0.2), (5, 0.6), (1, 1.0), (3, 0.05)):
            want = (None, None)
            for c in range(1, max(counts, default=0) + 1):
                k = sorted((min(n, c) for n in counts), reverse=True)
                if sum(k[:top]) / sum(k) <= most:
                    want = (c, sum(k[:top]) / sum(k))
            r = select.share_cap(spark.createDataFrame(list(enumerate(counts)), "k int, n long"), "n", "k", top, most).first()
            assert (r["cap"], r["share"]) == (want[0], None if want[1] is None else pytest.approx(want[1])), (counts, top, most)


def test_states_of_providers(spark):
    rng = np.random.default_rng(1)
    start = date(2024, 1, 1)
    daily = [(f"t{t}", start + timedelta(days=d), int(rng.integers(0, 4)), int(d == 100)) for t in range(3) for d in range(0, 120, t + 1)]
    events = [(k, f"t{k % 4}", start + timedelta(days=int(rng.integers(-40, 160)))) for k in range(200)] + [(900, None, start), (901, "t0", None)]
    got = confound.provider_states(spark.createDataFrame(events, "event_id int, ticker string, event_date date"), spark.createDataFrame(daily, "ticker string, article_date date, news long, rare long"), ["news", "rare"])
    rows = {r["event_id"]: r for r in got.collect()}
    assert len(rows) == len(events)
    for i, ticker, day in events:
        own = [r for r in daily if r[0] == ticker]
        for c, name in ((2, "news"), (3, "rare")):
            near, reach = (sum(r[c] for r in own if day and abs((r[1] - day).days) <= n) for n in (1, 30))
            usual = 3 * sum(r[c] for r in own) / ((max(r[1] for r in own) - min(r[1] for r in own)).days + 1) if own else None
            want = "confounded" if own and near > 1.5 * usual else "clean" if reach else "unknown"
            assert rows[i][f"{name}_state"] == want and rows[i][f"{name}_near"] == near
    assert {r["rare_state"] for r in rows.values()} == {"confounded", "clean", "unknown"}


def test_users_of_a_bucket_are_one_group(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(jobs, "BUCKETS", 2)
    schema, start = "user_id long, event_id long, ts timestamp", datetime(2024, 1, 1)
    rows = [(u, 100 * u + e % (u + 2), start + timedelta(minutes=e)) for u in range(40) for e in range(30)] + [(None, e, start) for e in range(4)] + [(3, None, start)] * 2
    for half in (rows[::2], rows):
        spark.createDataFrame(half, schema).repartition(3).write.mode("append").parquet(f"{tmp_path}/in")
        jobs.run_once(jobs.distinct_capped(jobs.source(spark, f"{tmp_path}/in", spark.read.parquet(f"{tmp_path}/in").schema, files=2), 5), f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    got = [(r["user_id"], r["event_id"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()]
    assert len(got) == len(set(got)) and set(got) <= {r[:2] for r in rows}
    counts = {u: sum(g[0] == u for g in got) for u in [*range(40), None]}
    assert counts == {u: min(5, len({r[1] for r in rows if r[0] == u})) for u in counts}
