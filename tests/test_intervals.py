"""Spans against windows, checked pair by pair."""
import datetime as dt
import random

import pytest

from loomtrace.operators import intervals as I


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_overlaps_equal_the_rule_for_every_pair(spark, seed):
    r = random.Random(seed)
    at = lambda: dt.datetime(2024, 1, 1) + dt.timedelta(hours=r.randrange(0, 400, 4))
    some = lambda: at() if r.random() < .85 else None
    spans = [(r.choice("aab"), some(), some()) for _ in range(120)]
    windows = [(r.choice("aabc"), k, some(), some()) for k in range(30)]
    got = I.overlaps(spark.createDataFrame(spans, "o string, first timestamp, last timestamp"),
                     spark.createDataFrame(windows + windows[:3], "o string, w int, since timestamp, until timestamp"), ["o"], ["w"])
    want = []
    for o, w, since, until in windows:
        if since and until and until <= since:
            continue
        hit = []
        for p, first, last in spans:
            end = first if first and last and last < first else last
            if p == o and (not first or not until or first < until) and (not end or not since or end >= since):
                hit.append((first, end))
        want.append((o, w, len(hit), min((f for f, _ in hit if f), default=None), max((e for _, e in hit if e), default=None)))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_no_spans_leave_windows_with_zero_and_no_windows_leave_nothing(spark):
    day = dt.datetime(2024, 1, 1)
    no_spans = spark.createDataFrame([], "o string, first timestamp, last timestamp")
    w = spark.createDataFrame([("a", 1, day, None)], "o string, w int, since timestamp, until timestamp")
    assert [tuple(x) for x in I.overlaps(no_spans, w, ["o"], ["w"]).collect()] == [("a", 1, 0, None, None)]
    assert I.overlaps(spark.createDataFrame([("a", day, day)], "o string, first timestamp, last timestamp"), w.limit(0), ["o"], ["w"]).count() == 0
