"""Escalation triggers by hand; customers without a label; segments of any number."""

import datetime as dt
import random

import pytest

from attrita.operators import explore as ex
from attrita.operators import segments as sg
from attrita.operators.escalation import escalations
from tests.conftest import CANON_SCHEMA, customer_row

DAY = dt.timedelta(days=1)
START = dt.datetime(2024, 1, 4)     # a week of the epoch begins


def test_triggers(spark):
    rows = [
        (1, START, "click", 100.0), (1, START + 8 * DAY, "click", 40.0), (1, START + 15 * DAY, "click", 20.0),     # 100 -> 40 -> 20
        (2, START, "click", 100.0), (2, START + 15 * DAY, "click", 60.0),       # a week without events in between
        (3, START + 14 * DAY, "click", 100.0),                                  # its next week has not begun
        (4, START + 16 * DAY, "error", 249.0), (4, START + 16 * DAY, "error", 250.0), (4, START + 16 * DAY, "error", 50.0),
        (5, START + 10 * DAY, "click", None), (None, START, "error", 999.0), (6, None, "error", 999.0),
    ]
    events = spark.createDataFrame([(i, t, u, k, v) for i, (u, t, k, v) in enumerate(rows)],
                                   "event_id long, ts timestamp_ntz, user_id long, event_type string, value double")
    got = {(x.user_id, x.trigger): (x.action, x.occurrences, x.last_at) for x in escalations(events, inactive_days=3).collect()}
    assert got == {
        (1, "Balance drop"): ("Relationship check", 1, START + 7 * DAY),
        (2, "Balance drop"): ("Relationship check", 1, START + 7 * DAY),
        (4, "Negative feedback"): ("Immediate resolution", 1, START + 16 * DAY),
        (4, "Closed account attempt"): ("Urgent intervention", 1, START + 16 * DAY),
        (5, "No activity"): ("Personal call", 1, START + 10 * DAY),
    }
    assert escalations(events.limit(0)).count() == 0


def test_a_customer_without_label(spark):
    """One rule: a customer, but neither churned nor retained."""
    rows = [customer_row(customer_id=i, exited=y, geography=g) for i, (y, g) in enumerate([(1, "A"), (0, "A"), (None, "A"), (None, "B")])]
    df = spark.createDataFrame(rows, CANON_SCHEMA)
    k = ex.kpis(df).first()
    assert (k.total_customers, k.churn_rate_pct, k.churned, k.retained) == (4, 50.0, 1, 1)
    by = {x.geography: (x.churn_rate_pct, x.customers, x.churned) for x in ex.churn_rate_by(df, "geography").collect()}
    assert by == {"A": (50.0, 3, 1), "B": (None, 1, 0)}
    assert [(x.customers, x.share_pct) for x in ex.class_counts(df).orderBy("exited").collect()] == [(1, 50.0), (1, 50.0)]
    per = {x.segment: (x.size, x.churn_rate, x.churn_count, x["rank"]) for x in sg.segment_stats(df, "geography").collect()}
    assert per == {"A": (3, 50.0, 1, 0), "B": (1, None, 0, 1)}


@pytest.mark.parametrize("bound", [10_000, 3])
def test_segments_of_any_number(spark, monkeypatch, bound):
    monkeypatch.setattr(sg, "MAX_SEGMENTS", bound)
    r = random.Random(1)
    rows = [customer_row(customer_id=i, geography=f"g{r.randrange(60):02d}", exited=r.choice([0, 0, 1, None])) for i in range(400)]
    df = spark.createDataFrame(rows, CANON_SCHEMA)
    got = sorted((x["rank"], x.segment, x.size, round(x.size_pct, 6)) for x in sg.segment_stats(df, "geography").collect())
    by = {}
    for x in rows:
        by.setdefault(x[2], []).append(x[11])
    rate = {g: (lambda k: sum(k) / len(k) if k else None)([y for y in ys if y is not None]) for g, ys in by.items()}
    order = sorted(by, key=lambda g: (rate[g] is None, -(rate[g] or 0), g))
    assert got == [(k, g, len(by[g]), round(len(by[g]) / 4, 6)) for k, g in enumerate(order)]
