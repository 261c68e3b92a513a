"""Rolling sums and previous rows of keys that are split by time, against plain loops."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F
from sentrel.operators import features, store

T0 = datetime(2024, 1, 1)


def test_wallet_sums(spark):
    r = random.Random(4)
    at = lambda: r.choice([None, T0 + timedelta(hours=r.randint(0, 60), seconds=r.choice([0, 0, 1799, 3599]), microseconds=r.choice([0, 1]))])
    rows = [(i, r.choice(["hot", "hot", "b", None]), at(), r.choice([None, 100.0, 700.5, -20.0])) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, user_id string, event_time timestamp, amount_tnd double").withColumn("_x", F.lit(1))
    got = {x.id: x.amount_24h for x in features.wallet_24h_limit(df, 1500.0).collect()}
    want = {}
    for i, u, t, _ in rows:
        if t is not None:
            total = sum(a or 0 for _, v, s, a in rows if v == u and s is not None and t - timedelta(days=1) <= s <= t)
            want |= {i: total} if total > 1500 else {}
    assert set(got) == set(want) and len(want) > 50 and all(abs(got[i] - want[i]) < 1e-6 for i in want)
    assert features.wallet_24h_limit(df, 1500.0).columns == [*df.columns, "amount_24h"]


def test_previous_rows(spark):
    r = random.Random(5)
    rows = [(r.choice(["hot", "hot", "b", None]), i, r.choice([None, T0 + timedelta(hours=r.randint(0, 90))]), r.choice([None, "x", "y"]), "c") for i in range(200)]
    df = spark.createDataFrame(rows, "k string, feedback_id long, timestamp timestamp, analyst_label string, analyst_comment string")
    got = {x.feedback_id: (x.p is not None, x.p and x.p.analyst_label) for x in store.with_previous(df, "k", ["timestamp", "feedback_id"], ["analyst_label", "analyst_comment"], "p").collect()}
    want = {}
    for key in {x[0] for x in rows}:
        own = sorted((x for x in rows if x[0] == key), key=lambda x: (x[2] is not None, x[2] or T0, x[1]))
        want |= {b[1]: (a is not None, a and a[3]) for a, b in zip([None, *own], own)}
    assert got == want
