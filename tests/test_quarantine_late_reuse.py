"""CSV quarantine, late rows of a stream, reuse that notices new data, clusters on given centres."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from attrita.ml import clustering as cl
from attrita.ml import explain as xp
from attrita.ml import models as md
from attrita.operators import centres as ce
from attrita.operators.features import engineer_features
from attrita.plans import catalog
from attrita.sources.customer_csv import ingest_customer_csv
from attrita.sources.reuse import ReusedTables, input_version
from attrita.streaming import late
from tests.test_calibration import planted

HEADER = ("RowNumber,CustomerId,Surname,CreditScore,Geography,Gender,Age,Tenure,Balance,NumOfProducts,HasCrCard,"
          "IsActiveMember,EstimatedSalary,Exited")
GOOD = '1,{id},"O\'Neil, Jr",650,France,Female,40,3,100.5,2,1,0,5000.25,1'


def test_quarantine(spark, tmp_path):
    bad = {
        "1,2,Doe,650,France,Female,40,3,1.0,2,1,0,5000.0": "fields 13",
        '1,3,"Doe, J",650,France,Female,40,3,1.0,2,1,0,5000.0,1,more': "fields 15",
        "1,4,Doe,650,France,Female,forty,3,1.0,2,1,0,5000.0,1": "type Age",
        '1,5,"Doe, J",650,France,Female,40,3,much,2,1,0,5000.0,1': "type Balance",
        "1,6,Doe,650,France,Female,40,3,1.0,2,1,0,5000.0,2": "label",
        "1,7,Doe,650,France,Female,40,3,1.0,2,1,0,5000.0,": "missing Exited",
        "1,,Doe,650,France,Female,40,3,1.0,2,1,0,5000.0,1": "missing CustomerId",
        "only text": "fields 1",
    }
    lines = [HEADER, *[GOOD.format(id=100 + i) for i in range(30)], *bad, GOOD.format(id=100), "1,8,Doe,,,,,,,,,,,0"]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("\n".join(lines) + "\n")
    (tmp_path / "in" / "b.csv").write_text(HEADER + "\n")
    got = ingest_customer_csv(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    assert got.counts == {"lines": 32 + len(bad), "quarantined": len(bad)}
    reasons = {r.line: r.reason for r in got.quarantine.collect()}
    assert sorted(reasons.values()) == sorted(bad.values())
    for line, reason in bad.items():
        if reason.split()[0] in ("fields", "type"):     # these stand as they were
            assert reasons[line] == reason
    rows = got.customers.collect()
    assert len(rows) == 32 and sum(r.customer_id == 100 for r in rows) == 2
    one = next(r for r in rows if r.customer_id == 101)
    assert (one.age, one.balance, one.estimated_salary, one.exited) == (40, 100.5, 5000.25, 1)
    empty = next(r for r in rows if r.customer_id == 8)
    assert empty.age is None and empty.geography is None and empty.exited == 0


def test_quarantine_of_an_empty_file(spark, tmp_path):
    (tmp_path / "a.csv").write_text(HEADER + "\n")
    got = ingest_customer_csv(spark, str(tmp_path / "a.csv"), str(tmp_path / "out"))
    assert got.counts == {"lines": 0, "quarantined": 0} and got.customers.count() == got.quarantine.count() == 0


DAY = dt.timedelta(days=1)
START = dt.datetime(2024, 1, 4)     # a Thursday: weeks since the epoch begin there


def events(spark, rows):
    return spark.createDataFrame([(i, t, u, "purchase" if i % 3 == 0 else "click", float(i), s) for i, (t, u, s) in enumerate(rows)],
                                 "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, slot int")


def expected(rows, allowed=1.0):
    kept, behind = [], []
    for i, (t, u, s) in enumerate(rows):
        if t is None or u is None:
            continue
        before = [x for x, v, slot in rows if slot < s and x is not None and v is not None]
        week = START + (t - START) // (7 * DAY) * 7 * DAY
        mark = max(before) - allowed * DAY if before else None
        (behind if mark is not None and week + 7 * DAY <= mark else kept).append((i, week, mark))
    return kept, behind


def test_late_rows_are_kept_apart(spark):
    r = random.Random(4)
    rows = []
    for _ in range(300):
        day = r.randrange(28)
        rows.append((START + day * DAY + r.random() * DAY, r.choice([1, 1, 1, 2, 3]), day // 3 + (5 if r.random() < 0.1 else 0)))
    rows += [(None, 1, 2), (START, None, 9), (START, 1, 9), (START + 7 * DAY, 1, 9)]
    kept, behind = expected(rows)
    source = events(spark, rows)
    out = replay(spark, source)
    got = {(x.event_id, x.watermark) for x in late.late_rows(spark, out).collect()}
    assert got == {(i, mark) for i, _, mark in behind} and len(got) > 5
    totals = {}
    for i, week, _ in kept:
        n, p, v = totals.get((rows[i][1], week), (0, 0, 0.0))
        totals[rows[i][1], week] = n + 1, p + (i % 3 == 0), v + i
    assert {(x.user_id, x.week_start): (x.events, x.purchases, x.total_value) for x in late.weekly_totals(spark, out).collect()} == totals
    marks = spark.read.schema(late.MARKS).parquet(out + "/marks").agg(F.sum("rows"), F.sum("late")).first()
    assert tuple(marks) == (len(kept) + len(behind), len(behind))


def replay(spark, source):
    import uuid

    from attrita.session import scratch_path

    run = uuid.uuid4().hex[:8]
    folder, out, checkpoint = (scratch_path(spark, f"late-test-{run}/{p}") for p in ("in", "out", "checkpoint"))
    late.land_in_order(source, F.col("slot"), folder)
    schema = source.drop("slot").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(folder)
    late.start_weekly_activity(stream, out, checkpoint).awaitTermination()
    return out


def test_a_batch_written_twice_counts_once(spark, tmp_path):
    out = str(tmp_path / "out")
    write = late.write_batch(out)
    first = events(spark, [(START, 1, 0), (START + 9 * DAY, 1, 0)]).drop("slot")
    second = events(spark, [(START, 2, 0), (START + 8 * DAY, 2, 0)]).drop("slot")
    for batch, k in ((first, 0), (first, 0), (second, 1), (second, 1)):
        write(batch, k)
    assert sorted((x.user_id, x.events) for x in late.weekly_totals(spark, out).collect()) == [(1, 1), (1, 1), (2, 1)]
    assert [x.user_id for x in late.late_rows(spark, out).collect()] == [2]


def test_reuse_notices_changed_files(spark, tmp_path):
    source, made = str(tmp_path / "in"), []
    spark.range(5).write.parquet(source)
    tables = ReusedTables(spark, str(tmp_path / "reused"))

    def get():
        return tables.get("count", [source], lambda: (made.append(1), spark.read.parquet(source).groupBy().count())[1]).first()[0]

    assert get() == get() == 5 and len(made) == 1
    spark.range(3).write.mode("append").parquet(source)
    assert get() == get() == 8 and len(made) == 2
    assert len(tables.versions("count")) == 1       # the older one is gone
    tables.drop("count")
    assert tables.versions("count") == [] and get() == 8 and len(made) == 3
    assert input_version(spark, [source, str(tmp_path / "none")]) == input_version(spark, [source])


def test_materialized_profile_follows_the_tables(spark, tmp_path):
    import shutil

    folder = str(tmp_path / "sf")
    shutil.copytree("/root/testdata/sf0.001", folder, copy_function=shutil.copyfile)
    catalog.use_materialized_profile(spark, folder)
    try:
        before = catalog.q_kpis(spark, folder).first().total_customers
        orders = spark.read.parquet(f"{folder}/orders.parquet")
        fewer = orders.where(F.col("o_custkey") % 2 == 0).toPandas()
        fewer.to_parquet(f"{folder}/orders.parquet", coerce_timestamps="us")
        after = catalog.q_kpis(spark, folder).first().total_customers
        assert 0 < after < before
    finally:
        catalog.drop_materialized_profile(folder)


def plain_silhouette(x, label):
    out = []
    for i in range(len(x)):
        apart = ((x - x[i]) ** 2).sum(axis=1)
        own = label == label[i]
        if own.sum() == 1:
            out.append(0.0)
            continue
        b = min(apart[label == k].mean() for k in set(label.tolist()) if k != label[i])
        a = apart[own].sum() / (own.sum() - 1)
        out.append((b - a) / max(a, b) if max(a, b) > 0 else 0.0)
    return np.array(out)


def test_centre_quality(spark):
    r = np.random.default_rng(5)
    x = np.concatenate([r.normal(m, 1.0, (40, 3)) for m in (0, 4, 9)] + [[[60.0, 60.0, 60.0]], [[1.0, 1.0, 1.0]] * 3])
    rows = [tuple(map(float, v)) for v in x] + [(None, 1.0, 2.0), (float("nan"), 1.0, 2.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double").repartition(3)
    known = df.where("a is not null and not isnan(a)")
    centres = [[-0.5, -0.5, -0.5], [0.2, 0.2, 0.2], [5.0, 5.0, 5.0], [99.0, 99.0, 99.0]]
    got = {q.cluster: q for q in ce.centre_quality(known, ["a", "b", "c"], centres).collect()}
    z = (x - x.mean(axis=0)) / x.std(axis=0, ddof=1)
    apart = ((z[:, None] - np.array(centres)) ** 2).sum(axis=2)
    label, sil = apart.argmin(axis=1), plain_silhouette(z, apart.argmin(axis=1))
    assert set(got) == {-1, *label.tolist()} and 3 not in got
    for k in set(label.tolist()):
        own = label == k
        assert got[k].customers == own.sum() and got[k].cost == pytest.approx(apart[own, k].sum(), abs=1e-5)
        assert got[k].inertia == pytest.approx(((z[own] - z[own].mean(axis=0)) ** 2).sum(), abs=1e-5)
        assert got[k].mean_silhouette == pytest.approx(sil[own].mean(), abs=1e-5)
    assert got[-1].mean_silhouette == pytest.approx(sil.mean(), abs=1e-5)
    with_gaps = ce.assign_to_centres(ce.standardised(df, ["a", "b", "c"]), centres)
    assert with_gaps.where("cluster is null").count() == 2


def test_silhouette_equals_the_evaluators(spark):
    """The library's evaluator on fitted clusters gives the same mean."""
    feats = engineer_features(planted(spark, 200))
    seg = cl.segment_customers(feats, restarts=1, max_iter=10)
    assigned = seg.assign(feats).withColumn("z", cl.scaled_array()).withColumn("distance", F.lit(0.0))
    sums = ce.cluster_sums(assigned, 21).collect()
    got = ce.silhouettes(assigned, sums).agg(F.avg("silhouette")).first()[0]
    assert got == pytest.approx(cl.silhouette(seg, feats), abs=1e-9)


def test_principal_components_solve_the_covariance(spark):
    """C v = lambda v for both components, and they explain the shares reported."""
    feats = engineer_features(planted(spark, 200))
    seg = cl.segment_customers(feats, restarts=1, max_iter=2)
    z = np.array([r.z for r in seg.assign(feats).select(cl.scaled_array().alias("z")).collect()])
    cov = np.cov(z.T)
    v = seg.pca.pc.toArray()
    total = np.trace(cov)
    for k, share in enumerate(seg.explained_variance):
        assert np.abs(cov @ v[:, k] - share * total * v[:, k]).max() < 1e-8
    assert abs(v[:, 0] @ v[:, 1]) < 1e-10


def test_permutation_importance_copies_no_rows(spark):
    """Equal to permuting by hand; the plan has one row a customer up to the scores."""
    profile = planted(spark, 250)
    trained, feats = md.train_model(profile, "gbt", maxIter=4)
    columns = ["age", "gender", "credit_score"]
    got = {r.feature: r.auc_drop for r in xp.permutation_importance(trained, feats, columns).collect()}
    pdf = feats.toPandas()
    h = [(((k % 2147483647) * 48271 % 2147483647) * 48271 % 2147483647 + 7) % 2147483647 for k in pdf.customer_id]
    order = np.lexsort((pdf.customer_id, h))
    n = len(order)
    donor = np.empty(n, dtype=int)
    shift = n // 2
    donor[order] = order[(np.arange(n) + shift) % n]

    def auc(frame):
        s = md.score(trained, spark.createDataFrame(frame, feats.schema)).select("exited", "churn_probability").toPandas()
        pos, neg = s.churn_probability[s.exited == 1].to_numpy(), s.churn_probability[s.exited == 0].to_numpy()
        return np.mean((pos[:, None] > neg) + 0.5 * (pos[:, None] == neg))

    base = auc(pdf)
    for c in columns:
        changed = pdf.copy()
        changed[c] = pdf[c].to_numpy()[donor]
        assert got[c] == pytest.approx(base - auc(changed), abs=2e-6)
