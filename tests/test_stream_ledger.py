"""Charging a stream: batches against one ledger, replay, refusal, odd batches."""

import random

import pytest

from veilframe.operators import budget as B
from veilframe.streaming import ledger as SL

ENTRIES = "dataset string, ord bigint, column string, operation string, epsilon double"
TOTALS = "dataset string, total_epsilon double"


def requests(seed, n):
    rng = random.Random(seed)
    return [("hot" if i % 3 == 0 else f"d{rng.randint(0, 2)}", i, f"c{i % 4}", "laplace", rng.randint(1, 400) / 1000)
            for i in range(n)]


def plainly(rows, totals):
    used, out = {}, []
    for dataset, order, _, _, epsilon in rows:
        cost, total = round(epsilon * 1000), round(totals.get(dataset, 0) * 1000)
        fits = used.get(dataset, 0) + cost <= total
        used[dataset] = used.get(dataset, 0) + cost * fits
        out.append((dataset, order, fits, used[dataset]))
    return sorted(out)


def taken(spark, path):
    return sorted((r["dataset"], r["ord"], r["admitted"], round(r["used_after"] * 1000)) for r in SL.decisions(spark, path).collect())


LIMITS = {"hot": 5.0, "d0": 1.0, "d1": 30.0}  # d2 has no total and may spend nothing


def test_batches_are_charged_in_turn_and_replay_charges_once(spark, tmp_path):
    rows, path = requests(1, 150), str(tmp_path / "ledger")
    totals = spark.createDataFrame(list(LIMITS.items()), TOTALS)
    SL.prepare(spark, path)
    cut = [0, 40, 41, 150]
    batches = [spark.createDataFrame(rows[a:b], ENTRIES) for a, b in zip(cut, cut[1:])]
    for number, batch in enumerate(batches):
        SL.charge_batch(batch, number, totals, path, B.folded_ledger)
        SL.charge_batch(batch, number, totals, path, B.folded_ledger)  # the same batch once more
    want = plainly(rows, LIMITS)
    assert taken(spark, path) == want
    assert any(not fits for _, _, fits, _ in want) and any(fits for _, _, fits, _ in want)
    report = {r["dataset"]: r for r in SL.stream_report(spark, path, totals).collect()}
    for d, total in LIMITS.items():
        mine = [w for w in want if w[0] == d]
        assert round(report[d]["used_epsilon"] * 1000) == mine[-1][3] <= total * 1000
        assert (report[d]["admitted"], report[d]["skipped"]) == (sum(w[2] for w in mine), sum(not w[2] for w in mine))
    by_column = SL.spent_by_column(spark, path).collect()
    assert sum(r["admitted"] for r in by_column) == sum(w[2] for w in want)
    # a batch that failed between its decisions and its snapshot is replayed from the snapshot before it
    assert taken(spark, path) == want
    raised = spark.createDataFrame([("d2", 10.0)], TOTALS)
    SL.charge_batch(spark.createDataFrame([("d2", 999, "c", "laplace", 0.5)], ENTRIES), 3, raised, path, B.folded_ledger)
    assert [(r["admitted"], r["used_after"]) for r in SL.decisions(spark, path).where("ord = 999").collect()] == [(True, 0.5)]


def test_the_stream_goes_on_after_a_stop(spark, tmp_path):
    rows = requests(2, 60)
    totals = spark.createDataFrame(list(LIMITS.items()), TOTALS)
    source, path, checkpoint = (str(tmp_path / n) for n in ("source", "ledger", "checkpoint"))
    for part in (rows[:25], rows[25:], []):
        if part:
            spark.createDataFrame(part, ENTRIES).write.mode("append").parquet(source)
        stream = spark.readStream.schema(ENTRIES).parquet(source)
        SL.ledger_stream(stream, totals, path, checkpoint, True, B.folded_ledger).awaitTermination()
    assert taken(spark, path) == plainly(rows, LIMITS)


def test_empty_batches_and_bad_requests(spark, tmp_path):
    path = str(tmp_path / "ledger")
    totals = spark.createDataFrame(list(LIMITS.items()), TOTALS)
    SL.prepare(spark, path)
    SL.charge_batch(spark.createDataFrame([], ENTRIES), 0, totals, path)
    assert {r["used_epsilon"] for r in SL.stream_report(spark, path, totals).collect()} == {0.0}
    with pytest.raises(Exception, match="epsilon must be above zero"):
        SL.charge_batch(spark.createDataFrame([("hot", 1, "c", "laplace", 0.0)], ENTRIES), 1, totals, path, B.folded_ledger)
    assert SL.spent_by_column(spark, path).count() == 0
    assert B.ledger(spark.createDataFrame([], ENTRIES), totals).count() == 0
