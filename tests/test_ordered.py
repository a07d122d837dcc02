"""Predecessors over ranges, points in intervals: against brute force."""

import random

from pyspark.sql import functions as F

from quarry.operators import graph
from quarry.operators.intervals import stab
from quarry.operators.ordered import with_previous


def test_previous_rows_across_partitions(spark):
    rng = random.Random(1)
    rows = sorted({(rng.choice([None, "a", "a", "a", "b", "c"]), k, rng.choice([None, str(k)])) for k in range(3000)}, key=lambda r: (r[0] is not None, r[0] or "", r[1]))
    frame = spark.createDataFrame(rows, "g string, n long, v string").repartition(7)
    got = with_previous(frame, ["g", "n"], ["g", "v"]).collect()
    assert len({r.n for r in got}) == len(rows)
    before = {(r.g, r.n): r.before and tuple(r.before) for r in got}
    for k, r in enumerate(rows):
        assert before[r[:2]] == (None if k == 0 else (rows[k - 1][0], rows[k - 1][2]))
    assert with_previous(frame.limit(0), ["g", "n"], ["v"]).count() == 0


def test_one_long_chain(spark):
    events = spark.range(4000).select(F.col("id").alias("seq"), F.col("id").alias("ts"), F.lit("k").alias("kind"), F.lit("w").alias("author"), F.col("id").cast("string").alias("payload"), F.lit("c").alias("c"))
    chain = graph.build_chain(events, "c").cache()
    assert graph.verify_chain(chain).first().asDict() | {"head": None} == {"chain": "c", "checked": 4000, "n_bad": 0, "first_bad_seq": None, "head": None, "ok": True}
    forged = chain.withColumn("kind", F.when(F.col("seq").isin(1777, 3000), "x").otherwise(F.col("kind"))).filter("seq <> 2500")
    row = graph.overall(graph.verify_chain(forged)).first()
    assert (row.chains, row.checked, row.n_bad, row.first_bad_seq, row.ok) == (1, 3999, 3, 1777, False)
    headless = graph.verify_chain(chain.filter("seq > 0")).first()
    assert (headless.n_bad, headless.first_bad_seq) == (1, 1)
    anchors = chain.filter("seq = 9").select("chain", F.col("entry_hash").alias("anchor"))
    assert graph.verify_after(chain.filter("seq > 9"), anchors).first().ok and not graph.verify_after(chain.filter("seq > 10"), anchors).first().ok
    assert graph.overall(graph.verify_chain(chain.limit(0))).first().asDict() == {"chains": 0, "checked": 0, "n_bad": 0, "first_bad_chain": None, "first_bad_seq": None, "ok": True}


def test_points_in_intervals(spark):
    rng = random.Random(2)
    some = lambda: rng.choice([None, rng.randrange(-50, 1000), 10 * rng.randrange(100)])
    spans = [(rng.choice("xxxy"), k, some(), some()) for k in range(400)]
    dots = [(rng.choice("xxxyz"), k, some()) for k in range(400)]
    for unit in (1, 10, 37, 5000):
        found = stab(spark.createDataFrame(dots, "s string, p long, at long"), spark.createDataFrame(spans, "s string, i long, start long, stop long"), ["s"], "at", "start", "stop", unit)
        got = sorted((r.p, r.i) for r in found.collect())
        assert got == sorted((p, i) for s, p, t in dots for u, i, a, b in spans if s == u and None not in (t, a) and a <= t and (b is None or t < b))
    none = spark.createDataFrame([], "s string, p long, at long")
    assert stab(none, spark.createDataFrame(spans, "s string, i long, start long, stop long"), ["s"], "at", "start", "stop", 10).count() == 0


def test_stabbing_compares_no_pairs_that_do_not_hold(spark):
    """Short claims of one subject at many times: the join's rows stay near the result's."""
    spans = spark.range(3000).selectExpr("'x' AS s", "id AS i", "id * 100 AS start", "id * 100 + 250 AS stop")
    dots = spark.range(3000).selectExpr("'x' AS s", "id AS p", "id * 100 + 7 AS at")
    found = stab(dots, spans, ["s"], "at", "start", "stop", 100)
    assert found.count() == 3000 + 2999 + 2998
    plan = found._jdf.queryExecution().executedPlan()
    found.collect()
    text = found._jdf.queryExecution().executedPlan().toString() or plan.toString()
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_chains_of_any_text(spark):
    """What a chain is built from is what it is checked against, whatever the texts hold."""
    rows = [(k, k * 10, "a\x1fb\"\\/é🙂" if k % 2 else None, f"u{k % 3}", None if k % 5 == 0 else f"p{k}") for k in range(40)]
    events = spark.createDataFrame(rows, "seq long, ts long, kind string, author string, payload string")
    made = graph.build_chain(events, "author")
    assert [r.ok for r in graph.verify_chain(made).collect()] == [True] * 3
    assert {r.kind for r in made.collect()} == {r[2] for r in rows}
