"""Streams with state, batch by batch, against the same work done in order."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import graph
from quarry.streaming import stateful, streams


def _run(spark, frames, folder, made, mode="append"):
    streams.in_steps(frames, f"{folder}/in")
    with stateful.state_store(spark):
        q = made(streams.event_stream(spark, f"{folder}/in", 1)).writeStream.outputMode(mode)
        q.foreachBatch(lambda b, n: b.withColumn("batch", F.lit(n)).write.mode("append").parquet(f"{folder}/out")).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out")


def test_ring(spark, tmp_path):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "a", "b"]), k, rng.randrange(1000)) for k in range(900)] + [("rare", 901, 7)]
    cuts = [rows[:10], rows[10:500], rows[500:]]
    out = _run(spark, [spark.createDataFrame(c, "op string, seq long, ms int") for c in cuts], tmp_path, stateful.latencies, "update")
    want = set()
    for batch in range(3):
        seen = [r for c in cuts[: batch + 1] for r in c]
        for op in {r[0] for r in cuts[batch]}:
            mine = [ms for o, _, ms in seen if o == op]
            last = sorted(mine[-stateful.RING :])
            want.add((op, len(mine), last[math.ceil(0.5 * len(last)) - 1], last[math.ceil(0.95 * len(last)) - 1], last[-1], batch))
    assert {tuple(r) for r in out.select("op", "n", "p50", "p95", "max", "batch").collect()} == want


def test_chains_across_batches(spark, tmp_path):
    events = spark.range(90).select(F.col("id").alias("seq"), F.col("id").alias("ts"), F.lit("k").alias("kind"), F.lit("w").alias("author"), F.col("id").cast("string").alias("payload"), (F.col("id") % 3).cast("string").alias("c"))
    rows = graph.build_chain(events, "c").cache()
    forged = rows.withColumn("kind", F.when(F.col("seq") == 34, "x").otherwise(F.col("kind")))  # of chain 1, in the second batch
    gap = forged.filter("seq <> 29")  # chain 2 loses the last row of the first batch
    frames = [gap.filter("seq < 30"), gap.filter("seq >= 30 AND seq < 60"), gap.filter("seq >= 60").union(rows.filter("seq = 3"))]  # chain 0 repeats a row
    out = _run(spark, frames, tmp_path, stateful.verified)
    got = {(r.chain, r.batch): (r.checked, r.n_bad, r.first_bad_seq) for r in out.collect()}
    assert got == {
        ("0", 0): (10, 0, None), ("1", 0): (10, 0, None), ("2", 0): (9, 0, None), ("0", 1): (10, 0, None), ("1", 1): (10, 1, 34), ("2", 1): (10, 1, 32),
        ("0", 2): (11, 2, 3), ("1", 2): (10, 0, None), ("2", 2): (10, 0, None),
    }


def _file(items, centroids, least, margin):
    """In order, one by one."""
    state = {k: [n, np.array(t)] for k, (n, t) in centroids.items()}
    out = {}
    for seq, root, v in sorted(items, key=lambda r: r[0]):
        v = None if v is None else np.array(v)
        mine = sorted(node for r, node in state if r == root)
        if v is None or not v.any() or not mine:
            out[seq] = (None, None)
            continue
        near = sorted(((round(float(v @ state[root, m][1] / np.linalg.norm(v) / np.linalg.norm(state[root, m][1])), 9), -m) for m in mine), reverse=True)
        ok = near[0][0] >= least and (len(near) == 1 or round(near[0][0] - near[1][0], 9) >= margin)
        out[seq] = (-near[0][1] if ok else None, near[0][0])
        if ok:
            state[root, -near[0][1]][1] += v / np.linalg.norm(v)
    return out


def test_filing_in_order(spark, tmp_path):
    rng = np.random.default_rng(3)
    centres = {(root, node): rng.normal(size=6) for root in (1, 2) for node in range(4 * root, 4 * root + 4)}
    centroids = {k: (2, (2 * c / np.linalg.norm(c)).tolist()) for k, c in centres.items()}
    items = []
    for seq in range(240):
        k = list(centres)[rng.integers(8)]
        items.append((seq, k[0], (centres[k] * 0.3 + rng.normal(size=6) * 0.4 + seq / 200).tolist()))  # they drift
    items += [(300, 1, None), (301, 1, [0.0] * 6), (302, 9, [1.0] * 6)]
    items[5] = (5, 2, None)
    first = spark.createDataFrame([(*k, *v) for k, v in centroids.items()], "root long, node long, n long, total array<double>")
    frame = spark.createDataFrame(items, "seq long, root long, v array<double>")
    frames = [frame.filter("seq < 100"), frame.filter("seq >= 100 AND seq < 101"), frame.filter("seq > 100")]
    out = _run(spark, frames, tmp_path, lambda s: stateful.filed(s, first, 0.5, 0.05))
    got = {r.seq: (r.node, r.score) for r in out.collect()}
    want = _file(items, centroids, 0.5, 0.05)
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all((got[k][1] is None) == (v[1] is None) and (v[1] is None or got[k][1] == pytest.approx(v[1], abs=1e-8)) for k, v in want.items())
    assert 0 < sum(v[0] is not None for v in want.values()) < len(items)


def test_delta_waits_for_notes(spark, tmp_path):
    day = "timestamp'2026-01-01 00:00:00'"
    events = spark.sql(f"SELECT id AS seq, {day} + make_dt_interval(0, 0, CAST(id AS INT)) AS at, IF(id = 5, 'view', 'note') AS kind, id % 4 AS session, 1 AS turn FROM range(12)")
    far = spark.sql(f"SELECT -1L AS seq, {day} + INTERVAL 60 DAYS AS at, 'note' AS kind, -1L AS session, 1 AS turn")
    notes = spark.sql(f"SELECT id AS target, {day} + make_dt_interval(0, 0, CAST(id AS INT) + IF(id = 7, 61, 59)) AS noted_at, concat('n', id) AS note FROM range(6, 9)")
    late = spark.sql(f"SELECT -1L AS target, {day} + INTERVAL 62 DAYS AS noted_at, '' AS note")
    streams.in_steps([events, far], f"{tmp_path}/events")
    streams.in_steps([notes, late], f"{tmp_path}/notes")
    prompts = spark.createDataFrame([(1, 1, "user", "x" * 10), (2, 1, "assistant", "a")], "session long, turn int, role string, said string")
    pages = spark.createDataFrame([(4, "page four")], "seq long, page string")

    def run(name, **more):
        made = streams.delta(streams.event_stream(spark, f"{tmp_path}/events"), prompts, pages, streams.event_stream(spark, f"{tmp_path}/notes"), body=8, **more)
        streams.run_available(made, f"{tmp_path}/{name}", f"{tmp_path}/{name}-state")
        return {r.seq: (r.role, r.body) for r in spark.read.parquet(f"{tmp_path}/{name}").filter("seq >= 0").collect()}

    got = run("plain")
    assert got == {0: (None, None), 1: ("user", "xxxxxxxx…"), 3: (None, None), 4: ("page", "page fou…"), 7: (None, None), 8: ("note", "n8"), 9: ("user", "xxxxxxxx…"), 11: (None, None)}
    assert set(run("all", agents=True)) == set(got) | {2, 6, 10}
