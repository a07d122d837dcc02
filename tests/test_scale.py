"""Operators that never form all pairs of a group, against those that do."""

import random

import numpy as np

from quarry.operators import curation, simhash
from quarry.plans import vectors
from quarry.plans.maintenance import ranks_of_first, recall_mrr


def _cosine(a, b):
    n = np.linalg.norm(a) * np.linalg.norm(b)
    return round(float(np.dot(a, b) / n), 9) if n else 0.0


def test_first_of_the_class(spark, monkeypatch):
    from quarry.operators import blocks

    monkeypatch.setattr(blocks, "QUERIES", 7)
    monkeypatch.setattr(blocks, "ROWS", 50)
    rng = np.random.default_rng(1)
    rows = [(i, int(rng.integers(4)) if i % 17 else None, (rng.integers(-1, 2, 5) if i % 11 else np.zeros(5)).astype(float).tolist()) for i in range(300)] + [(500, 99, [1.0] * 5)]
    frame = spark.createDataFrame(rows, "vec_id long, label int, v array<float>").filter("label IS NOT NULL")
    got = {r.q: r["rank"] for r in ranks_of_first(frame.filter("vec_id % 5 = 0"), frame).collect()}
    kept = [r for r in rows if r[1] is not None]
    want = {}
    for q, label, v in kept:
        if q % 5 == 0:
            order = sorted((-_cosine(v, w), i, other) for i, other, w in kept if i != q)
            place = next((k for k, x in enumerate(order, 1) if x[2] == label), None)
            if place:
                want[q] = place
    assert got == want and 500 not in got


def test_packs_that_hold_the_class(spark, tmp_path):
    rows = [(0, 1, [1.0, 0.0]), (100, 2, [0.0, 1.0])] + [(k, 3, [1.0, k / 1000]) for k in range(1, 25)] + [(201, 1, [-1.0, 0.1]), (202, 2, [0.1, 1.0])]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    row = recall_mrr(spark, str(tmp_path)).first()
    assert (row.n, row.packed, row.recall20) == (2, 0.5, 0.5)  # one's class is behind 24 others


def test_best_two_centroids(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(i, int(rng.integers(6)), rng.normal(size=4).tolist()) for i in range(120)] + [(200, 9, [1.0, 0.0, 0.0, 0.0])]
    frame = spark.createDataFrame(rows, "id long, node int, v array<double>")
    cents = vectors.centroids(frame).withColumnRenamed("node", "to")
    for own in (False, True):
        want = {}
        for i, node, v in rows:
            near = []
            for to in sorted({r[1] for r in rows}):
                members = [np.array(r[2]) for r in rows if r[1] == to]
                total = sum(members) - (np.array(v) if own and to == node else 0)
                if not (own and to == node and len(members) == 1):
                    near.append((-_cosine(total, v), to))
            near.sort()
            want[i] = (near[0][1], round(-near[0][0], 6), round(near[1][0] - near[0][0], 6))
        for sent in (64 << 20, 64):  # one list, or blocks of two classes
            monkeypatch.setattr(vectors, "SENT", sent)
            got = {r.id: (r.top1, round(r.score, 6), round(r.margin, 6)) for r in vectors._best_two(frame, cents, own).collect()}
            assert got == want


def test_near_fingerprints_of_a_session(spark):
    rng = random.Random(3)
    marks = [rng.getrandbits(63) for _ in range(20)]
    flip = lambda m, n: m ^ sum(1 << b for b in rng.sample(range(63), n))
    said = [(k, rng.randrange(4), flip(rng.choice(marks), rng.randrange(6))) for k in range(300)] + [(900, 0, 0)]
    given = [(rng.randrange(4), flip(rng.choice(marks), rng.randrange(4))) for _ in range(60)] + [(0, 0)]
    near = simhash.near_within(spark.createDataFrame(said, "seq long, session long, simhash long"), spark.createDataFrame(given, "session long, simhash long"), "session", "seq")
    want = {k for k, s, m in said for t, g in given if s == t and m and g and (m ^ g).bit_count() <= simhash.NEAR}
    assert sorted(r.seq for r in near.collect()) == sorted(want) and want


def test_alike_titles(spark):
    rng = random.Random(4)
    some = lambda: sorted(rng.sample("abcdefghijkl", rng.choice([0, 1, 3, 5, 6, 9, 10])))
    mine, theirs = [(k, rng.randrange(3), some()) for k in range(120)], [(k, rng.randrange(3), some()) for k in range(120)]
    got = curation._alike(spark.createDataFrame(mine, "op long, parent long, mine array<string>"), spark.createDataFrame(theirs, "twin long, parent long, theirs array<string>"))
    want = {(a, b) for a, p, x in mine for b, q, y in theirs if p == q and (not x and not y or (x or y) and len(set(x) & set(y)) / len(set(x) | set(y)) >= curation.TWIN)}
    assert {tuple(r) for r in got.collect()} == want
    assert got.count() == len(want)


def test_embeddings_by_words(spark):
    from pyspark.sql import functions as F

    from quarry.functions import vector

    texts = ["red fox red", "", None, "日本 red", "--", " ".join(f"w{k % 700}" for k in range(20_000))]
    got = spark.createDataFrame(list(enumerate(texts)), "id long, t string").select("id", vector.hashed_embedding(F.col("t"), 8).alias("v"), F.expr("transform(filter(split(lower(t), '[^\\\\p{L}\\\\p{N}]+'), w -> w <> ''), w -> pmod(xxhash64(w), 16))").alias("p"))
    for r in got.collect():
        if r.p is None:
            assert r.v is None
            continue
        raw = np.bincount(r.p, minlength=16)[:8] - np.bincount(r.p, minlength=16)[8:]
        assert np.allclose(r.v, raw / max(np.linalg.norm(raw), 1e-300)) and len(r.v) == 8


def test_fingerprints_are_made_once(spark, tmp_path):
    from quarry.plans import vectors as plans

    spark.createDataFrame([(k, f"one two three four {k % 3}", "en", "s", 1) for k in range(9)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    found = plans.simhash_pairs(spark, str(tmp_path))
    assert "ArrowEvalPython" not in found._jdf.queryExecution().executedPlan().toString()
    assert {(r.a, r.b) for r in found.collect() if r.distance == 0} >= {(k, k + n) for k in range(3) for n in (3, 6)}


def test_similar_titles_in_blocks(spark):
    from quarry.operators import relational

    rng = random.Random(7)
    rows = [(i, i % 3 if i % 31 else None, sorted({rng.choice("abcdefgh") for _ in range(rng.randrange(6))})) for i in range(160)]
    frame = spark.createDataFrame(rows, "id long, parent int, s array<string>")
    for least in (0.5, 0.8):
        want = {}
        for i, p, s in rows:
            for j, o, t in rows:
                if i < j and p is not None and p == o:
                    score = len(set(s) & set(t)) / len(set(s) | set(t)) if s or t else 1.0
                    if score >= least:
                        want[i, j] = score
        for block in (4, 1024):
            found = relational.similar_titles(frame, least, block)
            got = [((r.a, r.b), r.jaccard) for r in found.collect()]
            assert len(got) == len(want) and dict(got) == want
            # pairs are kept nowhere to tell them apart
            plan = found._jdf.queryExecution().optimizedPlan().toString()
            assert "Aggregate [a#" not in plan


def test_co_occurrence_in_blocks(spark, monkeypatch):
    from quarry.operators import relational

    rng = random.Random(8)
    rows = [(i % 9 if i % 13 else None, rng.randrange(40) if i % 17 else None) for i in range(300)] + [(99, k) for k in range(40)]
    want = {}
    for s in range(100):
        nodes = sorted({n for t, n in rows if t == s and n is not None})
        for k, a in enumerate(nodes):
            for b in nodes[k + 1 :]:
                want[a, b] = want.get((a, b), 0) + 1
    want = {k: v for k, v in want.items() if v >= 2}
    frame = spark.createDataFrame(rows, "session long, node long")
    for block, each in ((6, 50), (256, 2_000_000)):
        monkeypatch.setattr(relational, "PAIRS", each)
        found = relational.co_occurrence(frame, 2, block=block)
        assert {(r.a, r.b): r.weight for r in found.collect()} == want
        if each == 50:  # tasks grow with the pairs
            assert f", {-(-sum(n * min(n, 6) for n in _sizes(rows)) // 50)}" in found._jdf.queryExecution().optimizedPlan().toString().split("RepartitionByExpression")[1].splitlines()[0]


def _sizes(rows):
    by = {}
    for s, n in rows:
        if s is not None and n is not None:
            by[s] = by.get(s, 0) + 1
    return by.values()


def test_claim_rules_in_one_pass(spark):
    writes = spark.createDataFrame(
        [(1, "s", "p", "x", "v", 5, None, "structured", 9, []), (2, " ", "p", "x", "v", 5, 5, "structured", 9, []), (3, "s", "p", "x", "v", 5, None, "derived", 1, [7, 8]),
         (4, "s", "p", "x", "v", 5, 4, "structured", 9, []), (5, None, "p", "x", "v", 5, 9, "structured", 9, [7])],
        "id long, subject string, predicate string, scope string, value string, valid_from long, valid_until long, derivation string, recorded_at long, supersedes array<long>",
    )
    sources = spark.createDataFrame(
        [(1, 10, "user", "is v", None), (1, 10, "user", "is v", 1), (2, 10, "assistant", "is v", 7), (2, 11, "user", "v", None), (3, 99, "user", "v", None), (3, 99, "user", "v", None), (5, 12, "user", " ", 0), (6, 10, "user", "v", 0)],
        "id long, seq long, role string, quote string, start int",
    )
    evidence = spark.createDataFrame([(10, "status is v.", "user", "n"), (11, "v", "user", "m"), (12, "v", None, "n")], "seq long, body string, role string, namespace string")
    claims = spark.createDataFrame([(7, "s", "p", "x", "n", 5, True)], "id long, subject string, predicate string, scope string, namespace string, recorded_at long, by_user boolean")
    found = curation.claim_violations(writes, sources, evidence, claims)
    got = sorted((r.id, r.violation) for r in found.collect())
    assert got == [
        (1, "unsupported"), (2, "empty"), (2, "interval"), (2, "namespaces"), (2, "role"), (3, "authority"), (3, "order"), (3, "unavailable"), (3, "unknown"),
        (4, "interval"), (4, "uncited"), (5, "empty"), (5, "unsupported"),
    ]
    # the evidence isn't joined again for each rule
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join") <= 4


def test_delta_of_events_in_many_files(spark, tmp_path):
    """More files than a trigger takes by default, in no order of time, still come as one batch: no event is late."""
    from pyspark.sql import functions as F

    from quarry.streaming import streams

    day = F.timestamp_millis((F.col("seq") + 1) * 86_400_000)
    events = spark.range(40).repartition(20, "id").select(F.col("id").alias("seq")).select("seq", day.alias("at"), F.lit("click").alias("kind"), F.col("seq").alias("session"), F.lit(0).alias("turn"))
    events = events.unionAll(events.select((F.col("seq") + 40).alias("seq"), "at", "kind", "session", "turn")).repartition(20, "seq")
    end = events.limit(1).select(F.lit(-1).cast("long").alias("seq"), F.timestamp_millis(F.lit(10**11)).alias("at"), "kind", F.lit(-1).cast("long").alias("session"), "turn")
    notes = events.filter("seq % 2 = 0").select(F.col("seq").alias("target"), F.col("at").alias("noted_at"), F.lit("n").alias("note"))
    last = end.select(F.col("seq").alias("target"), F.col("at").alias("noted_at"), F.lit("").alias("note"))
    n = streams.at_once([events, end], f"{tmp_path}/events")
    m = streams.at_once([notes, last], f"{tmp_path}/notes")
    assert n > 16
    said = spark.createDataFrame([], "session long, turn int, role string, said string")
    seen = spark.createDataFrame([], "seq long, page string")
    made = streams.delta(streams.event_stream(spark, f"{tmp_path}/events", n), said, seen, streams.event_stream(spark, f"{tmp_path}/notes", m))
    streams.run_available(made, f"{tmp_path}/out", f"{tmp_path}/state")
    got = {r.seq: r.body for r in spark.read.parquet(f"{tmp_path}/out").filter("seq >= 0").collect()}
    assert got == {k: "n" if k % 2 == 0 else None for k in range(80)}
