"""Frozen probes, nested values and sketches."""

import hashlib
import json
import math

from pyspark.sql import functions as F

from quarry.operators import canary, search, variants


def test_freeze_is_the_least_of_all(spark):
    rows = spark.range(500).select("id", F.concat_ws(" ", *[F.concat(F.lit(f"w{k}x"), (F.col("id") % (k + 2)).cast("string")) for k in range(20)]).alias("t"))
    one = canary.freeze(canary.spans(rows.repartition(5), "a", "id", "t", 3).union(canary.titles(rows, "b", "id", "t", 3)), 9)
    again = canary.freeze(canary.spans(rows.repartition(2), "a", "id", "t", 3).union(canary.titles(rows, "b", "id", "t", 3)), 9)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, again.collect()))
    for subject in "ab":
        want = sorted(range(500), key=lambda k: hashlib.md5(f"3:{subject}:{k}".encode()).hexdigest())[:9]
        assert sorted(r.gold for r in one.filter(F.col("subject") == subject).collect()) == sorted(want)
    texts = {r.id: r.t for r in rows.collect()}
    assert all(r.query in texts[r.gold] and 8 <= len(r.query.split()) <= 12 for r in one.filter("subject = 'a'").collect())
    assert "WindowGroupLimit" in one._jdf.queryExecution().executedPlan().toString()  # parts keep their own least first


def test_evaluation_against_each_search(spark, tmp_path):
    texts = ["red fox runs", "red red fox", "a lazy dog", "the dog and the fox", None, "fox", "blue whale sings"]
    frame = spark.createDataFrame(list(enumerate(texts)), "id long, body string")
    index = search.write_index(frame, "id", {"body": F.col("body")}, f"{tmp_path}/i")
    probes = spark.createDataFrame([("s", 0, "red fox"), ("s", 3, "dog and fox"), ("s", 5, "whale"), ("s", 6, "blue whale"), ("s", 1, "zebra"), ("s", 2, "the")], "subject string, gold long, query string")
    got = {r.gold: r["rank"] for r in canary.evaluate(index, probes, [1.0], 3).collect()}
    for r in probes.collect():
        asked = spark.createDataFrame([(r.query,)], "q string").select(canary.asked(F.col("q"))).first()[0]
        order = [x.key for x in search.bm25(index, asked).withColumn("score", F.round("score", 6)).orderBy(F.desc("score"), "key").collect()]
        place = order.index(r.gold) + 1 if r.gold in order else None
        assert got[r.gold] == (place if place and place <= 3 else None), r
    row = canary.report(canary.evaluate(index, probes, [1.0], 3)).first()
    found = [v for v in got.values() if v]
    assert (row.n, row.hits) == (6, len(found)) and row.mrr == round(sum(1 / v for v in found) / 6, 6)


def _walk(path, v):
    kind = {dict: "object", list: "array", str: "string", bool: "boolean", type(None): "null"}.get(type(v), "number")
    yield path, kind
    for k, w in v.items() if kind == "object" else enumerate(v) if kind == "array" else ():
        yield from _walk(f"{path}.{k}" if kind == "object" else f"{path}[{k}]", w)


def test_json_tree(spark):
    deep = {"leaf": 1}
    for _ in range(12):
        deep = {"in": [deep, None]}
    values = [{"a": [1, 2.5, {"b": None}], "c": {}, "d": []}, [], 7, "x", True, None, deep, {"k": "ü \" q"}]
    rows = [(k, json.dumps(v)) for k, v in enumerate(values)] + [(90, None), (91, "{broken"), (92, "")]
    got = variants.json_tree(spark.createDataFrame(rows, "id long, j string"), "id", "j").collect()
    assert sorted((r.id, r.path, r.kind) for r in got) == sorted((k, *x) for k, v in enumerate(values) for x in _walk("$", v))
    assert {(r.path, r.value) for r in got if r.id == 0 and r.value is not None} == {("$.a[0]", "1"), ("$.a[1]", "2.5")}
    assert [r.value for r in got if r.id == 7 and r.kind == "string"] == ["ü \" q"]


def test_sketches_add_up(spark):
    rows = spark.range(60000).select((F.col("id") % 7).alias("day"), (F.col("id") % 3).alias("g"), (F.col("id") * 31 % 20011).alias("u"))
    parts = variants.sketches(rows, ["g", "day"], ["u"])
    exact = {r.g: r.n for r in rows.groupBy("g").agg(F.countDistinct("u").alias("n")).collect()}
    for r in variants.estimated(parts, ["g"], ["u"]).collect():
        assert abs(r.u - exact[r.g]) <= variants.error_bound() * exact[r.g]
    whole = variants.estimated(variants.sketches(rows, ["g"], ["u"]), ["g"], ["u"])
    assert {(r.g, r.u) for r in whole.collect()} == {(r.g, r.u) for r in variants.estimated(parts, ["g"], ["u"]).collect()} or math.isclose(whole.first().u, 20011, rel_tol=0.03)
