"""Trigram lists and positional postings against plain search over all texts."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quarry.functions import text as tx
from quarry.operators import ranges, search, trigrams

TEXTS = [
    "alpha beta gamma delta epsilon zeta", "日本語の文章の中に言葉がある。", "", None, "ab", "a", "ABC abc AbC", "x" * 5000 + "needle" + "y" * 5000, "ΟΔΟΣ και οδός", "İstanbul ve ISPARTA",
    "emoji 🙂🙃 here", "line\nbreaks\tand tabs", "100% of_it \\ [x] (y)", "aaaa", "errors: E0277 at src/db.rs:42", "Alpha Beta", "naïve façade", "gamma delta eps",
]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    rng = random.Random(4)
    more = [" ".join(rng.choice(["red", "green", "blue", "Grue", "bleen"]) + str(rng.randrange(30)) for _ in range(rng.randrange(1, 60))) for _ in range(300)]
    rows = list(enumerate(TEXTS + more))
    frame = spark.createDataFrame(rows, "id long, body string").repartition(3)
    made = trigrams.write_trigrams(frame, "id", {"body": F.col("body"), "title": F.concat(F.lit("t"), F.col("id").cast("string"))}, f"{tmp_path_factory.mktemp('grams')}/i")
    return made, dict(rows)


def _keys(frame):
    return sorted(r.key for r in frame.select("key").collect())


@pytest.mark.parametrize("needle", ["needle", "gamma", "ABC", "abc", "aaa", "の文章", "🙂🙃 h", "οδός", "\\ [x]", "of_it", "s\tand", "green7 ", "bleen12", "stanbul", "isparta", "not there"])
def test_needles(index, needle):
    made, rows = index
    holds = lambda t, n: t is not None and n in t
    assert _keys(trigrams.grep(made, needle, case_sensitive=True)) == [k for k, t in rows.items() if holds(t, needle.strip())]
    loose = _keys(trigrams.grep(made, needle))
    assert loose == [k for k, t in rows.items() if t is not None and needle.strip().lower() in t.lower()]


@pytest.mark.parametrize("pattern", [r"E\d+ at src/\w+", r"(red1|bleen2)\d? .*Grue", r"gre{2}n\d", r"(?:alpha) +beta", r"blue(1|2)+x?", r"(gam)+ma", r"^alpha"])
def test_patterns(index, pattern):
    made, rows = index
    assert _keys(trigrams.grep(made, pattern=pattern, case_sensitive=True)) == [k for k, t in rows.items() if t and re.search(pattern, t)]


def test_runs_of_patterns():
    runs = trigrams.literal_runs
    assert runs("abc.*defg") == [["abc", "defg"]] and runs("ab+c") == [] and runs("ab+cd") == [["bcd"]] and runs("gre{2}n") == [["green"]] and runs("gre{2,}n") == [["gree", "een"]] and runs("(foo|barr)baz") == [["foo", "baz"], ["barr", "baz"]]
    assert runs("abc?def") == [["def"]] and runs("(abc)?def") == [["def"]] and runs(r"\bword\b") == [["word"]] and runs("a|bcd") == []
    assert runs("abc[de]ef") == [["abc"]] and runs("(?:xyz){2,}") == [["xyz"]] and runs("[") == [] and runs(r"\p{L}abc") == [] and runs("") == []
    assert runs("|".join(f"way{k:03}" for k in range(99))) == [["way0"]]  # what all have in common
    letters = [chr(c) for c in range(ord("a"), ord("z") + 1)]
    assert runs("|".join(f"{c}way" for c in letters)) == [[f"{c}way"] for c in letters]
    assert runs("|".join(f"{c}way" for c in [*letters, *map(str.upper, letters), *"0123456789éèê"])) == []  # too many ways


def test_refusals(index):
    made, _ = index
    for ask in ({"needle": "ab"}, {"needle": "  a "}, {"pattern": "a.b"}, {}):
        with pytest.raises(ValueError):
            trigrams.grep(made, **ask)


def _scanned(frame):
    """Rows and files that scans of the texts gave."""
    frame.collect()
    out, stack = [], [frame._jdf.queryExecution().executedPlan()]
    while stack:
        node = stack.pop()
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            stack.append(node.executedPlan())
        if "Scan parquet" in node.nodeName() and "body" in node.schema().treeString():
            m = node.metrics()
            out.append((m.apply("numOutputRows").value(), m.apply("numFiles").value()))
        children = node.children()
        stack += [children.apply(k) for k in range(children.size())]
        if node.nodeName().endswith("QueryStage"):
            stack.append(node.plan())
    return out


def test_only_candidates_are_read(index):
    made, rows = index
    (n, files), = _scanned(trigrams.grep(made, "needle"))
    assert files == 1 and n < len(rows) / 4  # one block of sixteen; within it the scan is given the key
    assert _scanned(trigrams.grep(made, "zzqqy")) in ([], [(0, 0)])


def test_probes_of_any_length(spark, index):
    made, rows = index
    rng = random.Random(5)
    probes = ["beta gamma", "ta gamma delta eps", "beta gamma delta epsilon", "に言葉が", "🙃 ", "a", "ab", "の", "", None, "οδός", "ΟΔΟΣ", "ΣΣΣ", "alpha", "Alpha", "aaa", "İst", "red1", "x" * 4000]
    probes += [t[a : a + rng.randrange(1, 30)] for t in rng.sample([t for t in rows.values() if t], 40) for a in [rng.randrange(len(t))]]
    frame = spark.createDataFrame(list(enumerate(probes)), "p long, t string")
    got = sorted((r.p, r.key) for r in trigrams.containing(made, frame, "p", "t", "body").collect())
    assert got == sorted((p, k) for p, probe in enumerate(probes) for k, t in rows.items() if probe and t is not None and probe in t)


def test_phrases(spark, tmp_path):
    rng = random.Random(6)
    rows = [(k, " ".join(rng.choice("red green blue redder x1 of".split()) for _ in range(rng.randrange(12)))) for k in range(300)] + [(900, None), (901, "red"), (902, "the red red green"), (903, "of red of red x1 x1 of blue x1 red of green blue")]
    frame = spark.createDataFrame(rows, "id long, body string")
    cut_at = {"head": F.substring("body", 1, 20), "tail": F.substring("body", 21, 1 << 30)}
    made = search.write_index(frame, "id", cut_at, f"{tmp_path}/i")

    def brute(terms, phrases):
        stages = {}
        for k, t in rows:
            parts = [re.findall(r"\w+", p) for p in ((t or "")[:20], (t or "")[20:])]
            words = [w for p in parts for w in p]
            adjacent = [any(p[i : i + len(q)] == q for p in parts for i in range(len(p))) for q in phrases]
            whole = [w in words for w in terms]
            if all(adjacent + whole):
                stages[k] = 1
            elif any(adjacent + whole) or any(x.startswith(w) for w in terms if len(w) >= tx.PREFIX_FROM for x in words):
                stages[k] = 2
        first = min(stages.values(), default=None)
        return {k for k, s in stages.items() if s == first}

    for terms, phrases in (([], [["red", "green"]]), (["blue"], [["red", "red", "green"]]), (["redd"], []), (["blue", "x1"], [["of", "red"], ["green", "blue"]]), (["nowhere"], [["red", "nowhere"]]), (["nowhere"], []), ([], [["x1", "red", "of"]]), ([], [["of", "red", "x1", "x1"]]), (["redder"], [["blue", "of"]])):
        got = search.planned(made, terms, phrases).collect()
        assert {r.key for r in got} == brute(terms, phrases), (terms, phrases)


def test_tokens_by_ranges(spark, tmp_path, monkeypatch):
    """Tokens and places against plain counting, in small batches and ranges; a word that all rows have fills several ranges."""
    monkeypatch.setattr(ranges, "EACH", 200)
    monkeypatch.setattr(search, "BATCH_TERMS", 100)
    rng = random.Random(7)
    words = ["the", "Émile", "日本", "x1", "--flag", "b", "🙂a", *(f"w{k}" for k in range(300))]
    rows = [(f"k{k}", " ".join(["the", *(rng.choice(words) for _ in range(rng.randrange(30)))]), rng.choice([None, "", "one the one", "b"])) for k in range(400)] + [("none", None, None), ("long", "the " * 500, "")]
    frame = spark.createDataFrame(rows, "id string, body string, title string").repartition(3)
    made = search.write_index(frame, "id", {"title": F.col("title"), "body": F.col("body")}, f"{tmp_path}/i")
    want, total = [], 0
    for r in frame.select("id", *[tx.terms(F.coalesce(c, F.lit(""))).alias(c) for c in ("title", "body")]).collect():
        at = {}
        for k, found in enumerate((r.title, r.body)):
            for i, t in enumerate(found):
                at.setdefault(t, []).append((k << search.COLUMN_BITS) + i)
        total += len(r.title) + len(r.body)
        want += [(t, r.id, len(r.title) + len(r.body), r.title.count(t), r.body.count(t), tuple(p)) for t, p in at.items()]
    got = made.tokens.select("term", "key", "len", "tf_title", "tf_body", "places").withColumn("file", F.input_file_name()).collect()
    assert sorted((*r[:5], tuple(r.places)) for r in got) == sorted(want) and made.n == len(rows) and made.average == total / len(rows)
    files = {}
    for r in got:
        files.setdefault(r.file, []).append((r.term, r.key))
    spans = sorted((min(f), max(f)) for f in files.values())
    assert len(spans) > 5 and all(a[1] < b[0] for a, b in zip(spans, spans[1:])) and all(f == sorted(f) for f in files.values())
    assert sum(a[0] <= "the" <= b[0] for a, b in spans) > 1


def test_lists_of_keys(spark, tmp_path, monkeypatch):
    """A gram's keys stand together, a row for each stretch of a block's texts; ranges by gram don't overlap."""
    monkeypatch.setattr(ranges, "EACH", 500)
    monkeypatch.setattr(trigrams, "BATCH_CHARS", 300)
    rng = random.Random(8)
    rows = [(k, "".join(rng.choice("abcde 日🙂Σς\0") for _ in range(rng.randrange(40)))) for k in range(300)] + [(900, None), (901, "ab"), (902, "aab" * 400)]
    made = trigrams.write_trigrams(spark.createDataFrame(rows, "id long, body string").repartition(3), "id", {"body": F.col("body")}, f"{tmp_path}/i")
    got = made.postings.withColumn("file", F.input_file_name()).collect()
    low = lambda t: (t or "").lower().replace("ς", "σ")
    want = sorted({(low(t)[i : i + 3], k) for k, t in rows for i in range(len(low(t)) - 2)})
    assert sorted((r.gram, k) for r in got for k in r["keys"]) == want and len(got) < len(want)
    files = {}
    for r in got:
        files.setdefault(r.file, []).append((r.gram, r.block))
    spans = sorted((min(f), max(f)) for f in files.values())
    assert len(spans) > 3 and all(a[1] < b[0] for a, b in zip(spans, spans[1:]))


def test_rows_that_share_a_key(spark, tmp_path):
    frame = spark.createDataFrame([(1, "red fox"), (1, "red hen"), (2, "red")], "id long, body string")
    made = search.write_index(frame, "id", {"body": F.col("body")}, f"{tmp_path}/i")
    assert {(r.key, r.term): (r.tf_body, r.places) for r in made.tokens.collect()} == {(1, "red"): (2, [0, 0]), (1, "fox"): (1, [1]), (1, "hen"): (1, [1]), (2, "red"): (1, [0])}
    assert [(r.key, r.stage) for r in search.planned(made, ["red", "fox"], []).collect()] == [(1, 1)]
    assert sorted((r.key, r.stage) for r in search.cascade(made, frame, "id", "body", ["red", "cat"]).collect()) == [(1, 2), (2, 2)]
