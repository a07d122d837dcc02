"""Claims, proposals and maintenance of the class tree as frames in, frames out."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators import graph, relational
from quarry.operators.lineage import cut

# Kinds of decisions, the general root, the tree's depth, links of a split's part, and the queue's waits and end.
DECISIONS = ("decision", "resolution", "approval", "reopen", "review_verdict", "pin", "source_trust")
GENERAL, MAX_DEPTH, PART_LINKS, TWIN = "~general", 8, 3, 0.8
WAITS, ATTEMPTS, LAKE_DAYS = (1, 2, 4), 3, 7
#: Claims and their sources that a task takes, about.
CLAIMS = 250_000
#: The freshest share of the lake's span, in which nothing is cold.
FRESH = 0.34
#: Subjects whose recall may not fall at all, and what may be lost otherwise.
ZERO_TOLERANCE, LOSS, PROBES = ("decision", "supersession", "note", "claim"), 0.05, 3


def current_claims(claims: DataFrame, valid_at: int, known_at: int, words: list[str] | None = None, limit: int = 50) -> DataFrame:
    """(id, subject, predicate, scope, value, recorded_at, alternatives, found): claims as known then and valid then, without
    those a later claim replaced from its own valid time on; alternatives: the ids with another value of the same subject,
    predicate and scope. With words, claims that hold any, by how many, then the newest."""
    known = claims.filter((F.col("recorded_at") <= known_at) & (F.col("valid_from") <= valid_at) & (F.col("retired_at").isNull() | (F.col("retired_at") > known_at)))
    valid = known.filter(F.col("valid_until").isNull() | (F.col("valid_until") > valid_at))
    gone = known.select(F.explode("supersedes").alias("id")).distinct()
    rows = valid.join(gone, "id", "left_anti")
    about = ["subject", "predicate", "scope"]
    groups = rows.groupBy(*about).agg(F.array_sort(F.collect_list(F.struct("id", "value"))).alias("all"), F.countDistinct("value").alias("values")).filter("values > 1")
    rows = rows.join(groups.select(*about, "all"), about, "left")
    other = F.transform(F.filter("all", lambda c: c["value"] != F.col("value")), lambda c: c["id"])
    rows = rows.withColumn("alternatives", F.coalesce(other, F.array().cast("array<long>")))
    text = F.lower(F.concat_ws(" ", F.col("subject").cast("string"), "predicate", "value"))
    found = sum((text.contains(w).cast("int") for w in words), F.lit(0)) if words else F.lit(0)
    rows = rows.withColumn("found", found)
    if words:
        rows = rows.filter("found > 0")
    rows = rows.orderBy(F.desc("found"), F.desc("recorded_at"), "id").limit(min(max(limit, 1), 200))
    return rows.select("id", *about, "value", "recorded_at", "alternatives", "found")


def claim_violations(writes: DataFrame, sources: DataFrame, evidence: DataFrame, claims: DataFrame) -> DataFrame:
    """(id, violation) of claims to be written: empty fields, an empty interval, no citation, evidence out of reach or of
    another role, a quote that isn't in its evidence or lacks the value, sources of several namespaces, related claims about
    something else or of another namespace, a derived claim over a user's, and a replacement before what it replaces.

    writes: id, subject, predicate, scope, value, valid_from, valid_until, derivation, recorded_at, supersedes.
    sources: id, seq, role, quote, start (null: anywhere). evidence: seq, body, role, namespace. claims: id, subject,
    predicate, scope, namespace, recorded_at, by_user.
    """
    blank = lambda c: F.coalesce(F.trim(F.col(c).cast("string")) == "", F.lit(True))
    names = lambda tests: F.filter(F.array(*[F.when(test, name) for name, test in tests.items()]), lambda v: v.isNotNull())
    n, cites, known = writes.count(), sources.count(), evidence.count()
    dealt = lambda df, rows, key: relational.in_tasks(df, rows, CLAIMS, key)
    # all that a claim breaks is gathered in its own row, so that no rule reads the claims, or joins them to their evidence, again
    mine = dealt(writes.withColumn("own", names({"empty": blank("subject") | blank("value"), "interval": F.col("valid_until") <= F.col("valid_from")})), n + cites, "id")
    cited = dealt(sources, n + cites, "id").join(mine.select("id", "value"), "id")
    found = dealt(evidence.select("seq", "body", "namespace", F.col("role").alias("actual")), cites + known, "seq")
    cited = dealt(cited, cites + known, "seq").join(found, "seq", "left")
    at = F.when(F.col("start").isNull(), F.col("body").contains(F.col("quote"))).otherwise(F.substr("body", (F.col("start") + 1).cast("int"), F.length("quote")) == F.col("quote"))
    unsupported = F.col("body").isNotNull() & ((F.trim("quote") == "") | ~at | ~F.col("quote").contains(F.col("value")))
    tests = {"unavailable": F.col("body").isNull(), "role": F.col("actual") != F.col("role"), "unsupported": unsupported}
    cited = dealt(cited.select("id", "namespace", (F.col("role") == "user").alias("user"), *[test.alias(name) for name, test in tests.items()]), n + cites, "id")
    spaces = cited.groupBy("id").agg(
        (F.min("namespace") < F.max("namespace")).alias("namespaces"), F.min("namespace").alias("namespace"), F.bool_and("user").alias("users"), *[F.bool_or(name).alias(name) for name in tests],
    )
    judged = cut(spaces.withColumn("theirs", names({name: F.col(name) for name in (*tests, "namespaces")})).select("id", "namespace", "users", "theirs"))  # read twice
    uncited = dealt(sources.select("id"), n + cites, "id").distinct().withColumn("cited", F.lit(True))
    rows = mine.join(uncited, "id", "left").join(judged, "id", "left")
    rows = rows.withColumn("broken", F.concat("own", names({"uncited": F.col("cited").isNull()}), F.coalesce("theirs", F.array().cast("array<string>"))))
    out = rows.select("id", F.explode("broken").alias("violation"))
    old = claims.select(F.col("id").alias("old"), *[F.col(c).alias(f"old_{c}") for c in ("subject", "predicate", "scope", "namespace", "recorded_at", "by_user")])
    related = writes.withColumn("old", F.explode("supersedes")).join(old, "old", "left").join(judged.select("id", "namespace", "users"), "id", "left")
    same = (F.col("old_subject") == F.col("subject")) & (F.col("old_predicate") == F.col("predicate")) & (F.col("old_scope") == F.col("scope"))
    broken = names({
        "unknown": F.col("old_subject").isNull(), "unrelated": ~same, "namespace": F.col("old_namespace") != F.col("namespace"),
        "authority": F.col("old_by_user") & ((F.col("derivation") != "structured") | ~F.coalesce("users", F.lit(False))), "order": F.col("recorded_at") < F.col("old_recorded_at"),
    })
    out = out.union(related.select("id", F.explode(broken).alias("violation")))
    return dealt(out, n + cites, "id").distinct()


def claim_projection(events: DataFrame, forgotten: DataFrame) -> DataFrame:
    """(id, value, recorded_at, retired_at) rebuilt from the log (seq, ts, kind: claim or claim_retired, id, value, source): the
    first retirement counts, and claims of forgotten sources (source) are gone."""
    made = events.filter("kind = 'claim'").join(forgotten, "source", "left_anti").select("id", "value", F.col("ts").alias("recorded_at"))
    ended = events.filter("kind = 'claim_retired'").select("id", F.col("ts").alias("t"))
    ends = made.join(ended, "id").filter("t >= recorded_at").groupBy("id").agg(F.min("t").alias("retired_at"))
    return made.join(ends, "id", "left")


def adjudicate_files(ops: DataFrame, roots: DataFrame, events: DataFrame, projects: DataFrame) -> DataFrame:
    """(op, verdict) of filings (op, parent, target_kind, seq): refused without a parent, without the event or for one of another
    kind, and by provenance, where the item's project has another root than the parent. roots: node, root."""
    rows = ops.join(roots.withColumnRenamed("node", "parent"), "parent", "left").join(events.select("seq", "kind"), "seq", "left").join(projects, "seq", "left")
    fits = F.when(F.col("target_kind") == "decision", F.col("kind").isin(*DECISIONS)).otherwise(F.col("kind") == F.col("target_kind"))
    own = F.concat(F.lit("root-"), F.substring(F.sha2("project", 256), 1, 12))
    verdict = F.when(F.col("root").isNull(), "no parent").when(F.col("seq").isNull(), "needs a seq").when(F.col("kind").isNull(), "no target").when(~fits, "other kind")
    verdict = verdict.when((F.col("root") == GENERAL) | F.col("project").isNull() | (own == F.col("root")), "apply").otherwise("provenance")
    return rows.select("op", verdict.alias("verdict"))


def adjudicate_creates(ops: DataFrame, nodes: DataFrame) -> DataFrame:
    """(op, verdict, twins) of new titles (op, parent, title): where a sibling's title has nearly the same words, it is used instead,
    and several such siblings are to be merged."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda x: x != ""))
    mine = ops.select("op", "parent", words("title").alias("mine"))
    theirs = nodes.filter("parent IS NOT NULL").select("parent", F.col("id").alias("twin"), words("title").alias("theirs"))
    near = _alike(mine, theirs)
    twins = near.groupBy("op").agg(F.array_sort(F.collect_list("twin")).alias("twins"))
    rows = ops.join(twins, "op", "left").join(nodes.select(F.col("id").alias("parent"), F.lit(True).alias("there")), "parent", "left")
    n = F.coalesce(F.size("twins"), F.lit(0))
    verdict = F.when(F.col("there").isNull(), "no parent").when(F.col("twins").isNull(), "apply").when(n == 1, "redirect").otherwise("merge")
    return rows.select("op", verdict.alias("verdict"), F.coalesce("twins", F.array().cast("array<string>")).alias("twins"))


def _alike(mine: DataFrame, theirs: DataFrame) -> DataFrame:
    """(op, twin) of word sets (op, parent, mine) and (twin, parent, theirs) under one parent with a Jaccard similarity of TWIN.

    Sets that alike share one of each one's rarest words, as many as may be missed and one more, so only these are joined:
    a parent's titles are never all compared. Sets without words equal each other.
    """
    every = mine.select("parent", F.explode("mine").alias("word")).union(theirs.select("parent", F.explode("theirs").alias("word")))
    often = every.groupBy("parent", "word").agg(F.count("*").alias("n"))

    def rarest(sets: DataFrame, key: str, s: str) -> DataFrame:
        words = sets.select(key, "parent", F.explode(s).alias("word"), F.size(s).alias("size")).join(often, ["parent", "word"])
        by = words.groupBy(key, "parent", "size").agg(F.array_sort(F.collect_list(F.struct("n", "word"))).alias("w"))  # one title's words
        few = F.slice("w", 1, (F.col("size") - F.ceil(F.lit(TWIN) * F.col("size")) + 1).cast("int"))
        return by.select(key, "parent", F.explode(F.transform(few, lambda x: x["word"])).alias("word"))

    met = rarest(mine, "op", "mine").join(rarest(theirs, "twin", "theirs"), ["parent", "word"]).select("op", "twin").distinct()
    both = met.join(mine.select("op", "mine"), "op").join(theirs.select("twin", "theirs"), "twin")
    near = both.filter(F.size(F.array_intersect("mine", "theirs")) / F.size(F.array_union("mine", "theirs")) >= TWIN).select("op", "twin")
    bare = mine.filter(F.size("mine") == 0).join(theirs.filter(F.size("theirs") == 0), "parent").select("op", "twin")
    return near.union(bare)


def adjudicate_moves(ops: DataFrame, nodes: DataFrame, closure: DataFrame, most: int = MAX_DEPTH) -> DataFrame:
    """(op, verdict) of moves (op, node, new_parent): refused for nodes that aren't there, for a cycle, and beyond the depth."""
    depth = closure.groupBy("id").agg(F.max("up").alias("depth"))
    height = closure.groupBy("ancestor").agg(F.max("up").alias("height"))
    there = nodes.select("id")
    rows = ops.join(there.select(F.col("id").alias("node"), F.lit(True).alias("has_node")), "node", "left").join(there.select(F.col("id").alias("new_parent"), F.lit(True).alias("has_parent")), "new_parent", "left")
    rows = rows.join(depth.select(F.col("id").alias("new_parent"), "depth"), "new_parent", "left").join(height.withColumnRenamed("ancestor", "node"), "node", "left")
    under = closure.select(F.col("id").alias("new_parent"), F.col("ancestor").alias("node"), F.lit(True).alias("inside"))
    rows = rows.join(under, ["node", "new_parent"], "left")
    verdict = F.when(F.col("has_node").isNull(), "no node").when(F.col("new_parent").isNull(), "apply").when(F.col("has_parent").isNull(), "no parent")
    verdict = verdict.when(F.col("inside"), "cycle").when(F.col("depth") + 1 + F.col("height") > most, "depth").otherwise("apply")
    return rows.select("op", verdict.alias("verdict"))


def apply_ops(nodes: DataFrame, links: DataFrame, ops: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The tree and its links after operations of one run (op: promote, merge, split or collapse; node, to, part): promoted nodes
    get the parent `to`; merged ones pass children and links to `to` and are retired; a split's links (part, by link id) go to
    `to`; collapsed nodes are retired. Retired rows stay, marked with the run."""
    run = ops.select("run").limit(1)
    moved = ops.filter("op = 'promote'").groupBy(F.col("node").alias("id")).agg(F.min("to").alias("to"))
    merged = ops.filter("op = 'merge'").groupBy("node").agg(F.min("to").alias("into"))
    ended = ops.filter("op IN ('merge', 'collapse')").select(F.col("node").alias("id"), F.lit(True).alias("ended")).distinct()
    out = nodes.join(moved, "id", "left").withColumn("parent", F.coalesce("to", "parent")).drop("to")
    out = out.join(merged.withColumnRenamed("node", "parent"), "parent", "left").withColumn("parent", F.coalesce("into", "parent")).drop("into")
    out = out.join(ended, "id", "left").crossJoin(F.broadcast(run))  # one row
    out = out.withColumn("retired_by", F.when(F.col("ended"), F.col("run"))).drop("ended", "run")
    split = ops.filter("op = 'split'").select(F.col("part").alias("id"), F.col("to").alias("part_of"))
    kept = links.join(merged, "node", "left").withColumn("node", F.coalesce("into", "node")).drop("into")
    kept = kept.join(split, "id", "left").withColumn("node", F.coalesce("part_of", "node")).drop("part_of")
    return out, kept


def revertible(journal: DataFrame) -> DataFrame:
    """(run, ok) of runs in a journal (run, op, subject, reverted): a run can be taken back unless a later one that stands touched
    the same subjects."""
    stands = journal.filter("NOT reverted").select("run", "subject").distinct()
    last = stands.groupBy("subject").agg(F.max("run").alias("last"))
    return stands.join(last, "subject").groupBy("run").agg(F.bool_and(F.col("last") == F.col("run")).alias("ok"))


def revert(rows: DataFrame, journal: DataFrame, run: int) -> DataFrame:
    """rows (subject, value) with the values from before a run: its operations' first ones, newest undone first."""
    first = journal.filter(F.col("run") == run).groupBy("subject").agg(F.min_by("before", "op").alias("before"), F.lit(True).alias("touched"))
    out = rows.join(first, "subject", "left")
    return out.filter("touched IS NULL OR before IS NOT NULL").select("subject", F.when(F.col("touched"), F.col("before")).otherwise(F.col("value")).alias("value"))


def forget(frames: dict[str, DataFrame], sources: DataFrame) -> dict[str, DataFrame]:
    """All frames (with a column source) without what comes from the forgotten sources."""
    return {name: df.join(sources, "source", "left_anti") for name, df in frames.items()}


def queue_state(queue: DataFrame, runs: int, newest: int, day: int) -> DataFrame:
    """(id, state) of proposals (id, attempts, failed_run, created): expired after ATTEMPTS or LAKE_DAYS, waiting while fewer runs than
    their turn's wait have gone by, else due."""
    wait = F.element_at(F.array(*map(F.lit, WAITS)), F.least(F.greatest("attempts", F.lit(1)), F.lit(len(WAITS))).cast("int"))
    expired = (F.col("attempts") >= ATTEMPTS) | (newest > F.col("created") + LAKE_DAYS * day)
    waiting = (F.col("attempts") > 0) & (runs - F.col("failed_run") < wait)
    return queue.select("id", F.when(expired, "expired").when(waiting, "waiting").otherwise("due").alias("state"))


def stamped(rows: DataFrame, events: DataFrame, aliases: DataFrame) -> DataFrame:
    """rows (seq, principal) with the principal of their event's author where they have none."""
    author = events.join(aliases, "author", "left").select("seq", F.coalesce("alias", "author").alias("by"))
    return rows.join(author, "seq", "left").withColumn("principal", F.coalesce("principal", "by")).drop("by")


def branch_states(nodes: DataFrame, closure: DataFrame, direct: DataFrame, protected: DataFrame, recalled: DataFrame, low: int, high: int) -> DataFrame:
    """(node, n, last_ts, protected, warm, collapsible) of every branch: links and their newest over the subtree, whether it or
    anything below is protected (id), whether its newest recall (id, at) is in the freshest share of the lake, and whether it may
    be collapsed without asking: neither, and its newest link is old enough."""
    span = max(high - low, 0)
    up = closure.select("id", "ancestor")
    rows = up.join(direct, "id", "left").join(protected.select("id", F.lit(True).alias("safe")).distinct(), "id", "left").join(recalled, "id", "left")
    by = rows.groupBy(F.col("ancestor").alias("node")).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.max("last_ts").alias("last_ts"), F.coalesce(F.max("safe"), F.lit(False)).alias("protected"), F.max("at").alias("at"),
    )
    warm = F.coalesce((high - F.col("at")) <= FRESH * span if span else F.col("at") >= high, F.lit(False))
    cold = F.coalesce(F.greatest(high - F.col("last_ts"), F.lit(0)) >= FRESH * span, F.lit(False)) & F.lit(span > 0)
    return by.withColumn("warm", warm).select("node", "n", "last_ts", "protected", "warm", (cold & ~F.col("protected") & ~F.col("warm")).alias("collapsible"))


def canary(before: DataFrame, after: DataFrame) -> DataFrame:
    """(subject, n, before, after, regressed) of probes (probe, subject, hit) in two states; subject null is all of them. A subject of
    zero tolerance may not fall; all together may lose LOSS, or PROBES probes if that is more."""
    both = before.select("probe", "subject", F.col("hit").alias("was")).join(after.select("probe", F.col("hit").alias("is")), "probe")
    share = lambda c: F.avg(F.col(c).cast("double"))
    by = both.rollup("subject").agg(F.count("*").alias("n"), share("was").alias("before"), share("is").alias("after"))
    may = F.greatest(F.lit(LOSS), PROBES / F.col("n"))
    fell = F.when(F.col("subject").isNull(), F.col("before") - F.col("after") > may).when(F.col("subject").isin(*ZERO_TOLERANCE), F.col("after") < F.col("before")).otherwise(False)
    return by.withColumn("regressed", fell)


def session_tree(sessions: DataFrame) -> DataFrame:
    """(id, parent, root, n_children) of sessions (id, parent)."""
    spark = sessions.sparkSession
    up = graph.closure(spark, sessions)
    top = up.groupBy("id").agg(F.max_by("ancestor", "up").alias("root"))
    kids = sessions.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("n_children"))
    return sessions.join(top, "id").join(kids, "id", "left").select("id", "parent", "root", F.coalesce("n_children", F.lit(0)).alias("n_children"))


def ranked_first(rows: DataFrame, by: list[str], order: list) -> DataFrame:
    """The first row of each group."""
    return rows.withColumn("_place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter("_place = 1").drop("_place")
