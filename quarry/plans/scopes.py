"""Scopes, facets, evidence and annotations."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.functions import text as tx
from quarry.operators import relational as op
from quarry.registry import query
from quarry.sources import lake
from quarry.sources.lake import sql

# How machine-made prompts begin.
MACHINE = ("<task-notification>", "<system-reminder>")
DAY0 = 1_704_067_200_000
_NOTED = "+first AS (SELECT session, role, surface, project, thread FROM asked WHERE turn = 0), marks AS (SELECT target, min(id) AS note, bool_or(starred) AS starred FROM notes WHERE target IS NOT NULL GROUP BY target), wide AS (SELECT l.*, f.role, f.surface, f.project, f.thread, m.note, m.starred, l.session % 4 AS tab FROM ledger l LEFT JOIN first f USING (session) LEFT JOIN marks m ON m.target = l.seq) "


def wide_ledger(spark, d):
    """The ledger with the columns its timeline can filter by."""
    first = lake.asked(spark, d).filter("turn = 0").select("session", "role", "surface", "project", "thread")
    marks = lake.notes(spark, d).filter("target IS NOT NULL").groupBy(F.col("target").alias("seq")).agg(F.min("id").alias("note"), F.bool_or("starred").alias("starred"))
    rows = lake.ledger(spark, d).join(first, "session", "left").join(marks, "seq", "left")
    return rows.withColumn("tab", F.col("session") % 4)


@query(sql("asked", "SELECT seq, CASE WHEN starts_with(ltrim(b), '<task-notification>') OR starts_with(ltrim(b), '<system-reminder>') THEN 'system' ELSE 'user' END AS role FROM (SELECT seq, CASE WHEN role = 'system' THEN '  <system-reminder>' || body WHEN turn % 5 = 2 THEN '<task-notification>' || body ELSE body END AS b FROM asked)"))
def role_classifier(spark, d):
    marked = F.when(F.col("role") == "system", F.concat(F.lit("  <system-reminder>"), "body")).when(F.col("turn") % 5 == 2, F.concat(F.lit("<task-notification>"), "body")).otherwise(F.col("body"))
    return lake.asked(spark, d).select("seq", tx.role_of(marked).alias("role"))


@query(sql("ledger asked notes links", _NOTED + "SELECT seq, kind, author, note FROM wide WHERE kind IN ('click', 'view', 'error') AND author IN ('1', '2', '3', '5', '8', '13') AND surface IN ('cli') AND (role IS NULL OR role = 'user') AND coalesce(starred, false) = false AND note IS NOT NULL AND ts >= 1704067200000 AND ts <= 1706659200000 AND seq < 9000 AND seq IN (SELECT id FROM links) AND contains(lower(payload), '\"k\"') ORDER BY seq DESC LIMIT 500"))
def timeline_all_filters(spark, d):
    node = lake.links(spark, d).select(F.col("id").alias("seq"))
    page = op.timeline(
        wide_ledger(spark, d), limit=900, kinds=["click", "view", "error"], authors=["1", "2", "3", "5", "8", "13"], surface="cli", role="user", starred=False,
        noted=True, after=DAY0, until=1_706_659_200_000, before_seq=9000, text='"K"', node=node,
    )
    return page.select("seq", "kind", "author", "note")


@query(sql("ledger asked notes", _NOTED + "SELECT seq, session, thread, tab FROM wide WHERE session = 7 AND project = 'p1' AND thread = 't7' AND tab = 3 AND seq IN (SELECT seq FROM wide WHERE seq % 3 = 0 AND seq < 3000) ORDER BY seq DESC LIMIT 100"))
def timeline_of_thread(spark, d):
    page = op.timeline(wide_ledger(spark, d), session=7, project="p1", thread="t7", tab=3, seqs=list(range(0, 3000, 3)))
    return page.select("seq", "session", "thread", "tab")


@query(sql("asked", "SELECT seq, role, model FROM asked WHERE role IN ('assistant', 'user') AND mission = 'm2' AND surface = 'web' AND thread_kind = 'review' AND thread = 't7' AND parent = 4 AND project = 'p1' AND session = 7 AND seq > 100 AND contains(lower(body), 'e') ORDER BY seq LIMIT 200"))
def facets_all(spark, d):
    rows = op.facet_filter(
        lake.asked(spark, d), roles=["assistant", "user"], since_seq=100, text="E", mission="m2", surface="web", thread_kind="review", thread="t7", parent=4,
        project="p1", session=7,
    )
    return rows.select("seq", "role", "model")


@query(sql("asked", "SELECT seq, role, model FROM asked WHERE role = 'assistant' AND model = 'model-1' ORDER BY seq LIMIT 200"))
def facets_by_model(spark, d):
    return op.facet_filter(lake.asked(spark, d), roles=["assistant"], model="model-1").select("seq", "role", "model")


@query(sql("ledger notes turns", "+marks AS (SELECT target, min_by(text, id) AS text FROM notes WHERE target IS NOT NULL GROUP BY target), b AS (SELECT l.seq, coalesce(t.body, m.text) AS body FROM ledger l LEFT JOIN turns t ON t.session = l.session AND t.turn = 3 LEFT JOIN marks m ON m.target = l.seq) SELECT seq, CASE WHEN length(body) > 240 THEN substr(body, 1, 240) || '…' ELSE body END AS preview, length(body) AS chars FROM b"))
def preview_notes(spark, d):
    marks = lake.notes(spark, d).filter("target IS NOT NULL").groupBy(F.col("target").alias("seq")).agg(F.min_by("text", "id").alias("note"))
    said = lake.turns(spark, d).filter("turn = 3").select("session", "body")
    body = F.coalesce("body", "note")
    return lake.ledger(spark, d).join(said, "session", "left").join(marks, "seq", "left").select("seq", op.clip(body, 240).alias("preview"), F.length(body).alias("chars"))


_CLOSE = "+kin AS (SELECT id FROM nodes WHERE id = 'r:1' OR parent = 'r:1' OR parent IN (SELECT id FROM nodes WHERE parent = 'r:1')) "


@query(sql("nodes asked", _CLOSE + "SELECT seq, principal, role FROM asked WHERE (principal IN (SELECT id FROM kin) OR device IN (SELECT id FROM kin) OR agent IN (SELECT id FROM kin)) AND org = 'o1' AND role IN ('user', 'assistant') AND ts >= 1704067200000 AND ts < 1714067200000"))
def scope_predicate(spark, d):
    kin = op.principal_closure(lake.nodes(spark, d).select("id", "parent"), "r:1")
    rows = op.scoped(lake.asked(spark, d), principals=kin, org="o1", roles=["user", "assistant"], after=DAY0, before=1_714_067_200_000)
    return rows.select("seq", "principal", "role")


@query(sql("nodes asked", "+proj AS (SELECT 'c:' || c.id % 6 AS id, 'p' || c.id % 6 AS project FROM range(6) c(id)), mine AS (SELECT p.project FROM proj p JOIN nodes n ON n.id = p.id JOIN nodes m ON m.id = n.parent WHERE n.parent = 'n:2' OR m.parent = 'r:1') SELECT seq, project FROM asked WHERE project IN (SELECT project FROM mine)"))
def scope_by_ancestor(spark, d):
    from quarry.operators import graph

    # a project belongs to a node; a scope on any ancestor takes it in
    owner = spark.range(6).select(F.concat(F.lit("c:"), F.col("id").cast("string")).alias("node"), F.concat(F.lit("p"), F.col("id").cast("string")).alias("project"))
    up = graph.closure(spark, lake.nodes(spark, d)).filter(F.col("ancestor").isin("n:2", "r:1")).select(F.col("id").alias("node")).distinct()
    return op.scoped(lake.asked(spark, d), nodes_of=owner.join(up, "node").select("project")).select("seq", "project")


@query(sql("ledger asked pagev notes sup", "SELECT seq, kind FROM ledger WHERE session IN (SELECT session FROM asked WHERE org = 'o1' AND turn = 0) OR seq IN (SELECT id * 4 FROM pagev WHERE contains(url, 'blog')) OR seq IN (SELECT target FROM notes WHERE starred) OR seq IN (SELECT new_seq FROM sup WHERE old_seq % 10 = 3)"))
def ledger_visible(spark, d):
    events = lake.ledger(spark, d)
    prompts = events.join(lake.asked(spark, d).filter("org = 'o1' AND turn = 0").select("session"), "session", "left_semi").select("seq")
    pages = lake.pages(spark, d).filter(F.col("url").contains("blog")).select((F.col("id") * 4).alias("seq"))
    notes = lake.notes(spark, d).filter("starred AND target IS NOT NULL").select(F.col("target").alias("seq"))
    sources = lake.supersessions(spark, d).filter("old_seq % 10 = 3").select(F.col("new_seq").alias("seq"))
    return op.visible_events(events, prompts, pages, notes, sources).select("seq", "kind")


@query(sql("ledger asked", "SELECT r.chain, r.seq, CASE WHEN r.chain <> 'local' AND r.chain NOT IN ('d0', 'd1', 'd2', 'd3') THEN 'unavailable' WHEN a.seq IS NULL THEN 'unavailable' WHEN a.turn = 4 THEN 'redacted' ELSE 'available' END AS status FROM (SELECT CASE WHEN seq % 2 = 0 THEN 'local' ELSE 'd' || session % 9 END AS chain, seq * 1000 + session % 7 AS seq FROM ledger) r LEFT JOIN asked a ON a.seq = r.seq AND (r.chain = 'local' OR r.chain = a.device)"))
def evidence_status(spark, d):
    """Citations (chain, seq) against what is there: another chain's are found only where it is shared, forgotten ones are redacted."""
    cited = lake.ledger(spark, d).select(F.when(F.col("seq") % 2 == 0, "local").otherwise(F.concat(F.lit("d"), (F.col("session") % 9).cast("string"))).alias("chain"), (F.col("seq") * 1000 + F.col("session") % 7).alias("seq"))
    here = lake.asked(spark, d).select("seq", "device", (F.col("turn") == 4).alias("forgotten"))
    rows = here.select("seq", F.lit("local").alias("chain"), "forgotten").union(here.select("seq", F.col("device").alias("chain"), "forgotten"))
    found = cited.join(rows, ["chain", "seq"], "left")
    shared = F.col("chain").isin("local", "d0", "d1", "d2", "d3")
    status = F.when(~shared | F.col("forgotten").isNull(), "unavailable").when(F.col("forgotten"), "redacted").otherwise("available")
    return found.select("chain", "seq", status.alias("status"))


@query(sql("ledger notes", "SELECT l.seq, n.id AS note FROM ledger l LEFT JOIN notes n ON n.id = l.seq OR n.target = l.seq"))
def notes_by_id_or_target(spark, d):
    n = lake.notes(spark, d).select("id", "target")
    return op.or_left_join(lake.ledger(spark, d).select("seq"), n, "seq", "id", "target").select("seq", F.col("id").alias("note"))


@query(sql("indexed links", "SELECT l.id, l.node, i.kind, i.chunk FROM links l JOIN indexed i ON i.kind = CASE WHEN l.id % 2 = 0 THEN 'prompt' ELSE 'browse_event' END AND i.target = CASE WHEN l.id % 2 = 0 THEN l.id ELSE l.id + 1 END"))
def typed_vectors(spark, d):
    """Links to their vectors: prompts by their own number, page visits by that of their record. One equi-join for each kind."""
    links, vectors = lake.links(spark, d).select("id", "node"), lake.indexed(spark, d).select("kind", "target", "chunk")
    own = links.filter("id % 2 = 0").join(vectors.filter("kind = 'prompt'"), F.col("target") == F.col("id"))
    page = links.filter("id % 2 <> 0").join(vectors.filter("kind = 'browse_event'"), F.col("target") == F.col("id") + 1)
    return own.union(page).select("id", "node", "kind", "chunk")


@query(sql("prompts ledger", "+evidence AS (SELECT o_orderkey AS decision, o_custkey AS source, CASE WHEN o_orderkey % 3 = 0 THEN sha256('other') ELSE sha256(d.text) END AS payload_hash FROM orders JOIN documents d ON d.doc_id = o_custkey) SELECT e.decision, e.source, l.kind FROM evidence e JOIN ledger l ON l.seq = e.decision JOIN prompts p ON p.id = e.source AND p.body_hash = e.payload_hash"))
def decision_sources(spark, d):
    docs = lake.prompts(spark, d).select(F.col("id").alias("source"), "body_hash")
    evidence = lake.table(spark, d, "orders").select(F.col("o_orderkey").alias("decision"), F.col("o_custkey").alias("source")).join(docs.withColumnRenamed("body_hash", "h"), "source")
    evidence = evidence.select("decision", "source", F.when(F.col("decision") % 3 == 0, F.sha2(F.lit("other"), 256)).otherwise(F.col("h")).alias("payload_hash"))
    events = lake.ledger(spark, d).select(F.col("seq").alias("decision"), "kind")
    return evidence.join(events, "decision").join(docs, "source").filter("payload_hash = body_hash").select("decision", "source", "kind")


@query(sql("prompts", "+evidence AS (SELECT o_orderkey AS decision, o_custkey AS source FROM orders) SELECT e.decision, CAST(contains(lower(p.body), 'tionhe') AS INT) + CAST(contains(lower(p.body), 'ererth') AS INT) AS found FROM evidence e JOIN prompts p ON p.id = e.source WHERE contains(lower(p.body), 'tionhe') OR contains(lower(p.body), 'ererth')"))
def decision_search(spark, d):
    words = ["tionhe", "ererth"]
    docs = lake.prompts(spark, d).select(F.col("id").alias("source"), tx.n_found(F.col("body"), words).alias("found")).filter("found > 0")
    evidence = lake.table(spark, d, "orders").select(F.col("o_orderkey").alias("decision"), F.col("o_custkey").alias("source"))
    return evidence.join(docs, "source").select("decision", "found")


@query(sql("sup asked", "SELECT s.old_seq, s.new_seq FROM sup s WHERE s.old_seq < 500 AND s.new_seq % 20 IN (SELECT session FROM asked WHERE org = 'o1')"))
def visible_supersessions(spark, d):
    shown = op.scoped(lake.asked(spark, d), org="o1").select(F.col("session").alias("k")).distinct()
    s = lake.supersessions(spark, d).filter("old_seq < 500").withColumn("k", F.col("new_seq") % 20)
    return s.join(shown, "k", "left_semi").select("old_seq", "new_seq")


@query(sql("ledger", "SELECT l.seq, coalesce('person ' || c.c_name, l.author) AS principal FROM ledger l LEFT JOIN customer c ON CAST(c.c_custkey AS VARCHAR) = l.author AND c.c_nationkey < 12"))
def author_aliases(spark, d):
    alias = lake.table(spark, d, "customer").filter("c_nationkey < 12").select(F.col("c_custkey").cast("string").alias("author"), F.concat(F.lit("person "), "c_name").alias("alias"))
    return lake.ledger(spark, d).join(alias, "author", "left").select("seq", F.coalesce("alias", "author").alias("principal"))


@query(sql("ledger asked", "SELECT author FROM ledger UNION SELECT agent FROM asked WHERE agent IS NOT NULL UNION SELECT principal FROM asked"))
def author_union(spark, d):
    a = lake.asked(spark, d)
    return lake.ledger(spark, d).select("author").union(a.filter("agent IS NOT NULL").select("agent")).union(a.select("principal")).distinct()


@query(sql("indexed prompts", "SELECT model, count(*) AS rows, count(DISTINCT kind || target) AS targets, max(len(v)) AS dim, (SELECT count(*) FROM prompts p WHERE NOT EXISTS (SELECT 1 FROM indexed j WHERE j.target = p.id AND j.kind = 'prompt' AND j.model = i.model)) AS pending FROM indexed i GROUP BY model"))
def index_stats(spark, d):
    i = lake.indexed(spark, d)
    stats = i.groupBy("model").agg(F.count("*").alias("rows"), F.countDistinct("kind", "target").alias("targets"), F.max(F.size("v")).alias("dim"))
    done = i.filter("kind = 'prompt'").select("model", F.col("target").alias("id")).distinct().join(lake.prompts(spark, d).select("id"), "id", "left_semi").groupBy("model").agg(F.count("*").alias("done"))
    every = lake.prompts(spark, d).agg(F.count("*").alias("every"))  # one row
    return stats.join(done, "model", "left").crossJoin(every).select("model", "rows", "targets", "dim", (F.col("every") - F.coalesce("done", F.lit(0))).alias("pending"))


@query(sql("indexed", "SELECT kind, target, chunk FROM indexed WHERE model = 'new'"))
def model_scan(spark, d):
    """One model's vectors: the others' folders aren't read."""
    return lake.vector_store(spark, d).filter("model = 'new'").select("kind", "target", "chunk")


@query(sql("prompts", "SELECT count(*) FILTER (WHERE strlen(body) >= 2048) AS compacted, CAST(sum(CASE WHEN strlen(body) >= 2048 THEN strlen(body) ELSE 0 END) AS BIGINT) AS released, CAST(sum(CASE WHEN strlen(body) >= 2048 THEN least(strlen(body), 355) ELSE strlen(body) END) AS BIGINT) AS kept, count(DISTINCT project) AS chains FROM prompts"))
def store_stats(spark, d):
    size = F.octet_length("body")
    big = size >= 2048
    return lake.prompts(spark, d).agg(
        F.count_if(big).alias("compacted"), F.sum(F.when(big, size).otherwise(0)).alias("released"), F.sum(F.when(big, F.least(size, F.lit(355))).otherwise(size)).alias("kept"), F.countDistinct("project").alias("chains")
    )


@query(sql("turns", "SELECT session, min(seq) AS low, max(seq) AS high, count(*) AS n FROM (SELECT *, seq - row_number() OVER (PARTITION BY session ORDER BY seq) AS run FROM turns WHERE turn % 4 <> 2) GROUP BY session, run"))
def contiguous_runs(spark, d):
    w = Window.partitionBy("session").orderBy("seq")
    gap = F.coalesce(F.col("seq") - F.lag("seq").over(w) != 1, F.lit(True))
    run = F.sum(gap.cast("long")).over(w)
    t = lake.turns(spark, d).filter("turn % 4 <> 2").withColumn("gap", gap).withColumn("run", F.sum(F.col("gap").cast("long")).over(w))
    return t.groupBy("session", "run").agg(F.min("seq").alias("low"), F.max("seq").alias("high"), F.count("*").alias("n")).drop("run")


@query(sql("notes", "SELECT id, text, starred FROM notes WHERE contains(lower(text), 'bolt') ORDER BY starred DESC, updated DESC, id DESC LIMIT 100"))
def notes_page(spark, d):
    n = lake.notes(spark, d).filter(F.lower("text").contains("bolt"))
    return n.orderBy(F.desc("starred"), F.desc("updated"), F.desc("id")).limit(100).select("id", "text", "starred")


@query(sql("prompts notes", "+r AS (SELECT p.id, CAST(contains(lower(p.body), 'tionhe') AS INT) + CAST(contains(lower(p.body), 'bolt') AS INT) + CAST(contains(lower(coalesce(n.text, '')), 'tionhe') AS INT) + CAST(contains(lower(coalesce(n.text, '')), 'bolt') AS INT) AS found FROM prompts p LEFT JOIN notes n ON n.id = p.id) SELECT id, found FROM r WHERE found > 0 ORDER BY found DESC, id LIMIT 60"))
def link_relevance(spark, d):
    words = ["tionhe", "bolt"]
    notes = lake.notes(spark, d).select("id", "text")
    found = tx.n_found(F.col("body"), words) + tx.n_found(F.coalesce("text", F.lit("")), words)
    rows = lake.prompts(spark, d).join(notes, "id", "left").select("id", found.alias("found")).filter("found > 0")
    return rows.orderBy(F.desc("found"), "id").limit(60)


@query(sql("prompts pagev", "SELECT * FROM (SELECT 'prompt' AS kind, id FROM prompts WHERE length(body) >= 200 ORDER BY id DESC LIMIT 30) UNION ALL SELECT * FROM (SELECT 'page', id FROM pagev WHERE length(title) >= 8 ORDER BY id DESC LIMIT 30)"))
def recent_items(spark, d):
    p = lake.prompts(spark, d).filter(F.length("body") >= 200).orderBy(F.desc("id")).limit(30)
    g = lake.pages(spark, d).filter(F.length("title") >= 8).orderBy(F.desc("id")).limit(30)
    return p.select(F.lit("prompt").alias("kind"), "id").union(g.select(F.lit("page"), "id"))


@query(sql("ledger", "+h AS (SELECT sha256(max(seq) || ':kind=view') AS bound FROM ledger) SELECT seq, (SELECT bound FROM h) AS cursor FROM ledger WHERE kind = 'view' AND seq > 300 ORDER BY seq LIMIT 41"))
def inspection_cursor(spark, d):
    """A page after a key, with the cursor bound to the newest event and the question: either changes, and the cursor no longer fits."""
    head = lake.ledger(spark, d).agg(F.sha2(F.concat(F.max("seq").cast("string"), F.lit(":kind=view")), 256).alias("cursor"))  # one row
    return lake.ledger(spark, d).filter("kind = 'view' AND seq > 300").orderBy("seq").limit(41).select("seq").crossJoin(head)
