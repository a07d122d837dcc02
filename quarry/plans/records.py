"""Sources and sinks, bundles, segments and small functions of records."""

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.functions import text as tx
from quarry.operators import graph
from quarry.operators import records as rec
from quarry.operators import relational as op
from quarry.operators.lineage import cut, shared_folder
from quarry.registry import query
from quarry.sources import lake
from quarry.sources.lake import sql


@query(sql("ledger", "SELECT max(seq) AS seq, max_by(sha256('{\"seq\":' || seq || ',\"ts\":' || ts || ',\"kind\":\"' || kind || '\",\"author\":\"' || author || '\",\"payload_hash\":\"' || sha256(payload) || '\",\"prev_hash\":null}'), seq) AS entry_hash FROM ledger"))
def snapshot_head(spark, d):
    rows = lake.ledger(spark, d).withColumn("payload_hash", F.sha2("payload", 256)).withColumn("prev_hash", F.lit(None).cast("string"))
    return rows.agg(F.max("seq").alias("seq"), F.max_by(F.sha2(graph.event_body(), 256), "seq").alias("entry_hash"))


@query(sql("ledger turns pagev notes", "SELECT l.seq, l.kind, coalesce(t.role, CASE WHEN g.id IS NOT NULL THEN 'page' WHEN n.text IS NOT NULL THEN 'note' END) AS role, CASE WHEN length(b.body) > 4000 THEN substr(b.body, 1, 4000) || '…' ELSE b.body END AS body FROM ledger l LEFT JOIN turns t ON t.session = l.session AND t.turn = l.seq % 8 LEFT JOIN pagev g ON g.id = l.seq LEFT JOIN (SELECT target, min_by(text, id) AS text FROM notes WHERE target IS NOT NULL GROUP BY target) n ON n.target = l.seq, LATERAL (SELECT coalesce(t.body, g.text, n.text) AS body) b WHERE l.seq > 200 AND l.kind NOT IN ('view', 'signup') AND coalesce(t.role, '') <> 'assistant' ORDER BY l.seq LIMIT 300"))
def lake_delta(spark, d):
    """What is new after a number: events with the body of their prompt, page or note; kinds of bookkeeping and the agents' own rows are left out."""
    events = lake.ledger(spark, d).filter("seq > 200").filter(~F.col("kind").isin("view", "signup")).withColumn("turn", (F.col("seq") % 8).cast("int"))
    said = lake.turns(spark, d).select("session", "turn", F.col("role").alias("said_by"), F.col("body").alias("said"))
    seen = lake.pages(spark, d).select(F.col("id").alias("seq"), F.col("text").alias("page"))
    noted = lake.notes(spark, d).filter("target IS NOT NULL").groupBy(F.col("target").alias("seq")).agg(F.min_by("text", "id").alias("note"))
    rows = events.join(said, ["session", "turn"], "left").join(seen, "seq", "left").join(noted, "seq", "left")
    rows = rows.filter(F.coalesce("said_by", F.lit("")) != "assistant").orderBy("seq").limit(300)
    role = F.coalesce("said_by", F.when(F.col("page").isNotNull(), "page").when(F.col("note").isNotNull(), "note"))
    return rows.select("seq", "kind", role.alias("role"), op.clip(F.coalesce("said", "page", "note"), 4000).alias("body"))


@query(sql("ledger turns", "SELECT l.kind AS folder, l.seq, '# ' || l.seq || chr(10) || 'kind: ' || l.kind || chr(10) || chr(10) || coalesce(t.body, '') AS value FROM ledger l LEFT JOIN turns t ON t.session = l.session AND t.turn = l.seq % 8 WHERE l.seq > 700"))
def mirror(spark, d):
    """Events after a number as text files, a folder for each kind, and read again."""
    events = lake.ledger(spark, d).filter("seq > 700").withColumn("turn", (F.col("seq") % 8).cast("int"))
    rows = events.join(lake.turns(spark, d).select("session", "turn", "body"), ["session", "turn"], "left")
    page = F.concat(F.lit("# "), F.col("seq").cast("string"), F.lit("\nkind: "), "kind", F.lit("\n\n"), F.coalesce("body", F.lit("")))
    out = f"{shared_folder(spark)}/mirror-{uuid.uuid4().hex}"
    end = "\u001e"  # between files' texts, which hold line ends
    rows.select(F.col("kind").alias("folder"), page.alias("value")).write.option("lineSep", end).partitionBy("folder").text(out)
    read = spark.read.option("lineSep", end).text(out)
    return read.select("folder", F.regexp_extract("value", "^# ([0-9]+)", 1).cast("long").alias("seq"), "value")


@query(sql("turns", "+u AS (SELECT *, sum(CASE WHEN role = 'user' AND turn % 4 <> 2 THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY turn) AS unit FROM turns WHERE turn % 7 <> 6), g AS (SELECT session, unit, string_agg(trim(body), chr(10) || chr(10) ORDER BY turn) AS t, bool_or(turn % 3 = 1) AS edits, list_distinct(list('src/' || turn % 5 || '.py' ORDER BY turn) FILTER (WHERE turn % 3 = 1)) AS files, max(turn) AS last FROM u WHERE role = 'assistant' AND trim(body) <> '' GROUP BY session, unit) SELECT session, unit AS turn, (CASE WHEN length(t) > 16000 THEN substr(t, 1, 16000) || '…' ELSE t END) || (CASE WHEN edits THEN chr(10) || chr(10) || '[edited: ' || array_to_string(list_sort(files), ', ') || ']' ELSE '' END) AS body, 1767225600123 + last * 60000 AS ts FROM g"))
def transcript_turns(spark, d):
    """Turns written as JSONL transcripts, with side chains, tool results and edits, and read as the assistant's turns."""
    t = lake.turns(spark, d)
    text = F.struct(F.lit("text").alias("type"), F.trim("body").alias("text"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("struct<file_path:string>").alias("input"))
    path = F.concat(F.lit("src/"), (F.col("turn") % 5).cast("string"), F.lit(".py"))
    edit = F.struct(F.lit("tool_use").alias("type"), F.lit(None).cast("string").alias("text"), F.lit("Edit").alias("name"), F.struct(path.alias("file_path")).alias("input"))
    done = F.struct(F.lit("tool_result").alias("type"), F.col("body").alias("text"))
    at = F.concat(F.lit("2026-01-01T0"), F.floor(F.col("turn") / 60).cast("string"), F.lit(":"), F.lpad((F.col("turn") % 60).cast("string"), 2, "0"), F.lit(":00.123Z"))
    blocks = F.to_json(F.when(F.col("turn") % 3 == 1, F.array(text, edit)).otherwise(F.array(text)))
    content = F.when(F.col("role") == "assistant", blocks).when(F.col("turn") % 4 == 2, F.to_json(F.array(done))).otherwise(F.to_json(F.array(F.struct(F.lit("text").alias("type"), F.col("body").alias("text")))))
    kind = F.when(F.col("role") == "system", "summary").otherwise(F.col("role"))
    line = F.concat(
        F.lit('{"type":"'), kind, F.lit('","isSidechain":'), (F.col("turn") % 7 == 6).cast("string"), F.lit(',"timestamp":"'), at, F.lit('","message":{"content":'), content, F.lit("}}")
    )
    lines = t.select("session", F.col("turn").alias("pos"), line.alias("line"))
    out = rec.transcript_turns(lines)
    parts = F.split("body", "\n\n\\[edited: ")  # files in order of name, to compare
    files = F.array_join(F.array_sort(F.split(F.regexp_replace(F.get(parts, F.lit(1)), "\\]$", ""), ", ")), ", ")
    body = F.when(F.size(parts) > 1, F.concat(parts[0], F.lit("\n\n[edited: "), files, F.lit("]"))).otherwise(F.col("body"))
    return out.select("session", F.col("turn").cast("long").alias("turn"), body.alias("body"), "ts")


@query(sql("ledger", "SELECT seq, kind, sha256(payload) AS payload_hash FROM ledger WHERE kind = 'click' UNION ALL SELECT 1000000 + seq, 'capture', sha256(payload) FROM ledger WHERE kind = 'view'"))
def captured(spark, d):
    """An append sink: rows go to a table in two batches, an event with each, and are read as one."""
    out = f"{shared_folder(spark)}/captured-{uuid.uuid4().hex}"
    rows = lake.ledger(spark, d).select("seq", "kind", F.sha2("payload", 256).alias("payload_hash"))
    rows.filter("kind = 'click'").write.mode("append").parquet(out)
    rows.filter("kind = 'view'").select((F.col("seq") + 1_000_000).alias("seq"), F.lit("capture").alias("kind"), "payload_hash").write.mode("append").parquet(out)
    return spark.read.parquet(out)


_CHAINED = "+rows AS (SELECT seq, ts, kind, author, session, sha256(payload) AS ph, row_number() OVER (PARTITION BY session ORDER BY seq) AS i FROM ledger), c(session, i, seq, prev, entry, ts, kind, author, ph) AS (SELECT session, i, seq, repeat('0', 64), sha256('{\"seq\":' || seq || ',\"ts\":' || ts || ',\"kind\":\"' || kind || '\",\"author\":\"' || author || '\",\"payload_hash\":\"' || ph || '\",\"prev_hash\":\"' || repeat('0', 64) || '\"}'), ts, kind, author, ph FROM rows WHERE i = 1 UNION ALL SELECT r.session, r.i, r.seq, c.entry, sha256('{\"seq\":' || r.seq || ',\"ts\":' || r.ts || ',\"kind\":\"' || r.kind || '\",\"author\":\"' || r.author || '\",\"payload_hash\":\"' || r.ph || '\",\"prev_hash\":\"' || c.entry || '\"}'), r.ts, r.kind, r.author, r.ph FROM c JOIN rows r ON r.session = c.session AND r.i = c.i + 1) "


@query(sql("ledger", _CHAINED + "SELECT CAST(session AS VARCHAR) AS chain, seq, prev AS prev_hash, entry AS entry_hash FROM c", True))
def chain_build(spark, d):
    return graph.build_chain(lake.ledger(spark, d), "session").select("chain", "seq", "prev_hash", "entry_hash")


@query(sql("ledger prompts nodes links notes", "+s AS (SELECT seq FROM ledger WHERE session = 7) SELECT 'event' AS part, count(*) AS n FROM s UNION ALL SELECT 'prompt', count(*) FROM prompts WHERE id IN (SELECT seq FROM s) UNION ALL SELECT 'node', count(*) FROM nodes WHERE id IN (SELECT node FROM links WHERE id IN (SELECT seq FROM s)) UNION ALL SELECT 'link', count(*) FROM links WHERE id IN (SELECT seq FROM s) UNION ALL SELECT 'note', count(*) FROM notes WHERE target IN (SELECT seq FROM s)"))
def bundle_export(spark, d):
    """A session's bundle, written as JSON and read again: rows of each part."""
    chain = graph.build_chain(lake.ledger(spark, d).filter("session = 7"), "session")
    rows = rec.bundle_rows(chain, lake.prompts(spark, d).select("id", "body"), lake.nodes(spark, d), lake.links(spark, d), lake.notes(spark, d), chain.select("seq"))
    out = f"{shared_folder(spark)}/bundle-{uuid.uuid4().hex}"
    rows.write.json(out)
    return spark.read.schema("part string, id string, row string").json(out).groupBy("part").agg(F.count("*").alias("n"))


@query(sql("ledger", "+r AS (SELECT session, row_number() OVER (PARTITION BY session ORDER BY seq) - 1 AS place, count(*) OVER (PARTITION BY session) AS n FROM ledger), k AS (SELECT * FROM r WHERE NOT (session % 3 = 1 AND place = 2) AND NOT (session % 3 = 2 AND place = 0)) SELECT CAST(session AS VARCHAR) AS chain, count(*) AS checked, CAST(count(*) FILTER (WHERE session % 5 = 4 AND place = 1) AS BIGINT) AS bad, (session % 3 = 0 OR session % 3 = 1 AND max(n) <= 3) AS full_chain, NOT (session % 5 = 4 AND max(n) > 1) AS ok FROM k GROUP BY session"))
def bundle_verify(spark, d):
    """Bundles with a hole, with a late beginning and with a changed event."""
    w = Window.partitionBy("chain").orderBy("seq")
    rows = graph.build_chain(lake.ledger(spark, d), "session").withColumn("place", F.row_number().over(w) - 1).withColumn("c", F.col("chain").cast("long"))
    rows = rows.filter(~((F.col("c") % 3 == 1) & (F.col("place") == 2)) & ~((F.col("c") % 3 == 2) & (F.col("place") == 0)))
    rows = rows.withColumn("author", F.when((F.col("c") % 5 == 4) & (F.col("place") == 1), "intruder").otherwise(F.col("author")))
    return rec.verify_bundle(rows)


@query(sql("ledger", "SELECT CAST(session AS VARCHAR) AS chain, CASE session % 5 WHEN 0 THEN 'new' WHEN 1 THEN 'overlap' WHEN 2 THEN 'gap' WHEN 3 THEN 'fork' ELSE 'unlinked' END AS verdict FROM ledger GROUP BY session HAVING count(*) >= 8"))
def segment_verify(spark, d):
    """Segments that go on, come again, leave a hole, contradict and don't link, against the first five events of their chains."""
    w = Window.partitionBy("chain").orderBy("seq")
    rows = cut(graph.build_chain(lake.ledger(spark, d), "session").withColumn("n", F.count("*").over(Window.partitionBy("chain"))).withColumn("seq", F.row_number().over(w) - 1).filter("n >= 8"))
    known, c = rows.filter("seq < 5"), F.col("chain").cast("long") % 5
    low = F.when(c == 0, 5).when(c == 1, 3).when(c == 2, 6).when(c == 3, 4).otherwise(5)
    segment = rows.filter(F.col("seq") >= low)
    segment = segment.withColumn("entry_hash", F.when((c == 3) & (F.col("seq") == 4), F.sha2("entry_hash", 256)).otherwise(F.col("entry_hash")))
    segment = segment.withColumn("prev_hash", F.when((c == 4) & (F.col("seq") == 5), F.sha2("prev_hash", 256)).otherwise(F.col("prev_hash")))
    return rec.import_verdicts(known, segment)


@query(sql("ledger", "SELECT CAST(session AS VARCHAR) AS chain, max(seq) AS head_seq, count(*) AS n, count(*) FILTER (WHERE seq % 11 = 0) AS tombstones FROM ledger GROUP BY session"))
def foreign_upsert(spark, d):
    """Rows from elsewhere come twice and overlap; those there stay as they are, tombstones too."""
    rows = lake.ledger(spark, d).select(F.col("session").cast("string").alias("chain"), "seq", F.col("payload").alias("text"), (F.col("seq") % 11 == 0).alias("tombstoned"))
    first = rows.filter("seq % 2 = 0 OR tombstoned")
    again = rows.withColumn("tombstoned", F.lit(False))
    every, heads = rec.upsert_foreign(first, again.union(again))
    return every.groupBy("chain").agg(F.count("*").alias("n"), F.count_if("tombstoned").alias("tombstones")).join(heads, "chain").select("chain", "head_seq", "n", "tombstones")


@query(sql("ledger", "SELECT CAST(session AS VARCHAR) AS chain, count(*) FILTER (WHERE seq > 400) AS checked, CASE WHEN session % 4 = 3 THEN min(seq) FILTER (WHERE seq > 600) END AS first_bad_seq FROM ledger GROUP BY session HAVING count(*) FILTER (WHERE seq > 400) > 0"))
def chain_verify_increment(spark, d):
    """Only what follows an anchor is checked, against the anchor's stored hash."""
    rows = cut(graph.build_chain(lake.ledger(spark, d), "session"))
    anchors = rows.filter("seq <= 400").groupBy("chain").agg(F.max_by("entry_hash", "seq").alias("anchor"))
    w = Window.partitionBy("chain").orderBy("seq")
    first = (F.col("chain").cast("long") % 4 == 3) & (F.col("seq") > 600)
    new = rows.filter("seq > 400")
    new = new.withColumn("kind", F.when(first & (F.count_if(first).over(w) == 1), "altered").otherwise(F.col("kind")))
    return graph.verify_after(new, anchors).select("chain", "checked", "first_bad_seq")


@query(sql("prompts", "SELECT id, replace(substr(body, 1, 500), chr(10), ' ') IS NOT NULL AS has, CASE WHEN length(o) <= 160 THEN o ELSE substr(o, 1, 160) || '…' END AS line, CASE WHEN length(o) <= 500 THEN o ELSE substr(o, 1, 300) || ' … ' || right(o, 200) END AS ends, strftime(make_timestamp((1704067200000 + id * 61000) * 1000), '%Y-%m-%d %H:%M') AS at, regexp_replace(project || '/../' || surface || '.é ', '[^A-Za-z0-9_-]', '_', 'g') AS folder, substr(project || '/' || surface, length(project) + 2) AS title, least(greatest(60000 // 2 // (1 + id % 60), 600), 4000) AS budget FROM (SELECT *, replace(body, chr(10), ' ') AS o FROM prompts)"))
def line_forms(spark, d):
    at = F.date_format(F.timestamp_millis(F.lit(1_704_067_200_000) + F.col("id") * 61_000), "yyyy-MM-dd HH:mm")
    path = F.concat("project", F.lit("/../"), "surface", F.lit(".é "))
    budget = F.least(F.greatest(F.floor(F.lit(30_000) / (1 + F.col("id") % 60)), F.lit(600)), F.lit(4000))
    return lake.prompts(spark, d).select(
        "id", F.col("body").isNotNull().alias("has"), tx.one_line(F.col("body"), 160).alias("line"), tx.both_ends(F.col("body"), 300, 200).alias("ends"), at.alias("at"),
        tx.safe_segment(path).alias("folder"), tx.basename(F.concat("project", F.lit("/"), "surface")).alias("title"), budget.alias("budget"),
    )


@query("SELECT c_custkey AS id, sha256(c_name) AS principal, substr(sha256(c_name), 1, 16) AS fingerprint, sha256(CAST(c_name AS BLOB) || '\\x00'::BLOB || CAST('device:' || c_mktsegment AS BLOB)) AS device, sha256(CAST(c_name AS BLOB) || '\\x00'::BLOB || CAST('agent:' || c_mktsegment AS BLOB)) AS agent FROM customer")
def identity_hashes(spark, d):
    c = lake.table(spark, d, "customer")
    return c.select(F.col("c_custkey").alias("id"), *tx.identities(F.col("c_name"), F.col("c_mktsegment")))


@query(sql("prompts", "SELECT id, id % 7 <> 3 AS same, CASE WHEN id % 7 <> 3 THEN length(body) END AS chars FROM prompts WHERE body IS NOT NULL"))
def deflate_round_trip(spark, d):
    p = lake.prompts(spark, d).filter("body IS NOT NULL").withColumn("packed", rec.deflate(F.col("body")))
    asked = F.when(F.col("id") % 7 != 3, F.col("body_hash")).otherwise(F.sha2(F.lit("other"), 256))
    text = rec.inflate(F.col("packed"), asked)
    return p.select("id", text.isNotNull().alias("same"), F.length(text).cast("long").alias("chars"))


@query(sql("prompts", "SELECT id, '<<<ITEM nonce=n1 kind=prompt id=' || id || '>>>' || chr(10) || regexp_replace(body, '\\n+$', '') || chr(10) || '<<<END nonce=n1>>>' || chr(10) AS fenced, regexp_replace(body, '\\n+$', '') AS inner FROM prompts".replace("\\n", "\\n")))
def fenced_items(spark, d):
    fenced = tx.fence(F.col("body"), F.concat(F.lit("kind=prompt id="), F.col("id").cast("string")), "n1")
    rows = lake.prompts(spark, d).select("id", fenced.alias("fenced"))
    return rows.select("id", "fenced", tx.unfence(F.col("fenced"), "n1").alias("inner"))


@query(sql("ledger", "SELECT seq, CASE seq % 4 WHEN 0 THEN 'file' WHEN 1 THEN 'create' WHEN 2 THEN 'merge' ELSE 'supersede' END AS op, CASE seq % 4 WHEN 0 THEN CAST(seq AS VARCHAR) END AS target FROM ledger WHERE seq % 5 <> 4 AND NOT (seq % 4 = 3 AND seq % 3 = 0) AND NOT (seq % 4 = 2 AND seq % 7 = 0)"))
def proposal_parse(spark, d):
    """Replies with prose around them, broken objects and proposals that break a rule."""
    n = F.col("seq").cast("string")
    merge = F.when(F.col("seq") % 7 == 0, '["x"]').otherwise('["x","y"]')
    new = F.when(F.col("seq") % 3 == 0, n).otherwise((F.col("seq") + 1).cast("string"))
    body = (
        F.when(F.col("seq") % 4 == 0, F.concat(F.lit('{"op":"file","parent_id":"p","target_kind":"prompt","target_id":'), n, F.lit("}")))
        .when(F.col("seq") % 4 == 1, F.lit('{"op":"create","parent_id":"p","title":"a {brace} \\"quoted\\""}'))
        .when(F.col("seq") % 4 == 2, F.concat(F.lit('{"op":"merge","node_ids":'), merge, F.lit("}")))
        .otherwise(F.concat(F.lit('{"op":"supersede","old_seq":'), n, F.lit(',"new_seq":"'), new, F.lit('"}')))
    )
    end = F.when(F.col("seq") % 5 == 4, "").otherwise("}")
    reply = F.concat(F.lit('Sure {not json} {"other": 1}\n```json\n{"proposals":['), body, F.lit(',{"op":"unknown"}]'), end, F.lit("\n``` done"))
    found = rec.proposals(lake.ledger(spark, d).select("seq", reply.alias("reply")), "reply")
    return found.select("seq", F.col("p.op").alias("op"), F.when(F.col("p.op") == "file", F.col("p.target_id")).alias("target"))


@query(sql("ledger", "SELECT seq, seq % 100 / 100.0 >= 0.8 AND seq % 3 <> 0 AS accepted FROM ledger WHERE seq % 9 <> 0"))
def verdict_parse(spark, d):
    name = F.when(F.col("seq") % 9 == 0, "x").otherwise("proposalId")
    reply = F.concat(
        F.lit('so: {"verdicts":[{"'), name, F.lit('":'), F.col("seq").cast("string"), F.lit(',"apply":'), (F.col("seq") % 3 != 0).cast("string"), F.lit(',"confidence":'),
        (F.col("seq") % 100 / 100.0).cast("string"), F.lit(',"reason":"r"}]}'),
    )
    return rec.supersede_verdicts(lake.ledger(spark, d).select("seq", reply.alias("reply")), "reply").select("seq", "accepted")
