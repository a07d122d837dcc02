"""Maintenance passes and evaluation."""

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.functions import text as tx
from quarry.operators import blocks, canary, trigrams, variants
from quarry.operators.lineage import shared_folder
from quarry.plans.texts import _HT, _terms_sql
from quarry.registry import query
from quarry.sources import lake
from quarry.sources.lake import sql


@query("SELECT item_id, count(doc_id) AS hits, min(doc_id) AS first FROM benchmark b LEFT JOIN documents d ON contains(d.text, b.text) GROUP BY item_id")
def gold_hits(spark, d):
    """Documents that hold a probe's whole text, wherever it begins and however short it is."""
    probes = lake.table(spark, d, "benchmark").select("item_id", "text")
    index = lake.prompt_grams(spark, d)
    found = trigrams.containing(index, probes, "item_id", "text", "body").groupBy("item_id").agg(F.count("*").alias("hits"), F.min("key").alias("first"))
    everywhere = index.texts.filter("body IS NOT NULL").agg(F.count("*").alias("all"), F.min("key").alias("least"))  # one row: an empty probe's hits
    out = probes.join(found, "item_id", "left").join(F.broadcast(everywhere), F.col("text") == "", "left")
    return out.select("item_id", F.coalesce("hits", "all", F.lit(0)).alias("hits"), F.coalesce("first", "least").alias("first"))


@query("WITH r AS (SELECT v.vec_id AS q, e.vec_id, row_number() OVER (PARTITION BY v.vec_id ORDER BY round(list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 9) DESC, e.vec_id) AS rank, e.label = v.label AS gold FROM embeddings v JOIN embeddings e ON e.vec_id <> v.vec_id WHERE v.vec_id % 100 = 0), f AS (SELECT q, min(rank) AS rank, bool_or(rank <= 20 AND gold) AS packed FROM r WHERE gold GROUP BY q) SELECT count(*) AS n, round(avg(CAST(rank <= 5 AS DOUBLE)), 6) AS recall5, round(avg(CAST(rank <= 10 AS DOUBLE)), 6) AS recall10, round(avg(CAST(rank <= 20 AS DOUBLE)), 6) AS recall20, round(avg(1.0 / rank), 6) AS mrr, round(avg(CAST(packed AS DOUBLE)), 6) AS packed FROM f")
def recall_mrr(spark, d):
    """How early a vector of the same class comes, for every vector whose id is divisible by 100, and how often a pack of the
    first 20 holds one."""
    e = lake.table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").alias("v"))
    first = ranks_of_first(e.filter("vec_id % 100 = 0"), e)
    hit = lambda k: F.round(F.avg((F.col("rank") <= k).cast("double")), 6)
    return first.agg(
        F.count("*").alias("n"), hit(5).alias("recall5"), hit(10).alias("recall10"), hit(20).alias("recall20"), F.round(F.avg(1.0 / F.col("rank")), 6).alias("mrr"), hit(20).alias("packed")
    )


def ranks_of_first(queries, rows):
    """(q, rank): the place of the nearest row of the query's own label among all rows but itself (vec_id, label, v), ties to the
    smaller vec_id; queries without such a row have none. Blocks give their best row and, once the best of all is
    known, how many are ahead of it."""

    def best(q, r, near):
        good = (q["label"].to_numpy()[:, None] == r["label"].to_numpy()) & (q["vec_id"].to_numpy()[:, None] != r["vec_id"].to_numpy())
        some = np.flatnonzero(good.any(1)) if good.size else np.zeros(0, int)
        ids, at = r["vec_id"].to_numpy(), []
        for i in some:
            row = np.where(good[i], near[i], -2)
            at.append(min(ids[row == row.max()]))
        return pa.table([q["vec_id"].take(pa.array(some)), pa.array([float(np.where(good[i], near[i], -2).max()) for i in some], pa.float64()), pa.array(at, pa.int64())], names=["q", "s", "id"])

    def ahead(q, r, near):
        ids, s, own = r["vec_id"].to_numpy(), q["s"].to_numpy(), q["best"].to_numpy()
        n = (((near > s[:, None]) | ((near == s[:, None]) & (ids <= own[:, None]))) & (q["vec_id"].to_numpy()[:, None] != ids)).sum(1) if near.size else []
        return pa.table([q["vec_id"], pa.array(n, pa.int64())], names=["q", "n"])

    found = blocks.against(queries, rows, "vec_id", "vec_id", best, "q long, s double, id long")
    top = found.groupBy("q").agg(F.max(F.struct("s", (-F.col("id")).alias("n"))).alias("t")).select(F.col("q").alias("vec_id"), F.col("t.s").alias("s"), (-F.col("t.n")).alias("best"))
    counted = blocks.against(queries.join(top, "vec_id"), rows, "vec_id", "vec_id", ahead, "q long, n long")
    return counted.groupBy("q").agg(F.sum("n").alias("rank"))


@query(sql("nodes links", "+k AS (SELECT parent, count(*) AS fan FROM nodes WHERE parent IS NOT NULL GROUP BY parent), o AS (SELECT count(*) AS orphans FROM nodes n WHERE parent IS NOT NULL AND NOT EXISTS (SELECT 1 FROM links l WHERE l.node = n.id) AND n.id LIKE 'c:%') SELECT max(fan) AS fan_out_max, count(*) FILTER (WHERE fan > 120) AS over_120, count(*) FILTER (WHERE fan > 150) AS over_150, (SELECT orphans FROM o) AS orphans, (SELECT count(*) FROM (SELECT parent, title FROM nodes GROUP BY 1, 2 HAVING count(*) > 1)) AS same_titles FROM k"))
def catalog_health(spark, d):
    nodes, links = lake.nodes(spark, d), lake.links(spark, d)
    fan = nodes.filter("parent IS NOT NULL").groupBy("parent").agg(F.count("*").alias("fan"))
    a = fan.agg(F.max("fan").alias("fan_out_max"), F.count_if(F.col("fan") > 120).alias("over_120"), F.count_if(F.col("fan") > 150).alias("over_150"))
    filed = links.select(F.col("node").alias("id"))
    b = nodes.filter("id LIKE 'c:%'").join(filed, "id", "left_anti").agg(F.count("*").alias("orphans"))
    c = nodes.groupBy("parent", "title").count().filter("count > 1").agg(F.count("*").alias("same_titles"))
    return a.crossJoin(b).crossJoin(c)  # one row each


SEED, EACH, DEPTH = 7, 25, 20
_STOP = ", ".join(f"'{w}'" for w in tx.STOPWORDS)


def _drawn_sql(subject, frame, key, text):
    """Candidates of a subject with their draw, in DuckDB."""
    return f"(SELECT {key} AS gold, list_filter(string_split_regex(trim({text}), '\\s+'), lambda x: regexp_matches(x, '[\\p{{L}}\\p{{N}}]')) AS w, md5('{SEED}:{subject}:' || {key}) AS h FROM {frame})"


def _ranks_sql(subject, toks, weights):
    """Ranks of a subject's probes among a frame of (id, term lists)."""
    tf = " + ".join(f"{w} * count(*) FILTER (col = '{c}')" for c, w in weights)
    each = " UNION ALL ".join(f"SELECT id, '{c}' AS col, unnest({c}) AS term FROM {toks}" for c, _ in weights)
    return (
        f"{subject}_t AS (SELECT id AS key, term, {tf} AS tf FROM ({each}) GROUP BY ALL), {subject}_n AS (SELECT count(*) AS n, avg(len(t)) AS a FROM {toks}), {subject}_k AS (SELECT id AS key, len(t) AS k FROM {toks}), "
        f"{subject}_d AS (SELECT term, count(*) AS df FROM {subject}_t GROUP BY term), {subject}_q AS (SELECT gold, unnest(list_distinct(asked)) AS term FROM probes WHERE subject = '{subject}'), "
        f"{subject}_s AS (SELECT gold, key, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * k / a))), 6) AS score FROM {subject}_q JOIN {subject}_t USING (term) JOIN {subject}_d USING (term) JOIN {subject}_k USING (key), {subject}_n GROUP BY ALL), "
        f"{subject}_r AS (SELECT gold, (SELECT count(*) FROM {subject}_s x WHERE x.gold = o.gold AND (x.score > o.score OR (x.score = o.score AND x.key <= o.gold))) AS rank FROM {subject}_s o WHERE o.key = o.gold)"
    )


_CANARY = (
    f", c AS (SELECT 'prompt_span' AS subject, gold, h, array_to_string(w[s + 1 : s + n], ' ') AS query FROM (SELECT *, ('0x' || substr(h, 9, 7))::BIGINT % (len(w) - n + 1) AS s FROM (SELECT *, least(8 + ('0x' || substr(h, 1, 7))::BIGINT % 5, len(w)) AS n FROM {_drawn_sql('prompt_span', 'prompts', 'id', 'body')} WHERE len(w) >= 8)) "
    f"UNION ALL SELECT 'browse_title', gold, h, array_to_string(w[1:8], ' ') FROM {_drawn_sql('browse_title', 'pagev', 'id', 'title')} WHERE len(w) > 0), "
    f"f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY h, gold) AS r FROM c) WHERE r <= {EACH}), ft AS (SELECT subject, gold, query, {_terms_sql('query')} AS t FROM f), "
    f"fc AS (SELECT *, list_filter(t, lambda x: x NOT IN ({_STOP})) AS k FROM ft), probes AS (SELECT subject, gold, query, (CASE WHEN len(k) > 0 THEN k ELSE t END)[1:12] AS asked FROM fc)"
)


@query(sql("prompts pagev", "+" + _HT.rstrip() + f", ptoks AS (SELECT id, {_terms_sql('title')} AS ti, {_terms_sql('url')} AS tu, {_terms_sql('text')} AS tx FROM pagev), pt AS (SELECT *, list_concat(list_concat(ti, tu), tx) AS t FROM ptoks)" + _CANARY + ", " + _ranks_sql("prompt_span", "toks", [("th", 3.0), ("tt", 1.0)]) + ", " + _ranks_sql("browse_title", "pt", [("ti", 5.0), ("tu", 2.0), ("tx", 1.0)])
           + f", r AS (SELECT p.subject, p.gold, CASE WHEN rank <= {DEPTH} THEN rank END AS rank FROM probes p LEFT JOIN (SELECT 'prompt_span' AS subject, * FROM prompt_span_r UNION ALL SELECT 'browse_title', * FROM browse_title_r) x ON x.subject = p.subject AND x.gold = p.gold) SELECT subject, count(*) AS n, count(rank) AS hits, round(count(rank) / count(*), 6) AS recall, round(avg(coalesce(1.0 / rank, 0)), 6) AS mrr FROM r GROUP BY subject"))
def canary_eval(spark, d):
    """Probes of two subjects are drawn, stored, read again and put to the ranked arms of prompts and pages."""
    said = canary.spans(lake.prompts(spark, d), "prompt_span", "id", "body", SEED)
    seen = canary.titles(lake.pages(spark, d), "browse_title", "id", "title", SEED)
    folder = f"{shared_folder(spark)}/canary-{uuid.uuid4().hex}"
    canary.freeze(said.union(seen), EACH).write.parquet(folder)
    probes = spark.read.parquet(folder)
    ranks = canary.evaluate(lake.prompt_index(spark, d), probes.filter("subject = 'prompt_span'"), [3.0, 1.0], DEPTH)
    return canary.report(ranks.union(canary.evaluate(lake.page_index(spark, d), probes.filter("subject = 'browse_title'"), [5.0, 2.0, 1.0], DEPTH)))


@query(sql("turns", """+j AS (SELECT seq, json_object('seq', seq, 'who', json_object('role', role, 'long', length(body) > 200), 'marks', json_array(turn, json_array(session, turn % 3), 'it''s'), 'none', NULL) AS j FROM turns) SELECT seq, fullkey AS path, CASE type WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' ELSE 'number' END AS kind, CASE WHEN type NOT IN ('OBJECT', 'ARRAY', 'NULL') THEN json_extract_string(j, fullkey) END AS value FROM j, json_tree(j.j)"""))
def nested_values(spark, d):
    """Everything inside nested texts with its path."""
    t = lake.turns(spark, d)
    text = F.concat(
        F.lit('{"seq":'), F.col("seq").cast("string"), F.lit(',"who":'), F.to_json(F.struct("role", (F.length("body") > 200).alias("long"))), F.lit(',"marks":['), F.col("turn").cast("string"),
        F.lit(",["), F.col("session").cast("string"), F.lit(","), (F.col("turn") % 3).cast("string"), F.lit('],"it\'s"],"none":null}'),
    )
    return variants.json_tree(t.select("seq", text.alias("j")), "seq", "j")


@query("SELECT event_type AS kind, count(DISTINCT user_id) AS users, count(DISTINCT event_id) AS events, true AS users_near, true AS events_near FROM events GROUP BY event_type")
def distinct_by_sketch(spark, d):
    """Different users and events of each kind: exact, and whether the sketches of single days, rolled up, come within their bound."""
    e = lake.table(spark, d, "events").select(F.col("event_type").alias("kind"), F.to_date("ts").alias("day"), "user_id", "event_id")
    est = variants.estimated(variants.sketches(e, ["kind", "day"], ["user_id", "event_id"]), ["kind"], ["user_id", "event_id"])
    exact = e.groupBy("kind").agg(F.countDistinct("user_id").alias("users"), F.countDistinct("event_id").alias("events"))
    near = lambda a, b: F.abs(F.col(a) - F.col(b)) <= variants.error_bound() * F.col(a)
    return exact.join(est, "kind").select("kind", "users", "events", near("users", "user_id").alias("users_near"), near("events", "event_id").alias("events_near"))
