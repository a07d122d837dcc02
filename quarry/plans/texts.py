"""Text retrieval and text functions."""

from pyspark.sql import functions as F

from quarry.functions import text as tx
from quarry.operators import relational as op
from quarry.operators import search, trigrams
from quarry.registry import query
from quarry.sources import lake
from quarry.sources.lake import sql

SOME = ["tionhe", "ererth", "the"]

_TRIMMED = "regexp_replace({}, '^[_./@-]+|[_./@-]+$', '', 'g')"


def _terms_sql(text):
    """The terms of a text in DuckDB: cut, trimmed and without lone letters, step by step."""
    found = (
        f"list_filter(list_transform(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}_./@-]+'), lambda x: CASE WHEN starts_with(x, '--') THEN '--' || "
        + _TRIMMED.format("x") + " ELSE " + _TRIMMED.format("x") + " END), lambda x: regexp_matches(x, '[\\p{L}\\p{N}]'))"
    )
    return f"list_transform([{found}], lambda l: CASE WHEN len(list_filter(l, lambda x: NOT regexp_matches(x, '^[b-hj-z]$'))) > 0 THEN list_filter(l, lambda x: NOT regexp_matches(x, '^[b-hj-z]$')) ELSE l END)[1]"


_T = f"toks AS (SELECT id, body, {_terms_sql('body')} AS t FROM prompts) "
_HT = f"parts AS (SELECT id, body, {_terms_sql('substr(body, 1, 400)')} AS th, {_terms_sql('substr(body, 401)')} AS tt FROM prompts), toks AS (SELECT *, list_concat(th, tt) AS t FROM parts) "


@query(sql("prompts", f"+{_T} SELECT id, len(t) AS n, array_to_string(t[1:5], ' ') AS opening FROM toks"))
def tokenize_terms(spark, d):
    t = tx.terms(F.col("body"))
    return lake.prompts(spark, d).select("id", F.size(t).alias("n"), F.array_join(F.slice(t, 1, 5), " ").alias("opening"))


@query(sql("prompts", f"+{_T} SELECT term, count(DISTINCT id) AS df, count(*) AS tf FROM (SELECT id, unnest(t) AS term FROM toks) GROUP BY term HAVING count(DISTINCT id) >= 20"))
def term_stats(spark, d):
    t = search.token_table(lake.prompts(spark, d), "id", "body")
    return t.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf")).filter("df >= 20")


def _bm25_sql(words, columns):
    """columns: (list column, weight)."""
    tf = ", ".join(" + ".join(f"{w} * len(list_filter({c}, lambda x: x = '{x}'))" for c, w in columns) + f" AS f{i}" for i, x in enumerate(words))
    st = ", ".join(f"count(*) FILTER (WHERE f{i} > 0) AS d{i}" for i in range(len(words)))
    sc = " + ".join(f"ln(1 + (n - d{i} + 0.5) / (d{i} + 0.5)) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * k / a))" for i in range(len(words)))
    hit = " + ".join(f"CAST(f{i} > 0 AS INT)" for i in range(len(words)))
    return f", c AS (SELECT *, len(t) AS k, {tf} FROM toks), s AS (SELECT count(*) AS n, avg(k) AS a, {st} FROM c), r AS (SELECT c.*, round({sc}, 6) AS score, {hit} AS n_terms FROM c, s) "


@query(sql("prompts", "+" + _HT + _bm25_sql(SOME, [("th", 3.0), ("tt", 1.0)]) + "SELECT id, score, n_terms FROM r WHERE n_terms > 0 ORDER BY score DESC, id LIMIT 50"))
def bm25_search(spark, d):
    r = search.bm25(lake.prompt_index(spark, d), SOME, [3.0, 1.0])
    return r.select(F.col("key").alias("id"), F.round("score", 6).alias("score"), "n_terms").orderBy(F.desc("score"), "id").limit(50)


@query(sql("prompts", f"+{_HT}, s AS (SELECT id, CASE WHEN list_contains(t, 'tionhe') AND list_contains(t, 'ererth') THEN 1 WHEN len(list_filter(t, lambda x: starts_with(x, 'tionhe') OR starts_with(x, 'ererth'))) > 0 THEN 2 WHEN contains(lower(body), 'tionhe') OR contains(lower(body), 'ererth') THEN 3 END AS stage FROM toks) SELECT id, stage FROM s WHERE stage = (SELECT min(stage) FROM s)"))
def cascade_search(spark, d):
    found = search.cascade(lake.prompt_index(spark, d), lake.prompts(spark, d), "id", "body", SOME[:2])
    return found.select(F.col("key").alias("id"), "stage")


@query(sql("prompts", "SELECT id, 3 AS stage FROM prompts WHERE contains(lower(body), 'ionher') OR contains(lower(body), 'zqxw')"))
def cascade_substring(spark, d):
    found = search.cascade(lake.prompt_index(spark, d), lake.prompts(spark, d), "id", "body", ["ionher", "zqxw"])
    return found.select(F.col("key").alias("id"), "stage")


_PT = f"parts AS (SELECT id, url, title, text, {_terms_sql('title')} AS ti, {_terms_sql('url')} AS tu, {_terms_sql('text')} AS tx FROM pagev), toks AS (SELECT *, list_concat(list_concat(ti, tu), tx) AS t FROM parts) "
PAGE_WORDS = ["theha", "ition", "the"]


def _snippet_sql(words):
    """Twelve words of the page's text around the first that has a term, which is marked."""
    has = " OR ".join(f"contains(lower(x), '{w}')" for w in words)
    at = f"greatest(coalesce(list_position(list_transform(w, lambda x: {has}), true), 1) - 4, 1)"
    marked = f"list_transform(w[{at} : {at} + 11], lambda x: CASE WHEN {has} THEN '[' || x || ']' ELSE x END)"
    return f"(CASE WHEN {at} > 1 THEN '…' ELSE '' END) || array_to_string({marked}, ' ') || (CASE WHEN len(w) > {at} + 11 THEN '…' ELSE '' END)"


@query(sql("pagev ledger", "+" + _PT + _bm25_sql(PAGE_WORDS, [("ti", 5.0), ("tu", 2.0), ("tx", 1.0)]) + f", best AS (SELECT *, string_split_regex(trim(text), '\\s+') AS w FROM r WHERE n_terms > 0 ORDER BY score DESC, id LIMIT 60) SELECT b.id, l.seq, b.url, b.score, {_snippet_sql(PAGE_WORDS)} AS snippet FROM best b LEFT JOIN ledger l ON CAST(l.seq AS VARCHAR) = CAST(b.id AS VARCHAR) AND l.kind <> 'error'"))
def page_bm25(spark, d):
    best = search.bm25(lake.page_index(spark, d), PAGE_WORDS, [5.0, 2.0, 1.0]).withColumn("score", F.round("score", 6)).orderBy(F.desc("score"), "key").limit(60)
    hits = best.join(lake.pages(spark, d), F.col("key") == F.col("id"))
    events = lake.ledger(spark, d).filter("kind <> 'error'").select(F.col("seq").cast("string").alias("ref_id"), "seq")
    cited = hits.join(events, F.col("id").cast("string") == F.col("ref_id"), "left")
    return cited.select("id", "seq", "url", "score", tx.snippet(F.col("text"), PAGE_WORDS, 12).alias("snippet"))


@query(sql("pagev", "SELECT id, url, title, substr(text, 1, 120) AS snippet FROM pagev WHERE contains(lower(text), 'the') ORDER BY id DESC LIMIT 60"))
def page_search(spark, d):
    p = lake.pages(spark, d).filter(F.lower("text").contains("the")).orderBy(F.desc("id")).limit(60)
    return p.select("id", "url", "title", F.substring("text", 1, 120).alias("snippet"))


def _excerpt_sql(word, n):
    at = f"greatest(0, least(instr(lower(body), '{word}') - 1 - {n // 2}, length(body) - {n}))"
    return (
        f"CASE WHEN length(body) <= {n} THEN body WHEN instr(lower(body), '{word}') = 0 THEN substr(body, 1, {n}) || '…' ELSE (CASE WHEN {at} > 0 THEN '…' ELSE '' END) ||"
        f" substr(body, {at} + 1, {n}) || (CASE WHEN {at} + {n} < length(body) THEN '…' ELSE '' END) END"
    )


@query(sql("prompts", f"SELECT id, {_excerpt_sql('tionhe', 240)} AS excerpt FROM prompts WHERE contains(lower(body), 'tionhe') ORDER BY id DESC LIMIT 100"))
def grep_literal(spark, d):
    hits = trigrams.grep(lake.prompt_grams(spark, d), "Tionhe").orderBy(F.desc("key")).limit(100)
    return hits.select(F.col("key").alias("id"), tx.excerpt(F.col("body"), ["tionhe"], 240).alias("excerpt"))


@query(sql("prompts", "SELECT id FROM prompts WHERE regexp_matches(body, '(?i)(tionhe|ererth)[.,] +[a-z]+') OR regexp_matches(body, '(?i)thenti(on)+ ')"))
def grep_pattern(spark, d):
    """Rows that match a pattern: the runs of letters that it is sure to have choose the lists, either of several ways."""
    index = lake.prompt_grams(spark, d)
    return trigrams.grep(index, pattern=r"(?:(tionhe|ererth)[.,] +[a-z]+)|thenti(on)+ ").select(F.col("key").alias("id"))


@query(sql("pagev", "SELECT id, url, title FROM pagev WHERE contains(url, 'ththre') OR contains(title, 'ththre')"))
def grep_pages(spark, d):
    """Pages whose address or title holds the needle, in this very case."""
    return trigrams.grep(lake.page_grams(spark, d), "ththre", case_sensitive=True).select(F.col("key").alias("id"), "url", "title")


_PHRASE = ["the", "in"]
_NEXT = "list_contains(list_transform(range(1, len({t})), lambda i: {t}[i] || ' ' || {t}[i + 1]), '" + " ".join(_PHRASE) + "')"
_FOUND = f"({_NEXT.format(t='th')} OR {_NEXT.format(t='tt')})"


@query(sql("prompts", "+" + _HT + _bm25_sql([*_PHRASE, "ererth"], [("th", 3.0), ("tt", 1.0)]) + f", staged AS (SELECT *, CASE WHEN {_FOUND} AND list_contains(t, 'ererth') THEN 1 WHEN {_FOUND} OR len(list_filter(t, lambda x: starts_with(x, 'ererth'))) > 0 THEN 2 END AS stage FROM r) SELECT id, stage, coalesce(CASE WHEN n_terms > 0 THEN score END, 0) AS score FROM staged WHERE stage = (SELECT min(stage) FROM staged)"))
def phrase_search(spark, d):
    """A quoted phrase and a word: rows with both, failing that with either."""
    plan = tx.plan_query('"the in" ererth')
    index = lake.prompt_index(spark, d)
    phrases = [p.split() for p in plan["phrases"]]
    found = search.planned(index, plan["terms"], phrases)
    scored = search.bm25(index, [w for p in phrases for w in p] + plan["terms"], [3.0, 1.0]).withColumn("score", F.round("score", 6))
    return found.join(scored, "key", "left").select(F.col("key").alias("id"), "stage", F.coalesce("score", F.lit(0.0)).alias("score"))


@query(sql("prompts", f"SELECT id, {_excerpt_sql('ererth', 100)} AS excerpt FROM prompts"))
def excerpts(spark, d):
    return lake.prompts(spark, d).select("id", tx.excerpt(F.col("body"), ["ererth"], 100).alias("excerpt"))


def _relevance_sql(words, toks=None):
    p = ", ".join(f"list_contains(t, '{w}') AS p{i}" for i, w in enumerate(words))
    st = ", ".join(f"count(*) FILTER (WHERE p{i}) AS d{i}" for i in range(len(words)))
    idf = [f"ln(1 + n / (1.0 + d{i}))" for i in range(len(words))]
    got = [f"CASE WHEN p{i} THEN {x} ELSE 0 END" for i, x in enumerate(idf)]
    hit = " + ".join(f"CAST(p{i} AS INT)" for i in range(len(words)))
    return f"+{toks or _HT}, c AS (SELECT id, {p} FROM toks), s AS (SELECT count(*) AS n, {st} FROM c) SELECT id, round(({' + '.join(got)}) / ({' + '.join(idf)}) * least(greatest({', '.join(got)}) / ln(1 + n), 1), 6) AS score, {hit} >= 2 AS corroborated FROM c, s WHERE {hit} > 0"


@query(sql("prompts", _relevance_sql(SOME)))
def injection_relevance(spark, d):
    return search.relevance(lake.prompt_index(spark, d), SOME).select(F.col("key").alias("id"), F.round("score", 6).alias("score"), "corroborated")


@query(sql("prompts", "+f AS (SELECT id, body, trim(regexp_replace(body, '\\s+', ' ', 'g')) AS w FROM prompts) SELECT id, (CASE WHEN length(w) <= 320 THEN w ELSE substr(w, 1, 200) || ' … ' || right(w, 120) END) || '… [compacted ' || strlen(body) || ' bytes]' AS gist FROM f"))
def gists(spark, d):
    return lake.prompts(spark, d).select("id", tx.gist(F.col("body")).alias("gist"))


@query(sql("prompts", r"""SELECT id, len(regexp_extract_all(body, '(?i)\b[A-Z0-9_\-]*(?:API_?KEY|SECRET|TOKEN|PASSWORD|PASSWD)[A-Z0-9_\-]*["'']?\s*[:=]\s*["'']?[^\s"''`,;]{16,}')) AS n, sha256(regexp_replace(regexp_replace(body, '\b(?:AKIA|ASIA)[0-9A-Z]{16}\b', '[redacted:aws_access_key]', 'g'), '(?i)(\b[A-Z0-9_\-]*(?:API_?KEY|SECRET|TOKEN|PASSWORD|PASSWD)[A-Z0-9_\-]*["'']?\s*[:=]\s*["'']?)[^\s"''`,;]{16,}', '\1[redacted:assigned_secret]', 'g')) AS digest FROM prompts"""))
def scrub_secrets(spark, d):
    clean, counts = tx.scrub(F.col("body"))
    return lake.prompts(spark, d).select("id", counts["assigned_secret"].alias("n"), F.sha2(clean, 256).alias("digest"))


@query(sql("prompts", "SELECT id, sha256('kind=prompt' || chr(10) || 'project=' || project || chr(10) || 'body=' || body_hash || chr(10)) AS payload_hash, 'root-' || substr(sha256(project), 1, 12) AS root FROM prompts"))
def payload_hash(spark, d):
    lines = F.concat(F.lit("kind=prompt\nproject="), F.col("project"), F.lit("\nbody="), F.col("body_hash"), F.lit("\n"))
    root = F.concat(F.lit("root-"), F.substring(F.sha2("project", 256), 1, 12))
    return lake.prompts(spark, d).select("id", F.sha2(lines, 256).alias("payload_hash"), root.alias("root"))


@query("WITH w AS (SELECT s_suppkey AS id, s_nationkey AS parent, list_distinct(list_filter(string_split_regex(lower(s_name || ' of nation ' || s_nationkey % 3), '[^a-z0-9]+'), lambda x: x <> '')) AS s FROM supplier UNION ALL SELECT 100000 + n_nationkey, n_regionkey, [] FROM nation) SELECT a.id AS a, b.id AS b, round(CASE WHEN len(a.s) + len(b.s) = 0 THEN 1 ELSE len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s))) END, 6) AS jaccard FROM w a JOIN w b ON a.parent = b.parent AND a.id < b.id WHERE len(a.s) + len(b.s) = 0 OR len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s))) >= 0.5")
def title_jaccard(spark, d):
    """Siblings whose titles share at least half of their words; two without a word are alike."""
    s = lake.table(spark, d, "supplier")
    title = F.concat("s_name", F.lit(" of nation "), (F.col("s_nationkey") % 3).cast("string"))
    words = F.array_distinct(F.filter(F.split(F.lower(title), "[^a-z0-9]+"), lambda x: x != ""))
    rows = s.select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("parent"), words.alias("s"))
    n = lake.table(spark, d, "nation").select((F.col("n_nationkey") + 100_000).cast("long"), "n_regionkey", F.array().cast("array<string>"))
    return op.similar_titles(rows.union(n), 0.5).select("a", "b", F.round("jaccard", 6).alias("jaccard"))


@query()
def chunk_documents(spark, d):
    c = lake.prompts(spark, d).select("id", F.explode(tx.chunks(F.col("body"))).alias("c"))
    return c.select("id", "c.*")
