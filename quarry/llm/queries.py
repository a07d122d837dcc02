"""The numbered operators as queries over whole tables, with production parameters, and their DuckDB SQL."""

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quarry.llm import ann, bpe, codes, graphdedup, langid, minhash, packing, secrets, substring, suffixes, tokencount, toxicity, turns

ENGLISH, MULTI = "byte_bpe_50k.json", "byte_bpe_multi_50k.tiktoken"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), k=3, percent=85)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path(ENGLISH), window=1024, end_id=0)


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings"), every=100, k=10, factor=1.0)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path(ENGLISH), limit=512)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeated_passages(_table(spark, sf_dir, "documents"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphdedup.near_duplicate_vectors(_table(spark, sf_dir, "embeddings"), threshold=0.93)


def op9_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoding_digests(_table(spark, sf_dir, "documents"), public_tokenizers.path(MULTI))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.vector_codes(_table(spark, sf_dir, "embeddings"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.repaired_conversations(_table(spark, sf_dir, "conversations"))


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeated_bytes(_table(spark, sf_dir, "documents"), threshold=50)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}


_SETS = r"""w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i : i + 2], ' '))) END AS s FROM w)"""
_REACH = "e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l), r(id, c) AS (SELECT id, id FROM n UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.id)"
_FINITE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])) > 0"


def _codes_sql() -> str:
    """Lloyd's rounds by plain comparison of every part with every entry."""
    rounds = []
    for k in range(7):
        rounds.append(
            f"d{k} AS (SELECT x.i, x.p, b.e, sum((x.v - b.v) * (x.v - b.v))::BIGINT AS d FROM x JOIN b{k} b ON b.p = x.p AND b.j = x.j GROUP BY ALL), "
            f"a{k} AS MATERIALIZED (SELECT i, p, min(d * 16 + e) % 16 AS e, min(d * 16 + e) // 16 AS d FROM d{k} GROUP BY ALL)"
        )
        if k < 6:
            rounds.append(
                f"t{k} AS (SELECT a.p, a.e, x.j, sum(x.v)::BIGINT AS s, count(*) AS n FROM a{k} a JOIN x ON x.i = a.i AND x.p = a.p GROUP BY ALL), "
                f"b{k + 1} AS MATERIALIZED (SELECT b.p, b.e, b.j, coalesce((s - ((s % n) + n) % n) // n, b.v) AS v FROM b{k} b LEFT JOIN t{k} t ON t.p = b.p AND t.e = b.e AND t.j = b.j)"
            )
    return f"""WITH kept AS MATERIALIZED (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS i, list_transform(embedding, lambda y: floor(4096 * CAST(y AS DOUBLE))::BIGINT) AS q
FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR isnan(y) OR isinf(y))) = 0),
c AS (SELECT i, unnest(q) AS v, generate_subscripts(q, 1) - 1 AS place, len(q) // 8 AS w FROM kept), x AS MATERIALIZED (SELECT i, place // w AS p, place % w AS j, v FROM c),
b0 AS MATERIALIZED (SELECT p, i - 1 AS e, j, v FROM x WHERE i <= 16), {", ".join(rounds)},
r AS (SELECT i, string_agg(format('{{:02x}}', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a6 GROUP BY i),
h AS (SELECT sha256(string_agg(v::VARCHAR, ',' ORDER BY p, e, j)) AS h FROM b6)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, h AS codebooks_sha256 FROM r JOIN kept USING (i), h"""


def _repair_sql() -> str:
    """Least (cost, letters) of each grammar state row by row, each as one string that sorts as such a pair does."""

    def paid(value: str, cost: str, letter: str) -> str:
        return f"lpad((CAST(left({value}, 9) AS BIGINT) + {cost})::VARCHAR, 9, '0') || substr({value}, 10) || '{letter}'"

    def put_in(s: str) -> str:  # place most two insertions in a row can pay
        one = f"SELECT * REPLACE (least(s2, {paid('s0', '3', 'I')}, {paid('s1', '3', 'I')}, {paid('s3', '3', 'I')}) AS s2, least(s3, {paid('s2', '3', 'I')}) AS s3) FROM ({s})"
        return f"SELECT * REPLACE (least(s2, {paid('s0', '3', 'I')}, {paid('s1', '3', 'I')}, {paid('s3', '3', 'I')}) AS s2, least(s3, {paid('s2', '3', 'I')}) AS s3) FROM ({one})"

    stay = "CASE WHEN x.fault = 'truncated' THEN 3 ELSE 0 END"
    may = "x.fault IN ('blank', 'duplicate')"

    def kept(value: str, initial: str) -> str:
        return f"CASE WHEN NOT {may} AND x.initial = '{initial}' THEN {paid(value, stay, 'K')} END"

    def turned(value: str) -> str:
        return f"CASE WHEN NOT {may} THEN {paid(value, f'3 + {stay}', 'R')} END"

    to_user = ", ".join(f"{kept(f'q.s{k}', 'u')}, {turned(f'q.s{k}')}" for k in (0, 1, 3))
    step = f"""SELECT q.c, q.i + 1 AS i, {paid('q.s0', '4', 'D')} AS s0, least({paid('q.s1', '4', 'D')}, {kept('q.s0', 's')}) AS s1,
least({paid('q.s2', '4', 'D')}, {to_user}) AS s2, least({paid('q.s3', '4', 'D')}, {kept('q.s2', 'a')}, {turned('q.s2')}) AS s3
FROM ({put_in('SELECT * FROM steps')}) q JOIN items x ON x.c = q.c AND x.i = q.i + 1"""
    fault = "((SELECT list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(k, ''), lambda ch: ascii(ch)::UBIGINT)), lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[]), lambda y, z: CASE WHEN y % 2 = 1 THEN xor(y >> 1, 3988292384::UBIGINT) ELSE y >> 1 END))))"
    return rf"""WITH RECURSIVE keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
faulty AS (SELECT *, xor({fault}, 4294967295::UBIGINT) % 20 AS f FROM keyed),
rows_ AS (SELECT coalesce(conv_id::VARCHAR, '') AS c, turn, CASE f WHEN 4 THEN 'user' ELSE role END AS role, CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(range(CASE f WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM faulty WHERE f <> 0),
numbered AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, text, copy) AS i, row_number() OVER (PARTITION BY c, role, text ORDER BY turn NULLS FIRST, copy) AS seen, left(role, 1) AS initial FROM rows_),
items AS MATERIALIZED (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN seen > 1 THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault FROM numbered),
steps(c, i, s0, s1, s2, s3) AS (SELECT DISTINCT c, 0, '000000000', '900000000', '900000000', '900000000' FROM items UNION ALL {step}),
ends AS (SELECT c, least(s0, s3) AS best FROM ({put_in('SELECT * FROM steps')}) z WHERE i = (SELECT count(*) FROM items x WHERE x.c = z.c)),
walk(c, best, place, i, state, line) AS (SELECT c, best, 10, 0, 0, NULL::VARCHAR FROM ends UNION ALL
  SELECT w.c, w.best, w.place + 1, CASE WHEN l = 'I' THEN w.i ELSE w.i + 1 END,
    CASE WHEN l = 'D' THEN state WHEN l = 'K' THEN CASE x.initial WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END WHEN state = 2 THEN 3 ELSE 2 END,
    CASE WHEN l = 'D' THEN NULL WHEN l = 'K' THEN x.role || ':' || x.text ELSE CASE WHEN state = 2 THEN 'assistant:' ELSE 'user:' END || CASE WHEN l = 'R' THEN x.text ELSE '' END END
  FROM (SELECT *, substr(best, place, 1) AS l FROM walk WHERE place <= len(best)) w LEFT JOIN items x ON x.c = w.c AND x.i = w.i + 1),
lines AS (SELECT c, sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (line IS NOT NULL), '')) AS h FROM walk GROUP BY c),
pairs AS (SELECT c, initial, lag(initial) OVER (PARTITION BY c ORDER BY i) AS before FROM items),
wrong AS (SELECT c, count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM pairs GROUP BY c),
counts AS (SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated FROM items GROUP BY c)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
coalesce(CAST(left(best, 9) AS BIGINT), 0) AS cost, coalesce(substr(best, 10), '') AS audit, coalesce(h, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, coalesce(conv_id::VARCHAR, '') AS c FROM conversations) o LEFT JOIN counts USING (c) LEFT JOIN wrong USING (c) LEFT JOIN ends USING (c) LEFT JOIN lines USING (c)"""


_WINDOWS_SQL = """WITH d AS (SELECT doc_id, row_number() OVER () AS r, hex(encode(coalesce(text, ''))) AS x FROM documents),
parts AS (SELECT doc_id, r, s, substr(x, 2 * s + 1, 2098) AS x FROM d, unnest(range(0, len(x) // 2, 1000)) AS u(s)),
windows AS (SELECT doc_id, r, s + k AS place, substr(x, 2 * k + 1, 100) AS w FROM parts, unnest(range(0, least(1000, len(x) // 2 - 49))) AS u(k) WHERE len(x) >= 100),
low AS (SELECT w, min(doc_id) AS low FROM windows GROUP BY w HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT r, place FROM windows JOIN low USING (w) WHERE doc_id > low),
marked AS (SELECT r, place, CASE WHEN place - lag(place) OVER (PARTITION BY r ORDER BY place) <= 50 THEN 0 ELSE 1 END AS new FROM gone),
islands AS (SELECT r, place, sum(new) OVER (PARTITION BY r ORDER BY place) AS g FROM marked), spans AS (SELECT r, g, min(place) AS a, max(place) + 50 AS b FROM islands GROUP BY r, g),
edges AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS before FROM (SELECT r, a, b FROM spans UNION ALL SELECT r, len(x) // 2, NULL FROM d)),
kept AS (SELECT r, string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS k, coalesce(sum(b - a), 0)::BIGINT AS n_removed, count(b) AS n_spans FROM edges JOIN d USING (r) GROUP BY r)
SELECT doc_id, len(x) // 2 AS n_bytes, n_removed, n_spans, sha256(unhex(k)) AS kept_sha256 FROM d JOIN kept USING (r)"""


def oracle_sql() -> dict[str, str]:
    """Links by plain pairs, components by following them; plain rounds, rows and windows."""
    return {
        "op1_minhash_near_dedup": f"""WITH RECURSIVE {_SETS}, n AS (SELECT doc_id AS id, len(s) AS n FROM s), x AS (SELECT doc_id, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n u ON u.id = a JOIN n v ON v.id = b WHERE 100 * i >= 85 * (u.n + v.n - i)), {_REACH}
SELECT n.id AS doc_id, n.n AS n_shingles, min(c) AS component_id, n.id = min(c) AS kept FROM n JOIN r USING (id) GROUP BY n.id, n.n""",
        "op8_embedding_near_dedup": f"""WITH RECURSIVE n AS (SELECT vec_id AS id, CASE WHEN {_FINITE} THEN label END AS label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
l AS (SELECT a.id AS a, b.id AS b FROM n a JOIN n b ON a.label = b.label AND a.id < b.id WHERE list_cosine_similarity(a.v, b.v) >= 0.93), {_REACH}
SELECT n.id AS vec_id, (SELECT count(*) FROM e WHERE e.a = n.id) AS n_links, min(c) AS component_id, n.id = min(c) AS kept FROM n JOIN r USING (id) GROUP BY n.id""",
        "op11_vector_codes": _codes_sql(),
        "op12_conversation_repair": _repair_sql(),
        "op13_suffix_dedup": _WINDOWS_SQL,
    }
