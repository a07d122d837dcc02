"""Near-duplicate vectors within labels by a flat, robust-pruned graph.

Balls first: vectors of one label within BALL of a leader are all linked to each other by the triangle inequality, so
a ball of copies is one node with a weight, found in chunks before anything is shuffled and merged in rounds. Leaders
are clustered several times over around pivots drawn anew, so that shards overlap; a shard that is too large is split
again. Each shard builds its robust-pruned adjacency, and a leader's lists are united over its shards. In every shard all
leaders are searched for: from the medoid and their own lists greedily, then expanding through all nodes within range. A
pair is counted, for both its ends, in the first shard that both share. Balls that are certainly linked or certainly not
are decided by leaders and radii; the members of all others are compared exactly.

The audit counts the links of a few vectors by brute force; while the share found is below RECALL, further clusterings are
added. What a clustering separates depends on how many shards there are, so larger labels get more of them.
"""

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import cut
from quarry.llm.components import components
from quarry.llm.vectors import finite_vectors, matrix

CHUNK, SHARD, PIVOTS, DEGREE, ALPHA = 2048, 1200, 48, 24, 1.2
#: Nearest nodes that a search opens besides those in range, in rounds of so many.
GREEDY = (6, 4)
#: Clusterings added at a time and at most; vectors audited; the share of their links to be found.
CLUSTERINGS, MOST, AUDITED, RECALL = 4, 32, 64, 0.95
#: The least members of a ball; members of two balls compared at once.
LEAST, BLOCK = 16, 256
BALLS = "id long, label int, dim int, v array<double>, leader long, n long, radius double"


def _lead(v: np.ndarray, r: np.ndarray, ball: float) -> tuple[np.ndarray, np.ndarray]:
    """Each row's leader (row number), and its distance to it plus its own radius r, at most `ball`."""
    lead, dist = np.full(len(v), -1), np.zeros(len(v))
    gram = v @ v.T
    for i in range(len(v)):
        if lead[i] < 0:
            d = np.sqrt(np.maximum(0, 2 - 2 * gram[i])) + 1e-7 + r
            take = (lead < 0) & (d <= ball)
            lead[take], dist[take] = i, d[take]
            lead[i], dist[i] = i, max(r[i], dist[take & (np.arange(len(v)) != i)].max(initial=0))
    return lead, dist


def _ball_round(rows: DataFrame, ball: float) -> DataFrame:
    """Rows (BALLS columns; n and radius of what each stands for) with the leader found for them in their chunk."""

    def run(batches):
        for b in batches:
            for s in range(0, b.num_rows, CHUNK):
                c = b.slice(s, CHUNK)
                p = c.to_pandas()
                lead = p.id.to_numpy().copy()
                for _, i in p.groupby(["label", "dim"]).indices.items():
                    to, _ = _lead(matrix(p.v.iloc[i]), p.radius.to_numpy()[i], ball)
                    lead[i] = p.id.to_numpy()[i][to]
                yield c.set_column(4, "leader", pa.array(lead))

    return rows.mapInArrow(run, BALLS)


def _code(v: np.ndarray) -> np.ndarray:
    planes = np.random.default_rng(3).standard_normal((v.shape[1], 12))
    return ((v @ planes > 0) * (1 << np.arange(12))).sum(1)


def _balls(unit: DataFrame, ball: float) -> tuple[DataFrame, DataFrame]:
    """(id, leader) of every row, and the leaders (id, label, dim, v, n, radius)."""
    top = unit.select("id", "label", "dim", "v", F.col("id").alias("leader"), F.lit(1).cast("long").alias("n"), F.lit(0.0).alias("radius"))
    of, before = None, None
    while True:
        led = cut(_ball_round(top, ball))
        of = led.select("id", "leader") if of is None else cut(
            of.join(led.select(F.col("id").alias("leader"), F.col("leader").alias("up")), "leader").select("id", F.col("up").alias("leader"))
        )
        head = led.select(F.col("id").alias("leader"), F.col("v").alias("lv"))
        gap = F.sqrt(F.aggregate(F.zip_with("v", "lv", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda a, x: a + x))
        sums = led.join(head, "leader").groupBy("leader").agg(F.sum("n").alias("n"), F.max(gap + F.col("radius")).alias("radius"))
        top = led.filter("id = leader").select("id", "label", "dim", "v").join(sums.withColumnRenamed("leader", "id"), "id")
        top = top.select("id", "label", "dim", "v", F.col("id").alias("leader"), "n", "radius")

        def code(batches):
            for b in batches:
                if b.num_rows:
                    p = b.to_pandas()
                    c = np.zeros(len(p), np.int64)
                    for _, i in p.groupby("dim").indices.items():
                        c[i] = _code(matrix(p.v.iloc[i]))
                    yield b.append_column("code", pa.array(c))

        top = cut(top.mapInArrow(code, BALLS + ", code long"))
        after = top.count()
        if before is not None and after > 0.8 * before or after == 0:
            return of, top.drop("code", "leader")
        before = after
        # ids last, so that equal codes are spread over tasks; neighbours share chunks
        top = top.repartitionByRange("label", "code", "id").sortWithinPartitions("label", "code", "id").drop("code")


def _kept_balls(unit: DataFrame, of: DataFrame, leaders: DataFrame) -> tuple[DataFrame, DataFrame]:
    """As _balls, with balls of fewer than LEAST members dissolved: their vectors are nodes themselves, and pairs of such are
    decided where they are found."""
    small = leaders.filter(F.col("n") < LEAST).select(F.col("id").alias("leader"), F.lit(True).alias("small"))
    of = cut(of.join(small, "leader", "left").select("id", F.when(F.col("small"), F.col("id")).otherwise(F.col("leader")).alias("leader"), F.coalesce("small", F.lit(False)).alias("alone")))
    alone = unit.join(of.filter("alone").select("id"), "id", "left_semi").select("id", "label", "dim", "v", F.lit(1).cast("long").alias("n"), F.lit(0.0).alias("radius"))
    kept = leaders.filter(F.col("n") >= LEAST).select("id", "label", "dim", "v", "n", "radius")
    return of.select("id", "leader"), cut(kept.union(alone))


def _clustered(leaders: DataFrame, seed: int) -> DataFrame:
    """(id, shard): every leader with the shard of one clustering; a shard above SHARD is split by pivots of its own."""
    at = leaders.select("id", "label", "dim", "v").withColumn("shard", F.xxhash64("label", "dim"))
    done, depth = None, 0
    while True:
        at = cut(at)
        sizes = at.groupBy("shard").agg(F.count("*").alias("size"))
        small = at.join(sizes.filter(F.col("size") <= SHARD), "shard", "left_semi").select("id", "shard")
        done = small if done is None else done.union(small)
        large = sizes.filter(F.col("size") > SHARD)
        if depth == 24 or large.isEmpty():
            return done if depth < 24 else done.union(at.join(large, "shard", "left_semi").select("id", "shard"))
        want = F.least(F.lit(PIVOTS), F.ceil(F.col("size") / (SHARD / 2))) / F.col("size")
        order = F.pmod(F.xxhash64("id", F.lit(seed), F.lit(depth)), F.lit(1 << 30)) / (1 << 30)
        drawn = at.join(large, "shard").select("shard", (order < 1.5 * want).alias("in"), F.struct(order.alias("o"), "id", "v").alias("p"))
        # the least is there where chance draws none; a shard that one pivot leaves whole is drawn for again
        pivots = drawn.groupBy("shard").agg(F.slice(F.sort_array(F.collect_list(F.when(F.col("in"), F.col("p")))), 1, PIVOTS).alias("some"), F.min("p").alias("least"))
        pivots = pivots.withColumn("p", F.when(F.size("some") > 0, F.col("some")).otherwise(F.array("least"))).select("shard", F.col("p.id").alias("pid"), F.col("p.v").alias("pv"))

        def deal(batches):
            for b in batches:
                if not b.num_rows:
                    continue
                p = b.to_pandas()
                to = np.zeros(len(p), np.int64)
                for _, i in p.groupby("shard").indices.items():
                    pid = np.asarray(p.pid.iloc[i[0]], np.int64)
                    near = matrix(p.v.iloc[i]) @ matrix(pd.Series(list(p.pv.iloc[i[0]]))).T
                    to[i] = pid[near.argmax(axis=1)]
                yield b.drop_columns(["pid", "pv"]).append_column("pivot", pa.array(to))

        moved = at.join(pivots, "shard").select("id", "label", "dim", "v", "shard", "pid", "pv")
        moved = moved.mapInArrow(deal, "id long, label int, dim int, v array<double>, shard long, pivot long")
        at = moved.withColumn("shard", F.xxhash64("shard", "pivot", F.lit(seed), F.lit(depth))).drop("pivot")
        depth += 1


def _distances(v: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * v @ v.T))


def robust_prune(d: np.ndarray) -> np.ndarray:
    """(n, DEGREE) neighbours of all nodes, -1 where there are fewer, given the distances between them.

    Candidates are the nearest and some drawn at random, nearest first; one is dropped when a kept one is ALPHA times
    closer to it than the node is.
    """
    n = len(d)
    wide = min(n, 3 * DEGREE)
    rows = np.arange(n)[:, None]
    c = np.concatenate([np.argpartition(d, wide - 1, axis=1)[:, :wide], np.random.default_rng(5).integers(0, n, (n, 8))], axis=1)
    dc = d[rows, c]
    order = np.argsort(dc, axis=1, kind="stable")
    c, dc = c[rows, order], dc[rows, order]
    alive, kept = c != rows, np.full((n, DEGREE), -1)
    for k in range(DEGREE):
        at = alive.argmax(axis=1)
        some = alive[rows[:, 0], at]
        if not some.any():
            break
        to = c[rows[:, 0], at]
        kept[some, k] = to[some]
        alive &= (ALPHA * d[to[:, None], c] > dc) & some[:, None]
        alive[rows[:, 0], at] = False
    return kept


def _build(part: pd.DataFrame) -> pd.DataFrame:
    ids = part.id.to_numpy()
    kept = robust_prune(_distances(matrix(part.v)))
    return pd.DataFrame({"id": ids, "out": [ids[x[x >= 0]].tolist() for x in kept]})


def range_search(d: np.ndarray, limit: np.ndarray, out: np.ndarray) -> np.ndarray:
    """(n, n): for every node, those within its limits that a search meets which starts from the medoid and the node itself,
    opens the nearest nodes met so far, and then expands through all nodes in range. out: neighbours, -1 for none."""
    n = len(d)
    seen, opened = np.eye(n, dtype=bool), np.zeros((n, n), bool)
    seen[:, int(d.sum(axis=1).argmin())] = True

    def expand(open_: np.ndarray) -> None:
        q, x = np.nonzero(open_)
        opened[q, x] = True
        for s in range(0, len(q), 1 << 16):
            to = out[x[s : s + (1 << 16)]]
            i, j = np.nonzero(to >= 0)
            seen[q[s + i], to[i, j]] = True

    expand(seen.copy())
    width, rounds = min(GREEDY[0], n - 1), GREEDY[1]
    for _ in range(rounds if n > 1 else 0):
        far = np.where(seen & ~opened, d, np.inf)
        near = np.argpartition(far, width - 1, axis=1)[:, :width]
        open_ = np.zeros((n, n), bool)
        open_[np.arange(n)[:, None], near] = True
        open_ &= np.isfinite(far)
        if not open_.any():
            break
        expand(open_)
    inside = d <= limit
    while (open_ := seen & inside & ~opened).any():
        expand(open_)
    found = seen & inside
    np.fill_diagonal(found, False)
    return found | found.T


def _search(reach: float, threshold: float):
    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("id").reset_index(drop=True)
        v, ids, n, r = matrix(part.v), part.id.to_numpy(), part.n.to_numpy(), part.radius.to_numpy()
        shards, t = np.array(part.shards.tolist(), np.int64).reshape(len(part), -1), int(part.t.iloc[0])
        near, place = v @ v.T, {x: k for k, x in enumerate(ids.tolist())}
        d = np.sqrt(np.maximum(0, 2 - 2 * near))
        lists = [[place[y] for y in x if y in place] for x in part.out]
        for k, x in enumerate(list(map(list, lists))):
            for y in x:
                lists[y].append(k)
        out = np.full((len(ids), max(1, max(map(len, lists)))), -1)
        for k, x in enumerate(lists):
            out[k, : len(x)] = x
        found = np.triu(range_search(d, reach + r[:, None] + r[None], out))
        x, y = np.nonzero(found)
        fresh = ~(shards[x, :t] == shards[y, :t]).any(axis=1)  # else an earlier shard has the pair
        x, y = x[fresh], y[fresh]
        point = (r[x] == 0) & (r[y] == 0)
        sure = np.where(point, near[x, y] >= threshold, d[x, y] + r[x] + r[y] <= reach - 1e-6)
        extra = np.bincount(x[sure], n[y[sure]], len(ids)) + np.bincount(y[sure], n[x[sure]], len(ids))
        parent = np.arange(len(ids))  # a spanning forest of the certain links

        def root(i):
            while parent[i] != i:
                parent[i] = i = parent[parent[i]]
            return i

        links: list[list[int]] = [[] for _ in ids]
        for i, j in zip(x[sure].tolist(), y[sure].tolist()):
            a, b = root(i), root(j)
            if a != b:
                parent[b] = a
                links[i].append(int(ids[j]))
        open_: list[list[int]] = [[] for _ in ids]
        for i, j in zip(x[~sure & ~point].tolist(), y[~sure & ~point].tolist()):
            open_[i].append(int(ids[j]))
        some = np.array([k for k in range(len(ids)) if extra[k] or links[k] or open_[k]], np.int64)
        rows = {"id": ids[some].astype("int64"), "extra": extra[some].astype("int64"), "links": pd.Series([links[k] for k in some], dtype=object), "open": pd.Series([open_[k] for k in some], dtype=object)}
        return pd.DataFrame(rows)

    return run


def _found(leaders: DataFrame, shards: list[DataFrame], done: int, reach: float, threshold: float) -> DataFrame:
    """(id, extra, links, open) from the clusterings from number `done` on."""
    of = None
    for t, s in enumerate(shards):
        s = s.select("id", F.col("shard").alias(f"s{t}"))
        of = s if of is None else of.join(s, "id")
    of = of.select("id", F.array(*[f"s{t}" for t in range(len(shards))]).alias("shards"))
    each = F.explode(F.sequence(F.lit(done), F.lit(len(shards) - 1))).alias("t")
    held = leaders.join(of, "id").select("id", "v", "n", "radius", "shards", each).withColumn("shard", F.element_at("shards", F.col("t") + 1))
    lists = held.select("shard", "t", "id", "v").groupBy("shard", "t").applyInPandas(_build, "id long, out array<long>")
    lists = lists.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("out"))).alias("out"))
    return cut(held.join(lists, "id").groupBy("shard", "t").applyInPandas(_search(reach, threshold), "id long, extra long, links array<long>, open array<long>"))


def _compared(members: DataFrame, leaders: DataFrame, found: DataFrame, threshold: float) -> DataFrame:
    """(id, other, n): for the members of open pairs of balls, the links to the other ball. Blocks of both meet once."""
    pairs = found.select(F.col("id").alias("a"), F.explode("open").alias("b"))
    sizes = lambda c, m: leaders.select(F.col("id").alias(c), F.sequence(F.lit(0), F.ceil(F.col("n") / BLOCK).cast("int") - 1).alias(m))
    pairs = pairs.join(sizes("a", "i"), "a").join(sizes("b", "j"), "b").select("a", "b", F.explode("i").alias("i"), "j").select("a", "b", "i", F.explode("j").alias("j"))
    wanted = pairs.select(F.col("a").alias("leader")).union(pairs.select("b")).distinct()
    dealt = members.join(wanted, "leader", "left_semi").join(leaders.select(F.col("id").alias("leader"), F.ceil(F.col("n") / BLOCK).alias("of")), "leader")
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("id"), F.col("of")).cast("int"))
    blocks = cut(dealt.groupBy("leader", "block").agg(F.collect_list(F.struct("id", "v")).alias("rows")))

    def compare(batches):
        for b in batches:
            for a, c, x, y in zip(*(b.column(k).to_pylist() for k in ("a", "b", "x", "y"))):
                hit = np.array([r["v"] for r in x]) @ np.array([r["v"] for r in y]).T >= threshold
                n = np.concatenate([hit.sum(1), hit.sum(0)])
                ids, other = [r["id"] for r in [*x, *y]], [c] * len(x) + [a] * len(y)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(other, pa.int64()), pa.array(n, pa.int64())], ["id", "other", "n"])

    side = lambda c, k, v: blocks.select(F.col("leader").alias(c), F.col("block").alias(k), F.col("rows").alias(v))
    tried = pairs.join(side("a", "i", "x"), ["a", "i"]).join(side("b", "j", "y"), ["b", "j"]).select("a", "b", "x", "y")
    return cut(tried.mapInArrow(compare, "id long, other long, n long").filter("n > 0"))


def _true_links(unit: DataFrame, threshold: float, audited: int) -> dict[int, int]:
    """The links of about `audited` vectors, by brute force: they are sent along, and every vector is compared with them."""
    n = unit.count()
    chance = F.pmod(F.xxhash64("id", F.lit("audit")), F.lit(1 << 30)) / (1 << 30)
    asked = unit.filter(chance < (audited / n if n else 0)).select("id", "label", "dim", "v").limit(4 * audited).collect()
    if not asked:
        return {}
    ids, kinds = np.array([r["id"] for r in asked]), [(r["label"], r["dim"]) for r in asked]
    by = {k: np.array([i for i, x in enumerate(kinds) if x == k]) for k in set(kinds)}
    q = {k: np.array([asked[i]["v"] for i in i_]) for k, i_ in by.items()}

    def run(batches):
        for b in batches:
            total = np.zeros(len(ids), np.int64)
            p = b.to_pandas()
            for k, i in p.groupby(["label", "dim"]).indices.items():
                if k in by:
                    total[by[k]] += (matrix(p.v.iloc[i]) @ q[k].T >= threshold).sum(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total)], ["id", "n"])

    sums = unit.select("label", "dim", "v").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    return {r["id"]: max(r["n"] - 1, 0) for r in sums.collect()}  # a vector is near itself


def near_duplicate_vectors(table: DataFrame, threshold: float = 0.93) -> DataFrame:
    """(vec_id, n_links, component_id, kept): links by cosine >= threshold between vectors of one non-null label.

    Vectors that are null, zero or hold null or non-finite components, or have a null label, link with nothing and
    stay. Rows that repeat a vec_id count once; rows without one are left out. Vectors of different lengths never link.
    """
    reach = math.sqrt(2 - 2 * threshold)
    rows = cut(finite_vectors(table, "label"))
    unit = cut(_units_of(rows))
    of, leaders = _kept_balls(unit, *_balls(unit, 0.49 * reach))
    members = of.join(unit.select("id", "v"), "id")
    true = _true_links(unit, threshold, AUDITED)
    shards: list[DataFrame] = []
    found = checked = None
    while True:
        done = len(shards)
        shards += [cut(_clustered(leaders, seed)) for seed in range(done, done + CLUSTERINGS)]
        more = _found(leaders, shards, done, reach, threshold)
        more_checked = _compared(members, leaders, more, threshold)
        found, checked = (more, more_checked) if found is None else (found.union(more), checked.union(more_checked))
        extra = found.groupBy(F.col("id").alias("leader")).agg(F.sum("extra").alias("extra"))
        own = checked.groupBy("id").agg(F.sum("n").alias("own"))
        balls = leaders.select(F.col("id").alias("leader"), "n").join(extra, "leader", "left")
        n_links = (F.col("n") - 1 + F.coalesce("extra", F.lit(0)) + F.coalesce("own", F.lit(0))).alias("n_links")
        counted = cut(of.join(balls, "leader").join(own, "id", "left").select("id", "leader", n_links))
        got = {r["id"]: r["n_links"] for r in counted.filter(F.col("id").isin([*true])).collect()} if true else {}
        all_ = sum(true.values())
        if not all_ or sum(min(got.get(i, 0), n) for i, n in true.items()) >= RECALL * all_ or len(shards) >= MOST:
            break
    edges = found.select(F.col("id").alias("a"), F.explode("links").alias("b"))
    named = checked.join(of, "id").select(F.col("leader").alias("a"), F.col("other").alias("b")).distinct()
    groups = components(edges.union(named))
    nodes = counted.join(groups.withColumnRenamed("id", "leader"), "leader", "left").withColumn("node", F.coalesce("component_id", "leader")).drop("component_id")
    least = nodes.groupBy("node").agg(F.min("id").alias("component_id"))
    out = nodes.join(least, "node").select("id", "n_links", "component_id")
    rest = rows.filter("NOT valid OR label IS NULL").select("id", F.lit(0).cast("long"), F.col("id"))
    out = out.union(rest)
    return out.select(F.col("id").alias("vec_id"), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))


def unit_vectors(table: DataFrame) -> DataFrame:
    """(id, label, dim, v) of the vectors that take part, at length 1."""
    return _units_of(finite_vectors(table, "label"))


def _units_of(rows: DataFrame) -> DataFrame:
    live = rows.filter("valid AND label IS NOT NULL").withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))
    unit = F.transform("v", lambda x: x / F.col("norm")).alias("v")
    return live.select("id", F.col("label").cast("int").alias("label"), F.size("v").alias("dim"), unit)


def audit_recall(table: DataFrame, result: DataFrame, threshold: float = 0.93, audited: int = 500) -> float:
    """Share of the links of about `audited` vectors, counted by brute force, that the result counts too."""
    true = _true_links(unit_vectors(table), threshold, audited)
    got = {r["vec_id"]: r["n_links"] for r in result.filter(F.col("vec_id").isin([*true])).collect()}
    return sum(min(got[i], n) for i, n in true.items()) / max(1, sum(true.values())) if any(true.values()) else 1.0
