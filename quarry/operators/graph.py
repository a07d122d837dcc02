"""Trees, chains and time-bounded claims."""

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.lineage import cut
from quarry.operators.ordered import with_previous

MAX_DEPTH = 64
GENESIS = "0" * 64


def closure(spark, nodes: DataFrame, depth: int = MAX_DEPTH) -> DataFrame:
    """(id, ancestor, up) of every node and each of its ancestors, itself at 0; at most `depth` steps up, so cycles end.

    Rounds of joins: after each, ancestors up to twice as far are known.
    """
    links = nodes.filter("parent IS NOT NULL").select("id", F.col("parent").alias("ancestor"), F.lit(1).alias("up"))
    every = nodes.select("id", F.col("id").alias("ancestor"), F.lit(0).alias("up"))
    far = cut(links.join(nodes.select(F.col("id").alias("ancestor")), "ancestor", "left_semi").select("id", "ancestor", "up"))
    done, reach = far, 1
    while reach < depth:
        # paths of exactly `reach` steps go on by any path known
        last = far.filter(F.col("up") == reach)
        if last.isEmpty():
            break
        more = last.select("id", F.col("ancestor").alias("mid"), "up").join(done.select(F.col("id").alias("mid"), "ancestor", F.col("up").alias("further")), "mid")
        far = cut(more.select("id", "ancestor", (F.col("up") + F.col("further")).alias("up")).filter(F.col("up") <= depth))
        done, reach = done.union(far), 2 * reach
    return every.union(done)


def chain_heads(edges: DataFrame, rounds: int = MAX_DEPTH) -> DataFrame:
    """(old_seq, head, hops): where each chain of (old_seq, new_seq) ends, by pointer doubling; loops and backward edges are refused."""
    e = cut(edges.filter("new_seq > old_seq").groupBy("old_seq").agg(F.max("new_seq").alias("head")).withColumn("hops", F.lit(1).cast("long")))
    done = 1
    while done < rounds:
        nxt = e.select(F.col("old_seq").alias("head"), F.col("head").alias("further"), F.col("hops").alias("more"))
        joined = e.join(nxt, "head", "left").withColumn("moved", F.col("further").isNotNull())
        e = cut(joined.select("old_seq", F.coalesce("further", "head").alias("head"), (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops"), "moved"))
        done *= 2
        moved = e.filter("moved").isEmpty()
        e = e.drop("moved")
        if moved:
            break
    return e


def claims_as_of(claims: DataFrame, valid_at: int, known_at: int) -> DataFrame:
    """Claims whose validity holds valid_at, as recorded by known_at: half-open intervals."""
    open_ended = F.col("valid_until").isNull() | (F.col("valid_until") > valid_at)
    return claims.filter((F.col("recorded_at") <= known_at) & (F.col("valid_from") <= valid_at) & open_ended)


def alternatives(claims: DataFrame) -> DataFrame:
    """(subject, n, choices): subjects with different values among the given claims."""
    by = claims.groupBy("subject").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("value")).alias("choices"))
    return by.filter(F.size("choices") > 1)


def event_body():
    """An event's canonical JSON, nulls kept, without its own hash."""
    return F.to_json(F.struct("seq", "ts", "kind", "author", "payload_hash", "prev_hash"), {"ignoreNullFields": "false"})


CHAIN = "chain string, seq long, ts long, kind string, author string, payload_hash string, prev_hash string, entry_hash string"


def build_chain(events: DataFrame, chain: str) -> DataFrame:
    """CHAIN rows, each with the hash of the one before.

    A chain is sequential by nature, so one task goes through it, in order and batch by batch: it holds the last hash, not the rows.
    All that doesn't hang on the hash before is put together where the events are read.
    """
    names = [c.split()[0] for c in CHAIN.split(", ")]

    def run(batches):
        of, prev = None, GENESIS
        for b in batches:
            before, hashes = [], []
            for c, head in zip(b.column("chain").to_pylist(), b.column("head").to_pylist()):
                if c != of:
                    of, prev = c, GENESIS
                before.append(prev)
                prev = hashlib.sha256(f'{head}{prev}"}}'.encode()).hexdigest()
                hashes.append(prev)
            kept = [b.column(c) for c in names[:-2]]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(before, pa.string()), pa.array(hashes, pa.string())], names)

    src = events.select(F.col(chain).cast("string").alias("chain"), "seq", "ts", "kind", "author", F.sha2("payload", 256).alias("payload_hash"))
    whole = src.withColumn("prev_hash", F.lit("")).withColumn("head", event_body())
    src = whole.withColumn("head", F.expr("left(head, length(head) - 2)")).drop("prev_hash")  # up to the place of the hash before
    return src.repartition("chain").sortWithinPartitions("chain", "seq").mapInArrow(run, CHAIN)


def verify_chain(rows: DataFrame) -> DataFrame:
    """(chain, checked, ok, n_bad, first_bad_seq, head): every row is checked by itself against the stored hash before it."""
    return verify_after(rows, None)


def verify_after(rows: DataFrame, anchors: DataFrame | None) -> DataFrame:
    """As verify_chain for the rows after each chain's anchor (chain, anchor: the hash they begin at; else the beginning of all).

    Links are checked in ranges of (chain, seq), so one chain of all rows uses all tasks; only a chain's first row is
    compared with its anchor, when there is one row for each chain.
    """
    linked = with_previous(rows, ["chain", "seq"], ["chain", "entry_hash"])
    first = F.col("before").isNull() | ~F.col("before.chain").eqNullSafe(F.col("chain"))
    forged = F.sha2(event_body(), 256) != F.col("entry_hash")
    bad = forged | (~first & (F.col("before.entry_hash") != F.col("prev_hash")))
    by = linked.withColumn("bad", bad).withColumn("first", first).groupBy("chain").agg(
        F.count("*").alias("checked"), F.count_if("bad").alias("n_bad"), F.min(F.when(F.col("bad"), F.col("seq"))).alias("first_bad_seq"),
        F.max_by("entry_hash", "seq").alias("head"), F.min(F.when(F.col("first"), F.struct("seq", "prev_hash", "bad"))).alias("begin"),
    )
    if anchors is not None:
        by = by.join(anchors, "chain", "left")
    begins = F.lit(GENESIS) if anchors is None else F.coalesce("anchor", F.lit(GENESIS))
    adrift = (F.col("begin.prev_hash") != begins) & ~F.col("begin.bad")
    unlinked = F.col("begin.prev_hash") != begins
    return by.select(
        "chain", "checked", (F.col("n_bad") + adrift.cast("long")).alias("n_bad"), F.when(unlinked, F.col("begin.seq")).otherwise(F.col("first_bad_seq")).alias("first_bad_seq"), "head",
    ).withColumn("ok", F.col("n_bad") == 0)


def overall(verdicts: DataFrame) -> DataFrame:
    """(checked, n_bad, first_bad_chain, first_bad_seq, ok) over all chains: one row, also without any."""
    worst = F.min(F.when(~F.col("ok"), F.struct(F.col("first_bad_seq").alias("seq"), "chain")))
    out = verdicts.agg(F.count("*").alias("chains"), F.coalesce(F.sum("checked"), F.lit(0)).alias("checked"), F.coalesce(F.sum("n_bad"), F.lit(0)).alias("n_bad"), worst.alias("worst"))
    return out.select("chains", "checked", "n_bad", F.col("worst.chain").alias("first_bad_chain"), F.col("worst.seq").alias("first_bad_seq"), (F.col("n_bad") == 0).alias("ok"))
