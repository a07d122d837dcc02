"""Streams with state of their own: verified chains, rings of latencies, filing by running centroids."""

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quarry.operators import graph

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Samples kept of each operation.
RING = 256


@contextmanager
def state_store(spark: SparkSession):
    """Within it, queries that start keep their state in RocksDB, which state of several variables needs."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


def _sorted(rows: Iterator[pd.DataFrame], by: str) -> pd.DataFrame:
    return pd.concat(list(rows)).sort_values(by, kind="stable")


class _Chains(StatefulProcessor):
    """Each chain's last number and hash between batches."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "seq long, hash string")

    def handleInputRows(self, key, rows, timer):
        seq, head = self.last.get() if self.last.exists() else (None, graph.GENESIS)
        batch = _sorted(rows, "seq")
        before = np.append([head], batch["entry_hash"].to_numpy()[:-1])
        bad = batch["forged"].to_numpy() | (before != batch["prev_hash"].to_numpy())
        if seq is not None:
            bad |= batch["seq"].to_numpy() <= seq  # a chain that begins again
        seqs, head = batch["seq"].to_numpy(), batch["entry_hash"].iloc[-1]
        self.last.update((int(seqs[-1]), head))
        wrong = seqs[bad]
        yield pd.DataFrame({"chain": [key[0]], "since": [seqs[0]], "checked": [len(batch)], "n_bad": [int(bad.sum())], "first_bad_seq": pd.array([wrong[0] if len(wrong) else None], "Int64"), "head": [head]})

    def close(self) -> None:
        pass


def verified(chain_rows: DataFrame) -> DataFrame:
    """(chain, since, checked, n_bad, first_bad_seq, head) of each batch of a stream of chain rows: every row against its own body
    and against the hash before it, be it in this batch or in an earlier one.

    A batch's rows of one chain are held by one task, so a trigger's size bounds them; hashes of bodies are taken before.
    """
    rows = chain_rows.select("chain", "seq", "prev_hash", "entry_hash", (F.sha2(graph.event_body(), 256) != F.col("entry_hash")).alias("forged"))
    return rows.groupBy("chain").transformWithStateInPandas(_Chains(), "chain string, since long, checked long, n_bad long, first_bad_seq long, head string", "Append", "None")


class _Rings(StatefulProcessor):
    """The newest RING samples of an operation, and how many there ever were."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.samples, self.total = handle.getListState("samples", "ms long"), handle.getValueState("total", "n long")

    def handleInputRows(self, key, rows, timer):
        batch = _sorted(rows, "seq")["ms"].tolist()
        n = (self.total.get()[0] if self.total.exists() else 0) + len(batch)
        if len(batch) < RING:
            batch = ([r[0] for r in self.samples.get()] + batch) if n > len(batch) else batch
        kept = batch[-RING:]
        self.samples.put([(int(x),) for x in kept])
        self.total.update((n,))
        ordered = sorted(kept)
        rank = lambda q: ordered[max(1, int(np.ceil(q * len(ordered)))) - 1]
        yield pd.DataFrame({"op": [key[0]], "n": [n], "p50": [rank(0.5)], "p95": [rank(0.95)], "max": [ordered[-1]]})

    def close(self) -> None:
        pass


def latencies(samples: DataFrame) -> DataFrame:
    """(op, n, p50, p95, max) of each batch of a stream (op, seq, ms): nearest ranks over the newest RING samples, n of all."""
    return samples.select("op", "seq", F.col("ms").cast("long").alias("ms")).groupBy("op").transformWithStateInPandas(_Rings(), "op string, n long, p50 long, p95 long, max long", "Update", "None")


class _Filer(StatefulProcessor):
    """Of each class under a root: the sum of its members' unit vectors and their number."""

    def __init__(self, least: float, margin: float):
        self.least, self.margin = least, margin

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.classes = handle.getMapState("classes", "node long", "n long, total array<double>")

    def handleInitialState(self, key, rows, timer):
        for r in rows.itertuples():
            self.classes.updateValue((int(r.node),), (int(r.n), [float(x) for x in r.total]))

    def handleInputRows(self, key, rows, timer):
        nodes = sorted((k[0], v[0], np.array(v[1])) for k, v in self.classes.iterator()) if self.classes.exists() else []
        names, counts = [x[0] for x in nodes], [x[1] for x in nodes]
        totals = np.array([x[2] for x in nodes])
        touched, out = set(), []
        for r in _sorted(rows, "seq").itertuples():
            v = None if r.v is None else np.array(r.v, float)
            length = 0.0 if v is None else float(np.sqrt((v * v).sum()))
            node, top, margin = None, None, None
            if length > 0 and names:
                sizes = np.sqrt((totals * totals).sum(1))
                near = np.round(np.where(sizes > 0, (totals @ v) / np.where(sizes > 0, sizes, 1) / length, 0.0), 9)
                order = np.lexsort((names, -near))
                top, margin = float(near[order[0]]), round(float(near[order[0]] - near[order[1]]), 9) if len(names) > 1 else 1.0
                if top >= self.least and margin >= self.margin:
                    node = names[order[0]]
                    counts[order[0]] += 1
                    totals[order[0]] += v / length
                    touched.add(int(order[0]))
            out.append((r.seq, key[0], node, top, margin))
        for k in touched:
            self.classes.updateValue((names[k],), (counts[k], totals[k].tolist()))
        frame = pd.DataFrame(out, columns=["seq", "root", "node", "score", "margin"])
        yield frame.astype({"node": "Int64", "score": "Float64", "margin": "Float64"})

    def close(self) -> None:
        pass


def filed(items: DataFrame, centroids: DataFrame, least: float, margin: float) -> DataFrame:
    """(seq, root, node, score, margin) of a stream of items (seq, root, v): each goes to the nearest class under its root where that
    is near enough and nearer than the next by a margin, and moves that class's centroid for all that follow it; else node is
    null, the inbox. Items without a vector, or under a root without classes, go to the inbox without a score.

    centroids (root, node, n, total): what is filed already, once for each class. Order matters within a root, so one task takes
    a batch's items of a root in order; roots are independent. What is kept is one vector for each class.
    """
    first = centroids.select("root", "node", "n", "total").groupBy("root")
    schema = "seq long, root long, node long, score double, margin double"
    return items.select("root", "seq", "v").groupBy("root").transformWithStateInPandas(_Filer(least, margin), schema, "Append", "None", initialState=first)
