"""Conversation structure repair: the cheapest edits that make a conversation's roles fit the grammar (s?(ua)+)?.

Cost layers in the manner of Wu and Manber: for each turn a bitset of grammar states, and one such row of bitsets for each
increasing cost; bit s of turn i in layer c says that from state s before turn i the rest can be accepted at cost c. The
first layer in which the start's bit is set gives the cost; following set bits forward, by the least letter each time,
gives the least audit. Turns that must go (blank, repeated) cost the same on every path and stay outside the layers.

Layers are taken over blocks of BLOCK live turns, many blocks at once in numpy. Each block gives a matrix of costs from
state to state; composed from the right, matrices give what the rest costs behind each block, and then the blocks are
traced one by one. So time is linear in the turns of a conversation.

Rows are sorted by ranges of (conversation, turn), not grouped: a conversation of very many turns lies in many
partitions. Only the first and last conversation of a partition can go on in another one, so two matrices a partition,
composed on the driver, join the partitions. The texts of such a conversation are streamed once through one task in order,
since a SHA-256 can't be taken in parts; that task holds its audit letters, the result's own cell, and no texts.
"""

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import cut

BLOCK = 16
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
START, AFTER_SYSTEM, AFTER_USER, AFTER_ASSISTANT = range(4)
USER, ASSISTANT, SYSTEM, OTHER, ABSENT = range(5)
#: What is left to pay behind the last turn: nothing, two insertions, or one.
END = np.array([0, 2 * INSERT, INSERT, 0])
FAR = 1 << 40
#: Bits of the diagonal of four by four states, and of one state in each nibble.
_SAME, _ONE = np.uint16(0x8421), np.uint16(0x1111)
_NEXT = {"u": {START: AFTER_USER, AFTER_SYSTEM: AFTER_USER, AFTER_ASSISTANT: AFTER_USER}, "a": {AFTER_USER: AFTER_ASSISTANT}, "s": {START: AFTER_SYSTEM}}
#: The only role that can be put in at each state.
_FITS = {START: "u", AFTER_SYSTEM: "u", AFTER_USER: "a", AFTER_ASSISTANT: "u"}
_NAMES = {"u": "user", "a": "assistant"}
_INITIALS = {"u": USER, "a": ASSISTANT, "s": SYSTEM}


def _before_user(x):
    y = (x >> 2) & _ONE
    return y | y << 1 | y << 3


def _before_assistant(x):
    return ((x >> 3) & _ONE) << 2


def _before_system(x):
    return (x >> 1) & _ONE


def layers(kinds: np.ndarray, truncated: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Bitsets [cost, turn, block] of the states from which a block's seeds are reached; kinds and truncated are [turn, block].

    Each nibble is a set of states. seeds is [cost, block]. ABSENT turns cost nothing and leave states as they are.
    """
    turns, n = kinds.shape
    most = len(seeds) + DELETE * turns + 2 * INSERT
    out = np.zeros((most, turns + 1, n), np.uint16)
    out[: len(seeds), turns] = seeds
    none = np.zeros(n, np.uint16)
    is_kind = [(kinds == k) * np.uint16(0xFFFF) for k in range(5)]
    cut_off, whole = truncated * np.uint16(0xFFFF), ~truncated * np.uint16(0xFFFF)
    for c in range(most):
        for i in range(turns - 1, -1, -1):
            at = lambda k: out[c - k, i + 1] if c >= k else none  # noqa: B023,E731
            keep = (at(0) & whole[i]) | (at(TRUNCATED) & cut_off[i])
            turned = (at(REROLE) & whole[i]) | (at(REROLE + TRUNCATED) & cut_off[i])
            x = _before_user(keep) & is_kind[USER][i] | _before_assistant(keep) & is_kind[ASSISTANT][i] | _before_system(keep) & is_kind[SYSTEM][i]
            x |= _before_user(turned) | _before_assistant(turned) | at(DELETE)
            x = np.where(kinds[i] == ABSENT, at(0), x)
            if c >= INSERT:
                later = out[c - INSERT, i]
                x |= (_before_user(later) | _before_assistant(later)) & ~is_kind[ABSENT][i]
            out[c, i] = x
    return out


def _padded(blocks: list) -> tuple[np.ndarray, np.ndarray]:
    turns = max(map(len, blocks))
    kinds, truncated = np.full((turns, len(blocks)), ABSENT, np.uint8), np.zeros((turns, len(blocks)), bool)
    for k, b in enumerate(blocks):
        for i, (kind, off) in enumerate(b):
            kinds[i, k], truncated[i, k] = kind, off
    return kinds, truncated


def _by_length(blocks: list, at_once: int = 4096):
    """Indices of blocks of about the same length."""
    order = sorted((len(b) > BLOCK // 4, len(b) > BLOCK // 2, k) for k, b in enumerate(blocks) if b)
    same: dict = {}
    for a, b, k in order:
        same.setdefault((a, b), []).append(k)
    for ks in same.values():
        for s in range(0, len(ks), at_once):
            yield ks[s : s + at_once]


def matrices(blocks: list) -> np.ndarray:
    """Least costs [block, from state, to state]; blocks are lists of (kind, truncated)."""
    out = np.where(np.eye(4, dtype=bool), 0, FAR)[None].repeat(len(blocks), 0)
    for ks in _by_length(blocks):
        kinds, truncated = _padded([blocks[k] for k in ks])
        x = layers(kinds, truncated, np.full((1, len(ks)), _SAME))[:, 0]
        for s in range(4):
            for t in range(4):
                hit = (x >> np.uint16(s + 4 * t)) & np.uint16(1)
                out[ks, s, t] = np.where(hit.any(0), hit.argmax(0), FAR)
    return out


def _then(matrix: np.ndarray, rest: np.ndarray) -> np.ndarray:
    return (matrix + rest).min(1)


def _with_rests(blocks: list, rests: np.ndarray) -> list:
    """The layers [cost, turn] of each block, given what the rest costs behind it from each state."""
    low = rests.min(1)
    out: list = [None] * len(blocks)
    for ks in _by_length(blocks):
        kinds, truncated = _padded([blocks[k] for k in ks])
        behind = rests[ks] - low[ks, None]
        seeds = np.zeros((int(behind[behind < FAR // 2].max()) + 1, len(ks)), np.uint16)
        for s in range(4):
            for c in range(len(seeds)):
                seeds[c] |= (behind[:, s] == c).astype(np.uint16) << np.uint16(s)
        x = layers(kinds, truncated, seeds)
        for j, k in enumerate(ks):
            out[k] = x[:, : len(blocks[k]) + 1, j].tolist() if len(blocks[k]) == len(kinds) else x[:, [*range(len(blocks[k])), len(kinds)], j].tolist()
    return out


class _Repair:
    """One conversation, block by block."""

    def __init__(self, conv_id):
        self.conv_id, self.state, self.audit, self.cost, self.sha, self.first = conv_id, START, [], 0, sha256(), True
        self.blank = self.duplicate = self.truncated = self.illegal = self.distinct = 0
        self.low = self.high = self.turn = self.initial = None

    def _write(self, role: str, text: str) -> None:
        self.sha.update((role + ":" + text if self.first else "\n" + role + ":" + text).encode())
        self.first = False

    def _insert(self) -> None:
        role = _FITS[self.state]
        self._write(_NAMES[role], "")
        self.audit.append("I")
        self.cost += INSERT
        self.state = _NEXT[role][self.state]

    def rows(self, rows: list, layer: list | None) -> None:
        """rows: dicts of one block in order; layer: layers() of its live turns."""
        c = None
        if layer is not None:
            c = next(k for k, x in enumerate(layer) if x[0] >> self.state & 1)
        i = 0
        for r in rows:
            self._count(r)
            if not r["live"]:
                self.audit.append("D" * r["n"])
                self.cost += DELETE * r["n"]
                continue
            pay = TRUNCATED if r["truncated"] else 0
            while True:
                has = lambda cost, turn, state: cost >= 0 and layer[cost][turn] >> state & 1  # noqa: B023,E731
                role = _FITS[self.state]
                if has(c - DELETE, i + 1, self.state):
                    self.audit.append("D")
                    self.cost, c = self.cost + DELETE, c - DELETE
                elif has(c - INSERT, i, _NEXT[role][self.state]):
                    c -= INSERT
                    self._insert()
                    continue
                elif (to := _NEXT.get(r["initial"], {}).get(self.state)) is not None and has(c - pay, i + 1, to):
                    self.audit.append("K")
                    self._write(r["role"], r["text"])
                    self.cost, c, self.state = self.cost + pay, c - pay, to
                else:
                    self.audit.append("R")
                    self._write(_NAMES[role], r["text"])
                    self.cost, c, self.state = self.cost + pay + REROLE, c - pay - REROLE, _NEXT[role][self.state]
                break
            i += 1
            if r["n"] > 1:
                self.audit.append("D" * (r["n"] - 1))
                self.cost += DELETE * (r["n"] - 1)

    def _count(self, r: dict) -> None:
        n = r["n"]
        if r["blank"]:
            self.blank += n
        else:
            self.duplicate += n - r["live"]
            self.truncated += bool(r["live"] and r["truncated"])
        if self.initial is not None:
            self.illegal += self.initial + r["initial"] not in ("su", "ua", "au")
        self.illegal += n - 1
        self.initial = r["initial"]
        if r["turn"] is not None:
            self.distinct += r["turn"] != self.turn
            self.turn = self.high = r["turn"]
            self.low = r["turn"] if self.low is None else self.low

    def done(self) -> dict:
        while self.state in (AFTER_SYSTEM, AFTER_USER):
            self._insert()
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        return {"conv_id": self.conv_id, "gaps": gaps, "blank": self.blank, "duplicate": self.duplicate, "truncated": self.truncated, "illegal": self.illegal,
                "cost": self.cost, "audit": "".join(self.audit), "repaired_sha256": self.sha.hexdigest()}


OUT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def _live(rows: list) -> list:
    return [(_INITIALS.get(r["initial"], OTHER), bool(r["truncated"])) for r in rows if r["live"]]


def _blocks(rows: list) -> list[list]:
    """Rows cut behind every BLOCK live ones."""
    out, n = [[]], 0
    for r in rows:
        if n == BLOCK:
            out.append([])
            n = 0
        out[-1].append(r)
        n += r["live"]
    return out


def _conversations(rows: list) -> list[tuple]:
    """(conv_id, its rows) of neighbouring rows."""
    out: list = []
    for r in rows:
        if not out or out[-1][0] != r["conv_id"]:
            out.append((r["conv_id"], []))
        out[-1][1].append(r)
    return out


def _finish(convs: list[tuple]) -> Iterator[dict]:
    """Results of whole conversations."""
    cut_up = [_blocks(rows) for _, rows in convs]
    lives = [_live(b) for blocks in cut_up for b in blocks]
    costs, rests, k = matrices(lives), np.empty((len(lives), 4), np.int64), 0
    for blocks in cut_up:
        rest = END
        for j in range(k + len(blocks) - 1, k - 1, -1):
            rests[j] = rest
            rest = _then(costs[j], rest)
        k += len(blocks)
    traced, k = _with_rests(lives, rests), 0
    for (conv_id, _), blocks in zip(convs, cut_up):
        one = _Repair(conv_id)
        for b in blocks:
            one.rows(b, traced[k])
            k += 1
        yield one.done()


def _rows(batches) -> list[dict]:
    return [r for b in batches for r in b.to_pylist()]


def _result(rows: list[dict], kind: str, arrow_id) -> pa.RecordBatch:
    types = [arrow_id, *[pa.int64()] * 6, pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in zip(["conv_id", *_COUNTS, "audit", "repaired_sha256"], types)], ["conv_id", *_COUNTS, "audit", "repaired_sha256"])


def _rests_of_partitions(ends: list) -> dict:
    """For each partition: (its first conversation began before, its last goes on, costs behind the last).

    ends has (pid, first conv, last conv, matrix of the first, matrix of the last) of each partition, in order.
    """
    out, rest = {}, END
    for k in range(len(ends) - 1, -1, -1):
        pid, first, last, _, _ = ends[k]
        goes_on = k + 1 < len(ends) and ends[k + 1][1] == last
        if not goes_on:
            rest = END
        else:
            _, then_first, then_last, matrix, _ = ends[k + 1]
            rest = _then(matrix, out[ends[k + 1][0]][2] if then_first == then_last else END)
        out[pid] = (k > 0 and ends[k - 1][2] == first, goes_on, rest)
    return out


def repair(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Per conversation: its faults, the cost and letters of the cheapest edits, and the digest of the repaired turns.

    A row's first fault counts: blank (no word character), duplicate (role and text as in an earlier row), truncated (the
    last word character is none of .!?). Kept rows cost nothing, a new role REROLE, a deletion DELETE (blank and duplicate
    rows must go), an inserted empty turn INSERT, and a truncated row that stays TRUNCATED more. Among cheapest edits the
    letters D, I, K, R decide, the least string first. Null roles and texts count as one space. Rows are taken by turn
    (nulls first), then by role and text; equal rows stand together and all but one are duplicates. A null conv_id is a
    conversation too. Without rows there is no result. Other columns are ignored.
    """
    rows = rows.select(F.col(conv).alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), F.lit(" ")).alias("role"), F.coalesce(F.col(text), F.lit(" ")).alias("text"))
    kind = dict(rows.dtypes)["conv_id"]
    alike = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("n"))
    alike = alike.withColumn("key", F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)))
    # a row is the first of its like if its turn is their least: joined on all four, so a text said very often is no hot key
    heads = alike.groupBy("conv_id", "key").agg(F.min(F.struct("turn")).alias("t")).select(F.col("conv_id").alias("c"), F.col("key").alias("k"), F.col("t.turn").alias("t"), F.lit(True).alias("is_first"))
    marked = alike.join(heads, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("key") == F.col("k")) & F.col("turn").eqNullSafe(F.col("t")), "left")
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    marked = marked.select(
        "conv_id", "turn", "role", "text", F.col("n").cast("long").alias("n"), blank.alias("blank"), (~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")).alias("truncated"),
        F.substring("role", 1, 1).alias("initial"), (~blank & F.col("is_first").isNotNull()).alias("live"),
    )
    keys = ["conv_id", "turn", "role", "text"]
    placed = cut(marked.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("pid", F.spark_partition_id()))
    arrow_id = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]

    def ends(batches):
        rows = _rows(batches)
        if rows:
            convs = _conversations(rows)
            for_both = [convs[0], convs[-1]]
            found = []
            for _, part in for_both:
                whole = np.where(np.eye(4, dtype=bool), 0, FAR)
                for m in matrices([_live(b) for b in _blocks(part)]):
                    whole = np.minimum((whole[:, :, None] + m[None]).min(1), FAR)
                found.append(pa.array([whole.ravel().tolist()], pa.list_(pa.int64())))
            ids = [pa.array([c], arrow_id) for c, _ in for_both]
            yield pa.RecordBatch.from_arrays([pa.array([rows[0]["pid"]], pa.int32()), *ids, *found], ["pid", "head", "tail", "m_head", "m_tail"])

    light = ["conv_id", "pid", "n", "live", "truncated", "initial"]
    found = placed.select(*light).mapInArrow(ends, f"pid int, head {kind}, tail {kind}, m_head array<long>, m_tail array<long>").orderBy("pid").collect()
    joints = _rests_of_partitions([(r.pid, r["head"], r["tail"], np.array(r.m_head).reshape(4, 4), np.array(r.m_tail).reshape(4, 4)) for r in found])

    def whole_ones(batches):
        rows = _rows(batches)
        if rows:
            before, after, _ = joints[rows[0]["pid"]]
            convs = _conversations(rows)
            convs = convs[before and 1 or 0 :]
            convs = convs[:-1] if after and convs else convs
            for s in range(0, len(convs), 2000):
                yield _result(list(_finish(convs[s : s + 2000])), kind, arrow_id)

    def spread(batches):
        """Blocks of conversations that lie in several partitions, each with the costs behind it."""
        rows = _rows(batches)
        if not rows:
            return
        pid = rows[0]["pid"]
        before, after, rest_of_last = joints[pid]
        convs = _conversations(rows)
        for k in sorted({*([0] if before else []), *([len(convs) - 1] if after else [])}):
            blocks = _blocks(convs[k][1])
            rest = rest_of_last if k == len(convs) - 1 else END
            costs, rests = matrices([_live(b) for b in blocks]), []
            for m in costs[::-1]:
                rests.append(rest)
                rest = _then(m, rest)
            for j, (b, r) in enumerate(zip(blocks, rests[::-1])):
                yield pa.RecordBatch.from_pylist([{"conv_id": convs[k][0], "pid": pid, "j": j, "rest": [int(x) for x in r], "rows": [{c: x[c] for c in _FIELDS} for x in b]}], schema=_schema(arrow_id))

    def joined(batches):
        one = None
        for b in batches:
            blocks = b.to_pylist()
            lives = [_live(x["rows"]) for x in blocks]
            for x, layer in zip(blocks, _with_rests(lives, np.array([x["rest"] for x in blocks], np.int64))):
                if one is None or one.conv_id != x["conv_id"]:
                    if one is not None:
                        yield _result([one.done()], kind, arrow_id)
                    one = _Repair(x["conv_id"])
                one.rows(x["rows"], layer)
        if one is not None:
            yield _result([one.done()], kind, arrow_id)

    columns = ["conv_id", "turn", "role", "text", "n", "blank", "truncated", "initial", "live", "pid"]
    out = placed.select(*columns).mapInArrow(whole_ones, f"conv_id {kind}, {OUT}")
    if any(before or after for before, after, _ in joints.values()):
        parts = placed.select(*columns).mapInArrow(spread, f"conv_id {kind}, pid int, j int, rest array<long>, rows array<struct<turn:long,role:string,text:string,n:long,blank:boolean,truncated:boolean,initial:string,live:boolean>>")
        parts = parts.repartition("conv_id").sortWithinPartitions("conv_id", "pid", "j")
        out = out.union(parts.mapInArrow(joined, f"conv_id {kind}, {OUT}"))
    return out


_FIELDS = ["turn", "role", "text", "n", "blank", "truncated", "initial", "live"]


def _schema(arrow_id):
    row = pa.struct([("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("n", pa.int64()), ("blank", pa.bool_()), ("truncated", pa.bool_()), ("initial", pa.string()), ("live", pa.bool_())])
    return pa.schema([("conv_id", arrow_id), ("pid", pa.int32()), ("j", pa.int32()), ("rest", pa.list_(pa.int64())), ("rows", pa.list_(row))])


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with made faults, by crc32(`conv_id:turn`) % 20: 0 drops a row, 1 empties its text, 2 takes out its
    [.!?], 3 repeats it, 4 makes its role user. Nulls count as one space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace(space("text"), "[.!?]", "")).otherwise(space("text"))
    out = rows.select("conv_id", "turn", "role", "text", fault.alias("fault")).filter("fault <> 0")
    out = out.select("conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(space("role")).alias("role"), text.alias("text"), F.when(F.col("fault") == 3, 2).otherwise(1).alias("times"))
    return out.select("conv_id", "turn", "role", "text", F.explode(F.sequence(F.lit(1), "times")).alias("copy")).drop("copy")


def repaired_conversations(rows: DataFrame) -> DataFrame:
    """Every conversation of rows, damaged and repaired; one without rows after the damage has zeros and an empty audit."""
    ids = rows.select(F.col("conv_id").alias("of")).distinct()
    found = repair(damaged(rows))
    out = ids.join(found, F.col("of").eqNullSafe(F.col("conv_id")), "left")
    empty = {"audit": "", "repaired_sha256": sha256().hexdigest()}
    return out.select(F.col("of").alias("conv_id"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in _COUNTS], *[F.coalesce(c, F.lit(v)).alias(c) for c, v in empty.items()])
