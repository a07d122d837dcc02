"""Vector codes, conversation repair and suffix dedup against brute force, with the odd cases of each."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from quarry.llm import codes, suffixes, turns

DATA = "/root/testdata/sf0.001"


# ---- vector codes


def _lloyd(rows):
    """{row index: (code, error)} and the codebooks' digest, by comparing every part with every entry."""
    good = [k for k, (_, v, _) in enumerate(rows) if v and len(v) % 8 == 0 and all(x is not None and np.isfinite(x) for x in v)]
    x = np.floor(np.array([rows[k][1] for k in good], np.float64) * 4096).astype(np.int64)
    first = sorted(range(len(good)), key=lambda j: (rows[good[j]][0] is None, rows[good[j]][0] or 0, rows[good[j]][1]))[:16]
    width, picked, error, books = x.shape[1] // 8, [], np.zeros(len(x), np.int64), []
    for k in range(8):
        p = x[:, k * width : (k + 1) * width]
        book = p[first].copy()
        for r in range(7):
            apart = ((p[:, None] - book[None]) ** 2).sum(2)
            nearest = apart.argmin(1)
            for e in range(len(book)):
                if r < 6 and (nearest == e).any():
                    book[e] = np.floor_divide(p[nearest == e].sum(0), (nearest == e).sum())
        picked.append(nearest)
        error += apart.min(1)
        books.append(book)
    named = ["".join(f"{c:02x}" for c in r) for r in np.stack(picked, 1)]
    return {k: (c, int(e)) for k, c, e in zip(good, named, error)}, hashlib.sha256(",".join(str(v) for b in books for v in b.ravel()).encode()).hexdigest()


def _check_codes(spark, rows):
    schema = "vec_id long, embedding array<float>, label int, code string, error string, id string"
    out = codes.vector_codes(spark.createDataFrame([(*r, "x", "y", "z") for r in rows], schema).repartition(3)).collect()
    want, digest = _lloyd([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], c) for i, v, c in rows])
    assert sorted((r.vec_id or -1, r.code, r.error) for r in out) == sorted((rows[k][0] or -1, *c) for k, c in want.items())
    assert {r.codebooks_sha256 for r in out} == {digest}
    by_label = {}
    for k, (_, e) in want.items():
        by_label[rows[k][2]] = by_label.get(rows[k][2], 0) + e
    labels = {(rows[k][0], *c): by_label[rows[k][2]] for k, c in want.items()}
    assert all(labels[(r.vec_id, r.code, r.error)] == r.label_error for r in out)


def test_vector_codes(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i), rng.normal(size=16).tolist(), int(i % 3) or None) for i in rng.permutation(700)]
    rows += [(None, [0.5] * 16, 1), (3000, None, 1), (3001, [1.0] * 15 + [None], 1), (3002, [float("nan")] * 16, 2), (3003, [float("inf")] + [0.0] * 15, None), (3004, [], 1)]
    _check_codes(spark, rows)


def test_vector_codes_with_ties(spark):
    """Small integers: many equal vectors, equal entries and equal distances; one vector has a third of the rows."""
    rng = np.random.default_rng(2)
    rows = [(i, (rng.integers(-1, 2, 8) / 4096).tolist(), 1) for i in range(600)] + [(600 + i, [1 / 4096] * 8, 2) for i in range(300)]
    _check_codes(spark, rows)
    _check_codes(spark, rows[:5])


def test_vector_codes_odd_shapes(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert codes.vector_codes(spark.createDataFrame([], schema)).count() == 0
    assert codes.vector_codes(spark.createDataFrame([(1, None, 1), (2, [1.0], 1)], schema)).count() == 0
    other = spark.createDataFrame([(1, [0.0] * 8, 1), (2, [1.0] * 16, 1), (3, [4e9] * 8, 1)], schema)
    assert [r.vec_id for r in codes.vector_codes(other).collect()] == [1]  # another length, out of range


def test_filter_assigns_subtrees():
    rng = np.random.default_rng(3)
    points = np.concatenate([rng.integers(0, 9, (500, 3)), rng.integers(1000, 1009, (500, 3))]).astype(np.int32)
    entries = np.array([[4, 4, 4], [1004, 1004, 1004], [4, 4, 4], [9000, 0, 0]])
    tree = codes.Tree(points)
    got, _ = tree.assign(entries)
    assert (got == ((points[:, None].astype(np.int64) - entries) ** 2).sum(2).argmin(1)).all()
    whole = [level for level, nodes, _ in tree.walk(entries) if len(nodes)]
    assert whole == [1]  # both halves go as a whole, the later one of two equal entries to none
    total, count = tree.totals(entries)
    assert count.tolist() == [500, 500, 0, 0] and (total[0] == points[:500].sum(0)).all()


# ---- conversation repair

_SPACE = " \t\n\x0b\x0c\r"
_STEP = {("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3, ("s", 0): 1}


def _least(items):
    """The least (cost, audit) and its lines, by keeping the least one for each grammar state."""
    names = (("u", "user"), ("a", "assistant"))

    def with_insertions(best):
        best = dict(best)
        for _ in range(3):
            for s in list(best):
                for initial, name in names:
                    n = _STEP.get((initial, s))
                    k = (best[s][0] + 3, best[s][1] + "I", (*best[s][2], name + ":"))
                    if n is not None and (n not in best or k[:2] < best[n][:2]):
                        best[n] = k
        return best

    best = {0: (0, "", ())}
    for role, text, fault in items:
        after = {}

        def put(n, k, after=after):
            if n is not None and (n not in after or k[:2] < after[n][:2]):
                after[n] = k

        for s, (cost, audit, lines) in with_insertions(best).items():
            put(s, (cost + 4, audit + "D", lines))
            if fault not in ("blank", "duplicate"):
                more = 3 if fault == "truncated" else 0
                put(_STEP.get((role[:1], s)), (cost + more, audit + "K", (*lines, f"{role}:{text}")))
                for initial, name in names:
                    put(_STEP.get((initial, s)), (cost + more + 3, audit + "R", (*lines, f"{name}:{text}")))
        best = after
    best = with_insertions(best)
    return min(best[s] for s in (0, 3) if s in best)


def _repaired(rows):
    convs = {}
    for conv, turn, role, text in rows:
        kept = convs.setdefault(conv, [])
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        kept += [(turn, "user" if fault == 4 else role, text)] * {0: 0, 3: 2}.get(fault, 1)
    out = {}
    for conv, kept in convs.items():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, items = set(), []
        for _, role, text in kept:
            s = text.strip(_SPACE)
            items.append((role, text, "blank" if not s else "duplicate" if (role, text) in seen else "truncated" if s[-1] not in ".!?" else ""))
            seen.add((role, text))
        count = lambda f: sum(x[2] == f for x in items)  # noqa: B023,E731
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(items, items[1:]))
        cost, audit, lines = _least(items)
        t = {r[0] for r in kept} - {None}
        out[conv] = (max(t) - min(t) + 1 - len(t) if t else 0, count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def _check_repair(spark, rows):
    frame = spark.createDataFrame([(*r, 1, "c") for r in rows], "conv_id long, turn long, role string, text string, n int, cost string").repartition(4)
    got = {r.conv_id: tuple(r)[1:] for r in turns.repaired_conversations(frame).collect()}
    assert got == _repaired(rows)


_TEXTS = ["a.", "b?", "c", " ", "", None, "hello there!", "z. \n", "　", "“Où?” ", "x\x00."]


def test_conversation_repair(spark):
    rng = random.Random(5)
    roles = ["user", "assistant", "system", "tool", "", None, "u", "User", "user", "assistant"]
    rows = [(i // 9, rng.choice([None, *range(12)]), rng.choice(roles), rng.choice([*_TEXTS, f"y{i}.", f"y{i}"])) for i in range(900)]
    rows += [(None, t, "user", "said.") for t in range(5)] + rows[:40] + [(5000, 1, "user", "w" * 300_000)]
    rows += [(c, 7, "user", "gone?") for c in range(6000, 6060)]  # some are dropped as a whole
    _check_repair(spark, rows)


def test_one_conversation_over_many_partitions(spark):
    rng = random.Random(6)
    rows = [(1, t, rng.choice(["user", "assistant", "system", "tool"]), rng.choice([f"t{t}.", f"t{t}", "same.", ""])) for t in range(3000)]
    rows += [(2, t, "user", "again and again.") for t in range(400)] + [(3, 0, "user", "one row."), (0, 0, "system", "s.")]
    _check_repair(spark, rows)


def test_conversation_repair_of_nothing(spark):
    frame = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert turns.repaired_conversations(frame).count() == 0


def test_layers_agree_with_least_costs():
    """First layers of random blocks are the least costs from state to state."""
    rng = random.Random(7)
    letters = {turns.USER: "user", turns.ASSISTANT: "assistant", turns.SYSTEM: "system", turns.OTHER: "x"}
    blocks = [[(rng.randrange(4), rng.random() < 0.3) for _ in range(rng.randrange(1, turns.BLOCK + 1))] for _ in range(200)]
    costs = turns.matrices(blocks)
    for b, m in zip(blocks, costs):
        want, _, _ = _least([(letters[k], f"{i}.", "truncated" if off else "") for i, (k, off) in enumerate(b)])
        assert (m[turns.START] + turns.END).min() == want


# ---- suffix dedup


def _removed(rows, size=50):
    low, out = {}, []
    texts = [(i, (t or "").encode()) for i, t in rows]
    for i, b in texts:
        for k in range(len(b) - size + 1 if i is not None else 0):
            low[b[k : k + size]] = min(i, low.get(b[k : k + size], i))
    for i, b in texts:
        gone = bytearray(len(b))
        for k in range(len(b) - size + 1 if i is not None else 0):
            if low[b[k : k + size]] < i:
                gone[k : k + size] = b"\1" * size
        runs = len(re.findall(b"\1+", bytes(gone)))
        out.append((i, len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return out


def _order(rows):
    return sorted(rows, key=str)


@pytest.mark.parametrize("block, size", [(2 << 20, 50), (3000, 50), (2000, 64)])
def test_suffix_dedup(spark, monkeypatch, block, size):
    """Passages around the threshold out of one text, junk, periodic texts, copies, repeated and null ids; in one block and in many."""
    monkeypatch.setattr(suffixes, "LEAST_BLOCK", block)
    rng = random.Random(block)
    base, rows = "".join(rng.choice("abcd é—") for _ in range(4000)), []
    for i in range(250):
        parts = []
        for _ in range(rng.randrange(9)):
            a, n = rng.randrange(3900), rng.choice([10, 40, 49, 50, 51, 60, 64, 200])
            parts.append(base[a : a + n] if rng.random() < 0.6 else "".join(rng.choice("xyzw") for _ in range(n)))
        rows.append((rng.choice([None, i, i, i, 7, -i]), "".join(parts) if i % 30 else None))
    rows += [(1000 + i, "ab" * rng.randrange(10, 200)) for i in range(15)] + [(2000, base), (1999, base), (2001, "q" * 300_000), (2002, "q" * 20), (1500, "q" * 300), (2003, "")] + rows[:5]
    docs = spark.createDataFrame([(*r, 1, "s", "k") for r in rows], "doc_id long, text string, n_bytes int, spans string, blk string").repartition(3)
    assert _order(tuple(r) for r in suffixes.repeated_bytes(docs, size).collect()) == _order(_removed(rows, size))


def test_suffix_dedup_spans(spark):
    shared = "".join(chr(97 + k * k % 23) for k in range(80))
    docs = spark.createDataFrame([(1, "x" + shared + "y"), (2, "zé" + shared), (3, shared[:49]), (4, None)], "doc_id long, text string")
    got = {r.doc_id: ([tuple(s) for s in r.spans], bytes(r.kept)) for r in suffixes.remove_repeats(docs).collect()}
    assert got == {1: ([], b"x" + shared.encode() + b"y"), 2: ([(3, 83)], "zé".encode()), 3: ([], shared[:49].encode()), 4: ([], b"")}
    assert suffixes.repeated_bytes(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        suffixes.remove_repeats(docs, 30)


def test_common_line_in_many_contexts(spark, monkeypatch):
    """One line in all documents, between different words: its first digit has as many contexts as documents."""
    monkeypatch.setattr(suffixes, "LEAST_BLOCK", 4000)
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(30))
    line = "this very same line of some seventy bytes stands in each of the documents"
    rows = [(i, word() + line + word()) for i in range(300)]
    got = {r.doc_id: r.n_removed for r in suffixes.repeated_bytes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got[0] == 0 and all(got[i] >= len(line) for i in range(1, 300))
    assert sorted(got.items()) == sorted((r[0], r[2]) for r in _removed(rows))


def test_registered_forms(spark):
    from quarry.llm import queries

    for name, rows in (("op11_vector_codes", 500), ("op12_conversation_repair", 20), ("op13_suffix_dedup", 200)):
        assert queries.queries()[name](spark, DATA).count() == rows


# ---- secrets in texts with very many matches


def test_secrets_of_one_rich_text(spark):
    """Positions are taken in chunks: spans, overlaps and marks at all places around a chunk's and a piece's ends."""
    from quarry.llm import secrets

    rng = random.Random(8)
    words = lambda: rng.choice(["token=abcdef12", "secret: 'zz", "é🙂 " * rng.randrange(200), "password = " + "f" * rng.randrange(20, 40), "0123456789abcdef" * 2 + " ", "AKIA" + "Q" * 20 + " ", "x "])
    texts = ["".join(words() for _ in range(n)) for n in (0, 1, 127, 128, 129, 700, 3000)] + ["token=1234567 " * 20_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    patterns = [(secrets.ASSIGN, 6, 2), (secrets.ACCESS, 20, 0), (secrets.HEX, 0, 0)]
    got = {r.doc_id: r for r in secrets.scan(docs).collect()}
    clean = {r.doc_id: r.text for r in secrets.redact(docs).collect()}
    for k, t in enumerate(texts):
        spans, kinds = [], []
        for kind, (pattern, least, group) in zip(secrets.KINDS, patterns):
            found = [m.span() for m in re.finditer(pattern, t) if len(m.group(group)) >= least]
            kinds.append(len(found))
            spans += [(a, secrets.KINDS.index(kind), b) for a, b in found]
        assert (got[k].n_assign, got[k].n_access, got[k].n_hex) == tuple(kinds), k
        spans.sort()
        assert got[k].base_sha256 == hashlib.sha256(",".join(f"{secrets.KINDS[c]}:{a}:{b}" for a, c, b in spans).encode()).hexdigest()
        if re.search(f"{secrets.OPAQUE}|{secrets.ENDPOINT}", t):
            continue
        out, at = [], 0
        for a, b, c in sorted((a, b, c) for a, c, b in spans):
            if a >= at:
                out += [t[at:a], f"[SECRET:{secrets.KINDS[c]}]"]
            at = max(at, b)
        assert clean[k] == "".join(out) + t[at:], k


# ---- pre-tokens of overlapping chunks


def test_stitched_chunks():
    from quarry.llm import bpe

    rng = random.Random(11)
    bits = ["'", "s", "ll", " ", "  ", "\n", "a", "é", "1", "!", "中", " ", "　", "🙂", "\r\n", "word", "'re", " " * 90, "x" * 70]
    for size, overlap in ((16, 8), (64, 16), (50, 256)):
        texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(150))).encode() for _ in range(300)] + [b"", "🙂".encode() * 80]
        buf = np.frombuffer(b"".join(texts), np.uint8)
        off = np.append(0, np.cumsum([len(t) for t in texts]))
        assert bpe.stitched_starts(buf, off, size, overlap).tolist() == bpe.pretoken_starts(buf, off).tolist()
