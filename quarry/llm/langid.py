"""Language identification by a bidirectional gated recurrent network over bytes, written and trained in numpy.

Texts are read in windows of WINDOW bytes, every byte of every text; the network labels each position and a text's
probabilities are the mean over its letter bytes. It is fitted by backpropagation through time on the driver, on at most
SAMPLE_DOCS texts (about equally many of each language, about SAMPLE_WINDOWS windows of each) chosen by hash.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import doc_bucket, string_buffer

WINDOW, HIDDEN, BATCH = 64, 8, 4096
SAMPLE_DOCS, SAMPLE_WINDOWS, EPOCHS, RATE = 1600, 5, 8, 0.02
#: The languages learned at most, and the texts of each in the sample at least.
MOST_LANGS, LEAST_DOCS = 1000, 8
#: Windows read at once.
READ = 16384
#: A small sample is read more often, up to this many steps, and gives more windows of each text.
STEPS = 250
UNKNOWN = "und"

_LETTER = np.zeros(256, np.float32)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1


class Network:
    """Two gated recurrent units (one for each direction) and a softmax over their joint states.

    z = s(Wz[x] + Uz h), r = s(Wr[x] + Ur h), c = a(Wc[x] + r * Uc h), h' = h + z (c - h); s is x / 4 + 1/2, clipped, and
    a is x / (1 + |x|), which cost a fraction of the exponential forms.
    Bytes of padding reset the state. Arrays are (units, windows).
    """

    def __init__(self, n_labels: int, hidden: int = HIDDEN, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.h = hidden
        draw = lambda *shape, by: (rng.standard_normal(shape) * by).astype(np.float32)
        self.p = {}
        for d in "fb":
            self.p["W" + d] = draw(3 * hidden, 256, by=0.5)
            self.p["U" + d] = draw(3 * hidden, hidden, by=hidden**-0.5)
            self.p["V" + d] = draw(n_labels, hidden, by=hidden**-0.5)
        self.p["b"] = np.zeros((n_labels, 1), np.float32)

    def _walk(self, x: np.ndarray, real: np.ndarray, d: str, each) -> None:
        w, u, n = self.p["W" + d], self.p["U" + d], self.h
        h = np.zeros((n, x.shape[1]), np.float32)
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            a, g = np.take(w, x[t], axis=1), u @ h
            raw = a[: 2 * n] + g[: 2 * n]
            gate = np.clip(raw * np.float32(0.25) + np.float32(0.5), 0, 1)
            c = a[2 * n :] + gate[n:] * g[2 * n :]
            c /= 1 + np.abs(c)
            new = h + gate[:n] * (c - h)
            if real is not None:
                new *= real[t]
            each(t, h, raw, gate, g, c, new)
            h = new

    def logits(self, x: np.ndarray, real: np.ndarray | None) -> np.ndarray:
        out = np.empty((len(x), len(self.p["b"]), x.shape[1]), np.float32)
        out[:] = self.p["b"]
        for d in "fb":
            v = self.p["V" + d]

            def add(t, h, raw, gate, g, c, new, v=v):
                out[t] += v @ new

            self._walk(x, real, d, add)
        return out

    def probabilities(self, x: np.ndarray, real: np.ndarray | None) -> np.ndarray:
        """(positions, labels, windows)"""
        e = self.logits(x, real)
        e -= e.max(axis=1, keepdims=True)
        np.exp(e, out=e)
        e /= e.sum(axis=1, keepdims=True)
        return e

    def read(self, x: np.ndarray, real: np.ndarray | None) -> np.ndarray:
        """As probabilities, (positions, windows, labels), laid out for reading large batches."""
        n, (steps, width) = self.h, x.shape
        out = np.empty((steps, width, len(self.p["b"])), np.float32)
        out[:] = self.p["b"].T
        x = x.astype(np.intp)
        for d in "fb":
            w, u = self.p["W" + d].T, self.p["U" + d].T
            wz, wr, wc = (np.ascontiguousarray(w[:, k * n : (k + 1) * n] * (0.25, 0.25, 1)[k] + (0.5, 0.5, 0)[k], np.float32) for k in range(3))
            uz, ur, uc = (np.ascontiguousarray(u[:, k * n : (k + 1) * n] * (0.25, 0.25, 1)[k], np.float32) for k in range(3))
            v = np.ascontiguousarray(self.p["V" + d].T)
            h, z, r, c, g = (np.zeros((width, n), np.float32) for _ in range(5))
            for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
                for gate, wg, ug in ((z, wz, uz), (r, wr, ur)):
                    np.take(wg, x[t], axis=0, out=gate, mode="clip")
                    gate += np.matmul(h, ug, out=g)
                    np.clip(gate, 0, 1, out=gate)
                r *= np.matmul(h, uc, out=g)
                np.take(wc, x[t], axis=0, out=c, mode="clip")
                c += r
                np.abs(c, out=g)
                g += 1
                c /= g
                c -= h
                c *= z
                h += c
                if real is not None:
                    h *= real[t][:, None]
                out[t] += h @ v
        np.exp(np.minimum(out, 80, out=out), out=out)
        out /= out.sum(axis=2, keepdims=True) + np.float32(1e-30)
        return out

    def gradient(self, x: np.ndarray, real: np.ndarray, weight: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy over weighted positions, by backpropagation through time."""
        n = self.h
        p = self.probabilities(x, real)
        p[:, label, np.arange(x.shape[1])] -= 1
        p *= (weight / max(weight.sum(), 1))[:, None]
        out = {k: np.zeros_like(v) for k, v in self.p.items()}
        out["b"] = p.sum(axis=(0, 2))[:, None]
        for d in "fb":
            tape = []
            self._walk(x, real, d, lambda *s: tape.append(s))
            u, v, dh = self.p["U" + d], self.p["V" + d], 0
            byte = np.empty((len(x), 3 * n, x.shape[1]), np.float32)
            for t, h, raw, gate, g, c, new in reversed(tape):
                z, r = gate[:n], gate[n:]
                out["V" + d] += p[t] @ new.T
                dnew = (v.T @ p[t] + dh) * real[t]
                dc = dnew * z * (1 - np.abs(c)) ** 2
                dgate = np.concatenate([dnew * (c - h), dc * g[2 * n :]]) * np.float32(0.25) * (np.abs(raw) < 2)
                da = np.concatenate([dgate, dc])
                dg = np.concatenate([dgate, dc * r])
                out["U" + d] += dg @ h.T
                byte[t] = da
                dh = dnew * (1 - z) + u.T @ dg
            cell = x[:, None].astype(np.int32) + 256 * np.arange(3 * n, dtype=np.int32)[:, None]
            out["W" + d] += np.bincount(cell.ravel(), byte.ravel(), 256 * 3 * n).reshape(3 * n, 256)
        return out

    def fit(self, x: np.ndarray, real: np.ndarray, label: np.ndarray, epochs: int = EPOCHS, seed: int = 5) -> "Network":
        rng, m, s, step = np.random.default_rng(seed), {}, {}, 0
        epochs = max(epochs, STEPS // -(-len(label) // 256))
        total = epochs * -(-len(label) // 256)
        for _ in range(epochs):
            order = rng.permutation(len(label))
            for at in range(0, len(order), 256):
                i = order[at : at + 256]
                xs, rs = x[:, i], real[:, i]
                step += 1
                rate = RATE * min(1, 1.1 - step / total)
                for k, g in self.gradient(xs, rs, rs * _LETTER[xs], label[i]).items():
                    m[k] = 0.9 * m.get(k, 0) + 0.1 * g
                    s[k] = 0.99 * s.get(k, 0) + 0.01 * g * g
                    self.p[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
        return self


def windows(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(WINDOW, n) bytes of the texts' windows, which of them are real, and each text's first window (n + 1 places)."""
    sizes = np.diff(off)
    n = -(-sizes // WINDOW)
    first = np.append(0, np.cumsum(n))
    start = np.repeat(off[:-1] - first[:-1] * WINDOW, n) + np.arange(first[-1]) * WINDOW
    end = np.repeat(off[1:], n)
    at = start[None] + np.arange(WINDOW)[:, None]
    real = at < end[None]
    return np.where(real, buf[np.minimum(at, max(len(buf) - 1, 0))], 0) if len(buf) else np.zeros((WINDOW, 0), np.uint8), real, first


def training_windows(docs: DataFrame, counts: dict[str, int], per_label: int) -> list:
    """[(lang, windows as bytes, the last of a text perhaps shorter)] of about per_label texts of each language, chosen by hash."""
    share = {k: min(1.0, per_label / n) for k, n in counts.items()}
    each = max(1, SAMPLE_DOCS * SAMPLE_WINDOWS // max(1, sum(min(per_label, n) for n in counts.values())))
    chance = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / (1 << 30)
    want = F.element_at(F.create_map(*[F.lit(x) for kv in share.items() for x in kv]), F.col("lang"))

    def run(batches):
        for b in batches:
            out = []
            for t in b.column("text").to_pylist():
                raw = t.encode()
                n = -(-len(raw) // WINDOW)
                pick = np.unique(np.linspace(0, n - 1, min(each, n)).astype(int)) if n else []
                out.append([raw[k * WINDOW : (k + 1) * WINDOW] for k in pick])
            yield pa.RecordBatch.from_arrays([b.column("lang"), pa.array(out, pa.list_(pa.binary()))], ["lang", "windows"])

    rows = docs.filter(chance < want).select("lang", "text").mapInArrow(run, "lang string, windows array<binary>")
    return [(r["lang"], bytes(w)) for r in rows.collect() for w in r["windows"]]


def learn(docs: DataFrame) -> tuple[Network | None, list[str]]:
    """Fit on rows with text and lang whose crc32(doc_id) mod 3 is not 1; without any, there is no network.

    Languages are the MOST_LANGS with the most such rows, each with at least LEAST_DOCS texts in the sample, if it has them.
    """
    docs = docs.filter("text IS NOT NULL AND lang IS NOT NULL").filter(doc_bucket("doc_id", 3) != 1)
    ranked = docs.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGS)
    counts = {r["lang"]: r["n"] for r in ranked.collect()}
    names = sorted(counts)
    got = training_windows(docs, counts, max(LEAST_DOCS, SAMPLE_DOCS // len(names))) if names else []
    got.sort()
    if not got:
        return None, []
    x = np.stack([np.frombuffer(w.ljust(WINDOW, b"\0"), np.uint8) for _, w in got], axis=1)
    real = (np.arange(WINDOW)[:, None] < np.array([len(w) for _, w in got])).astype(np.float32)
    label = np.array([names.index(k) for k, _ in got])
    return Network(len(names)).fit(x, real, label), names


def predict(docs: DataFrame, network: Network | None, names: list[str]) -> DataFrame:
    """(row: all columns of docs but text, text, lang_pred, score).

    lang_pred is `und` with score 0 where text is null or has no letter, or where nothing was learned. Texts are read in
    pieces of READ windows, so a very long one needs no more memory than its bytes and one vector for each window.
    """
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.schema.names if c != "text"]).alias("row")
    text = F.col("text").cast("string")
    held = docs.select(rest, text.alias("text"), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("lettered"))

    def pooled(buf, off):
        """Sums of the probabilities at letter bytes, by text and label."""
        out = np.zeros((len(off) - 1, len(names)))
        sizes = np.diff(off)
        cuts = [(i, a) for i in range(len(sizes)) for a in range(0, int(sizes[i]), READ * WINDOW)]
        at = 0
        while at < len(cuts):  # pieces of texts, as many as make one reading
            part, total = [], 0
            while at < len(cuts) and (not part or total < READ * WINDOW):
                i, a = cuts[at]
                part.append((i, off[i] + a, min(off[i] + a + READ * WINDOW, off[i + 1])))
                total += int(part[-1][2] - part[-1][1])
                at += 1
            bounds = np.append(0, np.cumsum([e - s for _, s, e in part]))
            x, real, first = windows(np.concatenate([buf[s:e] for _, s, e in part]), bounds)
            sums = np.zeros((x.shape[1], len(names)))
            for k in range(0, x.shape[1], BATCH):
                xs, rs = np.ascontiguousarray(x[:, k : k + BATCH]), real[:, k : k + BATCH]
                p = network.read(xs, None if rs.all() else rs.astype(np.float32))
                p *= (rs * _LETTER[xs])[:, :, None]
                sums[k : k + xs.shape[1]] = p.sum(axis=0)
            some = np.diff(first) > 0
            of = np.array([i for i, _, _ in part])[some]
            np.add.at(out, of, np.add.reduceat(sums, first[:-1][some], axis=0) if some.any() else sums[:0])
        return out

    def run(batches):
        for b in batches:
            buf, off = string_buffer(b.column("text"))
            lettered = np.array(b.column("lettered").to_pylist(), bool)
            best, score = np.zeros(b.num_rows, int), np.zeros(b.num_rows)
            if network and len(buf):
                sums = pooled(buf, off)
                best, score = sums.argmax(axis=1), sums.max(axis=1) / np.maximum(sums.sum(axis=1), 1e-9)
            known = lettered & (score > 0)
            pred = [names[k] if ok else UNKNOWN for k, ok in zip(best, known)]
            columns = [b.column("row"), b.column("text"), pa.array(pred, pa.string()), pa.array(np.where(known, np.clip(score, 0, 1), 0.0))]
            yield pa.RecordBatch.from_arrays(columns, ["row", "text", "lang_pred", "score"])

    return held.mapInArrow(run, f"row {held.schema['row'].dataType.simpleString()}, text string, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row of docs (doc_id, text, lang; other columns are ignored).

    held_out: crc32(doc_id) mod 3 is 1, false for a null doc_id (such rows are not learned from either).
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    out = predict(docs.select("doc_id", "text"), *learn(docs)).select("row.doc_id", "lang_pred", "score")
    return out.select("doc_id", F.coalesce(doc_bucket("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")
