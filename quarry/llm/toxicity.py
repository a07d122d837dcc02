"""Toxicity by a weighted finite-state grammar over clauses.

Words are mapped to classes (insult, threat, target, negation, report, other). Small deterministic transducers follow
negation, reported speech and targets through a clause; their product reads each clause that holds an insult or threat
once, and weighs every match by the joint state it is met in. A text's score is a logistic function of its clauses.
Insults are word beginnings learned from labelled texts, threats and the closed classes are listed below.
"""

import math
import re
from collections import defaultdict

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import doc_bucket

#: The fit reads at most about this many labelled texts, none longer than SAMPLE_CHARS.
SAMPLE_ROWS, SAMPLE_CHARS = 6000, 20_000
#: A learned insult begins words in at least this many different contexts of toxic texts, at this precision.
CONTEXTS, PRECISION, SHORTEST, LONGEST = 6, 0.9, 4, 10
THRESHOLD = 0.3

TARGETS = set("you your yours u he him his she her they them their this that those tu te vous toi du dich euch sie ihr usted ustedes él ella".split())
NEGATIONS = set("not no never isn't aren't wasn't don't doesn't hardly pas jamais nicht kein keine nie nunca jamás tampoco".split())
REPORTS = set("said says say wrote writes called calls claimed claims quoted quote reported according dit écrit sagte sagt schrieb dijo dice".split())
THREATS = ["kill", "murder", "strangle", "stab you", "shoot you", "hurt you", "beat you", "burn you", "drop dead", "destroy you"]

_WORD = re.compile(r"\w+(?:'\w+)?|[\"“”«»]")
_CLAUSE_END = re.compile(r"[.!?;\n]")

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, QUOTE = range(7)


def compose() -> tuple[np.ndarray, np.ndarray]:
    """(next state, multiplier) by state and class of the product of the negation, report and target transducers.

    State: words of negation left (0-3) + 4 * reported + 8 * target seen + 16 * inside quotes.
    """
    step, weight = np.zeros((32, 7), int), np.zeros((32, 7))
    for s in range(32):
        neg, rep, tgt, quo = s % 4, s // 4 % 2, s // 8 % 2, s // 16
        for c in range(7):
            n = 3 if c == NEGATION else max(neg - 1, 0)
            r, t, q = rep or c == REPORT, tgt or c == TARGET, quo ^ (c == QUOTE)
            step[s, c] = n + 4 * r + 8 * t + 16 * q
            if c in (INSULT, THREAT):
                base = 1.0 if c == INSULT or tgt else 0.5
                weight[s, c] = base * (0.3 if neg else 1) * (0.5 if rep or quo else 1) * (1.25 if tgt else 1)
    return step, weight


STEP, WEIGHT = compose()


class Grammar:
    def __init__(self, insults: dict[str, float]):
        self.insults = insults
        self.finder = ahocorasick.Automaton()
        for w in [*insults, *THREATS]:
            self.finder.add_word(w, w)
        self.finder.make_automaton()
        self.threats = {w for w in THREATS}

    def clauses(self, text: str | None) -> list[tuple[int, int, float]]:
        """(start, end, weight) of the matched clauses of a text, in characters of its lower case."""
        text = (text or "").lower()
        hits: dict[int, tuple[int, float]] = {}
        for end, w in self.finder.iter(text):
            start = end + 1 - len(w)
            if start and (text[start - 1].isalnum() or text[start - 1] == "_"):
                continue
            if w in self.threats and end + 1 < len(text) and text[end + 1].isalnum():
                continue
            kind = (INSULT, self.insults[w]) if w in self.insults else (THREAT, 1.0)
            if kind[1] > hits.get(start, (0, -1.0))[1]:
                hits[start] = kind
        out, done = [], 0
        for at in sorted(hits):
            if at < done:
                continue
            begin = max(text.rfind(c, done, at) for c in ".!?;\n") + 1 or done
            m = _CLAUSE_END.search(text, at)
            done = m.end() if m else len(text)
            out.append((begin, done, self.weigh(text, begin, done, hits)))
        return out

    def weigh(self, text: str, begin: int, end: int, hits: dict[int, tuple[int, float]]) -> float:
        state, total = 0, 0.0
        for m in _WORD.finditer(text, begin, end):
            w = m[0]
            c, by = hits.get(m.start(), (OTHER, 0.0))
            if c == OTHER:
                c = TARGET if w in TARGETS else NEGATION if w in NEGATIONS else REPORT if w in REPORTS else QUOTE if w in "\"“”«»" else OTHER
            total += by * WEIGHT[state, c]
            state = STEP[state, c]
        return total

    def features(self, text: str | None) -> tuple[float, float, float]:
        w = [x for _, _, x in self.clauses(text)]
        return (math.log1p(sum(w)), max(w, default=0.0), float(bool(w)))


def learn_insults(rows: list[tuple[str, int]]) -> dict[str, float]:
    """Weights of the word beginnings that mark toxic texts. Contexts (both neighbours) are counted, so that copies count once."""
    seen: tuple[dict, dict] = (defaultdict(set), defaultdict(set))
    clean, toxic = [t for t, y in rows if y != 1], [t for t, y in rows if y == 1]
    wanted: set[str] = set()
    for y, texts in ((1, toxic), (0, clean)):
        for text in texts:
            w = [x for x in _WORD.findall(text.lower())]
            for i, x in enumerate(w):
                if len(x) < SHORTEST or y == 0 and x[:SHORTEST] not in wanted:
                    continue
                context = hash((w[i - 1] if i else "", w[i + 1] if i + 1 < len(w) else ""))
                for n in range(SHORTEST, min(len(x), LONGEST) + 1):
                    seen[y][x[:n]].add(context)
        if y == 1:
            wanted = {k for k, v in seen[1].items() if len(k) == SHORTEST and len(v) >= CONTEXTS}
    out: dict[str, float] = {}
    by_start = defaultdict(list)
    for k in sorted(seen[1]):
        by_start[k[:SHORTEST]].append(k)
    for k in sorted(seen[1], key=lambda k: (len(k), k)):
        t, c = len(seen[1][k]), len(seen[0].get(k, ()))
        if t >= CONTEXTS and t >= PRECISION * (t + c) and not any(w.startswith(k) or k.startswith(w) for w in out):
            while longer := [w for w in by_start[k[:SHORTEST]] if len(w) == len(k) + 1 and w.startswith(k) and len(seen[1][w]) >= 0.98 * t]:
                k = longer[0]  # all toxic words go on alike, so the longer beginning says the same more safely
            c = len(seen[0].get(k, ()))
            lift = math.log((t + 0.5) / (len(toxic) + 1)) - math.log((c + 0.5) / (len(clean) + 1))
            out[k] = min(max(lift, 0.0), 6.0) / 6.0
    return out


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.5) -> np.ndarray:
    """Weights with the intercept last, by Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    w, keep = np.zeros(x.shape[1]), ridge * np.diag([*np.ones(x.shape[1] - 1), 0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + keep + 1e-6 * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - keep @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def learn(docs: DataFrame, labels: DataFrame) -> tuple[Grammar, np.ndarray]:
    """Fit on labelled rows whose crc32(doc_id) mod 4 is not 2; without any, every score is 0."""
    rows = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").filter(doc_bucket("doc_id", 4) != 2)
    n = rows.count()
    chance = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / (1 << 30)
    picked = rows.filter(chance < (SAMPLE_ROWS / n if n else 0)).select(F.col("doc_id").cast("long").alias("doc_id"), "toxic").limit(2 * SAMPLE_ROWS)
    # bounded by SAMPLE_ROWS, hence the broadcast
    texts = docs.filter((F.length("text") <= SAMPLE_CHARS) & F.col("text").isNotNull())
    got = sorted((r["text"], int(r["toxic"] == 1)) for r in texts.join(F.broadcast(picked), "doc_id").select("text", "toxic").collect())
    if not any(y for _, y in got) or all(y for _, y in got):
        return Grammar({}), np.array([0, 0, 0, 30.0 if got and got[0][1] else -30.0])
    # words are learned from one half and weighed on the other, and the other way round
    half = [[r for k, r in enumerate(got) if k % 2 == j] for j in (0, 1)]
    x, y = [], []
    for j in (0, 1):
        g = Grammar(learn_insults(half[1 - j]))
        x += [g.features(t) for t, _ in half[j]]
        y += [v for _, v in half[j]]
    return Grammar(learn_insults(got)), fit_logistic(np.array(x), np.array(y, float))


def score_texts(docs: DataFrame, grammar: Grammar, weights: np.ndarray) -> DataFrame:
    """(doc_id, score, clauses array<struct<start, end, weight>>) of docs (doc_id, text)."""
    insults = dict(grammar.insults)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("weight", pa.float64())]))

    def run(batches):
        g = Grammar(insults)
        for b in batches:
            found = [g.clauses(t) for t in b.column("text").to_pylist()]
            x = np.array([(math.log1p(sum(w := [c[2] for c in f])), max(w, default=0.0), float(bool(w)), 1.0) for f in found]).reshape(-1, 4)
            score = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
            spans = [[{"start": a, "end": e, "weight": float(w)} for a, e, w in f] for f in found]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(score), pa.array(spans, kind)], ["doc_id", "score", "clauses"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, clauses array<struct<start:long,end:long,weight:double>>")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs (doc_id, text; other columns are ignored).

    Null and empty texts have no clauses and get the score of such. held_out: crc32(doc_id) mod 4 is 2, false for a null doc_id.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = score_texts(docs, *learn(docs, labels))
    held = F.coalesce(doc_bucket("doc_id", 4) == 2, F.lit(False)).alias("held_out")
    return out.select("doc_id", held, "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
