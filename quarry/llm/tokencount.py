"""Token counts by a compiled finite-state transducer.

The pre-tokenizer is compiled to a deterministic transducer over character symbols (class, what follows, possible
contraction). A text is cut into chunks of CHUNK characters; each chunk's map from any entry state to its exit state
is made for all chunks side by side, the maps are composed by a parallel prefix scan, and a second pass from the now
known entry states marks the transitions that open a pre-token. Inside a pre-token the transducer of transducer.py is
compiled from the vocabulary's merges: each of its transitions is annotated with the change of the token count, and a
pre-token's count is the sum of what it emits. Distinct pre-tokens are run once and remembered.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quarry.llm.bpe import BLANK, CHUNK_CHARS, SPACE, char_facts, code_points, encoded, vocabulary
from quarry.llm.common import blocks, string_buffer

CHUNK = 256
#: States: the class of the last character (0-4), before any text (5), one or two contraction letters to come (6, 7), contraction over (8).
N_STATES, BEGIN, ONE, TWO, OVER = 9, 5, 6, 7, 8


def compile_transducer() -> tuple[np.ndarray, np.ndarray]:
    """(next state, opens a pre-token) by symbol and state. Symbol: class + 5 * follows + 10 * reach + 30 * new text."""
    step, opens = np.zeros((60, N_STATES), np.uint8), np.zeros((60, N_STATES), bool)
    for symbol in range(60):
        cls, follows, reach, new = symbol % 5, symbol // 5 % 2, symbol // 10 % 3, symbol // 30
        for state in range(N_STATES):
            s = BEGIN if new else state
            if s in (ONE, TWO):  # the contraction's letters stay in its pre-token
                step[symbol, state] = ONE if s == TWO else OVER
                continue
            before = cls if s == cls and s != OVER else s
            if cls >= SPACE:
                start = bool(follows) or before not in (SPACE, BLANK)
            else:
                start = s != cls and s != BLANK
            opens[symbol, state] = start or s == BEGIN
            step[symbol, state] = {0: cls, 1: ONE, 2: TWO}[reach] if start and reach else cls
    return step, opens


STEP, OPENS = compile_transducer()


def scan(symbols: np.ndarray) -> np.ndarray:
    """Which symbols open a pre-token, by composing the chunks' state maps."""
    n = len(symbols)
    k = -(-n // CHUNK)
    grid = np.zeros(k * CHUNK, np.uint8)
    grid[:n] = symbols
    grid = grid.reshape(k, CHUNK).T.astype(np.intp)
    flat = STEP.astype(np.intp).ravel()
    rows = np.ascontiguousarray(grid * N_STATES)
    maps = np.broadcast_to(np.arange(N_STATES, dtype=np.intp), (k, N_STATES)).copy()
    for j in range(CHUNK):
        maps = flat[rows[j][:, None] + maps]
    d = 1
    while d < k:  # inclusive scan: map of chunks 0..i, the earlier part applied first
        maps = np.concatenate([maps[:d], np.take_along_axis(maps[d:], maps[:-d], axis=1)])
        d *= 2
    state = np.empty(k, np.intp)
    state[0], state[1:] = BEGIN, maps[:-1, BEGIN]
    out, emits = np.empty((CHUNK, k), bool), OPENS.ravel()
    for j in range(CHUNK):
        at = rows[j] + state
        out[j] = emits[at]
        state = flat[at]
    return out.T.ravel()[:n]


def symbols_of(cp: np.ndarray, new: np.ndarray) -> np.ndarray:
    cls, follows, reach = char_facts(cp, new)
    return cls + 5 * follows.astype(np.uint8) + 10 * reach + 30 * new.astype(np.uint8)


def count_block(v, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Tokens of each text of a buffer: the sums of what its pre-tokens' transitions emit."""
    n = np.zeros(len(off) - 1, np.int64)
    if len(buf):
        cp, at = code_points(buf)
        new = np.zeros(len(cp), bool)
        new[np.searchsorted(at, np.unique(off[:-1][off[1:] > off[:-1]]))] = True
        starts = at[scan(symbols_of(cp, new))]
        slots = v.counted.slots_of(buf, starts)
        total = np.append(0, np.cumsum(v.counted.n[slots], dtype=np.int64))
        n = np.diff(total[np.searchsorted(starts, off)])
    return n


def count_column(column: pa.Array, path: str) -> np.ndarray:
    v, n = vocabulary(path), []
    buf, off = string_buffer(column)
    for s, e in blocks(off):
        part, at = buf[off[s] : off[e]], off[s : e + 1] - off[s]
        data = part.tobytes() if v.special else b""
        if not any(w in data for w in v.special):
            n.extend(count_block(v, part, at).tolist())
            continue
        for x, y in zip(at[:-1], at[1:]):
            cut = [np.frombuffer(z, np.uint8) if isinstance(z, bytes) else None for z in v.segments(data[x:y])]
            n.append(sum(1 if z is None else int(count_block(v, z, np.array([0, len(z)]))[0]) for z in cut))
    return np.array(n, np.int64)


def count_tokens(docs: DataFrame, path: str, limit: int = 512, chars: int = CHUNK_CHARS) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row of docs (doc_id, text; other columns are ignored).

    Null texts count as empty: 0 bytes, 0 tokens. A special token's string inside a text is that one token.
    """

    def emit(doc_ids, n_bytes, n, ids):
        columns = [doc_ids, pa.array(n_bytes, pa.int64()), pa.array(n, pa.int64()), pa.array(n > limit)]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    schema = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
    return encoded(docs, path, True, emit, schema, count=lambda column: count_column(column, path), chars=chars)
