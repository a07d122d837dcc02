"""Byte-pair merges of a vocabulary file, applied to many pre-tokens at once."""

import base64
import json

import numpy as np

#: Bytes merged side by side.
STRETCH = 1 << 20


class Merges:
    """Tokens and merges of a byte-level BPE file: .json names its merges in order; by .tiktoken ranks any two tokens merge that are a token together."""

    def __init__(self, path: str):
        self.special: dict[bytes, int] = {}
        if path.endswith(".json"):
            with open(path, encoding="utf-8") as f:
                j = json.load(f)
            self.special = {x["content"].encode(): x["id"] for x in j["added_tokens"]}
            printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
            rest = [b for b in range(256) if b not in printable]
            byte_of = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(rest)}
            raw = lambda w: bytes(byte_of[c] for c in w)
            self.ids = {raw(w): i for w, i in j["model"]["vocab"].items() if w.encode() not in self.special}
            pairs = [tuple(map(raw, m.split(" ") if isinstance(m, str) else m)) for m in j["model"]["merges"]]
            self.rank_of = {(self.ids[a], self.ids[b]): k for k, (a, b) in reversed([*enumerate(pairs)])}
            into = {(self.ids[a], self.ids[b]): self.ids[a + b] for a, b in pairs}
        else:
            with open(path, "rb") as f:
                self.ids = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.rank_of, into = {}, {}
            for w, i in self.ids.items():
                for k in range(1, len(w)):
                    a, b = self.ids.get(w[:k]), self.ids.get(w[k:])
                    if a is not None and b is not None:
                        self.rank_of[a, b] = into[a, b] = i
        n = max([*self.ids.values(), *self.special.values()]) + 1
        self.piece = [b""] * n
        for w, i in [*self.ids.items(), *self.special.items()]:
            self.piece[i] = w
        self.size = [len(w) for w in self.piece]
        self.n = n
        self.byte_token = np.array([self.ids[bytes([b])] for b in range(256)], np.int64)
        keys = np.array([a * n + b for a, b in self.rank_of], np.int64)
        order = np.argsort(keys)
        self.keys = keys[order]
        self.ranks = np.array([*self.rank_of.values()], np.int64)[order]
        self.into = np.array([into[p] for p in self.rank_of], np.int64)[order]
        #: token: its two parts and the rank of their merge, for tokens that merges arrive at
        self.parts: dict[int, tuple[int, int, int]] = {}
        words = [w for w in self.ids if len(w) > 1]
        tokens, bounds, last = self._merge(words)
        for k, w in enumerate(words):
            if bounds[k + 1] - bounds[k] == 1 and tokens[bounds[k]] == self.ids[w]:
                a, b = last[k].tolist()
                self.parts[self.ids[w]] = (a, b, self.rank_of[a, b])

    def whole_tokens(self):
        """(bytes, id) of every token that its own bytes are merged into."""
        for w, i in self.ids.items():
            if len(w) == 1 or i in self.parts:
                yield w, i

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all words in a row, and each word's first (n + 1 places)."""
        tokens, bounds, _ = self._merge(words)
        return tokens, bounds

    def _merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """In each round every word merges all places of its pair of least rank. Also returns each word's last merge."""
        sizes = np.array([len(w) for w in words], np.int64)
        last = np.zeros((len(words), 2), np.int64)
        done_word, done_token, at = [], [], 0
        while at < len(words):
            upto = at + max(1, int(np.searchsorted(np.cumsum(sizes[at:]), STRETCH, side="right")))
            token = self.byte_token[np.frombuffer(b"".join(words[at:upto]), np.uint8)]
            word = np.repeat(np.arange(at, upto), sizes[at:upto])
            while len(token):
                joined = np.flatnonzero(word[1:] == word[:-1])
                key = token[joined] * self.n + token[joined + 1]
                place = np.minimum(np.searchsorted(self.keys, key), max(len(self.keys) - 1, 0))
                known = self.keys[place] == key if len(self.keys) else np.zeros(len(key), bool)
                joined, place = joined[known], place[known]
                busy = np.zeros(len(words) + 1, bool)
                busy[word[joined]] = True
                still = busy[word]
                done_word.append(word[~still])
                done_token.append(token[~still])
                if not len(joined):
                    break
                rank, of = self.ranks[place], word[joined]
                begins = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
                least = np.repeat(np.minimum.reduceat(rank, begins), np.diff(np.append(begins, len(of))))
                hit = rank == least
                joined, place = joined[hit], place[hit]
                # of equal tokens in a row, the first and second merge, the third and fourth, and so on
                chain = np.append(False, joined[1:] == joined[:-1] + 1)
                since = np.arange(len(joined)) - np.maximum.accumulate(np.where(chain, 0, np.arange(len(joined))))
                joined, place = joined[since % 2 == 0], place[since % 2 == 0]
                last[word[joined]] = np.stack([token[joined], token[joined + 1]], axis=1)
                token[joined] = self.into[place]
                still[joined + 1] = False
                token, word = token[still], word[still]
            at = upto
        done_word = np.concatenate(done_word) if done_word else np.zeros(0, np.int64)
        done_token = np.concatenate(done_token) if done_token else np.zeros(0, np.int64)
        order = np.argsort(done_word, kind="stable")
        return done_token[order], np.searchsorted(done_word[order], np.arange(len(words) + 1)), last
