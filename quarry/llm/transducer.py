"""A finite-state transducer of byte-pair merges: it reads bytes and emits, on each transition, how the token count changes.

The merges of a text's prefix end in one last token, and dropping that token leaves the merges of a shorter prefix. Which
token is last is settled by pairs: a token may follow the one before it where no merge across their border would have
come first. So after each byte it is enough to know, of the places from which a token may still reach further, how far
into a token the bytes since then have come, the last token there, and how many tokens fewer were counted there. These
facts are the state. There are finitely many, they are numbered as they are met, and each transition is worked out once.
"""

from quarry.llm.merges import Merges

ROOT = 0


class CountingTransducer:
    #: States and judged pairs kept before the tables are compiled afresh.
    STATES, PAIRS = 1_500_000, 2_000_000

    def __init__(self, merges: Merges):
        self.merges = merges
        self.child: dict[int, int] = {}
        self.token = [-1]
        for word, token in merges.whole_tokens():
            node = ROOT
            for byte in word:
                step = node << 8 | byte
                node = self.child.get(step, -1)
                if node < 0:
                    node = self.child[step] = len(self.token)
                    self.token.append(-1)
            self.token[node] = token
        self.spines: dict[int, tuple] = {}
        self.reset()

    def reset(self) -> None:
        self.ids: dict[tuple, int] = {}
        self.facts: list[tuple] = []
        self.step: dict[int, tuple[int, int, int]] = {}
        self.may_follow: dict[tuple[int, int], bool] = {}
        self.begin = self._number(((ROOT, -1, 0),))

    def _number(self, fact: tuple) -> int:
        got = self.ids.get(fact)
        if got is None:
            got = self.ids[fact] = len(self.facts)
            self.facts.append(fact)
        return got

    def _spine(self, token: int) -> tuple:
        """The tokens at the right and at the left end while `token` is merged, each with the rank of the merge that ends it."""
        got = self.spines.get(token)
        if got is None:
            ends = []
            for side in (1, 0):
                chain, x, ends_at = [], token, float("inf")
                while True:
                    chain.append((x, ends_at))
                    if x not in self.merges.parts:
                        break
                    left, right, rank = self.merges.parts[x]
                    x, ends_at = (right if side else left), rank
                ends.append(chain[::-1])
            got = self.spines[token] = tuple(ends)
        return got

    def _follows(self, before: int, token: int) -> bool:
        """Whether no merge across the border of both comes before one of them has grown past it."""
        known = self.may_follow.get((before, token))
        if known is None:
            left, right, rank_of = self._spine(before)[0], self._spine(token)[1], self.merges.rank_of
            i = j = 0
            known = True
            while True:
                (x, x_ends), (y, y_ends) = left[i], right[j]
                rank = rank_of.get((x, y))
                if rank is not None and rank < x_ends and rank <= y_ends:
                    known = False
                    break
                if i == len(left) - 1 and j == len(right) - 1:
                    break
                if x_ends <= y_ends:
                    i += 1
                else:
                    j += 1
            self.may_follow[before, token] = known
        return known

    def _compile(self, state: int, byte: int) -> tuple[int, int, int]:
        live, last = [], None
        for node, before, behind in self.facts[state]:
            node = self.child.get(node << 8 | byte)
            if node is None:
                continue
            live.append((node, before, behind))
            token = self.token[node]
            if last is None and token >= 0 and (before < 0 or self._follows(before, token)):
                last = (token, behind + 1)
        token, more = last
        fact = tuple((node, before, behind - more) for node, before, behind in live) + ((ROOT, token, 0),)
        return self._number(fact), more, token

    def _go(self, state: int, byte: int) -> tuple[int, int, int]:
        to = self.step[state << 8 | byte] = self._compile(state, byte)
        return to

    def _tidy(self) -> None:
        if len(self.facts) > self.STATES or len(self.may_follow) > self.PAIRS:
            self.reset()

    def count(self, word: bytes) -> int:
        """The tokens of one pre-token: the sum of what its transitions emit."""
        self._tidy()
        state, n, step = self.begin, 0, self.step
        for byte in word:
            to = step.get(state << 8 | byte) or self._go(state, byte)
            state = to[0]
            n += to[1]
        return n

    def tokens(self, word: bytes) -> list[int]:
        """The tokens themselves, from the last token after each byte, read backwards. Linear in the word, however long."""
        self._tidy()
        state, last, step = self.begin, [], self.step
        for byte in word:
            to = step.get(state << 8 | byte) or self._go(state, byte)
            state = to[0]
            last.append(to[2])
        out, at, size = [], len(last), self.merges.size
        while at:
            token = last[at - 1]
            out.append(token)
            at -= size[token]
        return out[::-1]
