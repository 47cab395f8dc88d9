"""A lexicon trie, and Levenshtein automata walked along it.

The automaton of a token accepts every string within k edits; neighbours that have changed places are
one edit, like a letter that is wrong, missing or one too many. Its state is two bit masks for each
number of edits, with a bit for each place in the token; stepping it along the trie's edges visits
only the branches that some term within k edits shares, so a token is compared with the lexicon as
a whole and not with one term after another.
"""

from __future__ import annotations

State = tuple[tuple[int, ...], tuple[int, ...]]


class Automaton:
    """Bit-parallel nondeterministic Levenshtein automaton of one token."""

    def __init__(self, token: str, k: int) -> None:
        self.k, self.last = k, 1 << len(token)
        self.masks: dict[str, int] = {}
        for i, c in enumerate(token):
            self.masks[c] = self.masks.get(c, 0) | 1 << i
        self.start: State = tuple((1 << (e + 1)) - 1 & (self.last << 1) - 1 for e in range(k + 1)), (0,) * (k + 1)

    def step(self, state: State, c: str) -> State:
        """After reading c: a match moves on; at the price of an edit c may stand for another
        character, be one too many, be the first of two that changed places, or characters of the token
        may be left out."""
        mask, (at, swapped) = self.masks.get(c, 0), state
        out, begun = [], [0]
        for e, s in enumerate(at):
            new = (s & mask) << 1
            if e:
                new |= at[e - 1] | at[e - 1] << 1 | out[-1] << 1 | (swapped[e] & mask) << 2
                begun.append(at[e - 1] & mask >> 1)
            out.append(new & (self.last << 1) - 1)
        return tuple(out), tuple(begun)

    def alive(self, state: State) -> bool:
        return any(state[0]) or any(state[1])

    def edits(self, state: State, anywhere: bool = False) -> int | None:
        """The least edits with which the token (or, anywhere, some prefix of it) is read."""
        for e, s in enumerate(state[0]):
            if s if anywhere else s & self.last:
                return e
        return None


class Lexicon:
    """Terms with the edits they allow, one at most. A term that ends in * is a stem: words that begin so."""

    def __init__(self, terms: dict[str, int]) -> None:
        self.root: dict = {}
        self.terms = terms
        self._k = max(terms.values(), default=0)
        # An edit touches two neighbouring letters at most, so of a term that allows one either the
        # head or the tail stands in the token as it is: the tail at the end, or in a stem about its place.
        self._heads: dict[int, dict[str, int]] = {}
        self._tails: dict[int, dict[str, int]] = {}
        self._inner: dict[tuple[int, int], set[str]] = {}
        for term, k in terms.items():
            word, stem = term.rstrip("*"), term.endswith("*")
            node = self.root
            for c in word:
                node = node.setdefault(c, {})
            node.setdefault("", []).append((term, k))
            n = len(word)
            head = (n - 1) // 2 if k else n
            sizes = -1 if stem else sum(1 << x for x in range(max(0, n - k), n + k + 1))
            self._note(self._heads, word[:head], sizes)
            if k and stem:
                self._inner.setdefault((head + 1, n - 1 - head), set()).add(word[head + 1 :])
            elif k:
                self._note(self._tails, word[head + 1 :], sizes)

    @staticmethod
    def _note(pieces: dict[int, dict[str, int]], piece: str, sizes: int) -> None:
        own = pieces.setdefault(len(piece), {})
        own[piece] = own.get(piece, 0) | sizes

    def possible(self, token: str) -> bool:
        """False only if no term can match; a few lookups."""
        size = 1 << len(token)
        for n, heads in self._heads.items():
            if heads.get(token[:n], 0) & size:
                return True
        for n, tails in self._tails.items():
            if tails.get(token[-n:], 0) & size:
                return True
        for (at, n), pieces in self._inner.items():
            if token[at : at + n] in pieces or token[at - 1 : at - 1 + n] in pieces or token[at + 1 : at + 1 + n] in pieces:
                return True
        return False

    def search(self, token: str) -> list[tuple[str, int]]:
        """(term, edits) of all terms that the token matches."""
        auto, found = Automaton(token, self._k), []
        stack = [(self.root, auto.start)]
        while stack:
            node, state = stack.pop()
            for c, child in node.items():
                if c == "":
                    for term, k in child:
                        e = auto.edits(state, term.endswith("*"))
                        if e is not None and e <= k:
                            found.append((term, e))
                    continue
                nxt = auto.step(state, c)
                if auto.alive(nxt):
                    stack.append((child, nxt))
        return sorted(found, key=lambda x: (x[1], -len(x[0]), x[0]))
