"""Byte-pair encoding by prefix dynamic programming.

A sequence of tokens is the encoding of its text exactly when each two
neighbouring tokens encode to themselves when put together, and every prefix
of an encoding is the encoding of its own text. So one pass from left to right
finds, for each prefix, its last token and its number of tokens; a longer text
goes on from the longest prefix already met.
"""

from __future__ import annotations

from collections.abc import Callable


class Memo(dict):
    """Remembers results in two generations, so that its size is bounded and frequent keys stay.

    ``limit`` bounds the number of keys of a generation, or the sum of their ``size``; a key
    of over a thousandth of it isn't kept.
    """

    def __init__(self, make: Callable, limit: int, size: Callable | None = None):
        super().__init__()
        self.make, self.limit, self.size, self.held, self.old = make, limit, size, 0, {}

    def __missing__(self, key):
        found = self.old.get(key)
        if found is None:
            found = self.make(key)
        self.put(key, found)
        return found

    def put(self, key, found) -> None:
        own = self.size(key) if self.size else 1
        if own * 1000 > self.limit:
            return
        if self.held >= self.limit:
            self.old, self.held = dict(self), 0
            self.clear()
        self.held += own
        self[key] = found


class PrefixEncoder:
    """Token counts of every prefix of a word.

    ``ranks`` maps a pair of spellings to the priority at which they merge
    (least first); a token's parts merge before the token does. ``end`` is a
    suffix that marks a word's last symbol. Pairs of token ids are kept as one
    number.
    """

    SHIFT = 20

    def __init__(self, vocab: dict[str, int], ranks: dict[tuple[str, str], int], end: str, limit: int = 250_000):
        self.spelled = {i: t for t, i in vocab.items()}
        self.open = {t: i for t, i in vocab.items() if not t.endswith(end)}
        self.closed = {t[: -len(end)]: i for t, i in vocab.items() if t.endswith(end)}
        self.vocab, self.end = vocab, end
        self.ranks = {vocab[a] << self.SHIFT | vocab[b]: r for (a, b), r in ranks.items()}
        self.joined = {vocab[a] << self.SHIFT | vocab[b]: vocab[a + b] for a, b in ranks}
        self.longest = max(map(len, [*self.open, *self.closed]), default=1)
        self.edges: dict[int, tuple] = {}
        self.pairs = Memo(self._fits, limit)
        self.limit, self.states, self.old = limit, {"": (0, 0, b"")}, {}

    def symbols(self, token: str) -> list[int]:
        end = self.end
        if token.endswith(end) and len(token) > len(end):
            body = token[: -len(end)]
            return [*(self.open[c] for c in body[:-1]), self.closed[body[-1]]]
        return [self.open[c] for c in token]

    def _edges(self, token: int) -> tuple:
        """What stands at the token's left and right edge while it is being merged: (id, rank at
        which it comes, rank at which it goes)."""
        known = self.edges.get(token)
        if known is None:
            symbols, ranks, shift = self.symbols(self.spelled[token]), self.ranks, self.SHIFT
            left, right = [(symbols[0], -1)], [(symbols[-1], -1)]
            while len(symbols) > 1:
                r, i = min((r, i) for i in range(len(symbols) - 1) if (r := ranks.get(symbols[i] << shift | symbols[i + 1])) is not None)
                both = self.joined[symbols[i] << shift | symbols[i + 1]]
                if i == 0:
                    left.append((both, r))
                if i == len(symbols) - 2:
                    right.append((both, r))
                symbols[i : i + 2] = [both]
            known = self.edges[token] = tuple([(s, r, x[k + 1][1] if k + 1 < len(x) else 1 << 60) for k, (s, r) in enumerate(x)] for x in (left, right))
        return known

    def _fits(self, pair: int) -> bool:
        """No merge over the boundary comes while its two sides stand there; of equals the left one is first."""
        ranks, shift = self.ranks, self.SHIFT
        heads = self._edges(pair & (1 << shift) - 1)[0]
        for x, came, goes in self._edges(pair >> shift)[1]:
            x <<= shift
            for y, came_y, goes_y in heads:
                r = ranks.get(x | y)
                if r is not None and came < r < goes and came_y < r <= goes_y:
                    return False
        return True

    def counts(self, word: str) -> tuple[int, ...] | bytes:
        """The token counts of the prefixes of 1, 2, ... symbols, each taken as a whole word."""
        n, states = len(word), self.states
        if n > 64:
            return self._long(word)
        if len(states) >= self.limit:
            self.old = dict(states)
            states.clear()
            states[""] = (0, 0, b"")
        if word in states:
            return states[word][2]
        open_, closed, pairs, shift, longest, old = self.open, self.closed, self.pairs, self.SHIFT, self.longest, self.old
        known = n - 1
        while word[:known] not in states:
            known -= 1
        for i in range(known + 1, n + 1):
            here = word[:i]
            state = old.get(here)
            if state is None:
                last = count = ending = 0
                for j in range(max(0, i - longest), i):
                    t = here[j:]
                    a = None if count else open_.get(t)
                    b = None if ending else closed.get(t)
                    if a is not None or b is not None:
                        before, n_before, _ = states[here[:j]]
                        if a is not None and not count and (not j or pairs[before << shift | a]):
                            last, count = a, n_before + 1
                        if b is not None and not ending and (not j or pairs[before << shift | b]):
                            ending = n_before + 1
                        if count and ending:
                            break
                state = (last, count, states[here[:-1]][2] + ending.to_bytes())
            states[here] = state
        return states[word][2]

    def _long(self, word: str) -> tuple[int, ...]:
        """The same without remembering, in time linear in the word's length."""
        open_, closed, pairs, shift = self.open, self.closed, self.pairs, self.SHIFT
        last, count, endings = [0], [0], []
        for i in range(1, len(word) + 1):
            found = ending = None
            for j in range(max(0, i - self.longest), i):
                t, before = word[j:i], last[j]
                a, b = open_.get(t), closed.get(t)
                if found is None and a is not None and (not j or pairs[before << shift | a]):
                    found = (a, count[j] + 1)
                if ending is None and b is not None and (not j or pairs[before << shift | b]):
                    ending = count[j] + 1
                if found and ending:
                    break
            last.append(found[0])
            count.append(found[1])
            endings.append(ending)
        return tuple(endings)
