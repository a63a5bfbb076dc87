"""An Aho-Corasick automaton over sequences of words, in flat arrays: made once, shared as it is, run over many texts at a time.

Words are numbered by the order of their 64-bit hashes. States are numbered by depth and then by (parent, word), so the
keys parent * base + word of all edges are one sorted array and a state's number is its edge's place in it. A state's
depth is at most the longest sequence's (window), so what the automaton is in after a word depends on the last window
words alone: all words of a batch take their steps together, and after at most that many rounds nothing changes any more.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import xxhash


def hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), "u8", len(words))


def _found(where: np.ndarray, what: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of what in a sorted array, and whether it is there."""
    at = np.searchsorted(where, what)
    at[at == len(where)] = 0
    return at, where[at] == what


@dataclass
class Automaton:
    """vocabulary: the words' hashes; first: a word's state from the root (0); keys: the edges; fail and last: a state's longest
    other suffix and the longest sequence that ends with it; depths: the first state of each depth; ends, owner_at and owners: the
    states that end a sequence and the places of their items in ids."""

    vocabulary: np.ndarray
    first: np.ndarray
    keys: np.ndarray
    fail: np.ndarray
    last: np.ndarray
    depths: np.ndarray
    ends: np.ndarray
    owner_at: np.ndarray
    owners: np.ndarray
    ids: list[str]

    def step(self, state: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The states after words: the edge of the state, or of what it falls back on."""
        out = self.first[word]
        todo = np.flatnonzero((state > 0) & (word > 0))
        state, word = state[todo], word[todo]
        while len(todo):
            at, there = _found(self.keys, state.astype("i8") * len(self.first) + word)
            out[todo[there]] = at[there] + 1
            state = self.fail[state]
            on = ~there & (state > 0)
            todo, state, word = todo[on], state[on], word[on]
        return out

    def states(self, texts: list[list[bytes]]) -> np.ndarray:
        """The state after each word of texts, one after the other, with one root behind each text."""
        begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
        number = np.zeros(begins[-1], "i4")
        for begin, t in zip(begins[:-1], texts, strict=True):
            if t:
                at, there = _found(self.vocabulary, hashes(t))
                number[begin : begin + len(t)] = np.where(there, at + 1, 0)
        state = self.first[number]
        todo = np.flatnonzero(state[:-1]) + 1
        while len(todo):
            new = self.step(state[todo - 1], number[todo])
            other = new != state[todo]
            todo = todo[other]
            state[todo] = new[other]
            todo = todo[todo < len(state) - 1] + 1
        return state

    def lengths(self, state: np.ndarray) -> np.ndarray:
        """The number of words that a state stands for."""
        return np.searchsorted(self.depths, state, "right")

    def sequences(self, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All sequences that end with states: places in state, and the sequences' own states."""
        at, now, places, found = np.arange(len(state)), self.last[state], [], []
        while len(at):
            on = now > 0
            at, now = at[on], now[on]
            places.append(at)
            found.append(now)
            now = self.last[self.fail[now]]
        return np.concatenate(places or [at]), np.concatenate(found or [at])

    def items(self, ends: np.ndarray) -> list[str]:
        """The items of sequences, sorted."""
        at = np.searchsorted(self.ends, np.unique(ends))
        owned = [self.owners[a:b] for a, b in zip(self.owner_at[at], self.owner_at[at + 1], strict=True)]
        return [self.ids[i] for i in np.unique(np.concatenate(owned))] if owned else []


def automaton(items: list[tuple[str | None, list[bytes]]], window: int) -> Automaton | None:
    """The automaton of all windows of items (an id and words); an item of fewer words is one window. None if there are none."""
    items = [(item, w) for item, w in items if w]
    if not items:
        return None
    vocabulary, word = np.unique(np.concatenate([hashes(w) for _, w in items]), return_inverse=True)
    word, base = word + 1, len(vocabulary) + 1
    long = np.array([len(w) for _, w in items])
    begins, n = np.cumsum(long) - long, np.maximum(1, long - window + 1)
    of = np.repeat(np.arange(len(items)), n)
    start = begins[of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    size = np.minimum(window, long)[of]

    node, depths, edges = np.zeros(len(of), "i4"), [1], []
    for d in range(size.max()):
        on = np.flatnonzero(size > d)
        key, at = np.unique(node[on].astype("i8") * base + word[start[on] + d], return_inverse=True)
        node[on] = at + depths[-1]
        edges.append(key)
        depths.append(depths[-1] + len(key))
    keys = np.concatenate(edges)
    first, fail, last = np.zeros(base, "i4"), np.zeros(len(keys) + 1, "i4"), np.zeros(len(keys) + 1, "i4")
    first[edges[0]] = np.arange(1, len(edges[0]) + 1)
    last[node] = node

    ids = sorted({item for item, _ in items if item is not None})
    place = {item: i for i, item in enumerate(ids)}
    own = np.array([-1 if item is None else place[item] for item, _ in items])[of]
    pairs = np.unique(node[own >= 0].astype("i8") * (len(ids) + 1) + own[own >= 0])
    ends = np.unique(node)
    owner_at = np.searchsorted(pairs, np.append(ends, len(keys) + 1).astype("i8") * (len(ids) + 1))

    out = Automaton(vocabulary, first, keys, fail, last, np.array(depths), ends, owner_at, (pairs % (len(ids) + 1)).astype("i4"), ids)
    for a, b in zip(depths[:-1], depths[1:], strict=True):  # what a state falls back on is of a lower depth, so it is known by then
        if a > 1:
            fail[a:b] = out.step(fail[keys[a - 1 : b - 1] // base], keys[a - 1 : b - 1] % base)
        last[a:b] = np.where(last[a:b] > 0, last[a:b], last[fail[a:b]])
    return out
