"""A generalised suffix automaton of word sequences: which windows of which items end where in a stream of words.

Words are numbers from 1; 0 is a word that no item has. The automaton holds every run of words of every item; streaming
keeps, for each place of a text, the state of the longest run that ends there. Texts are streamed side by side: one step
of numpy moves all of them on by a word.
"""

from __future__ import annotations

import io

import numpy as np

#: Words that one lane of a stream takes; a longer stretch is cut into lanes that overlap by a window.
LANE = 512


class Automaton:
    """Built from items of one group; `window` words of an item are a window, and so is a whole shorter item.

    A state stands for runs of words with the same ends: its longest has `length` words, the next shorter run with more ends
    is `link`. Steps are kept as sorted keys (state, word), so that many can be looked up at once.
    """

    def __init__(self, window: int, **arrays: np.ndarray):
        self.window = window
        self.__dict__.update(arrays)
        self.roots = np.full(int(self.n_words) + 1, -1, np.int64)
        at_root = self.keys <= self.n_words  # state 0
        self.roots[self.keys[at_root].astype(np.int64)] = self.targets[at_root]

    ARRAYS = ("n_words", "keys", "targets", "link", "length", "whole", "shortest", "window_states", "window_starts", "window_items")

    @classmethod
    def built(cls, items: list[np.ndarray], n_words: int, window: int) -> Automaton:
        """items: each one's words; items without words have no window."""
        steps, link, length = [{}], [-1], [0]

        def state(n: int, following: dict) -> int:
            steps.append(following)
            link.append(0)
            length.append(n)
            return len(steps) - 1

        def parted(p: int, q: int, word: int) -> int:
            """The state for q's runs of length[p] + 1 words, which end in more places than q's longest ones."""
            if length[q] == length[p] + 1:
                return q
            short = state(length[p] + 1, dict(steps[q]))
            link[short], link[q] = link[q], short
            while p >= 0 and steps[p].get(word) == q:
                steps[p][word] = short
                p = link[p]
            return short

        def extended(last: int, word: int) -> int:
            if word in steps[last]:
                return parted(last, steps[last][word], word)
            new, p = state(length[last] + 1, {}), last
            while p >= 0 and word not in steps[p]:
                steps[p][word] = new
                p = link[p]
            link[new] = parted(p, steps[p][word], word) if p >= 0 else 0
            return new

        ends = []
        for item in items:
            last = 0
            for word in item.tolist():
                last = extended(last, word)
            ends.append(last)
        pairs = sorted((s * (n_words + 1) + w, t) for s, following in enumerate(steps) for w, t in following.items())
        whole = np.zeros(len(steps), np.int64)  # of each state, the longest of its ends that is a whole short item; 0: none
        for item, end in zip(items, ends, strict=True):
            if 0 < len(item) < window:
                whole[end] = end
        for s in np.argsort(length, kind="stable").tolist():
            if s and not whole[s]:
                whole[s] = whole[link[s]]
        link[0] = 0
        sizes = [min(len(x), window) for x in items if len(x)]
        out = cls(
            window,
            n_words=np.int64(n_words),
            keys=np.array([k for k, _ in pairs], np.uint64),
            targets=np.array([t for _, t in pairs], np.int64),
            link=np.array(link, np.int64),
            length=np.array(length, np.int64),
            whole=whole,
            shortest=np.int64(min(sizes, default=0)),
            window_states=np.zeros(0, np.int64),
            window_starts=np.zeros(1, np.int64),
            window_items=np.zeros(0, np.int64),
        )
        starts = np.concatenate(([0], np.cumsum([len(x) for x in items]))).astype(np.int64)
        words = np.concatenate([np.zeros(0, np.int64), *items])
        at, states, _ = out.windows(words, starts)
        owner = np.searchsorted(starts, at, "right") - 1
        # a short item stands inside others too; those own a run of their words, not a window
        own = (out.length[states] >= window) | (np.array([len(x) for x in items], np.int64)[owner] == out.length[states]) if len(at) else np.zeros(0, bool)
        found = np.unique(np.stack([states[own], owner[own]], 1), axis=0) if len(at) else np.zeros((0, 2), np.int64)
        out.window_states, first = np.unique(found[:, 0], return_index=True)
        out.window_starts, out.window_items = np.append(first, len(found)), found[:, 1]
        return out

    def step(self, states: np.ndarray, words: np.ndarray) -> np.ndarray:
        """The states after one word more; -1 where no item goes on with it."""
        key = states.astype(np.uint64) * np.uint64(self.n_words + 1) + words.astype(np.uint64)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (words > 0), self.targets[at], -1)

    def stretches(self, words: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where a window may lie: stretches of texts each two neighbours of which stand in an item so (starts, ends)."""
        linked = np.zeros(len(words), bool)  # whether a word and the one before it are neighbours in some item
        pairs = np.flatnonzero((words[1:] > 0) & (words[:-1] > 0))
        linked[pairs[self.step(self.roots[words[pairs]], words[pairs + 1]) >= 0] + 1] = True
        linked[starts[:-1][starts[:-1] < len(words)]] = False
        first = np.flatnonzero(~linked)
        last = np.append(first[1:], len(words))
        keep = (words[first] > 0) & (last - first >= self.shortest)
        return first[keep], last[keep]

    def follow(self, words: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(places, states, lengths) of the stretches: at each place the longest run of an item that ends there, up to a window exactly."""
        n = -(-(last - first) // LANE)
        nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        own = np.repeat(first, n) + nth * LANE
        end = np.minimum(own + LANE, np.repeat(last, n))
        start = np.maximum(own - self.window + 1, np.repeat(first, n))
        order = np.argsort(start - end, kind="stable")  # the longest first: those still under way are in front
        start, own, size = start[order], own[order], (end - start)[order]
        state, matched = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
        places, states, lengths = [], [], []
        for t in range(int(size[0]) if len(size) else 0):
            k = int(np.searchsorted(-size, -t))
            place = start[:k] + t
            word = words[place]
            todo = np.arange(k)
            while len(todo):
                new = self.step(state[todo], word[todo])
                found = new >= 0
                went = todo[found]
                state[went] = new[found]
                matched[went] += 1
                todo = todo[~found]
                matched[todo[state[todo] == 0]] = 0
                todo = todo[state[todo] > 0]
                state[todo] = self.link[state[todo]]
                matched[todo] = self.length[state[todo]]
            mine = place >= own[:k]
            places.append(place[mine])
            states.append(state[:k][mine])
            lengths.append(matched[:k][mine])
        join = lambda x: np.concatenate([np.zeros(0, np.int64), *x])
        return join(places), join(states), join(lengths)

    def windows(self, words: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(places, states, sizes): every window's last word in the texts, the state that stands for the window, and its words."""
        if not len(words) or not self.shortest:
            none = np.zeros(0, np.int64)
            return none, none, none
        places, states, lengths = self.follow(words, *self.stretches(words, starts))
        out = []
        full = np.flatnonzero(lengths >= self.window)
        s = states[full]
        while len(up := np.flatnonzero(self.length[self.link[s]] >= self.window)):
            s[up] = self.link[s[up]]
        out.append((places[full], s, np.full(len(full), self.window)))
        # whole short items: the state itself where the run is its longest, else the next shorter such run, and so on
        s = np.where(lengths == self.length[states], self.whole[states], self.whole[self.link[states]])
        while len(some := np.flatnonzero(s)):
            places, s = places[some], s[some]
            out.append((places, s, self.length[s]))
            s = self.whole[self.link[s]]
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def items_at(self, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, item): for each of the states the items that have its window, as rows of a list."""
        at = np.searchsorted(self.window_states, states)
        n = self.window_starts[at + 1] - self.window_starts[at]
        row = np.repeat(np.arange(len(states)), n)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        return row, self.window_items[np.repeat(self.window_starts[at], n) + nth]

    def packed(self) -> bytes:
        out = io.BytesIO()
        np.savez_compressed(out, window=np.int64(self.window), **{k: getattr(self, k) for k in self.ARRAYS})
        return out.getvalue()

    @classmethod
    def unpacked(cls, blob: bytes) -> Automaton:
        found = np.load(io.BytesIO(blob))
        return cls(int(found["window"]), **{k: found[k] for k in cls.ARRAYS})
