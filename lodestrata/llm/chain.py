"""A linear-chain conditional random field over named features, in numpy: labels sequences of lines or paragraphs."""

from __future__ import annotations

from collections.abc import Callable, Hashable, Iterable

import numpy as np

MEMO = 120_000


class _Rows(dict):
    """Numbers keys in the order they are first met; ``new`` holds those that came since it was last emptied."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[Hashable] = []

    def __missing__(self, key: Hashable) -> int:
        self[key] = n = len(self)
        self.new.append(key)
        return n


def itself(key: Hashable) -> Iterable[str]:
    return (key,)


class Chain:
    """``fit`` on (keys per position, labels) sequences; ``decode`` gives the best label sequence of each.

    A position is described by a few hashable keys, each of which stands for a group of named features that go together:
    ``expand(key)`` lists them. A key is expanded and weighed once and met again by number (up to MEMO keys are held), so
    a paragraph, or a situation, that occurs often costs one look-up. Features seen in fewer than ``min_count`` positions of
    the sample are left out. The fit is exact gradient ascent on the conditional likelihood (forward-backward, AdaGrad, ridge),
    with a fixed order and seed.
    """

    def __init__(self, labels: tuple[str, ...], expand: Callable[[Hashable], Iterable[str]] = itself, min_count: int = 2, epochs: int = 12, rate: float = 0.3, ridge: float = 2e-5):
        self.labels, self.expand, self.min_count, self.epochs, self.rate, self.ridge = labels, expand, min_count, epochs, rate, ridge
        self.index: dict[str, int] = {}
        self._forget()

    def _forget(self) -> None:
        self._rows, self._scores = _Rows(), np.zeros((0, len(self.labels)))

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("_rows", "_scores")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._forget()

    def _emit(self, ids: np.ndarray, pos: np.ndarray, n: int) -> np.ndarray:
        return np.stack([np.bincount(pos, self.w[ids, k], n) for k in range(len(self.labels))], 1)

    @staticmethod
    def _grid(e: np.ndarray, start: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        t = np.arange(lens.max())
        at = np.minimum(start[:, None] + t[None, :], len(e) - 1)
        return e[at], t[None, :] < lens[:, None]

    def fit(self, seqs: list[list[list[Hashable]]], gold: list[list[int]]) -> Chain:
        names, rows = _Rows(), _Rows()
        flat = [np.fromiter((rows[x] for keys in s for x in keys), np.int64) for s in seqs]
        made = [np.fromiter((names[f] for f in self.expand(x)), np.int64) for x in rows]
        size = np.array([len(x) for x in made], np.int64)
        used = np.bincount(np.concatenate([np.zeros(0, np.int64), *flat]), minlength=len(made))
        count = np.bincount(np.concatenate([np.zeros(0, np.int64), *made]), np.repeat(used, size).astype(float), len(names))
        self.index = {f: i for i, f in enumerate(sorted(f for f, n in names.items() if count[n] >= self.min_count))}
        number = np.array([self.index.get(f, -1) for f in names], np.int64)
        made = [m[m >= 0] for m in (number[x] for x in made)]
        size = np.array([len(x) for x in made], np.int64)
        k = len(self.labels)
        self.w, self.trans, self.first, self.last = np.zeros((len(self.index) + 1, k)), np.zeros((k, k)), np.zeros(k), np.zeros(k)
        g2 = [np.full_like(x, 1e-2) for x in (self.w, self.trans, self.first, self.last)]
        order = sorted(range(len(seqs)), key=lambda i: (len(seqs[i]), i))
        groups = [[i for i in order[a:a + 32] if seqs[i]] for a in range(0, len(order), 32)]
        packed = []
        for g in filter(None, groups):
            lens = np.array([len(seqs[i]) for i in g], np.int64)
            all_rows = np.concatenate([flat[i] for i in g])
            keys_at = np.array([len(keys) for i in g for keys in seqs[i]], np.int64)
            ids = np.concatenate([made[r] for r in all_rows])
            pos = np.repeat(np.repeat(np.arange(len(keys_at)), keys_at), size[all_rows])
            packed.append((ids, pos, np.cumsum(lens) - lens, lens, np.concatenate([gold[i] for i in g]).astype(np.int64)))
        rng = np.random.default_rng(7)
        for _ in range(self.epochs):
            for j in rng.permutation(len(packed)):
                ids, pos, start, lens, y = packed[j]
                n = int(lens.sum())
                marg, pair, b0, b1 = self._marginals(self._emit(ids, pos, n), start, lens)
                marg[np.arange(n), y] -= 1
                gw = np.stack([np.bincount(ids, marg[pos, c], len(self.w)) for c in range(k)], 1)
                prev = np.ones(n, bool)
                prev[start] = False
                at = np.flatnonzero(prev)
                np.subtract.at(pair, (y[at - 1], y[at]), 1)
                np.subtract.at(b0, y[start], 1)
                np.subtract.at(b1, y[start + lens - 1], 1)
                for x, g, h in zip((self.w, self.trans, self.first, self.last), (gw, pair, b0, b1), g2):
                    g = g / len(lens) + self.ridge * x
                    h += g * g
                    x -= self.rate * g / np.sqrt(h)
        return self

    def _marginals(self, e: np.ndarray, start: np.ndarray, lens: np.ndarray):
        x, mask = self._grid(e, start, lens)
        b, t, k = x.shape
        lse = lambda v, axis: (m := v.max(axis)) + np.log(np.exp(v - np.expand_dims(m, axis)).sum(axis))
        fw, bw = np.zeros((b, t, k)), np.zeros((b, t, k))
        fw[:, 0] = x[:, 0] + self.first
        for i in range(1, t):
            fw[:, i] = x[:, i] + lse(fw[:, i - 1][:, :, None] + self.trans, 1)
        ends = lens - 1
        for i in range(t - 1, -1, -1):
            nxt = np.zeros((b, k)) if i == t - 1 else lse(self.trans + (x[:, i + 1] + bw[:, i + 1])[:, None, :], 2)
            bw[:, i] = np.where((ends == i)[:, None], self.last, nxt)
        z = lse(fw[np.arange(b), ends] + self.last, 1)
        m = np.exp(np.minimum(fw + bw - z[:, None, None], 0.0))  # behind a sequence's end are no probabilities
        pair = np.zeros((k, k))
        for i in range(1, t):
            p = np.exp(np.minimum(fw[:, i - 1][:, :, None] + self.trans + (x[:, i] + bw[:, i])[:, None, :] - z[:, None, None], 0.0))
            pair += p[mask[:, i]].sum(0)
        marg = m[mask]
        return marg, pair, np.exp(fw[:, 0] + bw[:, 0] - z[:, None]).sum(0), m[np.arange(b), ends].sum(0)

    def _weigh(self, seqs: list[list[list[Hashable]]]) -> np.ndarray:
        """Scores of the labels at every position of the sequences, one after the other."""
        if len(self._rows) > MEMO:
            self._forget()
        rows = self._rows
        at = np.array([rows[x] for s in seqs for keys in s for x in keys], np.int64)
        pos = np.repeat(np.arange(sum(map(len, seqs))), [len(keys) for s in seqs for keys in s])
        if rows.new:
            get = self.index.get
            found = [[i for i in map(get, self.expand(x)) if i is not None] for x in rows.new]
            of = np.repeat(np.arange(len(found)), [len(x) for x in found])
            self._scores = np.concatenate([self._scores, self._emit(np.array([i for x in found for i in x], np.int64), of, len(found))])
            rows.new = []
        got = self._scores[at]
        return np.stack([np.bincount(pos, got[:, k], sum(map(len, seqs))) for k in range(len(self.labels))], 1)

    def decode(self, seqs: list[list[list[Hashable]]], extra: list[np.ndarray] | None = None) -> list[np.ndarray]:
        """Label numbers of every sequence (empty sequences give empty arrays); ``extra`` has further scores of each."""
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(seqs)
        order = sorted((i for i in range(len(seqs)) if seqs[i]), key=lambda i: len(seqs[i]))
        for a in range(0, len(order), 64):
            group = order[a:a + 64]
            lens = np.array([len(seqs[i]) for i in group], np.int64)
            e = self._weigh([seqs[i] for i in group])
            if extra is not None:
                e = e + np.concatenate([extra[i] for i in group])
            x, _ = self._grid(e, np.cumsum(lens) - lens, lens)
            b, t, k = x.shape
            best, back, ends = x[:, 0] + self.first, np.zeros((b, t, k), np.int64), lens - 1
            last = np.where((ends == 0)[:, None], best + self.last, 0.0)
            for i in range(1, t):
                v = best[:, :, None] + self.trans
                back[:, i] = v.argmax(1)
                best = v.max(1) + x[:, i]
                last = np.where((ends == i)[:, None], best + self.last, last)
            y = last.argmax(1)
            path = np.zeros((b, t), np.int64)
            for i in range(t - 1, -1, -1):
                y = np.where(ends == i, last.argmax(1), y)
                path[:, i] = y
                y = np.where(i <= ends, back[np.arange(b), i, y], y)
            for r, i in enumerate(group):
                out[i] = path[r, :lens[r]]
        return out
