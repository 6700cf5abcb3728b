"""A replay head: one hidden layer over embeddings, trained online on balanced batches of the last rows of each label.

Sequential within a stream by nature: every step starts from the weights of the step before. Streams run in parallel. All
weights lie in one vector, so a step of the optimiser is a few passes in place over it; divisions by 1 are left out. What
the weights have no part in (means, drawn batches, scaling) is worked out for a block of rows at a time.
"""

from __future__ import annotations

from typing import Any

import numpy as np

# Hidden units, items remembered of a label, items of a step, and the step of the optimiser.
HIDDEN, PER_CLASS, BATCH, RATE = 512, 400, 32, 0.001
ROWS = np.arange(BATCH)
#: Rows whose batches are made at once; fewer than a label remembers.
BLOCK = 32


class Head:
    def __init__(self, dims: int, seed: int = 0) -> None:
        self.rng = np.random.default_rng(seed)
        bound = dims**-0.5
        self.flat = np.concatenate([self.rng.uniform(-bound, bound, (dims, HIDDEN)).ravel(), self.rng.uniform(-bound, bound, HIDDEN)])
        # Running mean and summed squares of every dimension; one scale for all.
        self.n, self.mean, self.squares, self.scale = 0, np.zeros(dims), np.zeros(dims), 1.0
        self.labels: list[str] = []
        self.place: dict[str, int] = {}
        # The rows of a block, then remembered rows of all labels; by label how many there were, and where the last of them lie (in a ring).
        self.rows, self.used = np.zeros((BLOCK + PER_CLASS, dims)), BLOCK
        self.seen, self.slots = np.zeros(0, int), np.zeros((0, PER_CLASS), int)
        self._reset()

    def _reset(self) -> None:
        self.m, self.v, self.t, self.room = np.zeros_like(self.flat), np.zeros_like(self.flat), 0, None

    def __getstate__(self) -> dict[str, Any]:
        return self.__dict__ | {"room": None}

    def parts(self, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Views of one vector as weights and offsets of the hidden layer and of the labels."""
        a = len(self.mean) * HIDDEN
        b, c = a + HIDDEN, len(flat) - len(self.labels)
        return flat[:a].reshape(-1, HIDDEN), flat[a:b], flat[b:c].reshape(HIDDEN, -1) if c > b else np.zeros((HIDDEN, 0)), flat[c:]

    def predict(self, x: np.ndarray) -> str | None:
        return self._answer((x - self.mean) / self.scale) if self.labels else None

    def _answer(self, x: np.ndarray) -> str:
        """For a row less the running mean, over the mean of the deviations of all dimensions."""
        w, w0, u, u0 = self.parts(self.flat)
        return self.labels[int((np.maximum(x @ w + w0, 0) @ u + u0).argmax())]

    def _admit(self, label: str) -> None:
        """A new class: its weights start at zero, and the moments anew."""
        w, w0, u, u0 = self.parts(self.flat)
        self.flat = np.concatenate([w.ravel(), w0, np.hstack([u, np.zeros((HIDDEN, 1))]).ravel(), u0, [0.0]])
        self.place[label] = len(self.labels)
        self.labels.append(label)
        self.seen, self.slots = np.append(self.seen, 0), np.vstack([self.slots, np.zeros((1, PER_CLASS), int)])
        self._reset()

    def _moments(self, xs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The mean and the scale after each row."""
        means, squares = np.empty_like(xs), np.empty_like(xs)
        for i, x in enumerate(xs):
            self.n += 1
            gap = x - self.mean
            self.mean = means[i] = self.mean + gap / self.n
            self.squares = squares[i] = self.squares + gap * (x - self.mean)
        n = np.arange(self.n - len(xs), self.n)
        scales = np.add.reduce(np.sqrt(squares / np.maximum(n, 1)[:, None]), axis=1) / xs.shape[1]
        scales = np.where(n == 0, 1.0, np.where(scales > 1e-6, scales, 1e-6))
        self.scale = float(scales[-1])
        return means, scales

    def _draws(self, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row labels drawn evenly and, for all but the first, which of a label's remembered rows; seen as they are after the row."""
        if self.used == BLOCK + PER_CLASS * len(self.labels):  # all labels remember as many rows as they may, so all bounds are known
            drawn = self.rng.integers(0, np.tile(np.repeat([len(self.labels), PER_CLASS], [BATCH, BATCH - 1]), (len(seen), 1)))
            return drawn[:, :BATCH], drawn[:, BATCH:]
        ys, at = np.empty((len(seen), BATCH), int), np.empty((len(seen), BATCH - 1), int)
        for i, n in enumerate(np.minimum(seen, PER_CLASS)):
            ys[i] = self.rng.integers(0, len(self.labels), BATCH)
            at[i] = self.rng.integers(0, n[ys[i, 1:]])
        return ys, at

    def _batches(self, xs: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each of some rows (at most BLOCK, of admitted labels): the row scaled as before it was seen, its batch, and the labels of that."""
        before, scale, n = self.mean, self.scale, len(xs)
        means, scales = self._moments(xs)
        asked = (xs - np.vstack([before, means[:-1]])) / np.append(scale, scales[:-1])[:, None]
        of = own[:, None] == np.arange(len(self.labels))
        rank = self.seen + np.cumsum(of, axis=0)
        ys, at = self._draws(rank)
        ys[:, 0], others = own, ys[:, 1:]
        # The place of a remembered row among all of its label; the last ones are rows of this block.
        seen = np.take_along_axis(rank, others, axis=1)
        place = np.maximum(seen - PER_CLASS, 0) + at
        order, first = np.argsort(own, kind="stable"), np.cumsum(of.sum(0)) - of.sum(0)
        new = place - self.seen[others]
        where = np.where(new < 0, self.slots[others, place % PER_CLASS], order[np.clip(first[others] + new, 0, n - 1)])
        self.rows[:n] = xs
        batches = np.empty((n, BATCH, xs.shape[1]))
        batches[:, 0], batches[:, 1:] = xs, self.rows[where]
        batches -= means[:, None]
        batches /= scales[:, None, None]
        self._remember(xs, own, rank[np.arange(n), own] - 1)
        return asked, batches, ys

    def _remember(self, xs: np.ndarray, own: np.ndarray, place: np.ndarray) -> None:
        """Rows take the places of their label's oldest ones, or new places while the label has fewer than it may."""
        more = np.flatnonzero(place < PER_CLASS)
        while self.used + len(more) > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        self.slots[own[more], place[more]] = self.used + np.arange(len(more))
        self.used += len(more)
        self.rows[self.slots[own, place % PER_CLASS]] = xs
        self.seen = self.seen + np.bincount(own, minlength=len(self.labels))

    def run(self, xs: np.ndarray, labels: list[str]) -> list[str | None]:
        """The answers to rows in order, each before its label is learned."""
        if xs.shape[1:] != self.mean.shape:
            raise ValueError(f"{xs.shape[1:]} features after {self.mean.shape}")
        out: list[str | None] = []
        while (at := len(out)) < len(labels):
            out.append(self.predict(xs[at]))
            if labels[at] not in self.place:
                self._admit(labels[at])
            end = at + 1
            while end < min(len(labels), at + BLOCK) and labels[end] in self.place:
                end += 1
            asked, batches, ys = self._batches(xs[at:end], np.array([self.place[y] for y in labels[at:end]]))
            for i in range(end - at):
                if i:
                    out.append(self._answer(asked[i]))
                self._fit(batches[i], ys[i])
        return out

    def learn(self, x: np.ndarray, label: str) -> None:
        if np.shape(x) != self.mean.shape:
            raise ValueError(f"{np.shape(x)} features after {self.mean.shape}")
        if label not in self.place:
            self._admit(label)
        _, batches, ys = self._batches(x[None], np.array([self.place[label]]))
        self._fit(batches[0], ys[0])

    def _fit(self, xs: np.ndarray, ys: np.ndarray) -> None:
        """One step on a batch."""
        if self.room is None:
            self.room = np.empty((2, len(self.flat))), np.empty((2, BATCH, HIDDEN))
        (g, a), (h, back) = self.room
        w, w0, u, u0 = self.parts(self.flat)
        np.matmul(xs, w, out=h)
        h += w0
        np.maximum(h, 0, out=h)
        z = h @ u + u0
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[ROWS, ys] -= 1
        p /= BATCH
        np.matmul(p, u.T, out=back)
        back *= (h > 0).astype(float)
        dw, dw0, du, du0 = self.parts(g)
        np.matmul(xs.T, back, out=dw)
        back.sum(0, out=dw0)
        np.matmul(h.T, p, out=du)
        p.sum(0, out=du0)
        self._step(g, a)

    def _step(self, g: np.ndarray, a: np.ndarray) -> None:
        """Adam, in place: w -= RATE * (m / first) / (sqrt(v / second) + 1e-8). g and a are written over."""
        m, v = self.m, self.v
        self.t += 1
        first, second = 1 - 0.9**self.t, 1 - 0.999**self.t
        np.subtract(g, m, out=a)
        a *= 0.1
        m += a
        np.multiply(g, g, out=a)
        a -= v
        a *= 0.001
        v += a
        np.sqrt(v if second == 1 else np.divide(v, second, out=g), out=g)
        g += 1e-8
        np.multiply(m if first == 1 else np.divide(m, first, out=a), RATE, out=a)
        a /= g
        self.flat -= a
