"""A character-level bidirectional LSTM with a CRF on top, in numpy: training, and fast tagging of long texts.

The gates of a direction are ``table[class] + h @ u``: the input's projection is
looked up, not multiplied.  In place of tanh stands a rational function of like
shape that reaches 1 at 3; a sigmoid is half of it plus a half, so one pass over
all gates gives the sigmoids too.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

#: Fixed list of characters with a class of their own.
OWN = "atdo@.-_+()[]{}<>:;,/\\#*$%&=|'\" \n\t\xa0·•"
PAD, LOWER, UPPER, DIGIT, OTHER, FIRST = 0, 1, 2, 3, 4, 5
CLASSES = FIRST + len(OWN)
CODES = 0x2100


def class_table() -> np.ndarray:
    """The class of each code point below CODES; all above are OTHER, or LOWER if letters."""
    out = np.full(CODES + 1, OTHER, np.uint8)
    for c in range(CODES):
        if (x := chr(c)).isdigit() and c < 128:
            out[c] = DIGIT
        elif x.isupper():
            out[c] = UPPER
        elif x.isalpha():
            out[c] = LOWER
    for k, x in enumerate(OWN):
        out[ord(x)] = FIRST + k
    out[CODES] = LOWER
    return out


def classes_of(text: str, table: np.ndarray) -> np.ndarray:
    return table[np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), CODES)]


@dataclass
class Tagger:
    """Parameters of both directions (forward, backward), of the output layer and of the CRF."""

    table: list[np.ndarray]  # CLASSES x 4H, gates in the order i, f, o, g
    u: list[np.ndarray]  # H x 4H
    out: list[np.ndarray]  # H x tags
    bias: np.ndarray
    move: np.ndarray  # from tag x to tag

    def parameters(self) -> list[np.ndarray]:
        return [*self.table, *self.u, *self.out, self.bias, self.move]

    @property
    def margin(self) -> float:
        """If tag 0 leads every emission by this much, the best path is all 0: a detour of n steps gains at most n + 1 moves."""
        return 2 * max(0.0, float((self.move - self.move[0, 0]).max()))

    def emissions(self, x: np.ndarray) -> np.ndarray:
        """``x`` steps x windows -> steps x tags x windows."""
        steps, n = x.shape
        size, x = self.u[0].shape[0], x.astype(np.intp)
        em = np.empty((steps, len(self.bias), n), np.float32)
        em[:] = self.bias[None, :, None]
        seen = np.empty((steps, size, n), np.float32)
        z, more, room = (np.empty((4 * size, n), np.float32) for _ in range(3))
        gate, (i, f, o, g) = z[: 3 * size], (z[k * size : (k + 1) * size] for k in range(4))
        for d, order in enumerate((range(steps), range(steps - 1, -1, -1))):
            table, u, out = (np.ascontiguousarray(a[d].T, np.float32) for a in (self.table, self.u, self.out))
            h, c = np.zeros((size, n), np.float32), np.zeros((size, n), np.float32)
            for t in order:
                np.take(table, x[t], axis=1, out=z, mode="clip")
                np.dot(u, h, out=more)
                z += more
                squash(z, more, room)
                gate += 1
                c *= f
                i *= g
                c += i
                c *= 0.5
                h = seen[t]
                np.copyto(h, c)
                squash(h, more[:size], room[:size])
                h *= o
                h *= 0.5
            em += np.matmul(out, seen)
        return em

    def best_paths(self, stretches: list[np.ndarray], opening: np.ndarray) -> list[np.ndarray]:
        """Viterbi over emissions (steps x tags each); before a stretch and behind it stands tag 0, unless ``opening`` says that a text begins."""
        length, found = np.array([len(e) for e in stretches], np.int64), [np.zeros(0, np.int8)] * len(stretches)
        move, order = self.move.astype(np.float32), np.argsort(length, kind="stable")
        for part in (order[k : k + 2048] for k in range(0, len(order), 2048)):
            steps, n, tags = int(length[part[-1]]) + 1, len(part), len(move)
            em = np.full((steps, n, tags), -1e9, np.float32)
            em[:, :, 0] = 0
            for row, k in enumerate(part):
                em[: length[k], row] = stretches[k]
            score, back = em[0] + np.where(opening[part, None], 0, move[0]), np.zeros((steps, n, tags), np.int8)
            for t in range(1, steps):
                best, from_ = score[:, 0, None] + move[0], back[t]
                for x in range(1, tags):
                    other = score[:, x, None] + move[x]
                    from_[other > best] = x
                    np.maximum(best, other, out=best)
                score = best + em[t]
            path = np.zeros((steps, n), np.int8)
            path[-1] = score.argmax(1)
            for t in range(steps - 1, 0, -1):
                path[t - 1] = back[t][np.arange(n), path[t]]
            for row, k in enumerate(part):
                found[k] = path[: length[k], row]
        return found

    def tag(self, texts: list[np.ndarray], core: int = 640, context: int = 32, apart: int = 64, most: int = 1 << 19) -> Iterator[list[tuple[int, int, int]]]:
        """Per text of classes the runs (tag, start, end) of tags other than 0.

        Each position belongs to the core of one window, and windows overlap by the context on both sides.  A
        position has the emissions of its own window; the windows' emissions are put together over the whole text,
        and one best path is sought in each stretch of it between ``apart`` positions where tag 0 is sure.
        """
        windows = [(k, s) for k, x in enumerate(texts) for s in range(0, len(x), core)]
        span = [(max(0, s - context), min(len(texts[k]), s + core + context)) for k, s in windows]
        length = np.array([b - a for a, b in span], np.int64)
        order = np.argsort(-length, kind="stable")
        unsure: dict[int, list[np.ndarray]] = {}  # places by text, in the order of the windows
        kept: dict[tuple[int, int], np.ndarray] = {}  # core emissions of the windows that have some
        lo = 0
        while lo < len(order):
            size = int(length[order[lo]])
            hi = min(len(order), lo + max(1, most // size), lo + int(np.searchsorted(-length[order[lo:]], -0.8 * size, "right")))
            part, lo = order[lo:hi], hi
            x = np.zeros((len(part), size), np.uint8)
            for row, w in enumerate(part):
                a, b = span[w]
                x[row, : b - a] = texts[windows[w][0]][a:b]
            em = self.emissions(x.T)
            doubt = em[:, 0] - em[:, 1:].max(1) < self.margin
            for row in np.flatnonzero(doubt.any(0)).tolist():
                k, s = windows[part[row]]
                own = slice(s - span[part[row]][0], min(s + core, len(texts[k])) - span[part[row]][0])
                if len(at := np.flatnonzero(doubt[own, row])):
                    unsure.setdefault(k, []).append(at + s)
                    kept[k, s // core] = em[own, :, row].copy()
        stretches, where = [], []
        for k, places in unsure.items():
            at = np.sort(np.concatenate(places))
            for run in np.split(at, np.flatnonzero(np.diff(at) > apart) + 1):
                i, j = int(run[0]), int(run[-1]) + 1
                stretches.append(np.concatenate([kept[k, w][max(0, i - w * core) : j - w * core] for w in range(i // core, (j - 1) // core + 1)]))
                where.append((k, i))
        found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for (k, start), path in zip(where, self.best_paths(stretches, np.array([i == 0 for _, i in where], bool)), strict=True):
            edges = np.flatnonzero(np.r_[True, np.diff(path) != 0, True])
            for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if path[i]:
                    found[k].append((int(path[i]), start + i, start + j))
        yield from (sorted(runs, key=lambda r: r[1]) for runs in found)


def squash(x: np.ndarray, s: np.ndarray, room: np.ndarray) -> None:
    """The rational function in place; ``s`` and ``room`` are scratch of the same shape."""
    np.clip(x, -3, 3, out=x)
    np.multiply(x, x, out=s)
    np.add(s, 27, out=room)
    x *= room
    s *= 9
    s += 27
    x /= s


def squashed(x: np.ndarray) -> np.ndarray:
    x = np.clip(x, -3, 3)
    return x * (27 + x * x) / (27 + 9 * x * x)


def slope(x: np.ndarray) -> np.ndarray:
    """Its derivative."""
    s = np.minimum(x * x, 9)
    return (9 - s) ** 2 / (9 * (3 + s) ** 2)


def _forward(model: Tagger, x: np.ndarray, d: int):
    steps, n = x.shape
    size = model.u[d].shape[0]
    h, c = np.zeros((steps + 1, n, size)), np.zeros((steps + 1, n, size))
    gates, into = np.empty((steps, n, 4 * size)), np.empty((steps, n, 4 * size))
    order = range(steps) if d == 0 else range(steps - 1, -1, -1)
    k = 0
    for t in order:
        into[k] = model.table[d][x[t]] + h[k] @ model.u[d]
        z = squashed(into[k])
        z[:, : 3 * size] = (z[:, : 3 * size] + 1) / 2
        gates[k] = z
        c[k + 1] = z[:, size : 2 * size] * c[k] + z[:, :size] * z[:, 3 * size :]
        h[k + 1] = z[:, 2 * size : 3 * size] * squashed(c[k + 1])
        k += 1
    rise = slope(into)
    rise[:, :, : 3 * size] /= 2
    return h, c, gates, rise


def _gradients(model: Tagger, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean negative log-likelihood of the tag sequences ``y`` (steps x windows) and its gradients."""
    steps, n = x.shape
    size, tags = model.u[0].shape[0], len(model.bias)
    passes = [_forward(model, x, d) for d in (0, 1)]
    em = passes[0][0][1:] @ model.out[0] + passes[1][0][1:][::-1] @ model.out[1] + model.bias
    # Forward and backward sums of the CRF in log space.
    up, down = np.empty_like(em), np.zeros_like(em)
    up[0] = em[0]
    lse = lambda a, axis: (m := a.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(a - m).sum(axis))
    for t in range(1, steps):
        up[t] = lse(up[t - 1][:, :, None] + model.move, 1) + em[t]
    for t in range(steps - 2, -1, -1):
        down[t] = lse(model.move + (em[t + 1] + down[t + 1])[:, None, :], 2)
    total = lse(up[-1], 1)
    g_em = np.exp(up + down - total[None, :, None])
    pair = np.exp(up[:-1, :, :, None] + model.move + (em[1:] + down[1:])[:, :, None, :] - total[None, :, None, None]).sum((0, 1))
    t_at, n_at = np.indices((steps, n))
    gold = em[t_at, n_at, y].sum(0) + model.move[y[:-1], y[1:]].sum(0)
    loss = float((total - gold).sum()) / (steps * n)
    g_em[t_at, n_at, y] -= 1
    np.subtract.at(pair, (y[:-1].ravel(), y[1:].ravel()), 1)
    scale = 1 / (steps * n)
    g_em, pair = g_em * scale, pair * scale
    g_table, g_u, g_out = [], [], []
    for d in (0, 1):
        h, c, gates, rise = passes[d]
        own = g_em if d == 0 else g_em[::-1]
        g_out.append(np.einsum("tnh,tnk->hk", h[1:], own))
        into = own @ model.out[d].T
        dz = np.empty_like(gates)
        dh, dc = np.zeros((n, size)), np.zeros((n, size))
        for k in range(steps - 1, -1, -1):
            i, f, o, g = (gates[k][:, j * size : (j + 1) * size] for j in range(4))
            dh = dh + into[k]
            dc = dc + dh * o * slope(c[k + 1])
            dz[k] = np.concatenate([dc * g, dc * c[k], dh * squashed(c[k + 1]), dc * i], 1) * rise[k]
            dc = dc * f
            dh = dz[k] @ model.u[d].T
        g_u.append(np.einsum("tnh,tnk->hk", h[:-1], dz))
        one = np.zeros((x.size, CLASSES), np.float64)
        one[np.arange(x.size), (x if d == 0 else x[::-1]).ravel()] = 1
        g_table.append(one.T @ dz.reshape(-1, 4 * size))
    return loss, [*g_table, *g_u, *g_out, g_em.sum((0, 1)), pair]


def train(x: np.ndarray, y: np.ndarray, tags: int, size: int = 8, steps: int = 260, batch: int = 64, rate: float = 0.02, seed: int = 8) -> Tagger:
    """``x`` and ``y`` windows x characters.  Adam with a falling rate; the classes' and gates' weights start small at random."""
    rng = np.random.Generator(np.random.PCG64(seed))
    start = lambda *shape: rng.standard_normal(shape) * 0.2
    model = Tagger([start(CLASSES, 4 * size) for _ in "fb"], [start(size, 4 * size) for _ in "fb"], [start(size, tags) for _ in "fb"], np.zeros(tags), np.zeros((tags, tags)))
    for t in model.table:
        t[:, size : 2 * size] += 0.5  # remember at first
    model.bias[0] = 2.0
    first, second = ([np.zeros_like(p) for p in model.parameters()] for _ in "mv")
    for k in range(1, steps + 1):
        rows = rng.choice(len(x), min(batch, len(x)), replace=False)
        _, grads = _gradients(model, x[rows].T, y[rows].T)
        norm = np.sqrt(sum(float((g**2).sum()) for g in grads))
        now = rate * (1 - 0.9 * k / steps)
        for p, g, m, v in zip(model.parameters(), grads, first, second, strict=True):
            g = g * min(1, 0.5 / max(norm, 1e-12))
            m += 0.1 * (g - m)
            v += 0.01 * (g**2 - v)
            p -= now * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return model
