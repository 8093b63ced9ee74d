"""A gated recurrent language model in numpy with a class-factored output layer.

P(word | before) = P(class of the word | h) * P(word | its class, h), so a prediction costs a softmax over the classes
and one over the words of a single class. Texts are laid out in lanes that a time step advances together; a lane goes
on with its next text when one ends, with a state of zeros, and windows of ``steps`` steps carry the state on.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np

F4 = np.float32


@dataclass
class Params:
    embed: np.ndarray  # words x D
    wx: np.ndarray  # D x 3H: reset, update, candidate
    wh: np.ndarray  # H x 3H
    b: np.ndarray  # 3H
    wc: np.ndarray  # (H + 1) x classes
    wo: np.ndarray  # words x (H + 1)

    def arrays(self) -> list[np.ndarray]:
        return [self.embed, self.wx, self.wh, self.b, self.wc, self.wo]

    def flat(self) -> np.ndarray:
        return np.concatenate([a.ravel() for a in self.arrays()])

    def like(self, flat: np.ndarray) -> Params:
        out, at = [], 0
        for a in self.arrays():
            out.append(flat[at : at + a.size].reshape(a.shape).astype(F4))
            at += a.size
        return Params(*out)


@dataclass
class Classes:
    """Words are numbered so that a class is a range of numbers: class k has first[k] up to first[k + 1]."""

    first: np.ndarray
    of: np.ndarray


def classes_of(words: int) -> Classes:
    """About sqrt(words) classes of consecutive words."""
    n = max(1, int(np.sqrt(words)))
    first = np.linspace(0, words, n + 1).astype(np.int64)
    return Classes(first, np.repeat(np.arange(n), np.diff(first)))


def start(counts: np.ndarray, classes: Classes, dim: int, hidden: int, seed: int) -> Params:
    """Random small weights; the biases of the output give the words' shares."""
    r = np.random.default_rng(seed)
    n, k = len(counts), len(classes.first) - 1
    share = (counts + 1) / (counts + 1).sum()
    by_class = np.add.reduceat(share, classes.first[:-1])
    wc = r.normal(0, 0.05, (hidden + 1, k))
    wc[-1] = np.log(by_class)
    wo = r.normal(0, 0.05, (n, hidden + 1))
    wo[:, -1] = np.log(share / by_class[classes.of])
    scale = lambda a, b: r.normal(0, 1 / np.sqrt(a), (a, b))
    p = Params(r.normal(0, 0.3, (n, dim)), scale(dim, 3 * hidden), scale(hidden, 3 * hidden), np.zeros(3 * hidden), wc, wo)
    return Params(*[a.astype(F4) for a in p.arrays()])


def lanes(lengths: np.ndarray, most: int) -> list[list[int]]:
    """Texts dealt over at most ``most`` lanes, the longest first and always into the shortest lane."""
    heap = [(0, k) for k in range(min(most, len(lengths)))]
    out: list[list[int]] = [[] for _ in heap]
    for i in np.argsort(-lengths, kind="stable"):
        n, k = heapq.heappop(heap)
        out[k].append(int(i))
        heapq.heappush(heap, (n + int(lengths[i]), k))
    return sorted((x for x in out if x), key=lambda x: -sum(lengths[i] for i in x))


class Layout:
    """Tokens of many texts in lanes: lane k has n[k] of them (falling), from base[k] on in tokens."""

    def __init__(self, texts: list[np.ndarray], most: int):
        lengths = np.array([len(t) for t in texts])
        dealt = lanes(lengths, most)
        order = [i for lane in dealt for i in lane]
        self.tokens = np.concatenate([texts[i] for i in order]) if order else np.zeros(0, np.int32)
        self.text = np.repeat(order, lengths[order]) if order else np.zeros(0, np.int64)
        self.n = np.array([sum(lengths[i] for i in lane) for lane in dealt], np.int64)
        self.base = np.concatenate([[0], np.cumsum(self.n)[:-1]]).astype(np.int64) if len(dealt) else np.zeros(0, np.int64)
        self.new = np.ones(len(self.tokens), bool)  # begins a text
        self.new[1:] = self.text[1:] != self.text[:-1]

    def windows(self, steps: int):
        """(lanes still going at the first step, [places of the lanes' tokens at each step])."""
        for t in range(0, int(self.n[0]) if len(self.n) else 0, steps):
            rows = []
            for u in range(t, min(t + steps, int(self.n[0]))):
                k = int(np.searchsorted(-self.n, -u, "left"))
                rows.append(self.base[:k] + u)
            yield t, rows


# Below, a column of an array is a lane's state and a row one of its numbers, so that the softmax and the gates run
# along whole rows.


def _soft(x: np.ndarray) -> np.ndarray:
    """x / (1 + |x|) in place: shaped like tanh at a fraction of its cost; its slope is (1 - |result|) ** 2."""
    d = np.abs(x)
    d += 1
    x /= d
    return x


def _gate(x: np.ndarray) -> np.ndarray:
    """(1 + soft(x)) / 2 in place; its slope is (1 - |2 result - 1|) ** 2 / 2."""
    x = _soft(x)
    x *= 0.5
    x += 0.5
    return x


def _inputs(p: Params, tokens: np.ndarray) -> np.ndarray:
    """The input's part of the gates at each token, 3H x tokens."""
    return np.ascontiguousarray((p.embed @ p.wx + p.b).take(tokens, 0).T)


def _step(wh: np.ndarray, x: np.ndarray, h: np.ndarray):
    """(next state, reset and update, h's part of the candidate, candidate); wh: 3H x H."""
    n = len(h)
    g = wh @ h
    ru = g[: 2 * n]
    ru += x[: 2 * n]
    _gate(ru)
    c = ru[:n] * g[2 * n :]
    c += x[2 * n :]
    _soft(c)
    new = h - c
    new *= ru[n:]
    new += c
    return new, ru, g[2 * n :], c


def log_probabilities(p: Params, classes: Classes, texts: list[np.ndarray], most: int = 256, steps: int = 32) -> np.ndarray:
    """Natural log-probability of each text (arrays of word numbers), its first word predicted from a state of zeros."""
    lay = Layout(texts, most)
    out = np.zeros(len(texts))
    wh = np.ascontiguousarray(p.wh.T)
    h = np.zeros((len(p.wh), len(lay.n)), p.wh.dtype)
    for _, rows in lay.windows(steps):
        places = np.concatenate(rows)
        words, fresh = lay.tokens[places], lay.new[places]
        x = _inputs(p, words)
        states = np.empty((len(h), len(words)), h.dtype)
        at = 0
        for row in rows:
            to = at + len(row)
            h = h[:, : len(row)] * ~fresh[at:to]
            states[:, at:to] = h
            h = _step(wh, x[:, at:to], h)[0]
            at = to
        out += np.bincount(lay.text[places], _log_output(p, classes, states, words), len(texts))
    return out


def _by_class(classes: Classes, words: np.ndarray):
    """(order of the words by class, [(class's first word and end, where its words are in that order)])."""
    k = classes.of[words].astype(np.int16)
    order = np.argsort(k, kind="stable")
    cut = np.searchsorted(k[order], np.arange(len(classes.first)))
    return order, [(classes.first[c], classes.first[c + 1], cut[c], cut[c + 1]) for c in np.flatnonzero(np.diff(cut))]


def _log_output(p: Params, classes: Classes, states: np.ndarray, words: np.ndarray) -> np.ndarray:
    def log_softmax_at(z, chosen):
        z -= z.max(0)
        out = z[chosen, np.arange(z.shape[1])]
        np.exp(z, out=z)
        return out - np.log(z.sum(0))

    logp = log_softmax_at(p.wc[:-1].T @ states + p.wc[-1][:, None], classes.of[words])
    order, parts = _by_class(classes, words)
    s, w = states.take(order, 1), words[order]
    inside = np.empty(len(words), states.dtype)
    for a, b, i, j in parts:
        inside[i:j] = log_softmax_at(p.wo[a:b, :-1] @ s[:, i:j] + p.wo[a:b, -1:], w[i:j] - a)
    logp[order] += inside
    return logp


class Adam:
    """Running averages of gradients and of their squares, and how many updates they hold."""

    def __init__(self, p: Params):
        self.m, self.v, self.k = [np.zeros_like(a) for a in p.arrays()], [np.zeros_like(a) for a in p.arrays()], 0


def gradient(p: Params, classes: Classes, lay: Layout, rows: list[np.ndarray], h: np.ndarray, weight: np.ndarray | None = None):
    """(gradients of the negative log-probability of a window's tokens, each times its text's weight, state behind the window);
    h: the state before it, which counts as given."""
    hidden, wh = len(p.wh), np.ascontiguousarray(p.wh.T)
    places = np.concatenate(rows)
    words, keep = lay.tokens[places], ~lay.new[places]
    n = len(words)
    x = _inputs(p, words)
    states, ru, gc, c = (np.empty((k * hidden, n), p.wh.dtype) for k in (1, 2, 1, 1))
    edges = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    for a, b in zip(edges, edges[1:]):
        h = h[:, : b - a] * keep[a:b]
        states[:, a:b] = h
        h, ru[:, a:b], gc[:, a:b], c[:, a:b] = _step(wh, x[:, a:b], h)
    dstates, dwc, dwo = _output_gradient(p, classes, states, words, None if weight is None else weight[lay.text[places]].astype(p.wh.dtype))
    r, u = ru[:hidden], ru[hidden:]
    slope = 0.5 * (1 - np.abs(2 * ru - 1)) ** 2
    by_c = (1 - u) * (1 - np.abs(c)) ** 2  # what a unit of the next state's gradient gives each gate
    by_u = (states - c) * slope[hidden:]
    by_r = gc * slope[:hidden]
    dx, dg = np.empty_like(x), np.empty_like(x)  # of the gates' inputs, and of h's part of them
    dnext = np.zeros((hidden, 0), p.wh.dtype)
    for a, b in zip(edges[-2::-1], edges[:0:-1]):
        dh = np.zeros((hidden, b - a), p.wh.dtype)
        dh[:, : dnext.shape[1]] = dnext
        dc = dh * by_c[:, a:b]
        dx[2 * hidden :, a:b] = dc
        np.multiply(dc, by_r[:, a:b], out=dx[:hidden, a:b])
        np.multiply(dh, by_u[:, a:b], out=dx[hidden : 2 * hidden, a:b])
        dg[: 2 * hidden, a:b] = dx[: 2 * hidden, a:b]
        np.multiply(dc, r[:, a:b], out=dg[2 * hidden :, a:b])
        dh *= u[:, a:b]
        dh += p.wh @ dg[:, a:b]
        dh += dstates[:, a:b]
        dnext = dh * keep[a:b]
    order = np.argsort(words, kind="stable")
    at = np.flatnonzero(np.diff(words[order], prepend=-1))
    dembed = np.zeros_like(p.embed)
    de = dx.T @ p.wx.T
    dembed[words[order][at]] = np.add.reduceat(de[order], at)
    return [dembed, p.embed[words].T @ dx.T, states @ dg.T, dx.sum(1), dwc, dwo], h


def train(p: Params, classes: Classes, texts: list[np.ndarray], rate: float, most: int = 192, steps: int = 16, clip: float = 5.0, adam: Adam | None = None, weight: np.ndarray | None = None) -> Params:
    """One pass over ``texts`` by backpropagation truncated to windows of ``steps`` steps, with Adam's updates; p is
    changed in place. ``adam`` carries the averages on from one call to the next; ``weight``: how often each text counts."""
    adam = adam or Adam(p)
    lay = Layout(texts, most)
    h = np.zeros((len(p.wh), len(lay.n)), p.wh.dtype)
    for _, rows in lay.windows(steps):
        adam.k += 1
        grads, h = gradient(p, classes, lay, rows, h, weight)
        n = sum(map(len, rows)) if weight is None else float(weight[lay.text[np.concatenate(rows)]].sum())
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads)) / n
        factor = min(1.0, clip / max(norm, 1e-9)) / n
        for a, g, mm, vv in zip(p.arrays(), grads, adam.m, adam.v, strict=True):
            g *= F4(factor)
            mm += F4(0.1) * (g - mm)
            vv += F4(0.01) * (g * g - vv)
            a -= F4(rate) * (mm / F4(1 - 0.9**adam.k)) / (np.sqrt(vv / F4(1 - 0.99**adam.k)) + F4(1e-6))
    return p


def _output_gradient(p: Params, classes: Classes, states: np.ndarray, words: np.ndarray, weight: np.ndarray | None):
    def softmax_minus(z, chosen, weight):
        z -= z.max(0)
        np.exp(z, out=z)
        z /= z.sum(0)
        z[chosen, np.arange(z.shape[1])] -= 1
        if weight is not None:
            z *= weight
        return z

    z = softmax_minus(p.wc[:-1].T @ states + p.wc[-1][:, None], classes.of[words], weight)
    dwc = np.concatenate([states @ z.T, z.sum(1)[None]])
    dstates = p.wc[:-1] @ z
    dwo = np.zeros_like(p.wo)
    order, parts = _by_class(classes, words)
    s, w = states.take(order, 1), words[order]
    ds = np.empty_like(s)
    for a, b, i, j in parts:
        z = softmax_minus(p.wo[a:b, :-1] @ s[:, i:j] + p.wo[a:b, -1:], w[i:j] - a, None if weight is None else weight[order[i:j]])
        ds[:, i:j] = p.wo[a:b, :-1].T @ z
        dwo[a:b, :-1] = z @ s[:, i:j].T
        dwo[a:b, -1] = z.sum(1)
    dstates[:, order] += ds
    return dstates, dwc, dwo
