"""A gated recurrent network in NumPy with a class-factored output softmax.

Input: the previous token's number. Output: first the token's class, then, for
the classes of frequent words, the word within its class. Rare words share
classes by their last letters; which of them it is follows from the counts and
is not the network's matter. All parameters lie in one flat vector.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

F32 = np.float32
#: Scores within this need no shift before exp.
SAFE = 60
#: Rows of states whose output is held at a time when scoring.
ROWS = 2048


@dataclass(frozen=True)
class Shape:
    words: int = 1024       # frequent words, the end mark among them
    per_class: int = 64     # frequent words of one class
    suffixes: int = 64      # classes of rare words
    hidden: int = 16

    @property
    def groups(self) -> int:
        return self.words // self.per_class

    @property
    def classes(self) -> int:
        return self.groups + self.suffixes

    @property
    def symbols(self) -> int:
        return self.words + self.suffixes

    def parts(self) -> list[tuple[str, tuple[int, ...]]]:
        h = self.hidden
        return [("E", (self.symbols + 1, 3 * h)), ("U", (h, 3 * h)), ("Wc", (h, self.classes)),
                ("bc", (self.classes,)), ("Wi", (self.groups, h, self.per_class)), ("bi", (self.words,))]

    def split(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        out, at = {}, 0
        for name, shape in self.parts():
            n = int(np.prod(shape))
            out[name] = flat[at:at + n].reshape(shape)
            at += n
        return out

    def size(self) -> int:
        return sum(int(np.prod(s)) for _, s in self.parts())


def start(shape: Shape, class_mass: np.ndarray, word_mass: np.ndarray, seed: int = 7) -> np.ndarray:
    """Parameters before training: random recurrence, an output that knows the
    counts alone (``class_mass`` by class, ``word_mass`` by frequent word)."""
    rng = np.random.default_rng(seed)
    flat = np.zeros(shape.size(), F32)
    p = shape.split(flat)
    p["E"][:] = rng.normal(0, 0.5, p["E"].shape)
    p["U"][:] = rng.normal(0, 0.5 / np.sqrt(shape.hidden), p["U"].shape)
    p["bc"][:] = np.log(class_mass / class_mass.sum())
    p["bi"][:] = np.log(word_mass)
    return flat


def step(p: dict, g: np.ndarray, h: np.ndarray, a: np.ndarray, zr: np.ndarray, n: np.ndarray, out: np.ndarray) -> None:
    """One step of the cell; ``g``: the input's part of the three gates. Written:
    the state's part ``a``, the gates ``zr``, the candidate ``n``, the new state
    ``out``."""
    k = h.shape[1]
    np.dot(h, p["U"], out=a)
    np.add(g[:, :2 * k], a[:, :2 * k], out=zr)
    zr *= 0.5
    np.tanh(zr, out=zr)
    zr *= 0.5
    zr += 0.5
    np.multiply(zr[:, k:], a[:, 2 * k:], out=n)
    n += g[:, 2 * k:]
    np.tanh(n, out=n)
    np.subtract(h, n, out=out)
    out *= zr[:, :k]
    out += n


def _softmax(x: np.ndarray, at: np.ndarray, back: bool):
    """Log probability of column ``at`` of each row of scores ``x``, and with
    ``back`` its gradient; ``x`` is overwritten."""
    rows = np.arange(len(x))
    if x.size and (x.max() > SAFE or x.min() < -SAFE):
        x -= x.max(axis=1, keepdims=True)
    own = x[rows, at]
    np.exp(x, out=x)
    total = x @ np.ones(x.shape[1], x.dtype)
    if not back:
        return own - np.log(total), None
    x *= (-1 / total)[:, None]
    x[rows, at] += 1
    return own - np.log(total), x


def output(shape: Shape, p: dict, hs: np.ndarray, cls: np.ndarray, word: np.ndarray, back: bool = False):
    """Natural log probability of each target (class, and word if frequent)
    from hidden states; with ``back`` also the gradients of their sum."""
    scores = hs @ p["Wc"]
    scores += p["bc"]
    out, dc = _softmax(scores, cls, back)
    order = np.argsort(cls.astype(np.min_scalar_type(shape.classes)), kind="stable")
    cut = np.searchsorted(cls[order], np.arange(shape.groups + 1)).tolist()
    order = order[:cut[-1]]
    states = hs[order]
    spans = [(g, slice(cut[g], cut[g + 1])) for g in range(shape.groups) if cut[g] < cut[g + 1]]
    scores = np.empty((len(order), shape.per_class), hs.dtype)
    bias = p["bi"].reshape(shape.groups, -1)
    for g, rows in spans:
        np.dot(states[rows], p["Wi"][g], out=scores[rows])
        scores[rows] += bias[g]
    own, dw = _softmax(scores, word[order] % shape.per_class, back)
    out[order] += own
    if not back:
        return out
    grad = {"Wc": hs.T @ dc, "bc": dc.sum(0), "Wi": np.zeros_like(p["Wi"]), "bi": np.zeros_like(p["bi"])}
    dh = dc @ p["Wc"].T
    ds = np.empty_like(states)
    for g, rows in spans:
        np.dot(states[rows].T, dw[rows], out=grad["Wi"][g])
        grad["bi"][g * shape.per_class:(g + 1) * shape.per_class] = dw[rows].sum(0)
        np.dot(dw[rows], p["Wi"][g].T, out=ds[rows])
    dh[order] += ds
    return out, grad, dh


class _Window:
    """Tokens of one window of documents ``begin`` (longest first, of ``size``
    tokens), step by step: their places and inputs and the rows of each step."""

    def __init__(self, shape: Shape, symbols: np.ndarray, begin: np.ndarray, size: np.ndarray, t0: int, steps: int):
        live = np.searchsorted(-size, -np.arange(t0, t0 + steps), "left")
        live = live[live > 0]
        ends = np.cumsum(live)
        self.live, self.ends = live.tolist(), ends.tolist()
        self.who = np.arange(ends[-1]) - np.repeat(ends - live, live)
        self.at = begin[self.who] + np.repeat(np.arange(t0, t0 + len(live)), live)
        self.inputs = symbols[self.at - 1]
        if t0 == 0:
            self.inputs[:live[0]] = shape.symbols
        k = shape.hidden
        self.a, self.zr, self.n, self.hs = (np.empty((ends[-1], x * k), F32) for x in (3, 2, 1, 1))

    def forward(self, p: dict, h: np.ndarray) -> None:
        """All steps from the state ``h``, which becomes the last one."""
        gates, lo, state = p["E"][self.inputs], 0, h
        for m, hi in zip(self.live, self.ends):
            new = self.hs[lo:hi]
            step(p, gates[lo:hi], state[:m], self.a[lo:hi], self.zr[lo:hi], self.n[lo:hi], new)
            state, lo = new, hi
        lo = 0
        for k, (m, hi) in enumerate(zip(self.live, self.ends)):
            done = self.live[k + 1] if k + 1 < len(self.live) else 0
            h[done:m] = self.hs[lo + done:hi]
            lo = hi

    def backward(self, p: dict, before: np.ndarray, dhs: np.ndarray):
        """Gradients of U and of the inputs' gates from those of the states;
        ``before``: the states before each step."""
        k = before.shape[1]
        z, r, n = self.zr[:, :k], self.zr[:, k:], self.n
        dn = (1 - z) * (1 - n * n)
        parts = np.empty((len(n), 3, k), F32)
        np.multiply((before - n) * z, 1 - z, out=parts[:, 0])
        np.multiply(dn * self.a[:, 2 * k:] * r, 1 - r, out=parts[:, 1])
        np.multiply(dn, r, out=parts[:, 2])
        da, back = np.empty((len(n), 3 * k), F32), np.ascontiguousarray(p["U"].T)
        carry = None
        for m, hi in zip(reversed(self.live), reversed(self.ends)):
            d = dhs[hi - m:hi]
            if carry is not None:
                d[:len(carry)] += carry
            np.multiply(d[:, None, :], parts[hi - m:hi], out=da[hi - m:hi].reshape(m, 3, k))
            carry = da[hi - m:hi] @ back
            carry += d * z[hi - m:hi]
        grad = before.T @ da
        np.multiply(dhs, dn, out=da[:, 2 * k:])
        return grad, da


def score(shape: Shape, flat: np.ndarray, symbols: np.ndarray, cls: np.ndarray, first: np.ndarray,
          window: int = 32) -> np.ndarray:
    """Natural log probability of each document's targets. ``symbols`` and
    ``cls`` hold the tokens of all documents; document d has first[d] to
    first[d + 1]. The state is carried from window to window."""
    p = shape.split(flat)
    n = np.diff(first)
    order = np.argsort(-n, kind="stable")
    n, begin = n[order], first[:-1][order]
    total = np.zeros(len(n))
    h = np.zeros((len(n), shape.hidden), F32)
    for t0 in range(0, int(n[0]) if len(n) else 0, window):
        w = _Window(shape, symbols, begin, n, t0, window)
        w.forward(p, h)
        lp = [output(shape, p, w.hs[i:i + ROWS], cls[w.at[i:i + ROWS]], symbols[w.at[i:i + ROWS]])
              for i in range(0, len(w.at), ROWS)]
        total += np.bincount(w.who, np.concatenate(lp), minlength=len(n))
    out = np.empty(len(n))
    out[order] = total
    return out


def train(shape: Shape, flat: np.ndarray, symbols: np.ndarray, cls: np.ndarray, first: np.ndarray,
          rate: float = 0.05, window: int = 20, batch: int = 64, clip: float = 5.0) -> np.ndarray:
    """One pass of truncated backpropagation over the documents, with Adagrad
    steps; the state is carried over windows, the gradient is not."""
    flat = flat.copy()
    p = shape.split(flat)
    memory = np.full(len(flat), 1e-3, F32)
    inputs, rest = p["E"].size, [name for name, _ in shape.parts()[1:]]
    seen = memory[:inputs].reshape(p["E"].shape)
    n = np.diff(first)
    long_first = np.argsort(-n, kind="stable")
    for b0 in range(0, len(n), batch):
        docs = long_first[b0:b0 + batch]
        size, begin = n[docs], first[:-1][docs]
        h = np.zeros((len(docs), shape.hidden), F32)
        for t0 in range(0, int(size[0]), window):
            w = _Window(shape, symbols, begin, size, t0, window)
            before = np.empty_like(w.hs)
            before[:w.live[0]] = h[:w.live[0]]
            w.forward(p, h)
            for lo, m, hi in zip([0, *w.ends], w.live[1:], w.ends[1:]):
                before[hi - m:hi] = w.hs[lo:lo + m]
            _, grad, dhs = output(shape, p, w.hs, cls[w.at], symbols[w.at], back=True)
            grad["U"], gates = w.backward(p, before, dhs)
            order = np.argsort(w.inputs.astype(np.min_scalar_type(shape.symbols)), kind="stable")
            rows, start_ = np.unique(w.inputs[order], return_index=True)
            g_in = np.add.reduceat(gates[order], start_, axis=0) / (window * batch)
            g = np.concatenate([grad[name].ravel() for name in rest]) / (window * batch)
            norm = float(np.sqrt(g @ g + g_in.ravel() @ g_in.ravel()))
            if norm > clip:
                g *= clip / norm
                g_in *= clip / norm
            memory[inputs:] += g * g
            flat[inputs:] += rate * g / np.sqrt(memory[inputs:])
            squares = seen[rows] + g_in * g_in         # inputs that do not occur have no gradient
            seen[rows] = squares
            p["E"][rows] += rate * g_in / np.sqrt(squares)
    return flat
