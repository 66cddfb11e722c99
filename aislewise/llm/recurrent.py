"""A bidirectional gated recurrent network with attention pooling, in numpy.

A token enters as the embedding of its word (a hashed bucket) and the mean embedding of its
characters, each with its two neighbours (hashed buckets as well). Both directions of gated
recurrent units read a window of tokens; attention weighs their states into one vector, and a
logistic unit turns it into the window's logit. A document is a bag of overlapping windows, and
its logit is the largest of them. Training follows that: the window that decides carries the
gradient. What depends on a distinct token alone is computed once per distinct token.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from aislewise.llm.shingles import word_hashes

WIDTH, STRIDE = 32, 24   # tokens of a window, and between the starts of windows
SIZE = 16                # of an embedding
HIDDEN = 8               # of the state of a direction
ATTENTION = 8
BUCKETS = 4096           # of words, and of characters
HIDE = 0.5               # of the distinct words of a batch are hidden in training
DECAY = 0.5              # of the weights in a training step, times the rate
_LETTERS = np.zeros(256, dtype=bool)
_LETTERS[128:] = True
_LETTERS[list(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")] = True
_FACTOR, _TOP = np.uint64(0x9E3779B97F4A7C15), np.uint64(64 - BUCKETS.bit_length() + 1)


def token_spans(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of every token: a run of letters, digits and bytes beyond ASCII."""
    inside = _LETTERS[np.frombuffer(raw, np.uint8)]
    edge = np.diff(np.r_[False, inside, False].astype(np.int8))
    return np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]


def window_starts(count: int) -> np.ndarray:
    """First tokens of the windows of a text: every ``STRIDE``, the last one flush with the end."""
    if count <= WIDTH:
        return np.zeros(1, dtype=np.int64)
    return np.minimum(np.arange(0, count - WIDTH + STRIDE, STRIDE), count - WIDTH)


@dataclass
class Tokens:
    """Distinct tokens: their word buckets and the buckets of their characters, one after another."""

    word: np.ndarray
    character: np.ndarray
    first: np.ndarray        # where each token's characters begin
    length: np.ndarray


def distinct_tokens(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[Tokens, np.ndarray]:
    """The distinct ones among the spans of a lower-case text, and the place of each span there."""
    hashes, at, place = np.unique(word_hashes(raw, starts, ends), return_index=True,
                                  return_inverse=True)
    starts, length = starts[at], (ends - starts)[at]
    first = np.cumsum(length) - length
    inside = np.arange(int(length.sum())) - np.repeat(first, length)
    data = np.frombuffer(raw, np.uint8)
    where = inside + np.repeat(starts, length)
    here = data[where].astype(np.uint64)
    before = np.where(inside > 0, data[where - (inside > 0)], 0).astype(np.uint64)
    left = np.repeat(length, length) - inside  # bytes of the token from here on
    after = np.where(left > 1, data[where + (left > 1)], 0).astype(np.uint64)
    second = np.where(left > 2, data[where + 2 * (left > 2)], 0).astype(np.uint64)
    code = (before | here << np.uint64(8) | after << np.uint64(16) | second << np.uint64(24))
    return Tokens((hashes >> _TOP).astype(np.int64),
                  ((code + np.uint64(1)) * _FACTOR >> _TOP).astype(np.int64), first, length), place


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * x))


@dataclass
class Network:
    """Weights by name, as single precision arrays."""

    weights: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def fresh(cls, seed: int = 5) -> Network:
        rng = np.random.default_rng(seed)
        draw = lambda *shape, by: (rng.normal(size=shape) * by).astype(np.float32)
        return cls({
            "word": draw(BUCKETS, SIZE, by=0.3), "character": draw(BUCKETS, SIZE, by=0.3),
            "input": draw(2 * SIZE, 6 * HIDDEN, by=(2 * SIZE) ** -0.5),
            "bias": np.zeros(6 * HIDDEN, np.float32),
            "forward": draw(HIDDEN, 3 * HIDDEN, by=HIDDEN ** -0.5),
            "backward": draw(HIDDEN, 3 * HIDDEN, by=HIDDEN ** -0.5),
            "attend": draw(2 * HIDDEN, ATTENTION, by=(2 * HIDDEN) ** -0.5),
            "query": draw(ATTENTION, by=ATTENTION ** -0.5),
            "out": draw(2 * HIDDEN, by=(2 * HIDDEN) ** -0.5),
            "out_bias": np.full(1, -1.0, np.float32)})

    def inputs(self, tokens: Tokens, shown: np.ndarray | None = None
               ) -> tuple[np.ndarray, np.ndarray]:
        """Embedded tokens, and what they add to the gates of both directions; one row of zeros
        at the end for padding."""
        w = self.weights
        if len(tokens.word):
            letters = np.add.reduceat(w["character"][tokens.character], tokens.first, axis=0)
            words = w["word"][tokens.word]
            if shown is not None:
                words = words * shown[:, None]
            x = np.hstack([words, letters / tokens.length[:, None]])
        else:
            x = np.zeros((0, 2 * SIZE))
        x = x.astype(np.float32)
        gates = np.vstack([x @ w["input"] + w["bias"], np.zeros((1, 6 * HIDDEN), np.float32)])
        return x, gates

    def _direction(self, gates: np.ndarray, windows: np.ndarray, real: np.ndarray, name: str,
                   states: np.ndarray, kept: list | None) -> None:
        """One direction over (window, place) token numbers; fills ``states`` (place, window, unit)."""
        turn = name == "backward"
        u, h = self.weights[name], np.zeros((len(windows), HIDDEN), np.float32)
        side = slice(3 * HIDDEN, None) if turn else slice(0, 3 * HIDDEN)
        mine = np.ascontiguousarray(gates[:, side])
        places = range(windows.shape[1] - 1, -1, -1) if turn else range(windows.shape[1])
        whole, numbers = bool(real.all()), np.ascontiguousarray(windows.T)
        for t in places:
            a, b = mine.take(numbers[t], axis=0), h @ u
            zr = a[:, :2 * HIDDEN] + b[:, :2 * HIDDEN]
            zr *= 0.5
            np.tanh(zr, out=zr)  # a sigmoid by halves: no overflow
            zr += 1
            zr *= 0.5
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            if not whole:
                z = np.where(real[:, t, None], z, np.float32(1))
            n = r * b[:, 2 * HIDDEN:]
            n += a[:, 2 * HIDDEN:]
            np.tanh(n, out=n)
            new = h - n
            new *= z
            new += n
            if kept is not None:
                kept.append((t, h, z, r, n, b[:, 2 * HIDDEN:]))
            h = new
            states[t, :, HIDDEN * turn:HIDDEN * (turn + 1)] = h

    def forward(self, gates: np.ndarray, windows: np.ndarray, real: np.ndarray,
                keep: bool = False) -> tuple[np.ndarray, dict]:
        """Logit of each window; ``real`` is false where a window is padded."""
        w, held = self.weights, {"forward": [], "backward": []}
        states = np.empty((windows.shape[1], len(windows), 2 * HIDDEN), np.float32)
        for name in held:
            self._direction(gates, windows, real, name, states, held[name] if keep else None)
        hidden = np.tanh(states @ w["attend"])
        score = np.where(real.T, hidden @ w["query"], np.float32(-1e9))
        weight = np.exp(score - score.max(0)) * real.T
        weight /= np.maximum(weight.sum(0), 1e-30)
        pooled = np.einsum("tn,tnk->nk", weight, states)
        logit = pooled @ w["out"] + w["out_bias"][0]
        if keep:
            held |= {"states": states, "hidden": hidden, "weight": weight, "pooled": pooled}
        return logit, held

    def gradients(self, tokens: Tokens, windows: np.ndarray, real: np.ndarray, y: np.ndarray,
                  scale: np.ndarray, shown: np.ndarray | None = None
                 ) -> tuple[dict[str, np.ndarray], float]:
        """Gradient of the weighted mean log loss of the windows' labels, and the loss."""
        w = self.weights
        x, gates = self.inputs(tokens, shown)
        logit, held = self.forward(gates, windows, real, True)
        p = _sigmoid(logit)
        loss = float((scale * (np.logaddexp(0, logit) - y * logit)).mean())
        d = (scale * (p - y) / len(y)).astype(np.float32)
        out = {"out": held["pooled"].T @ d, "out_bias": d.sum(keepdims=True)}
        pooled = d[:, None] * w["out"]
        states, hidden, weight = held["states"], held["hidden"], held["weight"]
        by_weight = np.einsum("nk,tnk->tn", pooled, states)
        score = weight * (by_weight - (weight * by_weight).sum(0))
        out["query"] = np.einsum("tn,tna->a", score, hidden)
        inner = score[:, :, None] * w["query"] * (1 - hidden * hidden)
        out["attend"] = np.einsum("tnk,tna->ka", states, inner)
        d_states = weight[:, :, None] * pooled + inner @ w["attend"].T
        d_gates = np.zeros((*windows.shape, 6 * HIDDEN), np.float32)
        for turn, name in enumerate(("forward", "backward")):
            u, grad = w[name], np.zeros_like(w[name])
            back = np.zeros((len(windows), HIDDEN), np.float32)
            for t, h, z, r, n, b in reversed(held[name]):
                dh = back + d_states[t, :, HIDDEN * turn:HIDDEN * (turn + 1)]
                d_n = dh * (1 - z) * (1 - n * n)
                d_z = dh * (h - n) * z * (1 - z)
                d_r = d_n * b * r * (1 - r)
                d_gates[:, t, 3 * HIDDEN * turn:3 * HIDDEN * (turn + 1)] = np.hstack([d_z, d_r, d_n])
                d_u = np.hstack([d_z, d_r, d_n * r])
                grad += h.T @ d_u
                back = dh * z + d_u @ u.T
            out[name] = grad
        order = np.argsort(windows, axis=None, kind="stable")
        numbers = windows.ravel()[order]
        edge = np.nonzero(np.r_[True, numbers[1:] != numbers[:-1]])[0]
        found = np.add.reduceat(d_gates.reshape(-1, 6 * HIDDEN)[order], edge)
        used = numbers[edge]
        found, used = found[used < len(x)], used[used < len(x)]  # the padding learns nothing
        out["input"], out["bias"] = x[used].T @ found, found.sum(0)
        d_x = np.zeros_like(x)
        d_x[used] = found @ w["input"].T
        out["word"], out["character"] = np.zeros_like(w["word"]), np.zeros_like(w["character"])
        by_word = d_x[:, :SIZE] if shown is None else d_x[:, :SIZE] * shown[:, None]
        np.add.at(out["word"], tokens.word, by_word)
        np.add.at(out["character"], tokens.character,
                  np.repeat(d_x[:, SIZE:] / tokens.length[:, None], tokens.length, axis=0))
        return out, loss


def logits(network: Network, texts: list[bytes], group: int = 2048,
           part: int = 1 << 20) -> np.ndarray:
    """The largest window logit of each text. Texts are joined up to ``part`` bytes at a time."""
    out = np.full(len(texts), -np.inf)
    at = 0
    while at < len(texts):
        size, upto = 0, at
        while upto < len(texts) and (upto == at or size + len(texts[upto]) < part):
            size, upto = size + len(texts[upto]) + 1, upto + 1
        _score(network, texts[at:upto], out[at:upto], group)
        at = upto
    return out


def _score(network: Network, texts: list[bytes], out: np.ndarray, group: int) -> None:
    raw = b"\n".join(texts).lower()
    starts, ends = token_spans(raw)
    edges = np.cumsum([len(t) + 1 for t in texts])
    upto = np.searchsorted(starts, edges)
    first = np.r_[0, upto[:-1]]
    counts = upto - first
    at = [window_starts(n) for n in counts.tolist()]
    text = np.repeat(np.arange(len(texts)), [len(a) for a in at])
    begin = np.concatenate(at) + first[text]
    size = np.minimum(counts[text], WIDTH)
    for k in range(0, len(text), group):
        part = slice(k, k + group)
        low, high = int(begin[k]), int((begin[part] + size[part]).max())
        if high > low:
            left, right = int(starts[low]), int(ends[high - 1])
            tokens, place = distinct_tokens(raw[left:right], starts[low:high] - left,
                                            ends[low:high] - left)
        else:
            tokens, place = no_tokens(), np.zeros(0, np.int64)
        _, gates = network.inputs(tokens)
        real = np.arange(WIDTH) < size[part, None]
        numbers = np.r_[place, len(tokens.word)]
        inside = np.where(real, begin[part, None] - low + np.arange(WIDTH), len(place))
        found, _ = network.forward(gates, numbers[inside], real)
        np.maximum.at(out, text[part], found)


def no_tokens() -> Tokens:
    none = np.zeros(0, np.int64)
    return Tokens(none, none, none, none)


@dataclass
class Bags:
    """Documents as bags of windows over one table of distinct tokens."""

    tokens: Tokens
    windows: np.ndarray      # (window, place) token numbers; the number of tokens is padding
    real: np.ndarray
    first: np.ndarray        # first window of each document, and their number
    y: np.ndarray

    @classmethod
    def of(cls, documents: list[list[bytes]], y: np.ndarray) -> Bags:
        """Documents as lists of windows, each the lower-case tokens joined by a space."""
        flat = [w for d in documents for w in d]
        raw = b"\n".join(flat)
        starts, ends = token_spans(raw)
        tokens, place = distinct_tokens(raw, starts, ends) if len(starts) else (
            no_tokens(), np.zeros(0, np.int64))
        upto = np.searchsorted(starts, np.cumsum([len(w) + 1 for w in flat]))
        begin = np.r_[0, upto[:-1]] if len(flat) else np.zeros(0, np.int64)
        real = np.arange(WIDTH) < (upto - begin)[:, None]
        inside = np.where(real, begin[:, None] + np.arange(WIDTH), len(place))
        return cls(tokens, np.r_[place, len(tokens.word)][inside], real,
                   np.r_[0, np.cumsum([len(d) for d in documents])].astype(np.int64), y)

    def logits(self, network: Network, group: int = 4096) -> np.ndarray:
        _, gates = network.inputs(self.tokens)
        return np.concatenate([network.forward(gates, self.windows[k:k + group],
                                               self.real[k:k + group])[0]
                               for k in range(0, len(self.windows), group)] or [np.zeros(0)])

    def best(self, network: Network) -> np.ndarray:
        """The largest logit of each document."""
        return np.maximum.reduceat(self.logits(network), self.first[:-1])


def fit(bags: Bags, steps: int = 160, batch: int = 192, rate: float = 0.01,
        seed: int = 11) -> Network:
    """A network trained by ``steps`` batches of Adam, whatever the number of documents. In the first
    round up to four windows a document bear its label; after that the window with the largest logit
    does. Both labels weigh the same in sum."""
    network, rng = Network.fresh(), np.random.default_rng(seed)
    mean = {k: np.zeros_like(v) for k, v in network.weights.items()}
    square = {k: np.zeros_like(v) for k, v in network.weights.items()}
    share = np.clip(bags.y.mean(), 0.01, 0.99)
    balance = np.where(bags.y > 0, 0.5 / share, 0.5 / (1 - share))
    step = 0
    while step < steps:
        if step == 0:
            chosen = np.arange(len(bags.windows))
            owner = np.repeat(np.arange(len(bags.y)), np.diff(bags.first))
            chosen = rng.permutation(chosen)[:4 * len(bags.y)]
            owner = owner[chosen]
        else:
            value = bags.logits(network)
            owner = np.arange(len(bags.y))
            chosen = np.array([a + value[a:b].argmax() for a, b in
                               zip(bags.first, bags.first[1:], strict=False)])
        order = rng.permutation(len(chosen))
        for k in range(0, min(len(order), (steps - step) * batch), batch):
            pick = order[k:k + batch]
            windows = bags.windows[chosen[pick]]
            used, place = np.unique(windows, return_inverse=True)
            pad = used[-1] == len(bags.tokens.word)
            tokens = subset(bags.tokens, used[:-1] if pad else used)
            grads, _ = network.gradients(tokens, place.reshape(windows.shape),
                                         bags.real[chosen[pick]], bags.y[owner[pick]],
                                         balance[owner[pick]],
                                         rng.random(len(tokens.word)) >= HIDE)
            step += 1
            pace = rate * (0.5 if step > steps // 2 else 1.0)
            for name, g in grads.items():
                mean[name] += 0.1 * (g - mean[name])
                square[name] += 0.001 * (g * g - square[name])
                network.weights[name] *= np.float32(1 - pace * DECAY)
                network.weights[name] -= (pace * (mean[name] / (1 - 0.9 ** step)) / (np.sqrt(
                    square[name] / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)
    return network


def subset(tokens: Tokens, chosen: np.ndarray) -> Tokens:
    length = tokens.length[chosen]
    first = np.cumsum(length) - length
    inside = np.arange(int(length.sum())) - np.repeat(first, length)
    return Tokens(tokens.word[chosen],
                  tokens.character[inside + np.repeat(tokens.first[chosen], length)], first, length)
