"""Bidirectional gated recurrent network with attention pooling, in numpy.

A word enters as the sum of two looked-up parts: a hashed word vector and the
scaled sum of hashed character n-gram vectors (with and without an anchor at
the word's start).  Two recurrent layers read a window of words in both
directions; attention weights, a softmax over the window's positions, pool the
states; a linear unit gives the window's logit.  A text's logit is that of its
highest window, in training (multiple-instance learning: only the text is
labelled) as in scoring."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from innkeep.llm.textscan import LETTER, LOWER, RangeHasher, words

WORD_ROWS, CHAR_ROWS = 1 << 15, 1 << 16
WORD_DIM, CHAR_DIM, HIDDEN = 6, 6, 8
NGRAMS = (3, 4, 5)
WINDOW, STRIDE = 48, 32
CAUTION = 0.5
WORD_START, CHAR_START = 0.5, 0.25
TABLE_RATE = 1.0           # of the learning rate, for the looked-up vectors
F32 = np.float32


@dataclass
class Vocabulary:
    """Distinct words of a run of texts: word row, and n-gram rows in CSR form."""
    word: np.ndarray
    grams: np.ndarray
    first: np.ndarray


def _row(h: np.ndarray) -> np.ndarray:
    return ((h >> np.uint64(40)) % np.uint64(CHAR_ROWS)).astype(np.int32)


def read_words(data: np.ndarray, offsets: np.ndarray) -> tuple[Vocabulary, np.ndarray, np.ndarray]:
    """(vocabulary, word number of each token, first token of each text)."""
    low = LOWER[data]
    start, end, first = words(low, offsets, LETTER)
    hasher = RangeHasher(low)
    distinct, at, ids = np.unique(hasher(start, end), return_index=True, return_inverse=True)
    start, end = start[at], end[at]
    parts, owners = [], []
    for n in NGRAMS:
        many = np.maximum(end - start - n + 1, 0)
        owner = np.repeat(np.arange(len(start), dtype=np.int32), many)
        pos = start[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
        h = hasher(pos, pos + n)
        anchor = pos == start[owner]
        parts += [_row(h), _row(h[anchor] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(n))]
        owners += [owner, owner[anchor]]
    owner = np.concatenate(owners)
    grams = np.concatenate(parts)[np.argsort(owner, kind="stable")]
    counts = np.bincount(owner, minlength=len(start))
    return (Vocabulary((distinct >> np.uint64(40)).astype(np.int64) % WORD_ROWS, grams,
                       np.concatenate([[0], np.cumsum(counts)])), ids.astype(np.int64), first)


def window_starts(n: int) -> np.ndarray:
    """First tokens of the overlapping windows over ``n`` tokens: every
    ``STRIDE``, and one that ends with the text."""
    if n <= WINDOW:
        return np.zeros(min(n, 1), np.int64)
    starts = np.arange(0, n - WINDOW + 1, STRIDE)
    return starts if starts[-1] == n - WINDOW else np.append(starts, n - WINDOW)


def windows(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token positions [window, WINDOW], valid, text of each window) of all
    texts; a text without tokens has no window."""
    n = np.diff(first)
    per = np.where(n > WINDOW, 1 + -(-(n - WINDOW) // STRIDE), np.minimum(n, 1))
    text = np.repeat(np.arange(len(n)), per)
    k = np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)
    start = np.minimum(k * STRIDE, np.maximum(n[text] - WINDOW, 0))
    pos = start[:, None] + np.arange(WINDOW)[None, :]
    valid = pos < n[text][:, None]
    return first[:-1][text][:, None] + np.where(valid, pos, 0), valid, text


def _segment_sum(rows: np.ndarray, first: np.ndarray) -> np.ndarray:
    out = np.zeros((len(first) - 1, rows.shape[1]), F32)
    has = np.flatnonzero(np.diff(first))
    if len(has):
        out[has] = np.add.reduceat(rows, first[:-1][has], axis=0)
    return out


def _csr_take(vocab: Vocabulary, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """n-gram rows of some words, and their first positions."""
    n = np.diff(vocab.first)[some]
    first = np.concatenate([[0], np.cumsum(n)])
    return vocab.grams[np.repeat(vocab.first[:-1][some] - first[:-1], n) + np.arange(first[-1])], first


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


@dataclass
class BiGRU:
    """Parameters by name; axis 0 of ``x``, ``b``, ``u`` is the direction."""
    p: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def fresh(cls, seed: int = 0) -> BiGRU:
        rng = np.random.default_rng(seed)
        h, d = HIDDEN, WORD_DIM + CHAR_DIM

        def normal(*shape, scale):
            return rng.normal(0, scale, shape).astype(F32)
        return cls({"word": np.zeros((WORD_ROWS, WORD_DIM), F32), "char": np.zeros((CHAR_ROWS, CHAR_DIM), F32),
                    "x": normal(2, d, 3 * h, scale=d ** -0.5), "b": np.zeros((2, 1, 3 * h), F32),
                    "u": normal(2, h, 3 * h, scale=h ** -0.5), "attend": normal(2 * h, scale=0.3),
                    "out": normal(2 * h, scale=0.3), "bias": np.full(1, -1.0, F32)})

    # forward ----------------------------------------------------------------

    def inputs(self, vocab: Vocabulary, some: np.ndarray | None = None):
        """Input vectors of the vocabulary's (or some of its) words."""
        if some is None:
            word, grams, first = vocab.word, vocab.grams, vocab.first
        else:
            word, (grams, first) = vocab.word[some], _csr_take(vocab, some)
        scale = (1 / np.sqrt(np.maximum(np.diff(first), 1))).astype(F32)[:, None]
        chars = _segment_sum(self.p["char"][grams], first) * scale
        return np.concatenate([self.p["word"][word], chars], axis=1), (word, grams, first, scale)

    def run(self, gates: np.ndarray, token: np.ndarray, valid: np.ndarray, keep: bool = False):
        """Logits of windows.  ``gates``: [direction, word, 3 * HIDDEN] input
        parts; ``token``: word number [window, position]."""
        p, h = self.p, HIDDEN
        n, width = token.shape
        full = bool(valid.all())
        state, states, steps = np.zeros((2, n, h), F32), np.empty((width, 2, n, h), F32), []
        for t in range(width):
            back = width - 1 - t
            x = np.stack([gates[0][token[:, t]], gates[1][token[:, back]]])
            g = state @ p["u"]
            rz = _sigmoid(x[..., :2 * h] + g[..., :2 * h])
            r, z = rz[..., :h], rz[..., h:]
            new = np.tanh(x[..., 2 * h:] + r * g[..., 2 * h:])
            nxt = new + z * (state - new)
            if not full:
                m = np.stack([valid[:, t], valid[:, back]])[..., None]
                nxt = np.where(m, nxt, state)
            if keep:
                steps.append((state, r, z, new, g[..., 2 * h:], None if full else m))
            state = nxt
            states[t, 0], states[back, 1] = state[0], state[1]
        seen = np.concatenate([states[:, 0], states[:, 1]], axis=2)               # [position, window, 2h]
        e = seen @ p["attend"]
        if not full:
            e[~valid.T] = -1e9
        e -= e.max(axis=0)
        np.exp(e, out=e)
        e /= e.sum(axis=0)
        pooled = np.einsum("tn,tnh->nh", e, seen)
        logit = pooled @ p["out"] + p["bias"][0]
        return (logit, (steps, seen, e, pooled)) if keep else logit

    def gates(self, x: np.ndarray) -> np.ndarray:
        return x @ self.p["x"] + self.p["b"]

    def text_logits(self, data: np.ndarray, offsets: np.ndarray, at_once: int = 2048) -> np.ndarray:
        """Highest window logit of each text; -inf for a text without words."""
        vocab, ids, first = read_words(data, offsets)
        out = np.full(len(offsets) - 1, -np.inf, F32)
        if not len(ids):
            return out
        gates = self.gates(self.inputs(vocab)[0])
        pos, valid, text = windows(first)
        whole = valid.all(axis=1)
        for group in (np.flatnonzero(whole), np.flatnonzero(~whole)):
            for lo in range(0, len(group), at_once):
                some = group[lo:lo + at_once]
                np.maximum.at(out, text[some], self.run(gates, ids[pos[some]], valid[some]))
        return out

    # training ---------------------------------------------------------------

    def gradients(self, vocab: Vocabulary, token: np.ndarray, valid: np.ndarray, text: np.ndarray, label: np.ndarray):
        """Gradients of the mean cross entropy of some texts' highest windows.
        ``text`` is sorted and numbers the texts of ``label`` from 0."""
        p, h = self.p, HIDDEN
        some, local = np.unique(token, return_inverse=True)
        local = local.reshape(token.shape)
        x, (word, grams, first, scale) = self.inputs(vocab, some)
        # which window is highest is found without keeping states; only those are run again with them
        quick = self.run(self.gates(x), local, valid)
        order = np.lexsort((quick, text))
        top = order[np.append(text[order][1:] != text[order][:-1], True)]
        which, local, valid = text[top], local[top], valid[top]
        logit, (steps, seen, att, pooled) = self.run(self.gates(x), local, valid, keep=True)
        d_logit = ((1 / (1 + np.exp(-logit))) - label[which]).astype(F32) / len(which)
        grad = {"out": pooled.T @ d_logit, "bias": np.array([d_logit.sum()], F32)}
        d_pooled = d_logit[:, None] * p["out"]
        d_att = np.einsum("nh,tnh->tn", d_pooled, seen)
        d_e = att * (d_att - (att * d_att).sum(axis=0))
        d_seen = att[..., None] * d_pooled + d_e[..., None] * p["attend"]
        grad["attend"] = np.einsum("tn,tnh->h", d_e, seen)
        width, n = att.shape
        d_gates, d_u, carry = np.zeros((2, len(some), 3 * h), F32), np.zeros_like(p["u"]), np.zeros((2, n, h), F32)
        for t in range(width - 1, -1, -1):
            back = width - 1 - t
            state, r, z, new, gn, m = steps[t]
            d = carry + np.stack([d_seen[t][:, :h], d_seen[back][:, h:]])
            through = 0.0
            if m is not None:
                through, d = np.where(m, 0, d), np.where(m, d, 0)
            d_new = d * (1 - z) * (1 - new * new)
            d_z = d * (state - new) * z * (1 - z)
            d_r = d_new * gn * r * (1 - r)
            d_g = np.concatenate([d_r, d_z, d_new * r], axis=2)
            d_u += state.transpose(0, 2, 1) @ d_g
            d_x = np.concatenate([d_r, d_z, d_new], axis=2)
            np.add.at(d_gates[0], local[:, t], d_x[0])
            np.add.at(d_gates[1], local[:, back], d_x[1])
            carry = d * z + d_g @ p["u"].transpose(0, 2, 1) + through
        grad |= {"u": d_u, "x": x.T @ d_gates, "b": d_gates.sum(axis=1, keepdims=True)}
        d_in = (d_gates @ p["x"].transpose(0, 2, 1)).sum(axis=0)
        grad["word"], grad["char"] = np.zeros_like(p["word"]), np.zeros_like(p["char"])
        np.add.at(grad["word"], word, d_in[:, :WORD_DIM])
        np.add.at(grad["char"], grams, np.repeat(d_in[:, WORD_DIM:] * scale, np.diff(first), axis=0))
        return grad


def _log_odds(pos: np.ndarray, neg: np.ndarray, texts: int, labelled: float) -> np.ndarray:
    """Log odds of label 1 for hashed rows that occur in ``pos`` and ``neg``
    texts of the labels, drawn towards 0 by ``CAUTION`` standard errors, so
    rows seen in a few texts only start neutral."""
    pos, neg = pos + 0.5, neg + 0.5
    odds = np.log(pos / (labelled + 1)) - np.log(neg / (texts - labelled + 1))
    return (np.sign(odds) * np.maximum(np.abs(odds) - CAUTION * np.sqrt(1 / pos + 1 / neg), 0)).astype(F32)


def _start_vectors(vocab: Vocabulary, ids: np.ndarray, first: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log odds of the word rows and of the n-gram rows; some texts at a time,
    as their n-grams are many."""
    seen = {True: (np.zeros(WORD_ROWS), np.zeros(CHAR_ROWS)), False: (np.zeros(WORD_ROWS), np.zeros(CHAR_ROWS))}
    for i, y in enumerate(label):
        own = np.unique(ids[first[i]:first[i + 1]])
        for counts, rows in zip(seen[bool(y)], (vocab.word[own], _csr_take(vocab, own)[0])):
            counts[np.unique(rows)] += 1
    return tuple(_log_odds(p, n, len(label), float(label.sum())) for p, n in zip(seen[True], seen[False]))


def train(data: np.ndarray, offsets: np.ndarray, label: np.ndarray, epochs: int = 4, least_steps: int = 150,
          batch: int = 48, rate: float = 0.01, seed: int = 0) -> BiGRU:
    """Fits the network to whole labelled texts with Adam.

    The first coordinate of the word and n-gram vectors starts at the rows' log
    odds among the training texts, all others at 0, so rows never seen in
    training stay neutral."""
    model = BiGRU.fresh(seed)
    vocab, ids, first = read_words(data, offsets)
    label = label.astype(F32)
    word_odds, char_odds = _start_vectors(vocab, ids, first, label)
    model.p["word"][:, 0], model.p["char"][:, 0] = WORD_START * word_odds, CHAR_START * char_odds
    pos, valid, text = windows(first)
    window_first = np.searchsorted(text, np.arange(len(label) + 1))
    rng, moment, second, step = np.random.default_rng(seed), {}, {}, 0
    usable = np.flatnonzero(np.diff(window_first))
    while len(usable) and (epochs > 0 or step < least_steps):
        epochs -= 1
        shuffled = rng.permutation(usable)
        for lo in range(0, len(shuffled), batch):
            chosen = np.sort(shuffled[lo:lo + batch])
            rows = np.concatenate([np.arange(window_first[i], window_first[i + 1]) for i in chosen])
            grad = model.gradients(vocab, ids[pos[rows]], valid[rows], np.searchsorted(chosen, text[rows]), label[chosen])
            step += 1
            for k, g in grad.items():
                m = moment[k] = 0.9 * moment.get(k, 0) + 0.1 * g
                s = second[k] = 0.99 * second.get(k, 0) + 0.01 * g * g
                pace = rate * (TABLE_RATE if k in ("word", "char") else 1)
                model.p[k] -= (pace * (m / (1 - 0.9 ** step)) / (np.sqrt(s / (1 - 0.99 ** step)) + 1e-6)).astype(F32)
    return model
