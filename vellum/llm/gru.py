"""A small bidirectional gated recurrent network with attention pooling, in numpy.

Inputs of a word: a hashed word embedding and the mean of its hashed
character n-gram embeddings. Both directions read the window, attention
weighs their states, and a linear layer gives the window's logit. Forward and
backward passes are written out; training is Adam on the logistic loss.
"""

from __future__ import annotations

from zlib import crc32

import numpy as np

from vellum.llm.common import gram_ids, letters_only

WORD_BITS, GRAM_BITS, GRAMS = 14, 15, (3, 5, 6)
DIM, HIDDEN, ATT = 8, 8, 8


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashed word ids, flat gram ids, word number of each gram) of raw tokens."""
    clean = letters_only(words)
    whole = np.array([crc32(w.encode("utf-8", "replace")) for w in clean], np.int64) & ((1 << WORD_BITS) - 1)
    return whole, *gram_ids(clean, GRAMS, GRAM_BITS)


def init(seed: int = 7) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)

    def mat(*shape, scale):
        return (rng.standard_normal(shape) * scale).astype(np.float32)

    p = {"word": mat(1 << WORD_BITS, DIM, scale=0.1), "gram": mat(1 << GRAM_BITS, DIM, scale=0.3)}
    for d in "fb":
        p |= {f"W{d}": mat(2 * DIM, 3 * HIDDEN, scale=0.3), f"U{d}": mat(HIDDEN, 3 * HIDDEN, scale=0.3),
              f"c{d}": np.zeros(3 * HIDDEN, np.float32)}
    return p | {"Wa": mat(2 * HIDDEN, ATT, scale=0.3), "ba": np.zeros(ATT, np.float32), "v": mat(ATT, scale=0.3),
                "w": mat(2 * HIDDEN, scale=0.3), "b": np.zeros(1, np.float32)}


def inputs(p: dict, features: tuple) -> np.ndarray:
    """(words, 2 * DIM) inputs: word embedding beside the mean gram embedding."""
    word, gram, of = features
    n = np.bincount(of, minlength=len(word)).astype(np.float32)
    summed = np.stack([np.bincount(of, p["gram"][gram, k], minlength=len(word)) for k in range(DIM)], 1)
    return np.concatenate([p["word"][word], summed.astype(np.float32) / np.maximum(n, 1)[:, None]], 1)


def projections(p: dict, words: list[str]) -> np.ndarray:
    """Each word's share of the gates of both directions, all that scoring needs of it."""
    x = inputs(p, word_features(words))
    return np.concatenate([x @ p["Wf"] + p["cf"], x @ p["Wb"] + p["cb"]], 1)


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


def _run(gates: np.ndarray, ids: np.ndarray, mask: np.ndarray, U: np.ndarray, back: bool, keep: bool):
    """Hidden states (T, B, H) of one direction; with ``keep`` also what the backward pass needs."""
    T, B = ids.shape
    H = HIDDEN
    h = np.zeros((B, H), np.float32)
    states = np.empty((T, B, H), np.float32)
    kept = {}
    whole = bool(mask.all())
    for t in range(T - 1, -1, -1) if back else range(T):
        g, u = gates[ids[t]], h @ U
        zr = _sigmoid(g[:, :2 * H] + u[:, :2 * H])
        z, r = zr[:, :H], zr[:, H:]
        n = np.tanh(g[:, 2 * H:] + r * u[:, 2 * H:])
        new = n + z * (h - n)
        if not whole:
            new *= mask[t][:, None]
        if keep:
            kept[t] = (h, z, r, n, u[:, 2 * H:])
        states[t] = h = new
    return states, kept


@np.errstate(over="ignore")
def forward(p: dict, gates: np.ndarray, ids: np.ndarray, sizes: np.ndarray, keep: bool = False):
    """Logits of windows. ``ids`` (T, B) index ``gates``; ``sizes`` are the windows' lengths, at least 1."""
    T, B = ids.shape
    mask = (np.arange(T)[:, None] < sizes[None, :]).astype(np.float32)
    half = 3 * HIDDEN
    hf, kf = _run(gates[:, :half], ids, mask, p["Uf"], False, keep)
    hb, kb = _run(gates[:, half:], ids, mask, p["Ub"], True, keep)
    h = np.concatenate([hf, hb], 2)
    a = np.tanh(h.reshape(T * B, -1) @ p["Wa"] + p["ba"]).reshape(T, B, -1)
    s = np.where(mask > 0, a @ p["v"], -1e9)
    s = np.exp(s - s.max(0))
    alpha = s / s.sum(0)
    c = np.einsum("tb,tbh->bh", alpha, h)
    logit = c @ p["w"] + p["b"][0]
    return (logit, (h, a, alpha, c, mask, kf, kb)) if keep else logit


def _states(gates: np.ndarray, ids: np.ndarray, mask: np.ndarray | None, U: np.ndarray, back: bool, out: np.ndarray) -> None:
    """As ``_run`` without ``keep``, into ``out`` (T, H, B): long rows, few temporaries."""
    T, B = ids.shape
    H, U = HIDDEN, np.ascontiguousarray(U.T)
    h, g, u = np.zeros((H, B), np.float32), np.empty((3 * H, B), np.float32), np.empty((3 * H, B), np.float32)
    for t in range(T - 1, -1, -1) if back else range(T):
        g[...] = gates.take(ids[t], 0).T
        np.matmul(U, h, out=u)
        zr, n = g[:2 * H], g[2 * H:]
        zr += u[:2 * H]
        np.negative(zr, out=zr)
        np.exp(zr, out=zr)
        zr += 1
        np.reciprocal(zr, out=zr)
        u[2 * H:] *= zr[H:]
        n += u[2 * H:]
        np.tanh(n, out=n)
        new = out[t]
        np.subtract(h, n, out=new)
        new *= zr[:H]
        new += n
        if mask is not None:
            new *= mask[t]
        h = new


@np.errstate(over="ignore")
def logits(p: dict, gates: tuple[np.ndarray, np.ndarray], ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """As ``forward``, for scoring only; ``gates`` has each direction's half."""
    T, B = ids.shape
    mask = None if (sizes == T).all() else (np.arange(T)[:, None] < sizes[None, :]).astype(np.float32)
    h = np.empty((T, 2 * HIDDEN, B), np.float32)
    _states(gates[0], ids, mask, p["Uf"], False, h[:, :HIDDEN])
    _states(gates[1], ids, mask, p["Ub"], True, h[:, HIDDEN:])
    a = np.matmul(np.ascontiguousarray(p["Wa"].T), h)
    a += p["ba"][:, None]
    np.tanh(a, out=a)
    s = np.matmul(p["v"], a)
    if mask is not None:
        s = np.where(mask > 0, s, np.float32(-1e9))
    s = np.exp(s - s.max(0))
    return (s * np.matmul(p["w"], h)).sum(0) / s.sum(0) + p["b"][0]


def _back_direction(dstates, kept, mask, U, back):
    """Gradients of one direction: of its gates (T, B, 3H) and of U."""
    T, B, H = dstates.shape
    dU, dg = np.zeros_like(U), np.empty((T, B, 3 * H), np.float32)
    carry = np.zeros((B, H), np.float32)
    for t in range(T) if back else range(T - 1, -1, -1):
        h, z, r, n, un = kept[t]
        dh = (dstates[t] + carry) * mask[t][:, None]
        dn = dh * (1 - z) * (1 - n * n)
        dz = dh * (h - n) * z * (1 - z)
        dr = dn * un * r * (1 - r)
        dg[t] = np.concatenate([dz, dr, dn], 1)
        du = np.concatenate([dz, dr, dn * r], 1)
        dU += h.T @ du
        carry = dh * z + du @ U.T
    return dg, dU


def gradients(p: dict, features: tuple, ids: np.ndarray, sizes: np.ndarray, y: np.ndarray, weight: np.ndarray, keep=None):
    """(mean loss, gradients of every parameter) for one batch of windows.

    ``keep`` (0 or 1 per word) leaves out word embeddings, so that characters alone must do.
    """
    x = inputs(p, features)
    keep = np.ones(len(x), np.float32) if keep is None else keep
    x[:, :DIM] *= keep[:, None]
    gates = np.concatenate([x @ p["Wf"] + p["cf"], x @ p["Wb"] + p["cb"]], 1)
    logit, (h, a, alpha, c, mask, kf, kb) = forward(p, gates, ids, sizes, True)
    prob = _sigmoid(logit)
    loss = float(-(weight * (y * np.log(prob + 1e-7) + (1 - y) * np.log(1 - prob + 1e-7))).mean())
    dl = ((prob - y) * weight / len(y)).astype(np.float32)
    T, B = ids.shape
    g = {"w": dl @ c, "b": np.array([dl.sum()], np.float32)}
    dc = dl[:, None] * p["w"]
    dalpha = np.einsum("bh,tbh->tb", dc, h)
    ds = alpha * (dalpha - (alpha * dalpha).sum(0))
    da = ds[:, :, None] * p["v"] * (1 - a * a)
    g["v"] = np.einsum("tb,tba->a", ds, a)
    flat = da.reshape(T * B, -1)
    g["Wa"], g["ba"] = h.reshape(T * B, -1).T @ flat, flat.sum(0)
    dh = alpha[:, :, None] * dc + da @ p["Wa"].T
    dx = np.zeros_like(x)
    at = ids.ravel()
    for d, kept, back, part in (("f", kf, False, dh[:, :, :HIDDEN]), ("b", kb, True, dh[:, :, HIDDEN:])):
        dg, g[f"U{d}"] = _back_direction(np.ascontiguousarray(part), kept, mask, p[f"U{d}"], back)
        dg = dg.reshape(T * B, -1)
        per_word = np.stack([np.bincount(at, dg[:, k], minlength=len(x)) for k in range(dg.shape[1])], 1).astype(np.float32)
        g[f"W{d}"], g[f"c{d}"] = x.T @ per_word, per_word.sum(0)
        dx += per_word @ p[f"W{d}"].T
    dx[:, :DIM] *= keep[:, None]
    word, gram, of = features
    n = np.maximum(np.bincount(of, minlength=len(word)), 1).astype(np.float32)
    dgram = (dx[:, DIM:] / n[:, None])[of]
    for name, index, d, bits in (("word", word, dx[:, :DIM], WORD_BITS), ("gram", gram, dgram, GRAM_BITS)):
        g[name] = np.stack([np.bincount(index, d[:, k], minlength=1 << bits) for k in range(DIM)], 1).astype(np.float32)
    return loss, g


class Adam:
    def __init__(self, p: dict, rate: float):
        self.rate, self.t = rate, 0
        self.m = {k: np.zeros_like(x) for k, x in p.items()}
        self.v = {k: np.zeros_like(x) for k, x in p.items()}

    def step(self, p: dict, g: dict) -> None:
        self.t += 1
        size = np.sqrt(sum(float((x.astype(np.float64) ** 2).sum()) for x in g.values()))
        scale = min(1.0, 5.0 / (size + 1e-9))
        fix = np.sqrt(1 - 0.999 ** self.t) / (1 - 0.9 ** self.t)
        for k in p:
            d = g[k] * np.float32(scale)
            self.m[k] += np.float32(0.1) * (d - self.m[k])
            self.v[k] += np.float32(0.001) * (d * d - self.v[k])
            p[k] -= np.float32(self.rate * fix) * self.m[k] / (np.sqrt(self.v[k]) + np.float32(1e-7))
