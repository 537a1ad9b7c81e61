"""A character-level bidirectional LSTM with CRF transitions, in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Classes of characters: ASCII as itself, other letters, digits and the rest.
VOCABULARY = 132


def _classes() -> np.ndarray:
    table = np.full(0x10000, 131, np.int16)
    table[:128] = np.arange(128)
    for o in range(128, 0x10000):
        c = chr(o)
        if c.isalpha():
            table[o] = 128
        elif c.isdigit():
            table[o] = 129
        elif c.isspace():
            table[o] = 130
    return table


_TABLE: list[np.ndarray] = []


def codes(text: str) -> np.ndarray:
    """Character classes of a text."""
    if not _TABLE:
        _TABLE.append(_classes())
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return _TABLE[0][np.minimum(points, 0xFFFF)].astype(np.int64)


@dataclass
class Network:
    """Weights; direction 0 reads forward, 1 backward. Gates are i, f, o, g."""

    wx: np.ndarray  # [2, vocabulary, 4h] input of each character class, with bias
    wh: np.ndarray  # [2, h, 4h]
    wo: np.ndarray  # [2h, k]
    bo: np.ndarray  # [k]
    trans: np.ndarray  # [k, k] from, to
    start: np.ndarray  # [k]

    @property
    def arrays(self) -> list[np.ndarray]:
        return [self.wx, self.wh, self.wo, self.bo, self.trans, self.start]


def fresh(h: int, k: int, seed: int) -> Network:
    r = np.random.default_rng(seed)
    f = lambda *s, scale: (r.standard_normal(s) * scale).astype(np.float32)
    net = Network(f(2, VOCABULARY, 4 * h, scale=0.3), f(2, h, 4 * h, scale=h**-0.5), f(2 * h, k, scale=(2 * h) ** -0.5), np.zeros(k, np.float32), np.zeros((k, k), np.float32), np.zeros(k, np.float32))
    net.wx[:, :, h : 2 * h] += 1.0
    return net


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def hidden(net: Network, x: np.ndarray, keep: bool = False) -> tuple[np.ndarray, dict]:
    """[t, n, 2h] states for classes [t, n]; ``keep`` also returns what backward needs."""
    t, n = x.shape
    h = net.wh.shape[1]
    both = np.stack([x, x[::-1]], axis=1)  # [t, 2, n]
    c = np.zeros((2, n, h), np.float32)
    s = np.zeros((2, n, h), np.float32)
    out = np.empty((t, 2, n, h), np.float32)
    saved: dict = {"gates": np.empty((t, 2, n, 4 * h), np.float32), "c": np.empty((t, 2, n, h), np.float32), "both": both} if keep else {}
    for i in range(t):
        z = np.matmul(s, net.wh)
        z[0] += net.wx[0][both[i, 0]]
        z[1] += net.wx[1][both[i, 1]]
        z[..., : 3 * h] *= 0.5
        np.tanh(z, out=z)
        z[..., : 3 * h] += 1
        z[..., : 3 * h] *= 0.5
        c = z[..., h : 2 * h] * c + z[..., :h] * z[..., 3 * h :]
        s = z[..., 2 * h : 3 * h] * np.tanh(c)
        out[i] = s
        if keep:
            saved["gates"][i], saved["c"][i] = z, c
    saved["out"] = out if keep else None
    return np.concatenate([out[:, 0], out[::-1, 1]], axis=-1), saved


def emissions(net: Network, x: np.ndarray) -> np.ndarray:
    return hidden(net, x)[0] @ net.wo + net.bo


def viterbi(net: Network, e: np.ndarray) -> np.ndarray:
    """Best tags [t, n] for emissions [t, n, k]."""
    t, n, k = e.shape
    back = np.empty((t, n, k), np.int8)
    v = net.start + e[0]
    for i in range(1, t):
        m = v[:, :, None] + net.trans
        back[i] = m.argmax(1)
        v = m.max(1) + e[i]
    tags = np.empty((t, n), np.int64)
    tags[-1] = v.argmax(1)
    for i in range(t - 1, 0, -1):
        tags[i - 1] = back[i][np.arange(n), tags[i]]
    return tags


def _lse(a: np.ndarray, axis: int) -> np.ndarray:
    m = a.max(axis, keepdims=True)
    return (np.log(np.exp(a - m).sum(axis, keepdims=True)) + m).squeeze(axis)


def loss_and_gradient(net: Network, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean negative log-likelihood of tags [t, n], and gradients as ``arrays``."""
    t, n = x.shape
    h, k = net.wh.shape[1], len(net.bo)
    states, saved = hidden(net, x, keep=True)
    e = states @ net.wo + net.bo
    fwd, bwd = np.empty((t, n, k), np.float32), np.zeros((t, n, k), np.float32)
    fwd[0] = net.start + e[0]
    for i in range(1, t):
        fwd[i] = _lse(fwd[i - 1][:, :, None] + net.trans, 1) + e[i]
    for i in range(t - 2, -1, -1):
        bwd[i] = _lse(net.trans + (bwd[i + 1] + e[i + 1])[:, None, :], 2)
    z = _lse(fwd[-1], 1)
    at = np.arange(n)
    gold = net.start[y[0]] + sum(e[i][at, y[i]] for i in range(t)) + net.trans[y[:-1], y[1:]].sum(0)
    de = np.exp(fwd + bwd - z[None, :, None])
    d_start = de[0].sum(0) - np.bincount(y[0], minlength=k)
    d_trans = -np.bincount((y[:-1] * k + y[1:]).ravel(), minlength=k * k).reshape(k, k).astype(np.float32)
    for i in range(1, t):
        d_trans += np.exp(fwd[i - 1][:, :, None] + net.trans + (e[i] + bwd[i])[:, None, :] - z[:, None, None]).sum(0)
    for i in range(t):
        de[i, at, y[i]] -= 1
    de /= n
    flat = de.reshape(-1, k)
    d_wo, d_bo = states.reshape(-1, 2 * h).T @ flat, flat.sum(0)
    ds = de @ net.wo.T
    d_out = np.stack([ds[..., :h], ds[::-1, :, h:]], axis=1)
    d_wx, d_wh = np.zeros_like(net.wx), np.zeros_like(net.wh)
    dc = np.zeros((2, n, h), np.float32)
    dh = np.zeros((2, n, h), np.float32)
    dz_all = np.empty((t, 2, n, 4 * h), np.float32)
    for i in range(t - 1, -1, -1):
        g, c = saved["gates"][i], saved["c"][i]
        i_, f_, o_, g_ = (g[..., a * h : (a + 1) * h] for a in range(4))
        tc = np.tanh(c)
        dh = dh + d_out[i]
        dc = dc + dh * o_ * (1 - tc * tc)
        before = saved["c"][i - 1] if i else np.zeros_like(c)
        dz = dz_all[i]
        dz[..., :h] = dc * g_ * i_ * (1 - i_)
        dz[..., h : 2 * h] = dc * before * f_ * (1 - f_)
        dz[..., 2 * h : 3 * h] = dh * tc * o_ * (1 - o_)
        dz[..., 3 * h :] = dc * i_ * (1 - g_ * g_)
        if i:
            d_wh += np.matmul(saved["out"][i - 1].transpose(0, 2, 1), dz)
        dh = np.matmul(dz, net.wh.transpose(0, 2, 1))
        dc = dc * f_
    for d in range(2):
        np.add.at(d_wx[d], saved["both"][:, d].ravel(), dz_all[:, d].reshape(-1, 4 * h))
    return float((z - gold).mean()), [d_wx, d_wh, d_wo, d_bo, d_trans / n, d_start / n]


def train(batches, h: int, k: int, seed: int, rate: float = 0.01) -> Network:
    """A network after one Adam step on each (classes, tags) batch."""
    net = fresh(h, k, seed)
    m = [np.zeros_like(a) for a in net.arrays]
    v = [np.zeros_like(a) for a in net.arrays]
    batches = list(batches)
    for step, (x, y) in enumerate(batches, 1):
        _, grads = loss_and_gradient(net, x, y)
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        lr = rate * (1 - 0.9 * step / len(batches))
        for a, g, mm, vv in zip(net.arrays, grads, m, v):
            g = g * min(1.0, 5.0 / max(norm, 1e-9))
            mm += 0.1 * (g - mm)
            vv += 0.001 * (g * g - vv)
            a -= (lr * (mm / (1 - 0.9**step)) / (np.sqrt(vv / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net
