"""A gated recurrent language model in numpy with a class-factored output softmax.

Symbols: `words` head words, one end of text, and `tails` buckets of all other words. Each symbol is an input; outputs
are classes: the head words in classes of about equal counts, the end and the tail buckets in classes of `TOGETHER`. What
a bucket does with its words is not the network's affair.
"""

from __future__ import annotations

import numpy as np

F32 = np.float32
TOGETHER = 17  # the end and the tail buckets, in one class
STEADY = 60.0  # logits within this need no shift before exp


def _sigmoid(x):
    return F32(0.5) * np.tanh(F32(0.5) * x) + F32(0.5)


def classes_of(counts: np.ndarray, classes: int) -> np.ndarray:
    """Class of each head word (by falling counts): equal shares of the square roots of counts, so that common words have small classes."""
    share = np.cumsum(np.sqrt(counts.astype(float)))
    return np.minimum((share - share[0]) / max(share[-1] - share[0], 1e-9) * classes, classes - 1).astype(np.int64) if len(counts) else np.zeros(0, np.int64)


class Net:
    """counts: of the head words by falling counts; rest: of the end and the tail buckets."""

    def __init__(self, counts, rest, hidden: int = 16, classes: int = 48, seed: int = 1):
        counts, rest = np.asarray(counts, float), np.asarray(rest, float)
        self.k, self.h, self.asked = len(counts), hidden, classes
        of = classes_of(counts, classes)
        used, of = np.unique(of, return_inverse=True)
        n = len(used)
        self.cls = np.concatenate([of, n + np.arange(len(rest)) // TOGETHER]).astype(np.int64)  # class of each symbol
        self.first = np.searchsorted(self.cls, np.arange(self.cls.max(initial=-1) + 2))  # symbols of class c: first[c] .. first[c + 1]
        every = np.concatenate([counts, rest])
        mass = np.bincount(self.cls, every) + 1.0
        rng = np.random.default_rng(seed)
        init = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(F32)
        self.p = {
            "e": init(len(every), 3 * hidden),
            "r": init(hidden, 3 * hidden),
            "wc": init(hidden, len(mass)),
            "bc": np.log(mass / mass.sum()).astype(F32),
            "u": init(len(every), hidden) * F32(0.1),
            "b": np.log((every + 0.5) / mass[self.cls]).astype(F32),
        }
        self.g2 = {key: np.full_like(v, 1e-3) for key, v in self.p.items()}

    def vector(self) -> np.ndarray:
        return np.concatenate([self.p[k].ravel() for k in self.p])

    def load(self, v: np.ndarray) -> None:
        at = 0
        for k, x in self.p.items():
            self.p[k] = v[at : at + x.size].reshape(x.shape).astype(F32)
            at += x.size

    def run(self, ids: np.ndarray, keep: np.ndarray, h: np.ndarray):
        """States over ids (steps x lanes); keep is 0 where a lane starts a text. Returns what backward needs."""
        t, b = ids.shape
        x = self.p["e"][ids]
        n2, hid, r = 2 * self.h, self.h, self.p["r"]
        hs = np.empty((t + 1, b, hid), F32)
        prev, gates, cand, rec = (np.empty((t, b, w), F32) for w in (hid, n2, hid, hid))
        hs[0] = h
        for s in range(t):
            p = hs[s] * keep[s][:, None]
            a = p @ r
            g = _sigmoid(x[s, :, :n2] + a[:, :n2])
            c = np.tanh(x[s, :, n2:] + g[:, hid:] * a[:, n2:])
            hs[s + 1] = c + g[:, :hid] * (p - c)
            prev[s], gates[s], cand[s], rec[s] = p, g, c, a[:, n2:]
        return hs, prev, gates, cand, rec

    def states(self, ids, keep, h):
        """Like run, for scoring: the states alone, and the last one."""
        t, b = ids.shape
        n2, hid, r, e = 2 * self.h, self.h, self.p["r"], self.p["e"]
        hs = np.empty((t, b, hid), F32)
        x = e[ids]
        for s in range(t):
            p = h * keep[s][:, None]
            a = p @ r
            g = _sigmoid(x[s, :, :n2] + a[:, :n2])
            c = np.tanh(x[s, :, n2:] + g[:, hid:] * a[:, n2:])
            h = c + g[:, :hid] * (p - c)
            hs[s] = h
        return hs, h

    @staticmethod
    def _softmax(z: np.ndarray, steady: bool) -> np.ndarray:
        """exp(z) in place, shifted by the rows' maxima unless all logits are known to be small; their sums by row."""
        if not steady:
            z -= z.max(1, keepdims=True)
        np.exp(z, out=z)
        return z @ np.ones(z.shape[1], z.dtype)

    def output(self, h: np.ndarray, y: np.ndarray, grad: bool):
        """(natural log probability of each y given states h; gradients of their mean negative sum by h and parameters)."""
        p, c = self.p, self.cls[y]
        order = np.argsort(c.astype(np.int16), kind="stable")  # rows by class, so that a class is a slice
        h, y, c = h[order], y[order], c[order]
        most = lambda w, b: float(np.abs(w).sum(0).max(initial=0) + np.abs(b).max(initial=0))  # noqa: E731; states lie in -1 .. 1
        z = h @ p["wc"]
        z += p["bc"]
        total = self._softmax(z, most(p["wc"], p["bc"]) < STEADY)
        rows = np.arange(len(y))
        chance = z[rows, c] / total
        if grad:
            z /= total[:, None]
            z[rows, c] -= 1
            dh = z @ p["wc"].T
            g = {"wc": h.T @ z, "bc": z.sum(0), "u": np.zeros_like(p["u"]), "b": np.zeros_like(p["b"])}
        steady = most(p["u"].T, p["b"]) < STEADY
        cuts = np.searchsorted(c, np.arange(len(self.first)))
        inner = np.ones_like(chance)
        for k in range(len(self.first) - 1):
            at, of = slice(cuts[k], cuts[k + 1]), slice(self.first[k], self.first[k + 1])
            if at.start == at.stop or of.stop - of.start < 2:
                continue
            hk, yk, u = h[at], y[at] - of.start, p["u"][of]
            z = hk @ u.T
            z += p["b"][of]
            total = self._softmax(z, steady)
            i = rows[: len(yk)]
            inner[at] = z[i, yk] / total
            if grad:
                z /= total[:, None]
                z[i, yk] -= 1
                dh[at] += z @ u
                g["u"][of] = z.T @ hk
                g["b"][of] = z.sum(0)
        back = np.empty_like(order)
        back[order] = rows
        logp = (np.log(chance) + np.log(inner))[back]
        return (logp, dh[back], g) if grad else logp

    def step(self, ids, keep, ys, live, h, rate: float) -> tuple[np.ndarray, float]:
        """One truncated back-propagation over a window (steps x lanes) and an AdaGrad update. Returns (last state, log probability)."""
        t, b = ids.shape
        hs, prev, gates, cand, rec = self.run(ids, keep, h)
        flat = np.flatnonzero(live.ravel())
        if not len(flat):
            return hs[-1], 0.0
        states = hs[1:].reshape(t * b, self.h)
        logp, dh_flat, g = self.output(states[flat], ys.ravel()[flat], True)
        dhs = np.zeros((t * b, self.h), F32)
        dhs[flat] = dh_flat
        dhs = dhs.reshape(t, b, self.h)
        hid, r = self.h, self.p["r"]
        da, dx = np.empty((t, b, 3 * hid), F32), np.empty((t, b, 3 * hid), F32)
        carry = np.zeros((b, hid), F32)
        for s in range(t - 1, -1, -1):
            dh = dhs[s] + carry
            z, rr = gates[s, :, :hid], gates[s, :, hid:]
            c, p = cand[s], prev[s]
            dn = dh * (1 - z) * (1 - c * c)
            dx[s, :, :hid] = dh * (p - c) * z * (1 - z)
            dx[s, :, hid : 2 * hid] = dn * rec[s] * rr * (1 - rr)
            dx[s, :, 2 * hid :] = dn
            da[s, :, : 2 * hid] = dx[s, :, : 2 * hid]
            da[s, :, 2 * hid :] = dn * rr
            carry = (dh * z + da[s] @ r.T) * keep[s][:, None]
        g["r"] = prev.reshape(t * b, hid).T @ da.reshape(t * b, 3 * hid)
        i = ids.ravel()
        order = np.argsort(i, kind="stable")
        touched, start = np.unique(i[order], return_index=True)
        ge = np.add.reduceat(dx.reshape(t * b, 3 * hid)[order], start, axis=0)
        scale = F32(1 / len(flat))
        for key, grad in g.items():
            grad = np.clip(grad * scale, -1, 1)
            self.g2[key] += grad * grad
            self.p[key] -= F32(rate) * grad / np.sqrt(self.g2[key])
        ge = np.clip(ge * scale, -1, 1)
        self.g2["e"][touched] += ge * ge
        self.p["e"][touched] -= F32(rate) * ge / np.sqrt(self.g2["e"][touched])
        return hs[-1], float(logp.sum())


def lanes(off: np.ndarray, count: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Texts dealt to lanes of near-equal lengths (longest first, to the shortest lane); lanes by falling length."""
    import heapq

    size = np.diff(off)
    heap = [(0, k) for k in range(min(count, len(size)))]
    mine: list[list[int]] = [[] for _ in heap]
    for i in np.argsort(-size, kind="stable").tolist():
        n, k = heapq.heappop(heap)
        mine[k].append(i)
        heapq.heappush(heap, (n + int(size[i]), k))
    total = np.array([size[m].sum() for m in mine])
    order = np.argsort(-total, kind="stable")
    return [np.array(mine[k]) for k in order], total[order]


def segments(off: np.ndarray, most: int) -> np.ndarray:
    """Offsets of texts cut into segments of at most `most` tokens."""
    n = np.diff(off)
    parts = -(-n // most)
    at = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    return np.append(np.repeat(off[:-1], parts) + at * most, off[-1])


def windows(ids: np.ndarray, off: np.ndarray, count: int, steps: int):
    """Windows (inputs, keep, targets, live, text) of steps x lanes over texts laid in `count` lanes.

    Lanes are in falling length and only drop out at the right; the input is the token before, with keep 0 at a text's start,
    where it is the end of the text before (of the last one for the first).
    """
    mine, total = lanes(off, count)
    if not len(total) or not total[0]:
        return
    order = np.concatenate(mine)
    n = np.diff(off)[order]
    to = np.cumsum(n) - n
    at = np.arange(n.sum(), dtype=np.int32) + np.repeat((off[order] - to).astype(np.int32), n)
    y, text = ids[at], np.repeat(order.astype(np.int32), n)
    first = np.zeros(len(at), bool)
    first[to[n > 0]] = True
    x = np.empty_like(y)
    x[1:] = y[:-1]
    x[first] = ids[off[order][n > 0] - 1]
    begin = np.cumsum(total) - total
    for s in range(0, int(total[0]), steps):
        k = int(np.searchsorted(-total, -s, "left"))  # lanes longer than s
        step = np.arange(s, s + steps)[:, None]
        live = step < total[None, :k]
        at = np.where(live, begin[None, :k] + step, 0)
        yield x[at], (~first[at]).astype(F32), y[at], live, text[at]
