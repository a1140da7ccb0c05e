"""A character-level bidirectional LSTM with CRF transitions, in numpy.

Both directions run as one batched recurrence. Inputs are windows of character
codes (windows by length), outputs tags of the same shape.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

N_CODES = 130  # ASCII, 128 for any other character, 0 for padding


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis)) + top.squeeze(axis)


@dataclass
class BiLstmCrf:
    n_tags: int
    hidden: int = 24
    width: int = 16
    seed: int = 7
    p: dict[str, np.ndarray] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.p:
            return
        r = np.random.default_rng(self.seed)
        h, e, k = self.hidden, self.width, self.n_tags

        def init(*shape: int) -> np.ndarray:
            return (r.standard_normal(shape) / np.sqrt(shape[-2])).astype(np.float32)

        bias = np.zeros((2, 1, 4 * h), np.float32)
        bias[:, :, h : 2 * h] = 1  # remember at first
        self.p = {"emb": init(N_CODES, e), "wx": init(2, e, 4 * h), "wh": init(2, h, 4 * h), "b": bias, "wo": init(2 * h, k), "bo": np.zeros(k, np.float32), "tr": np.zeros((k, k), np.float32), "st": np.zeros(k, np.float32)}

    def _run(self, codes: np.ndarray) -> tuple[np.ndarray, list]:
        """Hidden states (direction, window, position, hidden) and what backpropagation needs."""
        p, h = self.p, self.hidden
        both = np.stack([codes, codes[:, ::-1]])
        n, t = codes.shape
        inputs = p["emb"][both]
        pre = np.matmul(inputs.reshape(2, n * t, -1), p["wx"]).reshape(2, n, t, -1) + p["b"][:, :, None]
        hs = np.zeros((2, n, t, h), np.float32)
        state, cell, trace = np.zeros((2, n, h), np.float32), np.zeros((2, n, h), np.float32), []
        for s in range(t):
            g = pre[:, :, s] + np.matmul(state, p["wh"])
            gates, new = _sigmoid(g[..., : 3 * h]), np.tanh(g[..., 3 * h :])
            i, f, o = gates[..., :h], gates[..., h : 2 * h], gates[..., 2 * h :]
            was, before = cell, state
            cell = f * cell + i * new
            th = np.tanh(cell)
            state = o * th
            hs[:, :, s] = state
            trace.append((before, was, i, f, o, new, th))
        return hs, [both, inputs, trace]

    def _scores(self, codes: np.ndarray) -> np.ndarray:
        """Emissions (position, tag, window) without what backpropagation needs, from a table of every code's input to the gates.

        A gate's values of all windows lie side by side, and all four gates take one exponential: tanh(x) is 2 / (1 + exp(-2x)) - 1.
        """
        p, h = self.p, self.hidden
        n, t = codes.shape
        scale = np.where(np.arange(4 * h) < 3 * h, -1, -2).astype(np.float32)
        table = (np.matmul(p["emb"], p["wx"]) + p["b"]) * scale
        wh = np.ascontiguousarray((p["wh"] * scale).transpose(0, 2, 1))
        wo = p["wo"].reshape(2, h, -1).transpose(0, 2, 1)
        steps = np.ascontiguousarray(codes.T, dtype=np.intp)
        out = np.zeros((t, self.n_tags, n), np.float32) + p["bo"][:, None]
        hs, g, x, th = np.empty((t, h, n), np.float32), np.empty((4 * h, n), np.float32), np.empty((n, 4 * h), np.float32), np.empty((h, n), np.float32)
        with np.errstate(over="ignore"):
            for d, places in enumerate((range(t), range(t - 1, -1, -1))):
                state, cell = np.zeros((h, n), np.float32), np.zeros((h, n), np.float32)
                for s in places:
                    np.matmul(wh[d], state, out=g)
                    np.take(table[d], steps[s], axis=0, out=x, mode="clip")
                    g += x.T
                    np.exp(g, out=g)
                    g += 1
                    np.reciprocal(g, out=g)
                    new = g[3 * h :]
                    new *= 2
                    new -= 1
                    new *= g[:h]
                    cell *= g[h : 2 * h]
                    cell += new
                    state = np.multiply(np.tanh(cell, out=th), g[2 * h : 3 * h], out=hs[s])
                out += np.matmul(wo[d], hs)
        return out

    def emissions(self, codes: np.ndarray, keep: bool = False):
        if not keep:
            return self._scores(codes).transpose(2, 0, 1)
        hs, saved = self._run(codes)
        joined = np.concatenate([hs[0], hs[1][:, ::-1]], -1)
        return joined @ self.p["wo"] + self.p["bo"], joined, saved

    def step(self, codes: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of the tags, and its gradient."""
        p, h = self.p, self.hidden
        em, joined, (both, inputs, trace) = self.emissions(codes, keep=True)
        n, t, k = em.shape
        alpha, beta = np.zeros_like(em), np.zeros_like(em)
        alpha[:, 0] = p["st"] + em[:, 0]
        for s in range(1, t):
            alpha[:, s] = _logsumexp(alpha[:, s - 1, :, None] + p["tr"], 1) + em[:, s]
        for s in range(t - 2, -1, -1):
            beta[:, s] = _logsumexp(p["tr"] + (em[:, s + 1] + beta[:, s + 1])[:, None], 2)
        total = _logsumexp(alpha[:, -1], 1)
        rows, places = np.arange(n)[:, None], np.arange(t)[None]
        gold = em[rows, places, tags].sum(1) + p["st"][tags[:, 0]] + p["tr"][tags[:, :-1], tags[:, 1:]].sum(1)
        d_em = np.exp(alpha + beta - total[:, None, None])
        d = {"st": d_em[:, 0].sum(0), "tr": np.zeros((k, k), np.float32)}
        for s in range(1, t):
            d["tr"] += np.exp(alpha[:, s - 1, :, None] + p["tr"] + (em[:, s] + beta[:, s])[:, None] - total[:, None, None]).sum(0)
        np.subtract.at(d["tr"], (tags[:, :-1].ravel(), tags[:, 1:].ravel()), 1)
        np.subtract.at(d["st"], tags[:, 0], 1)
        d_em[rows, places, tags] -= 1
        d["wo"] = joined.reshape(-1, 2 * h).T @ d_em.reshape(-1, k)
        d["bo"] = d_em.sum((0, 1))
        d_joined = d_em @ p["wo"].T
        d_hs = np.stack([d_joined[..., :h], d_joined[:, ::-1, h:]])
        d_pre = np.zeros((2, n, t, 4 * h), np.float32)
        d["wh"] = np.zeros_like(p["wh"])
        dh, dc = np.zeros((2, n, h), np.float32), np.zeros((2, n, h), np.float32)
        for s in range(t - 1, -1, -1):
            before, was, i, f, o, new, th = trace[s]
            dh = dh + d_hs[:, :, s]
            dc = dc + dh * o * (1 - th * th)
            g = np.concatenate([dc * new * i * (1 - i), dc * was * f * (1 - f), dh * th * o * (1 - o), dc * i * (1 - new * new)], -1)
            d_pre[:, :, s] = g
            d["wh"] += np.matmul(before.transpose(0, 2, 1), g)
            dh, dc = np.matmul(g, p["wh"].transpose(0, 2, 1)), dc * f
        d["b"] = d_pre.sum((1, 2))[:, None]
        flat = d_pre.reshape(2, n * t, -1)
        d["wx"] = np.matmul(inputs.reshape(2, n * t, -1).transpose(0, 2, 1), flat)
        d["emb"] = np.zeros_like(p["emb"])
        np.add.at(d["emb"], both.reshape(2, -1), np.matmul(flat, p["wx"].transpose(0, 2, 1)))
        return float((total - gold).mean()), {key: x / n for key, x in d.items()}

    def fit(self, codes: np.ndarray, tags: np.ndarray, *, steps: int = 300, batch: int = 32, rate: float = 0.01) -> list[float]:
        r = np.random.default_rng(self.seed)
        m = {key: np.zeros_like(x) for key, x in self.p.items()}
        v = {key: np.zeros_like(x) for key, x in self.p.items()}
        losses = []
        for t in range(1, steps + 1):
            at = r.integers(0, len(codes), batch)
            loss, grad = self.step(codes[at], tags[at])
            losses.append(loss)
            norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
            lr = rate * min(1.0, 2 * (1 - t / (steps + 1)))
            for key, g in grad.items():
                g = g * min(1.0, 5 / (norm + 1e-9))
                m[key] = 0.9 * m[key] + 0.1 * g
                v[key] = 0.99 * v[key] + 0.01 * g * g
                self.p[key] = (self.p[key] - lr * (m[key] / (1 - 0.9**t)) / (np.sqrt(v[key] / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
        return losses

    def _plain(self, em: np.ndarray) -> np.ndarray:
        """Whether all tags of a window are surely 0: no run of others can score as much, whatever its tags.

        ``em`` is (position, tag, window). A run is given its best entry, its best step at each place and its best end.
        """
        tr, st = self.p["tr"] - self.p["tr"][0, 0], self.p["st"]
        gain = em[:, 1:].max(1) - em[:, 0]
        run = gain[0] + (st[1:].max() - st[0])
        best = run.copy()
        for s in range(1, len(em)):
            run = np.maximum(run + tr[1:, 1:].max(), tr[0, 1:].max()) + gain[s]
            np.maximum(best, run, out=best)
        return best + max(tr[1:, 0].max(), 0) < -0.05  # more than sums of floats are off by

    def decode(self, codes: np.ndarray, size: int = 256) -> np.ndarray:
        """Best tags of each window by Viterbi, ``size`` windows at a time; those that are surely 0 throughout are not searched."""
        tags = np.zeros(codes.shape, np.int8)
        for i in range(0, len(codes), size):
            em = self._scores(codes[i : i + size])
            open_ = np.flatnonzero(~self._plain(em))
            if len(open_):
                tags[i + open_] = self._best(em[:, :, open_].transpose(2, 0, 1))
        return tags

    def _best(self, em: np.ndarray) -> np.ndarray:
        p = self.p
        n, t, k = em.shape
        back = np.zeros((t, n, k), np.int8)
        into = np.ascontiguousarray(p["tr"].T)
        score = p["st"] + em[:, 0]
        for s in range(1, t):
            each = score[:, None, :] + into
            best = each.argmax(2)
            back[s] = best
            score = np.take_along_axis(each, best[:, :, None], 2)[:, :, 0] + em[:, s]
        tags = np.zeros((n, t), np.int64)
        tags[:, -1] = score.argmax(1)
        rows = np.arange(n)
        for s in range(t - 1, 0, -1):
            tags[:, s - 1] = back[s, rows, tags[:, s]]
        return tags
