"""A character-level bidirectional LSTM with CRF transitions, in numpy.

Windows of characters become tags B/I per kind, or O. Training follows the
exact gradients of the CRF's log-likelihood through both directions; decoding
is Viterbi over a batch of windows. Windows in which no run of other tags
can gain over O, whatever the steps, are all O without a search.
"""

from __future__ import annotations

import numpy as np

KINDS = ("email", "ip", "card", "phone")
TAGS = 1 + 2 * len(KINDS)  # 0: outside; 1 + 2k: first of kind k; 2 + 2k: further
HIDDEN = 12
#: Characters that have an input of their own, besides the letters a to z (upper case counts as lower); others share one for
#: the digits 0 and 1, one for other digits, one for white space, one for letters beyond ASCII, one for the rest.
OWN = "@.-+()[]{}/:=_%\"',;!?&#*$|<>"
LETTER, DIGIT = len(OWN), len(OWN) + 26
SPACE, OTHER_LETTER, REST, BEYOND = DIGIT + 2, DIGIT + 3, DIGIT + 4, DIGIT + 5  # BEYOND: no character
INPUTS = BEYOND + 1


def _table(points: int = 0x3000) -> np.ndarray:
    out = np.full(points, REST, np.int16)
    for i in range(points):
        c = chr(i)
        if c in OWN:
            out[i] = OWN.index(c)
        elif c.isascii() and c.isalpha():
            out[i] = LETTER + ord(c.lower()) - 97
        elif c.isascii() and c.isdigit():
            out[i] = DIGIT + (c not in "01")
        elif c.isspace():
            out[i] = SPACE
        elif c.isalpha():
            out[i] = OTHER_LETTER
    return out


_CLASS = _table()


def classes(text: str) -> np.ndarray:
    """The input of every character."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(points < len(_CLASS), _CLASS[np.minimum(points, len(_CLASS) - 1)], OTHER_LETTER)


def encode(windows: list[str], width: int | None = None) -> np.ndarray:
    """(windows, width) inputs; BEYOND after a window's end."""
    width = width or max(map(len, windows), default=0)
    x = np.full((len(windows), width), BEYOND, np.int16)
    for row, w in zip(x, windows, strict=True):
        row[: len(w)] = classes(w)
    return x


class Tagger:
    def __init__(self, seed: int = 3, dtype=np.float32):
        r = np.random.default_rng(seed)
        h = HIDDEN
        self.p = {"out": r.normal(0, 0.2, (2 * h, TAGS)), "bias": np.zeros(TAGS), "trans": np.zeros((TAGS, TAGS)), "first": np.zeros(TAGS)}
        for d in "fb":
            self.p |= {f"in{d}": r.normal(0, 0.3, (INPUTS, 4 * h)), f"re{d}": r.normal(0, 0.5 / np.sqrt(h), (h, 4 * h)), f"b{d}": np.concatenate([np.zeros(h), np.ones(h), np.zeros(2 * h)])}
        self.p = {k: v.astype(dtype) for k, v in self.p.items()}
        allowed = np.zeros((TAGS, TAGS), dtype)
        for k in range(len(KINDS)):
            allowed[:, 2 + 2 * k] = -1e4
            allowed[[1 + 2 * k, 2 + 2 * k], 2 + 2 * k] = 0
        self.allowed = allowed

    def _direction(self, x: np.ndarray, d: str, keep: bool):
        """States of one direction. Gates are in, forget, out and new. They are the hard forms of the sigmoid, clip(v / 5 + 1/2, 0, 1),
        and of tanh, clip(v, -1, 1): a clip costs a fraction of an exponential, and all of every text goes through here."""
        h = HIDDEN
        n, t = x.shape
        inputs, re = self.p[f"in{d}"] + self.p[f"b{d}"], self.p[f"re{d}"].copy()
        inputs[:, : 3 * h] = 0.2 * inputs[:, : 3 * h] + 0.5
        re[:, : 3 * h] *= 0.2
        order = range(t) if d == "f" else range(t - 1, -1, -1)
        state, cell = np.zeros((n, h), re.dtype), np.zeros((n, h), re.dtype)
        out, kept = np.empty((t, n, h), re.dtype), []
        xt = np.ascontiguousarray(x.T)
        for i in order:
            z = state @ re
            z += inputs.take(xt[i], axis=0)
            np.minimum(z, 1, out=z)
            np.maximum(z, -1, out=z)
            gates = z[:, : 3 * h]
            np.maximum(gates, 0, out=gates)
            a, f, o, new = z[:, :h], z[:, h : 2 * h], z[:, 2 * h : 3 * h], z[:, 3 * h :]
            before, cell = cell, f * cell
            cell += a * new
            tanh = np.clip(cell, -1, 1)
            if keep:
                kept.append((i, state, before, a, f, o, new, tanh))
            state = np.multiply(o, tanh, out=out[i])
        return out, kept

    def _states(self, x: np.ndarray, d: str) -> np.ndarray:
        """(places, hidden, windows): the states of :meth:`_direction`, for tagging only. Windows lie side by side, so every gate is one
        stretch of memory."""
        h = HIDDEN
        n, t = x.shape
        inputs, re = self.p[f"in{d}"] + self.p[f"b{d}"], self.p[f"re{d}"].T.copy()
        inputs[:, : 3 * h] = 0.2 * inputs[:, : 3 * h] + 0.5
        re[: 3 * h] *= 0.2
        xt = np.ascontiguousarray(x.T)
        out, z = np.empty((t, h, n), re.dtype), np.empty((4 * h, n), re.dtype)
        state, cell, work = np.zeros((h, n), re.dtype), np.zeros((h, n), re.dtype), np.empty((h, n), re.dtype)
        gates, a, f, o, new = z[: 3 * h], z[:h], z[h : 2 * h], z[2 * h : 3 * h], z[3 * h :]
        for i in range(t) if d == "f" else range(t - 1, -1, -1):
            np.matmul(re, state, out=z)
            z += inputs.take(xt[i], axis=0).T
            np.minimum(z, 1, out=z)
            np.maximum(gates, 0, out=gates)
            np.maximum(new, -1, out=new)
            cell *= f
            cell += np.multiply(a, new, out=work)
            np.maximum(np.minimum(cell, 1, out=work), -1, out=work)
            state = np.multiply(o, work, out=out[i])
        return out

    def emissions(self, x: np.ndarray, keep: bool = False):
        """(places, windows, tags), and what the gradients need."""
        f, kf = self._direction(x, "f", keep)
        b, kb = self._direction(x, "b", keep)
        h = HIDDEN
        return f @ self.p["out"][:h] + b @ self.p["out"][h:] + self.p["bias"], (f, b), kf, kb

    def decode(self, x: np.ndarray) -> np.ndarray:
        """(windows, places): tags of the best path of each window of inputs."""
        h = HIDDEN
        e = np.matmul(self.p["out"][:h].T, self._states(x, "f"))  # (places, tags, windows): steps work on rows
        e += np.matmul(self.p["out"][h:].T, self._states(x, "b"))
        e += self.p["bias"][:, None]
        beyond = np.flatnonzero((x == BEYOND).any(axis=0))
        if len(beyond):
            e[beyond, 1:] -= np.float32(1e4) * (x.T[beyond] == BEYOND)[:, None]
        trans = self.p["trans"] + self.allowed
        first = self.p["first"].copy()
        first[2::2] -= 4.0  # a window may begin inside a span, seldom
        # by kind, the most that a run of it up to a place can gain over O: from its first tag on, and with the steps that favour it most
        into = (trans[:, 1::2].max(axis=0) - trans[0, 0])[:, None]
        on = np.array([[max(trans[j - 1, j], trans[j, j]) - trans[0, 0]] for j in range(2, TAGS, 2)], e.dtype)
        start, stay = e[:, 1::2] - e[:, :1] + into, e[:, 2::2] - e[:, :1] + on
        run = np.maximum(start[0] - into + (first[1::2] - first[0])[:, None], stay[0] - on + (first[2::2] - first[0])[:, None])
        best = run.max(axis=0)
        for i in range(1, len(e)):
            before = np.maximum(run.max(axis=0), 0)
            run = np.maximum(before + start[i], run + stay[i])
            np.maximum(best, run.max(axis=0), out=best)
        tags = np.zeros(x.shape, np.int8)
        open_ = np.flatnonzero(best + max(0.0, float((trans[1:, 0] - trans[0, 0]).max())) > 0)
        if len(open_):
            tags[open_] = self._best_paths(np.ascontiguousarray(e[:, :, open_]), trans, first)
        return tags

    @staticmethod
    def _best_paths(e: np.ndarray, trans: np.ndarray, first: np.ndarray) -> np.ndarray:
        """(windows, places): the best paths. e: (places, tags, windows). A further tag can only follow its own kind, so most steps need not be looked at."""
        t, _, n = e.shape
        score = np.empty_like(e)
        score[0] = first[:, None] + e[0]
        enter = [0, *range(1, TAGS, 2)]  # O, and the first tag of each kind
        into = [trans[:, j][:, None] for j in range(TAGS)]
        for i in range(1, t):
            before, now = score[i - 1], score[i]
            for j in enter:
                (before + into[j]).max(axis=0, out=now[j])
            for j in range(2, TAGS, 2):
                np.maximum(before[j - 1] + trans[j - 1, j], before[j] + trans[j, j], out=now[j])
            now += e[i]
        tags = np.empty((t, n), np.int8)
        tags[-1] = score[-1].argmax(axis=0)
        for i in range(t - 1, 0, -1):
            tags[i - 1] = (score[i - 1] + trans[:, tags[i]]).argmax(axis=0)
        return tags.T

    @staticmethod
    def _viterbi(e: np.ndarray, trans: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The whole search, against which :meth:`decode` is tested."""
        t, n, _ = e.shape
        score, back = first + e[0], np.zeros((t, n, TAGS), np.int8)
        for i in range(1, t):
            s = score[:, :, None] + trans
            back[i] = s.argmax(axis=1)
            score = s.max(axis=1) + e[i]
        tags = np.zeros((n, t), np.int8)
        tags[:, -1] = score.argmax(axis=1)
        rows = np.arange(n)
        for i in range(t - 1, 0, -1):
            tags[:, i - 1] = back[i][rows, tags[:, i]]
        return tags

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        n, t = x.shape
        e, (f_out, b_out), kf, kb = self.emissions(x, keep=True)
        trans = self.p["trans"] + self.allowed
        # forward and backward sums, scaled place by place; steps that are not allowed have weight 0
        step, place = np.exp(trans), np.exp(e - e.max(axis=2, keepdims=True))
        alpha, beta, scale = np.empty_like(e), np.empty_like(e), np.empty((t, n), e.dtype)
        for i in range(t):
            a = (np.exp(self.p["first"]) if i == 0 else alpha[i - 1] @ step) * place[i]
            scale[i] = a.sum(axis=1)
            alpha[i] = a / scale[i][:, None]
        beta[-1] = 1
        for i in range(t - 2, -1, -1):
            beta[i] = ((beta[i + 1] * place[i + 1]) @ step.T) / scale[i + 1][:, None]
        de = alpha * beta
        rows, yt = np.arange(n), y.T
        loss = np.log(scale).sum(axis=0) + e.max(axis=2).sum(axis=0) - self.p["first"][yt[0]] - np.take_along_axis(e, yt[:, :, None], axis=2)[:, :, 0].sum(axis=0) - trans[yt[:-1], yt[1:]].sum(axis=0)
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        after = beta[1:] * place[1:] / scale[1:][:, :, None]
        g["trans"] = step * np.einsum("tni,tnj->ij", alpha[:-1], after)
        np.add.at(g["trans"], (yt[:-1].ravel(), yt[1:].ravel()), -1)
        np.put_along_axis(de, yt[:, :, None], np.take_along_axis(de, yt[:, :, None], axis=2) - 1, axis=2)
        h = HIDDEN
        g["first"] = de[0].sum(axis=0)
        g["out"] = np.concatenate([np.einsum("tnh,tnk->hk", f_out, de), np.einsum("tnh,tnk->hk", b_out, de)])
        g["bias"] = de.sum(axis=(0, 1))
        dh = de @ self.p["out"].T
        for d, kept, part in (("f", kf, dh[:, :, :h]), ("b", kb, dh[:, :, h:])):
            ds, dc = np.zeros((n, h), e.dtype), np.zeros((n, h), e.dtype)
            all_z = np.empty((t, n, 4 * h), e.dtype)
            for i, state, before, a, f, o, new, tanh in reversed(kept):
                ds = ds + part[i]
                dc = dc + ds * o * (np.abs(tanh) < 1)
                dz = all_z[i]
                inner = lambda v: 0.2 * ((v > 0) & (v < 1))
                dz[:, :h], dz[:, h : 2 * h], dz[:, 2 * h : 3 * h], dz[:, 3 * h :] = dc * new * inner(a), dc * before * inner(f), ds * tanh * inner(o), dc * a * (np.abs(new) < 1)
                g[f"re{d}"] += state.T @ dz
                ds, dc = dz @ self.p[f"re{d}"].T, dc * f
            flat = all_z.reshape(-1, 4 * h)
            one_hot = np.zeros((INPUTS, len(flat)), e.dtype)
            one_hot[x.T.ravel(), np.arange(len(flat))] = 1
            g[f"in{d}"] = one_hot @ flat
            g[f"b{d}"] = flat.sum(axis=0)
        del rows
        return float(loss.mean()), {k: v / n for k, v in g.items()}

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int, batch: int = 64, rate: float = 0.012, seed: int = 1) -> float:
        """Adam over shuffled batches; the last epoch's mean loss of a window."""
        rng = np.random.default_rng(seed)
        m, v = ({a: np.zeros_like(b) for a, b in self.p.items()} for _ in range(2))
        k, losses = 0, []
        for epoch in range(epochs):
            losses = []
            for at in np.array_split(rng.permutation(len(x)), max(1, len(x) // batch)):
                loss, g = self.gradients(x[at], y[at])
                losses.append(loss)
                k += 1
                for a in self.p:
                    m[a] = 0.9 * m[a] + 0.1 * g[a]
                    v[a] = 0.999 * v[a] + 0.001 * g[a] ** 2
                    self.p[a] -= (rate * (1 - 0.9 * epoch / epochs) * (m[a] / (1 - 0.9**k)) / (np.sqrt(v[a] / (1 - 0.999**k)) + 1e-8)).astype(self.p[a].dtype)
        return float(np.mean(losses))
