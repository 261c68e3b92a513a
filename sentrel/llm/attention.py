"""A causal self-attention language model over subword ids, in numpy.

Inputs are rows of one embedding table (the most frequent ids have a row each, the
others share ``hashed`` rows). One attention layer with relative positions sees the OWN
to 2 OWN - 1 ids before a target; the two ids next to it also enter by projections of
their own; a hidden layer follows. The softmax has two levels and covers every id:
classes (the most frequent ids alone, the next in bands of about equal mass), then the
ids of the class, each with its own output vector; only ids beyond the first
``vectors`` have fixed shares within their class.

Windows overlap by half, so that each id is scored once, and windows are attended in
batches under one mask. log probabilities of all ids at a place sum to one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from numpy.lib.stride_tricks import as_strided

OWN = 16  # ids scored by a window; it sees as many before them
_I, _J = np.arange(OWN)[:, None] + OWN, np.arange(2 * OWN)[None, :]
MASK = np.where(_J <= _I, 0, -1e9).astype(np.float32)
REL = np.clip(_I - _J, 0, 2 * OWN - 1)
LEAST = 5
RUN = 4  # blocks of a row of a training batch, which share what they see
STEP = 4096  # targets whose states and gradients are in memory at a time


def ranges(s: np.ndarray, e: np.ndarray) -> np.ndarray:
    n = e - s
    total = int(n.sum()) if len(n) else 0
    return np.repeat(s - (np.cumsum(n) - n), n) + np.arange(total) if total else np.zeros(0, np.int64)


def windows(offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(input positions, valid, target positions) of windows over texts' ids; target
    p is predicted from the inputs before it; a text's first input is an end (-1), as
    is every input that is not valid; targets that are not there are -1."""
    n = np.diff(offs)
    blocks = -(-n // OWN)
    start = ranges(np.zeros(len(n), np.int64), blocks) * OWN
    text = np.repeat(np.arange(len(n)), blocks)
    p = start[:, None] + np.arange(-OWN, OWN)[None, :]
    valid = (p >= 0) & (p < n[text][:, None])
    inputs = np.where(valid & (p > 0), p - 1 + offs[text][:, None], -1)
    target = np.where(valid[:, OWN:], p[:, OWN:] + offs[text][:, None], -1)
    return inputs, valid, target


def spread(n: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Texts of ``n`` ids each in one sequence of blocks of OWN, a block without inputs
    before each text, so no window sees the text before: (places of all ids, of each
    text's first, number of blocks)."""
    blocks = -(-n // OWN) + 1
    first = (np.cumsum(blocks) - blocks) * OWN + OWN
    return ranges(first, first + n), first, int(blocks.sum())


@dataclass
class Layout:
    """Which input row, class and place in its class each id has."""

    row_of: np.ndarray
    class_of: np.ndarray
    place: np.ndarray  # row of the output vectors, -1 without
    inside: np.ndarray  # log share within the class, where there is no vector
    cuts: np.ndarray  # rows [cuts[c], cuts[c + 1]) of the output vectors are class c's
    rows: int
    end: int


def layout(counts: np.ndarray, end: int, inputs: int = 6000, hashed: int = 96, single: int = 64, bands: int = 32, vectors: int = 6000, tails: int = 8) -> Layout:
    """From the corpus counts of all ids; an id needs LEAST of them for a row and a
    vector of its own."""
    c = counts + 0.1
    order = np.argsort(-c, kind="stable")
    usual = max(single, int((counts >= LEAST).sum()))
    inputs, vectors = min(inputs, usual), max(single, min(vectors, usual))
    cls, place = np.empty(len(c), np.int64), np.full(len(c), -1)
    inside = np.zeros(len(c))
    cls[order[:single]] = np.arange(single)
    at, sizes = single, [0] * single
    for ids, parts, own in ((order[single:vectors], bands, True), (order[vectors:], tails, False)):
        if not len(ids):
            sizes += [0] * parts
            at += parts
            continue
        mass = np.cumsum(c[ids]) / c[ids].sum()
        k = np.minimum((mass * parts).astype(np.int64), parts - 1)
        cls[ids] = at + k
        n = np.bincount(k, minlength=parts)
        sizes += (n if own else 0 * n).tolist()
        if own:
            place[ids] = np.arange(len(ids))
        else:
            total = np.bincount(k, weights=c[ids], minlength=parts)
            inside[ids] = np.log(c[ids] / total[k])
        at += parts
    row_of = inputs + (np.arange(len(c)) * 2654435761 % (1 << 32)) % hashed
    row_of[order[:inputs]] = np.arange(len(order[:inputs]))
    return Layout(row_of.astype(np.int32), cls.astype(np.int32), place.astype(np.int32), inside.astype(np.float32), np.concatenate(([0], np.cumsum(sizes))), inputs + hashed, end)


class Attention:
    def __init__(self, lay: Layout, p: dict[str, np.ndarray]) -> None:
        self.lay, self.p = lay, p
        self.prepare()

    def prepare(self) -> None:
        p = self.p
        e = p["E"]
        self.q, self.k, self.v = e @ p["Q"] / np.float32(np.sqrt(e.shape[1])), e @ p["K"], e @ p["V"]
        self.s1, self.s2 = e @ p["S1"], e @ p["S2"]
        self.learning()

    def learning(self) -> None:
        """What training derives from the parameters in each step."""
        p = self.p
        # scores of queries against keys are those of q against embeddings, and attended
        # values those of attended embeddings: only targets are projected
        self.qk = p["Q"] @ p["K"].T / np.float32(np.sqrt(len(p["Q"])))
        self.vs = np.concatenate((p["V"], p["S1"], p["S2"]))
        self.bias = MASK + p["R"][REL]
        self.ob, self.ii = np.vstack((p["O"], p["b"])), np.column_stack((p["I"], p["i"]))
        self._table = None

    def table(self) -> np.ndarray:
        """What attention takes of an input, one row each: key, value, 1, query. With it
        come the layers' weights, their biases as a row of the 1 that stays the last column
        of a state."""
        if self._table is None:
            p = self.p
            self._table = np.concatenate((self.k, self.v, np.ones((len(self.k), 1), np.float32), self.q), axis=1)
            self.uc = np.vstack((p["U"], p["c"]))
            self.w0 = np.concatenate((p["W"], np.zeros((len(p["W"]), 1), np.float32)), axis=1)
        return self._table

    def hidden(self, rows: np.ndarray, valid: np.ndarray):
        """rows, valid: (runs, inputs), a run being a block of OWN inputs and the blocks to
        score after it, each of which sees itself and the block before; of all blocks but
        the first: attended, first, hidden, last."""
        return self.forward(rows, valid)[-1]

    def forward(self, rows: np.ndarray, valid: np.ndarray):
        """(embeddings, the same by window; queries; attention below space for gradients
        of its scores; what V, S1 and S2 take; all states)."""
        p, r, d = self.p, len(rows), self.q.shape[1]
        e = p["E"].take(rows.ravel(), axis=0).reshape(r, -1, d)
        w = _windows(e)
        own = e[:, OWN:].reshape(-1, d)
        q = (own @ self.qk).reshape(r, -1, OWN, d)
        both = np.empty((*w.shape[:2], 2 * OWN, 2 * OWN), np.float32)
        a = both[:, :, OWN:]
        shut = None if valid.all() else _windows(np.where(valid, np.float32(0), np.float32(-1e9))[:, :, None]).swapaxes(2, 3)

        def scores():
            np.matmul(q, w.swapaxes(2, 3), out=a)
            np.add(a, self.bias, out=a)
            if shut is not None:
                np.add(a, shut, out=a)
            return a

        _, total = _exp(scores)
        a *= (1 / total)[..., None]
        x = np.empty((r, own.size // d // r, 3 * d), np.float32)
        np.matmul(a, w, out=x.reshape(*q.shape[:3], 3 * d)[..., :d])
        x[:, :, d : 2 * d], x[:, :, 2 * d :] = e[:, OWN - 1 : -1], e[:, OWN - 2 : -2]
        x = x.reshape(-1, 3 * d)
        h1 = x @ self.vs
        h1 += own
        g = h1 @ p["U"]
        g += p["c"]
        g *= g > 0
        h = g @ p["W"]
        h += h1
        return e, w, q, both, x, (h1, g, h)

    def groups(self, cls: np.ndarray):
        """(class, members) for the classes with output vectors among ``cls``."""
        order = np.argsort(cls.astype(np.int16), kind="stable")
        s = cls[order]
        first = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1]))) if len(s) else np.zeros(0, np.int64)
        cuts = self.lay.cuts
        for i, j in zip(first.tolist(), [*first[1:].tolist(), len(s)]):
            c = int(s[i])
            if cuts[c + 1] > cuts[c]:
                yield int(cuts[c]), int(cuts[c + 1]), order[i:j]

    def states(self, rows: np.ndarray, x: np.ndarray, shut: np.ndarray) -> np.ndarray:
        """As ``hidden`` for inputs in blocks of OWN: their ``rows``, those of ``table`` and
        what is added to their scores (0, or much below 0 where no input is). Each window is
        a view of two blocks that follow each other; states of all blocks but the first,
        each with a 1 after it."""
        d, n = self.q.shape[1], len(x) // OWN - 1
        row = x.strides[0]
        view = lambda y, size, width: as_strided(y, (n, size, width), (OWN * row, row, x.itemsize))
        own = x[OWN:]

        def attended(least: bool) -> np.ndarray:
            s = view(own[:, 2 * d + 1 :], OWN, d) @ view(x, 2 * OWN, d).transpose(0, 2, 1)
            s += self.bias
            s += as_strided(shut, (n, 1, 2 * OWN), (OWN * shut.itemsize, 0, shut.itemsize))
            if least:
                s -= s.max(axis=2, keepdims=True)
            np.exp(s, out=s)
            return (s @ view(x[:, d:], 2 * OWN, d + 1)).reshape(-1, d + 1)

        with np.errstate(over="ignore", invalid="ignore"):
            h = attended(False)
        if not (h[:, -1] < LARGE).all():
            h = attended(True)
        h /= h[:, -1:] + np.float32(1e-30)
        own = self.p["E"].take(rows[OWN:], axis=0)
        own += self.s1.take(rows[OWN - 1 : -1], axis=0)
        own += self.s2.take(rows[OWN - 2 : -2], axis=0)
        h[:, :-1] += own
        g = h @ self.uc
        g *= g > 0
        h += g @ self.w0
        return h

    def log_probs(self, h: np.ndarray, t: np.ndarray) -> np.ndarray:
        """Natural log probability of ids ``t`` after the states ``h``, with or without
        the 1 after each."""
        self.table()
        if h.shape[1] < len(self.ob):
            h = np.column_stack((h, np.ones(len(h), np.float32)))
        cls = self.lay.class_of[t]
        out = np.empty(len(t), np.float32)
        for i in range(0, len(t), CLASS_ROWS):
            out[i : i + CLASS_ROWS] = _picked(h[i : i + CLASS_ROWS], self.ob, cls[i : i + CLASS_ROWS])
        out += self.lay.inside[t]
        place = self.lay.place[t]
        several = np.flatnonzero((np.diff(self.lay.cuts) > 0)[cls])
        for s, e, m in self.groups(cls[several]):
            m, w = several[m], np.ascontiguousarray(self.ii[s:e].T)
            step = max(64, (1 << 17) // (e - s))
            for i in range(0, len(m), step):
                k = m[i : i + step]
                out[k] += _picked(h[k], w, place[k] - s)
        return out


CLASS_ROWS = 2048
#: Sums of exponentials up to here are exact enough in 32 bits without a maximum taken off.
LARGE = np.float32(1e30)


_SCRATCH = [np.empty(0, np.float32)]


def _scratch(n: int, k: int) -> np.ndarray:
    """Memory of this worker for one product at a time, without asking for it anew."""
    if len(_SCRATCH[0]) < n * k:
        _SCRATCH[0] = np.empty(n * k, np.float32)
    return _SCRATCH[0][: n * k].reshape(n, k)


def _picked(h: np.ndarray, w: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Log softmax of each row of ``h @ w`` at one place."""
    z = np.matmul(h, w, out=_scratch(len(h), w.shape[1]))
    own = z[np.arange(len(z)), at]
    with np.errstate(over="ignore"):
        np.exp(z, out=z)
        total = z @ np.ones(z.shape[1], np.float32)
    if ((total < LARGE) & (total > 1 / LARGE)).all():
        return own - np.log(total)
    z = h @ w
    most = z.max(axis=1)
    z -= most[:, None]
    return own - most - np.log(np.exp(z, out=z) @ np.ones(z.shape[1], np.float32))


def new_model(counts: np.ndarray, end: int, dim: int = 24, hidden: int = 64, seed: int = 3, **shape) -> Attention:
    """Starts at the shares of ``counts``: biases hold them, output vectors are small."""
    lay = layout(counts, end, **shape)
    rng = np.random.default_rng(seed)
    f = lambda scale, *s: rng.normal(0, scale, s).astype(np.float32)
    c = counts + 0.1
    share = np.bincount(lay.class_of, weights=c)
    share = np.concatenate((share, np.zeros(len(lay.cuts) - 1 - len(share))))
    n, bias = int(lay.cuts[-1]), np.zeros(int(lay.cuts[-1]), np.float32)
    own = np.flatnonzero(lay.place >= 0)
    bias[lay.place[own]] = np.log(c[own] / share[lay.class_of[own]])
    s = 1 / np.sqrt(dim)
    return Attention(lay, {
        "E": f(0.3, lay.rows, dim), "Q": f(s, dim, dim), "K": f(s, dim, dim), "V": f(s, dim, dim), "S1": f(s, dim, dim), "S2": f(s, dim, dim), "R": np.zeros(2 * OWN, np.float32),
        "U": f(s, dim, hidden), "c": np.zeros(hidden, np.float32), "W": f(0.3 / np.sqrt(hidden), hidden, dim),
        "O": f(0.1, dim, len(share)), "b": np.log(share + 1e-6).astype(np.float32), "I": f(0.1, n, dim), "i": bias,
    })


def _scatter(rows: np.ndarray, d: np.ndarray, out: np.ndarray) -> None:
    """out[rows] += d with repeated rows."""
    order = np.argsort(rows.astype(np.uint16) if len(out) < 1 << 16 else rows, kind="stable")
    r = rows[order]
    at = np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1])))
    out[r[at]] += np.add.reduceat(d.take(order, axis=0), at, axis=0)


def _windows(x: np.ndarray) -> np.ndarray:
    """(runs, inputs, width) as (runs, windows, inputs, width), a window being two blocks
    that follow each other; a view."""
    r, n, d = x.shape
    s = x.strides
    return as_strided(x, (r, n // OWN - 1, 2 * OWN, d), (s[0], OWN * s[1], s[1], s[2]))


def _exp(make) -> tuple[np.ndarray, np.ndarray]:
    """(exponentials of the scores that ``make`` gives, their sums along the last axis);
    a maximum is taken off only where 32 bits need it."""
    z = make()
    with np.errstate(over="ignore"):
        np.exp(z, out=z)
        total = z @ np.ones(z.shape[-1], np.float32)
    if len(z) and not ((total < LARGE) & (total > 1 / LARGE)).all():
        z = make()
        z -= z.max(axis=-1, keepdims=True)
        np.exp(z, out=z)
        total = z @ np.ones(z.shape[-1], np.float32)
    return z, total


def _errors(model: Attention, h: np.ndarray, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the softmax over classes: (gradient of -log of the class ``at`` times n, its
    probability)."""
    z, total = _exp(lambda: np.matmul(h, model.ob, out=_scratch(len(h), model.ob.shape[1])))
    k = np.arange(0, z.size, z.shape[1]) + at
    own = z.ravel().take(k) / total
    z *= (n / total)[:, None]
    z.ravel()[k] -= n
    return z, own


def _errors_inside(model: Attention, h: np.ndarray, cls: np.ndarray, place: np.ndarray, n: np.ndarray, out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As ``_errors``, of the ids within their classes, rows in order of class: (gradients
    of the states, probabilities); those of output vectors and biases are added to
    ``out``. All scores lie one after another, those of a class as one matrix."""
    ii, vectors, cuts = model.ii, model.p["I"], model.lay.cuts.tolist()
    back = np.empty((len(h), vectors.shape[1]), np.float32)
    if not len(h):
        return back, np.empty(0, np.float32)
    width = np.diff(model.lay.cuts)[cls]
    end = np.cumsum(width)
    start = end - width
    y = _scratch(1, int(end[-1]))[0]
    parts, i, at = [], 0, 0
    for c, rows in enumerate(np.bincount(cls).tolist()):
        if rows:
            s, e = cuts[c], cuts[c + 1]
            parts.append((i, i + rows, s, e, y[at : at + rows * (e - s)].reshape(rows, e - s)))
            i, at = i + rows, at + rows * (e - s)

    def scores():
        for i, j, s, e, z in parts:
            np.matmul(h[i:j], ii[s:e].T, out=z)
        return y

    with np.errstate(over="ignore"):
        np.exp(scores(), out=y)
        total = np.add.reduceat(y, start)
    if not ((total < LARGE) & (total > 1 / LARGE)).all():
        scores()
        y -= np.repeat(np.maximum.reduceat(y, start), width)
        np.exp(y, out=y)
        total = np.add.reduceat(y, start)
    k = start + (place - model.lay.cuts[cls])
    own = y.take(k) / total
    y *= np.repeat(n / total, width)
    y[k] -= n
    for i, j, s, e, z in parts:
        out[s:e] += z.T @ h[i:j]
        np.matmul(z, vectors[s:e], out=back[i:j])
    return back, own


def gradients(model: Attention, rows: np.ndarray, valid: np.ndarray, ids: np.ndarray, there: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """(mean loss, gradients) of -log probability of the targets that are ``there``, of
    runs as in Attention.hidden."""
    p, lay, d = model.p, model.lay, model.q.shape[1]
    count = max(1, int(there.sum()))
    several = (np.diff(lay.cuts) > 0)[lay.class_of[ids]] & there
    step, ones = max(1, STEP // ids.shape[1]), np.ones(d, np.float32)
    loss, de = 0.0, np.empty((*rows.shape, d), np.float32)
    out = {k: np.zeros_like(p[k]) for k in ("E", "R", "W")}
    ii, ob, uc, vs, m = (np.zeros_like(x) for x in (model.ii, model.ob, np.vstack((p["U"], p["c"])), model.vs, model.qk))
    for i in range(0, len(rows), step):
        z = slice(i, i + step)
        e, win, q, both, x, (h1, g, h) = model.forward(rows[z], valid[z])
        t, w = ids[z].ravel(), there[z].ravel()
        n = np.where(w, np.float32(1 / count), np.float32(0))
        cls = lay.class_of[t]
        one = np.ones((len(h), 1), np.float32)
        h = np.concatenate((h, one), axis=1)
        y, own = _errors(model, h, cls, n)
        ob += h.T @ y
        dh = y @ p["O"].T
        loss -= np.log(np.maximum(own[w], 1e-30)).sum() + lay.inside[t[w]].sum()
        inside = np.flatnonzero(several[z].ravel())
        order = inside[np.argsort(cls[inside].astype(np.int16), kind="stable")]
        back, prob = _errors_inside(model, h.take(order, axis=0), cls[order], lay.place[t[order]], n[order], ii)
        loss -= np.log(np.maximum(prob, 1e-30)).sum()
        dh[order] += back
        out["W"] += g.T @ dh
        dg = dh @ p["W"].T
        dg *= g > 0
        uc += np.concatenate((h1, one), axis=1).T @ dg
        dh += dg @ p["U"].T
        vs += x.T @ dh
        dx = (dh @ model.vs.T).reshape(*q.shape[:3], 3 * d)
        # gradients of scores above attention, queries above those of what is attended:
        # one product sums up both ways in which a target sees an input
        ds, a, back = both[:, :, :OWN], both[:, :, OWN:], np.empty(win.shape, np.float32)
        back[:, :, :OWN], back[:, :, OWN:] = q, dx[..., :d]
        np.matmul(back[:, :, OWN:], win.swapaxes(2, 3), out=ds)
        ds -= ((back[:, :, OWN:] * x.reshape(dx.shape)[..., :d]).reshape(-1, d) @ ones).reshape(*q.shape[:3], 1)
        ds *= a
        out["R"] += np.bincount(REL.ravel(), weights=ds.sum(axis=(0, 1)).ravel(), minlength=2 * OWN).astype(np.float32)
        dq = (ds @ win).reshape(-1, d)
        m += e[:, OWN:].reshape(-1, d).T @ dq
        dh += dq @ model.qk.T
        seen = both.swapaxes(2, 3) @ back
        to = de[z]
        blocks = to.reshape(len(to), -1, OWN, d)
        blocks[:, 0] = seen[:, 0, :OWN]
        blocks[:, 1:] = seen[:, :, OWN:]
        blocks[:, 1:-1] += seen[:, 1:, :OWN]
        dx = dx.reshape(len(to), -1, 3 * d)
        to[:, OWN:] += dh.reshape(len(to), -1, d)
        to[:, OWN - 1 : -1] += dx[..., d : 2 * d]
        to[:, OWN - 2 : -2] += dx[..., 2 * d :]
    m /= np.float32(np.sqrt(d))
    out |= {"Q": m @ p["K"], "K": m.T @ p["Q"], "I": ii[:, :-1], "i": ii[:, -1], "O": ob[:-1], "b": ob[-1], "U": uc[:-1], "c": uc[-1]}
    out["V"], out["S1"], out["S2"] = np.split(vs, 3)
    _scatter(rows.ravel(), de.reshape(-1, d), out["E"])
    return float(loss) / count, out


def runs(texts_ids: list[np.ndarray], lay: Layout) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(input rows, valid, target ids, there) of all texts in runs of RUN blocks, each
    with the block before; a row of the first two is a view of memory that it shares."""
    n = np.array([len(t) for t in texts_ids])
    at, first, blocks = spread(n)
    many = -(-(blocks - 1) // RUN)
    size = (many * RUN + 1) * OWN
    rows, valid = np.full(size + 1, lay.row_of[lay.end], np.int32), np.zeros(size, bool)
    target, there = np.full(size, lay.end, np.int32), np.zeros(size, bool)
    target[at] = np.concatenate(texts_ids)
    rows[at + 1] = lay.row_of[target[at]]
    rows[first + n] = lay.row_of[lay.end]  # the last id is no input
    valid[at] = there[at] = True
    with_before = lambda x: as_strided(x, (many, (RUN + 1) * OWN), (RUN * OWN * x.itemsize, x.itemsize))
    return with_before(rows), with_before(valid), target[OWN:].reshape(many, -1), there[OWN:].reshape(many, -1)


def descend(model: Attention, texts_ids: list[np.ndarray], steps: int | None, batch: int, rate: float, rng: np.random.Generator) -> Attention:
    """Adam on batches of about ``batch`` blocks, for ``steps`` or over all texts once,
    each pass over all runs in an order of its own; ``model`` changes. Without texts it
    stays as it is."""
    texts_ids = [t for t in texts_ids if len(t)]
    if not texts_ids or (steps is not None and steps < 1):
        return model
    x, valid, y, there = runs(texts_ids, model.lay)
    batch = max(1, batch // RUN)
    steps = steps or -(-len(x) // batch)
    names, shapes = list(model.p), [v.shape for v in model.p.values()]
    ends = np.cumsum([v.size for v in model.p.values()]).tolist()
    flat = np.concatenate([v.ravel() for v in model.p.values()])
    model.p = {k: flat[e - int(np.prod(z)) : e].reshape(z) for k, z, e in zip(names, shapes, ends)}
    a, b, grad, root = (np.zeros_like(flat) for _ in range(4))
    order, at = rng.permutation(len(x)), 0
    for step in range(1, steps + 1):
        if at >= len(order):
            order, at = rng.permutation(len(x)), 0
        pick = order[at : at + batch]
        at += batch
        model.learning()
        _, g = gradients(model, x[pick], valid[pick], y[pick], there[pick])
        np.concatenate([g[k].ravel() for k in names], out=grad)
        lr = rate * min(1.0, step / 20) * (1 - 0.9 * step / steps)
        one, two = 1 - 0.9**step, 1 - 0.98**step
        a *= np.float32(0.9)
        a += np.multiply(grad, np.float32(0.1), out=root)
        grad *= grad
        b *= np.float32(0.98)
        grad *= np.float32(0.02)
        b += grad
        np.sqrt(b, out=root)
        root *= np.float32(1 / np.sqrt(two))
        root += np.float32(1e-8)
        np.divide(a, root, out=root)
        root *= np.float32(lr / one)
        flat -= root
    model.prepare()
    return model


def id_scores(model: Attention, ids: np.ndarray, offs: np.ndarray, batch: int = 192) -> np.ndarray:
    """Natural log probability of every id, each text from its own start: a block
    without inputs goes before each text, so no window sees the text before."""
    n = np.diff(offs)
    at, first, blocks = spread(n)
    if not len(at):
        return np.zeros(0)
    size = blocks * OWN
    rows = np.full(size + 1, model.lay.row_of[model.lay.end])
    shut = np.full(size, -1e9, np.float32)
    rows[at + 1] = model.lay.row_of[ids]
    rows[first + n] = model.lay.row_of[model.lay.end]  # the last id is no input
    shut[at] = 0
    table, h = model.table(), np.empty((size - OWN, model.q.shape[1] + 1), np.float32)
    x = np.empty((min(size, (batch + 1) * OWN), table.shape[1]), np.float32)
    for i in range(0, size - OWN, batch * OWN):
        z = min(size, i + (batch + 1) * OWN)
        np.take(table, rows[i:z], axis=0, out=x[: z - i], mode="clip")
        h[i : z - OWN] = model.states(rows[i:z], x[: z - i], shut[i:z])
    return model.log_probs(h[at - OWN], ids).astype(np.float64)
