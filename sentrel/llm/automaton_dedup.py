"""Operator 9: removal of word windows that occur in a document with a smaller id.

Reference shards are the anchor classes of repeats.py; a suffix automaton is built
over one shard's passages in order of id, each state remembering the first id that
reached it, and the passages are streamed through it for their matching statistics.
Shards are dealt by a shuffle and not by broadcast: sending every shard to every
executor would cost the square of the corpus, and no bound holds for their size.

NULL and empty texts have no words; texts shorter than a window lose nothing; equal
ids do not remove each other's words; a NULL id comes after all others.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
from pyspark.sql import DataFrame

from sentrel.llm import repeats, seq


class SuffixAutomaton:
    """Over several passages of integers; ``first``: the tag of the first passage in
    which a state's strings occur. Add passages in order of tag."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.len, self.first = [-1], [0], [None]

    def add(self, passage, tag) -> None:
        nxt, link, length, first = self.next, self.link, self.len, self.first
        last = 0
        for x in passage:
            q = nxt[last].get(x)
            if q is not None and length[q] == length[last] + 1:
                last = q
                continue
            if q is None:
                cur = len(nxt)
                nxt.append({})
                length.append(length[last] + 1)
                link.append(0)
                first.append(tag)
                p = last
                while p >= 0 and x not in nxt[p]:
                    nxt[p][x] = cur
                    p = link[p]
                if p >= 0:
                    q = nxt[p][x]
                    link[cur] = q if length[q] == length[p] + 1 else self._clone(p, q, x)
                last = cur
            else:
                last = self._clone(last, q, x)

    def _clone(self, p: int, q: int, x) -> int:
        nxt, link = self.next, self.link
        c = len(nxt)
        nxt.append(dict(nxt[q]))
        self.len.append(self.len[p] + 1)
        self.first.append(self.first[q])
        link.append(link[q])
        link[q] = c
        while p >= 0 and nxt[p].get(x) == q:
            nxt[p][x] = c
            p = link[p]
        return c

    def windows(self, passage, size: int) -> list:
        """For each window of the passage the first tag of its string, None if absent."""
        nxt, link, length, first = self.next, self.link, self.len, self.first
        state = matched = 0
        out = []
        for i, x in enumerate(passage):
            while state and x not in nxt[state]:
                state = link[state]
                matched = length[state]
            if x in nxt[state]:
                state = nxt[state][x]
                matched += 1
            while state and length[link[state]] >= size:
                state = link[state]
                matched = length[state]
            if i >= size - 1:
                out.append(first[state] if matched >= size else None)
        return out


def _symbols(buf: np.ndarray, offs: np.ndarray):
    w = seq.Words(buf, offs)
    h = w.hashes()
    return h, w.offs, h, (buf, offs)


def _keep(ctx, so: np.ndarray, gone: np.ndarray) -> list[str]:
    buf, offs = ctx
    data, o, left = buf.tobytes(), offs.tolist(), (~gone).tolist()
    s, out = so.tolist(), []
    for k in range(len(o) - 1):
        words = data[o[k] : o[k + 1]].split()
        out.append(b" ".join(compress(words, left[s[k] : s[k + 1]])).decode("utf-8", "replace"))
    return out


def _keep_layout(ctx, so: np.ndarray, gone: np.ndarray) -> list[str]:
    """As _keep, but white space stays: a removed word goes with what follows it, up
    to the next word of its text."""
    buf, offs = ctx
    w = seq.Words(buf, offs)
    step = np.zeros(len(buf) + 1, dtype=np.int32)
    if gone.any():
        last = np.append(w.starts[1:], len(buf))
        text_end = offs[1:][np.searchsorted(w.offs, np.arange(len(w.starts)), "right") - 1]
        step += np.bincount(w.starts[gone], minlength=len(step)).astype(np.int32)
        step -= np.bincount(np.minimum(last, text_end)[gone], minlength=len(step)).astype(np.int32)
    stay = np.cumsum(step[:-1]) <= 0
    cut = np.concatenate(([0], np.cumsum(stay)))[offs].tolist()
    data = buf[stay].tobytes()
    return [data[i:j].decode("utf-8", "replace") for i, j in zip(cut[:-1], cut[1:])]


def _settle(size: int):
    def f(a, r, n, v, c, raw) -> np.ndarray:
        lengths = n + size - 1
        at = np.cumsum(lengths) - lengths
        to = np.cumsum(n) - n
        out = np.empty(int(n.sum()), dtype=np.int64)
        order = np.lexsort((v, a))
        g = seq.group_starts(a[order])
        words, al, ll, tl, nl, vl, rl = raw, at.tolist(), lengths.tolist(), to.tolist(), n.tolist(), v.tolist(), r.tolist()
        for i, j in zip(g.tolist(), [*g[1:].tolist(), len(order)]):
            members = order[i:j].tolist()
            sam, seen = SuffixAutomaton(), {}
            for m in members:
                if rl[m] not in seen:
                    seen[rl[m]] = passage = words[al[m] : al[m] + ll[m]].tolist()
                    sam.add(passage, vl[m])
            found = {k: sam.windows(p, size) for k, p in seen.items()}
            for m in members:
                out[tl[m] : tl[m] + nl[m]] = found[rl[m]]
        return out

    return f


def rule(size: int = 13, gram: int | None = None, layout: bool = False) -> repeats.Rule:
    """``gram``: words of an anchor, by default about a third of a window."""
    gram = gram or max(1, min(5 + (size - 13) // 4, size))
    return repeats.Rule(size, min(gram, size), np.uint64, True, _symbols, _settle(size), _keep_layout if layout else _keep, "string")


def dedup_passages(docs: DataFrame, size: int = 13, id_col: str = "doc_id", text_col: str = "text", carry: bool = False, layout: bool = False) -> DataFrame:
    """See repeats.remove_repeats; ``kept``: the words left, joined by one space, or
    with ``layout`` with their own white space."""
    return repeats.remove_repeats(docs, rule(size, layout=layout), id_col, text_col, carry)
