"""Operator 12: point-in-time features, pushed from rows to probes.

Every sale is a probe at a time t. A click, sale or line counts for the probes of its
client in one range of times: from when it has happened and arrived, to when its window
ends. So a row is not looked up by probes; it adds its value where its range begins and
takes it off where it ends, and running sums over the probes give all counts.

Both ends of each row and the probes are dealt to chunks by (client, time). Bounds come
from a sample, so a client with many rows has many chunks. Within a chunk the
probes are ranked, ``searchsorted`` finds the first probe of each end, ``np.add.at``
adds the values there and ``cumsum`` sums them up. Rows that cover the chunk's start
enter as constants: every task that deals rows out knows what its rows leave open at
each bound and sends that as one row per chunk, so no task sees a client's whole
history. Distinct items need the union of ranges first: the lines of a client and item
are dealt by (client, item, time) in the same way, and each keeps only the part that
earlier ones do not cover.

Rows without a client or time take part in nothing; rows that have not arrived (NULL)
are no clicks, sales or lines, but a sale without an arrival is a probe and a label.
Equal clicks count once, equal lines and sales each. Amounts that are NULL are 0 cents.
A sale without an id is probed at its own time. Empty tables give no rows; other
columns are not read. Times without a zone are UTC.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

WINDOWS = (2, 14)  # days
LABEL_DAYS = 7
LATE = "INTERVAL 240 MINUTES"
PROBE_SPREAD = 259_200  # seconds
DAY = 86_400_000_000
#: Ends that one chunk holds about; rows per chunk that bounds are chosen from.
CHUNK = 500_000
SAMPLE = 100

NONE = np.iinfo(np.int64).min  # a NULL id
PROBE, CLICK, SALE, LINE, ITEM, LABEL = range(6)
ENDS = "p int, client long, at long, kind int, n long, aux long, cents long, ts long, id long"
PARTS = "p int, client long, item long, lo long, sold long, carry boolean"
RESULT = "sale_id long, d int, t_us long, label boolean, n_clicks long, n_purchases long, click_cents long, last_click_id long, n_sales long, sale_cents long, n_lines long, n_items long, line_cents long"
Ends = dict[str, np.ndarray]


def cents(c: str) -> Column:
    return F.coalesce(F.floor(F.lit(100) * F.col(c) + F.lit(0.5)), F.lit(0)).cast("long")


def ntz(c: str) -> Column:
    return F.col(c).cast("timestamp_ntz")


def _longs(b, name: str) -> np.ndarray:
    a = b.column(name)
    a = a.combine_chunks() if isinstance(a, pa.ChunkedArray) else a
    if pa.types.is_timestamp(a.type):
        a = a.cast(pa.timestamp("us")).cast(pa.int64())
    return (a.fill_null(NONE) if a.null_count else a).to_numpy(zero_copy_only=False).astype(np.int64, copy=False)


# ---- dealing by sampled bounds -------------------------------------------------------


class Bounds:
    """Sorted keys; a key belongs to the chunk of the last bound not above it."""

    def __init__(self, rows: list[tuple[int, ...]], width: int):
        self.keys = np.array(sorted(set(rows)), np.int64).reshape(-1, width)

    def chunk(self, *key: np.ndarray) -> np.ndarray:
        """Of each key (columns in order) the number of bounds that are not above it."""
        if not len(self.keys):
            return np.zeros(len(key[0]), np.int64)
        lo, hi = (np.searchsorted(self.keys[:, 0], key[0], side) for side in ("left", "right"))
        for values, column in zip(self.keys.T[1:], key[1:]):  # narrows to the bounds equal in the columns before
            some = np.flatnonzero(lo < hi)
            if len(some):
                lo[some], hi[some] = _within(values, lo[some], hi[some], column[some])
        return hi

    def __len__(self) -> int:
        return len(self.keys) + 1


def _within(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each x where the bounds of [lo, hi) that equal it begin and end."""
    def search(up: Callable) -> np.ndarray:
        a, b = lo.copy(), hi.copy()
        while (apart := a < b).any():
            mid = (a + b) >> 1
            more = apart & up(values[np.minimum(mid, len(values) - 1)], x)
            a, b = np.where(more, mid + 1, a), np.where(apart & ~more, mid, b)
        return a

    return search(np.less), search(np.less_equal)


def _merged(keys: list[np.ndarray], sums: Ends, tops: Ends) -> tuple[list[np.ndarray], Ends]:
    """Rows with equal keys become one: sums are added, of tops the last in order stays."""
    order = np.lexsort([*reversed(list(tops.values())), *reversed(keys)])
    keys = [k[order] for k in keys]
    if not len(order):
        return keys, {k: v[order] for k, v in {**sums, **tops}.items()}
    new = np.concatenate(([True], np.any([k[1:] != k[:-1] for k in keys], axis=0)))
    at = np.flatnonzero(new)
    ends = np.append(at[1:], len(order)) - 1
    out = {k: np.add.reduceat(v[order], at) for k, v in sums.items()} | {k: v[order][ends] for k, v in tops.items()}
    return [k[at] for k in keys], out


# ---- ends of rows ---------------------------------------------------------------------


def _ends(client, lo, base, kind: int, n, aux=None, value=None, ts=None, ids=None, mask=None) -> list[Ends]:
    """A value begins at ``lo`` and ends ``d`` days after ``base``, for each window d
    whose bit is in ``mask``. The kind of an end tells what it counts and for which d."""
    zero = np.zeros(len(client), np.int64)
    aux, value = zero if aux is None else aux, zero if value is None else value
    mask = np.full(len(client), (1 << len(WINDOWS)) - 1) if mask is None else mask
    m = sum(((mask >> i & 1) * (lo < base + d * DAY)) << i for i, d in enumerate(WINDOWS))
    none = np.full(len(client), NONE)

    def rows(keep, at, k, sign, named=False):
        pick = {"client": client, "at": at, "kind": kind * 4 + k, "n": sign * n, "aux": sign * aux, "cents": sign * value, "ts": ts if named else none, "id": ids if named else none}
        return {c: np.broadcast_to(v, len(client))[keep] for c, v in pick.items()}

    out = [rows(m > 0, lo, m, 1, ts is not None)]
    return out + [rows((m >> i & 1) > 0, base + d * DAY, 1 << i, -1) for i, d in enumerate(WINDOWS)]


def _clicks(b) -> list[Ends]:
    ts = _longs(b, "ts")
    return _ends(_longs(b, "client"), _longs(b, "lo"), ts, CLICK, np.int64(1), _longs(b, "bought"), _longs(b, "cents"), ts, _longs(b, "id"))


def _sales(b) -> list[Ends]:
    client, sold, lo, value = (_longs(b, c) for c in ("client", "sold", "lo", "cents"))
    zero, none = np.zeros(len(client), np.int64), np.full(len(client), NONE)
    base = {"aux": zero, "cents": zero, "ts": none}
    probe = base | {"client": client, "at": sold + _longs(b, "after") * 1_000_000, "kind": zero, "n": zero, "id": _longs(b, "id")}
    labels = [base | {"client": client, "at": at, "kind": zero + LABEL * 4 + 3, "n": zero + sign, "id": none} for at, sign in ((sold - LABEL_DAYS * DAY, 1), (sold, -1))]
    there = lo != NONE
    return [probe, *labels, *_ends(client[there], lo[there], sold[there], SALE, np.int64(1), value=value[there])]


def _lines(b) -> list[Ends]:
    return _ends(_longs(b, "client"), _longs(b, "lo"), _longs(b, "sold"), LINE, _longs(b, "n"), value=_longs(b, "cents"))


def _items(b) -> list[Ends]:
    return _ends(_longs(b, "client"), _longs(b, "lo"), _longs(b, "sold"), ITEM, np.int64(1), mask=_longs(b, "mask"))


def _batch(columns: Ends, ddl: str) -> pa.RecordBatch:
    types = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_()}
    fields = [x.split() for x in ddl.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(columns[n]).cast(types[t]) for n, t in fields], [n for n, _ in fields])


def _deal_ends(build: Callable, bounds: Bounds):
    """Deals ends and probes to chunks. Once all are dealt, tells each chunk what these
    rows leave open at its bound: as ends that begin there."""
    kinds = 6 * 4

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((3, len(bounds), kinds), np.int64)
        tops: dict[int, tuple[int, int, int]] = {}
        for b in batches:
            parts = build(b)
            e = {c: np.concatenate([x[c] for x in parts]) for c in parts[0]}
            e["p"] = bounds.chunk(e["client"], e["at"])
            probe = e["kind"] == PROBE
            if probe.any():
                yield _batch({c: v[probe] for c, v in e.items()}, ENDS)
                e = {c: v[~probe] for c, v in e.items()}
            keys, rest = _merged([e[c] for c in ("p", "client", "at", "kind")], {c: e[c] for c in ("n", "aux", "cents")}, {c: e[c] for c in ("ts", "id")})
            e = dict(zip(("p", "client", "at", "kind"), keys)) | rest
            for s, c in zip(sums, ("n", "aux", "cents")):
                np.add.at(s, (e["p"], e["kind"]), e[c])
            named = np.flatnonzero(e["ts"] != NONE)
            if len(named):
                order = named[np.lexsort([e[c][named] for c in ("id", "ts", "client", "p")])]
                last = order[np.append(e["p"][order][1:] != e["p"][order][:-1], True)]
                for p, *top in zip(*(e[c][last].tolist() for c in ("p", "client", "ts", "id"))):
                    tops[p] = max(tops.get(p, tuple(top)), tuple(top))
            yield _batch(e, ENDS)
        left = np.cumsum(sums, axis=1)[:, :-1]  # by chunk whose bound comes next
        p, kind = np.nonzero(left.any(axis=0))
        carry = {"p": p + 1, "client": bounds.keys[p, 0] if len(p) else p, "at": bounds.keys[p, 1] if len(p) else p, "kind": kind, **dict(zip(("n", "aux", "cents"), left[:, p, kind])), "ts": np.full(len(p), NONE), "id": np.full(len(p), NONE)}
        yield _batch(carry, ENDS)
        rows, top = [], (NONE, NONE, NONE)
        for q in range(1, len(bounds)):
            top = max(top, tops.get(q - 1, top))
            client, at = bounds.keys[q - 1].tolist()
            if top[0] == client and top[1] != NONE:
                rows.append((q, client, at, CLICK * 4 + 3, 0, 0, 0, top[1], top[2]))
        if rows:
            yield _batch(dict(zip(("p", "client", "at", "kind", "n", "aux", "cents", "ts", "id"), np.array(rows, np.int64).T)), ENDS)

    return f


# ---- one chunk ------------------------------------------------------------------------


def _resolve(table: pa.Table) -> pa.Table:
    """The features of a chunk's probes."""
    e = {c: _longs(table, c) for c in ("client", "at", "kind", "n", "aux", "cents", "ts", "id")}
    is_probe = e["kind"] == PROBE
    q = {c: e[c][is_probe] for c in ("client", "at", "id")}
    order = np.lexsort((q["id"], q["at"], q["client"]))
    q = {c: v[order] for c, v in q.items()}
    e = {c: v[~is_probe] for c, v in e.items()}
    n = len(order)
    # rank of (client, time) among the probes, without products that overflow
    clients, times = np.unique(q["client"]), np.unique(q["at"])
    wide = len(times) + 1
    rank = np.searchsorted(clients, q["client"]) * wide + np.searchsorted(times, q["at"])
    c = np.searchsorted(clients, e["client"])
    known = np.append(clients, 0)[c] == e["client"] if n else np.zeros(len(c), bool)
    known &= c < len(clients)
    pos = np.searchsorted(rank, c * wide + np.where(known, np.searchsorted(times, e["at"]), 0))

    def total(kind: int, column: str, bit: int) -> np.ndarray:
        hit = (e["kind"] >> 2 == kind) & (e["kind"] & bit > 0)
        out = np.zeros(n + 1, np.int64)
        np.add.at(out, pos[hit], e[column][hit])
        return np.cumsum(out)[:n]

    named = np.flatnonzero(e["ts"] != NONE)
    named = named[np.lexsort((e["id"][named], e["ts"][named], e["client"][named]))]
    best = np.full(n + 1, -1, np.int64)
    np.maximum.at(best, pos[named], np.arange(len(named)))
    best = np.maximum.accumulate(best)[:n]
    last = {c: (e[c][named][best] if len(named) else np.full(n, NONE)) for c in ("client", "ts", "id")}
    here = (best >= 0) & (last["client"] == q["client"])
    label = total(LABEL, "n", 1) > 0
    out = []
    for i, d in enumerate(WINDOWS):
        bit = 1 << i
        fits = here & (last["ts"] + d * DAY > q["at"]) & (last["id"] != NONE)
        out.append([
            pa.array(q["id"], mask=q["id"] == NONE), pa.array(np.full(n, d, np.int32)), pa.array(q["at"]), pa.array(label),
            *[pa.array(total(k, c, bit)) for k, c in ((CLICK, "n"), (CLICK, "aux"), (CLICK, "cents"))], pa.array(last["id"], mask=~fits),
            *[pa.array(total(k, c, bit)) for k, c in ((SALE, "n"), (SALE, "cents"), (LINE, "n"), (ITEM, "n"), (LINE, "cents"))],
        ])
    names = [x.split()[0] for x in RESULT.split(", ")]
    return pa.concat_tables([pa.Table.from_arrays(x, names) for x in out])


# ---- distinct items -------------------------------------------------------------------


def _deal_parts(bounds: Bounds):
    """Deals lines by (client, item, time); of equal ones the latest sale stays. A chunk
    whose bound is inside a client and item gets the latest sale before it."""
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tops: dict[int, tuple[int, int, int]] = {}
        for b in batches:
            e = {c: _longs(b, c) for c in ("client", "item", "lo", "sold")}
            p = bounds.chunk(e["client"], e["item"], e["lo"])
            keys, rest = _merged([p, e["client"], e["item"], e["lo"]], {}, {"sold": e["sold"]})
            e = dict(zip(("p", "client", "item", "lo"), keys)) | rest
            order = np.lexsort([e[c] for c in ("sold", "item", "client", "p")])
            last = order[np.append(e["p"][order][1:] != e["p"][order][:-1], True)] if len(order) else order
            for p, *top in zip(*(e[c][last].tolist() for c in ("p", "client", "item", "sold"))):
                tops[p] = max(tops.get(p, tuple(top)), tuple(top))
            yield _batch(e | {"carry": np.zeros(len(e["p"]), bool)}, PARTS)
        rows, top = [], (NONE, NONE, NONE)
        for q in range(1, len(bounds)):
            top = max(top, tops.get(q - 1, top))
            client, item, lo = bounds.keys[q - 1].tolist()
            if top[:2] == (client, item) and top[2] != NONE:
                rows.append((q, client, item, lo, top[2]))
        if rows:
            yield _batch(dict(zip(("p", "client", "item", "lo", "sold"), np.array(rows, np.int64).T)) | {"carry": np.ones(len(rows), bool)}, PARTS)

    return f


def _uncovered(table: pa.Table) -> pa.Table:
    """Of each line's range the part that earlier lines of its client and item leave."""
    e = {c: _longs(table, c) for c in ("client", "item", "lo", "sold")}
    carry = table.column("carry").to_numpy()
    order = np.lexsort((~carry, e["lo"], e["item"], e["client"]))
    e, carry = {c: v[order] for c, v in e.items()}, carry[order]
    first = np.concatenate(([True], (e["client"][1:] != e["client"][:-1]) | (e["item"][1:] != e["item"][:-1]))) if len(order) else carry
    group = np.cumsum(first)
    sold = np.unique(e["sold"])
    top = np.maximum.accumulate(group * (len(sold) + 1) + np.searchsorted(sold, e["sold"]))
    before = np.concatenate(([0], top[:-1])) % (len(sold) + 1) if len(order) else top
    prior = sold[np.minimum(before, len(sold) - 1)] if len(order) else top
    starts = [np.where(first, e["lo"], np.maximum(e["lo"], prior + d * DAY)) for d in WINDOWS]
    open_ = [~carry & (s < e["sold"] + d * DAY) for s, d in zip(starts, WINDOWS)]
    both = open_[0] & open_[1] & (starts[0] == starts[1])
    picked = [(both, starts[0], 3), (open_[0] & ~both, starts[0], 1), (open_[1] & ~both, starts[1], 2)]
    return pa.table({
        "client": np.concatenate([e["client"][k] for k, _, _ in picked]), "lo": np.concatenate([s[k] for k, s, _ in picked]),
        "sold": np.concatenate([e["sold"][k] for k, _, _ in picked]), "mask": np.concatenate([np.full(int(k.sum()), m) for k, _, m in picked]),
    })


# ---- the operator ---------------------------------------------------------------------


def _some(df: DataFrame, rows: int, wanted: int) -> DataFrame:
    """About ``wanted`` of the ``rows``, or all."""
    return df.sample(wanted / rows, 7) if rows > wanted else df


def _bounds(df: DataFrame, step: int) -> Bounds:
    """Every ``step``-th row in order, the first after half a step. The rows are sorted
    in ranges; only the bounds, a few numbers a chunk, reach the driver."""
    def every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for b in batches:
            at = np.arange((step // 2 - seen) % step, b.num_rows, step)
            seen += b.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(_longs(b, c)[at]) for c in b.schema.names], b.schema.names)

    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = df.repartitionByRange(n, *df.columns).sortWithinPartitions(*df.columns)
    return Bounds([tuple(r) for r in ordered.mapInArrow(every, ", ".join(f"{c} long" for c in df.columns)).collect()], len(df.columns))


def features(sales: DataFrame, lines: DataFrame, clicks: DataFrame) -> DataFrame:
    """Per sale with client and time, and per window d: t_us, label, counts and sums
    known at t (see RESULT)."""
    spark = sales.sparkSession
    sizes = {"sales": sales.count(), "lines": lines.count(), "clicks": clicks.count()}
    weights = {"sales": 6, "lines": 6, "clicks": 3}
    total = sum(n * weights[k] for k, n in sizes.items())
    chunks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // CHUNK))

    after = F.coalesce(F.crc32(F.col("sale_id").cast("string").cast("binary")) % PROBE_SPREAD, F.lit(0))
    seen = lambda time: F.when(F.col("arrived_at").isNotNull(), F.greatest(ntz(time), ntz("arrived_at") + F.expr(LATE)))
    s = sales.filter("client_id IS NOT NULL AND sold_at IS NOT NULL").select(F.col("client_id").alias("client"), ntz("sold_at").alias("sold"), seen("sold_at").alias("lo"), cents("total").alias("cents"), after.alias("after"), F.col("sale_id").alias("id"))
    c = clicks.filter("client_id IS NOT NULL AND ts IS NOT NULL AND arrived_at IS NOT NULL").select("click_id", "ts", "arrived_at", "client_id", "kind", "value", F.unhex(F.md5("props")).alias("props")).distinct()
    c = c.select(F.col("client_id").alias("client"), ntz("ts").alias("ts"), seen("ts").alias("lo"), F.coalesce((F.col("kind") == "purchase").cast("long"), F.lit(0)).alias("bought"), cents("value").alias("cents"), F.col("click_id").alias("id"))
    known = s.filter("lo IS NOT NULL AND id IS NOT NULL").select(F.col("id").alias("sale_id"), "client", "sold", "lo")
    shipped = lines.filter("sale_id IS NOT NULL AND shipped_at IS NOT NULL")
    per_day = shipped.groupBy("sale_id", ntz("shipped_at").alias("at")).agg(F.count("*").alias("n"), F.sum(cents("amount")).alias("cents"))
    per_item = shipped.filter("item_id IS NOT NULL").groupBy("sale_id", F.col("item_id").alias("item")).agg(F.min(ntz("shipped_at")).alias("at"))
    ripe = F.col("lo") < F.col("sold") + F.expr(f"INTERVAL {max(WINDOWS)} DAYS")
    begun = F.greatest("lo", "at").alias("lo")
    ln = per_day.join(known, "sale_id").select("client", begun, "sold", "n", "cents").filter(ripe)
    it = per_item.join(known, "sale_id").select("client", "item", begun, "sold").filter(ripe)

    # bounds: of sampled lines with their sales, clicks and sales
    wanted = SAMPLE * chunks
    some = _some(shipped.select("sale_id", F.coalesce("item_id", F.lit(0)).alias("item"), ntz("shipped_at").alias("at")), sizes["lines"], wanted)
    from_lines = known.join(some, "sale_id").select("client", "item", begun)
    from_clicks = _some(clicks.filter("client_id IS NOT NULL AND ts IS NOT NULL AND arrived_at IS NOT NULL").select(F.col("client_id").alias("client"), seen("ts").alias("lo")), sizes["clicks"], wanted)
    from_sales = _some(s.select("client", F.col("sold").alias("lo")), sizes["sales"], wanted)
    sampled = {k: min(n, wanted) for k, n in sizes.items()}
    by_item = _bounds(from_lines, max(1, sampled["lines"] // chunks))
    by_time = _bounds(from_lines.select("client", "lo").unionByName(from_clicks).unionByName(from_sales), max(1, sum(sampled.values()) // chunks))

    parts = it.mapInArrow(_deal_parts(by_item), PARTS).groupBy("p").applyInArrow(_uncovered, "client long, lo long, sold long, mask long")
    ends = [(s, _sales), (c, _clicks), (ln, _lines), (parts, _items)]
    dealt = None
    for df, build in ends:
        e = df.mapInArrow(_deal_ends(build, by_time), ENDS)
        dealt = e if dealt is None else dealt.unionByName(e)
    return dealt.groupBy("p").applyInArrow(_resolve, RESULT)
