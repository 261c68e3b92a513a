"""Licence scans, point-in-time features and conversation repair, against plain loops."""

import hashlib
import itertools
import random
import re
import zlib
from datetime import datetime, timedelta

import pytest
from sentrel.llm import licenses, point_in_time as pit, quality_rules, repair
from sentrel.llm.queries import op13_repair

T0 = datetime(2024, 1, 1)
NTZ = {"sales": "sale_id long, client_id long, status string, total double, sold_at timestamp_ntz, arrived_at timestamp_ntz, priority int",
       "sale_lines": "sale_id long, line_no int, item_id long, amount double, shipped_at timestamp_ntz, client_id string",
       "clicks": "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double, props string"}


def cents(x):
    return 0 if x is None else int((100 * x + 0.5) // 1)


def features(sales, lines, clicks):
    out, day = [], timedelta(days=1)
    late = timedelta(minutes=240)
    clicks = list(dict.fromkeys(clicks))
    for s in sales:
        sid, client, _, _, sold, *_ = s
        if client is None or sold is None:
            continue
        t = sold + timedelta(seconds=zlib.crc32(str(sid).encode()) % 259200 if sid is not None else 0)
        label = any(x[1] == client and x[4] is not None and t < x[4] <= t + 7 * day for x in sales)
        for d in (2, 14):
            c = [x for x in clicks if x[3] == client and x[1] is not None and x[2] is not None and t - d * day < x[1] <= t and x[2] + late <= t]
            z = [x for x in sales if x[1] == client and x[4] is not None and x[5] is not None and t - d * day < x[4] <= t and x[5] + late <= t]
            ln = [x for y in z if y[0] is not None for x in lines if x[0] == y[0] and x[4] is not None and x[4] <= t]
            best = max(c, key=lambda x: (x[1], x[0] is not None, x[0] or 0), default=None)
            out.append((sid, d, int((t - datetime(1970, 1, 1)).total_seconds()) * 10**6 + t.microsecond, label, len(c), sum(x[4] == "purchase" for x in c), sum(cents(x[5]) for x in c), best and best[0],
                        len(z), sum(cents(x[3]) for x in z), len(ln), len({x[2] for x in ln} - {None}), sum(cents(x[3]) for x in ln)))
    return sorted(out, key=repr)


def shop(seed, n):
    r = random.Random(seed)
    when = lambda: None if r.random() < 0.05 else T0 + timedelta(hours=r.randint(0, 24 * 40), microseconds=r.choice([0, 0, 1, 7]))
    after = lambda t: None if t is None or r.random() < 0.05 else t + timedelta(hours=r.choice([0, 0, 1, 50, 500]))
    client = lambda: r.choice([None, 5, 5, 5, *range(-2, 12)])
    sales = [(i if r.random() > 0.02 else None, client(), "x", r.choice([None, 1.005, -3.2, 99.99]), t := when(), after(t), 1) for i in range(n)]
    lines = [(r.choice([None, 3, 3, *range(n)]), k, r.choice([None, 7, 7, 7, *range(30)]), r.choice([None, 0.5, 10.014]), when(), "x") for k in range(4 * n)]
    clicks = [(r.choice([None, *range(50)]), t := when(), after(t), client(), r.choice([None, "view", "purchase"]), r.choice([None, 2.5, -1.0]), r.choice([None, "{}"])) for _ in range(3 * n)]
    return sales, lines + lines[:9], clicks + clicks[:40]


@pytest.mark.parametrize("chunks", [1, 8, 200])
def test_features_against_loops(spark, monkeypatch, chunks):
    """Few and many chunks, most of them within one client, item or sale."""
    monkeypatch.setattr(pit, "CHUNK", 10_000 if chunks < 200 else 15)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(min(chunks, 8)))
    try:
        tables = shop(chunks, 90)
        dfs = [spark.createDataFrame(x, s).repartition(3) for x, s in zip(tables, NTZ.values())]
        got = [tuple(r) for r in pit.features(*dfs).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = features(*tables)
    assert sorted(got, key=repr) == want and len(want) > 100
    assert any(w[3] for w in want) and any(w[7] is not None for w in want) and max(w[11] for w in want) > 3


def test_features_of_empty_tables(spark):
    e = [spark.createDataFrame([], s) for s in NTZ.values()]
    assert pit.features(*e).count() == 0
    one = spark.createDataFrame([(1, 1, "x", 2.0, T0, T0, 1)], NTZ["sales"])
    r = pit.features(one, *e[1:]).filter("d = 2").first()
    assert (r.n_sales, r.sale_cents, r.n_lines, r.n_clicks, r.last_click_id, r.label) == (1, 200, 0, 0, None, False)


def test_bounds_order_like_tuples():
    r = random.Random(1)
    rows = [tuple(r.randint(0, 3) for _ in range(3)) for _ in range(60)]
    b = pit.Bounds(r.sample(rows, 17), 3)
    keys = [tuple(k) for k in b.keys.tolist()]
    import numpy as np

    got = b.chunk(*np.array(rows).T.copy())
    assert [sum(k <= x for k in keys) for x in rows] == got.tolist()


# ---- conversations ----------------------------------------------------------------------


def after_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if k:
            out += [(turn, "user" if k == 4 else role, "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text)] * (2 if k == 3 else 1)
    return sorted(out, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))


def cheapest(rows):
    """Best (cost, audit, lines) by trying all edits, state by state."""
    seen, best = set(), {0: (0, "", ())}
    nxt = {0: [("u", 2)], 1: [("u", 2)], 2: [("a", 3)], 3: [("u", 2)]}
    name = {"u": "user", "a": "assistant"}

    def keep(d, q, v):
        if q not in d or v < d[q]:
            d[q] = v

    def inserted(d):
        d = dict(d)
        for _ in range(3):
            for q, v in list(d.items()):
                for i, to in nxt[q]:
                    keep(d, to, (v[0] + 2, v[1] + "I", v[2] + (f"{name[i]}:",)))
        return d

    faults = []
    for _, role, text in rows:
        end = text.rstrip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else "")
        seen.add((role, text))
    for (_, role, text), fault in zip(rows, faults):
        new = {}
        for q, (c, a, b) in inserted(best).items():
            keep(new, q, (c + 3, a + "D", b))
            if fault in ("blank", "duplicate"):
                continue
            c += fault == "truncated"
            for i, to in nxt[q] + ([("s", 1)] if q == 0 else []):
                if role[:1] == i:
                    keep(new, to, (c, a + "K", b + (f"{role}:{text}",)))
                if i != "s":
                    keep(new, to, (c + 2, a + "R", b + (f"{name[i]}:{text}",)))
        best = new
    return min(v for q, v in inserted(best).items() if q in (0, 3)), faults


def audits(rows):
    out = []
    for conv in dict.fromkeys(r[0] for r in rows):
        own = after_damage([r for r in rows if r[0] == conv])
        (cost, audit, lines), faults = cheapest(own)
        turns = [t for t, *_ in own if t is not None]
        out.append((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
                    sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own)), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_repair_against_all_edits(spark, parts):
    """One conversation over most partitions, many small ones, ties, NULLs, odd roles."""
    r = random.Random(parts)
    texts = ["Fine.", "cut", " \t", "", None, "Ünd?", "so! ", "a\nb.", "x" * 70_000 + "."]
    row = lambda conv, turn: (conv, turn, r.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None]), r.choice(texts) if r.random() < 0.6 else f"text {r.random()}.")
    rows = [row(77, r.choice([None, *range(120)])) for _ in range(150)]
    rows += [row(c, t) for c in [None, *range(40)] for t in range(r.randint(1, 7))]
    rows += [(3, 1, "user", "Same.")] * 6 + [(78, None, "user", "cut")]
    df = spark.createDataFrame([(*x, 1) for x in rows], "conv_id long, turn long, role string, text string, cost long").repartition(3)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = sorted((tuple(x) for x in repair.audit(df).collect()), key=repr)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == audits(rows)


def test_repair_of_little(spark, tmp_path):
    schema = "conv_id long, turn long, role string, text string"
    assert repair.audit(spark.createDataFrame([], schema)).count() == 0
    gone = next(i for i in itertools.count() if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    spark.createDataFrame([(gone, 0, "user", "x.")], schema).write.parquet(f"{tmp_path}/conversations.parquet")
    assert tuple(op13_repair(spark, str(tmp_path)).first()) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())


def test_dial_equals_relaxation():
    r = random.Random(5)
    for _ in range(300):
        rows = [(r.choice(["s", "u", "a", ""]), r.random() < 0.3) for _ in range(r.randint(0, 9))]
        goal = r.choice([repair.GOAL, [3, 5, 2, 1], [repair.FAR, repair.FAR, 0, repair.FAR]])
        n, want = len(rows), {}
        dist = [repair.FAR] * (4 * n) + list(goal)
        for _ in range(4 * n + 4):  # Bellman-Ford
            for place, row in enumerate(rows):
                for q, _, to, cost in repair.ARCS[row]:
                    dist[4 * place + q] = min(dist[4 * place + q], cost + dist[4 * place + 4 + to])
                for q, (_, to) in repair.TURNS.items():
                    dist[4 * place + q] = min(dist[4 * place + q], repair.INSERT + dist[4 * place + to])
        want = [min(x, repair.FAR) for x in dist]
        assert [min(x, repair.FAR) for x in repair.distances(rows, list(goal))] == want


# ---- licences ---------------------------------------------------------------------------


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def scanned(docs, weight):
    out = []
    for i, text in docs:
        ws = words_of(text)
        spots = lambda phrase: [x for x in range(len(ws)) if ws[x : x + len(phrase)] == phrase]
        base = [(x, label) for phrase, label in licenses.BASE for x in spots(phrase.split())]
        labels, score = {label for _, label in base}, 0.5 if base else 0.0
        for label, notice, keys in licenses.TEMPLATES:
            t = notice.split()
            rare = sorted(set(t), key=lambda w: (-weight[w], w))[: licenses.RARE]
            near = lambda x, y, k: licenses.BAND * (k - 1) <= x - y < licenses.BAND * (k + 1)
            for k in range(-len(t), len(ws) // licenses.BAND + 2):
                hit = lambda w, places: any(near(x, y, k) for x in range(len(ws)) if ws[x] == w for y in places)
                if sum(hit(w, [y for y, v in enumerate(t) if v == w]) for w in rare) < licenses.NEED:
                    continue
                if all(any(near(x, next(y for y in range(len(t)) if t[y : y + len(p.split())] == p.split()), k) for x in spots(p.split())) for p in keys):
                    labels.add(label)
                    score = max(score, sum(weight[w] for y, w in enumerate(t) if hit(w, [y])) / sum(weight[w] for w in t))
        out.append((i, len(ws), len(base), min((x for x, _ in base), default=None), max((x for x, _ in base), default=None), ",".join(sorted({b for _, b in base})), ",".join(sorted(labels)), round(score, 6)))
    return sorted(out, key=repr)


def test_scan_against_loops(spark):
    r = random.Random(2)
    docs = [(None, None), (0, ""), (1, "LICENSED under the\tApache-License, Version 2.0!"), (1, "CC BY, cc/by; accby cc byé"), (2, "mit license mit license"), (4, "the " * 3000 + "released under the MIT License"), (5, "cc"), (5, "by")]
    for i in range(6, 60):
        notice = r.choice(licenses.TEMPLATES)[1].split()
        for _ in range(r.randint(0, 5)):
            p = r.randrange(len(notice))
            notice[p : p + r.randint(0, 1)] = r.choice([[], ["né"], ["the"], ["x"] * 9])
        docs.append((i, "\n".join([*r.choices(["the", "of", "lorem", "software"], k=r.randint(0, 12)), " # ".join(notice), *r.choices(["any", "ipsum"], k=3)])))
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, score long").repartition(3)
    weight = licenses.weights(df)
    assert weight["the"] < weight["mozilla"] and min(weight.values()) >= 1
    want = scanned(docs, weight)
    got = licenses.scan_licenses(df).collect()
    assert sorted((tuple(x) for x in got), key=repr) == want
    assert len({x for w in want for x in w[6].split(",")}) > 8 and licenses.scan_licenses(df.limit(0)).count() == 0
    by = {x.doc_id: x for x in got}
    assert by[4].first_word == 3003 and by[2].n_base == 2 and (by[None].labels, by[None].score) == ("", 0.0)


def test_places_of_notices(spark):
    gpl, mit = licenses.TEMPLATES[2][1], licenses.TEMPLATES[13][1]
    docs = [(1, f"{'x ' * 30}{gpl} {'y ' * 40}{mit} z {'w ' * 50}{gpl}"), (2, None), (3, "my own terms of use apply to all that is here")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted((r.doc_id, r.label, r.first_word, r.last_word, r.share) for r in licenses.find_licenses(df).collect())
    n, m = len(gpl.split()), len(mit.split())
    at = [30, 30 + n + 40, 30 + n + 40 + m + 1 + 50]
    assert got == [(1, "gpl-3.0", at[0], at[0] + n - 1, 1.0), (1, "gpl-3.0", at[2], at[2] + n - 1, 1.0), (1, "mit", at[1], at[1] + m - 1, 1.0)]
    own = (("own", "my own terms of use apply", ("own terms of use",)),)
    assert [(r.doc_id, r.label, r.first_word, r.last_word) for r in licenses.find_licenses(df, own).collect()] == [(3, "own", 0, 5)]
    assert {r.doc_id: r.labels for r in licenses.scan_licenses(df, templates=own).collect()} == {1: "gpl,mit", 2: "", 3: "own"}
    assert licenses.find_licenses(df.limit(0)).count() == 0


def test_boilerplate_stands_alone():
    line = lambda s: quality_rules.line_is_boilerplate(s.encode(), s.encode().split())
    assert not line("We plan several design upgrades for the new bridge this year.") and not line("They may resign upon his return.") and not line("désign upé")
    assert line("Please SIGN UP here.") and line("(Tous droits réservés)") and line("sign up")
