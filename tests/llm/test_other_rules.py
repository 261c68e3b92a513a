import heapq
import random
import re
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F
from sentrel.llm import decontaminate as dc, mixing, quality_rules, quotation


def semi_global(item, text):
    row = [0] * (len(text) + 1)
    for i, x in enumerate(item):
        new = [i + 1]
        for j, y in enumerate(text):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def as_compared(t):
    return re.sub("[ \t-\r]+", " ", "".join(c.lower() if "A" <= c <= "Z" else c for c in t))


@pytest.mark.parametrize("small", [False, True])
def test_leaks_against_alignment(spark, monkeypatch, small):
    if small:  # several shards, slices and segments
        for name, x in (("SHARD_BYTES", 300), ("SLICE", 40), ("SEGMENT", 64)):
            monkeypatch.setattr(dc, name, x)
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdéfg") for _ in range(rnd.randint(2, 7)))
    items = [(i, " ".join(word() for _ in range(rnd.randint(12, 30)))) for i in range(8)] + [(90, None), (91, ""), (92, "short")]
    docs = [(0, None), (1, ""), (2, "x " * 3000), (None, items[0][1].replace(" ", "\n\t "))]
    for d in range(3, 60):
        parts = [" ".join(word() for _ in range(rnd.randint(0, 40)))]
        t = list(rnd.choice(items[:8])[1])
        for _ in range(rnd.randint(0, 12)):
            p = rnd.randrange(len(t))
            t[p] = rnd.choice(["", "Z", t[p] + "y", t[p].upper(), "ü"])
        docs.append((d, " ".join([*parts, "".join(t), word()])))
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = dc.find_leaks(df, bench).collect()
    text, item = dict(docs), {i: as_compared(t or "") for i, t in items}
    want = {}
    for i, t in items[:8]:
        e = dc.edit_budget(len(t), 0.05, 16)
        want |= {(d, i): n for d, x in docs if x and (n := semi_global(as_compared(t), as_compared(x))) <= e}
    assert {(r.doc_id, r.item_id): r.edits for r in got} == want and len(want) > 5 and len(got) == len(want)
    assert all(distance(item[r.item_id], as_compared(text[r.doc_id][r.start_char : r.end_char])) == r.edits for r in got)
    left = dc.drop_leaks(df, bench)
    assert {r.doc_id for r in left.collect()} == {d for d, _ in docs} - {d for d, _ in want}
    none = spark.createDataFrame([], "item_id long, text string")
    assert dc.find_leaks(df, none).count() == 0 and dc.drop_leaks(df, none).count() == len(docs)
    odd = df.select("doc_id", "text", *[F.lit(1).alias(c) for c in ("_leak", "_text", "_id", "_x", "_h1", "item_id")])
    assert dc.drop_leaks(odd, bench).columns == odd.columns and dc.drop_leaks(odd, bench).count() == left.count()


def test_places_of_a_repeating_text():
    phrase = "the same phrase comes again, "
    index = dc.Index([(1, phrase * 10), (2, "nothing like it is there at all, not once")], 16, 0.05)
    buf = np.frombuffer((phrase * 40_000).encode(), np.uint8)
    tracemalloc.start()
    chars, offs, _ = dc.plain(buf, np.array([0, len(buf)]))
    n, last = 0, 0
    for t, i, s, e, edits in dc.places(index, chars, offs):
        assert (t, i, edits) == (0, 0, 0) and s >= last
        n, last = n + 1, e
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert 3800 < n <= 4000 and peak < 150 << 20, (n, peak >> 20)


def sainte_lague(weights, seats):
    heap = [(-w, i, 0) for i, w in enumerate(weights) if w > 0]
    heapq.heapify(heap)
    quota = [0] * len(weights)
    for _ in range(seats if heap else 0):
        _, i, k = heapq.heappop(heap)
        quota[i] += 1
        heapq.heappush(heap, (-(weights[i] / (2 * k + 3)), i, k + 1))
    return quota


def test_quotas_against_a_heap(spark):
    rnd = random.Random(8)
    cases = [([500] + [0.49] * 600, 794), ([500] + [0.52] * 600, 812), ([600] + [0.4] * 1000, 1000), ([1.0] * 7, 10), ([0.0, 0.0], 3), ([0.0, 2.0], 0), ([3.0], 5)]
    cases += [([float(rnd.choice([0, 1, rnd.random(), rnd.randint(1, 10) ** rnd.randint(1, 6)])) for _ in range(rnd.randint(1, 30))], rnd.randint(0, 200)) for _ in range(200)]
    rows = [(g, i, float(w), s) for g, (ws, s) in enumerate(cases) for i, w in enumerate(ws)]
    df = spark.createDataFrame(rows, "g int, i int, w double, seats int")
    got = {(r.g, r.i): r.quota for r in mixing.apportion_within(df, "seats", "w", "g", "i").collect()}
    for g, (ws, s) in enumerate(cases):
        assert [got[g, i] for i in range(len(ws))] == sainte_lague(ws, s), (ws, s)
    for g in (0, 1, 2, 3, 4, 5, 20, 21):
        one = mixing.apportion(df.filter(F.col("g") == g), cases[g][1], "w", "i").orderBy("i").collect()
        assert [r.quota for r in one] == sainte_lague(*cases[g])


def fill(sizes, share=1.5, cap=2.0):
    names = sorted([s for s in sizes if s is not None]) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    out, left, free = {}, share * sum(sizes.values()), set(names)
    while free:
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total > cap * sizes[s]}
        if not over:
            out |= {s: left * weight[s] / total for s in free}
            break
        for s in over:
            out[s] = cap * sizes[s]
            left -= out[s]
        free -= over
    return out


@pytest.mark.parametrize("shard_docs", [5, 4000])
def test_mix(spark, shard_docs):
    rnd = random.Random(1)
    rows = [(i, " ".join("w" * rnd.randint(0, 300)), rnd.choice(["a", "a", "a", "a", "b", "é", "z", None])) for i in range(300)] + [(900, None, "a"), (901, "x", "only"), (902, "", "empty")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df, block=16, shard_docs=shard_docs).collect()
    again = mixing.mix(df.repartition(3), block=16, shard_docs=shard_docs).collect()
    assert sorted(map(str, got)) == sorted(map(str, again)) and len(got) == len(rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = fill(sizes)
    for s, t in want.items():
        mine = [r for r in got if r.source == s]
        assert all(abs(r.target - t) < 1e-6 and r.source_size == sizes[s] and 0 <= r.taken <= 2 * r.size for r in mine)
        shards = -(-len(mine) // shard_docs)
        assert abs(sum(r.taken for r in mine) - t) <= 16 * (shards + 1)


def test_mix_ties_and_repeated_rows(spark):
    rows = [(1, "a b c d e f", "s")] * 50 + [(None, "a b c d e f", "s"), (None, "g h", "s"), (2, "a b c d e f", "t"), (2, "x y z", "t"), (None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df, block=4).collect()
    assert len(got) == len(rows) and len({r.taken for r in got if r.doc_id == 1}) == 1
    assert all(0 <= r.taken <= 2 * r.size for r in got)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(df.repartition(7), block=4).collect()))


def test_mix_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(df).count() == 0
    assert [r.taken for r in mixing.mix(spark.createDataFrame([(1, None, "a")], df.schema)).collect()] == [0]


def test_rules_edges(spark):
    rows = [(1, None), (2, ""), (3, " ".join(f"w{i}, b." for i in range(30))), (4, "A | b | c | d | e | f\n" * 4), (5, ("w " * 25).strip()), (6, "\n".join(f"This a{i} is b{i} a clean c{i} line d{i}." for i in range(5)) + "\nAll rights reserved.")]
    got = {r.doc_id: r for r in quality_rules.apply_rules(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [d for d in got if got[d].kept] == [3, 6]
    assert got[4].n_dup_lines == 3 and got[5].n_repeat_words == 25 and "rights" not in got[6].cleaned
    foot = "Click here to sign up for more.\n"
    lost = spark.createDataFrame([(1, "".join(f"{i} {foot}" for i in range(100)) + "These four words stay."), (2, "Jetzt ANMELDEN, alle Rechte vorbehalten!\n" + "\n".join(f"Ein a{i} Satz b{i} mit c{i} Wörtern d{i}." for i in range(9)))], "doc_id long, text string")
    lost = {r.doc_id: r for r in quality_rules.apply_rules(lost).collect()}
    assert not lost[1].kept and lost[1].n_lost_words == 800 and lost[1].n_kept_words == 4 and lost[2].kept and "Rechte" not in lost[2].cleaned
    wide = spark.createDataFrame([(1, "a", 2, "y")], "doc_id long, text string, kept int, cleaned string")
    assert quality_rules.apply_rules(wide, carry=True).first()["_x"]["cleaned"] == "y"


def test_quotation(spark):
    rows = [
        (1, 0, "user", "First line here.\nSecond point!"), (1, 1, "assistant", "Answer one."), (1, 2, "user", "> Second  POINT\n>> deep unknown\nI disagree."),
        (1, 3, "assistant", "> > Second point\n> I disagree.\nWell."), (2, 0, "user", "> answer one\nfrom elsewhere"), (2, 5, "user", None), (3, 1, "user", ">\n>> \nnothing quoted"),
    ]
    got = {(r.conv_id, r.turn): r for r in quotation.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert len(got) == 7
    assert (got[1, 2].own_text, got[1, 2].max_level, got[1, 2].n_quotes, got[1, 2].n_linked, got[1, 2].reply_to, got[1, 2].anchor) == ("I disagree.", 2, 2, 1, 0, 0)
    assert (got[1, 3].own_text, got[1, 3].n_linked, got[1, 3].reply_to) == ("Well.", 2, 2)
    assert (got[2, 0].reply_conv, got[2, 0].reply_to, got[2, 0].anchor) == (1, 1, 0)
    assert got[1, 1].reply_to == 0 and got[2, 5].reply_to is None and got[3, 1].n_quotes == 0
    rows = [
        (1, 0, "user", "Aa\nBb\n\nCc\nDd"), (1, 1, "assistant", "ok"), (1, 2, "user", "> bb\n> cc\nyes"), (1, 3, "assistant", "> bb\n> dd\nno"),
        (2, 0, "user", "> shared line\nShared line"), (3, 0, "user", "x"), (3, 4, "user", "shared line"),
    ]
    got = {(r.conv_id, r.turn): r for r in quotation.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert (got[1, 2].n_quotes, got[1, 2].n_linked, got[1, 2].reply_to) == (1, 1, 0)  # some lines of a message
    assert (got[1, 3].n_linked, got[1, 3].reply_to) == (0, 2)  # not consecutive ones
    assert (got[2, 0].n_linked, got[2, 0].reply_conv, got[2, 0].reply_to) == (1, 3, 4)  # first own occurrence is this message
    assert quotation.link_quotes(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_conversations_in_reply_order(spark):
    rows = [(1, t, "user", f"line {t} of it") for t in range(6)] + [(1, 6, "bot", "> line 1 of it\nanswer to one"), (1, 7, "bot", "> answer to one\ndeep"), (1, 7, "bot", "twin"), (1, 8, "bot", "> line 5 of it"), (None, 1, "user", "no conversation"), (2, None, "user", "> line 3 of it\nno turn"), (2, 4, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = quotation.link_quotes(df).collect()
    one = sorted((r for r in got if r.conv_id == 1), key=lambda r: r.position)
    assert [r.position for r in one] == list(range(1, 11)) and len(got) == len(rows)
    assert [r.turn for r in one] == [0, 1, 6, 2, 3, 4, 5, 8, 7, 7]
    whole = {(r.conv_id, r.part): r.messages for r in quotation.conversations(df, part=4).collect()}
    assert [len(whole[1, p]) for p in (0, 1, 2)] == [4, 3, 2] and whole[1, 0][2].text == "answer to one" and whole[1, 0][2].reply_to == 1
    assert whole[2, 0][0].reply_conv is None and whole[None, 0][0].text == "no conversation"


def test_hot_conversation_and_line(spark, monkeypatch):
    """Each quoting turn finds the latest turn before it, whatever the number of turns."""
    monkeypatch.setattr(quotation, "BLOCK", 7)
    rows = [(1, t, "user", "> same line\nsame line" if t % 3 == 0 else "other\nsame line" if t % 3 == 1 else f"x{t}") for t in range(300)]
    got = {r.turn: r for r in quotation.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    for t in range(3, 300, 3):
        assert got[t].reply_to == t - 2 and got[t].n_linked == 1
    assert got[0].n_linked == 0
