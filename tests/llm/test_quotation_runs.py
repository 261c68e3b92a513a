"""Quotation linking against loops over all messages and runs."""

import random
import re

import pytest
from pyspark.sql import functions as F
from sentrel.llm import quotation

SCHEMA = "conv_id long, turn long, role string, text string"


def plain(s):
    return re.sub(r"[\W_]+", " ", s.lower()).strip()


def linked(rows):
    """(conv, turn): n_quotes, n_linked, reply_conv, reply_to, anchor."""
    said, quotes = {}, {}
    for conv, turn, _, text in rows:
        own, runs, last = [], [], None
        for i, line in enumerate((text or "").split("\n")):
            mark = re.match(r"((?:[ \t]*>)+)[ \t]?", line)
            level = mark[0].count(">") if mark else 0
            content = line[len(mark[0]):] if mark else line
            if not level:
                own.append(content)
            elif last == (level, i - 1):
                runs[-1][1].append(content)
            else:
                runs.append((level, [content]))
            last = (level, i)
        lines = [x for x in map(plain, own) if x]
        said.setdefault((conv, turn), set()).update([" ".join(lines), *(tuple(lines[i:j]) for i in range(len(lines)) for j in range(i + 1, len(lines) + 1))])
        for level, p in runs:  # passages of one level that read the same are one, however they are broken
            if h := plain("\n".join(p)):
                quotes.setdefault((conv, turn), {}).setdefault((level, h), set()).add(tuple(x for x in map(plain, p) if x))
    forms = {}
    for qs in quotes.values():
        for (_, h), how in qs.items():
            forms.setdefault(h, set()).update(how)
    holds = lambda x, h: h in x or (h,) in x or any(f in x for f in forms[h])
    out = {}
    for (conv, turn), qs in ((k, quotes.get(k, {})) for k in said):
        near, far, n = [], [], 0
        for _, h in qs:
            a = [t for (c, t), x in said.items() if c == conv and t < turn and holds(x, h)]
            other = [(c, t) for (c, t), x in said.items() if c != conv and holds(x, h)]
            n += bool(a or other)
            near += a and [max(a)]
            far += [] if a else other and [min(other)]
        before = (conv, turn - 1) in said
        reply = (conv, max(near)) if near else min(far) if far else (conv, turn - 1) if before else (None, None)
        out[conv, turn] = (len(qs), n, *reply, max(near) if near else turn)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_links_against_loops(spark, seed):
    r = random.Random(seed)
    line = lambda: " ".join(r.choice(["aa", "Bb", "cc!", "dé", "ee."]) for _ in range(r.randint(0, 2)))
    rows, texts = [], [["start"]]
    for conv in range(12):
        for turn in range(r.randint(1, 9)):
            out = []
            for _ in range(r.randint(0, 2)):
                old = r.choice(texts)
                i = r.randrange(len(old))
                out += [r.choice(["> ", ">> ", " > >"]) + x for x in old[i : i + r.randint(1, 4)]] + [line()] * r.randint(0, 1)
            own = [line() for _ in range(r.randint(0, 6))]
            texts.append(own or [""])
            rows.append((conv, turn * r.choice([1, 1, 2]), "user", "\n".join(out + own)))
    rows = list({(a, b): (a, b, c, d) for a, b, c, d in rows}.values())
    got = {(x.conv_id, x.turn): (x.n_quotes, x.n_linked, x.reply_conv, x.reply_to, x.anchor) for x in quotation.link_quotes(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = linked(rows)
    assert got == want
    assert sum(w[1] for w in want.values()) > 15 and any(w[2] not in (None, k[0]) for k, w in want.items())


def test_many_lines_and_lengths(spark):
    """3,000 lines, quoted in 200 lengths: only runs that begin like a passage are made."""
    r = random.Random(3)
    lines = [f"line {i} of {r.random()}" for i in range(3000)]
    places = {k: r.randrange(2700) for k in range(2, 202)}
    replies = [(1, k, "user", "\n".join(f"> {x}" for x in lines[at : at + k]) + f"\nanswer {k}") for k, at in places.items()]
    df = spark.createDataFrame([(1, 0, "user", "\n".join(lines)), *replies], SCHEMA)
    m = quotation.parse(df).withColumn("_row", F.monotonically_increasing_id())
    first = F.xxhash64(F.lit(plain(lines[5])), F.lit(plain(lines[6])))
    starts = spark.range(1).select(first.alias("f"), F.sequence(F.lit(2), F.lit(201)).alias("ks"))
    assert quotation._runs(m, starts).count() == 200
    got = quotation.link_quotes(df).filter("turn > 0").collect()
    assert len(got) == 200 and all((x.n_quotes, x.n_linked, x.reply_to) == (1, 1, 0) for x in got)
