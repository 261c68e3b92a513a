"""Operator 13: repair of the structure of conversations by shortest paths.

A conversation may begin with a system turn; after it user and assistant alternate,
user first, assistant last. Edits bring a conversation to that form: K(eep) a row,
R(erole) it to what is expected, D(elete) it, I(nsert) an empty turn. Keeping costs 0,
rerole and insertion 2, deletion 3, a truncated row that stays 1 more; blank rows and
repeated ones have to go. Places between rows and the four states of the form are the
nodes of a graph whose arcs are edits. Costs are small integers, so distances to the end
are found with Dial's ring of buckets instead of a heap; the audit is the walk from the
start that takes the first letter of the alphabet whose arc is tight.

Rows are dealt by ranges of (conv_id, turn, role, text), so a conversation of any length
lies in consecutive partitions and only those at the partitions' edges are cut. For cut
ones every partition tells what it costs to get from each state at its end to each
state at its start, then where each of the four ways in leads: a few numbers a partition
go through the driver, texts never do. Rows of equal conversation, turn, role and text
are one row with a number.

NULLs in any column count as one blank in texts and sums; rows without a conversation
belong to one of their own (NULL), rows without a turn come first. Rows of one turn are
ordered by role and text. Roles beginning with another letter than s, u, a cannot be
kept. Empty texts are blank, empty tables give no rows, other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sentrel.llm.graph import written

KEEP, REROLE, DELETE, INSERT, CUT = 0, 2, 3, 2, 1
#: States: nothing yet, after system, after user, after assistant. What is written from
#: each: (initial, next state).
START, SYSTEM, USER, ASSISTANT = range(4)
TURNS = {START: ("u", USER), SYSTEM: ("u", USER), USER: ("a", ASSISTANT), ASSISTANT: ("u", USER)}
ROLES = {"u": "user", "a": "assistant"}
ENDINGS = (START, ASSISTANT)
FAR = 1 << 40
#: More than any arc costs and than two finite distances at one place can differ.
RING = 16
SPACE = " \t\n\x0b\x0c\r"

EDITS = "conv_id long, part int, pos long, edit string, role string, text string, turn long, n long, fault string, was string, whole boolean"
AUDIT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows after the damage: conv_id, turn, role, text, n (how many equal ones)."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    kind = F.crc32(key.cast("binary")) % 20
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), kind.alias("kind")).filter("kind <> 0")
    out = rows.select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"), F.when(F.col("kind") == 3, 2).otherwise(1).alias("n"),
    )
    return out.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n"))


def _with_repeats(rows: DataFrame) -> DataFrame:
    """Adds ``again``: the conversation has the role and text in an earlier turn."""
    digest = F.sha2(F.concat_ws("\x00", F.length("role").cast("string"), "role", "text"), 256)
    first = rows.groupBy(F.col("conv_id").alias("c"), digest.alias("first_h")).agg(F.min(F.struct("turn")).alias("t")).select("c", F.col("t.turn").alias("t"), "first_h")
    r = rows.withColumn("h", digest)
    j = r.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & F.col("turn").eqNullSafe(F.col("t")) & (F.col("h") == F.col("first_h")), "left")
    return j.select("conv_id", "turn", "role", "text", "n", F.col("first_h").isNull().alias("again"))


# ---- the graph of one run of rows -----------------------------------------------------


def fault_of(text: str, again: bool) -> str:
    kept = text.rstrip(SPACE)
    return "blank" if not kept else "duplicate" if again else "truncated" if kept[-1] not in ".!?" else ""


def _arcs(initial: str, cut: bool) -> list[tuple[int, str, int, int]]:
    """(state, edit, next state, cost) over one row that may stay."""
    more = CUT * cut
    out = [(q, "D", q, DELETE) for q in TURNS] + [(q, "R", nxt, REROLE + more) for q, (_, nxt) in TURNS.items()]
    out += [(q, "K", nxt, KEEP + more) for q, (wanted, nxt) in TURNS.items() if wanted == initial]
    return out + ([(START, "K", SYSTEM, KEEP + more)] if initial == "s" else [])


ARCS = {(i, c): _arcs(i, c) for i in ("s", "u", "a", "") for c in (False, True)}
BACK = {k: [[(q, cost) for q, _, to, cost in v if to == state] for state in TURNS] for k, v in ARCS.items()}
AHEAD = {k: [sorted((e, to, cost) for q, e, to, cost in v if q == state) for state in TURNS] for k, v in ARCS.items()}
INTO = [[q for q, (_, to) in TURNS.items() if to == state] for state in TURNS]


def distances(rows: list[tuple[str, bool]], goal: list[int]) -> list[int]:
    """From each node (place * 4 + state) to the end; ``goal``: what remains from each
    state after the last row. Dial's buckets: all open distances lie in one ring. At the
    last place no turn is inserted: what comes next has done that."""
    n = len(rows)
    dist, done = [FAR] * (4 * n + 4), bytearray(4 * n + 4)
    least = min(goal)
    if least >= FAR:
        return dist
    ring: list[list[int]] = [[] for _ in range(RING)]
    for q, g in enumerate(goal):
        if g < FAR:
            assert g - least < RING - REROLE - CUT
            dist[4 * n + q] = g
            ring[g % RING].append(4 * n + q)
    at, open_ = least, sum(g < FAR for g in goal)
    back = [BACK[r] for r in rows]
    while open_:
        bucket = ring[at % RING]
        while bucket:
            node = bucket.pop()
            open_ -= 1
            if done[node]:
                continue
            done[node] = 1
            place, state = node >> 2, node & 3
            if place < n:
                for q in INTO[state]:
                    to = 4 * place + q
                    if at + INSERT < dist[to]:
                        dist[to] = at + INSERT
                        ring[(at + INSERT) % RING].append(to)
                        open_ += 1
            if place:
                for q, cost in back[place - 1][state]:
                    to = 4 * place - 4 + q
                    if at + cost < dist[to]:
                        dist[to] = at + cost
                        ring[(at + cost) % RING].append(to)
                        open_ += 1
        at += 1
    return dist


#: What remains after the last row of a conversation, insertions included.
GOAL = [0, 2 * INSERT, INSERT, 0]


def walk(rows: list[tuple[str, bool]], dist: list[int], state: int, final: bool) -> tuple[list[str], int]:
    """The edits of each row (insertions before it are I's in front) and the last
    state. ``final``: the conversation ends here, so missing turns follow as one more
    entry."""
    out = []
    for place, row in enumerate(rows):
        edits = ""
        while True:
            here = dist[4 * place + state]
            for edit, to, cost in [*AHEAD[row][state][:1], ("I", TURNS[state][1], INSERT), *AHEAD[row][state][1:]]:
                node = 4 * place + to if edit == "I" else 4 * place + 4 + to
                if cost + dist[node] == here:
                    break
            else:
                raise AssertionError("no tight arc")
            edits, state = edits + edit, to
            if edit != "I":
                break
        out.append(edits)
    if final:
        tail = ""
        while state not in ENDINGS:
            tail, state = tail + "I", TURNS[state][1]
        out.append(tail)
    return out, state


# ---- partitions -----------------------------------------------------------------------


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, int | None, Iterator]]:
    """Consecutive rows of one conversation: (is it the first, conv_id, rows)."""
    run, key, first = [], None, True
    for b in batches:
        for r in b.to_pylist():
            if run and r["conv_id"] != key:
                yield first, key, run
                run, first = [], False
            key = r["conv_id"]
            run.append(r)
    if run:
        yield first, key, run


def _staying(run: list[dict]) -> list[tuple[str, bool]]:
    """The classes of rows that may stay; the others add a fixed cost."""
    return [((r["role"][:1] if r["role"][:1] in ("s", "u", "a") else ""), f == "truncated") for r in run if (f := fault_of(r["text"], r["again"])) in ("", "truncated")]


def _edges(part_of):
    """Of the first and the last run of a partition: costs between states."""
    def f(batches):
        runs, last = [], None
        for first, key, run in _runs(batches):
            rows = _staying(run)
            last = (part_of(run), first, key, rows)
            if first:
                runs.append(last)
        if last and last is not runs[0]:
            runs.append(last)
        for i, (p, first, key, rows) in enumerate(runs):
            cost = [distances(rows, [0 if q == end else FAR for q in TURNS])[:4] for end in TURNS]
            yield pa.RecordBatch.from_pydict({"part": pa.array([p], pa.int32()), "first": [first], "last": [i == len(runs) - 1], "conv_id": pa.array([key], pa.int64()), "cost": pa.array([[x for c in cost for x in c]], pa.list_(pa.int64()))})

    return f


def _ways(part_of, goals: dict[int, list[int]]):
    """Of runs that go on in the next partition: the state in which each of the four
    ways in ends (-1: there is none)."""
    def f(batches):
        last = None
        for last in _runs(batches):
            pass
        if last and part_of(last[2]) in goals:
            first, _, run = last
            p, rows = part_of(run), _staying(run)
            dist = distances(rows, goals[p])
            ends = [walk(rows, dist, q, False)[1] if dist[q] < FAR else -1 for q in TURNS]
            yield pa.RecordBatch.from_pydict({"part": pa.array([p], pa.int32()), "first": [first], "ends": pa.array([ends], pa.list_(pa.int32()))})

    return f


def _edits(part_of, goals: dict[int, list[int]], starts: dict[int, int]):
    """One row per edit. ``goals``: of partitions whose last run goes on, what remains
    after it; ``starts``: the state in which a partition's first run begins, where it is
    the rest of a conversation."""
    names = [x.split()[0] for x in EDITS.split(", ")]
    types = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
    schema = pa.schema([(n, types[t]) for n, t in (x.split() for x in EDITS.split(", "))])

    def f(batches):
        held, out = None, []
        for first, key, run in _runs(batches):
            if held:
                out += edited(*held, False)
            held = (first, key, run)
            if len(out) >= 2000:
                yield batch(out)
                out = []
        if held:
            out += edited(*held, True)
        if out:
            yield batch(out)

    def batch(rows):
        return pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*rows)))), schema=schema)

    def edited(first, key, run, last):
        p, rows = part_of(run), _staying(run)
        begun, goes_on = first and p in starts, last and p in goals
        whole = not (begun or goes_on)
        goal = goals[p] if goes_on else GOAL
        state = starts[p] if begun else START
        dist = distances(rows, goal)
        steps, _ = walk(rows, dist, state, not goes_on)
        step, pos, out = iter(steps), 0, []

        def add(edit, role, text, turn=None, n=1, fault=None, was=None):
            nonlocal pos
            out.append((key, p, pos, edit, role, text, turn, n, fault, was, whole))
            pos += 1

        def insert(k):
            nonlocal state
            for _ in range(k):
                initial, state = TURNS[state]
                add("I", ROLES[initial], "")

        for r in run:
            fault, n = fault_of(r["text"], r["again"]), r["n"]
            initial = r["role"][:1]
            if fault in ("blank", "duplicate"):
                add("D", None, None, r["turn"], n, fault, initial)
                continue
            todo = next(step)
            insert(len(todo) - 1)
            edit = todo[-1]
            if edit == "K":
                state = SYSTEM if initial == "s" else TURNS[state][1]
                add("K", r["role"], r["text"], r["turn"], 1, fault, initial)
            elif edit == "R":
                wanted, state = TURNS[state]
                add("R", ROLES[wanted], r["text"], r["turn"], 1, fault, initial)
            else:
                add("D", None, None, r["turn"], 1, fault, initial)
            if n > 1:  # equal rows after the first
                add("D", None, None, r["turn"], n - 1, "duplicate", initial)
        if not goes_on:
            insert(len(next(step)))
        return out

    return f


def repair(conversations: DataFrame) -> DataFrame:
    """One row per edit, in order of (part, pos) within a conversation: the letter, the
    role and text that stay or are inserted, turn, fault and initial of the row before,
    n: of how many equal rows. ``whole``: the conversation lies in one partition."""
    spark = conversations.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    key = ("conv_id", "turn", "role", "text")
    dealt = written(_with_repeats(damaged(conversations)).repartitionByRange(n, *key).sortWithinPartitions(*key).withColumn("part", F.spark_partition_id()))
    part_of = lambda run: run[0]["part"]
    edges = sorted(dealt.mapInArrow(_edges(part_of), "part int, first boolean, last boolean, conv_id long, cost array<long>").collect(), key=lambda r: (r.part, not r.first))
    goals, cut = _goals(edges)
    starts: dict[int, int] = {}
    if goals:
        ways = {r.part: r for r in dealt.mapInArrow(_ways(part_of, goals), "part int, first boolean, ends array<int>").collect()}
        state = START
        for p in sorted({r.part for r in edges}):
            if p in cut:
                starts[p] = state
            if p in goals:
                state = ways[p].ends[starts.get(p, START) if ways[p].first else START]
    return dealt.mapInArrow(_edits(part_of, goals, starts), EDITS)


def _goals(edges: list) -> tuple[dict[int, list[int]], set[int]]:
    """Of each partition whose last run goes on in the next one: the costs that remain
    from each state after it; and the partitions that begin with such a rest."""
    goals: dict[int, list[int]] = {}
    cut: set[int] = set()
    ahead: list[int] | None = None  # costs from the start of the partition after
    after = None
    for r in reversed(edges):
        goal = GOAL
        if r.last and after is not None and after.conv_id == r.conv_id:
            goals[r.part] = goal = ahead
            cut.add(after.part)
        if r.first:
            ahead = [min(r.cost[4 * end + q] + goal[end] for end in TURNS) for q in TURNS]
            after = r
    return goals, cut


# ---- the audit of each conversation -----------------------------------------------------


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest columns of edits that come in order; holds one text at a time."""
    names = [x.split()[0] for x in AUDIT.split(", ")]
    schema = pa.schema([(n, pa.string() if n in ("audit", "repaired_sha256") else pa.int64()) for n in names])
    rows, now = [], None

    def close():
        gaps = now["high"] - now["low"] + 1 - now["turns"] if now["turns"] else 0
        rows.append((now["conv"], gaps, now["blank"], now["duplicate"], now["truncated"], now["illegal"], now["cost"], "".join(now["audit"]), now["sha"].hexdigest()))

    for b in batches:
        for r in b.to_pylist():
            if now is None or now["conv"] != r["conv_id"]:
                if now is not None:
                    close()
                now = {"conv": r["conv_id"], "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "turns": 0, "low": None, "high": None, "audit": [], "sha": hashlib.sha256(), "any": False, "was": None}
            n, e = r["n"], r["edit"]
            now["audit"].append(e * n)
            now["cost"] += {"D": DELETE, "I": INSERT, "R": REROLE, "K": KEEP}[e] * n + (CUT if r["fault"] == "truncated" and e in "KR" else 0)
            if e in "KRI":
                now["sha"].update((("\n" if now["any"] else "") + f"{r['role']}:{r['text']}").encode())
                now["any"] = True
            if e == "I":
                continue
            if r["fault"]:
                now[r["fault"]] += n
            # adjacent initials: to the row before, and among equal rows
            now["illegal"] += now["was"] is not None and now["was"] + r["was"] not in ("su", "ua", "au")
            now["illegal"] += n - 1
            now["was"] = r["was"]
            if r["turn"] is not None and r["turn"] != now["high"]:
                now["turns"] += 1
                now["low"] = r["turn"] if now["low"] is None else now["low"]
                now["high"] = r["turn"]
        if len(rows) >= 1000:
            yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*rows)))), schema=schema)
            rows = []
    if now is not None:
        close()
    if rows:
        yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*rows)))), schema=schema)


def audit(conversations: DataFrame) -> DataFrame:
    """One row per original conversation. Conversations that lie in one partition are
    folded there. A digest of one text is made in order, so the edits of each cut one
    (at most one per partition) are brought together and pass through one task as a
    stream."""
    edits = written(repair(conversations))
    n = max(1, int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cut = edits.filter("NOT whole").repartition(n, "conv_id").sortWithinPartitions("conv_id", "part", "pos")
    found = edits.filter("whole").mapInArrow(_fold, AUDIT).unionByName(cut.mapInArrow(_fold, AUDIT))
    ids = conversations.select(F.col("conv_id").cast("long").alias("id")).distinct()
    names = [x.split()[0] for x in AUDIT.split(", ")]
    j = ids.join(found, F.col("id").eqNullSafe(F.col("conv_id")), "left")
    empty = {"audit": F.lit(""), "repaired_sha256": F.lit(hashlib.sha256().hexdigest())}
    return j.select(F.col("id").alias("conv_id"), *[F.coalesce(F.col(c), empty.get(c, F.lit(0).cast("long"))).alias(c) for c in names[1:]])
