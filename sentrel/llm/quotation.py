"""Operator 7: conversations in reply order, without their quotations.

Lines that begin with ">" are quoted, once for each ">". Consecutive lines of one
level make a passage; it is looked up among the runs of consecutive own lines (blank ones
aside; the same lines, normalised) and the whole own texts of all messages: first in the
same conversation before this turn, else the first message of another one. DataFrame functions only.

A message answers the latest earlier message of its conversation that it quotes,
else the turn before it, if there is one. ``anchor`` is that quoted turn, else the
message's own turn. ``position`` numbers a conversation's messages from 1 in reply
order, by (anchor, turn, hash of the message): each answer comes behind what it
answers. It is found in sorted ranges, so no task sees a whole conversation.

Messages are parsed once and written. NULL texts have no lines; empty passages link
with nothing; equal (conv_id, turn) are separate rows and one message as a target;
equal rows follow each other. Rows with a NULL conv_id or turn answer nothing; a NULL
turn has no anchor and comes first. Very common passages are reduced to two targets
before the join, the quoting side is salted, and of the turns that hold a passage only
those next before a quoting turn are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from sentrel.llm import graph

MARK = r"^((?:[ \t]*>)+)[ \t]?"
SALTS = 16
#: Turns that are looked through at a time.
BLOCK = 1024
#: Messages of one row of an assembled conversation.
PART = 500


def _hash(normalised: Column) -> Column:
    return F.when(normalised != "", F.md5(normalised))


def normalised(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "))


def normal_lines(text: Column) -> Column:
    """The normalised lines of a text, empty ones too, in one pass over it."""
    return F.transform(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\n]+", " "), "\n"), lambda x: F.trim(x))


def parse(messages: DataFrame) -> DataFrame:
    """Adds own_text, max_level and ``_quoted``: array of (pos, level, content). Lines
    are only looked at in texts that hold a ">"."""
    prefix = lambda x: F.regexp_extract(x, MARK, 0)
    line = lambda x, i: F.struct(i.alias("pos"), F.length(F.regexp_replace(prefix(x), "[^>]", "")).alias("level"), F.substr(x, F.length(prefix(x)) + 1).alias("content"))
    text = F.coalesce("text", F.lit(""))
    lines = messages.withColumn("_lines", F.when(text.contains(">"), F.transform(F.split(text, "\n"), line)))
    own = F.array_join(F.transform(F.filter("_lines", lambda x: x["level"] == 0), lambda x: x["content"]), "\n")
    return lines.withColumns({
        "own_text": F.when(F.col("_lines").isNull(), text).otherwise(own),
        "max_level": F.when(F.col("_lines").isNull(), F.lit(0)).otherwise(F.array_max(F.transform("_lines", lambda x: x["level"]))),
        "_quoted": F.filter("_lines", lambda x: x["level"] > 0),
    }).drop("_lines")


def _runs(m: DataFrame, starts: DataFrame) -> DataFrame:
    """o_conv, o_turn, p: runs of consecutive own lines that may be quoted passages.
    ``starts``: the first two lines (hashed) of the passages of several lines, and how
    many lines such passages have. Only where these two lines stand are runs of those
    lengths made, so a message of many lines gives few. ``m`` has a number ``_row``."""
    said = F.filter(normal_lines(F.col("own_text")), lambda x: x != "")
    own = m.filter("conv_id IS NOT NULL AND turn IS NOT NULL").select("_row", "conv_id", "turn", said.alias("said")).filter(F.size("said") > 1)
    pairs = own.select("_row", F.posexplode(F.zip_with(F.slice("said", 1, F.size("said") - 1), F.slice("said", 2, F.size("said") - 1), lambda a, b: F.xxhash64(a, b))).alias("i", "f"))
    hits = pairs.join(starts, "f").groupBy("_row").agg(F.collect_list(F.struct("i", "ks")).alias("at"))
    found = own.join(hits, "_row").select("conv_id", "turn", "said", F.explode("at").alias("x")).select("conv_id", "turn", "said", F.col("x.i").alias("i"), F.explode("x.ks").alias("k"))
    fits = found.filter(F.col("i") + F.col("k") <= F.size("said"))
    return fits.select(F.col("conv_id").alias("o_conv"), F.col("turn").alias("o_turn"), F.array_join(F.slice("said", F.col("i") + 1, F.col("k")), " ").alias("p"))


def link_quotes(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, own_text, max_level, n_quotes, n_linked, reply_conv,
    reply_to, anchor, position: one row per message."""
    m = graph.written(parse(messages.select("conv_id", "turn", "role", "text")).drop("text")).withColumn("_row", F.monotonically_increasing_id())
    quoting = m.filter(F.size("_quoted") > 0)
    lines = quoting.select("conv_id", "turn", "_row", F.explode("_quoted").alias("x")).select("conv_id", "turn", "_row", "x.*")
    run = F.col("pos") - F.row_number().over(W.partitionBy("_row", "level").orderBy("pos"))
    passages = lines.withColumn("run", run).groupBy("conv_id", "turn", "_row", "level", "run").agg(F.array_sort(F.collect_list(F.struct("pos", normalised(F.col("content")).alias("content")))).alias("a"))
    passages = passages.select("conv_id", "turn", "level", F.filter(F.transform("a", lambda x: x["content"]), lambda x: x != "").alias("a"))
    first = F.when(F.size("a") > 1, F.xxhash64(F.get("a", F.lit(0)), F.get("a", F.lit(1))))
    passages = graph.written(passages.select("conv_id", "turn", "level", _hash(F.array_join("a", " ")).alias("h"), first.alias("f"), F.size("a").alias("k")))
    quotes = passages.filter("h IS NOT NULL").select("conv_id", "turn", "level", "h").distinct()
    starts = passages.filter("f IS NOT NULL").groupBy("f").agg(F.collect_set("k").alias("ks"))
    linked = _linked(m, quotes, starts)
    earlier = m.filter("conv_id IS NOT NULL AND turn IS NOT NULL").select("conv_id", (F.col("turn") + 1).alias("turn"), F.lit(True).alias("_has")).distinct()
    keys = m.select("conv_id", "turn", "role", "own_text", F.coalesce("max_level", F.lit(0)).alias("max_level"))
    out = keys.join(linked, ["conv_id", "turn"], "left").join(earlier, ["conv_id", "turn"], "left")
    foreign = F.col("near").isNull() & F.col("far").isNotNull()
    out = out.select(
        "conv_id", "turn", "role", "own_text", "max_level", F.coalesce("n_quotes", F.lit(0)).cast("bigint").alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).cast("bigint").alias("n_linked"),
        F.when(foreign, F.col("far.o_conv")).when(F.col("near").isNotNull() | F.col("_has"), F.col("conv_id")).alias("reply_conv"),
        F.when(foreign, F.col("far.o_turn")).when(F.col("near").isNotNull(), F.col("near")).when(F.col("_has"), F.col("turn") - 1).cast("bigint").alias("reply_to"),
        F.coalesce("near", "turn").cast("bigint").alias("anchor"),
    )
    return _positions(out)


def _linked(m: DataFrame, quotes: DataFrame, starts: DataFrame) -> DataFrame:
    """conv_id, turn, n_quotes, n_linked, near, far of the messages that quote."""
    spoken = normal_lines(F.col("own_text"))
    said = F.filter(spoken, lambda x: x != "")
    parts = F.array_append(spoken, F.array_join(said, " "))
    whole = m.select(F.col("conv_id").alias("o_conv"), F.col("turn").alias("o_turn"), F.explode(F.array_distinct(parts)).alias("p"))
    said_by = whole.unionByName(_runs(m, starts))
    targets = said_by.filter("p <> '' AND o_conv IS NOT NULL AND o_turn IS NOT NULL").select("o_conv", "o_turn", F.md5("p").alias("h"))
    targets = graph.written(targets.join(quotes.select("h").distinct(), "h", "left_semi").distinct())
    # the second is for those who quote within the first one's conversation
    first = targets.groupBy("h", "o_conv").agg(F.min("o_turn").alias("o_turn"))
    two = first.withColumn("_r", F.row_number().over(W.partitionBy("h").orderBy("o_conv"))).filter("_r <= 2")
    os = two.groupBy("h").agg(F.array_sort(F.collect_list(F.struct("o_conv", "o_turn"))).alias("os"))
    salted = os.select("h", "os", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    q = quotes.withColumn("salt", F.pmod(F.xxhash64("conv_id", "turn"), F.lit(SALTS)).cast("int")).join(salted, ["h", "salt"], "left")
    # the latest turn before each quoting turn that holds the passage: in order of turn,
    # quoting rows before targets of the same turn
    both = q.select("conv_id", "h", "turn", F.lit(None).cast("bigint").alias("held"), "level", "os").unionByName(targets.select(F.col("o_conv").alias("conv_id"), "h", F.col("o_turn").alias("turn"), F.col("o_turn").cast("bigint").alias("held")), allowMissingColumns=True)
    both = both.withColumn("_b", F.floor(F.col("turn") / BLOCK))
    inside = W.partitionBy("conv_id", "h", "_b").orderBy("turn", F.col("held").asc_nulls_first()).rowsBetween(W.unboundedPreceding, W.currentRow)
    # one row a block: what the blocks before hold
    blocks = both.groupBy("conv_id", "h", "_b").agg(F.max("held").alias("_held"))
    blocks = blocks.withColumn("_earlier", F.max("_held").over(W.partitionBy("conv_id", "h").orderBy("_b").rowsBetween(W.unboundedPreceding, -1))).filter("_earlier IS NOT NULL").select("conv_id", "h", "_b", "_earlier")
    both = both.withColumn("_near", F.last("held", ignorenulls=True).over(inside)).join(blocks, ["conv_id", "h", "_b"], "left")
    near = F.coalesce("_near", "_earlier")
    q = both.withColumn("near", near).filter("level IS NOT NULL").select("conv_id", "turn", "near", F.get(F.filter("os", lambda o: F.col("conv_id").isNull() | (o["o_conv"] != F.col("conv_id"))), F.lit(0)).alias("far"))
    q = q.withColumn("far", F.when(F.col("near").isNull(), F.col("far")))
    return q.groupBy("conv_id", "turn").agg(F.count("*").alias("n_quotes"), F.count_if(F.col("near").isNotNull() | F.col("far").isNotNull()).alias("n_linked"), F.max("near").alias("near"), F.min("far").alias("far"))


def _positions(out: DataFrame) -> DataFrame:
    """Adds ``position``: the rank among all messages, less the rank of the first of
    the conversation; a conversation may span any number of ranges."""
    order = [F.col("conv_id").asc_nulls_first(), F.col("anchor").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("_h").asc()]
    n = graph.numbered(out.withColumn("_h", F.md5(F.concat_ws("|", F.coalesce("role", F.lit("~")), "own_text"))), order)
    first = n.groupBy("conv_id").agg(F.min("rank").alias("_first"))
    # a conversation may hold a third of all messages: both sides are salted
    salted = first.select(F.col("conv_id").alias("_c"), "_first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_s"))
    j = n.join(salted, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.pmod("rank", F.lit(SALTS)).cast("int") == F.col("_s")))
    return j.withColumn("position", F.col("rank") - F.col("_first") + 1).drop("_c", "_s", "_first", "rank", "_h")


def conversations(messages: DataFrame, part: int = PART) -> DataFrame:
    """conv_id, part, messages: each conversation in reply order without quotations,
    as arrays of (position, turn, role, text, reply_conv, reply_to); ``part`` messages
    of a long one make a row, numbered from 0. Messages without own text are left out."""
    m = link_quotes(messages).withColumn("part", F.floor((F.col("position") - 1) / part))
    item = F.struct("position", "turn", "role", F.col("own_text").alias("text"), "reply_conv", "reply_to")
    return m.groupBy("conv_id", "part").agg(F.filter(F.array_sort(F.collect_list(item)), lambda x: F.trim(x["text"]) != "").alias("messages"))
