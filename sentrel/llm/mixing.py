"""Operator 4: mixing sources to target weights.

Targets are filled up by weight to a cap per source. Blocks of equal tokens are then
given to sources, and within a source to its shards, by the highest quotients
target / (2 k + 1) (Sainte-Lague), which gives whole quotas. Within a shard documents
lie in a seeded order on a line of words, and the quota is cut from the line at a
seeded place, going round it as often as needed.

Shards hold about ``shard_docs`` documents, so no window over documents grows with a
source; the list of sources is ranked in ranges, so it may be long. The windows left
see the shards of one source, one row for 4000 documents.

NULL and empty texts have size 0 and take nothing; a NULL source is a source of its
own. Rows with equal id, text and source lie side by side on the line and share what
it gives them evenly, a rest smaller than their number is left; other rows with equal
ids, or none, are documents of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from sentrel.llm import graph

WORD = r"[^\x20\x09-\x0D]+"
#: Fixed values of the contract.
WEIGHTS = (5, 2, 1)
SALTS = 32


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def row_hash(id_: Column, text: Column, seed: int) -> Column:
    """32 hexadecimal digits; equal only for rows with equal id and text."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(id_.cast("string"), F.lit("~")), F.coalesce(text, F.lit(""))))


def _number(h: Column, start: int) -> Column:
    """The number that eight hexadecimal digits give."""
    return F.conv(F.substring(h, start, 8), 16, 10).cast("bigint")


def targets(sizes: DataFrame, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """source, source_size, n_docs, target: one row per source of ``sizes``. Sources
    are taken in order of cap by weight; those before the first that stays below its
    cap are filled up, and that one sets the level of all others."""
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    s = graph.numbered(s, [F.col("source").asc_nulls_last()])
    s = s.withColumns({"_w": F.element_at(F.array(*[F.lit(float(x)) for x in WEIGHTS]), ((F.col("rank") - 1) % len(WEIGHTS) + 1).cast("int")), "_cap": F.col("source_size") * F.lit(cap)}).drop("rank")
    s = graph.numbered(s, [(F.col("_cap") / F.col("_w")).asc(), F.col("source").asc_nulls_last()], ("_cap", "_w"))
    total = s.agg(F.sum("source_size").alias("size"), F.sum("_w").alias("w")).first()
    level = (F.lit(share * float(total["size"] or 0)) - (F.col("cum__cap") - F.col("_cap"))) / (F.lit(float(total["w"] or 0)) - F.col("cum__w") + F.col("_w"))
    found = s.select("rank", "_cap", "_w", level.alias("_l")).filter("_cap > _l * _w").agg(F.min_by("_l", "rank")).first()[0]
    target = F.col("_cap") if found is None else F.least(F.col("_cap"), F.lit(found) * F.col("_w"))
    return s.select("source", "source_size", "n_docs", target.alias("target"))


def contested(seats: Column, weight: Column, total: Column, cells: Column) -> tuple[Column, Column]:
    """(seats a cell has for certain, seats it may get at most). At the threshold
    total / (2 seats - cells) no more than ``seats`` quotients are as high, at total /
    (2 seats + cells) no fewer; one seat either way covers rounding. Between the two
    lie at most 3 quotients for each cell on average."""
    def above(t: Column) -> Column:  # quotients of this cell of at least t
        return F.floor((weight / t + 1) / 2).cast("bigint")

    high, low = total / (2 * seats - cells), total / (2 * seats + cells)
    sure = F.when((2 * seats > cells) & (total > 0), F.greatest(above(high) - 1, F.lit(0))).otherwise(F.lit(0))
    return sure.cast("bigint"), F.when((seats > 0) & (total > 0) & (weight > 0), above(low) + 1).otherwise(F.lit(0)).cast("bigint")


def _bids(cells: DataFrame, seats: Column, weight: str, total: Column, count: Column, keep: list[str]) -> DataFrame:
    sure, most = contested(seats, F.col(weight).cast("double"), total.cast("double"), count)
    c = cells.withColumns({"_sure": sure, "_most": most})
    k = F.explode(F.when(F.col("_most") > F.col("_sure"), F.sequence(F.col("_sure"), F.col("_most") - 1)))
    return c, c.select(*keep, k.alias("_k"), F.col(weight).alias("_weight")).withColumn("_q", F.col("_weight") / (2 * F.col("_k") + 1))


def _with_quota(cells: DataFrame, won: DataFrame, keys: list[str]) -> DataFrame:
    n = won.groupBy(*keys).agg(F.count("*").alias("_won"))
    on = [F.col(f"c.{x}").eqNullSafe(F.col(f"w.{x}")) for x in keys]
    return cells.alias("c").join(n.alias("w"), on, "left").select("c.*", (F.col("c._sure") + F.coalesce("w._won", F.lit(0))).alias("quota")).drop("_sure", "_most")


def apportion(cells: DataFrame, seats: int, weight: str, key: str) -> DataFrame:
    """Adds ``quota``: the ``seats`` highest quotients weight / (2 k + 1) of all rows,
    ties to the least ``key`` (unique). Only quotients between two bounds are ranked."""
    a = cells.agg(F.sum(weight).alias("t"), F.count("*").alias("n")).first()
    c, bids = _bids(cells, F.lit(seats), weight, F.lit(float(a["t"] or 0)), F.lit(a["n"]), [key])
    left = seats - (c.agg(F.sum("_sure")).first()[0] or 0)
    won = graph.numbered(bids, [F.col("_q").desc(), F.col(key).asc_nulls_last(), F.col("_k").asc()]).filter(F.col("rank") <= left)
    return _with_quota(c, won, [key])


def apportion_within(cells: DataFrame, seats: str, weight: str, group: str, key: str) -> DataFrame:
    """As ``apportion`` for each ``group``, whose rows all have its number of ``seats``."""
    w = W.partitionBy(group)
    cells = cells.withColumns({"_t": F.sum(weight).over(w), "_n": F.count("*").over(w)})
    c, bids = _bids(cells, F.col(seats), weight, F.col("_t"), F.col("_n"), [group, key, seats])
    c = c.withColumn("_left", F.col(seats) - F.sum("_sure").over(w))
    left = c.groupBy(group).agg(F.first("_left").alias("_left"))
    bids = bids.alias("b").join(left.alias("l"), F.col(f"b.{group}").eqNullSafe(F.col(f"l.{group}"))).select("b.*", "_left")
    won = bids.withColumn("_r", F.row_number().over(w.orderBy(F.col("_q").desc(), F.col(key), F.col("_k")))).filter("_r <= _left")
    return _with_quota(c, won, [group, key]).drop("_t", "_n", "_left")


def mix(docs: DataFrame, block: int = 256, shard_docs: int = 4000, seed: int = 13, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """doc_id, size, source, source_size, target, taken, row_hash: one row per input
    row; (source, row_hash) names a document."""
    i, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    rows = graph.written(docs.select(i.alias("_id"), F.col(f"`{source_col}`").cast("string").alias("source"), word_count(text).alias("size"), row_hash(i, text, seed).alias("_h")))
    t = graph.written(targets(rows, share, cap))
    seats = int((t.agg(F.sum("target")).first()[0] or 0) // block)
    per_source = apportion(t, seats, "target", "source").withColumnRenamed("quota", "_seats").withColumn("_shards", F.ceil(F.col("n_docs") / shard_docs).cast("bigint"))
    per_source = graph.written(per_source)
    # a source may hold a third of all rows: both sides of this join are salted
    salted = per_source.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    d = rows.groupBy("source", "_h").agg(F.first("size").alias("size"), F.count("*").alias("_same"))
    d = d.withColumn("_salt", F.pmod(_number(F.col("_h"), 9), F.lit(SALTS)).cast("int")).alias("d").join(salted.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source")) & (F.col("d._salt") == F.col("p._salt"))).select("d.source", "d._h", "d._same", (F.col("d.size") * F.col("d._same")).alias("_long"), "p.source_size", "p.target", "p._seats", "p._shards")
    d = d.withColumn("_shard", F.pmod(_number(F.col("_h"), 1), F.col("_shards")))
    cells = d.groupBy("source", "_shard").agg(F.sum("_long").alias("_line"), F.first("_seats").alias("_seats"))
    cells = apportion_within(cells, "_seats", "_line", "source", "_shard")
    words = F.least(F.col("quota") * block, (F.col("_line") * F.lit(cap)).cast("bigint"))
    full = F.when(F.col("_line") > 0, F.floor(words / F.col("_line"))).otherwise(F.lit(0)).cast("bigint")
    # a seeded block of the line is the first of those that the last round takes
    place = _number(F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce("source", F.lit("~")), F.col("_shard").cast("string"))), 1)
    begin = F.when(F.col("_line") > 0, F.pmod(place, F.ceil(F.col("_line") / block)) * block).otherwise(F.lit(0))
    cells = cells.select("source", "_shard", "_line", full.alias("_full"), (words - full * F.col("_line")).alias("_part"), begin.cast("bigint").alias("_o"))
    j = d.alias("d").join(cells.alias("c"), F.col("d.source").eqNullSafe(F.col("c.source")) & (F.col("d._shard") == F.col("c._shard"))).select("d.*", "c._line", "c._full", "c._part", "c._o")
    before = F.sum("_long").over(W.partitionBy("source", "_shard").orderBy("_h").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("_long")
    j = j.withColumn("_a", before)

    def overlap(lo: Column, hi: Column) -> Column:
        return F.greatest(F.lit(0), F.least(F.col("_a") + F.col("_long"), hi) - F.greatest(F.col("_a"), lo))

    end = F.col("_o") + F.col("_part")
    taken = F.col("_full") * F.col("_long") + overlap(F.col("_o"), F.least(end, F.col("_line"))) + overlap(F.lit(0), end - F.col("_line"))
    j = j.select("source", "_h", "source_size", "target", F.floor(taken / F.col("_same")).cast("bigint").alias("taken"))
    out = rows.alias("r").join(j.alias("j"), (F.col("r._h") == F.col("j._h")) & F.col("r.source").eqNullSafe(F.col("j.source")))
    return out.select(F.col("r._id").alias(id_col), "r.size", "r.source", "j.source_size", F.col("j.target").cast("double").alias("target"), "j.taken", F.col("r._h").alias("row_hash"))
