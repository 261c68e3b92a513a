"""Written intermediate results and connected components."""

from __future__ import annotations

import gc

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Spark takes spark.checkpoint.dir itself. Where it is unset, a folder of this
    machine serves if everything runs on this machine; a cluster must name a shared one."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))


def shared_folder(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    import tempfile

    return tempfile.mkdtemp(prefix="sentrel-")


def free(spark: SparkSession) -> None:
    """As before ``written``: shuffle files of plans that nothing holds go from the disks.
    Python's references to plans go first, as some stand in cycles."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def written(df: DataFrame) -> DataFrame:
    """``df`` computed once, its lineage cut, in the shared folder. Spark removes the
    shuffle files of earlier steps when the driver's collector finds their plans
    unused, so it is called here rather than whenever the driver's memory is full."""
    ensure_checkpoint_dir(df.sparkSession)
    df.sparkSession.sparkContext._jvm.System.gc()
    return df.checkpoint(eager=True)


def numbered(df: DataFrame, order: list[Column], sums: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``rank`` (from 1, in ``order``) and, for each of ``sums``, the running sum
    ``cum_<name>``, without bringing all rows to one task: written ranges, numbered
    within, plus what the ranges before hold (one row a range)."""
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    parts = written(df.repartitionByRange(n, *order).withColumn("_p", F.spark_partition_id()))
    adds = {"rank": F.count("*"), **{f"cum_{c}": F.sum(c) for c in sums}}
    before = parts.groupBy("_p").agg(*[x.alias(f"_b_{c}") for c, x in adds.items()])
    earlier = W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    before = before.select("_p", *[F.coalesce(F.sum(f"_b_{c}").over(earlier), F.lit(0)).alias(f"_b_{c}") for c in adds])
    inside = W.partitionBy("_p").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    out = parts.withColumns({f"_i_{c}": x.over(inside) for c, x in adds.items()}).join(F.broadcast(before), "_p")
    return out.withColumns({c: F.col(f"_i_{c}") + F.col(f"_b_{c}") for c in adds}).drop("_p", *[f"_{k}_{c}" for c in adds for k in "ib"])


def free_names(wanted: list[str], used: list[str]) -> dict[str, str]:
    """For each of ``used`` that is also ``wanted`` by a result: a name that is free."""
    low, out = {c.lower() for c in used} | {c.lower() for c in wanted}, {}
    for c in used:
        if c.lower() in {w.lower() for w in wanted}:
            x = f"{c}_in"
            while x.lower() in low:
                x += "_in"
            low.add(x.lower())
            out[c] = x
    return out


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, component) of the nodes in ``edges`` (src, dst long); component: the
    least node reachable. Star contraction: a few rounds even for long paths."""
    e = written(edges.filter("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct())
    for _ in range(rounds):
        # every node's larger neighbours move to its least neighbour
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # every node and its smaller neighbours move to the least of them
        large = large.unionByName(e.join(least, "u").select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        new = written(small.filter("u <> v").distinct())
        # settled when no node has two parents and no parent has a parent
        state = new.select("u", F.lit(1).alias("c"), F.lit(0).alias("p")).unionByName(new.select(F.col("v").alias("u"), F.lit(0).alias("c"), F.lit(1).alias("p")))
        open_nodes = state.groupBy("u").agg(F.sum("c").alias("c"), F.max("p").alias("p")).filter("c > 1 OR (c > 0 AND p > 0)").limit(1).count()
        e = new
        if not open_nodes:
            break
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
