"""Quality of the alerts, thresholds, latency, classifier metrics."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from sentrel.config import CONFIRMED, FALSE_POSITIVE, THRESHOLD_GRID
from sentrel.operators.reports import for_branch, kind, ratio


def model_performance(al: DataFrame, fb: DataFrame, rate: float = 0.01, branch_id: str | None = None) -> DataFrame:
    """Precision from reviewed high-risk alerts, misses scaled up from the random
    sample by its rate; uncertainty samples count in neither."""
    f = for_branch(fb, branch_id).filter(F.col("analyst_label").isNotNull()).select("transaction_id", "analyst_label")
    j = f.join(al.select("transaction_id", "alert_type"), "transaction_id").filter(kind().isin("high_risk", "random_sample"))
    lab = F.col("analyst_label")

    def n(t: str, label: str) -> Column:
        return F.count_if((kind() == t) & (lab == label))

    c = j.agg(n("high_risk", CONFIRMED).alias("tp"), n("high_risk", FALSE_POSITIVE).alias("fp"), n("random_sample", FALSE_POSITIVE).alias("tn"), n("random_sample", CONFIRMED).alias("fn"))
    c = c.withColumn("estimated_fn", F.col("fn") / F.lit(rate) if rate > 0 else F.lit(0.0))
    c = c.withColumns({
        "p": ratio(F.col("tp"), F.col("tp") + F.col("fp")),
        "rr": F.when(F.col("tn") + F.col("fn") > 0, ratio(F.col("tp"), F.col("tp") + F.col("fn"))).otherwise(0.0),
        "er": F.when(F.col("tn") + F.col("fn") > 0, ratio(F.col("tp"), F.col("tp") + F.col("estimated_fn"))).otherwise(0.0),
    })
    f1 = ratio(2 * F.col("p") * F.col("er"), F.col("p") + F.col("er"))
    return c.select("tp", "fp", "tn", "fn", F.round("estimated_fn", 3).alias("estimated_fn"), F.round("p", 3).alias("precision"), F.round("rr", 3).alias("reviewed_recall"), F.round("er", 3).alias("estimated_recall"), F.round(f1, 3).alias("f1"))


def feedback_precision(fb: DataFrame) -> DataFrame:
    """Confirmed over all reviews, those without a label included."""
    c = fb.agg(F.count_if(F.col("analyst_label") == CONFIRMED).alias("confirmed"), F.count_if(F.col("analyst_label") == FALSE_POSITIVE).alias("false_positives"), F.count("*").alias("total"))
    return c.withColumn("precision", F.round(ratio(F.col("confirmed"), F.col("total")), 3))


def threshold_sweep(joined: DataFrame, grid: tuple[float, ...] = THRESHOLD_GRID) -> DataFrame:
    """One pass: each pair is counted at the highest threshold it reaches, then the
    grid's running sums give every threshold. No rows for an empty input."""
    p = F.col("ml_probability")
    step = sum(((p >= t).cast("int") for t in sorted(grid)), F.lit(0))
    hit, miss = F.col("analyst_label") == CONFIRMED, F.col("analyst_label") == FALSE_POSITIVE
    by = joined.filter(p.isNotNull() & (hit | miss)).groupBy(step.alias("s")).agg(F.count_if(hit).alias("c"), F.count_if(miss).alias("f"))
    one = by.agg(F.collect_list(F.struct("s", "c", "f")).alias("a"), F.sum("c").alias("confirmed"), F.count("*").alias("k")).filter("k > 0")
    ts = F.array(*[F.struct(F.lit(float(t)).alias("t"), F.lit(i + 1).alias("i")) for i, t in enumerate(sorted(grid))])
    rows = one.select("a", "confirmed", F.explode(ts).alias("x"))

    def count(field: str) -> Column:
        return F.aggregate("a", F.lit(0).cast("bigint"), lambda acc, r: acc + F.when(r["s"] >= F.col("x.i"), r[field]).otherwise(0))

    rows = rows.select(F.col("x.t").alias("threshold"), count("c").alias("tp"), count("f").alias("fp"), "confirmed")
    rows = rows.withColumns({"p": ratio(F.col("tp"), F.col("tp") + F.col("fp")), "r": ratio(F.col("tp"), F.col("confirmed"))})
    return rows.select("threshold", "tp", "fp", F.round("p", 3).alias("precision"), F.round("r", 3).alias("recall"), F.round(ratio(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r")), 3).alias("f1"))


def optimal_threshold(sweep: DataFrame, default: float = 0.85) -> DataFrame:
    """The threshold of the largest rounded F1, the lowest on ties."""
    best = sweep.agg(F.max_by("threshold", F.struct("f1", -F.col("threshold"))).alias("t"), F.max("f1").alias("f1"))
    return best.select(F.coalesce("t", F.lit(default)).alias("threshold"), F.coalesce("f1", F.lit(0.0)).alias("f1"))


def latency_percentiles(df: DataFrame, value: str, order: list[str], last: int = 1000) -> DataFrame:
    """Over the ``last`` samples; zeros when there are none."""
    v = df.filter(F.col(value).isNotNull()).orderBy(*[F.col(c).desc() for c in order]).limit(last)
    out = v.agg(F.avg(value).alias("m"), F.percentile(value, F.array(F.lit(0.95), F.lit(0.99))).alias("q"), F.count("*").alias("n"))
    zero = F.lit(0.0)
    return out.select(F.coalesce(F.round("m", 2), zero).alias("avg"), F.coalesce(F.round(F.col("q")[0], 2), zero).alias("p95"), F.coalesce(F.round(F.col("q")[1], 2), zero).alias("p99"), "n")


def _rows(hit: Column, n: str | None) -> Column:
    """How many rows there are, each standing for ``n`` (a column) if given."""
    return F.count_if(hit) if n is None else F.coalesce(F.sum(F.when(hit, F.col(n))), F.lit(0).cast("bigint"))


def confusion_metrics(df: DataFrame, n: str | None = None) -> DataFrame:
    """Of 0/1 columns prediction and label, in one aggregate."""
    p, y = F.col("prediction"), F.col("label")
    c = df.agg(_rows((p == 1) & (y == 1), n).alias("tp"), _rows((p == 1) & (y == 0), n).alias("fp"), _rows((p == 0) & (y == 0), n).alias("tn"), _rows((p == 0) & (y == 1), n).alias("fn"))
    pr, re = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return c.withColumns({"p": pr, "r": re}).select("tp", "fp", "tn", "fn", F.round("p", 4).alias("precision"), F.round("r", 4).alias("recall"), F.round(ratio(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r")), 4).alias("f1"))


RANGES = 256


def running(df: DataFrame, value: str, sums: list[str]) -> DataFrame:
    """Exact running sums over the order of the numeric column ``value`` without a
    single-task window: rows are dealt to ranges by fixed bounds (about equal parts,
    found by a job of their own), summed within, and the totals of the ranges before
    are added. Bounds are constants of the plan, so wherever Spark evaluates a branch
    again, a row is in the same range. At most RANGES totals are broadcast."""
    n = max(1, min(RANGES, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    found = df.agg(F.percentile_approx(F.col(value).cast("double"), [i / n for i in range(1, n)] or [0.5], 10_000)).first()[0]
    bounds = F.array(*[F.lit(float(x)) for x in sorted(set(found or []))]).cast("array<double>")
    parts = df.withColumn("_p", F.size(F.filter(bounds, lambda x: x <= F.col(value).cast("double"))))
    totals = parts.groupBy("_p").agg(*[F.sum(c).alias(f"_t_{c}") for c in sums])
    before = W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    heads = totals.select("_p", *[F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_h_{c}") for c in sums])
    inside = W.partitionBy("_p").orderBy(value).rowsBetween(W.unboundedPreceding, 0)
    local = parts.withColumns({f"_l_{c}": F.sum(c).over(inside) for c in sums})
    return local.join(F.broadcast(heads), "_p").withColumns({f"cum_{c}": F.col(f"_l_{c}") + F.col(f"_h_{c}") for c in sums})


def auc_rank(df: DataFrame, score: str = "ml_probability", n: str | None = None) -> DataFrame:
    """Area under ROC as the Mann-Whitney statistic with mid-ranks; NULL when one
    class is missing."""
    by = df.filter(F.col(score).isNotNull()).groupBy(score).agg(_rows(F.col("label") == 1, n).alias("pos"), _rows(F.col("label") == 0, n).alias("neg"))
    c = running(by, score, ["neg"])
    out = c.agg(F.sum(F.col("pos") * (F.col("cum_neg") - F.col("neg") / 2)).alias("u"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return out.select(F.round(F.when((F.col("p") > 0) & (F.col("n") > 0), F.col("u") / (F.col("p") * F.col("n"))), 6).alias("auc"))


def exact_quantiles(df: DataFrame, value: str, group: str, groups: list[str], qs: tuple[float, ...] = (0.5,)) -> DataFrame:
    """(group, q, quantile, n): exact quantiles with linear interpolation, of the given
    groups; groups without a value have no rows. Values are counted, the counts summed up
    over ranges of values, and the ranks looked up in the sums: no task holds a group."""
    v = F.col(value).cast("double")
    names = {g: f"_n{i}" for i, g in enumerate(groups)}
    by = df.filter(v.isNotNull() & F.col(group).isin(*groups)).groupBy(v.alias("_v")).agg(*[F.count_if(F.col(group) == g).alias(n) for g, n in names.items()])
    ranked = running(by, "_v", list(names.values()))
    long = ranked.select("_v", F.explode(F.array(*[F.struct(F.lit(g).alias("g"), F.col(n).alias("n"), F.col(f"cum_{n}").alias("cum")) for g, n in names.items()])).alias("x")).filter("x.n > 0").select("_v", "x.*")
    total = F.broadcast(by.agg(F.array(*[F.struct(F.lit(g).alias("g"), F.sum(n).alias("total")) for g, n in names.items()]).alias("a")).select(F.inline("a")))
    wanted = total.filter("total > 0").select("g", "total", F.explode(F.array(*map(F.lit, map(float, qs)))).alias("q")).withColumn("at", F.col("q") * (F.col("total") - 1))
    # the ranks floor(at) and ceil(at), from 0: values whose rows reach over them
    low, high = F.floor("at"), F.ceil("at")
    over = lambda rank: F.max(F.when((F.col("cum") - F.col("n") <= rank) & (rank < F.col("cum")), F.col("_v")))
    near = long.withColumnRenamed("g", "_g").join(F.broadcast(wanted), (F.col("_g") == F.col("g")) & (F.col("cum") > low) & (F.col("cum") - F.col("n") <= high))
    out = near.groupBy("g", "q", "total", "at").agg(over(low).alias("a"), over(high).alias("b"))
    return out.select(F.col("g").alias(group), "q", (F.col("a") + (F.col("b") - F.col("a")) * (F.col("at") - F.floor("at"))).alias("quantile"), F.col("total").alias("n"))


#: Relative error of percentiles from a sketch.
SKETCH_ERROR = 0.01


def gamma(error: float = SKETCH_ERROR) -> float:
    return (1 + error) / (1 - error)


def log_base(error: float = SKETCH_ERROR) -> float:
    return math.log(gamma(error))


def latency_sketch(df: DataFrame, value: str, error: float = SKETCH_ERROR) -> DataFrame:
    """(bucket, n): how many values lie between two powers of (1 + error) / (1 - error).
    Sketches of parts are one of the whole once their counts are added. Values of 0 and
    below are one bucket (NULL), as a latency of 0; NULLs count for nothing."""
    v = F.col(value).cast("double")
    bucket = F.when(v > 0, F.ceil(F.log(v) / F.lit(log_base(error))).cast("int"))
    return df.filter(v.isNotNull()).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


def sketch_percentiles(sketch: DataFrame, qs: tuple[float, ...] = (0.5, 0.95, 0.99), error: float = SKETCH_ERROR) -> DataFrame:
    """(q, value, n) of one sketch, or of several put together. A value is within
    ``error`` of a value of its rank, the lower one where q falls between two. The
    window sees one row a bucket: a few thousand at most, however many values."""
    g = gamma(error)
    by = sketch.groupBy("bucket").agg(F.sum("n").alias("n"))
    w = W.orderBy(F.col("bucket").asc_nulls_first()).rowsBetween(W.unboundedPreceding, 0)
    cum = by.select("bucket", F.sum("n").over(w).alias("cum"), F.sum("n").over(W.partitionBy(F.lit(0))).alias("total"))
    rows = cum.crossJoin(F.broadcast(df_of(sketch, qs)))
    found = rows.filter(F.col("cum") > F.floor(F.col("q") * (F.col("total") - 1))).groupBy("q", "total").agg(F.min_by("bucket", "cum").alias("bucket"))
    value = F.coalesce(2 * F.pow(F.lit(g), F.col("bucket")) / F.lit(g + 1), F.lit(0.0))
    return found.select("q", value.alias("value"), F.col("total").alias("n"))


def df_of(like: DataFrame, qs: tuple[float, ...]) -> DataFrame:
    return like.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, map(float, qs)))).alias("q"))
