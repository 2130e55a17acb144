"""Correlation, similarity, null models and multiple comparison on long tables."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import text_seed, upper_tail


def pair_union(a: DataFrame, b: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Both tables' values on the union of their keys, 0 where absent: keys, a, b."""
    joined = a.select(*keys, F.col(value).alias("a")).join(b.select(*keys, F.col(value).alias("b")), list(keys), "outer")
    return joined.fillna(0, ["a", "b"])


def safe_corr(a: Column, b: Column) -> Column:
    """Pearson correlation; null with fewer than two rows or a constant side."""
    return F.when((F.count(F.lit(1)) >= 2) & (F.min(a) != F.max(a)) & (F.min(b) != F.max(b)), F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)))


def average_rank(rows: DataFrame, by: Sequence[str], value: str, name: str) -> DataFrame:
    """Rank within groups; ties share their mean rank."""
    first = F.rank().over(Window.partitionBy(*by).orderBy(value))
    ties = F.count("*").over(Window.partitionBy(*by, value))
    return rows.withColumn(name, first + (ties - 1) / F.lit(2.0))


def spearman(rows: DataFrame, by: Sequence[str], a: str, b: str) -> DataFrame:
    ranked = average_rank(average_rank(rows, by, a, "__ra"), by, b, "__rb")
    return ranked.groupBy(*by).agg(safe_corr(F.col("__ra"), F.col("__rb")).alias("spearman"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two aggregated columns, null for a zero vector."""
    norm = F.sqrt(F.sum(a * a) * F.sum(b * b))
    return F.when(norm > 0, F.sum(a * b) / norm)


def jaccard(in_a: Column, in_b: Column) -> Column:
    either = F.sum((in_a | in_b).cast("long"))
    return F.when(either > 0, F.sum((in_a & in_b).cast("long")) / either)


def coverage(in_a: Column, in_b: Column) -> Column:
    """Share of a's members that b has."""
    own = F.sum(in_a.cast("long"))
    return F.when(own > 0, F.sum((in_a & in_b).cast("long")) / own)


def od_null(flows: DataFrame, by: Sequence[str], n: str = "trips") -> DataFrame:
    """Mean and sd of each observed pair when destinations are permuted (hypergeometric), margins held."""
    total, out, into = (F.sum(n).over(Window.partitionBy(*by, *k)).cast("double") for k in ((), ("from_region",), ("to_region",)))
    f = flows.withColumns({"__n": total, "__r": out, "__c": into})
    share = F.col("__c") / F.col("__n")
    mean = F.col("__r") * share
    var = F.when(F.col("__n") > 1, F.col("__r") * share * (1 - share) * (F.col("__n") - F.col("__r")) / (F.col("__n") - 1)).otherwise(0.0)
    return f.withColumns({"null_mean": mean, "null_sd": F.sqrt(F.greatest(var, F.lit(0.0)))}).drop("__n", "__r", "__c")


def channel_null(flows: DataFrame, by: Sequence[str], n: str = "tracks") -> DataFrame:
    """Mean and sd of each observed pair when the total is drawn anew over the observed support with chances in proportion to the margins (multinomial)."""
    total, out, into = (F.sum(n).over(Window.partitionBy(*by, *k)).cast("double") for k in ((), ("from_region",), ("to_region",)))
    f = flows.withColumns({"__n": total, "__s": out * into})
    f = f.withColumn("__p", F.col("__s") / F.sum("__s").over(Window.partitionBy(*by)))
    return f.withColumns({"null_mean": F.col("__n") * F.col("__p"), "null_sd": F.sqrt(F.greatest(F.col("__n") * F.col("__p") * (1 - F.col("__p")), F.lit(0.0)))}).drop("__n", "__s", "__p")


def benjamini_hochberg(rows: DataFrame, by: Sequence[str], p: str, tie: Sequence[str], name: str = "q") -> DataFrame:
    """q values of the non-null p within each group: p * m / rank, then the least of all from that rank on, at most 1."""
    tested = F.col(p).isNotNull()
    w = Window.partitionBy(*by, tested).orderBy(p, *tie)
    m = F.count("*").over(Window.partitionBy(*by, tested))
    scaled = rows.withColumn("__q", F.col(p) * m / F.row_number().over(w))
    least = F.min("__q").over(w.rowsBetween(0, Window.unboundedFollowing))
    return scaled.withColumn(name, F.when(tested, F.least(F.lit(1.0), least))).drop("__q")


def significance(flows: DataFrame, by: Sequence[str], n: str, min_observed: int = 5, fdr: float = 0.05) -> DataFrame:
    """z of every observed pair, the one-sided p, and q among pairs that are neither rare nor self loops."""
    z = F.when(F.col("null_sd") > 0, (F.col(n) - F.col("null_mean")) / F.col("null_sd"))
    f = flows.withColumn("z", z).withColumns({"p": upper_tail(F.col("z")), "gated": F.col(n) < min_observed, "is_self_loop": F.col("from_region") == F.col("to_region")})
    f = f.withColumn("__p", F.when(~F.col("gated") & ~F.col("is_self_loop"), F.col("p")))
    out = benjamini_hochberg(f, by, "__p", ["from_region", "to_region"])
    return out.withColumn("is_significant", F.coalesce(F.col("q") <= fdr, F.lit(False))).drop("__p")


def stable_pairs(rows: DataFrame, scope: str, scopes: int) -> DataFrame:
    """Pairs significant in every scope, with their least and median z."""
    kept = rows.where("is_significant").groupBy("from_region", "to_region").agg(F.count_distinct(scope).alias("scopes"), F.min("z").alias("z_min"), F.percentile("z", F.lit(0.5)).alias("z_median"))
    return kept.where(F.col("scopes") == scopes)


def top_pairs(rows: DataFrame, by: Sequence[str], n: str, k: int) -> DataFrame:
    """The k largest pairs of each group, ties by region."""
    w = Window.partitionBy(*by).orderBy(F.desc(n), "from_region", "to_region")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def extremes(rows: DataFrame, by: Sequence, k: int) -> DataFrame:
    """The first k and the last k rows in an order, marked head and tail."""
    back = [c.desc() if not isinstance(c, str) else F.desc(c) for c in by]
    return rows.orderBy(*by).limit(k).withColumn("end", F.lit("head")).union(rows.orderBy(*back).limit(k).withColumn("end", F.lit("tail")))


def replicate_null(flows: DataFrame, scope: str, n: str, reps: int, seed: str, block: int = 25) -> DataFrame:
    """Monte-Carlo mean, sd and upper tail of the permutation null for each pair.

    A draw permutes the targets of all trips of a scope, which is a row by row
    multivariate hypergeometric draw from the targets left, so memory follows the
    regions and not the trips. Draws go to tasks in blocks of ``block`` for each
    scope; the stream of a block is named by seed, scope and block. The tail counts
    the observed matrix among the draws.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        name, number = str(pdf[scope].iloc[0]), int(pdf["__block"].iloc[0])
        regions = np.unique(np.concatenate([pdf["from_region"], pdf["to_region"]]))
        i, j = np.searchsorted(regions, pdf["from_region"]), np.searchsorted(regions, pdf["to_region"])
        counts = pdf[n].to_numpy(np.int64)
        size = len(regions)
        sent, got = np.bincount(i, counts, minlength=size).astype(np.int64), np.bincount(j, counts, minlength=size).astype(np.int64)
        rng = np.random.default_rng(text_seed(f"{seed}|{name}|{number}"))
        total, square, tail = np.zeros(len(pdf)), np.zeros(len(pdf)), np.zeros(len(pdf), np.int64)
        for _ in range(min(block, reps - number * block)):
            left, drawn = got.copy(), np.zeros((size, size), np.int64)
            for r in np.flatnonzero(sent):
                drawn[r] = _hypergeometric(rng, left, int(sent[r]))
                left -= drawn[r]
            seen = drawn[i, j]
            total += seen
            square += seen.astype(float) ** 2
            tail += seen >= counts
        return pdf[[scope, "from_region", "to_region", n]].assign(total=total, square=square, tail=tail)

    s = flows.select(scope, "from_region", "to_region", F.col(n).cast("long").alias(n))
    blocks = s.withColumn("__block", F.explode(F.sequence(F.lit(0), F.lit(-(-reps // block) - 1))))
    parts = blocks.groupBy(scope, "__block").applyInPandas(run, ", ".join([*(f"{c} {t}" for c, t in s.dtypes), "total double", "square double", "tail long"]))
    mean, sums = F.sum("total") / reps, F.sum("square")
    sd = F.sqrt(F.greatest(F.lit(0.0), (sums - reps * mean * mean) / max(1, reps - 1)))
    return parts.groupBy(scope, "from_region", "to_region", n).agg(mean.alias("mc_mean"), sd.alias("mc_sd"), ((1 + F.sum("tail")) / (reps + 1)).alias("p_empirical"))


def _hypergeometric(rng: np.random.Generator, left: np.ndarray, take: int) -> np.ndarray:
    """How many of ``take`` items drawn without return are of each kind; numpy draws one kind after the other only below 10^9 items, beyond that halves of the kinds share the draw by the same rule."""
    out = np.zeros(len(left), np.int64)
    rest = int(left.sum())
    for k in np.flatnonzero(left):
        if not take:
            break
        others = rest - int(left[k])
        if rest < 1_000_000_000:
            x = int(rng.hypergeometric(int(left[k]), others, take)) if others else take
        else:
            # Beyond numpy's range: the normal limit with the exact mean and variance, within the possible counts.
            p = int(left[k]) / rest
            sd = math.sqrt(max(0.0, take * p * (1 - p) * (rest - take) / max(1, rest - 1)))
            x = min(max(round(rng.normal(take * p, sd)), max(0, take - others)), min(take, int(left[k])))
        out[k] = x
        take -= x
        rest = others
    return out


def floored_sd(mc_sd: Column, closed_sd: Column) -> Column:
    """The Monte-Carlo sd; the closed form's where all draws agreed and the closed form says that they need not."""
    return F.when((mc_sd <= 0) & (closed_sd > 0), closed_sd).otherwise(mc_sd)


def moment_audit(rows: DataFrame, by: Sequence[str], least_sd: float = 1.0) -> DataFrame:
    """How far the draws are from the closed forms, in units of the closed sd, over pairs whose closed sd is at least ``least_sd``: largest deviations of mean and sd, and the number of such pairs. ``rows`` has mc_mean, mc_sd, null_mean, null_sd."""
    live = F.col("null_sd") >= max(least_sd, 5e-324)
    off = lambda a, b: F.max(F.when(live, F.abs(F.col(a) - F.col(b)) / F.col("null_sd")))
    return rows.groupBy(*by).agg(F.coalesce(off("mc_mean", "null_mean"), F.lit(0.0)).alias("mean_off"), F.coalesce(off("mc_sd", "null_sd"), F.lit(0.0)).alias("sd_off"), F.count_if(live).alias("pairs"))


def element_similarity(contingency: DataFrame, a: str, b: str, n: str) -> DataFrame:
    """Flat element-centric similarity of two labelings from their contingency; the restart chance cancels."""
    c = contingency.withColumns({"__a": F.sum(n).over(Window.partitionBy(a)).cast("double"), "__b": F.sum(n).over(Window.partitionBy(b)).cast("double")})
    s = F.col(n).cast("double")
    d = s * F.abs(1 / F.col("__a") - 1 / F.col("__b")) + (F.col("__a") - s) / F.col("__a") + (F.col("__b") - s) / F.col("__b")
    return c.agg((F.sum(s * (1 - d / 2)) / F.sum(s)).alias("similarity"))


_SMALL = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, 256)))])


def log_factorial(k: np.ndarray) -> np.ndarray:
    """log k! of whole numbers of any size: a table up to 255, Stirling's series beyond."""
    k = np.asarray(k, np.float64)
    z = np.maximum(k, 255.0)
    series = z * np.log(z) - z + 0.5 * np.log(2 * np.pi * z) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5)
    return np.where(k < 256, _SMALL[np.minimum(k, 255).astype(np.int64)], series)


def expected_part(x: int, y: int, total: int) -> float:
    """Expected information that two margins of x and y elements give. Counts further than 40 deviations and 60 elements from their mean have no weight in doubles."""
    low, high = max(1, x + y - total), min(x, y)
    mean = x * y / total
    sd = math.sqrt(mean * (1 - x / total) * (1 - y / total) * total / max(1, total - 1))
    low, high = max(low, math.floor(mean - 40 * sd - 60)), min(high, math.ceil(mean + 40 * sd + 60))
    fixed = float(log_factorial(x) + log_factorial(y) + log_factorial(total - x) + log_factorial(total - y) - log_factorial(total))
    out = 0.0
    for a in range(low, high + 1, 1 << 18):
        k = np.arange(a, min(high + 1, a + (1 << 18)), dtype=np.float64)
        p = fixed - log_factorial(k) - log_factorial(x - k) - log_factorial(y - k) - log_factorial(total - x - y + k)
        out += float((k / total * np.log(total * k / (float(x) * y)) * np.exp(p)).sum())
    return out


def adjusted_mutual_information(counts: DataFrame, a: str, b: str, n: str) -> DataFrame:
    """AMI (arithmetic mean of entropies) of two labelings from their contingency, in one row: ami, null under two elements, 1 if both have one label or none repeats.

    Margins of equal size share the work, and pairs of sizes go to tasks of their
    own: sizes of one side are rows, those of the other are sent to all (as many
    as the map has labels; checked).
    """
    spark = counts.sparkSession
    c = counts.groupBy(a, b).agg(F.sum(n).cast("long").alias("n")).where("n > 0")
    total = c.agg(F.sum("n").alias("n")).first()["n"] or 0
    if total < 2:
        return spark.createDataFrame([(None,)], "ami double")
    rows, columns = (c.groupBy(F.col(k).alias("k")).agg(F.sum("n").alias("m")) for k in (a, b))
    sizes = columns.groupBy("m").agg(F.count("*").alias("times")).orderBy("m").limit(1_000_001).collect()
    if len(sizes) > 1_000_000:
        raise ValueError("more than 1,000,000 different sizes of labels")
    other = spark.sparkContext.broadcast([(r["m"], r["times"]) for r in sizes])
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def expect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"e": [times * sum(t * expected_part(x, y, total) for y, t in other.value) for x, times in zip(pdf["m"].tolist(), pdf["times"].tolist(), strict=True)]})

    expected = rows.groupBy("m").agg(F.count("*").alias("times")).repartition(tasks).mapInPandas(expect, "e double").agg(F.sum("e").alias("expected"))
    share = F.col("m") / F.lit(float(total))
    entropy = lambda df, name: df.agg((-F.sum(share * F.log(share))).alias(f"h_{name}"), F.count("*").alias(f"k_{name}"))
    met = c.join(rows.select(F.col("k").alias(a), F.col("m").alias("ma")), a).join(columns.select(F.col("k").alias(b), F.col("m").alias("mb")), b)
    mi = met.agg(F.sum(F.col("n") / F.lit(float(total)) * F.log(F.col("n") * F.lit(float(total)) / (F.col("ma").cast("double") * F.col("mb")))).alias("mi"))
    one = expected.crossJoin(F.broadcast(entropy(rows, "a"))).crossJoin(F.broadcast(entropy(columns, "b"))).crossJoin(F.broadcast(mi))
    low = (F.col("h_a") + F.col("h_b")) / 2 - F.col("expected")
    low = F.when(low < 0, F.least(low, F.lit(-1e-15))).otherwise(F.greatest(low, F.lit(1e-15)))
    same = ((F.col("k_a") == 1) & (F.col("k_b") == 1)) | ((F.col("k_a") == total) & (F.col("k_b") == total))
    return one.select(F.when(same, 1.0).otherwise((F.col("mi") - F.col("expected")) / low).alias("ami"))
