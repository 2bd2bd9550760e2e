"""Sets, duplicates, samples, splits and folds. Draws are ranks of a salted hash, so they agree on every engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import hash_rank_key


def keep_first(df: DataFrame, key: list[Column], order: list[Column]) -> DataFrame:
    """The first row of each key, which may be an expression such as a truncated text."""
    names = df.columns
    for i, k in enumerate(key):
        df = df.withColumn(f"__k{i}", k)
    w = Window.partitionBy(*[f"__k{i}" for i in range(len(key))]).orderBy(*order)
    return df.withColumn("__r", F.row_number().over(w)).where("__r = 1").select(*names)


def merge_sources(df: DataFrame, content: Column, ident: str, source: str) -> DataFrame:
    """One row for each content digest: the smallest id and all sources in order."""
    return df.groupBy(F.sha2(content, 256).alias("digest")).agg(F.min(ident).alias("first_id"), F.count(F.lit(1)).alias("n"), F.array_join(F.sort_array(F.collect_set(source)), ",").alias("sources"))


def quarantine(df: DataFrame, key: list[str], value: str) -> DataFrame:
    """Rows whose key has one value only."""
    bad = df.groupBy(*key).agg(F.countDistinct(value).alias("__n")).where("__n > 1").select(*key)
    return df.join(bad, key, "left_anti")


def largest_remainder(counts: DataFrame, group: str, n: str, total: int, floor: int = 0) -> DataFrame:
    """(group, quota): a total in proportion to counts, at least `floor` each, the rest to the largest remainders (then
    the larger group, then its name). One row for each group; groups are few next to rows."""
    t = counts.agg(F.sum(n).alias("__t"), F.count(F.lit(1)).alias("__g"))
    d = counts.crossJoin(F.broadcast(t)).withColumn("__left", F.lit(total) - F.lit(floor) * F.col("__g"))
    d = d.withColumn("__q", F.expr(f"cast(__left * {n} as bigint) div __t")).withColumn("__rem", F.expr(f"cast(__left * {n} as bigint) % __t"))
    s = d.agg(F.sum("__q").alias("__sum"))
    w = Window.orderBy(F.desc("__rem"), F.desc(n), group)
    d = d.crossJoin(F.broadcast(s)).withColumn("__rk", F.row_number().over(w))
    return d.select(group, n, (F.col("__q") + F.lit(floor) + (F.col("__rk") <= F.col("__left") - F.col("__sum")).cast("long")).alias("quota"))


def stratified(df: DataFrame, group: str, ident: str, total: int, salt: str, floor: int = 0) -> DataFrame:
    """A sample of `total` rows in proportion to strata, drawn by salted hash."""
    quota = largest_remainder(df.groupBy(group).agg(F.count(F.lit(1)).alias("n")), group, "n", total, floor)
    w = Window.partitionBy(group).orderBy(hash_rank_key(salt, ident), ident)
    ranked = df.withColumn("__r", F.row_number().over(w))
    return ranked.join(F.broadcast(quota.select(group, "quota")), group).where("__r <= quota").drop("__r", "quota")


def support_split(df: DataFrame, group: str, ident: str, salt: str, share: float = 0.05, low: int = 50, high: int = 250, calibration: float = 0.2) -> DataFrame:
    """(ident, partition): support of clamp(share, low, high) rows by strata, of which a share is for calibration; the
    rest is demand."""
    n = df.count()
    size = min(max(int(n * share), low), high, n)
    support = stratified(df.select(group, ident), group, ident, size, salt)
    cal = stratified(support, group, ident, int(size * calibration), salt + ":calibration").select(ident).withColumn("__c", F.lit(1))
    marked = support.select(ident).join(cal, ident, "left").select(ident, F.when(F.col("__c") == 1, "calibration").otherwise("support").alias("__p"))
    return df.select(group, ident).join(marked, ident, "left").select(ident, group, F.coalesce("__p", F.lit("demand")).alias("partition"))


def group_folds(df: DataFrame, group: str, folds: int, salt: str) -> DataFrame:
    """Rows with a fold; a group is never in two. Groups are dealt round in hash order, their places taken in ranges."""
    from millrace.operators.windows import prefix_sums

    g = df.select(group).distinct()
    dealt = prefix_sums(g, [hash_rank_key(salt, group), F.col(group)], {}, "__at").select(group, ((F.col("__at") - 1) % folds).cast("int").alias("fold"))
    return df.join(dealt, group)


def hash_folds(df: DataFrame, ident: str, folds: int, salt: str) -> DataFrame:
    """A fold from the id alone: no shuffle and no table of groups."""
    return df.withColumn("fold", (F.conv(F.substring(hash_rank_key(salt, ident), 1, 8), 16, 10).cast("long") % folds).cast("int"))


def permute_within(df: DataFrame, strata: list[str], ident: str, value: str, salt: str, out: str) -> DataFrame:
    """Values dealt anew among the rows of a stratum: a control that keeps each stratum's distribution."""
    by_id = df.withColumn("__r", F.row_number().over(Window.partitionBy(*strata).orderBy(ident)))
    moved = df.select(*strata, F.col(value).alias(out), F.row_number().over(Window.partitionBy(*strata).orderBy(hash_rank_key(salt, ident), ident)).alias("__r"))
    return by_id.join(moved, [*strata, "__r"]).drop("__r")


def draw_with_replacement(df: DataFrame, weight: str, ident: str, draws: int, salt: str) -> DataFrame:
    """(draw, ident): inverse-CDF draws at hashed points, weights running in order of id. Points and the starts of the
    rows' stretches are put in one order, in ranges, and every point takes the last start before it. Rows without a
    positive weight are never drawn; without any there are no draws. Ids must be unique."""
    from millrace.operators.windows import carry_forward, prefix_sums

    cdf = prefix_sums(df.where(F.col(weight) > 0).select(ident, weight), [F.col(ident)], {"hi": F.col(weight)})
    total = cdf.agg(F.max("hi").alias("t")).where("t is not null")
    point = F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(salt), F.col("draw").cast("string")), 256), 1, 8), 16, 10).cast("double") / 4294967296.0
    points = df.sparkSession.range(draws).withColumnRenamed("id", "draw").crossJoin(F.broadcast(total)).select((point * F.col("t")).alias("x"), "draw", F.lit(None).cast(df.schema[ident].dataType).alias(ident))
    starts = cdf.select((F.col("hi") - F.col(weight)).cast("double").alias("x"), F.lit(None).cast("long").alias("draw"), ident)
    order = [F.col("x"), F.col("draw").asc_nulls_first(), F.col(ident)]
    return carry_forward(starts.unionByName(points), order, ident, "__got").where("draw is not null").select("draw", F.col("__got").alias(ident))


def bootstrap_means(df: DataFrame, cluster: str, value: str, rounds: int, salt: str) -> DataFrame:
    """(round, mean): clusters are drawn with replacement by Poisson(1) weights from a hash, so that every round is one
    pass over cluster sums and no cluster is looked up by place."""
    per = df.groupBy(cluster).agg(F.sum(value).alias("s"), F.count(value).alias("n"))
    u = F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(salt), F.col("round").cast("string"), F.col(cluster).cast("string")), 256), 1, 8), 16, 10).cast("double") / 4294967296.0
    steps, p, acc = F.lit(0), 0.36787944117144233, 0.0
    for k in range(8):
        acc += p
        steps = steps + (u >= acc).cast("int")
        p /= k + 1
    r = per.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1)))).withColumn("w", steps)
    return r.groupBy("round").agg(F.try_divide(F.sum(F.col("w") * F.col("s")), F.sum(F.col("w") * F.col("n"))).alias("mean"))


def deficit_round_robin(df: DataFrame, stratum: str, category: str, parent: str, ident: str, weights: dict[str, float], count: int, salt: str) -> DataFrame:
    """`count` rows, one of a parent at most, dealt to strata in proportion to weights and evenly to their categories.

    Of each parent the row with the least hash is eligible, in each category in hash order. The k-th row of a category
    comes at the k-th turn of that category, the k-th turn of a stratum at (k - 1) / weight: a stratum's next row goes to
    the category with the fewest rows so far that has one left (by name where equal), the next turn to the stratum with
    the least turns for its weight (where equal, to that category with the fewest rows, then by name). Strata without a
    weight count 1. Only as many rows as could be taken, `count` of each category, are ranked beyond their category.
    """
    h = hash_rank_key(salt, ident)
    one = df.groupBy(parent).agg(F.min(F.struct(h.alias("h"), F.col(ident).alias("i"), F.col(stratum).alias("s"), F.col(category).alias("c"))).alias("r")).select("r.*")
    ranked = one.withColumn("k", F.row_number().over(Window.partitionBy("s", "c").orderBy("h", "i"))).where(F.col("k") <= count)
    # a stratum takes first rows of its categories, then second ones
    turn = F.row_number().over(Window.partitionBy("s").orderBy("k", "c"))
    w = F.lit(1.0)
    for name, value in weights.items():
        w = F.when(F.col("s") == name, float(value)).otherwise(w)
    dealt = ranked.withColumn("turn", turn).where(F.col("turn") <= count).withColumn("due", (F.col("turn") - 1) / w)
    return dealt.orderBy("due", "k", "c", "turn").limit(count).select(F.col("i").alias(ident), F.col("s").alias(stratum), F.col("c").alias(category))


def permutation_test(df: DataFrame, unit: str, label: str, value: str, rounds: int, salt: str) -> DataFrame:
    """(observed, at_least, rounds, p_value) for the difference of mean values between units labelled 1 and 0 when labels are
    dealt anew: in each round the units with the smallest hashes get label 1, as many as have it.

    Hashes of a round fall into 65,536 bins; bins below the threshold are sums, and only the bin it lies in is ranked.
    Units are rows; nulls are left out. The p-value counts the data as one round: (1 + at_least) / (1 + rounds).
    """
    d = df.where(F.col(unit).isNotNull() & F.col(label).isNotNull() & F.col(value).isNotNull()).select(F.col(unit).alias("u"), F.col(label).cast("int").alias("y"), F.col(value).cast("double").alias("v"))
    t = d.agg(F.sum("y").alias("n1"), F.count(F.lit(1)).alias("all"), F.avg(F.when(F.col("y") == 1, F.col("v"))).alias("m1"), F.avg(F.when(F.col("y") == 0, F.col("v"))).alias("m0"), F.sum("v").alias("s")).where("all > 0")
    r = d.select("u", "v", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))).alias("round"))
    r = r.withColumn("h", F.sha2(F.concat_ws("|", F.lit(salt), F.col("round").cast("string"), F.col("u").cast("string")), 256)).withColumn("bin", F.substring("h", 1, 4))
    bins = r.groupBy("round", "bin").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("sv")).crossJoin(F.broadcast(t))
    w = Window.partitionBy("round").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    bins = bins.withColumn("upto", F.sum("n").over(w))
    below = bins.groupBy("round").agg(F.sum(F.when(F.col("upto") <= F.col("n1"), F.col("sv")).otherwise(0.0)).alias("s1"), F.first("s").alias("s"), F.first("n1").alias("n1"), F.first("all").alias("all"), F.first(F.col("m1") - F.col("m0")).alias("o"))
    edge = bins.where((F.col("upto") > F.col("n1")) & (F.col("upto") - F.col("n") < F.col("n1"))).select("round", "bin", (F.col("n1") - F.col("upto") + F.col("n")).alias("take"))
    inside = r.join(F.broadcast(edge), ["round", "bin"]).withColumn("k", F.row_number().over(Window.partitionBy("round").orderBy("h", "u"))).where("k <= take")
    per = below.join(inside.groupBy("round").agg(F.sum("v").alias("e")), "round", "left").withColumn("s1", F.col("s1") + F.coalesce("e", F.lit(0.0)))
    diff = F.col("s1") / F.col("n1") - F.try_divide(F.col("s") - F.col("s1"), F.col("all") - F.col("n1"))
    out = per.agg(F.max("o").alias("observed"), F.sum((F.abs(diff) >= F.abs(F.col("o")) - 1e-12).cast("long")).alias("at_least"), F.count(F.lit(1)).alias("rounds"))
    return out.where("rounds > 0").withColumn("p_value", (F.col("at_least") + 1) / (F.col("rounds") + 1))
