"""Rows built from demonstrations, question inventories, paired machines and branch outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def reestimate(df: DataFrame, delta: str, which: str) -> DataFrame:
    """Events whose utility difference is to be estimated again: 'all', 'zero' or 'nonpos'. A null difference is in 'all'."""
    rules = {"all": F.lit(True), "zero": F.col(delta) == 0, "nonpos": F.col(delta) <= 0}
    if which not in rules:
        raise ValueError(f"unknown selection: {which}")
    return df.where(rules[which])


def demo_rows(demos: DataFrame, categories: DataFrame, teacher: str = "teacher") -> DataFrame:
    """One row for each turn of each task's demonstration (task_id, turns: array<struct<prompt, target>>): task_id, category,
    teacher, turn_index, prompt, response, token_hint. Rows have the order (task_id, turn_index) to sort by; a task without
    a category fails; null and empty demonstrations have no rows."""
    turns = demos.select("task_id", F.posexplode("turns").alias("turn_index", "__t"))
    named = turns.join(categories.select("task_id", "category").distinct(), "task_id", "left")
    known = F.when(F.col("category").isNull(), F.raise_error(F.concat(F.lit("no category: "), F.col("task_id")))).otherwise(F.col("category"))
    hint = F.greatest(F.expr("length(__t.target) div 4"), F.lit(1)).cast("long")
    return named.select("task_id", known.alias("category"), F.lit(teacher).alias("teacher"), F.col("turn_index").cast("long").alias("turn_index"), F.col("__t.prompt").alias("prompt"), F.col("__t.target").alias("response"), hint.alias("token_hint"))


def question_inventory(df: DataFrame, question: dict[str, str | None], audit: list[str], kind: str | None = None, prefix: str = "item", ordinal: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(questions, annotations): what a scorer may see, and what is for audits only, of one scan.

    `question` says which column is _id, question, answer and type; without one for _id, ids are made of `prefix` and the
    `ordinal` column; without one for type, `kind` is it. A null or empty id or question fails the inventory, and so does
    an id that occurs twice: nothing is filtered or replaced.
    """
    ident = F.col(question["_id"]).cast("string") if question.get("_id") else F.concat(F.lit(prefix + "-"), F.lpad(F.col(ordinal).cast("string"), 6, "0"))
    bad = ident.isNull() | (ident == "") | F.col(question["question"]).isNull() | (F.col(question["question"]) == "")
    checked = F.when(bad, F.raise_error(F.lit("empty id or question"))).otherwise(ident)
    rows = df.withColumn("__id", checked)
    twice = rows.groupBy("__id").agg(F.count(F.lit(1)).alias("__n"))
    once = F.when(F.col("__n") > 1, F.raise_error(F.concat(F.lit("duplicate id: "), F.col("__id")))).otherwise(F.col("__id"))
    rows = rows.join(twice, "__id").withColumn("__id", once).drop("__n")
    type_ = F.col(question["type"]) if question.get("type") else F.lit(kind)
    public = rows.select(F.col("__id").alias("_id"), F.col(question["question"]).alias("question"), F.col(question["answer"]).alias("answer"), type_.alias("type"))
    return public, rows.select(F.col("__id").alias("_id"), *audit)


def machine_effects(left: DataFrame, right: DataFrame, keys: list[str], bought: str, score: str, complete: str) -> DataFrame:
    """`keys`, identical, packages, left_score, right_score, effect: two machines' runs of one arm and round. The effect
    (right - left) is there only where both bought the same packages in the same order and both are complete; where either
    purchase list is null, `identical` is null."""
    a = left.select(*keys, F.col(bought).alias("__a"), F.col(score).alias("left_score"), F.col(complete).alias("__ca"))
    b = right.select(*keys, F.col(bought).alias("__b"), F.col(score).alias("right_score"), F.col(complete).alias("__cb"))
    same = F.col("__a") == F.col("__b")
    effect = F.when(F.coalesce(same, F.lit(False)) & F.col("__ca") & F.col("__cb"), F.round(F.col("right_score") - F.col("left_score"), 6))
    packages = F.when(same.isNotNull(), F.size("__a"))
    return a.join(b, keys).select(*keys, same.alias("identical"), packages.alias("packages"), "left_score", "right_score", effect.alias("effect"))


def beta_superiority(a: Column, b: Column, c: Column, d: Column) -> Column:
    """P(X > Y) for X ~ Beta(a, b) and Y ~ Beta(c, d) with whole a, b, c, d >= 1: a finite sum instead of draws.

    With t(0) = prod over j < b of (d + j) / (c + d + j) and t(i + 1) / t(i) = (c + i)(b + i) / ((b + c + d + i)(1 + i)), the
    sum of t(i) over i < a is P(Y < X). Terms are kept as logarithms. Null arguments give null.
    """
    num = lambda x: x.cast("double")
    start = F.aggregate(F.sequence(F.lit(0), (b - 1).cast("int")), F.lit(0.0), lambda s, j: s + F.log((num(d) + j) / (num(c) + num(d) + j)))
    first = F.struct(start.alias("log"), F.lit(0.0).alias("total"))
    step = lambda s, i: F.struct((s["log"] + F.log((num(c) + i) * (num(b) + i) / ((num(b) + num(c) + num(d) + i) * (1 + i)))).alias("log"), (s["total"] + F.exp(s["log"])).alias("total"))
    return F.aggregate(F.sequence(F.lit(0), (a - 1).cast("int")), first, step, lambda s: s["total"])


def closed_draws(packages: DataFrame, ident: str, dependencies: str, cost: str, budget: float, salt: str) -> DataFrame:
    """(draw, id, feasible, probability, remaining_before, cost): one package after the other, each drawn evenly among those
    not owned that the rest of the budget affords and whose dependencies are owned, until there is none.

    A draw takes the least salted hash of (draw, id), so that it is the same everywhere; it is one pass over the packages.
    A negative or null cost, and a dependency that isn't a package, fail.
    """
    spark = packages.sparkSession
    rows = packages.select(F.col(ident).cast("string").alias("id"), F.coalesce(F.col(dependencies).cast("array<string>"), F.array().cast("array<string>")).alias("deps"), F.col(cost).cast("double").alias("cost"))
    known = rows.select(F.col("id").alias("d"))
    if rows.where("cost is null or cost < 0 or id is null").limit(1).count() or rows.select(F.explode("deps").alias("d")).join(known, "d", "left_anti").limit(1).count():
        raise ValueError("invalid cost or dependency")
    owned, left, out = [], float(budget), []
    while True:
        mine = F.array(*[F.lit(o) for o in owned]).cast("array<string>")
        key = F.sha2(F.concat_ws("|", F.lit(salt), F.lit(str(len(out))), F.col("id")), 256)
        ok = rows.where((F.col("cost") <= left) & ~F.array_contains(mine, F.col("id")) & (F.size(F.array_except("deps", mine)) == 0))
        r = ok.agg(F.count(F.lit(1)).alias("n"), F.min_by(F.struct("id", "cost"), F.struct(key, F.col("id"))).alias("p")).first()
        if not r.n:
            break
        out.append((len(out), r.p.id, r.n, 1.0 / r.n, left, r.p.cost))
        owned.append(r.p.id)
        left -= r.p.cost
    return spark.createDataFrame(out, "draw long, id string, feasible long, probability double, remaining_before double, cost double")
