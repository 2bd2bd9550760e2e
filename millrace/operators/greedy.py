"""Greedy choices over a whole table: the best row by a score that falls as rows are taken, again and again.

A choice needs the choices before it, but not a task that holds all rows. Scores never rise (each rule says why), so the
rows with the largest scores now bound all others: a pass over the table scores every row where it lies and hands the
best `batch` to the driver, which takes rows from these for as long as none beyond them can be better. The result is
that of scoring all rows before every single choice.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.windows import shared_folder

SCHEMA = "pick long, id long, score double, cost double, spent double"


class Static:
    """A fixed score: the first component of the vector, or density (over the cost)."""

    least = -np.inf

    def __init__(self, density: bool = False):
        self.density = density

    def scores(self, x: np.ndarray, cost: np.ndarray) -> np.ndarray:
        return x[:, 0] / np.maximum(cost, 1) if self.density else x[:, 0]

    def take(self, x: np.ndarray, cost: float) -> None:
        pass


class Cover:
    """Facility location: the gain sum(max(similarity - cover, 0)) over the cost; the cover only grows."""

    least = 0.0

    def __init__(self, dim: int):
        self.cover = np.zeros(dim)

    def scores(self, x, cost):
        return np.maximum(x - self.cover, 0).sum(1) / np.maximum(cost, 1)

    def take(self, x, cost):
        self.cover = np.maximum(self.cover, x)


class Market:
    """Market clearing: demand in tokens by atom, sum(min(demand, supply)) over the cost; a row's supply is its cost dealt
    by its (non-negative) loadings, and what it sells is taken off the demand."""

    least = 0.0

    def __init__(self, demand: np.ndarray, budget: float):
        self.demand = np.asarray(demand, float) / max(float(np.sum(demand)), 1e-12) * budget

    @staticmethod
    def supply(x, cost):
        x = np.maximum(x, 0)
        return x / np.maximum(x.sum(-1, keepdims=True), 1e-12) * np.maximum(cost, 1)[..., None]

    def scores(self, x, cost):
        return np.minimum(self.demand, self.supply(x, cost)).sum(1) / np.maximum(cost, 1)

    def take(self, x, cost):
        self.demand = np.maximum(self.demand - self.supply(x, np.asarray(cost)), 0)


class Residual:
    """Expected reduction of sum(r ** 2) for each token, where a row with loadings z in [0, 1] leaves r * (1 - eta z); a
    row's score is divided by 1 + gamma times its overlap with the rows taken (cosine, not under 0)."""

    least = -np.inf

    def __init__(self, residual: np.ndarray, eta: float = 0.25, gamma: float = 1.0):
        self.r, self.eta, self.gamma, self.taken = np.asarray(residual, float), eta, gamma, np.zeros((0, len(residual)))

    def scores(self, x, cost):
        gain = (self.r**2 * (1 - (1 - self.eta * x) ** 2)).sum(1)
        unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        overlap = np.maximum(unit @ self.taken.T, 0).sum(1)
        return gain / (1 + self.gamma * overlap) / np.maximum(cost, 1e-9)

    def take(self, x, cost):
        self.r = self.r * (1 - self.eta * x)
        self.taken = np.vstack([self.taken, x / max(float(np.linalg.norm(x)), 1e-12)])


def _best(scores: np.ndarray, cost: np.ndarray, ids: np.ndarray) -> np.ndarray:
    return np.lexsort((ids, cost, -scores))


def choose(table: DataFrame, rule, budget: float, most: int | None = None, taken: list[int] = (), spent: float = 0.0, batch: int = 256) -> list[tuple]:
    """(id, score, cost, spent) of the rows taken, in order, from a table (id, cost, x) that is cut; `rule` is used up.

    Among rows that fit the rest of the budget the one with the largest score over `rule.least` is taken; ties go by
    cost, then id. What doesn't fit now never will. `taken` are ids that are not to be taken.
    """
    spark, out = table.sparkSession, []
    gone = set(taken)
    while most is None or len(out) < most:
        sent = spark.sparkContext.broadcast((rule, budget - spent, np.fromiter(gone, np.int64, len(gone))))

        def score(batches, sent=sent):
            rule, left, gone = sent.value
            for b in batches:
                ids, cost = b.column(0).to_numpy(), b.column(1).to_numpy()
                ok = (cost <= left + 1e-9) & ~np.isin(ids, gone)
                if ok.any():
                    b = b.filter(pa.array(ok))
                    x = np.array(b.column(2).to_pylist(), float)
                    s = rule.scores(x, b.column(1).to_numpy())
                    best = _best(s, b.column(1).to_numpy(), b.column(0).to_numpy())[: batch + 1]
                    best = pa.array(best[s[best] > rule.least])
                    yield pa.RecordBatch.from_arrays([*(c.take(best) for c in b.columns), pa.array(s).take(best)], names=["id", "cost", "x", "score"])

        top = table.mapInArrow(score, "id long, cost double, x array<double>, score double").orderBy(F.desc("score"), "cost", "id").limit(batch + 1).collect()
        sent.unpersist()
        if not top:
            break
        bound = top[batch].score if len(top) > batch else -np.inf
        ids, cost, x = np.array([r.id for r in top[:batch]]), np.array([r.cost for r in top[:batch]]), np.array([r.x for r in top[:batch]], float)
        first = True
        while len(ids) and (most is None or len(out) < most):
            fits = cost <= budget - spent + 1e-9
            ids, cost, x = ids[fits], cost[fits], x[fits]
            if not len(ids):
                break
            s = rule.scores(x, cost)
            i = _best(s, cost, ids)[0]
            if s[i] <= rule.least or (not first and s[i] <= bound):
                break
            first = False
            rule.take(x[i], float(cost[i]))
            spent += float(cost[i])
            gone.add(int(ids[i]))
            out.append((int(ids[i]), float(s[i]), float(cost[i]), spent))
            keep = np.arange(len(ids)) != i
            ids, cost, x = ids[keep], cost[keep], x[keep]
    return out


def prepared(df: DataFrame, ident: str, cost, vector) -> DataFrame:
    """(id, cost, x) of the rows without a null in id, cost, vector or its components, cut in the shared folder; of rows
    with one id the least by cost and vector counts."""
    shared_folder(df)
    d = df.select(F.col(ident).cast("long").alias("id"), F.expr(cost).cast("double").alias("cost") if isinstance(cost, str) else cost.cast("double").alias("cost"), (F.col(vector) if isinstance(vector, str) else vector).cast("array<double>").alias("x"))
    d = d.where(F.col("id").isNotNull() & F.col("cost").isNotNull() & F.col("x").isNotNull() & ~F.exists("x", lambda v: v.isNull() | F.isnan(v)))
    return d.groupBy("id").agg(F.min(F.struct("cost", "x")).alias("r")).select("id", "r.cost", "r.x").checkpoint(eager=True)


def _result(df: DataFrame, rows: list[tuple]) -> DataFrame:
    return df.sparkSession.createDataFrame([(i, *r) for i, r in enumerate(rows)], SCHEMA)


def cover(df: DataFrame, ident: str, cost, vector, score, budget: float, **options) -> DataFrame:
    """Greedy facility location over similarities to stated queries, and a top-up by score once nothing gains.

    Returns (pick, id, score, cost, spent), one row for each row taken: the selection itself passes the driver. Rows with
    a null in id, cost, vector or score aren't taken; an empty table gives no rows.
    """
    table = prepared(df, ident, cost, vector)
    dim = table.select(F.max(F.size("x"))).first()[0] or 0
    got = choose(table, Cover(dim), budget, **options)
    plain = prepared(df, ident, cost, F.array(score))
    got += choose(plain, Static(), budget, taken=[r[0] for r in got], spent=got[-1][3] if got else 0.0, **options)
    return _result(df, got)


def market(df: DataFrame, ident: str, cost, vector, demand: list[float], budget: float, score, **options) -> DataFrame:
    """Atom market clearing, then what is left of the budget by density of `score`. Returns as `cover` does."""
    table = prepared(df, ident, cost, vector)
    got = choose(table, Market(np.array(demand, float), budget), budget, **options)
    plain = prepared(df, ident, cost, F.array(score))
    got += choose(plain, Static(density=True), budget, taken=[r[0] for r in got], spent=got[-1][3] if got else 0.0, **options)
    return _result(df, got)


def residual(df: DataFrame, ident: str, cost, vector, start: list[float], budget: float, eta: float = 0.25, gamma: float = 1.0, **options) -> DataFrame:
    """Greedy reduction of a residual over atoms for each token, overlap discounted (see Residual). Returns as `cover`."""
    return _result(df, choose(prepared(df, ident, cost, vector), Residual(np.array(start, float), eta, gamma), budget, **options))


def fill(df: DataFrame, ident: str, cost, score, budget: float, density: bool = False, **options) -> DataFrame:
    """Rows by falling score (over the cost, if `density`), those skipped that don't fit any more. Returns as `cover`."""
    return _result(df, choose(prepared(df, ident, cost, F.array(score)), Static(density), budget, **options))


def residual_after(df: DataFrame, vector: str, start: list[float], eta: float) -> DataFrame:
    """(atom, before, after): the residual that any set of rows leaves, whatever their order: a product over rows."""
    k = df.select(F.posexplode(F.col(vector).cast("array<double>")).alias("atom", "z")).where("z is not null")
    # logarithms of factors; a factor of zero leaves nothing
    f = 1 - F.lit(float(eta)) * F.col("z")
    g = k.groupBy("atom").agg(F.sum(F.when(f != 0, F.log(F.abs(f)))).alias("l"), F.sum((f == 0).cast("int")).alias("zeros"), F.sum((f < 0).cast("int")).alias("signs"))
    base = df.sparkSession.createDataFrame(list(enumerate(map(float, start))), "atom int, before double")
    after = F.when(F.coalesce("zeros", F.lit(0)) > 0, 0.0).otherwise(F.col("before") * F.exp(F.coalesce("l", F.lit(0.0))) * F.when(F.coalesce("signs", F.lit(0)) % 2 == 1, -1).otherwise(1))
    return base.join(g, "atom", "left").select("atom", "before", after.alias("after"))


def metered(df: DataFrame, ident: str, quoted, paid, vector, demand: list[float], budget: float, accepted=None, per_round: int = 8, rounds: int = 1000) -> DataFrame:
    """Purchases in rounds, where a row's true cost is known only once it is bought.

    In each round the demand not yet supplied (by accepted rows, at what was paid) is cleared on quoted costs, scaled by
    what has been paid for what was quoted so far, `per_round` rows at most; then they are paid. A row that isn't
    accepted supplies nothing but its cost is gone. It ends when a round takes nothing or the budget is spent; the last
    rows paid may overshoot by less than a round. Returns (round, id, quoted, paid, spent, accepted).
    """
    ok = F.lit(True) if accepted is None else F.coalesce(accepted, F.lit(False))
    shared_folder(df)
    table = prepared(df, ident, quoted, vector)
    book = df.select(F.col(ident).cast("long").alias("id"), F.expr(paid).cast("double").alias("paid"), ok.alias("ok")).where("id is not null and paid is not null").groupBy("id").agg(F.min(F.struct("paid", "ok")).alias("b")).select("id", "b.paid", "b.ok").checkpoint(eager=True)
    total = np.asarray(demand, float) / max(float(np.sum(demand)), 1e-12) * budget
    bought, out, spent, asked = np.zeros(len(total)), [], 0.0, 0.0
    for k in range(rounds):
        rate = spent / asked if asked else 1.0
        rule = Market(np.ones(len(total)), 0.0)
        rule.demand = np.maximum(total - bought, 0)
        left = budget - spent
        got = choose(table.withColumn("cost", F.col("cost") * rate), rule, left, most=per_round, taken=[r[1] for r in out])
        if not got or left <= 0:
            break
        ids = [r[0] for r in got]
        rows = {r.id: r for r in table.join(book, "id").where(F.col("id").isin(ids)).collect()}
        for i in ids:
            if i not in rows:
                raise ValueError(f"row {i} has a quote but no price")
            r = rows[i]
            spent, asked = spent + r.paid, asked + r.cost
            if r.ok:
                bought = bought + Market.supply(np.array(r.x, float), np.asarray(r.paid))
            out.append((k, i, r.cost, r.paid, spent, r.ok))
    return df.sparkSession.createDataFrame(out, "round int, id long, quoted double, paid double, spent double, accepted boolean")


def probe_uncertainty(df: DataFrame, group: str, vector: str, top: int = 5) -> DataFrame:
    """(atom, uncertainty, anchor_share), the `top` atoms whose mean over groups depends most on single groups: standard
    deviation of the leave-one-group-out means; anchor_share is the largest group's part of the atom's mass."""
    k = df.select(group, F.posexplode(F.col(vector).cast("array<double>")).alias("atom", "z")).where("z is not null")
    g = k.groupBy("atom", group).agg(F.sum("z").alias("s"), F.count(F.lit(1)).alias("n"))
    t = g.groupBy("atom").agg(F.sum("s").alias("ts"), F.sum("n").alias("tn"), F.max("s").alias("ms"))
    loo = g.join(t, "atom").select("atom", "ts", "ms", F.try_divide(F.col("ts") - F.col("s"), F.col("tn") - F.col("n")).alias("m"))
    u = loo.groupBy("atom").agg(F.stddev_pop("m").alias("uncertainty"), F.max(F.try_divide("ms", "ts")).alias("anchor_share"))
    return u.orderBy(F.desc("uncertainty"), "atom").limit(top)


def deficit(failed: DataFrame, vector: str) -> list[float]:
    """The mean vector of failed rows, one value for each atom."""
    k = failed.select(F.posexplode(F.col(vector).cast("array<double>")).alias("atom", "z")).where("z is not null")
    return [r.m for r in k.groupBy("atom").agg(F.avg("z").alias("m")).orderBy("atom").collect()]


def by_deficit(df: DataFrame, vector: str, want: list[float]) -> DataFrame:
    """`deficit_score`: each row's vector times the deficit."""
    w = F.array(*[F.lit(float(v)) for v in want])
    return df.withColumn("deficit_score", F.aggregate(F.zip_with(F.col(vector).cast("array<double>"), w, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v))
