"""Search over formulas: a batch is scored in one job, pools keep the best.

All formulas of a batch are columns of one panel, so features and sub-expressions that they
share are computed once; the columns are unpivoted and profit is taken along (formula, symbol).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barsmith.sources.storage import stored

from .formulas import PUBLISHED, Sampler, compiled, executable, normalised, repetition_penalty, simplified, violations
from .reports import COST, DEAD_BAND, PPY, n, r6

POOL = [PUBLISHED["forex_v1"], PUBLISHED["forex_v2"], "RET5 TS_ZSCORE_20 NEG", "RSI14 DELTA CS_NEUTRALIZE", "CLOSE BAD"]
ELITE, HALF_LIFE = 60, 300


def columns(b, pool: Sequence[str]) -> dict:
    out = {}
    for i, text in enumerate(pool):
        if executable(text.split()):
            out[f"x{i}"] = normalised(b, compiled(b, text.split()))
    one, two = b.lead(b.open, 1), b.lead(b.open, 2)
    return out | {"y": b.let(b.ln(two / one))}


FINAL = f"""SELECT formula, CASE WHEN std < 1e-4 THEN 'constant' ELSE 'ok' END AS status,
  {r6(f"CASE WHEN std < 1e-4 THEN -2e0 ELSE mean / (dev + 1e-8) * sqrt({n(PPY)}) END", "score")} FROM"""


def scores(b, pool: Sequence[str]) -> DataFrame:
    """formula, status (ok, constant or invalid) and score of each formula."""
    return scored(b.frame(**columns(b, pool)), pool)


def scored(wide: DataFrame, pool: Sequence[str]) -> DataFrame:
    """The same from the columns that `columns` names, found already."""
    spark, names = wide.sparkSession, [f"x{i}" for i, text in enumerate(pool) if executable(text.split())]
    bad = spark.createDataFrame([(t, "invalid", -5.0) for t in pool if not executable(t.split())], "formula string, status string, score double")
    if not names:
        return bad
    pairs = ", ".join(f"'{pool[int(c[1:])]}', {c}" for c in names)
    rows = wide.selectExpr("symbol", "bar_idx", "y", f"stack({len(names)}, {pairs}) AS (formula, x)")
    squashed = F.tanh("x")
    rows = rows.withColumn("p", F.when(F.abs(squashed) < DEAD_BAND, 0.0).otherwise(squashed))
    before = F.lag("p", 1, 0.0).over(W.partitionBy("formula", "symbol").orderBy("bar_idx"))
    rows = rows.withColumn("pnl", F.col("p") * F.col("y") - F.abs(F.col("p") - before) * COST)
    each = rows.groupBy("formula").agg(F.stddev_samp("x").alias("std"), F.avg("pnl").alias("mean"), F.stddev_pop("pnl").alias("dev"))
    return spark.sql(f"{FINAL} {{each}}", each=each).unionByName(bad)


def scores_ctes(b, pool: Sequence[str], **more) -> str:
    """WITH and the tables up to `ag`, what FINAL reads."""
    cols = columns(b, pool)
    each = " UNION ALL ".join(f"SELECT symbol, bar_idx, y, '{pool[int(c[1:])]}' AS formula, {c} AS x FROM out" for c in cols if c != "y")
    return f"""WITH {b.ctes(**cols, **more)}, lg AS ({each}),
  ps AS (SELECT *, CASE WHEN abs(tanh(x)) < {DEAD_BAND} THEN 0.0 ELSE tanh(x) END AS p FROM lg),
  pn AS (SELECT formula, x, p * y - abs(p - lag(p, 1, 0.0) OVER (PARTITION BY formula, symbol ORDER BY bar_idx)) * {n(COST)} AS pnl FROM ps),
  ag AS (SELECT formula, stddev_samp(x) AS std, avg(pnl) AS mean, stddev_pop(pnl) AS dev FROM pn GROUP BY formula)"""


def scores_sql(b, pool: Sequence[str]) -> str:
    bad = "".join(f" UNION ALL SELECT '{t}', 'invalid', -5e0" for t in pool if not executable(t.split()))
    return f"{scores_ctes(b, pool)} {FINAL} ag{bad}"


def elite(scored: DataFrame, size: int = ELITE) -> DataFrame:
    """The best formulas, each once with its best score."""
    best = scored.filter("status = 'ok'").groupBy("formula").agg(F.max("score").alias("score"), F.first("status").alias("status"))
    return best.orderBy(F.desc("score"), "formula").limit(size).select("formula", "status", "score")


ROUNDS, BATCH = 3, 4


def batches(rounds: int = ROUNDS, count: int = BATCH, seed: int = 0) -> list[list[str]]:
    """Formulas to try, batch by batch; none comes twice."""
    seen: set[str] = set()
    out = []
    for k in range(rounds):
        fresh = [t for t in sampled(count * (k + 2), seed + k) if t not in seen][:count]
        seen |= set(fresh)
        out.append(fresh)
    return out


def looped(engine, tries: Sequence[Sequence[str]], size: int = ELITE, pool: DataFrame | None = None) -> DataFrame:
    """Scores each batch in one job and keeps the best in the pool, a table of its own after every
    round, so that a search goes on from where it stopped. engine() gives a new panel engine."""
    for batch in tries:
        found = scores(engine(), batch).select("formula", "status", "score")
        whole = found if pool is None else pool.unionByName(found)
        pool = stored(elite(whole, size), "search-pool")
    return pool


def drawn(pool: DataFrame, count: int, weight: F.Column, seed: int = 0) -> DataFrame:
    """A seeded draw of formulas without replacement, each as likely as its weight says: the least of
    -ln(u) / weight come first, u a hash of seed and formula."""
    u = (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), "formula")), 1, 8), 16, 10).cast("double") + 0.5) / 2**32
    return pool.orderBy(-F.ln(u) / weight, "formula").limit(count)


def migrated(islands: DataFrame, top: int = 5) -> DataFrame:
    """The best of each island for the others: (island, formula, score), a formula once."""
    place = F.row_number().over(W.partitionBy("island").orderBy(F.desc("score"), "formula"))
    best = islands.withColumn("place", place).filter(F.col("place") <= top)
    return best.groupBy("formula").agg(F.max("score").alias("score"), F.max_by("island", "score").alias("island"))


def replay_weight(score: F.Column, age: F.Column, temperature: float = 0.5) -> F.Column:
    """How likely an elite formula is replayed: by score, halved every 300 steps."""
    return F.exp(score / temperature) * F.pow(F.lit(0.5), age / HALF_LIFE)


def gated(train: F.Column, val: F.Column, exposure: F.Column) -> F.Column:
    """Whether a formula may become the champion: it neither overfits nor hardly trades."""
    return (val >= 0.5 * train) & (exposure >= 0.05)


def sampled(count: int, seed: int = 0) -> list[str]:
    """Different formulas in canonical form that always run and lean to neither side."""
    out: dict[str, float] = {}
    sampler = Sampler(seed)
    while len(out) < count:
        names = simplified(sampler.sample())
        if not violations(names) and executable(names):
            out[" ".join(names)] = repetition_penalty([hash(x) for x in names])
    return list(out)
