"""A search over formulas that learns: each round breeds from the best formulas so far.

Everything that was ever scored is a table of a folder, one part a round, keyed by canonical program.
A round draws parents from the elite by score and age, breeds programs by crossover and mutation, adds
fresh samples, takes out by anti-join what was scored before, scores the rest in one job and lets the
factor pool take away from formulas that resemble its members. Draws are seeded by the round, and a
round counts once its part is written, so a search that was cut off goes on as if it had not been.
"""

from __future__ import annotations

import random
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barsmith.functions.features import FEATURES
from barsmith.operators.formula_ops import OPERATORS, REGISTERED
from barsmith.sources.storage import complete, stored

from . import search
from .formulas import MAX_LENGTH, executable, simplified, violations
from .pool import FactorPool

#: Of a round's programs, the share that is sampled afresh; of the bred ones, the share of crossovers.
FRESH, CROSSED = 0.25, 0.5
#: Programs bred for each one that is scored, as many were seen before or cannot run.
SPARE = 4


def arity(name: str) -> int:
    return OPERATORS[name].arity if name in OPERATORS else 0


def spans(names: Sequence[str]) -> list[tuple[int, int]]:
    """For each step of a postfix program the half-open range of the expression that ends there."""
    stack: list[int] = []
    out = []
    for i, name in enumerate(names):
        n = arity(name)
        start = i if n == 0 else stack[len(stack) - n]
        del stack[len(stack) - n :]
        stack.append(start)
        out.append((start, i + 1))
    return out


def crossed(rng: random.Random, one: list[str], two: list[str]) -> list[str]:
    """One program with an expression of the other in place of one of its own."""
    a, b = rng.choice(spans(one))
    c, d = rng.choice(spans(two))
    return one[:a] + two[c:d] + one[b:]


def mutated(rng: random.Random, names: list[str]) -> list[str]:
    """A step exchanged for one of its arity, an expression for a feature, or a unary operator more or less."""
    kind, i = rng.randrange(4), rng.randrange(len(names))
    unary = [n for n in REGISTERED if arity(n) == 1]
    if kind == 0:
        same = [n for n in (REGISTERED if arity(names[i]) else FEATURES) if arity(n) == arity(names[i])]
        return names[:i] + [rng.choice(same)] + names[i + 1 :]
    a, b = spans(names)[i]
    if kind == 1:
        return names[:a] + [rng.choice(list(FEATURES))] + names[b:]
    if kind == 2 or arity(names[i]) != 1:
        return names[:b] + [rng.choice(unary)] + names[b:]
    return names[:i] + names[i + 1 :]


def bred(parents: Sequence[str], count: int, seed: str) -> list[str]:
    """`count` programs in canonical form that run, lean to neither side and are different; fewer if the
    parents do not yield them."""
    rng, out = random.Random(seed), {}
    parents = [p.split() for p in parents]
    for _ in range(count * 40):
        if len(out) == count or not parents:
            break
        one = rng.choice(parents)
        new = crossed(rng, one, rng.choice(parents)) if rng.random() < CROSSED else mutated(rng, one)
        new = simplified(new)
        if 1 < len(new) <= MAX_LENGTH and executable(new) and not violations(new):
            out[" ".join(new)] = None
    return list(out)


class Search:
    """A search in a folder that all executors share. engine() gives a new engine over the panel."""

    SCORED = "round int, formula string, status string, raw double, score double"

    def __init__(self, spark: SparkSession, path: str, engine: Callable, pool_size: int | None = None, seed: int = 0):
        self.spark, self.path, self.engine, self.seed = spark, path.rstrip("/"), engine, seed
        self.pool = FactorPool(spark, f"{self.path}/pool", pool_size) if pool_size else FactorPool(spark, f"{self.path}/pool")
        self.round = -1
        while complete(spark, self._at(self.round + 1)):
            self.round += 1

    def _at(self, k: int) -> str:
        return f"{self.path}/scored/round-{k}"

    def scored(self) -> DataFrame:
        """Every formula that was scored, once: round, formula, status, raw and score."""
        if self.round < 0:
            return self.spark.createDataFrame([], self.SCORED)
        return self.spark.read.schema(self.SCORED).parquet(*[self._at(k) for k in range(self.round + 1)])

    def elite(self, size: int = search.ELITE) -> DataFrame:
        return self.scored().filter("status = 'ok'").orderBy(F.desc("score"), "formula").limit(size)

    def proposals(self, count: int) -> list[str]:
        """The next round's programs: none was scored before."""
        k = self.round + 1
        age = F.lit(k) - F.col("round")
        drawn = search.drawn(self.elite(), 2 * count, search.replay_weight(F.col("score"), age), seed=self.seed * 1009 + k)
        parents = [r["formula"] for r in drawn.select("formula").collect()]  # of at most ELITE rows
        young = bred(parents, SPARE * count, f"{self.seed}:{k}")
        fresh = search.sampled(SPARE * count, seed=self.seed * 1009 + k)
        whole = round(FRESH * count) if young else count
        kinds = [(0, i, f) for i, f in enumerate(young)] + [(1, i, f) for i, f in enumerate(fresh) if f not in set(young)]
        tries = self.spark.createDataFrame(kinds, "kind int, place int, formula string").join(self.scored(), "formula", "left_anti")
        new = sorted((r["kind"], r["place"], r["formula"]) for r in tries.collect())  # a few times count
        old, sampled = ([f for x, _, f in new if x == kind] for kind in (0, 1))
        return (old[: count - whole] + sampled)[:count]

    def step(self, count: int) -> DataFrame:
        """Scores one batch, updates the pool and writes the round."""
        k, batch = self.round + 1, self.proposals(count)
        b = self.engine()
        columns = search.columns(b, batch)
        wide = stored(b.frame(**columns, bars=b.bars()), "search-batch")
        found = search.scored(wide, batch)
        place = self.spark.createDataFrame([(f, f"x{i}") for i, f in enumerate(batch)], "formula string, column string")
        good = found.filter("status = 'ok'").join(place, "formula")
        if self.pool.round < k:  # else the round was cut off after the pool's part
            self.pool.update(wide.filter("bar_idx < floor(bars * 8e-1)"), good)
        mine = self.pool.tried().select("formula", "raw", F.col("score").alias("held"))
        rows = found.join(mine, "formula", "left")
        rows = rows.select(F.lit(k).alias("round"), "formula", "status", F.coalesce("raw", "score").alias("raw"), F.coalesce("held", "score").alias("score"))
        rows.coalesce(1).write.mode("overwrite").parquet(self._at(k))
        self.round = k
        return self.scored()

    def run(self, rounds: int, count: int) -> DataFrame:
        """Goes on until there are `rounds` rounds."""
        while self.round + 1 < rounds:
            self.step(count)
        return self.scored()
