"""A pool of the best factors. A candidate that resembles a member loses a part of its score.

The pool is three tables of a folder, one set for each round: the members, their values on the training
bars, and the correlations of all pairs of members. A batch of candidates meets the members once, in one
block product of (batch x batch and pool); what survives keeps its values and correlations, so members
are neither computed nor compared with each other again. A round counts once its members are written,
which is done last: a search that was cut off goes on from the last whole round.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barsmith.sources.storage import complete, discard, stored

SIZE = 25
TOO_CLOSE, PENALTY, FLAT = 0.85, 0.8, 1e-4


def block_correlations(df: DataFrame, rows: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """|Pearson correlation| of each column in `rows` with each in `columns`: (one, two, correlation), 0 where
    one of them hardly varies. Each task adds up one matrix of products of centred values; only matrices
    are shuffled, as many numbers as there are pairs."""
    import numpy as np
    import pyarrow as pa

    names = list(dict.fromkeys([*rows, *columns]))
    place = {c: i for i, c in enumerate(names)}
    left, right = [place[c] for c in rows], [place[c] for c in columns]
    means = df.agg(*[F.avg(c).alias(c) for c in names]).first()  # one row
    centre = np.array([means[c] or 0.0 for c in names])

    def products(batches):
        cross, own, n = np.zeros((len(left), len(right))), np.zeros(len(names)), 0
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]) - centre
            cross += x[:, left].T @ x[:, right]
            own += (x * x).sum(0)
            n += len(x)
        i, j = (a.ravel() for a in np.indices(cross.shape))
        squares = (pa.array(own[np.array(side)[k]]) for side, k in ((left, i), (right, j)))
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(cross.ravel()), *squares, pa.array(np.full(len(i), n))], names=["i", "j", "p", "a", "b", "n"])

    parts = df.select(*names).mapInArrow(products, "i int, j int, p double, a double, b double, n long")
    sums = parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in "pabn"])
    name = lambda side, at: F.element_at(F.array(*map(F.lit, side)), F.col(at) + 1)
    flat = F.least("a", "b") < FLAT * FLAT * (F.col("n") - 1)
    value = F.when(flat, 0.0).otherwise(F.abs(F.try_divide(F.col("p"), F.sqrt("a") * F.sqrt("b"))))
    return sums.select(name(rows, "i").alias("one"), name(columns, "j").alias("two"), F.coalesce(value, F.lit(0.0)).alias("correlation"))


class FactorPool:
    """A pool in a folder that all executors share; opening it again finds its last whole round."""

    MEMBERS = "formula string, column string, round int, raw double, score double"
    PAIRS = "one string, two string, correlation double"

    def __init__(self, spark: SparkSession, path: str, size: int = SIZE):
        self.spark, self.path, self.size, self.round = spark, path.rstrip("/"), size, -1
        while complete(spark, self._at("members", self.round + 1)):
            self.round += 1

    def _at(self, table: str, k: int | None = None) -> str:
        return f"{self.path}/round-{self.round if k is None else k}/{table}"

    def members(self) -> DataFrame:
        """formula, column (of values), round, raw and score, at most `size` rows."""
        if self.round < 0:
            return self.spark.createDataFrame([], self.MEMBERS)
        return self.spark.read.schema(self.MEMBERS).parquet(self._at("members"))

    def pairs(self) -> DataFrame:
        """(one, two, correlation) of members, each pair once, by columns; one < two."""
        if self.round < 0:
            return self.spark.createDataFrame([], self.PAIRS)
        return self.spark.read.schema(self.PAIRS).parquet(self._at("pairs"))

    def values(self) -> DataFrame | None:
        """symbol, bar_idx and a column for each member."""
        return None if self.round < 0 else self.spark.read.parquet(self._at("values"))

    def update(self, wide: DataFrame, found: DataFrame) -> DataFrame:
        """One round. wide: symbol, bar_idx and a column for each candidate, on the training bars; found:
        formula, column, score. Candidates are held to the members that were there before the round; the
        best `size` of both stay, ties to the earlier round, then by formula. Returns the candidates with
        raw and penalised score."""
        k, old = self.round + 1, {r["column"]: r for r in self.members().collect()}  # `size` rows at most
        new = {f"r{k}_{r['column']}": (r["formula"], r["score"]) for r in found.select("formula", "column", "score").collect()}
        before = self.values()
        wide = wide.select("symbol", "bar_idx", *[F.col(c[len(f"r{k}_") :]).alias(c) for c in new])
        both = wide if before is None else wide.join(before, ["symbol", "bar_idx"])
        both = stored(both, "search-pool")
        fresh = block_correlations(both, list(new), [*new, *old]) if new else self.spark.createDataFrame([], self.PAIRS)
        fresh = {(r["one"], r["two"]): r["correlation"] for r in fresh.collect()}  # a number for each pair
        rows = [(old[c]["formula"], c, old[c]["round"], old[c]["raw"], old[c]["score"]) for c in old]
        for c, (formula, raw) in new.items():
            close = any(fresh[c, m] > TOO_CLOSE for m in old)
            rows.append((formula, c, k, raw, raw * PENALTY if close else raw))
        best = sorted(rows, key=lambda r: (-r[4], r[2], r[0]))[: self.size]
        stay = [r[1] for r in best]
        both.select("symbol", "bar_idx", *stay).write.mode("overwrite").parquet(self._at("values", k))
        met = [(min(a, b), max(a, b), v) for (a, b), v in fresh.items() if a in stay and b in stay and (a < b or b in old)]
        kept = self.pairs().filter(F.col("one").isin(stay) & F.col("two").isin(stay))
        pairs = kept.unionByName(self.spark.createDataFrame(sorted(set(met)), self.PAIRS))
        pairs.coalesce(1).write.mode("overwrite").parquet(self._at("pairs", k))
        tried = self.spark.createDataFrame([r for r in rows if r[2] == k], self.MEMBERS).coalesce(1)
        tried.write.mode("overwrite").parquet(self._at("tried", k))
        table = self.spark.createDataFrame(best, self.MEMBERS).coalesce(1)
        table.write.mode("overwrite").parquet(self._at("members", k))
        self.round = k
        if k > 1:  # nothing reads values older than the last round's
            discard(self.spark, self._at("values", k - 2))
        return self.tried()

    def tried(self) -> DataFrame:
        """The last round's candidates, with raw and penalised score."""
        return self.spark.read.schema(self.MEMBERS).parquet(self._at("tried"))


def members_sql(b, batches: Sequence[Sequence[str]], size: int) -> str:
    """The members after these batches of formulas, as one query: a step of the pool a batch."""
    from . import search

    every = [f for batch in batches for f in batch]
    steps, last = [], None
    for k, batch in enumerate(batches):
        mine = f"formula IN ({', '.join(repr(f) for f in batch)}) AND status = 'ok'"
        if last is None:
            rows = f"SELECT formula, {k} AS round, score AS raw, score FROM s0 WHERE {mine}"
        else:
            close = f"EXISTS (SELECT 1 FROM cc JOIN {last} ON cc.two = {last}.formula WHERE cc.one = s0.formula AND cc.c > {TOO_CLOSE})"
            rows = f"SELECT * FROM {last} UNION ALL SELECT formula, {k}, score, CASE WHEN {close} THEN score * {PENALTY}::DOUBLE ELSE score END FROM s0 WHERE {mine}"
        steps.append(f"m{k} AS (SELECT * FROM ({rows}) ORDER BY score DESC, round, formula LIMIT {size})")
        last = f"m{k}"
    return f"""{search.scores_ctes(b, every, bars=b.bars())}, s0 AS ({search.FINAL} ag),
  tr AS (SELECT formula, symbol, bar_idx, x FROM lg JOIN (SELECT symbol, bar_idx, bars FROM out) USING (symbol, bar_idx) WHERE bar_idx < floor(bars * 0.8)),
  cc AS (SELECT a.formula AS one, b.formula AS two, abs(corr(a.x, b.x)) AS c FROM tr a JOIN tr b USING (symbol, bar_idx) GROUP BY a.formula, b.formula),
  {", ".join(steps)} SELECT formula, round, raw, score FROM {last}"""
