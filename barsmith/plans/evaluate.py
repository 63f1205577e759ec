"""How much a factor tells about the return to come.

`candidates` is the long table (name, symbol, bar_idx, x, y) of all features and the target, without
the last bars, whose target is not known yet. Measures of one candidate are aggregations of it;
correlations between candidates come from the wide table in one pass of matrix products.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barsmith.functions.features import FEATURES
from barsmith.functions.ranks import quantiles, ranked
from barsmith.sources.storage import stored

from .reports import Report, r6

NAMES = tuple(FEATURES)
#: A candidate goes if one that stays correlates so much with it; so many names make the short list.
THRESHOLD, TOP = 0.9, 28
HORIZON = 2


def columns(b) -> dict:
    """The features by name and the target."""
    one, two = b.lead(b.open, 1), b.lead(b.open, 2)
    target = b.let(b.ln(two / one))
    return {**{f"f_{n.lower()}": FEATURES[n].build(b) for n in NAMES}, "y": target, "bars": b.bars()}


def candidates(wide: DataFrame, horizon: int = HORIZON) -> DataFrame:
    """One row for each feature and bar, unpivoted in place."""
    pairs = ", ".join(f"'{n}', f_{n.lower()}" for n in NAMES)
    return wide.filter(F.col("bar_idx") < F.col("bars") - horizon).selectExpr(
        "symbol", "bar_idx", "y", "bars", f"stack({len(NAMES)}, {pairs}) AS (name, x)"
    )


def candidates_sql(horizon: int = HORIZON) -> str:
    each = " UNION ALL ".join(f"SELECT symbol, bar_idx, y, bars, '{n}' AS name, f_{n.lower()} AS x FROM out WHERE bar_idx < bars - {horizon}" for n in NAMES)
    return f"cand AS ({each})"


def _corr(x: str, y: str) -> str:
    """Pearson correlation, null for a constant."""
    return f"covar_pop({x}, {y}) / nullif(stddev_pop({x}) * stddev_pop({y}), 0e0)"


RANKED = f"""rk AS (SELECT name, symbol, x, y, rank() OVER (PARTITION BY name, symbol ORDER BY x) + (count(*) OVER (PARTITION BY name, symbol, x) - 1) / 2e0 AS rx,
    rank() OVER (PARTITION BY name, symbol ORDER BY y) + (count(*) OVER (PARTITION BY name, symbol, y) - 1) / 2e0 AS ry FROM {{pnl}}),
  ic AS (SELECT name, symbol, {_corr('x', 'y')} AS ic, {_corr('rx', 'ry')} AS ric FROM rk GROUP BY name, symbol HAVING stddev_pop(x) >= 1e-8 AND stddev_pop(y) >= 1e-8),
  ev AS (SELECT name, avg(ic) AS ic, avg(ric) AS rank_ic, CASE WHEN stddev_pop(ic) > 1e-10 THEN avg(ic) / (stddev_pop(ic) + 1e-10) ELSE 0e0 END AS ir FROM ic GROUP BY name)"""
EVALUATIONS = {
    "eval_ic": Report("eval_ic", f"SELECT name, {r6('ic', 'ic')}, {r6('rank_ic', 'rank_ic')}, {r6('ir', 'ir')} FROM ev", RANKED),
    "eval_degenerate": Report("eval_degenerate", "SELECT name, count(*) AS n, CASE WHEN count(*) < 2 OR stddev_pop(x) < 1e-8 THEN 1 ELSE 0 END AS degenerate FROM {pnl} GROUP BY name"),
    "eval_ablation": Report(
        "eval_ablation",
        f"SELECT name, {r6('avg(v_with - v_without)', 'marginal')}, CASE WHEN avg(v_with - v_without) <= -1e-2 THEN 1 ELSE 0 END AS drop_it FROM mg GROUP BY name",
        f"""wn AS (SELECT *, floor(bar_idx / floor(bars / 5e0)) AS win FROM {{pnl}}),
  wi AS (SELECT name, win, symbol, {_corr('x', 'y')} AS ic FROM wn WHERE win < 5 GROUP BY name, win, symbol HAVING stddev_pop(x) >= 1e-8 AND stddev_pop(y) >= 1e-8),
  wv AS (SELECT name, win, abs(avg(ic)) AS v FROM wi GROUP BY name, win),
  mg AS (SELECT name, win, avg(v) OVER (PARTITION BY win) AS v_with,
    CASE WHEN count(*) OVER (PARTITION BY win) > 1 THEN (sum(v) OVER (PARTITION BY win) - v) / (count(*) OVER (PARTITION BY win) - 1) ELSE 0e0 END AS v_without FROM wv)""",
    ),
}


def information(wide: DataFrame, horizon: int = HORIZON) -> DataFrame:
    """name, ic, rank_ic and ir of every candidate. Ranks come from sorted ranges, those of the target once
    for all candidates; no task holds a symbol's values of a candidate."""
    rows = wide.filter(F.col("bar_idx") < F.col("bars") - horizon)
    rows = ranked(rows, ["symbol"], "y", "ry")
    pairs = ", ".join(f"'{n}', f_{n.lower()}" for n in NAMES)
    long = ranked(rows.selectExpr("symbol", "y", "ry", f"stack({len(NAMES)}, {pairs}) AS (name, x)"), ["name", "symbol"], "x", "rx")
    corr = lambda x, y: F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
    each = long.groupBy("name", "symbol").agg(corr("x", "y").alias("ic"), corr("rx", "ry").alias("ric"), F.stddev_pop("x").alias("sx"), F.stddev_pop("y").alias("sy"))
    each = each.filter("sx >= 1e-8 AND sy >= 1e-8").groupBy("name")
    ir = F.when(F.stddev_pop("ic") > 1e-10, F.avg("ic") / (F.stddev_pop("ic") + 1e-10)).otherwise(0.0)
    return each.agg(F.avg("ic").alias("ic"), F.avg("ric").alias("rank_ic"), ir.alias("ir"))


def mutual_information(cand: DataFrame, target: DataFrame | None = None) -> DataFrame:
    """Discrete mutual information with the target; the edges are exact quantiles found by sorted ranges,
    and the counts of at most 400 cells meet for each name. target: the column y by itself, if it is
    the same for all candidates; it is then sorted once."""
    from pyspark.sql import Window as W

    n = cand.groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    bins = F.greatest(F.lit(5), F.least(F.lit(20), F.floor(F.sqrt("n")).cast("int")))
    n = stored(n.select("name", bins.alias("bins"), "n"), "evaluation")
    parts = []
    for k in [r["bins"] for r in n.select("bins").distinct().collect()]:  # 16 values at most
        names = n.filter(F.col("bins") == k).select("name", "n")
        rows = cand.join(F.broadcast(names), "name")  # one row for each candidate
        at = {f"e{i}": i / k for i in range(k + 1)}
        listed = lambda found, by, name: found.select(*by, F.array(*at).alias(name))
        cut = listed(quantiles(rows.select("name", "x"), ["name"], "x", at), [F.col("name").alias("e_name")], "ex")
        if target is None:
            cut = cut.join(listed(quantiles(rows.select("name", "y"), ["name"], "y", at), [F.col("name").alias("y_name")], "ey"), F.col("e_name") == F.col("y_name"))
        else:
            every = target.select(F.lit(0).alias("all"), "y")
            cut = cut.join(F.broadcast(listed(quantiles(every, ["all"], "y", at), [], "ey")))  # one row
        inner = lambda e: F.slice(F.array_distinct(e), F.lit(2), F.greatest(F.size(F.array_distinct(e)) - 2, F.lit(0)))
        rows = rows.join(F.broadcast(cut), F.col("name") == F.col("e_name"))
        bin_of = lambda e, v: F.size(F.filter(inner(e), lambda c: c <= v))
        parts.append(rows.select("name", "n", bin_of(F.col("ex"), F.col("x")).alias("bx"), bin_of(F.col("ey"), F.col("y")).alias("by")))
    if not parts:
        return n.select("name", F.lit(0.0).alias("mi"))
    all_ = parts[0]
    for more in parts[1:]:
        all_ = all_.unionByName(more)
    cells = all_.groupBy("name", "bx", "by").agg(F.count(F.lit(1)).alias("c"), F.first("n").alias("n"))
    row = F.sum("c").over(W.partitionBy("name", "bx"))
    col = F.sum("c").over(W.partitionBy("name", "by"))
    cells = cells.withColumns({"row": row, "col": col})
    term = F.col("c") / F.col("n") * F.ln(F.col("c") * F.col("n") / (F.col("row") * F.col("col")))
    return cells.groupBy("name").agg(F.greatest(F.sum(term), F.lit(0.0)).alias("mi"))


def target(wide: DataFrame, horizon: int = HORIZON) -> DataFrame:
    return wide.filter(F.col("bar_idx") < F.col("bars") - horizon).select("y")


def mutual_information_sql() -> str:
    """`mi` over `cand`."""
    inner = lambda e: f"list_sort(list_distinct({e}))[2:len(list_distinct({e})) - 1]"
    q = lambda v: f"list_transform(range(0, bins + 1), lambda i: {v}[floor(i / bins * (n - 1))::BIGINT + 1] + ({v}[ceil(i / bins * (n - 1))::BIGINT + 1] - {v}[floor(i / bins * (n - 1))::BIGINT + 1]) * (i / bins * (n - 1) - floor(i / bins * (n - 1))))"
    return f"""mn AS (SELECT name, count(*) AS n, greatest(5, least(20, floor(sqrt(count(*)))))::INTEGER AS bins, list_sort(list(x)) AS sx, list_sort(list(y)) AS sy FROM cand GROUP BY name),
  me AS (SELECT name, n, {q("sx")} AS ex, {q("sy")} AS ey FROM mn),
  mi0 AS (SELECT name, n, {inner("ex")} AS ix, {inner("ey")} AS iy FROM me),
  mb AS (SELECT name, n, len(list_filter(ix, lambda e: e <= x)) AS bx, len(list_filter(iy, lambda e: e <= y)) AS by_ FROM cand JOIN mi0 USING (name)),
  mc AS (SELECT name, n, bx, by_, count(*) AS c FROM mb GROUP BY ALL),
  mt AS (SELECT *, sum(c) OVER (PARTITION BY name, bx) AS r, sum(c) OVER (PARTITION BY name, by_) AS k FROM mc),
  mi AS (SELECT name, greatest(sum(c / n * ln(c * n / (r * k))), 0) AS mi FROM mt GROUP BY name)"""


def correlations(wide: DataFrame, horizon: int = HORIZON) -> DataFrame:
    """|Pearson correlation| of every two candidates over all bars: (one, two, correlation). Each
    partition gives one matrix of products of centred values, and only matrices are added up."""
    import numpy as np
    import pyarrow as pa

    columns = [f"f_{n.lower()}" for n in NAMES]
    rows = wide.filter(F.col("bar_idx") < F.col("bars") - horizon).select(*columns)
    means = rows.agg(*[F.avg(c).alias(c) for c in columns]).first()  # one row
    centre = np.array([means[c] or 0.0 for c in columns])

    def products(batches):
        total = np.zeros((len(NAMES), len(NAMES)))
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]) - centre
            total += x.T @ x
        i, j = np.triu_indices(len(NAMES))
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], names=["i", "j", "p"])

    sums = rows.mapInArrow(products, "i int, j int, p double").groupBy("i", "j").agg(F.sum("p").alias("p"))
    own = sums.filter("i = j").select(F.col("i").alias("o"), F.sqrt("p").alias("s"))  # a row a candidate
    name = lambda c: F.element_at(F.array(*map(F.lit, NAMES)), F.col(c) + 1)
    left, right = own.select(F.col("o").alias("a"), F.col("s").alias("sa")), own.select(F.col("o").alias("b"), F.col("s").alias("sb"))
    both = sums.filter("i < j").join(F.broadcast(left), F.col("i") == F.col("a")).join(F.broadcast(right), F.col("j") == F.col("b"))
    value = F.when(F.col("sa") * F.col("sb") > 0, F.abs(F.col("p") / (F.col("sa") * F.col("sb")))).otherwise(0.0)
    first, second = F.least(name("i"), name("j")), F.greatest(name("i"), name("j"))
    return both.select(first.alias("one"), second.alias("two"), value.alias("correlation"))


CORRELATIONS_SQL = """cr AS (SELECT a.name AS one, b.name AS two, coalesce(abs(CASE WHEN stddev_pop(a.x) > 0 AND stddev_pop(b.x) > 0 THEN corr(a.x, b.x) END), 0) AS correlation
    FROM cand a JOIN cand b ON a.symbol = b.symbol AND a.bar_idx = b.bar_idx AND a.name < b.name GROUP BY a.name, b.name)"""


def scored(flat: DataFrame, ranks: DataFrame, mi: DataFrame) -> DataFrame:
    """0.6 rank of |rank IC| and 0.4 rank of mutual information, ranks in [0, 1] among the candidates
    that can be scored; degenerate ones have no score. flat: name, degenerate. A row a candidate."""
    from pyspark.sql import Window as W

    all_ = flat.join(ranks, "name", "left").join(mi, "name", "left")
    good = W.partitionBy("degenerate")
    place = lambda c: (F.row_number().over(good.orderBy(c, "name")) - 1) / F.greatest(F.count(F.lit(1)).over(good) - 1, F.lit(1))
    # candidates that are the same but for rounding tie
    of = lambda c: F.floor(F.coalesce(c, F.lit(0.0)) * 1e9 + 0.47)
    value = 0.6 * place(of(F.abs(F.col("rank_ic")))) + 0.4 * place(of(F.col("mi")))
    return all_.select("name", F.when(F.col("degenerate") == 0, value).alias("score"))


SCORED_SQL = """fl AS (SELECT name, CASE WHEN count(*) < 2 OR stddev_pop(x) < 1e-8 THEN 1 ELSE 0 END AS degenerate FROM cand GROUP BY name),
  ra AS (SELECT name, degenerate, row_number() OVER (PARTITION BY degenerate ORDER BY floor(abs(coalesce(rank_ic, 0)) * 1e9 + 0.47), name) - 1 AS a,
    row_number() OVER (PARTITION BY degenerate ORDER BY floor(coalesce(mi, 0) * 1e9 + 0.47), name) - 1 AS m, count(*) OVER (PARTITION BY degenerate) AS n
    FROM fl LEFT JOIN ev USING (name) LEFT JOIN mi USING (name)),
  sc AS (SELECT name, CASE WHEN degenerate = 0 THEN 0.6::DOUBLE * (a / greatest(n - 1, 1)) + 0.4::DOUBLE * (m / greatest(n - 1, 1)) END AS score FROM ra)"""
#: The greedy walk as a recursion along the names by score.
PRUNED_SQL = f"""od AS (SELECT name, score, coalesce(score, '-Infinity'::DOUBLE) AS s, row_number() OVER (ORDER BY coalesce(score, '-Infinity'::DOUBLE) DESC, name) AS k FROM sc),
  bl AS (SELECT o.k, o.name, o.score, list(b.name ORDER BY b.k) FILTER (b.name IS NOT NULL) AS better FROM od o
    LEFT JOIN (SELECT x.*, c.two AS other, c.correlation FROM od x JOIN (SELECT one, two, correlation FROM cr UNION ALL SELECT two, one, correlation FROM cr) c ON c.one = x.name) b
      ON b.other = o.name AND b.k < o.k AND b.correlation >= {THRESHOLD} AND b.s - o.s > 0.01 GROUP BY o.k, o.name, o.score),
  wk(k, kept, name, score, by_) AS (SELECT 0::BIGINT, []::VARCHAR[], NULL::VARCHAR, NULL::DOUBLE, NULL::VARCHAR
    UNION ALL SELECT k, CASE WHEN by_ IS NULL THEN list_append(kept, name) ELSE kept END, name, score, by_ FROM
      (SELECT bl.k, wk.kept, bl.name, bl.score, list_filter(coalesce(bl.better, []), lambda x: list_contains(wk.kept, x))[1] AS by_ FROM wk JOIN bl ON bl.k = wk.k + 1)),
  pr AS (SELECT name, score, CASE WHEN by_ IS NULL THEN 'retained' ELSE 'pruned' END AS status, by_ AS pruned_in_favor_of FROM wk WHERE k > 0)"""


def pruned(scores: dict[str, float | None], correlation: dict[frozenset, float], threshold: float = 0.9, conservative: bool = False, margin: float = 0.01) -> list[dict]:
    """Greedy, best score first: a candidate goes if one that stays correlates with it at the
    threshold and scores better by more than the margin. The matrix has a row a pair of names."""
    if not 0 <= threshold <= 1:
        raise ValueError("a threshold lies between 0 and 1")
    least, kept, out = 0.95 if conservative else threshold, [], []
    value = {k: float("-inf") if v is None else v for k, v in scores.items()}
    for name in sorted(scores, key=lambda x: (-value[x], x)):
        by = next((k for k in kept if correlation.get(frozenset((k, name)), 0.0) >= least and value[k] - value[name] > margin), None)
        kept += [name] if by is None else []
        out.append({"name": name, "score": scores[name], "status": "pruned" if by else "retained", "pruned_in_favor_of": by})
    return out


def active_subset(rows: list[dict], threshold: float = 0.0, most: int | None = None) -> list[str]:
    """Names that stay, best first; without a threshold those that cannot be scored stay, too."""
    score = lambda r: float("-inf") if r["score"] is None else r["score"]
    kept = sorted((r for r in rows if r["status"] == "retained"), key=lambda r: (-score(r), r["name"]))
    return [r["name"] for r in kept if threshold <= 0 or score(r) >= threshold][:most]
