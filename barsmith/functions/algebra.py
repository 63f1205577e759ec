"""Expressions over a bar panel, and the engine that turns them into DataFrame levels.

A panel has one row for each (symbol, bar_idx). An expression `X` knows the level at which
its inputs exist and whether it holds a window function. Window functions cannot nest, so
`let` names an expression as a column of the next level; `frame` adds each level with one
select, and Spark evaluates all windows of a level that share an order in one Window node.
Expressions are named by their text, so equal parts are computed once.

All windows are ROWS frames along a symbol's bars; before the first bar there are zeros.
`Engine` states rolling measures in closed form on native aggregates of the real rows, with
the zeros accounted for, and falls back to the window's array only where order matters.
Recursions and rolling medians are the two things that neither can do in good time: those run
grouped on Arrow batches, all of a level together.

A symbol of any length is spread over tasks: bars are cut into blocks of bar_idx, the windows and
grouped functions are partitioned by (symbol, block), and a block has the last bars of the one before
it (and the first of the next, for leads) as a halo. Every expression knows how far it reaches, so
the halo is as deep as the levels on top of it need, and rows of a halo go once they have served.
What reaches back to the first bar (running sums, means, maxima, last set values) ends such a
segment: each block is summed up on its own and the results of earlier blocks, one row each, are
carried over. The exact exponential average takes a halo in which its weights fall below 2 ** -56.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barsmith.functions.ranks import quantiles
from barsmith.sources.storage import stored

EPS = 1e-9
NORM_WINDOW = 200
NORM_CLIP = 5.0
#: Bars of a symbol that one task takes, without halos. Deeper halos and longer windows raise it.
BLOCK_BARS = 1 << 16
#: The column of a row's block.
BLOCK = "bar_block"


@dataclass(frozen=True)
class X:
    b: Any = field(compare=False, repr=False)
    e: Any = field(compare=False, repr=False)
    k: str
    lv: int = 0
    win: bool = False
    back: int = field(default=0, compare=False)  # bars that its own windows reach back on and ahead to
    ahead: int = field(default=0, compare=False)

    def _op(self, op: str, other, swap: bool = False) -> "X":
        other = self.b.x(other)
        return self.b.bin(op, other, self) if swap else self.b.bin(op, self, other)

    def __add__(self, o):
        return self._op("+", o)

    def __radd__(self, o):
        return self._op("+", o, True)

    def __sub__(self, o):
        return self._op("-", o)

    def __rsub__(self, o):
        return self._op("-", o, True)

    def __mul__(self, o):
        return self._op("*", o)

    def __rmul__(self, o):
        return self._op("*", o, True)

    def __truediv__(self, o):
        return self._op("/", o)

    def __rtruediv__(self, o):
        return self._op("/", o, True)

    def __lt__(self, o):
        return self._op("<", o)

    def __gt__(self, o):
        return self._op(">", o)

    def __le__(self, o):
        return self._op("<=", o)

    def __ge__(self, o):
        return self._op(">=", o)

    def eq(self, o):
        return self._op("=", o)

    def __or__(self, o):
        return self._op("OR", o)

    def __and__(self, o):
        return self._op("AND", o)

    def __neg__(self):
        return self.b.x(0.0) - self


class Base:
    """What both engines share: scalar building blocks and measures composed from others."""

    def __init__(self):
        self.lets: dict[str, X] = {}
        self.levels: dict[int, list[tuple[str, X, tuple | None]]] = {}

    def x(self, v) -> X:
        return v if isinstance(v, X) else self.lit(float(v))

    def depth(self, *xs: X) -> tuple[int, bool, int, int]:
        """Level, whether there is a window, and the reach of expressions that stand in one."""
        reach = (max((getattr(x, side) for x in xs), default=0) for side in ("back", "ahead"))
        return max((x.lv for x in xs), default=0), any(x.win for x in xs), *reach

    def let(self, x: X, call: tuple | None = None) -> X:
        """x as a column; call asks for a grouped function in place of an expression."""
        if call is None and not x.win:
            return x
        if x.k not in self.lets:
            name = f"c{len(self.lets)}"
            self.levels.setdefault(x.lv + 1, []).append((name, x, call))
            self.lets[x.k] = self.col(name, x.lv + 1)
        return self.lets[x.k]

    def plain(self, x: X) -> X:
        """x without window functions, ready to stand inside one."""
        return self.let(self.x(x))

    open = property(lambda self: self.col("open"))
    high = property(lambda self: self.col("high"))
    low = property(lambda self: self.col("low"))
    close = property(lambda self: self.col("close"))
    volume = property(lambda self: self.col("volume"))
    i = property(lambda self: self.col("bar_idx"))

    def lo2(self, a, b) -> X:
        return self.fn("least", self.x(a), self.x(b))

    def hi2(self, a, b) -> X:
        return self.fn("greatest", self.x(a), self.x(b))

    def clamp(self, x, low: float, high: float) -> X:
        return self.hi2(self.lo2(x, high), low)

    def abs(self, x) -> X:
        return self.fn("abs", self.x(x))

    def sign(self, x) -> X:
        x = self.x(x)
        return self.where(x > 0, 1.0, self.where(x < 0, -1.0, 0.0))

    def sqrt(self, x) -> X:
        return self.fn("sqrt", self.hi2(x, 0.0))

    def ln(self, x) -> X:
        """Logarithm, 0 where it has no finite value, as cleaning would make it."""
        x = self.x(x)
        return self.where(x > 0, self.fn("ln", self.where(x > 0, x, 1.0)), 0.0)

    def log1p(self, x) -> X:
        return self.ln(self.x(x) + 1.0)

    def exp(self, x) -> X:
        return self.fn("exp", self.x(x))

    def tanh(self, x) -> X:
        return self.fn("tanh", self.x(x))

    def div(self, a, b) -> X:
        """a / b; the sign of a where b is 0, as cleaning makes of infinities."""
        a, b = self.x(a), self.x(b)
        zero = b.eq(0.0)
        return self.where(zero, self.sign(a), a / self.where(zero, 1.0, b))

    def prev(self, x, n: int = 1) -> X:
        """n bars back; the first bars keep their own value."""
        x = self.plain(x)
        return self.where(self.i < n, x, self.lag(x, n))

    def change(self, x, n: int) -> X:
        x = self.plain(x)
        return self.where(self.i < n, 0.0, x - self.lag(x, n))

    def rmean(self, x, d: int) -> X:
        return self.rsum(x, d) / d

    def rstd(self, x, d: int) -> X:
        return self.sqrt(self.rvar(x, d))

    def rcorr(self, x, y, d: int) -> X:
        x, y = self.plain(x), self.plain(y)
        sx, sy = self.let(self.rstd(x, d)), self.let(self.rstd(y, d))
        cov = self.let(self.rcov(x, y, d))
        return self.where((sx < 1e-6) | (sy < 1e-6), 0.0, cov / (sx * sy + 1e-8))

    def slope(self, x, w: int) -> X:
        """Least-squares slope over a window, per price level."""
        top, mean = self.let(self.rtrend(x, w)), self.let(self.rmean(x, w))
        return top / (w * (w * w - 1) / 12 + EPS) / (mean + EPS)

    def xs_zscore(self, x, eps: float) -> X:
        x = self.plain(x)
        return (x - self.xs_mean(x)) / (self.xs_std(x) + eps)


class Engine(Base):
    """The Spark side."""

    def __init__(self, panel: DataFrame, block: int | None = None):
        super().__init__()
        self.panel, self.block = panel, block or BLOCK_BARS
        self.w = W.partitionBy("symbol", BLOCK).orderBy("bar_idx")
        # a bar in a halo stands in two blocks, and so do the bars of all symbols at its place
        self.across = W.partitionBy("bar_idx", BLOCK)

    def over(self, d: int):
        return self.w.rowsBetween(-(d - 1), 0)

    def col(self, name: str, lv: int = 0) -> X:
        return X(self, F.col(name), name, lv)

    def lit(self, v: float) -> X:
        return X(self, F.lit(v), repr(v))

    def bin(self, op: str, a: X, b: X) -> X:
        ops = {  # at the outer end of a halo a divisor may be missing, and with it the value
            "+": Column.__add__, "-": Column.__sub__, "*": Column.__mul__, "/": F.try_divide, "<": Column.__lt__, ">": Column.__gt__,
            "<=": Column.__le__, ">=": Column.__ge__, "=": Column.__eq__, "OR": Column.__or__, "AND": Column.__and__,
        }
        return X(self, ops[op](a.e, b.e), f"({a.k} {op} {b.k})", *self.depth(a, b))

    def fn(self, name: str, *xs: X) -> X:
        return X(self, getattr(F, name)(*[x.e for x in xs]), f"{name}({', '.join(x.k for x in xs)})", *self.depth(*xs))

    def where(self, c: X, a, b) -> X:
        a, b = self.x(a), self.x(b)
        return X(self, F.when(c.e, a.e).otherwise(b.e), f"if({c.k}, {a.k}, {b.k})", *self.depth(c, a, b))

    def _win(self, name: str, e: Column, *xs: X, back: int = 0, ahead: int = 0) -> X:
        return X(self, e, f"{name}[{', '.join(x.k for x in xs)}]", self.depth(*xs)[0], True, back, ahead)

    def lag(self, x, n: int) -> X:
        x = self.plain(x)
        return self._win(f"lag{n}", F.lag(x.e, n, 0.0).over(self.w), x, back=n)

    def lead(self, x, n: int) -> X:
        x = self.plain(x)
        return self._win(f"lead{n}", F.lead(x.e, n).over(self.w), x, ahead=n)

    def at_least(self, n: int) -> X:
        """Whether the symbol has n bars or more."""
        seen = F.count(F.lit(1)).over(self.w.rowsBetween(1, n - 1))
        return self._win(f"atleast{n}", F.col("bar_idx") + 1 + seen >= n, self.i, ahead=n - 1)

    def rsum(self, x, d: int) -> X:
        x = self.plain(x)
        return self._win(f"sum{d}", F.sum(x.e).over(self.over(d)), x, back=d - 1)

    def _real(self, d: int) -> tuple[Column, Column]:
        """Real rows and zeros of a window of d."""
        n = F.least(F.col("bar_idx") + 1, F.lit(d)).cast("double")
        return n, F.lit(float(d)) - n

    def rvar(self, x, d: int) -> X:
        x, (n, k) = self.plain(x), self._real(d)
        mean, var = F.avg(x.e).over(self.over(d)), F.var_pop(x.e).over(self.over(d))
        m = n * mean / d
        return self._win(f"var{d}", (n * (var + (mean - m) * (mean - m)) + k * m * m) / d, x, back=d - 1)

    def rcov(self, x, y, d: int) -> X:
        x, y, (n, k) = self.plain(x), self.plain(y), self._real(d)
        ax, ay = F.avg(x.e).over(self.over(d)), F.avg(y.e).over(self.over(d))
        mx, my, cov = n * ax / d, n * ay / d, F.covar_pop(x.e, y.e).over(self.over(d))
        return self._win(f"cov{d}", (n * (cov + (ax - mx) * (ay - my)) + k * mx * my) / d, x, y, back=d - 1)

    def rtrend(self, x, w: int) -> X:
        """Sum of x times centred place over the window."""
        x = self.plain(x)
        place = F.col("bar_idx").cast("double")
        total = F.sum(x.e * place).over(self.over(w)) - (place - (w - 1) / 2) * F.sum(x.e).over(self.over(w))
        return self._win(f"trend{w}", total, x, back=w - 1)

    def rmax(self, x, d: int) -> X:
        x = self.plain(x)
        m = F.max(x.e).over(self.over(d))
        return self._win(f"max{d}", F.when(F.col("bar_idx") < d - 1, F.greatest(m, F.lit(0.0))).otherwise(m), x, back=d - 1)

    def rmin(self, x, d: int) -> X:
        x = self.plain(x)
        m = F.min(x.e).over(self.over(d))
        return self._win(f"min{d}", F.when(F.col("bar_idx") < d - 1, F.least(m, F.lit(0.0))).otherwise(m), x, back=d - 1)

    def _array(self, x: X, d: int) -> X:
        """The window with its zeros, oldest first, as a column."""
        real = F.collect_list(x.e).over(self.over(d))
        return self.let(self._win(f"list{d}", F.concat(F.array_repeat(F.lit(0.0), d - F.size(real)), real), x, back=d - 1))

    def _of(self, name: str, a: X, e: Column, *xs: X) -> X:
        # named at once, so that no array lives longer than a level
        return self.let(X(self, e, f"{name}<{', '.join(x.k for x in (a, *xs))}>", self.depth(a, *xs)[0], True))

    def rbelow(self, x, d: int) -> X:
        """Share of the window strictly below the present value."""
        x = self.plain(x)
        a = self._array(x, d)
        return self._of(f"below{d}", a, F.size(F.filter(a.e, lambda v: v < x.e)) / F.lit(float(d)), x)

    def rargmax(self, x, d: int) -> X:
        a = self._array(self.plain(x), d)
        return self._of("argmax", a, (F.array_position(a.e, F.array_max(a.e)) - 1).cast("double"))

    def rargmin(self, x, d: int) -> X:
        a = self._array(self.plain(x), d)
        return self._of("argmin", a, (F.array_position(a.e, F.array_min(a.e)) - 1).cast("double"))

    def _fold(self, a: Column, f) -> Column:
        return F.aggregate(a, F.lit(0.0), lambda s, v: s + f(v))

    def rmoment(self, x, d: int, p: int) -> X:
        """Central moment of order p."""
        a = self._array(self.plain(x), d)
        m = self.let(X(self, self._fold(a.e, lambda v: v) / d, f"mean<{a.k}>", a.lv, True))
        power = lambda v: (v - m.e) * (v - m.e) if p == 2 else (v - m.e) * power_of(v - m.e, p - 1)
        return self._of(f"moment{p}", a, self._fold(a.e, power) / d, m)

    def rmad(self, x, d: int) -> X:
        """Mean absolute deviation."""
        a = self._array(self.plain(x), d)
        m = self.let(X(self, self._fold(a.e, lambda v: v) / d, f"mean<{a.k}>", a.lv, True))
        return self._of("mad", a, self._fold(a.e, lambda v: F.abs(v - m.e)) / d, m)

    def rautocorr(self, x, w: int, lag: int) -> X:
        """Correlation of the window of w with the one `lag` bars earlier."""
        x = self.plain(x)
        back = self.let(self.lag(x, lag))
        sx, sy = self.let(self.rvar(back, w)), self.let(self.rvar(x, w))
        return self.let(self.rcov(back, x, w)) / (self.sqrt(sx) * self.sqrt(sy) + 1e-8)

    def rwander(self, x, w: int) -> X:
        """Range of the running sums of deviations from the window's mean."""
        a = self._array(self.plain(x), w)
        m = self.let(X(self, self._fold(a.e, lambda v: v) / w, f"mean<{a.k}>", a.lv, True))
        start = F.struct(F.lit(0.0).alias("s"), F.lit(-math.inf).alias("hi"), F.lit(math.inf).alias("lo"))

        def step(acc, v):
            s = acc["s"] + (v - m.e)
            return F.struct(s.alias("s"), F.greatest(acc["hi"], s).alias("hi"), F.least(acc["lo"], s).alias("lo"))

        return self._of("wander", a, F.aggregate(a.e, start, step, lambda z: z["hi"] - z["lo"]), m)

    def rquantile(self, x, d: int, q: float) -> X:
        """Linear-interpolated quantile of the window."""
        a = self._array(self.plain(x), d)
        at = q * (d - 1)
        lo, part = int(at), at - int(at)
        s = F.sort_array(a.e)
        return self._of(f"q{q}", a, F.get(s, F.lit(lo)) * (1 - part) + F.get(s, F.lit(min(lo + 1, d - 1))) * part)

    def _carried(self, kind: str, x, more: float = 0.0) -> X:
        """x as a column under something that reaches back to the first bar; see `carried`."""
        x = self._named(x)
        return self.let(X(self, None, f"{kind}{more or ''}[{x.k}]", x.lv, True), (kind, x.k, more))

    def cumsum(self, x) -> X:
        return self._carried("cumsum", x)

    def cummean(self, x) -> X:
        return self._carried("cummean", x)

    def cummax(self, x) -> X:
        return self._carried("cummax", x)

    def last_set(self, c: X, v: X, default: float) -> X:
        """The value of v at the last bar so far where c holds."""
        c, v = self.plain(c), self.plain(v)
        return self._carried("last", X(self, F.when(c.e, v.e), f"set({c.k}, {v.k})", self.depth(c, v)[0], True), default)

    def bars(self) -> X:
        return self._carried("bars", self.i)

    def symbols(self) -> X:
        return self.let(self._win("symbols", F.count(F.lit(1)).over(self.across).cast("double"), self.i))

    def whole_median(self, x) -> X:
        """The median of a symbol's whole series (it looks ahead)."""
        return self._carried("median", x)

    def constant(self, x) -> X:
        """Whether the factor hardly varies over all bars of all symbols; a count, a sum and a
        sum of squares for each symbol meet in one row."""
        x = self._named(x)
        return self.let(X(self, None, f"constant[{x.k}]", x.lv, True), ("constant", x.k, 0))

    def _across(self, name: str, f, x) -> X:
        x = self.plain(x)
        return self.let(self._win(name, f(x.e).over(self.across), x))

    def xs_mean(self, x) -> X:
        return self._across("xmean", F.avg, x)

    def xs_std(self, x) -> X:
        return self._across("xstd", lambda e: F.stddev_samp(e), x)

    def xs_min(self, x) -> X:
        return self._across("xmin", F.min, x)

    def xs_max(self, x) -> X:
        return self._across("xmax", F.max, x)

    def xs_place(self, x) -> X:
        """Ordinal place in the cross-section from 0; ties by symbol."""
        x = self.plain(x)
        order = self.across.orderBy(x.e, "symbol")
        return self.let(self._win("xplace", (F.row_number().over(order) - 1).cast("double"), x))

    def _named(self, x) -> X:
        """x as a column, for functions that take their input by name."""
        x = self.x(x)
        return x if x.k.isidentifier() else self.let(replace(x, win=True))

    def ema(self, x, span: int) -> X:
        """The exact recursion, from the first value on."""
        x = self._named(x)
        return self.let(X(self, None, f"ema{span}[{x.k}]", x.lv, True, fading(span)), ("ema", x.k, span))

    def fema(self, x, span: int) -> X:
        """The features' average: the recursion on short series, else cut off where its weights
        fall below a millionth, with the first value in place of missing ones."""
        x = self._named(x)
        return self.let(X(self, None, f"fema{span}[{x.k}]", x.lv, True, full_window(span) - 1), ("fema", x.k, span))

    def rn(self, x) -> X:
        """The rolling robust norm."""
        x = self._named(x)
        return self.let(X(self, None, f"rn[{x.k}]", x.lv, True, NORM_WINDOW - 1), ("rn", x.k, NORM_WINDOW))

    def _segments(self, out: dict[str, X]) -> list[Segment]:
        """The levels in runs of finite reach. A run ends with the level that has something to carry, and
        the last one takes the grouped functions that only outputs read, in one pass."""
        found, late, reach = [Segment()], [], {}
        for level in sorted(self.levels):
            run, inner = found[-1], self._live(level, {})
            items: list[tuple[str, X, tuple | None]] = []
            for name, x, call in self.levels[level]:
                if call is not None and call[0] in CARRIED:
                    run.carry.append((name, call))
                elif call is not None and name not in inner:
                    late.append((name, x, call))
                else:
                    items.append((name, x, call))
            run.add(level, items, reach)
            if run.carry:
                found.append(Segment())
                reach = {}  # from here on what there is was found on whole bars
        found[-1].add(max(self.levels, default=0) + 1, late, reach)
        return found

    def frame(self, **out: X) -> DataFrame:
        """The panel with the outputs as further columns."""
        out = {n: self.let(x) for n, x in out.items()}
        had, segments = [*self.panel.columns, BLOCK], self._segments(out)
        late = {call[1] for _, _, call in segments[-1].levels[-1][1]}
        spans = [call[2] for _, named in segments_levels(segments) for _, _, call in named if call and call[0] == "fema"]
        size = max([self.block, *[2 * max(s.back, s.ahead) for s in segments], *[2 * full_window(n) for n in spans]])
        own = F.floor(F.col("bar_idx") / size).cast("int")
        df = self.panel.withColumn(BLOCK, own)
        for run in segments:
            if run.back or run.ahead:
                df = df.withColumn(BLOCK, F.explode(run.blocks(size)))
            for level, named in run.levels:
                plain = [(n, x) for n, x, call in named if call is None]
                calls = [(n, call) for n, _, call in named if call is not None]
                live = self._live(level, out) | late | {call[1] for _, call in run.carry}
                if plain:
                    df = df.select("*", *[x.e.alias(n) for n, x in plain])
                if calls:
                    # only what this level or a later one reads goes through the grouped function
                    reads = live | {call[1] for _, call in calls}
                    df = grouped(df.select(*[c for c in df.columns if c in had or c in reads]), calls)
                df = df.select(*[c for c in df.columns if c in had or c in live])
            if run.back or run.ahead:
                df = df.filter(F.col(BLOCK) == own)
            if run.carry:
                df = carried(df, run.carry)
        return df.select(*self.panel.columns, *[x.e.alias(n) for n, x in out.items()])

    def _live(self, level: int, out: dict[str, X]) -> set[str]:
        """Columns that levels after this one or the outputs read."""
        later = [x.k for lv, named in self.levels.items() if lv > level for _, x, _ in named]
        return set(re.findall(r"\bc\d+\b", " ".join([*later, *(x.k for x in out.values())])))


@dataclass
class Segment:
    """Levels that one halo serves, how far they reach together, and what is carried at their end."""

    levels: list[tuple[int, list]] = field(default_factory=list)
    carry: list[tuple[str, tuple]] = field(default_factory=list)
    back: int = 0
    ahead: int = 0

    def add(self, level: int, items: list, reach: dict[str, tuple[int, int]]) -> None:
        """reach: how far each column of the segment reaches from its bar, in all."""
        for name, x, _ in items:
            deps = [reach.get(c, (0, 0)) for c in re.findall(r"\bc\d+\b", x.k)]
            back, ahead = (mine + max((d[k] for d in deps), default=0) for k, mine in enumerate((x.back, x.ahead)))
            reach[name] = back, ahead
            self.back, self.ahead = max(self.back, back), max(self.ahead, ahead)
        self.levels.append((level, items))

    def blocks(self, size: int) -> Column:
        """The blocks that a bar belongs to: its own and the ones whose halo it is in."""
        place, own = F.col("bar_idx") % size, F.col(BLOCK)
        none = F.array().cast("array<int>")
        after = F.when(place >= size - self.back, F.array(own + 1)).otherwise(none)
        before = F.when((place < self.ahead) & (own > 0), F.array(own - 1)).otherwise(none)
        return F.concat(F.array(own), after, before)


def segments_levels(segments: list[Segment]) -> list[tuple[int, list]]:
    return [level for s in segments for level in s.levels]


#: Kinds of calls that need more than a bounded number of bars.
CARRIED = ("constant", "cumsum", "cummean", "cummax", "last", "bars", "median")


def carried(df: DataFrame, calls: list[tuple[str, tuple]]) -> DataFrame:
    """Adds what reaches beyond any halo; df has each bar once. A block is summed up on its own, and what
    earlier blocks come to, a row each, is added to the running values inside it."""
    if any(kind != "bars" for _, (kind, _, _) in calls):
        df = stored(df, "panel")  # read by the sums of blocks and by what follows
    parts, adds, sums = [], {}, {}
    inside = W.partitionBy("symbol", BLOCK).orderBy("bar_idx").rowsBetween(W.unboundedPreceding, 0)
    earlier = W.partitionBy("symbol").orderBy(BLOCK).rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy("symbol")
    for name, (kind, source, more) in calls:
        part, x = f"{name}_part", F.col(source)
        if kind in ("cumsum", "cummean"):
            parts += [F.sum(x).alias(part), F.count(x).alias(f"{part}_n")]
            sums |= {part: F.coalesce(F.sum(part).over(earlier), F.lit(0.0)), f"{part}_n": F.coalesce(F.sum(f"{part}_n").over(earlier), F.lit(0))}
            total = F.col(part) + F.sum(x).over(inside)
            adds[name] = total if kind == "cumsum" else total / (F.col(f"{part}_n") + F.count(x).over(inside))
        elif kind == "cummax":
            parts.append(F.max(x).alias(part))
            sums[part] = F.max(part).over(earlier)
            adds[name] = F.greatest(F.col(part), F.max(x).over(inside))
        elif kind == "last":
            parts.append(F.max_by(x, F.when(x.isNotNull(), F.col("bar_idx"))).alias(part))
            sums[part] = F.last(part, ignorenulls=True).over(earlier)
            adds[name] = F.coalesce(F.last(x, ignorenulls=True).over(inside), F.col(part), F.lit(more))
        elif kind == "bars":
            parts.append(F.count(F.lit(1)).alias(part))
            sums[part] = F.sum(part).over(whole)
            adds[name] = F.col(part).cast("double")
    if parts:
        keys = ["symbol", BLOCK]
        carry = df.groupBy(*keys).agg(*parts).select(*keys, *[c.alias(n) for n, c in sums.items()])
        columns = df.columns
        df = df.join(carry, keys).select(*columns, *[c.alias(n) for n, c in adds.items()])
    for name, (kind, source, _) in calls:
        if kind == "constant":
            df = df.join(F.broadcast(df.agg((F.stddev_samp(source) < 1e-6).alias(name))))  # one row
    medians = {name: source for name, (kind, source, _) in calls if kind == "median"}
    if medians:
        each = ", ".join(f"'{n}', {c}" for n, c in medians.items())
        long = df.selectExpr("symbol", f"stack({len(medians)}, {each}) AS (median_of, v)")
        found = quantiles(long, ["symbol", "median_of"], "v", {"q": 0.5}).groupBy("symbol")
        found = found.agg(*[F.max(F.when(F.col("median_of") == n, F.col("q"))).alias(n) for n in medians])
        df = df.join(found, "symbol")
    return df


def power_of(v: Column, p: int) -> Column:
    out = v
    for _ in range(p - 1):
        out = out * v
    return out


def fading(span: int) -> int:
    """Bars after which the weight of an exact average is below 2 ** -56."""
    return math.ceil(-56 * math.log(2) / math.log(1 - 2 / (span + 1)))


def full_window(span: int) -> int:
    """Bars after which the weight of a feature average is below one millionth."""
    return max(1, math.ceil(math.log(1e-6) / math.log(1 - 2 / (span + 1))))


def exact_average(x, span: int, last: float | None):
    """The recursion from the value before x on, or from the first value."""
    import numpy as np

    a, out = 2 / (span + 1), np.empty(len(x))
    for t, v in enumerate(x.tolist()):
        last = v if last is None else a * v + (1 - a) * last
        out[t] = last
    return out


def robust_norm(x, w: int):
    """Values by median and median deviation of the w up to each, from the w-th on."""
    import numpy as np

    half, parts = (w - 1) // 2, []  # the lower of two middles
    for lo in range(0, max(len(x) - w + 1, 0), 4096):
        v = np.lib.stride_tricks.sliding_window_view(x[lo : lo + 4096 + w - 1], w)
        med = np.partition(v, half, 1)[:, half]
        mad = np.partition(np.abs(v - med[:, None]), half, 1)[:, half] + 1e-6
        parts.append(np.clip((v[:, -1] - med) / mad, -NORM_CLIP, NORM_CLIP))
    return np.concatenate(parts) if parts else np.zeros(0)


class Along:
    """One recursion along a symbol that comes in pieces: it keeps the last value, or as many values
    as a window looks back on, and gives what the whole series at once would give."""

    def __init__(self, kind: str, size: int):
        self.kind, self.size, self.last, self.past, self.seen = kind, size, None, None, 0
        self.inside = False  # whether the pieces start within a halo and not with the first bar

    @property
    def needs(self) -> int:
        """Values to wait for: a features' average cuts off only on series twice its window long."""
        return 2 * full_window(self.size) if self.kind == "fema" else 1

    def feed(self, x):
        import numpy as np

        if self.kind == "fema" and self.seen == 0 and len(x) < self.needs and not self.inside:
            self.kind = "ema"  # the whole series is here, and short
        if not len(x):
            return x
        if self.kind == "ema":
            out = exact_average(x, self.size, self.last)
            self.last = out[-1]
        else:
            w = self.size if self.kind == "rn" else full_window(self.size)
            if self.past is None:
                self.past = np.zeros(0) if self.kind == "rn" else np.full(w - 1, x[0])
            whole = np.r_[self.past, x]
            if self.kind == "rn":
                found = robust_norm(whole, w)
                out = np.r_[np.zeros(len(x) - min(len(found), len(x))), found[max(len(found) - len(x), 0) :]]
            else:
                a = 2 / (self.size + 1)
                out = np.convolve(whole, a * (1 - a) ** np.arange(w), "valid")
            self.past = whole[max(len(whole) - (w - 1), 0) :]
        self.seen += len(x)
        return out


def grouped(df: DataFrame, calls: list[tuple[str, tuple]]) -> DataFrame:
    """Adds recursive averages and rolling robust norms. The bars of a symbol and block stream through in
    order, a batch at a time, and need the memory of a few batches. The row
    number's window leaves the bars in that order on the exchange that windows share."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        state = [Along(kind, size) for _, (kind, _, size) in calls]
        needs, waiting, rows, before = max(s.needs for s in state), [], 0, None

        def out(parts):
            nonlocal before
            for table in pa.Table.from_batches(parts).combine_chunks().to_batches():
                at = table.column("bar_idx").to_numpy()
                if before is None and at[0] > 0:
                    for s in state:
                        s.inside = True
                if before is not None and at[0] <= before or len(at) > 1 and (np.diff(at) <= 0).any():
                    raise ValueError("bars of a symbol came out of order")
                before = at[-1]
                columns = list(table.columns[:-1])
                for (_, (_, source, _)), s in zip(calls, state, strict=True):
                    x = np.ascontiguousarray(table.column(source).to_numpy(zero_copy_only=False), float)
                    columns.append(pa.array(s.feed(x), pa.float64()))
                yield pa.RecordBatch.from_arrays(columns, names=[*table.schema.names[:-1], *[n for n, _ in calls]])

        for batch in batches:
            if not batch.num_rows:
                continue
            waiting, rows = [*waiting, batch], rows + batch.num_rows
            if rows >= needs:
                yield from out(waiting)
                waiting, needs = [], 1
                rows = 0
        if waiting:
            yield from out(waiting)

    run.__annotations__ = {"batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    more = [T.StructField(name, T.DoubleType()) for name, _ in calls]
    place = F.row_number().over(W.partitionBy("symbol", BLOCK).orderBy("bar_idx"))
    schema = T.StructType([*df.schema.fields, *more])
    return df.withColumn("bar_place", place).groupBy("symbol", BLOCK).applyInArrow(run, schema)
