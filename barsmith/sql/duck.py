"""The SQL side, for DuckDB: the same expressions over zero-padded window lists.

Every rolling measure is stated naively on the list of the window's values with its leading
zeros, recursions fold the list of all values so far. It is slow and plain on purpose: it is
what the Spark engine is held against.
"""

from __future__ import annotations

import math

from barsmith.functions.algebra import NORM_CLIP, NORM_WINDOW, Base, X, full_window

ORDER = "PARTITION BY symbol ORDER BY bar_idx"


class Duck(Base):
    def __init__(self, panel: str):
        """panel: CTE definitions that end with one named bars."""
        super().__init__()
        self.panel = panel

    def col(self, name: str, lv: int = 0) -> X:
        return X(self, name, name, lv)

    def lit(self, v: float) -> X:
        text = f"{v!r}::DOUBLE" if math.isfinite(v) else f"'{v}'::DOUBLE"
        return X(self, f"({text})", repr(v))

    def bin(self, op: str, a: X, b: X) -> X:
        return X(self, f"({a.e} {op} {b.e})", f"({a.k} {op} {b.k})", *self.depth(a, b))

    def fn(self, name: str, *xs: X) -> X:
        return X(self, f"{name}({', '.join(x.e for x in xs)})", f"{name}({', '.join(x.k for x in xs)})", *self.depth(*xs))

    def where(self, c: X, a, b) -> X:
        a, b = self.x(a), self.x(b)
        return X(self, f"CASE WHEN {c.e} THEN {a.e} ELSE {b.e} END", f"if({c.k}, {a.k}, {b.k})", *self.depth(c, a, b))

    def _win(self, name: str, e: str, *xs: X) -> X:
        return X(self, e, f"{name}[{', '.join(x.k for x in xs)}]", self.depth(*xs)[0], True)

    def lag(self, x, n: int) -> X:
        x = self.plain(x)
        return self._win(f"lag{n}", f"lag({x.e}, {n}, 0.0) OVER ({ORDER})", x)

    def lead(self, x, n: int) -> X:
        x = self.plain(x)
        return self._win(f"lead{n}", f"lead({x.e}, {n}) OVER ({ORDER})", x)

    def _list(self, x, d: int) -> X:
        x = self.plain(x)
        real = self.let(self._win(f"real{d}", f"list({x.e}) OVER ({ORDER} ROWS BETWEEN {d - 1} PRECEDING AND CURRENT ROW)", x))
        full = f"list_concat(list_transform(range({d} - len({real.e})), lambda z: 0.0::DOUBLE), {real.e})"
        return self.let(X(self, full, f"list{d}[{x.k}]", real.lv, True))

    def _on(self, name: str, e: str, *xs: X) -> X:
        return self.let(X(self, e, f"{name}[{', '.join(x.k for x in xs)}]", self.depth(*xs)[0], True))

    def rsum(self, x, d: int) -> X:
        a = self._list(x, d)
        return self._on(f"sum{d}", f"list_sum({a.e})", a)

    def _mean(self, a: X, d: int) -> X:
        return self._on(f"mean{d}", f"list_sum({a.e}) / {d}", a)

    def rmoment(self, x, d: int, p: int) -> X:
        a = self._list(x, d)
        m = self._mean(a, d)
        return self._on(f"moment{p}", f"list_sum(list_transform({a.e}, lambda v: {' * '.join([f'(v - {m.e})'] * p)})) / {d}", a, m)

    def rvar(self, x, d: int) -> X:
        return self.rmoment(x, d, 2)

    def rcov(self, x, y, d: int) -> X:
        a, b = self._list(x, d), self._list(y, d)
        ma, mb = self._mean(a, d), self._mean(b, d)
        e = f"list_sum(list_transform(list_zip({a.e}, {b.e}), lambda z: (z[1] - {ma.e}) * (z[2] - {mb.e}))) / {d}"
        return self._on(f"cov{d}", e, a, b, ma, mb)

    def rtrend(self, x, w: int) -> X:
        a = self._list(x, w)
        return self._on(f"trend{w}", f"list_sum(list_transform({a.e}, lambda v, j: v * (j - 1 - {(w - 1) / 2})))", a)

    def rmax(self, x, d: int) -> X:
        a = self._list(x, d)
        return self._on("max", f"list_max({a.e})", a)

    def rmin(self, x, d: int) -> X:
        a = self._list(x, d)
        return self._on("min", f"list_min({a.e})", a)

    def rbelow(self, x, d: int) -> X:
        x, a = self.plain(x), self._list(x, d)
        return self._on(f"below{d}", f"len(list_filter({a.e}, lambda v: v < {x.e})) / {d}.0::DOUBLE", a, x)

    def rargmax(self, x, d: int) -> X:
        a = self._list(x, d)
        return self._on("argmax", f"(list_position({a.e}, list_max({a.e})) - 1)::DOUBLE", a)

    def rargmin(self, x, d: int) -> X:
        a = self._list(x, d)
        return self._on("argmin", f"(list_position({a.e}, list_min({a.e})) - 1)::DOUBLE", a)

    def rmad(self, x, d: int) -> X:
        a = self._list(x, d)
        m = self._mean(a, d)
        return self._on("mad", f"list_sum(list_transform({a.e}, lambda v: abs(v - {m.e}))) / {d}", a, m)

    def rautocorr(self, x, w: int, lag: int) -> X:
        a = self._list(x, w + lag)
        one = self._on("older", f"{a.e}[1:{w}]", a)
        two = self._on("newer", f"{a.e}[{lag + 1}:{w + lag}]", a)
        m1, m2 = self._mean(one, w), self._mean(two, w)
        var = lambda z, m: f"list_sum(list_transform({z.e}, lambda v: (v - {m.e}) * (v - {m.e}))) / {w}"
        cov = f"list_sum(list_transform(list_zip({one.e}, {two.e}), lambda z: (z[1] - {m1.e}) * (z[2] - {m2.e}))) / {w}"
        return self._on(f"ac{lag}", f"({cov}) / (sqrt({var(one, m1)}) * sqrt({var(two, m2)}) + 1e-8)", one, two, m1, m2)

    def rwander(self, x, w: int) -> X:
        a = self._list(x, w)
        m = self._mean(a, w)
        sums = self._on("sums", f"list_transform(range(1, {w + 1}), lambda j: list_sum(list_transform({a.e}[1:j], lambda v: v - {m.e})))", a, m)
        return self._on("wander", f"list_max({sums.e}) - list_min({sums.e})", sums)

    def rquantile(self, x, d: int, q: float) -> X:
        a = self._list(x, d)
        at = q * (d - 1)
        lo, part = int(at), at - int(at)
        s = self._on("sorted", f"list_sort({a.e})", a)
        return self._on(f"q{q}", f"{s.e}[{lo + 1}] * {1 - part!r} + {s.e}[{min(lo + 2, d)}] * {part!r}", s)

    def _so_far(self, x) -> X:
        x = self.plain(x)
        return self.let(self._win("sofar", f"list({x.e}) OVER ({ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)", x))

    def cumsum(self, x) -> X:
        x = self.plain(x)
        return self._win("cumsum", f"sum({x.e}) OVER ({ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)", x)

    def cummean(self, x) -> X:
        x = self.plain(x)
        return self._win("cummean", f"avg({x.e}) OVER ({ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)", x)

    def cummax(self, x) -> X:
        x = self.plain(x)
        return self._win("cummax", f"max({x.e}) OVER ({ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)", x)

    def last_set(self, c: X, v: X, default: float) -> X:
        c, v = self.plain(c), self.plain(v)
        e = f"last_value(CASE WHEN {c.e} THEN {v.e} END IGNORE NULLS) OVER ({ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
        return self._win("last", f"coalesce({e}, {default!r})", c, v)

    def bars(self) -> X:
        return self.let(self._win("bars", "(count(*) OVER (PARTITION BY symbol))::DOUBLE", self.i))

    def at_least(self, n: int) -> X:
        bars = self.bars()
        return self._on(f"atleast{n}", f"{bars.e} >= {n}", bars)

    def symbols(self) -> X:
        return self.let(self._win("symbols", "(count(*) OVER (PARTITION BY bar_idx))::DOUBLE", self.i))

    def whole_median(self, x) -> X:
        x = self.plain(x)
        return self.let(self._win("median", f"median({x.e}) OVER (PARTITION BY symbol)", x))

    def constant(self, x) -> X:
        x = self.plain(x)
        return self.let(self._win("constant", f"stddev_samp({x.e}) OVER () < 1e-6", x))

    def _across(self, name: str, x) -> X:
        x = self.plain(x)
        return self.let(self._win(f"x{name}", f"{name}({x.e}) OVER (PARTITION BY bar_idx)", x))

    def xs_mean(self, x) -> X:
        return self._across("avg", x)

    def xs_std(self, x) -> X:
        return self._across("stddev_samp", x)

    def xs_min(self, x) -> X:
        return self._across("min", x)

    def xs_max(self, x) -> X:
        return self._across("max", x)

    def xs_place(self, x) -> X:
        x = self.plain(x)
        return self.let(self._win("xplace", f"(row_number() OVER (PARTITION BY bar_idx ORDER BY {x.e}, symbol) - 1)::DOUBLE", x))

    def ema(self, x, span: int) -> X:
        a, alpha = self._so_far(x), 2 / (span + 1)
        return self._on(f"ema{span}", f"list_reduce({a.e}, lambda a, v: {alpha!r} * v + {1 - alpha!r} * a)", a)

    def fema(self, x, span: int) -> X:
        exact, w, alpha = self.ema(x, span), full_window(span), 2 / (span + 1)
        x = self.plain(x)
        real = self.let(self._win(f"real{w}", f"list({x.e}) OVER ({ORDER} ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)", x))
        first = self.let(self._win("first", f"first_value({x.e}) OVER ({ORDER})", x))
        bars = self.bars()
        inner = f"list_sum(list_transform({real.e}, lambda v, j: v * {alpha!r} * pow({1 - alpha!r}, len({real.e}) - j)))"
        tail = f"{first.e} * (pow({1 - alpha!r}, len({real.e})) - pow({1 - alpha!r}, {w}))"
        return self._on(f"fema{span}", f"CASE WHEN {bars.e} < {2 * w} THEN {exact.e} ELSE {inner} + {tail} END", exact, real, first, bars)

    def rn(self, x) -> X:
        x = self.plain(x)
        real = self.let(self._win("norm", f"list({x.e}) OVER ({ORDER} ROWS BETWEEN {NORM_WINDOW - 1} PRECEDING AND CURRENT ROW)", x))
        half = NORM_WINDOW // 2
        med = self._on("med", f"list_sort({real.e})[{half}]", real)
        mad = self._on("rmad", f"list_sort(list_transform({real.e}, lambda v: abs(v - {med.e})))[{half}] + 1e-6", real, med)
        bars = self.bars()
        e = f"CASE WHEN {bars.e} < {NORM_WINDOW} OR bar_idx < {NORM_WINDOW - 1} THEN 0.0 ELSE greatest(least(({x.e} - {med.e}) / {mad.e}, {NORM_CLIP}), -{NORM_CLIP}) END"
        return self._on("rn", e, x, med, mad, bars)

    def query(self, select: str, tail: str = "", **out: X) -> str:
        """SELECT `select` over the panel with the outputs as columns of a CTE named out."""
        return f"WITH {self.ctes(**out)} SELECT {select} FROM out {tail}"

    def ctes(self, **out: X) -> str:
        """The definitions up to `out`."""
        out = {n: self.let(x) for n, x in out.items()}
        parts, last = [self.panel], "bars"
        for level in sorted(self.levels):
            cols = ", ".join(f"{x.e} AS {n}" for n, x, _ in self.levels[level])
            parts.append(f"l{level} AS (SELECT *, {cols} FROM {last})")
            last = f"l{level}"
        cols = ", ".join(f"{x.e} AS {n}" for n, x in out.items())
        parts.append(f"out AS (SELECT symbol, bar_idx, time, open, high, low, close, volume, {cols} FROM {last})")
        return ", ".join(parts)
