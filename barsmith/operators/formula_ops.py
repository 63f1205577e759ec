"""The formula operators: names, arities and meanings over any engine of `algebra`.

Operators see finite values and return finite values: what has no finite value becomes 0, and
what is infinite becomes 1 or -1, as `div` does. Windows count missing bars as zeros.
TS_DECAY_EXP_5 weighs the oldest bar of its window most; that is kept as specified.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from barsmith.functions.algebra import X
from barsmith.functions.features import named


@dataclass(frozen=True)
class Operator:
    name: str
    arity: int
    build: Callable
    registered: bool = True


OPERATORS: dict[str, Operator] = {}


def operator(name: str, arity: int, build: Callable, registered: bool = True) -> None:
    OPERATORS[name] = Operator(name, arity, build, registered)


def _flag(b, c: X) -> X:
    return b.where(c, 1.0, 0.0)


def _jump(b, x):
    x = b.plain(x)
    mean, square = named(b, b.cummean(x)), named(b, b.cummean(x * x))
    std = b.sqrt(b.hi2(square - mean * mean, 1e-12)) + 1e-6
    out = b.tanh((x - mean) / std - 1.5)
    return b.where((b.i < 5) & b.at_least(6), 0.0, out)


def _weighted(b, x, weights: list[float], total: float) -> X:
    """Weights from the present bar backwards."""
    x = b.plain(x)
    out = x * weights[0]
    for n, w in enumerate(weights[1:], 1):
        out = out + b.lag(x, n) * w
    return out / total


def _zscore(d: int):
    def build(b, x):
        x = b.plain(x)
        std = named(b, b.rstd(x, d) + 1e-9)
        return b.where(std < 2e-9, 0.0, (x - b.rmean(x, d)) / std)

    return build


def _skew(b, x):
    std = b.sqrt(b.rmoment(x, 10, 2)) + 1e-6
    return b.rmoment(x, 10, 3) / (std * std * std)


def _scale(b, x):
    x = b.plain(x)
    return x / (b.cumsum(b.abs(x)) + 1e-6)


def _product(b, x):
    total = b.rsum(named(b, b.log1p(b.hi2(x, -0.999))), 5)
    return b.exp(b.clamp(total, -10.0, 10.0)) - 1.0


def _square(b, x):
    x = b.plain(x)
    return b.clamp(b.sign(x) * x * x, -1e9, 1e9)


def _winsorize(b, x):
    x = b.plain(x)
    low, high = named(b, b.rquantile(x, 20, 0.05)), named(b, b.rquantile(x, 20, 0.95))
    return b.where(high - low < 1e-9, x, b.lo2(b.hi2(x, low), high))


def _cs_rank(b, x):
    n, x = b.symbols(), b.plain(x)
    return b.where(n <= 1, x, b.xs_place(x) / b.where(n <= 1, 1.0, n - 1.0))


def _cs_scale(b, x):
    n, x = b.symbols(), b.plain(x)
    low, span = b.xs_min(x), b.xs_max(x) - b.xs_min(x)
    flat = span < 1e-9
    return b.where(n <= 1, x, b.where(flat, 0.5, (x - low) / b.where(flat, 1.0, span)))


def _cs_neutralize(b, x):
    x = b.plain(x)
    return b.where(b.symbols() <= 1, x, x - b.xs_mean(x))


operator("ADD", 2, lambda b, x, y: x + y)
operator("SUB", 2, lambda b, x, y: x - y)
operator("MUL", 2, lambda b, x, y: x * y)
operator("DIV", 2, lambda b, x, y: b.div(x, y + 1e-6))
operator("NEG", 1, lambda b, x: -x)
operator("ABS", 1, lambda b, x: b.abs(x))
operator("SIGN", 1, lambda b, x: b.sign(x))
operator("GATE", 3, lambda b, c, x, y: b.where(c > 0, x, y))
operator("JUMP", 1, _jump)
operator("DECAY", 1, lambda b, x: _weighted(b, x, [1.0, 0.8, 0.6], 2.4))
operator("DELAY1", 1, lambda b, x: b.lag(x, 1))
operator("MAX3", 1, lambda b, x: b.hi2(b.hi2(x, b.lag(x, 1)), b.lag(x, 2)))
for _d in (5, 10, 20):
    operator(f"TS_MEAN_{_d}", 1, lambda b, x, d=_d: b.rmean(x, d))
for _d in (5, 10, 20):
    operator(f"TS_STD_{_d}", 1, lambda b, x, d=_d: b.rstd(x, d) + 1e-6)
for _d in (5, 10, 20):
    operator(f"TS_RANK_{_d}", 1, lambda b, x, d=_d: b.rbelow(x, d))
operator("TS_CORR_10", 2, lambda b, x, y: b.rcorr(x, y, 10))
operator("MOMENTUM_5", 1, lambda b, x: b.rmean(x, 5) - b.rmean(x, 20))
operator("MOMENTUM_10", 1, lambda b, x: b.rmean(x, 10) - b.rmean(x, 20))
operator("TS_MAX_10", 1, lambda b, x: b.rmax(x, 10))
operator("TS_MIN_10", 1, lambda b, x: b.rmin(x, 10))
operator("WMA", 1, lambda b, x: _weighted(b, x, [3.0, 2.0, 1.0], 6.0))
operator("DELAY4", 1, lambda b, x: b.lag(x, 4))
operator("EMA_5", 1, lambda b, x: b.ema(x, 5))
operator("EMA_20", 1, lambda b, x: b.ema(x, 20))
operator("TS_QUANTILE_10", 1, lambda b, x: b.rbelow(x, 10))
operator("TS_SKEW_10", 1, _skew)
operator("TS_MIN_20", 1, lambda b, x: b.rmin(x, 20))
operator("TS_MAX_20", 1, lambda b, x: b.rmax(x, 20))
operator("DELTA", 1, lambda b, x: b.change(x, 1))
operator("TS_ARG_MAX_5", 1, lambda b, x: b.rargmax(x, 5) / 4.0)
operator("TS_ARG_MIN_5", 1, lambda b, x: b.rargmin(x, 5) / 4.0)
operator("DECAY_LINEAR_5", 1, lambda b, x: _weighted(b, x, [5.0, 4.0, 3.0, 2.0, 1.0], 15.0))
operator("SCALE", 1, _scale)
operator("COVARIANCE_10", 2, lambda b, x, y: b.rcov(x, y, 10))
operator("PRODUCT_5", 1, _product)
operator("SIGNED_POWER_2", 1, _square)
operator("TS_DECAY_EXP_5", 1, lambda b, x: _weighted(b, x, [0.5**5, 0.5**4, 0.5**3, 0.5**2, 0.5], 1 - 0.5**5))
operator("DELTA_5", 1, lambda b, x: b.change(x, 5))
operator("CS_RANK", 1, _cs_rank)
operator("CS_SCALE", 1, _cs_scale)
operator("CS_NEUTRALIZE", 1, _cs_neutralize)
for _d in (5, 10, 20):
    operator(f"TS_SUM_{_d}", 1, lambda b, x, d=_d: b.rsum(x, d))
operator("MIN", 2, lambda b, x, y: b.lo2(x, y))
operator("MAX", 2, lambda b, x, y: b.hi2(x, y))
operator("POWER", 1, _square)
operator("SIGNED_LOG", 1, lambda b, x: b.sign(x) * b.log1p(b.abs(x)))
operator("SQRT", 1, lambda b, x: b.sign(x) * b.sqrt(b.abs(x)))
operator("TS_ZSCORE_10", 1, _zscore(10))
operator("TS_ZSCORE_20", 1, _zscore(20))
operator("WINSORIZE", 1, _winsorize)
operator("CLIP", 1, lambda b, x: b.clamp(x, -3.0, 3.0))
operator("SIGMOID", 1, lambda b, x: 2.0 / (1.0 + b.exp(-b.clamp(x, -700.0, 700.0))) - 1.0)
operator("TANH_SQUASH", 1, lambda b, x: b.tanh(x))
operator("IF_GT", 3, lambda b, c, x, y: b.where(c > 0, x, y))
operator("GT", 2, lambda b, x, y: _flag(b, x > y), registered=False)
operator("LT", 2, lambda b, x, y: _flag(b, x < y), registered=False)
operator("AND", 2, lambda b, x, y: _flag(b, (x > 0) & (y > 0)), registered=False)
operator("OR", 2, lambda b, x, y: _flag(b, (x > 0) | (y > 0)), registered=False)
REGISTERED = [n for n, o in OPERATORS.items() if o.registered]
