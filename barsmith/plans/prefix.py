"""The second, smaller language: prefix programs over five features of one series.

Programs are written operator first. Features are normed by the median and the median absolute
deviation of the whole series, so they look ahead; that is how this language is specified.
"""

from __future__ import annotations

from collections.abc import Sequence

from barsmith.functions.algebra import X
from barsmith.functions.features import named

MAX_LENGTH = 12


def _returns(b) -> X:
    return named(b, b.where(b.i < 1, 0.0, (b.close - b.lag(b.close, 1)) / (b.lag(b.close, 1) + 1e-6)))


def _volume_change(b) -> X:
    mean = named(b, b.rmean(b.volume, 20))
    known = (b.i >= 19.0) & (mean > 0)
    return named(b, b.where(known, b.volume / b.where(mean > 0, mean, 1.0) - 1.0, 0.0))


def _trend(b) -> X:
    mean = named(b, b.rmean(b.close, 60))
    return b.where((b.i >= 59.0) & (mean > 0), b.close / b.where(mean > 0, mean, 1.0) - 1.0, 0.0)


def normed(b, x: X) -> X:
    x = named(b, x)
    middle = b.whole_median(x)
    spread = b.whole_median(named(b, b.abs(x - middle))) + 1e-6
    return b.clamp((x - middle) / spread, -5.0, 5.0)


FEATURES = {
    "RET": _returns,
    "RET5": lambda b: b.where(b.i < 5, 0.0, b.div(b.close, b.lag(b.close, 5)) - 1.0),
    "VOL_CHG": _volume_change,
    "V_RET": lambda b: _returns(b) * (_volume_change(b) + 1.0),
    "TREND": _trend,
}


def _zscore(b, x: X) -> X:
    """Rolling z-score by the sample deviation."""
    x = b.plain(x)
    return (x - b.rmean(x, 20)) / (b.sqrt(b.rvar(x, 20) * (20.0 / 19.0)) + 1e-6)


def _decay(b, x: X) -> X:
    x = named(b, x)
    out = x * 20.0
    for n in range(1, 20):
        out = out + b.lag(x, n) * float(20 - n)
    return out / 210.0


OPERATORS = {
    "ADD": (2, lambda b, x, y: x + y),
    "SUB": (2, lambda b, x, y: x - y),
    "MUL": (2, lambda b, x, y: x * y),
    "DIV": (2, lambda b, x, y: b.div(x, y + b.sign(y) * 1e-6)),
    "NEG": (1, lambda b, x: -x),
    "ABS": (1, lambda b, x: b.abs(x)),
    "SIGN": (1, lambda b, x: b.sign(x)),
    "DELTA5": (1, lambda b, x: b.plain(x) - b.lag(x, 5)),
    "MA20": (1, _decay),
    "STD20": (1, _zscore),
    "TS_RANK20": (1, _zscore),
}


def compiled(b, names: Sequence[str]) -> X | None:
    """The value of a prefix program, read from its end; None if it is none."""
    stack: list[X] = []
    for name in reversed(names):
        if name in FEATURES:
            stack.append(named(b, normed(b, FEATURES[name](b))))
        elif name in OPERATORS and len(stack) >= OPERATORS[name][0]:
            arity, build = OPERATORS[name]
            args = [stack.pop() for _ in range(arity)]
            stack.append(named(b, build(b, *args)))
        else:
            return None
    return stack[0] if len(stack) == 1 else None


def infix(names: Sequence[str]) -> str:
    """A program in readable form."""
    stack: list[str] = []
    for name in reversed(names):
        if name in FEATURES:
            stack.append(name)
        else:
            args = [stack.pop() for _ in range(OPERATORS[name][0])]
            sign = {"ADD": "+", "SUB": "-", "MUL": "*", "DIV": "/"}.get(name)
            stack.append(f"({args[0]} {sign} {args[1]})" if sign else f"{name}({', '.join(args)})")
    return stack[0]
