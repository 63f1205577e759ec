"""Formulas: vocabulary, registration, analysis, compilation and normalisation.

A formula is a postfix token program over features and operators. `compiled` analyses it and
builds only the features it names, each equal part once; the result is an expression of the
engine, hence one plan. Malformed programs give None, as the search relies on.
"""

from __future__ import annotations

import hashlib
import random
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from barsmith.functions.algebra import X
from barsmith.functions.features import FEATURES, Feature
from barsmith.operators.formula_ops import OPERATORS, REGISTERED, Operator

MAX_LENGTH = 8
NORM_BARS = 500


class RegistryError(ValueError):
    """A name or arity that cannot be registered."""


@dataclass
class Vocabulary:
    """Features first, then operators; ids follow the order of registration."""

    features: dict[str, Feature] = field(default_factory=lambda: dict(FEATURES))
    operators: dict[str, Operator] = field(default_factory=lambda: {n: OPERATORS[n] for n in REGISTERED})

    @property
    def names(self) -> list[str]:
        return [*self.features, *self.operators]

    @property
    def version(self) -> str:
        return "v" + hashlib.sha256("\n".join(self.names).encode()).hexdigest()[:12]

    def encode(self, names: Sequence[str]) -> list[int]:
        ids = {n: i for i, n in enumerate(self.names)}
        return [ids[n] for n in names]

    def decode(self, tokens: Sequence[int]) -> str:
        return " -> ".join(self.names[t] for t in tokens)

    def verify(self, version: str) -> None:
        if version != self.version:
            raise RegistryError(f"made with vocabulary {version}, this one is {self.version}")

    def _check(self, name: str) -> None:
        if not 1 <= len(name) <= 64:
            raise RegistryError("a name has 1 to 64 characters")
        if name in self.features or name in self.operators:
            raise RegistryError(f"{name} is registered")

    def register_feature(self, name: str, category: str, build: Callable, norm: bool = False) -> None:
        self._check(name)
        if not category:
            raise RegistryError("a feature has a category")
        self.features[name] = Feature(name, category, norm, build)

    def register_operator(self, name: str, arity: int, build: Callable) -> None:
        """build takes the engine and `arity` expressions."""
        self._check(name)
        if not 0 <= arity <= 10:
            raise RegistryError("an arity is 0 to 10")
        code = getattr(build, "__code__", None)
        if code is not None and code.co_argcount - len(build.__defaults__ or ()) != arity + 1 and not code.co_flags & 4:
            raise RegistryError(f"{name} takes another number of operands")
        self.operators[name] = Operator(name, arity, build)


VOCABULARY = Vocabulary()

#: Published formulas by the names of their tokens.
PUBLISHED = {
    "forex_v1": "AROON_OSC_25 TS_MIN_10 EMA_20 CS_SCALE SIGN CS_SCALE EMA_5 MOMENTUM_5",
    "forex_v2": "DMI_DIFF_14 HL_RANGE TS_MIN_20 SUB TS_MIN_20 TS_MEAN_20 CS_SCALE WMA",
    "index_v1": "PPO TS_RANK_10 TS_SUM_5 TS_RANK_10 TS_SUM_20 TS_MEAN_5 CLIP SQRT",
    "metals_v1": "CS_ZSCORE_RET20 EMA_20 TS_MAX_10 TANH_SQUASH EMA_20 AMIHUD_ILLIQ MAX MOMENTUM_5",
    "metals_v2": "SAR_DIST TREND_STRENGTH_50 TS_RANK_10 TS_MAX_20 ROLL_KURT_20 DELTA_5 TS_DECAY_EXP_5 IF_GT",
}

#: Operators whose result is never negative, that keep such a result so, and that
#: give it signs again.
POSITIVE = set("TS_RANK_5 TS_RANK_10 TS_RANK_20 ABS".split())
KEEPING = POSITIVE | set(
    "TS_SUM_5 TS_SUM_10 TS_SUM_20 TS_MEAN_5 TS_MEAN_10 TS_MEAN_20 TS_MAX_10 TS_MAX_20 CLIP SQRT POWER SIGNED_LOG SIGMOID "
    "TANH_SQUASH WINSORIZE WMA EMA_5 EMA_20 DECAY DECAY_LINEAR_5 TS_DECAY_EXP_5".split()
)
RESTORING = set(
    "SUB DIV NEG GATE IF_GT TS_ZSCORE_10 TS_ZSCORE_20 CS_NEUTRALIZE CS_RANK CS_SCALE TS_STD_5 TS_STD_10 TS_STD_20 TS_CORR_10 "
    "TS_SKEW_10 TS_QUANTILE_10 DELTA DELTA_5 MOMENTUM_5 MOMENTUM_10".split()
)


def next_chain(name: str, chain: int) -> int:
    """Length of the chain of one-signed operators after `name`; 0 if signs are free."""
    if name in POSITIVE:
        return chain + 1
    if chain and name in RESTORING:
        return 0
    return chain + 1 if chain and name in KEEPING else chain


def violations(names: Sequence[str]) -> list[str]:
    """Reasons for which a formula would only ever lean one way."""
    out, chain = [], 0
    for step, name in enumerate(names):
        if name in FEATURES:
            continue
        grown = next_chain(name, chain)
        if grown > chain and name not in POSITIVE and grown >= 3:
            out.append(f"step {step}: chain of {grown} one-signed operators")
        chain = grown
    if chain >= 2:
        out.append(f"ends in a chain of {chain} one-signed operators")
    return out


def repetition_penalty(tokens: Sequence[int]) -> float:
    return 0.3 * sum(a == b for a, b in zip(tokens, tokens[1:], strict=False))


def compiled(b, names: Sequence[str], vocabulary: Vocabulary = VOCABULARY) -> X | None:
    """The formula's value, or None if it is no program that leaves one value."""
    stack: list[X] = []
    for name in names:
        if name in vocabulary.features:
            stack.append(b.let(vocabulary.features[name].build(b)))
        elif name in vocabulary.operators:
            op = vocabulary.operators[name]
            if len(stack) < op.arity:
                return None
            args = stack[len(stack) - op.arity :]
            del stack[len(stack) - op.arity :]
            stack.append(b.let(op.build(b, *args)))
        else:
            return None
    return stack[0] if len(stack) == 1 else None


def executable(names: Sequence[str], vocabulary: Vocabulary = VOCABULARY) -> bool:
    depth = 0
    for name in names:
        if name in vocabulary.operators:
            if depth < vocabulary.operators[name].arity:
                return False
            depth -= vocabulary.operators[name].arity
        elif name not in vocabulary.features:
            return False
        depth += 1
    return depth == 1


def simplified(names: Sequence[str]) -> list[str]:
    """Equal formulas in one form: doubled NEG goes, repeated ABS and CLIP count once, and
    operators that are another's double take its name."""
    out: list[str] = []
    for name in names:
        name = {"POWER": "SIGNED_POWER_2", "TS_QUANTILE_10": "TS_RANK_10"}.get(name, name)
        if out and name == out[-1] == "NEG":
            out.pop()
        elif not (out and name == out[-1] and name in ("ABS", "CLIP")):
            out.append(name)
    return out


def normalised(b, x: X) -> X:
    """What positions are made of: the cross-section z-score with several symbols; alone, the
    expanding z-score below 500 bars and the rolling one from there on. Constant factors stay."""
    x = b.plain(x)
    cross = b.let(b.clamp((x - b.xs_mean(x)) / b.hi2(b.where(b.symbols() <= 1, 1.0, b.xs_std(x)), 1e-8), -3.0, 3.0))
    # below NORM_BARS bars the window holds all bars so far
    seen = b.lo2(b.i + 1.0, float(NORM_BARS))
    mean, square = b.let(b.rsum(x, NORM_BARS) / seen), b.let(b.rsum(x * x, NORM_BARS) / seen)
    grown = b.clamp((x - mean) / b.sqrt(b.hi2(square - mean * mean, 1e-8)), -3.0, 3.0)
    w = float(NORM_BARS)
    std = b.sqrt(b.rvar(x, NORM_BARS) * (w / (w - 1.0)))
    rolled = b.where(b.i < NORM_BARS - 1, 0.0, b.clamp((x - b.rmean(x, NORM_BARS)) / b.hi2(std, 1e-8), -3.0, 3.0))
    alone = b.where(b.at_least(NORM_BARS), rolled, grown)
    return b.where(b.constant(x), x, b.where(b.symbols() > 1, cross, alone))


class Sampler:
    """Random programs that always run: every step keeps a way to a stack of one value, and
    chains of one-signed operators end in time."""

    def __init__(self, seed: int = 0, vocabulary: Vocabulary = VOCABULARY):
        self.random, self.v = random.Random(seed), vocabulary

    def allowed(self, depth: int, step: int, steps: int, chain: int) -> list[str]:
        left = steps - step - 1
        out = []
        for name in self.v.names:
            new = depth + 1 - (self.v.operators[name].arity if name in self.v.operators else 0)
            if new < 1 or not new - 2 * left <= 1 <= new + left:
                continue
            if chain >= 2 and name in KEEPING:
                continue
            out.append(name)
        return out

    def sample(self, steps: int = MAX_LENGTH) -> list[str]:
        while True:
            depth, chain, out = 0, 0, []
            for step in range(steps):
                names = self.allowed(depth, step, steps, chain)
                if not names:
                    break
                name = self.random.choice(names)
                depth += 1 - (self.v.operators[name].arity if name in self.v.operators else 0)
                chain = next_chain(name, chain) if name in self.v.operators else chain
                out.append(name)
            if len(out) == steps and executable(out, self.v):
                return out
