"""Personal data by weak supervision.

Patterns propose candidate spans. Four labelers vote on each, 1 for personal, 0 for not, -1
for no opinion: the strict form of the kind, a gazetteer (top-level domains, calling codes,
issuer prefixes, country codes, reserved networks), the words before the span, and its
borders. All candidates of all rows are counted by kind, vote pattern and shape; that table is
bounded whatever the input, and expectation-maximisation on its votes estimates each labeler's
reliability and the share of true spans. Its posteriors train the last span classifier, a
logistic regression on votes, shape and kind that becomes one expression. Spans of the four base kinds
always stay; spans of the further kinds stay if the classifier says so.

One pass over the texts writes the candidates; the counts and the verdicts read those.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import joined, let, matches, running, stored, text_or_empty

BASE = ("email", "ip", "card", "phone")
LOCAL = "[A-Za-z0-9._%+-]"
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
#: What the gazetteer knows.
DOMAINS = "com org net edu gov int info biz io de fr es uk it nl eu us ch at be ca au jp cn in br example".split()
CALLING = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 60 61 62 63 64 65 66 81 82 84 86 90 91 92 98".split()
COUNTRIES = "AT BE CH CZ DE DK ES FI FR GB GR HU IE IT LU NL NO PL PT SE".split()
ISSUERS = "^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5)|3[068])"
#: Words before a span that speak for or against it.
FOR = "e-?mail|mail|contact|call|phone|tel|mobile|fax|card|visa|credit|account|iban|ssn|social|address|server|host|login|reach"
AGAINST = "version|isbn|serial|order|invoice|part no|build|release|section|figure|pages?"


def digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the check sum."""

    def value(i: Column) -> Column:
        d = F.substr(number, F.length(number) - i, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0))

    each = F.transform(F.sequence(F.lit(0), F.length(number) - 1), value)
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


@dataclass(frozen=True)
class Kind:
    """pattern finds candidates, linear in the text; gate is a literal that they hold; base
    says whether a candidate counts as a base span; strict and gazetteer are two voters."""

    name: str
    pattern: str
    base: object
    strict: object
    gazetteer: object
    gate: str = ""


def _between(n: Column, low: int, high: int) -> Column:
    return (n >= low) & (n <= high)


#: The patterns of the base kinds find what the contract's find: a look-behind or \G keeps a
#: search from starting inside a run, where it could only fail, and possessive repeats keep it
#: from going back into one, so long runs cost linear time and no stack.
KINDS = (
    Kind(
        "email",
        rf"(?:(?<!{LOCAL})|\G){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        lambda h: F.lit(True),
        lambda h: F.rlike(h, F.lit(r"^[A-Za-z0-9][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9-]{1,63}\.)++[A-Za-z]{2,}$")),
        lambda h: F.lower(F.regexp_extract(h, r"([^.]*)$", 1)).isin(DOMAINS),
        "@",
    ),
    Kind(
        "ip",
        r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
        lambda h: F.rlike(h, F.lit(rf"^{OCTET}(?:\.{OCTET}){{3}}$")),
        lambda h: F.rlike(h, F.lit(r"^(?:[1-9][0-9]?[0-9]?|0)(?:\.(?:[1-9][0-9]?[0-9]?|0)){3}$")),
        lambda h: ~F.rlike(h, F.lit(r"^0*(?:0|127|255)\.")),
        ".",
    ),
    Kind(
        "card",
        r"[0-9](?:[\x20-]?[0-9]){13,}+",
        lambda h: _between(F.length(digits(h)), 14, 19) & luhn(digits(h)),
        lambda h: F.rlike(h, F.lit(r"^(?:[0-9]{14,19}|[0-9]{4}(?:([\x20-])[0-9]{4})(?:\1[0-9]{4}){2}|[0-9]{4}([\x20-])[0-9]{6}\2[0-9]{5})$")),
        lambda h: F.rlike(digits(h), F.lit(ISSUERS)),
    ),
    Kind(
        "phone",
        r"\+[0-9][\x20().0-9-]+[0-9]",
        lambda h: _between(F.length(digits(h)), 10, 15),
        lambda h: F.rlike(h, F.lit(r"^\+[0-9]{1,3}(?:[\x20.-]?\(?[0-9]{2,5}\)?){2,5}$")),
        lambda h: F.rlike(h, F.lit(rf"^\+(?:{'|'.join(CALLING)})")),
        "+",
    ),
    Kind(
        "ssn",
        r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
        None,
        lambda h: F.rlike(h, F.lit(r"^[0-8][0-9]{2}-[0-9]{2}-[0-9]{4}$")),
        lambda h: ~F.rlike(h, F.lit(r"^(?:000|666|9..)-|-00-|-0000$")),
        "-",
    ),
    Kind(
        "iban",
        r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
        None,
        lambda h: _between(F.length(F.replace(h, F.lit(" "), F.lit(""))), 15, 32),
        lambda h: F.substring(h, 1, 2).isin(COUNTRIES),
    ),
    Kind(
        "local_phone",
        r"(?<![0-9+()-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[.-][0-9]{4}(?![0-9-])",
        None,
        lambda h: F.rlike(h, F.lit(r"^(?:\([0-9]{3}\) |[0-9]{3}-)[0-9]{3}-[0-9]{4}$")),
        lambda h: F.rlike(h, F.lit(r"^\(?[2-9][0-9]{2}\)?.[2-9]")),
        "-",
    ),
)
VOTERS = ("strict", "gazetteer", "context", "border")
#: What the last classifier sees besides the votes, each yes or no: the span's length and shape.
SHAPES = ("long", "parted", "spaced", "capital", "lettered", "alone")
CANDIDATE = "array<struct<start:int,order:int,end:int,kind:string,votes:array<int>,shape:array<int>,base:boolean>>"


def candidates(text: Column, kind: Kind, order: int) -> Column:
    def vote(said: Column) -> Column:
        return F.when(said, 1).otherwise(0)

    def one(s: Column) -> Column:
        hit = s["hit"]
        before = F.lower(s["before"])  # a candidate's own words end at the candidate before it
        context = (
            F.when(F.rlike(before, F.lit(rf"\b(?:{FOR})\b")), 1)
            .when(F.rlike(before, F.lit(rf"\b(?:{AGAINST})\b")), 0)
            .otherwise(-1)
        )
        around = F.concat(F.right(before, F.lit(1)), s["after"])
        border = vote(~F.rlike(around, F.lit("[0-9A-Za-z_]")))
        votes = F.array(vote(kind.strict(hit)), vote(kind.gazetteer(hit)), context, border)
        shape = F.array(
            vote(F.length(hit) > 20),
            vote(F.rlike(hit, F.lit("[.()-]"))),
            vote(F.contains(hit, F.lit(" "))),
            vote(F.rlike(hit, F.lit("^[A-Z]"))),
            vote(F.rlike(hit, F.lit("[A-Za-z]"))),
            vote(F.rlike(around, F.lit(r"^\s*+$"))),
        )
        return F.struct(
            s["start"].alias("start"),
            F.lit(order).alias("order"),
            s["end"].alias("end"),
            F.lit(kind.name).alias("kind"),
            votes.alias("votes"),
            shape.alias("shape"),
            (kind.base(hit) if kind.base else F.lit(False)).alias("base"),
        )

    found = matches(text, kind.pattern)
    if kind.base:  # a failing match of a base kind is dropped for good
        found = F.filter(found, lambda s: kind.base(s["hit"]))
    found = F.transform(found, one).cast(CANDIDATE)
    return F.when(F.contains(text, F.lit(kind.gate)), found).otherwise(F.array().cast(CANDIDATE)) if kind.gate else found


def apart(more: Column, base: Column) -> Column:
    """The spans of `more` that touch no span of `base`. Both are put in one order by start; a span
    touches one that starts no later if the largest end so far is beyond its start, and one that
    starts later if the smallest start to come is before its end. So n spans cost n log n."""
    none = F.array().cast(CANDIDATE)
    key = lambda s, rank: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s.alias("s"))
    merged = F.concat(F.transform(base, lambda s: key(s, 0)), F.transform(more, lambda s: key(s, 1)))
    far, least = F.lit(2**31).cast("long"), F.lit(-1).cast("long")

    def scanned(m: Column) -> Column:
        ends = F.transform(m, lambda x: F.when(x["rank"] == 0, x["s"]["end"].cast("long")).otherwise(least))
        starts = F.reverse(F.transform(m, lambda x: F.when(x["rank"] == 0, x["start"].cast("long")).otherwise(far)))
        before = running(ends, least, lambda a, x: F.greatest(a, x))
        after = F.reverse(running(starts, far, lambda a, x: F.least(a, x)))
        limits = F.zip_with(before, after, lambda b, a: F.struct(b.alias("b"), a.alias("a")))
        both = F.zip_with(m, limits, lambda x, z: F.struct(x.alias("x"), z.alias("z")))
        free = lambda y: (y["x"]["rank"] == 1) & (y["z"]["b"] <= y["x"]["start"]) & (y["z"]["a"] >= y["x"]["s"]["end"])
        return F.transform(F.filter(both, free), lambda y: y["x"]["s"])

    alone = F.when(F.size(base) > 0, let(F.array_sort(merged), scanned)).otherwise(more)
    return F.when(F.size(more) > 0, alone).otherwise(none)


def estimated(patterns: list[tuple[str, tuple[int, ...], int]], rounds: int = 30) -> dict[tuple, float]:
    """Expectation-maximisation over (kind, votes, count): a share of true spans for each kind
    and, for each voter, how often it votes 1 on true and on false spans, with weak priors that
    voters beat chance. Returns each pattern's posterior."""
    shares = {k: 0.7 for k, _, _ in patterns}
    rates = [[0.8, 0.3] for _ in VOTERS]
    posterior: dict[tuple, float] = {}
    for _ in range(rounds):
        for kind, votes, _ in patterns:
            like = [shares[kind], 1 - shares[kind]]
            for v, (yes, no) in zip(votes, rates, strict=True):
                if v >= 0:
                    like[0] *= yes if v else 1 - yes
                    like[1] *= no if v else 1 - no
            posterior[kind, votes] = like[0] / (like[0] + like[1])
        for kind in shares:
            own = [(posterior[k, v], n) for k, v, n in patterns if k == kind]
            shares[kind] = (sum(p * n for p, n in own) + 7) / (sum(n for _, n in own) + 10)
        for i in range(len(VOTERS)):
            told = [(posterior[k, v], n, v[i]) for k, v, n in patterns if v[i] >= 0]
            yes = (sum(p * n * x for p, n, x in told) + 8) / (sum(p * n for p, n, _ in told) + 10)
            no = (sum((1 - p) * n * x for p, n, x in told) + 3) / (sum((1 - p) * n for p, n, _ in told) + 10)
            rates[i] = [min(max(yes, 0.51), 0.99), min(max(no, 0.01), 0.49)]
    return posterior


def fitted(rows: list[tuple[str, tuple[int, ...], tuple[int, ...], int]], posterior: dict[tuple, float], steps: int = 400) -> list[float]:
    """Weights of the logistic regression on the posteriors. rows: kind, votes, shape and count. A
    pattern weighs the logarithm of its count, so that no kind drowns the others. The posterior
    knows the votes alone, so what the shape tells is learned from spans on which they agree."""
    weights = [0.0] * len(features(rows[0][0], rows[0][1], rows[0][2])) if rows else [0.0] * _WIDTH
    known = [(features(k, v, x), posterior[k, v], 1 + math.log(n)) for k, v, x, n in rows]
    total = sum(w for _, _, w in known) or 1
    for _ in range(steps):
        slope = [0.01 * w for w in weights]
        for x, y, w in known:
            p = 1 / (1 + math.exp(-sum(a * b for a, b in zip(weights, x, strict=True))))
            for i, b in enumerate(x):
                if b:
                    slope[i] += w * (p - y) * b / total
        weights = [a - g for a, g in zip(weights, slope, strict=True)]
    return weights


_WIDTH = 1 + len(VOTERS) + len(SHAPES) + len(KINDS)


def features(kind: str, votes: tuple[int, ...], shape: tuple[int, ...]) -> list[float]:
    """A constant, 1 or -1 times each vote, the shape, and the kind."""
    said = ({1: 1.0, 0: -1.0, -1: 0.0}[v] for v in votes)
    return [1.0, *said, *map(float, shape), *(float(k.name == kind) for k in KINDS)]


def classified(c: Column, weights: list[float]) -> Column:
    z, rest = F.lit(weights[0]), weights[1:]
    for i, w in enumerate(rest[: len(VOTERS)]):
        v = F.get(c["votes"], F.lit(i))
        z = z + F.when(v == 1, w).when(v == 0, -w).otherwise(0.0)
    for i, w in enumerate(rest[len(VOTERS) : len(VOTERS) + len(SHAPES)]):
        z = z + F.get(c["shape"], F.lit(i)) * w
    for kind, w in zip(KINDS, rest[len(VOTERS) + len(SHAPES) :], strict=True):
        z = z + F.when(c["kind"] == kind.name, w).otherwise(0.0)
    return 1 / (1 + F.exp(-z))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document doc_id and `found`: spans with kind, votes, shape, base flag and score.

    Null and empty texts hold nothing; null ids and repeated rows are kept as they are; an empty
    table gives an empty result; other columns are not read. Spans that start together stand in
    the order of the kinds; a score of just 0.5 counts as personal.
    """
    text = text_or_empty(text_col)
    df = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    named = [(k, candidates(F.col("text"), k, i)) for i, k in enumerate(KINDS)]
    df = df.select(
        "doc_id",
        F.concat(*[c for k, c in named if k.base]).alias("base"),
        F.concat(*[c for k, c in named if not k.base]).alias("more"),
    )
    # a further kind never reports a part of a base span again
    df = df.select("doc_id", F.concat("base", apart(F.col("more"), F.col("base"))).alias("found"))
    rows = stored(df, "pii-candidates")
    # at most kinds * 3 ** 4 * 2 ** 6 rows, whatever the input
    seen = rows.select(F.explode("found").alias("c")).groupBy("c.kind", "c.votes", "c.shape").count()
    patterns = sorted((r["kind"], tuple(r["votes"]), tuple(r["shape"]), r["count"]) for r in seen.collect())
    votes: dict[tuple, int] = {}
    for kind, said, _, n in patterns:
        votes[kind, said] = votes.get((kind, said), 0) + n
    weights = fitted(patterns, estimated([(k, v, n) for (k, v), n in sorted(votes.items())]))
    score = lambda c: c.withField("score", classified(c, weights))
    scored = F.transform("found", score)
    return rows.select("doc_id", F.filter(scored, lambda c: c["base"] | (c["score"] >= 0.5)).alias("found"))


def report(found: DataFrame) -> DataFrame:
    """Counts, digest of the base spans and all spans of each document."""
    of = lambda kind: F.filter("found", lambda s: s["kind"] == kind)
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE]
    base = joined(F.filter("found", lambda s: s["kind"].isin(*BASE)))
    return found.select("doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))
