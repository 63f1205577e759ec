"""Secret scans over an incremental blob ledger.

Every historical version of every path is content-addressed by SHA-256. The ledger is a
folder of Parquet batches; a row says which rule versions a blob has been scanned with and
what they found. An update scans, of the blobs at hand, only the pairs of blob and rule
version that the ledger lacks, appends them, and joins the findings back to all paths, so
copies and renames cost one scan together and a changed rule rescans with that rule only.

Copies of a blob meet in a map-side combined aggregation, so a text that a third of all
paths hold crosses the network once a map task. Only ids, addresses and findings are joined.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import joined, matches, shared_path, tagged, text_or_empty


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of `pattern`; a match for which `valid` does not hold
    fails and is dropped, without another try inside it. `gate` are literals of which a text
    with a match holds one. `revision` is raised when `valid` changes."""

    name: str
    pattern: str
    valid: Callable[[Column], Column] | None = None
    gate: tuple[str, ...] = ()
    revision: int = 1

    @property
    def version(self) -> str:
        return f"{self.name}@{self.revision}-{hashlib.sha256(self.pattern.encode()).hexdigest()[:8]}"


def either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


KEYWORDS = "|".join(
    [*(either_case(w) for w in ("password", "passwd", "secret", "token")), either_case("api") + "_?" + either_case("key")]
)
#: Characters of the parts of a web token.
WEB = "[A-Za-z0-9_-]"
ASSIGN_HEAD = rf"""(?:{KEYWORDS})["']?\x20*[:=]\x20*["']?"""
#: Base rules first, in the order in which reports list them; then the rules that this
#: library adds: key blocks, web tokens, prefixed service tokens and passwords in addresses.
RULES = (
    Rule(
        "assign",
        ASSIGN_HEAD + "[A-Za-z0-9+/_.=-]+",
        lambda hit: F.length(F.regexp_replace(hit, "^" + ASSIGN_HEAD, "")) >= 6,
    ),
    Rule("access", "AKIA[A-Z0-9]+", lambda hit: F.length(hit) >= 20, ("AKIA",)),
    Rule("hex", "[0-9a-f]{24,}"),
    # no length is bounded from above: possessive repeats over characters that cannot start another
    # match, or a border before the match, keep a search linear however long a run is
    Rule("pem", "-----BEGIN [A-Z ]*+(?<=PRIVATE KEY)-----", gate=("PRIVATE KEY-----",)),
    Rule("jwt", rf"(?<!{WEB})eyJ{WEB}{{8,}}+\.eyJ{WEB}{{8,}}+\.{WEB}{{8,}}+", gate=("eyJ",)),
    Rule(
        "prefixed",
        r"(?:gh[pousr]_[A-Za-z0-9]{36,}+|github_pat_[A-Za-z0-9_]{22,}+|xox[abprs]-[A-Za-z0-9-]{10,}+|AIza[A-Za-z0-9_-]{35,}+)",
        gate=("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "xox", "AIza"),
    ),
    Rule("address", r"://[A-Za-z0-9._~-]*+:[^\x00-\x20/@:]{3,}+@", gate=("://",)),
)
BASE = ("assign", "access", "hex")

FOUND = "array<struct<start:int,order:int,end:int,kind:string>>"
SPANS = "array<struct<version:string,start:int,end:int>>"
LEDGER = f"blob string, scanned array<string>, spans {SPANS}"


def findings(text: Column, rule: Rule) -> Column:
    """The rule's valid spans in a text, with its version."""
    spans = matches(text, rule.pattern)
    if rule.valid is not None:
        spans = F.filter(spans, lambda s: rule.valid(s["hit"]))
    spans = F.transform(spans, lambda s: F.struct(F.lit(rule.version).alias("version"), s["start"].alias("start"), s["end"].alias("end")))
    if not rule.gate:
        return spans
    gate = F.lit(False)
    for literal in rule.gate:
        gate = gate | F.contains(text, F.lit(literal))
    return F.when(gate, spans).otherwise(F.array().cast(SPANS))


class SecretLedger:
    """A ledger kept at `path`; without a path a new one in the shared folder."""

    def __init__(self, spark: SparkSession, path: str | None = None, rules: tuple[Rule, ...] = RULES):
        self.spark, self.rules, self.started = spark, rules, path is not None
        self.path = path or shared_path(spark, "secret-ledger")

    def read(self) -> DataFrame | None:
        """All batches so far; None before the first."""
        if not self.started:
            return None
        try:
            return self.spark.read.schema(LEDGER).option("recursiveFileLookup", "true").parquet(self.path)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return None

    def update(self, versions: DataFrame, text_col: str = "text") -> DataFrame:
        """Scans what is new among `versions` (a row for each path and version; any columns)
        and returns every row of it without the text, with its address `blob` and `found`.

        A null text is the empty blob; repeated rows return once each; an empty table leaves
        the ledger as it is. Rows of `versions` named blob or found are replaced, other columns
        may have any name. Spans of one kind never overlap, so there are no ties to break; of two
        kinds that start together the rule listed first comes first. Findings of rule versions
        that this ledger's rules no longer have are not reported, and those that two updates at
        once have both written count once.
        """
        text = text_or_empty(text_col)
        kept = [F.col(f"`{c}`") for c in versions.columns if c not in (text_col, "blob", "found")]
        # the ids need only the address, the scan only one copy of each text; a struct keeps the
        # caller's columns apart from those here
        rows = versions.select(F.sha2(text, 256).alias("blob"), F.struct(*(kept or [F.lit(0)])).alias("row"))
        blobs = versions.select(F.sha2(text, 256).alias("blob"), text.alias("text")).dropDuplicates(["blob"])
        ledger, current = self.read(), {r.version: r for r in self.rules}
        if ledger is not None:
            seen = ledger.groupBy(F.col("blob").alias("l_blob")).agg(F.flatten(F.collect_list("scanned")).alias("seen"))
            blobs = blobs.join(seen, F.col("blob") == F.col("l_blob"), "left").drop("l_blob")
            blobs = blobs.withColumn("seen", F.coalesce("seen", F.array().cast("array<string>")))
            todo = F.array_except(F.array(*map(F.lit, current)), F.col("seen"))
        else:
            todo = F.array(*map(F.lit, current))
        blobs = blobs.withColumn("scanned", todo).filter(F.size("scanned") > 0)
        parts = []
        for version, rule in current.items():
            part = findings(F.col("text"), rule)
            parts.append(part if ledger is None else F.when(F.array_contains("scanned", version), part).otherwise(F.array().cast(SPANS)))
        batch = blobs.select("blob", "scanned", F.concat(*parts).alias("spans"))
        batch.write.mode("append").parquet(f"{self.path}/batch={uuid.uuid4().hex}")
        self.started = True
        known = self.read().filter(F.size("spans") > 0).groupBy(F.col("blob").alias("f_blob"))
        known = known.agg(F.collect_list(F.struct("scanned", "spans")).alias("batches"))

        # a batch row holds all spans of its versions, so of two with one version either will do
        def once(row: Column, i: Column) -> Column:
            earlier = F.slice("batches", F.lit(1), i)
            said = lambda s: F.exists(earlier, lambda y: F.array_contains(y["scanned"], s["version"]))
            return F.filter(row["spans"], lambda s: ~said(s))

        known = known.select("f_blob", F.flatten(F.transform("batches", once)).alias("spans"))

        def found_by(version: str) -> Column:
            return F.filter("spans", lambda s: s["version"] == version)

        of = [tagged(found_by(version), rule.name, order) for order, (version, rule) in enumerate(current.items())]
        known = known.select("f_blob", F.sort_array(F.concat(*of)).alias("found"))
        out = rows.join(known, F.col("blob") == F.col("f_blob"), "left")
        row = [F.col(f"row.`{c}`") for c in versions.columns if c not in (text_col, "blob", "found")]
        return out.select(*row, "blob", F.coalesce("found", F.array().cast(FOUND)).alias("found"))


def report(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts, digest of the base spans and all spans of each row of an update."""
    of = lambda kind: F.filter("found", lambda s: s["kind"] == kind)
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE]
    base = joined(F.filter("found", lambda s: s["kind"].isin(*BASE)))
    return found.select(
        F.col(id_col).alias("doc_id"), *counts, F.sha2(base, 256).alias("base_sha256"), joined(F.col("found")).alias("spans")
    )
