"""Shared helpers of the training-data operators: shared folder, columns, spans."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII white-space characters, space and \x09 to \x0D.
WS_CHARS = " \t\n\x0b\f\r"
#: The same as a Java regular expression.
WS = r"[\x20\x09-\x0D]"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or else the
    context's checkpoint folder. Only a single-machine session that names neither gets a
    temporary folder; a cluster without one is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    set_before = context._jsc.sc().getCheckpointDir()
    if set_before.isDefined():
        return set_before.get().rstrip("/")
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="barsmith-"))
    return context._jsc.sc().getCheckpointDir().get().rstrip("/")


#: The lists of the scopes that are open where the code runs: of this thread, never of another one.
_scopes: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


def shared_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    for made in _scopes.get():
        made.append(path)
    return path


@contextlib.contextmanager
def scratch():
    """A list of the paths in the shared folder that this thread makes inside, in order."""
    made: list[str] = []
    before = _scopes.set((*_scopes.get(), made))
    try:
        yield made
    finally:
        _scopes.reset(before)


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Deletes tables that nothing reads any more, wherever the shared folder is."""
    context = spark.sparkContext
    for path in paths:
        where = context._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)


#: Rows of whole texts that go to a Python worker at once.
ARROW_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as a table in the shared folder and read again: the lineage ends there
    and a lost executor costs only a read."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, ARROW_ROWS)
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_BATCH, before)
    return spark.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Rows that a Python function turns into objects at once.
ROWS_AT_ONCE = 256


def sliced(batches):
    """Arrow batches in pieces of few rows: the rows of one piece at a time exist as Python objects,
    and results leave piece by piece."""
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS_AT_ONCE):
            yield batch.slice(start, ROWS_AT_ONCE)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def ws_words(text: Column) -> Column:
    """The maximal runs of other than white space, in order."""
    bare = F.btrim(text, F.lit(WS_CHARS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, WS + "+", -1))


def let(value: Column, use) -> Column:
    """use(value), with the value found once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


#: An array of n values is summed up in pieces of the square root of n, or of so many values.
PIECE = 64


def running(values: Column, zero: Column, merge) -> Column:
    """For each value of an array the merge (associative) of all before it, first `zero`. An array
    that grows by one is copied each time, so pieces are merged first and then each on its own:
    n values cost n to the power of 1.5 copies of a reference, a million about a second."""

    def inside(part: Column, first: Column) -> Column:
        none = F.array().cast("array<long>")
        step = lambda acc, x: F.struct(merge(acc["at"], x).alias("at"), F.concat(acc["found"], F.array(acc["at"])).alias("found"))
        return F.aggregate(part, F.struct(first.alias("at"), none.alias("found")), step, lambda acc: acc["found"])

    def whole(v: Column) -> Column:
        piece = F.greatest(F.lit(PIECE), F.ceil(F.sqrt(F.size(v))).cast("int"))
        count = F.ceil(F.size(v) / piece).cast("int")
        cut = lambda k: F.slice(v, k * piece + 1, piece)
        parts = F.when(count > 0, F.transform(F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1), cut)).otherwise(F.array().cast("array<array<long>>"))
        firsts = lambda p: inside(F.transform(p, lambda x: F.aggregate(x, zero, merge)), zero)
        return let(parts, lambda p: F.flatten(F.zip_with(p, firsts(p), inside)))

    return let(values.cast("array<long>"), whole)


#: Code points before a match that `matches` gives with it.
BEFORE = 40


def matches(text: Column, pattern: str) -> Column:
    """All leftmost non-overlapping matches of a pattern that never matches the empty string, as
    array<struct<start, end, hit, before, after>>; places are code points, the end is exclusive,
    before is what stands between the last match and this one (its last BEFORE code points), after
    the code point that follows unless the next match does. The gaps between matches (split) and
    the matches themselves (regexp_extract_all) come from the same left-to-right search, so their
    lengths add up to the places; nothing looks a place up in the text, which would cost the
    square of its matches."""
    none = F.array().cast("array<struct<start:int,end:int,hit:string,before:string,after:string>>")
    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"), F.split(text, pattern, -1).alias("gaps"))

    def placed(z: Column) -> Column:
        pairs = F.transform(z["hits"], lambda h, i: F.struct(h.alias("hit"), F.get(z["gaps"], i).alias("gap"), F.get(z["gaps"], i + 1).alias("next")))
        steps = F.transform(pairs, lambda p: F.length(p["gap"]) + F.length(p["hit"]))

        def one(p: Column, at: Column) -> Column:
            start = (at + F.length(p["gap"])).cast("int")
            end = start + F.length(p["hit"])
            before, after = F.right(p["gap"], F.lit(BEFORE)), F.left(p["next"], F.lit(1))
            return F.struct(start.alias("start"), end.alias("end"), p["hit"].alias("hit"), before.alias("before"), after.alias("after"))

        return F.zip_with(pairs, running(steps, F.lit(0).cast("long"), lambda a, x: a + x), one)

    return F.when(F.rlike(text, F.lit(pattern)), let(both, placed)).otherwise(none)


def tagged(spans: Column, kind: str, order: int) -> Column:
    """Spans as array<struct<start, order, end, kind>>, which sorts as reports need it."""
    return F.transform(
        spans,
        lambda s: F.struct(
            s["start"].alias("start"), F.lit(order).alias("order"), s["end"].alias("end"), F.lit(kind).alias("kind")
        ),
    )


def joined(spans: Column) -> Column:
    """kind:start:end of tagged spans by start, then kind, comma-joined."""
    return F.array_join(
        F.transform(F.sort_array(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )
