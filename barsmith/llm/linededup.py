"""Reversible line deduplication: sharded cuckoo filters over exact reference counts.

State, all of it tables in the shared folder:

* postings: (key, doc), one row for each different key of a document, appended by `insert`;
  `delete` names documents whose postings so far no longer count; inserted again, they do. A key is
  the 128-bit hash of a stripped, lower-cased line; only keys of at least MIN_CHARS code points have
  postings.
* reference counts: (key, n documents, smallest document), a log. An insertion or deletion appends
  the new state of the keys that it touches and of no others; the latest state of a key counts.
  Counts are aggregated with a map-side combine, so a line that stands in every document crosses the
  network once a task.
* cuckoo filters: the keys with two or more references, dealt to shards by their last bytes. The
  keys that an insertion brings to two references are inserted into their shards, those that a
  deletion takes below two are removed; a shard that overflows is built anew from the counts, and
  all are dealt anew to more shards once a shard would hold more than SHARD_KEYS on average.

A decision sends only lines that pass their shard's filter to the exact table. Keys with more
references than a 1 / HOT_SHARE of all postings are joined by broadcast: there are fewer than
HOT_SHARE of them whatever the data. All other keys have a bounded number of rows each.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import WS_CHARS, partitions, sliced, stored

MIN_CHARS = 10
HOT_SHARE = 50_000
SLOTS = 4
#: Fingerprints have 16 bits: about 2 * SLOTS / 65536 of the other keys pass, and are then
#: refuted by the exact table.
MAX_KICKS = 500
#: Filters of at most so many bytes together are broadcast; larger ones meet the postings by
#: a shuffle on the shard.
BROADCAST_BYTES = 32 << 20
#: Keys of a shard, and postings that meet its filter in one task, on average.
SHARD_KEYS = 100_000
TASK_POSTINGS = 1_000_000
#: Shards are numbered by an int and told apart by four bytes, for 200 trillion keys.
MAX_SHARDS = 1 << 31
COUNTS = ("key", "n", "keeper", "before", "version")
_WS = WS_CHARS.encode()


def key_of(line: bytes) -> bytes | None:
    """The key of a line in UTF-8, or None for short ones."""
    key = line.strip(_WS).lower()  # of bytes: A-Z only
    if len(key) < MIN_CHARS or (len(key) < 4 * MIN_CHARS and len(key.decode(errors="replace")) < MIN_CHARS):
        return None
    return hashlib.blake2b(key, digest_size=16).digest()


def keys_of(batches):
    """(key, doc) of every different key of each document."""
    for batch in sliced(batches):
        keys, docs = [], []
        ids = batch.column(0).to_pylist()
        for doc, text in zip(ids, batch.column(1).to_pylist(), strict=True):
            own = {k for k in map(key_of, (text or b"").split(b"\n")) if k}
            keys.extend(own)
            docs.extend([doc] * len(own))
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(docs, pa.int64())], names=["key", "doc"])


class Cuckoo:
    """A cuckoo filter: two buckets of SLOTS 16-bit fingerprints for each key, the second place
    found from the first and the fingerprint, so that keys can be removed again."""

    def __init__(self, table: np.ndarray):
        self.table = table  # (buckets, SLOTS), buckets a power of two; 0 is free

    @staticmethod
    def parts(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprint and both buckets of keys, uint8 of shape (n, 16)."""
        words = np.ascontiguousarray(keys).view("<u8").reshape(-1, 2)
        mark = (words[:, 1] & np.uint64(0xFFFF)).astype(np.int64)
        mark += mark == 0
        first = (words[:, 0] >> np.uint64(20)).astype(np.int64) & (buckets - 1)
        return mark, first, Cuckoo.other(first, mark, buckets)

    @staticmethod
    def other(bucket, mark, buckets: int):
        return bucket ^ (((mark * 0x5BD1E995) >> 7) & (buckets - 1))

    @classmethod
    def built(cls, keys: np.ndarray) -> "Cuckoo":
        buckets = 1
        while buckets * SLOTS * 0.85 < len(keys):
            buckets *= 2
        while True:
            new = cls(np.zeros((buckets, SLOTS), np.uint16))
            if all(new.insert(keys[i : i + 1]) for i in new.bulk(keys)):
                return new
            buckets *= 2

    def bulk(self, keys: np.ndarray) -> np.ndarray:
        """Fills free first and second buckets at once; returns the keys left for kicks."""
        buckets, left = len(self.table), np.arange(len(keys))
        mark, first, second = self.parts(keys, buckets)
        for place in (first, second):
            for slot in range(SLOTS):
                at, mine = np.unique(place[left], return_index=True)
                free = self.table[at, slot] == 0
                self.table[at[free], slot] = mark[left[mine[free]]]
                left = np.delete(left, mine[free])
        return left

    def insert(self, key: np.ndarray) -> bool:
        buckets = len(self.table)
        mark, first, second = (int(x[0]) for x in self.parts(key, buckets))
        at = first
        for kick in range(MAX_KICKS):
            for place in (first, second) if kick == 0 else (at,):
                free = np.flatnonzero(self.table[place] == 0)
                if len(free):
                    self.table[place, free[0]] = mark
                    return True
            slot = (kick * 7 + at) % SLOTS
            mark, self.table[at, slot] = int(self.table[at, slot]), mark
            at = int(self.other(at, mark, buckets))
        return False

    def remove(self, key: np.ndarray) -> bool:
        mark, first, second = (int(x[0]) for x in self.parts(key, len(self.table)))
        for place in (first, second):
            held = np.flatnonzero(self.table[place] == mark)
            if len(held):
                self.table[place, held[0]] = 0
                return True
        return False

    def contains(self, keys: np.ndarray) -> np.ndarray:
        mark, first, second = self.parts(keys, len(self.table))
        m = mark[:, None]
        return (self.table[first] == m).any(1) | (self.table[second] == m).any(1)

    def packed(self) -> bytes:
        return self.table.tobytes()

    @classmethod
    def unpacked(cls, data: bytes) -> "Cuckoo":
        return cls(np.frombuffer(data, np.uint16).reshape(-1, SLOTS).copy())


def as_keys(column: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint8).reshape(-1, 16)


FILTERS = "shard int, filter binary"


def filter_of(table: pa.Table) -> pa.Table:
    """One shard's filter from its keys."""
    keys = Cuckoo.built(as_keys(table["key"].to_pylist()))
    return pa.table({"shard": table["shard"][:1], "filter": pa.array([keys.packed()], pa.binary())})


def with_keys(held: pa.Table, more: pa.Table) -> pa.Table:
    """A shard's filter with more keys; null if they do not fit."""
    if not len(held):
        return filter_of(more)
    if not len(more):
        return held
    keys, own = as_keys(more["key"].to_pylist()), Cuckoo.unpacked(held["filter"][0].as_py())
    fits = all(own.insert(keys[i : i + 1]) for i in own.bulk(keys))
    return pa.table({"shard": held["shard"], "filter": pa.array([own.packed() if fits else None], pa.binary())})


def without_keys(held: pa.Table, gone: pa.Table) -> pa.Table:
    if not len(held) or not len(gone):
        return held
    own = Cuckoo.unpacked(held["filter"][0].as_py())
    for key in gone["key"].to_pylist():
        own.remove(as_keys([key]))
    return pa.table({"shard": held["shard"], "filter": pa.array([own.packed()], pa.binary())})


def shard_of(shards: int):
    """Shard by the last four bytes of the key, which say nothing of its place and mark in a filter."""
    return (F.conv(F.hex(F.substring("key", 13, 4)), 16, 10).cast("long") % shards).cast("int").alias("shard")


class LineDedup:
    """Incremental line dedup; without `shards` their number grows with the keys."""

    def __init__(self, spark: SparkSession, shards: int | None = None):
        self.spark, self.fixed = spark, shards
        self.shards = min(shards or partitions(spark), MAX_SHARDS)
        self.batches: list[DataFrame] = []
        self.ids: list[DataFrame] = []
        self.log: list[DataFrame] = []
        self.deleted: DataFrame | None = None
        self.filters: DataFrame | None = None
        self.keys = 0  # with two or more references

    def insert(self, docs: DataFrame) -> None:
        """Adds documents (doc_id, text): appends their postings and the new counts of their keys, and
        inserts the keys that reach two references. Rows of one id, here or live already, are one
        document and count once for a key."""
        rows = docs.select(_doc(), F.col("text").cast("string").cast("binary").alias("text"))
        batch = stored(rows.mapInArrow(keys_of, "key binary, doc long"), "line-postings")
        ids = rows.groupBy("doc").agg(F.count(F.lit(1)).alias("rows"))
        ids = stored(ids, "line-ids")
        if not ids.filter("rows > 1").isEmpty():
            batch = stored(batch.distinct(), "line-postings")
        if self.batches:
            live = self._live(self.ids)
            both = ids.join(live, "doc", "left_semi").select("doc")
            if not both.isEmpty():
                held = self.postings().join(both, "doc", "left_semi")
                batch = stored(batch.join(held, ["key", "doc"], "left_anti"), "line-postings")
        self.batches.append(batch)
        self.ids.append(ids.select("doc"))
        fresh = batch.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("doc").alias("keeper"))
        if self.log:
            known = self._known(fresh.select("key"))
            fresh = fresh.join(known.select("key", F.col("n").alias("before"), F.col("keeper").alias("first")), "key", "left")
            fresh = fresh.withColumn("before", F.coalesce("before", F.lit(0).cast("long")))
            fresh = fresh.withColumn("n", F.col("n") + F.col("before")).withColumn("keeper", F.least("keeper", "first"))
        else:
            fresh = fresh.withColumn("before", F.lit(0).cast("long"))
        self._append(fresh)
        gained = self.log[-1].filter("before < 2 AND n >= 2").select("key")
        self.keys += gained.count()
        if self.filters is None or self.keys > self.shards * SHARD_KEYS and not self.fixed and self.shards < MAX_SHARDS:
            if not self.fixed:
                self.shards = min(max(self.shards, -(-2 * self.keys // SHARD_KEYS)), MAX_SHARDS)
            self.filters = self._built(self.refs().filter("n >= 2").select("key"))
            return
        both = self.filters.groupBy("shard").cogroup(gained.select(shard_of(self.shards), "key").groupBy("shard"))
        self.filters = stored(both.applyInArrow(with_keys, FILTERS), "line-filters")
        full = self.filters.filter("filter IS NULL").select("shard")
        if not full.isEmpty():
            keys = self.refs().filter("n >= 2").select(shard_of(self.shards), "key").join(full, "shard", "left_semi")
            anew = keys.groupBy("shard").applyInArrow(filter_of, FILTERS)
            self.filters = stored(self.filters.filter("filter IS NOT NULL").union(anew), "line-filters")

    def delete(self, ids: DataFrame) -> None:
        """Takes documents (a column doc_id) out again: their references no longer count, and
        keys that fall below two references leave their shard's filter. Ids that are not there, or
        an empty ledger, change nothing."""
        if not self.batches:
            return
        # batches below this number are taken out, later ones are not
        out = ids.select(_doc()).distinct()
        touched = stored(self.postings().join(out, "doc", "left_semi").select("key").distinct(), "line-touched")
        gone = out.withColumn("below", F.lit(len(self.batches)))
        gone = gone if self.deleted is None else self.deleted.union(gone)
        self.deleted = stored(gone.groupBy("doc").agg(F.max("below").alias("below")), "line-deleted")
        left = self.postings().join(touched, "key", "left_semi").groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("doc").alias("keeper"))
        known = self._known(touched).select("key", F.col("n").alias("before"))
        now = known.join(left, "key", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
        self._append(now)
        lost = self.log[-1].filter("before >= 2 AND n < 2").select("key")
        self.keys -= lost.count()
        both = self.filters.groupBy("shard").cogroup(lost.select(shard_of(self.shards), "key").groupBy("shard"))
        self.filters = stored(both.applyInArrow(without_keys, FILTERS), "line-filters")

    def _live(self, parts: list[DataFrame]) -> DataFrame:
        """Rows of tables with a column doc, one for each batch, that no deletion took out."""
        if self.deleted is not None:
            parts = [p.join(self.deleted.filter(F.col("below") > i), "doc", "left_anti").select(*p.columns) for i, p in enumerate(parts)]
        live = parts[0]
        for more in parts[1:]:
            live = live.union(more)
        return live

    def postings(self) -> DataFrame:
        return self._live(self.batches)

    def _append(self, state: DataFrame) -> None:
        state = state.withColumn("version", F.lit(len(self.log)))
        self.log.append(stored(state.select(*COUNTS), "line-references"))

    def _known(self, keys: DataFrame | None = None) -> DataFrame:
        """The latest (key, n, keeper), of some keys or of all."""
        parts = [p if keys is None else p.join(keys, "key", "left_semi") for p in self.log]
        if len(parts) == 1:
            return parts[0].select("key", "n", "keeper")
        whole = parts[0]
        for more in parts[1:]:
            whole = whole.union(more)
        last = whole.groupBy("key").agg(F.max_by(F.struct("n", "keeper"), "version").alias("last"))
        return last.select("key", "last.n", "last.keeper")

    def refs(self) -> DataFrame:
        """The exact counts: key, n, keeper."""
        return self._known()

    def _built(self, keys: DataFrame) -> DataFrame:
        dealt = keys.select(shard_of(self.shards), "key").groupBy("shard")
        return stored(dealt.applyInArrow(filter_of, FILTERS), "line-filters")

    def dropped(self) -> DataFrame:
        """(doc, key): the lines each live document loses."""
        if not self.batches:
            return self.spark.createDataFrame([], "doc long, key binary")
        rows, size = self._passing(), self.postings().count()
        hot = max(size // HOT_SHARE, 1)
        refs = self.refs().filter("n >= 2").select(F.col("key").alias("r_key"), "n", "keeper")
        found = []
        for part, small in ((refs.filter(F.col("n") > hot), True), (refs.filter(F.col("n") <= hot), False)):
            # fewer than HOT_SHARE keys can be hot
            both = rows.join(F.broadcast(part) if small else part, F.col("key") == F.col("r_key"))
            found.append(both.filter(F.col("doc") != F.col("keeper")).select("doc", "key"))
        return found[0].union(found[1])

    def _passing(self) -> DataFrame:
        """Postings whose key passes its shard's filter."""
        size = self.filters.agg(F.sum(F.length("filter"))).first()[0] or 0
        shards = self.shards
        if size <= BROADCAST_BYTES:
            held = {r["shard"]: r["filter"] for r in self.filters.collect()}  # of the size just checked
            sent = self.spark.sparkContext.broadcast(held)

            def probe(batches):
                filters = {s: Cuckoo.unpacked(f) for s, f in sent.value.items()}
                for batch in batches:
                    if batch.num_rows:
                        yield batch.filter(pa.array(passing(as_keys(batch.column(0).to_pylist()), filters, shards)))

            return self.postings().mapInArrow(probe, "key binary, doc long")

        def meet(left: pa.Table, right: pa.Table) -> pa.Table:
            if not len(right) or not len(left):
                return left.select(["key", "doc"]).slice(0, 0)
            inside = Cuckoo.unpacked(right["filter"][0].as_py()).contains(as_keys(left["key"].to_pylist()))
            return left.select(["key", "doc"]).filter(pa.array(inside))

        # a salt bounds the rows that meet a shard's filter at once: a shard gets as many copies of its
        # filter as its postings need; the counts are a row a shard
        live = self.postings().select(shard_of(shards), "key", "doc")
        salts = live.groupBy(F.col("shard").alias("s_shard")).agg(F.ceil(F.count(F.lit(1)) / TASK_POSTINGS).alias("salts"))
        salts = F.broadcast(stored(salts, "line-salts"))
        salted = live.join(salts, F.col("shard") == F.col("s_shard"))
        salted = salted.select("shard", (F.crc32(F.col("doc").cast("string").cast("binary")) % F.col("salts")).alias("salt"), "key", "doc")
        copies = self.filters.join(salts, F.col("shard") == F.col("s_shard"))
        copies = copies.select("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), "filter")
        both = salted.groupBy("shard", "salt").cogroup(copies.groupBy("shard", "salt"))
        return both.applyInArrow(meet, "key binary, doc long")


def passing(keys: np.ndarray, filters: dict[int, Cuckoo], shards: int) -> np.ndarray:
    shard = np.ascontiguousarray(keys[:, 12:]).view(">u4")[:, 0].astype(np.int64) % shards
    order = np.argsort(shard, kind="stable")
    out = np.zeros(len(keys), bool)
    borders = np.flatnonzero(np.diff(shard[order], prepend=-1, append=-1))
    for lo, hi in zip(borders[:-1], borders[1:], strict=True):
        own = order[lo:hi]
        if f := filters.get(int(shard[own[0]])):
            out[own] = f.contains(keys[own])
    return out


def _doc():
    """A null id is a document of its own, the last."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("doc")


def kept_text(batches):
    """Removes the lines whose keys are in `drops`."""
    for batch in sliced(batches):
        texts, drops = batch.column("text").to_pylist(), batch.column("drops").to_pylist()
        kept, lines, gone = [], [], []
        for text, own in zip(texts, drops, strict=True):
            parts = (text or b"").split(b"\n")
            left = parts
            if own:
                own = set(own)
                left = [x for x in parts if key_of(x) not in own]
            kept.append(b"\n".join(left))
            lines.append(len(parts))
            gone.append(len(parts) - len(left))
        rest = [batch.column(n) for n in batch.schema.names if n not in ("text", "drops")]
        names = [n for n in batch.schema.names if n not in ("text", "drops")]
        more = [pa.array(lines, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary())]
        yield pa.RecordBatch.from_arrays([*rest, *more], names=[*names, "n_lines", "n_dropped", "kept"])


def dedup(docs: DataFrame, keep: tuple[str, ...] = (), shards: int | None = None) -> DataFrame:
    """Every document without the lines that a document with a smaller id holds, too.

    Returns doc_id, n_lines, n_dropped, kept (the text) and, with `keep`, a struct `row` of the
    columns named, whatever their names. A null or empty text is one empty line; rows of one id are
    one document for the counts and are treated each, so a line that repeats inside one document or
    among rows of one id stays; a null id counts as the last document; an empty table gives an empty
    result.
    """
    spark = docs.sparkSession
    ledger = LineDedup(spark, shards)
    ledger.insert(docs)
    # one list for each document, no longer than its text
    drops = ledger.dropped().groupBy(F.col("doc").alias("d_doc")).agg(F.collect_list("key").alias("drops"))
    row = [F.struct(*[F.col(f"`{k}`") for k in keep]).alias("row")] if keep else []
    rows = docs.select("doc_id", *row, F.col("text").cast("string").cast("binary").alias("text"), _doc())
    rows = rows.join(drops.hint("shuffle_hash"), F.col("doc") == F.col("d_doc"), "left").drop("doc", "d_doc")
    out = rows.drop("doc", "d_doc", "text", "drops")
    schema = StructType([*out.schema.fields]).add("n_lines", "long").add("n_dropped", "long").add("kept", "binary")
    out = rows.select(*out.columns, "text", "drops").mapInArrow(kept_text, schema)
    return out.withColumn("kept", F.col("kept").cast("string"))


def report(deduped: DataFrame) -> DataFrame:
    return deduped.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))
