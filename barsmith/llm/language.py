"""Language identification by prediction by partial matching on bytes.

For each language a tree of byte contexts up to `order` bytes is counted over labelled texts.
A byte's probability in a context is its count there over count plus number of different
bytes, or else an escape (number of different bytes over the same sum) to the context that is a
byte shorter, whose probabilities are renormalised over the bytes not yet excluded; below the
empty context all bytes are alike. The statistics are frozen before scoring, so the code length of
a byte is a fixed function of it and its longest known context: the tree of each language is
laid out as a table (context, byte) of code lengths, in integer units of
1 / 4096 bit, and a text's exact code length in every language is a sum of table cells.

The model is fitted on a bounded sample of labelled texts, `sample` per language in
expectation, chosen by a hash of the id; of long texts, blocks are taken. Every label takes part,
so the size is bounded by the number of languages and may be broadcast. Every
text is then scored whole, in blocks of bytes, in one narrow pass without a shuffle.
"""

from __future__ import annotations

import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import sliced

ORDER = 3
#: Expected number of sampled texts for each language: the documented bound of the fit.
SAMPLE = 400
#: Of texts of more bytes the fit takes FIT_BLOCKS blocks at even distances, of so many bytes together
#: at most; predictions read them whole.
MAX_FIT_BYTES = 100_000
FIT_BLOCKS = 4
#: Cells of a language's table of code lengths, 4 bytes each; beyond it the rarest contexts are pruned.
MAX_CELLS = 1 << 24
UNIT = 4096
BLOCK = 1 << 19
COUNTS = "lang string, gram long, n long"


def held_out(id_col: str = "doc_id") -> Column:
    """The documents that are never learned from."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def sampled(docs: DataFrame, sample: int) -> DataFrame:
    """Labelled texts for the fit: (lang, text). A count for each language gives the share to
    keep, so no group of a language is gathered or sorted."""
    usable = docs.filter(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = usable.groupBy(F.col("lang").alias("c_lang")).agg(F.count(F.lit(1)).alias("count"))
    u = F.pmod(F.xxhash64(F.lit("language-fit"), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    chosen = usable.join(F.broadcast(counts), F.col("lang") == F.col("c_lang")).filter(u < F.lit(float(sample)) / F.col("count"))
    size = MAX_FIT_BYTES // (4 * FIT_BLOCKS)  # characters of up to 4 bytes
    step = (F.length("text") - size) / (FIT_BLOCKS - 1)
    blocks = F.transform(F.sequence(F.lit(0), F.lit(FIT_BLOCKS - 1)), lambda k: F.substr("text", F.floor(k * step).cast("int") + 1, F.lit(size)))
    part = F.when(F.octet_length("text") <= MAX_FIT_BYTES, F.array("text")).otherwise(blocks)
    return chosen.select("lang", F.explode(part).alias("text"))


def grams_of(batches):
    """Counts of the (ORDER + 1)-byte windows of each batch, by language; ORDER zero bytes
    stand before a text."""
    for batch in batches:
        langs, texts = batch.column(0).to_pylist(), batch.column(1)
        by: dict[str, list[bytes]] = {}
        for lang, text in zip(langs, texts.to_pylist(), strict=True):
            by.setdefault(lang, []).append(bytes(ORDER) + text.encode())
        out = []
        for lang, parts in by.items():
            codes = []
            for part in parts:
                b = np.frombuffer(part, np.uint8).astype(np.int64)
                if len(b) > ORDER:
                    code = np.zeros(len(b) - ORDER, np.int64)
                    for k in range(ORDER + 1):
                        code = (code << 8) | b[k : len(b) - ORDER + k]
                    codes.append(code)
            if codes:
                gram, n = np.unique(np.concatenate(codes), return_counts=True)
                out.append((lang, gram, n))
        if out:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat([x[0] for x in out], [len(x[1]) for x in out]).tolist(), pa.string()),
                    pa.array(np.concatenate([x[1] for x in out]), pa.int64()),
                    pa.array(np.concatenate([x[2] for x in out]).astype(np.int64), pa.int64()),
                ],
                names=["lang", "gram", "n"],
            )


class Tree:
    """The frozen tree of one language as a table of code lengths, a row for each context."""

    def __init__(self, every: np.ndarray, weight: np.ndarray):
        # bytes that occur get a class each; class 0 is any other byte
        known = np.unique(np.concatenate([(every >> (8 * k)) & 255 for k in range(ORDER + 1)]))
        self.classes = np.zeros(256, np.int64)
        self.classes[known] = np.arange(1, len(known) + 1)
        self.a = a = len(known) + 1
        unseen = 256 - len(known)

        def context(g: np.ndarray, depth: int) -> np.ndarray:
            """Code of the last `depth` bytes before the coded one, the latest in the lowest place."""
            out = np.zeros(len(g), np.int64)
            for k in range(depth, 0, -1):
                out = out * a + self.classes[(g >> (8 * k)) & 255]
            return out

        rows, contexts = max(MAX_CELLS // a, 1), []
        for depth in range(ORDER + 1):
            code, at = np.unique(context(every, depth), return_inverse=True)
            if depth:  # a context needs its suffix, and the frequent ones go first
                inside = np.isin(code % a ** (depth - 1), contexts[-1])
                seen = np.bincount(at, weight) * inside
                room = max(rows - sum(map(len, contexts)), 0)
                code = np.sort(code[np.argsort(-seen, kind="stable")[: min(room, int(inside.sum()))]])
            contexts.append(code)
        self.table = self.lengths(every, weight, contexts, context, unseen).ravel()
        # the state after any ORDER bytes: the row of their longest known suffix
        first = 0
        for depth, code in enumerate(contexts):
            states = np.tile(states, a) if depth else np.zeros(1, np.int32)  # noqa: F821
            states[code] = np.arange(first, first + len(code))
            first += len(code)
        self.states = states.astype(np.int32) * np.int32(a)  # below MAX_CELLS or 257

    def lengths(self, g, n, contexts, context, unseen: int) -> np.ndarray:
        """Code lengths in all contexts, the shortest contexts first."""
        a, out = self.a, []
        members = np.r_[float(unseen), np.ones(a - 1)]  # bytes in each class
        below = np.full((1, a), 1 / 256)
        for depth, known in enumerate(contexts):
            if depth:
                below = below[np.searchsorted(contexts[depth - 1], known % a ** (depth - 1))] if len(known) else below[:0]
            code = context(g, depth)
            at = np.searchsorted(known, code)
            here = (at < len(known)) & (known[np.minimum(at, len(known) - 1)] == code) if len(known) else np.zeros(len(g), bool)
            c = np.bincount(at[here] * a + self.classes[g & 255][here], n[here], len(known) * a).reshape(-1, a)
            total, kinds = c.sum(1, keepdims=True), (c > 0).sum(1, keepdims=True)
            left = (below * members * (c == 0)).sum(1, keepdims=True)
            every = np.maximum(total + kinds, 1)
            escaped = below * kinds / every / np.where(left > 0, left, 1)
            below = np.where(total > 0, np.where(c > 0, c / every, escaped), below)
            out.append(below)
        bits = -np.log2(np.maximum(np.concatenate(out), 2.0**-40))
        return (bits * UNIT).round().astype(np.int32)

    def bits(self, text: np.ndarray) -> np.ndarray:
        """Code length of each byte but the first ORDER."""
        c = self.classes[text]
        state = np.zeros(len(c) - ORDER, np.int64)
        for k in range(ORDER):  # the oldest byte first
            state = state * self.a + c[k : len(c) - ORDER + k]
        return self.table[self.states[state] + c[ORDER:]]


class Model:
    """A tree for each language."""

    def __init__(self, langs: list[str], grams: list[np.ndarray], counts: list[np.ndarray]):
        self.langs = langs
        self.trees = [Tree(g, n) for g, n in zip(grams, counts, strict=True)]
        self.tables = [t.table for t in self.trees]
        self.a = max((t.a for t in self.trees), default=1)

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Exact code length of each text in each language, in 1 / UNIT bit."""
        out = np.zeros((len(texts), len(self.langs)), np.int64)
        parts, owners, size = [], [], 0
        pad = bytes(ORDER)
        for i, text in enumerate(texts):
            for k in range(0, len(text), BLOCK):
                parts.append((pad + text[:BLOCK]) if k == 0 else text[k - ORDER : k + BLOCK])
                owners.append(i)
                size += len(parts[-1])
                if size >= BLOCK:
                    self._add(out, parts, owners)
                    parts, owners, size = [], [], 0
        if parts:
            self._add(out, parts, owners)
        return out

    def _add(self, out: np.ndarray, parts: list[bytes], owners: list[int]) -> None:
        text = np.frombuffer(b"".join(parts), np.uint8)
        ends = np.cumsum([len(p) for p in parts])
        starts = np.r_[0, ends[:-1]]
        borders = np.stack([starts, ends - ORDER], 1).ravel()[:-1]  # of the coded bytes
        for k, tree in enumerate(self.trees):
            np.add.at(out[:, k], owners, np.add.reduceat(tree.bits(text), borders, dtype=np.int64)[::2])


_models: dict[str, Model] = {}


def model_of(key: str, fit) -> Model:
    """The model of a broadcast fit, laid out once in each worker."""
    if key not in _models:
        _models.clear()
        _models[key] = Model(*fit.value)
    return _models[key]


def identify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Per document doc_id, held_out, lang_pred and score.

    score is the posterior of the predicted language under equal priors. Texts that are null or
    hold no letter are `und` with score 0, and so is every text if nothing can be learned; a
    tie goes to the first language by name. Null ids and repeated rows are kept as they are;
    columns other than doc_id, text and lang are not read.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    counts = sampled(docs, sample).mapInArrow(grams_of, COUNTS).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    table = counts.toArrow().sort_by([("lang", "ascending"), ("gram", "ascending")])
    langs = sorted(set(table["lang"].to_pylist()))
    column = np.array(table["lang"].to_pylist(), object)
    gram, n = table["gram"].to_numpy(), table["n"].to_numpy()
    ends = np.r_[np.flatnonzero(column[1:] != column[:-1]) + 1, len(column)]
    by = [(gram[a:b], n[a:b]) for a, b in zip(np.r_[0, ends[:-1]], ends, strict=True)][: len(langs)]
    key = uuid.uuid4().hex
    fit = spark.sparkContext.broadcast((langs, [g for g, _ in by], [c for _, c in by]))

    def predict(batches):
        ascii_letter = re.compile(rb"[A-Za-z]").search
        letter = lambda text: any(map(str.isalpha, text))  # noqa: E731  number signs are words to a pattern, but no letters
        for batch in sliced(batches):
            texts = [t or b"" for t in batch.column(2).to_pylist()]
            named = np.array([bool(ascii_letter(t) or letter(t.decode())) for t in texts], bool) & bool(langs)
            pred, score = np.full(len(texts), "und", object), np.zeros(len(texts))
            if named.any():
                bits = model_of(key, fit).code_lengths([t for t, x in zip(texts, named, strict=True) if x]) / UNIT
                best = bits.min(1, keepdims=True)
                pred[named] = np.array(langs, object)[bits.argmin(1)]
                score[named] = 1 / np.exp2(np.maximum(best - bits, -1000)).sum(1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(pred.tolist(), pa.string()), pa.array(score)],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    rows = docs.select("doc_id", held_out().alias("held_out"), F.col("text").cast("binary").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(predict, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
