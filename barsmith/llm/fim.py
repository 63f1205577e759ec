"""Fill-in-middle transformation with a matcher that passes over a text twice.

A text is cut at the ends of two of its units (a word with the white space before it, or the white
space at the end). How many units there are has to be known before the two ranks can be drawn, so the
first pass counts matches and the second advances a lazy iterator of matches to the smaller and then
to the larger rank, where it stops. Neither pass keeps a match, so besides the text itself a row needs
the same few bytes whatever its length. Rows do not depend on each other: no shuffle, and a lost task
is run again with the same draws.
"""

from __future__ import annotations

import hashlib
import re
from itertools import islice
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import sliced, text_or_empty

SEED = 42
#: Per cent of the texts that are transformed, and of these in suffix-prefix-middle order.
RATE, SPM = 50, 80
#: A unit, in UTF-8: white space is ASCII, so bytes give the same matches as code points.
UNIT = re.compile(rb"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++|[\x20\x09-\x0D]++")


class Marks(NamedTuple):
    """The strings before prefix, suffix and middle."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def checked(self) -> Marks:
        """Marks that no text without them can form together with a neighbouring mark: the first
        character of a mark is found nowhere else in any of them."""
        if len(set(self)) < 3 or any(not m or m[0] in other[1:] for m in self for other in self):
            raise ValueError("marks must differ, and begin with a character that no mark has further on")
        return self


def draws(name: bytes) -> list[int]:
    """Four numbers below 2 ** 32 out of a row's seed and id."""
    digits = hashlib.sha256(name).hexdigest()
    return [int(digits[k : k + 8], 16) for k in range(0, 32, 8)]


def counted(text: bytes) -> int:
    return sum(1 for _ in UNIT.finditer(text))


def ends(text: bytes, first: int, second: int) -> tuple[int, int]:
    """Where the first `first` and the first `second` units end; first <= second."""
    units, at = UNIT.finditer(text), 0
    found = []
    for steps in (first, second - first):
        if steps:
            at = next(islice(units, steps - 1, None)).end()
        found.append(at)
    return found[0], found[1]


def transformed(text: bytes, name: bytes, rate: int, spm: int, marks: list[bytes]) -> tuple[int, str, int | None, int | None, bytes]:
    """Units, form, code points of prefix and middle, output."""
    n, (h1, h2, h3, h4) = counted(text), draws(name)
    if not text or h3 % 100 >= rate or any(m in text for m in marks):
        return n, "plain", None, None, text
    cut = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = ends(text, *cut)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    p, s, m = marks
    form = "spm" if h4 % 100 < spm else "psm"
    parts = (s, suffix, p, prefix, m, middle) if form == "spm" else (p, prefix, s, suffix, m, middle)
    return n, form, len(prefix.decode("utf-8", "replace")), len(middle.decode("utf-8", "replace")), b"".join(parts)


def transform(docs: DataFrame, keep: tuple[str, ...] = (), rate: int = RATE, spm: int = SPM, seed: int = SEED, marks: Marks = Marks()) -> DataFrame:
    """Per document doc_id, n (units), form (plain, psm or spm), prefix_chars, middle_chars (code points,
    null if plain), output and, with `keep`, a struct `row` of the columns of docs named.

    A null text counts as empty, an empty one has no unit and stays plain, as does one that holds a
    mark. A null id draws as an empty one; equal ids draw alike, so repeated rows return alike, once
    each; both ranks may be equal (an empty middle) and may be 0 or n; an empty table gives an empty
    result; other columns are not read.
    """
    texts = [m.encode() for m in marks.checked()]
    kind = docs.schema["doc_id"].dataType.simpleString()
    row = [F.struct(*[F.col(f"`{k}`") for k in keep]).alias("row")] if keep else []
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    base = docs.select("doc_id", name.cast("binary").alias("name"), text_or_empty().cast("binary").alias("text"), *row)

    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output", *["row" for _ in row]]

    def run(batches):
        for batch in sliced(batches):
            rows = zip(batch.column(2), batch.column(1), strict=True)  # one text at a time becomes a Python object
            found = [transformed(t.as_py(), n.as_py(), rate, spm, texts) for t, n in rows]
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary())
            more = [pa.array([f[i] for f in found], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *more, *batch.columns[3:]], names=names)

    schema = f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output binary"
    if row:
        schema += f", row {base.schema['row'].dataType.simpleString()}"
    return base.mapInArrow(run, schema).withColumn("output", F.col("output").cast("string"))


def restored(output: Column, form: Column, marks: Marks = Marks()) -> Column:
    """The text that an output was made of. The first occurrences of the marks are the marks."""
    parts = F.split(output, "|".join(re.escape(m) for m in marks.checked()), -1)
    part = lambda *places: F.concat(*[F.get(parts, F.lit(k)) for k in places])
    return F.when(form == "psm", part(1, 3, 2)).when(form == "spm", part(2, 3, 1)).otherwise(output)


def report(found: DataFrame) -> DataFrame:
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    back = restored(F.col("output"), F.col("form"))
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(back).alias("restored_sha256"))
