"""Fill-in-the-middle: each text is cut into prefix, middle and suffix at unit borders and written in another order.

A *sparse checkpoint index* finds the cuts.  One pass over a text's UTF-8 bytes, in
blocks, counts its units (lines or code points) and records, at every
``every``-th unit border, the number of units, the byte offset and the code-point
offset.  A cut after u units is found by binary search for the last checkpoint at or
before u and a short rescan from there: at most ``every`` units, however long the
text is.  So a text costs one pass, an index of n / every entries, and no list of its
units.

Cuts, form and order come from the sha256 of ``<seed>:<id>`` alone, so a text is
always transformed alike, on any cluster: groups h1, h2 of 8 hex digits name the two
cuts (mod n + 1), h3 whether the text is transformed (``rate`` in 100), h4 whether it
is ``spm`` (``spm_share`` in 100) or ``psm``.

- ``psm``: <P> prefix <S> suffix <M> middle;  ``spm``: <S> suffix <P> prefix <M> middle;
- ``plain``: the text as it is: empty texts, texts that hold a mark themselves (else
  the parts could not be told apart), and those that the rate leaves out.

``restored`` undoes it inside the JVM.  Texts hold no mark and marks do not overlap
each other, so the first three marks of an output are the right ones.

Null texts count as empty, null ids as the empty id; repeated rows give repeated
results; ids may have any type; a text of any length is one row of work in Arrow
batches bounded in bytes; input columns named like the results are replaced, all
others come through; an empty table gives an empty result.  Nothing is shuffled.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.llm.common import free_memory, small_batches, without

#: Marks before the prefix, the suffix and the middle.
MARKS = P, S, M = "<P>", "<S>", "<M>"
OUT = ["n_units", "form", "prefix_chars", "middle_chars", "fim"]
#: Units between two checkpoints, and bytes that are scanned at once.
EVERY, BLOCK = 64, 1 << 16


def borders(data: np.ndarray, start: int, stop: int, unit: str) -> np.ndarray:
    """Ends of the units of data that lie in start < end <= stop.  A line ends after its newline, the last one with the text."""
    if unit == "line":
        ends = np.flatnonzero(data[start:stop] == 10) + start + 1
        if stop == len(data) and stop > start and data[stop - 1] != 10:
            ends = np.append(ends, stop)
        return ends
    after = data[start + 1 : stop + 1]  # a code point ends where the next one begins
    ends = np.flatnonzero((after & 0xC0) != 0x80) + start + 1
    return np.append(ends, stop) if stop == len(data) and stop > start else ends


def code_points(data: np.ndarray) -> int:
    return int(np.count_nonzero((data & 0xC0) != 0x80))


class Checkpoints:
    """Index of a text: units, bytes and code points before every ``every``-th border."""

    def __init__(self, text: bytes, unit: str = "line", every: int = EVERY, block: int = BLOCK):
        self.data, self.unit, self.block = np.frombuffer(text, np.uint8), unit, block
        self.units, self.bytes, self.chars = [0], [0], [0]
        self.n, seen, chars = 0, 0, 0  # seen: bytes of which chars code points are counted
        for start in range(0, len(self.data), block):
            ends = borders(self.data, start, min(start + block, len(self.data)), unit)
            for k in range((-self.n - 1) % every, len(ends), every):
                at = int(ends[k])
                chars += code_points(self.data[seen:at])
                seen = at
                self.units.append(self.n + k + 1), self.bytes.append(at), self.chars.append(chars)
            self.n += len(ends)

    def cut(self, units: int) -> tuple[int, int]:
        """Bytes and code points before the border after so many units."""
        k = bisect_right(self.units, units) - 1
        left, at = units - self.units[k], self.bytes[k]
        start = at
        while left:
            stop = min(start + self.block, len(self.data))
            ends = borders(self.data, start, stop, self.unit)
            if len(ends) >= left:
                start, left = int(ends[left - 1]), 0
            else:
                start, left = stop, left - len(ends)
        return start, self.chars[k] + code_points(self.data[at:start])


def transform(text: bytes, key: str, unit: str = "line", rate: int = 100, spm_share: int = 50, every: int = EVERY) -> tuple[int, str, int | None, int | None, bytes]:
    """(units, form, code points of the prefix, of the middle, output) of one text; key: ``<seed>:<id>``."""
    index = Checkpoints(text, unit, every)
    digest = hashlib.sha256(key.encode()).hexdigest()
    h = [int(digest[k : k + 8], 16) for k in range(0, 32, 8)]
    if not text or h[2] % 100 >= rate or any(m.encode() in text for m in MARKS):
        return index.n, "plain", None, None, text
    (a, ca), (b, cb) = (index.cut(u) for u in sorted((h[0] % (index.n + 1), h[1] % (index.n + 1))))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    p, s, m = (x.encode() for x in MARKS)
    if h[3] % 100 < spm_share:
        return index.n, "spm", ca, cb - ca, b"".join((s, suffix, p, prefix, m, middle))
    return index.n, "psm", ca, cb - ca, b"".join((p, prefix, s, suffix, m, middle))


_KIND = pa.struct([("n_units", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("fim", pa.string())])


def fill_in_middle(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "line", rate: int = 100, spm_share: int = 50, seed: int = 7, every: int = EVERY
) -> DataFrame:
    """docs with the columns of OUT; unit: "line" or "char"; rate and spm_share in 100."""
    if unit not in ("line", "char"):
        raise ValueError("unit is line or char")
    if not (0 <= rate <= 100 and 0 <= spm_share <= 100 and every >= 1):
        raise ValueError("rate and spm_share lie between 0 and 100, every from 1 on")
    small_batches(docs.sparkSession)

    @F.arrow_udf("struct<n_units: long, form: string, prefix_chars: long, middle_chars: long, fim: string>")
    def task(rows: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        try:
            for keys, texts in rows:
                out = [transform(t.as_buffer().to_pybytes() if t.is_valid else b"", k, unit, rate, spm_share, every) for k, t in zip(keys.to_pylist(), texts, strict=True)]
                columns = [pa.array([x[i] for x in out], _KIND[i].type) for i in range(4)]
                outputs = pa.array([x[4] for x in out], pa.binary()).view(pa.string())
                yield pa.StructArray.from_arrays([*columns, outputs], fields=list(_KIND))
        finally:
            free_memory()

    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    kept = without(docs, OUT)
    made = kept.select(F.struct("*").alias("row"), task(key, F.col(text_col).cast("string")).alias("made"))
    return made.select("row.*", "made.*")


def restored(output: str | Column, form: str | Column) -> Column:
    """The text, rebuilt from an output and its form alone."""
    output, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))
    part = F.split(F.substr(output, F.lit(len(P) + 1)), "<[PSM]>", 3)
    psm, spm = F.concat(part[0], part[2], part[1]), F.concat(part[1], part[2], part[0])
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256) of each row, lines as units."""
    made = fill_in_middle(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id", "text")
    sha = {"output_sha256": F.sha2(F.col("fim").cast("binary"), 256), "restored_sha256": F.sha2(restored("fim", "form").cast("binary"), 256)}
    return made.select(F.col("id").alias(id_col), F.col("n_units").alias("n"), "form", "prefix_chars", "middle_chars", *[v.alias(k) for k, v in sha.items()])
