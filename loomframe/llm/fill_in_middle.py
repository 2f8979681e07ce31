"""Fill-in-the-middle: a text is cut at two token borders into prefix, middle and suffix, and put together in another order.

A token is a run of A-Z and a-z, or any other single code point. So a token begins at every
code point but a letter that follows a letter: whether one begins at a byte shows from that byte
and the one before, and a text need not be read in order. Its UTF-8 bytes are taken in chunks that
overlap by that one byte, and the borders of each chunk are counted by themselves. Running
sums of the counts say which chunk holds the border of a given rank; only these chunks, two at most,
are looked at again for the byte. The masks of one chunk are all that is held besides the text.

A text is one row, so its chunks are counted in the task that has the row: nothing is exchanged,
and rows keep their partitions. Where the cuts lie rests on the id alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, whole

CHUNK = 1 << 16
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKS = (PREFIX, SUFFIX, MIDDLE)
_LETTER = np.array([chr(b).isalpha() and b < 128 for b in range(256)])
MADE = {"n": T.LongType(), "form": T.StringType(), "prefix_chars": T.LongType(), "middle_chars": T.LongType(), "output": T.StringType()}


class Chunks:
    """A text's bytes in overlapping chunks, with running sums of token starts and of code points before each chunk."""

    def __init__(self, data: np.ndarray, size: int = CHUNK):
        self.data, self.size = data, size
        counted = [(self._starts(k).sum(), self._points(k).sum()) for k in range(-(-len(data) // size))]
        self.starts, self.points = (np.concatenate(([0], np.cumsum([c[i] for c in counted], dtype=np.int64))) for i in (0, 1))

    def _own(self, k: int) -> np.ndarray:
        return self.data[k * self.size : (k + 1) * self.size]

    def _points(self, k: int) -> np.ndarray:
        """Whether a code point begins at each byte of chunk k."""
        return (self._own(k) & 0xC0) != 0x80

    def _starts(self, k: int) -> np.ndarray:
        """Whether a token begins at each byte of chunk k; the byte before the chunk is looked at too."""
        after_letter = np.empty(len(self._own(k)), bool)
        after_letter[0] = k > 0 and _LETTER[self.data[k * self.size - 1]]
        letter = _LETTER[self._own(k)]
        after_letter[1:] = letter[:-1]
        return self._points(k) & ~(letter & after_letter)

    @property
    def n(self) -> int:
        return int(self.starts[-1])

    def border(self, rank: int) -> tuple[int, int]:
        """Bytes and code points before the token of a rank (from 0); n gives those of the whole text."""
        if rank >= self.n:
            return len(self.data), int(self.points[-1])
        k = int(np.searchsorted(self.starts, rank, side="right")) - 1
        at = int(np.flatnonzero(self._starts(k))[rank - self.starts[k]])
        return k * self.size + at, int(self.points[k] + self._points(k)[:at].sum())


def rearrange(data: bytes, h1: int, h2: int, form: str, size: int = CHUNK) -> tuple[int, int | None, int | None, bytes]:
    """Number of tokens, code points of prefix and middle (None if plain), and the output of one text."""
    chunks = Chunks(np.frombuffer(data, np.uint8), size)
    n = chunks.n
    if form == "plain":
        return n, None, None, data
    (a, a_chars), (b, b_chars) = (chunks.border(f(h1 % (n + 1), h2 % (n + 1))) for f in (min, max))
    p, s, m = (x.encode() for x in MARKS)
    parts = (p, data[:a], s, data[b:], m, data[a:b]) if form == "psm" else (s, data[b:], p, data[:a], m, data[a:b])
    return n, a_chars, b_chars - a_chars, b"".join(parts)


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 90, spm_percent: int = 20, seed: int = 1, chunk_bytes: int = CHUNK) -> DataFrame:
    """docs with n (tokens, long), form (plain, psm or spm), prefix_chars, middle_chars (long, null if plain) and output (string).

    ``percent`` of the texts are rearranged, ``spm_percent`` of these with the suffix first. The
    cuts are drawn from the sha256 of seed, a colon and the id, so rows of one id and text are
    treated alike, in every run and partition. A null id is drawn as an empty one. Null and empty texts are plain,
    with an empty output; so are texts that hold one of the marks, as they could not be told
    apart again. Columns of docs with these five names are replaced; all others stay, whatever they are called. An empty table gives an empty table.
    """
    names = [c for c in docs.columns if c not in MADE]
    text, draw, one, two, form = fresh(names, "text", "draw", "h1", "h2", "form")
    lot = lambda i: F.conv(F.substring(draw, 1 + 8 * i, 8), 16, 10).cast("long")
    marked = F.col(text) == ""
    for mark in MARKS:
        marked = marked | F.contains(text, F.lit(mark))
    rows = docs.select(*names, whole(F.col(text_col).cast("string")).alias(text), F.sha2(F.concat(F.lit(f"{seed}:"), whole(F.col(id_col).cast("string"))), 256).alias(draw))
    chosen = F.when(marked | (lot(2) % 100 >= percent), "plain").when(lot(3) % 100 < spm_percent, "spm").otherwise("psm")
    rows = rows.select(*names, lot(0).alias(one), lot(1).alias(two), chosen.alias(form), F.col(text).cast("binary").alias(text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(names)
        for batch in batches:
            h1, h2, forms = (batch.column(i).to_pylist() for i in range(k, k + 3))
            made = [rearrange(x.as_py(), *lots, chunk_bytes) for x, *lots in zip(batch.column(k + 3), h1, h2, forms, strict=True)]
            n, prefix, middle, output = zip(*made, strict=True) if made else ((), (), (), ())
            columns = [pa.array(n, pa.int64()), batch.column(k + 2), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:k], *columns], names=[*names, *MADE])

    schema = T.StructType([*rows.schema.fields[: len(names)], *(T.StructField(c, T.BinaryType() if c == "output" else t) for c, t in MADE.items())])
    return rows.mapInArrow(run, schema).withColumn("output", F.col("output").cast("string"))


def restored(output: str | Column = "output", form: str | Column = "form") -> Column:
    """The text that an output of a form was made of."""
    output, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))
    first = lambda mark: F.substring(F.substring_index(output, mark, 1), 4, 1 << 30)  # noqa: E731  up to a mark, without the one it begins with
    between = lambda mark: F.substring_index(F.substring_index(output, MIDDLE, 1), mark, -1)
    middle = F.substring_index(output, MIDDLE, -1)
    return F.when(form == "psm", F.concat(first(SUFFIX), middle, between(SUFFIX))).when(form == "spm", F.concat(between(PREFIX), middle, first(PREFIX))).otherwise(output)
