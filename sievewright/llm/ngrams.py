"""Character-pair language model in a table of fixed size.

Pairs are counted over all texts, each partition in one dense array, and
summed by cell, and so are single code points of the basic plane; the tables
have ``CELLS`` and 2^16 cells whatever the corpus, so that is the bound of what
is collected and broadcast (below 9 MB of float32). Letters are folded to lower
case and digits to ``0``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CELLS = 1 << 20
# Code points beyond the basic plane are folded into the surrogates' range,
# which no text holds: 2048 places for them, so that they differ as a rule.
_FOLD_SIZE = 0x10000
_fold: np.ndarray | None = None


def fold_codes(codes: np.ndarray) -> np.ndarray:
    """Lower case within the basic plane; digits become 0."""
    global _fold
    if _fold is None:
        table = np.arange(_FOLD_SIZE, dtype=np.uint32)
        for c in range(_FOLD_SIZE):
            low = chr(c).lower() if not 0xD800 <= c < 0xE000 else ""
            if len(low) == 1 and ord(low) < _FOLD_SIZE:
                table[c] = ord(low)
        table[0x30:0x3A] = 0x30
        table[[9, 10, 13]] = 32
        _fold = table
    beyond = codes >= _FOLD_SIZE
    return np.where(beyond, 0xD800 + (codes * np.uint32(0x9E3779B1) >> np.uint32(21)), _fold[np.minimum(codes, _FOLD_SIZE - 1)]) if beyond.any() else _fold[codes]


def joined_codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts with a line break before and after each, and
    the start of each text (its leading break)."""
    lengths = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
    codes = np.frombuffer(("\n" + "\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return codes, np.cumsum(lengths) - lengths


def cells(codes: np.ndarray) -> np.ndarray:
    """Table cell of each pair of neighbours."""
    c = fold_codes(codes)
    return pair_cells(c[:-1], c[1:])


def pair_cells(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Table cell of pairs of folded code points."""
    key = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    key ^= key >> np.uint64(31)
    key *= np.uint64(0xBF58476D1CE4E5B9)
    return (key >> np.uint64(44)).astype(np.int64)


def pair_counts(texts: DataFrame, columns: tuple[str, ...]) -> np.ndarray:
    """Counts of all pairs in text columns, by cell, then of all single code
    points; nulls count nothing."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS + _FOLD_SIZE, dtype=np.int64)
        for batch in batches:
            values = [v for column in batch.columns for v in column.drop_null().to_pylist()]
            for i in range(0, len(values), 2048):
                codes = joined_codes(values[i : i + 2048])[0]
                total[:CELLS] += np.bincount(cells(codes), minlength=CELLS)
                total[CELLS:] += np.bincount(fold_codes(codes), minlength=_FOLD_SIZE)
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(total[hit])], names=["cell", "n"])

    counted = texts.select(*columns).mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(CELLS + _FOLD_SIZE, dtype=np.int64)
    out[counted["cell"].to_numpy()] = counted["n"].to_numpy()
    return out


def _mild(codes: np.ndarray) -> np.ndarray:
    """Dashes, quotes, ellipses, guillemets, middle dots and CJK marks."""
    return ((codes >= 0x2010) & (codes <= 0x2027)) | ((codes >= 0x3000) & (codes < 0x3040)) | ((codes >= 0xFF00) & (codes < 0xFF20)) | (codes == 0xB7) | (codes == 0xBB) | (codes == 0xAB)


class PairModel:
    """Smoothed log probability of pairs.

    ``logp`` is the log of the share of a pair among all pairs, ``unseen``
    its value for a pair that was never counted. ``totals`` is the likelihood
    of texts: each code point given the one before, with the share of single
    code points behind it, so that texts of unlike length compare.
    """

    def __init__(self, counts: np.ndarray, smoothing: float = 0.05, back: float = 20.0):
        single, counts = counts[CELLS:].astype(float), counts[:CELLS]
        self.pairs, self.single = counts.astype(np.float32), single.astype(np.float32)
        # Typographic marks stand anywhere, also where no document has them.
        single = single + np.where(_mild(np.arange(_FOLD_SIZE)), back, 0.0)
        self.behind = (back * (single + smoothing) / (single.sum() + smoothing * _FOLD_SIZE)).astype(np.float32)
        self.before = np.log(single + back).astype(np.float32)
        total = counts.sum() + smoothing * CELLS
        self.logp = np.log((counts + smoothing) / total).astype(np.float32)
        self.unseen = float(np.log(smoothing / total))

    def steps(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Log probability of each code point ``b`` after ``a``."""
        a, b = fold_codes(a), fold_codes(b)
        seen = np.minimum(self.pairs[pair_cells(a, b)], np.minimum(self.single[a], self.single[b]))
        return np.log(seen + self.behind[b]) - self.before[a]

    def totals(self, texts: list[str]) -> np.ndarray:
        """Per text: its log likelihood."""
        codes, starts = joined_codes(texts)
        # A cell may hold other pairs too, but a pair is no more frequent than its code points.
        return np.add.reduceat(self.steps(codes[:-1], codes[1:]), starts, dtype=np.float64)

    def score(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per text: sum of log probabilities, mean over the pairs that hold a
        code point beyond ASCII (0 where there is none), unseen such pairs
        (without those of an ASCII and a CJK code point, where names meet
        the text, and of typographic marks, which stand anywhere)."""
        codes, starts = joined_codes(texts)
        values = self.logp[cells(codes)]
        high = (codes[:-1] > 127) | (codes[1:] > 127)
        total = np.add.reduceat(values, starts)
        n = np.add.reduceat(high.astype(np.int64), starts)
        part = np.add.reduceat(np.where(high, values, 0), starts)
        a, b = codes[:-1], codes[1:]
        seam = ((a < 128) & (b >= 0x2E80) & (b < 0xFFF0)) | ((b < 128) & (a >= 0x2E80) & (a < 0xFFF0))
        mild = _mild(a) | _mild(b)
        rare = np.add.reduceat((high & ~seam & ~mild & (values <= self.unseen + 0.01)).astype(np.int64), starts)
        return total, np.where(n, part / np.maximum(n, 1), 0.0), rare
