"""Words, hashes and shingles shared by the text operators (executor side, numpy), and the map over texts they run in."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

U = np.uint64
SPACES = b" \t\n\r\x0b\x0c"


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def utf8(text: str | None, lower: bool = False) -> bytes:
    """bytes.lower() folds A-Z alone."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw.lower() if lower else raw


def words(text: str | None, lower: bool = False) -> list[bytes]:
    """bytes.split() parts at exactly \\x20 and \\x09-\\x0D."""
    return utf8(text, lower).split()


def _powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.full(n, base, U))


_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = mix(np.arange(1, 257, dtype=U))
_BYTE[list(SPACES)] = 0
_POWERS, _INVERSES = _powers(_BASE, 1 << 17), _powers(_INVERSE, 1 << 17)


def word_spans(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in bytes."""
    space = np.ones(len(raw) + 2, bool)
    b = np.frombuffer(raw, np.uint8)
    space[1:-1] = (b == 32) | (b - np.uint8(9) < 5)
    edge = np.flatnonzero(space[1:] != space[:-1])
    return edge[0::2], edge[1::2]


def span_hashes(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: a polynomial over random values of its bytes, brought back to the word's start, mixed with its length."""
    if not len(starts):
        return np.empty(0, U)
    value, n = _BYTE[np.frombuffer(raw, np.uint8)], len(raw)
    powers, inverses = (_POWERS, _INVERSES) if n <= len(_POWERS) else (_powers(_BASE, n), _powers(_INVERSE, n))
    value *= powers[:n]
    return mix(np.add.reduceat(value, starts) * inverses[starts] ^ (ends - starts).astype(U))


def word_hashes(text: str | None, lower: bool = False) -> np.ndarray:
    raw = utf8(text, lower)
    return span_hashes(raw, *word_spans(raw))


def shingles(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive words; of the whole sequence if there are fewer."""
    if not len(h):
        return h
    n = min(n, len(h))
    out = np.full(len(h) - n + 1, n, U)
    for k in range(n):
        out = out * U(_BASE) + h[k : len(h) - n + 1 + k]
    return mix(out)


Work = Callable[[list], tuple[Sequence[int] | None, list]]


def mapped(df: DataFrame, make: Callable[[], Work], schema: str, keep: Sequence[str] = ("doc_id",), column: str = "text", rows: int = 512) -> DataFrame:
    """Map the values of `column`, `rows` at a time; make() gives each task its function.

    The function returns the rows its results belong to (None: one result per row, in order) and the columns of `schema`.
    The `keep` columns stay in Arrow throughout, so 64-bit ids beside nulls stay exact.
    """
    shape = StructType([*(df.schema[c] for c in keep), *(StructType.fromDDL(schema).fields if schema else [])])
    out = to_arrow_schema(shape)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for whole in batches:
            for lo in range(0, whole.num_rows, rows):
                b = whole.slice(lo, rows)
                index, columns = work(b.column(column).to_pylist())
                kept = [b.column(c) if index is None else b.column(c).take(pa.array(index, pa.int64())) for c in keep]
                made = [pa.array(x, out.field(len(keep) + k).type) for k, x in enumerate(columns)]
                yield pa.RecordBatch.from_arrays([x.cast(out.field(k).type) for k, x in enumerate(kept + made)], schema=out)

    return df.select(*dict.fromkeys([*keep, column])).mapInArrow(run, shape)
