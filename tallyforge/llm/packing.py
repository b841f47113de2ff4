"""Packing along a space-filling curve.

A document's token ids are hashed into a signed vector, which is projected to three dimensions; the Hilbert key of
the point orders the documents, and the stream of their ids in that order is cut at every `size` ids, so only the last
sequence has padding. Null text is empty (one id, the end mark); a null doc_id is carried; repeated rows are packed each;
documents of one key follow one another in the order of their rows; a text of any length is cut over as many sequences as
it needs; extra columns are ignored. A table without rows gives no pieces.
"""

from __future__ import annotations

import json
import zlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.llm.text import mapped, mix
from tallyforge.sources.tables import Scratch, written

DIMS, BITS, END, BUCKETS = 3, 12, 0, 64
PIECES = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

# fixed value: how a byte-level tokenizer cuts a text before merging
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


class Encoder:
    """Text -> the tokenizer file's ids as an array.

    A plain byte-level BPE whose ids are in the order of its merges goes through tiktoken, which gives the same ids
    in less time; any other file, and with `special` any text that holds a special token, through tokenizers itself.
    special: strings of special tokens in a text become their ids, which is what tokenizers does unless told otherwise; else they are plain text.
    """

    def __init__(self, tokenizer: str, special: bool = False):
        with open(tokenizer, encoding="utf-8") as f:
            j = json.load(f)
        pre, m = j.get("pre_tokenizer") or {}, j["model"]
        plain = m.get("type") == "BPE" and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        plain = plain and not any(m.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        made = [m["vocab"].get("".join(x) if isinstance(x, list) else x.replace(" ", "")) for x in m.get("merges", [])] if plain and not j.get("normalizer") and not j.get("post_processor") else []
        added = {x["content"] for x in j.get("added_tokens", [])}
        ids = m["vocab"].values() if isinstance(m.get("vocab"), dict) else [1 << 16]
        self.wide = max([*ids, *(x["id"] for x in j.get("added_tokens", []))], default=0) >= 1 << 16
        self.special, self.tokenizer, self.whole, self.fast = sorted(added) if special else [], tokenizer, None, None
        self.plain_text = not special
        if made and None not in made and all(a < b for a, b in zip(made, made[1:])):
            import tiktoken

            ranks = {bytes(map(_BYTE.__getitem__, k)): i for k, i in m["vocab"].items() if k not in added}
            self.fast = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def ids(self, text: str) -> list[int]:
        if self.fast and not any(x in text for x in self.special):
            return self.fast(text)
        if self.whole is None:
            from tokenizers import Tokenizer

            self.whole = Tokenizer.from_file(self.tokenizer)
            self.whole.encode_special_tokens = self.plain_text
        return self.whole.encode(text, add_special_tokens=False).ids

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        return np.array(self.ids(text), "<u4").tobytes()


def _byte_letters() -> dict[str, int]:
    """Letter of a byte-level vocabulary -> byte: printable Latin-1 stands for itself, the rest is numbered from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


_BYTE = _byte_letters()


def hilbert(x: list[int], bits: int = BITS) -> int:
    """Hilbert index of a point with coordinates of `bits` bits (Skilling 2004: transpose form, then interleave)."""
    x, n = list(x), len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            if x[i] & q:
                x[0] ^= p
            else:
                t = (x[0] ^ x[i]) & p
                x[0] ^= t
                x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = 0, 1 << (bits - 1)
    while q > 1:
        if x[n - 1] & q:
            t ^= q - 1
        q >>= 1
    key = 0
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | ((x[i] ^ t) >> b) & 1
    return key


#: Fixed projection of the hashed vector: +1 or -1 per bucket and dimension, by a hash.
_PROJECTION = 1 - 2 * (mix(np.arange(BUCKETS * DIMS, dtype=np.uint64) + np.uint64(1)) >> np.uint64(63)).astype(float).reshape(BUCKETS, DIMS)


def curve_key(ids: np.ndarray) -> int:
    """Hilbert key of the document's hashed vector: each id adds its sign to its bucket; the vector of unit length is projected and squashed to a grid."""
    if not len(ids):
        return 0
    h = mix(ids.astype(np.uint64) + np.uint64(1))
    v = np.bincount((h % np.uint64(BUCKETS)).astype(np.int64), 1.0 - 2.0 * (h >> np.uint64(63)), BUCKETS)
    norm = float(np.sqrt(v @ v))
    p = v @ _PROJECTION / norm if norm else np.zeros(DIMS)
    return hilbert([min((1 << BITS) - 1, int(x)) for x in (np.tanh(p) + 1) / 2 * (1 << BITS)])


def tokenized(docs: DataFrame, tokenizer: str, special: bool) -> DataFrame:
    """(row, doc_id, key, n, wide, ids): ids little-endian, of 32 bits where wide and else of 16, with the end mark."""

    def make():
        encoder = Encoder(tokenizer, special)

        def work(texts):
            ids = [np.array(encoder.ids(x or ""), "<u4") for x in texts]
            key = [curve_key(x) for x in ids]
            kind = "<u4" if encoder.wide else "<u2"
            whole = [np.append(x, np.uint32(END)).astype(kind).tobytes() for x in ids]
            return None, [key, [len(x) + 1 for x in ids], [encoder.wide] * len(ids), whole]

        return work

    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    return mapped(rows, make, "key long, n long, wide boolean, ids binary", ["row", "doc_id"], rows=256)


def pack(docs: DataFrame, tokenizer: str, size: int = 1024, special: bool = False) -> DataFrame:
    """doc_id and PIECES, one row per piece; `special` as for Encoder.

    The ids are written once; only (row, key, n) is range-sorted, and the start of a document is the sum of
    the range blocks before its own (one row per block) plus a running sum within its block.
    """
    tok = written(tokenized(docs, tokenizer, special), "ids")
    with Scratch(docs.sparkSession, "packing") as tmp:
        order = tmp.written(tok.select("row", "key", "n").repartitionByRange("key", "row").sortWithinPartitions("key", "row").withColumn("block", F.spark_partition_id()), "order")
        sums = order.groupBy("block").agg(F.sum("n").alias("s"))
        before = sums.select("block", (F.sum("s").over(Window.orderBy("block")) - F.col("s")).alias("before"))
        at = written(order.join(before, "block").select("row", (F.col("before") + F.sum("n").over(Window.partitionBy("block").orderBy("key", "row")) - F.col("n")).alias("at")), "starts")

    def make():
        def work(docs_):
            index, out = [], []
            for k, d in enumerate(docs_):
                n, at0 = d["n"], d["at"]
                ids = np.frombuffer(d["ids"], "<u4" if d["wide"] else "<u2").astype("<u4").tobytes()
                s = 0
                while s < n:
                    seq, off = divmod(at0 + s, size)
                    m = min(size - off, n - s)
                    index.append(k)
                    out.append((s, m, zlib.crc32(ids[4 * s : 4 * (s + m)]), n, seq, off))
                    s += m
            return index, list(zip(*out)) or [[]] * 6

        return work

    # one kind of join at every size: the ids move once, by row
    both = tok.join(at.hint("merge"), "row").select("doc_id", F.struct("n", "ids", "wide", "at").alias("d"))
    return mapped(both, make, PIECES, column="d", rows=256)
