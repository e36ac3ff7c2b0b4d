"""Sequence packing along a space-filling curve.

Documents are tokenised once. Each gets a hashed vector of its tokens,
projected to ``DIMS`` dimensions (signed random projection, one sign per
token id and dimension), and a Hilbert key of the quantised coordinates.
Documents are range-sorted by that key and laid end to end along the curve;
the stream is cut every ``LENGTH`` tokens, so only the last sequence is not
full. A document's ids lie in one piece per sequence that it touches.

Positions are a distributed prefix sum: rows are range-sorted by (Hilbert
key, hash of the row, row), which spreads copies of one text over
partitions; each partition sums its own rows, and the sums of the partitions
(one row each) give their offsets. No task sees more than its partition.

Token ids fit two bytes and are kept as bytes.

Defined results: a null text is empty; every document ends with id 1, so an
empty one has one token; repeated rows are packed each for itself; an empty
table gives no piece; extra columns are never read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreplane.llm.common import row_ids, whole, written

LENGTH = 2048
END_ID = 1
DIMS = 3
BITS = 10
TOKENIZER = "byte_bpe_50k"
BATCH_BYTES = 4 << 20


class Tokens:
    """Token ids of whole texts as little-endian two-byte strings."""

    def __init__(self, name: str = TOKENIZER):
        import base64

        import public_tokenizers as P
        import tiktoken
        from tokenizers import Tokenizer

        with open(P.path(f"{name}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        # the same vocabulary and pattern in a form that is several times faster
        self.fast = tiktoken.Encoding(name, pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.full = Tokenizer.from_file(P.path(f"{name}.json"))

    def encode(self, text: str) -> bytes:
        if "<|" in text:  # a special token's string
            ids = self.full.encode(text, add_special_tokens=False).ids
        else:
            ids = self.fast.encode_ordinary(text)
        return np.array(ids, "<u2").tobytes()


def hilbert(x: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert index of integer points (n x dims), by the transposed Gray-code form."""
    x = x.astype(np.int64).copy()
    n = x.shape[1]
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[:, i] & q) != 0
            t = np.where(high, 0, (x[:, 0] ^ x[:, i]) & p)
            x[:, 0] = np.where(high, x[:, 0] ^ p, x[:, 0] ^ t)
            x[:, i] ^= t
        q >>= 1
    for i in range(1, n):
        x[:, i] ^= x[:, i - 1]
    t = np.zeros(len(x), np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[:, n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t[:, None]
    key = np.zeros(len(x), np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[:, i] >> b) & 1)
    return key


def _signs(n_ids: int = 1 << 16) -> np.ndarray:
    return np.random.default_rng(7).choice(np.array([-1, 1], np.int32), (DIMS, n_ids))


def curve_keys(ids: list[np.ndarray], signs: np.ndarray) -> np.ndarray:
    """Hilbert keys of documents' hashed, projected, length-normalised vectors."""
    v = np.array([[s[i].sum() / np.sqrt(max(1, len(i))) for s in signs] for i in ids]).reshape(len(ids), DIMS)
    cells = np.clip((np.tanh(v / 4) + 1) / 2 * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)
    return hilbert(cells, BITS)


def tokenised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row_id, doc_id, key, n, ids): n counts the end id, ids are two-byte strings with it."""
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tok, signs, end = Tokens(), _signs(), np.array([END_ID], "<u2").tobytes()
        for pdf in it:
            size = pdf.text.str.len().cumsum() // BATCH_BYTES
            for _, part in pdf.groupby(size.to_numpy(), sort=True):
                ids = [tok.encode(t) + end for t in part.text]
                yield pd.DataFrame({
                    "row_id": part.row_id, "doc_id": part.doc_id,
                    "key": curve_keys([np.frombuffer(b, "<u2")[:-1] for b in ids], signs),
                    "n": [len(b) // 2 for b in ids], "ids": ids})

    rows = row_ids(docs.select(F.col(id_col).cast("long").alias("doc_id"), whole(text_col).alias("text")))
    return rows.withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(
        run, "row_id long, doc_id string, key long, n long, ids binary").withColumn("doc_id", F.col("doc_id").cast("long"))


def positions(rows: DataFrame, order: list[str], size: str) -> DataFrame:
    """(row_id, pos) of rows: the sum of the sizes before each in the order, which ends with row_id.

    Sizes are summed per range partition, then over the partitions before.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, k = 0, TaskContext.get().partitionId()
        for pdf in it:
            n = pdf[size].to_numpy("int64")
            after = at + np.cumsum(n)
            yield pdf[["row_id"]].assign(part=k, local=after - n, own=n)
            at = int(after[-1]) if len(after) else at

    ranged = rows.select(*order, size).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    local = written(ranged.mapInPandas(run, "row_id long, part long, local long, own long"), "positions")
    from pyspark.sql import Window

    # one row per partition
    sums = local.groupBy("part").agg(F.sum("own").alias("s"))
    before = sums.withColumn("before", F.sum("s").over(Window.orderBy("part")) - F.col("s")).select("part", "before")
    return local.join(F.broadcast(before), "part").select("row_id", (F.col("local") + F.col("before")).alias("pos"))


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """Pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids (two-byte ids)."""
    rows = written(tokenised(docs, id_col, text_col), "packing-tokens")
    order = rows.select("row_id", "key", F.xxhash64("row_id").alias("tie"), "n")
    at = positions(order, ["key", "tie", "row_id"], "n")

    def cut(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cols = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
        for pdf in it:
            out = []
            for doc_id, n, ids, pos in zip(pdf.doc_id, pdf.n, pdf.ids, pdf.pos):
                wide, start = np.frombuffer(ids, "<u2").astype("<u4"), 0
                while start < n:
                    seq, off = divmod(pos + start, length)
                    stop = min(n, start + length - off)
                    out.append((doc_id, start, stop - start, zlib.crc32(wide[start:stop].tobytes()), n, seq, off,
                                ids[2 * start:2 * stop]))
                    start = stop
                if len(out) >= 2000:
                    yield pd.DataFrame(out, columns=cols)
                    out = []
            if out:
                yield pd.DataFrame(out, columns=cols)

    joined = rows.select("row_id", F.col("doc_id").cast("string").alias("doc_id"), "n", "ids").join(at, "row_id")
    out = joined.select("doc_id", "n", "ids", "pos").mapInPandas(
        cut, "doc_id string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary")
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))
