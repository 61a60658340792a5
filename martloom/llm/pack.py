"""Packing by power-of-two decomposition: every document is cut into pieces
whose lengths are powers of two, a sequence is one piece, and sequences of one
length form a bucket, so nothing is padded and nothing crosses documents."""

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .tokens import encoded_slices

SCHEMA = ("doc_id long, start long, length long, ids binary, doc_tokens long, "
          "bucket int, sequence_id long, offset long")


def cuts(sizes, max_len):
    """(document, start, length) of all pieces of documents with so many tokens:
    whole multiples of ``max_len`` first, then the binary digits of the rest."""
    whole = sizes // max_len
    digits = (sizes % max_len)[:, None] >> np.arange(max_len.bit_length() - 2, -1, -1) & 1
    doc = np.repeat(np.arange(len(sizes)), whole + digits.sum(1))
    each = [np.concatenate([np.full(n, max_len), (1 << np.arange(max_len.bit_length() - 2, -1, -1))[d > 0]])
            for n, d in zip(whole, digits)]
    length = np.concatenate(each).astype(np.int64) if each else np.zeros(0, np.int64)
    first = np.repeat(np.cumsum(sizes) - sizes, whole + digits.sum(1))
    return doc, np.cumsum(length) - length - first, length


def binary_slices(flat, at, length):
    """A binary array of adjoining runs of a uint32 array, as little-endian bytes."""
    offsets = np.append(4 * at, 4 * (at[-1] + length[-1]) if len(at) else 0).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(at), [
        None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(flat, "<u4"))])


def pack(docs: DataFrame, tokenizer: str, max_len: int = 2048, end_id: int = 1,
         size: int = 4_000_000, remember: int = 1_000_000) -> DataFrame:
    """Pieces of all documents, each with its ids (little-endian uint32).

    ``docs`` has doc_id and text, other columns are left out. A null or empty
    text is the end id alone: one piece of length 1. Rows that repeat are packed
    as often as they occur. ``bucket`` is the exponent of the sequence's length.
    ``sequence_id`` joins the partition's number and a count inside it, so no
    task waits for another and nothing is shuffled; store the result before
    reading it twice. An empty table gives no rows. ``size`` (bytes of text at a
    time) and ``remember`` (encoded words) set a worker's memory against its time.
    """
    if max_len < 1 or max_len & (max_len - 1):
        raise ValueError("max_len must be a power of two")
    def run(batches):
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            ids_of = batch.column("doc_id")
            for first, to, flat, ends in encoded_slices(batch, tokenizer, size, remember):
                ends = ends + np.arange(1, len(ends) + 1)
                flat = np.insert(flat, ends - np.arange(1, len(ends) + 1), end_id)
                sizes = np.diff(ends, prepend=0)
                row, start, length = cuts(sizes, max_len)
                k, at = len(row), (ends - sizes)[row] + start
                yield pa.record_batch(
                    [ids_of.slice(first, to - first).take(pa.array(row)), pa.array(start),
                     pa.array(length),
                     binary_slices(flat, at, length),
                     pa.array(sizes[row]),
                     pa.array(np.log2(length).round().astype(np.int32)),
                     pa.array(np.arange(number, number + k)),
                     pa.array(np.zeros(k, np.int64))],
                    ["doc_id", "start", "length", "ids", "doc_tokens", "bucket",
                     "sequence_id", "offset"])
                number += k

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)


def write_buckets(pieces: DataFrame, path: str) -> None:
    """One folder of files per sequence length, for loaders that batch by it."""
    pieces.write.partitionBy("bucket").parquet(path)


def pieces_digest(pieces: DataFrame) -> DataFrame:
    """The pieces with a checksum instead of their ids."""
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
