"""Token files compressed by Re-Pair grammars, one grammar per shard.

A shard is one row of a Parquet file: the documents' ids, where their symbols
end, the symbols (uint16 or uint32, little-endian), the rules (pairs of symbols,
uint32) and the rules' expansion lengths (uint32). Symbols below ``first`` are
token ids, symbol ``first + r`` stands for rule r. No symbol crosses documents,
so any document, or any run of its tokens, is decoded on its own.
"""

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from .tokens import encoded_slices

SCHEMA = ("part int, shard long, part_start long, n_tokens long, first long, doc_ids array<long>, "
          "symbol_ends array<long>, doc_tokens array<long>, symbols binary, rules binary, "
          "lengths binary")
DOC_SCHEMA = "part int, shard long, part_start long, doc_id long, n_tokens long, ids binary"


def grammar(ids, ends, first, rounds=4, per_round=4000, least=24):
    """Re-Pair in rounds: each round counts all pairs of neighbours inside
    documents, takes the ``per_round`` most frequent ones with at least
    ``least`` uses, and replaces them, a more frequent pair before the pairs it
    overlaps. Returns (symbols, ends of documents in them, rules)."""
    seq, rules = ids.astype(np.uint64), np.zeros((0, 2), np.uint32)
    last = np.zeros(len(seq), bool)
    last[np.asarray(ends)[np.diff(ends, prepend=0) > 0] - 1] = True
    shift = np.uint64(32)
    for _ in range(rounds):
        if len(seq) < 2:
            break
        key = seq[:-1] << shift | seq[1:]
        # a rough count first: pairs in thin buckets need no exact one
        bucket = (key * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(44)).astype(np.int32)
        bucket[last[:-1]] = 1 << 20
        full = np.bincount(bucket, minlength=(1 << 20) + 1)
        full[1 << 20] = 0
        at = np.flatnonzero((full >= least)[bucket])
        some = np.sort(key[at])
        starts = np.flatnonzero(np.append(True, some[1:] != some[:-1])) if len(some) else at
        count = np.diff(np.append(starts, len(some)))
        starts, count = starts[count >= least], count[count >= least]
        if not len(count):
            break
        # most frequent first, ties by the pair itself
        best = np.argsort(-count, kind="stable")[:per_round]
        rank = np.empty(len(best), np.int64)
        pairs = some[starts[best]]
        order = np.argsort(pairs)
        rank[order] = order
        place = np.minimum(np.searchsorted(pairs[order], key[at]), len(pairs) - 1)
        hit = pairs[order][place] == key[at]
        weight = np.zeros(len(key) + 2, np.int32)
        weight[1 + at[hit]] = len(pairs) - order[place[hit]]
        here = weight[1:-1]
        win = np.flatnonzero((here > weight[:-2]) & (here >= weight[2:]))
        rule = len(pairs) - here[win]
        used = np.bincount(rule, minlength=len(pairs)) >= least
        win, rule = win[used[rule]], rule[used[rule]]
        if not len(win):
            break
        number = np.cumsum(used) - 1 + first + len(rules)
        made = pairs[used]
        rules = np.concatenate([rules, np.stack(
            [made >> shift, made & np.uint64(0xFFFFFFFF)], 1).astype(np.uint32)])
        seq[win] = number[rule]
        last[win] = last[win + 1]
        keep = np.ones(len(seq), bool)
        keep[win + 1] = False
        seq, last = seq[keep], last[keep]
    symbol_ends = np.zeros(len(ends), np.int64)
    symbol_ends[np.diff(ends, prepend=0) > 0] = np.flatnonzero(last) + 1
    return seq, np.maximum.accumulate(symbol_ends), rules


def expansions(rules, first):
    """(flat tokens of all rules, their lengths); a rule only uses earlier ones."""
    out = []
    for a, b in rules.tolist():
        out.append(np.concatenate([out[s - first] if s >= first else np.array([s], np.uint32)
                                   for s in (a, b)]))
    return (np.concatenate(out) if out else np.zeros(0, np.uint32),
            np.array([len(x) for x in out], np.int64))


def _symbols(shard):
    kind = "<u2" if shard["first"] + len(shard["lengths"]) // 4 <= 1 << 16 else "<u4"
    return np.frombuffer(shard["symbols"], kind).astype(np.int64)


def expand(symbols, first, rules):
    """The token ids that the symbols stand for."""
    flat, length = expansions(rules, first)
    flat = np.concatenate([np.arange(first, dtype=np.uint32), flat])
    start = np.concatenate([np.arange(first), first + np.cumsum(length) - length])
    size = np.concatenate([np.ones(first, np.int64), length])[symbols]
    upto = np.cumsum(size)
    return flat[np.repeat(start[symbols] - (upto - size), size) + np.arange(size.sum())]


def decode(shard, doc=None, begin=0, end=None):
    """Ids of a shard (a row as a dict), or of tokens ``begin`` to ``end`` of its
    ``doc``-th document, for which only the symbols that cover them are expanded."""
    symbols, first = _symbols(shard), shard["first"]
    rules = np.frombuffer(shard["rules"], "<u4").reshape(-1, 2)
    if doc is None:
        return expand(symbols, first, rules)
    ends = shard["symbol_ends"]
    symbols = symbols[ends[doc - 1] if doc else 0:ends[doc]]
    length = np.frombuffer(shard["lengths"], "<u4")
    size = np.ones(len(symbols), np.int64)
    size[symbols >= first] = length[symbols[symbols >= first] - first]
    upto = np.cumsum(size)
    end = int(upto[-1]) if end is None and len(upto) else end or 0
    a, b = np.searchsorted(upto, begin, "right"), np.searchsorted(upto, end, "left") + 1
    skip = begin - (int(upto[a - 1]) if a else 0)
    return expand(symbols[a:b], first, rules)[skip:skip + max(0, end - begin)]


def _shard(part, number, start, doc_ids, flat, ends, first):
    symbols, symbol_ends, rules = grammar(flat, ends, first)
    length = expansions(rules, first)[1].astype("<u4")
    kind = "<u2" if first + len(rules) <= 1 << 16 else "<u4"
    row = [part, number, start, len(flat), first, doc_ids, symbol_ends.tolist(),
           np.diff(ends, prepend=0).tolist(), symbols.astype(kind).tobytes(),
           rules.astype("<u4").tobytes(), length.tobytes()]
    kinds = [pa.int32(), *[pa.int64()] * 4, *[pa.list_(pa.int64())] * 3, *[pa.binary()] * 3]
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return pa.record_batch([pa.array([v], k) for v, k in zip(row, kinds)], names)


def shards(docs: DataFrame, tokenizer: str, end_id: int = 2, first: int = 49408,
           shard_tokens: int = 1_000_000) -> DataFrame:
    """Grammar shards of all documents in ascending order of doc_id.

    ``first`` is the size of the vocabulary. A shard closes once it holds
    ``shard_tokens``; a longer document fills one shard alone. A null or empty
    text is the end id alone; repeated rows are written as often as they occur,
    a null doc_id comes first; other columns are left out. No rows give no
    shards.
    """
    def run(batches):
        part = TaskContext.get().partitionId()
        number, start, held, docs_, flats, sizes = 0, 0, 0, [], [], []
        for batch in batches:
            for a, b, flat, ends in encoded_slices(batch, tokenizer):
                count = np.diff(ends, prepend=0) + 1
                flat, names = np.insert(flat, ends, end_id), batch.column("doc_id")[a:b].to_pylist()
                upto, at = np.cumsum(count), 0
                while at < len(names):
                    done = upto[at - 1] if at else 0
                    to = int(np.searchsorted(upto, done + shard_tokens - held, "left")) + 1
                    to = min(to, len(names))
                    docs_ += names[at:to]
                    flats.append(flat[done:upto[to - 1]])
                    sizes.append(count[at:to])
                    held += len(flats[-1])
                    at = to
                    if held >= shard_tokens:
                        yield _shard(part, number, start, docs_, np.concatenate(flats),
                                     np.cumsum(np.concatenate(sizes)), first)
                        number, start, held = number + 1, start + held, 0
                        docs_, flats, sizes = [], [], []
        if docs_:
            yield _shard(part, number, start, docs_, np.concatenate(flats),
                         np.cumsum(np.concatenate(sizes)), first)

    placed = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return (placed.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
            .mapInArrow(run, SCHEMA))


def write_shards(docs: DataFrame, path: str, tokenizer: str, **options) -> None:
    shards(docs, tokenizer, **options).write.option("compression", "zstd").parquet(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """Every document of the files with its decoded ids (little-endian uint32)
    and ``start``, the number of ids before it."""
    def run(batches):
        for batch in batches:
            for shard in batch.to_pylist():
                ids, count = decode(shard), np.array(shard["doc_tokens"])
                k, ends = len(count), np.cumsum(count)
                offsets = np.append(0, 4 * ends).astype(np.int32)
                yield pa.record_batch(
                    [pa.array([shard["part"]] * k, pa.int32()), pa.array([shard["shard"]] * k, pa.int64()),
                     pa.array(shard["part_start"] + ends - count), pa.array(shard["doc_ids"], pa.int64()),
                     pa.array(count), pa.Array.from_buffers(pa.binary(), k, [
                         None, pa.py_buffer(offsets), pa.py_buffer(ids.astype("<u4"))])],
                    ["part", "shard", "part_start", "doc_id", "n_tokens", "ids"])

    files = spark.read.schema(SCHEMA).parquet(path)
    # one row per range partition: no more than spark.sql.shuffle.partitions, so it is broadcast
    totals = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    totals = totals.select(F.col("part").alias("_part"), F.expr(
        "coalesce(sum(n) over (order by part rows between unbounded preceding and 1 preceding), 0)"
    ).alias("_before"))
    return (files.mapInArrow(run, DOC_SCHEMA).join(F.broadcast(totals), F.col("part") == F.col("_part"))
            .withColumn("start", F.col("part_start") + F.col("_before"))
            .drop("_part", "_before", "part_start"))
