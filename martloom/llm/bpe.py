"""Byte-level BPE with a contiguous rank array, and its decoder.

A word starts as one part per byte. Beside the parts stands the rank of each
adjacent pair; the smallest rank (the leftmost of equals) names the boundary to
delete, which leaves both arrays one shorter, and only the ranks left and right
of it are looked up anew. Distinct words of one length are a matrix, a row each,
so one numpy step scans, deletes and refreshes all of them. Words beyond ``short``
bytes, for which scanning would be quadratic, take the same merges from a heap.
"""

import heapq
import json
from unicodedata import category

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

NONE = np.iinfo(np.int32).max
_loaded = {}


def byte_letters():
    """The letter that stands for each byte in a byte-level vocabulary: printable
    Latin-1 letters stand for themselves, the other bytes follow from U+0100 on."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


def newer(word):
    """Whether the pattern's Unicode tables may class a letter of ``word`` otherwise
    than the library's: one assigned after the version that Python knows."""
    return not word.isascii() and any(category(c) == "Cn" for c in word)


class Bpe:
    """Vocabulary, ranks and remembered words of one tokenizer file."""

    def __init__(self, path, short=64):
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, vocab = spec["model"], spec["model"]["vocab"]
        pre = spec["pre_tokenizer"] or {}
        if (model["type"], pre.get("type"), pre.get("add_prefix_space"), spec["normalizer"],
                model.get("ignore_merges", False)) != ("BPE", "ByteLevel", False, None, False):
            raise ValueError("not a plain byte-level BPE file")
        self.short = short
        letters = byte_letters()
        byte_of = {c: b for b, c in enumerate(letters)}
        self.first = np.array([vocab[c] for c in letters], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left, right = (np.array([vocab[p[k]] for p in pairs], np.int64) for k in (0, 1))
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(left << 32 | right)
        self.keys, self.rank_of = (left << 32 | right)[order], order.astype(np.int32)
        self.bytes_of = {i: bytes(byte_of[c] for c in t) for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        self.cut = regex.compile("(" + "|".join(
            map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.pattern = regex.compile(public_tokenizers.PATTERN).findall
        self.library = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        self.forget()

    def forget(self):
        """Only the special tokens, whose strings the pattern never cuts out as a word."""
        self.known = {t: i.to_bytes(4, "little") for t, i in self.special.items()}

    def ranks(self, left, right):
        """Rank of each pair of part ids, NONE where the pair never merges."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank_of[at], NONE)

    def merge(self, rows):
        """Final ids of words of one length: ``rows`` is words x bytes. Yields
        (numbers of the words, their ids) as words come to an end."""
        number = np.arange(len(rows))
        parts = self.first[rows]
        rank = self.ranks(parts[:, :-1], parts[:, 1:])
        while len(parts):
            if parts.shape[1] == 1:
                yield number, parts
                return
            at = rank.argmin(1)
            best = rank[np.arange(len(rank)), at]
            done = best == NONE
            if done.any():
                yield number[done], parts[done]
                number, parts, rank, at, best = (x[~done] for x in (number, parts, rank, at, best))
            if not len(parts):
                return
            row, width = np.arange(len(parts)), parts.shape[1]
            parts[row, at] = self.merged[best]
            keep = np.ones(parts.shape, bool)
            keep[row, at + 1] = False  # the boundary's right part
            parts = parts[keep].reshape(len(row), width - 1)
            keep = np.ones(rank.shape, bool)
            keep[row, at] = False
            rank = rank[keep].reshape(len(row), width - 2)
            for beside in (at - 1, at):  # the pairs that end and begin with the merged part
                has = (beside >= 0) & (beside < width - 2)
                r, b = row[has], beside[has]
                rank[r, b] = self.ranks(parts[r, b], parts[r, b + 1])

    def merge_long(self, data):
        """Ids of one long word: the same merges, the next one from a heap."""
        ids = self.first[np.frombuffer(data, np.uint8)]
        rank = self.ranks(ids[:-1], ids[1:])
        heap = [(int(rank[i]), i) for i in np.flatnonzero(rank != NONE)]
        heapq.heapify(heap)
        now, n = dict(enumerate(rank.tolist())), len(ids)
        ids, after, before = ids.tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            best, i = heapq.heappop(heap)
            if now.get(i) != best:  # that pair is gone
                continue
            j = after[i]
            ids[i], ids[j], after[i] = int(self.merged[best]), None, after[j]
            now.pop(j, None)
            if after[i] < n:
                before[after[i]] = i
            for a in (before[i], i):
                if a >= 0 and after[a] < n:
                    b = after[a]
                    now[a] = int(self.ranks(np.int64(ids[a]), np.int64(ids[b])))
                    if now[a] != NONE:
                        heapq.heappush(heap, (now[a], a))
                elif a >= 0:
                    now.pop(a, None)
        return np.array([i for i in ids if i is not None], "<u4")

    def learn(self, words):
        """Remember the ids of ``words``, as little-endian uint32 bytes."""
        by_size = {}
        for w in words:
            data = w.encode()
            if len(data) > self.short:
                self.known[w] = self.merge_long(data).tobytes()
            elif data:
                by_size.setdefault(len(data), []).append((w, data))
        for size, group in by_size.items():
            rows = np.frombuffer(b"".join(d for _, d in group), np.uint8).reshape(-1, size)
            for numbers, parts in self.merge(rows):
                flat, width = parts.astype("<u4").tobytes(), 4 * parts.shape[1]
                self.known.update((group[n][0], flat[k * width:(k + 1) * width])
                                  for k, n in enumerate(numbers.tolist()))

    def words(self, text, cut):
        """The words of a text in order, special tokens among them; ``cut`` cuts what
        is between these."""
        if self.cut is None or not self.cut.search(text):
            return cut(text)
        return [w for part in self.cut.split(text)
                for w in ([part] if part in self.special else cut(part))]

    def by_library(self, text):
        return [text[a:b] for _, (a, b) in self.library(text)]

    def encode(self, texts, remember):
        """Ids of each text, as little-endian uint32 bytes; about ``remember`` distinct
        words stay known."""
        if len(self.known) > remember:
            self.forget()
        known = self.known
        lists = [self.words(t, self.pattern) for t in texts]
        new = {w for ws in lists for w in ws if w not in known}
        if odd := set(filter(newer, new)):  # never remembered, so that each such text is seen
            lists = [ws if odd.isdisjoint(ws) else self.words(t, self.by_library) for t, ws in zip(texts, lists)]
            new = {w for ws in lists for w in ws if w not in known}
        self.learn(new)
        out = [b"".join(map(known.__getitem__, ws)) for ws in lists]
        for w in filter(newer, new if odd else ()):
            del known[w]
        return out

    def decode(self, ids):
        """The text of an id sequence; bytes that are no UTF-8 become U+FFFD, ids
        that the vocabulary lacks are left out."""
        known = self.bytes_of
        try:
            data = b"".join(map(known.__getitem__, ids))
        except KeyError:
            data = b"".join(known.get(i, b"") for i in ids)
        return data.decode("utf-8", "replace")


def bpe(path):
    """The worker's tokenizer for ``path``; it stays for the worker's next tasks."""
    if path not in _loaded:
        _loaded[path] = Bpe(path)
    return _loaded[path]


def encode(docs: DataFrame, path: str, size: int = 4_000_000, remember: int = 500_000) -> DataFrame:
    """doc_id, n_tokens and ``ids`` (little-endian uint32) of every row of ``docs``,
    as the tokenizers library encodes with the file ``path`` and without added
    special tokens; the string of a special token in a text is that token.

    Other columns are left out. A null or empty text has no ids. Rows that repeat are
    encoded as often as they occur; a null doc_id stays null; an empty table gives
    no rows. One map, nothing is shuffled. ``size`` (bytes of text at a time) and
    ``remember`` (distinct words) bound a worker's memory beside one whole text.
    """
    def run(batches):
        for batch in batches:
            texts = pc.fill_null(batch.column("text"), "")
            for at, to in slices(pc.binary_length(texts), size):
                ids = bpe(path).encode(texts.slice(at, to - at).to_pylist(), remember)
                yield pa.record_batch(
                    [batch.column("doc_id").slice(at, to - at), pa.array([len(x) // 4 for x in ids], pa.int64()),
                     pa.array(ids, pa.binary())], ["doc_id", "n_tokens", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, n_tokens long, ids binary")


def decode(encoded: DataFrame, path: str, size: int = 8_000_000) -> DataFrame:
    """``encoded`` with a column ``text`` in place of any such: the text of ``ids``,
    special tokens included. Null ids are an empty text."""
    rows = encoded.select(F.struct("*").dropFields("text").alias("row"), "ids")

    def run(batches):
        for batch in batches:
            ids = batch.column("ids")
            for at, to in slices(pc.fill_null(pc.binary_length(ids), 0), size):
                texts = [bpe(path).decode(np.frombuffer(x or b"", "<u4").tolist())
                         for x in ids.slice(at, to - at).to_pylist()]
                yield pa.record_batch([batch.column("row").slice(at, to - at), pa.array(texts, pa.string())],
                                      ["row", "text"])

    schema = T.StructType([rows.schema["row"], T.StructField("text", T.StringType())])
    return rows.mapInArrow(run, schema).select("row.*", "text")


def slices(sizes, most):
    """(first, end) of runs of rows with about ``most`` bytes, one row at least."""
    upto, at = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64)), 0
    while at < len(upto):
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + most, "right")))
        yield at, to
        at = to
