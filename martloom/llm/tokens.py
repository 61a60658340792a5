"""Exact token ids, one encode per distinct word instead of one per word."""

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_loaded = {}
# white space other than single spaces and new lines, and the mark used for cutting
_ODD_SPACE = ("[\\x00\\t\\x0b\\x0c\\r\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}"
              "\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]|[ \\n]{2}")
# a word in Latin letters, then a mark: both vocabularies cut between the two
_WORD_AND_REST = re.compile("( ?[A-Za-zÀ-ÖØ-öø-ɏ]+)([!#$%&*,.:;?|].*)", re.DOTALL)


class Encoder:
    """Encodes string arrays with a byte-level vocabulary.

    Both byte-level vocabularies split a text into pieces before they merge,
    and no piece crosses from a visible character to a space or a new line.
    Where all white space is single spaces and new lines between words, a text
    may therefore be cut before each of them, and equal parts have equal ids.
    Parts are encoded once, many in one call with a separator whose single id
    shows where each part ends, and remembered (``remember`` parts at most,
    then the memory starts anew). Texts with other white space are encoded
    whole.
    """

    def __init__(self, path, remember=1_000_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.remember = remember
        self.sep = "\n" if self._whole("\n") else " 0 "
        [self.sep_id] = np.frombuffer(self._whole(self.sep), "<u4")
        self.known = {}

    def _whole(self, text):
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, parts):
        """Words apart from the marks behind them, so that fewer are new."""
        split = {p: m.groups() for p in parts if (m := _WORD_AND_REST.fullmatch(p))}
        known = self.known
        halves = dict.fromkeys(h for pair in split.values() for h in pair if h not in known)
        self._encode_parts([*halves, *(p for p in parts if p not in split and p not in halves)])
        known.update((p, known[a] + known[b]) for p, (a, b) in split.items())

    def _encode_parts(self, parts, per_call=2_000):
        alone = [p for p in parts if not p.strip() or self.sep.strip() and self.sep.strip() in p]
        self.known.update((p, self._whole(p)) for p in alone)
        alone = set(alone)
        parts = [p for p in parts if p not in alone]
        groups = [parts[at:at + per_call] for at in range(0, len(parts), per_call)]
        # a few groups at a time: the library's encodings are far larger than the ids
        found = (e for at in range(0, len(groups), 16) for e in self.tokenizer.encode_batch_fast(
            [self.sep.join(g) + self.sep for g in groups[at:at + 16]], add_special_tokens=False))
        for group, e in zip(groups, found):
            ids = np.asarray(e.ids, "<u4")
            ends = np.flatnonzero(ids == self.sep_id)
            if len(ends) != len(group):
                raise ValueError("a part holds the separator's id")
            data, starts = ids.tobytes(), np.concatenate([[0], ends[:-1] + 1])
            self.known.update((p, data[4 * a:4 * b]) for p, a, b in
                              zip(group, starts.tolist(), ends.tolist()))

    def encode(self, texts):
        """Ids of a string array without nulls: (flat uint32, end of each text)."""
        if len(self.known) > self.remember:
            self.known = {}
        odd = pc.match_substring_regex(texts, _ODD_SPACE).to_numpy(zero_copy_only=False)
        marked = pc.replace_substring(pc.replace_substring(texts, " ", "\0 "), "\n", "\0\n\0")
        marked = pc.if_else(pa.array(odd), "", marked)
        cut = pc.split_pattern(marked, "\0")
        ends = cut.offsets.to_numpy()[1:]
        words = cut.flatten().dictionary_encode()
        distinct = words.dictionary.to_numpy(zero_copy_only=False).tolist()  # far faster than to_pylist
        got = list(map(self.known.get, distinct))
        if None in got:
            self._learn([p for p, ids in zip(distinct, got) if ids is None])
            got = list(map(self.known.__getitem__, distinct))
        size = np.fromiter(map(len, got), np.int64, len(got)) // 4
        ids, start = np.frombuffer(b"".join(got), "<u4"), np.cumsum(size) - size
        at = words.indices.to_numpy()
        length = size[at]
        upto = np.cumsum(length)
        flat = ids[np.repeat(start[at] - (upto - length), length) + np.arange(length.sum())]
        ends = upto[ends - 1] if len(upto) else ends
        if odd.any():
            whole = {i: np.frombuffer(self._whole(texts[i].as_py()), "<u4") for i in np.flatnonzero(odd)}
            pieces = [whole[i] if odd[i] else flat[a:b] for i, (a, b) in
                      enumerate(zip(np.concatenate([[0], ends[:-1]]), ends))]
            flat, ends = np.concatenate(pieces), np.cumsum([len(p) for p in pieces])
        return flat, ends


def encoder(path, remember):
    """The worker's encoder for ``path``; it stays for the worker's next tasks."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel part
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    _loaded[path].remember = remember
    return _loaded[path]


def encoded_slices(batch, path, size=4_000_000, remember=1_000_000):
    """(first row, end row, flat ids, end of each row in them) for slices of an
    Arrow batch whose column ``text`` holds about ``size`` bytes; a null text
    is empty."""
    texts = pc.fill_null(batch.column("text"), "")
    upto = np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64))
    at = 0
    while at < len(texts):
        before = upto[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(upto, before + size, "right")))
        yield at, to, *encoder(path, remember).encode(pa.concat_arrays([texts.slice(at, to - at)]))
        at = to
