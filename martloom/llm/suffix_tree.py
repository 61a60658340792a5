"""Language-model scores from a probabilistic suffix tree.

A text is a sequence of words (lower-case A-Z, cut at ASCII white space) and one
end. The tree predicts a word's first two symbols from up to three last symbols
of the word before it, and each further symbol, and where the word stops, from a
variable number of symbols before it in the word. A context is a state if it is
frequent enough and if its next symbols diverge enough from those of the context
one symbol shorter. The longest state that is a suffix predicts, smoothed with
the shorter ones (Witten-Bell), down to a uniform code point; the first two
symbols of a word fall back on the tree's own probability of them.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F, Window as W

from ..operators.stable import stable
from .text import body

START, STOP, END, JOINT = "\t", " ", "\r", "\n"  # no word holds white space
TAIL, HEAD = 3, 2
CODE_POINTS = 0x110000
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h, x):
    h = (h ^ x.astype(np.uint64)) * _MIX
    return h ^ h >> np.uint64(29)


def positions(texts, depth):
    """(symbols, text of each, contexts) for texts that begin with START: the code
    points after it, and per depth 0..``depth`` the hash of that many symbols
    before each and where there are so many."""
    flat = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4").astype(np.uint64)
    size = np.array([len(t) for t in texts], np.int64)
    first = np.cumsum(size) - size
    text = np.repeat(np.arange(len(texts)), size)
    place = np.arange(len(flat)) - first[text]
    at = np.flatnonzero(place > 0)
    h, contexts = np.full(len(at), 1, np.uint64), []
    for d in range(depth + 1):
        if d:
            h = _mixed(h, flat[np.maximum(at - d, 0)] + np.uint64(1))
        contexts.append((h, place[at] >= d))
    return flat[at], text[at], contexts


def marked(word):
    return START + word + (STOP if word != END else "")


def joints(texts):
    """(symbols, contexts) for texts "tail JOINT head": the head as one symbol, and
    the hashes of the last 0..3 symbols of the tail."""
    tails = np.array([[*map(ord, t.partition(JOINT)[0][::-1].ljust(TAIL, "\0"))] for t in texts], np.uint64).reshape(-1, TAIL)
    size = np.array([t.index(JOINT) for t in texts], np.int64)
    heads = np.array([sum(ord(c) + 1 << 21 * i for i, c in enumerate(t.partition(JOINT)[2])) for t in texts], np.uint64)
    h, contexts = np.full(len(texts), 2, np.uint64), []
    for d in range(TAIL + 1):
        if d:
            h = _mixed(h, tails[:, d - 1] + np.uint64(1))
        contexts.append((h, size >= d))
    return heads, contexts


def _pair(context, symbol):
    return _mixed(context, symbol + np.uint64(CODE_POINTS))


def _counts(batches, depth, flush):
    """Rows (ctx, parent, depth, sym, n) for words with their counts."""
    def grouped(symbols, contexts, weight):
        parent = None
        for d, (h, there) in enumerate(contexts):
            up, parent = (h if parent is None else parent), h
            key, w, s, c, p = (x[there] for x in (_pair(h, symbols), weight, symbols, h, up))
            if not len(key):
                continue
            order = np.argsort(key)
            starts = np.flatnonzero(np.append(True, np.diff(key[order]) != 0))
            one, total = order[starts], np.add.reduceat(w[order], starts)
            near = np.argsort(c[one])  # rows of a context side by side compress well
            one, total = one[near], total[near]
            yield pa.record_batch(
                [pa.array(c[one].view(np.int64)), pa.array(p[one].view(np.int64)),
                 pa.array(np.full(len(one), d, np.int32)), pa.array(s[one].view(np.int64)),
                 pa.array(total)], ["ctx", "parent", "depth", "sym", "n"])

    def counted(texts, weights):
        joint = np.array([JOINT in t for t in texts])
        weights = np.asarray(weights, np.int64)
        symbols, word, contexts = positions([marked(t) for t, j in zip(texts, joint) if not j], depth)
        yield from grouped(symbols, contexts, weights[~joint][word])
        symbols, contexts = joints([t for t, j in zip(texts, joint) if j])
        yield from grouped(symbols, contexts, weights[joint])

    texts, weights = [], []
    for batch in batches:
        texts += batch.column("word").to_numpy(zero_copy_only=False).tolist()
        weights += batch.column("c").to_pylist()
        if len(texts) >= flush:
            yield from counted(texts, weights)
            texts, weights = [], []
    if texts:
        yield from counted(texts, weights)


def tree(counts: DataFrame, depth: int = 6, least_share: float = 1e-5, least: int = 2,
         nats: float = 4.0, flush: int = 300_000) -> DataFrame:
    """(ctx, sym, n, total, kinds) of the states of the tree. ``counts`` has
    distinct ``word`` (words and joints) with ``c`` occurrences.

    A context is a state if it occurs at least ``least`` times and ``least_share``
    times the number of tokens, and if (its count) x (Kullback-Leibler divergence
    from the context above it) is ``nats`` or more. So a depth has at most
    (symbols of a mean word) / ``least_share`` states, whatever the corpus.
    """
    rows = counts.filter("c > 0").select("word", "c").mapInArrow(
        lambda batches: _counts(batches, depth, flush), "ctx long, parent long, depth int, sym long, n long")
    # dealt by context, so that its symbols and its total meet without a further shuffle
    pairs = (rows.repartition("ctx").groupBy("ctx", "sym")
             .agg(F.sum("n").alias("n"), F.first("parent").alias("parent"), F.first("depth").alias("depth")))
    own = W.partitionBy("ctx")
    every = counts.filter(~F.col("word").contains(JOINT)).agg(F.sum("c")).first()[0] or 0
    pairs = stable(pairs.withColumn("total", F.sum("n").over(own)).withColumn("kinds", F.count(F.lit(1)).over(own))
                   .filter((F.col("depth") == 0) | (F.col("total") >= max(least, least_share * every))), "pairs")
    above = pairs.select(F.col("ctx").alias("parent"), "sym", (F.col("n") / F.col("total")).alias("q"))
    diverge = (pairs.filter("depth > 0").join(above, ["parent", "sym"])
               .groupBy("ctx").agg(F.sum(F.col("n") * F.log(F.col("n") / F.col("total") / F.col("q"))).alias("gain"))
               .filter(F.col("gain") >= nats).select("ctx"))
    return (pairs.filter("depth > 0").join(diverge, "ctx").select("ctx", "sym", "n", "total", "kinds")
            .unionByName(pairs.filter("depth = 0").select("ctx", "sym", "n", "total", "kinds")))


def packed(states: DataFrame) -> dict:
    """The tree as sorted arrays; its size is bounded by ``least_share``."""
    got = states.toArrow()
    ctx, sym, n, total, kinds = (got[c].to_numpy() for c in ("ctx", "sym", "n", "total", "kinds"))
    ctx, sym = ctx.view(np.uint64), sym.view(np.uint64)
    pair = _pair(ctx, sym)
    order = np.argsort(pair)
    some, first = np.unique(ctx, return_index=True)
    return {"pair": pair[order], "n": n[order].astype(np.float64), "ctx": some,
            "total": total[first].astype(np.float64), "kinds": kinds[first].astype(np.float64)}


def _found(sorted_keys, keys):
    if not len(sorted_keys):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return at, sorted_keys[at] == keys


def _smoothed(p, symbols, contexts, model):
    for h, there in contexts:
        at, state = _found(model["ctx"], h)
        use = np.flatnonzero(state & there)
        if len(use):
            place, seen = _found(model["pair"], _pair(h[use], symbols[use]))
            total, kinds = model["total"][at[use]], model["kinds"][at[use]]
            p[use] = (np.where(seen, model["n"][place], 0.0) + kinds * p[use]) / (total + kinds)
    return np.log10(p)


def log10_probability(texts, model, depth):
    """Of words: their symbols from the third on; of joints: the head after the tail."""
    joint = np.array([JOINT in t for t in texts])
    out = np.zeros(len(texts))
    inside = [marked(t) for t, j in zip(texts, joint) if not j]
    symbols, word, contexts = positions(inside, depth)
    logs = _smoothed(np.full(len(symbols), 1 / CODE_POINTS), symbols, contexts, model)
    if len(inside):
        place = np.arange(len(word)) - np.searchsorted(word, word)
        out[~joint] = np.bincount(word, np.where(place >= HEAD, logs, 0.0), len(inside))
    across = [t for t, j in zip(texts, joint) if j]
    if across:
        symbols, of, contexts = positions([START + t.partition(JOINT)[2] for t in across], depth)
        alone = np.bincount(of, _smoothed(np.full(len(symbols), 1 / CODE_POINTS), symbols, contexts, model), len(across))
        out[joint] = _smoothed(10.0 ** alone, *joints(across), model)
    return out


def coded(texts, tail=TAIL, head=HEAD):
    """(words, word of each token, tokens' end per text, joints, joint of each token)
    of a string array: lower-case A-Z, cut at ASCII white space, END after each."""
    cut = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    flat, ends = cut.flatten(), cut.offsets.to_numpy()[1:].astype(np.int64)
    real = pc.binary_length(flat).to_numpy() > 0  # white space at an end leaves an empty part
    if not real.all():
        ends = np.append(0, np.cumsum(real))[ends]
        flat = flat.filter(pa.array(real))
    found = flat.dictionary_encode()
    words = [*found.dictionary.to_numpy(zero_copy_only=False).tolist(), END]
    at = np.insert(found.indices.to_numpy().astype(np.int64), ends, len(words) - 1)
    ends = ends + np.arange(1, len(ends) + 1)
    ids = lambda x: np.unique(np.array(x, dtype=object).astype(str), return_inverse=True)
    tails, tail_of = ids([w[-tail:] for w in words] + [START])
    heads, head_of = ids([w if w == END else (w + STOP)[:head] for w in words])
    before = np.append(len(words), at[:-1])
    before[np.append(0, ends[:-1])[ends > np.append(0, ends[:-1])]] = len(words)
    pair = tail_of[before] * len(heads) + head_of[at]
    kinds, joint_at = np.unique(pair, return_inverse=True)
    joints = [f"{tails[k // len(heads)]}{JOINT}{heads[k % len(heads)]}" for k in kinds.tolist()]
    return words, at, ends, joints, joint_at


def _slices(batch, size=8_000_000):
    """(first row, end row, texts) of about ``size`` bytes each."""
    texts = batch.column("body")
    upto, at = np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64)), 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + size, "right")))
        yield at, to, pa.concat_arrays([texts.slice(at, to - at)])
        at = to


def _counted(batches):
    for batch in batches:
        train = batch.column("train").to_numpy(zero_copy_only=False)
        for first, to, texts in _slices(batch):
            words, at, ends, joints, joint_at = coded(texts)
            learn = np.repeat(train[first:to].astype(np.float64), np.diff(ends, prepend=0))
            for names, of in ((words, at), (joints, joint_at)):
                n = np.bincount(of, minlength=len(names))
                c = np.bincount(of, learn, len(names)).astype(np.int64)
                yield pa.record_batch([pa.array(names, pa.string()), pa.array(c), pa.array(n)], ["word", "c", "n"]
                                      ).filter(pa.array(n > 0))


def word_hash(words):
    """A 64-bit hash of each string."""
    return np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words)).view(np.int64)


def score(docs: DataFrame, train, depth: int = 6, common: int = 500_000, **options) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text; others are left out).

    ``train`` is the condition on doc_id of the documents that are learned from.
    Columns: n_tokens (words and the end), n_known (tokens that occur in
    training), train_tokens, base_score (log10 probability of the tokens by
    their smoothed counts), score (by the tree). A null or empty text is its end
    alone. Repeated rows are learned from as often as they occur and get equal
    rows. An empty table gives no rows; without training documents every code
    point is equally likely.

    Words and joints (a word's last symbols, the next word's first) are counted
    and scored once each. Those with at least one in ``common`` of all
    occurrences, ``common`` of them at most, are broadcast to where the texts are;
    only the rarer ones are shuffled, and none of those is hot.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), F.monotonically_increasing_id().alias("uid"),
                       F.coalesce(train, F.lit(False)).alias("train"), body("text").alias("body"))
    counts = stable(rows.select("train", "body").mapInArrow(_counted, "word string, c long, n long")
                    .groupBy("word").agg(F.sum("c").alias("c"), F.sum("n").alias("n")), "words")
    word = ~F.col("word").contains(JOINT)
    n, v, every = counts.agg(F.coalesce(F.sum(F.when(word, F.col("c"))), F.lit(0)),
                             F.count(F.when(word & (F.col("c") > 0), 1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    model = spark.sparkContext.broadcast(packed(tree(counts, depth, **options)))

    def scored(batches):
        for batch in batches:
            texts = batch.column("word").to_numpy(zero_copy_only=False).tolist()
            c = batch.column("c").to_numpy()
            is_word = np.array([JOINT not in t for t in texts])
            yield pa.record_batch(
                [batch.column("word"), pa.array(word_hash(texts)), batch.column("n"),
                 pa.array((is_word & (c > 0)).astype(np.int64)),
                 pa.array(np.where(is_word, np.log10((c + 0.5) / (n + 0.5 * (v + 1))), 0.0)),
                 pa.array(log10_probability(texts, model.value, depth))],
                ["word", "h", "n", "known", "base", "score"])

    known = stable(counts.mapInArrow(scored, "word string, h long, n long, known long, base double, score double"), "scored")
    hot = F.col("n") * common >= every
    # at most ``common`` rows
    top = known.filter(hot).select("word", "known", "base", "score").toArrow()
    values = np.stack([top[c].to_numpy().astype(np.float64) for c in ("known", "base", "score")], 1)
    shared = spark.sparkContext.broadcast((top["word"].to_pylist(), values))

    def summed(batches):
        """Per text the sums over common words, and a row for each rarer one."""
        names, values = shared.value
        place = dict(zip(names, range(len(names))))
        values = np.vstack([values, np.zeros((1, 3))])
        for batch in batches:
            ids, uids = batch.column("doc_id"), batch.column("uid").to_numpy()
            train = batch.column("train")
            for first, to, texts in _slices(batch):
                words, at, ends, joints, joint_at = coded(texts)
                total, far = np.zeros((to - first, 3)), []
                start = np.append(0, ends[:-1])
                for names_, of in ((words, at), (joints, joint_at)):
                    where = np.fromiter((place.get(w, len(names)) for w in names_), np.int64, len(names_))
                    total += np.add.reduceat(values[where[of]], start)
                    rare = np.flatnonzero(where[of] == len(names))
                    if len(rare):
                        used = np.unique(of[rare])
                        h = np.zeros(len(names_), np.int64)
                        h[used] = word_hash([names_[i] for i in used.tolist()])
                        far.append((uids[first + np.searchsorted(ends, rare, "right")], h[of[rare]]))
                own, k = uids[first:to], to - first
                m = sum(len(u) for u, _ in far)
                none = lambda kind: pa.nulls(m, kind)
                yield pa.record_batch(
                    [pa.concat_arrays([pa.array(own), *[pa.array(u) for u, _ in far]]),
                     pa.concat_arrays([pa.array(own), *[pa.array(h) for _, h in far]]),
                     pa.array(np.arange(k + m) >= k),
                     pa.concat_arrays([ids.slice(first, k), none(pa.int64())]),
                     pa.concat_arrays([train.slice(first, k), none(pa.bool_())]),
                     pa.concat_arrays([pa.array(ends - start), none(pa.int64())]),
                     *[pa.concat_arrays([pa.array(total[:, i]), none(pa.float64())]) for i in range(3)]],
                    ["uid", "h", "far", "doc_id", "train", "n_tokens", "known", "base", "score"])

    # a text's own row has its number in place of a hash, so that such rows spread over all tasks
    sums = rows.mapInArrow(summed, "uid long, h long, far boolean, doc_id long, train boolean, n_tokens long, "
                                   "known double, base double, score double")
    rare = known.filter(~hot).select("h", F.lit(True).alias("far"), *[F.col(c).cast("double").alias(f"r_{c}") for c in ("known", "base", "score")])
    parts = [F.sum(F.when(F.col("far"), F.col(f"r_{c}")).otherwise(F.col(c))).alias(c) for c in ("known", "base", "score")]
    return (sums.join(rare, ["h", "far"], "left").groupBy("uid").agg(
                F.max("doc_id").alias("doc_id"), F.max("train").alias("train"), F.max("n_tokens").alias("n_tokens"), *parts)
            .select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens",
                    F.round("known").cast("long").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
                    F.col("base").alias("base_score"), "score"))
