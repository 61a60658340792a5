"""Quality rules: statistics of each document, and lines that many documents of
a host share. Native expressions only."""

from pyspark.sql import DataFrame, functions as F

from ..operators.stable import stable
from .text import SPACE, body, words

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
SYMBOLS = "#*$%&|<>"


def _repeat_words():
    """Words inside 3-word windows that occur twice or more in ``words``.

    Most texts repeat no window, which the distinct count shows; the others
    sort their windows and look at the neighbours.
    """
    windows = """case when size(words) < 3 then array() else
        transform(sequence(0, size(words) - 3), i -> xxhash64(words[i], words[i + 1], words[i + 2])) end"""
    placed = "array_sort(transform(windows, (h, i) -> struct(h as h, i as i)))"
    again = """transform(filter(placed, (x, j) -> (j > 0 and placed[j - 1].h = x.h)
        or (j < size(placed) - 1 and placed[j + 1].h = x.h)), x -> x.i)"""
    return windows, placed, again


def measured(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``host`` and the base columns, a ``key`` that equal rows share,
    ``same`` that equal texts share, and ``lines``: for each line with a word the
    hash of its normalised form (lower case, digits as 0, single spaces), its place
    and its number of words."""
    windows, placed, again = _repeat_words()
    rows = docs.select(
        F.col("doc_id").cast("long"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("host"),
        F.xxhash64("doc_id", "source", "text").alias("key"), body("text").alias("body"))
    rows = rows.withColumn("parts", F.filter(F.split("body", "\n"), lambda l: F.trim(l, F.lit(SPACE)) != ""))
    rows = rows.withColumn("words", words(F.col("body")))
    rows = rows.withColumn("windows", F.expr(windows))
    rows = rows.withColumn("hashes", F.transform("parts", lambda l: F.xxhash64(F.regexp_replace(
        F.regexp_replace(F.lower(F.trim(l, F.lit(SPACE))), "[0-9]", "0"), "[ \\t-\\r]+", " "))))
    repeats = F.when(F.size(F.array_distinct("windows")) == F.size("windows"), F.lit(0)).otherwise(F.expr(f"""
        size(array_distinct(flatten(transform(
            transform(array({placed}), placed -> {again})[0], p -> array(p, p + 1, p + 2)))))"""))
    lines = F.expr("""transform(hashes, (h, j) -> struct(h as h, j as j,
        size(split(trim(both ' \\t\\n\\u000b\\f\\r' from parts[j]), '[ \\\\t-\\\\r]+')) as n))""")
    return rows.select(
        "doc_id", "host", "key", F.xxhash64("body").alias("same"), F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("body", f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
        (F.size("parts") - F.size(F.array_distinct("parts"))).cast("long").alias("n_dup_lines"),
        repeats.cast("long").alias("n_repeat_words"), lines.alias("lines"))


def shared_lines(lines: DataFrame, limit_docs: int) -> DataFrame:
    """(host, h) of the lines that more than ``limit_docs`` different texts of a host
    hold. Copies of one text count once; the limit is the same for a host of any
    size."""
    often = stable(lines.groupBy("host", "h").agg(F.count(F.lit(1)).alias("n"))
                   .filter(F.col("n") > limit_docs).select("host", "h"), "often")
    return (lines.join(often, ["host", "h"], "left_semi").select("host", "h", "same").distinct()
            .groupBy("host", "h").agg(F.count(F.lit(1)).alias("n"))
            .filter(F.col("n") > limit_docs).select("host", "h"))


def _judged(docs: DataFrame, min_words: int = 50, max_repeat_pct: int = 50, limit_docs: int = 10,
            min_left: float = 0.3) -> DataFrame:
    """``judge`` with ``shared_at``, the places of the shared lines among the lines
    with a word; null if there are none."""
    rows = stable(measured(docs).withColumn("uid", F.monotonically_increasing_id()), "measured")
    lines = rows.select("uid", "host", "same", F.inline("lines"))
    shared = stable(shared_lines(lines, limit_docs), "shared")
    found = (lines.join(shared, ["host", "h"], "left_semi").groupBy("uid").agg(
        F.sum("n").alias("n_shared_words"), F.sort_array(F.collect_list("j")).alias("shared_at")))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_pct * F.col("n_words"))
    shared_words = F.coalesce("n_shared_words", F.lit(0))
    return (rows.drop("lines").join(found, "uid", "left")
            .select("doc_id", "key", *BASE, failed.alias("base_failed"),
                    shared_words.cast("long").alias("n_shared_words"), "shared_at",
                    (~failed & (F.col("n_words") - shared_words >= min_left * F.col("n_words"))).alias("kept")))


def judge(docs: DataFrame, **options) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, source; others are left out):
    the base columns, ``base_failed``, ``n_shared_words`` (in lines above the
    limits: more than ``limit_docs``, 10, texts of a host), ``kept``.

    A document fails if it has fewer than ``min_words`` (50) words, if more than
    ``max_repeat_pct`` (50) percent of its words repeat, or if its shared lines leave
    less than ``min_left`` (0.3) of its words. A null or empty text has no words and
    fails; a null source is the host "". Repeated rows count as documents and
    get equal rows; an empty table gives none.
    """
    return _judged(docs, **options).drop("shared_at")


def keep_good(docs: DataFrame, **options) -> DataFrame:
    """The documents that are kept, without their shared lines: the other lines in
    order, and ``n_chars``, if there is one, anew. Texts without shared lines are as
    they were."""
    # rows of equal keys have equal lines, so any of their places will do
    good = _judged(docs, **options).filter("kept").groupBy(
        F.col("doc_id").alias("good_id"), F.col("key").alias("good_key")).agg(F.first("shared_at").alias("shared_at"))
    # the row itself in one column, so that no name of its own can clash
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"),
                       F.xxhash64("doc_id", "source", "text").alias("key"), F.col("text").cast("string").alias("body"))
    found = rows.join(good, F.col("id").eqNullSafe(F.col("good_id")) & (F.col("key") == F.col("good_key")))
    found = found.withColumn("raw", F.split("body", "\n")).withColumn("at", F.transform("raw", lambda l, i: i))
    placed = F.filter("at", lambda i: F.trim(F.get(F.col("raw"), i), F.lit(SPACE)) != "")
    found = found.withColumn("placed", placed)
    left = F.array_except("at", F.transform("shared_at", lambda j: F.get(F.col("placed"), j)))
    found = found.withColumn("new_text", F.when(F.col("shared_at").isNull(), F.col("body")).otherwise(
        F.array_join(F.transform(left, lambda i: F.get(F.col("raw"), i)), "\n")))
    new = {"text": F.col("new_text").cast(docs.schema["text"].dataType)}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("shared_at").isNull(), F.col("row")["n_chars"]).otherwise(
            F.length("new_text").cast(docs.schema["n_chars"].dataType))
    return found.select(*[(new[c] if c in new else F.col("row")[c]).alias(c) for c in docs.columns])
