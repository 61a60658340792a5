"""Secret scans: long tokens are candidates, and a random forest on their form and
surroundings removes the false positives. DataFrame operations and Spark's own
forest only."""

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from ..operators.stable import stable
from .text import body, lower_ascii, words

VALUE = "[A-Za-z0-9+/_-]{16,}={0,2}"
# Words that name a secret, words of made-up values, path parts of tests.
NAMES = "(?i)(token|secret|passw(or)?d|passwd|pwd|api_?key|access_?key|private_?key|credential|auth|bearer)"
MADE_UP = "(?i)(example|sample|dummy|placeholder|changeme|test|fake|xxxx|0000|1234)"
TEST_PATH = "(?i)(test|example|sample|mock|fixture|doc)"
FEATURES = ["length", "transitions", "digits", "upper", "distinct", "entropy", "hexadecimal", "coverage",
            "named", "assigned", "quoted", "made_up", "in_path", "test_path", "around"]
CONTEXT = ["named", "assigned", "quoted", "around"]


def candidates(docs: DataFrame) -> DataFrame:
    """One row per long token: doc_id, key (shared by equal rows), path, value,
    ``before`` (what stands before it, up to two words) and ``after``."""
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("doc_id", "text").alias("key"),
                       F.coalesce(F.col("source").cast("string"), F.lit("")).alias("path"),
                       words(body("text")).alias("words"))
    near = F.expr("""transform(filter(sequence(0, size(words) - 1), i -> length(words[i]) >= 16), i -> struct(
        words[i] as word, concat_ws(' ', get(words, i - 2), get(words, i - 1)) as left, get(words, i + 1) as right))""")
    found = (rows.filter(F.size("words") > 0).select("doc_id", "key", "path", F.explode(near).alias("w"))
             .select("doc_id", "key", "path", "w.*", F.explode(F.array_distinct(F.regexp_extract_all("w.word", F.lit(VALUE), F.lit(0)))).alias("value")))
    at = F.instr("word", F.col("value"))
    return found.select(
        "doc_id", "key", "path", "value", F.concat_ws(" ", "left", F.expr(f"left(word, instr(word, value) - 1)")).alias("before"),
        F.concat_ws(" ", F.substring("word", at + F.length("value"), F.length("word")), "right").alias("after")).distinct()


def dictionary(docs: DataFrame, least: float = 1e-5) -> list[int]:
    """Letter triples of the corpus's words as a bit set: those that make up at
    least ``least`` of all triples of all texts' distinct words. 26^3 bits."""
    counted = (docs.select(F.explode(F.array_distinct(words(lower_ascii(body("text"))))).alias("w"))
               .groupBy("w").agg(F.count(F.lit(1)).alias("n")))
    triples = (counted.select("n", F.regexp_extract("w", "[a-z]{3,12}", 0).alias("w")).filter(F.length("w") >= 3)
               .select("n", F.explode(F.expr(_triples("w"))).alias("t")).groupBy("t").agg(F.sum("n").alias("n")))
    got = triples.groupBy((F.col("t") / 64).cast("int").alias("slot")).agg(
        F.collect_list(F.struct("t", "n")).alias("tn")).collect()  # at most 26^3 triples
    total = sum(x["n"] for r in got for x in r["tn"])
    bits = [0] * (26 ** 3 // 64 + 1)
    for r in got:
        for x in r["tn"]:
            if x["n"] >= least * total:
                bits[r["slot"]] |= 1 << x["t"] % 64
    return [b - (1 << 64) if b >> 63 else b for b in bits]


def _triples(c):
    code = lambda k: f"(ascii(substring({c}, i + {k}, 1)) - 97)"
    return f"transform(sequence(1, length({c}) - 2), i -> {code(0)} * 676 + {code(1)} * 26 + {code(2)})"


def described(found: DataFrame, bits: list[int]) -> DataFrame:
    """Adds the columns of FEATURES."""
    v, low, n = F.col("value"), F.lower("value"), F.length("value")
    share = lambda drop: (n - F.length(F.regexp_replace("value", drop, ""))) / n
    kind = F.expr("""transform(split(value, ''), c -> case when c rlike '[0-9]' then 0 when c rlike '[a-z]' then 1
                     when c rlike '[A-Z]' then 2 else 3 end)""")
    listed = "array(" + ", ".join(f"{b}L" if b > -(1 << 63) else "cast('-9223372036854775808' as bigint)" for b in bits) + ")"
    triple = f"""transform(sequence(1, length(value) - 2), i -> if(substring(lower(value), i, 3) rlike '^[a-z]{{3}}$',
        (ascii(substring(lower(value), i, 1)) - 97) * 676 + (ascii(substring(lower(value), i + 1, 1)) - 97) * 26
        + (ascii(substring(lower(value), i + 2, 1)) - 97), -1))"""
    rows = (found.withColumn("kinds", kind).withColumn("chars", F.split("value", ""))
            .withColumn("triples", F.expr(triple)).withColumn("bits", F.expr(listed)))
    return rows.select(
        *found.columns, n.cast("double").alias("length"),
        (F.expr("size(filter(sequence(1, size(kinds) - 1), i -> kinds[i] != kinds[i - 1]))") / n).alias("transitions"),
        share("[0-9]").alias("digits"), share("[A-Z]").alias("upper"),
        (F.size(F.array_distinct("chars")) / n).alias("distinct"),
        F.expr("""aggregate(array_distinct(chars), cast(0 as double), (s, c) -> s
            - size(filter(chars, x -> x = c)) / size(chars) * log2(size(filter(chars, x -> x = c)) / size(chars)))""").alias("entropy"),
        v.rlike("^([0-9a-f]+|[0-9A-F]+)$").cast("double").alias("hexadecimal"),
        (F.expr("size(filter(triples, t -> t >= 0 and shiftright(bits[cast(t / 64 as int)], t % 64) & 1 = 1))") / (n - 2)).alias("coverage"),
        F.col("before").rlike(NAMES).cast("double").alias("named"),
        F.col("before").rlike("[=:]\\s*[\"'`]?$").cast("double").alias("assigned"),
        (F.col("before").rlike("[\"'`]$") & F.col("after").rlike("^[\"'`]")).cast("double").alias("quoted"),
        F.concat_ws(" ", "before", "value", "after").rlike(MADE_UP).cast("double").alias("made_up"),
        (F.col("before").rlike("[/\\\\]$") | F.col("before").rlike("https?:") | v.rlike("/.*/")).cast("double").alias("in_path"),
        F.col("path").rlike(TEST_PATH).cast("double").alias("test_path"),
        (F.length(F.regexp_replace(F.concat_ws("", "before", "after"), "[A-Za-z ]", ""))
         / (F.length(F.concat_ws("", "before", "after")) + 1)).alias("around"))


def labelled(found: DataFrame) -> DataFrame:
    """Findings that their form decides, with ``label``: 1 for a known key format
    and for a mixed value assigned to a name of a secret, 0 for words, plain
    numbers and values made of the dictionary's triples. Each also once with the
    other class's surroundings, so that the value counts, not its place alone."""
    mixed = (F.col("digits") > 0) & (F.col("digits") < 1) & (F.col("coverage") < 0.5)
    yes = F.col("value").rlike("^AKIA[0-9A-Z]{16}$") | (mixed & (F.col("named") == 1) & (F.col("assigned") == 1))
    no = (F.col("digits") == 0) & (F.col("coverage") >= 0.5) | (F.col("digits") == 1)
    sure = found.withColumn("label", F.when((F.col("made_up") == 1) & no, F.lit(0.0)).when(yes, F.lit(1.0)).when(no, F.lit(0.0)))
    sure = sure.filter(F.col("label").isNotNull())
    swapped = sure.withColumns({c: F.when(F.col("label") == 1, F.lit(0.0)).otherwise(F.lit(1.0)) for c in CONTEXT if c != "around"}
                               | {"around": F.lit(0.1)})
    return sure.unionByName(swapped)


def forest(findings: DataFrame, most: int = 8000, trees: int = 30, depth: int = 6):
    """Fits the forest on at most about ``most`` findings of each label, chosen by
    a hash of the value. Null if a label has none."""
    sizes = {r["label"]: r["count"] for r in findings.groupBy("label").count().collect()}
    if set(sizes) != {0.0, 1.0}:
        return None
    share = F.when(F.col("label") == 1, F.lit(min(1.0, most / sizes[1.0]))).otherwise(F.lit(min(1.0, most / sizes[0.0])))
    some = findings.filter(F.pmod(F.xxhash64("value", "key"), F.lit(1 << 30)) < share * (1 << 30))
    # a bounded sample in one order: the bootstrap draws alike each time
    some = stable(some.select("label", *FEATURES).repartition(1).sortWithinPartitions("label", *FEATURES), "findings")
    weight = {k: (sizes[0.0] + sizes[1.0]) / (2 * v) for k, v in sizes.items()}
    some = some.withColumn("weight", F.when(F.col("label") == 1, weight[1.0]).otherwise(weight[0.0]))
    ready = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(some)
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=5, weightCol="weight").fit(ready)


def scan(docs: DataFrame, findings: DataFrame | None = None, least: float = 0.5, **options) -> DataFrame:
    """One row per secret and document: doc_id, key, value, ``probability``.

    ``docs`` has doc_id, text and source (the path); others are left out.
    ``findings`` are labelled ones with FEATURES, key and value; without them the
    documents' own clear cases are learned from. A value that repeats in a document
    is one row, equal documents have one row set. A null or empty text has no
    candidates; without candidates of both labels the clear cases are the result.
    """
    found = stable(described(candidates(docs), dictionary(docs)), "candidates")
    known = labelled(found) if findings is None else findings
    model = forest(known, **options)
    if model is None:
        sure = labelled(found).filter("label = 1").select("doc_id", "key", "value").distinct()
        return sure.withColumn("probability", F.lit(1.0))
    ready = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(found)
    p = vector_to_array("probability").getItem(1)
    return (model.transform(ready).select("doc_id", "key", "value", p.alias("probability"))
            # a value that repeats with other surroundings counts at its likeliest place
            .groupBy("doc_id", "key", "value").agg(F.max("probability").alias("probability"))
            .filter(F.col("probability") >= least))


def redact(docs: DataFrame, mask: str = "[SECRET]", **options) -> DataFrame:
    """The documents with every secret's value replaced by ``mask`` and n_chars
    counted anew; texts without secrets and all other columns stay as they are."""
    found = (scan(docs, **options).groupBy(F.col("doc_id").alias("found_id"), F.col("key").alias("found_key"))
             # longest first, so that no value is cut by a shorter one; the values of one text
             .agg(F.sort_array(F.collect_set(F.struct(F.length("value").alias("n"), "value")), asc=False).alias("secrets")))
    # the row itself in one column, so that no name of its own can clash
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"),
                       F.xxhash64("doc_id", "text").alias("key"), F.col("text").alias("body"))
    joined = rows.join(found, F.col("id").eqNullSafe(F.col("found_id")) & (F.col("key") == F.col("found_key")), "left")
    clean = F.aggregate(F.coalesce("secrets", F.array()), F.col("body"), lambda t, s: F.replace(t, s["value"], F.lit(mask)))
    has = F.col("secrets").isNotNull()
    changed = {"text": F.when(has, clean).otherwise(F.col("body"))}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(has, F.length(clean).cast(dict(docs.dtypes)["n_chars"])).otherwise(F.col("row")["n_chars"])
    return joined.select(*[(changed[c] if c in changed else F.col("row")[c]).alias(c) for c in docs.columns])
