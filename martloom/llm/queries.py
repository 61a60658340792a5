"""The registered queries of this subpackage and their SQL checks."""

import public_tokenizers

from pyspark.sql import functions as F

from ..operators.stable import scratch_path
from . import (audit, bpe, classifier, imatch, license, mixing, pack, quality, repair, secrets, simhash, suffix_tree,
               trie)

QUERIES, ORACLES = {}, {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query
def op1_power_of_two_packing(spark, sf_dir):
    """Pieces of power-of-two lengths, 2048 at most, end id 1."""
    return pack.pieces_digest(pack.pack(
        documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), 2048, 1))


@query
def op4_repair_token_files(spark, sf_dir):
    """Grammar shards in order of doc_id, written and read back; end id 2."""
    path = scratch_path(spark, "shards")
    repair.write_shards(documents(spark, sf_dir), path,
                        public_tokenizers.path("word_bpe_49k.json"), end_id=2, first=49408)
    return repair.read_shards(spark, path).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"), "shard")


@query
def op10_simhash_components(spark, sf_dir):
    """64-bit fingerprints of 3-word shingles, linked within two bits."""
    found = simhash.groups(documents(spark, sf_dir), width=3, field=2)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


ORACLES["op9_line_frequency_rules"] = r"""
WITH d AS (SELECT row_number() OVER () AS uid, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS body
    FROM documents),
  t AS (SELECT *, regexp_extract_all(body, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(body, chr(10)),
    lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS parts FROM d),
  g AS (SELECT uid, i, count(*) OVER (PARTITION BY uid, w[i], w[i + 1], w[i + 2]) AS n
    FROM (SELECT uid, w, unnest(range(1, len(w) - 1)) AS i FROM t)),
  again AS (SELECT uid, count(DISTINCT i + k) AS n_repeat_words FROM g, (SELECT unnest([0, 1, 2]) AS k)
    WHERE n > 1 GROUP BY uid),
  b AS (SELECT uid, doc_id, host, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
    length(regexp_replace(body, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
    len(parts) - len(list_distinct(parts)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
    FROM t LEFT JOIN again USING (uid)),
  x AS (SELECT uid, host, unnest(parts) AS part, generate_subscripts(parts, 1) AS j FROM t),
  line AS (SELECT uid, host, j, len(regexp_extract_all(part, '[^\x20\x09-\x0D]+')) AS n, regexp_replace(
      regexp_replace(lower(regexp_replace(part, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')), '[0-9]', '0', 'g'),
      '[\x20\x09-\x0D]+', ' ', 'g') AS h FROM x),
  shared AS (SELECT host, h FROM line JOIN (SELECT uid, sha256(body) AS same FROM d) USING (uid)
    GROUP BY host, h HAVING count(DISTINCT same) > 10),
  gone AS (SELECT uid, sum(n)::BIGINT AS n_shared_words FROM line JOIN shared USING (host, h) GROUP BY uid)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, coalesce(n_shared_words, 0) AS n_shared_words,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)
    AND n_words - coalesce(n_shared_words, 0) >= 0.3 * n_words AS kept
FROM b LEFT JOIN gone USING (uid)"""


@query
def op9_line_frequency_rules(spark, sf_dir):
    """Base statistics, and the verdict with lines that a host's documents share."""
    return quality.judge(documents(spark, sf_dir)).drop("key")


@query
def op7_license_diagonals(spark, sf_dir):
    """Licence phrases and notices by votes on offset diagonals."""
    return license.scan(documents(spark, sf_dir))


@query
def op2_imatch_fingerprints(spark, sf_dir):
    """I-Match fingerprints of each text and of its half-edited form."""
    return imatch.fingerprints(documents(spark, sf_dir))


def fold(n, k):
    """Rows whose crc32 of the doc_id's digits is k modulo n."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n == k


@query
def op8_suffix_tree_scores(spark, sf_dir):
    """Log10 probabilities by word counts and by the suffix tree."""
    return suffix_tree.score(documents(spark, sf_dir), train=~fold(5, 1))


@query
def op5_quality_classifier(spark, sf_dir):
    """Calibrated quality scores, learned from the labels outside the held-out fold."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    found = classifier.score(documents(spark, sf_dir), labels, train=~fold(5, 0))
    return found.select("doc_id", fold(5, 0).alias("held_out"), "score",
                        (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query
def op6_secret_forest(spark, sf_dir):
    """Secrets of every document, by the forest."""
    return secrets.scan(documents(spark, sf_dir)).select(
        "doc_id", F.sha2(F.col("value").cast("binary"), 256).alias("value_sha256"),
        F.length("value").cast("long").alias("length"), F.expr("left(value, 4)").alias("starts"), "probability")


@query
def op3_raked_mixture(spark, sf_dir):
    """Half of all tokens, with tempered source, language and topic marginals."""
    return mixing.probabilities(documents(spark, sf_dir), rate=0.5, power=0.7).drop("key")


@query
def op11_rank_array_bpe(spark, sf_dir):
    """Ids of all texts and, from these ids, the texts again."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    decoded = bpe.decode(bpe.encode(documents(spark, sf_dir), path), path)
    return decoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                          F.sha2("text", 256).alias("decoded_sha256"))


@query
def op13_filter_diagrams(spark, sf_dir):
    """Every order of five filters over all documents, per language."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return audit.audit(audit.masks(documents(spark, sf_dir), labels))


ORACLES["op13_filter_diagrams"] = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS body,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
  told AS (SELECT doc_id, part, CASE WHEN len(w) < 200 THEN 'A' ELSE '' END
      || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
      || CASE WHEN 100 * length(regexp_replace(body, '[^A-Z]+', '', 'g')) > 3 * length(body) THEN 'C' ELSE '' END
      || CASE WHEN regexp_matches(body, '[#$%&*|]') THEN 'D' ELSE '' END
      || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY body) THEN 'E' ELSE '' END AS fails FROM d),
  m AS (SELECT part, fails, count(*) AS n, count(*) FILTER (g = 1) AS good, count(*) FILTER (t = 1) AS toxic
    FROM told LEFT JOIN (SELECT doc_id, max(quality) AS g, max(toxic) AS t FROM labels GROUP BY doc_id) USING (doc_id)
    GROUP BY part, fails),
  l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
  o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a, l b, l c, l d, l e
    WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
  g AS (SELECT part, filter_order, fails, n, good, toxic, coalesce(list_min(list_transform(
      list_filter(['A', 'B', 'C', 'D', 'E'], lambda y: contains(fails, y)), lambda y: instr(filter_order, y))), 6) AS gone
    FROM m, o),
  r AS (SELECT part, filter_order, CAST(step AS INTEGER) AS step, filter_order[step] AS x,
      sum(n) FILTER (gone > step) AS kept, sum(n) FILTER (gone = step) AS removed,
      sum(n) FILTER (gone < step AND contains(fails, filter_order[step])) AS redundant,
      sum(n) FILTER (fails = filter_order[step]) AS unique_fails,
      sum(good) FILTER (gone = step) AS good_lost, sum(toxic) FILTER (gone = step) AS toxic_lost
    FROM g, (SELECT unnest(range(1, 6)) AS step) GROUP BY part, filter_order, step, x)
SELECT part, filter_order, step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed,
  CAST(coalesce(redundant, 0) AS BIGINT) AS redundant, CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails,
  CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
  CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, x) AS BIGINT) AS shapley FROM r"""


@query
def op12_prefix_trie(spark, sf_dir):
    """The trie of the conversations rebuilt with shared beginnings."""
    return trie.trie(trie.rebuilt(trie.turns(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))


#: CRC-32 of decimal ids by its byte table, for the SQL checks (fixed polynomial).
CRC32_SQL = """
  bits AS (SELECT range AS byte, list_reduce(list_prepend(CAST(range AS BIGINT), CAST(range(8) AS BIGINT[])),
      lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS crc FROM range(256)),
  crcs AS (SELECT list(crc ORDER BY byte) AS t FROM bits)"""

ORACLES["op12_prefix_trie"] = f"""
WITH {CRC32_SQL},
  ids AS (SELECT DISTINCT conv_id AS c FROM conversations WHERE conv_id IS NOT NULL),
  hashed AS (SELECT c, c - c % 5 AS base, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT),
      list_transform(string_split(CAST(c AS VARCHAR), ''), lambda d: CAST(ascii(d) AS BIGINT))),
      lambda s, d: xor(s >> 8, t[CAST(xor(s % 256, d) + 1 AS INTEGER)]))) % 9 AS h FROM ids, crcs),
  turn AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS pos,
      coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
  own AS (SELECT h.c, 1 AS part, pos, role, text FROM hashed h JOIN turn t ON t.c = h.c AND t.pos >= h.h),
  lent AS (SELECT h.c, 0 AS part, pos, role, text FROM hashed h JOIN turn t ON t.c = h.base AND t.pos < h.h),
  rebuilt AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY part, pos) AS depth,
      sha256(length(role) || ':' || role || text) AS turn, strlen(text) AS bytes
    FROM (SELECT * FROM own UNION ALL SELECT * FROM lent)),
  -- a prefix is the digest of its turns' digests
  prefix AS (SELECT c, depth, bytes, sha256(string_agg(turn, ',') OVER (PARTITION BY c ORDER BY depth)) AS k,
      count(*) OVER (PARTITION BY c) = depth AS is_end FROM rebuilt
    UNION ALL SELECT c, 0, 0, '', c NOT IN (SELECT c FROM rebuilt) FROM ids),
  node AS (SELECT depth, k, min(c) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes,
      sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (is_end), '')) AS ends_sha256
    FROM prefix GROUP BY depth, k),
  linked AS (SELECT n.*, p.k AS parent, q.conv_id AS parent_conv_id FROM node n
    LEFT JOIN prefix p ON p.c = n.conv_id AND p.depth = n.depth - 1
    LEFT JOIN node q ON q.depth = n.depth - 1 AND q.k = p.k),
  kids AS (SELECT depth - 1 AS depth, parent AS k, count(*) AS n_children FROM linked WHERE depth > 0 GROUP BY ALL),
  whole AS (SELECT l.*, coalesce(n_children, 0) AS n_children FROM linked l LEFT JOIN kids USING (depth, k)),
  sums AS (SELECT p.depth, p.k, sum((w.n_children = 0)::INT) AS n_leaves, sum((w.n_convs - 1) * w.bytes) AS saved_tokens
    FROM whole w JOIN prefix p ON p.c = w.conv_id AND p.depth <= w.depth GROUP BY p.depth, p.k)
SELECT conv_id, CAST(depth AS BIGINT) AS depth, parent_conv_id, n_convs, n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
  CAST(saved_tokens AS BIGINT) AS saved_tokens, ends_sha256 FROM whole JOIN sums USING (depth, k)"""
