"""A training corpus from raw documents, in stages that are each stored."""

import public_tokenizers

from martloom.llm import mixing, pack, quality, secrets, simhash
from martloom.operators.stable import stable


def quality_rules(spark, docs, sf_dir):
    """Documents that the rules reject go."""
    return quality.keep_good(docs)


def near_dedup(spark, docs, sf_dir):
    """One row of each group stays whose fingerprints of 3-word shingles link at 2 or
    fewer differing bits."""
    return simhash.keep_first(docs, width=3, field=2)


def secret_scan(spark, docs, sf_dir):
    """Secrets are masked; the documents stay."""
    return secrets.redact(docs)


def mix_sources(spark, docs, sf_dir):
    """Nine tenths of the tokens, drawn towards flatter source, language and topic shares."""
    return mixing.sample(docs, rate=0.9, power=0.9)


def packing(spark, docs, sf_dir):
    """Sequences of power-of-two lengths, 2048 at most, with their ids. The executors
    still hold the earlier stages' heap, so the workers take less than by default."""
    return pack.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), 2048, 1,
                     size=1_000_000, remember=200_000)


STAGES = [("quality rules", quality_rules), ("simhash near-dedup", near_dedup),
          ("secret scans", secret_scan), ("source mixing", mix_sources), ("packing", packing)]

#: SQL cannot express the fingerprints, the forest or the tokenizer; tests/llm holds
#: the stages against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stable(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
