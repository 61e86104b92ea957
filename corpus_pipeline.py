"""A training corpus from ``documents`` in five stages, each written as Parquet and read back by the next.

1. Quality rules: documents that the base limits or the learned list reject go.
2. MinHash near-dedup on five-word shingles: one document of each group of near copies stays.
3. Secret scans: every secret found is replaced in the text.
4. Mixing: texts are cut at block borders and repeated as the target weights ask.
5. Packing: the mix's texts become token sequences; the result is one row per piece of a text.

All stages but the last return the columns they were given.
"""

from tallyframe.llm import minhash_dedup, mixing, packing, quality_rules, secret_scan
from tallyframe.llm.common import ship, staged, table

SHINGLE_WORDS = 5
SIMILAR_PERCENT = 80
REMEMBERED_WORDS = 40_000  # by a worker while packing; workers serve the other stages too


def quality(spark, docs, sf_dir):
    return quality_rules.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark, docs, sf_dir):
    return minhash_dedup.drop_near_duplicates(docs, SHINGLE_WORDS, SIMILAR_PERCENT)


def secrets(spark, docs, sf_dir):
    ship(spark)
    return secret_scan.redact(docs)


def mix(spark, docs, sf_dir):
    return mixing.mixed_documents(docs)


def pack(spark, docs, sf_dir):
    ship(spark)
    return packing.pack(docs, remembered=REMEMBERED_WORDS)


STAGES = [
    ("quality_rules", quality),
    ("minhash_dedup", near_duplicates),
    ("secret_scan", secrets),
    ("mixing", mix),
    ("packing", pack),
]

# The learned list, signatures, token efficiency and tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
