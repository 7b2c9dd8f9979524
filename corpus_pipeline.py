"""Corpus preparation: classify, drop exact copies, drop near copies, strip repeated passages, pack.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before kept, and returns a DataFrame; all but the last return
the columns of documents. `run` writes each stage's rows as Parquet in the cluster's shared folder and reads them back as the
next one's docs, so a stage's scratch tables are deleted once the next one begins.

Defined cases, in every stage: null and empty texts, ties, repeated rows, empty tables and extra columns are treated as the stage's
operator says. A text that deduplication empties is kept as an empty one.
"""

from __future__ import annotations

from spanwarden.llm import exact_dedup, near_dedup, packing, suffix_dedup, weak_labels
from spanwarden.llm.common import documents, release, stash

#: What 50 words come to: of the runs of 50 words in the documents (French, English, German, Spanish), 99 in 100 or more have at least so many bytes.
SUBSTRING_BYTES = 240


def quality(spark, docs, sf_dir):
    """Documents that the weak-label classifier does not reject."""
    release(spark)
    return weak_labels.filter_rows(docs, weak_labels.fit(docs, weak_labels.annotations(spark, sf_dir)))


def exact(spark, docs, sf_dir):
    """One document of each group of exact copies."""
    release(spark)
    return exact_dedup.keep_rows(docs)


def near(spark, docs, sf_dir):
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more."""
    release(spark)
    return near_dedup.keep_rows(docs)


def substrings(spark, docs, sf_dir):
    """All documents, without the byte strings of SUBSTRING_BYTES that repeat."""
    release(spark)
    return suffix_dedup.strip_rows(docs, length=SUBSTRING_BYTES)


def pack(spark, docs, sf_dir):
    """Sequences: one row for each piece of a document."""
    release(spark)
    return packing.pack_documents(docs)


STAGES = [("quality classifier", quality), ("exact dedup", exact), ("near dedup", near), ("substring dedup", substrings), ("packing", pack)]
#: SQL cannot express the classifier, the sketches or the packing; the tests compare `run` with a brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The rows of the last stage, for the documents of `sf_dir`."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}", keep=True)
    return STAGES[-1][1](spark, docs, sf_dir)
