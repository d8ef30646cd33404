"""Corpus pipeline: language ID, quality classifier, SimHash near-dedup, best-fit packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; the first three return the
columns of documents, the last the packed pieces. run() writes every stage to the shared folder and rereads it.
"""

from rasterloom.llm import language, packing, quality, simhash
from rasterloom.llm.common import cut, table


def identify_language(spark, docs, sf_dir):
    """Documents whose language evidence is too weak go."""
    return language.language_filter(docs)


def classify_quality(spark, docs, sf_dir):
    """Documents that the rule ensemble scores below 0.5 go."""
    return quality.quality_filter(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark, docs, sf_dir):
    """Of each SimHash group the document with the smallest id stays."""
    return simhash.deduplicate(docs)


def pack(spark, docs, sf_dir):
    """Every piece with its sequence and its place there; packing.pack_documents(docs, with_ids=True) adds the token ids."""
    return packing.pack_documents(docs)


STAGES = [("language", identify_language), ("quality", classify_quality), ("simhash", drop_near_duplicates), ("packing", pack)]
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
