"""A corpus pipeline in five stages, from documents to packed training sequences.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and
returns a DataFrame. Its result is written as Parquet and read again before the next
stage begins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skerry.llm.bestfit import best_fit_packing
from skerry.llm.common import materialize, release_scratch, scratch_scope, table
from skerry.llm.exact import drop_exact_copies
from skerry.llm.mixing import mix
from skerry.llm.quality import drop_low_quality
from skerry.llm.simhash import drop_near_copies
from skerry.llm.tokens import tokenizer_path


def quality_stage(spark, docs, sf_dir):
    """Drop documents that the quality rules reject.

    A null or empty text has no words and is dropped; a null language is one of its
    own; repeated rows are judged alike; an empty table stays empty; columns stay.
    """
    return drop_low_quality(docs)


def exact_stage(spark, docs, sf_dir):
    """Keep one document of each group of equal texts.

    The largest id stays, null ids being smaller than any other and a null text equal
    to an empty one; of rows that repeat the id along with its text one stays; an
    empty table stays empty; columns stay.
    """
    return drop_exact_copies(docs)


def near_stage(spark, docs, sf_dir):
    """Keep one document of each group of near copies.

    The smallest id stays, judged by id and text where ids repeat; a null id is larger
    than any other; null texts are near copies of each other; an empty table stays
    empty; columns stay.
    """
    return drop_near_copies(docs)


def mixing_stage(spark, docs, sf_dir):
    """Repeat and thin documents so that sources meet their target weights.

    A null source is one of its own, the last; null texts have no words; rows that
    repeat an id are drawn alike; an empty table stays empty; columns stay.
    """
    return mix(docs)


def packing_stage(spark, docs, sf_dir):
    """Pack the mix into sequences: a row per piece of a document.

    Null texts are empty documents, null ids stay null, repeated rows are packed like
    any other; an empty table gives an empty result.
    """
    return best_fit_packing(docs, tokenizer_path())


STAGES = [
    ("quality_rules", quality_stage),
    ("exact_dedup", exact_stage),
    ("simhash_near_dedup", near_stage),
    ("source_mixing", mixing_stage),
    ("best_fit_packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of the documents of ``sf_dir``, from a stored table.

    A stage's input and scratch tables are deleted once its output is written, so
    that only the last output is left; it belongs to this run alone.
    """
    docs, old = table(spark, sf_dir, "documents"), []
    for i, (name, stage) in enumerate(STAGES):
        with scratch_scope() as made:
            out = stage(spark, docs, sf_dir)
        with scratch_scope() as stored:
            docs = materialize(out, "packed" if i == len(STAGES) - 1 else f"stage-{name}")
        release_scratch(spark, old + made)
        old = stored
    return docs


#: SQL expresses neither the perplexity model nor SimHash nor the tokenizer.
ORACLE_SQL = None
