"""A corpus from raw documents to token ids, as stages that are written and read again.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept. All but the last return
the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.llm.bpe import encode_documents
from veilspan.llm.common import drop_table, read_table, stage_table, vocabulary
from veilspan.llm.linededup import dedup_lines
from veilspan.llm.minhash import one_of_each
from veilspan.llm.mixing import mixed_documents
from veilspan.llm.quality import filter_documents
from veilspan.session import ship_package


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule of the policy rejects, unchanged.

    Every row is judged on its own text, so repeated rows stay or go together and ids are not read. A null or
    empty text has too few words and goes. Other columns, whatever their names, pass through; an empty table
    gives no rows.
    """
    return filter_documents(docs, "full-1")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, without cross-site boilerplate lines but for the first of each; n_chars follows the text.

    A line is boilerplate from ten sources on, a null source counting as one; it stays in the document of the
    smallest id that holds it. No document loses all its text. A null text stays null. Repeated rows are cut
    alike; other columns, whatever their names, pass through; an empty table gives no rows.
    """
    out = dedup_lines(docs, keep_first=True)
    cut = F.col(f"`{out.columns[-1]}`") > 0
    cols = [F.when(cut, F.length("text")).otherwise(F.col("n_chars")).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns]
    return out.select(*cols)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity 0.8 or more.

    The smallest id of a group stays. Rows that share an id are one document. Texts without a word are linked
    with nothing and stay; rows without an id go where a document with an id has their shingles. Other columns,
    whatever their names, pass through; an empty table gives no rows.
    """
    ship_package(spark)
    return one_of_each(docs, k=5, percent=80, rows=5)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources at their target weights: a row as often as the mix takes it, three times at most.

    The null source is the last. Texts without words have size 0 and go where their block goes. Rows that agree
    in id, text and source are taken together. Other columns, whatever their names, pass through; an empty table
    gives no rows.
    """
    return mixed_documents(docs)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row: id, counts, digests and the ids.

    A null or empty text has no tokens; long texts are encoded whole. Rows are encoded on their own, so repeated
    rows repeat; other columns are not read; an empty table gives no rows.
    """
    ship_package(spark)
    return encode_documents(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", near_dedup),
    ("mixing to target weights", mixing),
    ("BPE encoding", bpe),
]

#: Components, the mix and BPE are beyond SQL. Tests hold the first three stages' rows and texts against plain
#: Python, the mix against exact targets, and the tokens against the library.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over ``documents``; each stage's table goes once the next one's is written."""
    docs = read_table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i + 1 == len(STAGES):
            return out
        done, docs = docs, stage_table(out, f"stage{i}")
        if i:
            drop_table(done)
    return docs
