"""From raw documents to packed sequences in five stages.

Each stage gets what its predecessor kept, as documents, and returns documents;
the last returns the pieces' places in the sequences. Between stages the rows
are written to the shared folder, so a lost executor costs one stage at most.

Extra columns go through the stages as they are, whatever their names. Rows are
told apart by id and text, so rows that share an id, or have none, are judged
each; of rows that repeat both, one stays. Null and empty texts fail the rules
of the first stage; a later stage that gets one leaves it. Texts are read whole,
however long. An empty table gives an empty one at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearbit.llm import decontam, near_dup, packing, pii, quality
from nearbit.llm.common import set_aside, stored, table

#: Share of a document's words, in percent, that may be hit before it goes as a whole.
MOST_HIT = 0


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    rows, back = set_aside(docs, "doc_id", "text")
    return quality.annotate(rows, trusted=table(spark, sf_dir, "labels")).where("kept").select(*back)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: that with the smallest id. Shingles are of five words, 80 % alike."""
    return near_dup.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"), most_hit=MOST_HIT)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data become tags, giveaway terms are generalised or removed; n_chars follows the text."""
    clean = pii.sanitised(docs)
    return clean.withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece's place in the sequences."""
    return packing.pack(docs)


STAGES = [("quality rules", quality_rules), ("near duplicates", near_duplicates), ("decontamination", decontamination), ("personal data", personal_data), ("packing", packed)]

#: Tokenisers and similarity groups are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
