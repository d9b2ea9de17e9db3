"""From raw documents to packed training sequences, in five stages.

Each stage takes what its predecessor kept, as written to Parquet and read again; all but the
last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.jaccard import near_duplicates
from tessera.llm.langid import UNKNOWN, fit, predicted
from tessera.llm.mixing import mix
from tessera.llm.packing import pack
from tessera.llm.queries import tokenizer_path
from tessera.llm.secrets import redacted
from tessera.session import keep, table

#: Below this a text is in no learned language; four languages by chance have 0.25.
LEAST_SCORE = 0.3


def _free(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` does not use."""
    while name in docs.columns:
        name += "_"
    return name


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or in none of the languages learned from the rest, go.

    Null and empty texts have no letter. With nothing to learn from (an empty table, no ``lang``), nothing else goes. Repeated rows are judged alike
    and stay repeated; rows with a null id are judged, never learned from; a column named like the judgement's is left as it is.
    """
    model = fit(docs)
    name = _free(docs, "language")
    if not model.langs:  # nothing to learn from: nothing to judge by
        return docs.where(F.col("text").rlike(r"\p{L}"))
    told = docs.withColumn(name, predicted(F.col("text"), model))
    return told.where((F.col(f"{name}.lang_pred") != UNKNOWN) & (F.col(f"{name}.score") >= LEAST_SCORE)).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies the row of the smallest id stays, and once if it is repeated.

    Rows with a null id can't be told to be copies and stay. Of rows that share the id but not the text,
    the one with the smaller hash of the text stays for a component.
    """
    found = near_duplicates(docs, k=5, percent=80).where("doc_id IS NOT NULL")
    chosen = found.groupBy("component_id", "group", F.when(F.col("group").isNull(), F.col("tie")).alias("wordless")).agg(F.min(F.struct((F.col("doc_id") != F.col("component_id")).alias("other"), "doc_id", "tie")).alias("first")).select(F.col("first.doc_id").alias("k_id"), F.col("first.tie").alias("k_tie"))
    tie = _free(docs, "tie")
    marked = docs.withColumn(tie, F.xxhash64(F.col("text")))
    kept = marked.join(chosen.distinct().hint("shuffle_hash"), (marked["doc_id"].cast("long") == chosen["k_id"]) & (marked[tie] == chosen["k_tie"]), "left_semi")
    return kept.dropDuplicates(["doc_id", tie]).unionByName(marked.where(F.col("doc_id").isNull())).select(*docs.columns)


def remove_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets, also those under layers of encoding, are replaced in the text; n_chars follows.

    No row goes. Null and empty texts stay as they are (n_chars of a null text is null), repeated rows stay repeated, very long texts are read whole,
    an empty table stays empty, and other columns, whatever their names, are untouched.
    """
    clean = docs.withColumn("text", redacted(F.col("text")))
    return (clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which the mix takes nothing go; one that it takes n times over is there n times.

    A document that a block cuts stays whole. Null and empty texts hold no words, so they go; a null source is a source of its own; repeated
    rows count each; an empty table stays empty; other columns, whatever their names, travel along.
    """
    taken = mix(docs, carry=True).where("taken > 0")
    copies = F.greatest(F.lit(1), F.floor(F.col("taken") / F.col("size")).cast("int"))
    return taken.select("doc", F.explode(F.sequence(F.lit(1), copies))).select("doc.*")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the training sequences.

    A null or empty text is its end id alone; repeated rows and null ids are packed like others; an empty table gives no piece; other
    columns are ignored.
    """
    return pack(docs, tokenizer_path())


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", remove_secrets),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: The language model, the decoding worklist and the tokenizer are beyond SQL; tests use a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
