"""A training-data pipeline over the documents table: each stage applies one operator.

Stages take (spark, docs, sf_dir); every stage works on all that its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldspar.llm import bpe, exact_dedup, language, minhash, mixing
from veldspar.llm.queries import tokenizer_path
from veldspar.llm.scratch import Scratch


def _stored(spark: SparkSession, docs: DataFrame, name: str) -> DataFrame:
    """doc_id, text, source and two more: ``row``, a key of the row, as ids may repeat or be missing, and ``own``, all its columns.

    So no column of ``docs`` can clash with one of an operator's. What is not a stored table
    is written first, so that all that reads it sees the same keys.
    """
    if not docs._jdf.queryExecution().analyzed().children().isEmpty():
        docs = Scratch(spark, name).save(docs, "rows")
    return docs.select("doc_id", "text", "source", F.monotonically_increasing_id().alias("row"), F.struct("*").alias("own"))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told, in ``lang`` the language found.

    Those that are null, empty or without a letter go, and all where no language could be
    learned. Each row is judged by its own text, so repeated rows and ids stay. Texts are read
    whole. Extra columns stay as they are; an empty table gives an empty table.
    """
    prototypes = language.train(docs.where(~language.held_out(F.col("doc_id"), 4, 2)))
    others = [c for c in docs.columns if c not in ("text", "lang")]
    found = language.identify(docs, prototypes, carry=F.struct(*others)).where(F.col("lang_pred") != language.UNDETERMINED)
    own = {"text": F.col("text"), "lang": F.col("lang_pred")}
    return found.select(*(own.get(c, F.col("carried")[c]).alias(c) for c in docs.columns))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts: the one with the smallest id, one of those that repeat it.

    Null counts as the empty text, and a missing id as greater than all. Extra columns stay
    as they are; an empty table gives an empty table.
    """
    rows = _stored(spark, docs, "pipeline-exact")
    kept = exact_dedup.exact_dedup(rows, row_col="row").where("kept").select("row")
    return rows.join(kept, "row", "left_semi").select("own.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts whose five-word shingles are similar to 0.8 or more: the one with the smallest id.

    Rows whose text is null, empty or without words all stay. A missing id counts as greater
    than all; rows that repeat an id are documents of their own. Extra columns stay as they
    are; an empty table gives an empty table.
    """
    rows = _stored(spark, docs, "pipeline-near")
    found = minhash.near_duplicates(rows.select("row", "text"), words=5, similarity=(80, 100), id_col="row").select(F.col("doc_id").alias("row"), "component_id")
    first = F.min(F.struct(F.isnull("doc_id").alias("nameless"), "doc_id", "row")).alias("first")
    kept = found.join(rows.select("row", "doc_id"), "row").groupBy("component_id").agg(first).select("first.row")
    return rows.join(kept, "row", "left_semi").select("own.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them, by the sizes of whole texts.

    A null source is a source, and null, empty or wordless texts are never taken. Rows that
    repeat an id are documents of their own. Extra columns stay as they are; an empty table
    gives an empty table.
    """
    rows = _stored(spark, docs, "pipeline-mixing")
    taken = mixing.mix(rows, row_col="row").where("copies > 0").select("row", F.col("copies").cast("int").alias("copies"))
    return rows.select("row", "own").join(taken, "row").select("own", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("own.*")


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded texts: doc_id, n_tokens, ids_sha256, decoded_sha256.

    One row a row. Null and empty texts have no tokens; extra columns are left out; an empty
    table gives an empty table.
    """
    return bpe.digests(bpe.encode(docs, tokenizer_path()))


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", encode_tokens),
]

#: Language profiles, sketches, random rounding and merges are beyond SQL; tests use a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; between stages the rows are written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
