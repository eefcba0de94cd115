"""Exact dedup by deterministic block naming, in DataFrame functions only.

Every normalised text is cut into blocks of BLOCK_CHARS characters. Equal blocks get
one integer name, then equal adjacent pairs of names get one, again and again, until
each document has one name; texts of one number of rounds are equal just when their
names are. Names stand for contents, not for hashes of them, so there are no collisions.

A name is the smallest row number among the rows that hold the content. Rows are sorted
by content under a salt first, so that a block that a third of the corpus shares is dealt
over SALTS tasks; only one row of each salt goes on to meet its like.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veldspar.llm.scratch import Scratch

BLOCK_CHARS = 2048
SALTS = 256
SPACES = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    """Each run of white space becomes one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def _named(rows: DataFrame, key: list[str]) -> DataFrame:
    """Replace ``key`` by ``name``: one integer for each distinct value. ``rows`` has unique integers in ``row``.

    The contents go through two exchanges in one line of plan: the first finds the head of
    each content and salt; the second, where only heads still carry their content, the head
    of all. The third exchange, on integers, hands the heads' names to the other rows.
    """
    rows = rows.withColumn("salt", F.pmod(F.hash("row"), F.lit(SALTS))).withColumn("near", F.min("row").over(Window.partitionBy(*key, "salt")))
    head = F.col("row") == F.col("near")
    rows = rows.withColumns({k: F.when(head, F.col(k)) for k in key} | {"alone": F.when(~head, F.col("row"))}).drop("salt")
    rows = rows.withColumn("name", F.min("row").over(Window.partitionBy(*key, "alone"))).drop(*key, "alone")
    return rows.withColumn("name", F.max(F.when(head, F.col("name"))).over(Window.partitionBy("near"))).drop("near")


def document_names(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS, row_col: str | None = None) -> DataFrame:
    """One row per input row: doc_id, text_sha256, rounds and name; equal texts share (rounds, name).

    ``docs`` must replay the same rows in the same order (a stored table does). Null text
    counts as empty; empty texts share one name; repeated rows share one name; other
    columns are not read. ``row_col`` names unique integers of the rows to take as ``doc``.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "exact-dedup")
    key = F.col(row_col) if row_col else F.monotonically_increasing_id()
    texts = docs.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("text"), key.alias("doc"))
    texts = texts.select("doc_id", "text", "doc", F.sha2("text", 256).alias("text_sha256"))
    pieces = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{block_chars}}}"), F.lit(0))
    pieces = F.when(F.length("text") == 0, F.array(F.lit(""))).otherwise(pieces)
    blocks = texts.withColumn("blocks", pieces).select("doc_id", "doc", "text_sha256", F.size("blocks").alias("left"), F.posexplode("blocks").alias("at", "block"))
    blocks = blocks.select("doc", "at", "left", "block", *(F.when(F.col("at") == 0, F.col(c)).alias(c) for c in ("doc_id", "text_sha256")), F.monotonically_increasing_id().alias("row"))
    now = scratch.save(_named(blocks, ["block"]), "blocks")
    finished = ["doc", "doc_id", "text_sha256", "rounds", "name"]
    done = now.where("left = 1").withColumn("rounds", F.lit(0)).select(finished)
    rounds = 0
    longest = now.agg(F.max("left")).first()[0] or 0
    while longest > 1:
        rounds += 1
        pairs = now.where("left > 1").groupBy("doc", F.floor(F.col("at") / 2).alias("at")).agg(
            F.min("row").alias("row"), F.first("left").alias("left"),
            F.max(F.when(F.col("at") % 2 == 0, F.col("name"))).alias("one"), F.max(F.when(F.col("at") % 2 == 1, F.col("name"))).alias("two"),
            F.max("doc_id").alias("doc_id"), F.max("text_sha256").alias("text_sha256"),
        )
        pairs = pairs.withColumns({"left": F.ceil(F.col("left") / 2).cast("int"), "two": F.coalesce("two", F.lit(-1))})
        now = scratch.save(_named(pairs, ["one", "two"]), f"pairs{rounds}")
        longest = (longest + 1) // 2
        done = done.unionByName(now.where("left = 1").withColumn("rounds", F.lit(rounds)).select(finished))
    return done


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS, row_col: str | None = None) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after white space runs become one space; null counts
    as empty. Of a group the row with the smallest id stays (a null id only if all are
    null), and of rows that repeat that id and text exactly one. An empty table gives an
    empty table. Extra columns are ignored, whatever their names; with ``row_col``, a column
    of unique integers, ``row`` has them.
    """
    rows = document_names(docs, id_col, text_col, block_chars, row_col).withColumn("salt", F.pmod(F.hash("doc"), F.lit(SALTS)))
    same = ["rounds", "name"]
    first = F.min(F.struct(F.isnull("doc_id").alias("nameless"), "doc_id", "doc"))
    near = rows.groupBy(*same, "salt").agg(first.alias("keep"), F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy(*same)
    near = near.select(*same, "salt", F.min("keep").over(whole).alias("keep"), F.sum("n").over(whole).alias("group_size"))
    out = rows.join(near, [*same, "salt"])
    row = [F.col("doc").alias("row")] if row_col else []
    return out.select("doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", (F.col("doc") == F.col("keep.doc")).alias("kept"), "text_sha256", *row)
