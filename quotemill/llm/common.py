"""Small helpers of the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hash of a text that tells rows with one id but different texts apart.
DIGEST = "digest"


def digest(text: Column) -> Column:
    """64-bit hash of a text; a null text has the hash of the seed."""
    return F.xxhash64(text)


def identified(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id``, ``text`` and the digest; all other columns, of whatever name, are left out."""
    return docs.select(
        F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), digest(F.col(text_col)).alias(DIGEST)
    )


def null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join on ``keys`` where null meets null; the keys of ``left`` stay."""
    renamed = right.withColumnsRenamed({k: f"__{k}" for k in keys})
    on = [left[k].eqNullSafe(renamed[f"__{k}"]) for k in keys]
    joined = left.join(renamed, on, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*[f"__{k}" for k in keys])


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def keep_documents(docs: DataFrame, kept: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` whose id and text digest are in ``kept``, with all columns of ``docs``."""
    key = fresh(docs, "kept_digest")
    marked = docs.withColumn(key, digest(F.col(text_col)))
    right = kept.select(F.col("doc_id").alias("__id"), F.col(DIGEST).alias("__digest")).distinct()
    on = [marked[id_col].eqNullSafe(right["__id"]), marked[key] == right["__digest"]]
    return marked.join(right, on, "left_semi").drop(key)
