"""What the corpus operators share: session settings, row keys, rows kept apart from inner columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import checkpoint_dir, connected_components, cut, discard, numbered  # noqa: F401

#: Arrow batches to Python workers: rows and bytes. Texts differ in length a thousandfold, so the bytes bind.
ARROW_ROWS, ARROW_BYTES = 2000, 8 << 20


def tune(spark: SparkSession) -> SparkSession:
    """Bound what one Arrow batch holds; a session that has set its own bounds below these keeps them."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)):
        now = spark.conf.get(key).rstrip("b")
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(key, str(most))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tune(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def text_hash(col: str | Column = "text") -> Column:
    """64 bits of the text; with the id this tells rows apart whose ids repeat."""
    return F.xxhash64(F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit("\u0000")))


def packed(documents: DataFrame) -> DataFrame:
    """Each row as the one column row, beside doc_id, text and text_hash: no name of its columns clashes with inner ones."""
    return documents.select(F.struct("*").alias("row"), "doc_id", "text", text_hash().alias("text_hash"))


def unpacked(rows: DataFrame, columns: list[str], **instead: Column) -> DataFrame:
    """The rows again, with some columns replaced."""
    return rows.select(*((instead[c] if c in instead else F.col("row").getField(c)).alias(c) for c in columns))


def same_row(doc_id: str, text_hash: str) -> Column:
    """Whether doc_id and text_hash are those of the named columns; null ids are equal."""
    return F.col("doc_id").eqNullSafe(F.col(doc_id)) & (F.col("text_hash") == F.col(text_hash))
