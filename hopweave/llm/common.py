"""What the training-data operators share: shared-folder tables and row access.

Conventions of every operator in this package:

* input columns are named by parameters; other columns are ignored, or, where the
  result has all columns, carried under numbered names (``plain``), so extra columns
  with clashing names can never reach an operator's own columns;
* a null text is the empty text, a null id is a value like any other;
* repeated rows are separate rows unless an operator says otherwise.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hopweave.plans.tables import TIDY, discard, land, release, settings, shared_dir, sweep

__all__ = ["FRUGAL", "discard", "documents", "land", "plain", "release", "settings", "shared_dir", "slices", "stable", "sweep", "texts", "trim"]


#: ``TIDY``, and Arrow batches of texts stay small on both sides.
FRUGAL = TIDY | {
    "spark.sql.execution.arrow.maxBytesPerBatch": "4m",
}


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Exactly the columns doc_id and text, null text as the empty text."""
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def plain(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with its columns called c0, c1, ..., and these names by the old ones."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    return docs.toDF(*names), dict(zip(docs.columns, names))


def stable(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """``df`` as it is where its rows come from files as they lie; landed where a
    shuffle would bring them in another order in every run."""
    moved = re.search(r"(?<!Broadcast)Exchange|Shuffle", df._jdf.queryExecution().executedPlan().toString())
    return land(spark, df, name) if moved else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def slices(batch, column: int = 1, most: int = 1_000_000):
    """Split a RecordBatch so that one slice's texts stay near ``most`` bytes;
    a single longer text is a slice of its own, whole."""
    import pyarrow as pa
    import pyarrow.compute as pc

    size, begin = 0, 0
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    for i, n in enumerate(sizes):
        if i > begin and (size + n > most or i - begin >= 50_000):
            yield batch.slice(begin, i - begin)
            begin, size = i, 0
        size += n
    if begin < batch.num_rows:
        yield batch.slice(begin)
    pa.default_memory_pool().release_unused()


def trim() -> None:
    """Hand memory that this Python worker has freed back to the system: idle workers
    outlive their tasks, beside the next ones' memory."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if give_back:
        give_back(0)
