"""Token counts of whole texts by a two-tier lookup in the map tasks."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from tidegraph.llm.bpe import Counts, frequent_units, vocabulary
from tidegraph.llm.common import batch, bounded_batches, strings, texts


def token_counts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024, vocab: str | None = None,
    frequent: int = 20_000, cache_bytes: int = 32 << 20,
) -> DataFrame:
    """Tokens of each text by byte-level BPE, as the ``tokenizers`` library counts them, without added special tokens.

    Tier one is a broadcast table with the token counts of the ``frequent`` most frequent units (a word with the blank before it and the
    marks after it), counted over all texts; tier two is a cache of at most ``cache_bytes`` in each worker, filled by encoding what is
    missed. Both only save time. The table is scanned twice, for units and for texts; units are shuffled as counts of each task.

    A null text counts as empty: 0 bytes, 0 tokens. Repeated rows and ties each give a row; a null id stays null; an empty table gives
    an empty result; other columns are ignored, whatever their names. A special token's string in a text is that token, as is the
    library's default.

    Returns doc_id, n_bytes, n_tokens (long), over_limit (n_tokens > ``limit``).
    """
    bounded_batches(docs.sparkSession)
    path = vocab or vocabulary()
    src = texts(docs, id_col, text_col)
    spark = docs.sparkSession
    known = spark.sparkContext.broadcast(frequent_units(src, frequent, path))
    id_type = src.schema["doc_id"].dataType.simpleString()

    def count(batches):
        counts = Counts(path, known.value, cache_bytes)
        schema = None
        for b in batches:
            schema = schema or pa.schema([b.schema.field("doc_id"), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])
            n = [counts(t) for t in strings(b.column("text"))]
            yield batch(schema, [b.column("doc_id"), pc.binary_length(b.column("text")), n, [x > limit for x in n]])

    return src.mapInArrow(count, f"doc_id {id_type}, n_bytes long, n_tokens long, over_limit boolean")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
