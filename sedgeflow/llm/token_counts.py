"""Token counts: what a public tokenizer makes of each text, as lengths only."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from sedgeflow.llm import bpe
from sedgeflow.llm.common import bounded, pick

#: Bytes of text that are cut and looked up together; a longer text is taken alone.
GROUP_BYTES = 1 << 20


def sizes(texts: pa.Array) -> pa.Array:
    """UTF-8 bytes of each text; null has none."""
    return pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())


def balanced(held: list[int], most: int = GROUP_BYTES) -> Iterator[slice]:
    """Groups of consecutive texts of so many bytes: up to `most` together, or one longer text."""
    lo = together = 0
    for i, n in enumerate(held):
        if i > lo and together + n > most:
            yield slice(lo, i)
            lo, together = i, 0
        together += n
    if held:
        yield slice(lo, len(held))


def count_tokens(df: DataFrame, tokenizer: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row: id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    tokenizer is the path of a tokenizers .json or a sentencepiece .model. No begin, end or other
    token is added, nothing is truncated or padded. Each Arrow batch is split into groups that are
    balanced by bytes; the distinct parts of a group go to the library in batches, texts being cut
    where a boundary is certain (see bpe). Only lengths leave the worker.

    Null and empty texts count 0 bytes and 0 tokens; a null id is kept; repeated rows give a row
    each; other columns are ignored, whatever their names; an empty table gives an empty one.
    """
    bounded(df.sparkSession)

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = bpe.encoder(tokenizer)
        for batch in batches:
            n_bytes, counts = sizes(batch.column(1)), []
            for group in balanced(n_bytes.to_pylist()):
                counts += enc.lengths(batch.column(1)[group].to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), n_bytes, pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_())],
                names=[id_col, "n_bytes", "n_tokens", "over_limit"],
            )

    held = pick(df, id_col, **{text_col: "string"})
    kind = held.schema[id_col].dataType.simpleString()
    return held.mapInArrow(lengths, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
