"""Sizes of texts in tokens of a public byte-level BPE tokenizer."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Rank file of the tokenizer; a parameter everywhere, never copied into the repository.
TOKENIZER = os.environ.get("INKWELL_TOKENIZER", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")

# Fixed value: the public pattern that splits text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def with_size(df: DataFrame, keep: list[str], text: str = "text", name: str = "tokens", path: str = TOKENIZER) -> DataFrame:
    """The columns `keep` and the number of tokens of `text` (0 for null and empty texts)."""
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(name, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(path).encode_ordinary
        for batch in batches:
            sizes = pa.array([len(encode(t)) if t else 0 for t in batch.column(text).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), sizes], names=[*keep, name])

    return df.select(*dict.fromkeys([*keep, text])).mapInArrow(run, schema)
