"""Sizes of texts in tokens of a public tokenizer. Tokenizers are read from a path, never trained and never copied."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Folder of the vocabulary files; a parameter everywhere.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: How byte-level vocabularies of this family cut a text before merging; a fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_encodings: dict[str, object] = {}


def encoding(path: str):
    """The tokenizer of a ranks file; read once a process."""
    if path not in _encodings:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _encodings[path] = tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


def quality(text: str, tokens: int) -> float:
    """Weight in [0.05, 1]: how much of the text is not repeated lines, times how well it packs (prose takes about 4 characters a token)."""
    lines = [x for x in text.splitlines() if x.strip()]
    if not lines or not tokens:
        return 0.05
    return max(0.05, round(len(set(lines)) / len(lines) * min(1.0, len(text) / tokens / 4), 4))


def sized(documents: DataFrame, *keep: str, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, the kept columns, tokens and quality of each document; null text has 0 tokens. One pass without a shuffle."""
    path = os.path.join(folder, vocabulary)
    names = ["doc_id", *keep]

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path)
        for batch in it:
            texts = [t or "" for t in batch.column(len(names)).to_pylist()]
            counts = [len(enc.encode_ordinary(t)) for t in texts]
            cols = [*batch.columns[:-1], pa.array(counts, pa.int64()), pa.array([quality(t, n) for t, n in zip(texts, counts)], pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, names=[*names, "tokens", "quality"])

    kinds = dict(documents.dtypes)
    ddl = ", ".join(f"`{n}` {kinds[n]}" for n in names) + ", tokens long, quality double"
    return documents.select(*names, "text").mapInArrow(batches, ddl)
