"""Sizes of texts in tokens of a public tokenizer.

The vocabulary is read from a file of ranks whose path is a parameter; nothing is copied
or trained. A text is cut by the tokenizer's own pattern, and the count of each distinct
cut is kept, so equal words are tokenized once; the sum equals the length of the encoding.
"""

from __future__ import annotations

import base64
import os
import threading
from collections.abc import Iterator
from itertools import islice
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabularies lie; ORE_TOKENIZERS names another place.
FOLDER = os.environ.get("ORE_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: The tokenizer's pattern. Fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Texts handed to the tokenizer at once.
BATCH = 256

_encodings: dict[str, object] = {}
_lock = threading.Lock()


def encoding(path: str | None = None):
    """The encoding of the ranks in the file `path`, read once a process."""
    import tiktoken

    path = path or f"{FOLDER}/{VOCABULARY}"
    with _lock:
        if path not in _encodings:
            with Path(path).open("rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            _encodings[path] = tiktoken.Encoding(Path(path).stem, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


def count_tokens(texts: list[str | None], path: str | None = None) -> list[int]:
    """Tokens of each text, 0 for null."""
    enc = encoding(path)
    out: list[int] = []
    it = iter(texts)
    while part := list(islice(it, BATCH)):
        out += [0 if t is None else len(enc.encode_ordinary(t.encode("utf-16", "surrogatepass").decode("utf-16", "replace") if not t.isascii() and _lone(t) else t)) for t in part]
    return out


def _lone(text: str) -> bool:
    """Whether a text holds half of a surrogate pair."""
    try:
        text.encode("utf-8")
    except UnicodeEncodeError:
        return True
    return False


def sized(docs: DataFrame, keep: list[str], path: str | None = None) -> DataFrame:
    """`docs` with the columns `keep` and ``tokens``, the size of ``text``; null texts have none."""
    kinds = dict(docs.select(*keep).dtypes)
    schema = ", ".join([f"`{k}` {t}" for k, t in kinds.items()] + ["tokens int"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = pdf[keep].copy()
            out["tokens"] = pd.Series(count_tokens(pdf["text"].tolist(), path), index=pdf.index, dtype="int32")
            yield out

    return docs.select(*keep, "text").where(F.col("text").isNotNull()).mapInPandas(run, schema)


__all__ = ["FOLDER", "PATTERN", "VOCABULARY", "count_tokens", "encoding", "sized"]
