"""Byte-level BPE ids of whole texts, and the bytes each id stands for."""

from __future__ import annotations

import base64
import json
from functools import lru_cache

import numpy as np

VOCABULARY = "byte_bpe_50k.json"


def vocabulary_path(name: str = VOCABULARY) -> str:
    """Place of a vocabulary file of the installed ``public_tokenizers`` package."""
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def _library(path: str):
    import os

    from tokenizers import Tokenizer

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    slow = Tokenizer.from_file(path)
    slow.encode_special_tokens = True
    return slow


@lru_cache(maxsize=4)
def encoder(path: str):
    """Function from a text to its ids (``uint32`` array), without special tokens.

    ``path`` is a byte-level BPE file of ``tokenizers``.  Where the same vocabulary
    lies beside it as ranks (``.tiktoken``), ``tiktoken`` encodes: the ids are the
    same (tests compare them) and it takes a quarter of the time.  Texts that it
    cannot handle go to ``tokenizers``, loaded with the first of them: it takes 28 MB
    of each Python worker.  Strings of special tokens in a text are ordinary text.
    """
    import os

    by_library = lambda text: np.array(_library(path).encode(text, add_special_tokens=False).ids, np.uint32)
    ranks = path.removesuffix(".json") + ".tiktoken"
    if not os.path.exists(ranks):
        return by_library
    import public_tokenizers
    import tiktoken

    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("byte-bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def encode(text: str) -> np.ndarray:
        try:
            return np.array(fast.encode_ordinary(text), np.uint32)
        except Exception:  # e.g. a stack limit of its pattern matcher on a very long run
            return by_library(text)

    return encode


@lru_cache(maxsize=4)
def byte_lengths(path: str) -> np.ndarray:
    """Number of bytes that each id of a byte-level BPE file stands for: one per
    character of its entry, as each character there stands for one byte."""
    with open(path) as f:
        vocabulary = json.load(f)["model"]["vocab"]
    size = np.zeros(max(vocabulary.values()) + 1, np.int64)
    for token, i in vocabulary.items():
        size[i] = len(token)
    return size
