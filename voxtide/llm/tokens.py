"""Token counts by a public tokenizer's vocabulary file."""

from __future__ import annotations

import base64

import numpy as np

#: Where the vocabulary lies; on a cluster the same path must hold on every executor.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: the pre-tokenization pattern that belongs to these byte-level vocabularies.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_loaded: dict[str, object] = {}


def encoding(path: str = VOCABULARY):
    """The tokenizer, loaded once per Python worker."""
    if path not in _loaded:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _loaded[path] = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path]


def token_ids(texts: list, path: str = VOCABULARY) -> list[np.ndarray]:
    """Token ids of each text; none for a null one. """
    enc = encoding(path)
    return [enc.encode_to_numpy(t) if t else np.empty(0, np.uint32) for t in texts]
