"""Token ids and byte offsets with a public byte-level BPE vocabulary, whole texts at a time.

The vocabulary file's path is a parameter. ``*.tiktoken`` (rank file, the quick way) and ``*.json`` (``tokenizers``) of the
same vocabulary give the same ids, those of its added tokens in a text included; ``tests/llm`` holds the two against each other.
"""

from __future__ import annotations

import base64
import json
import os

import numpy as np

_LOADED: dict[str, "RankEncoder | JsonEncoder"] = {}


class RankEncoder:
    """Ids from a rank file. The added tokens are those of the ``*.json`` file of the same name beside it, if there is one."""

    def __init__(self, path: str) -> None:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        added, beside = {}, os.path.splitext(path)[0] + ".json"
        if os.path.exists(beside):
            with open(beside, encoding="utf-8") as f:
                added = {x["content"]: x["id"] for x in json.load(f)["added_tokens"]}
        self.lengths = np.zeros(max([*ranks.values(), *added.values()]) + 1, dtype=np.int64)
        for token, rank in [*ranks.items(), *((x.encode(), i) for x, i in added.items())]:
            self.lengths[rank] = len(token)
        self._added = set(added)
        self._encoding = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)

    def ids(self, text: str) -> np.ndarray:
        return self._encoding.encode_to_numpy(text, allowed_special=self._added, disallowed_special=())

    def byte_ends(self, text: str) -> np.ndarray:
        """For each token the byte offset in the UTF-8 text at which it ends."""
        return np.cumsum(self.lengths[self.ids(text)])


class JsonEncoder:
    """The same ids by ``tokenizers``."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)

    def ids(self, text: str) -> np.ndarray:
        return np.array(self._tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint32)


def encoder(path: str) -> "RankEncoder | JsonEncoder":
    """This process's encoder for a vocabulary file; Python workers are reused, and so is what they loaded."""
    if path not in _LOADED:
        _LOADED[path] = RankEncoder(path) if path.endswith(".tiktoken") else JsonEncoder(path)
    return _LOADED[path]


def public_vocabulary(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Where the installed public tokenizer files are. It is the same path on every machine with the package."""
    import public_tokenizers

    return public_tokenizers.path(name)
