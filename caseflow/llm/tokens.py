"""Token ids of whole texts by a public tokenizer file, inside tasks.

A byte-level BPE whose merges are in the order of its ids is the same model for `tokenizers` and for `tiktoken`; the second
is about three times as fast.  Files of another kind, and texts that hold one of the file's special strings, are encoded by
`tokenizers` itself.
"""

from __future__ import annotations

import json
import os
from array import array
from functools import lru_cache

from .common import slices

#: The split before merging that a ByteLevel pre-tokenizer with ``use_regex`` stands for (fixed value).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes that stand for themselves in a byte-level vocabulary; the others follow from U+0100 on (fixed values).
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: Texts handed to the library at once: bounds the memory of a worker beside its batch of texts.
AT_ONCE = 256


def _byte_ranks(file: dict) -> dict[bytes, int] | None:
    """The ids of a byte-level BPE by their bytes, or None if ids and merges are not in one order or splitting differs."""
    model, before = file["model"], file.get("pre_tokenizer") or {}
    if (file.get("normalizer"), before.get("type"), before.get("add_prefix_space"), before.get("use_regex", True)) != (None, "ByteLevel", False, True):
        return None
    if model.get("type", "BPE") != "BPE" or model.get("dropout") or model.get("ignore_merges"):
        return None
    special = {t["content"] for t in file["added_tokens"]}
    vocabulary = {t: i for t, i in model["vocab"].items() if t not in special}
    merged = [vocabulary.get("".join(m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
    if sorted(vocabulary.values()) != list(range(256 + len(merged))) or merged != list(range(256, 256 + len(merged))):
        return None
    others = [b for b in range(256) if b not in PRINTABLE]
    byte = {chr(b): b for b in PRINTABLE} | {chr(256 + k): b for k, b in enumerate(others)}
    return {bytes(byte[c] for c in t): i for t, i in vocabulary.items()}


class TextTokenizer:
    """``ids(texts)`` gives each text's ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as file:
            ranks = _byte_ranks(json.load(file))
        self.fast = None
        if ranks:
            import tiktoken

            self.fast = tiktoken.Encoding(os.path.basename(path), pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[bytes]:
        """By the library that the file belongs to."""
        return [array("I", x.ids).tobytes() for some in slices(texts, AT_ONCE)
                for x in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)]

    def ids(self, texts: list[str | None]) -> list[bytes]:
        if self.fast is None:
            return self.encode([t or "" for t in texts])
        return [b"" if not t else self.encode([t])[0] if any(s in t for s in self.special)
                else array("I", self.fast.encode_ordinary(t)).tobytes() for t in texts]


@lru_cache(maxsize=2)
def tokenizer(path: str) -> TextTokenizer:
    """One per worker and file, kept over tasks."""
    return TextTokenizer(path)
