"""Token ids of whole texts in a byte-level BPE vocabulary.

The vocabulary is read from the file of the library tokenizers. Its ids follow the order of merges, so they serve as ranks for
tiktoken, which gives the same ids several times faster; tests hold the two against each other. As in the tokenizer as
it is loaded, the strings of added tokens in a text are those tokens.
"""

from __future__ import annotations

import json
import re
import sys
import types
from collections.abc import Callable
from itertools import chain
from typing import Any

import numpy as np

#: The vocabulary of the registered queries, by its name in the package of public tokenizers.
VOCABULARY = "byte_bpe_50k.json"
#: Distinct pre-tokens whose counts a worker remembers, and the longest of them.
MOST_KEPT, LONGEST = 1 << 18, 64


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def once_a_worker(key: tuple, make: Callable[[], Any]) -> Any:
    """make(), kept for later tasks of the same Python worker."""
    store = sys.modules.setdefault("seriesloom_worker_store", types.ModuleType("seriesloom_worker_store")).__dict__
    if key not in store:
        store[key] = make()
    return store[key]


def byte_of_character() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the others as the characters from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(0x100 + i): b for i, b in enumerate(others)}


def load(path: str) -> tuple[Any, Any, list[str]]:
    """The encoding, the compiled pattern of pre-tokens, and the strings of the added tokens."""
    import public_tokenizers
    import regex
    import tiktoken

    with open(path, encoding="utf-8") as file:
        tree = json.load(file)
    added = {x["content"]: x["id"] for x in tree["added_tokens"]}
    if any(x["single_word"] or x["lstrip"] or x["rstrip"] or x["normalized"] for x in tree["added_tokens"]):
        raise ValueError(f"{path} has added tokens that take in what is around them")
    byte = byte_of_character()
    ranks = {bytes(byte[c] for c in token): i for token, i in tree["model"]["vocab"].items() if token not in added}
    encoding = tiktoken.Encoding("seriesloom", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)
    return encoding, regex.compile(public_tokenizers.PATTERN), sorted(added, key=len, reverse=True)


class _Counts(dict):
    """Number of ids of each pre-token; forgets all when it has too many."""

    def __init__(self, encoding: Any):
        self.encoding = encoding

    def __missing__(self, part: str) -> int:
        n = len(self.encoding.encode_to_numpy(part, allowed_special="all"))
        if len(part) <= LONGEST:
            if len(self) >= MOST_KEPT:
                self.clear()
            self[part] = n
        return n


class Encoder:
    """Ids, pre-tokens and their counts. Ids never cross the borders of pre-tokens; an added token is a pre-token of its own."""

    def __init__(self, path: str | None = None):
        path = path or vocabulary_path()
        self.encoding, self.pattern, self.added = once_a_worker(("vocabulary", path), lambda: load(path))
        self._counts = once_a_worker(("counts", path), lambda: _Counts(self.encoding))
        self._split = re.compile(f"({'|'.join(map(re.escape, self.added))})") if self.added else None
        #: No border of pre-tokens depends on characters that are further from it than this, but for runs of one kind.
        self.reach = max([3, *map(len, self.added)])

    def ids(self, text: str) -> np.ndarray:
        return self.encoding.encode_to_numpy(text, allowed_special="all")

    def pre_tokens(self, text: str) -> list[str]:
        """The text in the parts that are encoded each by itself."""
        if not any(a in text for a in self.added):
            return self.pattern.findall(text)
        parts = self._split.split(text)  # every other part is an added token
        return [x for x in chain.from_iterable([p] if i % 2 else self.pattern.findall(p) for i, p in enumerate(parts)) if x]

    def counts(self, parts: list[str]) -> np.ndarray:
        """Number of ids of each pre-token."""
        return np.fromiter(map(self._counts.__getitem__, parts), dtype=np.int64, count=len(parts))
