"""Ids of a public byte-pair vocabulary, for texts of any shape.

The vocabulary is a rank file or a tokenizer's JSON file whose ids are the ranks of its merges. The
pattern looks ahead behind white space, which its library cannot do over very long runs. They
are taken out first by the rule of the pattern itself: of a run all but the last character is one
piece, or all of it at the end of the text.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import sys

import numpy as np
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Fixed: how the vocabulary's publisher splits text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# Fixed: the characters that Unicode calls white space.
LONG_BLANK = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{1024,}")


def _byte_letters() -> dict[str, int]:
    """How a byte-level JSON vocabulary writes bytes: printable ones as themselves, the others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(0x100 + n): b for n, b in enumerate(hidden)}


def ranks_of(vocabulary: bytes) -> dict[bytes, int]:
    if not vocabulary.lstrip().startswith(b"{"):
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, vocabulary.splitlines())}
    whole = json.loads(vocabulary)
    special, letters = {t["content"] for t in whole["added_tokens"]}, _byte_letters()
    known = whole["model"]["vocab"]
    merges = [m if isinstance(m, list) else m.split(" ") for m in whole["model"]["merges"]]
    made = [known[a + b] for a, b in merges]
    if made != sorted(made):
        raise ValueError("the ids of this vocabulary are not the ranks of its merges")
    return {bytes(map(letters.__getitem__, token)): i for token, i in known.items() if token not in special}


class Encoder:
    def __init__(self, vocabulary: bytes, pattern: str = PATTERN):
        import tiktoken

        ranks = ranks_of(vocabulary)
        self.split = tiktoken.Encoding("split", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        # everything is one piece
        self.whole = tiktoken.Encoding("whole", pat_str=r"(?s:.)+", mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def parts(self, text: str) -> list[list[int]]:
        """Lists of ids; together they are those of the text."""
        run = LONG_BLANK.search(text)
        if run is None:
            return [self.split(text)]
        found, at = [], 0
        while run:
            end = run.end() - (run.end() < len(text))
            found += [self.split(text[at : run.start()]), self.whole(text[run.start() : end])]
            at, run = end, LONG_BLANK.search(text, run.end())
        return [*found, self.split(text[at:])]

    def count(self, text: str) -> int:
        return sum(map(len, self.parts(text)))

    def encode(self, text: str) -> bytes:
        """Little-endian 32-bit ids."""
        return b"".join([np.array(ids, "<u4").tobytes() for ids in self.parts(text)])


def encoder_of(vocabulary: bytes, pattern: str = PATTERN) -> Encoder:
    """One for all tasks that follow one another in a Python worker."""
    shared = vars(sys).setdefault("_tidelog_byte_pairs", {})
    name = hashlib.sha1(vocabulary + pattern.encode()).hexdigest()
    if name not in shared:
        shared[name] = Encoder(vocabulary, pattern)
    return shared[name]
