"""Byte-level BPE vocabularies: where the file is, its pieces, and fast encoders for tasks.

The file is read on the driver and its text sent to the tasks, so executors need no copy of it.
"""
from __future__ import annotations

import json
import re
from functools import lru_cache

#: Fixed: how the byte-level pre-tokenizer of this vocabulary parts a text.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def vocabulary(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def tokenizer(vocab: str):
    """The tokenizers library's own encoder, without truncation and padding."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    found = Tokenizer.from_str(vocab)
    found.no_truncation()
    found.no_padding()
    return found


def byte_of_char() -> dict[str, int]:
    """The byte that each character of a byte-level piece stands for: printable Latin-1 is itself,
    the other bytes follow in order from code point 256."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=1)
def _parsed(vocab: str) -> tuple[dict[str, int], dict[str, int], list]:
    found = json.loads(vocab)
    return found["model"]["vocab"], {t["content"]: t["id"] for t in found["added_tokens"]}, found["model"]["merges"]


def pieces(vocab: str) -> list[bytes]:
    """The bytes of each id; an added token is its own text."""
    words, added, _ = _parsed(vocab)
    to_byte = byte_of_char()
    found = [b""] * (1 + max([*words.values(), *added.values()]))
    for piece, i in words.items():
        found[i] = bytes(to_byte[c] for c in piece)
    for piece, i in added.items():
        found[i] = piece.encode()
    return found


def ranked(vocab: str) -> dict:
    """Arguments of a tiktoken encoder of the same ids. It merges by id, so ids must follow the merges' order; else an error."""
    words, added, merges = _parsed(vocab)
    order = [words["".join(m if isinstance(m, list) else m.split(" "))] for m in merges]
    if any(a >= b for a, b in zip(order, order[1:])):
        raise ValueError("ids don't follow the order of merges")
    to_byte = byte_of_char()
    return {"name": "bpe", "pat_str": PATTERN, "mergeable_ranks": {bytes(to_byte[c] for c in p): i for p, i in words.items() if p not in added}, "special_tokens": added}


_OPEN, _CUT = re.compile(r"\s[ \n]"), re.compile(r"(?<=\S)(?=[ \n])")


def split_words(text: str) -> list[str]:
    """Parts that encode alone as they do in the text: cut before a space or line end that follows
    a character other than white space. The pre-tokenizer never takes both sides of such a place
    into one piece, nor looks across it."""
    if "\0" not in text and not _OPEN.search(text):
        return text.replace("\n", "\0\n").replace(" ", "\0 ").split("\0")
    return _CUT.split(text)
