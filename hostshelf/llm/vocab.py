"""Byte-level BPE vocabulary files of public tokenizers, as rank tables. Paths are parameters; nothing is copied."""

from __future__ import annotations

import base64
import json

#: What splits a text before the merges (fixed value of the vocabularies).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_of_char() -> dict[str, int]:
    """Byte-level vocabularies write each byte as a visible character: printable ones as themselves, the rest from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(0x100 + i): b for i, b in enumerate(rest)}


def rank_file(path: str) -> dict[bytes, int]:
    """Ranks of a `.tiktoken` file."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f)}


def json_file(path: str) -> tuple[dict[bytes, int], dict[str, int]]:
    """(ranks, special tokens) of a byte-level BPE `tokenizer.json`, whose ids are its merge ranks."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    byte = _byte_of_char()
    return {bytes(byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}, special


_ENCODINGS: dict[object, object] = {}


def encoding(name: str, ranks: dict[bytes, int], special: dict[str, int]):
    """The tokenizer object, built once per Python worker."""
    import tiktoken

    if name not in _ENCODINGS:
        _ENCODINGS[name] = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
    return _ENCODINGS[name]


def tokenizer(name: str, spec: str):
    """The `tokenizers` object of a `tokenizer.json` text, built once per Python worker."""
    from tokenizers import Tokenizer

    if (name, "json") not in _ENCODINGS:
        _ENCODINGS[name, "json"] = Tokenizer.from_str(spec)
    return _ENCODINGS[name, "json"]
