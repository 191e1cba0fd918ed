"""A byte-level BPE vocabulary read from a tokenizer file, and the character classes that its
pre-tokenizer's pattern uses, as the installed library has them."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np

#: Code points end here; surrogates are no characters.
LIMIT = 0x110000


def printable_bytes() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies: printable Latin-1
    characters for themselves, the others in order from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(other)}


@lru_cache(maxsize=1)
def class_ranges() -> dict[str, list[tuple[int, int]]]:
    """Inclusive ranges of letters, numbers and white space, asked of the library's own engine."""
    from tokenizers import Regex, pre_tokenizers

    points = [c for c in range(LIMIT) if not 0xD800 <= c < 0xE000]
    text, out = "".join(map(chr, points)), {}
    for name, pattern in (("letter", r"\p{L}+"), ("number", r"\p{N}+"), ("space", r"\s+")):
        rest = pre_tokenizers.Split(Regex(pattern), "removed").pre_tokenize_str(text)
        edges = [0, *(x for _, span in rest for x in span), len(text)]
        out[name] = [(points[a], points[b - 1]) for a, b in zip(edges[::2], edges[1::2]) if a < b]
    return out


@dataclass
class Vocabulary:
    """``token_bytes`` by id; merges in order as (left id, right id, id); special strings."""

    token_bytes: list[bytes]
    merges: np.ndarray
    specials: dict[str, int]
    classes: dict[str, list[tuple[int, int]]] = field(default_factory=dict)

    @staticmethod
    def load(path: str) -> Vocabulary:
        """Reads a .json tokenizer file: byte-level BPE without normalizer, prefix space or dropout."""
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, before = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or before["type"] != "ByteLevel" or spec["normalizer"] or before["add_prefix_space"] or not before["use_regex"] or model.get("ignore_merges"):
            raise ValueError(f"{path} is no plain byte-level BPE")
        byte = printable_bytes()
        ids = model["vocab"]
        specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError(f"{path} has added tokens of a kind that is not handled")
        token_bytes = [b""] * (max([*ids.values(), *specials.values()]) + 1)
        for token, i in ids.items():
            token_bytes[i] = bytes(byte[c] for c in token)
        for token, i in specials.items():
            token_bytes[i] = token.encode()
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        merges = np.array([(ids[a], ids[b], ids[a + b]) for a, b in pairs], np.int64).reshape(-1, 3)
        return Vocabulary(token_bytes, merges, specials, class_ranges())
