"""Hashed character n-grams of many texts at once, with numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_MULTIPLIER = np.uint32(0x9E3779B1)
#: Texts are taken together up to so many characters, so memory stays bounded beside one long text.
_CHARS = 1 << 20
_TEXTS = 256


def groups(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts (first index, texts) of about _CHARS characters and at most _TEXTS texts each."""
    first, held, size = 0, [], 0
    for i, text in enumerate(texts):
        text = text or ""
        if held and (size + len(text) > _CHARS or len(held) == _TEXTS):
            yield first, held
            first, held, size = i, [], 0
        held.append(text)
        size += len(text)
    if held:
        yield first, held


def hashed(texts: list[str], sizes: tuple[int, ...], bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n-gram size: the owner (index into ``texts``) and bucket of every n-gram.

    Texts are lower-cased and put between blanks, so words at the ends have edges too; a text has no
    n-gram that reaches into another. Buckets are numbers below 2**bits.
    """
    padded = [f" {t.lower()} " for t in texts]
    lengths = np.fromiter(map(len, padded), np.int64, len(padded))
    chars = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(padded), dtype=np.int32), lengths)
    shift = np.uint32(32 - bits)
    value = chars
    for n in range(1, max(sizes) + 1):
        if n > 1:
            if len(chars) < n:
                break
            value = value[:-1] * _MULTIPLIER + chars[n - 1 :]
        if n in sizes:
            mixed = (value ^ (value >> np.uint32(15))) * np.uint32(0x85EBCA6B) + np.uint32(n)
            same = owner[: len(value)] == owner[n - 1 :]
            yield owner[: len(value)][same], ((mixed * _MULTIPLIER) >> shift)[same].astype(np.int64)
