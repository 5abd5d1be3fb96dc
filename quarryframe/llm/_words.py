"""Letter words: the parts of a text between ASCII characters that are no letters, in lower case, as UTF-8."""

from __future__ import annotations

_TABLE = bytes(c if chr(c).isalpha() or c >= 128 else 32 for c in range(256))


def letter_words(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "replace").translate(_TABLE).split()


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))
