"""Words of UTF-8 texts, as byte strings.

Texts reach the Python workers as binary columns, so that no text is decoded
only to be split. Splitting never looks at a prefix: whole texts are used.
"""

from __future__ import annotations

import string

_LOWER = bytes.maketrans(string.ascii_uppercase.encode(), string.ascii_lowercase.encode())
_KEPT = set((string.ascii_lowercase + string.digits).encode()) | set(range(0x80, 0x100))
_ALNUM = bytes(b if (b := _LOWER[i]) in _KEPT else 0x20 for i in range(256))

#: The same words as an SQL regular expression over text whose A-Z may still be upper case.
ALNUM_WORD_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: ... and over text whose A-Z are lower-cased already.
ALNUM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = string.ascii_uppercase, string.ascii_lowercase


def alnum_words(text: bytes | None) -> list[bytes]:
    """A-Z lower-cased, then runs of a-z, 0-9 and everything outside ASCII. Null and empty texts have none."""
    return text.translate(_ALNUM).split() if text else []


def space_words(text: bytes | None) -> list[bytes]:
    """A-Z lower-cased, then runs without a space or one of U+0009 to U+000D. Null and empty texts have none."""
    return text.translate(_LOWER).split() if text else []
