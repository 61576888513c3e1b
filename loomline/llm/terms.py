"""Terms of whole texts, for use inside tasks.

A term is a maximal run of ASCII letters, of digits too if asked for, and of all
characters from U+0080 on; only A-Z are lower-cased. On UTF-8 that is a run of
bytes, so one table turns all other bytes into spaces and a split gives the terms.
"""

from __future__ import annotations

import string


def term_table(digits: bool) -> bytes:
    """For bytes.translate: A-Z to a-z, bytes outside of terms to spaces."""
    inside = string.ascii_lowercase + (string.digits if digits else "")
    table = bytearray(b" " * 128 + bytes(range(128, 256)))
    for c in inside:
        table[ord(c)] = table[ord(c.upper())] = ord(c)
    return bytes(table)


WITH_DIGITS, LETTERS = term_table(True), term_table(False)


def terms_of(text: str | None, table: bytes) -> list[bytes]:
    """Null: none."""
    return text.encode("utf-8", "surrogatepass").translate(table).split() if text else []
