"""The words of a text: its longest runs of letters and digits after normalisation."""

from __future__ import annotations

import re
import unicodedata

#: Characters without width that are removed.
INVISIBLE = dict.fromkeys((0x00AD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF))
#: Letters and digits of any script: word characters without the underscore.
_INVISIBLE = re.compile("[" + "".join(map(chr, INVISIBLE)) + "]")
WORD = re.compile(r"[^\W_]+")
_PLAIN = re.compile(r"[a-z0-9]+")


def words(text: str | None) -> list[str]:
    """In order, with repeats; none for null.  NFKC, then removal of invisible characters, then lower case."""
    if not text:
        return []
    if text.isascii():
        return _PLAIN.findall(text.lower())
    if not unicodedata.is_normalized("NFKC", text):
        text = unicodedata.normalize("NFKC", text)
    return WORD.findall(_INVISIBLE.sub("", text).lower())


def words_sql(x: str) -> str:
    """The words in the SQL of the oracles, for texts whose compatibility forms are full-width ones, ligatures and superscripts."""
    wide = "".join(map(chr, range(0xFF01, 0xFF5F)))
    plain = "".join(map(chr, range(0x21, 0x7F))).replace("'", "''")
    forms = f"replace(replace(replace(translate({x}, '{wide}²³¹', '{plain}231'), 'ﬁ', 'fi'), 'ﬂ', 'fl'), '…', '...')"
    return f"regexp_extract_all(lower(regexp_replace(nfc_normalize({forms}), '[{''.join(map(chr, INVISIBLE))}]', '', 'g')), '[\\p{{L}}\\p{{N}}]+')"
