"""One plain form for texts that a reader would take for the same."""

from __future__ import annotations

import re
import unicodedata

import regex

#: Letters of other scripts that look like Latin ones, and letters that do not decompose.
LOOKALIKES = str.maketrans(
    {
        "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y",
        "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ɡ": "g", "ӏ": "l", "һ": "h", "ԛ": "q", "ԝ": "w",
        "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
        "ı": "i", "ß": "ss", "ø": "o", "æ": "a", "œ": "o", "ł": "l", "đ": "d", "ð": "d", "þ": "th",
    }
)

#: Accents, invisible and control characters, but for white space.
_UNSEEN = regex.compile(r"[[\p{Mn}\p{Cf}\p{Cc}]--[\s\x1c-\x1f]]", regex.V1)
_TAG = re.compile(r"<[^<>]{1,40}>")
_NOT_ASCII_WORD = re.compile(r"[^a-z0-9]+")
_NOT_WORD = re.compile(r"[^\w]+|_+")
_QUOTES = re.compile(r"['’ʼ`´]")
_ASCII_LETTER = re.compile(r"[a-z]")
_UMLAUT = re.compile(r"([aou])e")


def latin(text: str) -> str:
    """Lower case without accents, invisible characters and look-alike letters; other scripts stay as they are.

    Look-alikes are replaced only in words that hold Latin letters too, so that a Russian or Greek text keeps
    its letters.
    """
    if text.isascii():
        return text.lower()
    t = unicodedata.normalize("NFKC", text).casefold()
    t = _UNSEEN.sub("", unicodedata.normalize("NFKD", t))
    if not t.isascii():
        t = re.sub(r"\w+", lambda m: m[0].translate(LOOKALIKES) if _ASCII_LETTER.search(m[0]) else m[0], t)
    return t


def words(text: str) -> list[str]:
    """The words of a text in plain form: no tags, case, accents, apostrophes or punctuation; umlauts and their
    two-letter spellings fall together."""
    t = latin(_TAG.sub(" ", text))
    t = _QUOTES.sub("", t)
    t = _UMLAUT.sub(r"\1", (_NOT_ASCII_WORD if t.isascii() else _NOT_WORD).sub(" ", t))
    return t.split()
