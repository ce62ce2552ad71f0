"""Text columns: white space, transcript tags, first usable fields, roles and message contents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode has it, with the four separators below the blank; trim() knows the blank only.
WS = r"[\s\x1c-\x1f]"

# The punctuation tags of transcripts with their marks, in the order they are replaced, and the tags
# that make up an utterance without speech.
PUNCTUATION_TAGS = (
    ("<COMMA>", ","),
    ("<PERIOD>", "."),
    ("<QUESTIONMARK>", "?"),
    ("<EXCLAMATIONPOINT>", "!"),
    ("<COLON>", ":"),
    ("<SEMICOLON>", ";"),
    ("<APOSTROPHE>", "'"),
    ("<QUOTE>", '"'),
    ("<LEFTPAREN>", "("),
    ("<RIGHTPAREN>", ")"),
    ("<HYPHEN>", "-"),
)
SPEECHLESS = ("<SIL>", "<MUSIC>", "<NOISE>", "<OTHER>")


def strip(c: Column) -> Column:
    """Without white space at both ends; null stays null."""
    return F.regexp_replace(c, rf"(?U)^{WS}+|{WS}+$", "")


def squeeze(c: Column) -> Column:
    """Stripped, each run of white space one blank; null becomes empty."""
    return F.coalesce(strip(F.regexp_replace(c, rf"(?U){WS}+", " ")), F.lit(""))


def stripped(c: Column) -> Column:
    """Stripped; null becomes empty."""
    return F.coalesce(strip(c), F.lit(""))


def spoken_text(c: Column) -> Column:
    """A transcript with its tags read out: marks for punctuation tags, nothing for the others, no blank before a
    mark, single blanks, lower case; null becomes empty."""
    out = strip(c)
    for tag, mark in PUNCTUATION_TAGS:
        out = F.replace(out, F.lit(tag), F.lit(mark))
    out = F.regexp_replace(out, rf"(?U){WS}*<[^<>]+>{WS}*", " ")
    out = F.regexp_replace(out, rf"(?U){WS}+([,.:;?!])", "$1")
    return F.lower(squeeze(out))


def is_speechless(raw: Column) -> Column:
    """Whether a raw transcript is one tag for missing speech and nothing else."""
    return F.coalesce(strip(raw).isin(*SPEECHLESS), F.lit(False))


def filled(c: Column) -> Column:
    """The value, or null where it is blank."""
    return F.when(F.length(strip(c)) > 0, c)


def first_filled(*cs: Column) -> Column:
    """The first value that is not blank, else the empty string."""
    return F.coalesce(*(filled(c) for c in cs), F.lit(""))


def role(c: Column) -> Column:
    """user, assistant or system for their usual spellings, any other role as it is, empty for null."""
    r = F.lower(stripped(c))
    return F.when(r.isin("human", "user"), "user").when(r.isin("assistant", "gpt", "bot"), "assistant").otherwise(r)


def without_mark(c: Column, mark: str = "<text> ") -> Column:
    """Without one modality mark in front."""
    return F.when(c.startswith(mark), F.substring(c, len(mark) + 1, 2**31 - 1)).otherwise(c)


def preview(c: Column, n: int = 4000) -> Column:
    """The first n characters."""
    return F.substring(c, 1, n)
