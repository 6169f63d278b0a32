"""Tokens, words, lines and small helpers as Column expressions.

Lengths and offsets count code points, 0-based where they are positions.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The stop words of the corpus tools, in their customary order.
STOP_WORDS = (
    "a an and are as at be been but by for from has have he her his i in into is it its of on or our she so than that the "
    "their them then there these they this to was we were what when which who will with you your not no do does did can could "
    "would should may might just also about over after before more most such only own same too very s t"
).split()

# Characters of a token; upper-case letters matter only where case is kept.
TOKEN_CHARS = "a-z0-9À-ɏ'"
#: Unicode white space as it is trimmed from lines: Java's set in Unicode mode, and U+FEFF.
EDGE_SPACE = r"(?U)^[\s\x{FEFF}]+|[\s\x{FEFF}]+$"


def raw_words(text: Column) -> Column:
    """Lower-cased runs of token characters, apostrophes at the edges included."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"[{TOKEN_CHARS}]+"), F.lit(0))


def is_stop_word(word: Column) -> Column:
    return F.lower(word).isin(STOP_WORDS)


def token_pattern(lowercase: bool = True) -> str:
    """A token's pattern, which Java and Python read alike."""
    inner = TOKEN_CHARS.removesuffix("'") if lowercase else "A-Z" + TOKEN_CHARS.removesuffix("'")
    return f"[{inner}](?:[{inner}']*[{inner}])?"


def tokens(text: Column, lowercase: bool = True, remove_stop_words: bool = False) -> Column:
    """Array of a text's tokens in order, runs of token characters without the apostrophes at their edges; null gives null."""
    found = F.regexp_extract_all(F.lower(text) if lowercase else text, F.lit(token_pattern(lowercase)), F.lit(0))
    if not remove_stop_words:
        return found
    return F.filter(found, lambda t: ~(t.isin(STOP_WORDS) if lowercase else is_stop_word(t)))


def word_count(text: Column) -> Column:
    """Runs of characters that are not white space."""
    return F.regexp_count(text, F.lit(r"\S+"))


def line_count(text: Column) -> Column:
    return F.when(text == "", 0).otherwise(F.size(lines(text)))


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def trim(text: Column) -> Column:
    """Without white space of any script at both ends; a text of ASCII has six kinds of it and needs no pattern."""
    return F.when(F.octet_length(text) == F.length(text), F.btrim(text, F.lit(" \t\n\x0b\f\r"))).otherwise(F.regexp_replace(text, EDGE_SPACE, ""))


def has_text(text: Column) -> Column:
    """Whether a text is more than white space of any script."""
    return F.rlike(text, F.lit(r"(?U)[^\s\x{FEFF}]"))


def split_documents(text: Column) -> Column:
    """Array of the non-blank lines of a text, trimmed."""
    return F.filter(F.transform(F.split(text, r"\r?\n", -1), trim), lambda x: x != "")


def round4(value: Column) -> Column:
    """To four places, halves up."""
    return F.floor(value * 10000 + 0.5) / 10000


def shortened(text: Column, most: int, mark: str = "…") -> Column:
    """The first ``most`` characters, with a mark where more follow."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit(mark))).otherwise(text)


def span(start: Column, length: Column) -> Column:
    """Array of ``length`` indexes from ``start`` on; none or less: empty."""
    return F.when(length > 0, F.sequence(start, start + length - 1)).otherwise(F.array().cast("array<int>"))


def quoted(pattern: str) -> str:
    """A Java regular expression that matches ``pattern`` literally."""
    return r"\Q" + pattern.replace(r"\E", r"\E\\E\Q") + r"\E"


def quoted_column(pattern: Column) -> Column:
    """The same for a column of patterns."""
    return F.concat(F.lit(r"\Q"), F.replace(pattern, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def normalize_answer(text: Column) -> Column:
    """Trimmed and lower-cased, brackets dropped, list separators turned into single commas."""
    parts = F.split(F.regexp_replace(F.lower(trim(text)), r"[\[\]{}()]", ""), r"[\s,;]+")
    return F.array_join(F.filter(parts, lambda x: x != ""), ",")


def strip_marks(text: Column) -> Column:
    """Compatibility forms without combining marks U+0300 to U+036F; Spark has no built-in normaliser.

    Plain ASCII has nothing to change, so such texts never leave the JVM.
    """

    # A text at a time: a batch's texts are held once as they come and once as they go.
    @F.arrow_udf(StringType())
    def strip(texts: pa.Array) -> pa.Array:
        def each() -> Iterator[str | None]:
            for t in texts:
                t = t.as_py()
                yield None if t is None else unicodedata.normalize("NFKC", marks.sub("", unicodedata.normalize("NFKD", t)))

        return pa.array(each(), pa.string())

    marks = re.compile("[\u0300-\u036f]")
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, text).otherwise(strip(F.when(plain, F.lit(None).cast("string")).otherwise(text)))
