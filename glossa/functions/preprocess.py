"""The preprocessing pipeline: eight stages in a fixed order, each switched by a flag, with a report."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import STOP_WORDS, has_text, line_count, lines, strip_marks, tokens, trim, word_count

# Punctuation that becomes a space; the apostrophe stays.
PUNCTUATION = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~“”‘’…–—"


def lowercase(text: Column) -> Column:
    return F.lower(text)


def remove_punctuation(text: Column) -> Column:
    return F.translate(text, PUNCTUATION, " " * len(PUNCTUATION))


def remove_stop_words(text: Column) -> Column:
    """Drops stop words and leaves the white space around them; a token is judged by its letters a-z and apostrophes.

    Only tokens with other characters besides letters are searched for what to leave out;
    white space never is a stop word.
    """
    parts = F.regexp_extract_all(text, F.lit(r"\s+|\S+"), F.lit(0))

    def stays(part: Column) -> Column:
        low = F.lower(part)
        mixed = F.rlike(low, F.lit(r"[^a-z'\s]"))
        return F.when(mixed, ~F.regexp_replace(low, "[^a-z']", "").isin(STOP_WORDS)).otherwise(~low.isin(STOP_WORDS))

    return F.array_join(F.filter(parts, stays), "")


# Stages by line: from an array of lines to one.


def normalize_whitespace(every: Column) -> Column:
    return F.transform(every, lambda x: trim(F.regexp_replace(x, r"[ \t\r\f\x0B]+", " ")))


def remove_empty_lines(every: Column) -> Column:
    return F.filter(every, has_text)


def remove_duplicate_lines(every: Column) -> Column:
    """Keeps the first of equal lines; blank lines stay, as each is told apart by its place while the others are made distinct."""
    named = F.transform(every, lambda x, i: F.when(has_text(x), F.concat(F.lit("="), x)).otherwise(F.concat(i.cast("string"), F.lit("|"), x)))
    return F.transform(F.array_distinct(named), lambda x: F.when(F.startswith(x, F.lit("=")), F.substr(x, F.lit(2))).otherwise(F.regexp_replace(x, r"^\d+\|", "")))


def tokenize_lines(every: Column) -> Column:
    """Each line's tokens, case kept, joined by single spaces."""
    return F.transform(every, lambda x: F.array_join(tokens(x, lowercase=False), " "))


def _fewer(measure: Callable[[Column], Column]) -> Callable[[Column, Column], Column]:
    return lambda before, after: measure(before) - measure(after)


#: The stages in the order in which they run, by the name of their flag: what they do, whether to the text or to its lines, what they count from the texts before and after, and its unit.
STAGES: dict[str, tuple[Callable[[Column], Column], bool, Callable[[Column, Column], Column], str]] = {
    "normalizeUnicode": (strip_marks, False, _fewer(F.length), "characters removed"),
    "lowercase": (lowercase, False, lambda before, _: F.regexp_count(before, F.lit(r"[A-Z\u00C0-\u00DE]")), "uppercase characters converted"),
    "removePunctuation": (remove_punctuation, False, lambda before, _: F.length(before) - F.length(F.translate(before, PUNCTUATION, "")), "punctuation marks replaced"),
    "removeStopWords": (remove_stop_words, False, lambda before, after: F.greatest(F.lit(0), word_count(before) - word_count(after)), "stop words removed"),
    "normalizeWhitespace": (normalize_whitespace, True, _fewer(F.length), "characters removed"),
    "removeEmptyLines": (remove_empty_lines, True, _fewer(line_count), "empty lines removed"),
    "removeDuplicateLines": (remove_duplicate_lines, True, _fewer(line_count), "duplicate lines removed"),
    "tokenize": (tokenize_lines, True, lambda _, after: word_count(after), "tokens produced"),
}


def preprocess(df: DataFrame, config: dict[str, bool], text: str = "text", output: str = "text", report: str | None = None) -> DataFrame:
    """``df`` with the stages of ``config`` applied to ``text``.

    With ``report``, a struct column of that name holds the stages that ran with the
    characters before and after each and what it counted (``detail``), and characters,
    lines and words before and after all.  Every stage is a column of its own, so none is
    computed twice; stages by line hand on lines, which are put together for what is asked for only.
    """
    unknown = set(config) - set(STAGES)
    if unknown:
        raise ValueError(f"unknown preprocessing flags: {sorted(unknown)}")
    names = [n for n in STAGES if config.get(n)]
    columns = df.columns
    out, by_line, texts = df.withColumn("__stage0", F.col(text)), False, [F.col("__stage0")]
    for k, name in enumerate(names):
        step, wants_lines, _, _ = STAGES[name]
        if wants_lines and not by_line:
            out = out.withColumn(f"__lines{k}", lines(texts[-1]))
        out = out.withColumn(f"__lines{k + 1}" if wants_lines else f"__stage{k + 1}", step(F.col(f"__lines{k}") if wants_lines else texts[-1]))
        texts.append(F.array_join(f"__lines{k + 1}", "\n") if wants_lines else F.col(f"__stage{k + 1}"))
        by_line = wants_lines
    extra = []
    if report:
        # The texts between stages by line are columns too, made where the report is asked for.
        out = out.withColumns({f"__text{k}": t for k, t in enumerate(texts)})
        texts = [F.col(f"__text{k}") for k in range(len(texts))]
        steps = []
        for k, n in enumerate(names):
            detail = F.concat(F.format_number(STAGES[n][2](texts[k], texts[k + 1]), 0), F.lit(f" {STAGES[n][3]}"))
            steps.append(F.struct(F.lit(n).alias("name"), F.length(texts[k]).alias("charsBefore"), F.length(texts[k + 1]).alias("charsAfter"), detail.alias("detail")))
        sizes = lambda c: F.struct(F.length(c).alias("chars"), line_count(c).alias("lines"), word_count(c).alias("words"))
        empty = F.array().cast("array<struct<name:string,charsBefore:int,charsAfter:int,detail:string>>")
        extra = [F.struct((F.array(*steps) if steps else empty).alias("steps"), sizes(texts[0]).alias("before"), sizes(texts[-1]).alias("after")).alias(report)]
    kept = [F.col(f"`{c}`") for c in columns if c not in (output, report)]
    return out.select(*kept, texts[-1].alias(output), *extra)
