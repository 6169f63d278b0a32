"""URL filters: pattern rules behind an index on each rule's rarest literal token.

Token frequencies are counted over all URLs of the table, for tokens of the
rules only.  Each rule is filed under the rarest of its tokens; a URL's own
tokens fetch its candidate rules, and only those run their regular expression.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Up to this many rules the index is a literal of the plan; above, it is a table that is joined.
LITERAL_RULES = 500

_FIELDS = "pattern string, site boolean, length int, place int, name string, verdict string"


@dataclass(frozen=True)
class Rule:
    """A site rule: it fits a host, its subdomains and, on them, paths from a prefix, whose case counts."""

    host: str
    path: str
    verdict: str

    site = True

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def pattern(self) -> str:
        """Regular expression over host, path and query; the path begins with ``/`` or is empty."""
        return rf"^(?:[^/?]*\.)?{_quoted(self.host)}{_quoted(self.path)}" + ("" if self.path else r"(?:[/?]|\z)")

    @property
    def tokens(self) -> list[str]:
        """Literal tokens, lower-cased, that each matching URL has: those with a boundary on both sides."""
        return _bounded(f" {self.host} {self.path}", open_end=bool(self.path))


@dataclass(frozen=True)
class Pattern:
    """A pattern rule over host, path and query, case aside.

    What stands before the first ``/`` or ``?`` is for the host, what follows for the
    rest.  ``*`` is any run of characters (of the host before a ``/``), ``^`` at either
    end of the host's part or at the end of all is a place where no letter or digit goes
    on, ``^`` elsewhere is one character that is neither, and ``|`` at the end is the end
    of the URL.  The host's part fits anywhere in the host; where it is given together with
    a rest it fits the host or a parent of it.  The rest fits from the path's beginning on.
    """

    text: str
    verdict: str

    site = False

    @property
    def name(self) -> str:
        return self.text

    def _parts(self) -> tuple[str, str]:
        at = re.search("[/?]", self.text)
        return (self.text[: at.start()], self.text[at.start() :]) if at else (self.text, "")

    @property
    def pattern(self) -> str:
        host, rest = self._parts()
        if not rest:
            return rf"(?is)^[^/?]*{_translated(host, '[^/?]*')}[^/?]*(?:[/?]|\z)"
        return "(?is)^" + (rf"(?:[^/?]*\.)?{_translated(host, '[^/?]*')}" if host else "[^/?]*") + _translated(rest, ".*")

    @property
    def tokens(self) -> list[str]:
        host, rest = self._parts()
        whole = " " + host if rest else host  # without a rest the host's part may begin and end within a word
        return sorted({*_bounded(whole, open_end=not rest and not host.endswith("^"), open_start=not rest), *_bounded(rest, open_end=not rest.endswith(("^", "|")))})


def _quoted(text: str) -> str:
    return re.sub(r"([^A-Za-z0-9/_-])", r"\\\1", text)


def _translated(text: str, anything: str) -> str:
    """A pattern's part as a regular expression."""
    end = r"\z" if text.endswith("|") else ""
    text = text.removesuffix("|")
    inner = text[text.startswith("^") : len(text) - (text.endswith("^") and len(text) > 1)]
    body = "".join(anything if c == "*" else "[^A-Za-z0-9]" if c == "^" else _quoted(c) for c in inner)
    return ("(?<![A-Za-z0-9])" if text.startswith("^") else "") + body + ("(?![A-Za-z0-9])" if text.endswith("^") else "") + end


def _bounded(text: str, open_end: bool, open_start: bool = False) -> list[str]:
    """Runs of letters and digits that no ``*`` and no open end may continue, lower-cased."""
    out = []
    for m in re.finditer("[A-Za-z0-9]+", text):
        before, after = text[m.start() - 1 : m.start()], text[m.end() : m.end() + 1]
        if before != "*" and after != "*" and (before or not open_start) and (after or not open_end):
            out.append(m.group().lower())
    return sorted(set(out))


#: The method's own rules for URLs that no site rule fits: hosts of betting, loans, pills and the like, and pages without content.
DEFAULT_PATTERNS = tuple(
    Pattern(text, "block")
    for text in (
        *(f"^{word}^" for word in ("bets", "betting", "casino", "cheap", "loans", "lottery", "pills", "poker", "porn", "slots", "viagra", "warez", "xxx")),
        "/wp-login.php^", "/xmlrpc.php^", "/cgi-bin/", "/*/cart^", "/*/checkout^", "/*.exe|", "/*^sessionid^", "/*/print/*?", "adserver*.",
    )
)


def url_parts(url: Column) -> tuple[Column, Column, Column]:
    """Host (A-Z lower-cased), path, and query with its ``?``; all empty for null and where there is no ``://``."""
    grab = r"://([^/?#]*)([^?#]*)(\?[^#]*)?"
    url = F.coalesce(url, F.lit(""))
    return _lowered(F.regexp_extract(url, grab, 1)), F.regexp_extract(url, grab, 2), F.regexp_extract(url, grab, 3)


def _lowered(text: Column) -> Column:
    """A-Z as a-z, nothing else: other letters are no part of a token."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def judge_urls(
    pages: DataFrame,
    rules: list[Rule | Pattern],
    url: str = "url",
    key: str = "page_id",
    patterns: tuple[Pattern, ...] = DEFAULT_PATTERNS,
    literal_rules: int = LITERAL_RULES,
) -> DataFrame:
    """One row per input row: ``page_id, host, path, rule, verdict``.

    The longest fitting site rule decides (ties: the first by name); else the longest
    fitting pattern rule does, else the URL is allowed.  ``rule`` is null unless it was a
    site rule.  Null, empty and malformed URLs have empty host and path and are allowed.
    Repeated rows are judged each; an empty table gives an empty result; other columns
    are ignored.
    """
    host, path, query = url_parts(F.col(url))
    rows = pages.select(F.col(key).alias("page_id"), host.alias("host"), path.alias("path"), query.alias("query"))
    rows = rows.withColumn("target", F.concat("host", "path", "query"))
    every = sorted({*rules, *patterns}, key=lambda r: (r.name, not r.site, r.verdict))
    if len(every) <= literal_rules:
        judged = rows.withColumn("best", _best(_from_literal(_words(), _file(rows, every))))
    else:
        judged = _by_join(rows, every)
    best = F.col("best")
    return judged.select(
        "page_id",
        "host",
        "path",
        F.when(best["site"], best["name"]).alias("rule"),
        F.coalesce(best["verdict"], F.lit("allow")).alias("verdict"),
    )


def _words() -> Column:
    """A URL's distinct tokens, lower-cased; host, path and query don't run on into each other."""
    return F.array_distinct(F.split(_lowered(F.concat_ws(" ", "host", "path", "query")), "[^a-z0-9]+"))


def _rank(r: Column) -> Column:
    """A struct that orders as rules do: site rules first, then length, then the first name."""
    return F.struct(r["site"].alias("site"), r["length"].alias("length"), (-r["place"]).alias("place"), r["name"].alias("name"), r["verdict"].alias("verdict"))


def _best(candidates: Column) -> Column:
    """The rank of the first of the candidate rules that fit; only these run their patterns."""
    return F.array_max(F.transform(F.filter(candidates, lambda r: F.rlike(F.col("target"), r["pattern"])), _rank))


def _entry(place: int, rule: Rule | Pattern) -> tuple:
    return rule.pattern, rule.site, len(rule.name), place, rule.name, rule.verdict


def _file(rows: DataFrame, rules: list[Rule | Pattern]) -> dict[str, list[tuple]]:
    """Rules by the token that is rarest in the table; under '' those without a token."""
    tokens = sorted({t for r in rules for t in r.tokens})
    words = rows.select(F.explode(F.filter(_words(), lambda w: w.isin(tokens))).alias("token"))
    often = {r["token"]: r["count"] for r in words.groupBy("token").count().collect()}  # one row a token of at most LITERAL_RULES rules
    filed: dict[str, list[tuple]] = {}
    for place, rule in enumerate(rules):
        token = min(rule.tokens, key=lambda t: (often.get(t, 0), t), default="")
        filed.setdefault(token, []).append(_entry(place, rule))
    return filed


def _from_literal(words: Column, filed: dict[str, list[tuple]]) -> Column:
    names = [f.split()[0] for f in _FIELDS.split(", ")]

    def entries(rules: list[tuple]) -> Column:
        return F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in zip(names, rule)]) for rule in rules])

    found = F.array().cast(f"array<array<struct<{_FIELDS.replace(' ', ':').replace(',:', ',')}>>>")
    if any(filed):
        index = F.create_map(*[x for t, rules in filed.items() if t for x in (F.lit(t), entries(rules))])
        found = F.transform(F.filter(words, lambda w: w.isin([t for t in filed if t])), lambda w: index[w])
    return F.flatten(F.concat(found, F.array(entries(filed[""])))) if "" in filed else F.flatten(found)


def _by_join(rows: DataFrame, rules: list[Rule | Pattern]) -> DataFrame:
    """The same with the rules as a table; Spark picks each join by the rules' size.

    Distinct URLs are judged, and rows meet them by host, path and query.  Rules without a
    token, which any URL may match, are a literal.
    """
    spark = rows.sparkSession
    table = spark.createDataFrame([_entry(k, r) for k, r in enumerate(rules) if r.tokens], _FIELDS)
    needs = spark.createDataFrame([(k, t) for k, r in enumerate(rules) for t in r.tokens], "place int, token string")
    urls = rows.select("host", "path", "query", "target").distinct()
    words = urls.select("target", F.explode(_words()).alias("token"))
    often = words.join(needs.select("token").distinct(), "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("often"))
    filed = needs.join(often, "token", "left").groupBy("place").agg(F.min_by("token", F.struct(F.coalesce("often", F.lit(0)), "token")).alias("token"))
    hits = words.join(filed.join(table, "place"), "token").where(F.rlike("target", "pattern"))
    rule = F.struct(*[f.split()[0] for f in _FIELDS.split(", ")])
    best = hits.groupBy(F.col("target").alias("of")).agg(F.max(_rank(rule)).alias("fetched"))
    loose = [_entry(k, r) for k, r in enumerate(rules) if not r.tokens]
    out = rows.join(best, F.col("target") == F.col("of"), "left")
    if not loose:
        return out.withColumn("best", F.col("fetched"))
    # Structs of the two kinds agree in their fields; nulls lose.
    return out.withColumn("best", F.array_max(F.array("fetched", _best(_from_literal(F.array().cast("array<string>"), {"": loose})))))
