"""Registered queries: every operator over whole tables, with SQL for DuckDB that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import preprocess as pp
from ..functions import text as tx
from ..operators import analytics as an
from ..operators import counters as co
from ..operators import dictionary as di
from ..operators import index as ix
from ..operators import links as li
from ..operators import matching as ma
from ..operators import multi_pattern as mp
from ..operators import statistics as stt
from ..operators import structures as st
from ..sources import csv_table, files, scratch, workloads
from ..streaming import overviews
from . import benchmark, dashboard, recommender, registry

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

PATTERN, SHORT = "the", "aa"
PATTERNS = ["the", "he", "tion", "er", "en", "en", "Zz"]
SEARCH = "the reand thble tionand"


def query(sql: str | None = None) -> Callable:
    """Register a function of (spark, table reader) under its name."""

    def wrap(f: Callable) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            def read(name: str) -> DataFrame:
                return spark.read.parquet(f"{sf_dir}/{name}.parquet")

            read.folder = sf_dir
            return f(spark, read)

        QUERIES[f.__name__] = run
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return wrap


#: Parts that rows of documents are grouped in: more than the usual, so that a task holds little of large tables.
_DOCUMENT_PARTS = 192


# SQL fragments
_STOP = ", ".join(f"'{w}'" for w in tx.STOP_WORDS)
_RAW = r"regexp_extract_all(lower({0}), '[a-z0-9\x{{00C0}}-\x{{024F}}'']+')"


def _raw(c: str) -> str:
    return _RAW.format(c)


def _tok(c: str, stop: bool) -> str:
    keep = f"t <> '' AND t NOT IN ({_STOP})" if stop else "t <> ''"
    return f"list_filter(list_transform({_raw(c)}, lambda t: trim(t, '''')), lambda t: {keep})"


_TERMS = f"""docs AS (SELECT doc_id, {_tok('text', True)} AS w FROM documents),
    n AS (SELECT count(*) AS n FROM documents WHERE trim(text) <> ''),
    terms AS (SELECT doc_id, len(w) AS len, unnest(w) AS term, unnest(range(len(w)))::INT AS pos FROM docs),
    cnt AS (SELECT doc_id, term, any_value(len) AS len, count(*) AS cnt FROM terms GROUP BY doc_id, term),
    idf AS (SELECT term, count(*) AS df, ln((1 + any_value(n)) / (1 + count(*))) + 1 AS idf FROM cnt, n GROUP BY term)"""


def _positions(table: str, key: str, pattern: str) -> str:
    m = len(pattern)
    return f"SELECT {key}, (i - 1)::INT AS pos FROM (SELECT {key}, text, unnest(range(1, length(text) - {m} + 2)) AS i FROM {table} WHERE length(text) >= {m}) WHERE substr(text, i, {m}) = '{pattern}'"


# Matching


@query(f"SELECT doc_id, ((length(text) - length(replace(text, '{PATTERN}', ''))) // {len(PATTERN)})::INT AS matches FROM documents")
def match_count(spark, t):
    return t("documents").select("doc_id", ma.match_count(F.col("text"), PATTERN).cast("int").alias("matches"))


@query(_positions("documents", "doc_id", "en"))
def match_positions(spark, t):
    return ma.match_positions(t("documents"), "en", key="doc_id")


@query(f"WITH p AS ({_positions('documents', 'doc_id', 'th')}) SELECT b.doc_id, count(p.pos)::INT AS n, coalesce(min(p.pos), -1)::INT AS first, coalesce(max(p.pos), -1)::INT AS last FROM documents b LEFT JOIN p USING (doc_id) GROUP BY b.doc_id")
def match_lists(spark, t):
    m = F.col("matches")
    return ma.matches(t("documents"), "th", key="doc_id", limit=None).select(
        "doc_id", F.col("totalMatches").alias("n"), F.coalesce(F.array_min(m), F.lit(-1)).alias("first"), F.coalesce(F.array_max(m), F.lit(-1)).alias("last")
    )


@query(
    """WITH s AS (SELECT doc_id, text, unnest(range(1, length(text) - 2 + 1)) AS i FROM documents),
    c AS (SELECT doc_id, CASE WHEN substr(text, i, 1) <> 't' THEN 1 WHEN substr(text, i + 1, 1) <> 'h' THEN 2 ELSE 3 END AS c FROM s),
    k AS (SELECT doc_id, sum(c) AS comparisons, count(*) AS operations FROM c GROUP BY doc_id)
    SELECT doc_id, coalesce(comparisons, 0)::BIGINT AS comparisons, coalesce(operations, 0) AS operations FROM documents LEFT JOIN k USING (doc_id)"""
)
def naive_counters(spark, t):
    c = F.col("text")
    return t("documents").select("doc_id", ma.naive_comparisons(c, "the").alias("comparisons"), ma.naive_operations(c, "the").alias("operations"))


@query(
    """WITH s AS (SELECT doc_id, text, unnest(range(1, length(text) - 2 + 1)) AS i FROM documents),
    h AS (SELECT doc_id, substr(text, i, 3) AS w, (unicode(substr(text, i, 1)) * 65536 + unicode(substr(text, i + 1, 1)) * 256 + unicode(substr(text, i + 2, 1))) % 1000003 AS h FROM s),
    k AS (SELECT doc_id, sum(CASE WHEN h = (116 * 65536 + 104 * 256 + 101) % 1000003 THEN 1 ELSE 0 END) AS hits,
        sum(CASE WHEN h = (116 * 65536 + 104 * 256 + 101) % 1000003 AND w <> 'the' THEN 1 ELSE 0 END) AS spurious FROM h GROUP BY doc_id)
    SELECT doc_id, coalesce(hits, 0)::BIGINT AS "hashHits", coalesce(spurious, 0)::BIGINT AS "spuriousHits" FROM documents LEFT JOIN k USING (doc_id)"""
)
def rabin_karp_hits(spark, t):
    return t("documents").select("doc_id", ma.rabin_karp_counters(F.col("text"), "the").alias("c")).select("doc_id", "c.hashHits", "c.spuriousHits")


@query(
    """WITH RECURSIVE r AS (
        SELECT item_id, text, length(text) AS n, 1 AS i, 0 AS j, 2::BIGINT AS comparisons, 2::BIGINT AS operations FROM benchmark
        UNION ALL
        SELECT item_id, text, n, CASE WHEN NOT eq AND j > 0 THEN i ELSE i + 1 END, CASE WHEN eq AND j < 2 THEN j + 1 WHEN eq OR j > 0 THEN [0, 0, 0][CASE WHEN eq THEN 3 ELSE j END] ELSE 0 END,
            comparisons + 1, operations + CASE WHEN (eq AND j = 2) OR (NOT eq AND j > 0) THEN 1 ELSE 0 END
        FROM (SELECT *, substr(text, i, 1) = substr('ten', j + 1, 1) AS eq FROM r WHERE i <= n AND n >= 3))
    SELECT item_id, max(comparisons) AS comparisons, max(operations) AS operations FROM r GROUP BY item_id"""
)
def kmp_counters(spark, t):
    return t("benchmark").select("item_id", ma.kmp_counters(F.col("text"), "ten").alias("c")).select("item_id", "c.*")


def _failed_sql(prefixes: dict[str, list[str]]) -> str:
    """Failures of prefixes by what may follow each, as differences of counts; right where no prefix overlaps itself and longer ones that end with it have no other characters."""
    count = lambda x: f"(length(text) - length(replace(text, '{x}', ''))) // {len(x)}"
    return " + ".join(f"({' - '.join([count(x), f'ends_with(text, {chr(39)}{x}{chr(39)})::INT', *(count(x + c) for c in onward)])})" for x, onward in prefixes.items())


@query(
    f"""WITH f AS (SELECT doc_id, length(text) AS n, {_failed_sql({'t': ['e'], 'te': ['n']})} AS failed, (length(text) - length(replace(text, 'ten', ''))) // 3 AS found FROM documents)
    SELECT doc_id, (2 + CASE WHEN n >= 3 THEN n + failed ELSE 0 END)::BIGINT AS comparisons, (2 + CASE WHEN n >= 3 THEN failed + found ELSE 0 END)::BIGINT AS operations FROM f"""
)
def kmp_counters_documents(spark, t):
    return t("documents").select("doc_id", ma.kmp_counters(F.col("text"), "ten").alias("c")).select("doc_id", "c.*")


@query(
    """WITH RECURSIVE r AS (
        SELECT item_id, text, length(text) AS n, 0 AS s, 4::BIGINT AS comparisons, 0::BIGINT AS operations FROM benchmark
        UNION ALL
        SELECT item_id, text, n, s + CASE WHEN k = 5 THEN [5, 5, 5, 5, 5, 1][1] ELSE greatest([5, 5, 5, 5, 5, 1][6 - k], 5 - k - instr('ation', substr(text, s + 5 - k, 1))) END,
            comparisons + least(k + 1, 5), operations + 1
        FROM (SELECT *, len(list_filter([1, 2, 3, 4, 5], lambda x: right(substr(text, s + 1, 5), x) = right('ation', x)))::INT AS k FROM r WHERE s <= n - 5))
    SELECT item_id, max(comparisons) AS comparisons, max(operations) AS operations FROM r GROUP BY item_id"""
)
def boyer_moore_counters(spark, t):
    return t("benchmark").select("item_id", ma.boyer_moore_counters(F.col("text"), "ation").alias("c")).select("item_id", "c.*")


@query(
    """WITH p AS (SELECT p_partkey, p_name FROM part), i AS (SELECT p_partkey, p_name, unnest(range(1, length(p_name) + 1)) AS i FROM p),
    l AS (SELECT p_partkey, i, max(CASE WHEN k < i AND substr(p_name, 1, k) = substr(p_name, i - k + 1, k) THEN k ELSE 0 END) AS lps
        FROM (SELECT p_partkey, p_name, i, unnest(range(0, i)) AS k FROM i) GROUP BY p_partkey, i)
    SELECT p_partkey, string_agg(lps::VARCHAR, ',' ORDER BY i) AS lps FROM l GROUP BY p_partkey"""
)
def failure_tables(spark, t):
    """Failure table of every part name, in expressions."""
    p, part = F.col("p_name"), t("part")
    longest = lambda i: F.array_max(F.filter(F.sequence(F.lit(0), i - 1), lambda k: F.substring(p, F.lit(1), k) == F.substring(p, i - k + 1, k)))
    return part.select("p_partkey", F.array_join(F.transform(F.sequence(F.lit(1), F.length(p)), longest).cast("array<string>"), ",").alias("lps"))


def _many_sql(value: str) -> str:
    rows = ", ".join(f"({i}, '{p}')" for i, p in enumerate(PATTERNS))
    return f"""WITH p(pattern_id, pattern) AS (VALUES {rows}),
    hit AS (SELECT item_id, pattern_id, pattern, i - 1 AS pos FROM (SELECT item_id, text, unnest(range(1, length(text) + 1)) AS i FROM benchmark) CROSS JOIN p WHERE substr(text, i, length(pattern)) = pattern)
    {value}"""


@query(_many_sql("SELECT pattern_id::INT AS pattern_id, pattern, (SELECT count(*) FROM hit h WHERE h.pattern_id = p.pattern_id) AS matches FROM p"))
def multi_pattern_counts(spark, t):
    return mp.pattern_counts(t("benchmark"), PATTERNS)


@query(_many_sql("SELECT item_id, pattern_id::INT AS pattern_id, pattern, pos::INT AS pos FROM hit"))
def multi_pattern_positions(spark, t):
    return mp.find_many(t("benchmark"), PATTERNS, key="item_id")


@query(_many_sql("SELECT item_id, pattern_id::INT AS pattern_id, pattern, pos::INT AS pos FROM hit"))
def multi_pattern_automaton(spark, t):
    return mp.find_many(t("benchmark"), PATTERNS, key="item_id", automaton_from=1)


@query(
    f"""WITH p AS (SELECT DISTINCT pattern FROM (SELECT unnest({_tok('text', False)}) AS pattern FROM benchmark) WHERE length(pattern) >= 4),
    h AS (SELECT doc_id, pattern, text, instr(text, pattern) - 1 AS first FROM documents JOIN p ON contains(text, pattern))
    SELECT doc_id, pattern, first::INT AS first, (length(text) - length(pattern) - instr(reverse(text), reverse(pattern)) + 1)::INT AS last FROM h"""
)
def dictionary_matches(spark, t):
    """Where the words of the benchmark occur first and last in each document."""
    words = t("benchmark").select(F.explode(tx.tokens(F.col("text"))).alias("pattern")).where(F.length("pattern") >= 4).distinct()
    # Hardly two rows of a task are one group, so they are dealt before any are held, to parts that hold few.
    return di.find_dictionary(t("documents"), words).repartition(_DOCUMENT_PARTS, "doc_id").groupBy("doc_id", "pattern").agg(F.min("pos").alias("first"), F.max("pos").alias("last"))


@query("SELECT count(DISTINCT substr(p, 1, k)) + 1 AS states FROM (SELECT p, unnest(range(1, length(p) + 1)) AS k FROM (VALUES " + ", ".join(f"('{p}')" for p in PATTERNS) + ") v(p))")
def automaton_states(spark, t):
    return mp.automaton_states(spark, PATTERNS)


@query(
    _many_sql(
        """SELECT item_id, (length(text) + coalesce(h, 0))::BIGINT AS comparisons, (length(text) + 26)::BIGINT AS operations FROM benchmark LEFT JOIN (
            WITH pre AS (SELECT DISTINCT substr(pattern, 1, k::INT) AS x FROM (SELECT pattern, unnest(range(1, length(pattern) + 1)) AS k FROM p)),
            places AS (SELECT item_id, text, unnest(range(1, length(text) + 1)) AS i FROM benchmark),
            held AS (SELECT item_id, i, length(text) AS n, length(x) AS l FROM places JOIN pre ON substr(text, i, 1) = right(x, 1) AND i >= length(x) AND substr(text, (i - length(x) + 1)::INT, length(x)) = x),
            top AS (SELECT item_id, i, max(l) AS l FROM held GROUP BY ALL)
            SELECT held.item_id, count(*) AS h FROM held LEFT JOIN top ON top.item_id = held.item_id AND top.i = held.i + 1
            WHERE held.i < held.n AND held.l > greatest(coalesce(top.l, 0) - 1, 0) GROUP BY held.item_id) USING (item_id)"""
    )
)
def automaton_counters(spark, t):
    """A failure link is followed for each prefix that ends before a character and is longer than what goes on with it; making the automaton takes 26 steps."""
    return co.automaton_counters(t("benchmark"), PATTERNS, key="item_id")


_ONWARD = {"t": ["h", "i"], "th": ["e"], "the": [], "h": ["e"], "he": [], "ti": ["o"], "tio": ["n"], "tion": [], "e": ["r", "n"], "er": [], "en": [], "Z": ["z"], "Zz": []}


@query(f"SELECT doc_id, (length(text) + {_failed_sql(_ONWARD)})::BIGINT AS comparisons, (length(text) + 26)::BIGINT AS operations FROM documents")
def automaton_counters_documents(spark, t):
    return co.automaton_counters(t("documents"), PATTERNS)


# Structures

_PARTS = "words AS (SELECT unnest(string_split(p_name, ' ')) AS word FROM part)"


def _part_words(t):
    return t("part").select(F.explode(F.split("p_name", " ")).alias("word"))


@query(
    f"""WITH {_PARTS}, w AS (SELECT word FROM words WHERE word <> ''),
    p AS (SELECT DISTINCT substr(word, 1, k) AS p FROM (SELECT word, unnest(range(1, length(word) + 1)) AS k FROM w))
    SELECT (SELECT count(*) + 1 FROM p) AS "nodeCount", (SELECT count(*) FROM w) AS "wordsInserted",
        (SELECT bool_or(starts_with(word, 'b')) FROM w) AS "prefixFound", (SELECT bool_or(word = 'b') FROM w) AS "isWord" """
)
def trie_summary(spark, t):
    return st.trie_summary(_part_words(t), "b")


@query(
    f"""WITH {_PARTS}, w AS (SELECT DISTINCT word FROM words WHERE word <> ''),
    p AS (SELECT word, substr(word, 1, k) AS prefix FROM (SELECT word, unnest(range(1, length(word) + 1)) AS k FROM w))
    SELECT prefix, length(prefix)::INT AS depth, substr(prefix, 1, length(prefix) - 1) AS parent, bool_or(prefix = word) AS terminal FROM p GROUP BY prefix"""
)
def trie_nodes(spark, t):
    return st.trie_nodes(_part_words(t))


_DOCUMENT_WORDS = f"words AS (SELECT unnest({_tok('text', False)}) AS word FROM documents)"


def _document_words(t):
    return t("documents").select(F.explode(tx.tokens(F.col("text"))).alias("word"))


@query(
    f"""WITH {_DOCUMENT_WORDS}, w AS (SELECT DISTINCT word FROM words),
    p AS (SELECT word, substr(word, 1, k) AS prefix FROM (SELECT word, unnest(range(1, length(word) + 1)) AS k FROM w))
    SELECT prefix, length(prefix)::INT AS depth, substr(prefix, 1, length(prefix) - 1) AS parent, bool_or(prefix = word) AS terminal FROM p GROUP BY prefix"""
)
def trie_of_documents(spark, t):
    return st.trie_nodes(_document_words(t))


@query(
    f"""WITH {_DOCUMENT_WORDS}, w AS (SELECT DISTINCT word FROM words),
    p AS (SELECT substr(word, 1, k) AS prefix, max(word = substr(word, 1, k)) AS terminal, count(DISTINCT substr(word, k + 1, 1)) AS onward FROM (SELECT word, unnest(range(1, length(word) + 1)) AS k FROM w) GROUP BY 1),
    k AS (SELECT prefix, terminal FROM p WHERE terminal OR onward > 1),
    up AS (SELECT k.prefix, max(length(a.prefix)) AS n FROM (SELECT prefix, unnest(range(1, length(prefix))) AS n FROM k) k JOIN k a ON a.prefix = substr(k.prefix, 1, k.n::INT) GROUP BY k.prefix)
    SELECT prefix, substr(prefix, coalesce(n, 0)::INT + 1) AS label, terminal FROM k LEFT JOIN up USING (prefix)"""
)
def trie_edges(spark, t):
    """Edges of the compressed trie over all words of the documents."""
    return st.trie_edges(_document_words(t))


@query(f"WITH {_PARTS} SELECT row_number() OVER (ORDER BY word)::INT AS rank, word FROM (SELECT DISTINCT word FROM words WHERE word <> '' AND starts_with(word, 'b') ORDER BY word LIMIT 200)")
def trie_completions(spark, t):
    return st.trie_completions(_part_words(t), "b")


@query(
    f"""WITH {_PARTS}, w AS (SELECT word FROM words WHERE word <> ''), f AS (SELECT coalesce(max(k), 0) AS f FROM (SELECT unnest(range(1, 6)) AS k) WHERE EXISTS (SELECT 1 FROM w WHERE starts_with(word, substr('blunt', 1, k::INT))))
    SELECT (sum(length(word)) + least(5, any_value(f) + 1))::BIGINT AS comparisons, sum(length(word))::BIGINT AS operations FROM w, f"""
)
def trie_counters(spark, t):
    return co.trie_counters(_part_words(t), "blunt")


_SUFFIXES = """s AS (SELECT item_id, text, pos, substr(text, (pos + 1)::INT) AS s FROM (SELECT item_id, text, unnest(range(length(text))) AS pos FROM benchmark)),
    r AS (SELECT item_id, text, pos, s, row_number() OVER w - 1 AS rank, lag(s) OVER w AS p FROM s WINDOW w AS (PARTITION BY item_id ORDER BY s)),
    l AS (SELECT item_id, text, pos, rank, CASE WHEN p IS NULL THEN 0 ELSE len(list_filter(range(1, least(length(p), length(s)) + 1), lambda k: substr(p, 1, k) = substr(s, 1, k))) END AS lcp FROM r)"""


@query(f"WITH {_SUFFIXES} SELECT item_id, rank::INT AS rank, pos::INT AS pos, lcp::INT AS lcp FROM l")
def suffix_array(spark, t):
    return st.suffix_array(t("benchmark"), key="item_id")


@query(f"WITH {_SUFFIXES} SELECT item_id, rank::INT AS rank, pos::INT AS pos, lcp::INT AS lcp FROM l")
def suffix_array_doubling(spark, t):
    return st.suffix_array(t("benchmark"), key="item_id", short=0)


@query(f"WITH {_SUFFIXES} SELECT item_id, rank::INT AS rank, pos::INT AS pos, lcp::INT AS lcp FROM l")
def suffix_array_distributed(spark, t):
    """Every text by rows over all tasks, as long ones are."""
    return st.suffix_array(t("benchmark"), key="item_id", short=0, long=0)


@query(
    f"""WITH {_SUFFIXES}, b AS (SELECT item_id, any_value(text) AS text, max(lcp) AS m, sum(lcp) AS total, count(*) AS n FROM l GROUP BY item_id),
    f AS (SELECT l.item_id, min(rank) AS rank FROM l JOIN b ON l.item_id = b.item_id AND l.lcp = b.m GROUP BY l.item_id)
    SELECT b.item_id, CASE WHEN m > 0 THEN substr(b.text, (l.pos + 1)::INT, least(m, 200)::INT) ELSE '' END AS "longestRepeatedSubstring", m::INT AS "longestRepeatLength", (n * (n + 1) // 2 - total)::BIGINT AS "distinctSubstrings"
    FROM b JOIN f USING (item_id) JOIN l ON l.item_id = b.item_id AND l.rank = f.rank"""
)
def longest_repeat(spark, t):
    b = t("benchmark")
    return st.repeats(st.suffix_array(b, key="item_id"), b, key="item_id")


@query(
    f"""WITH {_SUFFIXES}, m AS (SELECT item_id, length(text) AS n, rank, pos, lcp, lag(pos) OVER (PARTITION BY item_id ORDER BY rank) AS other, lag(lcp) OVER (PARTITION BY item_id ORDER BY pos) AS before FROM l)
    SELECT item_id, sum(lcp - greatest(coalesce(before, 0) - 1, 0) + CASE WHEN greatest(pos, other) + lcp < n THEN 1 ELSE 0 END)::BIGINT AS comparisons, count(*) AS operations FROM m WHERE rank > 0 GROUP BY item_id"""
)
def lcp_counters(spark, t):
    b = t("benchmark")
    return co.lcp_counters(st.suffix_array(b, key="item_id"), b, key="item_id")


# Edit distance


def _part_pairs(t):
    p = t("part").select("p_partkey", F.col("p_name").alias("a"))
    return p.join(p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("a").alias("b")), "p_partkey")


_PAIRS = "FROM part x JOIN part y ON y.p_partkey = x.p_partkey + 1"


@query(f"SELECT x.p_partkey, levenshtein(x.p_name, y.p_name)::INT AS distance, 1 - levenshtein(x.p_name, y.p_name) / greatest(length(x.p_name), length(y.p_name), 1) AS similarity {_PAIRS}")
def edit_distance(spark, t):
    return _part_pairs(t).select("p_partkey", an.edit_distance(F.col("a"), F.col("b")).alias("distance"), an.edit_similarity(F.col("a"), F.col("b")).alias("similarity"))


@query(f"SELECT x.p_partkey, levenshtein(x.p_name, y.p_name)::INT AS edits, x.p_name AS rebuilt_a, y.p_name AS rebuilt_b {_PAIRS}")
def edit_alignment(spark, t):
    """The scripts' costs and the two texts that they spell."""
    s = F.col("s")
    # Short rows would be one task's: they are few bytes, but much work.
    rows = _part_pairs(t).repartition(48).select("p_partkey", an.alignment(F.col("a"), F.col("b")).alias("s"))
    spelled = lambda side: F.array_join(F.transform(s, lambda x: x[side]), "")
    return rows.select("p_partkey", F.size(F.filter(s, lambda x: x["op"] != "match")).alias("edits"), spelled("a").alias("rebuilt_a"), spelled("b").alias("rebuilt_b"))


# Tokens and preprocessing


@query(f"SELECT doc_id, array_to_string({_tok('text', False)}, ' ') AS tokens FROM documents")
def tokenize(spark, t):
    return t("documents").select("doc_id", F.array_join(tx.tokens(F.col("text")), " ").alias("tokens"))


@query(f"SELECT doc_id, len({_tok('text', True)})::INT AS n, array_to_string({_tok('text', True)}, ' ') AS tokens FROM documents")
def stopword_filter(spark, t):
    rows = t("documents").select("doc_id", tx.tokens(F.col("text"), remove_stop_words=True).alias("w"))
    return rows.select("doc_id", F.size("w").alias("n"), F.array_join("w", " ").alias("tokens"))


@query(r"SELECT doc_id, len(regexp_extract_all(text, '\S+'))::INT AS words, CASE WHEN text = '' THEN 0 ELSE len(string_split(text, chr(10))) END::INT AS lines FROM documents")
def word_and_line_counts(spark, t):
    return t("documents").select("doc_id", tx.word_count(F.col("text")).alias("words"), tx.line_count(F.col("text")).alias("lines"))


def _punctuation_sql() -> str:
    chars = pp.PUNCTUATION.replace("'", "''")
    return f"translate({{0}}, '{chars}', '{' ' * len(pp.PUNCTUATION)}')"


_LINES = "string_split({0}, chr(10))"
_P = {
    "normalizeUnicode": "strip_accents({0})",
    "lowercase": "lower({0})",
    "removePunctuation": _punctuation_sql(),
    "removeStopWords": f"array_to_string(list_transform({_LINES}, lambda l: array_to_string(list_filter(regexp_extract_all(l, '\\s+|\\S+'), lambda p: regexp_replace(lower(p), '[^a-z'']', '', 'g') NOT IN ({_STOP})), '')), chr(10))",
    "normalizeWhitespace": f"array_to_string(list_transform({_LINES}, lambda l: trim(regexp_replace(l, '[ \\t\\r\\f\\x0B]+', ' ', 'g'))), chr(10))",
    "removeEmptyLines": f"array_to_string(list_filter({_LINES}, lambda l: trim(l) <> ''), chr(10))",
    "removeDuplicateLines": f"array_to_string(list_filter({_LINES}, lambda l, i: trim(l) = '' OR list_position({_LINES}, l) = i), chr(10))",
    "tokenize": f"array_to_string(list_transform({_LINES}, lambda l: array_to_string(list_filter(list_transform(regexp_extract_all(l, '[A-Za-z0-9\\x{{00C0}}-\\x{{024F}}'']+'), lambda t: trim(t, '''')), lambda t: t <> ''), ' ')), chr(10))",
}


def _stage(flag: str) -> None:
    name = "preprocess_" + "".join("_" + c.lower() if c.isupper() else c for c in flag)

    def run(spark: SparkSession, t) -> DataFrame:
        return pp.preprocess(t("documents").select("doc_id", "text"), {flag: True}).select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"), F.length("text").alias("chars"))

    run.__name__ = name
    query(f"SELECT doc_id, md5({_P[flag].replace('{0}', 'text')}) AS digest, length({_P[flag].replace('{0}', 'text')})::INT AS chars FROM documents")(run)


for _flag in pp.STAGES:
    _stage(_flag)

_ALL = {k: True for k in pp.STAGES if k != "normalizeUnicode"}


def _chain_sql() -> str:
    with_, last = [], "documents"
    for k, flag in enumerate(_ALL):
        with_.append(f"s{k} AS (SELECT doc_id, {_P[flag].replace('{0}', 'text')} AS text FROM {last})")
        last = f"s{k}"
    return f"WITH {', '.join(with_)} SELECT doc_id, md5({last}.text) AS digest, length(documents.text)::INT AS before, length({last}.text)::INT AS after FROM {last} JOIN documents USING (doc_id)"


@query(_chain_sql())
def preprocess_pipeline(spark, t):
    rows = pp.preprocess(t("documents").select("doc_id", "text"), _ALL, report="r")
    return rows.select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"), F.col("r.before.chars").alias("before"), F.col("r.after.chars").alias("after"))


def _details_sql() -> str:
    with_, last = [], "documents"
    for k, flag in enumerate(_ALL):
        with_.append(f"s{k} AS (SELECT doc_id, {_P[flag].replace('{0}', 'text')} AS text FROM {last})")
        last = f"s{k}"
    words, count = (lambda t: f"len(regexp_extract_all({t}.text, '\\S+'))"), (lambda t: f"(CASE WHEN {t}.text = '' THEN 0 ELSE len(string_split({t}.text, chr(10))) END)")
    marks = f"length(s0.text) - length(translate(s0.text, '{pp.PUNCTUATION.replace(chr(39), chr(39) * 2)}', ''))"
    amounts = [
        r"len(regexp_extract_all(documents.text, '[A-Z\x{00C0}-\x{00DE}]'))", marks, f"greatest(0, {words('s1')} - {words('s2')})", "length(s2.text) - length(s3.text)",
        f"{count('s3')} - {count('s4')}", f"{count('s4')} - {count('s5')}", words("s6"),
    ]
    units = [pp.STAGES[f][3] for f in _ALL]
    listed = " || '; ' || ".join(f"format('{{:,}}', ({a})::BIGINT) || ' {u}'" for a, u in zip(amounts, units))
    return f"WITH {', '.join(with_)} SELECT doc_id, {listed} AS details FROM documents " + " ".join(f"JOIN s{k} USING (doc_id)" for k in range(len(_ALL)))


@query(_details_sql())
def preprocess_details(spark, t):
    """What each stage of the chain counted."""
    rows = pp.preprocess(t("documents").select("doc_id", "text"), _ALL, report="r")
    return rows.select("doc_id", F.array_join(F.transform("r.steps", lambda s: s["detail"]), "; ").alias("details"))


@query("SELECT doc_id, line::INT AS line, text FROM (SELECT doc_id, unnest(range(len(l))) AS line, unnest(l) AS text FROM (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l FROM documents))")
def split_documents(spark, t):
    return t("documents").select("doc_id", F.posexplode(tx.split_documents(F.col("text"))).alias("line", "text"))


# Term weights and index


@query(f"WITH {_TERMS}, b AS (SELECT term, max(cnt / len) AS tf, count(*) AS df FROM cnt GROUP BY term), w AS (SELECT term, tf * idf AS w, b.df FROM b JOIN idf USING (term) ORDER BY w DESC, term LIMIT 30) SELECT row_number() OVER (ORDER BY w DESC, term)::INT AS rank, term, floor(w * 10000 + 0.5) / 10000 AS score, df FROM w")
def tfidf_global(spark, t):
    return an.tfidf_global(t("documents"))


@query(f"WITH {_TERMS}, b AS (SELECT term, max(cnt / len) AS tf, count(*) AS df FROM cnt GROUP BY term) SELECT term, floor(tf * idf * 10000 + 0.5) / 10000 AS score, b.df FROM b JOIN idf USING (term)")
def tfidf_all_terms(spark, t):
    return an.tfidf_global(t("documents"), limit=None)


@query(f"WITH {_TERMS}, w AS (SELECT doc_id, term, cnt / len * idf AS w FROM cnt JOIN idf USING (term)), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY w DESC, term) AS rank FROM w) SELECT doc_id, rank::INT AS rank, term, floor(w * 10000 + 0.5) / 10000 AS weight FROM r WHERE rank <= 10")
def tfidf_top_terms(spark, t):
    return an.tfidf_top_terms(t("documents"))


@query(f"WITH {_TERMS} SELECT term, df, round(idf, 9) AS idf FROM idf")
def idf(spark, t):
    return an.idf(t("documents")).select("term", "df", F.round("idf", 9).alias("idf"))


@query(f"WITH {_TERMS} SELECT count(DISTINCT term) AS vocabulary, count(*) AS tokens FROM terms")
def vocabulary(spark, t):
    return an.term_frequencies(t("documents")).groupBy("term").agg(F.sum("cnt").alias("n")).agg(F.count(F.lit(1)).alias("vocabulary"), F.sum("n").alias("tokens"))


@query(f"WITH {_TERMS} SELECT term, doc_id, count(*) AS tf, array_to_string((list(pos ORDER BY pos))[1:50], ',') AS positions FROM terms GROUP BY term, doc_id")
def postings(spark, t):
    return an.inverted_index(t("documents")).select("term", "doc_id", "tf", F.array_join(F.col("positions").cast("array<string>"), ",").alias("positions"))


@query(f"WITH {_TERMS} SELECT any_value(n) AS documents, count(DISTINCT term) AS terms, count(*) AS postings FROM cnt, n")
def index_stats(spark, t):
    return an.index_stats(t("documents"))


_ASKED = ", ".join(f"'{w}'" for w in an.query_terms("reand thble"))
_WORDS = an.query_terms(SEARCH)
_PLACE = "CASE term " + " ".join(f"WHEN '{w}' THEN {k + 1}" for k, w in enumerate(_WORDS)) + " END"
_IN = ", ".join(f"'{w}'" for w in _WORDS)


@query(f"WITH {_TERMS} SELECT doc_id FROM cnt WHERE term IN ('ing', 'tion') GROUP BY doc_id HAVING count(*) = 2")
def and_query(spark, t):
    return an.and_query(t("documents"), "ing the tion")


@query(f"WITH {_TERMS}, f AS (SELECT doc_id, count(*) AS matched, sum(cnt)::BIGINT AS score, min({_PLACE}) AS first, array_to_string(list(term ORDER BY {_PLACE}), ' ') AS terms FROM cnt WHERE term IN ({_IN}) GROUP BY doc_id), l AS (SELECT * FROM f ORDER BY matched DESC, score DESC, first, doc_id LIMIT 50) SELECT row_number() OVER (ORDER BY matched DESC, score DESC, first, doc_id)::INT AS rank, doc_id, matched, score, terms FROM l")
def or_query(spark, t):
    return an.or_query(t("documents"), SEARCH).withColumn("terms", F.array_join("terms", " "))


@query(f"WITH {_TERMS} SELECT term, doc_id, count(*) AS tf, array_to_string((list(pos ORDER BY pos))[1:50], ',') AS positions FROM terms WHERE term IN ({_IN}) GROUP BY term, doc_id")
def query_postings(spark, t):
    return an.query_postings(t("documents"), SEARCH).select("term", "doc_id", "tf", F.array_join(F.col("positions").cast("array<string>"), ",").alias("positions"))


@query(f"WITH {_TERMS}, f AS (SELECT term, count(*) AS df, sum(cnt)::BIGINT AS tf FROM cnt GROUP BY term), a AS (SELECT term, min({{'d': doc_id, 'p': pos}}) AS a FROM terms GROUP BY term), l AS (SELECT term, df, tf, a FROM f JOIN a USING (term) ORDER BY df DESC, a LIMIT 20) SELECT row_number() OVER (ORDER BY df DESC, a)::INT AS rank, term, df, tf AS \"totalTf\" FROM l")
def top_terms(spark, t):
    return an.top_terms(t("documents"))


def _index(spark, t):
    """The index of all documents, written anew."""
    return ix.build_index(t("documents"), scratch.new_folder(spark, "index"))


@query(ORACLE_SQL["and_query"])
def indexed_and_query(spark, t):
    return ix.and_query(_index(spark, t), "ing the tion")


@query(ORACLE_SQL["or_query"])
def indexed_or_query(spark, t):
    return ix.or_query(_index(spark, t), SEARCH).withColumn("terms", F.array_join("terms", " "))


@query(f"WITH {_TERMS} SELECT term, doc_id, count(*) AS tf, array_to_string(list(pos ORDER BY pos), ',') AS positions FROM terms GROUP BY term, doc_id")
def indexed_postings(spark, t):
    """All postings with all their places, out of the blocks."""
    rows = _index(spark, t).blocks.select("term", "cell", F.inline(F.arrays_zip("offsets", "counts", "positions")))
    return rows.select("term", (F.col("cell") * ix.CELL + F.col("offsets")).alias("doc_id"), F.col("counts").alias("tf"), F.array_join(F.col("positions").cast("array<string>"), ",").alias("positions"))


@query(f"WITH {_TERMS} SELECT term, doc_id, count(*) AS tf, array_to_string(list(pos ORDER BY pos), ',') AS positions FROM terms WHERE term IN ({_IN}) GROUP BY term, doc_id")
def indexed_query_postings(spark, t):
    return ix.query_postings(_index(spark, t), SEARCH).select("term", "doc_id", "tf", F.array_join(F.col("positions").cast("array<string>"), ",").alias("positions"))


@query(ORACLE_SQL["top_terms"])
def indexed_top_terms(spark, t):
    return ix.top_terms(_index(spark, t))


@query(ORACLE_SQL["index_stats"])
def indexed_stats(spark, t):
    return ix.index_stats(_index(spark, t))


@query(f"WITH {_TERMS} SELECT 0::BIGINT AS comparisons, (sum(cnt) + count(*))::BIGINT AS operations, (count(*) * 48 + count(DISTINCT term) * 64)::BIGINT AS \"memoryBytes\" FROM cnt")
def tfidf_counters(spark, t):
    return co.tfidf_counters(t("documents"))


@query(
    f"""WITH {_TERMS}, q AS (SELECT term, count(*) AS df, row_number() OVER (ORDER BY count(*), {_PLACE}) AS r FROM cnt WHERE term IN ({_IN}) GROUP BY term),
    has AS (SELECT doc_id, r, row_number() OVER (PARTITION BY doc_id ORDER BY r) AS rn FROM cnt JOIN q USING (term)),
    a AS (SELECT r AS k, doc_id FROM has WHERE r = rn), b AS (SELECT r - 1 AS k, doc_id FROM has WHERE r > 1),
    e AS (SELECT k, least(x, y) AS e FROM (SELECT k, max(doc_id) AS x FROM a GROUP BY k) JOIN (SELECT k, max(doc_id) AS y FROM b GROUP BY k) USING (k)),
    m AS (SELECT count(*) AS steps FROM (SELECT k, doc_id FROM a UNION SELECT k, doc_id FROM b) JOIN e USING (k) WHERE doc_id <= e)
    SELECT ({len(_WORDS)} + any_value(steps))::BIGINT AS comparisons, (sum(cnt) + (SELECT sum(df) FROM q))::BIGINT AS operations FROM cnt, m"""
)
def index_counters(spark, t):
    return co.index_counters(t("documents"), SEARCH)


# Similarity: each document with the next

_SIM = f"""d AS (SELECT doc_id, {_tok('text', True)} AS w FROM documents),
    p AS (SELECT x.doc_id, x.w AS a, y.w AS b, list_distinct(x.w) AS da, list_distinct(y.w) AS db FROM d x JOIN d y ON y.doc_id = x.doc_id + 1),
    q AS (SELECT *, len(list_intersect(da, db)) AS k FROM p)"""
_VECTOR = """ta AS (SELECT doc_id, term, count(*) AS c FROM (SELECT doc_id, unnest(a) AS term FROM p) GROUP BY ALL),
    tb AS (SELECT doc_id, term, count(*) AS c FROM (SELECT doc_id, unnest(b) AS term FROM p) GROUP BY ALL),
    na AS (SELECT doc_id, sum(c * c) AS s FROM ta GROUP BY doc_id), nb AS (SELECT doc_id, sum(c * c) AS s FROM tb GROUP BY doc_id),
    dot AS (SELECT doc_id, sum(ta.c * tb.c) AS s FROM ta JOIN tb USING (doc_id, term) GROUP BY doc_id)"""


def _neighbours(t):
    d = t("documents").select("doc_id", "text")
    return d.join(d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("textB")), "doc_id")


def _measure(method: str, up: str, down: str) -> None:
    def run(spark: SparkSession, t) -> DataFrame:
        return an.similarity(_neighbours(t), method=method).select("doc_id", "score")

    run.__name__ = f"similarity_{method}"
    query(f"WITH {_SIM} SELECT doc_id, CASE WHEN {down} > 0 THEN floor({up} / ({down}) * 10000 + 0.5) / 10000 ELSE 0.0 END AS score FROM q")(run)


_measure("jaccard", "k", "len(da) + len(db) - k")
_measure("dice", "(2 * k)", "len(da) + len(db)")
_measure("overlap", "k", "least(len(da), len(db))")


@query(f"WITH {_SIM}, {_VECTOR} SELECT q.doc_id, CASE WHEN na.s * nb.s > 0 THEN floor(coalesce(dot.s, 0) / sqrt((na.s * nb.s)::DOUBLE) * 10000 + 0.5) / 10000 ELSE 0.0 END AS score FROM q LEFT JOIN na USING (doc_id) LEFT JOIN nb USING (doc_id) LEFT JOIN dot USING (doc_id)")
def similarity_cosine(spark, t):
    return an.similarity(_neighbours(t), method="cosine").select("doc_id", "score")


@query(f"WITH {_SIM} SELECT doc_id, k::INT AS shared, (len(da) - k)::INT AS only_a, (len(db) - k)::INT AS only_b, len(a)::INT AS \"tokensA\", len(b)::INT AS \"tokensB\" FROM q")
def shared_terms(spark, t):
    rows = an.similarity(_neighbours(t))
    return rows.select("doc_id", F.size("sharedTerms").alias("shared"), F.size("onlyInA").alias("only_a"), F.size("onlyInB").alias("only_b"), "tokensA", "tokensB")


@query(f"WITH {_SIM}, {_VECTOR} SELECT doc_id, term, ta.c * tb.c AS product FROM ta JOIN tb USING (doc_id, term)")
def contributions(spark, t):
    rows = an.similarity(_neighbours(t)).select("doc_id", F.explode_outer("contributions").alias("c"))
    return rows.where("c is not null").select("doc_id", "c.term", "c.product")


@query(f"WITH {_SIM} SELECT doc_id, len(da)::BIGINT AS comparisons, (len(a) + len(b))::BIGINT AS operations FROM q")
def similarity_counters(spark, t):
    return co.similarity_counters(_neighbours(t))


@query(
    f"""WITH RECURSIVE {_TERMS}, v AS (SELECT doc_id, sum(cnt * cnt)::HUGEINT AS s FROM cnt GROUP BY doc_id),
    dot AS (SELECT a.doc_id AS a, b.doc_id AS b, sum(a.cnt * b.cnt)::HUGEINT AS d FROM cnt a JOIN cnt b ON a.term = b.term AND a.doc_id <> b.doc_id GROUP BY ALL),
    link AS MATERIALIZED (SELECT dot.a, dot.b FROM dot JOIN v x ON x.doc_id = dot.a JOIN v y ON y.doc_id = dot.b WHERE 25 * d * d >= 16 * x.s * y.s),
    reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a)
    SELECT doc_id, (SELECT count(*) FROM link WHERE link.a = doc_id) AS n_links, (SELECT min(b) FROM reach WHERE reach.a = doc_id) AS component_id FROM documents"""
)
def similar_documents(spark, t):
    """Documents linked by a cosine of 0.8 or more, out of all pairs."""
    return li.similar_documents(t("documents"))


# Statistics


@query(
    f"""WITH k AS (SELECT text, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS d FROM documents),
    s AS (SELECT sum(length(text)) AS c, sum(len({_raw('text')})) AS w, sum(CASE WHEN text = '' THEN 0 ELSE len(string_split(text, chr(10))) END) AS l, sum(len(d)) AS d, sum(list_sum(list_transform(d, lambda x: length(x)))) AS dl, sum(octet_length(encode(text))) AS b FROM k)
    SELECT c::BIGINT AS characters, w::BIGINT AS words, l::BIGINT AS lines, d::BIGINT AS documents, floor(dl / d * 10 + 0.5) / 10 AS "avgDocumentLength",
        (SELECT count(DISTINCT w) FROM (SELECT unnest({_raw('text')}) AS w FROM documents)) AS "vocabularySize", b::BIGINT AS bytes FROM s"""
)
def dataset_stats(spark, t):
    return stt.dataset_stats(t("documents"))


_FREQ = f"f AS (SELECT word, count(*) AS count FROM (SELECT unnest({_raw('text')}) AS word FROM documents) GROUP BY word)"


@query(f"WITH {_FREQ}, l AS (SELECT * FROM f ORDER BY count DESC, word LIMIT 25) SELECT row_number() OVER (ORDER BY count DESC, word)::INT AS rank, word, count FROM l")
def top_words(spark, t):
    return stt.top_words(t("documents"))


@query(f"WITH {_FREQ}, l AS (SELECT * FROM f WHERE word NOT IN ({_STOP}) ORDER BY count DESC, word LIMIT 25) SELECT row_number() OVER (ORDER BY count DESC, word)::INT AS rank, word, count FROM l")
def top_content_words(spark, t):
    return stt.top_words(t("documents"), content_only=True)


@query("SELECT CASE c WHEN ' ' THEN '␣' WHEN chr(10) THEN '↵' WHEN chr(9) THEN '⇥' ELSE c END AS char, count(*) AS count FROM (SELECT unnest(string_split(text, '')) AS c FROM documents) WHERE c <> '' GROUP BY c")
def char_frequency(spark, t):
    return stt.character_frequencies(t("documents"))


@query(f"WITH {_FREQ} SELECT floor(count(*) / sum(count) * 1000 + 0.5) / 1000 AS ratio FROM f")
def type_token_ratio(spark, t):
    return stt.type_token_ratio(t("documents"))


@query("SELECT 'url' AS \"column\", avg(length(coalesce(url, ''))) AS average FROM pages UNION ALL SELECT 'html', avg(length(coalesce(html, ''))) FROM pages UNION ALL SELECT 'page_id', avg(length(coalesce(page_id::VARCHAR, ''))) FROM pages")
def average_column_lengths(spark, t):
    return files.average_lengths(t("pages").select("page_id", "url", "html"))


@query("SELECT doc_id, substr(text, 101, 100) AS preview, length(text)::INT AS total, length(text) > 200 AS \"hasMore\" FROM documents")
def preview(spark, t):
    return files.preview(t("documents"), 100, 100).select("doc_id", "preview", "total", "hasMore")


@query()
def csv_round_trip(spark, t):
    """The documents written as CSV to a new folder and read again by blocks; it writes files, so it has no SQL."""
    path = scratch.new_folder(spark, "csv")
    files.export_csv([t("documents").select("doc_id", "source", "text")], path)
    back = csv_table.csv_table(spark, path)
    return back.select(F.col("doc_id").cast("long").alias("doc_id"), "source", F.md5(F.col("text").cast("binary")).alias("digest"))


# Measurements: events stand in for runs, their types for algorithms


@query("SELECT event_type, round(median(value), 6) AS median, round(avg(value), 6) AS mean, min(value) AS min, max(value) AS max, round(stddev_pop(value), 6) AS stdev FROM events GROUP BY event_type")
def run_statistics(spark, t):
    out = stt.run_statistics(t("events"), "value", "event_type")
    return out.select("event_type", *[F.round(c, 6).alias(c) if c in ("median", "mean", "stdev") else F.col(c) for c in ("median", "mean", "min", "max", "stdev")])


@query(
    """WITH p AS (SELECT l_returnflag AS g, l_quantity AS n, l_linenumber AS m, l_extendedprice AS t, ['nm', 'n/m', 'n+m', 'nlogn', 'nlog2n', 'mn', 'L'][l_linenumber % 7 + 1] AS model FROM lineitem),
    f AS (SELECT *, CASE WHEN model IN ('nm', 'mn') THEN n * greatest(m, 1) WHEN model = 'n/m' THEN n / greatest(m, 1) WHEN model = 'n+m' THEN n + m WHEN model = 'nlogn' THEN n * log2(greatest(n, 2)) WHEN model = 'nlog2n' THEN n * log2(greatest(n, 2)) * log2(greatest(n, 2)) ELSE n END AS f FROM p)
    SELECT g, round(sum(f * t) / sum(f * f), 6) AS constant, round(regr_slope(CASE WHEN t > 0 AND n > 0 THEN ln(t) END, CASE WHEN t > 0 AND n > 0 THEN ln(n) END), 6) AS exponent FROM f GROUP BY g"""
)
def scaling_fit(spark, t):
    model = F.get(F.array(*[F.lit(x) for x in ("nm", "n/m", "n+m", "nlogn", "nlog2n", "mn", "L")]), F.col("l_linenumber") % 7)
    points = t("lineitem").select(F.col("l_returnflag").alias("g"), F.col("l_quantity").alias("n"), F.col("l_linenumber").alias("m"), F.col("l_extendedprice").alias("t"), model.alias("model"))
    return stt.scaling_fit(points, "g").select("g", F.round("constant", 6).alias("constant"), F.round("exponent", 6).alias("exponent"))


@query("SELECT user_id, event_type, count(value) AS runs, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS stdev, min(value) AS min, max(value) AS max, round(CASE WHEN avg(value) <> 0 THEN stddev_pop(value) / avg(value) ELSE 0 END, 6) AS cv FROM events WHERE value IS NOT NULL GROUP BY user_id, event_type HAVING count(value) > 1")
def reproducibility_cv(spark, t):
    out = stt.reproducibility(t("events"), "value", "user_id", "event_type")
    return out.select("user_id", "event_type", "runs", *[F.round(c, 6).alias(c) if c in ("mean", "stdev", "cv") else F.col(c) for c in ("mean", "stdev", "min", "max", "cv")])


# All values of the columns that the pivots spread.
_PRIORITIES = {"1-URGENT": "urgent", "2-HIGH": "high", "3-MEDIUM": "medium", "4-NOT SPECIFIED": "unspecified", "5-LOW": "low"}
_SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


@query("SELECT o_orderstatus AS row, " + ", ".join(f"sum(CASE WHEN o_orderpriority = '{p}' THEN 1 END)::BIGINT AS {n}" for p, n in _PRIORITIES.items()) + " FROM orders GROUP BY 1")
def stress_pivot(spark, t):
    out = stt.matrix(t("orders"), "o_orderstatus", "o_orderpriority", "o_orderkey", list(_PRIORITIES), "count")
    return out.select(F.col("o_orderstatus").alias("row"), *[F.col(p).alias(n) for p, n in _PRIORITIES.items()])


@query(
    f"""WITH l AS (SELECT o_custkey, o_orderpriority, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS p FROM orders)
    SELECT o_orderpriority AS label, {', '.join(f"max(CASE WHEN c_mktsegment = '{s}' THEN o_totalprice END) AS {s.lower()}" for s in _SEGMENTS)} FROM l JOIN customer ON o_custkey = c_custkey WHERE p = 1 GROUP BY 1"""
)
def experiment_compare_pivot(spark, t):
    """The latest run of each experiment, pivoted: orders of customers by segment."""
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")))
    latest = t("orders").withColumn("p", place).where("p = 1").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    out = stt.matrix(latest, "o_orderpriority", "c_mktsegment", "o_totalprice", list(_SEGMENTS), "max")
    return out.select(F.col("o_orderpriority").alias("label"), *[F.col(s).alias(s.lower()) for s in _SEGMENTS])


# Relational patterns of the store: customers stand in for datasets and experiments, orders for versions and runs


@query("WITH c AS (SELECT o_custkey, max(o_orderkey) AS current FROM orders GROUP BY o_custkey) SELECT c_custkey AS id, c_name AS name, o.o_orderkey AS version, o.o_totalprice AS stats FROM customer LEFT JOIN c ON c_custkey = c.o_custkey LEFT JOIN orders o ON o.o_custkey = c_custkey AND o.o_orderkey = c.current")
def latest_version_join(spark, t):
    current = t("orders").groupBy("o_custkey").agg(F.max_by(F.struct("o_orderkey", "o_totalprice"), "o_orderkey").alias("v"))
    out = t("customer").join(current, F.col("c_custkey") == F.col("o_custkey"), "left")
    return out.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("v.o_orderkey").alias("version"), F.col("v.o_totalprice").alias("stats"))


@query("SELECT o_custkey AS dataset_id, max(o_orderkey) + 1 AS next FROM orders GROUP BY 1")
def next_version(spark, t):
    return t("orders").groupBy(F.col("o_custkey").alias("dataset_id")).agg((F.coalesce(F.max("o_orderkey"), F.lit(0)) + 1).alias("next"))


@query("SELECT o_custkey AS version_of, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC)::INT AS place, o_orderkey AS version, o_orderstatus AS note FROM orders")
def dataset_versions(spark, t):
    """The versions of every dataset, the latest first."""
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_orderkey")))
    return t("orders").select(F.col("o_custkey").alias("version_of"), place.alias("place"), F.col("o_orderkey").alias("version"), F.col("o_orderstatus").alias("note"))


@query("SELECT c_custkey AS id, coalesce(n, 0) AS runs, last FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, max(o_orderdate) AS last FROM orders GROUP BY 1) ON c_custkey = o_custkey")
def runs_per_experiment(spark, t):
    runs = t("orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.max("o_orderdate").alias("last"))
    return t("customer").join(runs, F.col("c_custkey") == F.col("o_custkey"), "left").select(F.col("c_custkey").alias("id"), F.coalesce("n", F.lit(0)).alias("runs"), "last")


@query("SELECT o_orderkey AS run_id, c_name AS experiment, o_orderdate AS \"at\" FROM orders JOIN customer ON o_custkey = c_custkey ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 500")
def recent_runs(spark, t):
    rows = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    return rows.orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(500).select(F.col("o_orderkey").alias("run_id"), F.col("c_name").alias("experiment"), F.col("o_orderdate").alias("at"))


@query("SELECT o_orderpriority AS challenge_id, count(*) AS attempts, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END)::BIGINT AS solved FROM orders GROUP BY 1")
def solved_counts(spark, t):
    return t("orders").groupBy(F.col("o_orderpriority").alias("challenge_id")).agg(F.count(F.lit(1)).alias("attempts"), F.sum(F.when(F.col("o_orderstatus") == "F", 1).otherwise(0)).alias("solved"))


@query("SELECT o_orderkey AS id, o_orderdate AS created_at FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 25 OFFSET 50")
def experiment_page(spark, t):
    return t("orders").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).offset(50).limit(25).select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("created_at"))


@query(
    """WITH a AS (SELECT 'order' AS kind, o_orderkey AS id, o_orderdate AS "at" FROM orders), e AS (SELECT 'event' AS kind, event_id AS id, ts AS "at" FROM events)
    SELECT * FROM (SELECT * FROM (SELECT * FROM a ORDER BY "at" DESC, id DESC LIMIT 6) UNION ALL SELECT * FROM (SELECT * FROM e ORDER BY "at" DESC, id DESC LIMIT 20)) ORDER BY "at" DESC, kind, id DESC LIMIT 12"""
)
def activity_feed(spark, t):
    orders = t("orders").select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("at")).orderBy(F.desc("at"), F.desc("id")).limit(6)
    events = t("events").select(F.lit("event").alias("kind"), F.col("event_id").alias("id"), F.col("ts").alias("at")).orderBy(F.desc("at"), F.desc("id")).limit(20)
    return orders.unionByName(events).orderBy(F.desc("at"), "kind", F.desc("id")).limit(12)


@query('SELECT l_returnflag AS "algorithmId", count(*) AS runs, round(sum(l_quantity) / sum(l_extendedprice) * 1000, 6) AS "avgThroughput", round(avg(l_extendedprice), 4) AS "avgMedianMs" FROM lineitem GROUP BY 1')
def algorithm_throughput(spark, t):
    """Every order is a benchmark whose JSON summary has an entry for each of its lines."""
    entry = F.struct(F.col("l_returnflag").alias("algorithmId"), F.lit("ok").alias("status"), F.col("l_quantity").cast("double").alias("inputSize"), F.col("l_extendedprice").cast("double").alias("medianMs"))
    benchmarks = t("lineitem").groupBy("l_orderkey").agg(F.to_json(F.collect_list(entry)).alias("summary")).withColumn("kind", F.lit("compare"))
    out = dashboard.throughput(benchmarks)
    return out.select("algorithmId", "runs", F.round("avgThroughput", 6).alias("avgThroughput"), F.round("avgMedianMs", 4).alias("avgMedianMs"))


def _experiments(t):
    c = t("customer")
    return c.select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("mode"), F.date_add(F.lit("2020-01-01").cast("date"), F.col("c_custkey").cast("int")).alias("created_at"),
        F.when(F.col("c_nationkey") > 3, F.col("c_nationkey")).alias("dataset_id"), (F.col("c_custkey") % 3).alias("dataset_version"),
    )


_EXPERIMENTS = "e AS (SELECT c_custkey AS id, c_name AS name, c_mktsegment AS mode, DATE '2020-01-01' + c_custkey::INT AS created_at, CASE WHEN c_nationkey > 3 THEN c_nationkey END AS dataset_id, c_custkey % 3 AS dataset_version FROM customer)"


@query("SELECT 12 AS algorithms, 4 AS categories, (SELECT count(*) FROM nation) AS datasets, (SELECT count(*) FROM customer) AS experiments, (SELECT count(*) FROM orders) AS benchmarks, 12 AS visualizable")
def totals(spark, t):
    return dashboard.totals(t("nation"), t("customer"), t("orders"))


@query(
    f"""WITH {_EXPERIMENTS}, r AS (SELECT o_orderkey AS run_id, o_custkey AS experiment_id, name, mode, o_orderdate AS created_at FROM orders JOIN e ON o_custkey = id ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 500),
    k AS (SELECT id AS experiment_id, dataset_id, dataset_version FROM e ORDER BY created_at DESC, id DESC LIMIT 200)
    SELECT run_id, experiment_id, name, mode, dataset_id, dataset_version, created_at FROM r LEFT JOIN k USING (experiment_id)"""
)
def research_feed(spark, t):
    runs = t("orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("experiment_id"), F.col("o_orderdate").alias("created_at"))
    return dashboard.research_feed(runs, _experiments(t))


#: Parts that entries meet their runs in: more than the usual, so that a task sorts little of large tables.
_ENTRY_PARTS = 192


def _entries(t):
    lines, orders = t("lineitem").repartition(_ENTRY_PARTS, "l_orderkey"), t("orders").repartition(_ENTRY_PARTS, "o_orderkey")
    rows = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.select(
        F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("experiment_id"), F.col("o_orderdate").alias("created_at"), F.concat(F.lit("a"), F.col("l_linenumber").cast("string")).alias("algorithmId"),
        F.lit(None).cast("string").alias("label"), F.col("l_extendedprice").alias("runtimeMs"), F.col("l_quantity").alias("comparisons"),
    )


@query(
    f"""WITH {_EXPERIMENTS} SELECT coalesce(n_name, '#' || dataset_id || ' (deleted)') AS dataset, dataset_version AS version, name AS experiment, 'a' || l_linenumber AS "algorithmId", l_extendedprice AS "runtimeMs", l_quantity AS comparisons, o_orderdate AS created_at
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN e ON o_custkey = id LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 20) ON n_nationkey = dataset_id WHERE dataset_id IS NOT NULL"""
)
def runs_by_dataset(spark, t):
    datasets = t("nation").where("n_nationkey < 20").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    return dashboard.runs_by_dataset(_entries(t), _experiments(t), datasets)


@query("SELECT l_orderkey AS run_id, " + ", ".join(f"max(CASE WHEN l_linenumber = {k} THEN l_extendedprice END) AS a{k}" for k in range(1, 8)) + ' FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1')
def run_matrix(spark, t):
    return dashboard.run_matrix(_entries(t), [f"a{k}" for k in range(1, 8)], "max")


@query(
    """WITH p AS (SELECT l_returnflag AS g, l_orderkey AS k, l_linenumber AS l, l_quantity AS n, l_linenumber AS m, l_extendedprice AS t, ['nm', 'n/m', 'n+m', 'nlogn', 'nlog2n', 'mn', 'L'][l_linenumber % 7 + 1] AS model FROM lineitem),
    f AS (SELECT *, CASE WHEN model IN ('nm', 'mn') THEN n * greatest(m, 1) WHEN model = 'n/m' THEN n / greatest(m, 1) WHEN model = 'n+m' THEN n + m WHEN model = 'nlogn' THEN n * log2(greatest(n, 2)) WHEN model = 'nlog2n' THEN n * log2(greatest(n, 2)) * log2(greatest(n, 2)) ELSE n END AS f FROM p),
    c AS (SELECT g, sum(f * t) / sum(f * f) AS c FROM f GROUP BY g)
    SELECT k, l, t, round(c * f, 3) AS theoretical FROM f JOIN c USING (g)"""
)
def scaling_series(spark, t):
    model = F.get(F.array(*[F.lit(x) for x in ("nm", "n/m", "n+m", "nlogn", "nlog2n", "mn", "L")]), F.col("l_linenumber") % 7)
    points = t("lineitem").select(
        F.col("l_returnflag").alias("g"), F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("l"), F.col("l_quantity").alias("n"), F.col("l_linenumber").alias("m"), F.col("l_extendedprice").alias("t"), model.alias("model")
    )
    return benchmark.scaling_series(points, "g").select("k", "l", "t", F.round("theoretical", 3).alias("theoretical"))


@query()
def streamed_overview(spark, t):
    """Overview of all events by type, kept by a stream in a new folder; it writes files, so it has no SQL."""
    # As a pattern, since a stream reads folders or patterns, and the table may be one file.
    source = spark.readStream.schema(t("events").schema).parquet(f"{t.folder}/events.parque[t]")
    one = F.lit(1)
    overview = overviews.Overview(
        ["event_type"],
        {"runs": (one, "sum"), "measured": (F.when(F.col("value").isNotNull(), one).otherwise(0), "sum"), "total": (F.col("value"), "sum"), "least": (F.col("value"), "min"), "most": (F.col("value"), "max"), "latest": (F.struct("ts", "event_id"), "max")},
    )
    folder = scratch.new_folder(spark, "overview")
    overviews.keep(source, overview, folder).awaitTermination()
    return overviews.kept(spark, overview, folder).select("event_type", "runs", "measured", "total", "least", "most", F.col("latest.event_id").alias("latest_id"))


@query(
    "SELECT category, count(*) AS count, string_agg(id, ',' ORDER BY id) AS algorithms FROM (VALUES "
    + ", ".join(f"('{k}', '{v[1]}')" for k, v in registry.META.items())
    + ") m(id, category) GROUP BY category"
)
def category_rollup(spark, t):
    return registry.categories(spark).select("category", "count", F.array_join("algorithms", ",").alias("algorithms"))


@query("SELECT event_type AS algorithm, extract('hour' FROM ts)::INT AS size, value AS runtime FROM events WHERE value IS NOT NULL")
def performance_trend(spark, t):
    return t("events").where(F.col("value").isNotNull()).select(F.col("event_type").alias("algorithm"), F.hour("ts").alias("size"), F.col("value").alias("runtime"))


@query("SELECT c_custkey AS experiment_id, c_name AS experiment, c_mktsegment AS mode, o_orderkey AS run_id, l_linenumber AS entry, l_extendedprice AS runtime FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey")
def report_flattening(spark, t):
    rows = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    return rows.select(F.col("c_custkey").alias("experiment_id"), F.col("c_name").alias("experiment"), F.col("c_mktsegment").alias("mode"), F.col("o_orderkey").alias("run_id"), F.col("l_linenumber").alias("entry"), F.col("l_extendedprice").alias("runtime"))


# Helpers of display and exercises


@query(r"""SELECT p_partkey, array_to_string(list_filter(string_split_regex(regexp_replace(lower(trim('[' || p_name || '; ' || p_brand || ' )  ')), '[\[\]{}()]', '', 'g'), '[\s,;]+'), lambda x: x <> ''), ',') AS answer FROM part""")
def answer_normalisation(spark, t):
    given = F.concat(F.lit("["), F.col("p_name"), F.lit("; "), F.col("p_brand"), F.lit(" )  "))
    return t("part").select("p_partkey", tx.normalize_answer(given).alias("answer"))


@query("SELECT doc_id, CASE WHEN length(text) > 40 THEN substr(text, 1, 40) || '…' ELSE text END AS shown, CASE WHEN doc_id % 5 > 0 THEN list_sum(range(doc_id, doc_id + doc_id % 5))::BIGINT ELSE 0 END AS summed, floor(length(text) / 7 * 10000 + 0.5) / 10000 AS rounded FROM documents")
def display_helpers(spark, t):
    numbers = tx.span(F.col("doc_id").cast("int"), (F.col("doc_id") % 5).cast("int"))
    summed = F.aggregate(numbers, F.lit(0).cast("long"), lambda s, x: s + x)
    return t("documents").select("doc_id", tx.shortened(F.col("text"), 40).alias("shown"), summed.alias("summed"), tx.round4(F.length("text") / 7).alias("rounded"))


def _preview_sql() -> str:
    after = _P["removePunctuation"].replace("{0}", _P["lowercase"].replace("{0}", "text"))
    side = lambda name, c: f"length({c})::INT AS {name}_chars, CASE WHEN {c} = '' THEN 0 ELSE len(string_split({c}, chr(10))) END::INT AS {name}_lines, len(regexp_extract_all({c}, '\\S+'))::INT AS {name}_words, len(list_distinct({_raw(c)}))::INT AS {name}_vocabulary, md5(substr({c}, 1, 3000)) AS {name}_preview"
    return f"SELECT doc_id, {side('before', 'text')}, {side('after', 'made')}, length(text) > 3000 AS truncated FROM (SELECT doc_id, text, {after} AS made FROM documents)"


@query(_preview_sql())
def preprocess_preview(spark, t):
    out = files.preprocess_preview(t("documents"), {"lowercase": True, "removePunctuation": True}, key="doc_id", refuse=False)
    side = lambda n: [F.md5(F.col(f"{n}.preview").cast("binary")).alias(f"{n}_preview"), *[F.col(f"{n}.{c}").alias(f"{n}_{c}") for c in ("chars", "lines", "words", "vocabulary")]]
    return out.select("doc_id", *side("before"), *side("after"), "truncated")


# Workloads

_DRAW = """a AS (SELECT i, ((42 + (i + 1) * 1831565813::HUGEINT) % 4294967296)::HUGEINT AS a FROM range(50000) r(i)),
    b AS (SELECT i, a, (xor(a::BIGINT, a::BIGINT >> 15)::HUGEINT * (a::BIGINT | 1)::HUGEINT % 4294967296)::BIGINT AS t FROM a),
    c AS (SELECT i, xor(t, ((t + (xor(t, t >> 7)::HUGEINT * (t | 61)::HUGEINT % 4294967296)) % 4294967296)::BIGINT) AS t FROM b)"""


@query(f"WITH {_DRAW} SELECT i, chr((97 + floor(xor(t, t >> 14) / 4294967296.0 * 26))::INT) AS c FROM c")
def workload_random(spark, t):
    return workloads.random_characters(spark, 50_000)


def _u(index: str) -> str:
    """The generator's draw at an index, as an expression; each step is bound by a list of one."""
    first = f"[((42 + ({index} + 1) * 1831565813::HUGEINT) % 4294967296)::BIGINT]"
    second = f"list_transform({first}, lambda a: (xor(a, a >> 15)::HUGEINT * (a | 1)::HUGEINT % 4294967296)::BIGINT)"
    third = f"list_transform({second}, lambda t: xor(t, ((t + (xor(t, t >> 7)::HUGEINT * (t | 61)::HUGEINT % 4294967296)) % 4294967296)::BIGINT))"
    return f"list_transform({third}, lambda t: xor(t, t >> 14) / 4294967296.0)[1]"


def _below(index: str, n: str) -> str:
    return f"floor({_u(index)} * {n})::INT"


def _cut(index: str) -> str:
    """A stretch of the text of 7 to 9 characters, by two draws."""
    size = f"greatest(1, least(2000, 8 + {_below(index, '3')} - 1))"
    return f"substr(text, {_below(f'({index} + 1)', f'greatest(1, 2000 - {size})')} + 1, {size})"


_WORKLOADS = f"""WITH RECURSIVE spelled AS (
        SELECT 0 AS k, 0 AS p, '' AS word
        UNION ALL
        SELECT k + 1, p + 1 + n, array_to_string(list_transform(range(n), lambda j: CASE WHEN j % 2 = 1 THEN 'aeiou'[({_below('(p + 1 + j)', '5')} + 1)] ELSE chr(97 + {_below('(p + 1 + j)', '26')}) END), '')
        FROM (SELECT k, p, 2 + {_below('p', '7')} AS n FROM spelled WHERE k < 2000)),
    v AS (SELECT list(word ORDER BY k) FILTER (k > 0) AS words, max(p) AS p FROM spelled),
    dense AS (SELECT list_transform(range(10), lambda i: words[{_below('(p + 2 * i)', '50')} + 1] || substr(words[{_below('(p + 2 * i + 1)', '2000')} + 1], 1, 6)) AS patterns FROM v),
    drawn AS (
        SELECT kind, 0 AS k, CASE kind WHEN 'dense' THEN p + 20 ELSE p END AS p, 0 AS length, '' AS word FROM v, (VALUES ('prose'), ('dense')) x(kind)
        UNION ALL
        SELECT kind, k + 1, p + CASE kind WHEN 'prose' THEN 1 ELSE 2 END, length + length(word) + 1, word FROM (
            SELECT kind, k, d.p, length, CASE WHEN kind = 'prose' THEN words[floor({_u('d.p')} * {_u('d.p')} * 2000)::INT + 1]
                WHEN {_u('d.p')} < 0.5 THEN patterns[{_below('(d.p + 1)', '10')} + 1] ELSE words[{_below('(d.p + 1)', '2000')} + 1] END AS word
            FROM drawn d, v, dense WHERE length < 2000)),
    periodic AS (
        SELECT 0 AS i, 0 AS p, '' AS c
        UNION ALL
        SELECT i + 1, CASE WHEN u < 0.02 THEN p + 2 ELSE p + 1 END, CASE WHEN u < 0.02 THEN 'abc'[({_below('(p + 1)', '3')} + 1)] ELSE 'abcab'[(i % 5 + 1)] END
        FROM (SELECT i, p, {_u('p')} AS u FROM periodic WHERE i < 2000)),
    made AS (
        SELECT kind, substr(string_agg(word, ' ' ORDER BY k) FILTER (k > 0), 1, 2000) AS text, max(p) AS p FROM drawn GROUP BY kind
        UNION ALL SELECT 'repetitive', string_agg(c, '' ORDER BY i), max(p) FROM periodic
        UNION ALL SELECT 'random', string_agg(chr(97 + {_below('i', '26')}), '' ORDER BY i), 2000 FROM range(2000) r(i)
        UNION ALL SELECT 'same', repeat('a', 2000), 0),
    typed(type, kind) AS (VALUES ('random', 'random'), ('repetitive', 'repetitive'), ('worst-case', 'same'), ('best-case', 'prose'), ('adversarial', 'same'), ('pattern-heavy', 'dense'), ('small', 'prose'), ('medium', 'prose'), ('large', 'prose')),
    given AS (SELECT type, text, p,
        CASE type WHEN 'worst-case' THEN 'aaaaaaab' WHEN 'adversarial' THEN 'aaaaaaaa' WHEN 'best-case' THEN 'ZZZZZZZZ' END AS pattern,
        CASE type WHEN 'worst-case' THEN list_transform(range(10), lambda i: repeat('a', greatest(1, 7 - i % 7)::INT) || 'b') WHEN 'adversarial' THEN list_transform(range(10), lambda i: repeat('a', (1 + i % 8)::INT))
            WHEN 'best-case' THEN list_transform(range(10), lambda i: repeat(chr((65 + i % 26)::INT), 8)) WHEN 'pattern-heavy' THEN patterns END AS patterns
        FROM typed JOIN made USING (kind), dense),
    first AS (SELECT type, text, coalesce(pattern, rpad(substr({_cut('p')}, 1, 8), 8, 'a')) AS pattern, patterns, CASE WHEN pattern IS NULL THEN p + 2 ELSE p END AS p FROM given),
    cut AS (SELECT type, text, pattern, coalesce(patterns, list_transform(range(10), lambda i: {_cut('(p + 2 * i)')})) AS patterns, CASE WHEN patterns IS NULL THEN p + 20 ELSE p END AS p FROM first),
    mutated AS (
        SELECT type, 0 AS i, p, '' AS c FROM cut
        UNION ALL
        SELECT type, i + 1, CASE WHEN u < 0.1 THEN p + 2 ELSE p + 1 END, CASE WHEN u < 0.1 THEN chr(97 + {_below('(p + 1)', '26')}) ELSE substr(text, i + 1, 1) END
        FROM (SELECT m.type, m.i, m.p, text, {_u('m.p')} AS u FROM mutated m JOIN cut USING (type) WHERE m.i < 2000)),
    other AS (SELECT type, string_agg(c, '' ORDER BY i) AS b FROM mutated GROUP BY type),
    w AS (SELECT *, CASE WHEN len(regexp_extract_all(text, '[A-Za-z]+')) > 0 THEN regexp_extract_all(text, '[A-Za-z]+') ELSE [substr(text, 1, 20)] END AS words FROM cut)
    SELECT type, md5(text) AS text, pattern, array_to_string(patterns, ',') AS patterns, words[1] || ' ' || words[len(words) // 2 + 1] || ' ' || words[len(words)] AS query, ((len(words) + 59) // 60)::INT AS documents, levenshtein(text, b)::INT AS mutations
    FROM w JOIN other USING (type)"""


@query(_WORKLOADS)
def workload_types(spark, t):
    """One row per workload type at 2,000 characters: digests of all its parts."""
    rows = []
    for name in workloads.TYPES:
        w = workloads.generate(name, 2000)
        rows.append((name, w.text, w.pattern, ",".join(w.patterns), w.query, len(w.documents), w.text_b))
    frame = spark.createDataFrame(rows, "type string, text string, pattern string, patterns string, query string, documents int, textB string")
    return frame.select("type", F.md5(F.col("text").cast("binary")).alias("text"), "pattern", "patterns", "query", "documents", F.levenshtein("text", "textB").alias("mutations"))


# Advice: pairs of customers' attributes stand in for profiles

_PROFILE = f"""p AS (SELECT c_custkey AS profile_id, {list(recommender.TASKS)!r}[c_custkey % 9 + 1] AS task, (c_custkey * 997 % 1000000)::DOUBLE AS ts, (c_custkey % 13)::DOUBLE AS ps,
    (c_custkey % 4 * 5 + 1)::DOUBLE AS pc, (c_custkey % 3)::DOUBLE AS dc, ['low', 'medium', 'high'][c_custkey % 3 + 1] AS rep, ['small', 'large'][c_custkey // 3 % 2 + 1] AS alp,
    ['once', 'frequent'][c_custkey // 6 % 2 + 1] AS freq, c_custkey // 12 % 2 = 1 AS idx, c_custkey // 24 % 2 = 1 AS str FROM customer),
    q AS (SELECT *, task = 'single-pattern' AS sp, task = 'multi-pattern' OR (task = 'single-pattern' AND pc > 1) AS mp FROM p)"""
_RULES = {
    "naive": ("sp", "CASE WHEN sp THEN 40 + CASE WHEN ps <= 3 THEN 20 ELSE 0 END + CASE WHEN ts < 10000 THEN 10 ELSE 0 END ELSE 0 END - CASE WHEN rep = 'high' THEN 30 ELSE 0 END"),
    "kmp": ("sp", "CASE WHEN sp THEN 60 + CASE WHEN rep <> 'low' THEN 20 ELSE 0 END + CASE WHEN alp = 'small' THEN 10 ELSE 0 END ELSE 0 END + CASE WHEN str THEN 15 ELSE 0 END"),
    "boyer-moore": ("sp", "CASE WHEN sp THEN 55 + CASE WHEN alp = 'large' THEN 15 ELSE 0 END + CASE WHEN ps >= 8 THEN 15 ELSE 0 END ELSE 0 END - CASE WHEN alp = 'small' THEN 15 ELSE 0 END - CASE WHEN rep = 'high' THEN 15 ELSE 0 END"),
    "rabin-karp": ("sp OR mp", "CASE WHEN task = 'document-similarity' THEN 35 WHEN sp THEN 45 WHEN mp THEN 30 ELSE 0 END - CASE WHEN rep = 'high' THEN 10 ELSE 0 END"),
    "aho-corasick": ("mp", "CASE WHEN mp THEN 85 + CASE WHEN pc >= 10 THEN 10 ELSE 0 END ELSE 0 END"),
    "trie": ("task = 'prefix-lookup' OR (mp AND freq = 'frequent')", "CASE WHEN task = 'prefix-lookup' THEN 90 WHEN mp AND freq = 'frequent' THEN 45 ELSE 0 END"),
    "suffix-array": ("task = 'substring-queries' OR (sp AND freq = 'frequent' AND idx)", "CASE WHEN task = 'substring-queries' THEN 85 WHEN sp AND freq = 'frequent' AND idx THEN 70 ELSE 0 END"),
    "kasai": ("task IN ('repeat-analysis', 'substring-queries')", "CASE task WHEN 'repeat-analysis' THEN 90 WHEN 'substring-queries' THEN 50 ELSE 0 END"),
    "edit-distance": ("task = 'fuzzy-match'", "CASE WHEN task = 'fuzzy-match' THEN CASE WHEN ts <= 5000 THEN 90 ELSE 55 END ELSE 0 END"),
    "tfidf": ("task IN ('keyword-ranking', 'document-search')", "CASE task WHEN 'keyword-ranking' THEN 90 WHEN 'document-search' THEN 55 ELSE 0 END"),
    "inverted-index": ("task = 'document-search' OR (idx AND dc > 1)", "CASE WHEN task = 'document-search' THEN 90 WHEN idx AND dc > 1 THEN 60 ELSE 0 END"),
    "similarity": ("task = 'document-similarity'", "CASE WHEN task = 'document-similarity' THEN 85 ELSE 0 END"),
}


@query(
    f"WITH {_PROFILE}, r AS ("
    + " UNION ALL ".join(f"SELECT profile_id, {i} AS place, '{a}' AS \"algorithmId\", {_RULES[a][0]} AS applicable, greatest(0, least(100, {_RULES[a][1]}))::INT AS score FROM q" for i, a in enumerate(recommender.ORDER))
    + ') SELECT profile_id, row_number() OVER (PARTITION BY profile_id ORDER BY applicable DESC, score DESC, place)::INT AS rank, "algorithmId", applicable, score FROM r'
)
def recommendation_scores(spark, t):
    c = F.col("c_custkey")
    pick = lambda values, at: F.get(F.array(*[F.lit(v) for v in values]), at.cast("int"))
    profiles = t("customer").select(
        c.alias("profile_id"),
        pick(recommender.TASKS, c % 9).alias("task"),
        (c * 997 % 1_000_000).cast("double").alias("textSize"),
        (c % 13).cast("double").alias("patternSize"),
        (c % 4 * 5 + 1).cast("double").alias("patternCount"),
        (c % 3).cast("double").alias("documentCount"),
        pick(("low", "medium", "high"), c % 3).alias("repetition"),
        pick(("small", "large"), F.floor(c / 3) % 2).alias("alphabet"),
        pick(("once", "frequent"), F.floor(c / 6) % 2).alias("queryFrequency"),
        (F.floor(c / 12) % 2 == 1).alias("needIndexing"),
        (F.floor(c / 24) % 2 == 1).alias("streaming"),
    )
    return recommender.recommend(profiles).select("profile_id", "rank", "algorithmId", "applicable", "score")


@query(
    """SELECT c_custkey AS profile_id, ['multi-pattern', 'fuzzy-match'][c_custkey % 2 + 1] AS task,
        CASE WHEN c_acctbal >= 0 THEN least(c_acctbal, 1e10) ELSE 100000.0 END::DOUBLE AS "textSize", 8::DOUBLE AS "patternSize", greatest(1, c_custkey % 3)::DOUBLE AS "patternCount", 1::DOUBLE AS "documentCount",
        CASE WHEN c_custkey % 3 < 2 THEN ['low', 'high'][c_custkey % 3 + 1] ELSE 'low' END AS repetition, 'large' AS alphabet, CASE WHEN c_custkey % 4 = 0 THEN 'frequent' ELSE 'once' END AS "queryFrequency",
        c_custkey % 4 = 1 AS "needIndexing", c_custkey % 2 = 1 AS streaming FROM customer"""
)
def profile_parsing(spark, t):
    """Profiles given as text: numbers below 0 and what isn't a number, unknown choices, flags in words."""
    c = F.col("c_custkey")
    pick = lambda values, by: F.get(F.array(*[F.lit(v) for v in values]), (c % by).cast("int"))
    raw = t("customer").select(
        c.alias("profile_id"), pick(["multi-pattern", "fuzzy-match"], 2).alias("task"), F.col("c_acctbal").cast("string").alias("textSize"), F.col("c_name").alias("patternSize"), (c % 3).cast("string").alias("patternCount"),
        F.lit(None).cast("string").alias("documentCount"), pick(["low", "high", "extreme"], 3).alias("repetition"), F.lit("huge").alias("alphabet"), pick(["frequent", "never", None, ""], 4).alias("queryFrequency"),
        pick(["false", "true", "0", ""], 4).alias("needIndexing"), pick(["no", "1"], 2).alias("streaming"),
    )
    return recommender.parse_profiles(raw)


@query(
    """SELECT * FROM (VALUES
        ('naive', 'Naive String Matching', 'string-matching', 'O(n·m)', 'O(1)', 'nm', 2000000), ('kmp', 'Knuth–Morris–Pratt (KMP)', 'string-matching', 'O(n + m)', 'O(m)', 'n+m', 5000000),
        ('rabin-karp', 'Rabin–Karp', 'string-matching', 'O(n·m)', 'O(1)', 'n+m', 5000000), ('boyer-moore', 'Boyer–Moore', 'string-matching', 'O(n·m)', 'O(m + σ)', 'n/m', 5000000),
        ('aho-corasick', 'Aho–Corasick', 'multi-pattern', 'O(n + m + z)', 'O(m · σ)', 'n+z', 5000000), ('trie', 'Trie (Prefix Tree)', 'text-structures', 'O(L)', 'O(total characters · σ)', 'L', 3000000),
        ('suffix-array', 'Suffix Array', 'text-structures', 'O(n log² n)', 'O(n)', 'nlog2n', 100000), ('kasai', 'Kasai LCP Array', 'text-structures', 'O(n)', 'O(n)', 'nlog2n', 100000),
        ('edit-distance', 'Edit Distance (Levenshtein)', 'text-analytics', 'O(n·m)', 'O(n·m)', 'mn', 5000), ('tfidf', 'TF-IDF', 'text-analytics', 'O(T + D·V)', 'O(D·V)', 'n', 3000000),
        ('inverted-index', 'Inverted Index', 'text-analytics', 'O(T)', 'O(T)', 'n', 3000000), ('similarity', 'Text Similarity', 'text-analytics', 'O(n + m)', 'O(V)', 'n', 3000000)
    ) m(id, name, category, worst, space, model, "maxBenchmarkSize")"""
)
def algorithm_metadata(spark, t):
    return registry.metadata(spark)
