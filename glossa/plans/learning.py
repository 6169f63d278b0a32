"""What to know about each algorithm, and small inputs to try it on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .registry import META, Input

#: Per algorithm: what it does, when it pays, what it costs, where it is used.
NOTES: dict[str, tuple[str, str, str, tuple[str, ...]]] = {
    "naive": ("Tries every shift and compares until a character differs.", "Short patterns, short texts, and as a check of the others.", "Repetitive texts make it compare almost everything at every shift.", ("tests", "tiny inputs")),
    "kmp": ("Keeps what has matched by a table of borders of the pattern, and never goes back in the text.", "Streams, small alphabets, repetitive texts.", "The table must be made, and nothing is skipped.", ("log streams", "DNA")),
    "rabin-karp": ("Compares a rolling hash of each window first and characters only where hashes agree.", "Many patterns of one length; fingerprints.", "Equal hashes of unequal windows cost a comparison each.", ("plagiarism", "deduplication")),
    "boyer-moore": ("Compares from the right and skips by the last place of a character and by matched suffixes.", "Long patterns in natural language.", "Small alphabets leave little to skip.", ("editors", "search tools")),
    "aho-corasick": ("A trie of all patterns with links to the longest suffix that is a prefix finds all of them in one pass.", "Dictionaries of patterns.", "Every state takes memory, and a changed dictionary means a new machine.", ("filters", "signatures")),
    "trie": ("Words share the path of their common beginnings.", "Prefix look-ups and completions.", "A node for each character of each beginning.", ("completion", "routing")),
    "suffix-array": ("All suffixes of a text in order, as their starts.", "Many searches of one text.", "A changed text is sorted again.", ("full-text search", "genomes")),
    "kasai": ("Common prefixes of neighbouring suffixes, each found from the one before.", "Repeats and distinct substrings.", "It needs the suffix array first.", ("repeats", "compression")),
    "edit-distance": ("The least insertions, deletions and substitutions between two texts.", "Typing errors, alignment of short texts.", "Its cost is the product of the lengths.", ("spelling", "diff")),
    "tfidf": ("Frequent in the document and rare in the corpus makes a term weigh much.", "Keywords and ranking.", "It knows neither order nor meaning.", ("ranking", "features")),
    "inverted-index": ("For every term the documents that have it.", "Many queries of one corpus.", "It is built once and takes space.", ("search engines", "log search")),
    "similarity": ("How many terms two texts share, by four measures.", "Near copies and related texts.", "Only words count.", ("clustering", "near copies")),
}

#: Inputs of our own that show what is particular about each algorithm.
PRESETS: dict[str, list[tuple[str, Input]]] = {
    "naive": [("a word three times", Input(text="to see the sea one has to see", pattern="see")), ("almost everywhere", Input(text="xxxxxxxxxxxxxxxy", pattern="xxxy"))],
    "kmp": [("borders of borders", Input(text="abaababaabaababaababa", pattern="abaababa")), ("overlaps", Input(text="ninininini", pattern="ninini"))],
    "rabin-karp": [("words", Input(text="red lorry yellow lorry", pattern="lorry")), ("digits", Input(text="1618033988749894848", pattern="8948"))],
    "boyer-moore": [("long skips", Input(text="a quiet harbour far beyond the northern lights", pattern="northern")), ("matched suffixes", Input(text="tatatictatacticta", pattern="tactic"))],
    "aho-corasick": [("words in words", Input(text="rearranged ranges", patterns=["range", "ranges", "arrange", "an", "ear"])), ("short ones", Input(text="xyzzyx zyx", patterns=["x", "xy", "zy", "yz", "zyx"]))],
    "trie": [("plants", Input(patterns=["fir", "fern", "fennel", "fig", "flax"], query="fe")), ("nested", Input(patterns=["in", "inn", "inner", "innermost", "out"], query="inn"))],
    "suffix-array": [("repeats", Input(text="senselessness")), ("a palindrome", Input(text="rotator"))],
    "kasai": [("repeats", Input(text="senselessness")), ("a refrain", Input(text="tralalala"))],
    "edit-distance": [("spelling", Input(text="harbor", text_b="harbour")), ("two towns", Input(text="lisbon", text_b="london"))],
    "tfidf": [("weather", Input(documents=["rain falls on the northern hills", "snow falls on northern peaks", "sun warms the southern coast", "the coast waits for rain"]))],
    "inverted-index": [("weather", Input(documents=["rain falls on the northern hills", "snow falls on northern peaks", "sun warms the southern coast", "the coast waits for rain"], query="rain northern"))],
    "similarity": [("one fact twice", Input(text="The old bridge crosses the river near the mill", text_b="Near the mill an old bridge crosses the water"))],
}


def learning(spark: SparkSession) -> DataFrame:
    """``id, name, what, use, limits, applications, worst, space``, one row an algorithm."""
    rows = [(a, META[a][0], *NOTES[a][:3], list(NOTES[a][3]), META[a][2], META[a][3]) for a in META]
    return spark.createDataFrame(rows, "id string, name string, what string, use string, limits string, applications array<string>, worst string, space string")
