"""Exact token counts of a byte-level BPE vocabulary by deterministic transducers.

Two transducers are compiled.  The *splitter* reads character classes and places
the boundaries of pre-tokens; it is a fixed table.  The *merger* reads the bytes
of one pre-token; its state holds, for the suffix that can still grow into a
vocabulary entry, the last token of the encoding of every prefix ending there and
that prefix's count relative to now.  Exactly one last token exists for each
prefix: the one compatible with the last token before it, two tokens being
compatible if the merges leave their concatenation as these two.  Each transition
is annotated with the change of the token count; states are made when first met.

A step from a non-space to a space puts every splitter state into the same state,
so a chunk's state map is short: the text before its first such step (to be read
from whatever state comes in), the count of what lies between, and the text after
its last one (which determines the outgoing state).  Such maps compose
associatively.  Long texts are cut into chunks, each a row of its own that any task can
map; the maps of a text then go through a scan.  A run of text without such a step, one
word however long, is read as a whole.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The characters with Unicode's White_Space property.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: The contractions that the pre-tokenizer takes whole.
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
#: Characters of a chunk within a task, and of one that is a row.
CHUNK, ROW_CHUNK = 1 << 15, 1 << 20
#: Bytes from which a text is cut into rows.
LONG = 1 << 22
#: Words whose counts a worker remembers.
MEMO = 1_200_000
#: States of the merger that a worker keeps.
STATES = 500_000

_PIECE = re.compile(f"[{SPACES}]*[^{SPACES}]+|[{SPACES}]+")
_SPACE = re.compile(f"[{SPACES}]")
_SYNC = re.compile(f"(?<=[^{SPACES}])(?=[{SPACES}])")


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 as itself, the rest from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(0x100 + k): b for k, b in enumerate(rest)}


def load_vocabulary(path: str) -> tuple[list[tuple[bytes, bytes]], list[str]]:
    """Merges in order of rank, and special strings, from a tokenizer file."""
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    letters = _byte_letters()
    raw = [m.split(" ") if isinstance(m, str) else m for m in data["model"]["merges"]]
    return [(bytes(letters[c] for c in a), bytes(letters[c] for c in b)) for a, b in raw], [t["content"] for t in data["added_tokens"]]


class Merger:
    """The transducer over the bytes of a pre-token, compiled as it is used."""

    def __init__(self, merges: list[tuple[bytes, bytes]], most: int = STATES):
        self.most = most
        self.rank = {pair: k for k, pair in enumerate(merges)}
        #: Of each token that a merge makes: that merge's rank and its two parts.
        self.made = {a + b: (k, a, b) for k, (a, b) in reversed(list(enumerate(merges)))}
        self.tokens = {bytes([b]) for b in range(256)} | self.made.keys()
        self.stems = {t[:k] for t in self.tokens for k in range(len(t))}
        self._clear()

    def _clear(self) -> None:
        self.ids: dict[tuple, int] = {}
        self.keys: list[tuple] = []
        self.steps: dict[int, tuple[int, int]] = {}  # by state * 256 + byte: next state * 256, change of the count
        self._state((b"", ((b"", 0),)))

    def _state(self, key: tuple) -> int:
        at = self.ids.get(key)
        if at is None:
            at = self.ids[key] = len(self.keys)
            self.keys.append(key)
        return at << 8

    def compatible(self, left: bytes, right: bytes) -> bool:
        """Whether the merges leave ``left + right`` as these two tokens; ``left`` may be empty.

        The merges that made the two are undone from the last one back.  Before each,
        the parts that then met at the border must not have had a merge of their own
        that came first: one of lower rank, or of equal rank and further to the left.
        """
        if not left:
            return True
        rank, made = self.rank, self.made
        limit = 1 << 60
        while True:
            if rank.get((left, right), 1 << 60) < limit:
                return False
            a, b = made.get(left), made.get(right)
            if a is None and b is None:
                return True
            if b is None or (a is not None and a[0] > b[0]):
                limit, left = a[0], a[2]
            else:
                limit, right = b[0] + 1, b[1]

    def _step(self, at: int, byte: int) -> tuple[int, int]:
        """(next state * 256, change of the count)."""
        suffix, ends = self.keys[at >> 8]
        grown = suffix + bytes((byte,))
        tokens, stems = self.tokens, self.stems
        places = [(grown[i:], *ends[i]) for i in range(len(ends)) if ends[i] is not None]
        for token, last, count in places:  # the longest candidate first; just one is right
            if token in tokens and self.compatible(last, token):
                break
        else:
            raise ValueError("the vocabulary lacks a single byte")
        change = count + 1
        # A place from which no vocabulary entry goes on like the text can't begin a token any more; it is forgotten.
        kept = [(rest, last, n - change) for rest, last, n in places if rest in stems]
        if kept:
            grown = kept[0][0]
            ends = [None] * len(grown) + [(token, 0)]
            for rest, last, n in kept:
                ends[len(grown) - len(rest)] = last, n
            out = self._state((grown, tuple(ends)))
        else:
            out = self._state((b"", ((token, 0),)))
        self.steps[at + byte] = out, change
        return out, change

    def count(self, data: bytes) -> int:
        at, total, known = 0, 0, self.steps.get
        for byte in data:
            step = known(at + byte)
            if step is None:
                if len(self.keys) > self.most:  # bounded memory: what is still in use is compiled anew, from the state reached
                    key = self.keys[at >> 8]
                    self._clear()
                    at, known = self._state(key), self.steps.get
                step = self._step(at, byte)
            at = step[0]
            total += step[1]
        return total


# Character classes and states of the splitter.
_SP, _WS, _LET, _ONE, _RV, _E, _ELL, _NUM, _OTH, _APO = range(10)
_B, _L, _N, _O, _A, _AR, _AL, _S1, _W1, _S2, _W2 = range(11)


def _class(c: str) -> int:
    if c == " ":
        return _SP
    if _SPACE.match(c):
        return _WS
    if c == "'":
        return _APO
    if c in "stmd":
        return _ONE
    if c in "rv":
        return _RV
    if c in "el":
        return _E if c == "e" else _ELL
    kind = unicodedata.category(c)[0]
    return _LET if kind == "L" else _NUM if kind == "N" else _OTH


def _splitter() -> list[list[tuple[int, tuple[int, ...]]]]:
    """For each state and class: next state, and boundaries as offsets from before the character read."""
    letters = (_LET, _ONE, _RV, _E, _ELL)

    def fresh(c: int) -> int:
        return _L if c in letters else _N if c == _NUM else _A if c == _APO else _O

    def step(state: int, c: int) -> tuple[int, tuple[int, ...]]:
        space = c in (_SP, _WS)
        if state in (_AR, _AL):
            if c == (_E if state == _AR else _ELL):
                return _B, (1,)
            state, before = _L, (-1,)  # no contraction after all: the apostrophe was a token, a word has begun
        else:
            before = ()
        if state == _B:
            return ((_S1 if c == _SP else _W1) if space else fresh(c)), before
        if state in (_S1, _W1, _S2, _W2):
            if space:
                return (_S2 if c == _SP else _W2), ()
            cut = (-1,) if state in (_S2, _W2) else ()
            if state in (_S1, _S2):  # the space goes with what follows
                return (_O if c == _APO else fresh(c)), cut
            return fresh(c), (*cut, 0)
        if space:
            return (_S1 if c == _SP else _W1), (*before, 0)
        if state == _A:
            if c == _ONE:
                return _B, (1,)
            if c in (_RV, _ELL):
                return (_AR if c == _RV else _AL), ()
            return (_O, ()) if c in (_OTH, _APO) else (fresh(c), (0,))
        same = {_L: letters, _N: (_NUM,), _O: (_OTH, _APO)}[state]
        return (state, before) if c in same else (fresh(c), (*before, 0))

    return [[step(s, c) for c in range(10)] for s in range(11)]


class Counter:
    """Token counts of texts, by splitter and merger together."""

    def __init__(self, merges: list[tuple[bytes, bytes]], special: list[str], chunk: int = CHUNK):
        self.merger, self.table, self.chunk = Merger(merges), _splitter(), chunk
        self.classes: dict[str, int] = {}
        self.memo: dict[str, int] = {}
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None

    def pretokens(self, text: str) -> list[str]:
        """A text cut by the splitter, from its first state."""
        state, bounds, classes, table = _B, [0], self.classes, self.table
        for i, c in enumerate(text):
            kind = classes.get(c)
            if kind is None:
                kind = classes[c] = _class(c)
            state, cuts = table[state][kind]
            for cut in cuts:
                bounds.append(i + cut)
        if state in (_AR, _AL):
            bounds.append(len(text) - 1)
        bounds.append(len(text))
        return [text[a:b] for a, b in zip(bounds, bounds[1:]) if a < b]

    def _piece(self, piece: str) -> int:
        """Tokens of spaces and the word after them: one transition between synchronising steps."""
        n, memo = 0, self.memo
        core = piece.rstrip(".,")
        if (core[1:] if core[:1] == " " else core).isalpha():  # letters, then stops: the splitter's most common paths, at once
            words = (core, piece[len(core) :]) if len(core) < len(piece) else (core,)
        else:
            words = self.pretokens(piece)
        for word in words:
            known = memo.get(word)
            if known is None:
                known = self.merger.count(word.encode("utf-8", "surrogatepass"))
                if len(word) <= 64:
                    if len(memo) >= MEMO:
                        memo.clear()
                    memo[word] = known
            n += known
        if len(piece) <= 64:
            memo[piece] = n
        return n

    def _run(self, text: str) -> int:
        known, total = self.memo.get, 0
        for piece in _PIECE.findall(text):
            n = known(piece)
            total += self._piece(piece) if n is None else n
        return total

    def state_map(self, chunk: str) -> tuple[str, int, str] | str:
        """(head, count between, tail), or the chunk itself if no step in it synchronises."""
        first = _SYNC.search(chunk)
        if first is None:
            return chunk
        last = len(chunk)
        for last in range(len(chunk) - 1, 0, -1):
            if _SPACE.match(chunk, last) and not _SPACE.match(chunk, last - 1):
                break
        return chunk[: first.start()], self._run(chunk[first.start() : last]), chunk[last:]

    def compose(self, a: tuple[str, int, str] | str, b: tuple[str, int, str] | str) -> tuple[str, int, str] | str:
        """The state map of two adjoining pieces of text."""
        if isinstance(a, str):
            if isinstance(b, str):
                return self.state_map(a + b) if _SYNC.search(a[-1:] + b[:1]) else a + b
            left = self.state_map(a + b[0]) if _SYNC.search(a[-1:] + b[0][:1]) else a + b[0]
            return (left, b[1], b[2]) if isinstance(left, str) else (left[0], left[1] + self._run(left[2]) + b[1], b[2])
        if isinstance(b, str):
            right = self.state_map(a[2] + b)
            return (a[0], a[1], right) if isinstance(right, str) else (a[0], a[1] + self._run(right[0]) + right[1], right[2])
        return a[0], a[1] + self._run(a[2] + b[0]) + b[1], b[2]

    def scan(self, maps: list[tuple[str, int, str] | str]) -> int:
        """Tokens of the text whose chunks have these maps."""
        while len(maps) > 1:  # the up-sweep of the scan; its last element is the map of the whole
            maps = [self.compose(*maps[k : k + 2]) if k + 1 < len(maps) else maps[k] for k in range(0, len(maps), 2)]
        whole = maps[0] if maps else ""
        return self._run(whole) if isinstance(whole, str) else self._run(whole[0]) + whole[1] + self._run(whole[2])

    def _segment(self, text: str) -> int:
        if len(text) <= self.chunk:
            return self._run(text)
        return self.scan([self.state_map(text[k : k + self.chunk]) for k in range(0, len(text), self.chunk)])

    def segments(self, text: str) -> list[str]:
        """The text between special strings, each of which is a token."""
        return self.special.split(text) if self.special is not None else [text]

    def count(self, text: str) -> int:
        parts = self.segments(text)
        return len(parts) - 1 + sum(map(self._segment, parts))


def count_tokens(
    docs: DataFrame, vocabulary: str, text: str = "text", key: str = "doc_id", limit: int = 512, long: int = LONG, chunk: int = ROW_CHUNK
) -> DataFrame:
    """One row per input row: ``doc_id, n_bytes, n_tokens, over_limit``.

    Counts are those of the library for the tokenizer file ``vocabulary``, read on
    the driver: no tokens are added, special strings inside texts count as one token
    each.  Null and empty texts have no bytes and no tokens; texts of any length are
    counted whole, those of ``long`` bytes and more in rows of ``chunk`` characters;
    repeated rows are counted each; an empty table gives an empty
    result; other columns are ignored.
    """
    merges, special = load_vocabulary(vocabulary)
    shipped = docs.sparkSession.sparkContext.broadcast({"vocabulary": (merges, special)})  # as large as the vocabulary
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def kept() -> Counter:
        """One counter for all chunks and texts of a worker."""
        held = shipped.value
        if "counter" not in held:
            held["counter"] = Counter(*held["vocabulary"])
        return held["counter"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(*shipped.value["vocabulary"])
        for batch in batches:
            counts = [counter.count(t) if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, part, row = Counter([], special), TaskContext.get().partitionId(), 0
        names = ["doc_id", "n_bytes", "part", "row", "segment", "place", "chunk"]
        for batch in batches:
            for k in range(len(batch)):
                row += 1
                for n, segment in enumerate(counter.segments(batch.column(1)[k].as_py())):
                    for at in range(0, max(1, len(segment)), chunk):
                        values = (part, row, n, at), (pa.int32(), pa.int64(), pa.int64(), pa.int64())
                        own = [pa.array([v], t) for v, t in zip(*values)]
                        yield pa.RecordBatch.from_arrays([batch.column(0)[k : k + 1], batch.column(2)[k : k + 1], *own, pa.array([segment[at : at + chunk]], pa.string())], names)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = kept()
        for batch in batches:
            maps = [counter.state_map(t) for t in batch.column(6).to_pylist()]
            maps = [(m, None, None) if isinstance(m, str) else m for m in maps]
            columns = [pa.array([m[j] for m in maps], t) for j, t in enumerate((pa.string(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], *columns], [*batch.schema.names[:6], "head", "n", "tail"])

    def compose(table: pa.Table) -> pa.Table:
        counter = kept()
        table = table.sort_by([("segment", "ascending"), ("place", "ascending")])
        maps: dict[int, list] = {}
        for segment, head, n, tail in zip(*(table[c].to_pylist() for c in ("segment", "head", "n", "tail"))):
            maps.setdefault(segment, []).append(head if n is None else (head, n, tail))
        total = len(maps) - 1 + sum(map(counter.scan, maps.values()))
        return pa.table([table["doc_id"].slice(0, 1), table["n_bytes"].slice(0, 1), pa.array([total], pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    schema = f"doc_id {kind}, n_bytes long, n_tokens long"
    out = rows.where(F.col("n_bytes") < long).mapInArrow(run, schema)
    place = f"doc_id {kind}, n_bytes long, part int, row long, segment long, place long"
    chunks = rows.where(F.col("n_bytes") >= long).mapInArrow(cut, f"{place}, chunk string")
    maps = chunks.repartition("part", "row", "segment", "place").mapInArrow(read, f"{place}, head string, n long, tail string")
    return out.unionByName(maps.groupBy("part", "row").applyInArrow(compose, schema)).withColumn("over_limit", F.col("n_tokens") > limit)
