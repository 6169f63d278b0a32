"""Personal data in texts: an automaton finds anchors, parsers around each expand and validate it.

Anchors are at-signs, schemes, digits as they begin addresses and numbers, and cue
words.  Each anchor asks one parser, which looks at its surroundings alone and never
twice at the same characters for one kind, so a text takes linear time however long.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import slices

#: Kinds of the base patterns, then those that the method adds.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "ssn", "ip6", "login", "account")

#: Bytes of text that a task turns into Python strings at a time.
SLICE = 8 << 20

Span = tuple[int, int, str]

_DIGITS = "0123456789"
_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_LOCAL = _LETTERS + _DIGITS + "._%+-"

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CHAIN = re.compile(r"[0-9](?:[ -]?[0-9])+")
_CALL = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

_IBAN = re.compile(r"(?:[ ]?(?:[Nn]o|[Nn]r|[Nn]umber|[Cc]ode))?[ .:#=]{0,3}([A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]){11,30})(?![A-Za-z0-9])")
_SSN = re.compile(r"(?:[ ]?(?:[Nn]o|[Nn]r|[Nn]umber))?[ .:#=]{0,3}(([0-9]{3})-([0-9]{2})-([0-9]{4}))(?![0-9-])")
_ACCOUNT = re.compile(r"(?:[ ]?(?:[Nn]o|[Nn]r|[Nn]umber|[Nn]ummer|[Nn]um[eé]ro|[Nn][uú]mero))?[ .:#=]{0,3}([0-9](?:[ -]?[0-9]){7,16})(?![0-9])")
_GROUPS = re.compile(r"[0-9A-Fa-f:]+")
_GROUP = re.compile(r"[0-9A-Fa-f]{1,4}")
_LOGIN = re.compile(r"([A-Za-z0-9._~%!$&'*+-]{1,64}:[^\s/@:]{1,128})@[A-Za-z0-9.-]+")

#: Cue words and the kind whose parser reads on behind them.
CUES = {"iban": "iban", "ssn": "ssn", "social security": "ssn", "account": "account", "acct": "account", "konto": "account", "cuenta": "account", "compte": "account"}


def luhn(digits: str) -> bool:
    """Whether the check digit fits: every second digit from the right but one doubled, its digits summed."""
    doubled = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)
    total = sum(map(int, digits[-1::-2])) + sum(doubled[int(d)] for d in digits[-2::-2])
    return total % 10 == 0


def is_iban(text: str) -> bool:
    """Whether an account number's check digits fit: the first four signs last, letters as 10 to 35, the rest by 97 is 1."""
    moved = text[4:] + text[:4]
    return 15 <= len(text) <= 34 and int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def is_ip6(text: str) -> bool:
    """Eight groups, or fewer around one gap: then three groups and eight digits at least, so that little else looks like it."""
    halves = text.split("::")
    if len(halves) > 2:
        return False
    groups = [g for h in halves if h for g in h.split(":")]
    if not all(_GROUP.fullmatch(g) for g in groups):
        return False
    return len(groups) == 8 if len(halves) == 1 else 3 <= len(groups) <= 7 and sum(map(len, groups)) >= 8


class Anchors:
    """The automaton of all anchors; each tells which parser it asks and how long it is."""

    def __init__(self) -> None:
        import ahocorasick

        self.machine = ahocorasick.Automaton()
        words: dict[str, str] = {"@": "email", "://": "login", "::": "ip6"}
        for a in _DIGITS:
            words[f"+{a}"] = "phone"
            words[f"{a}."] = "ip"
            words |= {f"{a}{sep}{b}": "card" for sep in ("", " ", "-") for b in _DIGITS}
        # A group of an address of eight is followed by a colon and a further group.
        words |= {f":{a}": "ip6" for a in _DIGITS + "abcdefABCDEF"}
        for cue, kind in CUES.items():
            words |= {w: kind for w in (cue, cue.title(), cue.capitalize(), cue.upper())}
        for word, kind in words.items():
            self.machine.add_word(word, (kind, len(word)))
        self.machine.make_automaton()

    def spans(self, text: str) -> list[Span]:
        """All spans of a text: those of the base patterns, leftmost and not overlapping per kind, and added ones."""
        out: list[Span] = []
        # Up to where each kind is decided, and behind which anchor its next expansion to the left ends.
        done, seen = dict.fromkeys(KINDS, 0), dict.fromkeys(KINDS, 0)
        for last, (kind, length) in self.machine.iter(text):
            start = last - length + 1
            if start < done[kind]:
                continue
            left, seen[kind] = max(done[kind], seen[kind]), last + 1
            found = getattr(self, f"_{kind}")(text, start, last + 1, left)
            if found:
                a, b, good = found
                done[kind] = b
                if good:
                    out.append((a, b, kind))
        return out

    # Parsers: where the anchor begins and ends, and how far to the left nothing is decided; they give
    # (start, end, whether it is valid), or nothing if no candidate is there.

    def _email(self, text: str, start: int, end: int, left: int) -> tuple[int, int, bool] | None:
        begin = left + len(text[left:start].rstrip(_LOCAL))
        domain = _DOMAIN.match(text, end) if begin < start else None
        return domain and (begin, domain.end(), True)

    def _ip(self, text: str, start: int, end: int, left: int) -> tuple[int, int, bool] | None:
        begin = left + len(text[left : start + 1].rstrip(_DIGITS))
        m = _DOTTED.match(text, begin)
        return m and (begin, m.end(), all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split(".")))

    def _card(self, text: str, start: int, end: int, left: int) -> tuple[int, int, bool] | None:
        m = _CHAIN.match(text, start)
        digits = m.group().replace(" ", "").replace("-", "")
        return start, m.end(), 12 <= len(digits) <= 19 and luhn(digits)

    def _phone(self, text: str, start: int, end: int, left: int) -> tuple[int, int, bool] | None:
        m = _CALL.match(text, start)
        return m and (start, m.end(), 9 <= sum(c in _DIGITS for c in m.group()) <= 15)

    def _iban(self, text: str, start: int, end: int, left: int) -> tuple[int, int, bool] | None:
        m = _IBAN.match(text, end) if _stands_alone(text, start, end) else None
        return m and (m.start(1), m.end(1), is_iban(m.group(1).replace(" ", "")))

    def _ssn(self, text: str, start: int, end: int, left: int) -> tuple[int, int, bool] | None:
        m = _SSN.match(text, end) if _stands_alone(text, start, end) else None
        return m and (m.start(1), m.end(1), m.group(2) not in ("000", "666") and m.group(2)[0] != "9" and m.group(3) != "00" and m.group(4) != "0000")

    def _account(self, text: str, start: int, end: int, left: int) -> tuple[int, int, bool] | None:
        m = _ACCOUNT.match(text, end) if _stands_alone(text, start, end) else None
        return m and (m.start(1), m.end(1), True)

    def _ip6(self, text: str, start: int, end: int, left: int) -> tuple[int, int, bool] | None:
        begin = left + len(text[left:start].rstrip(_DIGITS + "abcdefABCDEF:"))
        m = _GROUPS.match(text, begin)
        apart = (begin == 0 or not (text[begin - 1].isalnum() or text[begin - 1] in "_.")) and (m.end() == len(text) or not (text[m.end()].isalnum() or text[m.end()] == "_"))
        stop = m.end() - (m.group().endswith(":") and not m.group().endswith("::"))  # a colon of the sentence
        return begin, m.end() if stop == m.end() or not apart else stop, apart and is_ip6(text[begin:stop])

    def _login(self, text: str, start: int, end: int, left: int) -> tuple[int, int, bool] | None:
        m = _LOGIN.match(text, end) if start and text[start - 1] in _LETTERS else None
        return m and (m.start(1), m.end(1), True)


def _stands_alone(text: str, start: int, end: int) -> bool:
    """Whether a cue is a word of its own."""
    return (start == 0 or not text[start - 1].isalnum()) and (end == len(text) or not text[end].isalpha())


def written(spans: list[Span]) -> str:
    """``kind:start:end`` of each, by start, then in the order of KINDS."""
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1])))


def find_personal_data(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per input row: ``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans``.

    Spans are ``kind:start:end`` in code points, end exclusive.  ``base_sha256`` digests
    those of the base kinds alone; ``spans`` also has account numbers (with fitting check
    digits, or behind a cue word), social security numbers, long addresses and logins in
    links.  Null counts as the empty text, which has no spans; long texts are read whole
    in linear time; repeated rows are read each; an empty table gives an empty result;
    other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = Anchors()
        for whole in batches:
            for batch in slices(whole, 1, SLICE):
                counts, digests, spans = [[] for _ in BASE_KINDS], [], []
                for t in batch.column(1).to_pylist():
                    found = anchors.spans(t) if t else []
                    base = [s for s in found if s[2] in BASE_KINDS]
                    for k, n in zip(BASE_KINDS, counts):
                        n.append(sum(s[2] == k for s in base))
                    digests.append(hashlib.sha256(written(base).encode()).hexdigest())
                    spans.append(written(found))
                arrays = [batch.column(0), *(pa.array(n, pa.int64()) for n in counts), pa.array(digests, pa.string()), pa.array(spans, pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", *(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans"])

    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
