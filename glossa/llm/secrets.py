"""Secret scans with structural confirmation.

Base patterns give spans by themselves.  The method adds spans whose content it
can confirm: base64 or hexadecimal candidates are decoded, private keys must have the
fields of one of the known encodings with nested lengths that fill each other exactly,
signed tokens must have a decodable header that names an algorithm, and other encoded
text must hold a base pattern or something confirmed itself, at any depth.  Candidates
have at least the length that the shortest base pattern of 12 bytes has when encoded; a
run broken by line ends is as many candidates, except within the armour of a key.  The
signs ``/ _ -`` may be part of base64 or stand before it, so a run is read from its
beginning, behind each of these, and shifted by one to three signs.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The base kinds in order of listing, each a pattern; then the method's kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "jwt", "key", "encoded")

#: The shortest header that names an algorithm, {"alg":"x"}, is 15 characters in base64.
_JWT = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{15,}\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*")
_ARMOUR = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?)-----")
_END = re.compile(r"-----END [A-Z0-9 ]*-----")
_HEADER = re.compile(r"[\x20\t]*([A-Za-z0-9-]+):[\x20\t]*(.*)")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
_SEPARATOR = re.compile(r"[/_-]+")
_LONG_HEX = re.compile(r"[0-9A-Fa-f]{24,}")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns: leftmost matches, of which failing ones are dropped afterwards."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    # A run of 24 or more is the whole leftmost run, as runs of these characters can't adjoin.
    return out + [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]


def decode_base64(data: str) -> bytes | None:
    """Standard or URL-safe base64 with or without padding; None if it isn't that."""
    data = data.translate({45: 43, 95: 47}).rstrip("=")
    try:
        return base64.b64decode(data + "=" * (-len(data) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _header(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """(tag, start, end) of the content of the element at ``at``; None if its length doesn't fit."""
    if at + 2 > end:
        return None
    tag, size, start = data[at], data[at + 1], at + 2
    if size & 0x80:
        n = size & 0x7F
        if not 1 <= n <= 4 or start + n > end:
            return None
        size, start = int.from_bytes(data[start : start + n], "big"), start + n
    return (tag, start, start + size) if start + size <= end else None


def _elements(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """(tag, start, end) of elements that fill a stretch exactly; None if they don't."""
    out = []
    while at < end:
        element = _header(data, at, end)
        if element is None:
            return None
        out.append(element)
        at = element[2]
    return out


#: Object identifiers of password-based encryption (PKCS #5 and #12), their last numbers behind a common beginning.
_ENCRYPTION = {bytes.fromhex("2a864886f70d0105"): (1, 3, 4, 6, 10, 11, 13), bytes.fromhex("2a864886f70d010c01"): (1, 2, 3, 4, 5, 6)}

# Tags of the encodings of keys.
_INTEGER, _BITS, _OCTETS, _OBJECT, _SEQUENCE, _FIRST, _SECOND = 0x02, 0x03, 0x04, 0x06, 0x30, 0xA0, 0xA1


def _nests(data: bytes, at: int, end: int) -> bool:
    """Whether all nested lengths fill each other."""
    left = [(at, end)]
    while left:
        inner = _elements(data, *left.pop())
        if inner is None:
            return False
        left += [(a, b) for tag, a, b in inner if tag & 0x20]  # made of further elements
    return True


def is_private_key(data: bytes) -> bool:
    """Whether bytes are a private key of one of the known encodings, all nested lengths filled exactly.

    These are: version, algorithm identifier and octets (PKCS #8); an identifier of
    password-based encryption and octets (the same encrypted); version and nine integers or more (RSA) or five (DSA); version 1,
    octets and tagged parameters (EC); and OpenSSH's own.
    """
    if data.startswith(b"openssh-key-v1\0"):
        return _is_openssh_key(data)
    top = _header(data, 0, len(data))
    if top is None or top[0] != _SEQUENCE or top[2] != len(data) or not _nests(data, top[1], top[2]):
        return False
    fields = _elements(data, top[1], top[2]) or []
    tags = [f[0] for f in fields]
    named = lambda f: data[f[1] : f[1] + 1] == bytes([_OBJECT]) and (_header(data, f[1], f[2]) or (0, 0, 0))[2] > f[1] + 2
    if tags == [_SEQUENCE, _OCTETS]:
        return named(fields[0]) and _is_encryption(data, fields[0][1], fields[0][2]) and fields[1][2] - fields[1][1] >= 16
    if len(tags) < 3 or tags[0] != _INTEGER or fields[0][2] - fields[0][1] != 1:
        return False
    version = data[fields[0][1]]
    if tags[1:3] == [_SEQUENCE, _OCTETS]:
        return version <= 1 and named(fields[1]) and fields[2][2] > fields[2][1] and set(tags[3:]) <= {_FIRST, _SECOND, 0x81}
    if tags[1] == _OCTETS:
        return version == 1 and fields[1][2] - fields[1][1] >= 16 and set(tags[2:]) <= {_FIRST, _SECOND}
    whole = [f[2] - f[1] for f in fields[1:]]
    if len(tags) == 6 and set(tags) == {_INTEGER}:
        return version == 0 and min(whole) >= 1 and whole[0] >= 32
    rsa = len(tags) >= 9 and set(tags[:9]) == {_INTEGER} and tags[9:] in ([], [_SEQUENCE])
    return rsa and version <= 1 and min(whole) >= 1 and whole[0] >= 32


def _is_encryption(data: bytes, at: int, end: int) -> bool:
    """Whether an algorithm identifier is one of encryption by a password; a digest's, say, is not."""
    _, start, stop = _header(data, at, end)
    return data[stop - 1] in _ENCRYPTION.get(data[start : stop - 1], ())


def _is_openssh_key(data: bytes) -> bool:
    """Cipher, key derivation and its options, a number of keys, as many public keys, and the private part, which ends the data."""
    at, fields = len(b"openssh-key-v1\0"), []
    many = 0
    while len(fields) < 4 + many:
        if at + 4 > len(data):
            return False
        n = int.from_bytes(data[at : at + 4], "big")
        if len(fields) == 3 and not many:
            many, at = n, at + 4
            if not 1 <= many <= 64:
                return False
            continue
        at += 4 + n
        if at > len(data):
            return False
        fields.append(n)
    return at == len(data) and fields[-1] > 0


def _is_pgp_key(data: bytes) -> bool:
    """Whether bytes begin with a secret-key packet of a known version and are packets whose lengths fill them."""
    at = 0
    while at < len(data):
        tag, size = data[at], 0
        if not tag & 0x80 or at + 2 > len(data):
            return False
        kind = tag & 0x3F if tag & 0x40 else tag >> 2 & 0x0F
        first = data[at + 1]
        if tag & 0x40:  # lengths of 1, 2 and 5 bytes
            head = 2 if first < 192 else 3 if first < 224 else 6 if first == 255 else 0
            size = first if head == 2 else (first - 192 << 8) + 192 + int.from_bytes(data[at + 2 : at + 3], "big") if head == 3 else int.from_bytes(data[at + 2 : at + 6], "big")
        else:
            n = (1, 2, 4, 0)[tag & 3]
            head, size = (1 + n, int.from_bytes(data[at + 1 : at + 1 + n], "big")) if n else (1, len(data) - at - 1)
        start = at + head
        if not head or start + size > len(data):
            return False
        if at == 0 and (kind != 5 or not size or data[start] not in (3, 4, 5, 6)):
            return False
        at = start + size
    return at > 0


def _crc24(data: bytes) -> int:
    """The check sum of OpenPGP armour."""
    crc = 0xB704CE
    for byte in data:
        crc ^= byte << 16
        for _ in range(8):
            crc = crc << 1 ^ (0x1864CFB if crc & 0x800000 else 0)
    return crc & 0xFFFFFF


def _is_armoured_key(name: str, body: str) -> bool:
    """Whether what an armour of this name holds is a key: header lines, base64 and, in OpenPGP, a check sum."""
    lines = re.split(r"\\r\\n|\\n|\\r|\r\n|\n|\r", body)
    headers, rest = {}, []
    for line in lines:
        m = _HEADER.fullmatch(line) if not rest else None
        if m:
            headers[m.group(1)] = m.group(2)
        elif line.strip():
            rest.append(line.strip())
    check = rest.pop()[1:] if rest and re.fullmatch(r"=[A-Za-z0-9+/]{4}", rest[-1]) else None
    data = decode_base64("".join("".join(rest).split()))
    if not data:
        return False
    if name.endswith("BLOCK"):
        return _is_pgp_key(data) and (check is None or decode_base64(check) == _crc24(data).to_bytes(3, "big"))
    if headers.get("Proc-Type", "").replace(" ", "").startswith("4,ENCRYPTED"):
        cipher, _, start = headers.get("DEK-Info", "").partition(",")
        # Whole blocks of the named cipher, whose size its start value has.
        return bool(cipher) and re.fullmatch(r"(?:[0-9A-Fa-f]{2}){8,16}", start.strip()) is not None and len(data) % (len(start.strip()) // 2) == 0
    return is_private_key(data)


def is_signed_token(text: str) -> bool:
    """Whether a dotted token's first part decodes to a header that names an algorithm, and its second to an object."""
    head, body, _ = text.split(".", 2)
    for part, wanted in ((head, "alg"), (body, None)):
        try:
            value = json.loads(decode_base64(part) or b"")
        except (ValueError, RecursionError):
            return False
        if not isinstance(value, dict) or wanted and wanted not in value:
            return False
    return True


def _holds_secret(data: bytes) -> bool:
    inner = data.decode("utf-8", "replace")  # bytes that aren't UTF-8 part what is beside them, as other signs do
    return bool(base_spans(inner) or confirmed_spans(inner))


def confirmed_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of what the method confirms beyond the base patterns, none within another."""
    out = []
    if "-----BEGIN" in text:
        ends = [m.span() for m in _END.finditer(text)]
        at = [a for a, _ in ends]
        for m in _ARMOUR.finditer(text):
            k = bisect_left(at, m.end())
            if k < len(ends) and _is_armoured_key(m.group(1), text[m.end() : ends[k][0]]):
                out.append((m.start(), ends[k][1], "key"))
    if "." in text:
        tokens = ((m.start(), m.end(), "jwt") for m in _JWT.finditer(text) if is_signed_token(m.group()))
        out = _beside(out, tokens)
    for pattern in (_LONG_HEX, _BASE64):
        out = _beside(out, _decoded(text, pattern, out))
    return out


def _decoded(text: str, pattern: re.Pattern, taken: list[tuple[int, int, str]]) -> Iterator[tuple[int, int, str]]:
    """Candidates of an encoding, beside what is taken, whose content is a key or holds a secret."""
    k = 0
    for m in pattern.finditer(text):
        while k < len(taken) and taken[k][1] <= m.start():
            k += 1
        if k < len(taken) and taken[k][0] < m.end():
            continue
        run = m.group()
        if pattern is _BASE64:
            kind = _held_in_base64(run)
        else:
            data = bytes.fromhex(run) if len(run) % 2 == 0 else b""
            kind = "key" if is_private_key(data) else "encoded" if _holds_secret(data) else None
        if kind:
            yield m.start(), m.end(), kind


def _quads(run: str) -> bytes:
    """What a run without padding decodes to, but for a last sign that fills no byte."""
    return decode_base64(run[:-1] if len(run) % 4 == 1 else run) or b""


def _held_in_base64(run: str) -> str | None:
    """The kind of what a run of base64 signs holds.

    A path or a name in front belongs to the run, as their signs are those of base64.  So
    beside the whole run, what begins behind a separator is read as a key whose length
    it tells, and as text; and the run is read from each of its first four signs, as
    wherever an encoding begins, one of these falls on its groups.
    """
    run = run.rstrip("=")
    whole = _quads(run)
    if is_private_key(whole):
        return "key"
    begins = [m.end() for m in _SEPARATOR.finditer(run)]
    for at in begins:
        if run[at : at + 1] == "M" and len(run) - at >= 16:  # a sequence
            top = _length(_quads(run[at : at + 8]))
            signs = -(-top * 4 // 3)
            if top and signs <= len(run) - at and is_private_key(_quads(run[at : at + signs])):
                return "key"
    if _holds_secret(whole):
        return "encoded"
    for at, end in zip(begins, [*(b - 1 for b in begins[1:]), len(run)]):
        if at % 4 and end - at >= 16 and _holds_secret(_quads(run[at:end])):
            return "encoded"
    return "encoded" if any(base_spans(_quads(run[k:]).decode("utf-8", "replace")) for k in (1, 2, 3)) else None


def _length(data: bytes) -> int:
    """Bytes of the element that begins here; 0 if none does."""
    if len(data) < 6:
        return 0
    size, n = data[1], data[1] & 0x7F
    if size < 0x80:
        return 2 + size
    return 2 + n + int.from_bytes(data[2 : 2 + n], "big") if 1 <= n <= 4 else 0


def _beside(taken: list[tuple[int, int, str]], more: Iterator[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Both in order, without those of the second, in order themselves, that meet one of the first."""
    out, k = list(taken), 0
    for span in more:
        while k < len(taken) and taken[k][1] <= span[0]:
            k += 1
        if k == len(taken) or taken[k][0] >= span[1]:
            out.append(span)
    return sorted(out)


def _written(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1])))


def scan_secrets(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per input row: ``doc_id, n_assign, n_access, n_hex, base_sha256, spans``.

    Spans are ``kind:start:end`` in code points, end exclusive, by start and then in
    the order of KINDS.  ``base_sha256`` digests those of the base patterns alone.
    Null counts as the empty text, which has no spans; long texts are read whole;
    repeated rows are scanned each; an empty table gives an empty result; other columns
    are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, spans = ([], [], []), [], []
            for t in batch.column(1).to_pylist():
                base = base_spans(t) if t else []
                for k, n in enumerate(counts):
                    n.append(sum(s[2] == KINDS[k] for s in base))
                digests.append(hashlib.sha256(_written(base).encode()).hexdigest())
                spans.append(_written(base + confirmed_spans(t)) if t else "")
            arrays = [batch.column(0), *(pa.array(n, pa.int64()) for n in counts), pa.array(digests, pa.string()), pa.array(spans, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
