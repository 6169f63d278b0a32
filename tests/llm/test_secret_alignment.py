import base64
import hashlib
import random

import pytest

from glossa.llm.secrets import confirmed_spans, is_private_key


def tlv(tag, content):
    n = len(content)
    size = bytes([n]) if n < 128 else bytes([0x80 | (n.bit_length() + 7) // 8]) + n.to_bytes((n.bit_length() + 7) // 8, "big")
    return bytes([tag]) + size + content


SHA256 = bytes.fromhex("608648016503040201")
PBES2 = bytes.fromhex("2a864886f70d01050d")
RSA = bytes.fromhex("2a864886f70d010101")


def digest_info(data):
    return tlv(0x30, tlv(0x30, tlv(6, SHA256) + tlv(5, b"")) + tlv(4, hashlib.sha256(data).digest()))


def key(size=120):
    return tlv(0x30, tlv(2, b"\0") + tlv(0x30, tlv(6, RSA) + tlv(5, b"")) + tlv(4, bytes(range(size))))


def kinds(text):
    return [k for _, _, k in confirmed_spans(text)]


def test_a_digest_is_no_key():
    assert not is_private_key(digest_info(b"x"))
    assert kinds(base64.b64encode(digest_info(b"x")).decode()) == []
    encrypted = tlv(0x30, tlv(0x30, tlv(6, PBES2) + tlv(0x30, b"")) + tlv(4, bytes(48)))
    assert is_private_key(encrypted) and is_private_key(key())
    other = tlv(0x30, tlv(0x30, tlv(6, PBES2[:-1] + b"\x63") + tlv(0x30, b"")) + tlv(4, bytes(48)))
    assert not is_private_key(other)


@pytest.mark.parametrize("before", ["", "x/", "/", "a-", "path/to/", "some_name_", "ab/cd-", "x", "yz", "/usr/"])
def test_whatever_stands_before_base64(before):
    secret = base64.b64encode(b"the password=hunter22 of it").decode()
    text = f"see {before}{secret} there"
    assert confirmed_spans(text) == [(4, 4 + len(before) + len(secret), "encoded")]
    if before[-1:] in ("", "/", "-", "_"):
        whole = base64.b64encode(key()).decode().rstrip("=")
        assert kinds(f"see {before}{whole} there") == ["key"]


def test_paths_and_names_hold_nothing():
    rng = random.Random(1)
    for _ in range(300):
        text = "/".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz-_MI", k=rng.randrange(1, 12))) for _ in range(8))
        assert confirmed_spans(text) == []


def test_long_runs_end():
    for piece in ("/", "/M", "/MII", "A", "ab/", "_-", "QUFB"):
        confirmed_spans(piece * 20_000)
