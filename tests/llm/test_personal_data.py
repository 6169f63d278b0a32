import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from glossa.llm.personal_data import BASE_KINDS, Anchors, find_personal_data, is_iban, is_ip6, luhn, written

ANCHORS = Anchors()


def plain_luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def brute(text):
    """The base patterns by the regular expressions of their definition."""
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((*m.span(), "email"))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out.append((*m.span(), "ip"))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m.group())
        if 12 <= len(digits) <= 19 and plain_luhn(digits):
            out.append((*m.span(), "card"))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append((*m.span(), "phone"))
    return out


def base(text):
    return sorted(s for s in ANCHORS.spans(text) if s[2] in BASE_KINDS)


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet="a.Z@+-_%019 5():é/\n", max_size=60))
def test_base_spans_are_those_of_the_patterns(text):
    assert base(text) == sorted(brute(text))


@settings(max_examples=800, deadline=None)
@given(st.lists(st.sampled_from(["4111 1111-1111 1111", "4111111111111111", "1.2.3.4", "255.", "256", ".0", "@", "a@b.c", ".d", "x@", "+1 (555) 555-0100", "+49", " 12", "-", "--", "0" * 13, "iban ", "é"]), max_size=9))
def test_base_spans_of_pieces(parts):
    text = "".join(parts)
    assert base(text) == sorted(brute(text))


@pytest.mark.parametrize(
    "text, kind, part",
    [
        ("my IBAN: DE89 3704 0044 0532 0130 00.", "iban", "DE89 3704 0044 0532 0130 00"),
        ("iban GB29NWBK60161331926819", "iban", "GB29NWBK60161331926819"),
        ("SSN 123-45-6789,", "ssn", "123-45-6789"),
        ("Social security number: 123-45-6789", "ssn", "123-45-6789"),
        ("at 2001:db8:0:0:8:800:200c:417a: here", "ip6", "2001:db8:0:0:8:800:200c:417a"),
        ("(2001:db8::8:800:200c:417a)", "ip6", "2001:db8::8:800:200c:417a"),
        ("see https://ann:s3cret@example.org/x", "login", "ann:s3cret"),
        ("Account no: 1234-5678-90 is", "account", "1234-5678-90"),
        ("Kontonummer 1 Konto Nr 12345678", "account", "12345678"),
    ],
)
def test_added_spans(text, kind, part):
    assert (text.index(part), text.index(part) + len(part), kind) in ANCHORS.spans(text)


@pytest.mark.parametrize(
    "text",
    [
        "",
        "no data at 12:30:45 or in a::b, std::string, 1:2",
        "on account of 12 things; an accountant 12345678; lessness 123-45-6789",
        "iban DE89370400440532013001",
        "ssn 000-45-6789, ssn 123-00-6789, ssn 923-45-6789",
        "https://example.org:8080/a@b http://x",
        "IBAN",
        "version 1.2.3, 300.1.1.1, $1,200.50",
        ":1:2:3:4:5:6:7:8:9",
    ],
)
def test_clean_texts_have_no_spans(text):
    assert ANCHORS.spans(text) == []


def test_checks():
    assert luhn("4111111111111111") and not luhn("4111111111111112")
    assert is_iban("DE89370400440532013000") and not is_iban("DE8937040044053201300")
    assert is_ip6("1:2:3:4:5:6:7:8") and not is_ip6("1:2:3:4:5:6:7") and not is_ip6("1::2::3")


def test_order_of_spans():
    assert written([(5, 9, "card"), (5, 8, "ip"), (0, 2, "ssn"), (0, 2, "phone")]) == "phone:0:2,ssn:0:2,ip:5:8,card:5:9"


def test_long_runs_take_linear_time():
    for piece in ("@", "1.", "12 ", "+1 ", "a:", "a@b ", "iban ", "1", "::", "+1("):
        ANCHORS.spans(piece * 100_000)


def test_operator_on_odd_rows(spark, odd, none, documents):
    rows = {r.doc_id: r for r in find_personal_data(odd).collect()}
    assert find_personal_data(odd).count() == odd.count()
    empty = hashlib.sha256(b"").hexdigest()
    assert all(r.spans == "" and r.base_sha256 == empty and r.n_email == 0 for r in rows.values())
    assert find_personal_data(none).count() == 0
    text = "é a.b@c.de, 10.0.0.1; +1 (555) 555-0100, 4111 1111 1111 1111"
    (r,) = find_personal_data(documents([(1, text, "x")])).collect()
    assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == (1, 1, 1, 1)
    assert r.spans == "email:2:10,ip:12:20,phone:22:39,card:41:60"
    assert r.base_sha256 == hashlib.sha256(written(brute(text)).encode()).hexdigest()
