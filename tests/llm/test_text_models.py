import base64
import hashlib
import itertools
import json
import random
import re

import numpy as np
import public_tokenizers
import pytest
from glossa.llm import secrets as se
from glossa.llm import toxicity as to
from glossa.llm.token_counts import Counter, count_tokens, load_vocabulary

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(VOCABULARY)


def test_token_counts_equal_the_library(library):
    merges, special = load_vocabulary(VOCABULARY)
    whole, cut = Counter(merges, special), Counter(merges, special, chunk=7)
    rnd = random.Random(6)
    parts = ["'", "s", "t", "re", "ve", "ll", " ", "  ", "\n", "\t", "a", "é", "1", "½", "!", "　", "\xa0", "\x1c", "中", "<|endoftext|>", "the", "ing", "AAAA", "'r", "İ", "́", "😀", " '"]
    for _ in range(3000):
        t = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 25)))
        want = len(library.encode(t, add_special_tokens=False).ids)
        assert whole.count(t) == cut.count(t) == want, t


def test_token_query(spark, odd, none, library):
    got = count_tokens(odd, VOCABULARY).collect()
    text = {r["doc_id"]: r["text"] for r in odd.collect()}
    for r in got:
        t = text[r["doc_id"]] or ""
        n = len(library.encode(t, add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(t.encode()), n, n > 512)
    assert len(got) == 9 and count_tokens(none, VOCABULARY).count() == 0


def test_states_are_bounded_within_a_word(library):
    from glossa.llm.token_counts import Merger

    rnd = random.Random(16)
    merger = Merger(load_vocabulary(VOCABULARY)[0], most=500)
    run = "".join(rnd.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(20_000))
    assert merger.count(run.encode()) == len(library.encode(run, add_special_tokens=False).ids)
    assert len(merger.keys) <= 502 and len(merger.steps) <= 502 * 256


def test_long_texts_are_counted_in_rows(documents, library):
    rnd = random.Random(17)
    parts = ["'", "the", " ", "  ", "\n", "\t", "é", "12", "!", "中", "<|endoftext|>", "ing", "'ll", " word", "x" * 40]
    rows = [(i % 5 or None, "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 400))), "s") for i in range(60)] + [(9, "<|endoftext|>", "s"), (9, None, "s")]
    rows += rows[:5]
    want = sorted((str(i), len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t, _ in rows)
    for long in (1, 300):
        got = count_tokens(documents(rows), VOCABULARY, long=long, chunk=37).collect()
        assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"]) for r in got) == want


def brute_base(t):
    out = []
    word = r"(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
    for kind, pattern, least, group in (("assign", word + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 1), ("access", "AKIA[A-Z0-9]+", 20, 0), ("hex", "[0-9a-f]+", 24, 0)):
        out += [(m.start(), m.end(), kind) for m in re.finditer(pattern, t) if len(m.group(group)) >= least]
    return out


def test_base_spans_equal_brute_force():
    rnd = random.Random(7)
    parts = ["token", "Secret", "api_key", "apikey", "password", "paſſword", "=", ":", " ", '"', "'", "abc", "abcdef1", "AKIA", "ABCDEFGHIJKLMNOPQRST", "0123456789abcdef", "é", "\n", "x=y", "😀"]
    for _ in range(4000):
        t = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 14)))
        assert sorted(se.base_spans(t)) == sorted(brute_base(t)), t


def der(tag, body):
    n = len(body)
    return bytes([tag]) + (bytes([n]) if n < 128 else bytes([0x82]) + n.to_bytes(2, "big")) + body


def ssh(*fields):
    return b"".join(len(f).to_bytes(4, "big") + f for f in fields)


def armoured(name, data, headers=(), check=""):
    b64 = base64.b64encode(data).decode()
    lines = [f"-----BEGIN {name}-----", *headers, *([""] if headers or check else []), *(b64[k : k + 64] for k in range(0, len(b64), 64)), *([check] if check else []), f"-----END {name}-----"]
    return "\n".join(lines)


RSA = der(0x30, der(2, b"\0") + b"".join(der(2, bytes([1 + k]) * n) for k, n in enumerate((64, 3, 64, 32, 32, 32, 32, 32))))
EC = der(0x30, der(2, b"\1") + der(4, bytes(range(32))) + der(0xA0, der(6, b"\x2a\x86\x48\xce")) + der(0xA1, der(3, bytes(66))))
SEALED = der(0x30, der(0x30, der(6, bytes.fromhex("2a864886f70d01050d")) + der(0x30, der(6, b"\x2a\x86"))) + der(4, bytes(64)))
OPENSSH = b"openssh-key-v1\0" + ssh(b"none", b"none", b"") + (1).to_bytes(4, "big") + ssh(b"public", b"private part")
PGP = bytes([0x95, 0, 40, 4]) + bytes(39) + bytes([0xB4, 5]) + b"a user"[:5]


def test_encodings_of_keys():
    for name, data in (("RSA PRIVATE KEY", RSA), ("EC PRIVATE KEY", EC), ("ENCRYPTED PRIVATE KEY", SEALED), ("OPENSSH PRIVATE KEY", OPENSSH), ("PRIVATE KEY", KEY)):
        pem = armoured(name, data)
        assert se.is_private_key(data) and not se.is_private_key(data[:-1]) and not se.is_private_key(data + b"\0"), name
        for text in (pem, pem.replace("\n", "\\n"), pem.replace("\n", "\r\n")):
            assert se.confirmed_spans(f"x {text} y") == [(2, 2 + len(text), "key")], name
    sealed = armoured("RSA PRIVATE KEY", bytes(96), ("Proc-Type: 4,ENCRYPTED", "DEK-Info: AES-128-CBC," + "0F" * 16))
    assert se.confirmed_spans(sealed) == [(0, len(sealed), "key")]
    assert se.confirmed_spans(armoured("RSA PRIVATE KEY", bytes(97), ("Proc-Type: 4,ENCRYPTED", "DEK-Info: AES-128-CBC," + "0F" * 16))) == []
    check = "=" + base64.b64encode(se._crc24(PGP).to_bytes(3, "big")).decode()
    pgp = armoured("PGP PRIVATE KEY BLOCK", PGP, ("Version: 1",), check)
    assert se.confirmed_spans(pgp) == [(0, len(pgp), "key")]
    assert se.confirmed_spans(pgp.replace(check, "=AAAA")) == []
    assert se._crc24(b"123456789") == 0x21CF02


def test_what_only_nests_is_no_key():
    plain = der(0x30, der(2, b"\0") + der(4, b"just a text that is long enough"))
    numbers = der(0x30, der(2, b"\0") + der(2, b"\5") + der(2, b"\7"))
    certificate = der(0x30, der(0x30, der(2, b"\1")) + der(0x30, der(6, b"\x2a\x86")) + der(3, bytes(32)))
    assert not any(map(se.is_private_key, (plain, numbers, certificate, b"", b"\x30", b"\x30\x80")))


def test_headers_with_blanks():
    for header in ('{ "alg": "HS256" }', '{"typ":"JWT","alg":"none"}', ' \n{"alg":"x"}', '{"alg":"x"}'):
        part = lambda x: base64.urlsafe_b64encode(x.encode()).decode().rstrip("=")
        token = f"{part(header)}.{part('{ }')}.c2ln"
        assert se.confirmed_spans(f"a {token} b") == [(2, 2 + len(token), "jwt")], header


def test_many_markers_take_linear_time():
    text = "-----BEGIN PRIVATE KEY-----\n" * 20_000 + base64.b64encode(b"token=abcdef").decode() + " "
    assert [s[2] for s in se.confirmed_spans(text)] == ["encoded"]
    many = " ".join(base64.b64encode(b"token=abcdef").decode() for _ in range(20_000))
    assert len(se.confirmed_spans(many)) == 20_000


KEY = der(0x30, der(2, b"\0") + der(0x30, der(6, b"\x2a\x86\x48")) + der(4, bytes(range(1, 200))))


def test_structure_decides():
    b64 = base64.b64encode(KEY).decode()
    pem = f"-----BEGIN PRIVATE KEY-----\n{b64[:64]}\n{b64[64:]}\n-----END PRIVATE KEY-----"
    part = lambda x: base64.urlsafe_b64encode(json.dumps(x).encode()).decode().rstrip("=")
    jwt = f"{part({'alg': 'HS256', 'typ': 'JWT'})}.{part({'sub': '1'})}.c2ln"
    assert [s[2] for s in se.confirmed_spans("x " + pem + " y")] == ["key"]
    assert se.confirmed_spans(pem.replace(b64[:8], b64[:4] + "AAAA")) == []
    assert se.confirmed_spans(f"a {jwt} b") == [(2, 2 + len(jwt), "jwt")]
    assert se.confirmed_spans(f"{part({'typ': 'JWT'})}.{part({})}.x") == []
    assert [s[2] for s in se.confirmed_spans(KEY.hex())] == ["key"]
    assert [s[2] for s in se.confirmed_spans(base64.b64encode(b"the password=hunter22 is here").decode())] == ["encoded"]
    assert se.confirmed_spans("A" * 100 + " " + "word" * 40) == []


def test_short_and_nested_encodings():
    b64 = lambda x: base64.b64encode(x if isinstance(x, bytes) else x.encode()).decode()
    part = lambda x: base64.urlsafe_b64encode(json.dumps(x).encode()).decode().rstrip("=")
    pem = f"-----BEGIN PRIVATE KEY-----\n{b64(KEY)}\n-----END PRIVATE KEY-----\n"
    jwt = f"{part({'alg': 'HS256'})}.{part({'sub': '1'})}.c2ln"
    secrets = ["password=hunter22", "token=abcdef", "api_key: 9f8e7d6c5b", "clé: token=abcdef", pem, jwt, b64("token=abcdef"), "token=abcdef".encode().hex()]
    for run in [b64(x) for x in secrets] + [x.encode().hex() for x in secrets] + [b64("cl\xe9 token=abcdef".encode("latin-1")), b64("secret=aaaaaa")]:
        assert se.confirmed_spans(f"x {run} y") == [(2, 2 + len(run), "encoded")], run
    lower = b64("xAKIA" + "ABC" * 7 + "A")
    assert lower.isalpha() and lower[0].islower()
    assert se.confirmed_spans(lower) == [(0, len(lower), "encoded")]
    assert se.confirmed_spans(f"responsibilities {b64('token=abc')} {b64('just a plain text, nothing else')} {'0' * 30}") == []


def test_secret_query(odd, none, documents):
    rows = se.scan_secrets(odd).collect()
    assert len(rows) == 9 and all(r["spans"] == "" and r["base_sha256"] == hashlib.sha256(b"").hexdigest() for r in rows)
    assert se.scan_secrets(none).count() == 0
    r = se.scan_secrets(documents([(1, "é token = abcdefgh", "s")])).first()
    assert (r["n_assign"], r["spans"]) == (1, "assign:2:18") and r["base_sha256"] == hashlib.sha256(b"assign:2:18").hexdigest()


@pytest.fixture(scope="module")
def decoder():
    text = ("you are an idiot and a stupid loser what a pathetic clown this is disgusting trash " * 30).encode().translate(to._TO_SYMBOL)
    s = np.frombuffer(text, np.uint8).astype(int)
    n = to.SYMBOLS
    return to.Decoder(np.bincount((s[:-2] * n + s[1:-1]) * n + s[2:], minlength=n**3))


@pytest.mark.parametrize("span,want", [("1d10t", "idiot"), ("stup1d", "stupid"), ("l0s3r", "loser"), ("path3t1c", "pathetic"), ("stuuuupid", "stupid"), ("tr@$h", "trash"), ("idiot", "idiot")])
def test_decoding(decoder, span, want):
    assert decoder.decode(span) == want


def brute_decode(decoder, span, spaced, pairs):
    """(least cost, all originals that have it) over every path through the lattice."""
    lists, before = [], ""
    for k, c in enumerate(span):
        beside = spaced and (span[k - 1 : k].isalnum() or span[k + 1 : k + 2].isalnum())
        lists.append([(w, s, paid, len(c.encode()) if s == 27 else 1) for w, s, paid in decoder.options(c, before, spaced, beside, pairs)])
        before = c.lower()
    found = {}
    for path in itertools.product(*lists):
        a = b = 0
        total = 0.0
        for _, symbol, paid, times in path:
            total += paid
            for _ in range(times if symbol >= 0 else 0):
                total += decoder.cost[a][b][symbol]
                a, b = b, symbol
        found.setdefault(round(total + decoder.cost[a][b][0], 9), set()).add("".join(w for w, *_ in path))
    return found[min(found)]


def test_decoding_equals_exhaustive_search(decoder):
    rnd = random.Random(19)
    for _ in range(400):
        span = "".join(rnd.choice("aiostud10@$!| .-é") for _ in range(rnd.randint(1, 6)))
        for spaced in (False, True):
            for pairs in (False, True):
                assert decoder.decode(span, spaced, pairs) in brute_decode(decoder, span, spaced, pairs), span


def test_labels_that_repeat_a_key(spark, documents):
    rows = [(i, "bad word" if i % 2 else "good word", "s") for i in range(200)]
    labels = [(i, i % 2) for i in range(200)] + [(i, 0) for i in range(200)]
    table = lambda x: spark.createDataFrame(x, "doc_id long, toxic int")
    first, second = (sorted(map(tuple, to.toxicity(documents(rows), table(x)).collect())) for x in (labels, labels[::-1]))
    assert first == second and sum(r[3] for r in first) == 100


def test_spaced_letters_and_reading(decoder):
    reader = to.Reader(decoder)
    assert reader.restored("what an i d i o t you") == ["idiot"]
    assert reader.restored("i.d.i.0.t") == ["idiot"]
    assert reader.restored("a b and c") == []
    assert reader.forms("cl0wn!!") == ("cl0wn", "clown") and reader.forms("word,") == ("word",)


@pytest.fixture(scope="module")
def languages():
    text = ("réeux dödel achkeitü idiot stupid ass you are an idiot and a stupid loser un vrai réeux der dödel " * 30).encode().translate(to._TO_SYMBOL)
    s = np.frombuffer(text, np.uint8).astype(int)
    n = to.SYMBOLS
    return to.Reader(to.Decoder(np.bincount((s[:-2] * n + s[1:-1]) * n + s[2:], minlength=n**3)))


@pytest.mark.parametrize("word", ["réeux", "dödel", "achkeitü", "idiot", "ass"])
@pytest.mark.parametrize("gap", [" ", "  ", "/", " - ", "\n", "_", "*", "!", "|", "·"])
def test_spaced_words_with_any_letters_and_gaps(languages, word, gap):
    assert word in languages.restored(f"what {gap.join(word)} then")


def test_doubled_letters_and_leading_signs(languages):
    assert all(word in languages.forms(token) for token, word in (("stuupid", "stupid"), ("idiiot", "idiot"), ("döödel", "dödel"), ("rée0ux", "réeux")))
    assert languages.restored("what a, b") == [] and "ass" in languages.restored("an @ $ $") and "stupid" in languages.restored("so $ t u p i d!")
    assert languages.restored("re\u0301eux r e\u0301 e u x") == ["réeux"]
    assert list(to.spaced_spans("| " * 100_000 + "word" + " !" * 100_000))  # in linear time


def test_toxicity(spark, documents, none):
    rnd = random.Random(8)
    words = ["river", "stone", "cloud", "paper", "green", "under", "table", "light"]
    rows, labels = [], []
    for i in range(900):
        bad = i % 4 == 0
        t = [rnd.choice(words) for _ in range(rnd.randint(5, 40))]
        if bad:
            t.insert(rnd.randrange(len(t)), rnd.choice(["idiot", "moron", "scum"]))
        rows.append((i, " ".join(t), "s"))
        labels.append((i, 1, int(bad)))
    rows += [(2000, "river m0r0n stone", "s"), (2001, "river s c u m stone", "s"), (2002, None, "s"), (2003, "", "s"), (None, "green", "s"), (2000, "river m0r0n stone", "s")]
    table = spark.createDataFrame(labels + [(3000, None, None)], "doc_id long, quality int, toxic int")
    got = to.toxicity(documents(rows), table).collect()
    truth = {i: y for i, _, y in labels}
    test = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert len(got) == len(rows) and len(test) > 100 and sum(r["predicted"] == truth[r["doc_id"]] for r in test) >= 0.97 * len(test)
    odd = {r["doc_id"]: r["predicted"] for r in got if r["doc_id"] not in truth}
    assert odd[2000] == odd[2001] == 1 and odd[2002] == odd[2003] == odd[None] == 0
    kept = to.drop_toxic(documents(rows), table)
    assert kept.columns == documents(rows).columns and kept.count() == sum(r["predicted"] == 0 for r in got)
    assert to.toxicity(none, table).count() == 0
    assert to.toxicity(documents(rows[:3]), table.where("false")).count() == 3
