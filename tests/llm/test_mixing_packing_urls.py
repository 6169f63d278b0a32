import random
import re
from collections import Counter, defaultdict
from fractions import Fraction
from math import ceil, comb, floor, log2

import pytest
import xxhash
from glossa.llm.mixing import WORD, hypergeometric, mix, splitting_tree
from glossa.llm.packing import best_fit, pack_documents, packed_texts
from glossa.llm.url_filters import DEFAULT_PATTERNS, Pattern, Rule, judge_urls
from pyspark.sql import functions as F


def targets(sizes, share=1.5, most=2.0):
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    total, fixed = share * sum(sizes.values()), {}
    while True:
        left, w = total - sum(fixed.values()), sum(v for s, v in weight.items() if s not in fixed)
        out = {s: left * weight[s] / w for s in sizes if s not in fixed} if w else {}
        above = [s for s, v in out.items() if v > most * sizes[s]]
        if not above:
            return {**fixed, **out}
        fixed.update({s: most * sizes[s] for s in above})


def spark_hash(*values):
    """Spark's xxhash64 of integers given as (value, bytes), texts and nulls."""
    seed = 42
    for v in values:
        if v is not None:
            data = v.encode() if isinstance(v, str) else (v[0] % (1 << 8 * v[1])).to_bytes(v[1], "little")
            seed = xxhash.xxh64_intdigest(data, seed)
    return seed


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def brute_split(total, marked, taken, chance):
    """The number at which the exact distribution function passes a chance."""
    run = Fraction(0)
    for k in range(max(0, taken + marked - total), min(taken, marked) + 1):
        run += Fraction(comb(marked, k) * comb(total - marked, taken - k), comb(total, taken))
        if run > chance:
            return k
    return min(taken, marked)


def n_words(t):
    return len(re.findall(WORD, t))


def brute_mix(rows, block_words, levels=4):
    """(copies, leaves) of each document from the quotas of blocks, drawn with exact fractions."""
    sizes = defaultdict(int)
    weights = Counter()
    for _, t, s in rows:
        sizes[s] += n_words(t)
        weights[s] += n_words(t) + 1
    want = targets(sizes)
    order = sorted(s for s in sizes if s is not None) + [None] * (None in sizes)
    blocks, draws = defaultdict(list), {}
    for i, t, s in rows:
        h = spark_hash((41, 4), (i, 8), (spark_hash(t), 8))
        bits = max(8, ceil(log2(weights[s] / block_words)))
        blocks[order.index(s) + 1, h >> 64 - bits].append((signed(h), n_words(t), i))
    cut = {}
    for k, s in enumerate(order, 1):
        whole = floor(want[s] / sizes[s])
        rest, before = want[s] - whole * sizes[s], 0
        own = [b for b in blocks if b[0] == k]
        for b in sorted(own, key=lambda b: (signed(spark_hash((47, 4), (k, 4), (b[1], 8))), b[1])):
            words = sum(x[1] for x in blocks[b])
            draws[b] = whole + (0 < rest and before < rest)
            if draws[b] > whole and before + words > rest:
                at = before
                for h, n, _ in sorted(blocks[b]):
                    if at + n / 2 >= rest:
                        cut[b] = min(cut.get(b, h), h)
                    at += n
            before += words
    quota = Counter()
    for b, n in draws.items():
        quota[b[0]] += n
    nodes = {0: {k: n for k, n in quota.items() if n}}
    for level in range(levels):
        below = {}
        for node, counts in nodes.items():
            total = sum(counts.values())
            taken, left = (total + node % 2) // 2, {}
            for k in sorted(counts):
                chance = signed(spark_hash((53, 4), (level, 4), (node, 4), (k, 4))) % (1 << 53) / float(1 << 53)
                left[k] = brute_split(total, counts[k], taken, chance)
                total, taken = total - counts[k], taken - left[k]
            below[2 * node], below[2 * node + 1] = left, {k: counts[k] - left[k] for k in counts}
        nodes = below
    owners = {}
    for k in quota:
        mine = sorted((signed(spark_hash((59, 4), (k, 4), (b[1], 8), (p, 4))), b, p) for b in draws if b[0] == k for p in range(1, draws[b] + 1))
        leaf_of = [leaf for leaf in sorted(nodes) for _ in range(nodes[leaf].get(k, 0))]
        owners |= {(b, p): leaf for (_, b, p), leaf in zip(mine, leaf_of)}
    out = {}
    for b, docs in blocks.items():
        for h, _, i in docs:
            leaves = [owners[b, p] for p in range(1, draws[b] + 1)]
            out[i] = leaves[:-1] if b in cut and h >= cut[b] else leaves
    return out


@pytest.mark.parametrize("block_words", [1 << 20, 16])
def test_mix(documents, block_words):
    rnd = random.Random(3)
    rows = [(i, " ".join("w" * rnd.randint(1, 60)), rnd.choice(["a", "a", "a", "a", "b", "c", "d", None])) for i in range(2000)]
    got = mix(documents(rows), block_words=block_words).collect()
    sizes, taken = defaultdict(int), defaultdict(int)
    by = {i: s for i, _, s in rows}
    for r in got:
        sizes[by[r["doc_id"]]] += r["size"]
        taken[by[r["doc_id"]]] += r["taken"]
        assert r["taken"] == r["size"] * r["copies"] <= 2 * r["size"] and len(r["shards"]) == r["copies"]
    want = targets(sizes)
    for r in got:
        assert abs(r["target"] - want[by[r["doc_id"]]]) < 1e-6 and r["source_size"] == sizes[by[r["doc_id"]]]
    assert all(abs(taken[s] - want[s]) <= 30 for s in sizes)  # half of the longest document
    assert {r["doc_id"]: r["shards"] for r in got} == brute_mix(rows, block_words)
    again = mix(documents(rows).repartition(5), block_words=block_words).collect()
    assert {(r["doc_id"], r["copies"], tuple(r["shards"])) for r in got} == {(r["doc_id"], r["copies"], tuple(r["shards"])) for r in again}
    out = mix(documents(rows), carry=True, block_words=block_words)
    assert out.columns[:-2] == documents(rows).columns and out.columns[-2:] == ["_shard", "position"]
    copies = out.collect()
    assert Counter((r["doc_id"], r["_shard"]) for r in copies) == Counter((r["doc_id"], s) for r in got for s in r["shards"])
    assert len({r["position"] for r in copies}) == len(copies)


def test_splits_follow_the_hypergeometric_law(spark):
    cases = [(20, 7, 10), (300, 280, 150), (1000, 5, 500), (5, 0, 2), (6, 6, 3), (0, 0, 0), (9, 4, 0)]
    chances = [k / 97 for k in range(97)]
    df = spark.createDataFrame([(*c, u) for c in cases for u in chances], "t long, m long, n long, u double")
    for r in df.withColumn("k", hypergeometric(*(F.col(c) for c in "tmnu"))).collect():
        assert r["k"] == brute_split(r["t"], r["m"], r["n"], Fraction(r["u"])), r
    large = spark.range(400).select(hypergeometric(F.lit(30_000_000), F.lit(10_000_000), F.lit(15_000_000), (F.col("id") + 0.5) / 400).alias("k")).collect()
    mean, deviation = 5_000_000, (15e6 * (1 / 3) * (2 / 3) * 0.5) ** 0.5
    z = [(r["k"] - mean) / deviation for r in large]
    assert abs(sum(z)) < 4 and abs(sum(x * x for x in z) / 400 - 1) < 0.02


def test_tree_keeps_quotas(spark):
    quotas = {k: (5 * k * k + 1) % 97 for k in range(1, 30)}
    table = spark.createDataFrame([(k, n) for k, n in quotas.items()], "sid int, passes int")
    ends = {r["sid"]: r["ends"] for r in splitting_tree(table, 4).collect()}
    assert {k: e[-1] for k, e in ends.items()} == quotas and all(e == sorted(e) and len(e) == 16 for e in ends.values())
    leaves = [sum(e[k] - (e[k - 1] if k else 0) for e in ends.values()) for k in range(16)]
    assert max(leaves) - min(leaves) <= 1


def test_mix_of_odd_rows(odd, none):
    got = mix(odd).collect()
    assert len(got) == 9 and {r["size"] for r in got if r["doc_id"] in (3, 4, 5)} == {0}
    assert mix(odd, carry=True).count() == sum(r["copies"] for r in got)
    assert mix(none).count() == 0 and mix(none, carry=True).count() == 0


def brute_fit(sizes, sources, clusters, capacity, slots):
    bins, out = [], []
    for size, s, c in zip(sizes, sources, clusters):
        fits = [b for b in bins if b["left"] >= size and (c is None or c not in b["c"]) and (s is None or b["s"][s] < slots)]
        b = min(fits, key=lambda b: (b["left"], b["id"]), default=None)
        if b is None:
            b = {"id": len(bins), "left": capacity, "c": set(), "s": Counter()}
            bins.append(b)
        b["left"] -= size
        b["c"].add(c)
        b["s"][s] += 1
        out.append(b["id"])
    return out


def test_best_fit_equals_brute_force():
    rnd = random.Random(4)
    for _ in range(60):
        n = rnd.randint(0, 120)
        sizes = sorted((rnd.randint(0, 50) for _ in range(n)), reverse=True)
        sources = [rnd.choice([None, "a", "a", "b", "c"]) for _ in range(n)]
        clusters = [rnd.choice([None, 1, 1, 2, rnd.randint(3, 99)]) for _ in range(n)]
        for slots in (1, 3):
            assert best_fit(sizes, sources, clusters, 60, slots)[0] == brute_fit(sizes, sources, clusters, 60, slots)


def test_packing(documents, odd, none):
    rnd = random.Random(5)
    rows = [(i, " ".join(f"{rnd.random()}" for _ in range(rnd.randint(0, 300))), rnd.choice("abc")) for i in range(500)] + [(900 + i, "same words", "a") for i in range(100)]
    got = pack_documents(documents(rows), capacity=128, group=200).collect()
    words = {i: len(t.split()) for i, t, _ in rows}
    source = {i: s for i, _, s in rows}
    covered, bins = defaultdict(list), defaultdict(list)
    for r in got:
        covered[r["doc_id"]].append((r["piece_start"], r["size"]))
        bins[r["bin"]].append(r)
    for i, n in words.items():
        assert sum(s for _, s in covered[i]) == n
        assert [a for a, _ in sorted(covered[i])] == list(range(0, max(n, 1), 128))
    for b in bins.values():
        assert sum(r["size"] for r in b) == b[0]["bin_fill"] <= 128
        assert sorted(r["position"] for r in b) == list(range(len(b)))
        assert sum(r["doc_id"] >= 900 for r in b) <= 1
        assert max(Counter(source[r["doc_id"]] for r in b).values()) <= 4
    text = {i: t for i, t, _ in rows}
    whole = defaultdict(list)
    for r in sorted(got, key=lambda r: r["piece"]):
        whole[r["doc_id"]].append(r["text"])
    assert {i: "".join(parts) for i, parts in whole.items()} == text
    assert all(len(r["text"].split()) == r["size"] for r in got)
    bins_of = {r["bin"]: r for r in packed_texts(pack_documents(documents(rows), capacity=128, group=200)).collect()}
    assert all(bins_of[b]["doc_ids"] == [r["doc_id"] for r in sorted(rs, key=lambda r: r["position"])] for b, rs in bins.items())
    assert all(bins_of[b]["text"] == "\n\n".join(r["text"] for r in sorted(rs, key=lambda r: r["position"])) for b, rs in bins.items())


def test_packing_of_odd_rows(odd, none):
    got = pack_documents(odd).collect()
    assert sum(r["piece"] == 0 for r in got) == 9 and pack_documents(none).count() == 0
    assert sorted(str(r["text"]) for r in got if r["size"] == 0) == ["", " \n\t ", "None"]


def test_packing_of_repeated_rows_is_the_same_on_other_partitions(documents):
    rnd = random.Random(15)
    rows = [(rnd.choice([None, 1, 2, i]), rnd.choice(["a b", "c", " ".join("x" * rnd.randint(1, 50))]), rnd.choice(["s", None])) for i in range(600)] + [(5, "hot", "s")] * 300
    runs = [Counter(map(tuple, pack_documents(documents(rows).repartition(n), capacity=40, group=50).collect())) for n in (1, 7)]
    assert runs[0] == runs[1]
    groups = Counter(r[4] >> 32 for r in runs[0].elements() if r[0] == 5)
    assert len(groups) > 5 and max(groups.values()) < 150  # a row that repeats doesn't meet in one group


def test_packing_with_clusters_of_a_join(spark, documents):
    docs = documents([(i, f"text {i}", str(i)) for i in range(60)])
    clusters = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(3, 0), (None, 0)], "doc_id long, component_id long")
    member = {i: i % 2 for i in range(40)} | {3: 0}
    bins = defaultdict(list)
    for r in pack_documents(docs, cluster=clusters).collect():
        bins[r["bin"]].append(member.get(r["doc_id"]))
    assert all(max(Counter(c for c in b if c is not None).values(), default=0) <= 1 for b in bins.values())
    assert len(bins) == 21 and sum(map(len, bins.values())) == 60


RULES = [Rule("com", "/", "allow"), Rule("example.com", "/en/", "block"), Rule("www.example.com", "/en/", "allow"), Rule("net", "/es/", "block")]
PATTERNS = (*DEFAULT_PATTERNS, Pattern("news.org/*/live|", "allow"), Pattern("news.org/*", "block"), Pattern("track*.io", "block"), Pattern("/a^b/", "block"))
URLS = [
    ("http://a.example.com/en/1", "example.com/en/", "block"), ("HTTP://WWW.Example.COM/en/", "www.example.com/en/", "allow"), ("http://badexample.com/en/", "com/", "allow"),
    ("http://example.com/EN/", "com/", "allow"), ("http://example.com", None, "allow"), ("http://x.net/es/?q=/en/", "net/es/", "block"), ("http://x.net/es", None, "allow"),
    ("http://free-bets.example.org/", None, "block"), ("http://alphabets.org/", None, "allow"), ("x.com/en/", None, "allow"), ("", None, "allow"), (None, None, "allow"), ("a://b://c.com/", None, "allow"),
    ("http://h?x://example.com/en/", None, "allow"), ("http://com/", "com/", "allow"), ("http://CASINO.org", None, "block"), ("http://a.org/casino/", None, "allow"),
    ("http://a.org/shop/Cart?x=1", None, "block"), ("http://a.org/shop/cartoon", None, "allow"), ("http://a.org/x.EXE", None, "block"), ("http://a.org/x.exe/", None, "allow"),
    ("http://a.org/x?sessionid=1", None, "block"), ("http://a.org/x?mysessionid=1", None, "allow"), ("http://eu.news.org/a/live", None, "allow"), ("http://news.org/a/live/", None, "block"),
    ("http://badnews.org/a", None, "allow"), ("http://x.tracker9.io/", None, "block"), ("http://a.org/A-b/1", None, "block"), ("http://a.org/ab/", None, "allow"), ("http://a.org/x/print/1?p", None, "block"),
    ("http://myadserver7.org", None, "block"), ("http://a.org?/cgi-bin/", None, "allow"), ("http://a.org/cgi-bin/x#y", None, "block"), ("http://casino\u212a.org/", None, "block"),
]


@pytest.mark.parametrize("literal", [500, 0])
def test_urls(spark, literal):
    pages = spark.createDataFrame([(i, u[0], "h", "p") for i, u in enumerate(URLS)] * 2, "page_id long, url string, host string, rule string")
    got = judge_urls(pages, RULES, patterns=PATTERNS, literal_rules=literal).collect()
    assert len(got) == 2 * len(URLS)
    assert {(r["page_id"], r["rule"], r["verdict"]) for r in got} == {(i, rule, v) for i, (_, rule, v) in enumerate(URLS)}
    assert judge_urls(pages.where("false"), RULES, literal_rules=literal).count() == 0
    assert judge_urls(pages, [], patterns=(), literal_rules=literal).where("verdict <> 'allow'").count() == 0


def test_rules_are_filed_under_tokens_that_their_urls_have():
    rnd = random.Random(18)
    letters = ["a", "b", "1", ".", "/", "?", "-", "*", "^", "|"]
    for _ in range(3000):
        text = "".join(rnd.choice(letters) for _ in range(rnd.randint(1, 7)))
        rule = Pattern(text if "|" not in text[:-1] else text.replace("|", "") + "|", "block")
        fits = re.compile(rule.pattern.replace(r"\z", r"\Z"))
        for _ in range(20):
            host, path = "".join(rnd.choice("aAb1.-") for _ in range(rnd.randint(0, 5))), "".join(rnd.choice("aAb1./-") for _ in range(rnd.randint(0, 5)))
            query = rnd.choice(["", "?" + "".join(rnd.choice("ab1?-") for _ in range(3))])
            path = "/" + path if path else ""
            if fits.search(host + path + query):
                assert set(rule.tokens) <= set(re.split("[^a-z0-9]+", f"{host} {path} {query}".lower())), (rule, host, path, query)
