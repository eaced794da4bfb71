"""Periodic runs, prefix tries and personal data against brute force, and their edges."""

import collections
import hashlib
import itertools
import math
import os
import random
import re
import zlib
from fractions import Fraction

import duckdb
import numpy as np
import pytest

from framelode.llm import periodic, personal_data, prefix_trie, queries

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
needs_tables = pytest.mark.skipif(not os.path.isdir(DATA), reason="the supplied tables are needed")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def all_runs(words, least=24, fold=3):
    ids = np.unique(np.array(words, dtype=object).astype(str), return_inverse=True)[1] if words else np.zeros(0, int)
    found = {}
    for p in range(1, len(words) // fold + 1):
        turn = np.flatnonzero(np.diff(np.concatenate([[0], (ids[:-p] == ids[p:]).astype(int), [0]])))
        for a, b in zip(turn[::2].tolist(), turn[1::2].tolist(), strict=True):
            if b - a + p >= max(least, fold * p):
                found.setdefault((a, b + p), p)
    return sorted((a, b - a, p) for (a, b), p in found.items())


def repeating(rng, letters):
    words = []
    for _ in range(rng.randint(0, 8)):
        unit = [str(rng.randrange(letters)) for _ in range(rng.randint(1, 12))]
        words += (unit * 60)[: rng.randint(1, 60)] if rng.random() < 0.5 else [str(rng.randrange(letters)) for _ in range(rng.randint(1, 20))]
    return words


def test_runs_are_those_of_brute_force():
    rng = random.Random(5)
    for _ in range(400):
        words = repeating(rng, rng.choice([1, 2, 3, 5, 50]))
        assert periodic.find(words) == all_runs(words)
        least, fold = rng.choice([(24, 3), (6, 2), (9, 3)])
        assert periodic.runs_within([int(w) for w in words], least, fold) == all_runs(words, least, fold)
    assert periodic.OVERLAP == 16 and periodic.find(["a"] * 23) == [] and periodic.find(["a"] * 24) == [(0, 24, 1)]
    assert periodic.surviving(np.arange(500)) == []


@needs_tables
def test_op11_equals_brute_force(spark):
    found = {r.doc_id: r for r in queries.op11_periodic_runs(spark, DATA).collect()}
    rows = duckdb.sql(f"SELECT doc_id, text FROM read_parquet('{DATA}/documents.parquet')").fetchall()
    assert len(found) == len(rows)
    for i, text in rows:
        words, h = WORD.findall(text or ""), zlib.crc32(str(i).encode())
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
        runs = all_runs(words)
        best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None,) * 3)
        gone = {k for a, size, p in runs for k in range(a + p, a + size)}
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert tuple(found[i]) == (i, len(runs), *best, 1000 * best[1] // best[2] if runs else None, digest("".join("%d,%d,%d\n" % r for r in runs)), digest(" ".join(w for k, w in enumerate(words) if k not in gone)))


def test_runs_of_nulls_repeats_and_long_texts(spark):
    rows = [(None, None, 1), (None, "a " * 40, 1), (1, "", 1), (1, "", 1), (2, "x y " * 30, 1), (3, "w " * 100_000, 1), (4, " ".join(map(str, range(50_000))), 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs int")
    out = periodic.periodic_runs(docs)
    found = collections.Counter((r.doc_id, r.n_words, tuple(map(tuple, r.runs)), len(r.collapsed)) for r in out.collect())
    assert found == collections.Counter([(None, 0, (), 0), (None, 40, ((0, 40, 1),), 1), (1, 0, (), 0), (1, 0, (), 0), (2, 30, ((0, 30, 1),), 3), (3, 100_000, ((0, 100_000, 1),), 1), (4, 50_000, (), len(rows[6][1]))])
    digests = periodic.run_digests(out)
    assert digests.where("n_runs = 0 AND start IS NULL AND exponent_milli IS NULL AND runs_sha256 IS NOT NULL").count() == 4
    assert periodic.run_digests(periodic.periodic_runs(periodic.planted(docs.limit(0)))).count() == 0
    assert [r.text for r in periodic.planted(docs.where("doc_id IS NULL")).orderBy("text").collect()] == [None, "a " * 40]


def talks(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, depth int")


def brute_trie(by):
    nodes = collections.defaultdict(list)
    for conv, said in by.items():
        for d in range(len(said) + 1):
            nodes[tuple(said[:d])].append(conv)
    last = 1 << 63
    least = {n: min(last if c is None else c for c in m) for n, m in nodes.items()}
    out = []
    for node, members in nodes.items():
        under = [n for n in nodes if n[: len(node)] == node]
        kids = [n for n in under if len(n) == len(node) + 1]
        leaves = sum(all(len(m) <= len(n) or m[: len(n)] != n for m in under) for n in under)
        saved = sum((len(nodes[n]) - 1) * len(n[-1][1]) for n in under if n)
        ends = sorted(last if c is None else c for c in members if len(by[c]) == len(node))
        plain = lambda c: None if c == last else c
        digest = hashlib.sha256(",".join("" if c == last else str(c) for c in ends).encode()).hexdigest()
        out.append((plain(least[node]), len(node), plain(least[node[:-1]]) if node else None, len(members), len(kids), leaves, saved, digest))
    return collections.Counter(out)


@pytest.mark.parametrize("most", [1, 3, 12, 200_000])
def test_tries_of_any_bound_are_those_of_brute_force(spark, most):
    rng = random.Random(3)
    openings = [[("user", "x" * rng.randint(0, 3)) for _ in range(3)] for _ in range(2)]
    by = {c: rng.choice(openings)[: rng.randint(1, 3)] + [("assistant", rng.choice("abc")) for _ in range(rng.randint(0, 4))] for c in [*range(-3, 30), None]}
    by |= {100 + c: [("user", "long")] * 40 for c in range(3)}
    rows = [(c, k, role, text, 9) for c, said in by.items() for k, (role, text) in enumerate(said)]
    assert collections.Counter(map(tuple, prefix_trie.prefix_trie(talks(spark, rows), most).collect())) == brute_trie(by)


def test_tries_of_nulls_ties_and_turnless_members(spark):
    rows = [(None, None, None, None, 1), (5, 1, "user", "b", 1), (5, None, "user", "z", 1), (5, 1, "user", "a", 1), (5, 1, "user", "a", 1), (6, 2**62, "user", "", 1), (7, 0, None, None, 1)]
    by = {None: [("", "")], 5: [("user", "z"), ("user", "a"), ("user", "a"), ("user", "b")], 6: [("user", "")], 7: [("", "")]}
    table = talks(spark, rows)
    assert collections.Counter(map(tuple, prefix_trie.prefix_trie(table).collect())) == brute_trie(by)
    assert prefix_trie.prefix_trie(table.limit(0)).count() == 0
    members, said = prefix_trie.with_shared_openings(prefix_trie.turns(table))
    rebuilt = {}
    for c, was in by.items():
        h = zlib.crc32(str(c).encode()) % 6 if c is not None else 0
        rebuilt[c] = was[h:]  # their blocks' first conversation isn't there
    assert [] in rebuilt.values()
    assert collections.Counter(map(tuple, prefix_trie.trie(members, said).collect())) == brute_trie(rebuilt)


def test_tries_of_more_rows_than_a_batch_are_those_of_brute_force(spark):
    """Groups come to Python in batches of spark.sql.execution.arrow.maxRecordsPerBatch rows, which may cut conversations."""
    rng = random.Random(6)
    by = {c: [("user", rng.choice("ab")) for _ in range(rng.randint(1, 6))] + [("assistant", "c")] * rng.randint(0, 3) for c in range(60)}
    rows = [(c, k, role, text, 9) for c, said in by.items() for k, (role, text) in enumerate(said)]
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        found = [collections.Counter(map(tuple, prefix_trie.prefix_trie(talks(spark, rows), most).collect())) for most in (40, 200_000)]
        said = prefix_trie.turns(talks(spark, rows))
        found.append(collections.Counter(map(tuple, prefix_trie.trie(said.select("conv").distinct(), said, usual_rows=50).collect())))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    assert all(f == brute_trie(by) for f in found)


def test_tries_of_the_greatest_and_least_turns(spark):
    rows = [(1, 2**63 - 1, "user", "z", 1), (1, 2**63 - 2, "user", "y", 1), (1, 0, "user", "x", 1), (1, -(2**63), "user", "b", 1), (1, None, "user", "a", 1)]
    by = {1: [("user", t) for t in "abxyz"]}
    assert collections.Counter(map(tuple, prefix_trie.prefix_trie(talks(spark, rows)).collect())) == brute_trie(by)


PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def plain_spans(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == 1 and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == 2 and not (13 <= len(digits) <= 19 and sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(digits[::-1])) % 10 == 0):
                continue
            if kind == 3 and not 9 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def test_base_spans_are_those_of_the_patterns():
    rng = random.Random(8)
    for _ in range(6000):
        text = "".join(rng.choices(["a", "b.c", "@", ".", "-", "+", "1", "25", "256", "4111 1111-1111 1111", "(", ")", " ", "é", "\n", "+1 (212) 555-0101", "x@y.zz", "_", "%", "4111111111111111"], k=rng.randint(0, 14)))
        assert personal_data.base_spans(text) == plain_spans(text), text
    for text in ("x" * 200_000, "1" * 200_000, "1." * 100_000, "+1" + " " * 200_000, "a@" * 100_000, "@" * 200_000, "1 " * 100_000, "0" * 5000 + "1.1.1.1"):
        personal_data.base_spans(text)
    assert personal_data.base_spans("0" * 5000 + "1.1.1.1") == [(1, 0, 5007)]


def segmentations(n, pairs):
    """All sets of candidates that don't overlap."""
    for size in range(n + 1):
        for some in itertools.combinations(range(len(pairs)), size):
            chosen = sorted(pairs[k].tolist() for k in some)
            if all(a[1] <= b[0] for a, b in itertools.pairwise(chosen)):
                yield some


def test_field_sums_and_choice_equal_enumeration():
    rng = np.random.default_rng(2)
    texts = ["7 a 8", "call 12-34", "1.2", "a@b", "9", "x (5"]
    all_tokens = [personal_data.Tokens(t, 0, len(t)) for t in texts]
    pairs = [t.segments() for t in all_tokens]
    scores = rng.normal(size=(sum(map(len, pairs)), 4)) * 2
    total, chance = personal_data._folded(4, [t.n for t in all_tokens], pairs, scores)
    low = 0
    for k, tokens in enumerate(all_tokens):
        own = scores[low : low + len(pairs[k])]
        sums, hit, top = 0.0, np.zeros_like(own), 0.0
        for some in segmentations(tokens.n, pairs[k]):
            for kinds in itertools.product(range(4), repeat=len(some)):
                value = sum(own[a, c] for a, c in zip(some, kinds, strict=True))
                sums += math.exp(value)
                top = max(top, value)
                for a, c in zip(some, kinds, strict=True):
                    hit[a, c] += math.exp(value)
        assert math.isclose(total[k], math.log(sums)) and np.allclose(chance[low : low + len(own)], hit / sums)
        candidates = [(*pairs[k][a].tolist(), own[a, c], c) for a in range(len(own)) for c in range(4) if own[a, c] > 0]
        chosen = personal_data.best(candidates, tokens.n)
        value = sum(max(s for i, j, s, c in candidates if (i, j, c) == got) for got in chosen)
        assert math.isclose(value, top, abs_tol=1e-12) and all(a[1] <= b[0] for a, b in itertools.pairwise(chosen))
        low += len(own)


def corpus(seed, n):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefghijklmnoprstu", k=rng.randint(2, 9)))

    def card():
        body = "".join(rng.choices("123456789", k=15))
        return next(body + c for c in "0123456789" if personal_data.luhn(body + c))

    make = [lambda: f"{word()}.{rng.randint(1, 99)}@{word()}.{word()}.com", lambda: ".".join(str(rng.randint(1, 255)) for _ in range(4)), card, lambda: f"+1 ({rng.randint(100, 999)}) 555-{rng.randint(1000, 9999)}", lambda: str(rng.randint(10, 10**15)), lambda: f"{rng.randint(1, 99)}.{rng.randint(1, 99)}"]
    return [" ".join([*(word() for _ in range(4)), make[k % len(make)](), *(word() for _ in range(4))]) for k in range(n)]


def test_field_finds_disguised_data_on_held_out_texts(spark):
    train = spark.createDataFrame([(k, t) for k, t in enumerate(corpus(1, 600))], "doc_id long, text string")
    weights = personal_data.fitted(train)
    hits = wrong = all_ = 0
    for text, spans in personal_data.examples(corpus(2, 600)):
        found = set(personal_data.added_spans(text, weights, []))
        hits, wrong, all_ = hits + len(found & set(spans)), wrong + len(found - set(spans)), all_ + len(spans)
    assert hits > 0.93 * all_ and wrong < 0.05 * all_
    rows = [(None, None, 1), (1, "", 1), (1, "", 1), (2, "mail jo [at] host [dot] org now, or a@b.cc", 1), (3, "plain words only", 1), (4, "x" * 100_000 + "1", 1), (5, "12 " * 30_000, 1), (6, "é +1 (212) 555-0101 4111111111111111", 1)]
    out = personal_data.personal_data(spark.createDataFrame(rows, "doc_id long, text string, spans int"), weights, with_text=True)
    found = {r.doc_id: r for r in out.collect()}
    assert out.count() == len(rows) and [tuple(s) for s in found[2].spans] == [("email", 5, 27, False), ("email", 36, 42, True)]
    assert found[2].redacted.endswith("or [email]") and found[3].spans == [] and found[6].redacted == "é [phone] [card]"
    digest = {r.doc_id: r for r in personal_data.span_digests(out).collect()}
    assert digest[3].base_sha256 == hashlib.sha256(b"").hexdigest() and digest[3].spans == "" and digest[2].n_email == 1
    none = personal_data.fitted(train.limit(0))
    assert none is None and personal_data.personal_data(train.limit(0), none).count() == 0


@needs_tables
def test_op13_keeps_every_base_span(spark):
    found = {r.doc_id: r for r in queries.op13_personal_data(spark, DATA).collect()}
    rows = duckdb.sql(f"SELECT doc_id, text FROM read_parquet('{DATA}/documents.parquet')").fetchall()
    assert len(found) == len(rows)
    for i, text in rows:
        base = [f"{personal_data.KINDS[k]}:{a}:{b}" for k, a, b in plain_spans(text or "")]
        r = found[i]
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(b.startswith(k) for b in base) for k in personal_data.KINDS)
        own = r.spans.split(",") if r.spans else []
        assert set(base) <= set(own) and len(own) == len(base) + r.n_added and own == sorted(own, key=lambda s: (personal_data.KINDS.index(s.split(":")[0]), int(s.split(":")[1])))
