"""Operators over documents against brute force, and on nulls, empty tables, repeated rows and clashing columns."""

import collections
import hashlib
import random
import re

import numpy as np
import xxhash

from framelode.llm import media, mixing, packing, quality, simhash, suffix_dedup

RNG = random.Random(5)
VOCABULARY = ["".join(RNG.choices("abcdefghijklmnop", k=RNG.randint(2, 9))) for _ in range(400)]
PASSAGE = " ".join(VOCABULARY[:45])


def prose(n):
    return " ".join(RNG.choices(VOCABULARY, k=n))


BASE = [prose(RNG.randint(30, 300)) for _ in range(40)]
ROWS = (
    [(i, t, f"s{i % 5}") for i, t in enumerate(BASE)]
    + [(100 + i, t, None) for i, t in enumerate(BASE[:6])]
    + [(200 + i, BASE[7].replace(BASE[7].split()[3 * i], "changed", 1), "s1") for i in range(8)]
    + [(300 + i, f"{prose(20)} {PASSAGE} {prose(20)}", "s2") for i in range(5)]
    + [(400, None, "s3"), (401, "", None), (402, " \t\n", "s4"), (403, "Word", "s4"), (None, prose(50), "s0"), (403, "Word", "s4"), (404, "aé" * 300, "s1"), (405, "x " * 4000, "s0"), (406, PASSAGE + " " + PASSAGE, "s0")]
)


def reference_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64(s.encode(), seed=42).intdigest()
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if counts[b] * 2 > len(shingles))


def test_simhash_is_brute_force(docs):
    rows = simhash.near_duplicates(docs(ROWS)).collect()
    assert len(rows) == len(ROWS)
    prints = collections.defaultdict(set)
    for i, t, _ in ROWS:
        prints[i].add(reference_print(t))
    for r in rows:
        assert r.fp & (1 << 64) - 1 in prints[r.doc_id]
    nodes = sorted({p for s in prints.values() for p in s})
    root = {p: p for p in nodes}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for a in nodes:
        for b in nodes:
            if (a ^ b).bit_count() <= 4:
                root[find(a)] = find(b)
    least = {}
    for i, t, _ in ROWS:
        k = find(reference_print(t))
        least[k] = min(x for x in (least.get(k), i) if x is not None) if i is not None or k in least else None
    for r in rows:
        assert r.component_id == least[find(r.fp & (1 << 64) - 1)]


def test_simhash_empty_and_allocation(docs):
    assert simhash.near_duplicates(docs([])).count() == 0
    parts = simhash.allocate(np.full((16, 5), 0.2), 10**6, 4)
    assert sum(t + 1 for _, _, t in parts) == 5


def test_deduplicated_keeps_least_ids(docs):
    table = docs(ROWS)
    kept = simhash.deduplicated(table)
    assert kept.columns == table.columns
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len(set(ids)) and not {100, 101, 105} & set(ids) and {0, 1, 5} <= set(ids)


def reference_removal(rows, length=200):
    counts = collections.Counter()
    data = [(t or "").encode() for _, t, _ in rows]
    for b in data:
        counts.update(b[i : i + length] for i in range(len(b) - length + 1))
    out = []
    for (i, _, _), b in zip(rows, data, strict=True):
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if counts[b[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        runs = len(re.findall(b"\1+", bytes(gone)))
        out.append((i, len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return collections.Counter(out)


def test_suffix_dedup_is_brute_force(docs):
    rows = suffix_dedup.removal(docs(ROWS)).collect()
    assert collections.Counter(tuple(r) for r in rows) == reference_removal(ROWS)


def test_suffix_dedup_on_small_alphabets(docs):
    rng = random.Random(3)
    rows = [(i, "".join(rng.choices("ab", k=rng.randint(150, 900))), "s") for i in range(12)]
    rows += [(50, rows[0][1][50:] + rows[1][1], "s"), (51, "ab" * 300, "s"), (52, "b" + "ab" * 150, "s"), (53, "a" * 1000, "s")]
    found = suffix_dedup.removal(docs(rows)).collect()
    assert collections.Counter(tuple(r) for r in found) == reference_removal(rows)
    assert suffix_dedup.removal(docs([])).count() == 0


def test_long_texts_are_cut_in_chunks(docs, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK", 500)
    data = np.frombuffer("".join(VOCABULARY).encode(), dtype=np.uint8)
    at, first, last, _ = suffix_dedup.contexts(data, np.array([0, len(data)]), 200)
    assert (last - first + 1).sum() == len(data) - 199 and (at >= first).all() and (at - first <= 136).all()


def test_cut_documents_keeps_rows_and_columns(docs):
    table = docs(ROWS)
    out = suffix_dedup.cut_documents(table)
    assert out.columns == table.columns and out.count() == len(ROWS)
    by = {r.doc_id: r for r in out.collect()}
    assert by[0].text == "" and by[0].n_chars == 0 and by[400].text is None and by[20].text == BASE[20]
    assert PASSAGE not in by[301].text and by[301].text


def test_mix_reaches_targets(docs):
    rows = [(i, prose(20), f"s{i % 3}") for i in range(600)] + [(1000 + i, prose(20), None) for i in range(100)] + [(2000, None, "s0"), (2001, prose(10), "s1"), (2001, prose(10), "s1")]
    once = mixing.decide(mixing.sized(docs(rows))).collect()
    assert sorted(once) == sorted(mixing.decide(mixing.sized(docs(rows))).collect())
    by = collections.defaultdict(list)
    for r in once:
        by[r.source].append(r)
    total = sum(r.size * r.n for r in once)
    assert abs(sum(v[0].target for v in by.values()) - 1.5 * total) < 1e-6 * total
    weights = dict(zip([*sorted(s for s in by if s is not None), None], [3, 1, 2, 3], strict=True))
    for s, v in by.items():
        size, target = v[0].source_size, v[0].target
        assert size == sum(r.size * r.n for r in v) and target <= 2 * size + 1e-6
        assert abs(sum(r.copies * r.size * r.n for r in v) - target) <= 60, (s, weights)
        assert all(0 <= r.copies <= 2 for r in v)
    assert mixing.decide(mixing.sized(docs([]))).count() == 0
    assert mixing.decide(mixing.sized(docs([(1, None, None)]))).first().copies == 1


def test_mixed_documents_have_the_columns(docs):
    table = docs(ROWS)
    out = mixing.mixed_documents(table)
    counts = collections.Counter(r.doc_id for r in out.collect())
    assert out.columns == table.columns and max(counts.values()) <= 4 and counts[400] == 1
    assert mixing.mixed_documents(docs([])).count() == 0


def test_bounds_are_optimal():
    from itertools import combinations

    rng = random.Random(1)
    for _ in range(30):
        lengths = [rng.randint(0, 30) for _ in range(20)]
        h = collections.Counter(lengths)
        values = sorted(h)
        cost = lambda bounds: sum(n * (next(b for b in bounds if b >= k) - k) for k, n in h.items())  # noqa: B023, E731
        best = min(cost([*c, values[-1]]) for k in range(4) for c in combinations(values[:-1], k))
        found = packing.bucket_bounds(dict(h), 4)
        assert cost(found) == best and len(found) <= 4
    assert packing.bucket_bounds({}, 3) == []


def test_pack_holds_every_word_within_budget(docs):
    rows = packing.pack(docs(ROWS), max_words=100, buckets=3, batch_words=400, with_text=True).collect()
    words = collections.Counter()
    for r in rows:
        assert r.length <= r.bucket and r.padding == r.bucket - r.length and len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) == r.length
        words[r.doc_id] += r.length
    expected = collections.Counter()
    for i, t, _ in ROWS:
        expected[i] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert all(words[i] == n for i, n in expected.items())
    for (bucket, _), n in collections.Counter((r.bucket, r.batch) for r in rows).items():
        assert n * bucket <= 400 or n == 1
    assert len({(r.bucket, r.batch, r.place) for r in rows}) == len(rows)
    assert packing.pack(docs([])).count() == 0
    plain = packing.pack(docs(ROWS), max_words=100, buckets=3, batch_words=400).collect()
    assert sorted((r.doc_id or -1, r.piece, r.length, r.bucket) for r in plain) == sorted((r.doc_id or -1, r.piece, r.length, r.bucket) for r in rows)


def test_media_round_trip(docs):
    rows = media.digests(media.audio_features(media.store(docs(ROWS)))).collect()
    assert len(rows) == len(ROWS)
    texts = {i: (t or "").encode() for i, t, _ in ROWS if i != 403}
    features = collections.defaultdict(set)
    for r in rows:
        if r.doc_id in texts:
            padded = media.pad(texts[r.doc_id])
            assert len(padded) % 192 == 0 and (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(texts[r.doc_id]), len(padded), hashlib.sha256(padded).hexdigest())
            assert r.media_sha256 == hashlib.sha256(media.to_wav(padded)).hexdigest()
            features[texts[r.doc_id]].add(r.feature)
    assert all(len(v) == 1 for v in features.values())
    assert media.digests(media.audio_features(media.store(docs([])))).count() == 0


def test_audio_parts():
    rng = np.random.default_rng(0)
    x = rng.normal(size=501)
    direct = np.convolve(np.concatenate([np.zeros(8), x, np.zeros(9)]), media.TAPS[::-1], "valid")[: 2 * 251 : 2]
    assert np.allclose(media.resample(x), direct)
    f = media.features(rng.integers(0, 256, 40_000, dtype=np.uint8).tobytes())
    assert f["tensors"].shape[1:] == (media.POOL, media.MELS) and (media.read_tensors(media.tensor_column(f["tensors"])) == f["tensors"]).all()
    assert len(f["spans"]) == len(f["tensors"]) and all(b > a for a, b in f["spans"])
    energy = np.array([0, 0, 1, 0.5, 0.2, -1, -1, 0.2, 1, 1, 0, -1, 0.0])
    assert media.segments(energy) == [(2, 5), (8, 10)]


def test_quality_learns_without_labels(docs):
    good = [(i, ". ".join(f"The {prose(8)} and {prose(6)} of it" for _ in range(8)) + ".", "s") for i in range(120)]
    bad = [(1000 + i, " | ".join(w.upper() + "%%%" for w in prose(60).split()), "s") for i in range(30)] + [(2000 + i, f"{prose(1)} " * 80, "s") for i in range(20)]
    table = docs(good + bad + [(3000, None, "s"), (3001, "", None), (3002, "Fine.", "s"), (3002, "Fine.", "s")])
    rows = {r.doc_id: r for r in quality.classify(table, sample=100).collect()}
    assert all(rows[i].keep for i, _, _ in good) and not any(rows[i].keep for i, _, _ in bad)
    assert rows[3002].keep and quality.classify(table).columns == [*table.columns, "posterior", "score", "keep"]
    assert quality.good_documents(docs([])).count() == 0


def test_expectation_maximisation_finds_accuracies():
    rng = np.random.default_rng(2)
    accuracy = np.linspace(0.6, 0.95, len(quality.LABELLERS))
    truth = rng.random(4000) < 0.7
    votes = np.where(rng.random((4000, len(accuracy))) < accuracy, truth[:, None], ~truth[:, None]) * 2 - 1
    patterns = [quality.pattern(tuple(v)) for v in votes]
    table, share, posterior = quality.expectation_maximisation(collections.Counter(patterns))
    assert abs(share - 0.7) < 0.05 and np.abs(table[:, 1, 1] - accuracy).max() < 0.05
    assert np.mean([(posterior[p] > 0.5) == t for p, t in zip(patterns, truth, strict=True)]) > 0.95
    assert quality.unpattern(quality.pattern((1, -1, 0, 1, 0, 0, -1, 1, 1, 0))) == [2, 0, 1, 2, 1, 1, 0, 2, 2, 1]


def test_deduplicated_keeps_each_component(docs):
    texts = [prose(60) for _ in range(12)]
    rows = [(None, t, "s") for t in texts[:6]] + [(7, t, "s") for t in texts[6:9]] + [(8, texts[9], "s"), (9, texts[9], "s"), (9, texts[10], "s")] + [(None, texts[11], "s")] * 3
    kept = [(r.doc_id, r.text) for r in simhash.deduplicated(docs(rows)).collect()]
    expected = [(None, t) for t in texts[:6]] + [(7, t) for t in texts[6:9]] + [(8, texts[9]), (9, texts[10]), (None, texts[11])]
    assert collections.Counter(kept) == collections.Counter(expected)


def test_suffix_dedup_tells_texts_without_ids_apart(docs):
    rng = random.Random(11)
    rows = [(None if i % 2 else 1, " ".join(rng.choices(VOCABULARY, k=rng.randint(5, 40))) + PASSAGE, "s") for i in range(2000)]
    found = suffix_dedup.removal(docs(rows)).collect()
    assert collections.Counter(tuple(r) for r in found) == reference_removal(rows)
    cut = suffix_dedup.cut_documents(docs(rows)).collect()
    assert collections.Counter(hashlib.sha256(r.text.encode()).hexdigest() for r in cut) == collections.Counter(r[4] for r in reference_removal(rows).elements())


def test_function_words_of_long_texts_are_all_counted():
    at = quality.LABELLERS.index("function_words")
    for n in (3998, 4000, 4002, 20_000):
        assert quality.votes("word the " * (n // 2))[at] == 1 and quality.votes("the word " * (n // 2))[at] == 1
        assert quality.votes(("THE " + "word " * 19) * (n // 20))[at] == 0
    few = ["word"] * 4001
    few[1:4001:2] = ["the"] * 39 + ["word"] * 1961
    assert quality.votes(" ".join(few))[at] == -1 and quality.votes(" ".join(few[:3999]))[at] == -1
    assert quality.shape("x" * 64 + "%") == "x%" and quality.shape("ab" * 500 + "9" * 500 + "!") == "x9!"
