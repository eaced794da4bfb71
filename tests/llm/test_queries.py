"""The registered queries, on the smallest supplied tables, against SQL or brute force."""

import collections
import hashlib
import math
import os
import re
import zlib

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from framelode.llm import ann, html_template, media, mixing, packing, quality, queries, simhash, url_filter

from .test_documents import reference_print
from .test_other_tables import reference_verdict

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the supplied tables are needed")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "conversations", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


def run(spark, name):
    return queries.queries()[name](spark, DATA)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, tables, name):
    df = run(spark, name)
    result = tables.execute(queries.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    assert collections.Counter(map(tuple, df.select(*names).collect())) == collections.Counter(result.fetchall())


def test_op1_pages(spark, tables):
    expected = {i: html_template.main_text(source) for i, source in tables.execute("SELECT page_id, html FROM pages").fetchall()}
    rows = run(spark, "op1_html_template").collect()
    assert {r.page_id: r.text for r in rows} == expected and all(r.n_chars == len(r.text) for r in rows)


def test_op2_simhash(spark, tables):
    prints = {i: reference_print(t) for i, t in tables.execute("SELECT doc_id, text FROM documents").fetchall()}
    root = {p: p for p in prints.values()}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for a in root:
        for b in root:
            if (a ^ b).bit_count() <= 4:
                root[find(a)] = find(b)
    least = {}
    for i, p in prints.items():
        least[find(p)] = min(i, least.get(find(p), i))
    found = {r.doc_id: (r.fingerprint, r.component_id) for r in run(spark, "op2_simhash").collect()}
    assert found == {i: (f"{p:016x}", least[find(p)]) for i, p in prints.items()}


def test_op3_is_a_replay_of_the_queue(spark, tables):
    rows = tables.execute("SELECT doc_id, source, text FROM documents").fetchall()
    size = {i: len(WORD.findall(t or "")) for i, _, t in rows}
    of = {i: s for i, s, _ in rows}
    sources = sorted({s for s in of.values() if s is not None}) + ([None] if None in of.values() else [])
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sources)}
    total = {s: sum(n for i, n in size.items() if of[i] == s) for s in sources}
    full, left, target = set(), 1.5 * sum(total.values()), {}
    while True:
        level = left / sum(weight[s] for s in sources if s not in full)
        over = {s for s in sources if s not in full and weight[s] * level > 2 * total[s]}
        if not over:
            break
        full |= over
        left -= sum(2 * total[s] for s in over)
    target = {s: 2 * total[s] if s in full else weight[s] * level for s in sources}
    found = run(spark, "op3_mix_sources").collect()
    assert len(found) == len(rows)
    for r in found:
        assert r.size == size[r.doc_id] and r.source_size == total[of[r.doc_id]] and math.isclose(r.target, target[of[r.doc_id]], rel_tol=1e-9) and r.taken in (0, r.size, 2 * r.size)
    for s in sources:
        assert abs(sum(r.taken for r in found if of[r.doc_id] == s) - target[s]) <= 2 * max(n for i, n in size.items() if of[i] == s)
    # the passes taken are those of the least virtual finish times that fit into the budget
    decided = mixing.decide(mixing.sized(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "source", "text"))).where("size > 0").collect()
    for s in sources:
        own = sorted((r.finish[0], r.size * r.n) for r in decided if r.source == s)
        assert np.allclose([f for f, _ in own], np.cumsum([n for _, n in own]) / target[s])
    passes = sorted((f, e < r.copies, r.size * r.n) for r in decided for e, f in enumerate(r.finish))
    taken = [p for p in passes if p[1]]
    assert sum(n for _, _, n in taken) <= 1.5 * sum(total.values()) + 1e-6 and max(f for f, t, _ in passes if t) <= min((f for f, t, _ in passes if not t), default=math.inf)
    rest = [n for _, t, n in passes if not t]
    assert not rest or sum(n for _, _, n in taken) + rest[0] > 1.5 * sum(total.values()) - 1e-6


def test_op4_recall_where_few_lists_are_probed(spark, tables):
    found = collections.defaultdict(list)
    for r in run(spark, "op4_posting_lists").collect():
        found[r.query_id].append((r["rank"], r.vec_id, r.score))
    rows = tables.execute("SELECT vec_id, embedding FROM embeddings WHERE embedding IS NOT NULL ORDER BY vec_id").fetchall()
    ids, x = np.array([i for i, _ in rows]), np.array([e for _, e in rows], dtype=float)
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    hits = 0
    for q in ids[ids % 50 == 0]:
        s = unit @ unit[ids == q][0]
        s[ids == q] = -2
        top = set(ids[np.argsort(-s)[:5]].tolist())
        mine = sorted(found[q])
        hits += len(top & {v for _, v, _ in mine})
        assert all(abs(score - s[ids == v][0]) < 1e-12 for _, v, score in mine)
    assert hits >= 0.9 * 5 * len(ids[ids % 50 == 0])
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(120, 12))
    y = centres[rng.integers(0, 120, 6000)] + 0.25 * rng.normal(size=(6000, 12))
    y = (y / np.linalg.norm(y, axis=1)[:, None]).astype(np.float32)
    heads = ann.balanced_heads(y, 6000 // ann.LIST_SIZE)
    row, lists = ann.near_heads(y[:200], heads, ann.head_graph(heads))
    assert len(row) < len(heads) * 200 / 3
    table = spark.createDataFrame([(i, v.astype(float).tolist()) for i, v in enumerate(y)], "vec_id long, embedding array<double>")
    mine = collections.defaultdict(set)
    for r in ann.search(table, lambda v: v % 50 == 0).collect():
        mine[r.query_id].add(r.vec_id)
    exact = {q: set(np.argsort(-np.where(np.arange(6000) == q, -2, y @ y[q]))[:5].tolist()) for q in range(0, 6000, 50)}
    assert np.mean([len(exact[q] & mine[q]) / 5 for q in exact]) >= 0.9


def test_op4_tiny_huge_and_collinear_vectors(spark):
    rows = [(i, [2.0**-565 * (i % 7 + 1), 2.0**-565]) for i in range(60)] + [(100 + i, [2.0**660, 2.0**660 * (i + 1)]) for i in range(60)] + [(300, [5e-324, 0.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = {(r.query_id, r["rank"]): r.vec_id for r in ann.search(table, lambda v: v % 50 == 0, ratio=float("inf")).collect()}
    assert [out[0, k] for k in range(1, 6)] == [7, 14, 21, 28, 35] and (300, 1) in out and (100, 5) in out
    line = spark.createDataFrame([(i, [0.1 * (i + 1), 0.3 * (i + 1), 0.7 * (i + 1)]) for i in range(60)], "vec_id long, embedding array<double>")
    dot = lambda a, b: (a[0] * b[0] + a[1] * b[1]) + a[2] * b[2]
    exact = lambda a, b: dot(a, b) / (math.sqrt(dot(a, a)) * math.sqrt(dot(b, b)))
    vectors = {i: [0.1 * (i + 1), 0.3 * (i + 1), 0.7 * (i + 1)] for i in range(60)}
    for q in (0, 50):
        expected = sorted((i for i in vectors if i != q), key=lambda i: (-exact(vectors[q], vectors[i]), i))[:5]  # noqa: B023
        assert [r.vec_id for r in sorted((r for r in ann.search(line, lambda v: v % 50 == 0).collect() if r.query_id == q), key=lambda r: r["rank"])] == expected


def test_op5_digests_and_features(spark, tables):
    texts = {i: (t or "").encode() for i, t in tables.execute("SELECT doc_id, text FROM documents").fetchall()}
    for r in run(spark, "op5_audio_features").collect():
        padded = texts[r.doc_id] + b" " * (-len(texts[r.doc_id]) % 192) or b" " * 192
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(texts[r.doc_id]), len(padded), hashlib.sha256(padded).hexdigest())
        assert r.tail_crc32 == zlib.crc32(padded[-16:]) and r.media_bytes == len(padded) + 44 and r.feature
    # log-mel energies from the definitions: taps, frames, a discrete Fourier transform, triangles over mel
    x = (np.frombuffer(media.pad(texts[min(texts)])[:960], dtype=np.uint8).astype(float) - 128) / 128
    half = np.array([sum(media.TAPS[j] * x[2 * i + j - 8] for j in range(16) if 0 <= 2 * i + j - 8 < len(x)) for i in range((len(x) + 1) // 2)])
    mel = media.log_mel(media.pad(texts[min(texts)])[:960])
    bands = media.mel_bands()
    for k in range(len(mel)):
        frame = np.zeros(media.FFT)
        part = half[k * media.HOP : k * media.HOP + media.FRAME]
        frame[: len(part)] = part * np.hanning(media.FRAME)[: len(part)]
        power = np.array([abs(sum(frame[n] * np.exp(-2j * np.pi * f * n / media.FFT) for n in range(media.FFT))) ** 2 for f in range(media.FFT // 2 + 1)])
        assert np.allclose(mel[k], np.log(power @ bands + 1e-6), atol=1e-8)


def test_op6_urls(spark, tables):
    expected = sorted(repr((i, *reference_verdict(u, url_filter.RULES))) for i, u in tables.execute("SELECT page_id, url FROM pages").fetchall())
    assert sorted(repr((r.page_id, r.host, r.path, r.rule, r.verdict)) for r in run(spark, "op6_url_filter").collect()) == expected


def test_op7_is_a_replay_of_buckets_and_batches(spark, tables):
    words = {i: len(WORD.findall(t or "")) for i, t in tables.execute("SELECT doc_id, text FROM documents").fetchall()}
    lengths = {(i, k): min(2048, n - 2048 * k) for i, n in words.items() for k in range(max(1, -(-n // 2048)))}
    rows = run(spark, "op7_pack_buckets").collect()
    assert {(r.doc_id, r.piece): r.length for r in rows} == lengths and len(rows) == len(lengths)
    bounds = packing.bucket_bounds(collections.Counter(lengths.values()), 8)
    own = collections.Counter()
    for r in rows:
        assert r.bucket == next(b for b in bounds if b >= r.length) and r.padding == r.bucket - r.length and r.start == 2048 * r.piece
        own[r.bucket] += 1
    places = sorted((r.bucket, r.batch, r.place) for r in rows)
    per = {b: max(1, 16384 // max(1, b)) for b in bounds}
    assert places == sorted((b, k // per[b], k % per[b]) for b, n in own.items() for k in range(n))


def test_op9_is_brute_force(spark, tables):
    texts = {i: t or "" for i, t in tables.execute("SELECT doc_id, text FROM documents").fetchall()}
    cast = {i: quality.votes(t) for i, t in texts.items()}
    # expectation-maximisation text by text, with plain numbers
    post = {}
    for i, v in cast.items():
        bad, good = v.count(-1), v.count(1)
        post[i] = (0.1 if bad >= 2 else 0.6 if bad == 1 else 0.9) * 0.9 + 0.1 * (good + 0.5) / (good + bad + 1)
    for _ in range(200):
        share = (sum(post.values()) + 1) / (len(post) + 2)
        rate = []
        for k in range(len(quality.LABELLERS)):
            counts = {(c, x): 0.5 + sum((p if c else 1 - p) for i, p in post.items() if cast[i][k] == x) for c in (0, 1) for x in (-1, 1)}
            rate.append({x: math.log(counts[1, x] / (counts[1, -1] + counts[1, 1])) - math.log(counts[0, x] / (counts[0, -1] + counts[0, 1])) for x in (-1, 1)})
        new = {i: 1 / (1 + math.exp(-max(-40, min(40, math.log(share / (1 - share)) + sum(rate[k][x] for k, x in enumerate(v) if x))))) for i, v in cast.items()}
        moved = max(abs(new[i] - post[i]) for i in post)
        if moved < 1e-9:
            break
        post = new
    rows = run(spark, "op9_weak_labels").collect()
    assert len(rows) == len(texts) and all(abs(r.posterior - post[r.doc_id]) < 1e-6 for r in rows)
    labels = dict(tables.execute("SELECT doc_id, quality FROM labels").fetchall())
    judged = [(r.keep, labels[r.doc_id] == 1) for r in rows if r.doc_id in labels]
    assert np.mean([a == b for a, b in judged]) > 0.9


def test_near_dedup_stage_catches_similar_texts(spark, tables):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, DATA).collect()}
    texts = {i: t or "" for i, t in tables.execute("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall()}
    sets = {i: set(simhash.shingle_hashes(t.encode(), 5).tolist()) for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in texts:
        for b in texts:
            if a < b and (sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])):
                a_, b_ = sorted((find(a), find(b)))
                root[b_] = a_
    assert kept == {find(i) for i in texts}
