import hashlib
import random
import struct
import zlib

import numpy as np
import pytest
import xxhash

from vistra.llm import media_chunks, near_copies, simhash, url_filters, vector_dedup
from vistra.llm.components import components

from .conftest import SCHEMA, rows_of
from .test_text_operators import plain_targets


def closure(n, links):
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return [find(i) for i in range(n)]


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(400 + i, 401 + i) for i in range(40)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = closure(500, [(a, b) for a, b in links if a is not None])
    assert got == {i: want[i] for i in {x for a, b in links if a is not None and a != b for x in (a, b)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- 2: URL filters -----------------------------------------------------------------------------------


def test_url_filters(spark):
    urls = {
        1: "https://www.example.com/en/7?x=1", 2: "http://Sub.COM/en/", 3: "http://example.net/de/8#a", 4: "http://a.net/de/81", 5: "http://notcom/en/", 6: "http://x.org/es/1", 7: None, 8: "no scheme", 9: "ftp://h.example.com/en/8",
        10: "http://a.com/login", 11: "http://ads.doubleclick.com/x", 12: "http://b.org/?q=http://c.com/en/", 13: "http://", 14: "http://example.net/de/8x", 15: "http://com/en/1",
    }
    frame = spark.createDataFrame([(k, v, "w", "r") for k, v in urls.items()], "page_id long, url string, host string, rule string")
    got = {r.page_id: r for r in url_filters.judge(frame).collect()}
    want = {1: ("example.com/en/7", "allow"), 2: ("com/en/", "block"), 3: ("example.net/de/8", "block"), 4: ("net/de/", "allow"), 5: (None, "allow"), 6: ("org/es/", "block"), 7: (None, "allow"), 8: (None, "allow"), 9: ("com/en/", "block"),
            10: (None, "block"), 11: (None, "block"), 12: (None, "allow"), 13: (None, "allow"), 14: ("example.net/de/8", "block"), 15: ("com/en/", "block")}
    assert {k: (r.rule, r.verdict) for k, r in got.items()} == want
    assert (got[2].host, got[2].path) == ("sub.com", "/en/") and (got[7].host, got[7].path, got[12].path) == ("", "", "/")


def test_url_patterns_are_found_by_their_tokens(spark):
    urls = {1: "http://h.com/en/cart/1", 2: "http://en.wikipedia.org/wiki/Login", 3: "http://localhost:80/x", 4: "http://a.org/archive/2020/1", 5: "http://archive.org/details/x", 6: "http://a.org/sitemap-1.xml.gz", 7: "http://best-casino.net/", 8: "http://a.org/cartoon",
            9: "http://a.org/PASSWORD-reset", 10: "http://a.org/password-reset", 11: "http://a.org/page/12/", 12: "http://a.org/page/1200/", 13: "http://ads.a.com/"}
    rows = [(k, v) for k, v in urls.items()] * 2 + [(None, None)]
    frame = spark.createDataFrame(rows, "page_id long, url string")
    got = [(r.page_id, r.verdict) for r in url_filters.judge(frame).collect()]
    blocked = {1, 3, 4, 6, 7, 10, 12, 13}
    assert sorted(got, key=str) == sorted([(k, "block" if k in blocked else "allow") for k, _ in rows], key=str)
    assert url_filters.judge(frame.limit(0)).count() == 0
    index = url_filters.Index(url_filters.PATTERNS)
    for host, path in (url_filters.parts(u) for u in urls.values()):
        plain = [r for r in url_filters.PATTERNS if __import__("re").fullmatch(r.pattern, f"{host}\n{path}", __import__("re").S | __import__("re").A)]
        want = max(plain, key=lambda r: (len(r.name), r.action == "allow", r.name), default=None)
        assert index.match(host, path) == want and len(list(index.candidates(host, path))) < 6


def test_url_index_runs_few_rules():
    rules = tuple(url_filters.Rule("block", f"site{i}.com", "/en/") for i in range(200))
    index = url_filters.Index(rules)
    assert len(list(index.candidates("www.site7.com", "/en/x"))) == 1
    assert index.match("www.site7.com", "/en/x").host == "site7.com" and index.match("site7.com.org", "/en/") is None


# --- 5: SimHash ---------------------------------------------------------------------------------------


def plain_fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_golay_code_is_perfect():
    index = simhash.codewords()
    assert np.bincount(index).tolist() == [2048] * 4096


def test_keys_meet_within_two_bits():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 63, 3000).astype(np.uint64)
    flips = rng.integers(0, 64, (2, 3000)).astype(np.uint64)
    b = a ^ (np.uint64(1) << flips[0]) ^ (np.uint64(1) << flips[1])
    (ra, ka), (rb, kb) = simhash.keys_of(a), simhash.keys_of(b)
    assert len({r for r, _ in set(zip(ra.tolist(), ka.tolist())) & set(zip(rb.tolist(), kb.tolist()))}) == 3000


def brute_components(fps):
    links = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2]
    return closure(len(fps), links)


def test_simhash_equals_brute_force(spark, docs, no_docs):
    rows = rows_of()
    fps = [plain_fingerprint(r[1]) for r in rows]
    root = brute_components(fps)
    least = {}
    for r, c in zip(rows, root, strict=True):
        if r[0] is not None:
            least[c] = min(least.get(c, r[0]), r[0])
    want = sorted((str(r[0]), f"{f:016x}", str(least.get(c))) for r, f, c in zip(rows, fps, root, strict=True))
    got = simhash.near_duplicates(docs)
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got.collect()) == want
    assert simhash.near_duplicates(no_docs).count() == 0


def test_simhash_full_keys_are_linked_too(spark, monkeypatch):
    rng = random.Random(3)
    centre = rng.getrandbits(63)
    fps = [centre ^ (1 << rng.randrange(63)) ^ (1 << rng.randrange(63)) ^ ((1 << rng.randrange(63)) * (i % 2)) for i in range(300)] + [rng.getrandbits(63) for _ in range(50)]
    fps = sorted(set(fps))
    want = brute_components(fps)
    frame = spark.createDataFrame([(f,) for f in fps], "fp long")
    for most in (1, 64):
        monkeypatch.setattr(simhash, "PAIR_GROUP", most)
        got = {r.node: r.component for r in components(simhash.links(frame)).collect()}
        assert [got.get(f, f) for f in fps] == [fps[c] for c in want]


def test_one_document_of_a_group_stays(spark, docs):
    out = simhash.keep_one(docs)
    assert out.columns == docs.columns
    rows = rows_of()
    root = brute_components([plain_fingerprint(r[1]) for r in rows])
    groups = {}
    for r, c in zip(rows, root, strict=True):
        groups.setdefault(c, []).append(r[0])
    want = sorted(str(min((i for i in g if i is not None), default=None)) for g in groups.values())
    assert sorted(str(r.doc_id) for r in out.collect()) == want


def test_near_copies_meet_only_where_they_may_be_similar(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 400)  # texts with a common passage: every pair shares the shingle 7 and about half of its others
    sets = [np.unique(np.r_[7, rng.choice(base, 140, replace=False), rng.integers(0, 1 << 63, 60)]) for _ in range(60)]
    sets += [np.r_[s[:-i], rng.integers(0, 1 << 63, i)] for i in range(1, 46, 3) for s in sets[:2]]  # from nearly equal to not similar enough
    sizes = np.array([len(s) for s in sets])
    marks = near_copies.marks(np.concatenate(sets).astype(np.uint64), sizes)
    rows = [(7, i, i, n, n, m) for i, (n, m) in enumerate(zip(sizes.tolist(), marks.tolist(), strict=True))]
    first = spark.createDataFrame(rows, "shingle long, node long, component long, left long, n long, marks array<long>")
    met = {(r["a"], r["b"]) for r in near_copies.meetings(first, 0.8).collect()}
    common = {(i, j): len(np.intersect1d(sets[i], sets[j])) for j in range(len(sets)) for i in range(j)}
    similar = {(i, j) for (i, j), c in common.items() if c / (sizes[i] + sizes[j] - c) >= 0.8}
    assert similar and similar <= met
    assert len(met) < len(common) / 4  # all pairs met before, which is the square of the group


def test_dedup_stage_removes_near_copies(spark):
    import corpus_pipeline

    def shingled(text):
        w = text.lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    rng = random.Random(11)
    texts = []
    for i in range(40):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice((30, 120, 400)))]
        texts.append(" ".join(words))
        for changes in (1, 2, 5):
            near = list(words)
            for _ in range(changes):
                near[rng.randrange(len(near))] = f"x{rng.randrange(5000)}"
            texts.append(" ".join(near))
    page = [f"p{k}" for k in range(200)]
    texts += [" ".join([*page[:190], f"n{k}", *page[190:]]) for k in range(150)]  # more near copies than a key's pairs would allow
    texts += [None, "", "one two"]
    sets = [shingled(t) if t and t.split() else None for t in texts]
    fps = [plain_fingerprint(t) for t in texts]
    near = [(i, j) for i in range(len(texts)) for j in range(i) if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    assert sum((fps[i] ^ fps[j]).bit_count() > 2 for i, j in near) > 100
    close = [(i, j) for i in range(len(texts)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2]
    root = closure(len(texts), near + close)
    frame = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = sorted(r.doc_id for r in corpus_pipeline.dedup_stage(spark, frame, "").collect())
    assert got == sorted({c: i for i, c in reversed(list(enumerate(root)))}.values())


# --- 7: embeddings ------------------------------------------------------------------------------------


def vectors(n=400, dim=32, seed=2):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim))
    for i in range(0, 120, 3):
        x[i + 1] = x[i] + 0.1 * rng.standard_normal(dim)
    x[200:230] = x[199] + 0.05 * rng.standard_normal((30, dim))
    x[240:260] = x[239]
    return x


def test_embedding_dedup_equals_brute_force(spark):
    x = vectors()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    root = closure(len(x), [(i, j) for i, j in zip(*np.nonzero(near), strict=True) if j < i])
    odd = [(1000, None, 1, 5), (1001, [0.0] * 32, 1, 5), (1002, [float("nan")] * 32, 1, 5), (1003, [1.0, None], 1, 5), (1004, [], 1, 5), (1005, [1.0, 2.0], 1, 5), (None, x[0].tolist(), 1, 5)]
    frame = spark.createDataFrame([(i, v.tolist(), 0, 1) for i, v in enumerate(x)] + odd, "vec_id long, embedding array<double>, label int, n_links int")
    got = {r.vec_id: r for r in vector_dedup.near_duplicates(frame).collect()}
    assert len(got) == len(x) + len(odd)
    links = near.sum(1) - 1
    found = np.array([got[i].n_links for i in range(len(x))])
    assert (found <= links).all() and found.sum() >= 0.99 * links.sum()
    assert np.mean([got[i].component_id == root[i] for i in range(len(x))]) > 0.99
    assert all((got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True) for i in range(1000, 1006))
    assert got[None].n_links == 0
    assert vector_dedup.near_duplicates(frame.limit(0)).count() == 0


def test_repeated_ids_keep_the_links_of_their_own_vectors(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (2, [1.0, 0.01]), (3, [0.0, 2.0]), (3, [-1.0, 0.0])]
    got = vector_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == [(1, 2, 1), (1, 2, 1), (2, 1, 2), (2, 2, 1), (3, 0, 3), (3, 1, 2)]


def test_embedding_recall_at_the_threshold():
    """The count is calibrated on one half of the vectors; pairs at exactly the least cosine of the other half reach it."""
    rng = np.random.default_rng(4)
    x = rng.standard_normal((4000, 64)) * rng.uniform(0.2, 2, 64)  # not the same in all directions
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    tau, m, needed = vector_dedup.calibrate([x[:2000]], 20_000)
    counts = vector_dedup.collisions_of(x[2000:], vector_dedup.partners(x[2000:], 9), tau, m)
    assert needed >= 2 and (counts >= needed).mean() > 0.99


def test_the_count_is_calibrated_on_all_vectors(spark, monkeypatch):
    """5,000 distinct vectors, more than any sample held before: each is measured with its own partner, however the rows are dealt."""
    x = np.random.default_rng(6).standard_normal((5_000, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    seen, calibrated = [], vector_dedup.calibrated

    def watched(n, measure):
        return calibrated(n, lambda tau, m: seen.append((tau, m, measure(tau, m))) or seen[-1][2])

    monkeypatch.setattr(vector_dedup, "calibrated", watched)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "head long, unit array<double>")
    for parts in (2, 5):
        vector_dedup.near_pairs(frame.repartition(parts), len(x))
    assert [sum(found.values()) for _, _, found in seen] == [5_000, 5_000]
    tau, m, _ = seen[0]
    mates = vector_dedup.own_partners(x)
    assert np.allclose((x * mates).sum(1), vector_dedup.LEAST_COSINE)
    counts = vector_dedup.collisions_of(x, mates, tau, m)
    needed = max(1, int(np.sort(counts)[int((1 - vector_dedup.RECALL) * len(counts))]))
    assert [calibrated(len(x), lambda *_, found=found: found)[2] for _, _, found in seen] == [needed, needed]


def test_collisions_are_those_of_query_windows():
    rng = np.random.default_rng(0)
    x, y = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (rng.standard_normal((30, 8)), rng.standard_normal((30, 8))))
    y[:15] = vector_dedup.partners(x[:15])
    tau, m = 1.2, 6
    got = vector_dedup.collisions_of(x, y, tau, m)
    want = np.zeros(30, int)
    for number in range(vector_dedup.SETS):
        u, v = vector_dedup.directions(8, m, number)
        d = ((u[:, :, None] + v[:, None, :]) / np.sqrt(2)).reshape(8, -1)
        p, q = x @ d, y @ d
        for s in (1, -1):
            near = np.abs(p - q) <= vector_dedup.WINDOW
            want += (near & (s * p >= tau)).sum(1) + (near & (s * q >= tau)).sum(1)
    assert np.abs(got - want).max() <= 1 and want.sum() > 100  # single precision may move a projection over an edge


# --- 8: media -----------------------------------------------------------------------------------------


def test_chunks_follow_the_content():
    data = random.Random(1).randbytes(200_000)
    a, b = media_chunks.chunks(data), media_chunks.chunks(b"0123456789" + data)
    assert b"".join(a) == data and len(set(a) & set(b)) > 0.9 * len(a)
    assert all(media_chunks.LEAST <= len(c) <= media_chunks.MOST for c in a[:-1])
    assert [len(c) for c in media_chunks.chunks(bytes(20_000))][:2] == [media_chunks.MOST] * 2


def test_media_round_trip(spark, docs, no_docs, monkeypatch):
    rows = rows_of()
    for most in (1 << 28, 64):  # a full filter sends every chunk through the shared table
        monkeypatch.setattr(media_chunks, "FILTER_LEAST", min(most, 1 << 16))
        monkeypatch.setattr(media_chunks, "FILTER_MOST", most)
        packs, shared = media_chunks.store(docs)
        got = media_chunks.read(packs, shared).collect()
        want = []
        for r in rows:
            b = (r[1] or "").encode()
            p = b + bytes(-len(b) % 64) if b else bytes(64)
            want.append((str(r[0]), len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])))
        assert sorted((str(r.doc_id), r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == sorted(want)
        by = {}
        for r in got:
            by.setdefault(r.payload_sha256, set()).add((r.media_bytes, r.media_sha256, r.feature, r.n_bytes))
        assert all(len(v) == 1 for v in by.values())
        assert shared.count() == shared.select("digest").distinct().count()
        assert sorted((str(r.doc_id), r.text) for r in media_chunks.texts(packs, shared).collect()) == sorted((str(r[0]), r[1] or "") for r in rows)
        # the digest and size are those of the bytes that lie in the tables; the feature is that of the payload
        frames = {bytes(r.digest): bytes(r.chunk) for r in shared.collect()}
        for r in packs.collect():
            _, sizes, digests, away = media_chunks.parse(bytes(r.manifest))
            stored = bytes(r.manifest) + bytes(r.pack) + b"".join(frames[d] for d, s in zip(digests, away, strict=True) if s)
            text = next(x[1] for x in rows if x[0] == r.doc_id) or ""
            payload = media_chunks.payload(text.encode())
            wide = [b >= 128 for b in payload]
            feature = f"chunks={len(sizes)};mean={sum(payload) / len(payload):.4f};peak={max(payload)};zero_crossings={sum(a != b for a, b in zip(wide, wide[1:]))}"
            if r.doc_id is not None:
                assert by[hashlib.sha256(payload).hexdigest()] == {(len(stored), hashlib.sha256(stored).hexdigest(), feature, len(text.encode()))}
    assert media_chunks.media(no_docs).count() == 0


def test_repeated_chunks_lie_on_disk_once(spark):
    rng = random.Random(4)
    page = "".join(rng.choice("abcdefghijklmnop ") for _ in range(60_000))
    frame = spark.createDataFrame([(i, f"{i} {page}") for i in range(8)], "doc_id long, text string").repartition(4)
    packs, shared = media_chunks.store(frame)
    assert sum(len(r.pack) for r in packs.collect()) < 8 * 10_000
    assert 30_000 < sum(len(r.chunk) for r in shared.collect()) < 60_000


def test_filter_grows_with_its_digests():
    assert media_chunks.filter_bits(0) == media_chunks.FILTER_LEAST and media_chunks.filter_bits(1 << 40) == media_chunks.FILTER_MOST
    assert all(media_chunks.FILTER_SHARE * n <= media_chunks.filter_bits(n) < 2 * media_chunks.FILTER_SHARE * n for n in (5_000, 70_000, 1 << 20))


def test_damage_is_noticed():
    import zstandard

    text = b"some words of a text " * 40
    parts = media_chunks.chunks(media_chunks.payload(text))
    head = media_chunks.manifest(len(text), [len(c) for c in parts], [media_chunks.digest(c) for c in parts], [False] * len(parts))
    press = zstandard.ZstdCompressor()
    assert media_chunks.rebuilt(head, press.compress(b"".join(parts)), {}) == (len(text), media_chunks.payload(text))
    for bad in ((head, press.compress(b"?" + b"".join(parts)[1:])), (head[:-1], press.compress(b"".join(parts))), (b"?" + head[1:], b"")):
        with pytest.raises((ValueError, struct.error)):
            media_chunks.rebuilt(*bad, {})


# --- pipeline -----------------------------------------------------------------------------------------


def test_pipeline_equals_its_parts_done_plainly(spark, tmp_path):
    import corpus_pipeline
    from vistra.llm import language_id, secrets, sentencepieces
    from vistra.llm.queries import piece_vocabulary, word_vocabulary

    from collections import Counter

    rows = [r for r in rows_of() if r[0] is not None][:60]  # ids once
    rows[20] = (*rows[20][:1], rows[20][1] + " password=b7db7aa4a5fcc78305 ", *rows[20][2:])
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    frame = spark.createDataFrame(rows, SCHEMA)
    said = {r.doc_id: r for r in language_id.identify(frame, language_id.fit(frame, piece_vocabulary())).collect()}
    kept = [r for r in rows if said[r[0]].lang_pred != "und" and said[r[0]].score >= 0.5 and said[r[0]].fit >= language_id.LEAST_FIT * said[r[0]].n_words]
    root = brute_components([plain_fingerprint(r[1]) for r in kept])
    first = {}
    for r, c in zip(kept, root, strict=True):
        first[c] = min(first.get(c, r[0]), r[0])
    kept = [r for r in kept if r[0] in set(first.values())]
    words = secrets.dictionary(word_vocabulary(), secrets.corpus_words(spark.createDataFrame(kept, SCHEMA)))
    texts = {r[0]: secrets.redacted(r[1], secrets.find(r[1], words)) for r in kept}
    assert "[SECRET]" in texts[20]
    sized = {r[0]: (r[3], len(texts[r[0]].split())) for r in kept}
    hashed = lambda i: int(hashlib.md5(str(i).encode()).hexdigest()[:9], 16)
    total = Counter()
    for source, n in sized.values():
        total[source] += n
    want = Counter()
    for source, n, target in plain_targets(list(total.items())):
        mine = sorted((i for i, (s, _) in sized.items() if s == source), key=hashed)
        whole = min(int(target // n), 3) if n else 0
        rest, upto, edge = target - whole * n if whole < 3 else 0, 0, 0
        for k, i in enumerate(mine):
            before, upto = upto, upto + sized[i][1]
            if upto <= rest or (before <= rest and upto - rest < rest - before):
                edge = k + 1
            else:
                break
        for k, i in enumerate(mine):
            want[i] += min(3, whole + (k < edge))
    encoder = sentencepieces.Encoder(piece_vocabulary())
    assert Counter(r.doc_id for r in got) == +want
    assert all(r.ids == encoder.encode([texts[r.doc_id].encode()])[0].tolist() for r in got)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, frame, str(tmp_path)).columns == frame.columns, name


def test_pipeline_on_odd_tables(spark, no_docs, tmp_path):
    """An empty table gives an empty one; null ids, null texts, repeated rows and columns of the operators' own names do no harm."""
    import corpus_pipeline

    no_docs.write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
    odd = spark.createDataFrame(rows_of(), SCHEMA).withColumnsRenamed({"held_out": "mix", "part": "fp", "size": "tie"})
    odd.write.parquet(f"{tmp_path}/odd/documents.parquet")
    out = corpus_pipeline.run(spark, f"{tmp_path}/odd").collect()
    ids = {r.doc_id for r in out}
    assert all(r.round_trip for r in out) and ids <= {r[0] for r in rows_of()} and not ids & {3, 4, 5, 8, 10, 13}
