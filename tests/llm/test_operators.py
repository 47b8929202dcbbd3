"""Each operator against a plain version on odd cases."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from murmur.llm import bpe, importance, media, mixing, near_dup, ngrams, quality, repeats, secrets, toxicity, warc
from murmur.llm import kernels as K
from tests.llm import common

WORD = re.compile(r"[^\x20\x09-\x0d]+")


def by_id(df):
    return {r.doc_id: r for r in df.collect() if r.doc_id is not None}


def shape(df, docs):
    """Rows and columns hold on repeated and lost rows and on empty tables."""
    twice = common.repeated(docs)
    assert df(twice).count() == twice.count()
    assert df(common.empty(docs)).count() == 0


# --- mixing --------------------------------------------------------------------------------------------------------------------------------


def pfair(q):
    period, done, out = sum(q), [0] * len(q), []
    for t in range(period):
        ready = [((k + 1) * period + q[i] - 1) // q[i] * len(q) + i for i, k in enumerate(done) if k < q[i] and k * period // q[i] <= t]
        i = min(ready) % len(q)
        out.append(i)
        done[i] += 1
    return out


def test_mixing_deviates_by_less_than_a_block(spark):
    parts = mixing.shares({"a": 50, "b": 30, "c": 5}, 15, 200)
    slots = {r.slot0: r.stream for r in mixing.period_table(spark, parts).collect()}
    names = list(parts)
    assert [slots[t] for t in range(200)] == [names[i] for i in pfair(list(parts.values()))]
    seen = Counter()
    for t in range(200):
        seen[slots[t]] += 1
        assert all(abs(seen[s] - parts[s] * (t + 1) / 200) < 1 for s in parts)


def test_mixing_places_every_row(spark):
    docs = common.documents(spark)
    twice = common.repeated(docs)
    out = mixing.mix(twice, mixing.WEIGHTS, block=2).collect()
    assert len(out) == twice.count() and set(docs.columns) <= set(out[0].asDict())
    assert len({r.mix_position for r in out}) == len(out)
    assert all(r.release <= r.slot < r.deadline for r in out)
    assert {r.stream for r in out if r.source is None} == {mixing.OTHER}
    ordered = [r.doc_id for r in mixing.in_order(docs).collect()]
    place = {r.doc_id: r.mix_position for r in mixing.mix(docs, mixing.WEIGHTS).collect()}
    assert [place[i] for i in ordered] == sorted(place.values())
    assert mixing.mix(common.empty(docs), mixing.WEIGHTS).count() == 0
    assert mixing.mix(docs, {"src1": 1.0}, other=0).count() == docs.where("source = 'src1'").count()


def test_shares():
    assert sum(mixing.shares({f"s{i}": 1 for i in range(7)}, 1, 100).values()) == 100
    assert min(mixing.shares({"a": 1e-9, "b": 1}, 0, 10).values()) == 1
    with pytest.raises(ValueError):
        mixing.shares({"a": 0}, 1, 10)


# --- quality and importance ------------------------------------------------------------------------------------------------------------------


def plain_quality(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    seen = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
    marked = {j for k in range(len(w) - 7) if seen[tuple(w[k : k + 8])] > 1 for j in range(k, k + 8)}
    failed = len(w) < 20 or 100 * len(marked) > 30 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(marked), failed


def plain_scores(texts, trusted, n, bits):
    def grams(t):
        b = (t or "").encode()
        return [int(x) for x in ngrams.buckets(np.frombuffer(b, np.uint8), n, bits)]

    raw, target = Counter(), Counter()
    for i, t in enumerate(texts):
        raw.update(grams(t))
        if i in trusted:
            target.update(grams(t))
    size, p, q = 1 << bits, sum(target.values()), sum(raw.values())
    ratio = lambda g: np.log((target[g] + 0.5) / (p + 0.5 * size)) - np.log((raw[g] + 0.5) / (q + 0.5 * size))
    return [(sum(ratio(g) for g in grams(t)), len(grams(t))) for t in texts]


def test_quality(spark):
    texts = common.odd_texts()
    docs, labels = common.documents(spark), common.labels(spark, 20)
    ratio = quality.fit(docs, labels)
    got = by_id(quality.judge(docs, ratio))
    trusted = {r.doc_id for r in ngrams.trusted_ids(labels).collect()}
    want = plain_scores(texts, trusted, quality.WINDOW, ngrams.BITS)
    for i, t in enumerate(texts):
        r, (total, n) = got[i], want[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain_quality(t), i
        assert r.llr == pytest.approx(total / max(n, 1), abs=1e-4)
        assert r.kept == (not r.base_failed and r.llr >= quality.THRESHOLD)
    shape(lambda d: quality.judge(d, ratio), docs)
    assert not quality.fit(docs, common.empty(labels)).any()
    assert not quality.fit(common.empty(docs), labels).any()


def test_importance(spark):
    texts = common.odd_texts()
    docs, labels = common.documents(spark), common.labels(spark, 20)
    target, raw = ngrams.counts(ngrams.marked(docs, labels), importance.WINDOW, importance.BITS)
    rows = importance.keys(docs, ngrams.log_ratio(target, raw)).cache()
    want = plain_scores(texts, {r.doc_id for r in ngrams.trusted_ids(labels).collect()}, importance.WINDOW, importance.BITS)
    for r in rows.collect():
        assert r.log_weight == pytest.approx(want[r.doc_id][0], rel=1e-4, abs=1e-2) and r.sample_key == pytest.approx(r.log_weight + r.gumbel)
    for k in (0, 1, 10, len(texts), len(texts) + 5):
        kept = {r.doc_id for r in importance.top_k(rows, k).collect() if r.kept}
        best = sorted(rows.collect(), key=lambda r: (-round(r.sample_key * 2**20), r.doc_id))[:k]
        assert kept == {r.doc_id for r in best}, k
    shape(lambda d: importance.top_k(importance.keys(d, ngrams.log_ratio(target, raw)), 5), docs)


@pytest.mark.parametrize("k", [0, 1, 4, 11, 12, 13, 24, 30])
def test_top_k_keeps_exactly_k_of_repeated_rows(spark, k):
    rows = spark.createDataFrame([(i // 6, 1.0, 7, 8, 9) for i in range(24)], "doc_id long, sample_key double, key int, tie int, place int").repartition(3)
    out = importance.top_k(rows, k).collect()
    kept = [r.doc_id for r in out if r.kept]
    assert len(out) == 24 and sorted(kept) == [i // 6 for i in range(min(k, 24))]
    assert all((r.key, r.tie, r.place) == (7, 8, 9) for r in out)


def test_mixing_leaves_columns_alone_and_ties_in_order(spark):
    names = ["nth", "_nth", "part", "n", "no", "q", "before", "order", "tie", "slot0", "stream_"]
    rows = [(i // 40, f"src{i % 3}", f"text {i % 5}", *[777] * len(names)) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, " + ", ".join(f"{n} int" for n in names))
    out = [tuple(r) for r in mixing.mix(df, mixing.WEIGHTS).collect()]
    assert len(out) == 120 and all(r[3 : 3 + len(names)] == (777,) * len(names) for r in out)
    again = [tuple(r) for r in mixing.mix(df.repartition(7), mixing.WEIGHTS).collect()]
    assert sorted(out) == sorted(again) and len({r[-1] for r in out}) == 120
    wide = df.withColumn("mix_position", F.lit("mine")).withColumn("stream", F.lit(3))
    kept = mixing.in_order(wide.drop("stream"))
    assert kept.columns == wide.drop("stream").columns and kept.where("mix_position <> 'mine'").count() == 0


def test_top_k_breaks_ties_by_id(spark):
    rows = spark.createDataFrame([(i, 1.0) for i in range(9)] + [(None, 1.0), (100, None)], "doc_id long, sample_key double")
    assert sorted(r.doc_id for r in importance.top_k(rows, 4).collect() if r.kept) == [0, 1, 2, 3]


def test_gumbel_is_uniform_enough():
    g = importance.gumbel(np.arange(20_000), 1)
    assert abs(g.mean() - 0.5772) < 0.05 and abs(g.var() - np.pi**2 / 6) < 0.1


# --- near-duplicates -------------------------------------------------------------------------------------------------------------------------


def plain_groups(docs, words, percent):
    sets = {}
    for i, t in docs:
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


@pytest.mark.parametrize(("words", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates(spark, words, percent):
    rng = random.Random(words)
    texts = common.odd_texts()
    base = common.sentence(rng, 150).split()
    for _ in range(60):  # a group of near copies at many distances
        w = list(base)
        for _ in range(rng.randrange(0, 9)):
            w[rng.randrange(len(w))] = f"z{rng.randrange(99)}"
        texts.append(" ".join(w))
    texts += [" ".join(base)] * 20
    docs = common.documents(spark, texts)
    got = {i: (r.n_shingles, r.component_id, r.kept) for i, r in by_id(near_dup.groups(docs, words, percent)).items()}
    assert got == plain_groups(list(enumerate(texts)), words, percent)


def test_near_duplicates_in_large_nodes(spark, monkeypatch):
    """With small bounds, branching and the star of the last level are used too."""
    for name, value in (("SMALL", 4), ("LARGE", 12), ("FAN", 3), ("FAMILY", 8)):
        monkeypatch.setattr(near_dup, name, value)
    rng = random.Random(9)
    base = common.sentence(rng, 300).split()
    texts = []
    for k in range(70):
        w = list(base)
        w[k % len(w)] = f"z{k}"
        texts.append(" ".join(w))
    texts += [common.sentence(rng, 60) for _ in range(20)]
    got = {i: (r.n_shingles, r.component_id, r.kept) for i, r in by_id(near_dup.groups(common.documents(spark, texts), 3, 85)).items()}
    assert got == plain_groups(list(enumerate(texts)), 3, 85)


def test_near_duplicate_shapes(spark):
    docs = common.documents(spark, common.odd_texts()[:16])
    twice = common.repeated(docs)
    out = near_dup.groups(twice).collect()
    assert len(out) == twice.count()
    lost = [r for r in out if r.doc_id is None]
    assert lost and all(r.component_id is None and r.kept for r in lost)
    assert near_dup.groups(common.empty(docs)).count() == 0
    with pytest.raises(ValueError):
        near_dup.groups(docs, percent=20)


# --- repeated passages -----------------------------------------------------------------------------------------------------------------------


def plain_repeats(docs, least):
    first = {}
    for i, t in docs:
        b = (t or "").encode()
        for k in range(len(b) - least + 1):
            w = b[k : k + least]
            first[w] = min(first.get(w, i), i)
    out = {}
    for i, t in docs:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, np.int32)
        for k in range(len(b) - least + 1):
            if first[b[k : k + least]] < i:
                gone[k] += 1
                gone[k + least] -= 1
        gone = np.cumsum(gone)[: len(b)] > 0
        starts = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(b) else 0
        left = bytes(np.frombuffer(b, np.uint8)[~gone]) if len(b) else b""
        out[i] = (len(b), int(gone.sum()), starts, hashlib.sha256(left).hexdigest())
    return out


@pytest.mark.parametrize(("least", "gram"), [(50, 16), (30, 8), (51, 13)])
def test_repeats(spark, least, gram, monkeypatch):
    monkeypatch.setattr(repeats, "SEGMENT", 1500)  # so that long texts are cut
    monkeypatch.setattr(repeats, "BLOCK", 20_000)
    rng = random.Random(least)
    texts = [t if t is None or len(t) < 30_000 else t[:30_000] for t in common.odd_texts()]
    passages = [common.sentence(rng, rng.randrange(8, 40)) for _ in range(6)]
    for _ in range(60):
        texts.append(common.sentence(rng, rng.randrange(0, 30)) + rng.choice(passages)[rng.randrange(9) :] + common.sentence(rng, 4) + rng.choice(passages))
    got = {i: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for i, r in by_id(repeats.remove_repeats(common.documents(spark, texts).repartition(5), least, gram)).items()}
    want = plain_repeats(list(enumerate(texts)), least)
    assert got == want


def test_repeat_shapes(spark):
    docs = common.documents(spark)
    twice = common.repeated(docs)
    out = repeats.remove_repeats(twice).collect()
    assert len(out) == twice.count()
    assert all(r.n_removed == 0 for r in out if r.doc_id is None)
    once = {i: r.n_removed for i, r in by_id(repeats.remove_repeats(docs)).items()}
    assert {r.doc_id: r.n_removed for r in out if r.doc_id is not None} == once
    assert repeats.remove_repeats(common.empty(docs)).count() == 0
    with pytest.raises(ValueError):
        repeats.remove_repeats(docs, 10, 20)


def test_repeats_of_rows_that_share_an_id(spark):
    rng = random.Random(12)
    p, x, other = (common.sentence(rng, 30) for _ in range(3))
    rows = [(1, p), (2, p + " tail"), (2, x), (2, x), (2, p), (3, x + p), (3, "a" + x), (3, other), (4, other + p), (None, p), (1, other), (5, None), (5, other * 2), (5, "b" + p)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    first = {}
    for i, t in rows:
        b = (t or "").encode() if i is not None else b""
        for k in range(len(b) - 49):
            first[b[k : k + 50]] = min(first.get(b[k : k + 50], i), i)
    want = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, np.int32)
        for k in range(len(b) - 49):
            if i is not None and first[b[k : k + 50]] < i:
                gone[k] += 1
                gone[k + 50] -= 1
        gone = np.cumsum(gone)[: len(b)] > 0
        want.append((i, len(b), int(gone.sum()), hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()))
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.kept_sha256) for r in repeats.remove_repeats(docs.repartition(3)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert {(2, x): 0, (2, p): len(p.encode())} == {(i, t): n for (i, t), n in ((r[:2], w[2]) for r, w in zip(rows, want, strict=True)) if i == 2 and t in (x, p)}


def test_repeats_do_not_rest_on_hashes():
    """A bucket whose strings of 50 bytes all share a hash gives the groups of one whose strings don't."""
    rng = np.random.default_rng(5)
    parts = [rng.integers(97, 100, 70, dtype=np.uint8) for _ in range(12)]
    texts = [np.concatenate([parts[i], parts[j]])[:100] for i in range(6) for j in range(12)]
    size = np.array([len(t) for t in texts])
    args = (np.arange(len(texts)) // 2, np.arange(len(texts)), np.zeros(len(texts), np.int64), size, np.full(len(texts), -1, np.int16), np.concatenate(texts), 50)

    def spans():
        return sorted(zip(*(x.tolist() for x in repeats.repeats_of(*args)), strict=True))

    want, of = spans(), K.Hashes.of
    assert want
    for mask in (0, 1, 15):
        K.Hashes.of = lambda self, start, end, mask=mask: of(self, start, end) & np.uint64(mask)
        try:
            assert spans() == want
        finally:
            K.Hashes.of = of


def test_groups_have_all_occurrences(spark):
    rng = random.Random(3)
    passages = [common.sentence(rng, rng.randrange(10, 30)) for _ in range(4)]
    texts = [common.sentence(rng, 5) + rng.choice(passages) + common.sentence(rng, 3) + rng.choice(passages) for _ in range(25)]
    data = [t.encode() for t in texts]
    out = repeats.repeat_groups(common.documents(spark, texts).repartition(3), 50, 16).collect()
    strings = {r.group: bytes(r.passage) for r in out if r.passage is not None}
    at = {}
    for r in out:
        at.setdefault(r.group, set()).add((r.doc_id, r.start))
    covered = {}
    for g, places in at.items():
        s = strings[g]
        assert len(s) >= 50 and all(data[i][k : k + len(s)] == s for i, k in places) and len({i for i, _ in places}) > 1
        for i, k in places:
            covered.setdefault(i, set()).update(range(k, k + len(s)))
    # every string of 50 bytes that several documents have is inside a group, at each place where it is
    seen = {}
    for i, b in enumerate(data):
        for k in range(len(b) - 49):
            seen.setdefault(b[k : k + 50], set()).add((i, k))
    for s, places in seen.items():
        if len({i for i, _ in places}) > 1:
            inside = [{(i, k - d) for i, k in places} <= at[g] for g in at if (d := strings[g].find(s)) >= 0]
            assert any(inside)
    assert repeats.repeat_groups(common.documents(spark, ["a", None, ""])).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_maximal_repeats(seed):
    rng = random.Random(seed)
    texts = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(0, 40))) for _ in range(5)]
    least = 4
    want = {}
    for t in texts:
        for a, b in itertools.combinations(range(len(t) + 1), 2):
            if b - a >= least:
                want.setdefault(t[a:b], None)
    for s in list(want):
        at = [(i, k) for i, t in enumerate(texts) for k in range(len(t) - len(s) + 1) if t[k : k + len(s)] == s]
        left = {texts[i][k - 1] if k else (i,) for i, k in at}
        right = {texts[i][k + len(s)] if k + len(s) < len(texts[i]) else (i,) for i, k in at}
        diverse = lambda side, ends: len(side) > 1 or ends
        if len(at) > 1 and diverse(left, any(k == 0 for _, k in at)) and diverse(right, any(k + len(s) == len(texts[i]) for i, k in at)):
            want[s] = sorted(at)
        else:
            del want[s]
    got = dict(repeats.maximal_repeats(texts, least))
    assert got == want


# --- media -----------------------------------------------------------------------------------------------------------------------------------


def test_media_round_trip(spark):
    texts = common.odd_texts()
    got = by_id(media.digests(common.documents(spark)))
    for i, t in enumerate(texts):
        b, r = (t or "").encode(), got[i]
        p = media.padded(b)
        assert len(p) % 64 == 0 and len(p) >= 64 and p.startswith(b)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        avi = media.write_avi(p)
        assert (r.media_bytes, r.media_sha256) == (len(avi), hashlib.sha256(avi).hexdigest()) and media.read_payload(avi) == p
    shape(media.digests, common.documents(spark))


def test_all_bytes_survive():
    rng = np.random.default_rng(1)
    for n in (64, 128, 4096, 4160, 70_000 // 64 * 64):
        p = rng.integers(0, 256, n, dtype=np.uint8).tobytes()
        assert media.read_payload(media.write_avi(p)) == p
    with pytest.raises(ValueError):
        media.write_avi(b"x")


def test_index_and_shots(spark):
    dark, light = bytes([10] * 4096), bytes([240] * 4096)
    avi = media.write_avi(dark * 5 + light * 3 + dark * 2)
    info = media.parse_avi(avi)
    assert len(info["frames"]) == 10 and info["fps"] == 25 and (info["width"], info["height"]) == (512, 512)
    assert [avi[at : at + 2] for at, _ in info["frames"]] == [b"\xff\xd8"] * 10
    assert [(c[1], c[2]) for c in media.clips(avi)] == [(0, 5), (5, 3), (8, 2)]
    rows = media.clip_rows(spark.createDataFrame([(1, bytearray(avi)), (2, None)], "doc_id long, media binary")).collect()
    assert [(r.clip, r.start_s, r.end_s) for r in rows] == [(0, 0.0, 0.2), (1, 0.2, 0.32), (2, 0.32, 0.4)]
    assert media.media_column(common.documents(spark)).where("media is null").count() == 0


# --- BPE -------------------------------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def vocabulary():
    import tiktoken

    ranks, pattern = bpe.default_vocabulary()
    return ranks, pattern, tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_the_library(spark, vocabulary, monkeypatch):
    ranks, pattern, library = vocabulary
    texts = [*common.odd_texts(), "<|endoftext|>", "á  x   y", "🙂🙂 👩‍👩‍👧", "I'll we've DON'T", "1234567890" * 30, "ſ K Å", "\n\n \n  x   ", "abcabc" * 3000]
    docs = common.documents(spark, texts)
    got = by_id(bpe.digests(docs, ranks, pattern))
    for i, t in enumerate(texts):
        ids = library.encode_ordinary(t or "")
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()), i
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    shape(lambda d: bpe.digests(d, ranks, pattern), docs)


def test_forgetting_words_changes_nothing(vocabulary):
    import pyarrow as pa

    ranks, pattern, library = vocabulary
    rng = random.Random(4)
    texts = [common.sentence(rng, 50) + f" w{k}x{k * 7}" for k in range(50)]
    batches = [pa.RecordBatch.from_pydict({"doc_id": [k], "text": [t]}) for k, t in enumerate(texts)]
    got = [ids.tolist() for _, ids, _ in bpe.encoder(ranks, pattern, words=20)(iter(batches))]
    assert got == [library.encode_ordinary(t) for t in texts]


def test_higher_order_fold_equals_the_library(spark, vocabulary):
    ranks, pattern, library = vocabulary
    words = sorted({w for t in common.odd_texts()[:20] if t for w in re.findall(r" ?\w+|[^\w\s]+", t) if len(w) < 40})[:150]
    rows = bpe.encode_words(spark.createDataFrame([(w,) for w in words], "word string"), ranks).collect()
    for r in rows:
        want = library._encode_single_piece(r.word.encode()) if hasattr(library, "_encode_single_piece") else library.encode_ordinary(r.word)
        assert [ranks[bytes.fromhex(p)] for p in r.pieces] == want
    docs = common.documents(spark, ["naïve 東京 token", None])
    back = bpe.encode(docs, ranks, pattern).select("doc_id", bpe.decode_column(F.col("ids"), ranks).alias("b")).collect()
    assert {r.doc_id: bytes(r.b).decode() for r in back} == {0: "naïve 東京 token", 1: ""}


# --- secrets ---------------------------------------------------------------------------------------------------------------------------------


def plain_secrets(text):
    found = []
    for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 8:
            found.append((m.start(), 0, m.end()))
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(found)


SECRETS = [
    "password: token: abcdefghij", "token=secret=abcdefgh1234", "AKIAAKIAAKIAAKIA1", "AKIA123 AKIA" + "Z" * 12, "api_key  :  'abc.def-ghi=='", "\U0001f642 secret = \"ÀabcdefghiÀ\"", "f" * 32 + "g" + "0" * 31,
    "TOKEN='" + "a" * 40 + "' passwd=12345678", "key 9fK2xQ7pLw8ZtR4vB6nM1cY3 here", "ordinaryidentifierwithoutdigits plainwordsjoinedtogether",
]


def test_secrets(spark):
    texts = common.odd_texts() + SECRETS
    docs, labels = common.documents(spark, texts), common.labels(spark, len(texts))
    rng = random.Random(8)
    model = secrets.fit(common.documents(spark, [common.sentence(rng, 80) for _ in range(60)]), common.labels(spark, 60))
    got = by_id(secrets.report(docs, model))
    extra = 0
    for i, t in enumerate(texts):
        base = plain_secrets(t or "")
        names = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in base)
        r, n = got[i], Counter(k for _, k, _ in base)
        assert (r.n_assign, r.n_access, r.n_hex, r.base_sha256) == (n[0], n[1], n[2], hashlib.sha256(names.encode()).hexdigest()), (i, t)
        spans = r.spans.split(",") if r.spans else []
        assert [s for s in spans if not s.startswith("markov")] == (names.split(",") if names else [])
        extra += any(s.startswith("markov") for s in spans)
        if t == SECRETS[-2]:
            assert spans == ["markov:4:28"]
        if t == SECRETS[-1]:
            assert not spans
    shape(lambda d: secrets.report(d, model), docs)
    masked = secrets.redact(docs, model)
    assert masked.columns == docs.columns and masked.count() == docs.count()
    row = {r.doc_id: r for r in masked.collect()}
    at = texts.index(SECRETS[1])
    assert row[at].text == "[secret]" and row[at].n_chars == 8 and row[0].text is None
    assert secrets.redact(docs.withColumn("spans", F.lit("mine")), model).where("spans <> 'mine'").count() == 0
    assert len(secrets.fit(docs, common.empty(labels))) == len(secrets.ALPHABET) ** 2


# --- WARC ------------------------------------------------------------------------------------------------------------------------------------


def pages(spark):
    big = "<p>" + "x" * 200
    rows = [(5, "u5", big), (2, "u2", big), (9, None, big), (2, "u2", big), (1, "s", "short"), (3, "s", "short"), (4, "é\"\n", None), (6, "", ""), (None, "n", big), (7, "y", "ü" * 400_000), (8, "y", "ü" * 400_000)]
    return spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")


def test_warc(spark):
    bundles = warc.bundles(pages(spark))
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.records(bundles).collect()), key=str)
    first = {}
    rows = [(r.page_id, (r.html or "").encode()) for r in pages(spark).collect()]
    for k, b in rows:
        if len(b) >= 100 and k is not None:
            first[b] = min(first.get(b, k), k)
    want = sorted(((k, len(b), hashlib.sha256(b).hexdigest(), *(("revisit", first[b]) if k is not None and first.get(b, k) < k else ("response", None))) for k, b in rows), key=str)
    assert got == want
    assert warc.records(warc.bundles(common.empty(pages(spark)))).count() == 0


def test_bundles_are_seekable_and_valid_streams():
    import zstandard

    b = warc.Bundle(frame_bytes=1000)
    data = {str(k): warc.record(k, f"http://x/{k}", bytes([65 + k % 26]) * (37 * k % 900), "d", None) for k in range(80)}
    for k, v in data.items():
        b.add(k, v)
    whole = b.finish()
    r = warc.Reader(whole)
    assert len(r.frames) > 5 and dict(r.records()) == data and r.get("41") == data["41"] and r.get("x") is None
    # any reader of Zstandard streams gets the records in order
    out = zstandard.ZstdDecompressor().stream_reader(whole, read_across_frames=True).read()
    assert out == b"".join(data.values())
    headers, body = warc.parse(data["3"])
    assert headers["WARC-Type"] == "response" and len(body) == 111


# --- toxicity --------------------------------------------------------------------------------------------------------------------------------

INSULTS = ["idiot", "clown", "worthless", "pathetic", "disgusting"]


def toxic_corpus(seed, n, misspell=False):
    rng = random.Random(seed)
    texts, marks = [], []
    for i in range(n):
        w = common.sentence(rng, rng.randrange(20, 120)).split()
        y = i % 3 == 0
        for _ in range(3 if y else 0):
            x = rng.choice(INSULTS)
            if misspell:
                k = rng.randrange(1, len(x) - 1)
                x = x[:k] + rng.choice("xzq") + x[k + 1 :]
            w.insert(rng.randrange(len(w)), x)
        texts.append(" ".join(w))
        marks.append(y)
    return texts, marks


def test_toxicity_on_held_out_and_misspelt(spark):
    texts, marks = toxic_corpus(1, 450)
    docs, labels = common.documents(spark, texts), common.labels(spark, 450, lambda i: marks[i])
    model = toxicity.fit(docs, labels)
    rows = by_id(toxicity.score(docs, model))
    held = [i for i in range(450) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert [i for i in rows if rows[i].held_out] == held or {i for i in rows if rows[i].held_out} == set(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows.values())
    right = lambda ids, y: sum(rows[i].predicted == y[i] for i in ids) / len(ids)
    assert right(held, marks) > 0.95
    odd, odd_marks = toxic_corpus(2, 150, misspell=True)
    rows = by_id(toxicity.score(common.documents(spark, odd), model))
    assert right(range(150), odd_marks) > 0.9
    kept = toxicity.reject(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.select("doc_id").collect()} == {r.doc_id for r in toxicity.score(docs, model).where("predicted = 0").collect()}


def plain_score(text, model):
    """The softmax's toxic share of the best passage, word by word and n-gram by n-gram."""
    words = re.findall(rb"[a-z0-9\x80-\xff]+", text.lower())
    means = []
    for w in words:
        grams = [(b" " + w + b" ")[k : k + n] for n in toxicity.GRAMS for k in range(len(w) + 3 - n)]
        bucket = lambda g: (int.from_bytes(g, "little") * 0x9E3779B97F4A7C15 % 2**64) >> (64 - toxicity.BITS)
        means.append(sum(float(model.value[bucket(g)]) for g in grams) / max(1, len(grams)))
    passages = [means[k : k + model.words] for k in range(0, len(means), model.words)]
    best = max((sum(p) / len(p) for p in passages), default=0.0)
    return 1 / (1 + np.exp(-np.clip(model.slope * best + model.shift, -50, 50)))


@pytest.mark.parametrize("words", [1, 2, 5])
def test_toxicity_equals_a_plain_score(spark, words):
    texts, marks = toxic_corpus(7, 120)
    model = toxicity.train([(int(y), t.encode()) for t, y in zip(texts, marks, strict=True)], words=words)
    docs = common.documents(spark, [t for t in common.odd_texts() + texts[:30] if not t or len(t) < 5000])
    for r in docs.join(toxicity.score(docs, model).select("doc_id", "score"), "doc_id").collect():
        assert r.score == pytest.approx(plain_score((r.text or "").encode(), model), abs=1e-6), r.doc_id


def test_passage_places():
    texts = [b"one two three, four", b"", b"  five", "é à ü ö".encode()]
    data, offsets = toxicity.joined(texts)
    _, place, at = toxicity.logits(data, offsets, np.zeros(1 << toxicity.BITS, np.float32), 2)
    assert at.tolist() == [0, 2, 2, 3, 5]
    assert [data[a:b].tobytes().decode() for a, b in place] == ["one two", "three, four", "five", "é à", "ü ö"]


def test_toxicity_sample_is_bounded(spark, monkeypatch):
    texts, marks = toxic_corpus(8, 60)
    docs, labels = common.documents(spark, texts), common.labels(spark, 60, lambda i: marks[i])
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 8000)
    rows = toxicity.sample(docs, labels)
    assert 0 < sum(len(t) for _, t in rows) <= 8000 and {y for y, _ in rows} == {0, 1}
    assert all(t.decode() in texts for _, t in rows)


def test_toxicity_learns_from_allowed_rows_only(spark):
    texts, marks = toxic_corpus(3, 60)
    docs = common.documents(spark, texts)
    held = {i for i in range(60) if zlib.crc32(str(i).encode()) % 3 == 1}
    a = toxicity.sample(docs, common.labels(spark, 60, lambda i: marks[i]))
    b = toxicity.sample(docs, common.labels(spark, 60, lambda i: marks[i] != (i in held)))
    assert a == b
    assert len(a) == 60 - len(held)


def test_toxicity_shapes(spark):
    docs = common.documents(spark)
    model = toxicity.fit(docs, common.labels(spark, 20))
    shape(lambda d: toxicity.score(d, model), docs)
    none = toxicity.fit(docs, common.empty(common.labels(spark, 5)))
    assert toxicity.score(docs, none).where("predicted = 1").count() == 0
    assert toxicity.fit(common.empty(docs), common.labels(spark, 5)).value.any() == np.False_


# --- words made to collide under polynomial hashes -------------------------------------------------------------------------------------------


def thue_morse(n):
    """A word of n letters and its complement, which polynomial hashes modulo a power of two can't tell apart."""
    bits = [0]
    while len(bits) < n:
        bits += [1 - x for x in bits]
    return "".join("ab"[x] for x in bits), "".join("ba"[x] for x in bits)


@pytest.mark.parametrize("n", [1024, 2048, 4096])
def test_words_that_collide(spark, n):
    a, b = thue_morse(n)
    texts = [a, b, a + " " + b, a + "\n" + b + "\n" + a, f"{a} x y", f"{b} x y", " ".join([a, b] * 10), "q w e r t y u " + a + " q w e r t y u " + b]
    docs = common.documents(spark, texts)
    got = by_id(quality.judge(docs, np.zeros(1 << ngrams.BITS, np.float32)))
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain_quality(t), i
    got = {i: (r.n_shingles, r.component_id, r.kept) for i, r in by_id(near_dup.groups(docs, 3, 85)).items()}
    assert got == plain_groups(list(enumerate(texts)), 3, 85)


@pytest.mark.parametrize("mask", [0, 3, 0xFF])
def test_counts_do_not_rest_on_hashes(monkeypatch, mask):
    of = K.Hashes.of
    monkeypatch.setattr(K.Hashes, "of", lambda self, start, end: of(self, start, end) & np.uint64(mask))
    texts = [(t or "").encode() for t in common.odd_texts() if not t or len(t) < 20_000]
    got = quality.base_counts(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
    for i, t in enumerate(texts):
        assert tuple(int(got[k][i]) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == plain_quality(t.decode())[:5], i


def test_exact_sets_compare_words():
    rng = random.Random(6)
    texts = [" ".join(rng.choice("abcdefgh") * rng.randrange(1, 4) for _ in range(rng.randrange(0, 40))).encode() for _ in range(50)]
    for words in (1, 3, 5, 30):
        sets = near_dup.exact_sets(texts, words)
        plain = [{tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set() for w in (t.split() for t in texts)]
        assert [len(s) for s in sets] == [len(s) for s in plain]
        for x, y in itertools.combinations(range(50), 2):
            assert len(np.intersect1d(sets[x], sets[y])) == len(plain[x] & plain[y])


def test_trees_reach_their_recall():
    for percent in (80, 85, 90, 100):
        s = percent / 100
        assert 1 - (1 - s**near_dup.LEVELS) ** near_dup.trees_for(percent) >= near_dup.RECALL
