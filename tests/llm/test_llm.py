"""Small fixtures for every operator: nulls, empty and long texts, repeated rows, extra columns, empty tables."""

import collections
import functools
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillmark.llm import encoding, licenses, mixing, mtree, neardup, omh, packing, quality, suffixdedup, textvec, tokenids, toxicity
from quillmark.llm.common import scratch_path, tokenizer_path
from quillmark.llm.encoding import Encoder
from quillmark.llm.licenses import scan_licenses
from quillmark.llm.textvec import span_hashes, text_bytes
from tests.llm import plain as plain_rules

BYTE, WORD = "byte_bpe_50k.json", "word_bpe_49k.json"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, count long, rank string, token int, h long"


def table(spark, rows):
    """Documents with extra columns whose names operators also use inside."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), 7, "r", 1, 2) for i, t, s in rows], SCHEMA)


def prose(rng, n, words=400):
    return " ".join("w%d" % rng.randrange(words) for _ in range(n)) + "."


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(1)
    base, passage = prose(rng, 80), prose(rng, 90, 10_000)
    rows = [(i, prose(rng, rng.randrange(1, 120), 10_000), f"s{i % 3}") for i in range(30)]
    for k in range(12):  # near copies of one text, exact copies, and a passage that others share
        words = base.split()
        words[rng.randrange(80)] = f"x{k}"
        rows.append((100 + k, " ".join(words), "s0"))
    rows += [(200 + k, base, "s0") for k in range(4)]
    rows += [(300 + k, prose(rng, 30, 10_000) + "\n" + passage + "\n" + prose(rng, 5, 10_000), "s1") for k in range(5)]
    rows += [(400, None, "s1"), (401, "", None), (402, "é ü 中文 \x00 one", None), (404, "end <|endoftext|> of <|startoftext|>" + base, "s2"), (403, "ab " * 40_000, "s2"), (None, base, "s2"), (None, None, None), (405, "same row", "s2"), (405, "same row", "s2"), (406, "Same  ROW", "s2")]
    return table(spark, rows)


def plain(docs):
    return [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]


def key(x):
    return tuple((v is not None, v) for v in x)


@pytest.mark.parametrize("name", [BYTE, WORD])
def test_encoder_equals_library(name):
    from tokenizers import Tokenizer

    path = tokenizer_path(name)
    t, e, rng = Tokenizer.from_file(path), Encoder(path), random.Random(2)
    marks = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endof", "text|>", "<|endoftext|> ", "x<|endoftext|>"]
    parts = [*marks[: 2 + 5 * (name == WORD)], "a", "B", " ", "  ", "\n", "\t", "'s", "'", "1", "é", "\x1c", "\x85", "\xa0", " ", "é", "̈", "Σ", ".", "中", "🎉"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(600)] + ["", "word " * 3000]
    data, offsets = text_bytes(pa.array(texts))
    for a, b, ids, at in e.encode_rows(data, offsets):
        for i in range(a, b):
            assert ids[at[i - a] : at[i - a + 1]].tolist() == t.encode(texts[i], add_special_tokens=False).ids


@pytest.mark.parametrize("name", [BYTE, WORD])
def test_encoder_of_long_texts(name, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(encoding, "STEP_BYTES", 300)
    monkeypatch.setattr(encoding, "steps", lambda offsets: textvec.steps(offsets, 300))
    path, rng = tokenizer_path(name), random.Random(12)
    t, e = Tokenizer.from_file(path), Encoder(path)
    for mark in ("", "<|endoftext|>"):
        texts = ["short", prose(rng, 400) + mark, "", "é中 " * 500 + mark + "x" * 2000, mark, "ab", "   \n" * 900 + "b"]
        got = {}
        for a, b, ids, at in e.encode_rows(*text_bytes(pa.array(texts))):
            got |= {i: ids[at[i - a] : at[i - a + 1]].tolist() for i in range(a, b)}
        assert got == {i: t.encode(x, add_special_tokens=False).ids for i, x in enumerate(texts)}


def ids_of(name, text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path(name))
    return t.encode(text, add_special_tokens=False).ids


def test_token_files_round_trip(spark, docs):
    folder = scratch_path(spark, "test-tokens")
    manifest = tokenids.write_token_files(docs, folder, tokenizer_path(BYTE), 2)
    got = tokenids.read_token_files(spark, folder).collect()
    expected, start = [], 0
    for i, t in sorted(plain(docs), key=lambda x: key(x)):
        ids = np.array([*ids_of(BYTE, t), 2], "<u4")
        expected.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, got), key=lambda x: x[1]) == expected
    row = manifest.orderBy("shard").head()
    shard = tokenids.TokenShard(folder, row["name"], row["width"], row["n_docs"])
    assert row["width"] == 2 and isinstance(shard.ids, np.memmap) and len(shard[0]) == expected[0][2]
    assert tokenids.token_digests(docs.limit(0), tokenizer_path(BYTE)).count() == 0


def test_packing(spark, docs):
    got = packing.pack(docs, tokenizer_path(WORD), 256, 0).collect()
    expected = collections.Counter()
    for i, t in plain(docs):
        ids = [*ids_of(WORD, t), 0]
        for p in range(0, len(ids), 256):
            part = np.array(ids[p : p + 256], "<u4")
            expected[(i, p // 256, p, len(part), zlib.crc32(part.tobytes()))] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == expected
    by = collections.defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    assert len(by) <= -(-sum(r.length for r in got) // 256) + 3
    assert packing.pack(docs.limit(0), tokenizer_path(WORD)).count() == 0


def test_packing_plan_uses_all():
    rng = np.random.default_rng(3)
    counts = rng.integers(0, 50, 513)
    plan = packing.plan_packing(counts, 512)
    used = np.zeros(513, int)
    for lengths, n in plan:
        assert sum(lengths) <= 512 and n > 0
        for v in lengths:
            used[v] += n
    assert (used[1:] == counts[1:]).all()
    least = max((np.arange(513) * counts).sum() / 512, counts[257:].sum())  # tokens, and pieces over half a sequence
    assert sum(n for _, n in plan) <= 1.01 * least + 1


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text.translate({c: c + 32 for c in range(65, 91)}))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def near_expected(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            i = len(sets[a] & sets[b])
            alike = 100 * i >= 85 * (len(sets[a]) + len(sets[b]) - i) or rows[a][0] == rows[b][0]
            if sets[a] and sets[b] and None not in (rows[a][0], rows[b][0]) and alike:
                parent[find(a)] = find(b)
    least = {}
    for a, (i, _) in enumerate(rows):
        least[find(a)] = i if i is None else min(i, least.get(find(a), i))
    return sorted((((i, len(s), least[find(a)], i == least[find(a)])) for a, ((i, _), s) in enumerate(zip(rows, sets, strict=True))), key=key)


@pytest.mark.parametrize("bucket, cluster", [(4096, 1_500_000), (2, 200)])
def test_near_duplicates(spark, docs, monkeypatch, bucket, cluster):
    monkeypatch.setattr(neardup, "BUCKET", bucket)
    monkeypatch.setattr(neardup, "CLUSTER_SHINGLES", cluster)
    got = sorted((tuple(r) for r in neardup.near_duplicates(docs).collect()), key=key)
    assert got == near_expected(plain(docs))


def test_near_duplicates_of_rows_with_one_id(spark):
    rng = random.Random(13)
    a, b, c = (prose(rng, 60, 10_000) for _ in range(3))
    rows = [(5, a, "s"), (5, b, "s"), (7, a + " x", "s"), (8, b + " y", "s"), (3, c, "s"), (9, c + " z", "s"), (9, a, "s"), (9, "", "s"), (10, "alone", "s")]
    got = sorted((tuple(r) for r in neardup.near_duplicates(table(spark, rows)).collect()), key=key)
    assert got == near_expected([(i, t) for i, t, _ in rows])
    assert {r[0]: r[2] for r in got if r[1]} == {5: 3, 7: 3, 8: 3, 3: 3, 9: 3, 10: 10}


def test_near_duplicates_of_one_large_cluster(spark, monkeypatch):
    """A chain of near copies, of which only neighbours are links, among true copies of its ends."""
    monkeypatch.setattr(neardup, "CLUSTER_SHINGLES", 150)
    rng = random.Random(14)
    words = prose(rng, 90, 10_000).split()
    rows = []
    for k in range(40):
        words[2 * k] = f"x{k}"
        rows.append((k, " ".join(words), "s"))
    rows += [(100 + k, rows[0][1] + f" e{k}", "s") for k in range(10)]
    got = sorted((tuple(r) for r in neardup.near_duplicates(table(spark, rows)).collect()), key=key)
    assert got == near_expected([(i, t) for i, t, _ in rows])


def test_first_of_each_group(spark, docs):
    got = neardup.first_of_each_group(docs)
    ids = sorted(r.doc_id for r in got.where("doc_id is not null").collect())
    assert got.columns == docs.columns and ids == sorted({r[0] for r in near_expected(plain(docs)) if r[3] and r[0] is not None})
    assert got.where("doc_id is null").count() == 2
    assert neardup.near_duplicates(docs.limit(0)).count() == 0


def repeats_expected(rows, n):
    raw = [t.encode() for _, t in rows]
    seen = collections.Counter(r[i : i + n] for r in raw for i in range(len(r) - n + 1))
    out = []
    for (i, _), r in zip(rows, raw, strict=True):
        gone = np.zeros(len(r) + 1, bool)
        for k in range(len(r) - n + 1):
            if seen[r[k : k + n]] > 1:
                gone[k : k + n] = True
        b = np.frombuffer(r, np.uint8)
        out.append((i, len(r), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(b[~gone[:-1]].tobytes()).hexdigest()))
    return sorted(out, key=key)


@pytest.mark.parametrize("group", [4096, 2])
def test_repeated_passages(spark, docs, monkeypatch, group):
    monkeypatch.setattr(suffixdedup, "GROUP", group)
    some = docs.where("doc_id is null or doc_id != 403").unionByName(table(spark, [(403, "ab " * 300, "s2"), (407, "ab" * 150, "s2")]))
    got = suffixdedup.remove_repeats(some).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256))
    assert sorted((tuple(r) for r in got.collect()), key=key) == repeats_expected(plain(some), 200)
    cleaned = suffixdedup.cleaned_rows(some)
    assert cleaned.columns == some.columns and cleaned.count() == some.count()
    assert suffixdedup.remove_repeats(docs.limit(0)).count() == 0


@pytest.mark.parametrize("length, group", [(32, 4096), (300, 4096), (400, 3)])
def test_repeated_passages_of_other_lengths(spark, monkeypatch, length, group):
    monkeypatch.setattr(suffixdedup, "GROUP", group)
    rng = random.Random(9)
    shared = [prose(rng, 300, 10_000) for _ in range(3)]
    rows = [(i, prose(rng, rng.randrange(60), 10_000) + rng.choice(shared)[rng.randrange(300) :] + prose(rng, 20, 10_000) + rng.choice(shared)[: rng.randrange(1800)], "s") for i in range(25)]
    rows += [(50, "ab" * 600, "s"), (51, "a" * 1300, "s"), (None, rows[0][1], "s"), (52, None, None), (52, rows[3][1], "s")]
    some = table(spark, rows)
    got = suffixdedup.remove_repeats(some, length).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256))
    assert sorted((tuple(r) for r in got.collect()), key=key) == repeats_expected(plain(some), length)


def test_repeated_passages_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(suffixdedup, "SEGMENT", 1500)
    monkeypatch.setattr(suffixdedup, "steps", lambda offsets: textvec.steps(offsets, 2000))
    rng = random.Random(10)
    data = prose(rng, 4000, 10_000).encode()
    whole = [np.concatenate(x) for x in zip(*suffixdedup.context_steps(np.frombuffer(data, np.uint8), np.array([0, len(data)]), 200), strict=True)]
    starts = np.concatenate([np.arange(a, a + n) for a, n in zip(whole[1], whole[2], strict=True)])
    assert starts.tolist() == list(range(len(data) - 199))  # each string in one context, whatever the steps
    for start, n, place, h in zip(*whole[1:5], strict=True):
        at = np.array([start + place])
        assert 0 <= place <= 168 and n >= 1 and span_hashes(np.frombuffer(data, np.uint8), at, at + 32)[0] == h
    for bad in (31, 40_000):
        with pytest.raises(ValueError):
            suffixdedup.repeated_spans(table(spark, []), bad)


def test_repeated_starts():
    rng = random.Random(3)
    for trial in range(120):
        n = rng.choice([3, 5, 8, 40])
        texts = ["".join(rng.choice("ab\0" if trial % 2 else "abcd") for _ in range(rng.randrange(60))).encode() for _ in range(rng.randrange(1, 6))]
        seen = collections.Counter(t[i : i + n] for t in texts for i in range(len(t) - n + 1))
        expected = [[i for i in range(len(t) - n + 1) if seen[t[i : i + n]] > 1] for t in texts]
        assert [g.tolist() for g in suffixdedup.repeated_starts(texts, n)] == expected


def test_order_minhash(spark, docs):
    """Against fingerprints of all K-mers, one after another; null and repeated ids included."""
    rows = docs.where("doc_id is null or doc_id != 403").collect()
    some = docs.where("doc_id is null or doc_id != 403").unionByName(table(spark, [(403, "ab " * 900, "s2")]))
    texts = sorted([(r.doc_id, r.text or "") for r in rows] + [(403, "ab " * 900)], key=lambda x: -1 if x[0] is None else x[0], reverse=True)
    of = functools.lru_cache(None)(lambda t: plain_rules.order_minhash(t, omh.K, omh._XOR.ravel().tolist(), omh._MULTIPLY.ravel().tolist()))
    alike = lambda a, b: sum(a[k : k + 4] == b[k : k + 4] for k in range(0, len(a), 4)) / (len(a) // 4)
    got = omh.with_edits(some).collect()
    assert collections.Counter(r.doc_id for r in got) == collections.Counter(i for i, _ in texts)
    once = {i for i, n in collections.Counter(i for i, _ in texts).items() if n == 1}
    for k, (i, t) in enumerate(texts):
        after = texts[(k + 1) % len(texts)][1]
        if i not in once or i is None or texts[(k + 1) % len(texts)][0] not in once:
            continue  # of equal ids the order is by a hash of the text
        m = len(t) // 3
        edited = t[: len(t) - m] + after[:m]
        [r] = [r for r in got if r.doc_id == i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (of(t), of(edited))
        assert (r.near_edited, r.near_next) == (alike(of(t), of(edited)), alike(of(t), of(after)))
    own = {r.doc_id: r.fingerprint for r in omh.fingerprints(some.where("doc_id is not null")).collect()}
    assert all(own[i] == of(t) for i, t in texts if i in once and i is not None)
    assert omh.with_edits(docs.limit(0)).count() == 0 and omh.with_edits(docs.limit(1)).count() == 1


def test_order_matters():
    rng = random.Random(4)
    words = [f"w{i}" for i in rng.sample(range(10_000), 200)]
    mixed = rng.sample(words, 200)
    near = [*words[:190], *mixed[:10]]
    own = omh.fingerprint(" ".join(words))
    assert omh.likeness(own, omh.fingerprint(" ".join(near))) > 0.5 > 0.2 > omh.likeness(own, omh.fingerprint(" ".join(mixed)))


def best_products(rows, k=5):
    """(query_id, rank, vec_id, score) in Python's integers."""
    good = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    queries = {}
    for i, v in good:
        if i % 50 == 0:
            queries[i] = min(queries.get(i, v), v)
    out = []
    for q, x in queries.items():
        best = sorted((-sum(a * b for a, b in zip(x, v, strict=True)), i) for i, v in good if i != q and len(v) == len(x))[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("block, queries, shared", [(8 << 20, 1024, 64), (8 * 8 * 60, 3, 2)])
def test_mtree(spark, monkeypatch, block, queries, shared):
    monkeypatch.setattr(mtree, "BLOCK_BYTES", block)
    monkeypatch.setattr(mtree, "QUERIES", queries)
    monkeypatch.setattr(mtree, "SHARED", shared)
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(700)] + [(1000 + i, [0.5] * 8) for i in range(300)]
    rows += [(5000, None), (5050, [1.0, None] * 4), (5100, [float("nan")] * 8), (5150, [1.0]), (5200, [2.0]), (5250, []), (None, [1.0] * 8), (700, [0.0] * 8), (700, [0.0] * 8)]
    rows += [(701, [3.0] * 8)] * 3 + [(750, [9.0] * 8), (750, [-9.0] * 8)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, rank int, label int")
    assert sorted(map(tuple, mtree.top_inner_products(df, F.col("vec_id") % 50 == 0).collect())) == best_products(rows)


def test_mtree_of_few_rows(spark):
    one = spark.createDataFrame([(0, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assert mtree.top_inner_products(one, F.lit(True)).count() == 0
    assert mtree.top_inner_products(one.limit(0), F.lit(True)).count() == 0


def test_mtree_scores_beyond_floats(spark):
    rng = np.random.default_rng(11)
    rows = [(i, [float(x) for x in 1e6 + rng.normal(size=6)]) for i in range(120)]  # scores near 4e17
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, mtree.top_inner_products(df, F.col("vec_id") % 50 == 0).collect())) == best_products(rows)
    big = np.array([[1 << 40] * 4, [1 << 20] * 4])
    assert mtree.scores(big, big.astype(float), np.array([1 << 20] * 4)).tolist() == [1 << 62, 1 << 42]
    with pytest.raises(ValueError):
        mtree.scores(big, big.astype(float), np.array([1 << 30] * 4))


def test_mtree_skips_pages_and_regions():
    rng = np.random.default_rng(6)
    v = np.concatenate([rng.normal(c, 1, (400, 4)) for c in (0, 100, 200, 300)]).round().astype(int)
    tree = mtree.MTree.from_bytes(mtree.MTree(np.arange(len(v)), v).to_bytes())
    best = sorted((-int(x @ v[7]), i) for i, x in enumerate(v) if i != 7)[:3]
    assert tree.search(7, v[7], 3) == [(-s, i) for s, i in best]
    tree.visited = 0
    best = sorted((-int(x @ v[1500]), i) for i, x in enumerate(v) if i != 1500)[:3]
    assert tree.search(1500, v[1500], 3) == [(-s, i) for s, i in best]
    assert 0 < tree.visited < len(tree.pages) / 2
    assert tree.search(1500, v[1500], 3, floor=10**9) == []
    top = float((v.astype(float) ** 2).sum(axis=1).max())
    at, far = mtree.nearest_pivot(v, v[[0, 500, 900, 1300]], top)
    regions = mtree.Regions({4: v[[0, 500, 900, 1300]]}, {4: top})
    regions.radius = {(4, i): float(far[at == i].max()) for i in range(4)}
    assert regions.within(4, v[[1500]], [-best[-1][0]]).tolist() == [3] and len(regions.within(4, v[[1500]], [None])) == 4


def marked(spark):
    rng = random.Random(7)
    rows, labels = [], []
    for i in range(400):
        text = prose(rng, 40, 5000)  # most words are rare, as in real texts
        toxic, good = i % 5 == 0, i % 3 != 0
        if toxic:
            words = text.split()
            words[3] = rng.choice(["idiot", "scum", "pathetic"])
            text = " ".join(words)
        rows.append((i, text if good else text.upper().replace(" ", "!! "), "s"))
        labels.append((i, int(good), int(toxic), 3))
    labels += [(None, 1, 1, 3), (5, None, None, 3)]
    return table(spark, [*rows, (None, None, None), (900, "", "s"), (901, "long " * 50_000, "s")]), spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text int")


def test_quality(spark):
    docs, labels = marked(spark)
    weights = quality.fit(docs, labels.where(~quality.held_out()))
    got = {r.doc_id: r for r in quality.score(docs, weights).collect()}
    out = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(out) > 50 and sum(got[i].predicted == int(i % 3 != 0) for i in out) >= 0.98 * len(out)
    assert len(got) == docs.count() and 0 <= got[900].score <= 1
    assert quality.score(docs.limit(0), weights).count() == 0
    assert {r.score for r in quality.score(docs, quality.fit(docs, labels.limit(0))).collect()} == {0.5}


def test_quality_equals_plain_rules(spark):
    rng = random.Random(16)
    texts = {i: " ".join(rng.choice(["Word", "word", "WORD", "w1", "é", "!!", "a-b", "...", "two two"]) for _ in range(rng.randrange(1, 30))) for i in range(60)} | {900: "", 901: None}
    labels = {i: i % 2 for i in range(40)}
    docs = table(spark, [(i, t, "s") for i, t in texts.items()])
    known = spark.createDataFrame(list(labels.items()), "doc_id long, quality int")
    expected = plain_rules.quality_scores(texts, labels)
    got = {r.doc_id: r for r in quality.score(docs, quality.fit(docs, known)).collect()}
    assert all(abs(got[i].score - x) < 1e-5 and got[i].predicted == (got[i].score >= 0.7) for i, x in expected.items()) and len({round(x, 3) for x in expected.values()}) > 20


def toxic_fixture(rng, n=40, every=4):
    texts = {i: prose(rng, rng.randrange(3, 14), 60) for i in range(n)} | {900: "", 901: None, 902: "?? !!"}
    labels = {}
    for i in range(n):
        labels[i] = int(i % every == 0)
        if labels[i]:
            texts[i] += " " + rng.choice(["Idiot", "scum", "pathetic", "worthless idiot"])
    return texts, labels


def test_toxicity_equals_plain_rules(spark):
    texts, labels = toxic_fixture(random.Random(17))
    docs = table(spark, [(i, t, "s") for i, t in texts.items()])
    known = spark.createDataFrame(list(labels.items()), "doc_id long, toxic int")
    expected = plain_rules.toxicity_scores(texts, labels, toxicity.CATEGORIES)
    names = [*toxicity.CATEGORIES, "toxic"]
    got = {r.doc_id: r for r in toxicity.score(docs, toxicity.fit(docs, known), names).collect()}
    for i, p in expected.items():
        assert all(abs(got[i][c] - x) < 1e-5 for c, x in zip(names, p, strict=True))
        assert got[i].rejected == (bool(re.search(r"\w", texts[i] or "")) and got[i].toxic > 0.2)


def test_toxicity(spark):
    docs, labels = marked(spark)
    chain = toxicity.fit(docs, labels.where("doc_id < 300 or doc_id is null"))
    names = [*toxicity.CATEGORIES, "toxic"]
    got = {r.doc_id: r for r in toxicity.score(docs, chain, names).collect()}
    # with 60 toxic training rows over three words, nearly all clean rows stay and most toxic ones go
    assert sum(got[i].rejected for i in range(300, 400) if i % 5) <= 2 and sum(got[i].rejected for i in range(300, 400, 5)) >= 13
    assert not got[900].rejected and not got[None].rejected and len(got) == docs.count()
    kept = toxicity.without_toxic(docs, labels)
    assert kept.columns == docs.columns and 318 <= kept.count() <= 330
    assert toxicity.without_toxic(docs, labels.limit(0)).count() == docs.count()
    assert toxicity.score(docs.limit(0), chain, names).count() == 0


def test_chain_learns_from_out_of_fold_predictions():
    rng = np.random.default_rng(8)
    rows = [rng.choice(2000, 20, replace=False) for _ in range(300)]
    first = np.array([float((r < 200).any()) for r in rows])
    y = np.stack([first, first], axis=1)
    chain = toxicity.fit_rows([np.sort(r) for r in rows], y)
    assert chain.weights[1][1 << toxicity.BITS] > 0  # the second link leans on the first one's probability


def mix_expected(rows, alpha, budget, block=mixing.BLOCK):
    """Uses of each (id, text, source) by the rules of the module's docstring, in plain Python."""
    digest = lambda *x: hashlib.md5("|".join(map(str, x)).encode()).hexdigest()
    docs = []
    for i, t, s in rows:
        name = f"{'' if i is None else i}|{hashlib.md5((t or '').encode()).hexdigest()[:16]}"
        docs.append((s or "", name, max(1, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))), (i, t, s)))
    tokens = collections.Counter()
    for s, _, n, _ in docs:
        tokens[s] += n
    total = sum(tokens.values())
    p = {s: (n / total) ** alpha for s, n in tokens.items()}
    z = math.fsum(p.values())
    whole = math.ceil(max(tokens[s] / p[s] for s in p) * z) if budget == "cover" else total if budget is None else budget
    uses = collections.Counter()
    for s in tokens:
        own = [d for d in docs if d[0] == s]
        quota = max(math.floor(round(whole * p[s] / z, 6)), tokens[s] if budget == "cover" else 0)
        blocks = -(-len(own) // block)
        for epoch in range(quota // tokens[s] + 1):
            left = quota % tokens[s] if epoch == quota // tokens[s] else None
            dealt = collections.defaultdict(list)
            for d in own:
                dealt[int(digest("0b", d[1])[:8], 16) % blocks].append(d)
            before = 0
            for k in sorted(dealt, key=lambda k: digest(0, epoch, s, f"b{k}")):
                reach = before
                for d in sorted(dealt[k], key=lambda d: (digest(0, epoch, s, d[1]), d[1])):
                    reach += d[2]
                    if left is None or reach <= left:
                        uses[d[3]] += 1
                before = reach
    return uses


@pytest.mark.parametrize("how", [{"target_entropy": 0.99}, {"target_entropy": 0.999, "budget": 3000}, {"max_repetition": 1.5, "budget": "cover"}, {"max_repetition": 2.5, "budget": 40_000}])
def test_mixing(spark, docs, monkeypatch, how):
    monkeypatch.setattr(mixing, "BLOCK", 6)
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    sums = docs.sparkSession.createDataFrame([(s or "", max(1, len(re.findall(r"[^\x20\x09-\x0D]+", t or "")))) for _, t, s in rows], "source string, n long").groupBy("source").agg(F.sum("n").alias("tokens"))
    total = sums.agg(F.sum("tokens")).head()[0]
    budget = how.get("budget")
    alpha = mixing.find_exponent(sums.withColumn("total", F.lit(total)), None if budget == "cover" else budget or total, how.get("target_entropy"), how.get("max_repetition"))
    assert 0 <= alpha <= 1
    got = mixing.mix_sources(docs, **how)
    expected = mix_expected(rows, alpha, budget, 6)
    by_row = collections.Counter()
    for r in got.collect():
        by_row[(r.doc_id, r.source, r.tokens)] += 1
    wanted = collections.Counter()
    for (i, t, s), n in expected.items():
        wanted[(i, s or "", max(1, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))))] += n
    assert by_row == wanted
    out = mixing.mixed_rows(docs, **how)
    assert out.columns == docs.columns and collections.Counter((r.doc_id, r.text, r.source) for r in out.collect()) == expected
    if budget == "cover":
        assert set(expected) == set(rows)




def test_mixing_of_odd_tables(spark, docs):
    assert mixing.mix_sources(docs.limit(0), target_entropy=0.9).count() == 0 and mixing.mixed_rows(docs.limit(0), max_repetition=2.0, budget="cover").count() == 0
    with pytest.raises(ValueError):
        mixing.mix_sources(docs)
    odd = docs.select("doc_id", "text", "source", F.lit(1).alias("name"), F.lit(2).alias("a.b"), F.lit(3).alias("__copy"), F.lit(4).alias("copies"), F.lit(5).alias("from"))
    got = mixing.mixed_rows(odd, max_repetition=1.5, budget="cover")
    assert got.columns == odd.columns and set(got.select("name", "`a.b`", "__copy", "copies", "from").distinct().collect()) == {(1, 2, 3, 4, 5)}


def test_licenses(spark):
    rows = [("p/LICENSE", "Released under the MIT License."), ("p/a/x.c", "code\nAll rights reserved.\nmore"), ("p/a/y.c", "words only"), ("p/a/b/z.c", None), ("q/z.c", ""), (None, "Licensed under the Apache License, Version 2.0."), ("p/a/y.c", "words only")]
    df = spark.createDataFrame([(i, t, p, "x") for i, (p, t) in enumerate(rows)], "doc_id long, text string, path string, license string")
    got = {r.doc_id: (r.license, r.origin, r.license_dir) for r in scan_licenses(df, F.col("path")).collect()}
    assert got == {
        0: ("MIT", "file", None), 1: ("Proprietary", "header", None), 2: ("MIT", "directory", "p"), 3: ("MIT", "directory", "p"), 4: (None, None, None),
        5: ("Apache-2.0", "header", None), 6: ("MIT", "directory", "p"),
    }
    assert scan_licenses(df.limit(0), F.col("path")).count() == 0
    plan = scan_licenses(df, F.col("path"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_licenses_in_wrapped_headers_and_among_other_words(spark):
    texts = [
        "# Redistribution and use in source and binary forms, with or\n# without modification, are permitted provided that the\n# following conditions are met:\n#\ncode()",
        "Copyright 2021 Acme Corp. All rights reserved. Contact legal for more.",
        "x = 1; // see below\n/*\n * Copyright 2020 Some People. Permission is hereby granted, free\n * of charge, to any person obtaining a copy of this software\n * and associated documentation files. Other words follow here.\n */",
        "/* This Source Code Form is\n\n * subject to the terms of the Mozilla\n * Public License, v. 2.0. */",
        "\n".join("This program is free software you can redistribute it and or modify it under the terms of the GNU General Public License as published by the Free Software Foundation either version 3 of the License or any later version".split()),
        "The mit of words, and other\nreserved seats. Rights of way\nand so on.",
        "Licensed to all. " * 3000,
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("path", F.concat(F.lit("d/f"), "doc_id", F.lit(".c")))
    got = {r.doc_id: (r.license, r.origin) for r in scan_licenses(df, F.col("path")).collect()}
    header = lambda name: (name, "header")
    assert got == {0: header("BSD-3-Clause"), 1: header("Proprietary"), 2: header("MIT"), 3: header("MPL-2.0"), 4: header("GPL-3.0"), 5: (None, None), 6: (None, None)}


def brute_licenses(rows, threshold=licenses.THRESHOLD):
    """(license, score) by id of rows (id, is_file, text), in plain Python."""
    import math

    every = [(n, licenses.words_of(t), False) for n, t in licenses.TEMPLATES] + [(n, licenses.words_of(t), True) for n, t in licenses.WHOLE_TEXTS]
    vocabulary = {w for _, t, _ in every for w in t}
    df = collections.Counter(w for _, _, text in rows for w in set(licenses.words_of(text or "")) & vocabulary)
    weight = lambda w: math.log((1 + len(rows)) / (1 + (df[w] if w in vocabulary else 0))) + 1
    vector = lambda words: {w: n * weight(w) for w, n in collections.Counter(words).items()}
    out = {}
    for i, is_file, text in rows:
        pieces = [p for p in (licenses.words_of(x) for x in re.split(r"\n|(?<=[.!?;:])[\x09-\x0D\x20]+", text or "")) if p]
        units = [(licenses.words_of(line), False) for line in (text or "").split("\n")]
        units += [(sum(pieces[a:b], []), False) for a in range(len(pieces)) for b in range(a + 1, len(pieces) + 1)]
        units += [(licenses.words_of(text or ""), True)] * is_file
        found = []
        for words, whole in units:
            v = vector(words)
            length = math.sqrt(sum(x * x for x in v.values()))
            for name, t, of_files in every:
                u = vector(t)
                if words and (whole or not of_files) and (whole or len(words) <= licenses.LONGEST or words in [licenses.words_of(x) for x in (text or "").split("\n")]):
                    s = round(sum(x * u.get(w, 0) for w, x in v.items()) / length / math.sqrt(sum(x * x for x in u.values())), 6)
                    if s >= threshold:
                        found.append((-s, name))
        out[i] = (min(found)[1], -min(found)[0]) if found else None
    return out


def test_licenses_equal_brute_force(spark):
    rng = random.Random(15)
    words = sorted({w for _, t in licenses.TEMPLATES for w in licenses.words_of(t)})
    mit, apache = dict(licenses.WHOLE_TEXTS)["MIT"], dict(licenses.TEMPLATES[2:4])["Apache-2.0"]
    texts = [(True, "Copyright (c) 2020 Some One\n\n" + mit.replace(". ", ".\n")), (True, "   Apache License\n  Version 2.0, January 2004\n\n" + apache + "\n" + prose(rng, 200)), (False, mit), (True, "not a licence"), (False, None), (False, "")]
    for _ in range(40):
        name, t = rng.choice(licenses.TEMPLATES)
        mixed = [w if rng.random() < 0.85 else rng.choice([*words, "xx", "yy"]) for w in t.split()]
        for k in range(rng.randrange(4)):
            mixed.insert(rng.randrange(len(mixed)), rng.choice(["\n", ".", "zz", "; "]))
        texts.append((False, prose(rng, 6) + " " + " ".join(mixed) + ". " + prose(rng, 5)))
    df = spark.createDataFrame([(i, t, f) for i, (f, t) in enumerate(texts)], "doc_id long, text string, f boolean")
    path = F.concat_ws("/", F.lit("x"), F.col("doc_id").cast("string"), F.when(F.col("f"), "LICENSE").otherwise("a.c"))
    got = {r.doc_id: (r.own_license, r.own_score) if r.own_license else None for r in scan_licenses(df, path).collect()}
    expected = brute_licenses([(i, f, t) for i, (f, t) in enumerate(texts)])
    assert got == expected and got[0][0] == "MIT" and got[1][0] == "Apache-2.0" and sum(x is not None for x in got.values()) > 15


def test_mixing_keeps_a_source_of_one_word_beside_billions(spark):
    sources = spark.createDataFrame([("", 1, 1, 5_000_000_001), ("big", 5_000_000_000, 9_000, 5_000_000_001)], "source string, tokens long, docs long, total long")
    alpha = mixing.find_exponent(sources, None, None, 1.5)
    got = {r.source: r for r in mixing.source_quotas(sources, alpha, "cover").collect()}
    assert got[""].weight < 1e-9 and got[""].quota == 1 and 5_000_000_000 <= got["big"].quota <= 7_500_000_001
    assert {r.source: r.quota for r in mixing.source_quotas(sources, 1.0, None).collect()}[""] == 1


def test_agreement_follows_the_threshold():
    from math import comb

    n = 2 * neardup.T * neardup.K
    for percent in (70, 75, 80, 85):
        p = percent / 100
        assert sum(comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(neardup.agree(percent))) < 1e-6
    assert neardup.agree(85) == 63
