"""The pipeline and the registered queries as wholes: against plain Python, and on odd tables."""

import collections
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillmark.llm import neardup, queries, suffixdedup, toxicity
from quillmark.llm.common import tokenizer_path
from quillmark.llm.mixing import find_exponent
from tests.llm import plain
from tests.llm.test_llm import mix_expected, near_expected, prose, toxic_fixture


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A small corpus with toxic documents, near copies and exact ones, shared passages and odd rows, and its labels."""
    rng = random.Random(21)
    texts, labels = toxic_fixture(rng, 64, 16)
    passage, base = prose(rng, 70, 10_000), prose(rng, 60, 10_000)
    rows = [(i, t, f"s{i % 3}") for i, t in texts.items()]
    rows += [(100 + k, base + f" x{k}", "s0") for k in range(4)] + [(110, base, "s0"), (111, base, None)]
    rows += [(200 + k, f"é{k} " * 40 + passage + prose(rng, 9, 10_000), "s1") for k in range(4)] + [(300, "tail <|endoftext|> " + prose(rng, 2500, 10_000), "s2")]
    rows += [(400 + k, f"idiot scum {k}", "s2") for k in range(3)] + [(None, base, "s1"), (None, None, None), (500, "one id", "s1"), (500, "another text", "s1")]
    d = tmp_path_factory.mktemp("pipeline")
    odd = "doc_id long, text string, lang string, source string, n_chars long, d string, rk long, spans string, `a.b` int, __row int, name string"
    table = spark.createDataFrame([(i, t, "en", s, len(t or ""), "d", 1, "s", 2, 3, "n") for i, t, s in rows], odd)
    table.write.parquet(str(d / "documents.parquet"))
    spark.createDataFrame([(i, y, y) for i, y in labels.items()], "doc_id long, toxic int, quality int").write.parquet(str(d / "labels.parquet"))
    spark.createDataFrame([(i, [float(i % 7), float(i % 5)]) for i in range(120)], "vec_id long, embedding array<float>").write.parquet(str(d / "embeddings.parquet"))
    return str(d), rows, texts, labels


def cut(rows, n=200):
    """Rows without their repeated passages, at code point borders."""
    raw = [(t or "").encode() for _, t, _ in rows]
    seen = collections.Counter(r[i : i + n] for r in raw for i in range(len(r) - n + 1))
    out = []
    for (i, t, s), r in zip(rows, raw, strict=True):
        gone = np.zeros(len(r) + 1, int)
        for k in range(len(r) - n + 1):
            if seen[r[k : k + n]] > 1:
                gone[k : k + n] = 1
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone])))
        kept, at = b"", 0
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            while a < len(r) and r[a] & 0xC0 == 0x80:
                a += 1
            while 0 < b < len(r) and r[b] & 0xC0 == 0x80:
                b -= 1
            kept, at = kept + r[at:a], b
        out.append((i, None if t is None else (kept + r[at:]).decode(), s))
    return out


def test_pipeline_equals_plain_version(spark, folder):
    from tokenizers import Tokenizer

    d, rows, _, labels = folder
    # toxicity: the chain is fitted on the labelled rows
    texts = {i: t for i, t, _ in rows if i is not None and i in labels}
    every = dict(enumerate(t for _, t, _ in rows))
    p = plain.toxicity_scores(texts | {("row", k): t for k, t in every.items()}, labels, toxicity.CATEGORIES)
    rows = [r for k, r in enumerate(rows) if not (p[("row", k)][-1] > toxicity.THRESHOLD and re.search(r"\w", r[1] or ""))]
    assert 0 < len(rows) < len(every) and not any("idiot scum" in (t or "") for _, t, _ in rows)
    kept = {x[0] for x in near_expected([(i, t or "") for i, t, _ in rows]) if x[3] and x[0] is not None}
    one = [r for r in rows if r[0] == 500]
    rows = [r for r in rows if r[0] is None or (r[0] in kept and r[0] != 500)]
    assert len(one) == 2 and 500 in kept
    got = corpus_pipeline.run(spark, d)
    pieces = got.collect()
    found = next(r for r in one if {x.ids_crc32 for x in pieces if x.doc_id == 500} == {crc(Tokenizer.from_file(tokenizer_path("word_bpe_49k.json")), r[1])})
    rows = cut([*rows, found])  # of the two rows of one id either may stay
    tokens = collections.Counter()
    for _, t, s in rows:
        tokens[s or ""] += max(1, len(re.findall(r"[^\x20\x09-\x0D]+", t or "")))
    sums = spark.createDataFrame([(s, n, sum(tokens.values())) for s, n in tokens.items()], "source string, tokens long, total long")
    uses = mix_expected(rows, find_exponent(sums, None, None, 1.5), "cover")
    assert set(uses) == set(rows)
    t = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    expected = collections.Counter()
    for (i, text, _), n in uses.items():
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 2048):
            part = np.array(ids[k : k + 2048], "<u4")
            expected[(i, k // 2048, k, len(part), zlib.crc32(part.tobytes()))] += n
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in pieces) == expected
    by = collections.defaultdict(list)
    for r in pieces:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        ends = np.cumsum([0, *(n for _, n in sorted(parts))])
        assert [a for a, _ in sorted(parts)] == ends[:-1].tolist() and ends[-1] <= 2048


def crc(tokenizer, text):
    return zlib.crc32(np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 0], "<u4").tobytes())


def test_stages_keep_columns_and_take_empty_tables(spark, folder):
    d = folder[0]
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, d).schema.simpleString() == docs.schema.simpleString(), name
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), d).count() == 0, name
    assert suffixdedup.cleaned_rows(docs).count() == docs.count()


COLUMNS = {
    "op1_token_ids": {"doc_id", "start", "n_tokens", "ids_crc32"}, "op2_temperature_mixing": {"doc_id", "source", "tokens", "weight", "epoch"}, "op3_license_scan": {"doc_id", "license", "origin"},
    "op4_toxicity_chain": {"doc_id", "toxic", "rejected"}, "op5_order_minhash": {"doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"},
    "op6_near_dedup": {"doc_id", "n_shingles", "component_id", "kept"}, "op7_mtree_search": {"query_id", "rank", "vec_id", "score"}, "op8_quality_ftrl": {"doc_id", "held_out", "score", "predicted"},
    "op9_pattern_packing": {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"}, "op10_suffix_dedup": {"doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"},
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_registered_queries(spark, folder, name):
    """Each query covers every row of its odd table."""
    d, rows, _, _ = folder
    got = queries.queries()[name](spark, d)
    assert set(got.columns) >= COLUMNS[name]
    ids = collections.Counter(r[0] for r in got.select(got.columns[0]).collect())
    if name == "op7_mtree_search":
        assert ids == {0: 5, 50: 5, 100: 5}
    elif name in ("op2_temperature_mixing", "op9_pattern_packing"):
        assert set(ids) <= {i for i, _, _ in rows} and (name == "op2_temperature_mixing" or set(ids) == {i for i, _, _ in rows})
    else:
        assert ids == collections.Counter(i for i, _, _ in rows)


def test_near_copies_of_the_threshold_are_linked(spark):
    """85 of 100 shingles in common is a link, 84 is none."""
    words = [f"w{i}" for i in range(104)]
    rows = []
    for k in (15, 16, 17):  # the last words differ: 100 shingles each, of which k are others
        rows.append((k, " ".join([*words[: 104 - k], *(f"{k}x{i}" for i in range(k))])))
    rows.append((99, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(r) for r in neardup.near_duplicates(df).collect())) == near_expected(rows)


def test_kept_text_is_whole(spark):
    both = spark.createDataFrame([(1, "é" * 150 + "a"), (2, "é" * 150 + "b")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in suffixdedup.cleaned_rows(both, 200, size_col=None).collect()}
    assert got == {1: "a", 2: "b"} and suffixdedup.cleaned_rows(both.select("doc_id", "text", F.lit(0).alias("n_chars"))).select("n_chars").distinct().count() == 1
