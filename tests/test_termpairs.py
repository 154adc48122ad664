"""Pairs of texts by blocks of vectors, beside the join over all of their terms."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillmark.functions import terms
from quillmark.functions import vector as V
from quillmark.llm.textvec import text_bytes
from quillmark.operators import cluster, termpairs
from quillmark.plans import registry


def near_copies(seed: int) -> list[str]:
    rng = random.Random(seed)
    base = [[f"w{rng.randrange(400)}" for _ in range(rng.choice((8, 60, 300)))] for _ in range(12)]
    texts = [" ".join(rng.choice(b) if rng.random() < k / 60 else w for w in b) for b in base for k in range(8)]
    return [*texts, *texts[::7], texts[0].upper(), texts[5] + " " + texts[5], "", "", "!", "aa", "aa", "aa bb", "aa aa", "the"]


@pytest.mark.parametrize("least", [0.3, 0.9, 1.0])
def test_text_pairs_are_those_of_all_terms(spark, monkeypatch, least):
    monkeypatch.setattr(termpairs, "BLOCK", 3000)  # some 20 blocks
    texts = near_copies(3)
    df = spark.createDataFrame([*enumerate(texts), (len(texts), None)], "id long, t string")
    expected = cluster.sparse_pairs(V.hashed_terms(df, "id", F.col("t"), 1 << 20), "id", least).collect()
    got = termpairs.text_pairs(df, "id", F.col("t"), 1 << 20, least).collect()
    assert len(got) == len(expected) > 50 and {(r.i, r.j): r.similarity for r in got} == {(r.i, r.j): r.similarity for r in expected}
    plain = {r.id: r.component for r in cluster.components(spark.createDataFrame([(r.i, r.j) for r in expected], "i long, j long"), df, "id").collect()}
    links = termpairs.text_links(df, "id", F.col("t"), 1 << 20, least)
    assert {r.id: r.component for r in cluster.components(links, df, "id").collect()} == plain
    assert links.count() < len(expected)


def test_rows_of_one_id_are_one_vector_and_no_rows_none(spark):
    df = spark.createDataFrame([(1, "aa bb"), (1, "cc dd"), (2, "aa bb"), (3, "aa bb")], "id long, t string")
    assert [(r.i, r.j) for r in termpairs.text_pairs(df, "id", F.col("t"), 1 << 20, 0.9).collect()] == [(2, 3)]
    assert termpairs.text_pairs(df.limit(0), "id", F.col("t"), 1 << 20, 0.9).count() == 0


@pytest.mark.parametrize("query", ["sparse_cosine_pairs"])
def test_terms_are_no_rows_of_a_join(spark, tmp_path, query):
    rows = [(i, t, "en", f"src{i % 3}", len(t)) for i, t in enumerate(near_copies(4))]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert "bucket" not in registry.queries()[query](spark, str(tmp_path))._jdf.queryExecution().toString()


@pytest.mark.parametrize("query", ["connected_components", "cluster_events"])
def test_components_need_no_row_per_pair(spark, tmp_path, monkeypatch, query):
    def rows_of_all_pairs(*_):
        raise AssertionError("pairs are listed one by one")

    monkeypatch.setattr(cluster, "rare_pairs", rows_of_all_pairs)
    monkeypatch.setattr(termpairs, "text_pairs", rows_of_all_pairs)
    texts = ["aa bb cc dd"] * 5 + ["Aa, bb cc dd"] + [f"x{i} y{i} z{i}" for i in range(3)]
    rows = [(i, t, "en", f"src{i % 3}", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = registry.queries()[query](spark, str(tmp_path)).collect()
    if query == "connected_components":
        assert {r.id: r.component for r in got} == {**dict.fromkeys(range(6), 0), 6: 6, 7: 7, 8: 8}
    else:
        assert {r.event_id: r.num_items for r in got} == {0: 6, 6: 1, 7: 1, 8: 1}


def block(texts: list[str], first: int, least: float, dim: int = 1 << 20) -> termpairs.Block:
    row, bucket, n = terms.counted(*text_bytes(pa.array(texts)), dim)
    at = np.searchsorted(row, np.arange(len(texts) + 1))
    name, n, fewest = termpairs.named(bucket, n, at, np.arange(dim, dtype=np.int32), least)
    steps = np.diff(name, prepend=0)
    steps[at[:-1]] = name[at[:-1]]
    lists = [pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(x.astype(np.int32))) for x in (steps, n)]
    return termpairs.Block(pa.table([pa.array(range(first, first + len(texts))), *lists, pa.array(fewest)], names=["first", "name", "n", "fewest"]), dim)


def test_few_pairs_are_decided_on_all_terms():
    """Texts that share frequent words only are told apart by groups of buckets; pairs that links unite already are left out."""
    rng, least = random.Random(7), 0.9
    words = [f"w{k}" for k in range(6000)]
    texts = [" ".join(rng.choices(words[:12], [40, 9, 7, 5, 4, 3, 2, 2, 2, 1, 1, 1], k=90) + rng.choices(words, k=rng.choice((150, 400)))) for _ in range(160)]
    texts += [f"{texts[k % 4]} more{k} words{k}" for k in range(120)]
    rng.shuffle(texts)
    blocks = block(texts[:140], 0, least), block(texts[140:], 140, least)
    vectors = {}
    for x in blocks:
        for k, i in enumerate(x.ids.to_pylist()):
            own = slice(x.at[k], x.at[k + 1])
            vectors[i] = dict(zip(x.name[own].tolist(), x.n[own].tolist(), strict=True)), x.length[k]
    cosine = lambda i, j: sum(n * vectors[j][0].get(t, 0) for t, n in vectors[i][0].items()) / (vectors[i][1] * vectors[j][1])
    expected = {(i, j) for i in vectors for j in vectors if i < j and round(cosine(i, j), 6) >= least}

    def met(links):
        for p, q in ((0, 0), (0, 1), (1, 1)):
            for i, j, _ in termpairs.meet(blocks[p], blocks[q], least, links):
                x, y = blocks[p].ids.take(pa.array(i)).to_pylist(), blocks[q].ids.take(pa.array(j)).to_pylist()
                yield from ((min(k), max(k)) for k in zip(x, y, strict=True))

    pairs, links = list(met(False)), list(met(True))
    assert len(pairs) == len(set(pairs)) and set(pairs) == expected and len(expected) > 1000
    forests = [dict(zip(*termpairs._forest(*np.array(x).T)[::-1], strict=True)) for x in (pairs, links)]
    assert forests[0] == forests[1] and len(links) < len(pairs) / 3
