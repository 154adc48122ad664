"""Queries look at whole texts and whole tables."""

import math
import random

from pyspark.sql import functions as F

from quillmark.functions import vector as V
from quillmark.operators import cluster, tables
from quillmark.plans import adapters, registry


def documents(tmp_path, spark, texts):
    rows = [(i, t, "en", f"src{i % 3}", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def test_pairs_see_all_of_a_text(spark, tmp_path):
    rng = random.Random(1)
    words = lambda tag, n: " ".join(f"{tag}{rng.randrange(10**6)}" for _ in range(n))
    start, body = words("s", 300), words("b", 3000)
    assert len(start) > 2000
    texts = [start + " " + words("x", 3000), start + " " + words("y", 3000), words("p", 260) + " " + body, words("q", 260) + " " + body]
    d = documents(tmp_path, spark, texts)
    assert [(r.i, r.j) for r in registry.queries()["sparse_cosine_pairs"](spark, d).collect()] == [(2, 3)]
    found = {r.id: r.component for r in registry.queries()["connected_components"](spark, d).collect()}
    assert found == {0: 0, 1: 1, 2: 2, 3: 2}
    assert registry.queries()["cluster_events"](spark, d).count() == 3


def test_rare_pairs_equal_brute_force(spark):
    rng = random.Random(2)
    base = [rng.choice("abcdefghijklmnop") * 2 for _ in range(60)]
    texts = [" ".join(rng.choice(base) if rng.random() < k / 40 else w for w in base) for k in range(25)] + ["", "aa", "aa", "aa bb"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    weights = V.hashed_terms(df, "id", F.col("t"), 1 << 20)
    vectors: dict = {}
    for r in weights.collect():
        vectors.setdefault(r.id, {})[r.bucket] = r.weight
    for least in (0.3, 0.9, 1.0):
        expected = {}
        for i in vectors:
            for j in vectors:
                if i < j and (s := round(math.fsum(w * vectors[j].get(b, 0.0) for b, w in vectors[i].items()), 6)) >= least:
                    expected[(i, j)] = s
        got = cluster.rare_pairs(weights, "id", least).collect()
        assert {(r.i, r.j): r.similarity for r in got} == expected and len(got) == len(expected)


def test_whole_views_hold_every_row(spark, tmp_path):
    d = documents(tmp_path, spark, [f"text {i}" for i in range(1500)])
    items, events, stories, claims, cited = (f(spark, d) for f in (adapters.event_items, adapters.events, adapters.stories, adapters.claims, adapters.claim_sources))
    assert {r.raw_item_id for r in items.collect()} == set(range(1500)) == {r.claim_id for r in claims.collect()} == {r.claim_id for r in cited.collect()}
    assert {r.event_id for r in events.collect()} == {r.event_id for r in items.collect()} == {r.story_id for r in stories.collect()}
    assert items.groupBy("event_id").count().agg(F.max("count")).head()[0] == 240
    assert sum(r.num_items for r in registry.queries()["event_features"](spark, d).collect()) == 1500


def test_rows_without_a_partner(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "event_id long, headline string")
    news = spark.createDataFrame([(2, "c"), (3, "d")], "event_id long, headline string")
    assert sorted(map(tuple, tables.upsert(old, news, ["event_id"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    from quillmark.operators import claims

    c = spark.createDataFrame([(1,), (2,)], "claim_id long")
    cited = spark.createDataFrame([(1, "pib", 1)], "claim_id long, source_name string, source_tier int")
    assert {r.claim_id: (r.n_sources, r.verified, r.note) for r in claims.verify_floor(c, cited).collect()} == {1: (1, True, ""), 2: (0, False, "no valid source")}


def test_every_label_has_a_centroid(spark, tmp_path):
    rows = [(i, [float(i % 10 == k) + 0.01 for k in range(10)], i % 10) for i in range(40)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = registry.queries()["centroid_topk"](spark, str(tmp_path)).collect()
    assert sorted((r.label, r.id) for r in got) == sorted((k, k + 10 * n) for k in range(10) for n in range(3))
