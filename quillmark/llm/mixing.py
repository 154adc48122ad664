"""Mixing sources to target weights, with DataFrame operations only.

Weights are shares of tokens raised to an exponent and normalised (temperature mixing). The exponent is bisected: the
largest in [0, 1] whose entropy reaches a target, or the smallest whose highest repetition keeps to a limit. A budget
of tokens is then realised per source: whole epochs, and one partial epoch. Each epoch is a permutation of the
source's blocks (by a hash) and of the documents in each block; the partial epoch takes blocks in that order while
the budget lasts, and of the block where it ends the documents that still fit.

A source's documents are dealt to blocks of about BLOCK documents by a hash of their ids and texts, so a source with a
third of all rows is many groups. Rows that are equal in id, text and source are one row with a count until they are
dealt out. Sums per block are windowed, not documents. Only sums over all sources reach the driver.

A document costs its number of words, one at least (null text is empty). A null source counts as the source ''. Null
ids and repeated rows are documents like others. Extra columns are ignored here; `mixed_rows` keeps all columns, whatever
their names. An empty table gives no rows. Budget "cover" is the smallest that uses every document at least once.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.llm.common import materialize, text_or_empty

#: Documents of a block, about, steps of the bisection, and steps that one job decides.
BLOCK, STEPS, AT_ONCE = 4096, 40, 4
WORD = r"[^\x20\x09-\x0D]+"


def _draw(*parts: Column) -> Column:
    """A hash as hexadecimal text, the same in any SQL engine that has md5."""
    return F.md5(F.concat_ws("|", *parts))


def _cost(text: Column) -> Column:
    return F.greatest(F.lit(1), F.regexp_count(text_or_empty(text), F.lit(WORD))).cast("long")


def _name(doc_id: Column, text: Column) -> Column:
    """What tells documents apart: the id, and 64 bits of the text."""
    return F.concat(F.coalesce(doc_id.cast("long").cast("string"), F.lit("")), F.lit("|"), F.substring(F.md5(text_or_empty(text)), 1, 16))


def _costs(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """doc_id, source, tokens, name and copies of the distinct documents."""
    i, t = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    rows = docs.select(i.cast("long").alias("doc_id"), text_or_empty(F.col(f"`{source_col}`")).alias("source"), _cost(t).alias("tokens"), _name(i, t).alias("name"))
    return rows.groupBy("doc_id", "source", "tokens", "name").agg(F.count("*").alias("copies"))


def find_exponent(sources: DataFrame, budget: float | None, target_entropy: float | None, max_repetition: float | None) -> float:
    """The exponent for a table (source, tokens, total); target_entropy is a share of the highest possible one; with
    max_repetition and no budget, of the budget that uses every document at least once. A job measures all the places
    that the next AT_ONCE steps of the bisection may come to."""

    def measured(alphas: list[float]) -> list[float]:
        p = [F.pow(F.col("tokens") / F.col("total"), F.lit(a)) for a in alphas]
        sums = [f for x in p for f in (F.sum(x), F.sum(x * F.log(x)), F.max(x / F.col("tokens")), F.min(x / F.col("tokens")))]
        n, *found = sources.agg(F.count("*"), *sums).head()
        out = []
        for k in range(len(alphas)):
            z, plogp, top, least = found[4 * k : 4 * k + 4]
            if target_entropy is not None:
                out.append((math.log(z) - plogp / z) - target_entropy * math.log(n))
            else:
                out.append(max_repetition - (top / least if budget is None else budget * top / z))
        return out

    low, high = 0.0, 1.0
    up = target_entropy is not None  # entropy falls with the exponent, so seek the largest; else the smallest
    if measured([high if up else low])[0] >= 0:
        return high if up else low
    for _ in range(0, STEPS, AT_ONCE):
        ends, places = [(low, high)], []
        for _ in range(AT_ONCE):
            places += [(a + b) / 2 for a, b in ends]
            ends = [half for a, b in ends for half in ((a, (a + b) / 2), ((a + b) / 2, b))]
        ok = dict(zip(places, measured(places), strict=True))
        for _ in range(AT_ONCE):
            mid = (low + high) / 2
            if (ok[mid] >= 0) == up:
                low = mid
            else:
                high = mid
    return round(low if up else high, 9)


def source_quotas(sources: DataFrame, alpha: float, budget: int | str | None) -> DataFrame:
    """(source, weight, source_tokens, blocks, quota) of a table (source, tokens, docs, total). Quotas come from whole
    shares; only the weight that is shown is rounded."""
    p = F.pow(F.col("tokens") / F.col("total"), F.lit(alpha))
    z, each, total = sources.agg(F.sum(p), F.max(F.col("tokens") / p), F.max("total")).head()  # one row
    share = p / F.lit(z)
    whole = F.lit(0.0 if z is None else float(math.ceil(each * z)) if budget == "cover" else float(total if budget is None else budget))
    quota = F.floor(F.round(whole * share, 6))  # rounded, so that a whole number stays one
    if budget == "cover":
        quota = F.greatest(quota, F.col("tokens"))
    return sources.select("source", F.round(share, 9).alias("weight"), F.col("tokens").alias("source_tokens"), F.ceil(F.col("docs") / BLOCK).alias("blocks"), quota.alias("quota"))


def mix_sources(
    docs: DataFrame, budget: int | str | None = None, target_entropy: float | None = None, max_repetition: float | None = None,
    seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", one_row_each: bool = True,
) -> DataFrame:
    """One row per use of a document: doc_id, source, tokens, weight, epoch (from 0), block, block_rank, doc_rank (from 1);
    without one_row_each one row per distinct document and epoch, with copies and how many of them are taken.

    budget: tokens of the mix; None: as many as there are; "cover": so many that every document is used once at least.
    """
    if (target_entropy is None) == (max_repetition is None):
        raise ValueError("give either target_entropy or max_repetition")
    table = materialize(_costs(docs, id_col, text_col, source_col), "mixing-costs")
    sums = table.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.sum("copies").alias("docs"))
    sums = materialize(sums, "mixing-sums")
    total = sums.agg(F.sum("tokens")).head()[0]
    sources = sums.withColumn("total", F.lit(total).cast("long"))
    alpha = 1.0 if total is None else find_exponent(sources, None if budget == "cover" else (total if budget is None else budget), target_entropy, max_repetition)
    plan = source_quotas(sources, alpha, budget)
    plan = materialize(plan.select("*", F.floor(F.col("quota") / F.col("source_tokens")).alias("epochs"), (F.col("quota") % F.col("source_tokens")).alias("rest")), "mixing-plan")

    place = F.conv(F.substring(_draw(F.lit(f"{seed}b"), F.col("name")), 1, 8), 16, 10).cast("long")
    dealt = table.join(plan, "source").withColumn("block", place % F.col("blocks"))
    uses = dealt.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("epochs"))).alias("epoch"))

    def order(what: Column) -> Column:
        return _draw(F.lit(str(seed)), F.col("epoch").cast("string"), F.col("source"), what)

    drawn = uses.withColumn("draw", order(F.col("name")))
    inside = Window.partitionBy("source", "epoch", "block").orderBy("draw", "name", "tokens").rowsBetween(Window.unboundedPreceding, -1)
    ranked = drawn.select("*", F.coalesce(F.sum("copies").over(inside), F.lit(0)).alias("docs_before"), F.coalesce(F.sum(F.col("tokens") * F.col("copies")).over(inside), F.lit(0)).alias("tokens_before"))
    sizes = dealt.groupBy("source", "block", "epochs").agg(F.sum(F.col("tokens") * F.col("copies")).alias("block_tokens"))
    blocks = sizes.select("source", "block", "block_tokens", F.explode(F.sequence(F.lit(0).cast("long"), F.col("epochs"))).alias("epoch"))
    across = Window.partitionBy("source", "epoch").orderBy(order(F.concat(F.lit("b"), F.col("block").cast("string"))))
    blocks = blocks.select(
        "source", "block", "epoch", F.row_number().over(across).alias("block_rank"),
        (F.sum("block_tokens").over(across.rowsBetween(Window.unboundedPreceding, 0)) - F.col("block_tokens")).alias("before"),
    )
    used = ranked.join(blocks, ["source", "block", "epoch"])
    # of a partial epoch as many copies as still fit
    fits = F.floor((F.col("rest") - F.col("before") - F.col("tokens_before")) / F.col("tokens"))
    used = used.withColumn("taken", F.when(F.col("epoch") < F.col("epochs"), F.col("copies")).otherwise(F.greatest(F.lit(0), F.least(F.col("copies"), fits))))
    used = used.where("taken > 0")
    if not one_row_each:
        return used
    each = used.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("taken"))).alias("k"))
    return each.select("doc_id", "source", "tokens", "weight", "epoch", "block", "block_rank", (F.col("docs_before") + F.col("k")).cast("int").alias("doc_rank"))


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The documents with all their columns, each as often as the mix uses it; uses of rows that are equal in id, text and
    source go round among them."""
    used = mix_sources(docs, id_col=id_col, text_col=text_col, source_col=source_col, one_row_each=False, **how)
    times = used.groupBy("name", "source").agg(F.sum("taken").alias("uses"), F.max("copies").alias("rows"))
    times = materialize(times.withColumnRenamed("source", "from"), "mixing-times")
    names = [f"c{i}" for i in range(len(docs.columns))]
    at = {c: F.col(names[docs.columns.index(c)]) for c in (id_col, text_col, source_col)}
    own = docs.toDF(*names).select("*", _name(at[id_col], at[text_col]).alias("name"), text_or_empty(at[source_col]).alias("from"))
    joined = own.join(times, ["name", "from"])
    least, more = F.floor(F.col("uses") / F.col("rows")), F.col("uses") % F.col("rows")
    even = joined.where(more == 0).withColumn("times", least)
    # only rows that stand several times and can't be used equally often are counted off
    n = F.row_number().over(Window.partitionBy("name", "from").orderBy(F.lit(0)))
    uneven = joined.where(more != 0).withColumn("n", n).withColumn("times", least + F.when(F.col("n") <= more, 1).otherwise(0)).drop("n")
    copies = even.unionByName(uneven).where("times > 0").select(*names, F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))).alias("copy"))
    return copies.select(*names).toDF(*docs.columns)
