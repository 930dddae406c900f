"""Mixing sources to target weights by iterative proportional fitting.

Every document belongs to a cell (source, language, topic) and weighs its tokens (white-space words). Raking scales the
cells' token weights until they meet target shares for each source, language and topic; a document's probability is its
cell's ratio of raked to given weight, scaled so that the expected tokens of the sample are the budget. Probabilities
above 1 are held at 1 and the rest is scaled up until the budget is met. A document is drawn if a hash of its doc_id,
read as a number in [0, 1), lies below its probability, so the same documents are drawn on every run.

Targets are shares over the values that a margin has; without given targets they are tempered token shares
(share ** TEMPER, normed), so a source that holds a third of all tokens is cut and rare ones are raised. A topic is any
column or expression over docs that the caller gives (a classifier's labels, say); without one it is the kind of text, by
a rule: table, symbols, notice or prose.

Cells are summed by Spark over all rows, partial sums first. Their number is the product of the margins' sizes: up to
MAX_CELLS the cells are raked on the driver, beyond that by the same passes over a DataFrame, cut at each pass.

Null sources and languages are values of their own ('?'); null and empty texts weigh 0 tokens and are kept exactly if
drawn like any other of their cell (cells without tokens have probability 1). Repeated doc_ids are drawn together. Extra
columns pass through where a caller keeps them. Empty input gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metaloom.llm.shared import cut

MARGINS = ("source", "lang", "topic")
BUDGET, TEMPER, PASSES, TOLERANCE = 0.5, 0.5, 60, 1e-9
MAX_CELLS, SEED = 200_000, 2026
#: Parts into which a cell's documents are dealt where cells are too many for a broadcast.
SALTS = 64


def topic_of(text: Column) -> Column:
    """table (many bars), symbols (runs of marks), notice (license lines) or prose."""
    words = F.greatest(n_words(text), F.lit(1))
    bars, marks = F.regexp_count(text, F.lit(r" \| ")), F.regexp_count(text, F.lit(r"[#$%&*!]{2,}"))
    return F.when(bars * 5 > words, "table").when(marks * 5 > words, "symbols").when(text.contains("License"), "notice").otherwise("prose")


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def with_cells(docs: DataFrame, topic: Column | None = None) -> DataFrame:
    """The columns row (all of docs, so that no name can clash), _source, _lang, _topic and _tokens."""
    text = F.coalesce("text", F.lit(""))
    kind = topic_of(text) if topic is None else F.coalesce(topic.cast("string"), F.lit("?"))
    return docs.select(F.struct("*").alias("row"), F.coalesce("source", F.lit("?")).alias("_source"), F.coalesce("lang", F.lit("?")).alias("_lang"), kind.alias("_topic"), n_words(text).alias("_tokens"))


def tempered(totals: dict[str, float], temper: float = TEMPER) -> dict[str, float]:
    """Target shares of a margin's values."""
    raised = {k: v**temper for k, v in totals.items() if v > 0}
    whole = sum(raised.values())
    return {k: v / whole for k, v in raised.items()} if whole else {}


def rake(weights: np.ndarray, codes: list[np.ndarray], targets: list[np.ndarray], passes: int = PASSES) -> np.ndarray:
    """Weights scaled so that each margin's sums are its targets (which sum to the same), as nearly as cells allow."""
    w = weights.astype(np.float64).copy()
    for _ in range(passes):
        worst = 0.0
        for code, target in zip(codes, targets):
            sums = np.bincount(code, w, len(target))
            ratio = np.divide(target, sums, out=np.ones_like(target), where=sums > 0)
            worst = max(worst, float(np.abs(ratio - 1)[sums > 0].max(initial=0)))
            w *= ratio[code]
        if worst < TOLERANCE:
            break
    return w


def probabilities(given: np.ndarray, raked: np.ndarray, budget: float) -> np.ndarray:
    """Probabilities in proportion to raked / given, at most 1, whose expected weight is budget (or all there is)."""
    ratio = np.divide(raked, given, out=np.zeros_like(raked), where=given > 0)
    p, full = np.zeros(len(given)), np.zeros(len(given), bool)
    for _ in range(len(given) + 1):
        left, room = budget - given[full].sum(), (given * ratio)[~full].sum()
        p = np.where(full, 1.0, ratio * (left / room if room > 0 else 0.0))
        more = ~full & (p > 1)
        if not more.any():
            break
        full |= more
    return np.where(given > 0, np.clip(p, 0, 1), 1.0)


def _cells_on_driver(cells: list, targets: dict[str, dict[str, float]], budget: float) -> list[tuple]:
    given = np.array([c._tokens for c in cells], np.float64)
    total, codes, goals = given.sum(), [], []
    for m in MARGINS:
        values = sorted({c[f"_{m}"] for c in cells})
        number = {v: i for i, v in enumerate(values)}
        codes.append(np.array([number[c[f"_{m}"]] for c in cells]))
        sums = dict(zip(values, np.bincount(codes[-1], given, len(values)).tolist()))
        share = targets.get(m) or tempered(sums)
        here = {v: share.get(v, 0.0) for v in values if sums[v] > 0}
        whole = sum(here.values()) or 1.0
        goals.append(np.array([here.get(v, 0.0) / whole * total for v in values]))
    raked = rake(given, codes, goals)
    p = probabilities(given, raked, budget * total)
    return [(c._source, c._lang, c._topic, float(r), float(x)) for c, r, x in zip(cells, raked, p)]


def _cells_by_spark(cells: DataFrame, targets: dict[str, dict[str, float]], budget: float) -> DataFrame:
    """The same passes over a DataFrame, for more cells than the driver takes; targets given as shares or tempered."""
    spark = cells.sparkSession
    total = float(cells.agg(F.sum("_tokens")).first()[0] or 0)
    now = cells.withColumn("w", F.col("_tokens").cast("double"))
    goals = {}
    for m in MARGINS:
        sums = cells.groupBy(f"_{m}").agg(F.sum("_tokens").alias("s")).where("s > 0")
        if targets.get(m):
            share = sums.join(spark.createDataFrame(list(targets[m].items()), f"_{m} string, g double"), f"_{m}", "left").select(f"_{m}", F.coalesce("g", F.lit(0.0)).alias("g"))
        else:
            share = sums.select(f"_{m}", F.pow("s", F.lit(TEMPER)).alias("g"))
        whole = share.agg(F.sum("g")).first()[0] or 1.0
        goals[m] = cut(share.withColumn("g", F.col("g") * total / whole), "goal")
    for _ in range(PASSES):
        worst = 0.0
        for m in MARGINS:
            sums = now.groupBy(f"_{m}").agg(F.sum("w").alias("s")).join(goals[m], f"_{m}", "left")
            ratio = sums.select(f"_{m}", F.when(F.col("s") > 0, F.col("g") / F.col("s")).otherwise(1.0).alias("r"))
            now = cut(now.join(ratio, f"_{m}").withColumn("w", F.col("w") * F.col("r")).withColumn("e", F.abs(F.col("r") - 1)), "rake")
            worst = max(worst, now.agg(F.max("e")).first()[0] or 0.0)
            now = now.drop("r", "e")
        if worst < TOLERANCE:
            break
    rows = now.withColumn("ratio", F.when(F.col("_tokens") > 0, F.col("w") / F.col("_tokens")).otherwise(0.0))
    scale = 0.0
    while True:  # each turn holds more cells at 1
        full = F.lit(False) if not scale else F.col("ratio") * scale >= 1
        held, room = rows.agg(F.sum(F.when(full, F.col("_tokens")).otherwise(0)), F.sum(F.when(full, 0.0).otherwise(F.col("w")))).first()
        after = (budget * total - float(held or 0)) / room if room else scale
        if after <= scale * (1 + 1e-12):
            break
        scale = after
    p = F.when(F.col("_tokens") > 0, F.least(F.lit(1.0), F.col("ratio") * scale)).otherwise(1.0)
    return rows.select("_source", "_lang", "_topic", F.col("w").alias("_weight"), p.alias("_p"))


def drawn(doc_id: Column, p: Column, seed: int = SEED) -> Column:
    """Whether a hash of doc_id, as a number in [0, 1), lies below p."""
    return F.pmod(F.xxhash64(F.lit(seed), doc_id.cast("string")), F.lit(1 << 52)).cast("double") / float(1 << 52) < p


def mix(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, budget: float = BUDGET, max_cells: int = MAX_CELLS, topic: Column | None = None) -> DataFrame:
    """A row per row of docs (doc_id, text, source, lang): row, _source, _lang, _topic, _tokens, _weight (of the cell,
    raked), _p and _drawn."""
    spark, targets = docs.sparkSession, targets or {}
    marked = with_cells(docs, topic)
    cells = cut(marked.groupBy("_source", "_lang", "_topic").agg(F.sum("_tokens").alias("_tokens")), "cells")
    n = cells.count()
    if n <= max_cells:
        rows = _cells_on_driver(cells.collect(), targets, budget) if n else []
        kinds = {"_source": pa.string(), "_lang": pa.string(), "_topic": pa.string(), "_weight": pa.float64(), "_p": pa.float64()}
        # an Arrow table, as a list of rows would start Python workers on the executors that stay idle
        raked = spark.createDataFrame(pa.table([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds.values())], list(kinds)))
        joined = marked.join(F.broadcast(raked), ["_source", "_lang", "_topic"])  # max_cells rows at most
    else:
        raked = _cells_by_spark(cells, targets, budget).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salted = marked.withColumn("_salt", F.pmod(F.xxhash64("row.doc_id", "_tokens"), F.lit(SALTS)).cast("int"))
        joined = salted.join(raked, ["_source", "_lang", "_topic", "_salt"]).drop("_salt")
    return joined.withColumn("_drawn", drawn(F.col("row.doc_id"), F.col("_p")))


def mixing_report(docs: DataFrame) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, cell_weight, probability, sampled: a row per document."""
    mixed = mix(docs.select("doc_id", "text", "source", "lang"))
    return mixed.select("row.doc_id", F.col("_source").alias("source"), F.col("_lang").alias("lang"), F.col("_topic").alias("topic"), F.col("_tokens").alias("n_tokens"), F.col("_weight").alias("cell_weight"), F.col("_p").alias("probability"), F.col("_drawn").alias("sampled"))
