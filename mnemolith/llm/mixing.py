"""Mixing sources to target weights by iterative proportional fitting.

Token counts of the cells (source, language, topic) are raked to the three target marginals, one
after another, until no cell changes; documents are then sampled with the calibrated probability of their
cell. Targets are given, or are powers of the natural shares. DataFrame functions only. Rounds touch the
cell table alone, which has a row for each combination that occurs; sums of an axis are grouped and joined
back, so no value of an axis gathers its cells in a task. Only single totals come to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, materialize

AXES = ("source", "lang", "topic")
#: Powers of the natural token shares that the targets are; 1 keeps a marginal as it is.
ALPHA = {"source": 0.7, "lang": 0.8, "topic": 1.0}
#: Raking ends when no cell's weight changes by more than this share in a round, or after ROUNDS rounds.
TOLERANCE = 1e-8
ROUNDS = 40


def default_topic(text: str = "text") -> Column:
    """A coarse topic by form: tabular, legal, brief or prose (null text: brief)."""
    t = F.coalesce(F.col(text), F.lit(""))
    return (
        F.when(F.contains(t, F.lit(" | ")), "tabular")
        .when(F.contains(t, F.lit("License")) | F.contains(t, F.lit("All rights reserved")), "legal")
        .when(F.length(t) < 500, "brief")
        .otherwise("prose")
    )


def uniform(key: Column, seed: str) -> Column:
    """A number in [0, 1) that depends on the key and the seed alone."""
    text = F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)


def with_targets(cells: DataFrame, axis: str, alpha: float, given: dict | None) -> DataFrame:
    """Adds ``t_<axis>``: the share of tokens that the cell's value of the axis shall have."""
    sums = cells.groupBy(axis).agg(F.sum("tokens").cast("double").alias("_t"))
    if given is None:
        total = cells.agg(F.sum("tokens").cast("double")).first()[0] or 1.0
        sums = sums.select(F.col(axis).alias("_v"), F.when(F.col("_t") > 0, F.pow(F.col("_t") / F.lit(total), F.lit(alpha))).otherwise(0.0).alias("_s"))
    else:  # values that aren't named get nothing, as do those without tokens
        named = cells.sparkSession.createDataFrame([(k, float(v)) for k, v in given.items()], "_v string, _w double")
        sums = sums.join(named, F.col(axis).eqNullSafe(F.col("_v")), "left").select(F.col(axis).alias("_v"), F.when(F.col("_t") > 0, F.coalesce("_w", F.lit(0.0))).otherwise(0.0).alias("_s"))
    sums = materialize(sums)
    norm = sums.agg(F.sum("_s")).first()[0] or 1.0
    return cells.join(sums, F.col(axis).eqNullSafe(F.col("_v"))).withColumn(f"t_{axis}", F.col("_s") / F.lit(norm)).drop("_v", "_s")


def rake(cells: DataFrame, alpha: dict[str, float] = ALPHA, targets: dict[str, dict] | None = None, tolerance: float = TOLERANCE, rounds: int = ROUNDS) -> DataFrame:
    """Adds ``w``: ``tokens`` raked until an axis value's share is its target, and ``change``: how much the
    last round changed the cell. ``targets`` maps an axis to shares by value; without it the target is the
    token share to the power alpha, normalised. Values without tokens get none. Where the targets contradict
    each other, as cells that don't occur can make them, the last axis of the last round is met."""
    for a in AXES:
        cells = with_targets(cells, a, alpha[a], (targets or {}).get(a))
    cells = materialize(cells.withColumn("w", F.col("tokens").cast("double")).withColumn("change", F.lit(0.0)))
    for _ in range(rounds):
        now = cells.withColumn("_was", F.col("w"))
        for a in AXES:  # written for each axis: sums of a table that is joined sums itself double the plan three times over
            sums = now.groupBy(F.col(a).alias("_v")).agg(F.nullif(F.sum("w"), F.lit(0.0)).alias("_s"))
            now = now.join(sums, F.col(a).eqNullSafe(F.col("_v"))).withColumn("w", F.coalesce(F.col("w") * F.col(f"t_{a}") / F.col("_s"), F.lit(0.0))).drop("_v", "_s")
            now = now if a == AXES[-1] else materialize(now)
        cells = materialize(now.withColumn("change", F.when(F.col("_was") > 0, F.abs(F.col("w") / F.col("_was") - 1)).otherwise(0.0)).drop("_was"))
        if (cells.agg(F.max("change")).first()[0] or 0.0) <= tolerance:
            break
    return cells


def marginals(cells: DataFrame) -> DataFrame:
    """``axis, value, target, reached`` of raked cells: the shares of tokens wanted and expected."""
    total = cells.agg(F.sum("w")).first()[0] or 1.0
    out = [cells.groupBy(F.lit(a).alias("axis"), F.col(a).alias("value")).agg(F.first(f"t_{a}").alias("target"), (F.sum("w") / F.lit(total)).alias("reached")) for a in AXES]
    return out[0].unionByName(out[1]).unionByName(out[2])


def document_cells(docs: DataFrame, text_col: str, source_col: str, lang_col: str, topic: Column | None) -> list[Column]:
    """The axes and the token count of a row, as columns named ``_source, _lang, _topic, _tokens``."""
    tokens = F.coalesce(F.regexp_count(F.col(text_col), F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")
    return [
        F.col(source_col).cast("string").alias("_source"),
        F.col(lang_col).cast("string").alias("_lang"),
        (default_topic(text_col) if topic is None else topic).alias("_topic"),
        tokens.alias("_tokens"),
    ]


def raked_cells(rows: DataFrame, alpha: dict[str, float], targets: dict[str, dict] | None) -> DataFrame:
    """Raked cells of rows with the columns above."""
    return rake(materialize(rows.groupBy(*(F.col(f"_{a}").alias(a) for a in AXES)).agg(F.sum("_tokens").alias("tokens"))), alpha, targets)


def cell_probabilities(rows: DataFrame, alpha: dict[str, float], targets: dict[str, dict] | None) -> DataFrame:
    """``c_source, c_lang, c_topic, probability`` of each cell."""
    cells = raked_cells(rows, alpha, targets)
    scale = cells.where("w > 0").agg(F.min(F.col("tokens") / F.col("w"))).first()[0] or 1.0
    p = F.when(F.col("tokens") == 0, 1.0).otherwise(F.least(F.lit(1.0), F.col("w") / F.col("tokens") * F.lit(scale)))
    return broadcast_if_small(materialize(cells.select(*(F.col(a).alias(f"c_{a}") for a in AXES), p.alias("probability"))))


def with_probability(rows: DataFrame, cells: DataFrame) -> DataFrame:
    return rows.join(cells, [F.col(f"_{a}").eqNullSafe(F.col(f"c_{a}")) for a in AXES])


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", topic: Column | None = None, alpha: dict[str, float] = ALPHA, targets: dict[str, dict] | None = None, seed: str = "mix") -> DataFrame:
    """``doc_id, source, lang, topic, n_tokens, probability, selected`` for every row.

    ``targets`` gives the shares of tokens wanted, by axis and value; an axis that it leaves out has its
    natural shares to the power of ``alpha``. A cell's probability is its raked weight over its tokens, scaled
    so that the largest is 1: the largest sample whose expected token shares are the targets. A null source, language or topic is a
    value of its own. Cells without tokens weigh nothing and are kept. Repeated rows with one id share
    their draw. An empty table gives an empty result.
    """
    rows = materialize(docs.select(F.col(id_col).alias("doc_id"), *document_cells(docs, text_col, source_col, lang_col, topic)))
    out = with_probability(rows, cell_probabilities(rows, alpha, targets))
    return out.select(
        "doc_id",
        *(F.col(f"_{a}").alias(a) for a in AXES),
        F.col("_tokens").alias("n_tokens"),
        F.round("probability", 6).alias("probability"),
        (uniform(F.col("doc_id"), seed) < F.col("probability")).alias("selected"),
    )


def sample_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", topic: Column | None = None, alpha: dict[str, float] = ALPHA, targets: dict[str, dict] | None = None, seed: str = "mix", draw: Column | None = None) -> DataFrame:
    """The rows that mix_sources selects, with the columns they came with; no text is shuffled. The draw
    is by id, or by the value of ``draw`` if it is given."""
    light = document_cells(docs, text_col, source_col, lang_col, topic)
    cells = cell_probabilities(materialize(docs.select(*light)), alpha, targets)
    row = F.struct(*(docs[c] for c in docs.columns)).alias("_row")
    drawn = uniform(docs[id_col] if draw is None else draw, seed).alias("_drawn")
    return with_probability(docs.select(row, drawn, *light[:3]), cells).where("_drawn < probability").select("_row.*")


def op3_mixing(spark, sf_dir: str) -> DataFrame:
    return mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: Rounds after which the query's table has long converged to six decimals.
SQL_ROUNDS = 20


def _sql() -> str:
    parts = [
        r"""rows_ AS (SELECT doc_id, source, lang, CASE WHEN contains(coalesce(text, ''), ' | ') THEN 'tabular'
  WHEN contains(coalesce(text, ''), 'License') OR contains(coalesce(text, ''), 'All rights reserved') THEN 'legal'
  WHEN length(coalesce(text, '')) < 500 THEN 'brief' ELSE 'prose' END AS topic,
  coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS n_tokens FROM documents)""",
        "cells AS (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS tokens FROM rows_ GROUP BY ALL)",
    ]
    for a in AXES:
        parts.append(f"s_{a} AS (SELECT {a} AS v, pow(sum(tokens) / (SELECT sum(tokens) FROM cells), {ALPHA[a]}) AS s FROM cells GROUP BY {a})")
    parts.append("c0 AS (SELECT cells.*, " + ", ".join(f"(SELECT s / (SELECT sum(s) FROM s_{a}) FROM s_{a} WHERE v IS NOT DISTINCT FROM cells.{a}) AS t_{a}" for a in AXES) + ", tokens AS w FROM cells)")
    for i in range(SQL_ROUNDS * 3):
        a = AXES[i % 3]
        parts.append(f"c{i + 1} AS MATERIALIZED (SELECT * REPLACE (coalesce(w * t_{a} / nullif(sum(w) OVER (PARTITION BY {a}), 0), 0) AS w) FROM c{i})")
    last = f"c{SQL_ROUNDS * 3}"
    return (
        "WITH "
        + ",\n".join(parts)
        + f"""
SELECT r.doc_id, r.source, r.lang, r.topic, r.n_tokens, round(p, 6) AS probability,
  ('0x' || substr(md5('mix:' || coalesce(r.doc_id::VARCHAR, 'null')), 1, 8))::BIGINT / 4294967296.0 < p AS selected
FROM rows_ r JOIN (SELECT source, lang, topic, CASE WHEN w > 0 THEN least(1.0, w / tokens * (SELECT min(tokens / w) FROM {last} WHERE w > 0)) ELSE 1.0 END AS p FROM {last}) c
ON r.source IS NOT DISTINCT FROM c.source AND r.lang IS NOT DISTINCT FROM c.lang AND r.topic IS NOT DISTINCT FROM c.topic"""
    )


SQL = _sql()
