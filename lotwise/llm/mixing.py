"""Mixing sources to target weights: iterative proportional fitting of token weights, then calibrated sampling.

DataFrame functions only. Documents fall into cells (source, language, topic); only the cells take part in the
iteration, so its cost does not depend on the number of documents.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, written

#: Exponents that flatten each dimension's own shares of tokens into targets; 1 keeps them, 0 makes them equal.
FLATTEN = {"source": 0.7, "lang": 0.5, "topic": 0.8}
#: Expected share of all tokens that the sample holds.
BUDGET = 0.8
TOLERANCE, SWEEPS, ROUNDS, SEED = 1e-8, 40, 20, "mix-1"
#: Sweeps of one job, after which the deviation is read.
STEP = 4
WORD = r"[^\x20\x09-\x0D]+"


def tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def topic(text: Column, n_tokens: Column) -> Column:
    """A coarse topic by the shape of the whole text; ``mix`` takes any other column of topics as well."""
    digits, lines = F.regexp_count(text, F.lit("[0-9]")), F.regexp_count(text, F.lit("\n"))
    return (
        F.when(n_tokens < 50, "brief")
        .when(digits * 20 >= F.length(text), "figures")
        .when((lines + 1) * 12 >= n_tokens, "listing")
        .when(n_tokens >= 1000, "longform")
        .otherwise("article")
    )


def targets(cells: DataFrame, dim: str, power: float) -> DataFrame:
    """(dim, target): the shares of tokens to the power, scaled to sum to 1."""
    share = cells.groupBy(dim).agg(F.sum("tokens").cast("double").alias("t")).where("t > 0").select(dim, F.pow("t", F.lit(power)).alias("p"))
    return share.crossJoin(F.broadcast(share.agg(F.sum("p").alias("all")))).select(dim, (F.col("p") / F.col("all")).alias("target"))  # one row


def rake(cells: DataFrame, marginals: dict[str, DataFrame], tolerance: float = TOLERANCE, sweeps: int = SWEEPS) -> DataFrame:
    """Cells with a ``w`` that sums to the target of every value of every dimension.

    Starts from the shares of tokens and scales one dimension after another until no sum is off by more than
    ``tolerance`` of its target; a warning says what is left if that is not so after ``sweeps``, as where targets
    contradict empty cells. The windows run over cells only. Values that a marginal does not list keep no weight.
    """
    total = cells.agg(F.sum("tokens").cast("double").alias("all"))
    dims = list(marginals)
    cells = cells.where("tokens > 0").crossJoin(F.broadcast(total)).select(*cells.columns, (F.col("tokens") / F.col("all")).alias("w"))
    for dim, target in marginals.items():
        cells = cells.join(target.select(F.col(dim), F.col("target").alias(f"_t_{dim}")), dim, "left").fillna(0.0, [f"_t_{dim}"])
    cells, worst = checkpointed(cells), None
    for _ in range(0, sweeps, STEP):
        for _ in range(STEP):
            for dim in dims:
                now = F.sum("w").over(Window.partitionBy(dim))
                cells = cells.withColumn("_f", F.when(now > 0, F.col(f"_t_{dim}") / now).otherwise(0.0)).withColumn(f"_off_{dim}", F.when(now > 0, F.abs(F.col("_f") - 1)).otherwise(0.0)).withColumn("w", F.col("w") * F.col("_f"))
        cells = checkpointed(cells.drop("_f"))
        worst = cells.agg(F.greatest(*[F.max(f"_off_{dim}") for dim in dims])).first()[0]
        if worst is None or worst <= tolerance:
            break
    else:
        warnings.warn(f"after {sweeps} sweeps a marginal is off by {worst:.3g} of its target", stacklevel=2)
    return cells.drop(*[f"{k}_{dim}" for dim in dims for k in ("_t", "_off")])


def calibrate(cells: DataFrame, budget: float = BUDGET, rounds: int = ROUNDS) -> DataFrame:
    """Cells with ``p``: min(1, c * w / tokens), with c such that the expected tokens are ``budget`` of all.

    Cells that reach 1 stay there; the rest share what is left, again until no more cell reaches 1. One row is read
    back from each round.
    """
    rate = F.col("w") / F.col("tokens")
    c = None
    for _ in range(rounds):
        full = F.lit(False) if c is None else c * rate >= 1
        row = cells.agg(F.sum("tokens").alias("all"), F.sum(F.when(full, F.col("tokens"))).alias("full"), F.sum(F.when(~full, F.col("w"))).alias("open")).first()
        if not row["all"] or not row["open"]:
            break
        new = (budget * row["all"] - (row["full"] or 0)) / row["open"]
        if c is not None and abs(new - c) <= 1e-12 * new:
            break
        c = new
    else:
        warnings.warn(f"after {rounds} rounds cells still reach probability 1; the sample misses its budget by what they would share", stacklevel=2)
    return cells.withColumn("p", F.least(F.lit(1.0), F.lit(c if c is not None else 0.0) * rate))


def uniform(key: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) from the key and the seed: the first 32 bits of an MD5."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit("")))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", topic_col: Column | None = None) -> DataFrame:
    count = tokens(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce("source", F.lit("")).alias("source"), F.coalesce("lang", F.lit("")).alias("lang"), F.col(text_col).alias("text"), count.alias("tokens"), *([topic_col.alias("topic")] if topic_col is not None else []))
    if topic_col is None:
        rows = rows.withColumn("topic", topic(F.coalesce("text", F.lit("")), F.col("tokens")))
    return rows.withColumn("topic", F.coalesce("topic", F.lit(""))).drop("text")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", topic_col: Column | None = None, flatten: dict[str, float] | None = None, marginals: dict[str, DataFrame] | None = None, budget: float = BUDGET, seed: str = SEED, sweeps: int = SWEEPS) -> DataFrame:
    """Per row of docs: id, source, lang, topic, tokens, weight, p and kept.

    ``weight`` is the raked share of a token of the document's cell relative to its share before, ``p`` the
    probability of keeping the document, and ``kept`` whether its uniform number is below p. Targets are
    ``marginals`` (dimension to a table of value and target), else the flattened own shares. Null source, language or
    topic is the value ''. Texts without words (null, empty) hold no tokens: weight 0, p 1, kept. Repeated rows share
    their decision. An empty table gives an empty result. Columns of docs other than id, text, source and lang are
    not read. Very long texts are only counted.
    """
    rows = written(features(docs, id_col, text_col, topic_col), "features")
    cells = written(rows.groupBy("source", "lang", "topic").agg(F.sum("tokens").alias("tokens")), "cells")
    goals = marginals or {dim: targets(cells, dim, power) for dim, power in (flatten or FLATTEN).items()}
    raked = calibrate(rake(cells, goals, sweeps=sweeps), budget)
    total = raked.agg(F.sum("tokens").alias("_all"))
    raked = raked.crossJoin(F.broadcast(total)).select("source", "lang", "topic", (F.col("w") / F.col("tokens") * F.col("_all")).alias("weight"), "p")
    raked = written(raked, "weights")
    out = rows.join(raked, ["source", "lang", "topic"], "left")
    p = F.when(F.col("tokens") == 0, 1.0).otherwise(F.coalesce("p", F.lit(0.0)))
    weight = F.when(F.col("tokens") == 0, 0.0).otherwise(F.coalesce("weight", F.lit(0.0)))
    return out.select(F.col("id").alias(id_col), "source", "lang", "topic", "tokens", weight.alias("weight"), p.alias("p"), (uniform(F.col("id"), seed) < p).alias("kept"))


def op1_mix_sources(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs).withColumns({"weight": F.round("weight", 6), "p": F.round("p", 6)})


def mix_sql(table: str, flatten: dict[str, float] = FLATTEN, budget: float = BUDGET, seed: str = SEED, sweeps: int = SWEEPS, rounds: int = 12, head: str = "") -> str:
    """The same in SQL, with a fixed number of sweeps and rounds written out."""
    q = f"""
WITH {head}
rows_ AS MATERIALIZED (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, coalesce(text, '') AS body,
  len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS tokens FROM {table}),
feat AS MATERIALIZED (SELECT doc_id, source, lang, tokens,
  CASE WHEN tokens < 50 THEN 'brief' WHEN len(regexp_extract_all(body, '[0-9]')) * 20 >= length(body) THEN 'figures'
       WHEN (len(regexp_extract_all(body, '\\n')) + 1) * 12 >= tokens THEN 'listing' WHEN tokens >= 1000 THEN 'longform' ELSE 'article' END AS topic
  FROM rows_),
cells AS MATERIALIZED (SELECT source, lang, topic, sum(tokens)::DOUBLE AS tokens FROM feat GROUP BY ALL HAVING sum(tokens) > 0),
"""
    for dim, power in flatten.items():
        q += f"goal_{dim} AS MATERIALIZED (SELECT {dim}, pow(sum(tokens), {power}) / sum(pow(sum(tokens), {power})) OVER () AS target FROM cells GROUP BY {dim}),\n"
    q += "w0 AS MATERIALIZED (SELECT *, tokens / sum(tokens) OVER () AS w FROM cells),\n"
    k = 0
    for _ in range(sweeps):
        for dim in flatten:
            q += f"w{k + 1} AS MATERIALIZED (SELECT source, lang, topic, tokens, w * g.target / sum(w) OVER (PARTITION BY {dim}) AS w FROM w{k} JOIN goal_{dim} g USING ({dim})),\n"
            k += 1
    q += f"c0 AS MATERIALIZED (SELECT {budget} * sum(tokens) / sum(w) AS c FROM w{k}),\n"
    for i in range(rounds):
        q += f"c{i + 1} AS MATERIALIZED (SELECT coalesce(({budget} * sum(tokens) - coalesce(sum(tokens) FILTER (c * w / tokens >= 1), 0)) / sum(w) FILTER (c * w / tokens < 1), any_value(c)) AS c FROM w{k}, c{i}),\n"
    q += f"prob AS MATERIALIZED (SELECT source, lang, topic, w / tokens * sum(tokens) OVER () AS weight, least(1.0, c * w / tokens) AS p FROM w{k}, c{rounds}),\n"
    q += f"""mixed AS MATERIALIZED (SELECT doc_id, f.source, f.lang, f.topic, f.tokens,
  CASE WHEN f.tokens = 0 THEN 0 ELSE coalesce(weight, 0) END AS weight, CASE WHEN f.tokens = 0 THEN 1 ELSE coalesce(p, 0) END AS p,
  ('0x' || substr(md5('{seed}:' || doc_id::VARCHAR), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
  FROM feat f LEFT JOIN prob USING (source, lang, topic))
"""
    return q


OP1_SQL = mix_sql("documents") + "SELECT doc_id, source, lang, topic, tokens, round(weight, 6) AS weight, round(p, 6) AS p, u < p AS kept FROM mixed"
