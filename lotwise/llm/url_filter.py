"""URL filters: host and path rules, and gradient-boosted trees on lexical features for the URLs without a rule.

DataFrame functions and the DataFrame-based ML library only.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shared_dir, written

#: Fixed rules: (host and path, verdict).
RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]
#: Labelled URLs that the trees are fitted on, at most: those with the smallest hashes.
SAMPLE_ROWS = 20_000
#: Labelled URLs' worth of the prior in a suffix's rate; parts that the rows of a suffix are dealt to where its statistics are joined by a shuffle.
SMOOTH, SALTS = 20.0, 16
#: The rate of a suffix that a fitted URL sees comes from the URLs of the other folds.
FOLDS = 5
TREES, DEPTH, THRESHOLD, SEED = 10, 3, 0.5, 7
FEATURES = ["len_url", "len_host", "len_path", "depth", "labels", "digit_ratio", "hyphens", "entropy", "params", "fragment", "suffix_rate", "suffix_n"]
_SPLIT = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _SPLIT, 1), F.lit("")), _UPPER, _LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _SPLIT, 2), F.lit(""))


def matched_rule(h: Column, p: Column, rules: list[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, or nulls. A rule fits its host and all subdomains, and paths that start with its own."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: len(r[0])):  # the longest is asked first
        own, _, rest = text.partition("/")
        fits = ((h == own) | h.endswith("." + own)) & p.startswith("/" + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def lexical(url: Column, h: Column, p: Column) -> dict[str, Column]:
    """Length, depth, digits, entropy and parameters of a URL; null counts as empty."""
    u = F.coalesce(url, F.lit(""))
    query = F.regexp_extract(u, r"(?s)\?([^#]*)", 1)
    chars = F.split(u, "")
    n = F.greatest(F.length(u), F.lit(1)).cast("double")
    share = lambda c: F.size(F.filter(chars, lambda x: x == c)) / n
    entropy = F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda a, c: a - F.when(F.length(c) > 0, share(c) * F.log2(F.greatest(share(c), F.lit(1e-9)))).otherwise(0.0))
    return {
        "len_url": F.length(u), "len_host": F.length(h), "len_path": F.length(p),
        "depth": F.regexp_count(p, F.lit("/[^/]+")), "labels": F.regexp_count(h, F.lit("[^.]+")),
        "digit_ratio": F.regexp_count(u, F.lit("[0-9]")) / n, "hyphens": F.regexp_count(h, F.lit("-")), "entropy": entropy,
        "params": F.regexp_count(query, F.lit("[^&]+")), "fragment": F.instr(u, "#").cast("boolean").cast("int"),
    }


def described(pages: DataFrame, id_col: str, url_col: str, rules: list[tuple[str, str]]) -> DataFrame:
    """URLs with host, path, rule, the rule's verdict (_says, _y) and lexical features, as a written table."""
    rows = pages.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{url_col}`").cast("string").alias("_url"))
    rows = rows.withColumns({"host": host(F.col("_url")), "path": path(F.col("_url"))})
    rule, says = matched_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "_says": says} | lexical(F.col("_url"), F.col("host"), F.col("path")))
    rows = rows.withColumns({"_suffix": F.substring_index("host", ".", -1), "_y": (F.col("_says") == "block").cast("double"), "_fold": F.pmod(F.xxhash64("_url"), F.lit(FOLDS)).cast("int")})
    return written(rows, "urls")


def with_scores(rows: DataFrame, known: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """rows with ``score``, the probability of block by trees that are fitted on ``known``, rows with a verdict."""
    in_fold = lambda c: F.array(*[F.coalesce(F.sum(F.when(F.col("_fold") == k, c)), F.lit(0.0)) for k in range(FOLDS)])
    by_suffix = written(known.groupBy("_suffix").agg(in_fold(F.lit(1.0)).alias("n"), in_fold(F.col("_y")).alias("y")), "suffixes")
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    row = by_suffix.agg(F.sum(total(F.col("n"))).alias("n"), F.sum(total(F.col("y"))).alias("y")).first()
    n, y = row["n"] or 0.0, row["y"] or 0.0
    prior = y / n if n else 0.0
    if not n or y in (0.0, n):
        return rows.withColumn("score", F.lit(1.0 if n and y else 0.0))
    stats = by_suffix.select(F.col("_suffix").alias("_s"), F.col("n").alias("_n"), F.col("y").alias("_yes"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_part"))
    salt = F.pmod(F.xxhash64("_id", "_url"), F.lit(SALTS)).cast("int")

    def full(d: DataFrame, fitted: bool) -> DataFrame:
        d = d.withColumn("_salt", salt).join(stats, (F.col("_suffix") == F.col("_s")) & (F.col("_salt") == F.col("_part")), "left")
        own = lambda c: F.element_at(c, F.col("_fold") + 1) if fitted else F.lit(0.0)
        rate = (total(F.col("_yes")) - own(F.col("_yes")) + SMOOTH * prior) / (total(F.col("_n")) - own(F.col("_n")) + SMOOTH)
        return d.withColumns({"suffix_rate": F.coalesce(rate, F.lit(prior)), "suffix_n": F.coalesce(total(F.col("_n")) / n, F.lit(0.0))}).drop("_s", "_n", "_yes", "_salt", "_part")

    sample = known.dropDuplicates(["_url"]).orderBy(F.xxhash64("_url"), "_url").limit(sample_rows)
    assembler = VectorAssembler(inputCols=FEATURES, outputCol="_x")
    fitted = written(full(sample, True).select("_y", *FEATURES), "urls-fit").coalesce(4)
    if fitted.agg(F.count_distinct("_y")).first()[0] < 2:
        return rows.withColumn("score", F.lit(prior))
    model = GBTClassifier(featuresCol="_x", labelCol="_y", predictionCol="_p", maxIter=TREES, maxDepth=DEPTH, seed=SEED).setProbabilityCol("_q").setRawPredictionCol("_raw").fit(assembler.transform(fitted))
    return model.transform(assembler.transform(full(rows, False))).withColumn("score", vector_to_array("_q")[1])


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: list[tuple[str, str]] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Per row of pages: id, host, path, rule, verdict and score (the trees' probability of block).

    The verdict is the rule's, else block if the score reaches THRESHOLD, else allow. The URLs that a rule decides
    are the labelled ones: suffix statistics cover all of them (those of the other folds where a URL is fitted on),
    the trees a sample of at most ``sample_rows`` distinct URLs. With no labelled URL every score is 0; with labels of
    one kind only, every score says that one. Null URLs and those without ``://`` have empty host and path and are
    judged by the trees. Repeated rows get the same result; an empty table gives an empty one. Other columns of pages
    are not read; a very long URL is described whole, as one value.
    """
    shared_dir(pages.sparkSession)
    rows = described(pages, id_col, url_col, rules)
    scored = with_scores(rows, rows.where("_says is not null"), sample_rows)
    verdict = F.coalesce("_says", F.when(F.col("score") >= THRESHOLD, "block").otherwise("allow"))
    return scored.select(F.col("_id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), F.round("score", 9).alias("score"))


def held_out_figures(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: list[tuple[str, str]] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """urls, blocked, precision, recall and accuracy of the trees on the labelled URLs of one fold, fitted on the others."""
    shared_dir(pages.sparkSession)
    known = described(pages, id_col, url_col, rules).where("_says is not null")
    told = with_scores(known.where("_fold = 0"), known.where("_fold <> 0"), sample_rows).select("_y", (F.col("score") >= THRESHOLD).cast("double").alias("p"))
    hit = F.sum(F.col("_y") * F.col("p"))
    return told.agg(F.count("*").alias("urls"), F.sum("_y").alias("blocked"), (hit / F.sum("p")).alias("precision"), (hit / F.sum("_y")).alias("recall"), F.avg((F.col("_y") == F.col("p")).cast("double")).alias("accuracy"))


def op6_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))
