"""Operator 9: mixing sources to target weights by Efraimidis-Spirakis sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .session import maybe_broadcast, read, unused

#: Relative shares of the token budget; a source that isn't named has DEFAULT_TARGET.
TARGETS = {"src0": 4.0}
DEFAULT_TARGET = 1.0
#: The budget, as a part of the tokens there are.
BUDGET = 1.0
#: Sampling weights by the quality label; an unlabelled document has 1.
QUALITY = {1: 2.0, 0: 0.5}
SEED = 11
#: Sampling keys fall into so many ordered ranges a source; only the one with the budget's end is sorted.
RANGES = 16_384


def with_quality(docs: DataFrame, labels: DataFrame, weight_col: str, id_col: str = "doc_id", quality: dict[int, float] = QUALITY) -> DataFrame:
    """docs with the sampling weight of each: by the highest quality label of its id, 1 without one."""
    at, best = unused(docs, "labelled_id"), unused(docs, "best_quality")
    found = labels.filter(F.col(id_col).isNotNull() & F.col("quality").isNotNull()).groupBy(F.col(id_col).alias(at)).agg(F.max("quality").alias(best))
    weight = F.lit(1.0)
    for q, w in quality.items():
        weight = F.when(F.col(best) == q, w).otherwise(weight)
    return docs.join(maybe_broadcast(found, 500_000), F.col(id_col) == F.col(at), "left").withColumn(weight_col, weight).drop(at, best)


def token_count(text_col: str) -> F.Column:
    """Words between white space; 0 for a null or empty text."""
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(r"[^ \t\n\r]+")), F.lit(0)).cast("long")


def mix(df: DataFrame, source_col: str = "source", tokens_col: str = "n_tokens", weight_col: str = "weight", id_col: str = "doc_id", targets: dict[str, float] = TARGETS, default_target: float = DEFAULT_TARGET, budget: float = BUDGET, seed: int = SEED, copies_col: str = "copies") -> DataFrame:
    """The rows of df that the mixture has, with how many copies of each.

    A source's budget is budget * (all tokens) * target / (sum of targets), rounded down. It is met by as
    many complete epochs as fit, then by the rows with the smallest keys -ln(u) / weight, u being uniform
    by a hash of seed and id, as long as the sum of tokens stays within the rest; the first row that
    doesn't fit ends the selection. Only the range of keys in which the budget ends is sorted, so no source
    is too large for a task; the others are decided by sums of ranges.

    A null source counts as the empty name. Null tokens count 0. A null weight counts as 1, and rows with a
    weight of 0 or less come last. A null id is an id like any other. Ties go by id, tokens, then a hash
    of the row; rows alike in everything are interchangeable. A source with no tokens has no epochs, and
    all its rows fit once. Targets of 0 leave a source out, and null or negative ones aren't allowed.
    Columns named copies_col are replaced.
    """
    if default_target < 0 or any(t is None or t < 0 for t in targets.values()):
        raise ValueError("targets must be numbers of 0 or more")
    columns = [c for c in df.columns if c != copies_col]
    hashed = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))), 1, 13), 16, 10).cast("long")
    u = (hashed + 0.5) / float(2**52)
    w = F.coalesce(F.col(weight_col).cast("double"), F.lit(1.0))
    key = F.when(w > 0, -F.log(u) / w).otherwise(F.lit(float("inf")))
    # the table's own columns travel as one, so that no helper can clash with them
    keyed = df.select(F.struct(*columns).alias("row"), F.col(id_col).alias("id"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("__source"), F.coalesce(F.col(tokens_col), F.lit(0)).cast("long").alias("__tokens"), key.alias("__key"))
    keyed = keyed.withColumn("__range", F.least(F.lit(RANGES - 1), F.floor((1 - F.exp(-F.col("__key"))) * RANGES).cast("int")))
    sums = keyed.groupBy("__source", "__range").agg(F.sum("__tokens").alias("sum"))
    target = F.lit(float(default_target))
    for name, t in targets.items():
        target = F.when(F.col("__source") == name, float(t)).otherwise(target)
    ahead = Window.partitionBy("__source").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("sum").over(ahead), F.lit(0)))
    totals = sums.groupBy("__source").agg(F.sum("sum").alias("total")).withColumn("target", target)
    whole = totals.agg(F.sum("total").alias("all"), F.sum("target").alias("targets"))
    share = F.floor(F.col("all") * F.lit(float(budget)) * F.col("target") / F.col("targets")).cast("long")
    shares = totals.crossJoin(F.broadcast(whole)).filter("target > 0 and targets > 0").withColumn("share", share)  # one row
    shares = shares.withColumn("epochs", F.when(F.col("total") > 0, F.floor(F.col("share") / F.col("total"))).otherwise(0).cast("long"))
    shares = shares.withColumn("epochs", F.col("epochs") - (F.col("epochs") * F.col("total") > F.col("share")).cast("long")).withColumn("rest", F.col("share") - F.col("epochs") * F.col("total"))
    ends = sums.join(shares, "__source").groupBy("__source", "epochs", "rest").agg(F.min(F.when(F.col("before") + F.col("sum") > F.col("rest"), F.struct("__range", "before"))).alias("end"))
    ends = ends.select("__source", "epochs", "rest", F.coalesce("end.__range", F.lit(RANGES)).alias("__end"), F.coalesce("end.before", F.lit(0)).alias("__before"))
    keyed = keyed.join(maybe_broadcast(ends, 100_000), "__source")
    clear = keyed.filter("__range <> __end").withColumn("copies", F.col("epochs") + (F.col("__range") < F.col("__end")).cast("long"))
    order = Window.partitionBy("__source").orderBy("__key", "id", "__tokens", F.xxhash64("row"))
    sorted_ = keyed.filter("__range = __end").withColumn("__sum", F.col("__before") + F.sum("__tokens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    edge = sorted_.withColumn("copies", F.col("epochs") + (F.col("__sum") <= F.col("rest")).cast("long"))
    both = clear.select("row", "copies").unionByName(edge.select("row", "copies")).filter("copies > 0")
    return both.select(*(F.col("row")[c].alias(c) for c in columns), F.col("copies").alias(copies_col))


def mixing(spark, sf_dir: str) -> DataFrame:
    """The documents of the mixture and their copies."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", token_count("text").alias("n_tokens"))
    return mix(with_quality(docs, read(spark, sf_dir, "labels"), "weight")).select("doc_id", "source", "n_tokens", "weight", "copies")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents of the mixture, each as often as it has copies; odd rows are as in mix, and a null or empty text counts no tokens."""
    tokens, weight, copies, copy = (unused(docs, c) for c in ("mix_tokens", "mix_weight", "mix_copies", "mix_copy"))
    rows = docs.withColumn(tokens, token_count("text"))
    rows = mix(with_quality(rows, read(spark, sf_dir, "labels"), weight), tokens_col=tokens, weight_col=weight, copies_col=copies)
    return rows.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), copies))).select(*docs.columns)


MIXING_SQL = f"""
WITH quality AS (SELECT doc_id, max(quality) AS q FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
docs AS (
  SELECT d.doc_id, coalesce(d.source, '') AS source,
    CAST(coalesce(len(regexp_extract_all(d.text, '[^ \\t\\n\\r]+')), 0) AS BIGINT) AS n_tokens,
    CASE q WHEN 1 THEN 2.0 WHEN 0 THEN 0.5 ELSE 1.0 END::DOUBLE AS weight
  FROM documents d LEFT JOIN quality USING (doc_id)),
keyed AS (
  SELECT *, -ln((CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0::DOUBLE) / weight AS key FROM docs),
totals AS (SELECT source, sum(n_tokens)::BIGINT AS total, CASE source WHEN 'src0' THEN 4.0 ELSE 1.0 END::DOUBLE AS target FROM keyed GROUP BY source),
shares AS (
  SELECT source, total, CAST(floor((SELECT sum(total) FROM totals)::DOUBLE * {BUDGET}::DOUBLE * target / (SELECT sum(target) FROM totals)) AS BIGINT) AS share FROM totals),
rests AS (SELECT source, CASE WHEN total > 0 THEN share // total ELSE 0 END AS epochs, CASE WHEN total > 0 THEN share % total ELSE share END AS rest FROM shares),
summed AS (SELECT *, sum(n_tokens) OVER (PARTITION BY source ORDER BY key, doc_id, n_tokens ROWS UNBOUNDED PRECEDING) AS upto FROM keyed)
SELECT doc_id, source, n_tokens, weight, CAST(epochs + CASE WHEN upto <= rest THEN 1 ELSE 0 END AS BIGINT) AS copies
FROM summed JOIN rests USING (source) WHERE epochs + CASE WHEN upto <= rest THEN 1 ELSE 0 END > 0
"""
