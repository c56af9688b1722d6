"""Mixing sources to target weights, in DataFrame operations only.

Each document gets a hash-random key, which is also its place in its source's order. Sources are cut into
ranges of the key; the ranges' token counts are summed before the shuffle, their prefix sums give each range's
start, and a window within the range gives each document's. A source whose budget is ``e`` times its size and
a rest takes every document ``e`` times and then, in key order, up to exactly the rest; the document on
the cut gives just the words that are still missing.

Null texts have size 0 and take nothing. A null source is one source of its own, the last. Rows with a null id
share one key and are ordered by size; repeated rows are documents of their own. Without any words all
targets are 0. Documents of a source of size 0 take nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, staged

#: Ranges of the key: the first RANGE_DIGITS hexadecimal digits.
RANGE_DIGITS = 3


def source_targets(sized: DataFrame, weights: Sequence[int], most: int) -> DataFrame:
    """(source, source_size, target) of each source; ``sized`` has source and size.

    One row per source from here on. The excess of sources at ``most`` times their size is reshared by weight
    until none is above: in the order of most * size / weight, the full ones are a prefix, and the others share
    what these leave. The order of sources, and with it this window, spans the table of sources only.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    by = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    by = by.withColumn("w", weight.cast("bigint")).withColumn("cap", most * F.col("source_size"))
    fill = W.orderBy((F.col("cap") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(W.unboundedPreceding, -1)
    level = (F.sum("source_size").over(W.partitionBy(F.lit(1))) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("w").over(fill.rowsBetween(0, W.unboundedFollowing))
    # The first source, in this order, that isn't full sets the level; taking more sources for full only lowers it.
    by = by.withColumn("level", F.when(level * F.col("w") < F.col("cap"), level))
    by = by.withColumn("level", F.max("level").over(W.partitionBy(F.lit(1))))
    target = F.least(F.col("cap").cast("double"), F.coalesce(F.col("level") * F.col("w"), F.col("cap").cast("double")))
    return by.select("source", "source_size", target.alias("target"))


def _keyed(docs: DataFrame, doc_id: str, text: str, source: str, salt: str) -> tuple[DataFrame, list[str]]:
    """(``docs`` with its columns by place as c0, c1, ..., which no name of ours can clash with, and _id, _source ('' for
    null), _none (is it null), _size, _key and _range; the places' names of id, text and source)."""
    at = {name: f"c{docs.columns.index(name)}" for name in (doc_id, text, source)}
    rows = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    own_id, own_text, own_source = (F.col(at[name]) for name in (doc_id, text, source))
    key = F.md5(F.concat(F.coalesce(own_id.cast("string"), F.lit("")), F.lit(f":{salt}")))
    rows = rows.select(
        "*",
        own_id.alias("_id"),
        F.coalesce(own_source.cast("string"), F.lit("")).alias("_source"),
        own_source.isNull().alias("_none"),
        F.coalesce(F.regexp_count(own_text, F.lit(WORD)), F.lit(0)).cast("bigint").alias("_size"),
        key.alias("_key"),
        F.substring(key, 1, RANGE_DIGITS).alias("_range"),
    )
    return rows, [at[doc_id], at[text], at[source]]


def _placed(rows: DataFrame, slim: DataFrame, weights: Sequence[int], most: int, ties: Sequence[str] = ()) -> DataFrame:
    """``rows`` with source_size, target and _taken; ``slim`` has the keyed columns of the same rows."""
    named = F.when(~F.col("_none"), F.col("_source"))
    targets = source_targets(slim.select(named.alias("source"), F.col("_size").alias("size")), weights, most)
    targets = targets.select(F.coalesce("source", F.lit("")).alias("ts"), F.col("source").isNull().alias("tn"), "source_size", "target")
    ranges = slim.groupBy("_source", "_none", "_range").agg(F.sum("_size").alias("n"))
    start = F.sum("n").over(W.partitionBy("_source", "_none").orderBy("_range")) - F.col("n")
    ranges = ranges.withColumn("_start", start).drop("n")
    ranges = ranges.join(targets, (F.col("_source") == F.col("ts")) & (F.col("_none") == F.col("tn")))
    ranges = staged(ranges.select(F.col("_source").alias("rs"), F.col("_none").alias("rn"), F.col("_range").alias("rr"), "_start", "source_size", "target"), "ranges")
    here = W.partitionBy("_source", "_none", "_range").orderBy("_key", "_id", "_size", *ties).rowsBetween(W.unboundedPreceding, 0)
    placed = rows.withColumn("_inside", F.sum("_size").over(here) - F.col("_size"))
    placed = placed.join(ranges, (F.col("_source") == F.col("rs")) & (F.col("_none") == F.col("rn")) & (F.col("_range") == F.col("rr")))
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    rest = budget - epochs * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("_size"), rest - F.col("_start") - F.col("_inside")))
    return placed.withColumn("_taken", (epochs * F.col("_size") + part).cast("bigint"))


def mix(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), most: int = 3, doc_id: str = "doc_id", text: str = "text", source: str = "source", salt: str = "mix") -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) of each row of ``docs``; texts are read once."""
    keyed, _ = _keyed(docs.select(docs[doc_id], docs[text], docs[source]), doc_id, text, source, salt)
    slim = staged(keyed.select("_id", "_source", "_none", "_size", "_key", "_range"), "sized")
    out = _placed(slim, slim, weights, most)
    return out.select(F.col("_id").alias("doc_id"), F.when(~F.col("_none"), F.col("_source")).alias("source"), F.col("_size").alias("size"), "source_size", "target", F.col("_taken").alias("taken"))


def apply_mix(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), most: int = 3, doc_id: str = "doc_id", text: str = "text", source: str = "source", salt: str = "mix") -> DataFrame:
    """The mixed corpus, in the columns of ``docs``: each document once for each time it is taken, and on the cut
    of its source its first words up to the budget. ``n_chars``, if there, follows the text; other columns keep their
    values, whatever their names.

    Documents that take nothing, among them those without words, aren't in it.
    """
    keyed, (_, words, _) = _keyed(docs, doc_id, text, source, salt)
    slim = staged(keyed.select("_id", "_source", "_none", "_size", "_key", "_range"), "sized")
    rows = _placed(keyed.withColumn("_tie", F.xxhash64(words)), slim, weights, most, ["_tie"]).where("_taken > 0")
    whole, part = F.floor(F.col("_taken") / F.col("_size")), F.col("_taken") % F.col("_size")
    rows = rows.withColumn("_part", part).withColumn("_copy", F.explode(F.sequence(F.lit(1), (whole + (part > 0).cast("int")).cast("int")))).withColumn("_cut", (F.col("_copy") > whole) & (part > 0))
    first = F.concat_ws("", F.slice(F.regexp_extract_all(F.col(words), F.lit(f"({WORD}[\\x20\\x09-\\x0D]*)"), F.lit(1)), F.lit(1), F.col("_part").cast("int")))
    rows = rows.withColumn(words, F.when(F.col("_cut"), first).otherwise(F.col(words)))
    if "n_chars" in docs.columns:
        kind, chars = docs.schema["n_chars"].dataType, f"c{docs.columns.index('n_chars')}"
        rows = rows.withColumn(chars, F.when(F.col("_cut"), F.length(words).cast(kind)).otherwise(F.col(chars)))
    return rows.select(*[F.col(f"c{i}").alias(name) for i, name in enumerate(docs.columns)])


def op2_mixing(spark, sf_dir: str) -> DataFrame:
    """What the mix takes of each document: sources weigh 5, 2, 1 by code point and stop at 3 times their size."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("source")


OP2_SQL = rf"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '') || ':mix') AS key
  FROM documents),
by_source AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighted AS (
  SELECT *, 3 * source_size AS cap,
         [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT] AS w
  FROM by_source),
filled AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
            / (sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS at_this
  FROM weighted WINDOW o AS (ORDER BY cap::DOUBLE / w::DOUBLE, source NULLS LAST)),
levels AS (SELECT *, max(CASE WHEN at_this * w < cap THEN at_this END) OVER () AS level FROM filled),
targets AS (SELECT source, source_size, least(cap::DOUBLE, coalesce(level * w, cap::DOUBLE)) AS target FROM levels),
placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN floor(floor(t.target) / t.source_size)::BIGINT ELSE 0 END AS epochs,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id, s.size ROWS UNBOUNDED PRECEDING) - s.size AS before
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (epochs * size + greatest(0, least(size, floor(target)::BIGINT - epochs * source_size - before)))::BIGINT AS taken
FROM placed
"""
