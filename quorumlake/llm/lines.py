"""Line dedup by site-relative frequency, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quorumlake.runtime import broadcast_if_small, free_name, materialize

MAX_RATIO, SUPPORT = 0.05, 2
MAX_BROADCAST = 48_000_000


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def boilerplate(docs: DataFrame, host: str = "source", text: str = "text", max_ratio: float = MAX_RATIO, support: int = SUPPORT) -> DataFrame:
    """(host, line) of the lines on more than ``max_ratio`` of a host's pages, and on ``support`` pages at least.

    The ratio alone decides for hosts of any size: a footer on 3 of 3 pages goes as well as one on a tenth of a million; a
    line on a single page is never boilerplate, which is all that a support of 2 says. The default of a twentieth leaves
    most lines of copied pages to near-duplicate removal. Lines are compared without the spaces at their ends; blank lines
    never count. A line counts once a page. Both counts are partial aggregates before the shuffle, so a host with a third of all pages costs
    one row a task.
    """
    pages = docs.select(F.col(host).alias("_host"), F.array_distinct(F.transform(_lines(F.col(text)), lambda x: F.trim(x))).alias("_lines"))
    totals = docs.groupBy(F.col(host).alias("_host")).agg(F.count("*").alias("_pages"))
    held = pages.select("_host", F.explode("_lines").alias("_line")).filter("_line != ''").groupBy("_host", "_line").agg(F.count("*").alias("_n")).filter(F.col("_n") >= support)
    totals = broadcast_if_small(materialize(totals, "hosts"), 100)
    both = held.alias("a").join(totals.alias("b"), F.col("a._host").eqNullSafe(F.col("b._host")))
    return both.filter(F.col("_n") > F.lit(float(max_ratio)) * F.col("_pages")).select(F.col("a._host"), "_line")


def drop_boilerplate(docs: DataFrame, host: str = "source", text: str = "text", max_ratio: float = MAX_RATIO, support: int = SUPPORT) -> DataFrame:
    """``docs`` with the host's boilerplate lines cut from ``text``; all columns stay, plus _n_lines and _n_dropped at the
    end (with more underscores where ``docs`` has columns of these names).

    Null text: stays null, 0 lines. Empty text: one empty line, kept. A null host is a host of its own.
    Repeated rows count as pages of their own. An empty table gives an empty table. Fewer than 1 / max_ratio
    boilerplate lines fit on a host's average page line, so the list of a host stays bounded; the lists of all hosts
    are broadcast if their measured bytes allow, else joined by host, where adaptive execution splits hot hosts.
    """
    h, drop, kept, n_lines, n_dropped = (free_name(x, docs) for x in ("_host", "_drop", "_kept", "_n_lines", "_n_dropped"))
    lists = boilerplate(docs, host, text, max_ratio, support).groupBy(F.col("_host").alias(h)).agg(F.collect_set("_line").alias(drop))
    lists = materialize(lists, "boilerplate")
    size = lists.agg(F.sum(F.octet_length(F.array_join(drop, "")) + 32 * F.size(drop) + 64)).first()[0] or 0
    lists = F.broadcast(lists) if size <= MAX_BROADCAST else lists
    joined = docs.join(lists, docs[host].eqNullSafe(lists[h]), "left")
    lines = _lines(F.col(text))
    out = joined.withColumn(kept, F.when(F.col(drop).isNull(), lines).otherwise(F.filter(lines, lambda x: ~F.array_contains(F.col(drop), F.trim(x)))))
    out = out.withColumn(n_lines, F.when(F.col(text).isNull(), 0).otherwise(F.size(lines)).cast("long"))
    out = out.withColumn(n_dropped, F.when(F.col(text).isNull(), 0).otherwise(F.size(lines) - F.size(kept)).cast("long"))
    return out.withColumn(text, F.when(F.col(text).isNotNull(), F.array_join(kept, "\n"))).select(*docs.columns, n_lines, n_dropped)


def op5_site_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_boilerplate(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "source", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.col("text").alias("kept_text"))


OP5_SQL = f"""
WITH l AS (SELECT doc_id, source, unnest(string_split(coalesce(text, ''), chr(10))) AS line, text, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
per AS (SELECT source, trim(line) AS line, count(DISTINCT doc_id) AS n FROM l WHERE trim(line) <> '' GROUP BY 1, 2),
tot AS (SELECT source, count(*) AS pages FROM documents GROUP BY 1),
bad AS (SELECT per.source, per.line FROM per JOIN tot USING (source) WHERE n >= {SUPPORT} AND n > {MAX_RATIO}::DOUBLE * pages),
m AS (SELECT l.*, bad.line IS NOT NULL AS dropped FROM l LEFT JOIN bad ON l.source = bad.source AND trim(l.line) = bad.line)
SELECT doc_id, any_value(source) AS source, CAST(count(*) AS BIGINT) AS n_lines, CAST(sum(CAST(dropped AS INT)) AS BIGINT) AS n_dropped,
       coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT dropped), '') AS kept_text
FROM m GROUP BY doc_id
"""
