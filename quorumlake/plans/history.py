"""Queries on logs of appends, broken lines, chains, global order and selections, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quorumlake.operators import ordering as od, sampling as sa, series as se
from quorumlake.plans import projection as pj
from quorumlake.plans.records import _path
from quorumlake.plans.registry import F_, query, rounded
from quorumlake.runtime import discard, materialize
from quorumlake.sources import logs, stores
from quorumlake.sources.logs import Log
from quorumlake.streaming.ingest import ingest_log

CHANGE = "client_id long, change_id long, op string, city string, balance double"


def _changes(spark: SparkSession, sf: str) -> DataFrame:
    """One change of a client in each of three appends."""
    c = pj.table(spark, sf, "client_changes").filter("client_id IS NOT NULL AND change_id IS NOT NULL").withColumn("part", F.col("change_id") % 3)
    top = c.groupBy("client_id", "part").agg(F.max_by(F.struct("change_id", "op", "city", "balance"), F.struct("change_id", F.coalesce("seq", F.lit(-1)), F.coalesce("city", F.lit("")), F.coalesce("balance", F.lit(-1e18)))).alias("top"))
    return materialize(top.select("part", "client_id", "top.*"), "changes")


_CHANGES = """c AS (SELECT *, change_id % 3 AS part FROM client_changes WHERE client_id IS NOT NULL AND change_id IS NOT NULL),
t AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY client_id, part ORDER BY change_id DESC, coalesce(seq, -1) DESC, coalesce(city, '') DESC, coalesce(balance, -1e18) DESC) = 1),"""


@query("SELECT client_id, change_id, op, city, balance FROM t QUALIFY row_number() OVER (PARTITION BY client_id ORDER BY part DESC) = 1", _CHANGES.rstrip(","))
def newest_append_wins(spark, sf):
    """Three appends, the middle one by far the smallest in files, and a fourth that failed before it was committed."""
    rows = _changes(spark, sf)
    log = Log(spark, _path(spark), CHANGE, ["client_id"])
    for k, files in enumerate((4, 1, 2)):
        log.append(rows.filter(F.col("part") == k).drop("part").coalesce(files), f"part {k}")
    lost = rows.filter("part = 0").drop("part").select("*", F.lit(0).cast("long").alias(logs.ORDINAL))
    lost.write.parquet(f"{log.path}/attempt=lost")
    discard(rows)
    return log.newest()


@query(""", m AS (SELECT client_id, max(city) AS city FROM clients WHERE client_id IS NOT NULL GROUP BY 1), n AS (SELECT client_id, city, op FROM t QUALIFY row_number() OVER (PARTITION BY client_id ORDER BY part DESC) = 1)
SELECT coalesce(n.client_id, m.client_id) AS client_id, CASE WHEN n.client_id IS NULL THEN m.city ELSE n.city END AS city, n.op FROM m FULL JOIN n USING (client_id)""", _CHANGES.rstrip(","))
def union_of_logs(spark, sf):
    """Two logs with different columns: the later one's newest record wins, the earlier one's stays where it is alone."""
    rows = _changes(spark, sf)
    first, second = Log(spark, _path(spark), "client_id long, city string", ["client_id"]), Log(spark, _path(spark), "client_id long, city string, op string", ["client_id"])
    for k in range(3):
        second.append(rows.filter(F.col("part") == k))
    first.append(pj.table(spark, sf, "clients").filter("client_id IS NOT NULL").groupBy("client_id").agg(F.max("city").alias("city")))
    discard(rows)
    return logs.newest([first, second])


@query(""", k AS (SELECT DISTINCT sale_id, sale_id % 4 AS b FROM sales WHERE sale_id IS NOT NULL) SELECT CAST(b + 1 AS BIGINT) AS sequence, 'b' || b AS batch, CAST(count(*) AS BIGINT) AS n_rows FROM k GROUP BY b
UNION ALL SELECT 5, 'again', 0 UNION ALL SELECT 6, 'rest', CAST(count(*) AS BIGINT) FROM (SELECT DISTINCT order_id FROM (SELECT -o_orderkey - 1 AS order_id FROM orders))""", "z AS (SELECT 1)")
def indexed_appends(spark, sf):
    """Four batches of new keys, one of known keys only, one half known, and one that comes twice: what each has added."""
    log = Log(spark, _path(spark), "sale_id long", ["sale_id"])
    sales = pj.table(spark, sf, "sales").filter("sale_id IS NOT NULL").select("sale_id")
    for b in (0, 1, 2, 3, 3):
        log.append_unseen(sales.filter(F.col("sale_id") % 4 <= b), f"b{b}")
    log.append_unseen(sales.filter("sale_id % 7 = 0"), "again")
    log.append_unseen(pj.table(spark, sf, "orders").select((-F.col("o_orderkey") - 1).alias("sale_id")).unionByName(sales), "rest")
    return log.commits().select("sequence", "batch", "n_rows")


@query("""SELECT kind, CAST(count(*) AS BIGINT) AS n, CAST(sum(doc_id) AS BIGINT) AS ids FROM (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'unreadable' WHEN doc_id % 11 = 0 THEN 'no key' WHEN doc_id % 13 = 0 THEN 'unreadable' ELSE 'record' END AS kind FROM documents) GROUP BY kind""")
def broken_lines(spark, sf):
    """A log in which some lines are cut off, some have no key and some a field of another type, with blank lines between."""
    d = pj.table(spark, sf, "documents").select("doc_id", F.substring("text", 1, 200).alias("text"))
    sound = F.to_json(F.struct(F.sha2(F.col("doc_id").cast("string"), 256).alias("cache_key"), F.col("doc_id"), F.col("text").alias("raw_text")))
    line = F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit('{"doc_id": '), "doc_id", F.lit(', "cache_key": "cut')))
    line = line.when(F.col("doc_id") % 11 == 0, F.to_json(F.struct("doc_id"))).when(F.col("doc_id") % 13 == 0, F.concat(F.lit('{"cache_key": "k", "doc_id": "'), "doc_id", F.lit(' of them"}'))).otherwise(sound)
    path = _path(spark)
    d.select(F.explode(F.array(line, F.lit("  "))).alias("value")).write.text(path)
    found = stores.lines(spark, path, "cache_key string, doc_id long, raw_text string")
    own = F.coalesce("doc_id", F.regexp_extract("_text", r'"doc_id": ?"?(\d+)', 1).try_cast("long"))
    return found.groupBy(F.coalesce("_problem", F.lit("record")).alias("kind")).agg(F.count("*").alias("n"), F.sum(own).alias("ids"))


@query("""SELECT CAST(count(*) AS BIGINT) AS rows, CAST(count(DISTINCT sale_id) AS BIGINT) AS keys, CAST(sum(sale_id) AS BIGINT) AS ids, 4::BIGINT AS batches, 0::BIGINT AS again FROM (SELECT DISTINCT sale_id FROM sales WHERE sale_id IS NOT NULL)""")
def resumed_ingest(spark, sf):
    """A stream in four batches, stopped and started again between them; then all files once more from the start, which adds nothing."""
    landing, path, check = _path(spark), _path(spark), _path(spark)
    sales = pj.table(spark, sf, "sales").filter("sale_id IS NOT NULL").select("sale_id", "client_id", "total")
    for k in range(4):
        sales.filter(F.col("sale_id") % 5 <= k + 1).write.mode("append").json(landing)
        ingest_log(spark, landing, path, sales.schema, ["sale_id"], check).awaitTermination()  # all that is new is one batch
    log = Log(spark, path, sales.schema, ["sale_id"])
    commits = log.commits().count()
    ingest_log(spark, landing, path, sales.schema, ["sale_id"], _path(spark)).awaitTermination()
    again = log.commits().filter(F.col("sequence") > commits).agg(F.sum("n_rows").alias("again"))
    return log.read().agg(F.count("*").alias("rows"), F.countDistinct("sale_id").alias("keys"), F.sum("sale_id").alias("ids")).withColumn("batches", F.lit(commits).cast("long")).crossJoin(again)


CHAIN = 250


@query(f"""WITH RECURSIVE n AS (SELECT DISTINCT item_id AS name, CASE WHEN item_id % {CHAIN} > 0 THEN item_id - 1 END AS parent FROM items),
w AS (SELECT name, parent AS ancestor, 1 AS depth FROM n WHERE parent IS NOT NULL UNION ALL SELECT w.name, n.parent, w.depth + 1 FROM w JOIN n ON n.name = w.ancestor WHERE n.parent IS NOT NULL)
SELECT name, CAST(count(*) AS BIGINT) AS ancestors, CAST(max(depth) AS BIGINT) AS depth, CAST(arg_max(ancestor, depth) AS BIGINT) AS root FROM w GROUP BY name""")
def deep_lineage(spark, sf):
    """Chains of 250 entries: number of ancestors, depth and root of each."""
    i = F.col("item_id")
    nodes = pj.table(spark, sf, "items").select(i.alias("name"), F.when(i % CHAIN > 0, i - 1).alias("parent")).distinct()
    return rounded(se.lineage(spark, nodes).groupBy("name").agg(F.count("*").alias("ancestors"), F.max("depth").alias("depth"), F.max_by("ancestor", "depth").alias("root")))


@query(f"SELECT DISTINCT item_id AS name FROM items WHERE item_id // {CHAIN} % 2 = 0 AND item_id // {CHAIN} * {CHAIN} + {CHAIN} - 1 IN (SELECT item_id FROM items)")
def endless_lineage(spark, sf):
    """Entries whose chain runs into a cycle: every other block of 250 is closed to a ring."""
    i = F.col("item_id")
    ring = F.floor(i / CHAIN) % 2 == 0
    nodes = pj.table(spark, sf, "items").select(i.alias("name"), F.when(i % CHAIN > 0, i - 1).when(ring, i + CHAIN - 1).alias("parent")).distinct()
    return se.endless(nodes)


@query("SELECT doc_id, CAST(row_number() OVER (ORDER BY sha256('9:' || CAST(doc_id AS VARCHAR))) AS BIGINT) AS place, printf('L%03d', row_number() OVER (ORDER BY sha256('9:' || CAST(doc_id AS VARCHAR)))) AS sample_id FROM documents")
def shuffled_corpus(spark, sf):
    """All rows numbered in shuffled order, without one task that sees them all."""
    d = pj.table(spark, sf, "documents").select("doc_id")
    out = sa.shuffled(d, "doc_id", "9")
    return out.select("doc_id", F.substring("sample_id", 2, 20).cast("long").alias("place"), "sample_id")


@query("SELECT l_orderkey, l_linenumber, CAST(row_number() OVER (ORDER BY l_extendedprice DESC, l_shipdate, l_orderkey, l_linenumber) AS BIGINT) AS place FROM lineitem")
def sorted_places(spark, sf):
    """The place of each row in a sort by several keys."""
    rows = pj.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_shipdate")
    return rounded(od.numbered(rows, F.desc("l_extendedprice"), "l_shipdate", "l_orderkey", "l_linenumber", name="place").select("l_orderkey", "l_linenumber", "place"))


@query("SELECT status, CAST(count(total) AS BIGINT) AS n, round(quantile_cont(total, 0.05), 4) AS p05, round(quantile_cont(total, 0.5), 4) AS p50, round(quantile_cont(total, 0.95), 4) AS p95, round(quantile_cont(total, 0.999), 4) AS p999 FROM sales WHERE total IS NOT NULL AND NOT isnan(total) GROUP BY status")
def exact_amount_quantiles(spark, sf):
    """Quantiles of amounts by selection: no buffer holds a group."""
    sales = pj.table(spark, sf, "sales").filter(~F.isnan("total"))
    return rounded(od.exact_quantiles(sales, ["status"], "total", {"p05": 0.05, "p50": 0.5, "p95": 0.95, "p999": 0.999}), 4)


_STRATA = [("cut", "finish_reason = 'length'", 20), ("failed", "finish_reason = 'error'", 5), ("first", "prompt = 'stance_first' AND polarity = 'orig'", 12), ("inverted", "polarity = 'inv'", 25), ("left", "item_lean = 'left'", 30), ("late", "stage = 's3'", 15), ("any", "true", 40)]


def _strata_sql() -> str:
    rank = "row_number() OVER (PARTITION BY stage, prompt ORDER BY sha256('7:' || CAST(doc_id AS VARCHAR)))"
    parts, before = [], []
    for name, condition, n in _STRATA:
        gone = "".join(f" AND doc_id NOT IN (SELECT doc_id FROM t_{b})" for b in before)
        parts.append(f"t_{name} AS (SELECT doc_id, '{name}' AS stratum FROM (SELECT doc_id, {rank} AS k, sha256('7:' || CAST(doc_id AS VARCHAR)) AS x FROM r WHERE {condition}{gone}) ORDER BY k, x LIMIT {n})")
        before.append(name)
    return ", " + ",\n".join(parts) + " " + " UNION ALL ".join(f"SELECT * FROM t_{b}" for b in before)


@query(_strata_sql(), F_)
def quotas_of_seven(spark, sf):
    """Seven strata in order of priority, each spread over stages and prompts, from one scan."""
    r = pj.records(spark, sf)
    return sa.quotas(r, [(name, F.expr(condition), n) for name, condition, n in _STRATA], ["stage", "prompt"], "doc_id", "7").select("doc_id", "stratum")
