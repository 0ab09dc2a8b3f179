"""Queries over the driver's tables and their DuckDB counterparts, by operator."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import tree
from ..functions.temporal import edge_in_force, in_force
from ..operators import graph, retrieval, risk
from ..operators import versions as V
from ..operators.vector_index import VectorIndex
from ..scratch import new_folder, spread
from ..sources import law_xml
from ..sources.keyed_table import KeyedTable
from . import corpus, job_queries
from .catalogue import ORACLE, QUERIES, query
from .tables import EDGES_SQL, PART_VERSIONS_SQL, RULINGS_SQL, VERSIONS_SQL, citations, document_index, edges, laid_out_edges, part_versions, raw_versions, rulings, table, versions

AS_OF = date(1997, 6, 30)


def lookup_sql(day: str) -> str:
    return f"valid_from <= {day} AND (valid_to IS NULL OR valid_to > {day})"


DAY = f"DATE '{AS_OF}'"
VALID_EDGE_SQL = f"(valid_from IS NULL OR valid_from <= {DAY}) AND (valid_to IS NULL OR valid_to > {DAY})"


# --- versions -------------------------------------------------------------------------------------------------------


@query(f"WITH {VERSIONS_SQL} SELECT article_id, article_key, valid_from, valid_to FROM v WHERE {lookup_sql(DAY)}")
def ap_03_effective_law(spark, d):
    return V.effective_at(versions(spark, d), AS_OF).select("article_id", "article_key", "valid_from", "valid_to")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ap_03_effective_law(spark, sf_dir)


@query(f"WITH {VERSIONS_SQL} SELECT article_id, article_key, valid_from, valid_to FROM v")
def wn_01_close_versions(spark, d):
    return versions(spark, d).select("article_id", "article_key", "valid_from", "valid_to")


@query(f"WITH {VERSIONS_SQL} SELECT article_id, valid_from, article_key FROM w WHERE n = 1")
def sk_05_first_write_wins(spark, d):
    return V.first_write(raw_versions(spark, d), ["article_id", "valid_from"], ["article_key"]).select("article_id", "valid_from", "article_key")


@query(f"WITH {VERSIONS_SQL} SELECT article_id, article_key, valid_to FROM v WHERE valid_to IS NOT NULL")
def wn_01_changed_ends(spark, d):
    return V.changed_ends(versions(spark, d).withColumn("valid_to", F.lit(None).cast("date"))).select("article_id", "article_key", "valid_to")


@query(f"""WITH {VERSIONS_SQL}, q AS (SELECT event_id, user_id AS article_id, CAST(ts AS DATE) AS day FROM events)
SELECT event_id, article_id, article_key FROM q JOIN v USING (article_id) WHERE {lookup_sql("q.day")}""")
def ap_01_get_article_as_of(spark, d):
    asked = table(spark, d, "events").select("event_id", F.col("user_id").alias("article_id"), F.to_date("ts").alias("day"))
    return V.as_of_lookup(asked, versions(spark, d), ["article_id"], "day").select("event_id", "article_id", "article_key")


@query(f"WITH {VERSIONS_SQL} SELECT article_id, article_key, valid_from FROM v JOIN customer ON c_custkey = article_id WHERE {lookup_sql(DAY)}")
def ap_02_get_article_by_id(spark, d):
    asked = table(spark, d, "customer").select(F.col("c_custkey").alias("article_id"))
    return V.effective_at(versions(spark, d), AS_OF).join(asked, "article_id", "left_semi").select("article_id", "article_key", "valid_from")


@query(f"WITH {VERSIONS_SQL} SELECT article_id, article_key, valid_from, CAST(row_number() OVER (PARTITION BY article_id ORDER BY valid_from) AS INTEGER) AS position FROM v")
def ap_06_article_timeline(spark, d):
    return V.timeline(versions(spark, d)).select("article_id", "article_key", "valid_from", "position")


@query(f"WITH {VERSIONS_SQL}, s AS (SELECT article_key AS src, lag(article_key) OVER (PARTITION BY article_id ORDER BY valid_from) AS dst FROM v) SELECT src, dst FROM s WHERE dst IS NOT NULL")
def wn_02_supersedes(spark, d):
    return V.supersedes(versions(spark, d), "article_id", "valid_from", "article_key")


@query(f"""WITH {VERSIONS_SQL}, s AS (SELECT article_key, o_totalprice, lead(article_key) OVER (PARTITION BY article_id ORDER BY valid_from) AS next_article_key,
lead(o_totalprice) OVER (PARTITION BY article_id ORDER BY valid_from) AS next_o_totalprice FROM v) SELECT * FROM s WHERE next_article_key IS NOT NULL""")
def jn_09_adjacent_pairs(spark, d):
    return V.adjacent_pairs(versions(spark, d), "article_id", "valid_from", ["article_key", "o_totalprice"]).select("article_key", "o_totalprice", "next_article_key", "next_o_totalprice")


@query("""SELECT event_id, user_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER
(PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS carried FROM events""")
def wn_03_carry_forward(spark, d):
    value = F.when(F.col("event_type") == "purchase", F.col("value"))
    return V.carry_forward(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], value, "carried").select("event_id", "user_id", "carried")


@query("""SELECT event_id, coalesce(last_value(CASE WHEN event_type <> 'click' THEN event_type END IGNORE NULLS) OVER
(PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'none') AS kind FROM events""")
def wn_04_carry_classification(spark, d):
    kind = F.when(F.col("event_type") != "click", F.col("event_type"))
    return V.carry_forward(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], kind, "kind", "none").select("event_id", "kind")


@query("""WITH g AS (SELECT conv_id, turn, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS group_no FROM conversations)
SELECT conv_id, turn, CAST(group_no AS BIGINT) AS group_no FROM g WHERE group_no > 0""")
def wn_06_group_runs(spark, d):
    return V.group_runs(table(spark, d, "conversations"), ["conv_id"], ["turn"], F.col("role") == "user").select("conv_id", "turn", "group_no")


@query("""WITH s AS (SELECT o_custkey AS statute_id, o_orderkey AS seq, o_orderstatus = 'F' AS is_current, o_orderpriority AS law_type, CAST(o_orderdate AS DATE) AS enforced_on FROM orders)
SELECT statute_id, arg_max(law_type, seq) AS law_type, coalesce(max(seq) FILTER (is_current), min(seq)) AS current_mst,
coalesce(arg_max(enforced_on, seq) FILTER (is_current), arg_min(enforced_on, seq)) AS enforced_on FROM s GROUP BY statute_id""")
def sk_03_statute_upsert(spark, d):
    o = table(spark, d, "orders").select(
        F.col("o_custkey").alias("statute_id"), F.col("o_orderkey").alias("seq"), (F.col("o_orderstatus") == "F").alias("is_current"), F.col("o_orderpriority").alias("law_type"), F.lit("").alias("name"),
        F.lit("").alias("ministry_code"), F.col("o_orderkey").alias("current_mst"), F.to_date("o_orderdate").alias("enforced_on"), F.lit(None).cast("long").alias("parent_id"),
    )
    return V.merge_statutes(o).select("statute_id", "law_type", "current_mst", "enforced_on")


@query("SELECT l_partkey, l_suppkey, min(l_orderkey * 10 + l_linenumber) AS seq, arg_min(l_shipmode_, l_orderkey * 10 + l_linenumber) FILTER (l_shipmode_ IS NOT NULL) AS chapter_title FROM (SELECT *, CASE WHEN l_returnflag <> 'N' THEN l_returnflag END AS l_shipmode_ FROM lineitem) GROUP BY l_partkey, l_suppkey")
def sk_04_article_get_or_create(spark, d):
    rows = table(spark, d, "lineitem").select("l_partkey", "l_suppkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("chapter_title"))
    first = rows.groupBy("l_partkey", "l_suppkey").agg(F.min("seq").alias("seq"))
    return V.merge_articles(rows, ["l_partkey", "l_suppkey"]).drop("article_id").join(first, ["l_partkey", "l_suppkey"])


@query("SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') GROUP BY o_custkey")
def sk_07_insert_ignore(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    new = V.first_write(o.where("o_orderstatus = 'O'"), ["o_custkey"], ["o_orderkey"])
    return V.insert_ignore(o.where("o_orderstatus = 'F'"), new, ["o_custkey"]).select("o_custkey", "o_orderkey")


@query("""WITH n AS (SELECT l_partkey, max(l_orderkey) AS k FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT p_partkey, coalesce(k, CAST(-1 AS BIGINT)) AS source_key FROM part LEFT JOIN n ON p_partkey = l_partkey""")
def sk_10_upsert(spark, d):
    old = table(spark, d, "part").select("p_partkey", F.lit(-1).cast("long").alias("source_key"))
    new = table(spark, d, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.max("l_orderkey").alias("source_key"))
    return V.upsert(old, new, ["p_partkey"])


@query(ORACLE["sk_10_upsert"])
def sk_10_keyed_upsert(spark, d):
    """The same rows in a table that the second write replaces in parts."""
    stored = KeyedTable(spark, new_folder(spark, "part"), "p_partkey long, source_key long", ["p_partkey"], buckets=8)
    stored.upsert(table(spark, d, "part").select("p_partkey", F.lit(-1).cast("long").alias("source_key")))
    stored.upsert(table(spark, d, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.max("l_orderkey").alias("source_key")))
    return stored.read()


@query(ORACLE["wn_01_close_versions"])
def sk_05_stored_versions(spark, d):
    """Versions that come in two writes, the smaller keys first: the first one of a day stays, intervals close as they come."""
    rows = raw_versions(spark, d).select("article_id", "valid_from", "article_key")
    stored = KeyedTable(spark, new_folder(spark, "versions"), "article_id long, article_key long, valid_from date, valid_to date", ["article_id", "valid_from"], ["article_id"], buckets=8)

    def closed(old, new):
        both = old.withColumn("_late", F.lit(0)).unionByName(new.withColumn("_late", F.lit(1)), allowMissingColumns=True)
        return V.close_versions(V.first_write(both, ["article_id", "valid_from"], ["_late", "article_key"]))

    half = rows.agg(F.avg("article_key")).first()[0] or 0
    for part in (rows.where(F.col("article_key") <= half), rows.where(F.col("article_key") > half)):
        stored.merge(part, closed)
    return stored.read().select("article_id", "article_key", "valid_from", "valid_to")


@query("SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def ck_01_duplicate_keys(spark, d):
    return V.duplicate_keys(table(spark, d, "lineitem"), ["l_partkey", "l_suppkey"])


@query("""WITH p AS (SELECT o_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS f, CAST(o_orderdate AS DATE) + 30 AS t FROM orders),
n AS (SELECT *, lead(f) OVER (PARTITION BY o_custkey ORDER BY f) AS nf, max(t) OVER (PARTITION BY o_custkey) AS m FROM p)
SELECT o_custkey, count(*) AS overlapping FROM n WHERE nf IS NOT NULL AND nf < t GROUP BY o_custkey""")
def ck_02_overlaps(spark, d):
    p = table(spark, d, "orders").select(F.col("o_custkey").alias("article_id"), F.to_date("o_orderdate").alias("valid_from")).withColumn("valid_to", F.date_add("valid_from", 30))
    return V.overlaps(p).groupBy(F.col("article_id").alias("o_custkey")).agg(F.count("*").alias("overlapping"))


@query("SELECT event_id, user_id FROM events WHERE user_id NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def ck_03_orphans(spark, d):
    return V.orphans(table(spark, d, "events"), "user_id", table(spark, d, "orders").where("o_orderstatus = 'P'"), "o_custkey").select("event_id", "user_id")


@query(f"WITH {VERSIONS_SQL} SELECT article_id, arg_max(article_key, valid_from) AS article_key, max(valid_from) AS valid_from FROM v WHERE o_orderstatus <> 'P' GROUP BY article_id")
def ag_04_latest_open(spark, d):
    # As before the intervals are closed: every version that is not pending is open.
    rows = versions(spark, d).where("o_orderstatus <> 'P'").withColumn("valid_to", F.lit(None).cast("date"))
    return V.latest_open(rows).select("article_id", "article_key", "valid_from")


@query(f"WITH {EDGES_SQL} SELECT type, src, dst, valid_from, valid_to FROM e WHERE {VALID_EDGE_SQL}")
def pf_02_edge_as_of(spark, d):
    return edges(spark, d).where(edge_in_force(AS_OF)).select("type", "src", "dst", "valid_from", "valid_to")


@query(f"""WITH {VERSIONS_SQL}, s AS (SELECT o_orderpriority, count(*) FILTER ({lookup_sql(DAY)}) AS in_force, count(*) FILTER (valid_to IS NULL) AS open, count(*) AS total FROM v GROUP BY 1) SELECT * FROM s""")
def pf_01_as_of_predicate(spark, d):
    return versions(spark, d).groupBy("o_orderpriority").agg(F.count_if(in_force(AS_OF)).alias("in_force"), F.count_if(F.col("valid_to").isNull()).alias("open"), F.count("*").alias("total"))


# --- rulings and risk -----------------------------------------------------------------------------------------------


@query(f"WITH {RULINGS_SQL} SELECT c.article_id, r.ruling_id, decided_on FROM r JOIN c USING (ruling_id) JOIN part ON p_partkey = c.article_id WHERE outcome = 'F'")
def ap_09_rulings_for(spark, d):
    asked = table(spark, d, "part").select(F.col("p_partkey").alias("article_id"))
    return risk.rulings_for(rulings(spark, d), asked, "F").select("article_id", "ruling_id", "decided_on")


RATE_SQL = f"""{RULINGS_SQL}, t AS (SELECT c.article_id, count(*) AS total, count(f.ruling_id) AS flagged FROM r JOIN c USING (ruling_id) LEFT JOIN f USING (ruling_id) GROUP BY 1),
rate AS (SELECT p_partkey AS article_id, coalesce(total, 0) AS total, coalesce(flagged, 0) AS flagged, CASE WHEN coalesce(total, 0) > 0 THEN flagged / total ELSE 0.0 END AS rate FROM part LEFT JOIN t ON p_partkey = article_id)"""


@query(f"WITH {RATE_SQL} SELECT article_id, total, flagged, round(rate, 6) AS rate FROM rate")
def ap_10_anti_avoidance_rate(spark, d):
    return risk.anti_avoidance_rate(table(spark, d, "part").select(F.col("p_partkey").alias("article_id")), rulings(spark, d)).withColumn("rate", F.round("rate", 6))


@query(f"""WITH {RULINGS_SQL}, l AS (SELECT c.* FROM c JOIN r USING (ruling_id) WHERE outcome = 'F')
SELECT a.article_id AS start, b.article_id AS neighbour, count(*) AS n FROM l a JOIN l b USING (ruling_id) JOIN part ON p_partkey = a.article_id WHERE a.article_id <> b.article_id GROUP BY 1, 2""")
def gq_05_risk_neighbours(spark, d):
    r = rulings(spark, d)
    starts = table(spark, d, "part").select(F.col("p_partkey").alias("start"))
    return graph.risk_neighbours(citations(spark, d), r.where("outcome = 'F'").select("ruling_id"), starts)


UNPATCHED_SQL = f"""{RATE_SQL}, {PART_VERSIONS_SQL},
u AS (SELECT DISTINCT r.ruling_id, c.article_id, r.decided_on FROM r JOIN c USING (ruling_id) JOIN pv ON pv.article_id = c.article_id
WHERE outcome = 'O' AND decided_on >= DATE '1996-01-01' AND valid_to IS NULL AND valid_from <= decided_on)"""


def _unpatched(spark, d):
    r = rulings(spark, d)
    return graph.unpatched(r, citations(spark, d), part_versions(spark, d), date(1996, 1, 1), "O")


@query(f"WITH {UNPATCHED_SQL} SELECT ruling_id, article_id, decided_on FROM u")
def gq_06_find_unpatched(spark, d):
    return _unpatched(spark, d)


@query(f"WITH {UNPATCHED_SQL} SELECT article_id, ruling_id AS origin_ruling, 'alive' AS status, CAST(round_even(rate, 3) AS DOUBLE) AS risk_score FROM u JOIN rate USING (article_id)")
def gq_07_materialise_unpatched(spark, d):
    found = _unpatched(spark, d)
    existing = spark.createDataFrame([], "article_id long, origin_ruling long")
    rates = risk.anti_avoidance_rate(found, rulings(spark, d)).select("article_id", "rate")
    return graph.materialise_unpatched(found, rates, existing).withColumn("risk_score", F.col("risk_score").cast("double"))


@query("""WITH k AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'O' THEN 'alive' WHEN 'F' THEN 'patched' ELSE 'dead' END AS status,
CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderdate AS DATE) END AS patched_on, CASE WHEN o_orderpriority <> '1-URGENT' THEN CAST(o_orderdate AS DATE) + 400 END AS claim_deadline FROM orders)
SELECT id, status FROM k WHERE status IN ('alive', 'patched') AND (patched_on IS NULL OR patched_on >= DATE '1998-01-01' - 1095) AND (claim_deadline IS NULL OR claim_deadline >= DATE '1998-01-01')""")
def ap_11_find_claimable(spark, d):
    day = F.to_date("o_orderdate")
    status = F.when(F.col("o_orderstatus") == "O", "alive").when(F.col("o_orderstatus") == "F", "patched").otherwise("dead")
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("article_id"), status.alias("status"), F.when(F.col("o_orderstatus") == "F", day).alias("patched_on"), F.when(F.col("o_orderpriority") != "1-URGENT", F.date_add(day, 400)).alias("claim_deadline"))
    return risk.find_claimable(rows, date(1998, 1, 1), lookback_years=3).select("id", "status")


@query("""WITH x AS (SELECT quality = 1 AS positive, n_chars > 400 AS predicted FROM labels JOIN documents USING (doc_id)),
s AS (SELECT count(*) FILTER (positive AND predicted) AS tp, count(*) FILTER (NOT positive AND predicted) AS fp, count(*) FILTER (positive AND NOT predicted) AS fn, count(*) FILTER (NOT positive AND NOT predicted) AS tn FROM x)
SELECT tp, fp, fn, tn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall FROM s""")
def ag_07_confusion(spark, d):
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    found = corpus.confusion(rows, F.col("quality") == 1, F.col("n_chars") > 400, F.lit(True))
    return found.withColumn("precision", F.round("precision", 6)).withColumn("recall", F.round("recall", 6))


# --- graph ----------------------------------------------------------------------------------------------------------


def _starts(spark, d):
    """The query set of traversals: every part whose key is divisible by 20, against all edges."""
    return table(spark, d, "part").where("p_partkey % 20 = 0").select(F.col("p_partkey").alias("start"))


BFS_SQL = f"""{EDGES_SQL}, g AS (SELECT DISTINCT src, dst, type FROM e WHERE {VALID_EDGE_SQL}), s AS (SELECT p_partkey AS start FROM part WHERE p_partkey % 20 = 0),
n0 AS (SELECT start, start AS node FROM s), x1 AS (SELECT DISTINCT start, src, dst, type FROM n0 JOIN g ON node = src), n1 AS (SELECT start, node FROM n0 UNION SELECT start, dst FROM x1),
x2 AS (SELECT DISTINCT start, src, dst, type FROM n1 JOIN g ON node = src), n2 AS (SELECT start, node FROM n1 UNION SELECT start, dst FROM x2)"""


@query(f"WITH {BFS_SQL} SELECT start, node, CASE WHEN start = node THEN 0 WHEN (start, node) IN (SELECT start, dst FROM x1) THEN 1 ELSE 2 END AS hop FROM n2")
def gq_01_expand_refs_nodes(spark, d):
    return graph.expand_refs(_starts(spark, d), laid_out_edges(spark, d), AS_OF)[0]


@query(f"WITH {BFS_SQL} SELECT start, src, dst, type FROM x2")
def gq_01_expand_refs_edges(spark, d):
    return graph.expand_refs(_starts(spark, d), laid_out_edges(spark, d), AS_OF)[1]


@query(f"""WITH {EDGES_SQL}, g AS (SELECT DISTINCT src, dst FROM e WHERE type = 'DELEGATES'), s AS (SELECT p_partkey AS start FROM part WHERE p_partkey % 20 = 0),
c1 AS (SELECT start, [start, dst] AS chain FROM s JOIN g ON src = start), c2 AS (SELECT start, list_append(chain, dst) AS chain FROM c1 JOIN g ON src = chain[2] WHERE NOT (src = chain[1] AND dst = chain[2])),
c3 AS (SELECT start, list_append(chain, dst) AS chain FROM c2 JOIN g ON src = chain[3] WHERE NOT (src = chain[1] AND dst = chain[2]) AND NOT (src = chain[2] AND dst = chain[3])),
a AS (SELECT * FROM c1 UNION ALL SELECT * FROM c2 UNION ALL SELECT * FROM c3), k AS (SELECT *, row_number() OVER (PARTITION BY start ORDER BY len(chain) DESC, chain) AS n FROM a)
SELECT start, array_to_string(chain, '>') AS chain FROM k WHERE n = 1""")
def gq_02_delegation_chain(spark, d):
    return graph.delegation_chains(_starts(spark, d), laid_out_edges(spark, d)).select("start", F.array_join(F.transform("chain", lambda x: x.cast("string")), ">").alias("chain"))


CHAIN_SQL = ORACLE["gq_02_delegation_chain"].replace("array_to_string(chain, '>') AS chain", "chain")


@query(f"WITH {PART_VERSIONS_SQL}, ch AS ({CHAIN_SQL}), x AS (SELECT start, unnest(chain) AS article_id, unnest(range(0, len(chain))) AS position FROM ch) SELECT start, position, article_id, valid_from FROM x JOIN pv USING (article_id) WHERE position > 0 AND {lookup_sql(DAY)}")
def gq_02_resolve_chain(spark, d):
    found = graph.resolve_chain(graph.delegation_chains(_starts(spark, d), laid_out_edges(spark, d)), part_versions(spark, d), AS_OF)
    return found.select("start", F.col("position").cast("long").alias("position"), "article_id", "valid_from")


@query(f"""WITH {EDGES_SQL}, g AS (SELECT DISTINCT src, dst FROM e WHERE quantity = 1), s AS (SELECT p_partkey AS start FROM part),
h1 AS (SELECT DISTINCT start, dst AS node FROM s JOIN g ON src = start), h2 AS (SELECT DISTINCT start, dst AS node FROM h1 JOIN g ON src = node),
h3 AS (SELECT DISTINCT start, dst AS node FROM h2 JOIN g ON src = node), h4 AS (SELECT DISTINCT start, dst AS node FROM h3 JOIN g ON src = node), h AS (SELECT * FROM h1 UNION SELECT * FROM h2 UNION SELECT * FROM h3 UNION SELECT * FROM h4)
SELECT start, node FROM h WHERE node NOT IN (SELECT src FROM g)""")
def gq_03_mutatis_terminals(spark, d):
    """From every part, over a graph of its own: lines of a single piece refer to the next part."""
    single = edges(spark, d).withColumn("type", F.when(F.col("quantity") == 1, "MUTATIS").otherwise("OTHER"))
    return graph.terminals(table(spark, d, "part").select(F.col("p_partkey").alias("start")), single)


@query("""WITH w AS (SELECT DISTINCT source AS src, unnest(string_split(lower(text), ' ')) AS term FROM documents), k AS (SELECT term FROM w WHERE term <> '' GROUP BY term HAVING count(*) > 1)
SELECT src, term, count(*) OVER (PARTITION BY term) AS definers FROM w JOIN k USING (term)""")
def gq_04_term_conflicts(spark, d):
    words = table(spark, d, "documents").select(F.col("source").alias("src"), F.explode(F.split(F.lower("text"), " ")).alias("term")).where("term <> ''").distinct()
    return graph.term_conflicts(words).select("src", "term", "definers")


@query(f"WITH {RULINGS_SQL} SELECT ruling_id AS src, article_id AS dst FROM c JOIN part ON p_partkey = article_id WHERE ruling_id IN (SELECT ruling_id FROM r)")
def gb_11_cites_edges(spark, d):
    return graph.cites_edges(rulings(spark, d), table(spark, d, "part").select(F.col("p_partkey").alias("article_id"))).select("src", "dst")


@query("SELECT o_orderkey AS src, o_custkey AS dst, 'DELEGATES_TO' AS type FROM orders WHERE o_orderstatus <> 'P'")
def gb_04_hierarchy(spark, d):
    parent = F.when(F.col("o_orderstatus") != "P", F.col("o_custkey"))
    return graph.hierarchy_edges(table(spark, d, "orders").select(F.col("o_orderkey").alias("statute_id"), parent.alias("parent_id")))


# --- retrieval ------------------------------------------------------------------------------------------------------

TRIGRAM_SQL = r"""
words AS (SELECT 'c' AS side, doc_id AS id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS w FROM documents UNION ALL
          SELECT 'q', item_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) FROM benchmark),
g AS (SELECT DISTINCT side, id, substring('  ' || w || ' ', i, 3) AS g FROM (SELECT side, id, w, unnest(range(1, length(w) + 2)) AS i FROM words)),
n AS (SELECT side, id, count(*) AS n FROM g GROUP BY 1, 2),
b AS (SELECT q.id AS query_id, c.id AS chunk_id, count(*) AS shared FROM g q JOIN g c ON q.g = c.g WHERE q.side = 'q' AND c.side = 'c' GROUP BY 1, 2),
kw0 AS (SELECT query_id, chunk_id, shared / (q.n + c.n - shared) AS score FROM b JOIN n q ON q.side = 'q' AND q.id = query_id JOIN n c ON c.side = 'c' AND c.id = chunk_id),
kw AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM kw0 WHERE score >= 0.3)"""


def _keyword(spark, d, top=10):
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return retrieval.keyword_search(q, None, top=top, index=document_index(spark, d))


@query(f"WITH {TRIGRAM_SQL} SELECT query_id, chunk_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM kw WHERE rank <= 10")
def rt_01_keyword_search(spark, d):
    return _keyword(spark, d).withColumn("score", F.round("score", 6))


VECTOR_SQL = """
q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS qv FROM embeddings WHERE vec_id % 20 = 0),
vs0 AS (SELECT query_id, vec_id AS chunk_id, list_cosine_similarity(qv, CAST(embedding AS DOUBLE[])) AS score FROM q, embeddings),
vs AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM vs0)"""


def _vector(spark, d, top=10):
    """The query set: every vector whose id is divisible by 20, against all."""
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding", F.lit(True).alias("is_current"))
    found = retrieval.vector_search(rows.where("chunk_id % 20 = 0").select(F.col("chunk_id").alias("query_id"), "embedding"), rows, AS_OF, AS_OF, top=top)
    return found


@query(f"WITH {VECTOR_SQL} SELECT query_id, chunk_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM vs WHERE rank <= 10")
def rt_02_vector_search(spark, d):
    return _vector(spark, d).withColumn("score", F.round("score", 6))


@query(f"WITH {VECTOR_SQL} SELECT query_id, chunk_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM vs WHERE rank <= 10")
def rt_02_vector_index(spark, d):
    """The same hits from an index, which leaves out the cells that can hold none."""
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding", F.lit(True).alias("is_current"))
    asked = rows.where("chunk_id % 20 = 0").select(F.col("chunk_id").alias("query_id"), "embedding")
    found = retrieval.vector_search(asked, rows, AS_OF, AS_OF, top=10, index=VectorIndex.build(rows))
    return found.withColumn("score", F.round("score", 6))


@query(f"""WITH {TRIGRAM_SQL}, {VECTOR_SQL}, a AS (SELECT query_id, chunk_id, rank FROM kw WHERE rank <= 10), z AS (SELECT query_id, chunk_id, rank FROM vs WHERE rank <= 10),
k AS (SELECT query_id, chunk_id, a.rank AS ra, z.rank AS rz FROM a FULL JOIN z USING (query_id, chunk_id)),
c AS (SELECT query_id, count(ra) AS na, count(rz) AS nz FROM k GROUP BY 1),
f AS (SELECT query_id, chunk_id, 1.0::DOUBLE / (60 + coalesce(ra, na + 1)) + 1.0::DOUBLE / (60 + coalesce(rz, nz + 1)) AS score, CASE WHEN ra IS NULL THEN 1 ELSE 0 END AS l, coalesce(ra, rz) AS r FROM k JOIN c USING (query_id))
SELECT query_id, chunk_id, round(score, 9) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, l, r) AS INTEGER) AS rank FROM f""")
def rt_03_rrf_fuse(spark, d):
    return retrieval.rrf_fuse(_keyword(spark, d), _vector(spark, d), top=1000).withColumn("score", F.round("score", 9))


CITING = "concat('see ', n_name, CASE WHEN c_custkey % 2 = 0 THEN concat(' (', year(o_orderdate), '. ', month(o_orderdate), '. ', day(o_orderdate), '. enacted)') ELSE '' END, ' ART', c_custkey, CASE WHEN c_custkey % 3 = 0 THEN concat('-', c_nationkey) ELSE '' END, ' as well')"
ARTICLE = r"ART(\d+)(?:-(\d+))?"


def _nation_names(spark, d) -> DataFrame:
    return table(spark, d, "nation").select("n_name")


def _citing(spark, d):
    o = spread(table(spark, d, "orders")).join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return o.select("o_orderkey", F.expr(CITING).alias("text"))


@query("""SELECT o_orderkey, n_name AS law, CAST(c_custkey AS INTEGER) AS art_no, CAST(CASE WHEN c_custkey % 3 = 0 THEN c_nationkey ELSE 0 END AS INTEGER) AS branch_no,
CASE WHEN c_custkey % 2 = 0 THEN CAST(o_orderdate AS DATE) END AS historical_date FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""")
def ap_04_parse_citation(spark, d):
    return _citing(spark, d).select("o_orderkey", T.citation(F.col("text"), _nation_names(spark, d), ARTICLE).alias("c")).select("o_orderkey", "c.*")


@query(f"""WITH {VERSIONS_SQL}, q AS (SELECT o_orderkey AS query_id, o_custkey AS article_id, CASE WHEN o_custkey % 2 = 0 THEN CAST(o_orderdate AS DATE) ELSE {DAY} END AS day FROM orders)
SELECT query_id, article_id, article_key FROM q JOIN v USING (article_id) WHERE {lookup_sql("q.day")}""")
def rt_04_route_direct(spark, d):
    named = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    named = named.select(F.col("c_custkey").alias("article_id"), F.col("n_name").alias("law"), F.col("c_custkey").cast("int").alias("art_no"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_nationkey")).otherwise(0).cast("int").alias("branch_no"))
    queries = _citing(spark, d).withColumnRenamed("o_orderkey", "query_id")
    return retrieval.route_direct(queries, versions(spark, d).join(named, "article_id"), _nation_names(spark, d), AS_OF, article=ARTICLE).select("query_id", "article_id", "article_key")


@query(f"WITH {TRIGRAM_SQL} SELECT query_id, chunk_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY chunk_id DESC) AS INTEGER) AS rank FROM kw WHERE rank <= 10 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY chunk_id DESC) <= 3")
def rt_06_rerank(spark, d):
    return retrieval.rerank(_keyword(spark, d), 3, lambda h: h.withColumn("rerank_score", F.col("chunk_id").cast("double"))).select("query_id", "chunk_id", "rank")


SEARCH_SQL = f"""{TRIGRAM_SQL.replace("FROM benchmark)", "FROM bq)").replace("words AS", "bq AS (SELECT item_id, text FROM benchmark JOIN embeddings ON vec_id = item_id WHERE item_id % 4 <> 0), words AS", 1)},
q AS (SELECT item_id AS query_id, CAST(embedding AS DOUBLE[]) AS qv FROM bq JOIN embeddings ON vec_id = item_id),
vs0 AS (SELECT query_id, vec_id AS chunk_id, list_cosine_similarity(qv, CAST(embedding AS DOUBLE[])) AS score FROM q, embeddings JOIN documents ON doc_id = vec_id),
vs AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM vs0),
k AS (SELECT query_id, chunk_id, a.rank AS ra, z.rank AS rz FROM (SELECT * FROM kw WHERE rank <= 30) a FULL JOIN (SELECT * FROM vs WHERE rank <= 30) z USING (query_id, chunk_id)),
c0 AS (SELECT query_id, count(ra) AS na, count(rz) AS nz FROM k GROUP BY 1),
f0 AS (SELECT query_id, chunk_id, 1.0::DOUBLE / (60 + coalesce(ra, na + 1)) + 1.0::DOUBLE / (60 + coalesce(rz, nz + 1)) AS score, CASE WHEN ra IS NULL THEN 1 ELSE 0 END AS l, coalesce(ra, rz) AS r0 FROM k JOIN c0 USING (query_id)),
hits AS (SELECT query_id, chunk_id AS article_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, l, r0) AS INTEGER) AS rank FROM f0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, l, r0) <= 5
         UNION ALL SELECT item_id, item_id, 1.0, 1 FROM benchmark JOIN embeddings ON vec_id = item_id JOIN documents ON doc_id = item_id WHERE item_id % 4 = 0),
{EDGES_SQL}, {RULINGS_SQL}, near AS (SELECT DISTINCT src, dst FROM e WHERE {VALID_EDGE_SQL} AND src <> dst),
rel AS (SELECT src, string_agg(CAST(dst AS VARCHAR), '|' ORDER BY dst) AS related FROM near JOIN documents ON doc_id = dst GROUP BY src),
rul AS (SELECT article_id AS src, string_agg(CAST(ruling_id AS VARCHAR), '|' ORDER BY CAST(ruling_id AS VARCHAR)) AS rulings FROM c JOIN r USING (ruling_id) GROUP BY 1),
adm AS (SELECT p_partkey AS src, p_name AS addenda FROM part WHERE p_size > 1)"""


@query(f"WITH {SEARCH_SQL} SELECT query_id, article_id, round(score, 9) AS score, rank, coalesce(related, '') AS related, coalesce(rulings, '') AS rulings, coalesce(addenda, '') AS addenda FROM hits LEFT JOIN rel ON rel.src = article_id LEFT JOIN rul ON rul.src = article_id LEFT JOIN adm ON adm.src = article_id")
def rt_07_search(spark, d):
    """The whole chain: every fourth query names an article, the others are searched by text and vector."""
    docs, vec = table(spark, d, "documents"), table(spark, d, "embeddings")
    chunks = docs.join(vec, docs["doc_id"] == vec["vec_id"], "left").select(
        F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("article_id"), "text", "embedding", F.lit(True).alias("is_current"), F.lit(date(1990, 1, 1)).alias("valid_from"), F.lit(None).cast("date").alias("valid_to")
    )
    articles = chunks.select("article_id", F.col("article_id").alias("article_key"), F.lit("LAW").alias("law"), F.col("article_id").cast("int").alias("art_no"), F.lit(0).alias("branch_no"), F.col("text").alias("body"), "valid_from", "valid_to")
    text = F.when(F.col("item_id") % 4 == 0, F.expr("concat('see LAW ART', item_id, '.')")).otherwise(F.col("text"))
    queries = table(spark, d, "benchmark").join(vec, F.col("item_id") == F.col("vec_id")).select(F.col("item_id").alias("query_id"), text.alias("text"), "embedding")
    r = rulings(spark, d).withColumn("ruling_id", F.col("ruling_id").cast("string"))
    addenda = table(spark, d, "part").where("p_size > 1").select(F.col("p_partkey").alias("addendum_id"), F.col("p_name").alias("body"), F.array("p_partkey", "p_partkey").alias("target_articles"))
    embedded = chunks.where("embedding is not null")
    found = retrieval.search(queries, chunks, articles, laid_out_edges(spark, d), r, addenda, ["LAW"], AS_OF, AS_OF, top=5, vector_chunks=embedded, index=document_index(spark, d), article=ARTICLE)
    related = F.array_join(F.transform("related", lambda v: v["article_id"].cast("string")), "|")
    return found.select("query_id", "article_id", F.round("score", 9).alias("score"), "rank", related.alias("related"), F.array_join("rulings", "|").alias("rulings"), F.array_join("addenda", "|").alias("addenda"))


# --- text and trees -------------------------------------------------------------------------------------------------

AMOUNTS = (("amount", None, r"(\d[\d,]*(?:\.\d+)?)\s*(EUR|USD)\s*(min|max)", 1, 2, 3), ("period", None, r"(\d+)\s*(days|weeks)\s*(min|max)?", 1, 2, 3))
BOUNDS = {"min": ">=", "max": "<="}


@query("""SELECT o_orderkey, 'amount' AS kind, CASE WHEN o_orderstatus = 'F' THEN '<=' ELSE '>=' END AS op, CAST(o_custkey * 1000 AS DOUBLE) AS value, 'EUR' AS unit FROM orders
UNION ALL SELECT o_orderkey, 'period', CASE WHEN o_orderstatus = 'P' THEN '>=' ELSE '==' END, CAST(o_custkey AS DOUBLE), 'days' FROM orders""")
def st_10_thresholds(spark, d):
    text = F.expr("concat('pay ', o_custkey, ',000 EUR ', if(o_orderstatus = 'F', 'max', 'min'), ' within ', o_custkey, ' days', if(o_orderstatus = 'P', ' min', ''))")
    rows = table(spark, d, "orders").select("o_orderkey", F.explode(T.thresholds(text, AMOUNTS, BOUNDS)).alias("t"))
    return rows.select("o_orderkey", "t.kind", "t.op", "t.value", "t.unit")


@query("SELECT DISTINCT p_partkey, unnest([p_brand, p_type]) AS term FROM part")
def st_09_definitions(spark, d):
    text = F.expr("""concat('a "', p_brand, '" means; hereafter "', p_type, '" it; "', p_brand, '" means')""")
    found = T.definitions(text, (r'"([^"]{1,60})" means', r'hereafter "([^"]{1,60})" it'))
    return table(spark, d, "part").select("p_partkey", F.explode(found).alias("term"))


@query("SELECT l_orderkey, '제' || l_linenumber || '항' AS chunk_path, l_returnflag || chr(10) || l_linestatus || chr(10) || l_partkey AS text FROM lineitem")
def tr_02_chunks(spark, d):
    return job_queries.trees(spark, d).select("l_orderkey", F.explode(tree.chunks(F.col("clauses"))).alias("c")).select("l_orderkey", "c.chunk_path", "c.text")


LINES_SQL = """t AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations),
a AS (SELECT conv_id, turn, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i, unnest(string_split(text, chr(10))) AS v FROM t WHERE before IS NOT NULL),
b AS (SELECT conv_id, turn, unnest(range(1, len(string_split(before, chr(10))) + 1)) AS i, unnest(string_split(before, chr(10))) AS v FROM t WHERE before IS NOT NULL),
j AS (SELECT conv_id, turn, i, a.v AS av, b.v AS bv FROM a FULL JOIN b USING (conv_id, turn, i))"""


@query(f"WITH {LINES_SQL} SELECT conv_id, turn, CASE WHEN bv IS NULL THEN 'added' WHEN av IS NULL THEN 'removed' ELSE 'changed' END AS kind, i AS path, bv AS before, av AS after FROM j WHERE av IS DISTINCT FROM bv")
def tr_05_tree_diff(spark, d):
    lines = lambda c: tree.as_map(F.transform(F.split(F.col(c), "\n"), lambda v, i: F.struct((i + 1).cast("string").alias("key"), v.alias("value"))))
    pairs = V.adjacent_pairs(table(spark, d, "conversations"), "conv_id", "turn", ["turn", "text"])
    change = pairs.select("conv_id", F.col("next_turn").alias("turn"), tree.diff(lines("text"), lines("next_text")).alias("x"))
    return change.select(*job_queries.exploded("x", "conv_id", "turn")).select("conv_id", "turn", "e.kind", F.col("e.path").cast("long").alias("path"), "e.before", "e.after")


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, l_quantity, lag(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity) AS before FROM lineitem)
SELECT l_orderkey, count(*) FILTER (before IS NOT NULL AND before <> l_quantity) AS n, sum(CASE WHEN before IS NOT NULL AND before <> l_quantity THEN CAST(l_quantity AS BIGINT) ELSE 0 END)::BIGINT AS total FROM x GROUP BY 1""")
def tr_06_added_thresholds(spark, d):
    text = F.concat(F.col("l_quantity").cast("long").cast("string"), F.lit(" EUR min"))
    rows = table(spark, d, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_quantity").alias("at"), F.create_map(F.lit("1"), text).alias("m"))
    pairs = V.adjacent_pairs(rows, "l_orderkey", "at", ["m"]).withColumn("t", tree.added_thresholds(tree.diff(F.col("m"), F.col("next_m")), patterns=AMOUNTS, operators=BOUNDS))
    counts = pairs.groupBy("l_orderkey").agg(F.sum(F.size("t")).alias("n"), F.sum(F.aggregate("t", F.lit(0.0), lambda a, x: a + x["value"])).cast("long").alias("total"))
    return rows.select("l_orderkey").distinct().join(counts, "l_orderkey", "left").fillna(0, ["n", "total"])


@query("SELECT doc_id, list_filter(['the', 'ing', 'eau'], lambda k: contains(text, k)) [1] AS first_flag, len(list_filter(['the', 'ing', 'eau'], lambda k: contains(text, k))) AS flags FROM documents")
def st_15_keyword_flags(spark, d):
    flags = T.keyword_flags(F.col("text"), ("the", "ing", "eau"))
    return table(spark, d, "documents").select("doc_id", F.get(flags, 0).alias("first_flag"), F.size(flags).cast("long").alias("flags"))


def _phrase(status: str) -> str:
    """Texts of rulings by order status, each for one rule of the classifier."""
    return f"""case {status} when 0 then '원고의 상고를 기각한다' when 1 then '피고의 항소를 기각한다' when 2 then '상고를 기각한다. 상고비용은 피고가 부담한다' when 3 then '상고를 모두 기각'
when 4 then '원심을 파기하고 환송한다. 피고의 상고이유 주장은 이유 있다' when 5 then '파기하고 환송한다. 원고의 주장은 이유 있다' when 6 then '파기 환송하고 원고의 상고를 기각'
when 7 then '원고의 청구를 인용한다' when 8 then '청구인의 청구는 이유 없다' else '기타' end"""


@query("""SELECT o_orderkey, CASE o_orderkey % 10 WHEN 0 THEN '납세자패' WHEN 1 THEN '납세자승' WHEN 2 THEN '납세자승' WHEN 4 THEN '납세자패' WHEN 5 THEN '납세자승' WHEN 7 THEN '납세자승' WHEN 8 THEN '납세자패' END AS outcome FROM orders""")
def st_13_court_outcome(spark, d):
    return table(spark, d, "orders").select("o_orderkey", T.court_outcome(F.expr(_phrase("o_orderkey % 10"))).alias("outcome"))


@query("SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN '합헌' WHEN 1 THEN '헌법불합치' WHEN 2 THEN '한정위헌' WHEN 3 THEN '위헌' END AS outcome FROM orders")
def st_14_constitutional_outcome(spark, d):
    body = F.expr("""case o_orderkey % 5 when 0 then '[주 문] 헌법에 위반되지 아니한다. [이 유] 위헌' when 1 then '[주문] 헌법불합치, 위헌' when 2 then '한정위헌' when 3 then '[주 문]\n헌법에 위반된다. [이 유] 각하' else '기타' end""")
    return table(spark, d, "orders").select("o_orderkey", T.constitutional_outcome(body).alias("outcome"))


@query("""SELECT o_orderkey, '1' AS clause_no, '시행일' AS kind, CAST(o_orderdate AS DATE) AS applies_from FROM orders UNION ALL SELECT o_orderkey, '2', '시행일', NULL FROM orders
UNION ALL SELECT o_orderkey, '3', '경과조치', NULL FROM orders UNION ALL SELECT o_orderkey, '4', '특례', NULL FROM orders""")
def jb_02_addenda(spark, d):
    body = F.expr("concat('부칙 ①(시행일) 이 법은 ', year(o_orderdate), '년 ', month(o_orderdate), '월 ', day(o_orderdate), '일부터 시행한다. ②(동전) 같다 ③(일반 경과조치) 따른다 ④ 그 밖')")
    unit = F.array(F.struct(F.lit("k").alias("addendum_key"), F.lit("").alias("promulgated_at"), F.lit("00012").alias("promulgation_no"), body.alias("body")))
    shots = table(spark, d, "orders").select(F.lit(1).alias("seq"), F.col("o_orderkey").cast("string").alias("law_id"), unit.alias("addenda"))
    return corpus.ingest_addenda(shots).select(F.col("statute_id").alias("o_orderkey"), "clause_no", "kind", "applies_from")


@query("""SELECT o_orderkey, CAST(o_orderdate AS DATE) AS strict, CAST(o_orderdate AS DATE) AS listed, CAST(o_orderdate AS DATE) AS korean, CAST(o_orderdate AS DATE) AS dotted, CAST(NULL AS DATE) AS bad, CAST(o_orderdate AS DATE) - 1825 AS cutoff FROM orders""")
def dt_dates(spark, d):
    o, ymd = table(spark, d, "orders"), F.date_format("o_orderdate", "yyyyMMdd")
    return o.select(
        "o_orderkey", T.strict_date(ymd).alias("strict"), T.listed_date(F.date_format("o_orderdate", "yyyy.MM.dd")).alias("listed"), T.korean_date(F.expr("concat('x ', year(o_orderdate), '년 ', month(o_orderdate), '월', day(o_orderdate), '일')")).alias("korean"),
        T.dotted_date(F.expr("concat(year(o_orderdate), '. ', month(o_orderdate), '. ', day(o_orderdate), '.')")).alias("dotted"), T.lenient_date(F.lit("20201340")).alias("bad"), F.date_sub(F.to_date("o_orderdate"), 365 * 5).alias("cutoff"),
    )


@query("SELECT p_partkey, round_even(p_retailprice / 7, 3) AS score FROM part")
def ma_03_bround(spark, d):
    return table(spark, d, "part").select("p_partkey", graph.risk_score(F.col("p_retailprice") / 7).alias("score"))


# --- documents ------------------------------------------------------------------------------------------------------


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS mst, CAST(o_custkey AS VARCHAR) AS law_id, o_orderpriority AS law_name, strftime(o_orderdate, '%Y%m%d') AS enforced_on, CAST(o_custkey AS INTEGER) AS art_no, o_orderstatus AS title, '1' AS clause_no, 'a < b' AS clause_text FROM orders""")
def sr_06_statute_xml(spark, d):
    xml = F.expr("""concat('<법령><기본정보><법령ID>', o_custkey, '</법령ID><법령명_한글><![CDATA[', o_orderpriority, ']]></법령명_한글><시행일자>', date_format(o_orderdate, 'yyyyMMdd'),
'</시행일자></기본정보><조문><조문단위 조문키="1"><조문번호>', o_custkey, '</조문번호><조문제목>', o_orderstatus, '</조문제목><항><항번호>①</항번호><항내용><![CDATA[ a < b ]]></항내용></항></조문단위></조문></법령>')""")
    docs = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("key"), F.lit("").alias("raw_uri"), xml.alias("xml"))
    rows = law_xml.snapshots(docs).select("mst", "law_id", "law_name", "enforced_on", F.explode("articles").alias("a"))
    return rows.select("mst", "law_id", "law_name", "enforced_on", "a.art_no", "a.title", F.expr("a.clauses[0].no").alias("clause_no"), F.expr("a.clauses[0].text").alias("clause_text"))


@query("""WITH e AS (SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'R' THEN 'DELEGATES' WHEN 'A' THEN 'REFERS_TO' END AS edge_type, CAST(l_suppkey AS VARCHAR) AS target_law_mst, CAST(nullif(l_partkey, 0) AS INTEGER) AS target_art_no FROM lineitem)
SELECT CAST(l_orderkey AS VARCHAR) AS source_mst, edge_type, target_law_mst, target_art_no FROM e WHERE edge_type IS NOT NULL""")
def gb_07_delegation_xml(spark, d):
    group = F.expr("""concat('<위임구분>', case l_returnflag when 'R' then '시행령' when 'A' then '인용법령' else '행정규칙' end, '</위임구분><위임법령일련번호>', l_suppkey, '</위임법령일련번호><위임법령제목><![CDATA[x]]></위임법령제목><위임법령조문정보><위임법령조문번호>', l_partkey, '</위임법령조문번호></위임법령조문정보>')""")
    groups = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.sort_array(F.collect_list(group)), "").alias("groups"))
    xml = F.concat(F.lit("<r><위임조문정보><조정보><조문번호>5</조문번호><조문제목>t</조문제목></조정보><위임정보>"), "groups", F.lit("</위임정보></위임조문정보></r>"))
    docs = groups.select(F.col("l_orderkey").cast("string").alias("key"), xml.alias("xml"))
    return law_xml.delegations(docs).select("source_mst", "edge_type", "target_law_mst", "target_art_no")


@query("SELECT CAST(o_orderkey AS VARCHAR) AS ruling_id, coalesce(nullif(o_orderpriority, ''), '법원') AS source, CAST(o_orderdate AS DATE) AS decided_on, CASE WHEN o_orderstatus = 'F' THEN '납세자패' END AS outcome, 'g' AS gist, CASE WHEN o_orderstatus = 'F' THEN '원고의 상고를 기각한다' ELSE '-' END AS body FROM orders")
def jb_12_map_ruling(spark, d):
    xml = F.expr("""concat('<PrecService><판례정보일련번호>', o_orderkey, '</판례정보일련번호><법원명>', o_orderpriority, '</법원명><선고일자>', date_format(o_orderdate, 'yyyyMMdd'), '</선고일자><판시사항>g</판시사항><판결요지></판결요지><판례내용>', if(o_orderstatus = 'F', '원고의 상고를 기각한다', '-'), '</판례내용></PrecService>')""")
    docs = table(spark, d, "orders").select(F.lit("k").alias("key"), F.lit("").alias("raw_uri"), xml.alias("xml"))
    return corpus.map_rulings(law_xml.ruling_details(docs, "prec")).select("ruling_id", "source", "decided_on", "outcome", "gist", "body")
