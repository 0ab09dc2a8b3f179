"""Queries of the parsers and batch jobs: documents are built from the driver's tables, read by the parsers and taken through the jobs."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas
from ..functions import text as T
from ..functions import tree
from ..operators import graph, retrieval, risk
from ..operators import versions as V
from ..scratch import new_folder, written
from ..sources import law_xml, raw_zone
from ..sources.listings import fetch_listings, listing_archive
from . import corpus
from .catalogue import query
from .tables import EDGE_TYPES, PART_VERSIONS_SQL, RULINGS_SQL, VERSIONS_SQL, rulings, table, versions

AS_OF = date(1997, 6, 30)
DAY = f"DATE '{AS_OF}'"
IN_FORCE = "valid_from <= {0} AND (valid_to IS NULL OR valid_to > {0})"


def orders(spark: SparkSession, d: str, *columns) -> DataFrame:
    return table(spark, d, "orders").select(*columns) if columns else table(spark, d, "orders")


def joined(column: str) -> Column:
    return F.array_join(F.transform(column, lambda x: x.cast("string")), "|")


# --- trees: an order's lines as clauses, the parts as items -------------------------------------------------------------

LINE = "named_struct('no', cast(l_linenumber as string), 'text', l_returnflag, 'status', l_linestatus, 'part', cast(l_partkey as string))"
TREE = "named_struct('no', x.no, 'text', x.text, 'sub_clauses', array(named_struct('no', '1', 'text', x.status, 'items', array(named_struct('no', 'x', 'text', x.part)))))"
CLAUSE_ORDER = "CAST(l_linenumber AS VARCHAR), l_returnflag, l_linestatus, CAST(l_partkey AS VARCHAR)"
#: Of lines with one number the last counts.
PATHS_SQL = f"""
last AS (SELECT l_orderkey, l_linenumber, l_returnflag, l_linestatus, l_partkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_returnflag DESC, l_linestatus DESC, CAST(l_partkey AS VARCHAR) DESC) = 1),
paths AS (SELECT l_orderkey, '제' || l_linenumber || '항' AS path, l_returnflag AS value FROM last UNION ALL SELECT l_orderkey, '제' || l_linenumber || '항제1호', l_linestatus FROM last
          UNION ALL SELECT l_orderkey, '제' || l_linenumber || '항제1호x목', CAST(l_partkey AS VARCHAR) FROM last)"""


def trees(spark, d) -> DataFrame:
    """Lines are brought together flat, and nested only then: what is shuffled and sorted is small."""
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.expr(LINE))).alias("lines"))
    return lines.select("l_orderkey", F.expr(f"transform(lines, x -> {TREE})").alias("clauses"))


def tree_versions(spark, d) -> DataFrame:
    """The versions of customers whose orders have lines, with the lines as their tree and the priority as the reason."""
    tree_of = trees(spark, d).select(F.col("l_orderkey").alias("article_key"), F.struct("clauses").alias("tree"))
    return V.close_versions(versions(spark, d).drop("valid_to").join(tree_of, "article_key")).withColumn("revision_reason", F.col("o_orderpriority"))


CHANGES_SQL = f"""{VERSIONS_SQL}, {PATHS_SQL},
tv AS (SELECT * FROM v WHERE article_key IN (SELECT l_orderkey FROM lineitem)),
adjacent AS (SELECT article_key AS f, lead(article_key) OVER (PARTITION BY article_id ORDER BY valid_from) AS t FROM tv),
ends AS (SELECT DISTINCT first_value(article_key) OVER w AS f, last_value(article_key) OVER w AS t FROM tv WINDOW w AS (PARTITION BY article_id ORDER BY valid_from ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
pairs AS (SELECT f, t, TRUE AS stored FROM adjacent WHERE t IS NOT NULL UNION ALL SELECT f, t, FALSE FROM ends WHERE NOT EXISTS (SELECT 1 FROM adjacent n WHERE n.f = ends.f AND n.t = ends.t)),
a AS (SELECT f, t, stored, path, value AS before FROM pairs JOIN paths ON l_orderkey = f), b AS (SELECT f, t, stored, path, value AS after FROM pairs JOIN paths ON l_orderkey = t),
changes AS (SELECT f, t, stored, path, before, after, CASE WHEN before IS NULL THEN 'added' WHEN after IS NULL THEN 'removed' WHEN before <> after THEN 'changed' END AS kind FROM a FULL JOIN b USING (f, t, stored, path))"""


def exploded(diff: str, *keys: str) -> list:
    """Every entry of a diff: kind, path, before, after."""
    entry = lambda kind, before, after: lambda e: F.struct(F.lit(kind).alias("kind"), e["key"].alias("path"), before(e).alias("before"), after(e).alias("after"))
    none = lambda e: F.lit(None).cast("string")
    value = lambda e: e["value"]
    lists = [
        F.transform(F.map_entries(f"{diff}.added"), entry("added", none, value)), F.transform(F.map_entries(f"{diff}.removed"), entry("removed", value, none)),
        F.transform(F.map_entries(f"{diff}.changed"), entry("changed", lambda e: e["value"]["from"], lambda e: e["value"]["to"])),
    ]
    return [*keys, F.explode(F.concat(*lists)).alias("e")]


@query(f"WITH {PATHS_SQL} SELECT * FROM paths")
def tr_03_flatten_tree(spark, d):
    return trees(spark, d).select("l_orderkey", F.explode(tree.flatten_tree(F.col("clauses"))).alias("path", "value"))


@query(f"SELECT l_orderkey, string_agg(l_returnflag || chr(10) || l_linestatus || chr(10) || l_partkey, chr(10) ORDER BY {CLAUSE_ORDER}) AS text FROM lineitem GROUP BY l_orderkey")
def tr_04_full_text(spark, d):
    return trees(spark, d).select("l_orderkey", tree.full_text(F.col("clauses")).alias("text"))


ADJACENT_SQL = f"""{VERSIONS_SQL}, {PATHS_SQL},
n AS (SELECT article_key AS f, lead(article_key) OVER (PARTITION BY article_id ORDER BY valid_from) AS t FROM v WHERE article_key IN (SELECT l_orderkey FROM lineitem)),
a AS (SELECT f, t, path, value AS before FROM n JOIN paths ON l_orderkey = f WHERE t IS NOT NULL), b AS (SELECT f, t, path, value AS after FROM n JOIN paths ON l_orderkey = t),
c AS (SELECT f, t, path, before, after, CASE WHEN before IS NULL THEN 'added' WHEN after IS NULL THEN 'removed' WHEN before <> after THEN 'changed' END AS kind FROM a FULL JOIN b USING (f, t, path))"""


@query(f"WITH {ADJACENT_SQL} SELECT f AS from_version, t AS to_version, kind, path, before, after FROM c WHERE kind IS NOT NULL")
def jb_03_build_diffs(spark, d):
    return corpus.build_diffs(tree_versions(spark, d)).select(*exploded("diff", "from_version", "to_version")).select("from_version", "to_version", "e.*")


@query(f"""WITH {CHANGES_SQL} SELECT f AS from_version, t AS to_version, kind, path, before, after, CASE WHEN stored THEN 'kept' ELSE o_orderpriority END AS reason_text,
CASE WHEN stored THEN 'other' ELSE '법제처' END AS reason_source FROM changes JOIN orders ON o_orderkey = t WHERE kind IS NOT NULL""")
def ap_07_diff_articles(spark, d):
    """Stored diffs of neighbours, and those of first and last versions made on the fly."""
    version = written(tree_versions(spark, d).select("article_id", "article_key", "valid_from", "tree", "revision_reason"), "versions")  # it is read for its neighbours, ends and keys
    stored = corpus.build_diffs(version).withColumns({"reason_text": F.lit("kept"), "reason_source": F.lit("other")})
    over = Window.partitionBy("article_id").orderBy("valid_from").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = version.select(F.first("article_key").over(over).alias("from_version"), F.last("article_key").over(over).alias("to_version"))
    found = corpus.diff_articles(stored.select("from_version", "to_version").union(ends), stored, version)
    return found.select(*exploded("diff", "from_version", "to_version", "reason_text", "reason_source")).select("from_version", "to_version", "e.*", "reason_text", "reason_source")


@query(f"""WITH {VERSIONS_SQL}, x AS (SELECT article_id, valid_from, article_key % 7 AS now, lag(article_key % 7) OVER (PARTITION BY article_id ORDER BY valid_from) AS before FROM v)
SELECT article_id, valid_from, 'ratio' AS kind, '>=' AS op, CAST(now AS DOUBLE) AS value, '%' AS unit FROM x WHERE before IS NOT NULL AND now <> before""")
def ap_08_find_thresholds(spark, d):
    clause = F.expr(f"array(named_struct('no', '1', 'text', concat('100분의 ', article_key % 7, ' 이상인 경우'), 'sub_clauses', cast(array() as array<{schemas.SUB_CLAUSE}>)))")
    version = versions(spark, d).withColumn("tree", F.struct(clause.alias("clauses")))
    return corpus.find_thresholds(corpus.build_diffs(version), version).select("article_id", "valid_from", "kind", "op", "value", "unit")


@query(f"WITH {VERSIONS_SQL} SELECT article_key, '제' || l_linenumber || '항' AS chunk_path, l_returnflag || chr(10) || l_linestatus || chr(10) || l_partkey AS text FROM v JOIN lineitem ON l_orderkey = article_key WHERE article_key IN (SELECT last(article_key ORDER BY valid_from) FROM v WHERE article_key IN (SELECT l_orderkey FROM lineitem) GROUP BY article_id)")
def jb_07_embedding_chunks(spark, d):
    return corpus.embedding_chunks(tree_versions(spark, d)).select("article_key", "chunk_path", "text")


@query(f"WITH {VERSIONS_SQL} SELECT article_key AS chunk_id, o_orderstatus <> 'P' AND valid_to IS NULL AS is_current FROM v")
def jn_07_expire_chunks(spark, d):
    version = versions(spark, d)
    embedding = version.select(F.col("article_key").alias("chunk_id"), "article_key", (F.col("o_orderstatus") != "P").alias("is_current"))
    return corpus.expire_chunks(embedding, version).select("chunk_id", "is_current")


@query(f"""WITH {PATHS_SQL}, n AS (SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem))
SELECT o_orderkey, count(*) AS paths, count(DISTINCT value) AS texts, any_value(o_custkey)::DOUBLE AS threshold, any_value(o_orderkey)::VARCHAR AS added FROM n JOIN paths ON l_orderkey = o_orderkey GROUP BY o_orderkey""")
def tr_07_json(spark, d):
    """Trees, diffs and thresholds written as JSON and read back."""
    back = lambda c, schema: tree.decoded(tree.encoded(c), schema)
    rows = trees(spark, d).join(orders(spark, d, F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    change = tree.diff(F.create_map(F.lit("a"), F.lit("x")), F.create_map(F.lit("a"), F.lit("x"), F.lit("b"), F.col("l_orderkey").cast("string")))
    limits = T.thresholds(F.concat(F.lit("100분의 "), F.col("o_custkey").cast("string"), F.lit(" 이상")))
    read = rows.select("l_orderkey", back(F.struct("clauses"), schemas.TREE).alias("tree"), back(change, schemas.DIFF).alias("diff"), back(limits, f"array<{schemas.THRESHOLD}>").alias("limits"))
    flat = read.withColumn("paths", tree.flatten_tree(F.col("tree.clauses")))
    return flat.select(
        F.col("l_orderkey").alias("o_orderkey"), F.size("paths").cast("long").alias("paths"), F.size(F.array_distinct(F.map_values("paths"))).cast("long").alias("texts"),
        F.expr("limits[0].value").alias("threshold"), F.expr("diff.added['b']").alias("added"),
    )


# --- documents ----------------------------------------------------------------------------------------------------------


def documents(rows: DataFrame, key: str, xml: str) -> DataFrame:
    return rows.select(F.col(key).cast("string").alias("key"), F.lit("").alias("raw_uri"), F.expr(xml).alias("xml"))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS mst, CAST(o_custkey AS VARCHAR) AS law_id, o_orderpriority AS law_name, strftime(o_orderdate, '%Y%m%d') AS effective_date, o_orderstatus = 'F' AS is_current FROM orders")
def sr_04_law_list(spark, d):
    row = F.expr("concat('<law id=\"1\"><법령ID>', o_custkey, '</법령ID><법령명한글><![CDATA[', o_orderpriority, ']]></법령명한글><법령일련번호>', o_orderkey, '</법령일련번호><시행일자>', date_format(o_orderdate, 'yyyyMMdd'), '</시행일자><현행연혁코드>', if(o_orderstatus = 'F', '현행', '연혁'), '</현행연혁코드></law>')")
    pages = orders(spark, d).groupBy("o_custkey").agg(F.array_join(F.collect_list(row), "").alias("rows"))
    return law_xml.law_list(pages.select(F.concat(F.lit("<LawSearch><totalCnt>9</totalCnt>"), "rows", F.lit("</LawSearch>")).alias("xml")))


@query("""SELECT CAST(l_orderkey AS VARCHAR) AS mst, '제' || l_linenumber || '항' AS path, l_returnflag AS value FROM lineitem UNION ALL SELECT CAST(l_orderkey AS VARCHAR), '제' || l_linenumber || '항제1호', 'a < ' || l_linestatus FROM lineitem
UNION ALL SELECT CAST(l_orderkey AS VARCHAR), '제' || l_linenumber || '항제1호가목', CAST(l_partkey AS VARCHAR) FROM lineitem""")
def sr_08_nested_clauses(spark, d):
    clause = F.expr("""concat('<항><항번호>', substring('①②③④⑤⑥⑦', l_linenumber, 1), '</항번호><항내용>', l_returnflag, '</항내용><호><호번호>1.</호번호><호내용><![CDATA[ a < ', l_linestatus, ']]></호내용><목><목번호>가.</목번호><목내용>', l_partkey, '</목내용></목></호></항>')""")
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.collect_list(clause), "").alias("clauses"))
    docs = documents(rows, "l_orderkey", "concat('<법령><조문><조문단위 조문키=\"1\"><조문번호>1</조문번호>', clauses, '</조문단위></조문></법령>')")
    articles = law_xml.snapshots(docs).select("mst", F.explode("articles").alias("a"))
    return articles.select("mst", F.explode(tree.paths(F.col("a.clauses"))).alias("e")).select("mst", F.col("e.key").alias("path"), F.col("e.value").alias("value"))


def _hierarchies(spark, d) -> DataFrame:
    info = lambda id_, mst, kind: f"'<기본정보><법령ID>', {id_}, '</법령ID><법령일련번호>', {mst}, '</법령일련번호><법령명><![CDATA[', c_mktsegment, ']]></법령명><법종구분>{kind}</법종구분><시행일자>20200101</시행일자></기본정보>'"
    rule = f"if(c_custkey % 2 = 0, concat('<시행규칙>', {info('c_custkey * 10 + 2', 'c_custkey * 10 + 2', '부령')}, '</시행규칙>'), '')"
    decree = f"'<시행령>', {info('c_custkey * 10 + 1', 'c_custkey * 10 + 1', '대통령령')}, {rule}, '</시행령>'"
    act = f"'<법률>', {info('c_custkey * 10', 'c_custkey * 10', '법률')}, {decree}, '</법률>'"
    xml = f"concat('<법령체계도><기본정보><법령일련번호>', c_custkey, '</법령일련번호></기본정보><상하위법>', {act}, '</상하위법></법령체계도>')"
    return law_xml.hierarchy(documents(table(spark, d, "customer"), "c_custkey", xml))


HIERARCHY_SQL = "h AS (SELECT c_custkey, i AS level, c_custkey * 10 + i AS id, c_mktsegment AS name FROM customer, (VALUES (0), (1), (2)) AS v(i) WHERE i < 2 OR c_custkey % 2 = 0)"


@query(f"WITH {HIERARCHY_SQL} SELECT CAST(c_custkey AS VARCHAR) AS mst, level, CAST(id AS VARCHAR) AS law_id, name AS law_name, CASE level WHEN 0 THEN '법률' WHEN 1 THEN '대통령령' ELSE '부령' END AS law_type FROM h")
def sr_10_hierarchy(spark, d):
    return _hierarchies(spark, d).select("mst", "level", "law_id", "law_name", "law_type")


@query(f"WITH {HIERARCHY_SQL} SELECT id AS statute_id, CASE WHEN level > 0 THEN id - 1 END AS parent_id FROM h")
def sr_09_parents(spark, d):
    return corpus.parents_of(_hierarchies(spark, d))


def _targets(spark, d) -> DataFrame:
    return orders(spark, d).withColumn("target", F.expr("element_at(array('prec', 'expc', 'detc', 'admrul'), cast(o_orderkey % 4 as int) + 1)"))


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS ruling_id, CASE o_orderkey % 4 WHEN 0 THEN CASE WHEN o_orderstatus = 'F' THEN 'F' ELSE '법원' END WHEN 1 THEN '법제처' WHEN 2 THEN '헌법재판소' ELSE '행정규칙' END AS source,
CASE WHEN o_orderkey % 4 = 3 THEN '' ELSE o_orderpriority END AS case_no, 'n' || o_custkey AS title, strftime(o_orderdate, '%Y.%m.%d') AS decided_at FROM orders""")
def sr_13_ruling_lists(spark, d):
    """Listings of all four kinds, one page each."""
    court = "if(o_orderstatus = 'F', '<법원명>F</법원명>', '<법원명></법원명>')"

    def page(target: str) -> str:
        tag, id_, case, title, day = law_xml.RULING_LISTS[target]
        number = f"'<{case}>', o_orderpriority, '</{case}>'," if case else ""
        return f"when '{target}' then concat('<x><{tag} id=\"1\"><{id_}>', o_orderkey, '</{id_}>', {number} '<{title}><![CDATA[n', o_custkey, ']]></{title}><{day}>', date_format(o_orderdate, 'yyyy.MM.dd'), '</{day}>', {court if target == 'prec' else "''"}, '</{tag}></x>')"

    return law_xml.ruling_lists(_targets(spark, d).select("target", F.expr(f"case target {' '.join(map(page, law_xml.RULING_LISTS))} end").alias("xml")))


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS ruling_id, CASE o_orderkey % 4 WHEN 0 THEN '법원' WHEN 1 THEN '법제처' WHEN 2 THEN '헌법재판소' ELSE '행정규칙' END AS source, CASE WHEN o_orderkey % 4 = 3 THEN '' ELSE o_orderpriority END AS case_no,
strftime(o_orderdate, '%Y%m%d') AS decided_at, 'n' || o_custkey AS title, CASE WHEN o_orderkey % 4 = 3 THEN 'n' || o_custkey ELSE 'g' || o_custkey END AS gist, 'a' || chr(10) || 'b' || o_custkey AS body,
CASE WHEN o_orderkey % 2 = 0 THEN 'r1|r' || o_custkey ELSE '' END AS refs FROM orders""")
def sr_14_ruling_details(spark, d):
    """Details of all four kinds."""

    def detail(target: str) -> str:
        id_, case, day, title, gist, (one, two), _ = law_xml.RULING_DETAILS[target]
        return f"when '{target}' then concat('<x><{id_}>', o_orderkey, '</{id_}><{case}>', o_orderpriority, '</{case}><{day}>', date_format(o_orderdate, 'yyyyMMdd'), '</{day}><{title}>n', o_custkey, '</{title}><{gist}>g', o_custkey, '</{gist}><{one}>a</{one}><{two}><![CDATA[b', o_custkey, ']]></{two}><참조조문>r1, r', o_custkey, ',</참조조문></x>')"

    rule = "else concat('<AdmRulService><행정규칙기본정보><행정규칙일련번호>', o_orderkey, '</행정규칙일련번호><행정규칙명>n', o_custkey, '</행정규칙명><발령일자>', date_format(o_orderdate, 'yyyyMMdd'), '</발령일자></행정규칙기본정보><조문내용>a</조문내용><조문내용><![CDATA[b', o_custkey, ']]></조문내용></AdmRulService>')"
    xml = F.expr(f"case target {' '.join(map(detail, law_xml.RULING_DETAILS))} {rule} end")
    docs = _targets(spark, d).select("target", F.col("o_orderkey").cast("string").alias("key"), F.lit("").alias("raw_uri"), xml.alias("xml"))
    return law_xml.all_ruling_details(docs).select("ruling_id", "source", "case_no", "decided_at", "title", "gist", "body", joined("ref_articles").alias("refs"))


def _statute_snapshots(spark, d) -> DataFrame:
    """Orders as snapshots of their customer's statute: a heading, an article in force from the order's day, one without a day."""
    day = "date_format(o_orderdate, 'yyyyMMdd')"
    xml = f"""concat('<법령><기본정보><법령ID>', o_custkey, '</법령ID><법령명한글>law</법령명한글><법종구분>', o_orderpriority, '</법종구분><공포일자>', if(o_orderstatus = 'P', '', {day}), '</공포일자><공포번호>000', o_orderkey, '</공포번호><시행일자>', {day}, '</시행일자></기본정보><조문>
<조문단위 조문키="0"><조문번호>1</조문번호><조문여부>전문</조문여부><조문내용>제', o_orderkey, '장 총칙 &lt;개정 2020.1.1&gt;</조문내용></조문단위><조문단위 조문키="1"><조문번호>', o_custkey, '</조문번호><조문가지번호>2</조문가지번호><조문여부>조문</조문여부><조문제목>t</조문제목><조문내용>b', o_orderkey,
'</조문내용><조문시행일자>', {day}, '</조문시행일자><조문제개정유형>', if(o_orderstatus = 'F', '전부개정', '일부개정'), '</조문제개정유형></조문단위><조문단위 조문키="2"><조문번호>9</조문번호><조문여부>조문</조문여부><조문내용>x</조문내용></조문단위></조문><제개정이유><제개정이유내용>why</제개정이유내용></제개정이유></법령>')"""
    return law_xml.snapshots(documents(orders(spark, d), "o_orderkey", xml)).withColumn("seq", F.col("mst").cast("long")).withColumn("is_current", F.lit(False))


@query("""SELECT o_custkey AS statute_id, CAST(o_custkey AS INTEGER) AS art_no, 2 AS branch_no, '제' || o_orderkey || '장 총칙' AS chapter_title, CAST(o_orderdate AS DATE) AS valid_from, CAST(o_orderdate AS DATE) AS promulgated_on, CAST(nullif(o_orderkey, 0) AS INTEGER) AS promulgation_no,
o_orderstatus = 'F' AS is_full_rewrite, o_orderkey || ':1' AS moleg_article_key, 'why' AS revision_reason FROM orders""")
def jb_11_map_snapshots(spark, d):
    return corpus.map_snapshots(_statute_snapshots(spark, d)).select("statute_id", "art_no", "branch_no", "chapter_title", "valid_from", "promulgated_on", "promulgation_no", "is_full_rewrite", "moleg_article_key", "revision_reason")


@query(f"WITH {VERSIONS_SQL}, c AS (SELECT o_custkey, min(o_orderkey) AS k FROM orders GROUP BY 1) SELECT article_id AS statute_id, CAST(article_id AS INTEGER) AS art_no, '제' || k || '장 총칙' AS chapter_title, 'b' || article_key AS body, valid_from, valid_to, article_key || ':1' AS moleg_article_key FROM v JOIN c ON o_custkey = article_id")
def jb_01_ingest_statutes(spark, d):
    """Versions and articles of snapshots; of two snapshots of one day the first written counts."""
    found = corpus.ingest_statutes(_statute_snapshots(spark, d))
    return found["article_version"].join(found["article"], "article_id").select("statute_id", "art_no", "chapter_title", "body", "valid_from", "valid_to", "moleg_article_key")


@query("SELECT o_orderkey, CAST(o_orderkey % 20 + 1 AS VARCHAR) AS circled, CAST(o_custkey AS VARCHAR) AS plain, CAST(o_custkey AS VARCHAR) AS sub, 'a|b|c' || o_custkey AS refs, '총칙 ' || o_orderstatus AS heading, CAST(nullif(o_custkey, 0) AS INTEGER) AS promulgation, CASE WHEN o_custkey % 2 = 0 AND o_custkey > 0 THEN CAST(o_custkey AS INTEGER) END AS positive FROM orders")
def st_01_document_fields(spark, d):
    e = F.expr
    return orders(spark, d).select(
        "o_orderkey", T.clause_number(e("substring('①②③④⑤⑥⑦⑧⑨⑩⑪⑫⑬⑭⑮⑯⑰⑱⑲⑳', cast(o_orderkey % 20 as int) + 1, 1)")).alias("circled"), T.clause_number(e("concat(' (', o_custkey, ')')")).alias("plain"),
        T.sub_number(e("concat(o_custkey, '. ')")).alias("sub"), F.array_join(T.references(e("concat('a, b，', '\n', ' c', o_custkey, ',')")), "|").alias("refs"), T.heading(e("concat(' 총칙 ', o_orderstatus, ' <개정 2020.1.1> ')")).alias("heading"),
        T.promulgation_number(e("concat('000', o_custkey)")).alias("promulgation"), T.positive_int(e("if(o_custkey % 2 = 0, concat(' ', o_custkey), if(o_custkey % 3 = 0, '0', '-1'))")).alias("positive"),
    )


# --- rulings ------------------------------------------------------------------------------------------------------------


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS ruling_id, '법원' AS source, CAST(o_orderdate AS DATE) AS decided_on, CASE WHEN o_orderstatus = 'F' THEN '납세자패' END AS outcome, CASE WHEN o_orderstatus = 'P' THEN 'n' || o_custkey ELSE '실질과세' END AS gist,
o_orderstatus <> 'P' AS body_available, CASE WHEN o_orderstatus <> 'P' THEN '실질과세' END AS flags FROM orders""")
def jb_04_ingest_rulings(spark, d):
    """All orders are listed, those that are not pending have details."""
    o = orders(spark, d)
    listed = o.select(F.col("o_orderkey").cast("string").alias("ruling_id"), F.lit("법원").alias("source"), F.lit("").alias("case_no"), F.expr("concat('n', o_custkey)").alias("title"), F.date_format("o_orderdate", "yyyy.MM.dd").alias("decided_at"))
    xml = "concat('<PrecService><판례정보일련번호>', o_orderkey, '</판례정보일련번호><선고일자>', date_format(o_orderdate, 'yyyyMMdd'), '</선고일자><판시사항>실질과세</판시사항><판례내용>', if(o_orderstatus = 'F', '원고의 상고를 기각한다', '-'), '</판례내용></PrecService>')"
    details = law_xml.ruling_details(documents(o.where("o_orderstatus <> 'P'"), "o_orderkey", xml), "prec")
    return corpus.ingest_rulings(listed, details).select("ruling_id", "source", "decided_on", "outcome", "gist", "body_available", F.get("anti_avoidance", 0).alias("flags"))


CITED = "concat('see ', c_name, ' LAW', CASE WHEN c_custkey % 2 = 0 THEN concat(' (', year(o_orderdate), '. ', month(o_orderdate), '. ', day(o_orderdate), '. enacted)') ELSE '' END, ' ART', c_custkey, '-', c_nationkey, ' as well')"
ARTICLE = r"ART(\d+)(?:-(\d+))?"
SEGMENTS = "concat('see ', c_mktsegment, CASE WHEN c_custkey % 3 = 0 THEN ' DECREE' ELSE '' END, CASE WHEN c_custkey % 2 = 0 THEN concat(' (', year(o_orderdate), '. ', month(o_orderdate), '. ', day(o_orderdate), '. enacted)') ELSE '' END, ' ART', c_custkey, ' as well')"


def _law_versions(spark, d) -> DataFrame:
    """Versions of customers as articles of their segment's law or, every third, of its decree."""
    law = F.expr("concat(c_mktsegment, if(c_custkey % 3 = 0, ' DECREE', ''))")
    articles = table(spark, d, "customer").select(F.col("c_custkey").alias("article_id"), law.alias("law"), F.col("c_custkey").cast("int").alias("art_no"), F.lit(0).alias("branch_no"))
    return versions(spark, d).join(articles, "article_id")


def _segment_names(spark, d) -> list[str]:
    """A small dimension; each decree's name begins with that of its law."""
    names = [r[0] for r in table(spark, d, "customer").select("c_mktsegment").distinct().collect()]
    return [*names, *(f"{n} DECREE" for n in names)]


def _citations(spark, d) -> DataFrame:
    o = orders(spark, d).join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return o.select(F.col("o_orderkey").alias("ruling_id"), F.expr(SEGMENTS).alias("text"), F.date_add(F.to_date("o_orderdate"), 400).alias("decided_on"))


RESOLVED_SQL = f"{VERSIONS_SQL}, q AS (SELECT o_orderkey AS ruling_id, o_custkey AS article_id, CASE WHEN o_custkey % 2 = 0 THEN CAST(o_orderdate AS DATE) ELSE CAST(o_orderdate AS DATE) + 400 END AS day FROM orders JOIN customer ON c_custkey = o_custkey), x AS (SELECT ruling_id, article_id, article_key FROM q JOIN v USING (article_id) WHERE {IN_FORCE.format('q.day')})"


@query(f"WITH {RESOLVED_SQL} SELECT ruling_id, article_id, article_key FROM x")
def ap_05_resolve_citation(spark, d):
    return corpus.resolve_citations(_citations(spark, d), _law_versions(spark, d), _segment_names(spark, d), AS_OF, article=ARTICLE).select("ruling_id", "article_id", "article_key")


@query(f"WITH {RESOLVED_SQL} SELECT ruling_id, article_id || '|' || article_id AS cited FROM x")
def jb_05_resolve_references(spark, d):
    rows = _citations(spark, d).select("ruling_id", "decided_on", F.array("text", F.lit("nothing"), "text").alias("ref_articles"))
    found = corpus.resolve_references(rows, _law_versions(spark, d), _segment_names(spark, d), AS_OF, article=ARTICLE)
    return found.select("ruling_id", joined("cited_article_ids").alias("cited"))


@query("""WITH x AS (SELECT CASE o_orderstatus WHEN 'F' THEN o_custkey WHEN 'O' THEN o_custkey + 1 END AS expected, CASE WHEN o_orderpriority <> '1-URGENT' THEN o_custkey END AS answer FROM orders),
s AS (SELECT count(*) FILTER (expected = answer) AS tp, count(*) FILTER (answer IS NOT NULL AND expected IS DISTINCT FROM answer) AS fp, count(*) FILTER (expected IS NOT NULL AND answer IS DISTINCT FROM expected) AS fn, count(*) FILTER (expected IS NULL AND answer IS NULL) AS tn FROM x)
SELECT tp, fp, fn, tn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall FROM s""")
def ap_12_evaluate_citations(spark, d):
    expected = F.expr("case o_orderstatus when 'F' then named_struct('law', '소득세법', 'art_no', cast(o_custkey as int), 'branch_no', 0) when 'O' then named_struct('law', '소득세법', 'art_no', cast(o_custkey + 1 as int), 'branch_no', 0) end")
    cases = orders(spark, d).select(F.expr("if(o_orderpriority = '1-URGENT', '조문 없음', concat('구 소득세법 제', o_custkey, '조에 따라'))").alias("text"), expected.alias("expected"))
    found = corpus.evaluate_citations(cases)
    return found.withColumns({c: F.round(c, 6) for c in ("precision", "recall")})


@query("SELECT DISTINCT name FROM (SELECT p_type AS name FROM part UNION ALL SELECT p_brand FROM part UNION ALL SELECT p_name FROM part WHERE p_size = 1 UNION ALL VALUES ('조특법'), ('국기법'))")
def so_05_law_names(spark, d):
    brands = F.when(F.col("p_size") == 1, F.array("p_brand", "p_name")).otherwise(F.array("p_brand"))
    return corpus.law_names(table(spark, d, "part").select(F.col("p_type").alias("name"), brands.alias("abbreviations")))


UNPATCHED_SQL = f"""{RULINGS_SQL}, {PART_VERSIONS_SQL}, t AS (SELECT c.article_id, count(*) AS total, count(f.ruling_id) AS flagged FROM r JOIN c USING (ruling_id) LEFT JOIN f USING (ruling_id) GROUP BY 1),
u AS (SELECT DISTINCT r.ruling_id, c.article_id FROM r JOIN c USING (ruling_id) JOIN pv ON pv.article_id = c.article_id WHERE outcome = 'O' AND decided_on >= DATE '1996-01-01' AND valid_to IS NULL AND valid_from <= decided_on)"""


@query(f"WITH {UNPATCHED_SQL} SELECT article_id, ruling_id AS origin_ruling, 'alive' AS status, CAST(round_even(flagged / total, 3) AS DOUBLE) AS risk_score FROM u JOIN t USING (article_id) WHERE article_id IN (SELECT p_partkey FROM part)")
def jb_09_find_unpatched(spark, d):
    """The whole job: citations, won rulings on articles that stand, their risk, and only what is not stored yet."""
    from .tables import part_versions

    ruling = rulings(spark, d).withColumn("outcome", F.when(F.col("outcome") == "O", T.WON).otherwise(T.LOST))
    article = table(spark, d, "part").select(F.col("p_partkey").alias("article_id"))
    nothing = spark.createDataFrame([], "article_id long, origin_ruling long")
    return corpus.find_unpatched(ruling, article, part_versions(spark, d), nothing, date(1996, 1, 1)).withColumn("risk_score", F.col("risk_score").cast("double"))


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'O' AND o_custkey BETWEEN 1 AND 40 AND CAST(o_orderdate AS DATE) + 400 >= DATE '1998-01-01'")
def pf_06_claimable_articles(spark, d):
    day = F.to_date("o_orderdate")
    rows = orders(spark, d, F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("article_id"), F.when(F.col("o_orderstatus") == "O", "alive").otherwise("dead").alias("status"), F.lit(None).cast("date").alias("patched_on"), F.date_add(day, 400).alias("claim_deadline"))
    return risk.find_claimable(rows, date(1998, 1, 1), article_ids=list(range(1, 41))).select("id")


@query(f"WITH {VERSIONS_SQL} SELECT c_nationkey AS statute_id, article_id, article_key, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS INTEGER) AS position FROM v JOIN customer ON c_custkey = article_id WHERE {IN_FORCE.format(DAY)}")
def tk_01_effective_law(spark, d):
    article = table(spark, d, "customer").select(F.col("c_custkey").alias("article_id"), F.col("c_nationkey").alias("statute_id"), F.col("c_custkey").cast("int").alias("art_no"), F.lit(0).alias("branch_no"))
    return V.effective_law(versions(spark, d), article, AS_OF).select("statute_id", "article_id", "article_key", "position")


# --- graph: suppliers as statutes, what they deliver as articles ----------------------------------------------------------


def _statutes(spark, d) -> DataFrame:
    """Only suppliers with a balance are known statutes."""
    return table(spark, d, "supplier").where("s_acctbal > 500").select(
        F.col("s_suppkey").alias("statute_id"), F.col("s_name").alias("name"), F.col("s_suppkey").cast("string").alias("current_mst"), F.expr("date_add(DATE '1995-01-01', cast(s_suppkey % 100 as int))").alias("enforced_on"), (F.col("s_nationkey") + 1_000_000).alias("parent_id")
    )


def _articles(spark, d) -> DataFrame:
    pairs = table(spark, d, "lineitem").select("l_suppkey", "l_partkey").distinct()
    return pairs.select((F.col("l_suppkey") * 10_000_000 + F.col("l_partkey")).alias("article_id"), F.col("l_suppkey").alias("statute_id"), F.col("l_partkey").cast("int").alias("art_no"), F.lit(0).alias("branch_no"))


def _following(spark, d) -> DataFrame:
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    kind = F.coalesce(*(F.when(F.col("l_returnflag") == k, F.lit(v)) for k, v in EDGE_TYPES.items()))
    line = table(spark, d, "lineitem").select("l_suppkey", "l_partkey", kind.alias("edge_type"), F.lead("l_suppkey").over(order).alias("t_suppkey"), F.lead("l_partkey").over(order).alias("t_partkey"))
    return line.where("t_suppkey is not null")


def _delegations(spark, d) -> DataFrame:
    zero = F.lit(0)
    return _following(spark, d).select(
        F.col("l_suppkey").cast("string").alias("source_mst"), F.col("l_partkey").cast("int").alias("source_art_no"), zero.alias("source_branch_no"), "edge_type",
        F.col("t_suppkey").cast("string").alias("target_law_mst"), F.col("t_partkey").cast("int").alias("target_art_no"), zero.alias("target_branch_no"),
    )


REFERENCES_SQL = """following AS (SELECT l_suppkey, l_partkey, CASE l_returnflag WHEN 'R' THEN 'DELEGATES' WHEN 'A' THEN 'REFERS_TO' ELSE 'MUTATIS' END AS type, lead(l_suppkey) OVER o AS t_suppkey, lead(l_partkey) OVER o AS t_partkey
           FROM lineitem WINDOW o AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate)),
known AS (SELECT * FROM supplier WHERE s_acctbal > 500),
refs AS (SELECT DISTINCT l_suppkey * 10000000 + l_partkey AS src, t_suppkey * 10000000 + t_partkey AS dst, type, DATE '1995-01-01' + CAST(l_suppkey % 100 AS INTEGER) AS valid_from
         FROM following WHERE l_suppkey IN (SELECT s_suppkey FROM known) AND t_suppkey IN (SELECT s_suppkey FROM known))"""


@query(f"WITH {REFERENCES_SQL} SELECT src, dst, type, valid_from FROM refs")
def gb_08_reference_edges(spark, d):
    return graph.reference_edges(_delegations(spark, d), _statutes(spark, d), _articles(spark, d)).select("src", "dst", "type", "valid_from")


def _defining(spark, d) -> DataFrame:
    """Versions whose body and tree define terms."""
    body = F.expr("""concat('"', o_orderpriority, '"이란 것을 말한다. 이하 "', o_orderstatus, '"라 한다')""")
    clause = F.expr(f"""array(named_struct('no', '1', 'text', concat('"T', article_id, '" (생략) 란 그것이다'), 'sub_clauses', cast(array() as array<{schemas.SUB_CLAUSE}>)))""")
    return versions(spark, d).withColumn("body", body).withColumn("tree", F.struct(clause.alias("clauses")))


DEFINES_SQL = "SELECT DISTINCT article_id AS src, unnest([o_orderpriority, o_orderstatus, 'T' || article_id]) AS term FROM v WHERE valid_to IS NULL"
SUPERSEDES_SQL = "SELECT article_key AS src, lag(article_key) OVER (PARTITION BY article_id ORDER BY valid_from) AS dst FROM v"


@query(f"WITH {VERSIONS_SQL} {DEFINES_SQL}")
def gb_09_defines_edges(spark, d):
    return graph.defines_edges(_defining(spark, d))


@query(f"WITH {VERSIONS_SQL}, s AS ({SUPERSEDES_SQL}) SELECT article_id AS src, article_key AS dst, 'HAS_VERSION' AS type FROM v UNION ALL SELECT src, dst, 'SUPERSEDES' FROM s WHERE dst IS NOT NULL")
def gb_06_version_edges(spark, d):
    version = versions(spark, d)
    return graph.version_edges(version).union(graph.supersedes_edges(version))


@query("SELECT DISTINCT p_brand AS pattern_type, 'about ' || p_brand AS description FROM part")
def gb_10_pattern_vertices(spark, d):
    return graph.pattern_vertices(table(spark, d, "part").select(F.col("p_brand").alias("code"), F.col("p_name").alias("name"), F.concat(F.lit("about "), "p_brand").alias("description")))


@query(f"""WITH {VERSIONS_SQL}, {REFERENCES_SQL}, d AS ({DEFINES_SQL}), s AS ({SUPERSEDES_SQL})
SELECT 'DELEGATES_TO' AS kind, CAST(s_suppkey AS VARCHAR) AS src, CAST(s_nationkey + 1000000 AS VARCHAR) AS dst FROM known UNION ALL SELECT 'HAS_VERSION', CAST(article_id AS VARCHAR), CAST(article_key AS VARCHAR) FROM v
UNION ALL SELECT 'SUPERSEDES', CAST(src AS VARCHAR), CAST(dst AS VARCHAR) FROM s WHERE dst IS NOT NULL UNION ALL SELECT type, CAST(src AS VARCHAR), CAST(dst AS VARCHAR) FROM refs
UNION ALL SELECT 'DEFINES', CAST(src AS VARCHAR), term FROM d UNION ALL SELECT DISTINCT 'CITES', CAST(l_orderkey AS VARCHAR), CAST(l_suppkey * 10000000 + l_partkey AS VARCHAR) FROM lineitem""")
def gb_01_build_graph(spark, d):
    line = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("ruling_id")).agg(F.collect_list(F.col("l_suppkey") * 10_000_000 + F.col("l_partkey")).alias("cited_article_ids"))
    patterns = spark.createDataFrame([], schemas.PATTERN_TYPE)
    return graph.all_edges(graph.build_graph(_statutes(spark, d), _articles(spark, d), _defining(spark, d), line, _delegations(spark, d), patterns))


REWRITE_SQL = """n AS (SELECT s_name, l_suppkey, l_partkey, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate) AS t_partkey FROM lineitem JOIN supplier ON s_suppkey = l_suppkey),
w AS (SELECT DISTINCT * FROM n WHERE t_partkey IS NOT NULL)"""


def _rewrites(spark, d) -> tuple[DataFrame, DataFrame]:
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    line = table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select("s_name", "l_suppkey", "l_partkey", F.lead("l_partkey").over(order).alias("t_partkey")).where("t_partkey is not null").distinct()
    rows = line.select(F.col("s_name").alias("statute_name"), F.col("l_partkey").cast("int").alias("from_art_no"), F.lit(0).alias("from_branch_no"), F.col("t_partkey").cast("int").alias("to_art_no"), F.lit(0).alias("to_branch_no"), F.lit("n").alias("note"))
    statute = table(spark, d, "supplier").select(F.col("s_suppkey").alias("statute_id"), F.col("s_name").alias("name"))
    return corpus.load_rewrite_map(rows, statute, _articles(spark, d))


@query(f"WITH {REWRITE_SQL} SELECT DISTINCT l_suppkey * 10000000 + l_partkey AS from_article_id, l_suppkey * 10000000 + t_partkey AS to_article_id, 'n' AS note FROM w WHERE (l_suppkey, t_partkey) IN (SELECT l_suppkey, l_partkey FROM lineitem)")
def jb_06_load_rewrite_map(spark, d):
    return _rewrites(spark, d)[0]


@query(f"WITH {REWRITE_SQL} SELECT s_name AS statute_name, CAST(l_partkey AS INTEGER) AS from_art_no, CAST(t_partkey AS INTEGER) AS to_art_no FROM w WHERE (l_suppkey, t_partkey) NOT IN (SELECT l_suppkey, l_partkey FROM lineitem)")
def jb_06_unknown_rewrites(spark, d):
    return _rewrites(spark, d)[1].select("statute_name", "from_art_no", "to_art_no")


def letters_model():
    """A model that tells of a text its length, its share of the letter e, and its number of words."""
    return lambda texts: [[len(t), t.count("e") / len(t), len(t.split(" "))] for t in texts]


@query("""SELECT p_partkey AS article_key, length(p_name) AS n_chars, round((length(p_name) - length(replace(p_name, 'e', ''))) / length(p_name), 5) AS share, len(string_split(p_name, ' ')) AS n_words, p_size > 10 AS is_current FROM part""")
def jb_07_embedding_backfill(spark, d):
    """Every part as an article of one clause, embedded in two turns; then those of small size are closed, and expire."""
    clause = F.expr(f"array(named_struct('no', cast(null as string), 'text', p_name, 'sub_clauses', cast(array() as array<{schemas.SUB_CLAUSE}>)))")
    version = table(spark, d, "part").select(F.col("p_partkey").alias("article_key"), F.struct(clause.alias("clauses")).alias("tree"), F.lit(None).cast("date").alias("valid_to"), "p_size")
    store = corpus.embedding_store(spark, new_folder(spark, "embeddings"), buckets=8)
    corpus.embed_backfill(version, store, letters_model, 3, turns=2)
    corpus.embed_backfill(version.withColumn("valid_to", F.when(F.col("p_size") <= 10, F.lit("2020-01-01").cast("date"))), store, letters_model, 3)
    e = lambda k: F.col("embedding")[k]
    return store.read().select("article_key", e(0).cast("long").alias("n_chars"), F.round(e(1).cast("double"), 5).alias("share"), e(2).cast("long").alias("n_words"), "is_current")


# --- sources and sinks: files and listings made of the tables ---------------------------------------------------------


def nations_of(rows: dict[str, list[tuple]], page_size: int):
    """A source of listings: the nations of each region, some to a page."""

    def fetch(target: str, query: str, page: int) -> str:
        laws = "".join(f"<law><법령ID>{k}</법령ID><법령명한글>{n}</법령명한글><법령일련번호>{k + 100}</법령일련번호><시행일자>20200101</시행일자><현행연혁코드>현행</현행연혁코드></law>" for k, n in rows[query][(page - 1) * page_size : page * page_size])
        return f"<LawSearch><totalCnt>{len(rows[query])}</totalCnt>{laws}</LawSearch>"

    return fetch


def measured(xml: str) -> tuple[int, int]:
    return xml.count("<law>"), int(xml.split("<totalCnt>")[1].split("<")[0])


@query("SELECT CAST(n_nationkey AS VARCHAR) AS law_id, n_name AS law_name, CAST(n_nationkey + 100 AS VARCHAR) AS mst, r_name AS query FROM nation JOIN region ON n_regionkey = r_regionkey")
def sr_03_paged_listing(spark, d):
    """The nations of every region as a listing of two to a page, fetched by the tasks, archived and parsed."""
    region = table(spark, d, "region").select("r_regionkey", "r_name")
    known: dict[str, list[tuple]] = {r["r_name"]: [] for r in region.collect()}  # the service's data, a dimension
    for r in table(spark, d, "nation").join(region, F.col("n_regionkey") == F.col("r_regionkey")).orderBy("n_nationkey").collect():
        known[r["r_name"]].append((r["n_nationkey"], r["n_name"]))
    listings = region.select(F.lit("eflaw").alias("target"), F.col("r_name").alias("query"))
    pages = fetch_listings(listings, nations_of(known, 2), measured, listing_archive(spark, new_folder(spark, "listing"), buckets=2), page_size=2, at_a_time=8, slots=2)
    return law_xml.law_list(pages.select("query", "xml"), "query").select("law_id", "law_name", "mst", "query")


@query("SELECT CAST(c_custkey AS VARCHAR) AS key, c_mktsegment || ' ' || c_custkey AS content, 'zone#' || c_custkey AS place FROM customer")
def sk_01_raw_zone(spark, d):
    """Customers put into a raw zone, half of them twice with another content, which the zone doesn't take; read back by their URIs."""
    root = new_folder(spark, "zone")
    c = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("key"), F.concat_ws(" ", "c_mktsegment", F.col("c_custkey").cast("string")).alias("content"))
    raw_zone.put_raw(c.where("key % 2 = 0"), root)
    stored = raw_zone.put_raw(c.withColumn("content", F.when(F.expr("key % 2 = 0"), "changed").otherwise(F.col("content"))), root)
    found = spark.read.parquet(root).select("key", F.col("content").cast("string").alias("content"))
    return found.join(stored.distinct(), "key").select("key", "content", F.replace("raw_uri", F.lit(root), F.lit("zone")).alias("place"))


@query("SELECT CAST(max(c_custkey) AS VARCHAR) AS content FROM customer")
def sk_02_get_raw(spark, d):
    root = new_folder(spark, "zone")
    stored = raw_zone.put_raw(table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("key"), F.col("c_custkey").cast("string").alias("content")), root)
    uri = stored.agg(F.max_by("raw_uri", F.col("key").cast("long"))).first()[0]
    return raw_zone.get_raw(spark, uri).select(F.col("content").cast("string").alias("content"))


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def sr_18_csv(spark, d):
    folder = new_folder(spark, "csv")
    table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey").write.csv(folder, header=True)
    return raw_zone.read_csv(spark, folder, "n_nationkey long, n_name string, n_regionkey long")


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def sr_19_jsonl(spark, d):
    """Orders as JSON lines, with blank lines between."""
    folder = new_folder(spark, "json")
    lines = table(spark, d, "orders").select(F.to_json(F.struct("o_orderkey", "o_orderstatus", "o_totalprice")).alias("value"))
    lines.select(F.explode(F.array("value", F.lit("  "))).alias("value")).write.text(folder)
    return raw_zone.read_jsonl(spark, folder, "o_orderkey long, o_orderstatus string, o_totalprice double")


@query("SELECT p_name AS value FROM part WHERE p_partkey % 3 <> 0")
def sr_20_lines(spark, d):
    """Names of parts, a third of them commented out."""
    folder = new_folder(spark, "lines")
    line = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("# "), "p_name")).otherwise(F.concat(F.lit(" "), "p_name"))
    table(spark, d, "part").select(F.explode(F.array(line, F.lit(""))).alias("value")).write.text(folder)
    return raw_zone.read_lines(spark, folder)


@query(f"WITH {VERSIONS_SQL} SELECT article_key, article_id, lower(o_orderpriority) AS text, valid_from FROM v WHERE {IN_FORCE.format(DAY)}")
def jn_05_dated_chunks(spark, d):
    """Chunks, which know their version only, beside the article and the interval of it, as search takes them."""
    v = versions(spark, d)
    chunks = table(spark, d, "orders").select(F.col("o_orderkey").alias("article_key"), F.lower("o_orderpriority").alias("text"))
    return retrieval.dated_chunks(chunks, v, AS_OF).select("article_key", "article_id", "text", "valid_from")
