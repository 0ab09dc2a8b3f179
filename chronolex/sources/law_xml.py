"""Parsers of the XML documents, as Column expressions over a string column `xml`.

Leaves are read as their text, markup in CDATA included. A leaf that has child elements keeps their markup.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clause_number, found_all, positive_int, references, stripped, sub_number

# Element names of the documents.
SNAPSHOT = (
    "`기본정보` struct<`법령ID`: string, `법령일련번호`: string, `법령명_한글`: string, `법령명한글`: string, `법종구분`: string, "
    "`소관부처`: struct<_VALUE: string, `_소관부처코드`: string>, `공포일자`: string, `공포번호`: string, `제개정구분`: string, `시행일자`: string>, "
    "`조문` struct<`조문단위`: array<struct<`_조문키`: string, `조문번호`: string, `조문가지번호`: string, `조문여부`: string, `조문제목`: string, "
    "`조문내용`: string, `조문시행일자`: string, `조문제개정유형`: string, `조문변경여부`: string, `조문이동이전`: string, `조문이동이후`: string, "
    "`항`: array<struct<`항번호`: string, `항내용`: string, `호`: array<struct<`호번호`: string, `호내용`: string, "
    "`목`: array<struct<`목번호`: string, `목내용`: string>>>>>>>>>, "
    "`부칙` struct<`부칙단위`: array<struct<`_부칙키`: string, `부칙공포일자`: string, `부칙공포번호`: string, `부칙내용`: string>>>, "
    "`제개정이유` struct<`제개정이유내용`: string>"
)
LAW_ROW = "struct<`법령ID`: string, `법령명한글`: string, `법령일련번호`: string, `시행일자`: string, `현행연혁코드`: string>"
#: target: row tag, and the fields of id, case number, title, date.
RULING_LISTS = {
    "prec": ("prec", "판례일련번호", "사건번호", "사건명", "선고일자"),
    "expc": ("expc", "법령해석례일련번호", "안건번호", "안건명", "회신일자"),
    "detc": ("Detc", "헌재결정례일련번호", "사건번호", "사건명", "종국일자"),
    "admrul": ("admrul", "행정규칙일련번호", None, "행정규칙명", "발령일자"),
}
SOURCES = {"prec": "법원", "expc": "법제처", "detc": "헌법재판소", "admrul": "행정규칙"}
#: target: fields of id, case number, date, title, gist, parts of the body, references.
RULING_DETAILS = {
    "prec": ("판례정보일련번호", "사건번호", "선고일자", "사건명", "판시사항", ("판결요지", "판례내용"), True),
    "expc": ("법령해석례일련번호", "안건번호", "해석일자", "안건명", "질의요지", ("회답", "이유"), False),
    "detc": ("헌재결정례일련번호", "사건번호", "종국일자", "사건명", "판시사항", ("결정요지", "전문"), True),
}
CLEAN_ITEM = "struct<no: string, text: string>"


def _text(column) -> Column:
    return stripped(column if isinstance(column, Column) else F.col(column))


def law_list(pages: DataFrame, *keep: str) -> DataFrame:
    """law_id, law_name, mst, effective_date, is_current of every row of listing pages, and what columns of the pages are to be kept."""
    row = F.explode(F.from_xml("xml", f"law array<{LAW_ROW}>")["law"]).alias("r")
    r = lambda name: _text(F.col(f"r.`{name}`"))
    return pages.select(*keep, row).select(*keep, r("법령ID").alias("law_id"), r("법령명한글").alias("law_name"), r("법령일련번호").alias("mst"), r("시행일자").alias("effective_date"), (r("현행연혁코드") == "현행").alias("is_current"))


def _clauses(units: Column) -> Column:
    item = lambda m: F.struct(sub_number(_text(m["목번호"])).alias("no"), _text(m["목내용"]).alias("text"))
    items = lambda h: F.coalesce(F.transform(h["목"], item), F.array().cast(f"array<{CLEAN_ITEM}>"))
    sub = lambda h: F.struct(sub_number(_text(h["호번호"])).alias("no"), _text(h["호내용"]).alias("text"), items(h).alias("items"))
    subs = lambda c: F.coalesce(F.transform(c["호"], sub), F.array().cast(f"array<struct<no: string, text: string, items: array<{CLEAN_ITEM}>>>"))
    clause = lambda c: F.struct(clause_number(_text(c["항번호"])).alias("no"), _text(c["항내용"]).alias("text"), subs(c).alias("sub_clauses"))
    return F.coalesce(F.transform(units, clause), F.array().cast(f"array<struct<no: string, text: string, sub_clauses: array<struct<no: string, text: string, items: array<{CLEAN_ITEM}>>>>>"))


def snapshots(documents: DataFrame) -> DataFrame:
    """One row per statute document (key = mst): header, articles and addenda in document order."""
    parsed = documents.withColumn("d", F.from_xml("xml", SNAPSHOT))
    info = lambda name: _text(F.col(f"d.`기본정보`.`{name}`"))

    def article(u: Column) -> Column:
        number = lambda name: F.coalesce(_text(u[name]).try_cast("int"), F.lit(0))
        return F.struct(
            F.coalesce(u["_조문키"], F.lit("")).alias("jomun_key"), number("조문번호").alias("art_no"), number("조문가지번호").alias("branch_no"), (_text(u["조문여부"]) == "전문").alias("is_heading"),
            _text(u["조문제목"]).alias("title"), _text(u["조문내용"]).alias("body"), _text(u["조문시행일자"]).alias("effective_from"), _text(u["조문제개정유형"]).alias("revision_type"),
            (_text(u["조문변경여부"]) == "Y").alias("changed"), _text(u["조문이동이전"]).alias("moved_from"), _text(u["조문이동이후"]).alias("moved_to"), _clauses(u["항"]).alias("clauses"),
        )

    def addendum(u: Column) -> Column:
        return F.struct(F.coalesce(u["_부칙키"], F.lit("")).alias("addendum_key"), _text(u["부칙공포일자"]).alias("promulgated_at"), _text(u["부칙공포번호"]).alias("promulgation_no"), _text(u["부칙내용"]).alias("body"))

    return parsed.select(
        F.col("key").alias("mst"), info("법령ID").alias("law_id"), F.coalesce(F.nullif(info("법령명_한글"), F.lit("")), info("법령명한글")).alias("law_name"), info("법종구분").alias("law_type"),
        F.coalesce(F.col("d.`기본정보`.`소관부처`.`_소관부처코드`"), F.lit("")).alias("ministry_code"), info("공포일자").alias("promulgated_on"), info("공포번호").alias("promulgation_no"),
        info("제개정구분").alias("revision_type"), info("시행일자").alias("enforced_on"), _text(F.col("d.`제개정이유`.`제개정이유내용`")).alias("revision_reason"), "raw_uri",
        F.transform(F.col("d.`조문`.`조문단위`"), article).alias("articles"), F.transform(F.col("d.`부칙`.`부칙단위`"), addendum).alias("addenda"),
    )


def hierarchy(documents: DataFrame) -> DataFrame:
    """(mst, level, law_id, law_mst, law_name, law_type, enforced_on): act, decree and rule, one of each."""
    levels = ("/법령체계도/상하위법/법률", "/법령체계도/상하위법/법률[1]/시행령", "/법령체계도/상하위법/법률[1]/시행령[1]/시행규칙")
    field = lambda base, name: stripped(F.xpath_string("xml", F.lit(f"{base}[1]/기본정보[1]/{name}")))
    entry = lambda i, base: F.struct(F.lit(i).alias("level"), *(field(base, n).alias(a) for n, a in (("법령ID", "law_id"), ("법령일련번호", "law_mst"), ("법령명", "law_name"), ("법종구분", "law_type"), ("시행일자", "enforced_on"))))
    own = stripped(F.xpath_string("xml", F.lit("/법령체계도/기본정보/법령일련번호")))
    return documents.select(own.alias("mst"), F.explode(F.array(*(entry(i, b) for i, b in enumerate(levels)))).alias("e")).select("mst", "e.*").where("law_mst <> ''")


def _child(xml: Column, tag: str) -> Column:
    """Text of the first child of a name, unwrapped; empty without one."""
    raw = F.regexp_extract(xml, rf"(?s)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>", 1)
    plain = F.regexp_replace(raw, r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(entity), F.lit(char))
    return stripped(plain)


def delegations(documents: DataFrame) -> DataFrame:
    """Edges of delegation documents. Groups are told by the order of differently named siblings, which the XML reader loses,
    so ordered children are cut from the string; a kind opens a group, and what stands before the first kind is dropped."""
    units = documents.select(F.col("key").alias("source_mst"), F.posexplode(found_all(F.col("xml"), r"(?s)<위임조문정보>(.*?)</위임조문정보>")).alias("unit_no", "unit"))
    head = F.regexp_extract("unit", r"(?s)<조정보>(.*?)</조정보>", 1)
    named = units.select(
        "source_mst", "unit_no", "unit", positive_int(_child(head, "조문번호")).alias("source_art_no"), F.coalesce(positive_int(_child(head, "조문가지번호")), F.lit(0)).alias("source_branch_no"),
        F.contains(_child(head, "조문제목"), F.lit("준용")).alias("mutatis"),
    ).where("source_art_no is not null")
    blocks = named.select("*", F.posexplode(found_all(F.col("unit"), r"(?s)<위임정보>(.*?)</위임정보>")).alias("block_no", "block")).drop("unit")
    child = r"(?s)<(위임구분|위임법령일련번호|위임법령제목|위임법령조문정보)(?:\s[^>]*)?>(.*?)</\1>"
    tags, bodies = found_all(F.col("block"), child, 1), found_all(F.col("block"), child, 0)
    # Group number of each child: how many kinds there are up to it; all within one array, so no shuffle is needed.
    flat = blocks.select("*", tags.alias("tags"), bodies.alias("bodies")).drop("block")
    number = lambda i: F.size(F.filter(F.slice("tags", F.lit(1), i + 1), lambda t: t == "위임구분"))
    children = F.transform("tags", lambda t, i: F.struct(t.alias("tag"), F.get(F.col("bodies"), i).alias("body"), number(i).alias("g")))
    grouped = flat.withColumn("children", F.filter(children, lambda c: c["g"] > 0)).drop("tags", "bodies")
    groups = grouped.select("*", F.explode(F.array_distinct(F.transform("children", lambda c: c["g"]))).alias("g"))
    last = lambda tag: F.coalesce(F.try_element_at(F.filter("children", lambda c: (c["g"] == F.col("g")) & (c["tag"] == tag)), F.lit(-1))["body"], F.lit(""))
    targets = F.filter("children", lambda c: (c["g"] == F.col("g")) & (c["tag"] == "위임법령조문정보"))
    edges = groups.select("source_mst", "source_art_no", "source_branch_no", "mutatis", *(_child(last(t), t).alias(a) for t, a in (("위임구분", "kind"), ("위임법령일련번호", "target_law_mst"), ("위임법령제목", "target_law_title"))), F.explode(targets).alias("t"))
    kind = F.when(F.col("kind").isin("시행령", "시행규칙"), "DELEGATES").when(F.col("kind") == "인용법령", F.when(F.col("mutatis"), "MUTATIS").otherwise("REFERS_TO"))
    target = F.col("t.body")
    return edges.select(
        "source_mst", "source_art_no", "source_branch_no", _child(target, "조항호목").alias("source_johang"), kind.alias("edge_type"), "target_law_mst", "target_law_title",
        positive_int(_child(target, "위임법령조문번호")).alias("target_art_no"), F.coalesce(positive_int(_child(target, "위임법령조문가지번호")), F.lit(0)).alias("target_branch_no"),
    ).where("edge_type is not null")


def ruling_list(pages: DataFrame, target: str) -> DataFrame:
    """ruling_id, source, case_no, title, decided_at of listing pages of one target."""
    tag, id_, case, title, day = RULING_LISTS[target]
    fields = [f for f in (id_, case, title, day, "법원명") if f]
    rows = pages.select(F.explode(F.from_xml("xml", f"`{tag}` array<struct<{', '.join(f'`{f}`: string' for f in fields)}>>")[tag]).alias("r"))
    r = lambda f: _text(F.col(f"r.`{f}`")) if f else F.lit("")
    source = F.coalesce(F.nullif(r("법원명"), F.lit("")), F.lit(SOURCES[target])) if target == "prec" else F.lit(SOURCES[target])
    return rows.select(r(id_).alias("ruling_id"), source.alias("source"), r(case).alias("case_no"), r(title).alias("title"), r(day).alias("decided_at"))


def ruling_details(documents: DataFrame, target: str) -> DataFrame:
    """ruling_id, source, case_no, decided_at, title, gist, body, ref_articles, ref_cases, raw_uri of detail documents."""
    if target == "admrul":
        info = ("행정규칙일련번호", "행정규칙명", "발령일자")
        schema = f"`행정규칙기본정보` struct<{', '.join(f'`{f}`: string' for f in info)}>, `조문내용` array<string>"
        d = documents.withColumn("d", F.from_xml("xml", schema))
        number, name, day = (_text(F.col(f"d.`행정규칙기본정보`.`{f}`")) for f in info)
        body = F.array_join(F.transform(F.coalesce(F.col("d.`조문내용`"), F.array().cast("array<string>")), lambda t: _text(t)), "\n")
        none = F.array().cast("array<string>")
        return d.select(number.alias("ruling_id"), F.lit(SOURCES[target]).alias("source"), F.lit("").alias("case_no"), day.alias("decided_at"), name.alias("title"), name.alias("gist"), body.alias("body"), none.alias("ref_articles"), none.alias("ref_cases"), "raw_uri")
    id_, case, day, title, gist, parts, refers = RULING_DETAILS[target]
    fields = [id_, case, day, title, gist, *parts, "참조조문", "참조판례", "법원명"]
    d = documents.withColumn("d", F.from_xml("xml", ", ".join(f"`{f}` string" for f in fields)))
    f = lambda name: _text(F.col(f"d.`{name}`"))
    source = F.coalesce(F.nullif(f("법원명"), F.lit("")), F.lit(SOURCES[target])) if target == "prec" else F.lit(SOURCES[target])
    body = F.array_join(F.filter(F.array(*map(f, parts)), lambda p: p != ""), "\n")
    refs = lambda name: references(f(name)) if refers else F.array().cast("array<string>")
    return d.select(f(id_).alias("ruling_id"), source.alias("source"), f(case).alias("case_no"), f(day).alias("decided_at"), f(title).alias("title"), f(gist).alias("gist"), body.alias("body"), refs("참조조문").alias("ref_articles"), refs("참조판례").alias("ref_cases"), "raw_uri")


def ruling_lists(pages: DataFrame) -> DataFrame:
    """The rows of listing pages (target, xml) of all targets."""
    return reduce(DataFrame.union, [ruling_list(pages.where(F.col("target") == t), t) for t in RULING_LISTS])


def all_ruling_details(documents: DataFrame) -> DataFrame:
    """Detail documents (target, key, raw_uri, xml) of all targets."""
    return reduce(DataFrame.union, [ruling_details(documents.where(F.col("target") == t), t) for t in RULING_LISTS])
