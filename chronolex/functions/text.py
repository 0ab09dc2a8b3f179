"""Text and date functions as Column expressions; all patterns are Unicode-aware, with `.` stopping at line feeds only."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .names import first_citation, name_list

UNICODE = "(?Ud)"

# Vocabulary of the corpus.
ABBREVIATIONS = {"조특법": "조세특례제한법", "국기법": "국세기본법"}
OPERATORS = {"이상": ">=", "초과": ">", "이하": "<=", "미만": "<"}
ANTI_AVOIDANCE = ("실질과세", "부당행위계산부인", "단계거래")
CONSTITUTIONAL = (("헌법불합치", "헌법불합치"), ("한정위헌", "한정위헌"), ("한정합헌", "한정합헌"), ("각하", "각하"), ("위반된다", "위헌"), ("위헌", "위헌"))
WON, LOST = "납세자승", "납세자패"
REMAND = r"파기.{0,80}?환송"
DISMISSED = r"(?:상고|항소)를?\s*(?:모두\s*)?기각"
DISMISSED_PARTY = r"(원고|피고)(?:들)?의?.{0,10}?(?:상고|항소)(?:를|는)?.{0,15}?기각"
COSTS_PAYER = r"(?:상고|항소)비용은\s*(원고|피고)(?:들)?(?:이|가)\s*부담"
PLAINTIFF_RIGHT = r"원고(?:들)?의?\s*(?:상고이유|항소이유)?\s*주장은\s*이유\s*있다"
DEFENDANT_RIGHT = r"피고(?:들)?의?\s*(?:상고이유|항소이유)?\s*주장은\s*이유\s*있다"
CLAIM_GRANTED = r"(원고|납세자|청구인)(?:들)?.{0,10}?청구(?:를|는)?.{0,10}?(인용|받아들|이유\s*있)"
CLAIM_DISMISSED = r"(원고|납세자|청구인)(?:들)?.{0,10}?청구(?:를|는)?.{0,10}?(기각|이유\s*없)"
COMPARE = "(이상|초과|이하|미만)"
#: kind, unit where fixed, pattern, and the groups of value, unit and operator.
THRESHOLDS = (
    ("ratio", "%", rf"100분의\s*(\d+(?:\.\d+)?)\s*{COMPARE}?", 1, None, 2),
    ("ratio", "%", rf"(\d+(?:\.\d+)?)\s*(?:퍼센트|%)\s*{COMPARE}?", 1, None, 2),
    ("amount", None, rf"(\d[\d,]*(?:\.\d+)?)\s*(억원|만원|천원|원)\s*{COMPARE}", 1, 2, 3),
    ("period", None, rf"(\d+)\s*(년|개월|일)\s*{COMPARE}", 1, 2, 3),
    ("headcount", None, rf"(\d+)\s*(명|인)\s*{COMPARE}", 1, 2, 3),
)
DEFINITIONS = (r'["“]([^"”]{1,30})["”]\s*(?:\([^)]*\))?\s*(?:란|이란)', r'이하\s*["“]([^"”]{1,30})["”]\s*(?:라|이라)\s*한다')


def has(text: Column, pattern: str) -> Column:
    return text.rlike(UNICODE + pattern)


def found(text: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match; null if there is none or it took no part."""
    return F.nullif(F.regexp_extract(text, UNICODE + pattern, group), F.lit(""))


def found_all(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(UNICODE + pattern), F.lit(group))


def stripped(text: Column) -> Column:
    """Unicode white space off both ends; null becomes empty."""
    return F.coalesce(F.regexp_replace(text, UNICODE + r"^\s+|\s+\z", ""), F.lit(""))


def clause_number(text: Column) -> Column:
    s = stripped(text)
    code = F.ascii(F.substring(s, 1, 1))
    return F.when((s != "") & code.between(9312, 9331), (code - 9311).cast("string")).otherwise(F.btrim(s, F.lit(".()")))


def sub_number(text: Column) -> Column:
    return F.rtrim(stripped(text), F.lit("."))


def references(text: Column) -> Column:
    """Fragments between commas and line ends, in order, without the empty ones."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "[,，\n]"), stripped), lambda x: x != "")


def heading(text: Column) -> Column:
    return stripped(F.regexp_replace(F.coalesce(text, F.lit("")), UNICODE + r"\s*<개정[^>]*>\s*\z", ""))


def promulgation_number(text: Column) -> Column:
    digits = F.ltrim(stripped(text), F.lit("0"))
    return F.when(digits.rlike(r"^[0-9]+\z"), digits.try_cast("int"))


def positive_int(text: Column) -> Column:
    number = F.when(stripped(text).rlike(r"^[0-9]+\z"), stripped(text).try_cast("int"))
    return F.when(number > 0, number)


def strict_date(text: Column) -> Column:
    """YYYYMMDD; anything else is an error."""
    return F.to_date(stripped(text), "yyyyMMdd")


def lenient_date(text: Column) -> Column:
    """YYYYMMDD; anything else, impossible days too, is null."""
    s = stripped(text)
    return F.when(s.rlike(r"^[0-9]{8}\z"), F.try_to_date(s, "yyyyMMdd"))


def listed_date(text: Column) -> Column:
    """YYYYMMDD or YYYY.MM.DD."""
    return lenient_date(F.regexp_replace(text, "[. ]", ""))


def _date_of(text: Column, pattern: str) -> Column:
    y, m, d = (found(text, pattern, g) for g in (1, 2, 3))
    return F.try_to_date(F.concat(y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), "yyyyMMdd")


def korean_date(text: Column) -> Column:
    return _date_of(text, r"(\d{4})년\s*(\d{1,2})월\s*(\d{1,2})일")


def dotted_date(text: Column) -> Column:
    return _date_of(text, r"(\d{4})\.\s*(\d{1,2})\.\s*(\d{1,2})\.")


def lookback(today, years: int) -> Column:
    """So many times 365 days before today."""
    return F.date_sub(F.lit(today).cast("date"), 365 * years)


def citation(text: Column, names: list[str] | DataFrame, article: str = r"제(\d+)조(?:의(\d+))?", abbreviations: dict[str, str] = ABBREVIATIONS) -> Column:
    """The first citation as struct(law, art_no, branch_no, historical_date), null without one or without names. names: a list, or a
    table whose first column they are."""
    known = name_list(names)
    if not known:
        return F.lit(None).cast("struct<law: string, art_no: int, branch_no: int, historical_date: date>")
    full = F.create_map(*(F.lit(x) for pair in abbreviations.items() for x in pair)) if abbreviations else None

    def cut(match: Column) -> Column:
        law = F.coalesce(F.try_element_at(full, match["law"]), match["law"]) if full is not None else match["law"]
        branch = F.coalesce(match["branch_no"].cast("int"), F.lit(0))
        return F.when(match["law"].isNotNull(), F.struct(law.alias("law"), match["art_no"].cast("int").alias("art_no"), branch.alias("branch_no"), dotted_date(match["detail"]).alias("historical_date")))

    return F.get(F.transform(F.array(first_citation(text, known, article)), cut), 0)


def definitions(text: Column, patterns: tuple[str, ...] = DEFINITIONS) -> Column:
    """Defined terms, those of the first pattern first, each once."""
    return F.array_distinct(F.filter(F.transform(F.concat(*(found_all(text, p) for p in patterns)), stripped), lambda t: t != ""))


def thresholds(text: Column, patterns=THRESHOLDS, operators: dict[str, str] = OPERATORS) -> Column:
    """array<struct(kind, op, value, unit)> by pattern and place; commas leave numbers, amounts aren't scaled."""
    lists = []
    for kind, unit, pattern, value_group, unit_group, op_group in patterns:
        values, ops = found_all(text, pattern, value_group), found_all(text, pattern, op_group)
        units = found_all(text, pattern, unit_group) if unit_group else F.array_repeat(F.lit(unit), F.size(values))
        lists.append(F.transform(F.arrays_zip(values.alias("v"), ops.alias("o"), units.alias("u")), _threshold(kind, operators)))
    return F.concat(*lists)


def _threshold(kind: str, operators: dict[str, str]):
    def one(z: Column) -> Column:
        op = F.coalesce(*(F.when(z["o"] == k, F.lit(v)) for k, v in operators.items()), F.lit("=="))
        return F.struct(F.lit(kind).alias("kind"), op.alias("op"), F.regexp_replace(z["v"], ",", "").cast("double").alias("value"), z["u"].alias("unit"))

    return one


def keyword_flags(text: Column, keywords: tuple[str, ...] = ANTI_AVOIDANCE) -> Column:
    return F.filter(F.array(*map(F.lit, keywords)), lambda k: F.contains(text, k))


def court_outcome(text: Column) -> Column:
    """Who won: null where a part was sent back and a part dismissed, or nothing tells."""
    remand, dismissed = has(text, REMAND), has(text, DISMISSED)
    party, payer = found(text, DISMISSED_PARTY), found(text, COSTS_PAYER)
    by = lambda who: F.when(who == "원고", LOST).otherwise(WON)
    return (
        F.when(remand & (party.isNotNull() | dismissed), F.lit(None).cast("string"))
        .when(party.isNotNull(), by(party))
        .when(dismissed, F.when(payer.isNotNull(), by(payer)))
        .when(remand, F.when(has(text, DEFENDANT_RIGHT), LOST).when(has(text, PLAINTIFF_RIGHT), WON))
        .when(has(text, CLAIM_GRANTED), WON)
        .when(has(text, CLAIM_DISMISSED), LOST)
    )


def constitutional_outcome(body: Column) -> Column:
    order = F.coalesce(found(body, r"(?s)\[주\s*문\]\s*(.+?)(?:\[이\s*유\]|\z)"), body)
    chain = F.when(F.contains(order, F.lit("위반되지 아니한다")) | F.contains(order, F.lit("위반된다고 할 수 없다")), "합헌")
    for keyword, outcome in CONSTITUTIONAL:
        chain = chain.when(F.contains(order, F.lit(keyword)), outcome)
    return chain


def addendum_items(body: Column) -> Column:
    """array<struct(clause_no, label, text)>: at circled numbers, whatever precedes the first is dropped; else one item."""
    marks, chunks = (found_all(body, r"(?s)([①-⑳])([^①-⑳]*)", g) for g in (1, 2))
    label = r"^\(([^)]+)\)\s*"

    def item(z: Column) -> Column:
        chunk = stripped(z["c"])
        return F.struct((F.ascii(z["m"]) - 9311).cast("string").alias("clause_no"), F.coalesce(found(chunk, label), F.lit("")).alias("label"), stripped(F.regexp_replace(chunk, UNICODE + label, "")).alias("text"))

    whole = F.struct(F.lit("1").alias("clause_no"), F.lit("").alias("label"), stripped(body).alias("text"))
    split = F.transform(F.arrays_zip(marks.alias("m"), chunks.alias("c")), item)
    return F.when(F.size(marks) > 0, split).when(stripped(body) != "", F.array(whole)).otherwise(F.filter(F.array(whole), lambda x: F.lit(False)))


def addendum_kind(label: Column) -> Column:
    """Kind by label; null for "as before", which the caller carries forward."""
    return F.when(label == "동전", F.lit(None).cast("string")).when(label == "시행일", "시행일").when(F.contains(label, F.lit("적용례")), "적용례").when(F.contains(label, F.lit("경과조치")), "경과조치").otherwise("특례")


def trigrams(text: Column) -> Column:
    """Distinct trigrams of the lower-case alphanumeric words, two blanks before and one after each."""
    words = F.transform(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))), lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.array_distinct(F.flatten(F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, F.lit(3))))))


def script_statements(script: str) -> list[str]:
    """Statements of a script: comment lines dropped, split at semicolons."""
    kept = [line for line in script.splitlines() if not line.strip().startswith(("--", "//"))]
    return [s.strip() for s in re.split(";", "\n".join(kept)) if s.strip()]
