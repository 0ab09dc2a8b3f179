from datetime import date

import pytest
from pyspark.sql import functions as F

from chronolex.functions import text as T
from chronolex.functions.temporal import require_as_of
from chronolex.plans import corpus


@pytest.fixture()
def apply(spark):
    def run(function, *values):
        rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
        return [r[0] for r in rows.orderBy("i").select(function(F.col("v"))).collect()]

    return run


def test_thresholds(apply):
    texts = ["100분의 30 이상", "10퍼센트 미만", "3억원 이하", "2천원", "2년 초과", "2020년", "1,000만원 이상이고 5명 이하", "100분의 50을 초과"]
    found = [[(t.kind, t.op, t.value, t.unit) for t in row] for row in apply(T.thresholds, *texts)]
    assert found == [
        [("ratio", ">=", 30.0, "%")], [("ratio", "<", 10.0, "%")], [("amount", "<=", 3.0, "억원")], [], [("period", ">", 2.0, "년")], [],
        [("amount", ">=", 1000.0, "만원"), ("headcount", "<=", 5.0, "명")], [("ratio", "==", 50.0, "%")],
    ]


def test_numbers_and_dates(apply):
    assert apply(T.clause_number, "①", "⑳", "(3)", "", None) == ["1", "20", "3", "", ""]
    assert apply(T.promulgation_number, "00012", "0", "x", "", " 7 ") == [12, None, None, None, 7]
    assert apply(T.lenient_date, "20200131", "0       ", "20201340", None) == [date(2020, 1, 31), None, None, None]
    assert apply(T.listed_date, "2020.01.31", "20200131") == [date(2020, 1, 31)] * 2
    assert apply(T.korean_date, "이 법은 2020년 1월 5일부터", "없음") == [date(2020, 1, 5), None]
    assert apply(T.stripped, "　 a 　", None) == ["a", ""]
    assert apply(T.references, "가, 나，다\n ,라", None) == [["가", "나", "다", "라"], []]
    assert apply(T.heading, "제1장 총칙 <개정 2020. 1. 1.> ", None) == ["제1장 총칙", ""]


def test_citations(spark, apply):
    names = corpus.GOLDEN_NAMES
    cite = lambda v: T.citation(v, names)
    got = apply(cite, "소득세법 제89조", "법인세법 제18조의3", "조특법 제10조", "구 소득세법(1996. 12. 30. 전부개정되고, 2003. 1. 1. 개정) 제14조", "없는법 제1조", "국세기본법 시행령 제2조", "")
    assert [(g.law, g.art_no, g.branch_no, g.historical_date) if g else None for g in got] == [
        ("소득세법", 89, 0, None), ("법인세법", 18, 3, None), ("조세특례제한법", 10, 0, None), ("소득세법", 14, 0, date(1996, 12, 30)), None, ("국세기본법 시행령", 2, 0, None), None,
    ]
    assert apply(lambda v: T.citation(v, []), "소득세법 제89조") == [None]
    cases = spark.createDataFrame([("소득세법 제89조", ("소득세법", 89, 0)), ("아무것도 없음", None), ("법인세법 제1조", ("법인세법", 2, 0))], "text string, expected struct<law: string, art_no: int, branch_no: int>")
    r = corpus.evaluate_citations(cases).first()
    assert (r.tp, r.fp, r.fn, r.tn, r.precision, r.recall) == (1, 1, 1, 1, 0.5, 0.5)


def test_citations_by_many_names(spark, monkeypatch):
    """As an alternation of all names, longest first, would find them: from a table of 50,000 names too, and in several turns."""
    import random
    import re

    from chronolex.functions import names as N

    r = random.Random(4)
    few = ["소득세법", "소득세법 시행령", "법", "구법", "세법", "국세기본법", "가나", "가나 다"]
    article = r"제(\d+)조(?:의(\d+))?"
    one = re.compile(r"(?:구\s*)?(" + "|".join(re.escape(n) for n in sorted(few, key=lambda n: -len(n))) + r")(?:\s*\(([^)]*)\))?\s*" + article)
    pieces = [*few, "구", " ", "  ", "제1조", "제23조의4", "(2001. 2. 3. 개정)", "(", ")", "x", "소득", "제"]
    texts = ["".join(r.choices(pieces, k=r.randint(1, 9))) for _ in range(1500)]
    wanted = [(m[1], int(m[3]), int(m[4] or 0)) if (m := one.search(t)) else None for t in texts]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, v string")
    table = spark.createDataFrame([(f"없는이름{k}법",) for k in range(50_000)] + [(n,) for n in few] + [(None,), ("",)], "name string")

    def found(names):
        return [(x.c.law, x.c.art_no, x.c.branch_no) if x.c else None for x in rows.select("i", T.citation(F.col("v"), names, abbreviations={}).alias("c")).orderBy("i").collect()]

    assert sum(w is not None for w in wanted) > 200 and found(few) == wanted and found(table) == wanted
    monkeypatch.setattr(N, "NAMES", 3)
    assert found(few) == wanted


def test_definitions_and_addenda(apply):
    assert apply(T.definitions, '"국세"(國稅)란 세금. (이하 "단체"라 한다) "국세"란', None) == [["국세", "단체"], None]
    got = apply(T.addendum_items, "머리 ①(시행일) 가 ②(동전) 나 ③ 다", "본문뿐", " ")
    assert [[tuple(i) for i in g] for g in got] == [[("1", "시행일", "가"), ("2", "동전", "나"), ("3", "", "다")], [("1", "", "본문뿐")], []]


def test_outcomes(apply):
    assert apply(T.court_outcome, "원고의 상고를 기각한다", "피고의 항소는 기각", "파기하고 환송한다. 원고의 상고를 기각", "상고를 모두 기각. 상고비용은 원고가 부담", "청구인의 청구를 받아들인다", "") == [T.LOST, T.WON, None, T.LOST, T.WON, None]
    assert apply(T.constitutional_outcome, "[주 문] 위반되지 아니한다 [이 유] 위헌", "한정위헌", "[주문] 각하", "x") == ["합헌", "한정위헌", "각하", None]
    assert apply(T.keyword_flags, "단계거래와 실질과세") == [["실질과세", "단계거래"]]


def test_guard_and_scripts():
    with pytest.raises(TypeError):
        require_as_of("2020-01-01")
    assert T.script_statements("-- c\nA;\nB ;\n;") == ["A", "B"]
