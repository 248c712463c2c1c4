import pytest
from pyspark.sql import functions as F

from docloom.functions import amounts
from docloom.operators import repairs, structured
from docloom.operators.structured import Plan, Requirement

BASE = dict.fromkeys(amounts.FIELDS, "") | {"benefit_type": "할인", "action": "할인"}


def facts(spark, *rows):
    df = spark.createDataFrame([{"document_id": d, "fact": i} | BASE | f for i, (d, f) in enumerate(rows)])
    lit = lambda f: amounts.literals(F.concat(F.col(f), F.when(F.col(f) != "", F.col("unit")).otherwise("")) if f == "value" else F.col(f)).alias(f"{f}_literals")
    return df.select("*", lit("value"), lit("condition"), lit("cap")).cache()


@pytest.fixture(scope="module")
def some(spark):
    return facts(
        spark,
        ("fixture/both", {"target": "커피", "value": "10", "unit": "%", "cap": "월 1만원", "frequency": "월 2회"}),
        ("fixture/both", {"target": "넷플릭스", "value": "20", "unit": "%"}),
        ("fixture/coffee", {"target": "스타벅스", "value": "10", "unit": "%", "exceptions": "카페 제외"}),
        ("fixture/coffee", {"target": "커피빈", "value": "최대 30", "unit": "%"}),
        ("fixture/netflix", {"target": "넷플릭스", "value": "20", "unit": "%", "condition": "전월 실적 30만원 이상"}),
        ("fixture/netflix", {"target": "커피(온라인 제외)", "value": "5", "unit": "%", "action": "적립", "benefit_type": "적립"}),
    )


def chosen(some, *groups, scope=None):
    return {r["document_id"] for r in structured.select_documents(some, Plan(tuple(groups)), scope=scope).collect()}


COFFEE = Requirement(("커피",), "discount", min_percent=10)
NETFLIX = Requirement(("넷플릭스",), "discount", min_percent=15)


def test_and_is_an_intersection(some):
    assert chosen(some, (COFFEE,)) == {"fixture/both"}
    assert chosen(some, (NETFLIX,)) == {"fixture/both", "fixture/netflix"}
    assert chosen(some, (COFFEE, NETFLIX)) == chosen(some, (COFFEE,)) & chosen(some, (NETFLIX,))
    assert chosen(some, (COFFEE,), (NETFLIX,)) == {"fixture/both", "fixture/netflix"}


def test_empty_and_wrong_plans(some):
    assert chosen(some) == set()
    assert structured.select_documents(some, Plan(((COFFEE,),), ("colour",))).count() == 0
    with pytest.raises(ValueError, match="requirement"):
        Plan(((),))
    with pytest.raises(ValueError, match="target"):
        Requirement((" ",))
    with pytest.raises(ValueError, match="negative"):
        Requirement(("x",), min_percent=-1)
    assert Plan(((Requirement(("x",), max_spend_krw=1),),), ("y",)).not_narrowing() == "numeric_guard"
    assert Plan(((COFFEE,),), ("y",)).not_narrowing() == "unsupported_conditions"
    assert Plan(()).not_narrowing() == "empty_conditions" and Plan(((COFFEE,),)).not_narrowing() is None


def test_other_conditions(some, spark):
    assert chosen(some, (Requirement(("커피",), min_frequency=2, frequency_period="month"),)) == {"fixture/both"}
    assert chosen(some, (Requirement(("커피",), min_cap_krw=10_000, cap_period="month"),)) == {"fixture/both"}
    assert chosen(some, (Requirement(("커피",), min_cap_krw=10_000, cap_period="day"),)) == set()
    assert chosen(some, (Requirement(("넷플릭스",), max_spend_krw=300_000),)) == {"fixture/netflix"}
    assert chosen(some, (Requirement(("커피",), "earn"),)) == {"fixture/netflix"}
    assert chosen(some, (Requirement(("커피",), exclude_targets=("커피빈",)),), scope=spark.createDataFrame([("fixture/both",)], "document_id string")) == {"fixture/both"}


def test_typed_columns(spark):
    df = structured.derived(
        facts(
            spark,
            ("a", {"value": "10~20", "unit": "%", "cap": "이용금액 10만원", "action": "할인 제외", "condition": "전월 실적 30만원 이상 50만원 이상"}),
            ("b", {"value": "1만", "unit": "원", "cap": "월 최대 1.5만원", "action": "포인트 적립 할인", "condition": "30만원 이상 전월 실적"}),
            ("c", {"cap": "하루 5천원", "action": "안내", "benefit_type": "", "condition": "전월 이용금액 20만원 이하"}),
        )
    )
    rows = {r["document_id"]: r for r in df.collect()}
    state = lambda d, c: (rows[d][c]["value"], rows[d][c]["state"])
    assert state("a", "percent") == (None, "unknown") and state("c", "percent") == (None, "not_applicable")
    assert state("a", "cap_amount") == (None, "unknown") and state("b", "cap_amount") == (15_000, "known") and state("c", "cap_amount") == (5000, "known")
    assert state("b", "cap_period") == ("month", "known") and state("c", "cap_period") == ("day", "known")
    assert state("a", "action_kind") == ("discount", "false") and state("b", "action_kind") == (None, "unknown") and state("c", "action_kind") == (None, "unknown")
    assert state("a", "spend") == (None, "unknown") and state("b", "spend") == (300_000, "known") and state("c", "spend") == (None, "unknown")
    assert rows["c"]["spend"]["operator"] == "lte"


def test_targets(spark):
    df = spark.createDataFrame([("전기차",), ("기차",), ("전기차,수소차충전소",), ("주유(커피 제외)",)], "t string").withColumn("n", structured.named_text(F.col("t")))
    train = [r["x"] for r in df.select(structured.mentions(F.col("n"), "기차").alias("x")).collect()]
    assert train == [False, True, False, False]
    assert [r["x"] for r in df.select(structured.mentions(F.col("n"), "전기차충전소").alias("x")).collect()] == [False, False, True, False]
    assert not any(r["x"] for r in df.select(structured.mentions(F.col("n"), "커피").alias("x")).collect())
    assert structured.expanded(("커피",)) == sorted(structured.ALIASES["커피"])


def test_fallback_and_scope(spark):
    base = spark.createDataFrame([("g", 1), ("g", 2), ("h", 3)], "g string, k int")
    got = structured.with_fallback(base.where("k = 2"), base, "g").collect()
    assert {tuple(r) for r in got} == {("g", 2), ("h", 3)}
    names = spark.createDataFrame([(1, "Blue Card"), (2, "Blue Card Plus"), (3, "Same Name"), (4, "Same Name")], "key int, name string")
    asked = spark.createDataFrame([(10, "is the blue card plus good?"), (11, "blue card or blue card plus"), (12, "same name"), (13, "none")], "query int, text string")
    got = {tuple(r) for r in structured.explicit_scope(asked, names).collect()}
    assert got == {(10, 2), (11, 1), (11, 2)}


def test_few_runs_of_a_question_become_rows(spark):
    """A row of each place of a text would be 2,000 here; all starts of names are among those made, long and short ones and beyond the first plane."""
    text = "".join(chr(97 + i * i % 23) for i in range(1000)) + "bluecardplus\U0001f600\U0001f601\U0001f602xgold"
    asked = spark.createDataFrame([(1, text), (2, ""), (3, "abc")], "query int, text string")
    starts = spark.createDataFrame([("bluecard",), ("gold",), ("\U0001f600\U0001f601\U0001f602x",), ("none",)], "start string")
    got = [tuple(r) for r in structured._begun(asked, starts, (4, 8)).collect()]
    assert {(1, "bluecard"), (1, "gold"), (1, "\U0001f600\U0001f601\U0001f602x")} <= set(got) and len(got) == len(set(got)) < 20
    assert not structured._begun(asked, starts.where("false"), (4, 8)).count()


def test_repairs(spark):
    evidence = lambda *fields: {f: [("P0001-L0001", "리터당 10포인트")] for f in fields}
    scope = ("bounded_block", ["P0001-L0001"], [])
    rows = [
        ("none", {"condition": "전월 실적 조건 없음"}, {}, scope),
        ("voucher", {"benefit_type": "바우처 할인", "action": "교환"}, {}, scope),
        ("ceiling", {"benefit_type": "이용금액 한도", "cap": "월 10만원"}, {}, scope),
        ("litre", {"target": "주유", "action": "적립", "unit": "포인트", "cap": "1회 10만원 한도", "value": "10", "condition": "리터당"}, evidence("target", "action", "value", "unit", "condition", "cap"), scope),
        ("compound", {"condition": "전월 실적 조건 및 할인한도 없음", "target": "커피"}, evidence("target", "action", "condition"), scope),
        ("free", {"action": "무료 이용", "benefit_type": "라운지", "target": "라운지"}, evidence("target", "action", "benefit_type"), scope),
        ("unbound", {"action": "무료 이용", "benefit_type": "라운지", "target": "라운지"}, {}, scope),
    ]
    df = structured.derived(facts(spark, *((d, f) for d, f, _, _ in rows)))
    extra = spark.createDataFrame([(d, e, s) for d, _, e, s in rows], "document_id string, field_evidence map<string,array<struct<line_id:string,fragment:string>>>, relation_scope struct<scope_type:string,line_ids:array<string>,row_line_ids:array<string>>")
    got = {r["document_id"]: r for r in repairs.repaired(df.join(extra, "document_id")).collect()}
    assert {d: r["rules"] for d, r in got.items()} == {
        "none": ["explicit_no_previous_month_requirement"],
        "voucher": ["exchange_voucher_is_not_accrual"],
        "ceiling": ["eligible_use_amount_is_not_payout_cap"],
        "litre": ["non_krw_accrual_transaction_ceiling"],
        "compound": ["explicit_compound_no_spend"],
        "free": ["explicit_free_use_positive"],
        "unbound": [],
    }
    assert got["none"]["spend"]["value"] == 0 and got["ceiling"]["cap_amount"]["state"] == "unknown" and got["free"]["action_kind"]["state"] == "true"


def test_a_litre_told_by_the_source_alone(spark):
    """The line that says 'a litre' must lie in the scope, near the cap, and carry one of the benefit's fields."""
    fact = {"target": "주유", "action": "적립", "unit": "포인트", "cap": "1회 10만원 한도", "value": "10", "condition": "주유 시"}
    line = lambda n: f"P0001-L{n:04d}"
    ev = lambda cap, rest: {"cap": [(line(cap), "x")]} | {f: [(line(rest), "x")] for f in ("target", "action", "value", "unit", "condition")}
    all_lines = [line(i) for i in range(1, 9)]
    rows = [
        ("told", ev(2, 1), all_lines, {line(1): "리터 당 10포인트"}),
        ("silent", ev(2, 1), all_lines, {line(1): "10포인트"}),
        ("outside", ev(2, 1), [line(1), line(2)], {line(1): "리터당", line(3): "리터당"}),
        ("far", ev(6, 1), all_lines, {line(1): "리터당"}),
        ("elsewhere", ev(2, 1), all_lines, {line(3): "리터당"}),
    ]
    df = structured.derived(facts(spark, *((d, fact) for d, *_ in rows)))
    extra = spark.createDataFrame([(d, e, ("bounded_block", ids, []), s) for d, e, ids, s in rows], "document_id string, field_evidence map<string,array<struct<line_id:string,fragment:string>>>, relation_scope struct<scope_type:string,line_ids:array<string>,row_line_ids:array<string>>, source_lines map<string,string>")
    got = {r["document_id"]: r["rules"] for r in repairs.repaired(df.join(extra, "document_id")).collect()}
    assert got == {"told": ["non_krw_accrual_transaction_ceiling"], "silent": [], "outside": [], "far": [], "elsewhere": []}


def test_registered_names_are_joined_exactly(spark):
    names = [("a", ["x", "y", "x"]), ("b", []), ("c", None), ("d", ["x", "none"]), ("e", ["twice"]), ("f", ["keyless"]), ("g", ["x", "same"]), ("h", ["x", None])]
    catalogue = [("x", "k/x"), ("y", "k/y"), ("twice", "k/1"), ("twice", "k/2"), ("keyless", None), ("same", "k/x")]
    got = {r["owner"]: (r["status"], r["keys"]) for r in structured.registered(spark.createDataFrame(names, "owner string, names array<string>"), spark.createDataFrame(catalogue, "name string, key string")).collect()}
    review = ("needs_review", [])
    assert got == {"a": ("ready", ["k/x", "k/y"]), "b": ("empty", []), "c": review, "d": review, "e": review, "f": review, "g": review, "h": review}
    assert structured.registered(spark.createDataFrame([("a", ["x", "y"])], "owner string, names array<string>"), spark.createDataFrame(catalogue, "name string, key string"), most=1).first()["status"] == "needs_review"


def test_selected_references_are_one_group_and_unique(spark):
    refs = [(q, i, r, k) for q in range(8) for i, (r, k) in enumerate([("1r1", "a"), ("1r2", "b"), ("2r1", "c"), ("1r3", "a")])]
    choices = [(0, ["1r2", "1r1"], ""), (1, [], None), (2, ["1r1", "1r1"], ""), (3, ["1r9"], ""), (4, ["1r1", "2r1"], ""), (5, ["1r1", "1r3"], ""), (6, ["1r1"], " which? "), (7, None, "")]
    got = {r["query"]: r["keys"] for r in structured.selected_scope(spark.createDataFrame(choices, "query int, selected array<string>, clarification string"), spark.createDataFrame(refs, "query int, position int, ref string, key string")).collect()}
    assert got == {0: ["a", "b"], **dict.fromkeys(range(1, 8))}
