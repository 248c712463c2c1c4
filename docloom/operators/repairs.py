"""Repairs of typed columns: explicit statements that the base rules leave unknown, and amounts that are no payout cap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.operators.lines import evidence_near

#: Wordings of the repairs, on text without blanks unless told.
NO_SPEND_RAW = r"^\s*전월\s*(?:이용\s*금액|실적)\s*조건\s*없음\s*$"
NO_SPEND = r"전월(?:이용금액|실적)조건(?:및할인한도)?(?:없음|제한없이)"
SPEND_TOLD = r"전월(?:이용금액|실적)[^\d]{0,12}\d[\d,.]*(?:만|천)?원이상"
TEMPORARY = "신규발급|발급월|등록월|다음달말"
FREE = "무료이용|무료입장"
NOT_FREE = "무료이용불가|무료입장불가|제공하지않|제공되지않|유료"
OTHER_FREE = "바우처|무료교환|무료가입|무료숙박권"
GENERIC_ACTIONS = ("제공", "제공됩니다", "제공되며", "이용", "입장", "서비스이용", "무료이용서비스제공")
SPEND_TIER = r"^전월(?:이용금액|실적)\d[\d,.]*(?:천|만)?원이상에해당하는할인한도$"
RECOGNISED = r"(?:캐시백|할인|적립)대상(?:으로)?인정"
MONTHLY_SUM = r"^합산최대월\d[\d,.]*(?:천|만)?원까지$"
TRANSACTION_CEILING = r"(?:회당|1회)(?:이용|주유|결제)금액\d[\d,.]*(?:천|만)?원한도"
ONE_TIME_LIMIT = r"^1회\d[\d,.]*(?:천|만)?원한도$"


def dense(column: Column) -> Column:
    return F.lower(F.regexp_replace(F.coalesce(column, F.lit("")), r"(?U)\s+", ""))


def line_ids(field: str) -> Column:
    """Line ids of a field's evidence: field_evidence is map<string, array<struct<line_id, fragment>>>."""
    return F.array_distinct(F.transform(F.coalesce(F.col("field_evidence")[field], F.array().cast("array<struct<line_id:string,fragment:string>>")), lambda e: e["line_id"]))


def bounded(fields: list[str]) -> Column:
    """Every field has evidence, all of it in the one bounded scope of the fact."""
    scope = F.concat(F.coalesce("relation_scope.line_ids", F.array().cast("array<string>")), F.coalesce("relation_scope.row_line_ids", F.array().cast("array<string>")))
    told = F.col("relation_scope.scope_type").isin("bounded_block", "table_row")
    for f in fields:
        told &= (F.size(line_ids(f)) > 0) & (F.size(F.array_except(line_ids(f), scope)) == 0)
    return F.coalesce(told, F.lit(False))


def per_unit_ceiling(source: Column | None = None) -> Column:
    """Points a litre under a limit a visit: the limit is on what is bought.

    ``source``: map of line id to the source's text, or none. Lines that say 'a litre', by their text or by what a field took from
    them, and the lines of cap, value and condition all lie in the scope's lines; a benefit's field stands on one of the
    first; the cap is within two lines of each.
    """
    c = F.col
    context = F.concat(dense(c("target")), dense(c("benefit_type")), dense(c("condition")))
    worded = dense(c("action")).contains("적립") & dense(c("unit")).rlike("포인트|마일리지") & dense(c("cap")).rlike(ONE_TIME_LIMIT) & context.rlike("주유|리터")
    fields = ("target", "action", "value", "unit", "condition")
    none = F.array().cast("array<struct<line_id:string,fragment:string>>")
    litre = F.flatten(F.array(*[F.transform(F.filter(F.coalesce(c("field_evidence")[f], none), lambda e: dense(e["fragment"]).contains("리터당")), lambda e: e["line_id"]) for f in fields]))
    if source is not None:
        litre = F.concat(litre, F.coalesce(F.map_keys(F.map_filter(source, lambda k, v: dense(v).contains("리터당"))), F.array().cast("array<string>")))
    scope = F.coalesce("relation_scope.line_ids", F.array().cast("array<string>"))
    needed = [line_ids(f) for f in ("cap", "value", "condition")]
    placed = F.size(litre) > 0
    for ids in (*needed, litre):
        placed &= (F.size(ids) > 0) & (F.size(F.array_except(ids, scope)) == 0)
    placed &= F.arrays_overlap(litre, F.flatten(F.array(*map(line_ids, fields))))
    near = evidence_near(needed[0], needed[1]) & evidence_near(needed[0], needed[2]) & evidence_near(needed[0], litre)
    return F.coalesce(worded & (c("relation_scope.scope_type") == "bounded_block") & placed & near, F.lit(False))


def cap_rule(source: Column | None = None) -> Column:
    """The first rule by which a cap's amount is no payout cap, or null."""
    c = F.col
    cap, benefit, action, target = (dense(c(x)) for x in ("cap", "benefit_type", "action", "target"))
    return (
        F.when(cap.rlike(SPEND_TIER), "previous_spend_tier_is_not_payout_cap")
        .when(benefit.contains("이용금액한도"), "eligible_use_amount_is_not_payout_cap")
        .when(cap.rlike(RECOGNISED), "recognized_purchase_amount_is_not_payout_cap")
        .when(target.contains("이용금액") & (benefit.contains("적립대상") | action.contains("적립대상")) & cap.rlike(MONTHLY_SUM), "recognized_purchase_amount_is_not_payout_cap")
        .when(cap.rlike(TRANSACTION_CEILING), "per_transaction_spend_is_not_payout_cap")
        .when(per_unit_ceiling(source), "non_krw_accrual_transaction_ceiling")
    )


def repaired(facts: DataFrame) -> DataFrame:
    """Derived facts (with field_evidence, relation_scope, and perhaps source_lines, a map of line id to text) after both stages of repairs, and ``rules``: what was applied."""
    c = F.col
    action, benefit, value, target, condition = (dense(c(x)) for x in ("action", "benefit_type", "value", "target", "condition"))
    stated = F.coalesce("condition", F.lit("")).rlike(NO_SPEND_RAW)
    voucher = benefit.contains("바우처") & action.rlike("교환|전환") & ~F.concat(action, benefit).rlike("적립|캐시백") & (c("action_kind.value").isNotNull() | (c("action_kind.state") != "unknown"))
    rule = F.when(c("cap_amount.state") == "known", cap_rule(c("source_lines") if "source_lines" in facts.columns else None))
    first = facts.withColumns({"_stated": stated, "_voucher": voucher, "_cap_rule": rule})
    zero = F.struct(F.lit(0).cast("long").alias("value"), F.lit("gte").alias("operator"), F.lit("known").alias("state"))
    unknown = F.lit("unknown").alias("state")
    first = first.withColumns(
        {
            "spend": F.when(c("_stated"), zero).otherwise(c("spend")),
            "action_kind": F.when(c("_voucher"), F.struct(F.lit(None).cast("string").alias("value"), unknown)).otherwise(c("action_kind")),
            "cap_amount": F.when(c("_cap_rule").isNotNull(), F.struct(F.lit(None).cast("long").alias("value"), unknown)).otherwise(c("cap_amount")),
            "cap_period": F.when(c("_cap_rule").isNotNull(), F.struct(F.lit(None).cast("string").alias("value"), unknown)).otherwise(c("cap_period")),
        }
    )
    compound = (c("spend.state") != "known") & condition.rlike(NO_SPEND) & ~condition.rlike(SPEND_TOLD) & ~condition.contains("추가혜택") & ~condition.rlike(TEMPORARY) & bounded(["target", "action", "condition"])
    worded = action.rlike(FREE) | (action.isin(*GENERIC_ACTIONS) & (benefit.contains("무료이용") | value.contains("무료이용")))
    clean = ~F.concat(action, benefit, value).rlike(NOT_FREE) & ~F.concat(action, benefit, value, target).rlike(OTHER_FREE)
    placed = bounded(["target", "action"]) & ((benefit == "") | bounded(["benefit_type"])) & ((value == "") | bounded(["value"]))
    free = (c("action_kind.state") == "unknown") & worded & clean & placed
    second = first.withColumns({"_compound": compound, "_free": free})
    rules = F.array_compact(F.array(F.when(c("_stated"), "explicit_no_previous_month_requirement"), F.when(c("_voucher"), "exchange_voucher_is_not_accrual"), c("_cap_rule"), F.when(c("_compound"), "explicit_compound_no_spend"), F.when(c("_free"), "explicit_free_use_positive")))
    out = second.withColumns(
        {
            "rules": rules,
            "spend": F.when(c("_compound"), zero).otherwise(c("spend")),
            "action_kind": F.when(c("_free"), F.struct(F.lit(None).cast("string").alias("value"), F.lit("true").alias("state"))).otherwise(c("action_kind")),
        }
    )
    return out.drop("_stated", "_voucher", "_cap_rule", "_compound", "_free")
