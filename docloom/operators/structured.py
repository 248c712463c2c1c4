"""Structured filters over facts: typed columns with a state of their own, three-valued predicates, division.

A fact is ten raw strings. Typed columns are derived by rules that say 'unknown' rather than guess, so a
predicate has three outcomes, told by an ordered ladder (not SQL's logic: some unknowns come before
violations). Only 'true' selects. A plan is an OR of groups, a group an AND of requirements that facts of
the same document must meet: one aggregate over the facts answers all groups at once.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce
from operator import and_, or_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions.amounts import FIELDS
from docloom.functions.text import dense_form
from docloom.session import settled

#: Target words that stand for each other.
ALIASES = {
    "여행": ["여행", "항공", "항공사", "호텔", "숙박", "공항", "라운지", "면세점"],
    "커피": ["커피", "카페", "스타벅스", "투썸", "이디야", "폴바셋", "커피빈"],
    "카페": ["커피", "카페", "스타벅스", "투썸", "이디야", "폴바셋", "커피빈"],
}
#: Patterns of the typed columns.
MONEY = r"(\d[\d,]*(?:\.\d+)?)\s*(천|만)?\s*원"
PERCENT = r"(\d+(?:\.\d+)?)\s*%"
RANGE = r"\d\s*(?:~|∼|～|–|—|-)\s*\d"
LIMIT_WORDS = "최대|최소|이상|이하|초과|미만|까지"
SPEND_PHRASE = r"전월\s*(?:이용\s*)?(?:실적|이용금액|이용\s*실적)"
SPEND_PHRASE_REVERSED = r"(?:적실|액금용이|적실\s*용이)\s*(?:용이\s*)?월전"
SPEND_CEILING = r"이용\s*금액|이용액|결제\s*금액|결제액|승인\s*금액|매출\s*(?:금액|액|건당)"
MONTH_WORDS = r"매월|월간|월별|당월|해당월|월한도|월최대|월통합|(?:^|[^가-힣])월\d"
DAY_WORDS = r"하루|일일|1일최대|1일한도|1일1회|(?:^|[^가-힣])일(?:최대|한도|\d)"
RAW_MONTH = r"매월|월간|월별|당월|해당월|(?<![가-힣])월\s*(?:(?:할인|적립|통합)\s*)?(?:한도|최대|\d)"
RAW_DAY = r"하루|매일|일일|1\s*일\s*(?:최대|한도|1회)|(?<![가-힣])일\s*(?:최대|한도|\d)"
DENIED = "제외|제공되지않|적용되지않|불가"
EARN_WORDS = "적립|포인트|마일리지|airmoney|에어머니"
EXCLUDED_ASIDE = r"\([^)]*(?:제외|불가|미제공)[^)]*\)"
#: Characters after and before a spend phrase in which its amount may stand, and after the amount for its bound.
AFTER, BEFORE, BOUND = 45, 30, 8


@dataclass(frozen=True)
class Requirement:
    targets: tuple[str, ...]
    action: str = "any"
    min_percent: float | None = None
    max_spend_krw: int | None = None
    min_cap_krw: int | None = None
    cap_period: str = "any"
    exclude_targets: tuple[str, ...] = ()
    min_frequency: int | None = None
    frequency_period: str = "any"

    def __post_init__(self):
        for name in ("min_percent", "max_spend_krw", "min_cap_krw", "min_frequency"):
            if (value := getattr(self, name)) is not None and not (math.isfinite(value) and value >= 0):
                raise ValueError(f"{name} must be finite and not negative")
        if not any(t.strip() for t in self.targets):
            raise ValueError("a requirement needs a target")
        if self.action not in ("discount", "earn", "any") or {self.cap_period, self.frequency_period} - {"month", "day", "any"}:
            raise ValueError("unknown action or period")


@dataclass(frozen=True)
class Plan:
    """OR of groups; AND within a group, on one document."""

    groups: tuple[tuple[Requirement, ...], ...]
    unsupported: tuple[str, ...] = field(default=())

    def __post_init__(self):
        if any(not g for g in self.groups):
            raise ValueError("a group needs a requirement")

    def not_narrowing(self) -> str | None:
        """Why this plan isn't used to narrow a search: the first of three reasons."""
        if any(r.max_spend_krw is not None or r.min_cap_krw is not None for g in self.groups for r in g):
            return "numeric_guard"
        return "unsupported_conditions" if self.unsupported else None if self.groups else "empty_conditions"


def money(token: Column) -> Column:
    """Won of one written amount, null if not whole."""
    number = F.replace(F.regexp_extract(token, MONEY, 1), F.lit(","), F.lit("")).try_cast("decimal(30,6)")
    scale = F.regexp_extract(token, MONEY, 2)
    amount = number * F.when(scale == "만", 10_000).when(scale == "천", 1_000).otherwise(1)
    return F.when(amount == F.floor(amount), amount.cast("long"))


def amounts(text: Column) -> Column:
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(MONEY), F.lit(0)), money), lambda x: x.isNotNull())


def _decimals(literals: Column, kind: str) -> Column:
    return F.transform(F.filter(F.coalesce(literals, F.array().cast("array<struct<kind:string,decimal:string>>")), lambda x: x["kind"] == kind), lambda x: x["decimal"].try_cast("decimal(30,6)"))


def percent_column(value: Column, unit: Column, literals: Column) -> Column:
    """struct(value, state): known if the one typed ratio is the one written percentage, without range, bound or money."""
    raw = F.concat_ws(" ", F.coalesce(value, F.lit("")), F.coalesce(unit, F.lit("")))
    written = F.transform(F.regexp_extract_all(raw, F.lit(PERCENT), F.lit(1)), lambda x: x.try_cast("decimal(30,6)"))
    typed = F.transform(_decimals(literals, "ratio"), lambda x: x * 100)
    vague = raw.rlike(RANGE) | raw.rlike(LIMIT_WORDS) | (raw.rlike(MONEY) & raw.rlike(PERCENT))
    agrees = (F.size(typed) == 1) & (F.size(written) == 1) & (F.get(typed, F.lit(0)) == F.get(written, F.lit(0)))
    state = F.when(vague, "unknown").when(agrees, "known").when((F.size(typed) == 0) & (F.coalesce(value, F.lit("")) == ""), "not_applicable").otherwise("unknown")
    return F.struct(F.when(state == "known", F.get(typed, F.lit(0)).cast("double")).alias("value"), state.alias("state"))


def spend_column(condition: Column, literals: Column) -> Column:
    """struct(value, operator, state) of the previous month's least spending.

    Amounts within AFTER characters behind and BEFORE characters ahead of a spend phrase are connected to it;
    it is known if there is one distinct amount, a lower bound, and a typed one.
    """
    text = F.coalesce(condition, F.lit(""))
    typed = _decimals(literals, "KRW")
    behind = F.regexp_extract_all(text, F.lit(f"(?s){SPEND_PHRASE}(?=(.{{0,{AFTER}}}))"), F.lit(1))
    ahead = F.transform(F.regexp_extract_all(F.reverse(text), F.lit(f"(?s){SPEND_PHRASE_REVERSED}(?=(.{{0,{BEFORE}}}))"), F.lit(1)), F.reverse)
    told = lambda p: F.zip_with(F.regexp_extract_all(p, F.lit(MONEY), F.lit(0)), F.regexp_extract_all(p, F.lit(f"(?s){MONEY}(?=(.{{0,{BOUND}}}))"), F.lit(3)), lambda token, tail: F.struct(money(token).alias("amount"), F.when(tail.contains("이상"), "gte").when(tail.contains("이하"), "lte").otherwise("unknown").alias("operator")))
    pairs = F.filter(F.flatten(F.transform(F.concat(behind, ahead), told)), lambda x: x["amount"].isNotNull())
    distinct = F.array_distinct(pairs)
    one = F.get(distinct, F.lit(0))
    known = (F.size(distinct) == 1) & (one["operator"] == "gte") & F.array_contains(typed, one["amount"].try_cast("decimal(30,6)"))
    state = F.when(~text.rlike(SPEND_PHRASE), F.when((F.size(typed) > 0) & (text != ""), "unknown").otherwise("not_applicable")).when(known, "known").otherwise("unknown")
    return F.struct(F.when(state == "known", one["amount"]).alias("value"), F.when(F.size(distinct) == 1, one["operator"]).alias("operator"), state.alias("state"))


def cap_column(cap: Column, literals: Column) -> Column:
    """struct(value, state): known if the one typed amount is the one written, and no ceiling on spending."""
    text = F.coalesce(cap, F.lit(""))
    typed, written = _decimals(literals, "KRW"), amounts(text)
    agrees = (F.size(typed) == 1) & (F.size(written) == 1) & (F.get(written, F.lit(0)).try_cast("decimal(30,6)") == F.get(typed, F.lit(0)))
    state = F.when(text.rlike(SPEND_CEILING), "unknown").when(agrees, "known").when((F.size(typed) == 0) & (text == ""), "not_applicable").otherwise("unknown")
    return F.struct(F.when(state == "known", F.get(written, F.lit(0))).alias("value"), state.alias("state"))


def period_column(cap: Column, period: Column) -> Column:
    """struct(value, state): month or day if one alone is told."""
    text = dense_form(F.concat_ws(" ", F.coalesce(cap, F.lit("")), F.coalesce(period, F.lit(""))))
    month, day = text.rlike(MONTH_WORDS), text.rlike(DAY_WORDS)
    value = F.when(month & ~day, "month").when(day & ~month, "day")
    return F.struct(value.alias("value"), F.when(value.isNotNull(), "known").when(text != "", "unknown").otherwise("not_applicable").alias("state"))


def action_column(action: Column, benefit: Column) -> Column:
    """struct(value, state): discount or earn; state 'false' if denied, 'unknown' for none or several kinds."""
    text = dense_form(F.concat_ws(" ", F.coalesce(action, F.lit("")), F.coalesce(benefit, F.lit(""))))
    discount, earn = text.contains("할인"), text.rlike(EARN_WORDS)
    value = F.when(discount & ~earn, "discount").when(earn & ~discount, "earn")
    return F.struct(value.alias("value"), F.when(text.rlike(DENIED), "false").when(value.isNotNull(), "true").otherwise("unknown").alias("state"))


def raw_period(text: Column) -> Column:
    """The period told by a cap's raw text, if it is one."""
    month, day = text.rlike(RAW_MONTH), text.rlike(RAW_DAY)
    return F.when(month & ~day, "month").when(day & ~month, "day")


def derived(facts: DataFrame) -> DataFrame:
    """Facts (ten raw fields, and ``value_literals, condition_literals, cap_literals``) with their typed columns."""
    c = F.col
    return facts.withColumns(
        {
            "percent": percent_column(c("value"), c("unit"), c("value_literals")),
            "spend": spend_column(c("condition"), c("condition_literals")),
            "cap_amount": cap_column(c("cap"), c("cap_literals")),
            "cap_period": period_column(c("cap"), c("period")),
            "action_kind": action_column(c("action"), c("benefit_type")),
            "exceptions_dense": dense_form(c("exceptions")),
            "target_named": named_text(c("target")),
        }
    )


def expanded(targets: tuple[str, ...]) -> list[str]:
    """Targets with the words that stand for them, dense, sorted."""
    dense = lambda t: "".join(t.casefold().split())
    return sorted({dense(a) for t in targets for a in ALIASES.get(dense(t), [t])} - {""})


def named_text(target: Column) -> Column:
    """What a raw target names: dense, asides that exclude left out."""
    return F.regexp_replace(dense_form(F.regexp_replace(F.coalesce(target, F.lit("")), EXCLUDED_ASIDE, "")), "[()]", "")


def mentions(text: Column, word: str) -> Column:
    """Whether a target (its named_text, in a column) names a word: lists 'A차,B차충전소' name each with the ending, 기차 isn't 전기차."""
    whole = r"^((?:[가-힣]+차[,/])+[가-힣]+차)(충전소?)$"
    listed = F.transform(F.split(F.regexp_extract(text, whole, 1), "[,/]"), lambda w: F.concat(w, F.regexp_extract(text, whole, 2)))
    forms = F.when(text.rlike(whole), F.concat(F.array(text), listed)).otherwise(F.array(text))
    if word == "기차":
        forms = F.transform(forms, lambda f: F.replace(f, F.lit("전기차"), F.lit("")))
    return F.exists(forms, lambda f: f.contains(word))


def three_valued(*steps: tuple[str, Column]) -> Column:
    """The first outcome whose condition holds, else 'true'."""
    out = F.lit("true")
    for outcome, condition in reversed(steps):
        out = F.when(condition, outcome).otherwise(out)
    return out


def status(r: Requirement) -> Column:
    """true, false or unknown for a derived fact: what its typed columns say of a requirement; targets apart."""
    c = F.col
    kind, said = c("action_kind.value"), c("action_kind.state")
    never = F.lit(False)
    bounds = [
        (c("percent.state"), c("percent.value") < F.lit(r.min_percent)) if r.min_percent is not None else None,
        (c("spend.state"), c("spend.value") > F.lit(r.max_spend_krw)) if r.max_spend_krw is not None else None,
        (c("cap_amount.state"), c("cap_amount.value") < F.lit(r.min_cap_krw)) if r.min_cap_krw is not None else None,
    ]
    if r.min_cap_krw is not None and r.cap_period != "any":
        period = F.when(c("cap_period.state") == "known", c("cap_period.value")).otherwise(raw_period(F.coalesce("cap", F.lit(""))))
        bounds.append((F.when(period.isNotNull(), "known").otherwise("unknown"), period != r.cap_period))
    bounds = [b for b in bounds if b]
    broken = reduce(or_, ((state == "known") & over for state, over in bounds), never)
    unsure = reduce(or_, (state != "known" for state, _ in bounds), said != "true")
    other = never if r.action == "any" else kind != r.action
    untold = never if r.action == "any" else kind.isNull()
    return three_valued(("false", said == "false"), ("unknown", untold), ("false", other), ("false", broken), ("unknown", unsure))


def holds(r: Requirement) -> Column:
    """Whether a derived fact meets a requirement for sure."""
    wanted = expanded(r.targets)
    named = reduce(or_, (mentions(F.col("target_named"), w) for w in wanted))
    barred = reduce(or_, (mentions(F.col("target_named"), w) for w in expanded(r.exclude_targets)), F.lit(False))
    excepted = reduce(or_, (F.col("exceptions_dense").contains(w) for w in wanted))
    out = named & ~barred & ~excepted & (status(r) == "true")
    if r.min_frequency is not None:
        pattern = {"month": r"(?:월|매월)(\d+)회", "day": r"(?:일|하루)(\d+)회", "any": r"(\d+)회"}[r.frequency_period]
        times = F.array_distinct(F.transform(F.regexp_extract_all(F.regexp_replace(F.coalesce("frequency", F.lit("")), r"(?U)\s+", ""), F.lit(pattern), F.lit(1)), lambda x: x.cast("int")))
        out &= (F.size(times) == 1) & (F.get(times, F.lit(0)) >= r.min_frequency)
    return out


def by_wording(facts: DataFrame, fields: list[str], told) -> DataFrame:
    """facts with what ``told`` (a DataFrame of distinct ``fields`` to one with more columns or fewer rows) makes of their wording alone: once for each wording, in a table of its own, met again by an equi-join in which nulls are equal."""
    wordings = settled(told(facts.select(*fields).distinct()), "wordings")
    named = wordings.withColumnsRenamed({f: f"_of_{f}" for f in fields})
    return facts.join(named, reduce(and_, (facts[f].eqNullSafe(named[f"_of_{f}"]) for f in fields))).drop(*(f"_of_{f}" for f in fields))


def divided(facts: DataFrame, key: str, groups: list[list[Column]]) -> DataFrame:
    """(key): documents for which in some group every condition holds for a fact of theirs. One shuffle, whatever the groups."""
    named = {f"_c{i}_{j}": F.coalesce(condition, F.lit(False)) for i, g in enumerate(groups) for j, condition in enumerate(g)}
    marked = facts.select(key, *(c.alias(n) for n, c in named.items())).where(reduce(or_, (F.col(n) for n in named)))
    some = marked.groupBy(key).agg(*(F.bool_or(n).alias(n) for n in named))
    return some.where(reduce(or_, (reduce(and_, (F.col(f"_c{i}_{j}") for j in range(len(g)))) for i, g in enumerate(groups)))).select(key)


def select_documents(facts: DataFrame, plan: Plan, key: str = "document_id", scope: DataFrame | None = None) -> DataFrame:
    """(key) of the documents that meet a plan; none for an empty or unsupported one."""
    table = facts if scope is None else facts.join(scope.select(key), key, "left_semi")
    if not plan.groups or plan.unsupported:
        return table.select(key).limit(0)
    fields = [c for c in (*FIELDS, "value_literals", "condition_literals", "cap_literals") if c in table.columns]
    flags = {f"_h{i}_{j}": holds(r) for i, g in enumerate(plan.groups) for j, r in enumerate(g)}
    judged = by_wording(table.select(key, *fields), fields, lambda w: derived(w).select(*fields, *(c.alias(n) for n, c in flags.items())))
    return divided(judged, key, [[F.col(f"_h{i}_{j}") for j in range(len(g))] for i, g in enumerate(plan.groups)])


def with_fallback(matches: DataFrame, base: DataFrame, group: str) -> DataFrame:
    """Rows of (group, key): those matched, and for a group without any the whole base."""
    missed = base.join(matches.select(group).distinct(), group, "left_anti")
    return matches.select(*base.columns).unionByName(missed)


#: Bits of the set of starts that questions are looked through for.
START_BITS = 1 << 20


def _start_bits(codes: np.ndarray, size: int) -> np.ndarray:
    """The bit of the characters of each place and the size - 1 ones behind it."""
    n = len(codes) - size + 1
    h = np.full(max(0, n), size, np.uint64)
    for i in range(size if n > 0 else 0):
        h = (h ^ codes[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return (h % np.uint64(START_BITS)).astype(np.int64)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def _begun(asked: DataFrame, starts: DataFrame, sizes: tuple[int, int]) -> DataFrame:
    """(query, start): of each question's runs of ``sizes`` characters, each once, those that may be among the starts. Which ones may be is told by a set of bits of a fixed size, so that no row is made of every place of a text."""

    @F.pandas_udf(T.LongType())
    def bit(its: pd.Series) -> pd.Series:
        return pd.Series([int(_start_bits(_codes(x), len(x))[0]) for x in its], dtype="int64")

    held = np.zeros(START_BITS, bool)
    held[[r[0] for r in starts.distinct().select(bit("start")).distinct().collect()]] = True  # START_BITS rows at most
    shared = asked.sparkSession.sparkContext.broadcast(np.packbits(held))

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def among(texts: pd.Series) -> pd.Series:
        bits = np.unpackbits(shared.value).astype(bool)
        out = []
        for text in texts:
            codes = _codes(text)
            out.append(list({text[p : p + n] for n in sizes for p in np.flatnonzero(bits[_start_bits(codes, n)]).tolist()}))
        return pd.Series(out)

    return asked.select("query", F.explode(among("text")).alias("start"))


def explicit_scope(questions: DataFrame, names: DataFrame, least: int = 4) -> DataFrame:
    """(query, key) of names found in a question, dense forms compared.

    questions: (query, text); names: (key, name). A name inside a longer one found at the same place doesn't count; a name
    of several keys gives none for its question.
    """
    asked = questions.select("query", dense_form(F.col("text")).alias("text"))
    known = names.select("key", dense_form(F.col("name")).alias("form")).where(F.length("form") >= least).distinct()
    forms = known.groupBy("form").agg(F.count_distinct("key").alias("keys"), F.min("key").alias("key"))
    # a form can only be in a question that holds its first characters: an equi-join on these, then the whole form is looked for
    start = F.when(F.length("form") >= 2 * least, F.substring("form", 1, 2 * least)).otherwise(F.substring("form", 1, least))
    begun = _begun(asked, forms.select(start.alias("start")), (least, 2 * least)).join(forms.withColumn("start", start), "start").select("query", "form", "keys", "key")
    found = begun.join(asked, "query").where(F.contains("text", "form")).select("query", "form", "keys", "key", "text")
    longer = found.select(F.col("query").alias("q"), F.col("form").alias("whole"))
    inside = (F.col("query") == F.col("q")) & (F.length("whole") > F.length("form")) & F.col("whole").contains(F.col("form"))
    # a shorter form counts if it also stands outside all longer ones
    rest = found.join(longer, inside, "left").groupBy("query", "form", "keys", "key", "text").agg(F.array_sort(F.collect_set("whole"), lambda a, b: F.length(b) - F.length(a)).alias("wholes"))
    cut = F.aggregate("wholes", F.col("text"), lambda t, w: F.replace(t, w, F.lit("\u0001")))
    kept = rest.where(cut.contains(F.col("form")))
    clear = kept.groupBy("query").agg(F.max("keys").alias("most")).where("most = 1").select("query")
    return kept.join(clear, "query").select("query", "key").distinct()


def registered(names: DataFrame, catalogue: DataFrame, most: int = 106) -> DataFrame:
    """(owner, status, keys) of the names an owner has registered, joined with the catalogue exactly: ready with one key a name, empty without names, else needs_review and no keys.

    names: (owner, names array<string>, null where what was stored can't be read); catalogue: (name, key), a null key where it has none. Needs review:
    a name that is null, stands for no card or for several, has no key or the key of another name, and more than ``most`` keys.
    """
    told = names.select("owner", "names", F.array_distinct("names").alias("_its"))
    known = catalogue.groupBy("name").agg(F.count(F.lit(1)).alias("_n"), F.max("key").alias("_key"))
    each = told.select("owner", F.explode("_its").alias("name")).join(known, "name", "left")
    judged = each.groupBy("owner").agg(F.bool_and(F.coalesce(F.col("_n") == 1, F.lit(False)) & F.col("_key").isNotNull()).alias("_sound"), F.count_distinct("_key").alias("_keys"), F.count(F.lit(1)).alias("_names"), F.array_sort(F.collect_list("_key")).alias("keys"))
    met = told.select("owner", "names").join(judged, "owner", "left")
    empty = F.array().cast(met.schema["keys"].dataType)
    sound = F.coalesce(F.col("_sound") & (F.col("_keys") == F.col("_names")) & (F.col("_names") <= most), F.lit(False))
    status = F.when(F.col("names").isNull(), "needs_review").when(F.size("names") == 0, "empty").when(sound, "ready").otherwise("needs_review")
    return met.select("owner", status.alias("status"), F.when(status == "ready", F.col("keys")).otherwise(empty).alias("keys"))


def selected_scope(choices: DataFrame, references: DataFrame) -> DataFrame:
    """(query, keys) of the cards that a question's selected references name, in the order of the references; null keys where it must be asked again.

    choices: (query, selected array<string>, clarification string); references: (query, position, ref, key). A reference is of the group before its
    first "r". Asked again: nothing selected, one selected twice or unknown, several groups, one card twice, or a clarification.
    """
    rows = choices.select("query", "selected", F.trim(F.coalesce("clarification", F.lit(""))).alias("_told"))
    each = rows.select("query", F.explode(F.array_distinct("selected")).alias("ref")).join(references, ["query", "ref"], "left")
    judged = each.groupBy("query").agg(F.bool_and(F.col("position").isNotNull()).alias("_known"), F.count_distinct(F.substring_index("ref", "r", 1)).alias("_groups"), F.count_distinct("key").alias("_distinct"), F.count(F.lit(1)).alias("_n"), F.transform(F.array_sort(F.collect_list(F.struct("position", "key"))), lambda x: x["key"]).alias("_keys"))
    met = rows.join(judged, "query", "left")
    clear = (F.col("_told") == "") & F.col("_known") & (F.col("_groups") == 1) & (F.col("_distinct") == F.col("_n")) & (F.size("selected") == F.col("_n"))
    return met.select("query", F.when(F.coalesce(clear, F.lit(False)), F.col("_keys")).alias("keys"))
