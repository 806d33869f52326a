"""Whether a record is right, by its dataset: rules over JSON records as columns, in a registry.

A record is a JSON object in a string column, which is parsed once into a map of typed values that the rules read. A rule
gives 1, 0 or null where the record doesn't tell.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from scorewright.functions import answers as A
from scorewright.functions import text as X
from scorewright.functions.registry import Registry

Rule = Callable[[Column], Column]
RULES: Registry[Rule] = Registry("dataset rule")

#: Fields that tell of a verdict, in the order asked, and those that binarised records are trusted in. Fixed values.
VERDICT_FIELDS = ("voted_correctness", "any_correct", "is_correct", "hit", "if_right")
TRUSTED_FIELDS = ("voted_correctness", "binary_is_correct")
#: Datasets by the rule that reads them. Fixed values.
EXPLICIT = "swe_bench_verified swe_bench_multilingual swe_bench_pro livecodebench arc_challenge hellaswag toolathlon humaneval_plus mmstar mmmu_dev_val mmmu_pro_10c mmmu_pro_v logicvista realworldqa mmvp spatialeval theoremqa scicode scicode_with_background mbpp_plus".split()
TRUSTED = "osworld_verified ocrbench_v2 terminal_bench omnidocbench_text_edit omnidocbench_tab_edit omnidocbench_tab_teds omnidocbench_formula_edit omnidocbench_formula_cdm omnidocbench_read_order_edit arenahard".split()


def text_of(value: Column) -> Column:
    """A JSON value as text: strings without quotes, null where it is null."""
    return F.try_variant_get(value, "$", "string")


def raw(record: Column, *names: str) -> Column:
    """The JSON value of the first of the fields that the record has, be it null."""
    found = F.lit(None).cast("variant")
    for n in reversed(names):
        found = F.when(F.map_contains_key(record, n), F.try_element_at(record, F.lit(n))).otherwise(found)
    return found


def field(record: Column, *names: str) -> Column:
    """The first of the fields that isn't null, as text."""
    return F.coalesce(*[text_of(F.try_element_at(record, F.lit(n))) for n in names])


def first_of_list(value: Column) -> Column:
    """The first element of a JSON list, of a list in a list its first; other values as they are."""
    for _ in range(2):
        value = X.bound(value, lambda v: F.when(F.schema_of_variant(v).startswith("ARRAY"), F.try_variant_get(v, "$[0]", "variant")).otherwise(v))
    return value


def _told(value: Column, words: Callable[[Column], Column]) -> Column:
    """A JSON value's verdict by its type: booleans as they are, numbers by whether they are 0, strings by `words`."""

    def by_kind(v: Column, kind: Column) -> Column:
        number = F.regexp_like(kind, F.lit("^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL)"))
        told = F.when(kind == "BOOLEAN", F.try_variant_get(v, "$", "boolean").cast("int")).when(number, (F.try_variant_get(v, "$", "double") != 0).cast("int"))
        return told.when(kind == "STRING", X.bound(text_of(v), words))

    return X.bound(value, lambda v: X.bound(F.schema_of_variant(v), lambda kind: by_kind(v, kind)))


def verdict(value: Column) -> Column:
    """1, 0 or null of a JSON value; a text that is a number other than 1 and 0 doesn't tell."""
    return _told(first_of_list(value), X.correctness)


def judge_verdict(value: Column) -> Column:
    """A judge's JSON value as 0 or 1: of an object its model_response, of a list its first element."""
    for _ in range(2):
        value = X.bound(value, lambda v: F.when(F.schema_of_variant(v).startswith("OBJECT"), F.try_variant_get(v, "$.model_response", "variant")).otherwise(first_of_list(v)))
    return _told(value, lambda v: X.bound(A.judge_words(v), A.flag_of_words))


def explicit(record: Column) -> Column:
    """The first verdict field that tells, by its name and then by its name in any case. Records without any such field, most
    of them, aren't asked for each."""
    named = F.exists(F.map_keys(record), lambda k: F.lower(k).isin(*VERDICT_FIELDS))
    any_case = F.filter(F.map_entries(record), lambda e: F.lower(e["key"]).isin(*VERDICT_FIELDS))
    places = F.transform(any_case, lambda e: F.struct(F.array_position(F.array(*map(F.lit, VERDICT_FIELDS)), F.lower(e["key"])).alias("place"), verdict(e["value"]).alias("flag")))
    known = F.array_sort(F.filter(places, lambda x: x["flag"].isNotNull()))
    return F.when(named, F.coalesce(*[verdict(F.try_element_at(record, F.lit(n))) for n in VERDICT_FIELDS], F.try_element_at(known, F.lit(1))["flag"]))


def trusted(record: Column) -> Column:
    """Binarised verdicts only: a raw score of other fields would count as right whenever it isn't 0."""
    return F.coalesce(*[verdict(raw(record, n)) for n in TRUSTED_FIELDS])


for _name in EXPLICIT:
    RULES.add(_name)(explicit)
for _name in TRUSTED:
    RULES.add(_name)(trusted)


@RULES.add("tau2_bench")
def tau2(record: Column) -> Column:
    return F.coalesce(*[verdict(raw(record, n)) for n in ("correct", "is_correct", "any_correct")])


@RULES.add("scibench")
def close_numbers(record: Column, atol: float = 1e-3, rtol: float = 1e-2) -> Column:
    """An explicit verdict, else the last numbers within tolerance, else equal free texts."""
    p, r = text_of(first_of_list(raw(record, "predictions", "prediction"))), text_of(first_of_list(raw(record, "references", "reference", "answer", "gold")))
    x, y = X.last_number(p), X.last_number(r)
    close = F.when(x.isNotNull() & y.isNotNull(), X.numeric_close(x, y, atol, rtol).cast("int")).otherwise((A.free_text(p) == A.free_text(r)).cast("int"))
    return F.coalesce(explicit(record), close)


@RULES.add("countbenchqa")
def names_answer(record: Column) -> Column:
    """An explicit verdict, else whether the prediction contains the answer, case and all."""
    p, a = X.empty_null(field(record, "prediction")), X.empty_null(field(record, "answer"))
    return F.coalesce(explicit(record), F.contains(p, a).cast("int"))


@RULES.add("simplevqa")
def judged(record: Column) -> Column:
    """An explicit verdict, else the judge's own words."""
    return F.coalesce(explicit(record), judge_verdict(raw(record, "judge_res")), judge_verdict(raw(record, "judge_res.model_response")))


@RULES.add("mathvista_mini")
def by_answer_type(record: Column) -> Column:
    """An explicit verdict, else by the kind of question: option letters, whole numbers cut to size, floats, or texts of
    which one contains the other. What can't be read is wrong."""
    kind, form = F.lower(X.stripped(field(record, "question_type"))), F.lower(X.stripped(field(record, "answer_type")))
    number = lambda x, use: X.bound(X.whole_number(x), use)
    cut = lambda x: F.when(F.abs(x) < float("inf"), F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)))

    def letter(text: Column) -> Column:
        alone = lambda x: X.bound(X.stripped(x), lambda bare: F.when(F.regexp_like(bare, F.lit("^\\p{L}$")), F.upper(bare)).otherwise(X.choice_letter(x, "A-Z")))
        return X.bound(text, alone)

    def by_form(form: Column, response: Column, answer: Column) -> Column:
        right = F.when(form == "integer", number(response, cut) == number(answer, cut)).when(form == "float", X.whole_number(response) == X.whole_number(answer))
        return right.otherwise(X.bound(A.comparable(response), lambda p: X.bound(A.comparable(answer), lambda a: A.one_within(p, a))))

    def right(response: Column) -> Column:
        other = X.bound(field(record, "answer"), lambda answer: X.bound(form, lambda f: by_form(f, response, answer)))
        return F.when(kind == "multi_choice", letter(response) == letter(field(record, "answer_option"))).otherwise(other)

    return F.coalesce(explicit(record), X.bound(field(record, "res", "prediction"), right).cast("int"), F.lit(0))


def choice_rule(letters: str, predictions: tuple[str, ...], references: tuple[str, ...], default: str | None = None, right: str | None = None) -> Rule:
    """Option letters of prediction and reference; with `right` that letter alone is right, whatever the reference. What
    is missing or can't be read is wrong."""

    def rule(record: Column) -> Column:
        p = X.choice_letter(text_of(first_of_list(raw(record, *predictions))), letters, default)
        a = F.lit(right) if right is not None else X.choice_letter(text_of(first_of_list(raw(record, *references))), letters)
        return F.coalesce(explicit(record), (p == a).cast("int"), F.lit(0))

    return rule


#: Datasets of option letters, by their letters. Fixed values.
RULES.add("simpleqa")(choice_rule("ABC", ("prediction", "predictions"), ("gold",), "C", "A"))
for _name, _letters in {"commonsense_qa": "ABCDE", "openbookqa": "ABCD", "openbookqa_fact": "ABCD", "c3": "ABCD", "longbenchv2_0shot": "ABCD"}.items():
    RULES.add(_name)(choice_rule(_letters, ("predictions", "prediction"), ("references", "reference")))
#: Datasets whose records may be bare verdicts, and those where a bare value is the prediction. Fixed values.
BARE_VERDICTS, BARE_PREDICTIONS = ("scicode", "scicode_with_background"), ("simpleqa", "commonsense_qa", "openbookqa", "openbookqa_fact", "c3", "longbenchv2_0shot")


def normal_name(dataset: str) -> str:
    return dataset.strip().lower().replace("-", "_")


def dataset_correctness(record: Column, dataset: str) -> Column:
    """1, 0 or null of a JSON record by the dataset's rule; an unknown dataset raises. JSON types count: see `verdict`."""
    name = normal_name(dataset)
    rule = RULES["tau2_bench" if name.startswith("tau2_bench") else name]
    is_object = F.ltrim(record).startswith("{")
    told = F.when(is_object, X.bound(F.from_json(record, "map<string,variant>"), rule))
    if name in BARE_VERDICTS:
        return told.otherwise(F.coalesce(X.bound(F.try_parse_json(record), verdict), F.lit(0)))
    if name in BARE_PREDICTIONS:
        return told.otherwise(X.bound(F.create_map(F.lit("prediction"), F.try_parse_json(record)), rule))
    return told
