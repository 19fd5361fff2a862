"""The match rules: an ordered cascade of tests that labels a pair of records."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.utils import AnalysisException, ParseException

from ..functions import text, vectors
from ..schemas import DISPLAY_NAMES, RECORD_VECTORS
from .cosine import near_vectors
from .pairs import self_pairs
from .tiles import similar_pairs

# The labels, in rule order. The double space in ADDRESS is meant.
EXACT = "Exact firstname+lastname+dob+gender"
HIGH = "hc-firstname+hc-lastname | Exact DOB+gender"
ADDRESS = "lc firstname+lastname + hc-address  | Exact DOB+gender"
FUZZY = "Fuzzy Match on Lastname"
NO_MATCH = "No Match"
RULE_LABELS = (EXACT, HIGH, ADDRESS, FUZZY, NO_MATCH)
#: What HIGH was called by earlier versions.
HIGH_EARLIER = "hc-firstname+lc-lastname | Exact DOB+gender"
SINGLETON = "Singleton"

SCORES = ("fn_similarity_score", "ln_similarity_score", "adrs_similarity_score")
SCORED_VECTORS = dict(zip(SCORES, RECORD_VECTORS.values()))


@dataclass(frozen=True)
class Thresholds:
    """Scores must lie above these; edits of the last name stay below ``max_edits``."""

    high: float = 0.95
    address: float = 0.9
    max_edits: int = 3


def _equal_known_dob(a: str, b: str) -> Column:
    return text.known_dob(a) == text.known_dob(b)


def _equal_known_gender(a: str, b: str) -> Column:
    return text.known_gender(a) == text.known_gender(b)


def rule_tests(limits: Thresholds = Thresholds()) -> dict[str, Column]:
    """Label -> test over a pair row with ``*_a``/``*_b`` columns and the three scores."""
    fn, ln, adrs = (F.col(s) for s in SCORES)
    dob = _equal_known_dob("dob_a", "dob_b")
    gender = _equal_known_gender("gender_a", "gender_b")
    return {
        EXACT: (F.col("firstname_a") == F.col("firstname_b"))
        & (F.col("lastname_a") == F.col("lastname_b"))
        & dob
        & gender,
        HIGH: (fn > limits.high) & (ln > limits.high) & dob & gender,
        ADDRESS: (adrs > limits.address) & (fn > limits.address) & (ln > limits.address) & dob,
        FUZZY: text.within_edits("lastname_a", "lastname_b", limits.max_edits - 1),
    }


def match_label(limits: Thresholds = Thresholds()) -> Column:
    """First rule that holds; a test that is NULL does not hold."""
    (first, test), *rest = rule_tests(limits).items()
    label = F.when(test, F.lit(first))
    for name, test in rest:
        label = label.when(test, F.lit(name))
    return label.otherwise(F.lit(NO_MATCH))


_PAIR_COLUMNS = ("dob", "gender", "firstname", "lastname")


def scored_pairs(
    records: DataFrame, block=("task_id",), with_text: bool = True, **tiling
) -> DataFrame:
    """Pairs of each block with both sides' compared columns and the three scores."""
    carried = [*block, "id", *_PAIR_COLUMNS, *RECORD_VECTORS.values()]
    if with_text:
        carried.append("country")
    pairs = similar_pairs(records.select(*carried), block, "id", SCORED_VECTORS, **tiling)
    return pair_columns(pairs, block, with_text)


def pair_columns(pairs: DataFrame, block, with_text: bool = True, *carried: str) -> DataFrame:
    """The pair relation's columns, with both records as one line of text each."""
    columns = [*block, *carried, "id_a", "id_b", *[f"{c}_{s}" for c in _PAIR_COLUMNS for s in "ab"]]
    if with_text:
        columns += [record_text("_a").alias("first_record"), record_text("_b").alias("second_record")]
    return pairs.select(*columns, *SCORES)


def record_text(side: str = "") -> Column:
    """One line showing a record; NULL if any part is."""
    return text.joined_text(
        *[f"{c}{side}" for c in ("firstname", "lastname", "dob", "gender", "country")]
    )


def label_pairs(pairs: DataFrame, limits: Thresholds = Thresholds()) -> DataFrame:
    """Add the label, before the scores."""
    lead = [c for c in pairs.columns if c not in SCORES]
    return pairs.select(*lead, match_label(limits).alias("match_type"), *SCORES)


def match_pairs(
    records: DataFrame, block=("task_id",), limits: Thresholds = Thresholds(), **tiling
) -> DataFrame:
    """The labelled pair relation, ``No Match`` pairs included."""
    return label_pairs(scored_pairs(records, block, **tiling), limits)


def with_display_names(pairs: DataFrame) -> DataFrame:
    return pairs.withColumnsRenamed(DISPLAY_NAMES)


def without_display_names(pairs: DataFrame) -> DataFrame:
    return pairs.withColumnsRenamed({shown: name for name, shown in DISPLAY_NAMES.items()})


def score_band(score, high: float = 0.9) -> Column:
    return F.when(text.col(score) > high, "High").otherwise("Medium")


def tier(match_type="match_type") -> Column:
    """Display tier of a row. Both names of the second rule belong to ``hc``."""
    label = text.col(match_type)
    return (
        F.when(label == SINGLETON, "singleton")
        .when(label == EXACT, "exact")
        .when(label.isin(HIGH, HIGH_EARLIER), "hc")
        .when(label == ADDRESS, "lc")
        .otherwise("other")
    )


def combined_scores(digits: int = 10) -> Column:
    """The three scores as one text, ``fn|ln|adrs``."""
    return text.joined_text(
        *[F.round(F.col(s), digits).cast("decimal(12,10)").cast("string") for s in SCORES],
        separator="|",
    )


# -- user-written rules ----------------------------------------------------------------

_FUNCTIONS = {
    "vector_cosine_similarity": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", """
        try_divide(
          aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x),
          sqrt(aggregate(a, 0D, (s, x) -> s + x * x))
            * sqrt(aggregate(b, 0D, (s, x) -> s + x * x)))"""),
    "vector_dot_product": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", """
        aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)"""),
    "vector_add": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "ARRAY<DOUBLE>", """
        slice(zip_with(a, b, (x, y) -> x + y), 1, least(size(a), size(b)))"""),
    "editdistance": ("a STRING, b STRING", "INT", "levenshtein(a, b)"),
    "jaccard_distance": ("a STRING, b STRING", "DOUBLE", """
        CASE WHEN a IS NULL AND b IS NULL THEN 0D WHEN a IS NULL OR b IS NULL THEN 1D
        ELSE 1D - size(array_intersect(split(a, ','), split(b, ',')))
                  / size(array_union(split(a, ','), split(b, ','))) END"""),
    "hamming_distance": ("a STRING, b STRING", "INT", """
        CASE WHEN length(a) = length(b) THEN
          aggregate(zip_with(split(a, ''), split(b, ''), (x, y) -> int(x <> y)), 0, (s, x) -> s + x)
        WHEN length(a) <> length(b)
          THEN CAST(raise_error('the two texts differ in length') AS INT) END"""),
    "suppress_vowels": ("s STRING", "STRING", f"translate(s, '{text.VOWELS}', '')"),
}


def register_functions(spark: SparkSession) -> None:
    """Make the matching functions callable from SQL; all but one are inlined expressions."""
    for name, (arguments, kind, body) in _FUNCTIONS.items():
        spark.sql(
            f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {kind} RETURN {body}"
        )
    spark.udf.register("jaro_winkler_distance", text.jaro_winkler_similarity)


#: Built-in functions that a rule may call beside those of this module and operators.
_ALLOWED = frozenset(
    "abs ceil ceiling coalesce concat concat_ws contains date_add date_sub datediff day"
    " dayofmonth endswith floor greatest if ifnull initcap instr isnotnull isnull least left"
    " length levenshtein like locate lower lpad ltrim month months_between nullif nvl regexp"
    " regexp_like replace reverse right rlike round rpad rtrim size soundex split startswith"
    " substr substring to_date translate trim upper year".split()
)


def _parsed(spark: SparkSession, predicate: str):
    """The predicate without its closing semicolon, and as a tree by Spark's own parser."""
    rule = predicate.strip().rstrip(";").strip()
    return rule, spark._jsparkSession.sessionState().sqlParser().parseExpression(rule)


def _refuse_statements(spark: SparkSession, predicate: str) -> str:
    """The predicate, if it is an expression without subqueries that calls listed functions
    only."""
    rule, tree = _parsed(spark, predicate)
    todo = [tree]
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "UnresolvedFunction":
            name = ".".join(_items(node.nameParts())).lower()
            if name not in _ALLOWED and name not in _FUNCTIONS and name != "jaro_winkler_distance":
                raise ValueError(f"not allowed in a rule: {name}")
        elif re.search("Subquery|Exists|ListQuery|Plan|Lambda", kind):
            raise ValueError(f"not allowed in a rule: {kind}")
        todo += _items(node.children())
    return rule


def _items(sequence) -> list:
    return [sequence.apply(i) for i in range(sequence.size())]


@dataclass(frozen=True)
class Drivers:
    """What the tests joined by AND in a rule say of every pair that satisfies it.

    ``equal`` columns are equal on both sides, the cosine of a vector column is at least its
    number in ``cosine``, and texts are at most so many edits apart as in ``edits``.
    """

    equal: tuple[str, ...]
    cosine: dict[str, float]
    edits: dict[str, int]


def rule_drivers(spark: SparkSession, predicate: str) -> Drivers:
    """Read from the predicate's tree as Spark parses it; other tests are left to the filter."""
    equal, cosine, edits = [], {}, {}
    todo = [_parsed(spark, predicate)[1]]
    while todo:
        node = todo.pop()
        kind, children = node.getClass().getSimpleName(), _items(node.children())
        if kind == "And":
            todo += children
            continue
        if kind == "EqualTo" and (column := _same_column(children)):
            equal.append(column)
        if kind not in _COMPARED or len(children) != 2:
            continue
        call, limit = children
        if _number(call) is not None:  # the limit stands first
            call, limit, kind = limit, call, _COMPARED[kind]
        number = _number(limit)
        if call.getClass().getSimpleName() != "UnresolvedFunction" or number is None:
            continue
        name = ".".join(_items(call.nameParts())).lower()
        column = _same_column(_items(call.children()))
        if column and name == "vector_cosine_similarity" and kind.startswith("Greater"):
            cosine[column] = max(number, cosine.get(column, -1.0))
        if column and name in ("editdistance", "levenshtein") and kind.startswith("Less"):
            most = math.ceil(number) - 1 if kind == "LessThan" else math.floor(number)
            edits[column] = min(most, edits.get(column, most))
    return Drivers(tuple(dict.fromkeys(equal)), cosine, edits)


#: Comparisons, and what they are with their sides exchanged.
_COMPARED = {
    "GreaterThan": "LessThan",
    "GreaterThanOrEqual": "LessThanOrEqual",
    "LessThan": "GreaterThan",
    "LessThanOrEqual": "GreaterThanOrEqual",
}


def _same_column(sides: list) -> str | None:
    """The column that both sides name, one as ``a.<column>``, the other as ``b.<column>``."""
    if len(sides) != 2 or any(s.getClass().getSimpleName() != "UnresolvedAttribute" for s in sides):
        return None
    names = [_items(s.nameParts()) for s in sides]
    if any(len(n) != 2 for n in names) or sorted(n[0].lower() for n in names) != ["a", "b"]:
        return None
    return names[0][1] if names[0][1].lower() == names[1][1].lower() else None


def _number(node) -> float | None:
    try:
        return float(node.sql()) if node.getClass().getSimpleName() == "Literal" else None
    except ValueError:  # decimals are written with their type
        text = re.fullmatch(r"(-?[\d.]+)(BD|D|L|F)?", node.sql())
        return float(text[1]) if text else None


#: Below this cosine most pairs of a block are candidates, and the block is compared.
_LEAST_COSINE = 0.5


def rule_pairs(
    records: DataFrame, predicate: str, block=("task_id",), id_column: str = "id", **tiling
) -> DataFrame:
    """Pairs that satisfy a user's SQL predicate over ``a`` and ``b``.

    Columns that the rule wants equal are join keys beside the block, so only records agreeing
    on them meet. Without such, pairs come from an index of the vectors that the rule wants
    similar, or else of the texts it wants few edits apart; the whole rule is then tested on
    them. Only a rule with none of these tests every pair of a block.
    """
    spark = records.sparkSession
    rule = _refuse_statements(spark, predicate)
    register_functions(spark)
    found = rule_drivers(spark, predicate)
    columns = {c.lower(): c for c in records.columns}
    equal = [columns[c.lower()] for c in found.equal if c.lower() in columns]
    cosine = {v: x for v, x in found.cosine.items() if x >= _LEAST_COSINE}
    edits = [c for c, n in found.edits.items() if n <= 2]
    if not equal and cosine:
        vector = max(cosine, key=cosine.get)
        pairs = near_vectors(
            records.select(*block, id_column, vector), block, id_column, vector, "__score", cosine[vector] - 1e-6
        ).select(*block, f"{id_column}_a", f"{id_column}_b")
    elif not equal and edits:
        from .candidates import near_names

        pairs = _pairs_of_names(records, near_names(records, block, edits[0]), block, id_column, edits[0])
    else:
        keys = [*block, *(c for c in equal if c not in block)]
        return self_pairs(records, keys, id_column, **tiling).filter(F.expr(rule))
    pairs = pairs.toDF(*(f"__{c}" for c in pairs.columns))
    met = pairs
    for side in "ab":
        keys = [F.col(f"__{c}") == F.col(f"{side}.{c}") for c in block]
        keys.append(F.col(f"__{id_column}_{side}") == F.col(f"{side}.{id_column}"))
        met = met.join(records.alias(side), reduce(lambda x, y: x & y, keys))
    return met.drop(*pairs.columns).filter(F.expr(rule))


def _pairs_of_names(records, names, block, id_column: str, column: str) -> DataFrame:
    """Ids of records with two near names, the lower id first."""
    there = F.struct(f"{column}_a", f"{column}_b")
    back = F.struct(F.col(f"{column}_b").alias(f"{column}_a"), F.col(f"{column}_a").alias(f"{column}_b"))
    pairs = names.select(*block, F.inline(F.array_distinct(F.array(there, back))))
    for side in "ab":
        own = records.select(
            *block, F.col(column).alias(f"{column}_{side}"), F.col(id_column).alias(f"{id_column}_{side}")
        ).distinct()
        pairs = pairs.join(own, [*block, f"{column}_{side}"])
    ids = [f"{id_column}_{side}" for side in "ab"]
    return pairs.where(F.col(ids[0]) < F.col(ids[1])).select(*block, *ids)


def validate_rule(records: DataFrame, predicate: str) -> tuple[bool, str | None]:
    """Whether the predicate can be run on the records. Analyses only; starts no job."""
    try:
        rule = _refuse_statements(records.sparkSession, predicate)
        register_functions(records.sparkSession)
        a, b = records.alias("a"), records.alias("b")
        joined = a.join(b, F.expr("a.id < b.id") & F.expr(rule))
        joined.schema
        return True, None
    except (AnalysisException, ParseException, ValueError) as error:
        return False, str(error)
