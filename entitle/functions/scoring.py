"""Match scores, checks and explanations as column expressions.

All functions expect one row with the profile columns (age, income, category, occupation, state,
see ``with_user_keys``) and the compiled rule columns. Rule columns carry the prefix ``r_`` so the
two sides never clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from entitle.functions.strings import money, strip
from entitle.schema import OPEN_INCOME_CAP

# Weights and tolerances of the two scores.
STRICT_WEIGHT = 25.0
AGE_TOLERANCE = 5
INCOME_TOLERANCE = 0.8
LENIENT_AGE = (20, 10)
LENIENT_INCOME = (30, 15)
LENIENT_GROUP = (25, 15)
RELAXED_INCOME = 1.3
SOFT_OCCUPATION, SOFT_AGE, SOFT_INCOME = 0.4, 0.3, 0.3

c = F.col


def with_user_keys(profiles: DataFrame) -> DataFrame:
    """Adds the normalised values the checks compare, once per profile instead of once per pair."""
    return (profiles.withColumn("u_category", F.lower(strip(c("category"))))
            .withColumn("u_occupation", F.lower(strip(c("occupation"))))
            .withColumn("u_state", F.lower("state"))
            # the lenient dialect compares values as they are
            .withColumn("l_category", F.lower("category"))
            .withColumn("l_occupation", F.lower("occupation")))


def user_category() -> Column:
    return c("u_category")


def user_occupation() -> Column:
    return c("u_occupation")


# --- strict dialect -------------------------------------------------------------------------

def age_ok() -> Column:
    above = c("r_min_age").isNull() | (c("age") >= c("r_min_age"))
    below = c("r_max_age").isNull() | (c("age") <= c("r_max_age"))
    return above & below


def income_ok() -> Column:
    return c("r_max_income").isNull() | (c("income") <= c("r_max_income"))


def category_ok() -> Column:
    return c("r_category_open") | F.array_contains(c("r_category_keys"), user_category())


def occupation_ok() -> Column:
    return c("r_occupation_open") | F.array_contains(c("r_occupation_keys"), user_occupation())


def age_points() -> Column:
    gap = (
        F.when(c("age") < c("r_min_age"), c("r_min_age") - c("age"))
        .when(c("age") > c("r_max_age"), c("age") - c("r_max_age"))
    )
    return (
        F.when(age_ok(), F.lit(STRICT_WEIGHT))
        .when(gap <= AGE_TOLERANCE, STRICT_WEIGHT * (1 - gap / 10))
        .otherwise(F.lit(0.0))
    )


def income_points() -> Column:
    ratio = F.try_divide(c("r_max_income"), c("income"))
    return (
        F.when(income_ok(), F.lit(STRICT_WEIGHT))
        .when(ratio >= INCOME_TOLERANCE, STRICT_WEIGHT * ratio)
        .otherwise(F.lit(0.0))
    )


def _flag_points(ok: Column) -> Column:
    return F.when(ok, F.lit(STRICT_WEIGHT)).otherwise(F.lit(0.0))


def strict_score() -> Column:
    total = age_points() + income_points() + _flag_points(category_ok()) + _flag_points(occupation_ok())
    return F.round(total, 1)


def age_reason() -> Column:
    low, high = c("r_min_age"), c("r_max_age")
    return F.concat(
        F.lit("age "), c("age").cast("string"), F.lit(": "),
        F.when(low.isNull() & high.isNull(), F.lit("no age limit"))
        .when(c("age") < low, F.concat(F.lit("under the minimum of "), low.cast("string")))
        .when(c("age") > high, F.concat(F.lit("over the maximum of "), high.cast("string")))
        .when(low.isNotNull() & high.isNotNull(),
              F.concat(F.lit("inside "), low.cast("string"), F.lit("-"), high.cast("string")))
        .when(low.isNotNull(), F.concat(F.lit("at least "), low.cast("string")))
        .otherwise(F.concat(F.lit("at most "), high.cast("string"))),
    )


def income_reason() -> Column:
    cap = c("r_max_income")
    return F.concat(
        F.lit("income "), money(c("income")), F.lit(": "),
        F.when(cap.isNull(), F.lit("no income limit"))
        .when(income_ok(), F.concat(F.lit("within "), money(cap)))
        .otherwise(F.concat(F.lit("over "), money(cap))),
    )


def category_reason() -> Column:
    mine, text = user_category(), c("r_category_text")
    return F.concat(
        F.lit("category "), mine, F.lit(": "),
        F.when(c("r_category_open"), F.lit("open to all"))
        .when(F.array_contains(c("r_category_tokens"), mine), F.lit("listed"))
        .when(text.contains("sc/st") & mine.isin("sc", "st"), F.lit("covered by SC/ST"))
        .when(text.contains("minority") & (mine == "minority"), F.lit("covered by the minority rule"))
        .otherwise(F.concat(F.lit("not among "), text)),
    )


def occupation_reason() -> Column:
    mine, text = user_occupation(), c("r_occupation_text")
    return F.concat(
        F.lit("occupation "), mine, F.lit(": "),
        F.when(c("r_occupation_open"), F.lit("open to all"))
        .when(mine == text, F.lit("as required"))
        .when(occupation_ok(), F.concat(F.lit("counts as "), text))
        .otherwise(F.concat(F.lit("rule asks for "), text)),
    )


def strict_reason() -> Column:
    checks = [(age_ok(), age_reason()), (income_ok(), income_reason()),
              (category_ok(), category_reason()), (occupation_ok(), occupation_reason())]
    passed = F.array_compact(F.array(*[F.when(ok, why) for ok, why in checks]))
    failed = F.array_compact(F.array(*[F.when(~ok, why) for ok, why in checks]))
    return (
        F.when(F.size(failed) == 0,
               F.concat(F.lit("All criteria met: "), F.array_join(passed, ", "), F.lit(".")))
        .when(F.size(failed) == 1,
              F.concat(F.lit("Most criteria met ("), F.array_join(passed, ", "), F.lit("), except "),
                       F.get(failed, F.lit(0)), F.lit(".")))
        .otherwise(F.concat(F.lit("Criteria not met: "), F.array_join(failed, "; "), F.lit(".")))
    )


# --- lenient dialect ------------------------------------------------------------------------

def lenient_age_ok() -> Column:
    return c("age").between(c("r_min_age"), c("r_max_age"))


def category_mentioned() -> Column:
    return c("r_category_open") | c("r_category_text").contains(c("l_category"))


def lenient_category_ok() -> Column:
    return category_mentioned() | c("r_category_has_all")


def lenient_occupation_ok() -> Column:
    return c("r_occupation_open") | c("r_occupation_text").contains(c("l_occupation"))


def is_central() -> Column:
    return F.lower("r_state") == "central"


def jurisdiction_ok() -> Column:
    return is_central() | (F.lower("r_state") == c("u_state"))


def lenient_core_ok() -> Column:
    """All hard criteria but the place."""
    return lenient_age_ok() & (c("income") <= c("r_max_income")) & lenient_category_ok() & lenient_occupation_ok()


def lenient_score() -> Column:
    low, high = c("r_min_age"), c("r_max_age")
    span = F.when(high > low, high - low).otherwise(1)
    drift = F.abs(c("age") - (low + high) / 2) / span
    age = F.when(c("r_age_open"), F.lit(float(LENIENT_AGE[1]))).otherwise(
        (1 - F.least(drift, F.lit(1.0))) * LENIENT_AGE[0])
    cap = c("r_max_income")
    ratio = F.when(cap > 0, F.try_divide(c("income"), cap)).otherwise(1.0)
    income = F.when(c("r_income_open") | (cap >= OPEN_INCOME_CAP), F.lit(float(LENIENT_INCOME[1]))).otherwise(
        (1 - F.least(ratio, F.lit(1.0))) * LENIENT_INCOME[0])

    def group(is_open: Column, ok: Column) -> Column:
        return (F.when(is_open, F.lit(float(LENIENT_GROUP[1])))
                .when(ok, F.lit(float(LENIENT_GROUP[0]))).otherwise(F.lit(0.0)))

    category = group(c("r_category_open"), category_mentioned())
    occupation = group(c("r_occupation_open"), lenient_occupation_ok())
    return F.round(F.least(age + income + category + occupation, F.lit(100.0)), 2)


def lenient_reason() -> Column:
    parts = F.array(
        F.when(~c("r_age_open") & lenient_age_ok(),
               F.concat(F.lit("age "), c("age").cast("string"), F.lit(" fits "), c("r_age_text"))),
        F.when(~c("r_income_open") & (c("income") <= c("r_max_income")),
               F.concat(F.lit("income "), money(c("income")), F.lit(" fits "), c("r_income_text"))),
        F.when(category_mentioned(), F.concat(F.lit("category "), c("category"), F.lit(" accepted"))),
        F.when(lenient_occupation_ok(), F.concat(F.lit("occupation "), c("occupation"), F.lit(" accepted"))),
        F.when(is_central(), F.concat(F.lit("central programme, valid in "), c("state")))
        .when(jurisdiction_ok(), F.concat(F.lit("programme of "), c("state"))),
    )
    return F.concat(F.lit("Qualifies: "), F.array_join(F.array_compact(parts), ", "))


def relaxed_reason() -> Column:
    parts = F.array(
        F.when(c("income") > c("r_max_income"),
               F.concat(F.lit("income a little above "), c("r_income_text"))),
        F.when(~lenient_occupation_ok(), F.concat(F.lit("meant for "), c("r_occupation_label"))),
        F.when(~jurisdiction_ok(), F.concat(F.lit("offered in "), c("r_state"))),
    )
    joined = F.array_join(F.array_compact(parts), ", ")
    return F.concat(F.lit("Related programme"),
                    F.when(joined != "", F.concat(F.lit(": "), joined)).otherwise(F.lit("")))


# --- soft fit -------------------------------------------------------------------------------

def soft_matches() -> Column:
    """Names of the profile fields that fit raw criteria c_age, c_income, c_occupation.

    Only supplied fields count; a zero age or income counts as not supplied.
    """
    occupation = (c("c_occupation") == "All") | (F.lower("c_occupation") == F.lower("occupation"))
    return F.array_compact(F.array(
        F.when((F.length("occupation") > 0) & occupation, F.lit("occupation")),
        F.when((c("age") != 0) & c("c_age").contains("All"), F.lit("age")),
        F.when((c("income") != 0) & c("c_income").contains("All"), F.lit("income")),
    ))


def soft_fit(matches: Column) -> Column:
    def part(name: str, points: float) -> Column:
        return F.when(F.array_contains(matches, name), F.lit(points)).otherwise(F.lit(0.0))
    return part("occupation", SOFT_OCCUPATION) + part("age", SOFT_AGE) + part("income", SOFT_INCOME)
