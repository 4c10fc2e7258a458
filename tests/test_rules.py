import pytest

from entitle.operators.rules import compile_rules
from tests.helpers import rows, rules, scheme

STRICT_AGES = {
    "18-25": (18, 25), "60+": (60, None), "< 18": (None, 17), "21": (21, 21), " 21 ": (21, 21), "All": (None, None),
    "any": (None, None), "No limit": (None, None), "about 30": (None, None), "": (None, None),
    "All for visually impaired, 60+ for senior citizens": (60, None), "18-25 or 60+": (18, 25),
    "99999999999-3": (None, 3),
}
LENIENT_AGES = {
    "18-25": (18, 25), "60+": (60, 150), "< 18": (18, 18), "21": (21, 21), "all": (0, 150), "any": (0, 150), "": (0, 150),
    "All for visually impaired, 60+ for senior citizens": (60, 150), None: (0, 150), "0-18": (0, 18), "x+": (0, 150),
}
STRICT_INCOMES = {
    "BPL families": 150000.0, "Below  Poverty Line": 150000.0, "APL": None, "< 5 lakh": 500000.0, "< 2.5 lakh": 250000.0,
    "< ₹5,00,000": 500000.0, "< ₹5 lakh": 5.0, "< 1 crore": 1.0, "Low income": None, "All": None, "ANY": None,
    "no limit": None, "5 lakh": None, "whatever": None,
}
LENIENT_INCOMES = {
    "BPL families": 200000, "Low income": 200000, "< 6 lakh": 600000, "5 lakh": 500000, "< 1 crore": 10000000,
    "< ₹5,00,000": 5, "All": 999999999, "": 999999999, None: 999999999, "whatever": 999999999, "2.3 lakh": 229999,
}


@pytest.mark.parametrize("dialect,field,cases", [
    ("strict", "age", STRICT_AGES), ("lenient", "age", LENIENT_AGES),
    ("strict", "income", STRICT_INCOMES), ("lenient", "income", LENIENT_INCOMES)])
def test_texts(spark, dialect, field, cases):
    texts = list(cases)
    compiled = rules(spark, dialect, *[scheme(i, **{field: t}) for i, t in enumerate(texts)])
    columns = ("min_age", "max_age") if field == "age" else ("max_income",)
    found = {texts[pos]: tuple(v) if len(v) > 1 else v[0] for pos, *v in rows(compiled, "pos", *columns)}
    assert found == cases


def test_category_tokens_and_keys(spark):
    compiled = rules(spark, "strict", scheme(0, category=" SC/ST "), scheme(1, category="OBC, SC"),
                     scheme(2, category="Minority communities"), scheme(3, category="General"))
    found = {pos: (tokens, sorted(keys), is_open) for pos, tokens, keys, is_open in
             rows(compiled, "pos", "category_tokens", "category_keys", "category_open")}
    assert found[0] == (["sc", "st"], ["sc", "st"], False)
    assert found[1] == (["obc", "sc"], ["obc", "sc"], False)
    assert found[2][1] == ["minority", "minority communities"]
    assert found[3][2]


def test_synonyms_need_the_group_name(spark):
    compiled = rules(spark, "strict", scheme(0, occupation="entrepreneur"), scheme(1, occupation="Self-employed"))
    keys = dict(rows(compiled, "pos", "occupation_keys"))
    assert set(keys[0]) == {"entrepreneur", "self-employed"}
    assert set(keys[1]) == {"self-employed", "entrepreneur", "business owner"}


def test_map_criteria_default_to_open(spark):
    frame = spark.createDataFrame(
        [(0, "a", "n", "Central", {"age": "18+"})], "pos int, id string, name string, state string, eligibility map<string,string>")
    row = compile_rules(frame, "lenient").first()
    assert (row.min_age, row.max_age, row.income_open, row.category_open) == (18, 150, True, True)


def test_unknown_dialect(spark):
    with pytest.raises(ValueError):
        rules(spark, "other", scheme(0))
