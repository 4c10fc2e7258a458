from pyspark.sql import functions as F

from entitle.operators import catalogue as C
from entitle.operators import errors as ERR
from entitle.operators import validate as V
from entitle.schema import CATALOGUE, PROFILE
from tests.helpers import catalogue, rows, scheme


def fields(checked):
    return [tuple(e.field for e in r.errors) for r in checked.collect()]


def test_profiles(spark):
    good = (1, 20, 1.0, "OBC", " Farmer ", None)
    bad = (2, 130, -1.0, "Other", "  ", "Nowhere")
    missing = (3, None, None, None, None, "Goa")
    checked = V.validate_profiles(spark.createDataFrame([good, bad, missing], PROFILE)).orderBy("user_id")
    assert fields(checked) == [(), ("age", "income", "category", "occupation", "state"), ("age", "income", "category", "occupation")]
    valid, rejected = V.split_valid(checked)
    assert rows(valid, "occupation", "state") == [("farmer", "Karnataka")]
    assert valid.count() + rejected.count() == 3
    report = V.violations(checked, "user_id").where("user_id = 2 AND field = 'age'").first()
    assert (report.invalid_value, report.expected_type) == ("130", "integer")


def test_catalogue_rows(spark):
    criteria = ("All", "All", "All", "All")
    frame = spark.createDataFrame([
        ("a", "n", "d", criteria, [" x ", "", "x", "y"], "Goa", "health", "k", None),
        ("", "n" * 201, "", ("", "All", "All", "All"), [" "], "Nowhere", "other", None, [1.0, 2.0]),
        ("c", "n", "d", None, None, "Goa", "health", "k", [1.0, None])], CATALOGUE)
    checked = V.validate_catalogue(frame, dim=2)
    assert fields(checked) == [
        (), ("id", "name", "description", "eligibility.age", "documents", "state", "category", "keywords"),
        ("eligibility.age", "eligibility.income", "eligibility.category", "eligibility.occupation", "documents", "embedding")]
    assert checked.first().documents == ["x", "y"]


def test_requests(spark):
    searches = spark.createDataFrame([(" q ", None, None), ("", 0, "klingon"), ("x" * 501, 20, "hindi")], "query string, top_k int, language string")
    checked = V.validate_searches(searches)
    assert fields(checked) == [(), ("query", "top_k", "language"), ("query",)]
    assert (checked.first().query, checked.first().top_k, checked.first().language) == ("q", 5, "english")
    browse = spark.createDataFrame([(None, None, None, None), (51, -1, "x", "y")], "limit int, offset int, category string, state string")
    assert fields(V.validate_browse_requests(browse)) == [(), ("limit", "offset", "category", "state")]
    formats = spark.createDataFrame([(["a"], None), ([], "klingon")], "items array<string>, language string")
    assert fields(V.validate_format_requests(formats)) == [(), ("items", "language")]


def test_keys_reports_and_codes(spark):
    maps = spark.createDataFrame([({"age": "1", "state": "x"},)], "m map<string,string>")
    assert maps.select(V.missing_keys(F.col("m"))).first()[0] == ["income", "category", "occupation"]
    report = V.null_report(spark.createDataFrame([(None, 1), (2, 1)], "a int, b int"), ["a", "b"])
    assert sorted(rows(report, "field", "missing", "compliant")) == [("a", 1, False), ("b", 0, True)]
    codes = spark.createDataFrame([("RATE_LIMIT_EXCEEDED", "low"), ("NEW", None)], "code string, severity string")
    assert sorted(rows(ERR.classify_errors(codes), "code", "status", "level")) == [("NEW", 500, "ERROR"), ("RATE_LIMIT_EXCEEDED", 429, "INFO")]


def test_lookup_browse_and_counts(spark):
    c = catalogue(spark, *[scheme(i, name=f"n{i}", state="Goa" if i % 2 else "Central") for i in range(7)])
    again = catalogue(spark, scheme(9, name="newer")).withColumn("id", F.lit("s-3"))
    found = C.lookup(c.unionByName(again), spark.createDataFrame([("s-3",), ("none",)], "id string"))
    assert sorted(rows(found, "id", "name"), key=str) == [("none", None), ("s-3", "newer")]
    page = C.browse(c, state="Goa", limit=2, offset=1).collect()
    assert [(r.id, r.total_available, r.has_more) for r in page] == [("s-3", 3, False), ("s-5", 3, False)]
    assert C.browse(c, limit=3).first().has_more
    named = C.category_list(c.withColumn("category", F.lit("social_welfare"))).first()
    assert (named.display_name, named["count"], named.total_categories) == ("Social Welfare", 7, 1)
    assert C.occupation_index(c).count() == 7
