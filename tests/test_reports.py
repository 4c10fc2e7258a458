import hashlib
import json

import pytest
from pyspark.sql import functions as F

from entitle.functions import privacy as P
from entitle.operators import oplogs as L
from entitle.operators import responses as R
from tests.helpers import catalogue, rows, scheme

ITEM = "user_id long, rank int, scheme_id string, name string, description string, reason string, documents array<string>, match_score double"


def inputs(spark):
    users = spark.createDataFrame([(1, "english"), (2, "hindi"), (3, "odia"), (4, "english")], "user_id long, language string")
    items = spark.createDataFrame([
        (1, 2, "s-1", "B", "d2", "r2", ["x"], 75.0), (1, 1, "s-2", "A", "d1", "r1", ["x", "y"], 95.84),
        (2, 1, "s-1", "B", "d2", "r2", ["x"], 75.0), (3, 1, "s-1", "B", "d2", "r2", [], 75.0)], ITEM)
    return users, items


def test_responses(spark):
    users, items = inputs(spark)
    found = {r.user_id: r for r in R.format_responses(users, items).collect()}
    assert found[1].response == (
        "You may qualify for 2 programmes:\n\n1. **A**\n   What it offers: d1\n   Why: r1\n   Bring: x, y\n\n"
        "2. **B**\n   What it offers: d2\n   Why: r2\n   Bring: x")
    assert found[2].response.startswith("आप 1 ") and "कारण: r2" in found[2].response
    assert found[3].response.startswith("You may qualify for 1 ")
    assert found[4].item_count == 0 and found[4].response == R.TEMPLATES["english"]["none"]
    assert R.response_metrics(R.format_responses(users, items)).where("user_id = 4").first().response_length > 0


def test_fingerprints_prompts_and_stored_responses(spark):
    users, items = inputs(spark)
    prints = dict(rows(R.fingerprints(users, items), "user_id", "fingerprint"))
    assert prints[1] == hashlib.md5(b"s-1:75.0-s-2:95.8-english").hexdigest()
    assert len(prints) == 3 and len(set(prints.values())) == 3
    stored = spark.createDataFrame([(prints[2], "kept")], "fingerprint string, response string")
    source = {u: (r, s) for u, r, s in rows(R.resolve_responses(users, items, stored), "user_id", "response", "source")}
    assert source[2] == ("kept", "stored") and source[1][1] == "template" and source[4][1] == "no_match"
    made = dict(rows(R.prompts(users, items), "user_id", "prompt"))
    assert made[2].startswith("Answer in Hindi. ") and made[1].endswith("1. A | d1 | r1 | x, y\n2. B | d2 | r2 | x")
    text = R.explain_items(catalogue(spark, scheme(0))).first().explanation
    assert text.startswith("1. **scheme 0**") and text.endswith("Bring: Card")


def test_translations(spark):
    texts = spark.createDataFrame([("a", "Hindi"), ("a", "Hindi"), ("b", "hindi"), ("c", "English"), ("d", "en"), ("e", "fr")], "text string, language string")
    known = spark.createDataFrame([("b", "hindi", "B!")], "text string, language string, translation string")
    assert sorted(rows(R.translation_backlog(texts, known), "text", "language", "code")) == [("a", "Hindi", "hi"), ("e", "fr", "fr")]
    applied = sorted(rows(R.apply_translations(texts, known), "text", "result", "translated"))
    assert ("b", "B!", True) in applied and ("c", "c", False) in applied and len(applied) == 6


REDACTIONS = {
    "api_key=abcdefghij0123456789XYZ": "api_key=***REDACTED***",
    'API-KEY: "abcdefghij0123456789"': 'API-KEY: "***REDACTED***"',
    "Bearer abc.def-ghi_0123456789xx": "Bearer ***REDACTED***",
    "password=hunter22 ok": "password=***REDACTED*** ok",
    "password=short": "password=short",
    "mail bob.x@site.org now": "mail ***EMAIL_REDACTED*** now",
    "éa@site.org": "éa@site.org",
    "call 9876543210": "call***PHONE_REDACTED***",
    "id 1234-5678-9012.": "id ***AADHAAR_REDACTED***.",
    "pan ABCDE1234F": "pan ***PAN_REDACTED***",
    "card 1234-5678-9012-3456": "card ***AADHAAR_REDACTED***-3456",
    "card 1234123412341234": "card ***CREDIT_CARD_REDACTED***",
    # the phone pattern has no word boundary and runs first
    "card 1234567890123456": "card 12345***PHONE_REDACTED***6",
}


def test_redaction_order_and_masks(spark):
    frame = spark.createDataFrame([(t,) for t in REDACTIONS], "t string")
    found = dict(rows(frame.select("t", P.redact_text(F.col("t")).alias("r")), "t", "r"))
    assert found == REDACTIONS


def test_key_redaction(spark):
    text = '{"Company":"a","note":"b","n":{"Phone":"1","deep":{"token":"2","x":"3"}},"list":["' + "y" * 101 + '",{"email":"q"}]}'
    frame = spark.createDataFrame([(text,)], "t string")
    loose = json.loads(frame.select(P.redact_json(F.col("t"))).first()[0])
    masked = "***REDACTED***"
    assert loose == {"Company": masked, "note": "b", "n": {"Phone": masked, "deep": {"token": masked, "x": "3"}},
                     "list": ["y" * 100 + "...[truncated]", {"email": masked}]}
    exact = json.loads(frame.select(P.redact_json(F.col("t"), exact=True)).first()[0])
    assert exact["Company"] == "a" and exact["n"] == {"Phone": "1", "deep": {"token": masked, "x": "3"}}
    assert exact["list"] == ["y" * 101, {"email": "q"}]
    assert frame.select(P.shorten(F.lit("z" * 120))).first()[0] == "z" * 100 + "...[truncated]"


@pytest.mark.parametrize("depth", [1, 2, 3, 4, 5, 6, 400])
def test_nested_secrets_are_masked_at_any_depth(spark, depth):
    secret = {"password": "hunter22", "k": 7, "z": True, "none": None, "f": 1.5}
    in_maps = in_lists = secret
    for _ in range(depth - 1):
        in_maps, in_lists = {"a": in_maps}, [in_lists]
    frame = spark.createDataFrame([(json.dumps(x),) for x in (in_maps, in_lists)], "t string")
    for row, whole in zip(frame.select(P.redact_json(F.col("t"))).collect(), (in_maps, in_lists)):
        found, given = json.loads(row[0]), whole
        for _ in range(depth - 1):
            found, given = (found["a"], given["a"]) if isinstance(found, dict) else (found[0], given[0])
        assert found == {**given, "password": "***REDACTED***"}


def test_odd_json(spark):
    frame = spark.createDataFrame([(1, None), (2, "no json"), (3, "[" * 100_000 + "]" * 100_000), (4, '"' + "x" * 150 + '"'), (5, "7")], "i int, t string")
    found = dict(rows(frame.select("i", P.redact_json(F.col("t")).alias("r")), "i", "r"))
    assert found[1] is None and found[2] is None and found[4] == '"' + "x" * 100 + '...[truncated]"' and found[5] == "7"
    assert found[3] in ('"***REDACTED***"', "[" * 100_000 + "]" * 100_000)


def test_logs(spark):
    log = spark.createDataFrame([("a", 1000.0, True), ("a", 1000.1, False), ("b", 500.1, True), ("b", 500.0, True)],
                                "operation string, duration_ms double, success boolean")
    assert sorted(rows(L.duration_classes(log), "operation", "class", "calls")) == [
        ("a", "moderate", 1), ("a", "slow", 1), ("b", "moderate", 1), ("b", "normal", 1)]
    assert sorted(rows(L.service_summary(log, percentile=0.95), "service", "calls", "failures")) == [("a", 2, 1), ("b", 2, 0)]
    line = L.structured_rows(log.limit(1), ["operation"], {"message": F.lit("x@y.org"), "user_id": F.lit(None).cast("string")}).first()
    assert line.json == '{"message":"***EMAIL_REDACTED***"}'
