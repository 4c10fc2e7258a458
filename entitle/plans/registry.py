"""Every registered query with, where SQL can say it, its twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from entitle.functions import privacy as P
from entitle.functions import scoring as S
from entitle.functions import vectors as VF
from entitle.functions.strings import display_name, searchable_text
from entitle.operators import bounds as B
from entitle.operators import catalogue as C
from entitle.operators import eligibility as E
from entitle.operators import errors as ERR
from entitle.operators import keywords as K
from entitle.operators import neighbours as N
from entitle.operators import oplogs as L
from entitle.operators import responses as R
from entitle.operators import reuse as U
from entitle.operators import search as Q
from entitle.operators import tfidf as T
from entitle.operators import upkeep as UP
from entitle.operators import validate as V
from entitle.operators.joins import spread
from entitle.operators.rules import compile_rules
from entitle.operators.suppress import suppressed
from entitle.plans import fixtures as X
from entitle.plans.oracle_views import sql
from entitle.session import truncate_lineage
from entitle.sources.catalogue_io import as_json, parsed, verify_written

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
TTL_SECONDS = 86400
TEST_STATES = [f"NATION_{i}" for i in range(25)] + ["Central"]
TEST_CATEGORIES = ["economy", "small", "medium", "promo", "standard"]


def register(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        QUERIES[name] = query
        if oracle is not None:
            ORACLES[name] = oracle
        return query
    return add


def _strict(spark, d):
    return compile_rules(X.catalogue(spark, d), "strict")


def _lenient(spark, d):
    return compile_rules(X.catalogue(spark, d), "lenient")


def _schemes(spark, d):
    return X.catalogue(spark, d).withColumn("text", searchable_text("name", "description", "keywords"))


def _with_vectors(spark, d):
    own = X.table(spark, d, "embeddings").select(F.col("vec_id").alias("pos"), "embedding")
    return X.catalogue(spark, d).join(own, "pos", "left")


# --- sources ---------------------------------------------------------------------------------

@register("s7_rows_as_json", sql("""
    SELECT id, to_json({'id': id, 'name': name, 'state': state}) AS json FROM catalogue""", "catalogue"))
def _(spark, d):
    return as_json(X.catalogue(spark, d).select("id", "name", "state"), "id")


def _catalogue_texts(spark, d):
    """Catalogue documents as JSON texts, by size and block of parts; every 13th part lacks its papers."""
    c = X.catalogue(spark, d)
    papers = F.when(F.col("pos") % 13 == 0, F.array(F.lit(" "))).otherwise(F.col("documents"))
    part = X.table(spark, d, "part").select(F.col("p_partkey").alias("pos"), "p_size")
    scheme = F.struct("id", "name", "description", "eligibility", papers.alias("documents"), "state", "category", "keywords")
    block = F.floor(F.col("pos") / 1000)  # so many programmes a document at most
    listed = F.array_sort(F.collect_list(F.struct("pos", scheme.alias("s"))))["s"]
    return (c.join(part, "pos").groupBy("p_size", block.alias("block")).agg(listed.alias("schemes"))
            .select(F.format_string("part-%05d-%012d", "p_size", "block").alias("file"), F.to_json(F.struct("schemes")).alias("json")))


_LOADED = """
    SELECT id, row_number() OVER (ORDER BY p_size, pos) - 1 AS pos, pos % 13 <> 0 AS valid FROM catalogue"""


@register("s1_parse_catalogue", sql(_LOADED, "catalogue"))
def _(spark, d):
    checked = V.validate_catalogue(parsed(_catalogue_texts(spark, d)), TEST_STATES, [*TEST_CATEGORIES, "large"])
    return checked.select("id", "pos", "valid")


@register("s6_load_report", sql("""
    SELECT count(*) AS source_rows, count(*) FILTER (valid) AS written_rows, count(*) = count(*) FILTER (valid) AS matches
    FROM loaded""", "catalogue", "loaded", loaded=_LOADED))
def _(spark, d):
    rows = parsed(_catalogue_texts(spark, d))
    return verify_written(V.validate_catalogue(rows, TEST_STATES, [*TEST_CATEGORIES, "large"]).where("valid"), rows)


# --- validation ------------------------------------------------------------------------------

def _bad_profiles(spark, d):
    k = F.col("user_id")
    return (X.profiles(spark, d).withColumn("age", F.col("age") - 5)
            .withColumn("occupation", F.when(k % 7 == 0, "  ").otherwise(F.concat(F.lit(" "), F.upper("occupation"))))
            .withColumn("category", F.when(k % 7 == 1, "Other").otherwise(F.col("category")))
            .withColumn("state", F.when(k % 7 == 2, F.lit(None)).otherwise(F.col("state"))))


_BAD = """
    SELECT user_id, age - 5 AS age, income, CASE WHEN user_id % 7 = 1 THEN 'Other' ELSE category END AS category,
      CASE WHEN user_id % 7 = 0 THEN '  ' ELSE ' ' || upper(occupation) END AS occupation,
      coalesce(CASE WHEN user_id % 7 = 2 THEN NULL ELSE state END, 'Karnataka') AS state FROM profiles"""
_BAD_RULES = """
    SELECT user_id, 'age' AS field, 'must be between 0 and 120' AS message, CAST(age AS VARCHAR) AS invalid_value,
      'integer' AS expected_type FROM bad WHERE age NOT BETWEEN 0 AND 120
    UNION ALL SELECT user_id, 'category', 'not a known social category', category, 'enum' FROM bad
      WHERE category NOT IN ('General', 'OBC', 'SC', 'ST', 'Minority')
    UNION ALL SELECT user_id, 'occupation', 'must have 1 to 100 characters and not be blank', occupation, 'string'
      FROM bad WHERE trim(occupation) = '' OR length(occupation) > 100
    UNION ALL SELECT user_id, 'state', 'not a known state', state, 'enum' FROM bad
      WHERE state <> 'Central' AND NOT starts_with(state, 'NATION_')"""


@register("v1_validate_profiles", sql("""
    SELECT b.user_id, lower(trim(occupation)) AS occupation, state, count(f.field) AS n_errors, count(f.field) = 0 AS valid
    FROM bad b LEFT JOIN flaws f ON b.user_id = f.user_id GROUP BY b.user_id, occupation, state""",
    "profiles", "bad", "flaws", bad=_BAD, flaws=_BAD_RULES))
def _(spark, d):
    checked = V.validate_profiles(_bad_profiles(spark, d), states=TEST_STATES)
    return checked.select("user_id", "occupation", "state", F.size("errors").cast("bigint").alias("n_errors"), "valid")


@register("v10_violation_report", sql("SELECT * FROM flaws", "profiles", "bad", "flaws", bad=_BAD, flaws=_BAD_RULES))
def _(spark, d):
    return V.violations(V.validate_profiles(_bad_profiles(spark, d), states=TEST_STATES), "user_id")


def _blank_criteria(spark, d):
    e, k = F.col("eligibility"), F.col("pos")
    return X.catalogue(spark, d).withColumn("eligibility", F.struct(
        F.when(k % 11 == 0, "  ").otherwise(F.concat(F.lit(" "), e["age"])).alias("age"),
        F.when(k % 13 == 0, "").otherwise(e["income"]).alias("income"),
        e["category"].alias("category"), e["occupation"].alias("occupation")))


@register("v2_validate_criteria", sql("""
    SELECT id, CASE WHEN pos % 11 = 0 THEN '' ELSE c_age END AS age, pos % 11 <> 0 AND pos % 13 <> 0 AS valid,
      array_to_string(list_filter([CASE WHEN pos % 11 = 0 THEN 'eligibility.age' END,
        CASE WHEN pos % 13 = 0 THEN 'eligibility.income' END], lambda x: x IS NOT NULL), ',') AS fields
    FROM catalogue""", "catalogue"))
def _(spark, d):
    checked = V.validate_criteria(_blank_criteria(spark, d))
    return checked.select("id", F.col("eligibility.age").alias("age"), "valid",
                          F.array_join("errors.field", ",").alias("fields"))


@register("v3_validate_catalogue", sql("""
    SELECT id, array_to_string(list_filter([CASE WHEN category = 'large' THEN 'category' END,
        CASE WHEN embedding IS NOT NULL AND label > 4 THEN 'embedding' END], lambda x: x IS NOT NULL), ',') AS fields
    FROM catalogue LEFT JOIN embeddings ON vec_id = pos""", "catalogue"))
def _(spark, d):
    label = F.col("label")
    own = X.table(spark, d, "embeddings").select(
        F.col("vec_id").alias("pos"), F.when(label > 4, F.slice("embedding", 1, 60)).otherwise(F.col("embedding")).alias("embedding"))
    rows = X.catalogue(spark, d).join(own, "pos", "left")
    checked = V.validate_catalogue(rows, TEST_STATES, TEST_CATEGORIES, dim=64)
    return checked.select("id", F.array_join("errors.field", ",").alias("fields"))


@register("v4_clean_documents", sql("""
    SELECT id, CASE pos % 3 WHEN 0 THEN 'Identity card|Income certificate' WHEN 1 THEN 'Identity card|Marksheet'
      ELSE 'Ration card' END AS documents FROM catalogue""", "catalogue"))
def _(spark, d):
    return X.catalogue(spark, d).select("id", F.array_join(V.clean_documents(F.col("documents")), "|").alias("documents"))


@register("v5_validate_searches", sql("""
    SELECT item_id AS query_id, coalesce(CAST(nullif(item_id % 23, 7) AS INT), 5) AS top_k,
      array_to_string(list_filter([CASE WHEN length(text) > 500 THEN 'query' END,
        CASE WHEN coalesce(nullif(item_id % 23, 7), 5) NOT BETWEEN 1 AND 20 THEN 'top_k' END,
        CASE WHEN item_id % 3 = 2 THEN 'language' END], lambda x: x IS NOT NULL), ',') AS fields
    FROM benchmark"""))
def _(spark, d):
    k = F.col("query_id") % 23
    requests = (X.text_queries(spark, d).withColumn("top_k", F.when(k != 7, k.cast("int")))
                .withColumn("language", F.when(F.col("query_id") % 3 == 0, "hindi")
                            .when(F.col("query_id") % 3 == 2, "klingon")))
    return V.validate_searches(requests).select("query_id", "top_k", F.array_join("errors.field", ",").alias("fields"))


@register("v5_validate_format_requests", sql("""
    SELECT c_custkey AS user_id, count(o_orderkey) AS n_items, count(o_orderkey) > 0 AS valid
    FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey"""))
def _(spark, d):
    # the orders of a customer are the items of one request
    orders = X.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("user_id")).agg(
        F.collect_list("o_orderkey").alias("items"))
    requests = X.profiles(spark, d).select("user_id").join(orders, "user_id", "left").select(
        "user_id", F.coalesce("items", F.array().cast("array<bigint>")).alias("items"), F.lit("english").alias("language"))
    return V.validate_format_requests(requests).select("user_id", F.size("items").cast("bigint").alias("n_items"), "valid")


@register("v6_validate_browse_requests", sql("""
    SELECT p_partkey AS request_id, array_to_string(list_filter([CASE WHEN p_size + 5 > 50 THEN 'limit' END,
        CASE WHEN p_partkey % 10 < 2 THEN 'offset' END, CASE WHEN p_type = 'LARGE' THEN 'category' END],
        lambda x: x IS NOT NULL), ',') AS fields FROM part"""))
def _(spark, d):
    requests = X.table(spark, d, "part").select(
        F.col("p_partkey").alias("request_id"), (F.col("p_size") + 5).alias("limit"),
        (F.col("p_partkey") % 10 - 2).cast("int").alias("offset"), F.lower("p_type").alias("category"),
        F.lit(None).cast("string").alias("state"))
    checked = V.validate_browse_requests(requests, TEST_CATEGORIES, TEST_STATES)
    return checked.select("request_id", F.array_join("errors.field", ",").alias("fields"))


@register("v7_missing_profile_keys", sql("""
    SELECT user_id, CASE WHEN user_id % 5 = 0 THEN 'income,state' WHEN user_id % 5 = 1 THEN 'age' ELSE '' END AS missing
    FROM profiles""", "profiles"))
def _(spark, d):
    k = F.col("user_id") % 5
    names = ["age", "income", "category", "occupation", "state"]
    full = F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*[F.col(n).cast("string") for n in names]))
    given = F.map_filter(full, lambda key, _: ~(((k == 0) & key.isin("income", "state")) | ((k == 1) & (key == "age"))))
    return X.profiles(spark, d).select("user_id", F.array_join(V.missing_keys(given), ",").alias("missing"))


@register("v8_required_fields", sql("""
    SELECT field, missing, total, missing = 0 AS compliant FROM (
      SELECT count(*) AS total, count(*) - count(embedding) AS embedding, count(*) - count(name) AS name,
        count(*) - count(description) AS description FROM catalogue LEFT JOIN embeddings ON vec_id = pos)
    UNPIVOT (missing FOR field IN (embedding, name, description))""", "catalogue"))
def _(spark, d):
    return V.null_report(_with_vectors(spark, d), ["embedding", "name", "description"])


@register("v9_stated_counts", sql("""
    SELECT id, pos % 10 <> 0 AS matches FROM catalogue""", "catalogue"))
def _(spark, d):
    stated = X.catalogue(spark, d).withColumn("stated", F.size("documents") + F.when(F.col("pos") % 10 == 0, 1).otherwise(0))
    return stated.select("id", V.count_matches("documents", "stated").alias("matches"))


@register("v11_classify_errors", """
    SELECT event_id, CASE event_type WHEN 'error' THEN 503 WHEN 'click' THEN 404 WHEN 'view' THEN 429 ELSE 500 END AS status,
      CASE WHEN value > 20 THEN 'CRITICAL' WHEN value > 10 THEN 'WARNING' WHEN value > 5 THEN 'INFO' ELSE 'ERROR' END AS level
    FROM events""")
def _(spark, d):
    kind, value = F.col("event_type"), F.col("value")
    coded = X.table(spark, d, "events").select(
        "event_id",
        F.when(kind == "error", "EXTERNAL_SERVICE_ERROR").when(kind == "click", "SCHEME_NOT_FOUND")
        .when(kind == "view", "RATE_LIMIT_EXCEEDED").otherwise("SOMETHING_ELSE").alias("code"),
        F.when(value > 20, "critical").when(value > 10, "medium").when(value > 5, "low").alias("severity"))
    return ERR.classify_errors(coded).select("event_id", "status", "level")


# --- lookups and browsing --------------------------------------------------------------------

@register("f1_lookup_latest", sql("""
    SELECT r.id, coalesce(later.name, first.name) AS name
    FROM (SELECT 's-' || CAST(s_suppkey * 30 AS VARCHAR) AS id FROM supplier) r
    LEFT JOIN catalogue first ON first.id = r.id
    LEFT JOIN (SELECT id, upper(name) AS name FROM catalogue WHERE p_size > 25) later ON later.id = r.id""", "catalogue"))
def _(spark, d):
    catalogue = X.catalogue(spark, d)
    big = X.table(spark, d, "part").where("p_size > 25").select(F.col("p_partkey").alias("pos"))
    # a second load follows the first: its positions come after all others
    revised = catalogue.join(big, "pos", "left_semi").select("id", F.upper("name").alias("name"), (2 * F.col("pos") + 1).alias("pos"))
    loads = catalogue.select("id", "name", (2 * F.col("pos")).alias("pos")).unionByName(revised)
    ids = X.table(spark, d, "supplier").select(F.concat(F.lit("s-"), (F.col("s_suppkey") * 30).cast("string")).alias("id"))
    return C.lookup(loads, ids).select("id", "name")


@register("f2_by_category", sql("SELECT id, name FROM catalogue WHERE category = 'economy'", "catalogue"))
def _(spark, d):
    return C.by_category(X.catalogue(spark, d), "economy").select("id", "name")


@register("f3_by_state", sql("SELECT id, name FROM catalogue WHERE state = 'Central'", "catalogue"))
def _(spark, d):
    return C.by_state(X.catalogue(spark, d), "Central").select("id", "name")


@register("f4_filter_catalogue", sql("""
    SELECT id, name FROM catalogue WHERE category = 'standard' AND state = 'Central'
      AND lower(c_occupation) IN ('all', 'farmer')""", "catalogue"))
def _(spark, d):
    return C.filter_catalogue(X.catalogue(spark, d), "standard", "Central", "Farmer").select("id", "name")


@register("f5_occupation_index", sql("""
    SELECT 'all' AS occupation, id FROM catalogue
    UNION ALL SELECT lower(c_occupation), id FROM catalogue WHERE lower(c_occupation) <> 'all'""", "catalogue"))
def _(spark, d):
    return C.occupation_index(X.catalogue(spark, d))


@register("f6_f7_browse_page", sql("""
    SELECT id, total_available, 25 < total_available AS has_more, CAST(100.0 AS DOUBLE) AS match_score,
      'Not assessed while browsing' AS reason, false AS is_eligible
    FROM (SELECT *, count(*) OVER () AS total_available FROM catalogue WHERE category = 'small')
    ORDER BY pos LIMIT 20 OFFSET 5""", "catalogue"))
def _(spark, d):
    page = C.browse(X.catalogue(spark, d), category="small", limit=20, offset=5)
    return page.select("id", "total_available", "has_more", "match_score", "reason", "is_eligible")


@register("f8_display_names", """
    SELECT DISTINCT lower(p_type) || '_' || split_part(p_name, ' ', 1) AS category,
      upper(p_type[1]) || lower(p_type[2:]) || ' ' || upper(p_name[1]) || split_part(p_name, ' ', 1)[2:] AS display_name
    FROM part""")
def _(spark, d):
    raw = F.concat_ws("_", F.lower("p_type"), F.split_part("p_name", F.lit(" "), F.lit(1)))
    return X.table(spark, d, "part").select(raw.alias("category")).distinct().withColumn(
        "display_name", display_name(F.col("category")))


@register("f9_jurisdiction_counts", sql("""
    SELECT user_id, p.state, count(c.id) AS programmes FROM profiles p LEFT JOIN catalogue c
      ON lower(c.state) = 'central' OR lower(c.state) = lower(p.state) GROUP BY user_id, p.state""", "profiles", "catalogue"))
def _(spark, d):
    return E.jurisdiction_counts(X.profiles(spark, d), X.catalogue(spark, d))


@register("f6_browse_requests", sql("""
    SELECT request_id, id, place, total_available, off + lim < total_available AS has_more FROM (
      SELECT r.request_id, r.lim, r.off, c.id, row_number() OVER w AS place, count(*) OVER (PARTITION BY r.request_id) AS total_available
      FROM asked r JOIN catalogue c ON (r.category IS NULL OR c.category = r.category) AND (r.state IS NULL OR c.state = r.state)
      WINDOW w AS (PARTITION BY r.request_id ORDER BY c.pos)) WHERE place > off AND place <= off + lim""", "catalogue", "asked", asked="""
    SELECT s_suppkey AS request_id, s_suppkey % 50 + 1 AS lim, s_suppkey * 7 % 40 AS off,
      CASE WHEN s_suppkey % 2 = 0 THEN 'small' END AS category, CASE WHEN s_suppkey % 3 = 0 THEN 'Central' END AS state FROM supplier"""))
def _(spark, d):
    k = F.col("s_suppkey")
    requests = X.table(spark, d, "supplier").select(
        k.alias("request_id"), (k % 50 + 1).alias("limit"), (k * 7 % 40).alias("offset"),
        F.when(k % 2 == 0, "small").alias("category"), F.when(k % 3 == 0, "Central").alias("state"))
    return C.browse_requests(X.catalogue(spark, d), requests)


# --- rule compilation ------------------------------------------------------------------------

@register("p2_p4_p5_strict_rules", sql("""
    SELECT id, coalesce(min_age, -1) AS min_age, coalesce(max_age, -1) AS max_age, coalesce(max_income, -1.0) AS max_income,
      array_to_string(tokens, '|') AS tokens FROM strict""", "strict"))
def _(spark, d):
    bounds = [F.coalesce(c, F.lit(-1)).alias(c) for c in ("min_age", "max_age", "max_income")]
    return _strict(spark, d).select("id", *bounds, F.array_join("category_tokens", "|").alias("tokens"))


@register("p1_p3_lenient_rules", sql("SELECT id, min_age, max_age, max_income FROM lenient", "lenient"))
def _(spark, d):
    return _lenient(spark, d).select("id", "min_age", "max_age", "max_income")


@register("p6_occupation_synonyms", sql("""
    SELECT c.id, w.word FROM catalogue c JOIN (
        SELECT key AS rule, word FROM synonyms UNION SELECT word, key FROM synonyms
        UNION SELECT DISTINCT lower(c_occupation), lower(c_occupation) FROM catalogue) w ON w.rule = lower(c.c_occupation)
    """, "catalogue", "synonyms"))
def _(spark, d):
    return _strict(spark, d).select("id", F.explode("occupation_keys").alias("word"))


# --- eligibility -----------------------------------------------------------------------------

@register("e1_eligible_pairs", sql("SELECT user_id, scheme_id FROM fitting", "fitting"))
def _(spark, d):
    pairs = E.eligible_pairs(X.profiles(spark, d), _lenient(spark, d))
    return pairs.select("user_id", F.col("r_id").alias("scheme_id"))


_FIT_REASON = """'Qualifies: ' || array_to_string(list_filter([
      CASE WHEN lower(c_age) <> 'all' THEN 'age ' || age || ' fits ' || c_age END,
      CASE WHEN lower(c_income) <> 'all' THEN 'income ' || format('{:,.0f}', income) || ' fits ' || c_income END,
      CASE WHEN cat_named THEN 'category ' || ucat || ' accepted' END,
      'occupation ' || uocc || ' accepted',
      CASE WHEN central THEN 'central programme, valid in ' || ustate ELSE 'programme of ' || ustate END],
      lambda x: x IS NOT NULL), ', ')"""


@register("e2_e3_e4_eligible_list", sql(f"""
    SELECT user_id, scheme_id, match_score, {_FIT_REASON} AS reason,
      CAST(row_number() OVER (PARTITION BY user_id ORDER BY match_score DESC, pos) AS INT) AS rank
    FROM fit_scores""", "fit_scores"))
def _(spark, d):
    listed = E.eligible_list(X.profiles(spark, d), _lenient(spark, d))
    return listed.select("user_id", "scheme_id", "match_score", "reason", "rank")


@register("e5_relaxed_recommendations", sql(
    "SELECT user_id, scheme_id, name, reason, rank FROM near_misses", "near_misses"))
def _(spark, d):
    near = E.relaxed_recommendations(X.profiles(spark, d), _lenient(spark, d))
    return near.select("user_id", "scheme_id", "name", "reason", "rank")


@register("e6_eligibility_report", sql("""
    SELECT p.user_id, coalesce(f.n, 0) AS eligible_count, f.best_scheme, f.best_score, coalesce(m.n, 0) AS recommended_count,
      coalesce(f.listed, '') AS eligible, coalesce(m.listed, '') AS recommended, (SELECT count(*) FROM catalogue) AS catalogue_total
    FROM profiles p
    LEFT JOIN (SELECT user_id, count(*) AS n, arg_max(scheme_id, (match_score, -pos)) AS best_scheme,
                 max(match_score) AS best_score, array_to_string(list(scheme_id ORDER BY match_score DESC, pos)[:10], ',') AS listed
               FROM fit_scores GROUP BY user_id) f ON f.user_id = p.user_id
    LEFT JOIN (SELECT user_id, count(*) AS n, string_agg(scheme_id, ',' ORDER BY rank) AS listed
               FROM near_misses GROUP BY user_id) m ON m.user_id = p.user_id""",
    "fit_scores", "near_misses"))
def _(spark, d):
    report = E.eligibility_report(X.profiles(spark, d), _lenient(spark, d))
    report = report.withColumn("eligible", F.array_join("eligible.scheme_id", ","))
    return report.withColumn("recommended", F.coalesce(F.array_join("recommended.scheme_id", ","), F.lit("")))


@register("e7_criterion_checks", sql("""
    SELECT user_id, scheme_id, age_ok, income_ok, category_ok, occupation_ok, age_why, income_why, category_why, occupation_why
    FROM reasons""", "applications", "reasons", pairs="SELECT * FROM applications"))
def _(spark, d):
    assessed = E.assess_pairs(X.applications(spark, d), X.profiles(spark, d), _strict(spark, d))
    return assessed.select(
        "user_id", "scheme_id", S.age_ok().alias("age_ok"), S.income_ok().alias("income_ok"),
        S.category_ok().alias("category_ok"), S.occupation_ok().alias("occupation_ok"),
        S.age_reason().alias("age_why"), S.income_reason().alias("income_why"),
        S.category_reason().alias("category_why"), S.occupation_reason().alias("occupation_why"))


@register("e8_e9_e10_assess_applications", sql("""
    SELECT user_id, scheme_id, match_score, match_score >= 75 AS is_eligible, reason,
      CAST(row_number() OVER (PARTITION BY user_id ORDER BY match_score DESC, pos) AS INT) AS rank FROM explained""", "applications", "explained", pairs="SELECT * FROM applications"))
def _(spark, d):
    assessed = E.assess_pairs(X.applications(spark, d), X.profiles(spark, d), _strict(spark, d))
    return assessed.select("user_id", "scheme_id", "match_score", "is_eligible", "reason", "rank")


_ALL_PAIRS = "SELECT user_id, id AS scheme_id FROM profiles, catalogue"


@register("e11_recommendations", sql("""
    SELECT user_id, scheme_id, match_score, match_score >= 75 AS is_eligible, CAST(rank AS INT) AS rank FROM (
      SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY match_score DESC, pos) AS rank
      FROM scored WHERE match_score >= 25) WHERE rank <= 5""", "profiles", "catalogue", "scored", pairs=_ALL_PAIRS))
def _(spark, d):
    return E.recommend(X.profiles(spark, d), _strict(spark, d))


@register("e12_eligible_and_recommended", sql("""
    SELECT user_id, section, CAST(rank AS INT) AS rank, scheme_id, match_score,
      count(*) OVER (PARTITION BY user_id, section) AS section_total FROM (
      SELECT *, row_number() OVER (PARTITION BY user_id, section ORDER BY match_score DESC, pos) AS rank FROM (
        SELECT *, CASE WHEN match_score >= 75 THEN 'eligible' ELSE 'recommended' END AS section
        FROM scored WHERE match_score >= 25))
    WHERE rank <= CASE section WHEN 'eligible' THEN 10 ELSE 5 END""", "profiles", "catalogue", "scored", pairs=_ALL_PAIRS))
def _(spark, d):
    return E.eligible_and_recommended(X.profiles(spark, d), _strict(spark, d))


# --- text ------------------------------------------------------------------------------------

@register("t1_searchable_text", sql("""
    SELECT id, text AS text, name || ' | ' || description || ' | ' || keywords AS piped FROM schemes""", "schemes"))
def _(spark, d):
    return _schemes(spark, d).select("id", "text", searchable_text("name", "description", "keywords", separator=" | ").alias("piped"))


@register("t2_word_counts", """
    SELECT doc_id, word, count(*) AS tf FROM (
      SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[\\s\\p{Z}\\x0b\\x1c-\\x1f\\x{85}]+')) AS word FROM documents)
    WHERE word <> '' GROUP BY doc_id, word""")
def _(spark, d):
    return T.word_counts(X.corpus(spark, d))


@register("t3_positional_weights", """
    WITH words AS (SELECT item_id AS query_id, list_filter(regexp_split_to_array(lower(text), '[\\s\\p{Z}\\x0b\\x1c-\\x1f\\x{85}]+'), lambda w: w <> '') AS ws
                   FROM benchmark),
      placed AS (SELECT query_id, unnest(ws) AS word, unnest(range(len(ws))) AS position FROM words),
      totals AS (SELECT word, count(*) AS tf FROM (
        SELECT unnest(regexp_split_to_array(lower(text), '[\\s\\p{Z}\\x0b\\x1c-\\x1f\\x{85}]+')) AS word FROM documents) GROUP BY word)
    SELECT query_id, CAST(position AS INT) AS position,
      round(coalesce(least(1.0, tf / (SELECT count(*) FROM documents)), 0.0), 6) AS weight
    FROM placed LEFT JOIN totals USING (word) WHERE position < 384""")
def _(spark, d):
    weights = T.positional_weights(X.text_queries(spark, d), X.corpus(spark, d))
    return weights.select("query_id", "position", F.round("weight", 6).alias("weight"))


@register("t4_tokens", sql("""
    SELECT t.k AS doc_id, CAST(len(toks) AS INT) AS n_tokens, md5(array_to_string(toks, ' ')) AS tokens_md5,
      md5(array_to_string(list_transform(range(1, len(toks)), lambda i: toks[i] || ' ' || toks[i + 1]), '|')) AS bigrams_md5
    FROM d_toks t""", "d_toks"))
def _(spark, d):
    return T.tokenised(X.corpus(spark, d)).select(
        "doc_id", F.size("tokens").alias("n_tokens"), F.md5(F.array_join("tokens", " ")).alias("tokens_md5"),
        F.md5(F.array_join("bigrams", "|")).alias("bigrams_md5"))


@register("t5_vocabulary", sql("SELECT term, tf, df, round(idf, 6) AS idf FROM d_vocab", "d_vocab"))
def _(spark, d):
    return T.fit_vocabulary(X.corpus(spark, d)).withColumn("idf", F.round("idf", 6))


@register("t6_tfidf_vectors", sql("SELECT k AS doc_id, term, round(w, 5) AS weight FROM d_vec", "d_vec"))
def _(spark, d):
    return T.build_index(X.corpus(spark, d)).postings.withColumn("weight", F.round("weight", 5))


_DENSE = """
    SELECT s.id, round(coalesce(sum(v.w * p.place), 0.0), 4) AS checksum, CAST(384 AS INT) AS dims
    FROM schemes s LEFT JOIN s_vec v ON v.k = s.id
    LEFT JOIN (SELECT term, row_number() OVER (ORDER BY term) AS place FROM s_vocab) p ON p.term = v.term GROUP BY s.id"""


def _checksum(vector):
    total = F.aggregate(F.transform(vector, lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return F.round(total, 4).alias("checksum")


@register("t7_catalogue_vectors", sql(_DENSE, "schemes", "s_vec"))
def _(spark, d):
    schemes = _schemes(spark, d)
    vectors = T.embed_catalogue(schemes, T.fit_vocabulary(schemes, "id"))
    return vectors.select("id", _checksum(F.col("vector")), F.size("vector").alias("dims"))


@register("t8_backfill_vectors", sql("""
    SELECT s.id, embedding IS NULL AS added, CAST(CASE WHEN embedding IS NULL THEN 384 ELSE 64 END AS INT) AS dims,
      CASE WHEN embedding IS NULL THEN d.checksum
           ELSE round(list_sum(list_transform(embedding, lambda x, i: CAST(x AS DOUBLE) * i)), 4) END AS checksum
    FROM schemes s JOIN dense d ON d.id = s.id LEFT JOIN embeddings ON vec_id = s.pos""",
    "schemes", "s_vec", "dense", dense=_DENSE))
def _(spark, d):
    schemes = _schemes(spark, d)
    existing = _with_vectors(spark, d).where(F.col("embedding").isNotNull()).select("id", F.col("embedding").alias("vector"))
    filled = T.backfill(existing, schemes, T.fit_vocabulary(schemes, "id"))
    return filled.select("id", "added", F.size("vector").alias("dims"), _checksum(F.col("vector")))


@register("t8_index_in_steps", sql("SELECT k AS doc_id, term, round(w, 5) AS weight FROM d_vec", "d_vec"))
def _(spark, d):
    """The corpus comes language by language, one of them twice, and ends as the index of all."""
    docs, english = X.corpus(spark, d), F.coalesce(F.col("lang") == "en", F.lit(False))
    steps = [UP.added(docs.where(english)), UP.added(docs.where(~english))]
    steps.append(UP.removed(docs.where(english).select("doc_id"), steps))
    steps = [UP.merged(steps[:2]), *steps[2:], UP.added(docs.where(english))]
    return UP.index_of(steps).postings.withColumn("weight", F.round("weight", 5))


@register("t9_fit_length", """
    SELECT vec_id, CAST(100 AS INT) AS padded_dims, CAST(embedding[40] AS DOUBLE) AS cut_last, CAST(0.0 AS DOUBLE) AS padded_last
    FROM embeddings""")
def _(spark, d):
    v = F.col("embedding")
    padded, cut = VF.fit_length(v, 100), VF.fit_length(v, 40)
    return X.table(spark, d, "embeddings").select(
        "vec_id", F.size(padded).alias("padded_dims"), F.element_at(cut, -1).alias("cut_last"),
        F.element_at(padded, -1).alias("padded_last"))


# --- search ----------------------------------------------------------------------------------

def _centroid_sql(value: str) -> str:
    return f"""WITH parts AS (SELECT label, i, avg(CAST(x AS DOUBLE)) AS m FROM (
        SELECT label, unnest(embedding) AS x, unnest(range(len(embedding))) AS i FROM embeddings) GROUP BY label, i),
      centres AS (SELECT CAST(label AS VARCHAR) AS category, list(m ORDER BY i) AS c FROM parts GROUP BY label) {value}"""


_COS = "list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), c.c)"


@register("q1_cosine_to_centroid", _centroid_sql(f"""
    SELECT vec_id, round({_COS}, 4) AS raw, round(greatest({_COS}, 0.0), 4) AS clipped
    FROM embeddings e JOIN centres c ON c.category = CAST(e.label AS VARCHAR)"""))
def _(spark, d):
    items = X.vectors(spark, d)
    both = items.join(Q.centroids(items).withColumnRenamed("vector", "centre"), "category")
    v, c = F.col("vector"), F.col("centre")
    return both.select(F.col("item_id").alias("vec_id"), F.round(VF.cosine(v, c), 4).alias("raw"),
                       F.round(VF.cosine(v, c, clip=True), 4).alias("clipped"))


def _dense_sql(where: str) -> str:
    return _centroid_sql(f"""
    SELECT query_id, item_id, similarity, CAST(rank AS INT) AS rank FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, item_id) AS rank FROM (
        SELECT c.category AS query_id, e.vec_id AS item_id, round({_COS}, 4) AS similarity
        FROM embeddings e, centres c {where}) WHERE similarity >= 0.1) WHERE rank <= 5""")


@register("q2_dense_top_k", _dense_sql(""))
def _(spark, d):
    items = X.vectors(spark, d)
    queries = Q.centroids(items).withColumnRenamed("category", "query_id")
    return Q.dense_search(queries, items, threshold=Q.API_THRESHOLD, category="no such category")


@register("q2_dense_top_k_in_category", _dense_sql("WHERE e.label = 3"))
def _(spark, d):
    items = X.vectors(spark, d)
    queries = Q.centroids(items).withColumnRenamed("category", "query_id")
    return Q.dense_search(queries, items, threshold=Q.API_THRESHOLD, category="3")


@register("q3_similarity_matrix", sql("SELECT * FROM doc_sims", "doc_sims"))
def _(spark, d):
    docs = X.corpus(spark, d)
    index = T.build_index(docs)
    return Q.similarities(Q.query_vectors(X.text_queries(spark, d), index.vocabulary), index.postings, n_items=docs.count())


@register("q3_similar_pairs", sql("SELECT query_id, doc_id, similarity FROM doc_sims WHERE similarity >= 0.3", "doc_sims"))
def _(spark, d):
    index = T.build_index(X.corpus(spark, d))
    queries = truncate_lineage(Q.query_vectors(X.text_queries(spark, d), index.vocabulary))
    return B.similar_pairs(queries, index.postings, Q.LIBRARY_THRESHOLD).withColumnRenamed("item", "doc_id")


@register("q3_passages_in_corpus_top_k", sql("""
    SELECT query_id, doc_id, similarity, CAST(rank AS INT) AS rank FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, doc_id) AS rank
      FROM doc_sims WHERE similarity >= 0.3) WHERE rank <= 5""", "doc_sims"))
def _(spark, d):
    docs = X.corpus(spark, d)
    index = T.build_index(docs)
    return Q.search(X.text_queries(spark, d), docs, index.vocabulary, postings=index.postings)


def _search_inputs(spark, d):
    schemes = _schemes(spark, d)
    return (X.scheme_queries(spark, d), schemes, T.build_index(schemes, "pos"), X.profiles(spark, d))


_SIM_PAIRS = "SELECT query_id AS user_id, scheme_id FROM scheme_sims WHERE similarity >= {t}"


def _ranked_sql(order: str, k: int, threshold: float, where: str = "") -> str:
    return f"""SELECT query_id, scheme_id, similarity, match_score, combined, CAST(rank AS INT) AS rank FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {order} DESC, pos) AS rank FROM (
        SELECT s.query_id, s.scheme_id, s.similarity, s.pos, x.match_score,
          round((s.similarity * 100 + x.match_score) / 2, 3) AS combined
        FROM scheme_sims s JOIN scored x ON x.user_id = s.query_id AND x.scheme_id = s.scheme_id
        JOIN catalogue c ON c.id = s.scheme_id WHERE s.similarity >= {threshold} {where})) WHERE rank <= {k}"""


_RESULT = ["query_id", "scheme_id", "similarity", "match_score", "combined", "rank"]


@register("q4_batch_search", sql(_ranked_sql("similarity", 5, 0.3), "scheme_sims", "scored",
                                 pairs=_SIM_PAIRS.format(t=0.3)))
def _(spark, d):
    return Q.search_batch(*_search_inputs(spark, d), _strict(spark, d)).select(*_RESULT)


@register("q5_combined_search", sql(_ranked_sql("combined", 5, 0.1), "scheme_sims", "scored",
                                    pairs=_SIM_PAIRS.format(t=0.1)))
def _(spark, d):
    return Q.search_combined(*_search_inputs(spark, d), _strict(spark, d)).select(*_RESULT)


@register("q6_filtered_search", sql(
    _ranked_sql("combined", 5, 0.1, "AND c.category = 'economy' AND c.state = 'Central'"), "scheme_sims", "scored",
    pairs=_SIM_PAIRS.format(t=0.1)))
def _(spark, d):
    found = Q.search_combined(*_search_inputs(spark, d), _strict(spark, d), category="economy", state="Central")
    return found.select(*_RESULT)


_SIMILAR = """
    SELECT id, similar_id, similarity, CAST(rank AS INT) AS rank FROM (
      SELECT *, row_number() OVER (PARTITION BY id ORDER BY similarity DESC, pos) AS rank FROM (
        SELECT a.k AS id, b.k AS similar_id, round(least(sum(a.w * b.w), 1.0), 4) AS similarity
        FROM s_vec a JOIN s_vec b ON a.term = b.term AND a.k <> b.k GROUP BY a.k, b.k)
      JOIN (SELECT id AS other, pos FROM catalogue) ON other = similar_id
      WHERE similarity >= 0.4) WHERE rank <= 3"""


def _similar(spark, d):
    schemes = _schemes(spark, d)
    index = T.build_index(schemes, "id")
    return schemes, Q.similar_items(index.postings, schemes, index.vocabulary)


@register("q7_similar_items", sql(_SIMILAR, "s_vec", "catalogue"))
def _(spark, d):
    return _similar(spark, d)[1]


_SIMILAR_VECTORS = """
    SELECT query_id, item_id, similarity, CAST(rank AS INT) AS rank FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, item_id) AS rank FROM (
        SELECT a.vec_id AS query_id, b.vec_id AS item_id,
          round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 4) AS similarity
        FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id) WHERE similarity >= 0.4) WHERE rank <= 3"""


@register("q7_similar_vectors", _SIMILAR_VECTORS)
def _(spark, d):
    items = X.vectors(spark, d).select("item_id", "vector")
    return Q.nearest(items.withColumnRenamed("item_id", "query_id"), items, 3, Q.SIMILAR_THRESHOLD, exclude_same=True)


@register("q7_similar_vectors_indexed", _SIMILAR_VECTORS)
def _(spark, d):
    items = X.vectors(spark, d).select("item_id", "vector")
    return N.search(items.withColumnRenamed("item_id", "query_id"), N.build_inverted_file(items), 3, Q.SIMILAR_THRESHOLD, exclude_same=True)


@register("q7_similar_vectors_probed")
def _(spark, d):
    items = X.vectors(spark, d).select("item_id", "vector")
    index = N.build_inverted_file(items)
    probes = N.probes_for(index, 3, Q.SIMILAR_THRESHOLD, 0.95, exclude_same=True)
    queries = items.withColumnRenamed("item_id", "query_id")
    return N.search(queries, index, 3, Q.SIMILAR_THRESHOLD, exact=False, probes=probes, exclude_same=True)


@register("q8_item_details", sql("""
    SELECT c.id, c.name, coalesce(string_agg(s.similar_id, ',' ORDER BY s.rank), '') AS similar
    FROM catalogue c LEFT JOIN sims s ON s.id = c.id GROUP BY c.id, c.name""", "s_vec", "catalogue", "sims", sims=_SIMILAR))
def _(spark, d):
    schemes, similar = _similar(spark, d)
    details = Q.item_details(schemes, similar)
    return details.select("id", "name", F.array_join("similar.similar_id", ",").alias("similar"))


_SOFT = """
    SELECT x.*, c_occupation = 'All' OR lower(c_occupation) = lower(occupation) AS occ_fit,
      age <> 0 AND contains(c_age, 'All') AS age_fit, income <> 0 AND contains(c_income, 'All') AS income_fit
    FROM {pairs} x JOIN profiles p ON p.user_id = x.user_id
    JOIN (SELECT id AS scheme_id, c_age, c_income, c_occupation FROM catalogue) c ON c.scheme_id = x.scheme_id"""
_FIT = """round(CASE WHEN occ_fit THEN 0.4 ELSE 0.0 END + CASE WHEN age_fit THEN 0.3 ELSE 0.0 END
      + CASE WHEN income_fit THEN CAST(0.3 AS DOUBLE) ELSE 0.0 END, 2)"""


@register("q9_two_stage_search", sql(f"""
    SELECT query_id, scheme_id, similarity, fit, combined, CAST(rank AS INT) AS rank FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY combined DESC, first_rank) AS rank FROM (
        SELECT *, {_FIT} AS fit, round(similarity * 0.7 + {_FIT} * 0.3, 5) AS combined FROM soft)) WHERE rank <= 5""",
    "scheme_sims", "profiles", "catalogue", "firsts", "soft",
    firsts="""SELECT query_id AS user_id, query_id, scheme_id, similarity, first_rank FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, pos) AS first_rank
      FROM scheme_sims WHERE similarity >= 0.3) WHERE first_rank <= 10""",
    soft=_SOFT.format(pairs="firsts")))
def _(spark, d):
    found = Q.two_stage_search(*_search_inputs(spark, d))
    return found.select("query_id", "scheme_id", "similarity", "fit", "combined", "rank")


@register("q10_soft_fit", sql(f"""
    SELECT user_id, scheme_id, {_FIT} AS fit, array_to_string(list_filter([CASE WHEN occ_fit THEN 'occupation' END,
      CASE WHEN age_fit THEN 'age' END, CASE WHEN income_fit THEN 'income' END], lambda x: x IS NOT NULL), ',') AS matches
    FROM soft""", "profiles", "catalogue", "applications", "soft", soft=_SOFT.format(pairs="applications")))
def _(spark, d):
    fitted = Q.soft_fit_pairs(X.applications(spark, d), X.profiles(spark, d), X.catalogue(spark, d))
    return fitted.withColumn("matches", F.array_join("matches", ","))


_KEYWORDS = """
    SELECT query_id, doc_id, matches, CAST(rank AS INT) AS rank FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY matches DESC, doc_id) AS rank FROM (
        SELECT query_id, doc_id, CAST(sum(times) AS BIGINT) AS matches FROM (
            SELECT query_id, term, count(*) AS times FROM (
              SELECT item_id AS query_id, unnest(regexp_split_to_array(lower(text), '[\\s\\p{Z}\\x0b\\x1c-\\x1f\\x{85}]+')) AS term FROM benchmark)
            WHERE term <> '' GROUP BY query_id, term) q
          JOIN (SELECT doc_id, lower(text) AS body FROM documents) t ON contains(t.body, q.term)
        GROUP BY query_id, doc_id)) WHERE rank <= 10"""


@register("q11_keyword_search", _KEYWORDS)
def _(spark, d):
    return Q.keyword_search(X.text_queries(spark, d), X.corpus(spark, d))


@register("q11_keyword_search_catalogue", sql("""
    SELECT query_id, scheme_id, CAST(matches AS BIGINT) AS matches, CAST(rank AS INT) AS rank FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY matches DESC, pos) AS rank FROM (
        SELECT query_id, id AS scheme_id, pos, len(list_filter(string_split(lower(query), ' '),
          lambda t: contains(lower(text), t))) AS matches FROM queries, schemes) WHERE matches > 0) WHERE rank <= 10""",
    "queries", "schemes"))
def _(spark, d):
    found = Q.keyword_search(X.scheme_queries(spark, d), _schemes(spark, d), item_id="id", order="pos")
    return found.select("query_id", F.col("id").alias("scheme_id"), "matches", "rank")


@register("q11_indexed_keyword_search", _KEYWORDS)
def _(spark, d):
    found = K.indexed_keyword_search(X.text_queries(spark, d), K.build_keyword_index(X.corpus(spark, d)))
    return found.withColumnRenamed("item_id", "doc_id")


@register("q12_category_centroids", _centroid_sql("""
    SELECT category, CAST(i AS INT) AS place, round(x, 6) AS mean FROM (
      SELECT category, unnest(c) AS x, unnest(range(len(c))) AS i FROM centres)"""))
def _(spark, d):
    centres = Q.centroids(X.vectors(spark, d))
    return centres.select("category", F.posexplode("vector").alias("place", "mean")).withColumn("mean", F.round("mean", 6))


@register("q13_mentions", """
    WITH items AS (SELECT conv_id AS pos, lower(text[1:10]) AS piece FROM conversations WHERE turn = 0),
      messages AS (SELECT conv_id, turn, lower(text) AS body FROM conversations WHERE role = 'user')
    SELECT conv_id, turn, coalesce(min(i.pos), (SELECT min(pos) FROM items)) AS pos, min(i.pos) IS NOT NULL AS matched
    FROM messages m LEFT JOIN items i ON contains(m.body, i.piece) GROUP BY conv_id, turn""")
def _(spark, d):
    chat = X.table(spark, d, "conversations")
    items = chat.where("turn = 0").select(F.col("conv_id").alias("pos"), F.col("text").alias("name"))
    messages = chat.where("role = 'user'").select(F.struct("conv_id", "turn").alias("message_id"), "text")
    return Q.mentions(messages, items).select("message_id.conv_id", "message_id.turn", "pos", "matched")


# --- statistics ------------------------------------------------------------------------------

@register("a1_count_per_category", sql("SELECT category, count(*) AS count FROM catalogue GROUP BY category", "catalogue"))
def _(spark, d):
    return C.count_by(X.catalogue(spark, d), "category")


@register("a2_count_per_state", sql("SELECT state, count(*) AS count FROM catalogue GROUP BY state", "catalogue"))
def _(spark, d):
    return C.count_by(X.catalogue(spark, d), "state")


@register("a3_category_list", sql("""
    SELECT category, count(*) AS count, upper(category[1]) || category[2:] AS display_name,
      (SELECT count(DISTINCT category) FROM catalogue) AS total_categories FROM catalogue GROUP BY category""", "catalogue"))
def _(spark, d):
    return C.category_list(X.catalogue(spark, d))


@register("a4_catalogue_summary", sql("""
    SELECT count(*) AS total_schemes, count(DISTINCT category) AS categories, count(DISTINCT state) AS states,
      count(embedding) AS schemes_with_embeddings FROM catalogue LEFT JOIN embeddings ON vec_id = pos""", "catalogue"))
def _(spark, d):
    return C.summary(_with_vectors(spark, d))


@register("a5_index_summary", sql("""
    SELECT (SELECT count(*) FROM schemes) AS total_schemes, (SELECT count(DISTINCT k) FROM s_vec) AS schemes_with_embeddings,
      CAST(384 AS INT) AS embedding_dimension, true AS fitted, (SELECT count(*) FROM s_vocab) AS vocabulary_size""",
    "schemes", "s_vec"))
def _(spark, d):
    schemes = _schemes(spark, d)
    index = T.build_index(schemes, "id")
    return Q.index_summary(schemes, index.postings, index.vocabulary)


@register("a6_storage_report", sql("""
    SELECT 'category' AS kind, category AS value, count(*) AS rows, CAST(sum(bytes) AS BIGINT) AS vector_bytes FROM v GROUP BY category
    UNION ALL SELECT 'state', state, count(*), CAST(sum(bytes) AS BIGINT) FROM v GROUP BY state""", "catalogue", "v", v="""
    SELECT category, state, coalesce(len(embedding), 0) * 4 AS bytes FROM catalogue LEFT JOIN embeddings ON vec_id = pos"""))
def _(spark, d):
    return C.storage_report(_with_vectors(spark, d))


_REUSE = f"""
    WITH by_key AS (SELECT user_id, event_type, count(*) AS requests, count(*) FILTER (ts - before < INTERVAL {TTL_SECONDS} SECOND) AS repeats,
        round(count(*) FILTER (ts - before < INTERVAL {TTL_SECONDS} SECOND) / count(*), 4) AS repeat_share
      FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts) AS before FROM events)
      GROUP BY user_id, event_type)"""


@register("a7_reuse_by_key", _REUSE + " SELECT * FROM by_key")
def _(spark, d):
    return U.reuse_by_key(X.table(spark, d, "events"), ["user_id", "event_type"], TTL_SECONDS)


@register("a7_reuse_summary", _REUSE + """
    SELECT count(*) AS keys, CAST(sum(requests) AS BIGINT) AS requests, CAST(sum(repeats) AS BIGINT) AS repeats,
      round(sum(repeats) / sum(requests), 4) AS repeat_share FROM by_key""")
def _(spark, d):
    return U.reuse_summary(U.reuse_by_key(X.table(spark, d, "events"), ["user_id", "event_type"], TTL_SECONDS))


@register("a8_sample", sql("SELECT name, state, category FROM catalogue ORDER BY pos LIMIT 5", "catalogue"))
def _(spark, d):
    return C.sample(X.catalogue(spark, d), ["name", "state", "category"])


# --- responses -------------------------------------------------------------------------------

def _response_inputs(spark, d):
    """Users with a language, and the best ten eligible programmes they applied for."""
    profiles = X.profiles(spark, d)
    best = E.best_pairs(X.applications(spark, d), profiles, _strict(spark, d), 10)
    texts = X.catalogue(spark, d).select(F.col("id").alias("scheme_id"), "name", "description",
                                         V.clean_documents(F.col("documents")).alias("documents"))
    items = best.select("user_id", "rank", "scheme_id", "match_score", "reason").join(texts, "scheme_id")
    k = F.col("user_id") % 3
    users = profiles.select("user_id", F.when(k == 0, "english").when(k == 1, "hindi").otherwise("tamil").alias("language"))
    return users, items


_ITEMS = """
    SELECT x.*, c.name, c.description, CASE c.pos % 3 WHEN 0 THEN 'Identity card, Income certificate'
        WHEN 1 THEN 'Identity card, Marksheet' ELSE 'Ration card' END AS docs FROM (
      SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY match_score DESC, pos) AS rank
      FROM explained WHERE match_score >= 75) x JOIN catalogue c ON c.id = x.scheme_id WHERE rank <= 10"""
_USERS = """
    SELECT user_id, CASE user_id % 3 WHEN 0 THEN 'english' WHEN 1 THEN 'hindi' ELSE 'tamil' END AS language FROM profiles"""
_EN, _HI = R.TEMPLATES["english"], R.TEMPLATES["hindi"]


def _labels(which: int) -> str:
    def part(texts):
        return texts["item"].replace("%d. **%s**", "").split("%s")[which]
    return f"CASE u.language WHEN 'hindi' THEN '{part(_HI)}' ELSE '{part(_EN)}' END"


_RESPONSES = f"""
    SELECT u.user_id, u.language, CAST(count(i.scheme_id) AS INT) AS item_count,
      CASE WHEN count(i.scheme_id) = 0 THEN CASE u.language WHEN 'hindi' THEN '{_HI["none"]}' ELSE '{_EN["none"]}' END
      ELSE replace(CASE u.language WHEN 'hindi' THEN '{_HI["head"]}' ELSE '{_EN["head"]}' END, '%d', CAST(count(*) AS VARCHAR))
        || chr(10) || chr(10) || string_agg(i.rank || '. **' || i.name || '**' || {_labels(0)} || i.description
        || {_labels(1)} || i.reason || {_labels(2)} || i.docs, chr(10) || chr(10) ORDER BY i.rank) END AS response
    FROM users u LEFT JOIN items i ON i.user_id = u.user_id GROUP BY u.user_id, u.language"""
_RESPONSE_VIEWS = ("applications", "explained", "catalogue", "items", "users", "responses")
_RESPONSE_SQL = {"pairs": "SELECT * FROM applications", "items": _ITEMS, "users": _USERS, "responses": _RESPONSES}
_PRINTS = """
    SELECT u.user_id, md5(string_agg(part, '-' ORDER BY part) || '-' || u.language) AS fingerprint
    FROM users u JOIN (SELECT user_id, scheme_id || ':' || printf('%.1f', match_score) AS part FROM items) i
      ON i.user_id = u.user_id GROUP BY u.user_id, u.language"""


@register("r1_r2_r3_responses", sql("SELECT * FROM responses", *_RESPONSE_VIEWS, **_RESPONSE_SQL))
def _(spark, d):
    return R.format_responses(*_response_inputs(spark, d))


@register("r4_explanations", sql("""
    SELECT id, '1. **' || name || '**' || chr(10) || '   What it offers: ' || description || chr(10)
      || '   Why: See the eligibility rules' || chr(10) || '   Bring: ' || array_to_string(documents, ', ') AS explanation
    FROM catalogue""", "catalogue"))
def _(spark, d):
    return R.explain_items(X.catalogue(spark, d))


@register("r5_prompts", sql(f"""
    SELECT u.user_id, CASE u.language WHEN 'hindi' THEN 'Answer in Hindi. ' ELSE '' END || '{R.PROMPT_TASK}' || chr(10)
      || string_agg(i.rank || '. ' || i.name || ' | ' || i.description || ' | ' || i.reason || ' | ' || i.docs, chr(10) ORDER BY i.rank) AS prompt
    FROM users u JOIN items i ON i.user_id = u.user_id GROUP BY u.user_id, u.language""", *_RESPONSE_VIEWS[:-1], **_RESPONSE_SQL))
def _(spark, d):
    return R.prompts(*_response_inputs(spark, d))


@register("r6_fingerprints", sql(_PRINTS, *_RESPONSE_VIEWS[:-1], **_RESPONSE_SQL))
def _(spark, d):
    return R.fingerprints(*_response_inputs(spark, d))


@register("r7_response_metrics", sql("""
    SELECT user_id, item_count, language, CAST(length(response) AS INT) AS response_length FROM responses""",
    *_RESPONSE_VIEWS, **_RESPONSE_SQL))
def _(spark, d):
    return R.response_metrics(R.format_responses(*_response_inputs(spark, d)))


def _translation_inputs(spark, d):
    docs = X.corpus(spark, d)
    languages = F.when(F.col("lang") == "en", "english").when(F.col("lang") == "fr", "hindi").when(
        F.col("lang") == "de", "Tamil").otherwise("odia")
    texts = docs.select("doc_id", "text", languages.alias("language"))
    quality = X.table(spark, d, "labels").where("quality = 1").select("doc_id")
    known = texts.join(quality, "doc_id").groupBy("text", "language").agg(
        F.concat(F.lit("translated:"), F.first("text")).alias("translation"))
    return texts, known


_TRANSLATIONS = {"texts": """
    SELECT doc_id, text, CASE lang WHEN 'en' THEN 'english' WHEN 'fr' THEN 'hindi' WHEN 'de' THEN 'Tamil'
      ELSE 'odia' END AS language FROM documents""",
    "known": "SELECT DISTINCT text, language FROM texts JOIN labels USING (doc_id) WHERE quality = 1"}


@register("r8_translation_backlog", sql("""
    SELECT DISTINCT md5(text) AS text_md5, language, CASE language WHEN 'hindi' THEN 'hi' WHEN 'Tamil' THEN 'ta' ELSE language END AS code
    FROM texts t WHERE language <> 'english' AND NOT EXISTS (
      SELECT 1 FROM known k WHERE k.text = t.text AND k.language = t.language)""", "texts", "known", **_TRANSLATIONS))
def _(spark, d):
    return R.translation_backlog(*_translation_inputs(spark, d)).select(F.md5("text").alias("text_md5"), "language", "code")


@register("r8_apply_translations", sql("""
    SELECT t.doc_id, md5(CASE WHEN t.language <> 'english' AND k.text IS NOT NULL THEN 'translated:' || t.text ELSE t.text END) AS result_md5,
      t.language <> 'english' AND k.text IS NOT NULL AS translated
    FROM texts t LEFT JOIN known k ON k.text = t.text AND k.language = t.language""", "texts", "known", **_TRANSLATIONS))
def _(spark, d):
    return R.apply_translations(*_translation_inputs(spark, d)).select("doc_id", F.md5("result").alias("result_md5"), "translated")


@register("r9_resolve_responses", sql("""
    SELECT r.user_id, p.fingerprint, CASE WHEN p.fingerprint < '8' THEN 'stored text' ELSE r.response END AS response,
      CASE WHEN p.fingerprint < '8' THEN 'stored' WHEN r.item_count = 0 THEN 'no_match' ELSE 'template' END AS source
    FROM responses r LEFT JOIN prints p ON p.user_id = r.user_id""",
    *_RESPONSE_VIEWS, "prints", prints=_PRINTS, **_RESPONSE_SQL))
def _(spark, d):
    users, items = _response_inputs(spark, d)
    stored = R.fingerprints(users, items).where("fingerprint < '8'").select("fingerprint").distinct()
    return R.resolve_responses(users, items, stored.withColumn("response", F.lit("stored text")))


# --- privacy and logs ------------------------------------------------------------------------

@register("l1_redact_text", """
    WITH raw AS (SELECT doc_id, text || ' api_key=' || md5(CAST(doc_id AS VARCHAR)) || ' Password: "' || md5(text) || '"'
        || ' Bearer ' || md5(text) || ' ABCDE1234F' AS t FROM documents),
    a AS (SELECT doc_id, regexp_replace(t, '(?i)(api[_-]?key["'']?\\s*[:=]\\s*["'']?)([a-z0-9_-]{20,})', '\\1***REDACTED***', 'g') AS t FROM raw),
    b AS (SELECT doc_id, regexp_replace(t, '(?i)(bearer\\s+)([a-z0-9_.-]{20,})', '\\1***REDACTED***', 'g') AS t FROM a),
    c AS (SELECT doc_id, regexp_replace(t, '(?i)(password["'']?\\s*[:=]\\s*["'']?)([^"''\\s]{6,})', '\\1***REDACTED***', 'g') AS t FROM b),
    d AS (SELECT doc_id, regexp_replace(t, '\\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Z|a-z]{2,}\\b', '***EMAIL_REDACTED***', 'g') AS t FROM c),
    e AS (SELECT doc_id, regexp_replace(t, '(\\+91|91)?[-.\\s]?[6-9]\\d{9}', '***PHONE_REDACTED***', 'g') AS t FROM d),
    f AS (SELECT doc_id, regexp_replace(t, '\\b\\d{4}[-.\\s]?\\d{4}[-.\\s]?\\d{4}\\b', '***AADHAAR_REDACTED***', 'g') AS t FROM e),
    g AS (SELECT doc_id, regexp_replace(t, '\\b[A-Z]{5}\\d{4}[A-Z]\\b', '***PAN_REDACTED***', 'g') AS t FROM f),
    h AS (SELECT doc_id, regexp_replace(t, '\\b\\d{4}[-.\\s]?\\d{4}[-.\\s]?\\d{4}[-.\\s]?\\d{4}\\b', '***CREDIT_CARD_REDACTED***', 'g') AS t FROM g)
    SELECT doc_id, md5(t) AS redacted_md5, CAST(length(t) AS INT) AS redacted_length FROM h""")
def _(spark, d):
    text = F.concat(F.col("text"), F.lit(" api_key="), F.md5(F.col("doc_id").cast("string")), F.lit(' Password: "'),
                    F.md5("text"), F.lit('"'), F.lit(" Bearer "), F.md5("text"), F.lit(" ABCDE1234F"))
    redacted = spread(X.corpus(spark, d), "doc_id").select("doc_id", P.redact_text(text).alias("t"))
    return redacted.select("doc_id", F.md5("t").alias("redacted_md5"), F.length("t").alias("redacted_length"))


def _tagged_events(spark, d):
    return X.table(spark, d, "events").select("event_id", F.create_map(
        F.lit("Email"), F.col("event_type"), F.lit("company"), F.col("user_id").cast("string"),
        F.lit("auth"), F.col("props"), F.lit("note"), F.col("event_type")).alias("m"))


@register("l2_redact_maps", """
    SELECT event_id, '***REDACTED***' AS email, '***REDACTED***' AS company, event_type AS note,
      event_type AS email_exact, CAST(user_id AS VARCHAR) AS company_exact, '***REDACTED***' AS auth_exact FROM events""")
def _(spark, d):
    events = _tagged_events(spark, d).select("event_id", P.redact_map(F.col("m")).alias("part"),
                                             P.redact_map(F.col("m"), exact=True).alias("exact"))
    return events.select("event_id", F.col("part")["Email"].alias("email"), F.col("part")["company"].alias("company"),
                         F.col("part")["note"].alias("note"), F.col("exact")["Email"].alias("email_exact"),
                         F.col("exact")["company"].alias("company_exact"), F.col("exact")["auth"].alias("auth_exact"))


def _nested(inner: str, deep: str, shut: str) -> str:
    return '{"level":1,"a":{"b":{"c":{"d":{"e":{' + inner + '}}}}},"lists":[[{' + deep + '}],[true,null,1.5]]' + shut + '}'


_SHUT = '"***REDACTED***"'


@register("l2_redact_nested", f"""
    SELECT event_id, replace(replace('{_nested(f'"password":{_SHUT},"n":@', f'"token":{_SHUT},"kept":#', ',"Email":' + _SHUT)}', '@', CAST(event_id AS VARCHAR)),
        '#', replace(props, ': ', ':')) AS masked,
      replace(replace('{_nested(f'"password":{_SHUT},"n":~', '"token":"t","kept":#', ',"Email":"x@y"')}', '~', CAST(event_id AS VARCHAR)),
        '#', replace(props, ': ', ':')) AS exact FROM events""")
def _(spark, d):
    text = _nested('"password":"hunter22","n":@', '"token":"t","kept":#', ',"Email":"x@y"')
    filled = F.replace(F.replace(F.lit(text), F.lit("@y"), F.lit("~y")), F.lit("@"), F.col("event_id").cast("string"))
    filled = F.replace(F.replace(filled, F.lit("~y"), F.lit("@y")), F.lit("#"), F.col("props"))
    return X.table(spark, d, "events").select("event_id", P.redact_json(filled).alias("masked"),
                                              P.redact_json(filled, exact=True).alias("exact"))


@register("l3_duration_classes", sql("""
    SELECT operation, CASE WHEN duration_ms > 1000 THEN 'slow' WHEN duration_ms > 500 THEN 'moderate' ELSE 'normal' END AS class,
      count(*) AS calls, round(avg(duration_ms), 2) AS avg_ms FROM op_log GROUP BY ALL""", "op_log"))
def _(spark, d):
    return L.duration_classes(X.operation_log(spark, d))


@register("l4_service_summary", sql("""
    SELECT operation AS service, count(*) AS calls, count(*) FILTER (NOT success) AS failures,
      round(avg(duration_ms), 2) AS avg_ms, max(duration_ms) AS max_ms FROM op_log GROUP BY operation""", "op_log"))
def _(spark, d):
    return L.service_summary(X.operation_log(spark, d))


@register("l5_structured_rows", sql("""
    SELECT event_id, '{"level":"' || CASE WHEN success THEN 'INFO' ELSE 'WARNING' END || '","message":"' || operation
      || ' by ***EMAIL_REDACTED***"' || CASE WHEN success THEN '' ELSE ',"user_id":"' || user_id || '"' END || '}' AS json
    FROM op_log""", "op_log"))
def _(spark, d):
    log = X.operation_log(spark, d)
    return L.structured_rows(log, ["event_id"], {
        "level": F.when(F.col("success"), "INFO").otherwise("WARNING"),
        "message": F.concat("operation", F.lit(" by user"), F.col("user_id").cast("string"), F.lit("@example.org")),
        "user_id": F.when(~F.col("success"), F.col("user_id").cast("string"))})


@register("x3_rate_violations", """
    SELECT user_id, time_bucket(INTERVAL 1 DAY, ts) AS window_start, count(*) AS requests
    FROM events GROUP BY ALL HAVING count(*) > 5""")
def _(spark, d):
    return L.rate_violations(X.table(spark, d, "events"), limit=5, window="1 day")


@register("x4_slow_per_window", sql("""
    SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, operation, count(*) AS calls,
      count(*) FILTER (duration_ms > 1000) AS slow FROM op_log GROUP BY ALL""", "op_log"))
def _(spark, d):
    return L.slow_per_window(X.operation_log(spark, d))


@register("x5_suppressed_repeats", """
    WITH RECURSIVE firsts AS (
      SELECT user_id, event_type, min(ts) AS ts FROM events GROUP BY ALL
      UNION ALL SELECT f.user_id, f.event_type, (SELECT min(e.ts) FROM events e WHERE e.user_id = f.user_id
          AND e.event_type = f.event_type AND e.ts >= f.ts + INTERVAL 1 DAY) FROM firsts f WHERE f.ts IS NOT NULL)
    SELECT user_id, event_type, CAST(epoch_us(ts) AS BIGINT) AS micros FROM firsts WHERE ts IS NOT NULL""")
def _(spark, d):
    events = X.table(spark, d, "events").select("user_id", "event_type", "ts")
    passed = suppressed(events, ["user_id", "event_type"], TTL_SECONDS)
    return passed.select("user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"))
