"""SQL twins of the derived inputs and compiled rules, as named common table expressions."""

from __future__ import annotations

# The English stop words of two letters and more.
_STOP = ", ".join(f"'{w}'" for w in """
me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its
itself they them their theirs themselves what which who whom this that these those am is are was were be been being
have has had having do does did doing an the and but if or because as until while of at by for with about against
between into through during before after above below to from up down in out on off over under again further then once
here there when where why how all any both each few more most other some such no nor not only own same so than too very
can will just don should now cannot could ought would
""".split())


def _vectors(prefix: str, docs: str, key: str, text: str) -> dict[str, tuple[list[str], str]]:
    """Tokens, counts, vocabulary and unit vectors of one corpus."""
    return {
        f"{prefix}_toks": ([docs], f"""
            SELECT {key} AS k, list_filter(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}_]{{2,}}'),
                                           lambda t: t NOT IN ({_STOP})) AS toks FROM {docs}"""),
        f"{prefix}_feats": ([f"{prefix}_toks"], f"""
            SELECT k, unnest(list_concat(toks, list_transform(range(1, len(toks)),
                   lambda i: toks[i] || ' ' || toks[i + 1]))) AS term FROM {prefix}_toks"""),
        f"{prefix}_counts": ([f"{prefix}_feats"], f"SELECT k, term, count(*) AS tf FROM {prefix}_feats GROUP BY k, term"),
        f"{prefix}_vocab": ([f"{prefix}_counts"], f"""
            SELECT term, tf, df, ln((1 + n) / (1 + df)) + 1 AS idf FROM (
              SELECT term, CAST(sum(tf) AS BIGINT) AS tf, count(*) AS df FROM {prefix}_counts GROUP BY term),
              (SELECT count(*) AS n FROM {docs})
            WHERE df <= 0.95 * n ORDER BY tf DESC, term LIMIT 384"""),
        f"{prefix}_vec": ([f"{prefix}_counts", f"{prefix}_vocab"], f"""
            SELECT k, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY k)) AS w FROM (
              SELECT c.k, c.term, c.tf * v.idf AS raw FROM {prefix}_counts c JOIN {prefix}_vocab v USING (term))"""),
    }


def _query_vectors(prefix: str, queries: str, fitted: str) -> dict[str, tuple[list[str], str]]:
    parts = _vectors(prefix, queries, "query_id", "query")
    parts.pop(f"{prefix}_vocab")
    deps, sql = parts[f"{prefix}_vec"]
    parts[f"{prefix}_vec"] = ([f"{prefix}_counts", f"{fitted}_vocab"], sql.replace(f"{prefix}_vocab", f"{fitted}_vocab"))
    return parts


AGE = "trim(c_age, ' \t\n')"
OPEN_BOUND = "('all', 'any', 'no limit')"

VIEWS: dict[str, tuple[list[str], str]] = {
    "profiles": ([], """
        SELECT c_custkey AS user_id, CAST(c_custkey % 90 AS INT) AS age,
          round(abs(c_acctbal) * 120, 0) AS income,
          CASE c_custkey % 5 WHEN 0 THEN 'General' WHEN 1 THEN 'OBC' WHEN 2 THEN 'SC'
                             WHEN 3 THEN 'ST' ELSE 'Minority' END AS category,
          CASE c_mktsegment WHEN 'FURNITURE' THEN 'student' WHEN 'MACHINERY' THEN 'farmer'
            WHEN 'HOUSEHOLD' THEN 'unemployed' WHEN 'AUTOMOBILE' THEN 'self-employed'
            ELSE 'employed' END AS occupation,
          n_name AS state
        FROM customer JOIN nation ON c_nationkey = n_nationkey"""),
    "catalogue": ([], """
        SELECT k AS pos, concat('s-', CAST(k AS VARCHAR)) AS id, p_name || ' ' || p_brand AS name,
          p_brand || ' ' || p_name || ' ' || lower(p_type) AS description,
          p_name || ' ' || lower(p_type) AS keywords,
          CASE k % 8 WHEN 0 THEN 'All' WHEN 1 THEN '18+' WHEN 2 THEN '18-25' WHEN 3 THEN '60+'
            WHEN 4 THEN '16-35' WHEN 5 THEN '< 18' WHEN 6 THEN '21'
            ELSE 'All for disabled, 60+ for others' END AS c_age,
          CASE p_size % 8 WHEN 1 THEN 'BPL families' WHEN 2 THEN '< 2.5 lakh' WHEN 3 THEN '< 5 lakh'
            WHEN 4 THEN '< ₹8,00,000' WHEN 5 THEN 'Low income' WHEN 6 THEN '< 1 crore' ELSE 'All' END AS c_income,
          CASE k % 7 WHEN 0 THEN 'All' WHEN 1 THEN 'SC/ST' WHEN 2 THEN 'OBC'
            WHEN 3 THEN 'Minority communities' WHEN 4 THEN 'General' WHEN 5 THEN 'Small farmers'
            ELSE 'OBC, SC' END AS c_category,
          CASE p_type WHEN 'ECONOMY' THEN 'student' WHEN 'SMALL' THEN 'farmer' WHEN 'MEDIUM' THEN 'entrepreneur'
            WHEN 'PROMO' THEN 'jobless' ELSE 'All' END AS c_occupation,
          string_split(CASE k % 3 WHEN 0 THEN 'Identity card,Income certificate'
            WHEN 1 THEN ' Identity card ,, Marksheet,Identity card' ELSE 'Ration card,   ' END, ',') AS documents,
          CASE WHEN k % 3 = 0 THEN 'Central' ELSE concat('NATION_', CAST(k % 25 AS VARCHAR)) END AS state,
          lower(p_type) AS category, p_size
        FROM (SELECT *, p_partkey AS k FROM part)"""),
    "schemes": (["catalogue"], "SELECT *, name || ' ' || description || ' ' || keywords AS text FROM catalogue"),
    "applications": ([], """
        SELECT DISTINCT o_custkey AS user_id, concat('s-', CAST(l_partkey AS VARCHAR)) AS scheme_id
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""),
    "queries": ([], """
        SELECT query_id, string_agg(word, ' ' ORDER BY r) AS query FROM (
          SELECT query_id, word, row_number() OVER (PARTITION BY query_id ORDER BY count(*) DESC, word) AS r FROM (
            SELECT l_suppkey AS query_id, unnest(list_concat(string_split(p_name, ' '), [lower(p_type), lower(p_brand)])) AS word
            FROM lineitem JOIN part ON l_partkey = p_partkey) GROUP BY query_id, word)
        WHERE r <= 6 GROUP BY query_id"""),
    "passages": ([], "SELECT item_id AS query_id, text AS query FROM benchmark"),
    "synonyms": ([], """
        SELECT * FROM (VALUES ('student', 'student'), ('student', 'pupil'), ('student', 'learner'),
          ('farmer', 'farmer'), ('farmer', 'agriculturist'), ('farmer', 'cultivator'),
          ('unemployed', 'unemployed'), ('unemployed', 'jobless'), ('unemployed', 'seeking employment'),
          ('self-employed', 'self-employed'), ('self-employed', 'entrepreneur'), ('self-employed', 'business owner'),
          ('employed', 'employed'), ('employed', 'working'), ('employed', 'job holder')) AS s(key, word)"""),
    "strict": (["catalogue"], f"""
        SELECT pos, id, name, state,
          CASE WHEN lower({AGE}) IN {OPEN_BOUND} THEN NULL
            WHEN regexp_matches(c_age, '\\d+-\\d+') THEN CAST(regexp_extract(c_age, '(\\d+)-(\\d+)', 1) AS INT)
            WHEN regexp_matches(c_age, '\\d+\\+') THEN CAST(regexp_extract(c_age, '(\\d+)\\+', 1) AS INT)
            WHEN regexp_matches(c_age, '<\\s*\\d+') THEN NULL
            WHEN regexp_full_match({AGE}, '\\d+') THEN CAST({AGE} AS INT) END AS min_age,
          CASE WHEN lower({AGE}) IN {OPEN_BOUND} THEN NULL
            WHEN regexp_matches(c_age, '\\d+-\\d+') THEN CAST(regexp_extract(c_age, '(\\d+)-(\\d+)', 2) AS INT)
            WHEN regexp_matches(c_age, '\\d+\\+') THEN NULL
            WHEN regexp_matches(c_age, '<\\s*\\d+') THEN CAST(regexp_extract(c_age, '<\\s*(\\d+)', 1) AS INT) - 1
            WHEN regexp_full_match({AGE}, '\\d+') THEN CAST({AGE} AS INT) END AS max_age,
          CASE WHEN lower(trim(c_income)) IN {OPEN_BOUND} THEN NULL
            WHEN regexp_matches(c_income, '(?i)bpl|below\\s+poverty\\s+line') THEN 150000.0
            WHEN regexp_matches(c_income, '(?i)apl|above\\s+poverty\\s+line') THEN NULL
            WHEN regexp_matches(c_income, '(?i)<\\s*\\d+(\\.\\d+)?\\s*lakh')
              THEN CAST(regexp_extract(c_income, '(?i)<\\s*(\\d+(?:\\.\\d+)?)\\s*lakh', 1) AS DOUBLE) * 100000
            WHEN regexp_matches(c_income, '<\\s*₹?\\s*\\d+')
              THEN CAST(replace(regexp_extract(c_income, '<\\s*₹?\\s*(\\d+(?:,\\d+)*(?:\\.\\d+)?)', 1), ',', '') AS DOUBLE)
            END AS max_income,
          lower(trim(c_category)) AS category_text,
          list_transform(string_split(replace(lower(trim(c_category)), '/', ','), ','), lambda t: trim(t)) AS tokens,
          lower(trim(c_occupation)) AS occupation_text
        FROM catalogue"""),
    "checked": (["pairs", "profiles", "strict", "synonyms"], """
        SELECT p.user_id, r.id AS scheme_id, r.pos, p.age, p.income, lower(p.category) AS cat, lower(p.occupation) AS occ,
          r.min_age, r.max_age, r.max_income, r.category_text, r.tokens, r.occupation_text,
          NOT ((r.min_age IS NOT NULL AND p.age < r.min_age) OR (r.max_age IS NOT NULL AND p.age > r.max_age)) AS age_ok,
          (r.max_income IS NULL OR p.income <= r.max_income) AS income_ok,
          (r.category_text IN ('all', 'any', 'general') OR list_contains(r.tokens, lower(p.category))
            OR (contains(r.category_text, 'sc/st') AND p.category IN ('SC', 'ST'))
            OR (contains(r.category_text, 'minority') AND p.category = 'Minority')) AS category_ok,
          (r.occupation_text IN ('all', 'any', 'no restriction') OR r.occupation_text = lower(p.occupation)
            OR (r.occupation_text, lower(p.occupation)) IN (SELECT (key, word) FROM synonyms)
            OR (lower(p.occupation), r.occupation_text) IN (SELECT (key, word) FROM synonyms)) AS occupation_ok
        FROM pairs x JOIN profiles p ON x.user_id = p.user_id JOIN strict r ON x.scheme_id = r.id"""),
    "scored": (["checked"], """
        SELECT *, round(
            CASE WHEN age_ok THEN 25.0 WHEN age < min_age AND min_age - age <= 5 THEN 25.0 * (1 - (min_age - age) / 10)
                 WHEN age > max_age AND age - max_age <= 5 THEN 25.0 * (1 - (age - max_age) / 10) ELSE 0.0 END
          + CASE WHEN income_ok THEN 25.0 WHEN max_income / income >= 0.8 THEN 25.0 * (max_income / income) ELSE 0.0 END
          + CASE WHEN category_ok THEN 25.0 ELSE 0.0 END + CASE WHEN occupation_ok THEN 25.0 ELSE 0.0 END, 1) AS match_score
        FROM checked"""),
    "reasons": (["scored"], """
        SELECT *, 'age ' || age || ': ' || CASE
              WHEN min_age IS NULL AND max_age IS NULL THEN 'no age limit'
              WHEN age < min_age THEN 'under the minimum of ' || min_age
              WHEN age > max_age THEN 'over the maximum of ' || max_age
              WHEN max_age IS NULL THEN 'at least ' || min_age
              WHEN min_age IS NULL THEN 'at most ' || max_age
              ELSE 'inside ' || min_age || '-' || max_age END AS age_why,
          'income ' || format('{:,.0f}', income) || ': ' || CASE WHEN max_income IS NULL THEN 'no income limit'
              WHEN income_ok THEN 'within ' || format('{:,.0f}', max_income)
              ELSE 'over ' || format('{:,.0f}', max_income) END AS income_why,
          'category ' || cat || ': ' || CASE WHEN category_text IN ('all', 'any', 'general') THEN 'open to all'
              WHEN list_contains(tokens, cat) THEN 'listed'
              WHEN category_ok AND cat = 'minority' THEN 'covered by the minority rule'
              WHEN category_ok THEN 'covered by SC/ST'
              ELSE 'not among ' || category_text END AS category_why,
          'occupation ' || occ || ': ' || CASE WHEN occupation_text IN ('all', 'any', 'no restriction') THEN 'open to all'
              WHEN occ = occupation_text THEN 'as required'
              WHEN occupation_ok THEN 'counts as ' || occupation_text
              ELSE 'rule asks for ' || occupation_text END AS occupation_why
        FROM scored"""),
    "explained": (["reasons"], """
        SELECT *, CASE len(bad) WHEN 0 THEN 'All criteria met: ' || array_to_string(good, ', ') || '.'
            WHEN 1 THEN 'Most criteria met (' || array_to_string(good, ', ') || '), except ' || bad[1] || '.'
            ELSE 'Criteria not met: ' || array_to_string(bad, '; ') || '.' END AS reason
        FROM (SELECT *,
            list_filter([CASE WHEN age_ok THEN age_why END, CASE WHEN income_ok THEN income_why END,
              CASE WHEN category_ok THEN category_why END, CASE WHEN occupation_ok THEN occupation_why END],
              lambda x: x IS NOT NULL) AS good,
            list_filter([CASE WHEN NOT age_ok THEN age_why END, CASE WHEN NOT income_ok THEN income_why END,
              CASE WHEN NOT category_ok THEN category_why END, CASE WHEN NOT occupation_ok THEN occupation_why END],
              lambda x: x IS NOT NULL) AS bad
          FROM reasons)"""),
    "lenient": (["catalogue"], """
        SELECT *, lower(c_category) AS category_text, lower(c_occupation) AS occupation_text,
          CASE WHEN lower(c_age) = 'all' OR len(nums) = 0 THEN 0 ELSE CAST(nums[1] AS INT) END AS min_age,
          CASE WHEN lower(c_age) = 'all' OR len(nums) = 0 OR contains(c_age, '+') THEN 150
            WHEN len(nums) >= 2 THEN CAST(nums[2] AS INT) ELSE CAST(nums[1] AS INT) END AS max_age,
          CASE WHEN lower(c_income) = 'all' THEN 999999999
            WHEN contains(lower(c_income), 'bpl') OR contains(lower(c_income), 'low income') THEN 200000
            WHEN amount = '' THEN 999999999
            ELSE CAST(trunc(CAST(amount AS DOUBLE) * CASE WHEN contains(lower(c_income), 'lakh') THEN 100000
                 WHEN contains(lower(c_income), 'crore') THEN 10000000 ELSE 1 END) AS BIGINT) END AS max_income
        FROM (SELECT *, regexp_extract_all(c_age, '\\d+') AS nums,
                regexp_extract(c_income, '\\d+\\.?\\d*') AS amount FROM catalogue)"""),
    "matched": (["profiles", "lenient"], """
        SELECT p.user_id, p.age, p.income, p.category AS ucat, p.occupation AS uocc, p.state AS ustate,
          r.id AS scheme_id, r.pos, r.name, r.min_age, r.max_age, r.max_income, r.c_age, r.c_income, r.c_occupation,
          r.category_text, r.occupation_text, r.state AS rstate,
          p.age BETWEEN r.min_age AND r.max_age AS age_in, p.income <= r.max_income AS income_in,
          r.category_text = 'all' OR contains(r.category_text, lower(p.category)) AS cat_named,
          r.occupation_text = 'all' OR contains(r.occupation_text, lower(p.occupation)) AS occ_in,
          lower(r.state) = 'central' AS central,
          lower(r.state) = 'central' OR lower(r.state) = lower(p.state) AS place_in
        FROM profiles p, lenient r"""),
    "fitting": (["matched"], """
        SELECT * FROM matched WHERE age_in AND income_in AND (cat_named OR contains(category_text, 'all'))
          AND occ_in AND place_in"""),
    "fit_scores": (["fitting"], """
        SELECT *, round(least(
            CASE WHEN lower(c_age) = 'all' THEN 10.0 ELSE (1 - least(abs(age - (min_age + max_age) / 2)
                 / CASE WHEN max_age > min_age THEN max_age - min_age ELSE 1 END, 1.0)) * 20 END
          + CASE WHEN max_income >= 999999999 THEN 15.0 WHEN max_income > 0
                 THEN (1 - least(income / max_income, 1.0)) * 30 ELSE 0.0 END
          + CASE WHEN category_text = 'all' THEN 15.0 WHEN cat_named THEN 25.0 ELSE 0.0 END
          + CASE WHEN occupation_text = 'all' THEN 15.0 WHEN occ_in THEN 25.0 ELSE 0.0 END, 100.0), 2) AS match_score
        FROM fitting"""),
    "near_misses": (["matched", "fitting"], """
        SELECT user_id, scheme_id, name, pos, reason, CAST(rank AS INT) AS rank FROM (
          SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY central DESC,
                 contains(occupation_text, lower(uocc)) DESC, pos) AS rank,
            'Related programme' || CASE WHEN why = '' THEN '' ELSE ': ' || why END AS reason
          FROM (SELECT *, array_to_string(list_filter([
                  CASE WHEN NOT income_in THEN 'income a little above ' || c_income END,
                  CASE WHEN NOT occ_in THEN 'meant for ' || c_occupation END,
                  CASE WHEN NOT place_in THEN 'offered in ' || rstate END], lambda x: x IS NOT NULL), ', ') AS why
                FROM matched m
                WHERE age_in AND cat_named AND income <= max_income * 1.3
                  AND (user_id, name) NOT IN (SELECT (user_id, name) FROM fitting)))
        WHERE rank <= 5"""),
    "op_log": ([], """
        SELECT event_id, ts, user_id, event_type AS operation, value * 10 AS duration_ms,
          event_type <> 'error' AS success, props FROM events"""),
    **_vectors("d", "documents", "doc_id", "text"),
    **_query_vectors("b", "passages", "d"),
    **_vectors("s", "schemes", "id", "text"),
    **_query_vectors("q", "queries", "s"),
    "scheme_sims": (["q_vec", "s_vec", "catalogue"], """
        SELECT query_id, scheme_id, similarity, pos FROM (
          SELECT q.k AS query_id, s.k AS scheme_id, round(least(sum(q.w * s.w), 1.0), 4) AS similarity
          FROM q_vec q JOIN s_vec s USING (term) GROUP BY q.k, s.k) JOIN catalogue ON id = scheme_id
        WHERE similarity > 0"""),
    "doc_sims": (["b_vec", "d_vec"], """
        SELECT b.k AS query_id, d.k AS doc_id, round(least(sum(b.w * d.w), 1.0), 4) AS similarity
        FROM b_vec b JOIN d_vec d USING (term) GROUP BY b.k, d.k HAVING round(sum(b.w * d.w), 4) > 0"""),
}


def sql(body: str, *views: str, **extra: str) -> str:
    """``body`` with the named views (and what they need) in front. ``extra`` adds or replaces views."""
    known = {**VIEWS, **{name: ([], text) for name, text in extra.items()}}
    ordered: list[str] = []

    def need(name: str) -> None:
        if name in ordered or name not in known:
            return
        for other in known[name][0]:
            need(other)
        ordered.append(name)

    for name in views:
        need(name)
    return "WITH " + ", ".join(f"{n} AS ({known[n][1]})" for n in ordered) + " " + body if ordered else body
