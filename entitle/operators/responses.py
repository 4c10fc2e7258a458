"""Response texts for whole tables of users.

``items`` rows are (user_id, rank, scheme_id, name, description, reason, documents, match_score), of which
the first ``n`` by rank are shown, so that no user's list is unbounded; ``users`` rows are (user_id, language).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT_LANGUAGE = "english"
TEMPLATES = {
    "english": {
        "head": "You may qualify for %d programmes:",
        "item": "%d. **%s**\n   What it offers: %s\n   Why: %s\n   Bring: %s",
        "none": "No programme fits this profile yet. A local help desk can check the details with you.",
    },
    "hindi": {
        "head": "आप %d कार्यक्रमों के लिए योग्य हो सकते हैं:",
        "item": "%d. **%s**\n   क्या मिलता है: %s\n   कारण: %s\n   साथ लाएँ: %s",
        "none": "अभी कोई कार्यक्रम इस प्रोफ़ाइल से मेल नहीं खाता। स्थानीय सहायता केंद्र पर जाँच कराएँ।",
    },
}
#: Programmes a response shows by default.
MAX_ITEMS = 50
UNASSESSED = "See the eligibility rules"
# Language names with a translation code.
LANGUAGE_CODES = {"hindi": "hi", "tamil": "ta", "telugu": "te", "bengali": "bn"}
PROMPT_TASK = "Describe these programmes in plain words, one numbered entry each, with benefit, reason and papers."
PROMPT_LANGUAGE = {"hindi": "Answer in Hindi. "}


def template_table(spark: SparkSession) -> DataFrame:
    rows = [(language, t["head"], t["item"], t["none"]) for language, t in TEMPLATES.items()]
    return spark.createDataFrame(rows, "template string, head string, item string, none string")


def with_template(users: DataFrame) -> DataFrame:
    """Adds head, item and none texts of the user's language, English when it has no template."""
    table = F.broadcast(template_table(users.sparkSession))  # one row per language, fixed
    known = F.when(F.col("language").isin(list(TEMPLATES)), F.col("language")).otherwise(DEFAULT_LANGUAGE)
    return users.withColumn("template", known).join(table, "template")


def _fill(template: Column, *values: Column) -> Column:
    """Fill the few language templates; the format text itself must be a constant in each branch."""
    filled = None
    for texts in TEMPLATES.values():
        for text in (texts["head"], texts["item"]):
            if text.count("%") == len(values):
                branch = F.format_string(text, *values)
                filled = F.when(template == text, branch) if filled is None else filled.when(template == text, branch)
    return filled


def format_responses(users: DataFrame, items: DataFrame, n: int = MAX_ITEMS) -> DataFrame:
    """(user_id, language, item_count, response): one numbered text per user, or the no-match text."""
    texted = with_template(users)
    lines = (
        items.where(F.col("rank") <= n).join(texted.select("user_id", F.col("item").alias("_t")), "user_id")
        .select("user_id", "rank", _fill(F.col("_t"), F.col("rank"), F.col("name"), F.col("description"),
                                         F.col("reason"), F.array_join("documents", ", ")).alias("line"))
        .groupBy("user_id")
        .agg(F.array_sort(F.collect_list(F.struct("rank", "line"))).alias("lines"))
        .select("user_id", F.size("lines").alias("item_count"), F.array_join("lines.line", "\n\n").alias("body"))
    )
    full = F.concat(_fill(F.col("head"), F.col("item_count")), F.lit("\n\n"), F.col("body"))
    return (
        texted.join(lines, "user_id", "left").fillna(0, ["item_count"])
        .select("user_id", "language", "item_count",
                F.when(F.col("item_count") == 0, F.col("none")).otherwise(full).alias("response"))
    )


def explain_items(catalogue: DataFrame, language: str = DEFAULT_LANGUAGE) -> DataFrame:
    """(id, explanation): the item text with no assessment."""
    text = TEMPLATES.get(language, TEMPLATES[DEFAULT_LANGUAGE])["item"]
    return catalogue.select("id", F.format_string(
        text, F.lit(1), F.col("name"), F.col("description"), F.lit(UNASSESSED),
        F.array_join("documents", ", ")).alias("explanation"))


def prompts(users: DataFrame, items: DataFrame, n: int = MAX_ITEMS) -> DataFrame:
    """(user_id, prompt) for an offline batch model; users without items get none."""
    line = F.format_string("%d. %s | %s | %s | %s", F.col("rank"), F.col("name"), F.col("description"),
                           F.col("reason"), F.array_join("documents", ", "))
    lines = (items.where(F.col("rank") <= n).select("user_id", "rank", line.alias("line")).groupBy("user_id")
             .agg(F.array_sort(F.collect_list(F.struct("rank", "line"))).alias("lines")))
    lead = F.lit("")
    for language, text in PROMPT_LANGUAGE.items():
        lead = F.when(F.lower("language") == language, F.lit(text)).otherwise(lead)
    prompt = F.concat(lead, F.lit(PROMPT_TASK), F.lit("\n"), F.array_join("lines.line", "\n"))
    return users.join(lines, "user_id").select("user_id", prompt.alias("prompt"))


def fingerprints(users: DataFrame, items: DataFrame, n: int = MAX_ITEMS) -> DataFrame:
    """(user_id, fingerprint): MD5 over the sorted ``id:score`` list and the language."""
    part = F.format_string("%s:%.1f", F.col("scheme_id"), F.col("match_score"))
    lists = items.where(F.col("rank") <= n).groupBy("user_id").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    text = F.concat(F.array_join("parts", "-"), F.lit("-"), F.col("language"))
    return users.join(lists, "user_id").select("user_id", F.md5(text).alias("fingerprint"))


def response_metrics(responses: DataFrame) -> DataFrame:
    return responses.select("user_id", "item_count", "language", F.length("response").alias("response_length"))


def resolve_responses(users: DataFrame, items: DataFrame, stored: DataFrame) -> DataFrame:
    """Stored response by fingerprint, else the template text; ``source`` tells which.

    Fingerprints meet the stored ones before the texts, which are then shuffled by user only."""
    known = stored.select("fingerprint", F.col("response").alias("_stored"))
    prints = fingerprints(users, items).join(known, "fingerprint", "left")
    return (format_responses(users, items).join(prints, "user_id", "left")
            .select("user_id", "fingerprint", F.coalesce("_stored", "response").alias("response"),
                    F.when(F.col("_stored").isNotNull(), "stored")
                    .when(F.col("item_count") == 0, "no_match").otherwise("template").alias("source")))


def language_code(language: Column) -> Column:
    """Code of a language name; other values pass through."""
    result = language
    for name, code in LANGUAGE_CODES.items():
        result = F.when(F.lower(language) == name, code).otherwise(result)
    return result


def _needs_translation() -> Column:
    return ~((F.lower("language") == "english") | (F.col("language") == "en"))


def _text_key() -> Column:
    """Comes first among the join keys: rows are sorted and compared by it, texts only where it agrees."""
    return F.xxhash64("text").alias("_key")


def translation_backlog(texts: DataFrame, known: DataFrame) -> DataFrame:
    """Distinct (text, language, code) that still lack a translation."""
    wanted = texts.where(_needs_translation()).select(_text_key(), "text", "language").distinct()
    open_work = wanted.join(known.select(_text_key(), "text", "language"), ["_key", "language", "text"], "left_anti").drop("_key")
    return open_work.select("text", "language").withColumn("code", language_code(F.col("language")))


def apply_translations(texts: DataFrame, known: DataFrame) -> DataFrame:
    """English passes through, known translations apply, all else keeps its text."""
    found = known.select(_text_key(), "text", "language", "translation")
    joined = texts.withColumn("_key", _text_key()).join(found, ["_key", "language", "text"], "left").drop("_key")
    use = _needs_translation() & F.col("translation").isNotNull()
    return (joined.withColumn("result", F.when(use, F.col("translation")).otherwise(F.col("text")))
            .withColumn("translated", use).drop("translation"))
