"""Secret scans with a random forest against false positives (operator 5); DataFrame functions only."""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from entitle.llm.shared import keep, table

#: A candidate: so many characters of keys, hashes and numbers.
CANDIDATE = r"[A-Za-z0-9+/_=\-]{16,}"
LEAST_CHARS = 16
#: Words of so many documents at least are the dictionary.
WORD_DOCS = 5
#: Labelled findings that the forest is fitted on, at most; chosen by hash.
TRAIN_ROWS = 20_000
TREES, DEPTH, THRESHOLD, SEED = 20, 6, 0.5, 7
#: Names that stand before a credential.
NAMES = r"(?i)(token|secret|passw|pwd|api|auth|key|credential|private|bearer)"
#: A candidate too: what is quoted after such a name or assigned to it, of 8 characters or more; its closing quote may follow.
#: Groups: all before the value, the name, the value, its quote.
VALUE = "(" + NAMES + (r"[\w.\-]*[\"'`\]]*(?:\s*(?::=|=>|[=:])\s*|\s+(?=[\"'`]))[\"'`]?)"
                       r"((?<=\")[^\"\s][^\"\n]{7,}(?=\")|(?<=')[^'\s][^'\n]{7,}(?=')|(?<=`)[^`\s][^`\n]{7,}(?=`)|[^\s\"'`]{7,}[^\s\"'`,;])([\"'`]?)")
#: Stands before each value while its word is looked for; one in the text is taken for its neighbour OTHER meanwhile.
MARK, OTHER = "\uffff", "\ufffe"
BLANKS = r"[\x20\x09-\x0D]+"
FEATURES = ("length", "digit_share", "upper_share", "changes", "variety", "transition", "coverage", "path", "quoted",
            "assigned", "named", "plain_before")


def dictionary(docs: DataFrame) -> DataFrame:
    """(word, n): lower-case words a-z of all documents with the number of documents that have them."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[a-z]{3,20}"), F.lit(0)))
    return (docs.select(F.explode(words).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
            .where(F.col("n") >= WORD_DOCS))


def transitions(words: DataFrame) -> DataFrame:
    """One row: logs of how often each character of a-z follows each, in the dictionary, as an array of 27 * 27; the
    last place is for all other characters."""
    code = F.transform(F.split("word", ""), lambda c: F.ascii(c) - 97)
    pairs = (words.select("n", code.alias("c"))
             .select("n", F.explode(F.transform(F.sequence(F.lit(0), F.size("c") - 2),
                                                lambda i: F.get("c", i) * 27 + F.get("c", i + 1))).alias("pair")))
    counts = pairs.groupBy("pair").agg(F.sum("n").alias("n"))
    held = counts.agg(F.map_from_entries(F.collect_list(F.struct("pair", "n"))).alias("m"))  # 676 entries at most
    cell = F.transform(F.sequence(F.lit(0), F.lit(27 * 27 - 1)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0)) + 1.0)
    total = F.aggregate("cells", F.lit(0.0), lambda a, x: a + x)
    return held.select(cell.alias("cells")).select(F.transform("cells", lambda x: F.log(x / total)).alias("logs"), F.lit(1).alias("one"))


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, position, word, candidate, before, after): every candidate of every whole text with the words around it."""
    text = F.coalesce("text", F.lit(""))
    words = docs.select("doc_id", text.alias("t"), F.split(text, BLANKS).alias("w"))
    hit = lambda i: (F.char_length(F.get("w", i)) >= LEAST_CHARS) & F.rlike(F.get("w", i), F.lit(CANDIDATE))
    # place and candidate as one string: unions of strings are hashed, and slices of arrays would copy them whole
    at = lambda i, c: F.concat_ws(" ", i.cast("string"), c)
    runs = F.flatten(F.transform(F.filter(F.sequence(F.lit(0), F.size("w") - 1), hit), lambda i: F.transform(
        F.regexp_extract_all(F.get("w", i), F.lit(CANDIDATE), F.lit(0)), lambda c: at(i, c))))
    # the word that the k-th mark stands in is that of the k-th value
    marked = F.split(F.regexp_replace(F.translate("t", MARK, OTHER), F.lit(VALUE), F.lit(f"$1{MARK}$3$4")), BLANKS)
    marks = F.filter(F.transform(marked, lambda w, i: F.struct(i.alias("at"), (F.size(F.split(w, MARK)) - 1).alias("n"))), lambda x: x["n"] > 0)
    places = F.flatten(F.transform(marks, lambda x: F.array_repeat(x["at"], x["n"])))
    values = F.transform(F.arrays_zip(places.alias("at"), F.regexp_extract_all("t", F.lit(VALUE), F.lit(3)).alias("v")), lambda x: at(x["at"], x["v"]))
    each = F.transform(F.array_union("runs", "values"), lambda x: F.struct(
        F.call_function("substring_index", x, F.lit(" "), F.lit(1)).cast("int").alias("at"),
        F.call_function("substr", x, F.call_function("instr", x, F.lit(" ")) + 1).alias("candidate")))
    word = lambda x, k: F.get("w", x["at"] + k)
    found = F.transform("each", lambda x: F.struct(
        x["at"].alias("position"), word(x, 0).alias("word"), F.concat_ws(" ", word(x, -2), word(x, -1)).alias("before"),
        F.concat_ws(" ", word(x, 1), word(x, 2)).alias("after"), x["candidate"].alias("candidate")))
    rows = words.withColumns({"runs": runs, "values": values}).withColumn("each", each)
    return rows.select("doc_id", F.explode(found).alias("c")).select("doc_id", "c.*")


def with_features(found: DataFrame, words: DataFrame) -> DataFrame:
    """``found`` with FEATURES: the candidate's length, shares of digits and capitals, changes of kind per
    character, variety, mean log transition, share of its letters in dictionary words, then path, quotes,
    assignment, credential names and plain words around it."""
    size = F.char_length("candidate")
    share = lambda pattern: F.regexp_count("candidate", F.lit(pattern)) / size
    low = F.lower("candidate")
    code = F.transform(F.split(low, ""), lambda c: F.when(c.between("a", "z"), F.ascii(c) - 97).otherwise(26))
    rows = found.withColumns({"id": F.monotonically_increasing_id(), "c": code, "one": F.lit(1)})
    rows = rows.join(F.broadcast(transitions(words)), "one")
    steps = F.transform(F.sequence(F.lit(0), F.size("c") - 2), lambda i: F.get("logs", F.get("c", i) * 27 + F.get("c", i + 1)))
    rows = keep(rows.withColumn("transition", F.aggregate(steps, F.lit(0.0), lambda a, x: a + x) / (size - 1)).drop("c", "logs", "one"))
    runs = rows.select("id", F.explode(F.regexp_extract_all(F.lower("candidate"), F.lit(r"[a-z]{3,20}"), F.lit(0))).alias("word"))
    known = runs.join(words.select("word"), "word").groupBy("id").agg(F.sum(F.char_length("word")).alias("known"))
    around = F.concat_ws(" ", "before", "word")
    ahead = F.call_function("substring_index", F.col("word"), F.regexp_extract("candidate", r"^[^\x20\x09-\x0D]+", 0), F.lit(1))
    return (rows.join(known, "id", "left").select(
        "doc_id", "position", "candidate", "word", "before", "after", "transition",
        size.cast("double").alias("length"), share("[0-9]").alias("digit_share"), share("[A-Z]").alias("upper_share"),
        share(r"(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])|(?<=[a-z])(?=[A-Z])").alias("changes"),
        (F.size(F.array_distinct(F.split("candidate", ""))) / size).alias("variety"),
        (F.coalesce("known", F.lit(0)) / size).alias("coverage"),
        F.rlike("word", F.lit(r"://|@|[\\]|^/|(/[^/]*){3}|\.[a-z]{2,4}\b")).cast("double").alias("path"),
        F.rlike("word", F.lit("[\"'`]")).cast("double").alias("quoted"),
        F.rlike(F.concat_ws(" ", "before", ahead), F.lit(r"[=:]\W*$")).cast("double").alias("assigned"),
        F.rlike(around, F.lit(NAMES)).cast("double").alias("named"),
        F.rlike("before", F.lit(r"^[\p{L}',.]+ [\p{L}',.]+$")).cast("double").alias("plain_before"))
        .na.fill(0.0, list(FEATURES)))


def weak_labels() -> Column:
    """Labels for findings where none are given: 1 for a mixed string that is assigned to a credential's name, 0
    for numbers, paths, addresses and dictionary words, null for what neither rule is sure of, as words that
    are assigned to such a name."""
    mixed = (F.col("digit_share") > 0.1) & (F.col("digit_share") < 0.95) & (F.col("coverage") < 0.3)
    given = (F.col("assigned") == 1) & (F.col("named") == 1)
    return (F.when(given & mixed, 1.0)
            .when(given & (F.col("digit_share") < 0.95) & (F.col("path") == 0), None)
            .when((F.col("digit_share") >= 0.95) | (F.col("path") == 1) | (F.col("coverage") >= 0.5), 0.0))


def scan(docs: DataFrame, label: Column | None = None, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """One row per finding: doc_id, position (of its word in the text), candidate, score, is_secret.

    Candidates are found in every whole text. A random forest, fitted on ``train_rows`` labelled findings at
    most (``label``: 1, 0 or null from the columns of ``with_features``; ``weak_labels`` by default), scores
    all of them; those under THRESHOLD are false positives. The dictionary and the transitions count all documents.

    A null or empty text has no findings; a null doc_id stays null; repeated rows give repeated findings; very long
    texts are split in their task. With labels of one kind or none the score is that label's, or 0. An empty
    table gives no rows. Other columns are not read.
    """
    words = keep(dictionary(docs))
    rows = keep(with_features(candidates(docs), words).withColumn("label", weak_labels() if label is None else label))
    kinds = {r["label"]: r["n"] for r in rows.where("label IS NOT NULL").groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    columns = ["doc_id", "position", "candidate"]
    if len(kinds) < 2:
        return rows.select(*columns, F.lit(float(next(iter(kinds), 0.0))).alias("score")).withColumn("is_secret", F.col("score") >= THRESHOLD)
    share = min(1.0, train_rows / sum(kinds.values()))
    train = rows.where(F.col("label").isNotNull() & (F.pmod(F.xxhash64("doc_id", "position", "candidate"), F.lit(1 << 30)) <= F.lit(int(share * (1 << 30)))))
    assembled = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED).fit(assembled.transform(train))
    scored = forest.transform(assembled.transform(rows)).select(*columns, vector_to_array("probability")[1].alias("score"))
    return scored.withColumn("is_secret", F.col("score") >= THRESHOLD)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
