"""Language identification by Bayesian evidence fusion (operator 2)."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from entitle.llm.html_extraction import TOKEN, host_of, parse
from entitle.llm.kernels import LOWER, mix, text_slices
from entitle.llm.shared import keep, small_batches, table

#: Labelled documents that the text model is fitted on, about, the same number of each language; chosen by a
#: hash of their id.
SAMPLE_DOCS = 4000
#: Buckets that grams of four bytes are hashed to.
BUCKETS = 1 << 16
#: Grams overlap and repeat each other's evidence: the sum of their log likelihoods counts by this factor, and
#: for MOST_GRAMS grams at most.
TEMPER, MOST_GRAMS = 0.25, 400
#: Pages that a prior weighs when it is handed from all pages to the domain, and from there to the host.
PRIOR_PAGES = 5.0
#: Counts added to each value of a declared language or suffix.
SMOOTH = 0.5
HTML_TAG = re.compile(r"<html\b", re.I)
DECLARED = re.compile(r"\blang\s*=\s*[\"']?([a-zA-Z]{2,3})\b", re.I)


def declared_language(page: str) -> str:
    """Language of the first html tag that has one, wherever it stands outside comments and scripts; else ''."""
    if HTML_TAG.search(page):
        for m in TOKEN.finditer(page):
            if (m.group("name") or "").lower() == "html" and not m.group("end"):
                found = DECLARED.search(m.group("rest"))
                if found:
                    return found.group(1).lower()
    return ""


def _grams(data: np.ndarray) -> np.ndarray:
    """Bucket of the four bytes that begin at each place; white space is one kind."""
    data = LOWER[data].astype(np.uint64)
    data[data < 33] = 32
    if len(data) < 4:
        return np.zeros(0, np.int64)
    four = (data[:-3] << np.uint64(24)) | (data[1:-2] << np.uint64(16)) | (data[2:-1] << np.uint64(8)) | data[3:]
    return (mix(four) % np.uint64(BUCKETS)).astype(np.int64)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, bucket, n) of a partition, summed up in it."""
    held: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = batch.column(0).to_pylist()
        for i, _, data, offsets in text_slices(batch.column(1)):
            for k in range(len(offsets) - 1):
                total = held.setdefault(langs[i + k], np.zeros(BUCKETS, np.int64))
                total += np.bincount(_grams(data[offsets[k]:offsets[k + 1]]), minlength=BUCKETS)
    for lang, total in held.items():
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(total[at])],
                                         ["lang", "bucket", "n"])


#: Languages and their table of log likelihoods, as ``text_model`` gives them.
Fitted = tuple[list[str], np.ndarray]


def text_model(labelled: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Fitted:
    """Languages and, by language and bucket, log likelihoods; BUCKETS numbers a language reach the driver."""
    rows = labelled.where("lang IS NOT NULL AND text IS NOT NULL")
    # each language has an equal share of the sample, and its row of the least hash at least
    rows = rows.withColumn("draw", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)))
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min("draw").alias("least"))
    each = F.lit(float(sample_docs)) / F.lit(max(1, rows.select("lang").distinct().count()))
    bounds = sizes.select("lang", F.greatest(F.col("least"), F.floor(each * F.lit(1 << 30) / F.col("n"))).alias("bound"))
    counts = (rows.join(F.broadcast(bounds), "lang").where("draw <= bound").select("lang", "text").mapInArrow(_counts, "lang string, bucket long, n long")
              .groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas())
    langs = sorted(counts["lang"].unique())
    table_ = np.full((len(langs), BUCKETS), 0.5)
    for k, lang in enumerate(langs):
        part = counts[counts["lang"] == lang]
        table_[k, part["bucket"].to_numpy()] += part["n"].to_numpy()
    return langs, np.log(table_ / table_.sum(axis=1, keepdims=True)).astype(np.float32)


EVIDENCE = "id long, url string, host string, domain string, suffix string, declared string, n_chars long, score array<double>"


def _evidence(model: np.ndarray, plain: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    by_bucket = np.ascontiguousarray(model.T)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[] for _ in range(8)]
            for row_id, url, page in zip(*(batch.column(k) for k in range(3))):
                page, host = page.as_py() or "", (url.as_py() or "") if plain else host_of(url.as_py())
                labels = [host] if plain else host.split(":")[0].split(".")
                text = page if plain else "\n".join(parse(page).texts())
                at = _grams(np.frombuffer(text.encode("utf-8", "replace"), np.uint8))
                total = np.zeros(by_bucket.shape[1])
                for i in range(0, len(at), 1 << 16):
                    total += by_bucket[at[i:i + (1 << 16)]].sum(axis=0, dtype=np.float64)
                weight = TEMPER * min(1.0, MOST_GRAMS / max(1, len(at)))
                for column, value in zip(rows, (row_id.as_py(), url.as_py(), host, ".".join(labels[-2:]), "" if plain else labels[-1],
                                                "" if plain else declared_language(page), len(text), (total * weight).tolist())):
                    column.append(value)
            kinds = [pa.int64(), *[pa.string()] * 5, pa.int64(), pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds)], EVIDENCE_NAMES)
    return run


EVIDENCE_NAMES = [x.split()[0] for x in EVIDENCE.split(", ")]


def _softmax(scores: Column) -> Column:
    most = F.array_max(scores)
    powers = F.transform(scores, lambda x: F.exp(x - most))
    return F.transform(powers, lambda x: x / F.aggregate(powers, F.lit(0.0), lambda a, b: a + b))


def identify(pages: DataFrame, labelled: DataFrame, sample_docs: int = SAMPLE_DOCS, fitted: Fitted | None = None) -> DataFrame:
    """One row per row of ``pages``: page_id, url, lang, probability, text_lang, declared, n_chars.

    Four kinds of evidence are fused by Bayes' rule. Text: likelihoods of hashed grams of the page's text,
    fitted on about ``sample_docs`` rows of ``labelled`` (doc_id, text, lang). Declared language of the markup
    and suffix of the address: how often each value goes with each language over all pages, which are
    counted with the probabilities that their text gives them. Host: shares of the languages on the host's
    other pages, smoothed towards those of its domain, and these towards those of all pages. All tables are
    grouped sums with partial aggregation, one row per value, joined back; a large host is no group.

    A page without text or html is judged by the other evidence; a null url is a host without a name. Equal
    posteriors go to the language first by name. Without labelled rows lang is null. Repeated rows give repeated results,
    each counts as a page. An empty table gives no rows; other columns are not read.
    """
    langs, model = fitted or text_model(labelled, sample_docs)
    rows = keep(small_batches(pages).select(F.col("page_id").cast("long"), "url", "html").mapInArrow(_evidence(model, False), EVIDENCE))
    return _fused(rows, langs).withColumnRenamed("id", "page_id")


def identify_documents(docs: DataFrame, labelled: DataFrame, sample_docs: int = SAMPLE_DOCS, fitted: Fitted | None = None) -> DataFrame:
    """doc_id, source, lang, probability, text_lang and n_chars of every row of ``docs``: as ``identify``, for plain
    text, which has no markup and no address; its source takes the place of the host. Same cases."""
    langs, model = fitted or text_model(labelled, sample_docs)
    rows = keep(small_batches(docs).select(F.col("doc_id").cast("long"), "source", "text").mapInArrow(_evidence(model, True), EVIDENCE))
    return _fused(rows, langs).drop("declared").withColumnsRenamed({"id": "doc_id", "url": "source"})


def _fused(rows: DataFrame, langs: list[str]) -> DataFrame:
    """id, url, lang, probability, text_lang, declared and n_chars from the evidence of each row."""
    if not langs:
        return rows.select("id", "url", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("probability"),
                           F.lit(None).cast("string").alias("text_lang"), "declared", "n_chars")
    k = range(len(langs))
    rows = rows.withColumn("by_text", _softmax(F.col("score")))

    def sums(*keys: str) -> DataFrame:
        return rows.groupBy(*keys).agg(F.array(*[F.sum(F.col("by_text")[i]) for i in k]).alias("n"))

    whole = sums().withColumn("one", F.lit(1)).select("one", F.col("n").alias("all"))  # one row
    hosts = sums("host").withColumnRenamed("n", "of_host")
    domains = sums("domain").withColumnRenamed("n", "of_domain")
    found = (rows.withColumn("one", F.lit(1)).join(F.broadcast(whole), "one").join(hosts, "host").join(domains, "domain"))
    for name in ("declared", "suffix"):
        values = sums(name).withColumnRenamed("n", f"of_{name}")
        found = found.join(values, name)
    kinds = {name: rows.select(name).distinct().count() for name in ("declared", "suffix")}

    def at(name: str, i: int) -> Column:
        return F.col(name)[i]

    total = sum((at("all", i) for i in k), F.lit(0.0))
    fused = []
    for i in k:
        own = at("by_text", i)
        overall = (at("all", i) - own + 1.0 / len(langs)) / total
        domain_pages = sum((at("of_domain", j) for j in k), F.lit(0.0)) - 1
        domain = (at("of_domain", i) - own + PRIOR_PAGES * overall) / (domain_pages + PRIOR_PAGES)
        host_pages = sum((at("of_host", j) for j in k), F.lit(0.0)) - 1
        prior = (at("of_host", i) - own + PRIOR_PAGES * domain) / (host_pages + PRIOR_PAGES)
        score = at("score", i) + F.log(F.greatest(prior, F.lit(1e-12)))
        for name in ("declared", "suffix"):
            score += F.log((at(f"of_{name}", i) - own + SMOOTH) / (at("all", i) - own + SMOOTH * kinds[name]))
        fused.append(score)
    names = F.array(*[F.lit(x) for x in langs])
    found = found.withColumn("posterior", _softmax(F.array(*fused)))

    def best(column: str) -> Column:
        return F.element_at(names, F.array_position(column, F.array_max(column)).cast("int"))

    return found.select("id", "url", best("posterior").alias("lang"), F.array_max("posterior").alias("probability"),
                        best("by_text").alias("text_lang"), F.nullif("declared", F.lit("")).alias("declared"), "n_chars")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page and every document; pages have a null doc_id, documents a null page_id and url."""
    docs = table(spark, sf_dir, "documents")
    fitted = text_model(docs)
    pages = identify(table(spark, sf_dir, "pages"), docs, fitted=fitted)
    return identify_documents(docs, docs, fitted=fitted).drop("source").unionByName(pages, allowMissingColumns=True)
