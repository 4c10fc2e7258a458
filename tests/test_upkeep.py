"""An index kept up step by step against one built anew."""

from entitle.operators import tfidf as T
from entitle.operators import upkeep as U

TEXTS = ["red fish swims", "red fish", "blue bird flies over red fish", "green tree", "the and of", "blue blue sea", None]


def frame(spark, texts):
    return spark.createDataFrame(list(texts.items()), "doc_id int, text string")


def same(one, two):
    terms = [sorted((r.term, r.tf, r.df, round(r.idf, 9)) for r in x.vocabulary.collect()) for x in (one, two)]
    weights = [sorted((r.doc_id, r.term, round(r.weight, 9)) for r in x.postings.collect()) for x in (one, two)]
    return terms[0] == terms[1] and weights[0] == weights[1] and bool(weights[0])


def test_stored_steps_equal_a_rebuild(spark, tmp_path):
    path = str(tmp_path / "index")
    assert U.read_steps(spark, path) == []
    U.remove_documents(spark, path, spark.createDataFrame([(1,)], "doc_id int"))
    U.add_documents(spark, path, frame(spark, dict(enumerate(TEXTS[:3]))))
    U.add_documents(spark, path, frame(spark, dict(enumerate(TEXTS[3:], 3))))
    held = dict(enumerate(TEXTS))
    rebuilt = lambda: T.build_index(frame(spark, held), dim=9)
    current = lambda: U.index_of(U.read_steps(spark, path), dim=9)
    assert same(current(), rebuilt())
    U.add_documents(spark, path, frame(spark, {1: "green fish green tree", 9: "red sea"}))
    held |= {1: "green fish green tree", 9: "red sea"}
    U.remove_documents(spark, path, spark.createDataFrame([(0,), (4,), (77,)], "doc_id int"))
    held = {k: v for k, v in held.items() if k not in (0, 4)}
    assert same(current(), rebuilt())
    before = len(U.read_steps(spark, path))
    U.compact(spark, path)
    assert before == 5 and len(U.read_steps(spark, path)) == 1 and same(current(), rebuilt())
    U.add_documents(spark, path, frame(spark, {0: "red fish again"}))
    held[0] = "red fish again"
    assert same(current(), rebuilt())


def test_adding_reads_no_text_of_the_index(spark, tmp_path):
    path = str(tmp_path / "index")
    U.add_documents(spark, path, frame(spark, dict(enumerate(TEXTS))))
    step = U.read_steps(spark, path)[0]
    assert [sorted(x.columns) for x in step] == [["doc_id", "term", "tf"], ["df", "term", "tf"], ["added", "doc_id"]]
