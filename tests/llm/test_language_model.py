from collections import Counter, defaultdict

import numpy as np
import pytest
from plain_llm import KneserNey, documents, held_out, words
from pyspark.sql import functions as F

from terrace.llm import kneser_ney, queries

TEXTS = ["the cat sat on the mat", "The cat ran", "", None, "a dog sat on the mat and the cat sat on a dog", "unseen words here", "the " * 300, "on the mat", "on the mat", "é È ẞ tab\tand\nline"] * 3 + ["x y z " * 5000]


def test_scores_equal_a_plain_model(spark):
    model = KneserNey([t for i, t in enumerate(TEXTS) if not held_out(i)])
    rows = kneser_ney.train_and_score(documents(spark, TEXTS)).collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        t = TEXTS[r["doc_id"]]
        tokens = [*words(t), "</s>"]
        assert (r["held_out"], r["n_tokens"], r["train_tokens"]) == (held_out(r["doc_id"]), len(tokens), sum(model.n.values()))
        assert r["n_known"] == sum(model.n[w] > 0 for w in tokens)
        assert r["base_score"] == pytest.approx(model.base(t), rel=1e-9)
        assert r["score"] == pytest.approx(model.score(t), rel=1e-9)
        assert r["perplexity"] == pytest.approx(10 ** (-model.score(t) / len(tokens)), rel=1e-9)


def test_probabilities_add_up():
    model = KneserNey(TEXTS)
    for before in (("on", "the"), ("<s>", "<s>"), ("<s>", "a"), ("x", "never"), ("never", "the"), ("words", "here")):
        assert sum(model.p(*before, w) for w in [*model.n, "neverseen"]) == pytest.approx(1)


def test_scores_of_given_documents_equal_a_plain_model(spark):
    """Real documents, with more shards than the session's shuffles have, and the trigram order against pairs only."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    model = KneserNey([t for k, t in texts.items() if not held_out(k)])
    rows = kneser_ney.train_and_score(docs).collect()
    sums = np.zeros(3)
    for r in rows:
        assert r["score"] == pytest.approx(model.score(texts[r["doc_id"]]), rel=1e-9)
        if r["held_out"]:
            sums += [r["score"], model.score(texts[r["doc_id"]], model.pairs_only), model.base(texts[r["doc_id"]])]
    assert sums[0] > sums[1] > sums[2]


def test_counts_beyond_a_byte():
    x = np.array([0, 1, 254, 255, 256, 1 << 40])
    assert (kneser_ney.taken(kneser_ney.narrow("c", x), "c", np.array([5, 3, 0, 4, 2, 1])) == x[[5, 3, 0, 4, 2, 1]]).all()


def test_empty_tables_and_clashing_columns(spark):
    docs = documents(spark, TEXTS[:6])
    model = kneser_ney.train(docs.filter("false"))
    rows = kneser_ney.score(docs.withColumn("score", F.lit("x")), model).collect()
    assert all(r["n_known"] == 0 and np.isfinite(r["score"]) for r in rows) and len(rows) == 6
    assert kneser_ney.train_and_score(docs.filter("false")).count() == 0
    lone = spark.createDataFrame([(None, "the cat")], "doc_id long, text string")
    assert kneser_ney.score(lone, model).first()["held_out"] is True


class WholeKneserNey(KneserNey):
    """The plain model with the trigrams of contexts seen once, too."""

    def __init__(self, texts):
        super().__init__(texts)
        triples = Counter(t for x in texts for tokens in [["<s>", "<s>", *words(x), "</s>"]] for t in zip(tokens, tokens[1:], tokens[2:]))
        self.counts[2], self.follow[2] = triples, defaultdict(list)
        for (a, b, _), c in triples.items():
            self.follow[2][a, b].append(c)
        self.d[2] = self.discounts(triples)


@pytest.mark.parametrize("texts", [TEXTS, ["a b c d e", "a b c x e", "b c", None], [f"w{i} v{i % 90} u{i % 7} t{i}" for i in range(400)]])
def test_contexts_seen_once_have_trigrams(spark, texts):
    model = WholeKneserNey([t for i, t in enumerate(texts) if not held_out(i)])
    rows = kneser_ney.train_and_score(documents(spark, texts), every_context=True).collect()
    assert [r["score"] for r in rows] == pytest.approx([model.score(texts[r["doc_id"]]) for r in rows], rel=1e-9)
    lone = kneser_ney.score(documents(spark, texts), kneser_ney.train(documents(spark, texts[:1]), every_context=True)).collect()
    assert [r["score"] for r in lone] == pytest.approx([WholeKneserNey(texts[:1]).score(texts[r["doc_id"]]) for r in lone], rel=1e-9)


def test_query_scores_with_every_context(spark):
    """The registered query leaves no trigram out."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    model = WholeKneserNey([t for k, t in texts.items() if not held_out(k)])
    for r in queries.op2_kneser_ney(spark, "/root/testdata/sf0.001").collect():
        assert r["score"] == pytest.approx(model.score(texts[r["doc_id"]]), rel=1e-9)
