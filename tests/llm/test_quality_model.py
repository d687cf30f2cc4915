import numpy as np
import pytest
from plain_llm import documents, fault_probability
from pyspark.sql import functions as F

import corpus_pipeline
from terrace.llm import quality

DATA = "/root/testdata"


def tables(spark, scale):
    return spark.read.parquet(f"{DATA}/{scale}/documents.parquet"), spark.read.parquet(f"{DATA}/{scale}/labels.parquet")


@pytest.mark.parametrize("up", [2, 30])
@pytest.mark.parametrize("gap", [0.0, 1.0, 1e6])
def test_calibration_stays_finite(up, gap):
    """Two positives, separated and far separated logits, and logits that say the opposite."""
    y = np.r_[np.zeros(60), np.ones(up)].astype(int)
    z = np.random.default_rng(1).normal(size=len(y))
    for sign in (1, -1):
        slope, shift = quality.line(z + sign * gap * y, y)
        p = quality.probability(slope * (z + sign * gap * y) + shift)
        assert 0 < slope < 1e3 and abs(shift) < 1e3 and abs(p.mean() - y.mean()) < 0.1
    slope, shift = quality.line(np.zeros(len(y)), y)
    assert slope > 0 and quality.probability(np.array([shift]))[0] == pytest.approx(y.mean(), abs=0.03)


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01"])
def test_few_labels_keep_clean_documents(spark, scale):
    docs, labels = tables(spark, scale)
    kept = all_ = 0
    for split in range(3):
        aside = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == split
        model = quality.train(docs, labels.filter(~aside))
        for fault in model.faults.values():
            assert all(0 < v.scale < 10 and abs(v.shift) < 10 for v in (fault.text, fault.page))
        clean = quality.judged(docs.join(labels.filter(aside & (F.col("quality") == 1) & (F.col("toxic") == 0)), "doc_id"), model, ["doc_id"]).collect()
        kept, all_ = kept + sum(r["accepted"] for r in clean), all_ + len(clean)
    assert kept >= 0.97 * all_


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01"])
def test_pipeline_has_rows(spark, scale):
    docs, _ = tables(spark, scale)
    first = corpus_pipeline.STAGES[0][1](spark, docs, f"{DATA}/{scale}").count()
    assert first > 0.7 * docs.count()
    assert corpus_pipeline.run(spark, f"{DATA}/{scale}").select("doc_id").distinct().count() > 0.6 * docs.count()


def test_scores_equal_plain_sums(spark):
    docs, labels = tables(spark, "sf0.01")
    model = quality.train(docs, labels)
    assert set(model.faults) == set(quality.FAULTS)
    odd = documents(spark, [None, "", "x" * 50000, "Plain | WORDS!! #5\n\nPlain | WORDS!! #5\n"], 10**9).union(docs.limit(0)).withColumn("source", F.when(F.col("doc_id") % 2 == 0, F.col("source")))
    rows = docs.orderBy(F.xxhash64("doc_id")).limit(150).union(odd)
    found = {r["doc_id"]: r for r in quality.judged(rows, model, ["doc_id"]).collect()}
    for r in rows.collect():
        p = {f: fault_probability(x, model.vocabulary, r["text"], r["source"], r["lang"]) for f, x in model.faults.items()}
        got = found[r["doc_id"]]
        assert 1 - got["quality"] == pytest.approx(p["low"], abs=1e-4) and got["toxicity"] == pytest.approx(p["toxic"], abs=1e-4)
        if all(abs(p[f] - x.least) > 1e-4 for f, x in model.faults.items()):
            assert got["accepted"] == all(p[f] < x.least for f, x in model.faults.items())


def _two_views(spark, n=3000):
    """Bad documents come from ten of forty sources and mostly say so in a word; few are labelled."""
    rng = np.random.default_rng(5)
    rows, labels = [], []
    for k in range(n):
        bad = k % 3 == 0
        word = f"bad{rng.integers(3)}" if bad and rng.random() < 0.98 else "fine"
        rows.append((k, " ".join(["some", "words", word, f"w{rng.integers(200)}"]), "en", f"mill{rng.integers(10)}" if bad else f"src{rng.integers(30)}", 20))
        if k < 45:
            labels.append((k, 0 if bad else 1, 0))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_views_teach_each_other(spark, monkeypatch):
    monkeypatch.setattr(quality, "SURE", 0.9)
    docs, labels = _two_views(spark)
    alone, taught = quality.train(docs, labels, rounds=1), quality.train(docs, labels)
    given = {}
    for exchange in taught.exchanged:
        for kind, (confident, taken) in exchange.items():
            given[kind] = max(given.get(kind, 0), taken)
            assert taken <= confident
    assert given["low", "text", 1] > 50 and given["low", "text", 0] > 50 and given["low", "page", 0] > 50
    # the sources' view of 45 labels gains by what the words' view tells it of the unlabelled documents
    rows = docs.filter("doc_id >= 45").select("doc_id", "text", "source", "lang").toArrow().combine_chunks().to_batches()[0]
    bad = np.array(rows.column(0)) % 3 == 0
    wrong = []
    for model in (alone, taught):
        page = model.faults["low"].page
        numbers = quality.page_numbers(rows.column(2), rows.column(3), np.array([len(t) for t in rows.column(1).to_pylist()]))
        p = quality.probability(page.logit(page.expand(numbers, np.empty((len(numbers), 0)))))
        wrong.append(float(-np.log(np.where(bad, p, 1 - p)).mean()))
    assert wrong[1] < wrong[0]
    judged = {r["doc_id"]: r["quality"] for r in quality.judged(docs, taught, ["doc_id"]).collect()}
    assert sum((q < 0.5) == (k % 3 == 0) for k, q in judged.items()) > 0.97 * len(judged)


def test_faults_that_cannot_be_learned(spark):
    docs, labels = tables(spark, "sf0.001")
    for changed in (labels.withColumn("toxic", F.lit(1)), labels.withColumn("toxic", (F.col("doc_id") < 20).cast("int")), labels.filter("false"), labels.withColumn("toxic", F.lit(0))):
        few = changed.filter("toxic = 1").count() < quality.LEAST or changed.filter("toxic = 0").count() < quality.LEAST
        rows = quality.score(docs, changed).collect()
        assert len(rows) == 200 and (not few or all(r["toxicity"] == 0 for r in rows))


def test_tables_without_metadata_and_repeated_keys(spark):
    docs, labels = tables(spark, "sf0.001")
    again = docs.union(docs.withColumn("text", F.lit("another text of the same key")))
    assert quality.score(again.drop("source", "lang"), labels).count() == 400
    first, second = ({(r["doc_id"], r["quality"], r["toxicity"]) for r in quality.score(x, labels).collect()} for x in (again, again.repartition(5)))
    assert first == second
