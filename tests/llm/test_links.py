from plain_llm import documents, shingles, weighted_jaccard
from test_duplicates import corpus

from terrace.llm import bagminhash


def test_links_equal_all_pairs(spark):
    """Every pair of different texts that are similar enough counts, also inside a class."""
    texts = [*corpus(), *(" ".join(f"w{k}" if k != 16 * i else f"own{i}" for k in range(200)) for i in range(12))]
    parts = {text or "": shingles(text or "", 5) for text in texts}
    want = {a: sum(a != b and bool(x and y) and weighted_jaccard(x, y) >= 0.8 for b, y in parts.items()) for a, x in parts.items()}
    rows = bagminhash.near_duplicates(documents(spark, texts)).collect()
    assert {r["doc_id"]: r["n_links"] for r in rows} == {i: want[t or ""] for i, t in enumerate(texts)}
    assert max(want.values()) >= 11
