import random

from relpoint.llm.simhash import drop_near, fingerprint, near_groups, similar_texts
from tests.llm.fixtures import documents, words
from tests.llm.test_components import by_search


def families():
    """Texts with edits up to and beyond similarity 0.8, a chain, and two without words."""
    rng = random.Random(11)
    rows = []
    for _ in range(8):
        own = words(rng, rng.randrange(80, 200), 5000).split()
        for _ in range(4):
            rows.append((len(rows), " ".join(own)))
            own = list(own)
            for _ in range(rng.randrange(1, 5)):
                own[rng.randrange(len(own))] = f"e{rng.randrange(10_000)}"
    return rows + [(100, None), (101, " ")]


def test_near_copies_of_many_bits_are_grouped(spark):
    rows = families()
    how = similar_texts()
    data = [(t or "").encode() for _, t in rows]
    fps, sets = [fingerprint(t) for t in data], [how.shingles(t) for t in data]
    alike = lambda a, b: data[a].strip() and data[b].strip() and how.jaccard(sets[a], sets[b]) >= 0.8
    pairs = [(a, b) for a in range(len(rows)) for b in range(a)]
    near = [p for p in pairs if bin(fps[p[0]] ^ fps[p[1]]).count("1") <= 2 or alike(*p)]
    assert any(bin(fps[a] ^ fps[b]).count("1") > 2 for a, b in near)
    root = by_search(near)
    least = {}
    for k, (i, _) in enumerate(rows):
        least.setdefault(root.get(k, k), i)
    docs = documents(spark, rows)
    got = {r["id"]: r["component"] for r in near_groups(docs, similar=how).collect()}
    assert got == {i: least[root.get(k, k)] for k, (i, _) in enumerate(rows)}
    assert {r["doc_id"] for r in drop_near(docs, similar=how).collect()} == set(least.values())
