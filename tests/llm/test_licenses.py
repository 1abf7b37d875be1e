import random
import re

from relpoint.llm.licenses import PHRASES, TEMPLATES, Scanner, op6_licenses, scan_licenses
from tests.llm.fixtures import corpus, documents, words
from tests.llm.test_decontaminate import plain


def slow(text):
    own = plain(text)
    found = []
    for phrase, label in PHRASES.items():
        parts = phrase.split()
        found += [(k, label) for k in range(len(own)) if own[k : k + len(parts)] == parts]
    return sorted(found)


def texts():
    rng = random.Random(4)
    rows = corpus()
    pieces = ["CC BY", "cc-by", "General PUBLIC license", "all rights reserved", "All rights, reserved. all rights", "cc cc by by"]
    for k in range(40):
        parts = words(rng, 12).split() + [rng.choice(pieces) for _ in range(rng.randrange(4))]
        rng.shuffle(parts)
        rows.append((700 + k, " ".join(parts)))
    return rows


def test_phrases_match_brute_force(spark):
    rows = texts()
    docs = documents(spark, rows).selectExpr("*", "1 as id", "2 as places", "3 as spans")
    got = scan_licenses(docs).collect()
    assert len(got) == len(rows)
    by_text = sorted(((r["id"], r["n_words"], [tuple(p) for p in r["places"]]) for r in got), key=repr)
    assert by_text == sorted(((i, len(plain(t)), slow(t)) for i, t in rows), key=repr)


def test_templates_are_found_whole_and_altered(spark):
    rng = random.Random(5)
    rows, expected = [], {}
    for k, (label, text) in enumerate(TEMPLATES):
        parts = text.split()
        if len(parts) > 20:
            parts[len(parts) // 2] = "changed"
            del parts[len(parts) // 4]
        rows.append((k, f"{words(rng, 30)} é {' '.join(parts).upper()} {words(rng, 30)}"))
        expected[k] = label
    for r in scan_licenses(documents(spark, rows)).collect():
        own = [s for s in r["spans"] if s["label"] == expected[r["id"]]]
        assert own, TEMPLATES[r["id"]]
        text = dict(rows)[r["id"]]
        for s in own:
            inside = plain(text)[s["first"] : s["last"] + 1]
            assert plain(text.encode()[s["start"] : s["end"]].decode()) == inside
            assert 0.6 <= s["share"] <= 1 and not any(re.fullmatch(r"w\d+", w) for w in inside)


def test_clean_texts_have_no_spans(spark):
    rng = random.Random(6)
    rows = [(k, words(rng, 200)) for k in range(20)] + [(50, "the license of the software and the rights of the file")]
    assert all(not r["spans"] and not r["places"] for r in scan_licenses(documents(spark, rows)).collect())
    assert scan_licenses(documents(spark, [])).count() == 0


def test_repeated_notices_are_each_a_span():
    notice = plain(TEMPLATES[0][1])
    _, spans = Scanner().scan([w.encode() for w in (notice + ["x"] * 30) * 5])
    assert [s.first for s in spans if s.label == "mit" and s.share == 1.0] == [35 * k for k in range(5)]


def test_query_digest(spark, sf):
    for r in op6_licenses(spark, sf).collect():
        base, labels = set(filter(None, r["base_labels"].split(","))), set(filter(None, r["labels"].split(",")))
        assert base <= labels and 0 <= r["score"] <= 1
        assert (r["n_base"] > 0) == (r["first_word"] is not None) == bool(base)
