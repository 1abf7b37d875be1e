import hashlib
import random
import re
import time

import pytest

from relpoint.llm.personal_data import (
    deobfuscated,
    detect,
    op13_personal_data,
    scan,
    with_personal_data,
    without_personal_data,
)
from tests.llm.fixtures import corpus, documents

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def slow(text):
    found = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == "card" and not (13 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            found.append((kind, *m.span()))
    return found


def test_detectors_match_the_patterns():
    rng = random.Random(13)
    alphabet = ["1", "2", "25", "0", "4111111111111111", ".", "-", " ", "+", "(", ")", "a", "b.c", "@", "%", "é", "x@y.z", "\n", "192.168.0.1"]
    for _ in range(6000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(30)))
        assert [tuple(s) for s in detect(text)] == slow(text), text


@pytest.mark.parametrize(
    ("text", "kind", "disguised"),
    [
        ("mail bob [at] example [dot] com today", "email", "bob [at] example [dot] com"),
        ("mail bob(at)example(dot)com", "email", "bob(at)example(dot)com"),
        ("é é write to jane.doe at mail dot example dot org, please", "email", "jane.doe at mail dot example dot org"),
        ("mail bob{at}example.com", "email", "bob{at}example.com"),
        ("mail bоb＠exаmple．com!", "email", "bоb＠exаmple．com"),
        ("mail bo​b@exam­ple.com", "email", "bo​b@exam­ple.com"),
        ("server 192 dot 168 dot 0 dot 17 down", "ip", "192 dot 168 dot 0 dot 17"),
        ("server one nine two dot one six eight dot zero dot one down", "ip", "one nine two dot one six eight dot zero dot one"),
        ("server １９２.１６８.０.１", "ip", "１９２.１６８.０.１"),
        ("server ١٠.٠.٠.١", "ip", "١٠.٠.٠.١"),
        ("card four one one one one one one one one one one one one one one one.", "card", " ".join(["four"] + ["one"] * 15)),
        ("card 4111 1111 1111 one one one one ok", "card", "4111 1111 1111 one one one one"),
        ("card ４１１１–1111–1111–1111", "card", "４１１１–1111–1111–1111"),
        ("call plus four nine three zero five five five zero one zero now", "phone", "plus four nine three zero five five five zero one zero"),
        ("call ＋1 (555) 555-0100", "phone", "＋1 (555) 555-0100"),
    ],
)
def test_disguises(text, kind, disguised):
    base, added = scan(text)
    assert (kind, disguised) in [(s.kind, text[s.start : s.end]) for s in added]
    assert [tuple(s) for s in base] == slow(text)


def test_clean_texts_stay_clean():
    for text in (
        "we met at noon and looked at one or two of the three things at home",
        "one two three four five six seven eight nine ten",
        "the dot at the end. of the line. is at five dot",
        "look at example.com at once, plus five of them, a point at issue",
        "Éa über ñandú ça où ß один два",
        "version 1.2.3 of 2024-01-01, 300.300.300.300 and 4111 1111 1111 1112",
        "",
    ):
        assert scan(text) == ([], []), text


def test_spans_lead_back_to_the_source():
    rng = random.Random(7)
    forms = ["bob [at] example [dot] com", "one nine two dot one six eight dot zero dot one", "bоb＠example．com", "a@b.cd", "4111​111111111111"]
    for _ in range(300):
        pieces, places = [], []
        for _ in range(rng.randrange(6)):
            pieces.append(rng.choice(["xx é ", "lorem, ", "​ zz ", "ＡＢ "]))
            form = rng.choice(forms)
            start = sum(map(len, pieces))
            places.append((start, start + len(form)))
            pieces += [form, "; "]
        text = "".join(pieces)
        base, added = scan(text)
        assert sorted((s.start, s.end) for s in base + added) == places, text


def test_time_is_linear():
    for piece in ("a", "1", "1.", "1 ", "@", "a@", "+1", "+1 ", "one ", "dot ", " at ", "(", " ", "a.b@", "x at y dot "):
        start = time.process_time()
        scan(piece * 200_000)
        assert time.process_time() - start < 10, piece


def test_rows_of_all_kinds(spark):
    rows = corpus() + [(800, "a@b.cd " * 3), (800, "a@b.cd " * 3), (801, "x" * 9_000 + " 10.0.0.1"), (802, "é me at x dot org")]
    docs = documents(spark, rows).selectExpr("*", "1 as base", "2 as added", "3 as kind", "4 as spans", "5 as `start.end`")
    got = with_personal_data(docs.drop("base", "added")).collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[1] or "")
    assert sorted(((r["doc_id"], r["text"], [tuple(s) for s in r["base"]]) for r in got), key=key) == sorted(
        ((i, t, slow(t or "")) for i, t in rows), key=key
    )
    masked = without_personal_data(docs)
    assert masked.columns == docs.columns
    by_id = {r["doc_id"]: r["text"] for r in masked.collect()}
    assert by_id[300] is None and by_id[800] == "<email> <email> <email> " and by_id[802] == "é <email>"
    assert by_id[801].endswith("x <ip>") and by_id[0] == dict(rows)[0]
    assert with_personal_data(documents(spark, [])).count() == 0


def test_query(spark, sf):
    found = {r["doc_id"]: r for r in op13_personal_data(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(found) == len(docs)
    for d in docs:
        base, r = slow(d["text"] or ""), found[d["doc_id"]]
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in PATTERNS] == [sum(s[0] == k for s in base) for k in PATTERNS]
        assert set(filter(None, joined.split(","))) <= set(r["spans"].split(","))
        assert r["n_added"] == len(list(filter(None, r["spans"].split(",")))) - len(base)


def test_plain_form():
    text, steps = deobfuscated("call plus one two (at) noon")
    assert text == "call +12@noon" and len(steps) == 1
    assert steps[0].source(5, 6) == (5, 10) and steps[0].source(6, 8) == (10, 17)
