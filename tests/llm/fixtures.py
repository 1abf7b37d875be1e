"""Small documents with the cases that every operator has to survive."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def documents(spark, rows, schema=SCHEMA):
    """Rows of (doc_id, text); the other columns are filled, or null for every third."""
    full = [
        (i, t, None if k % 3 == 0 else "en", f"src{k % 2}", None if t is None else len(t)) for k, (i, t) in enumerate(rows)
    ]
    return spark.createDataFrame(full, schema).repartition(3)


def corpus(seed=1, n=40):
    """Plain, copied, edited, null, empty, blank, repeated and long texts."""
    rng = random.Random(seed)
    rows = [(k, "\n".join(words(rng, rng.randrange(5, 60)) for _ in range(rng.randrange(1, 4)))) for k in range(n)]
    rows += [(100 + k, rows[k][1]) for k in range(6)]
    for k in range(6):
        parts = rows[k + 8][1].split(" ")
        parts[len(parts) // 2] = "edited"
        rows.append((200 + k, " ".join(parts)))
    rows += [(300, None), (301, ""), (302, " \n\t "), (None, "no id here"), (None, None), (303, "é Ünï çode ÀÉ x")]
    rows += [rows[3], (400, words(rng, 6000)), (401, "tie tie tie"), (402, "tie tie tie"), (403, "one"), (404, "A\x0bB")]
    return rows
