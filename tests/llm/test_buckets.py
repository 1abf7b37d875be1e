import random
from collections import defaultdict

from relpoint.llm.minhash import bucketed


def test_buckets_of_several_units_take_one_shuffle(spark):
    rng = random.Random(31)
    rows = [(key, [rng.randrange(40) for _ in range(3)]) for key in rng.sample(range(10**6), 60)]
    rows += [(key, list(bands)) for key, bands in rows[:9]] + [(7, []), (8, [900]), (8, [900]), (9, [901]), (10, [901])]
    held = defaultdict(list)
    for key, bands in rows:
        for bucket in bands:
            held[bucket].append(key)
    expected = set()
    for bucket, keys in held.items():
        a, b = min(keys), max(keys)
        if a < b:
            expected |= {(bucket, a, 2, b)} if len(keys) == 2 else {(bucket, k, len(keys), None) for k in keys}
    found = bucketed(spark.createDataFrame(rows, "key long, bands array<long>"))
    # Exchanges were two before, one for the buckets' counts and one for their units. Read before a run adds its own plan.
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    got = [tuple(r) for r in found.collect()]
    assert set(got) == expected and len(got) == len(expected)
