import corpus_pipeline
from relpoint.llm.common import store
from relpoint.llm.packing import public_tokenizer
from relpoint.llm.simhash import similar_texts
from tests.llm.fixtures import SCHEMA, documents
from tests.llm.test_decontaminate import slow as slow_leaks
from tests.llm.test_exact import expected as exact_expected
from tests.llm.test_packing import whole
from tests.llm.test_components import by_search
from tests.llm.test_simhash import expected as near_expected


def near_kept(rows):
    """The smallest id of each group of fingerprints within 2 bits or texts of similarity 0.8, all pairs compared."""
    how = similar_texts()
    sets = {i: how.shingles(" ".join(t.lower().split()).encode()) for i, t in rows if (t or "").split()}
    ids = sorted(sets)
    alike = [(a, b) for a in ids for b in ids if a < b and how.jaccard(sets[a], sets[b]) >= how.threshold]
    root = by_search([(i, c) for i, _, c in near_expected(rows) if i != c] + alike)
    least = {}
    for i, _ in sorted(rows):
        least.setdefault(root.get(i, i), i)
    return set(least.values()), alike


def test_each_stage_on_what_the_one_before_kept(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "decontamination", "packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = [(r["doc_id"], r["text"]) for r in docs.collect()]
        docs = store(stage(spark, docs, sf), name)
        assert docs.columns == columns
        kept = {r["doc_id"] for r in docs.collect()}
        if name == "quality":
            labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
            right = [(i in kept) == bool(labels[i]) for i, _ in before if i in labels]
            assert sum(right) >= 0.9 * len(right)
        elif name == "exact_dedup":
            assert kept == {i for i, _, _, stays, _ in exact_expected(before) if stays}
        elif name == "near_dedup":
            expected, alike = near_kept(before)
            assert alike and kept == expected
        else:
            assert kept == {i for i, t in before if not slow_leaks(t, items)[1]}
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizer())
    rows = corpus_pipeline.packing(spark, docs, sf).collect()
    ids = {}
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["piece"])):
        ids.setdefault(r["doc_id"], []).extend(r["ids"])
    assert ids == {r["doc_id"]: [*tokenizer.encode(r["text"], add_special_tokens=False).ids, 0] for r in docs.collect()}
    whole(rows, 2048)


def test_stages_survive_odd_rows_and_empty_tables(spark, sf):
    odd = documents(spark, [(1, None), (2, ""), (None, None), (3, "x"), (3, "x"), (4, "y " * 9000)])
    for docs in (odd.withColumnRenamed("lang", "Score"), spark.createDataFrame([], SCHEMA)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = store(stage(spark, docs, sf), name)
            assert out.columns == docs.columns
            docs = out
        assert corpus_pipeline.packing(spark, docs, sf).count() >= 0


def test_run_is_registered(spark):
    import __spark_entry__ as driver

    names = set(driver.queries())
    assert "pipeline" in names and {f"op{n}_" for n in range(1, 11)} <= {x[: x.index("_") + 1] for x in names if x[:2] == "op"}
