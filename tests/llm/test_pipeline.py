import public_tokenizers
from brute import contamination, shingle_set, substrings
from data import documents
from test_llm_operators import toxic_corpus

import corpus_pipeline
from tallyrill.llm import bpe, queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows(spark, docs):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], SCHEMA)


def test_toxicity_stage(spark, tmp_path):
    corpus = toxic_corpus(1200)
    spark.createDataFrame([(i, 1, y) for i, _, y in corpus], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = rows(spark, [(i, t) for i, t, _ in corpus])
    kept = corpus_pipeline.toxicity_filter(spark, docs, str(tmp_path))
    assert kept.schema == docs.schema
    left = {r.doc_id for r in kept.collect()}
    assert sum((i in left) != bool(y) for i, _, y in corpus) > 0.95 * len(corpus)


def test_near_duplicate_stage(spark):
    docs = documents(6)
    df = rows(spark, [*docs, (0, docs[0][1]), (None, "a b c d e f g"), (None, "h i j k l m n")])
    out = corpus_pipeline.one_of_near_duplicates(spark, df, "")
    assert out.columns == df.columns
    left = sorted(r.doc_id for r in out.collect() if r.doc_id is not None)
    sets = {i: shingle_set(t, 5) for i, t in docs}
    from brute import components

    comp = components(list(sets), lambda a, b: bool(sets[a]) and bool(sets[b]) and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]))
    assert left == sorted(i for i in sets if comp[i] == i)
    assert out.where("doc_id is null").count() == 2


def test_rows_of_one_doc_id_are_documents_of_their_own(spark):
    x, y = " ".join(f"x{i}" for i in range(40)), " ".join(f"y{i}" for i in range(40))
    out = corpus_pipeline.one_of_near_duplicates(spark, rows(spark, [(7, x), (7, y), (8, x + " more"), (9, x), (7, x), (5, ""), (5, ""), (6, None)]), "")
    assert sorted((r.doc_id, r.text or "-") for r in out.collect()) == sorted([(7, x), (7, y), (5, "-"), (6, "-")])


def test_substring_stage(spark):
    docs = documents(7)
    df = rows(spark, docs)
    out = corpus_pipeline.without_repeated_substrings(spark, df, "")
    assert out.columns == df.columns and [f.dataType for f in out.schema] == [f.dataType for f in df.schema]
    want = {i: k.decode("utf-8", "ignore") for i, (k, _, _) in substrings(docs, 100).items()}
    for r in out.collect():
        text = dict(docs)[r.doc_id]
        assert r.text == (None if text is None else want[r.doc_id]) and r.n_chars == (None if text is None else len(r.text))


def test_last_stages(spark, tmp_path):
    docs = documents(8)
    items = [(1, docs[5][1]), (2, "One two")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.without_benchmark(spark, rows(spark, docs), str(tmp_path))
    want = contamination(docs, items, 10)
    assert {r.doc_id for r in out.collect()} == {i for i, w in want.items() if not w[1]}
    t = bpe.Library(public_tokenizers.path("byte_bpe_50k.json"))
    for r in corpus_pipeline.encoded(spark, out, "").collect():
        assert bytes(r.ids) == t.encode([dict(docs)[r.doc_id] or ""])[0].astype("<u4").tobytes()


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows(spark, []).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_queries_are_registered(spark):
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
