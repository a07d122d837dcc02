"""Injection: what may be put before a prompt, over a table made for it."""

from quarry.plans import retrieval


def _tables(spark, folder):
    said = [
        (1, 0, "user", "We decided that the checkout_v2 flag stays on for the tantivy index rebuild."),
        (1, 1, "assistant", "The tantivy index rebuild took four hours with checkout_v2 enabled."),
        (2, 0, "user", "How long does the tantivy index rebuild take with checkout_v2 enabled?"),
        (3, 0, "user", "Lunch was good."), (4, 0, "assistant", "Rebuild notes: the index is cold after a rebuild."), (5, 0, "system", "tantivy index rebuild checkout_v2"), (6, 0, "user", ""),
    ] + [(10 + k, 0, "user", f"Filler number {k} says nothing of the sort, and neither do its neighbours.") for k in range(40)]
    spark.createDataFrame(said, "conv_id long, turn long, role string, text string").write.parquet(f"{folder}/conversations.parquet")
    spark.createDataFrame([(10**6, 1, "O", 1.0, "2026-01-01 00:00:00")], "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate string").selectExpr(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "CAST(o_orderdate AS timestamp_ntz) AS o_orderdate").write.parquet(f"{folder}/orders.parquet")


def test_injection(spark, tmp_path):
    d, later = str(tmp_path), 1 << 60
    _tables(spark, d)
    ask = "and the tantivy index rebuild with checkout_v2"
    found = retrieval.injected(spark, d, retrieval.FLOOR, retrieval.prompt_terms(ask), 3, later, ask).collect()
    assert [r.session for r in found] == [1, 1]  # no question, no system turn, no lone common word
    block = retrieval.injection_block(spark, d, ask, 3, later)
    assert "#100000 " in block and "#100001 " in block and len(block.encode()) <= retrieval.BLOCK_BYTES
    assert retrieval.injection_block(spark, d, ask, 1, later) is None  # its own session
    assert retrieval.injection_block(spark, d, ask, 3, 0) is None  # nothing earlier
    assert retrieval.injection_block(spark, d, "continue", 3, later) is None and retrieval.injection_block(spark, d, "and what about it", 3, later) is None
    same = "The tantivy index rebuild took four hours with checkout_v2 enabled."
    near = retrieval.injected(spark, d, 0.0, retrieval.prompt_terms(same), 3, later, same.upper().lower() + " ").collect()
    assert 100001 not in [r.seq for r in near] and 100000 in [r.seq for r in near]


def test_shared_search_stages(spark, tmp_path):
    d = str(tmp_path)
    texts = [(0, "red fox here", "en"), (1, "red fox red fox", "en"), (2, "red only", "en"), (3, "foxes and redness", "en"), (4, "none", "en")]
    spark.createDataFrame([(i, t, l, "s", 1) for i, t, l in texts], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, [1.0, float(i)], 0) for i in range(5)], "vec_id long, embedding array<float>, label int").write.parquet(f"{d}/embeddings.parquet")
    ask = lambda rows, words: {r.id: r.arms for r in retrieval.shared_hits(spark, d, spark.createDataFrame(rows, "id long"), words, spark.sql("SELECT array(0.0D, 1.0D) AS q"), 3).collect()}
    assert ask([(0,), (1,), (2,)], ["red", "fox"]) == {0: "lexical,semantic", 1: "lexical,semantic", 2: "semantic"}  # all words: the second stage isn't asked
    assert ask([(2,), (3,), (4,)], ["redd", "foxe"]) == {3: "lexical,semantic", 2: "semantic", 4: "semantic"}


def test_documents_of_stems(spark, tmp_path):
    texts = ["walking walked façade", "walks", "walk facade xyz", "xyz", "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("doc_id", "text", "'en' AS lang", "'s' AS source", "1L AS n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    found = retrieval.stemmed_terms(spark, str(tmp_path))
    assert "Expand" not in found._jdf.queryExecution().toString()  # no row is made once more for a second count of different values
    got = {r.stem: (r.df, r.terms) for r in found.collect()}
    assert got == {"walk": (3, 4), "facad": (2, 2), "xyz": (2, 1)}
