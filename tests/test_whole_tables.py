"""Queries without SQL take all rows of their tables, on tables made for that."""
from tersely.plans import queries as plans


def test_levels_take_bundles_of_either_side(spark, tmp_path):
    d = str(tmp_path)
    docs = [(1, "doc one"), (250, "doc far"), (None, "doc without id"), (2, None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(5, 1, "HIGH", "O"), (900, 2, "LOW", "F")], "o_orderkey long, o_custkey long, o_orderpriority string, o_orderstatus string").write.parquet(f"{d}/orders.parquet")
    got = {r.bundle: r.text for r in plans._mixed(spark, d).collect()}
    assert set(got) == {0, 2, 9, None}
    assert got[0].startswith("doc one\n\nIn order to ship order 5") and got[2] == "doc far" and got[None] == "doc without id" and "order 900" in got[9]
    for name in ("safe", "balanced", "aggressive", "fallback_level"):
        assert {r.bundle for r in plans.QUERIES[f"reduce_{name}"](spark, d).collect()} == {0, 2, 9, None}


def test_negations_in_any_language_and_none(spark, tmp_path):
    rows = [(1, "I do not and never will", "en"), (2, "Not so", "de"), (3, "never", None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.negations for r in plans.QUERIES["negation_signature_all"](spark, str(tmp_path)).collect()}
    assert got == {1: ["never", "not"], 2: ["not"], 3: ["never"]}


def test_comments_in_code_stay(spark, tmp_path):
    rows = [(1, "a<!-- x -->b"), (2, "`<!-- kept -->` and <!-- gone -->end"), (3, "```\n<!-- kept -->\n```\n<!-- gone -->end")]
    spark.createDataFrame(rows, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r.html for r in plans.QUERIES["strip_html_comments_protected_all"](spark, str(tmp_path)).collect()}
    assert got == {1: "ab", 2: "`<!-- kept -->` and end", 3: "```\n<!-- kept -->\n```\nend"}


def test_examples_of_changes_and_of_lost_values(spark):
    from tersely.operators import measure

    rows = [("g", i, f"costs {i} now", f"costs {i}" if i < 6 else "costs") for i in range(1, 9)] + [("h", 1, "same", "same")]
    got = measure.examples(spark.createDataFrame(rows, "grp string, id long, text string, reduced string"), ["grp"]).collect()
    assert sorted((r.kind, r.grp, r.key) for r in got) == [("changed", "g", i) for i in (1, 2, 3)] + [("violation", "g", i) for i in (6, 7, 8)]
    assert {r.key: [float(x) for x in r.lost] for r in got if r.kind == "violation"} == {i: [float(i)] for i in (6, 7, 8)}
