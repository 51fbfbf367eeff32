"""Rows that share an id or have none, the last duplicate, and reads that fail for another reason than a missing file."""
import math

import pytest
from pyspark.sql import functions as F

from tersely.functions import kernels
from tersely.operators import dedup, evaluate
from tersely.sources import readers


def test_repeated_documents(spark):
    rows = [(1, "a", 9), (2, "a", 9), (2, "b", 9), (None, "c", 9), (3, "d", 9), (3, "d", 9), (None, None, 9), (7, "", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n int").selectExpr("*", "'x' as digest", "'y' as row", "'z' as at")
    got = dedup.drop_repeated_documents(df)
    assert got.columns == df.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in got.collect()) == [(0, "c"), (1, "a"), (2, "b"), (3, "d"), (7, "")]


def test_repeated_sentences_of_rows_without_an_id(spark):
    s = "This is a sentence that is long enough. "
    rows = [(None, s * 2), (None, "Other words make a sentence that is long enough too."), (5, s * 2), (5, s), (6, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id or 0, r.text) for r in dedup.drop_repeated_sentences(df).collect()), key=str)
    want = sorted(((d or 0, kernels.drop_repeated_sentences(t or "")) for d, t in rows), key=str)
    assert got == want


def test_shuffled_sample_of_any_ids(spark):
    rows = [(10 * i + 5, f"q {i}", "a") for i in range(30)]
    plain = [(i, f"q {i}", "a") for i in range(30)]
    schema = "id long, question string, answer string"
    a = [r.question for r in evaluate.sample_by_shuffle(spark.createDataFrame(rows, schema), 8, 1337).collect()]
    b = [r.question for r in evaluate.sample_by_shuffle(spark.createDataFrame(plain, schema), 8, 1337).collect()]
    assert a == b and len(a) == 8


def test_least_detectable_is_where_the_need_is_met():
    za, zb = evaluate.normal_quantile(0.975), evaluate.normal_quantile(0.8)
    for psi in (0.01, 0.1, 0.3, 0.9):
        for n in (20, 100, 431, 5000):
            d = evaluate.least_detectable(psi, n)
            if d is not None:
                assert abs((za * psi**0.5 + zb * math.sqrt(psi - d * d)) ** 2 / (d * d) - n) < 1e-6 * n
    assert evaluate.least_detectable(0.1, 1) is None and evaluate.least_detectable(0, 10) is None and evaluate.least_detectable(0.1, 0) is None


def test_last_baseline_by_an_order(spark):
    rows = [(1, "baseline", True, 9.0, 1), (1, "baseline", False, 1.0, 2), (1, "x", True, 1.0, 3)]
    df = spark.createDataFrame(rows, "id long, condition string, correct boolean, latency_s double, line int").withColumn("error", F.lit(None).cast("string"))
    assert evaluate.compare(df, order="line").first().baseline_wrong_treatment_correct == 1
    assert evaluate.compare(df).first().both_correct == 1


def test_only_a_missing_file_gives_the_sample(spark, tmp_path):
    assert readers.read_verified(spark, str(tmp_path / "none.jsonl"), "0")[1] == "bundled_fallback"
    (tmp_path / "q.jsonl").write_text("{}")
    with pytest.raises(readers.DatasetIntegrityError):
        readers.read_verified(spark, str(tmp_path / "q.jsonl"), "0")
    assert readers.write_report(spark.range(3), str(tmp_path / "out")) == 0
    (tmp_path / "file").write_text("x")
    assert readers.write_report(spark.range(3), str(tmp_path / "file" / "below")) == 1


@pytest.mark.parametrize("text, want", [
    ("Basically, essentially, it works. Actually, in conclusion, so it does.", "It works. So it does."),
    ("We basically, know. needless to say, fine", "We know. Fine"),
    ("basically", ""), ("Yes! To sum up, élan", "Yes! Élan"), ("Basically, 3 things", "3 things"), ("it is actually, basically, so", "it is so")])
def test_filler_chains(text, want):
    assert kernels.trim_fillers(text) == want


@pytest.mark.parametrize("line, want", [("| a | b |", "|a|b|"), ("  a | `x | y` | b", "  a|`x | y`|b".replace("a|`x", "a| `x").replace("y`|b", "y` |b")), ("|", "||"), ("|| a", "||a"), ("a |", "a|")])
def test_rows(line, want):
    assert kernels.compact_row(line, False) == want
