"""Plans stay as they should be: what is per document does not shuffle, scans read what they need."""
import re

import pytest

from tersely.plans import queries as plans


def physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


NO_SHUFFLE = ["scan_documents_stats", "numeric_literals", "normal_keys", "normalize_whitespace", "strip_html_comments", "compress_phrases",
              "compress_phrases_protected", "trim_filler", "near_dup_sentences_95", "minify_json_doc", "minify_json_plain", "code_c", "code_python",
              "tidy_lines_collapse", "verify_fidelity", "extract_pred", "zlib_density", "line_dedup_count"]


@pytest.mark.parametrize("name", NO_SHUFFLE)
def test_no_exchange(spark, sf_dir, name):
    assert "Exchange" not in physical(plans.QUERIES[name](spark, sf_dir))


@pytest.mark.parametrize("name", ["scan_documents_stats", "normal_keys", "compress_phrases", "trim_filler_chains", "near_dup_sentences_95"])
def test_scans_read_only_what_is_used(spark, sf_dir, name):
    schema = re.search(r"ReadSchema: struct<([^>]*)", physical(plans.QUERIES[name](spark, sf_dir)))[1]
    assert "lang" not in schema and "n_chars" not in schema and "o_totalprice" not in schema and "o_orderdate" not in schema


def test_a_level_is_one_arrow_stage(spark, sf_dir):
    from tersely.operators import reduce

    docs = plans.table(spark, sf_dir, "documents")
    plan = physical(reduce.reduce_text(docs).select("doc_id", "reduced"))
    assert len(re.findall("ArrowEvalPython", plan)) == 1 and "BatchEvalPython" not in plan and "Exchange" not in plan


def test_texts_do_not_move_for_the_flagship(spark, sf_dir):
    plan = physical(plans.redundancy_by_language(spark, sf_dir))
    assert not any("text" in line for line in plan.split("\n") if "Exchange" in line)


def test_filters_reach_the_scan(spark, sf_dir):
    assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(lang,en\)", physical(plans.negation_signature(spark, sf_dir)))
