"""Expressions and kernels of one meaning must agree; DataFrame operators on small rows."""
import pytest
from pyspark.sql import functions as F

from tersely.functions import codes, kernels as k
from tersely.functions import text as X
from tersely.operators import chunks, dedup, evaluate, fidelity, measure, reduce
from tersely.sources import readers
from tersely.streaming import texts as streams

TEXTS = [
    "", " ", "One two  three.\tFour!  \n\n\n\nfive\x1csix seven x", "Éa é ß Ça\n \nÉA  É SS ça\n\nend", "a\n\nA\n\n\nb\n\n b ",
    "n 1,250 and -3.5 or 2026-09-15, not No DON'T can't", "a​b﻿c", "In order to go, prior to noon ; due to the fact that 5\nAT ALL TIMES x",
    '{ "a" : [1 , "x \\" y"] }', "- a\n-  A\n* b\nx\n- a", "## h ##\n*  i\n***\n2)   j\n\n\n\nk  ",
    "a `x  y` \"q z\" \"w\n> quote  \nsee ```f \"no\"``` and `in` \"yes\"\n~~~\nfence\n~~~ tail", "Mr Ada met Bob Smith at NASA. The end is near Paris",
]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)] + [(99, None)], "id long, text string").cache()


def both(df, column, f):
    rows = df.select("text", column.alias("got")).collect()
    for r in rows:
        if r.text is None:
            assert r.got is None
        else:
            assert (tuple(r.got) if isinstance(r.got, list) else r.got) == f(r.text), repr(r.text)


CASES = {
    "key": (X.key, k.key_of), "numbers": (X.numbers, k.numbers), "negations": (X.negations, k.negations),
    "invisible": (X.drop_invisible, k.drop_invisible), "squeeze": (X.squeeze_whitespace, k.squeeze_whitespace),
    "squeeze_all": (lambda c: X.squeeze_whitespace(c, True), lambda t: k.squeeze_whitespace(t, True)),
    "paragraphs": (X.drop_repeated_paragraphs, k.drop_repeated_paragraphs), "words": (X.words, lambda t: len(t.split())),
    "tokens": (X.tokens, lambda t: round(len(t.split()) * 1.3)),
    "tidy": (X.tidy_lines, codes.tidy), "tidy_remove": (lambda c: X.tidy_lines(c, "remove"), lambda t: codes.tidy(t, "remove")),
    "code_spans": (X.code_spans, lambda t: tuple(sorted(fidelity.code(t)))), "quotes": (X.quotes, lambda t: tuple(sorted(fidelity.quotes(t)))),
    "without_code": (X.without_code, fidelity.prose), 
    "chunks": (lambda c: chunks.chunked_plain(c, 20), lambda t: tuple(chunks.pack([p.strip() for p in k.paragraphs(t)], 20))),
}


@pytest.mark.parametrize("name", CASES)
def test_expression_is_the_kernel(df, name):
    expression, kernel = CASES[name]
    both(df, expression(F.col("text")), kernel)


def test_forms_for_plain_text(df):
    plain = df.where("id in (2, 3, 4, 5, 7, 9, 10)")
    both(plain, X.shorten_phrases(F.col("text")), k.shorten_phrases)
    both(plain, X.tidy_markdown(F.col("text")), k.tidy_markdown)
    both(df.where("id = 8"), X.pack_json(F.col("text")), k.pack_json)


def test_udfs_pass_null_and_register(spark, df):
    assert df.select(reduce.reduced(F.col("text")).alias("r")).where("r is null").count() == 1
    names = reduce.register(spark)
    assert spark.sql("SELECT shorten_phrases('in order to x') a, reduce_safe('b  ') b, json_valid('{}') c").first()[:] == ("to x", "b", True)
    assert "reduce_aggressive" in names
    assert df.select(reduce.whole_json(F.col("text")).alias("j")).where("j").count() == 1
    levels = reduce.reduce_levels(df.where("id = 7")).collect()
    assert {r.level for r in levels} == {"safe", "balanced", "aggressive"}


def test_window_forms_are_the_kernels(df):
    rows = df.where("text is not null")
    want = {r.id: r.text for r in rows.collect()}
    assert {r.id: r.text for r in dedup.drop_repeated_paragraphs(rows, "id").collect()} == {i: k.drop_repeated_paragraphs(t) for i, t in want.items()}
    assert {r.id: r.text for r in dedup.drop_repeated_sentences(rows, "id", shortest=2).collect()} == {i: k.drop_repeated_sentences(t, 2) for i, t in want.items()}
    plain = {i: t for i, t in want.items() if "```" not in t and "~~~" not in t}
    got = {r.id: r.text for r in dedup.drop_repeated_items(rows.where(~F.col("text").rlike("```|~~~")), "id", "text").collect()}
    assert got == {i: k.drop_repeated_items(t) for i, t in plain.items()}
    assert dedup.drop_repeated_documents(df.union(df.selectExpr("id + 1000", "concat(' ', text)")), "id").count() <= len(TEXTS)


def test_fidelity():
    source = 'Ada Byron paid 5 to 10 for `x` and said "so it is" to NASA. The rest.'
    assert fidelity.report(source, source)["ok"]
    r = fidelity.report(source, source.replace("5 to 10", "10 to 5").replace("Byron", "B."))
    assert not r["ok"] and r["missing_numbers"] == ["10"] and "Ada Byron" in r["missing_proper_nouns"]
    assert fidelity.report("a", "a 1 2")["ok"]
    assert fidelity.names("The cat saw Rome. Then we left Oslo.\nParis is: Big") == {"Rome", "Oslo"}
    assert fidelity.lost_numbers(["1", "2", "1"], ["2", "1"]) == ["2", "1"] and fidelity.lost_numbers(["9", "2", "1"], ["2", "1"]) == ["9"]


def test_verify_and_summary(spark):
    df = spark.createDataFrame([("pay 5 to Bob Ray", "pay 5 to Bob Ray"), ("pay 5 `a`", "pay"), (None, "x")], "source string, digest string")
    got = fidelity.verify(df).withColumn("s", fidelity.summary(F.col("fidelity"))).collect()
    assert [(r.fidelity.ok, r.s) for r in got] == [(True, "(none)"), (False, "numbers=[5], code=1"), (True, "(none)")]


def test_chunks_keep_fences_whole(spark):
    text = "a a\n\n```\nx\n\ny\n```\n\nb. c! d"
    assert chunks.atoms(text) == ["a a", "```\nx\n\ny\n```", "b. c! d"]
    assert chunks.atoms(text, "sentence")[2:] == ["b.", "c!", "d"]
    assert chunks.pack(["aaaa", "bb", "c" * 30, "d"], 8) == ["aaaa\n\nbb", "c" * 30, "d"] and chunks.pack([], 5) == []
    p = chunks.plan(spark.createDataFrame([(text,)], "text string")).first()
    assert len(p.chunks) == len(p.prompts) == 1 and p.prompts[0].user.endswith(text.strip()) and p.required_spans.code


def test_condense_fails_closed(spark):
    df = spark.createDataFrame([("We paid 500 to Ada Byron.  Prior to that, no.",)], "text string")
    base = df.select(reduce.reduced(F.col("text"))).first()[0]
    run = lambda f: chunks.condense(df, condenser=f).first().condensed
    assert run(None) == base and run(lambda s, u, b: "gone") == base

    def boom(s, u, b):
        raise OSError

    assert run(boom) == base
    assert run(lambda s, u, b: "500 Ada Byron Prior") == "500 Ada Byron Prior"
    assert [chunks.budget("x" * n) for n in (0, 3000, 10**6)] == [256, 1256, 8192]


def test_verdicts_at_their_edges(spark):
    rows = [(10.0, 50), (9.99, 50), (5.0, 50), (4.99, 1999), (4.99, 2000), (0.0, 199)]
    df = spark.createDataFrame(rows, "p double, b int")
    got = [r[0] for r in df.select(measure.verdict(F.col("p"), F.col("b"))).collect()]
    assert got == ["tier1_sufficient", "modest", "modest", "send_as_is", "consider_semantic", "send_as_is"]
    assert [r[0] for r in df.select(measure.low_savings_note(F.col("p"), F.col("b"))).collect()] == [False, False, False, True, True, False]
    assert all(r[0] for r in df.select(measure.advice(measure.verdict(F.col("p"), F.col("b")), F.col("p"), F.col("b"))).collect())


def test_classify(spark):
    rows = [(None, 100, 0, 0), (None, 15001, 0, 0), (None, 0, 9, 6), (None, 0, 0, 6), (None, 15001, 3, 0), (None, 15001, 3, 1), ("one two", None, None, None)]
    df = spark.createDataFrame(rows, "t string, n int, files int, sources int")
    got = [r.task for r in measure.classify(df, "t", "n").collect()]
    assert [(g["size"], g["kind"]) for g in got] == [("small", None), ("large", "unknown-large"), ("large", "refactor"), ("large", "research"),
                                                    ("large", "refactor"), ("large", "research"), ("small", None)]
    assert got[2]["reasons"] == ["9 files > 8 threshold", "6 sources > 5 threshold"] and got[0]["reasons"] == ["below all thresholds"]
    assert got[6]["token_method"] == "heuristic(words*1.3)" and got[6]["raw_tokens"] == 3 and got[0]["token_method"] is None
    assert got[1]["thresholds"].asDict() == {"tokens": 15000, "files": 8, "sources": 5}


def test_answers(spark):
    gold = [("a\n#### 72", 72.0), ("#### 2,125", 2125.0), ("#### -10", -10.0), ("#### 3.5", 3.5), ("#### 1\n#### 0", 0.0), ("none", None)]
    predicted = [("Answer: 48", 48.0), ("the answer is $80,000.", 80000.0), ("Final answer: 20%", 20.0), ("Answer: -7", -7.0), ("answer is -7", 7.0), ("18-5 gives", 5.0),
                 ("no idea", None), ("The answer is 5.\nthe answer is actually 48", 48.0), ("answer: 3\nAnswer: 9", 9.0), ("we get 12 or 13!", 13.0), ("", None), (None, None), ("v2 beats 7", 7.0)]
    g = spark.createDataFrame([(i, t, v) for i, (t, v) in enumerate(gold)], "i int, t string, v double")
    p = spark.createDataFrame([(i, t, v) for i, (t, v) in enumerate(predicted)], "i int, t string, v double")
    assert [(r.t, r.g) for r in g.select("t", X.gold_answer(F.col("t")).alias("g"), "i").orderBy("i").collect()] == gold
    assert [(r.t, r.g) for r in p.select("t", X.predicted_answer(F.col("t")).alias("g"), "i").orderBy("i").collect()] == predicted


def test_statistics(spark):
    one = spark.range(1)
    low, high = one.select(evaluate.wilson(F.lit(50), F.lit(100))).first()[0]
    assert abs(low - 0.4038) < 1e-3 and abs(high - 0.5962) < 1e-3
    assert one.select(evaluate.wilson(F.lit(0), F.lit(0))).first()[0] == [0.0, 1.0]
    p = lambda b, c: one.select(evaluate.mcnemar_p(F.lit(b), F.lit(c))).first()[0]
    assert p(0, 0) == 1.0 and abs(p(1, 9) - 0.021484375) < 1e-9 and p(5, 5) == 1.0 and 0 < p(900, 1100) < 1e-4
    n = lambda psi, d: one.select(evaluate.pairs_for_mcnemar(F.lit(psi), F.lit(d))).first()[0]
    assert n(0.10, 0.05) <= 320 and n(0.01, 0.2) is None and n(0.1, 0.0) is None
    assert 600 < one.select(evaluate.pairs_for_two_proportions(F.lit(0.90), F.lit(0.85))).first()[0] < 750
    d = evaluate.least_detectable(0.10, n(0.10, 0.05))
    assert abs(d - 0.05) < 1e-3 and evaluate.least_detectable(0.0, 10) is None and evaluate.least_detectable(0.1, 1) is None


def test_paired_tally(spark):
    rows = [(0, True, True, None), (1, True, False, None), (2, False, False, None), (3, True, True, None), (4, True, False, "timeout")]
    both_ = [(i, c, ok, e if c == "t" else None) for i, b, t, e in rows for c, ok in (("baseline", b), ("t", t))]
    df = spark.createDataFrame([(i, c, ok, e, 0.0, 1) for i, c, ok, e in both_], "id long, condition string, correct boolean, error string, latency_s double, input_tokens int")
    r = evaluate.compare(df).first()
    assert (r.baseline_correct_treatment_wrong, r.n_excluded_errors, r.n_valid_pairs, r.answer_stability_delta, r.both_correct, r.both_wrong) == (1, 1, 4, -0.25, 2, 1)


def test_conditions_and_runs(spark):
    assert evaluate.conditions(("safe",), condensed=True) == ["baseline", "baseline_repeat", "safe", "safe+tier2"]
    items = readers.builtin_questions(spark).withColumn("id", F.monotonically_increasing_id())
    assert evaluate.run_conditions(items, ["baseline"], None).count() == 0 and evaluate.status(False) == "skipped_no_api"

    def solver(question):
        if "train" in question:
            raise TimeoutError("slow")
        return "Answer: 22"

    got = evaluate.run_conditions(items, ["baseline", "safe"], solver, retries=0)
    s = {r.condition: r for r in evaluate.summarize(got).collect()}
    assert s["baseline"].n == 10 and s["baseline"].correct == 1 and s["baseline"].n_errors == 1 and s["baseline"].n_unparseable == 0
    assert items.where(X.gold_answer(F.col("answer")).isNull()).count() == 0


def test_samples(spark):
    records = spark.createDataFrame([(i, '{"a":1}' if i == 3 else f"q{i}") for i in range(20)], "id long, question string")
    a, b = (evaluate.sample_by_shuffle(records, 19, 7).collect() for _ in range(2))
    assert a == b and 3 not in {r.id for r in a} and [r.id for r in a] == sorted(r.id for r in a)
    assert evaluate.sample_by_hash(records, 5, 1).collect() == evaluate.sample_by_hash(records.repartition(4), 5, 1).collect()


def test_sources(spark, tmp_path):
    folder = tmp_path / "corpus"
    folder.mkdir()
    for name, text in (("redundant_1.txt", "a\nb"), ("odd.txt", "c"), ("unique_x.txt", "d"), ("skip.md", "e")):
        (folder / name).write_text(text)
    assert [(r.name, r.category, r.text) for r in readers.read_corpus(spark, str(folder)).collect()] == [("odd.txt", "other", "c"), ("redundant_1.txt", "redundant", "a\nb"), ("unique_x.txt", "unique", "d")]
    (tmp_path / "m.py").write_text("x = 1  # c\n")
    assert readers.read_source_files(spark, str(tmp_path / "m.py")).first().lang == "python"
    data = '{"question": "q", "answer": "#### 1"}\n\n{"question": "r", "answer": "#### 2"}\n'
    (tmp_path / "qa.jsonl").write_text(data)
    good = readers.digest(data.encode())
    records, label = readers.read_verified(spark, str(tmp_path / "qa.jsonl"), good, 2)
    assert records.count() == 2 and label.startswith("verified")
    with pytest.raises(readers.DatasetIntegrityError):
        readers.read_verified(spark, str(tmp_path / "qa.jsonl"), "0" * 64)
    with pytest.raises(readers.DatasetIntegrityError):
        readers.read_verified(spark, str(tmp_path / "qa.jsonl"), good, 3)
    assert readers.read_verified(spark, str(tmp_path / "none.jsonl"), good)[1] == "bundled_fallback"
    assert readers.parse_questions(spark.createDataFrame([(x,) for x in data.split("\n")], "value string")).count() == 2
    md = tmp_path / "words.md"
    md.write_text("# t\n<!-- s -->\n```\n# c\nfoo bar => baz\nlonger phrase here => x\nsame => SAME\nno arrow\n```\n<!-- e -->\n")
    assert readers.read_phrases(spark, str(md), "<!-- s -->", "<!-- e -->") == (("longer phrase here", "x"), ("foo bar", "baz"))
    assert readers.read_fillers(spark, str(md), "<!-- s -->", "<!-- e -->")[-1] == "no arrow"
    assert len(readers.read_fillers(spark, str(tmp_path / "gone.md"), "a", "b")) == 21
    readers.write_texts(records.selectExpr("question as reduced"), str(tmp_path / "out"))
    assert readers.write_report(records, str(tmp_path / "rep")) == 0 and readers.write_report(records, "nofs://x/y") == 1


def test_streams(spark, tmp_path):
    source = tmp_path / "in"
    spark.createDataFrame([("2026-01-01 00:00:00", "in order to  x"), ("2026-01-01 00:01:00", "IN order to x"), ("2026-01-01 00:30:00", "y")], "ts string, text string") \
        .selectExpr("cast(ts as timestamp) ts", "text").write.parquet(str(source))
    stream = lambda: spark.readStream.schema("ts timestamp, text string").parquet(str(source))

    def run(df, name, mode="append"):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
        return spark.table(name).collect()

    assert sorted(r.reduced for r in run(streams.reduce_stream(stream()), "s1")) == ["To x", "to x", "y"]
    assert len(run(streams.drop_repeats(stream(), "ts"), "s2")) == 2
    assert sum(r.n for r in run(streams.savings_by_window(stream(), "ts"), "s3", "complete")) == 3


def test_report_rows(spark):
    df = spark.createDataFrame([("n", "unique", "safe", "one two 3", "one 3"), ("m", "unique", "safe", "4 5", "")], "name string, category string, level string, text string, reduced string")
    rows = {r.name: r for r in measure.corpus_rows(df).collect()}
    assert rows["n"].saved_pct == 25.0 and rows["n"].numbers_preserved and not rows["m"].numbers_preserved
    means = {(r.category, r.level): r for r in measure.corpus_means(measure.corpus_rows(df)).collect()}
    assert means[("unique", None)].mean_saved_pct == 62.5 and not means[("unique", "safe")].all_numbers_preserved
    line = measure.stats_line(measure.signals(df)).first()
    assert line.line.startswith("[stats] (estimated) tokens: 4 -> 3 (saved 1, 25.0%)") and '"saved_tokens":1' in line.json
