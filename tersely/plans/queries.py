"""One query for each operator, over texts that the star-schema tables are made into, and DuckDB SQL for those
that SQL can say. The recipes are bounded: a bundle holds a hundred documents whatever the size of the table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import text as X
from ..operators import chunks, dedup, evaluate, fidelity, measure, reduce
from ..sources import readers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# --- recipes, each in both languages --------------------------------------------------------------------------

SOLID = "[^\\s\\x1c-\\x1f\\x85\\p{Z}]+"
GAP = "[\\s\\x1c-\\x1f\\x85\\p{Z}]"


def sql_tokens(x: str) -> str:
    return f"CAST(round_even(len(regexp_extract_all({x}, '{SOLID}')) * CAST(1.3 AS DOUBLE), 0) AS INTEGER)"


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{GAP}+|{GAP}+$', '', 'g')"


def sql_key(x: str) -> str:
    return f"lower(regexp_replace({sql_strip(x)}, '{GAP}+', ' ', 'g'))"


def bundles(spark: SparkSession, d: str, separator: str = "\n\n", column: str = "text") -> DataFrame:
    docs = table(spark, d, "documents").select(F.floor(F.col("doc_id") / 100).cast("long").alias("bundle"), "doc_id", F.col("text").alias(column))
    return dedup.rebuild(docs.repartition(_tasks(spark), "bundle"), "bundle", column, "doc_id", separator)


def _tasks(spark: SparkSession) -> int:
    """A bundle is little data but much work: a number of partitions that is asked for is not coalesced by size."""
    return 2 * max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


BUNDLES = "SELECT CAST(doc_id // 100 AS BIGINT) AS bundle, string_agg(text, chr(10) || chr(10) ORDER BY doc_id) AS text FROM documents GROUP BY 1"
NOTE = ("'In order to ship order ' || o_orderkey || ', it is important to note that a large number of items left prior to day ' || o_custkey || '. "
        "Basically, ' || lower(o_orderpriority) || ' work is due at this point in time ; see ' || o_orderstatus || '.'")
NOTES = f"SELECT o_orderkey, {NOTE} AS text FROM orders"


def view(spark: SparkSession, d: str, *names: str) -> SparkSession:
    for name in names:
        table(spark, d, name).createOrReplaceTempView(name)
    return spark


def notes(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "orders").sql(NOTES)


def transcripts(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "conversations").select("conv_id", "turn", F.concat("role", F.lit(": "), "text").alias("line"))
    return dedup.rebuild(t, "conv_id", "line", "turn", "\n\n")


TRANSCRIPTS = "SELECT conv_id, string_agg(role || ': ' || text, chr(10) || chr(10) ORDER BY turn) AS text FROM conversations GROUP BY 1"


def bullet_lists(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_brand", "p_partkey", F.concat(F.lit("*  "), "p_name").alias("line"))
    return dedup.rebuild(p, "p_brand", "line", "p_partkey", "\n")


LISTS = "SELECT p_brand, string_agg('*  ' || p_name, chr(10) ORDER BY p_partkey) AS text FROM part GROUP BY 1"
ROW = "'|  ' || n_name || '  |   ' || n_nationkey || '   |'"


def tables_md(spark: SparkSession, d: str) -> DataFrame:
    n = view(spark, d, "nation").sql(f"SELECT n_regionkey, n_nationkey, {ROW} AS line FROM nation")
    out = dedup.rebuild(n, "n_regionkey", "line", "n_nationkey", "\n", "rows")
    return out.select("n_regionkey", F.concat(F.lit("|  name |  key  |\n| :--- | ---: |\n"), "rows").alias("text"))


TABLES = (f"SELECT n_regionkey, '|  name |  key  |' || chr(10) || '| :--- | ---: |' || chr(10) || string_agg({ROW}, chr(10) ORDER BY n_nationkey) AS text "
          "FROM nation GROUP BY 1")

# --- scans, tokens, keys ---------------------------------------------------------------------------------------


@query(f"SELECT doc_id, CAST(length(text) AS INTEGER) AS chars, CAST(len(regexp_extract_all(text, '{SOLID}')) AS INTEGER) AS words, "
       f"{sql_tokens('text')} AS tokens FROM documents")
def scan_documents_stats(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", F.length(t).alias("chars"), X.words(t).alias("words"), X.tokens(t).alias("tokens"))


def _tokens_by(column):
    def f(spark, d):
        return table(spark, d, "documents").groupBy(column).agg(F.sum(X.tokens(F.col("text"))).alias("tokens"), F.count("*").alias("n"))

    f.__name__ = f"token_count_by_{column}"
    return query(f"SELECT {column}, CAST(sum({sql_tokens('text')}) AS BIGINT) AS tokens, count(*) AS n FROM documents GROUP BY 1")(f)


_tokens_by("lang")
_tokens_by("source")
NUMBERS = "list_transform(regexp_extract_all(text, '-?\\d[\\d,]*(?:\\.\\d+)?'), lambda x: replace(x, ',', ''))"


@query(f"SELECT doc_id, {NUMBERS} AS numbers FROM documents")
def numeric_literals(spark, d):
    return table(spark, d, "documents").select("doc_id", X.numbers(F.col("text")).alias("numbers"))


@query(f"SELECT array_to_string({NUMBERS}, ' ') AS numbers, count(*) AS n FROM documents GROUP BY 1")
def numeric_tuple_blocks(spark, d):
    return table(spark, d, "documents").groupBy(F.array_join(X.numbers(F.col("text")), " ").alias("numbers")).agg(F.count("*").alias("n"))


_NEG = K.NEGATION.replace("'", "''")


@query(f"SELECT doc_id, list_sort(list_transform(regexp_extract_all(text, '(?i){_NEG}'), lambda x: lower(x))) AS negations FROM documents WHERE lang = 'en'")
def negation_signature(spark, d):
    return table(spark, d, "documents").where("lang = 'en'").select("doc_id", X.negations(F.col("text")).alias("negations"))


@query()
def negation_signature_all(spark, d):
    """Every document's, whatever its language; DuckDB's case rules are not held to it."""
    return table(spark, d, "documents").select("doc_id", X.negations(F.col("text")).alias("negations"))


@query(f"SELECT doc_id, {sql_key('text')} AS key FROM documents")
def normal_keys(spark, d):
    return table(spark, d, "documents").select("doc_id", X.key(F.col("text")).alias("key"))


# --- passes ----------------------------------------------------------------------------------------------------


@query("SELECT doc_id, text FROM documents")
def strip_invisibles(spark, d):
    t = table(spark, d, "documents").withColumn("text", F.replace("text", F.lit(" "), F.lit(" ​")))
    return t.select("doc_id", X.drop_invisible(F.col("text")).alias("text"))


_PADDED = "chr(10) || replace(replace(text, ' ', chr(9)), chr(10), '  ' || chr(10) || chr(10) || chr(10) || chr(10)) || '  ' || chr(10)"


def _squeezed(no_blank: bool) -> str:
    lines = f"list_transform(string_split(replace({_PADDED}, chr(9), '    '), chr(10)), lambda x: regexp_replace(x, '{GAP}+$', ''))"
    joined = f"regexp_replace(array_to_string({lines}, chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g')"
    if no_blank:
        joined = f"array_to_string(list_filter(string_split({joined}, chr(10)), lambda x: x <> ''), chr(10))"
    return f"SELECT doc_id, trim({joined}, chr(10)) AS text FROM documents"


def _padded(spark, d):
    t = F.replace(F.replace("text", F.lit(" "), F.lit("\t")), F.lit("\n"), F.lit("  \n\n\n\n"))
    return table(spark, d, "documents").select("doc_id", F.concat(F.lit("\n"), t, F.lit("  \n")).alias("text"))


@query(_squeezed(False))
def normalize_whitespace(spark, d):
    return _padded(spark, d).select("doc_id", X.squeeze_whitespace(F.col("text")).alias("text"))


@query(_squeezed(True))
def normalize_whitespace_drop_blank(spark, d):
    return _padded(spark, d).select("doc_id", X.squeeze_whitespace(F.col("text"), True).alias("text"))


@query("SELECT page_id, regexp_replace(html, '(?s)<!--.*?-->', '', 'g') AS html FROM pages")
def strip_html_comments(spark, d):
    return table(spark, d, "pages").select("page_id", X.drop_comments(F.col("html")).alias("html"))


@query("SELECT page_id, regexp_replace(html, '(?s)<!--.*?-->', '', 'g') AS html FROM pages WHERE html NOT LIKE '%`%' AND html NOT LIKE '%~~~%'")
def strip_html_comments_protected(spark, d):
    pages = table(spark, d, "pages").where("html NOT LIKE '%`%' AND html NOT LIKE '%~~~%'")
    return pages.select("page_id", reduce.one_pass(reduce.kernels.drop_comments)(F.col("html")).alias("html"))


@query()
def strip_html_comments_protected_all(spark, d):
    """Every page, those with code too, which the pass protects."""
    return table(spark, d, "pages").select("page_id", reduce.one_pass(reduce.kernels.drop_comments)(F.col("html")).alias("html"))


def _phrases_sql(x: str) -> str:
    for phrase, short in K.longest_first():
        raised = short[:1].upper() + short[1:]
        x = f"regexp_replace({x}, '\\b{phrase[0].upper()}(?i:{phrase[1:]})\\b', '{raised}', 'g')"
        x = f"regexp_replace({x}, '\\b{phrase[0]}(?i:{phrase[1:]})\\b', '{short}', 'g')"
    return f"regexp_replace(regexp_replace({x}, '[ \\t]{{2,}}', ' ', 'g'), '\\s+([.,;:!?])', '\\1', 'g')"


@query(f"SELECT o_orderkey, {_phrases_sql('text')} AS text FROM ({NOTES})")
def compress_phrases(spark, d):
    return notes(spark, d).select("o_orderkey", X.shorten_phrases(F.col("text")).alias("text"))


@query(f"SELECT o_orderkey, {_phrases_sql('text')} AS text FROM ({NOTES})")
def compress_phrases_protected(spark, d):
    return notes(spark, d).select("o_orderkey", reduce.one_pass(reduce.kernels.shorten_phrases)(F.col("text")).alias("text"))


@query("SELECT o_orderkey, regexp_replace(replace(replace(text, 'it is important to note that ', ''), 'Basically, ' || lower(o_orderpriority), "
       "upper(substr(lower(o_orderpriority), 1, 1)) || substr(lower(o_orderpriority), 2)), ' ;', ';') AS text "
       f"FROM (SELECT o_orderpriority, o_orderkey, {NOTE} AS text FROM orders)")
def trim_filler(spark, d):
    return notes(spark, d).select("o_orderkey", reduce.one_pass(reduce.kernels.trim_fillers)(F.col("text")).alias("text"))


@query()
def trim_filler_chains(spark, d):
    chain = F.concat(F.lit("Basically, actually, in conclusion, "), F.col("text"), F.lit(" Essentially `basically` actually, done. factually"))
    return notes(spark, d).select("o_orderkey", reduce.one_pass(reduce.kernels.trim_fillers)(chain).alias("text"))


_PARS = f"""p AS (SELECT bundle, unnest(list_filter(regexp_split_to_array(text, '\\n{GAP}*\\n'), lambda x: {sql_strip('x')} <> '')) AS par,
  generate_subscripts(list_filter(regexp_split_to_array(text, '\\n{GAP}*\\n'), lambda x: {sql_strip('x')} <> ''), 1) AS pos FROM ({BUNDLES})),
k AS (SELECT *, row_number() OVER (PARTITION BY bundle, {sql_key('par')} ORDER BY pos) AS r FROM p)"""
_EXACT = f"WITH {_PARS} SELECT bundle, string_agg(par, chr(10) || chr(10) ORDER BY pos) AS text FROM k WHERE r = 1 GROUP BY 1"


@query(_EXACT)
def exact_paragraph_dedup(spark, d):
    return bundles(spark, d).select("bundle", X.drop_repeated_paragraphs(F.col("text")).alias("text"))


@query(_EXACT)
def exact_paragraph_dedup_win(spark, d):
    return dedup.drop_repeated_paragraphs(bundles(spark, d), "bundle")


_SENTENCES = f"string_split(regexp_replace(par, '([.!?]){GAP}+', '\\1' || chr(1), 'g'), chr(1))"
_SENT_DEDUP = f"""WITH {_PARS.split('k AS')[0]}
s AS (SELECT bundle, pos, unnest({_SENTENCES}) AS sent, generate_subscripts({_SENTENCES}, 1) AS i FROM p),
r AS (SELECT *, {sql_key('sent')} AS key, row_number() OVER (PARTITION BY bundle, {sql_key('sent')} ORDER BY pos, i) AS r FROM s),
q AS (SELECT bundle, pos, {sql_strip("string_agg(sent, ' ' ORDER BY i)")} AS par FROM r WHERE r = 1 OR length(key) < 25 GROUP BY 1, 2)
SELECT bundle, string_agg(par, chr(10) || chr(10) ORDER BY pos) AS text FROM q WHERE par <> '' GROUP BY 1"""


@query(_SENT_DEDUP)
def sentence_dedup(spark, d):
    return dedup.drop_repeated_sentences(bundles(spark, d), "bundle")


@query(_SENT_DEDUP)
def sentence_dedup_fused(spark, d):
    return bundles(spark, d).select("bundle", reduce.one_pass(reduce.kernels.drop_repeated_sentences)(F.col("text")).alias("text"))


@query(f"""SELECT doc_id, CAST(len(l) AS BIGINT) AS n_lines, CAST(len(list_distinct(list_transform(l, lambda x: {sql_key('x')}))) AS BIGINT) AS n_distinct
FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)""")
def line_dedup_count(spark, d):
    lines = F.split("text", "\n")
    return table(spark, d, "documents").select("doc_id", F.size(lines).cast("long").alias("n_lines"),
                                               F.size(F.array_distinct(F.transform(lines, X.key))).cast("long").alias("n_distinct"))


@query(f"SELECT doc_id, text FROM (SELECT doc_id, text, row_number() OVER (PARTITION BY {sql_key('text')} ORDER BY doc_id) AS r FROM documents) WHERE r = 1")
def corpus_exact_dedup(spark, d):
    return dedup.drop_repeated_documents(table(spark, d, "documents").select("doc_id", "text"))


def _near_sentences(name, threshold):
    def f(spark, d):
        return table(spark, d, "documents").select("doc_id", reduce.one_pass(lambda t: reduce.kernels.drop_alike_sentences(t, threshold))(F.col("text")).alias("text"))

    f.__name__ = name
    return query()(f)


def _near_paragraphs(name, threshold):
    def f(spark, d):
        return bundles(spark, d).select("bundle", reduce.one_pass(lambda t: reduce.kernels.drop_alike_paragraphs(t, threshold))(F.col("text")).alias("text"))

    f.__name__ = name
    return query()(f)


_near_sentences("near_dup_sentences_95", 0.95)
_near_sentences("near_dup_sentences_90", 0.90)
_near_paragraphs("near_dup_paragraphs_92", 0.92)
_near_paragraphs("near_dup_paragraphs_90", 0.90)
_near_paragraphs("near_dup_paragraphs_85", 0.85)

_LIST_SQL = f"""WITH l AS (SELECT p_brand, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM ({LISTS})),
r AS (SELECT *, row_number() OVER (PARTITION BY p_brand, {sql_key("substr(line, 4)")} ORDER BY pos) AS r FROM l)
SELECT p_brand, string_agg(line, chr(10) ORDER BY pos) AS text FROM r WHERE r = 1 GROUP BY 1"""


@query(_LIST_SQL)
def list_dedup_exact(spark, d):
    return bullet_lists(spark, d).select("p_brand", reduce.one_pass(reduce.kernels.drop_repeated_items)(F.col("text")).alias("text"))


@query(_LIST_SQL)
def list_dedup_exact_win(spark, d):
    return dedup.drop_repeated_items(bullet_lists(spark, d), "p_brand", "text")


@query()
def list_dedup_near(spark, d):
    return bullet_lists(spark, d).select("p_brand", reduce.one_pass(lambda t: reduce.kernels.drop_repeated_items(t, True))(F.col("text")).alias("text"))


_TABLE_SQL = ("SELECT n_regionkey, '|name|key|' || chr(10) || '|:-|-:|' || chr(10) || string_agg('|' || n_name || '|' || n_nationkey || '|', chr(10) ORDER BY n_nationkey) AS text "
              "FROM nation GROUP BY 1")


@query(_TABLE_SQL)
def compact_tables(spark, d):
    return tables_md(spark, d).select("n_regionkey", reduce.one_pass(reduce.kernels.compact_tables)(F.col("text")).alias("text"))


@query(_TABLE_SQL)
def compact_tables_plain(spark, d):
    rows = F.transform(F.split("text", "\n"), X.compact_row)
    return tables_md(spark, d).select("n_regionkey", F.array_join(rows, "\n").alias("text"))


_MD = "'## ' || p_brand || ' ##' || chr(10) || replace(text, chr(10), '   ' || chr(10)) || chr(10) || chr(10) || chr(10) || '* * *' || chr(10) || '1.   end'"


def _markdown(spark, d):
    t = F.concat(F.lit("## "), "p_brand", F.lit(" ##\n"), F.replace("text", F.lit("\n"), F.lit("   \n")), F.lit("\n\n\n* * *\n1.   end"))
    return bullet_lists(spark, d).select("p_brand", t.alias("text"))


_MD_SQL = ("SELECT p_brand, '## ' || p_brand || chr(10) || replace(text, '*  ', '- ') || chr(10) || chr(10) || '* * *' || chr(10) || '1. end' AS text "
           f"FROM ({LISTS})")


@query(_MD_SQL)
def normalize_markdown(spark, d):
    return _markdown(spark, d).select("p_brand", X.tidy_markdown(F.col("text")).alias("text"))


@query(_MD_SQL)
def normalize_markdown_protected(spark, d):
    return _markdown(spark, d).select("p_brand", reduce.one_pass(reduce.kernels.tidy_markdown)(F.col("text")).alias("text"))


def _json(spark, d):
    wrapped = F.concat(F.lit('{ "id" : '), F.col("event_id").cast("string"), F.lit(' ,\n\t"note" : "a \\" b  c", "props" : '), F.coalesce("props", F.lit("null")), F.lit(" }\n"))
    return table(spark, d, "events").select("event_id", wrapped.alias("text"))


_PROPS = """regexp_replace(coalesce(props, 'null'), '("[^"]*")|[ \\t\\n\\r]+', '\\1', 'g')"""
_JSON_SQL = f"""SELECT event_id, '{{"id":' || event_id || ',"note":"a \\" b  c","props":' || {_PROPS} || '}}' AS text FROM events"""


@query(_JSON_SQL)
def minify_json_doc(spark, d):
    return _json(spark, d).select("event_id", reduce.one_pass(reduce.kernels.minify_json)(F.col("text")).alias("text"))


@query(_JSON_SQL)
def minify_json_plain(spark, d):
    return _json(spark, d).select("event_id", X.pack_json(F.col("text")).alias("text"))


@query(f"SELECT event_id, 'See:' || chr(10) || '```json' || chr(10) || text || chr(10) || '```' AS text FROM ({_JSON_SQL})")
def minify_json_fenced(spark, d):
    fenced = F.concat(F.lit("See:\n```json\n"), F.col("text"), F.lit("```"))
    return _json(spark, d).select("event_id", reduce.one_pass(reduce.kernels.minify_json)(fenced).alias("text"))


@query("SELECT event_id, event_id % 2 = 0 AS is_json FROM events")
def whole_json_gate(spark, d):
    t = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("\n "), "text")).otherwise(F.concat("text", F.lit(" x")))
    return _json(spark, d).select("event_id", reduce.whole_json(t).alias("is_json"))


# --- whole levels ------------------------------------------------------------------------------------------------


def _mixed(spark, d):
    """Bundles of documents and notes: all of either side, those without a number too."""
    n = notes(spark, d).select(F.floor(F.col("o_orderkey") / 100).cast("long").alias("bundle"), F.struct(F.lit(1).alias("side"), F.col("o_orderkey").cast("long").alias("pos")).alias("pos"), "text")
    docs = table(spark, d, "documents").select(F.floor(F.col("doc_id") / 100).cast("long").alias("bundle"), F.struct(F.lit(0).alias("side"), F.col("doc_id").cast("long").alias("pos")).alias("pos"), "text")
    return dedup.rebuild(docs.union(n).repartition(_tasks(spark), "bundle"), "bundle", "text", "pos", "\n\n")


def _level(name):
    def f(spark, d):
        return reduce.reduce_text(_mixed(spark, d), level=name).select("bundle", "reduced")

    f.__name__ = f"reduce_{name}"
    return query()(f)


for _name in K.LEVELS:
    _level(_name)


@query()
def reduce_fallback_level(spark, d):
    return reduce.reduce_text(_mixed(spark, d), level="unheard-of").select("bundle", "reduced")


@query(f"SELECT bundle, text AS reduced FROM ({BUNDLES})")
def reduce_overrides(spark, d):
    off = {k: False for k in ("json", "whitespace", "filler", "dedup", "sentence_dedup", "near_dedup", "near_dedup_sentences", "dedup_lists", "compact_tables", "markdown", "phrases")}
    return reduce.reduce_text(bundles(spark, d), level="balanced", **off).select("bundle", "reduced")


# --- code ----------------------------------------------------------------------------------------------------------

_CODE = {"hash": ("#", "hash"), "dash": ("--", "dash"), "ini": (";", "ini")}


def _code(lang, marker):
    line = f"'x = \"{marker} kept\"  {marker} note ' || l_orderkey"
    src = f"{line} || chr(10) || '{marker} gone' || chr(10) || 'y = ' || l_linenumber || ' {marker} TODO ' || l_partkey"

    def f(spark, d):
        t = view(spark, d, "lineitem").sql(f"SELECT l_orderkey, l_linenumber, {src} AS src FROM lineitem")
        return t.select("l_orderkey", "l_linenumber", reduce.code_reduced(F.col("src"), lang).alias("src"))

    f.__name__ = f"code_{lang}"
    clean = f"'x = \"{marker} kept\"' || chr(10) || 'y = ' || l_linenumber || ' {marker} TODO ' || l_partkey"
    query(f"SELECT l_orderkey, l_linenumber, {clean} AS src FROM lineitem")(f)

    def g(spark, d):
        t = view(spark, d, "lineitem").sql(f"SELECT l_orderkey, l_linenumber, {src} AS src FROM lineitem")
        return t.select("l_orderkey", "l_linenumber", X.strip_line_comments(F.col("src"), marker).alias("src"))

    g.__name__ = f"code_{lang}_plain"
    query(f"SELECT l_orderkey, l_linenumber, {clean} AS src FROM lineitem")(g)


for _lang, (_marker, _) in _CODE.items():
    _code(_lang, _marker)

_C_SRC = "'int a' || l_orderkey || ' = 1; // gone' || chr(10) || '/* gone' || chr(10) || ' too */ char *s = \"/* kept */ // kept\";' || chr(10) || '// eslint-disable' || chr(10) || 'f(`x // kept`);'"
_C_CLEAN = "'int a' || l_orderkey || ' = 1;' || chr(10) || ' char *s = \"/* kept */ // kept\";' || chr(10) || '// eslint-disable' || chr(10) || 'f(`x // kept`);'"


@query(f"SELECT l_orderkey, l_linenumber, {_C_CLEAN} AS src FROM lineitem")
def code_c(spark, d):
    t = view(spark, d, "lineitem").sql(f"SELECT l_orderkey, l_linenumber, {_C_SRC} AS src FROM lineitem")
    return t.select("l_orderkey", "l_linenumber", reduce.code_reduced(F.col("src"), "c").alias("src"))


@query(f"SELECT l_orderkey, l_linenumber, replace({_C_CLEAN}, '// eslint-disable', '') AS src FROM lineitem")
def code_c_plain(spark, d):
    t = view(spark, d, "lineitem").sql(f"SELECT l_orderkey, l_linenumber, {_C_SRC} AS src FROM lineitem")
    return t.select("l_orderkey", "l_linenumber", X.rtrim_lines(X.strip_block_comments(F.col("src"))).alias("src"))


_PY_SRC = ("'import os  # noqa' || chr(10) || 'X = ' || l_linenumber || '  # gone' || chr(10) || 'def f' || l_orderkey || '(a):' || chr(10) || '    \"\"\"Doc.\"\"\"' || chr(10) || '    # gone' || chr(10) || '    return \"# kept\"'")


def _python(spark, d):
    return view(spark, d, "lineitem").sql(f"SELECT l_orderkey, l_linenumber, {_PY_SRC} AS src FROM lineitem")


@query("SELECT l_orderkey, l_linenumber, 'import os  # noqa' || chr(10) || 'X = ' || l_linenumber || chr(10) || 'def f' || l_orderkey || '(a):' || chr(10) || '    \"\"\"Doc.\"\"\"' || chr(10) || '    return \"# kept\"' AS src FROM lineitem")
def code_python(spark, d):
    return _python(spark, d).select("l_orderkey", "l_linenumber", reduce.code_reduced(F.col("src"), "python").alias("src"))


@query("SELECT l_orderkey, l_linenumber, 'import os  # noqa' || chr(10) || 'X = ' || l_linenumber || chr(10) || 'def f' || l_orderkey || '(a):' || chr(10) || '    return \"# kept\"' AS src FROM lineitem")
def code_python_docstrings(spark, d):
    return _python(spark, d).select("l_orderkey", "l_linenumber", reduce.code_reduced(F.col("src"), "python", docstrings=True).alias("src"))


@query("SELECT l_orderkey, l_linenumber, 'import os  # noqa' || chr(10) || 'X = ' || l_linenumber || chr(10) || 'def f' || l_orderkey || '(a):' || chr(10) || '    ...' AS src FROM lineitem")
def code_skeleton(spark, d):
    return _python(spark, d).select("l_orderkey", "l_linenumber", reduce.code_reduced(F.col("src"), "python", fold=True).alias("src"))


_BLANKS = {"collapse": "chr(10) || chr(10)", "remove": "chr(10)", "keep": "chr(10) || '' || chr(10) || '' || chr(10) || chr(10)"}


def _tidy(mode):
    def f(spark, d):
        src = "chr(10) || 'a' || chr(9) || l_orderkey || '  ' || chr(10) || '  ' || chr(10) || chr(9) || chr(10) || chr(10) || 'b' || chr(10) || ' '"
        t = view(spark, d, "lineitem").sql(f"SELECT l_orderkey, l_linenumber, {src} AS src FROM lineitem")
        return t.select("l_orderkey", "l_linenumber", X.tidy_lines(F.col("src"), mode).alias("src"))

    f.__name__ = f"tidy_lines_{mode}"
    query(f"SELECT l_orderkey, l_linenumber, 'a    ' || l_orderkey || {_BLANKS[mode]} || 'b' AS src FROM lineitem")(f)


for _mode in _BLANKS:
    _tidy(_mode)

_ALL_EXT = [(e, lang) for lang, es in K.EXTENSIONS.items() for e in es] + [("txt", "unknown"), ("PY", "python")]
_PATHS = "'src/' || replace(p_name, ' ', '.') || '.' || {pick}"


@query("SELECT p_partkey, CASE " + " ".join(f"WHEN p_partkey % {len(_ALL_EXT)} = {i} THEN '{lang}'" for i, (_, lang) in enumerate(_ALL_EXT)) + " END AS lang FROM part")
def lang_detect_ext(spark, d):
    ext = F.element_at(F.array(*[F.lit(e) for e, _ in _ALL_EXT]), (F.col("p_partkey") % len(_ALL_EXT) + 1).cast("int"))
    path = F.concat(F.lit("src/"), F.replace("p_name", F.lit(" "), F.lit(".")), F.lit("."), ext)
    return table(spark, d, "part").select("p_partkey", X.language(path).alias("lang"))


_DIRECTIVE_SQL = " OR ".join(f"contains(lower(c), '{k}')" for k in K.DIRECTIVES)


@query(f"SELECT l_orderkey, l_linenumber, {_DIRECTIVE_SQL} AS keep FROM (SELECT *, CASE l_linenumber % 3 WHEN 0 THEN '# TODO ' || l_partkey WHEN 1 THEN '# plain' ELSE '// prettier-ignore' END AS c FROM lineitem)")
def directive_comments(spark, d):
    c = F.when(F.col("l_linenumber") % 3 == 0, F.concat(F.lit("# TODO "), "l_partkey")).when(F.col("l_linenumber") % 3 == 1, F.lit("# plain")).otherwise(F.lit("// prettier-ignore"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", X.is_directive(c).alias("keep"))


# --- measures --------------------------------------------------------------------------------------------------------

_SIGNALS = f"""SELECT *, CASE WHEN before_tokens > 0 THEN CAST(round_even((before_tokens - after_tokens) / CAST(before_tokens AS DOUBLE) * 100.0, 2) AS DOUBLE) ELSE 0.0 END AS saved_pct
FROM (SELECT b.bundle, {sql_tokens('b.text')} AS before_tokens, {sql_tokens('a.text')} AS after_tokens FROM ({BUNDLES}) b JOIN ({_EXACT}) a ON a.bundle = b.bundle)"""
_VERDICT = "CASE WHEN saved_pct >= 10 THEN 'tier1_sufficient' WHEN saved_pct < 5 AND before_tokens < 2000 THEN 'send_as_is' WHEN saved_pct < 5 THEN 'consider_semantic' ELSE 'modest' END"


def _signals(spark, d):
    b = bundles(spark, d)
    return measure.signals(b.withColumn("reduced", X.drop_repeated_paragraphs(F.col("text"))))


@query(f"SELECT bundle, before_tokens, after_tokens, before_tokens - after_tokens AS saved_tokens, saved_pct, '{K.METHOD}' AS method, true AS is_estimate FROM ({_SIGNALS})")
def redundancy_signals(spark, d):
    return _signals(spark, d).drop("text", "reduced")


@query(f"SELECT bundle, saved_pct, {_VERDICT} AS verdict, saved_pct < 5 AND before_tokens >= 200 AS note FROM ({_SIGNALS})")
def auto_verdict(spark, d):
    p, b = F.col("saved_pct"), F.col("before_tokens")
    return _signals(spark, d).select("bundle", "saved_pct", measure.verdict(p, b).alias("verdict"), measure.low_savings_note(p, b).alias("note"))


@query(f"SELECT {_VERDICT} AS verdict, count(*) AS n FROM ({_SIGNALS}) GROUP BY 1")
def verdict_histogram(spark, d):
    return _signals(spark, d).groupBy(measure.verdict(F.col("saved_pct"), F.col("before_tokens")).alias("verdict")).agg(F.count("*").alias("n"))


@query()
def zlib_density(spark, d):
    return table(spark, d, "documents").select("doc_id", reduce.density(F.col("text")).alias("density"))


@query()
def stats_lines(spark, d):
    return measure.stats_line(_signals(spark, d)).select("bundle", "line", "json")


@query(f"""SELECT bundle, t AS raw_tokens, CASE WHEN t > 15000 OR f > 8 OR s > 5 THEN 'large' ELSE 'small' END AS size,
CASE WHEN NOT (t > 15000 OR f > 8 OR s > 5) THEN NULL WHEN f > 8 OR (f > 0 AND s = 0) THEN 'refactor' WHEN s > 0 THEN 'research' ELSE 'unknown-large' END AS kind,
CASE WHEN t > 15000 OR f > 8 OR s > 5 THEN list_filter([CASE WHEN t > 15000 THEN 'raw context ~' || t || ' tok > 15000 threshold' END, CASE WHEN f > 8 THEN f || ' files > 8 threshold' END,
 CASE WHEN s > 5 THEN s || ' sources > 5 threshold' END], lambda x: x IS NOT NULL) ELSE ['below all thresholds'] END AS reasons
FROM (SELECT bundle, {sql_tokens('text')} AS t, CAST(bundle % 12 AS INTEGER) AS f, CAST(bundle * 3 % 8 AS INTEGER) AS s FROM ({BUNDLES}))""")
def classify_tasks(spark, d):
    b = bundles(spark, d).withColumn("files", (F.col("bundle") % 12).cast("int")).withColumn("sources", (F.col("bundle") * 3 % 8).cast("int"))
    return measure.classify(b, "text").select("bundle", "task.raw_tokens", "task.size", "task.kind", "task.reasons")


_CATS = "CASE doc_id % 3 WHEN 0 THEN 'redundant' WHEN 1 THEN 'unique' ELSE 'mixed' END"
_AFTER = "CASE level WHEN 'half' THEN substr(text, 1, length(text) // 2) ELSE replace(text, ' the', '') END"
_ROWS = f"""SELECT *, tokens_before - tokens_after AS saved, CASE WHEN tokens_before > 0 THEN CAST(round_even((tokens_before - tokens_after) / CAST(tokens_before AS DOUBLE) * 100.0, 1) AS DOUBLE) ELSE 0.0 END AS saved_pct
FROM (SELECT 'd' || doc_id AS name, {_CATS} AS category, level, {sql_tokens('text')} AS tokens_before, {sql_tokens('reduced')} AS tokens_after, CAST(length(text) AS INTEGER) AS chars_before,
 CAST(length(reduced) AS INTEGER) AS chars_after, '{K.METHOD}' AS method, true AS is_estimate,
 len(list_filter(list_distinct(regexp_extract_all(text, '\\d+(?:\\.\\d+)?')), lambda x: NOT list_contains(regexp_extract_all(reduced, '\\d+(?:\\.\\d+)?'), x))) = 0 AS numbers_preserved
 FROM (SELECT *, {_AFTER} AS reduced FROM documents, (VALUES ('half'), ('the')) v(level)))"""


def _report(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", F.explode(F.array(F.lit("half"), F.lit("the"))).alias("level"))
    cat = F.element_at(F.array(F.lit("redundant"), F.lit("unique"), F.lit("mixed")), (F.col("doc_id") % 3 + 1).cast("int"))
    half = F.substring(F.col("text"), F.lit(1), F.floor(F.length("text") / 2).cast("int"))
    after = F.when(F.col("level") == "half", half).otherwise(F.replace("text", F.lit(" the"), F.lit("")))
    return measure.corpus_rows(docs.select(F.concat(F.lit("d"), "doc_id").alias("name"), cat.alias("category"), "level", "text", after.alias("reduced")))


@query(_ROWS)
def corpus_report(spark, d):
    return _report(spark, d)


@query(f"""SELECT category, level, CAST(round_even(avg(saved_pct), 1) AS DOUBLE) AS mean_saved_pct, count(*) AS n, bool_or(is_estimate) AS any_estimate, bool_and(numbers_preserved) AS all_numbers_preserved
FROM ({_ROWS}) GROUP BY GROUPING SETS ((category, level), (category))""")
def corpus_means(spark, d):
    return measure.corpus_means(_report(spark, d))


@query()
def corpus_levels(spark, d):
    docs = table(spark, d, "documents").select(F.concat(F.lit("d"), "doc_id").alias("name"), F.lit("other").alias("category"), "text")
    return measure.corpus_rows(reduce.reduce_levels(docs, levels=("safe", "balanced")))


_DIAG = "SELECT o_orderkey, o_orderstatus, text, CASE o_orderkey % 3 WHEN 0 THEN text WHEN 1 THEN replace(text, 'In order to', 'To') ELSE substr(text, 1, 60) END AS reduced FROM (SELECT *, " + NOTE + " AS text FROM orders)"
_VALUES = "list_distinct(list_transform(regexp_extract_all({x}, '\\d[\\d,]*(?:\\.\\d+)?%?'), lambda v: CAST(replace(replace(v, ',', ''), '%', '') AS DOUBLE)))"
_LOST = f"list_filter({_VALUES.format(x='text')}, lambda v: NOT list_contains({_VALUES.format(x='reduced')}, v))"


def _diag(spark, d):
    return view(spark, d, "orders").sql(_DIAG)


@query(f"""SELECT o_orderstatus, count(*) AS n_items, count(*) FILTER (text <> reduced) AS n_changed, count(*) FILTER (len({_LOST}) > 0) AS n_numeric_fidelity_violations,
count(*) FILTER (length(text) > 1200) AS n_exceeds_tier2_threshold, round(avg((length(text) - length(reduced)) / CAST(length(text) AS DOUBLE) * 100.0), 6) AS mean_char_delta_pct,
min(CASE WHEN text <> reduced THEN o_orderkey END) AS first_changed FROM ({_DIAG}) GROUP BY 1""")
def reduction_diagnostics(spark, d):
    out = measure.diagnostics(_diag(spark, d), ["o_orderstatus"], key="o_orderkey")
    return out.withColumn("mean_char_delta_pct", F.round("mean_char_delta_pct", 6))


@query()
def reduction_examples(spark, d):
    return measure.examples(_diag(spark, d), ["o_orderstatus"], key="o_orderkey")


@query(f"SELECT o_orderkey, CAST(len({_LOST}) AS INTEGER) AS n_lost, list_sort({_LOST}) AS lost FROM ({_DIAG})")
def numeric_fidelity_loss(spark, d):
    lost = F.array_sort(F.array_except(X.value_set(F.col("text")), X.value_set(F.col("reduced"))))
    return _diag(spark, d).select("o_orderkey", F.size(lost).alias("n_lost"), lost.alias("lost"))


# --- chunks, spans, fidelity -------------------------------------------------------------------------------------------

_CHUNK_SQL = f"""WITH RECURSIVE a AS (SELECT conv_id, list_transform(list_filter(regexp_split_to_array(text, '\\n{GAP}*\\n'), lambda x: {sql_strip('x')} <> ''), lambda x: {sql_strip('x')}) AS atoms FROM ({TRANSCRIPTS})),
f AS (SELECT conv_id, atoms, 1 AS i, CAST([] AS VARCHAR[]) AS done, CAST(NULL AS VARCHAR) AS open FROM a
UNION ALL SELECT conv_id, atoms, i + 1,
 CASE WHEN open IS NULL OR length(open) + 2 + length(atoms[i]) <= 500 THEN done ELSE list_append(done, open) END,
 CASE WHEN open IS NOT NULL AND length(open) + 2 + length(atoms[i]) <= 500 THEN open || chr(10) || chr(10) || atoms[i] ELSE atoms[i] END FROM f WHERE i <= len(atoms))
SELECT conv_id, CASE WHEN open IS NULL THEN done ELSE list_append(done, open) END AS chunks FROM f WHERE i = len(atoms) + 1"""


@query(_CHUNK_SQL)
def chunk_text_plain(spark, d):
    return transcripts(spark, d).select("conv_id", chunks.chunked_plain(F.col("text"), 500).alias("chunks"))


@query(_CHUNK_SQL)
def chunk_text_500(spark, d):
    return transcripts(spark, d).select("conv_id", chunks.chunked(F.col("text"), 500).alias("chunks"))


@query()
def chunk_text_sentences(spark, d):
    return transcripts(spark, d).select("conv_id", chunks.chunked(F.col("text"), 300, "sentence").alias("chunks"))


@query("SELECT conv_id, c.i AS n, '" + chunks.SYSTEM.replace("'", "''") + "' AS system, '" + chunks.ASK.replace("'", "''").replace("\n", "' || chr(10) || '") +
       f"' || chunks[c.i] AS user_text FROM ({_CHUNK_SQL}), LATERAL (SELECT unnest(range(1, len(chunks) + 1)) AS i) c")
def compression_prompts(spark, d):
    p = transcripts(spark, d).select("conv_id", F.posexplode(chunks.prompts(chunks.chunked_plain(F.col("text"), 500))).alias("pos", "p"))
    return p.select("conv_id", (F.col("pos") + 1).cast("long").alias("n"), F.col("p.system").alias("system"), F.col("p.user").alias("user_text"))


_SPANNED = "text || chr(10) || '> quoted ' || conv_id || chr(10) || 'see `code_' || conv_id || '` and \"said ' || conv_id || '\" by Ada Byron 12,5' || chr(10) || '```' || chr(10) || 'x = \"' || conv_id || '\"' || chr(10) || '```'"


def _spanned(spark, d):
    transcripts(spark, d).createOrReplaceTempView("_transcripts")
    return spark.sql(f"SELECT conv_id, {_SPANNED} AS text FROM _transcripts")


_SPANNED_SQL = f"SELECT conv_id, {_SPANNED} AS text FROM ({TRANSCRIPTS})"


@query(f"SELECT conv_id, list_sort(list_distinct(list_concat(regexp_extract_all(text, '(?s)```.*?```|~~~.*?~~~'), regexp_extract_all(regexp_replace(text, '(?s)```.*?```|~~~.*?~~~', chr(10), 'g'), '`[^`\\n]*`')))) AS spans FROM ({_SPANNED_SQL})")
def required_spans_code(spark, d):
    return _spanned(spark, d).select("conv_id", X.code_spans(F.col("text")).alias("spans"))


_NOCODE = "regexp_replace(regexp_replace(text, '(?s)```.*?```|~~~.*?~~~', chr(10) || chr(1), 'g'), '`[^`\\n]*`', '', 'g')"


@query(f"""SELECT conv_id, list_sort(list_distinct(list_concat(list_filter(list_transform(string_split(text, chr(10)), lambda x: {sql_strip('x')}), lambda x: starts_with(x, '>')),
regexp_extract_all(replace({_NOCODE}, chr(10) || chr(1), ''), '"[^"\\n]+"')))) AS spans FROM ({_SPANNED_SQL})""")
def required_spans_quotes(spark, d):
    return _spanned(spark, d).select("conv_id", X.quotes(F.col("text")).alias("spans"))


@query(f"SELECT conv_id, {NUMBERS} AS spans FROM ({_SPANNED_SQL})")
def required_spans_numbers(spark, d):
    return _spanned(spark, d).select("conv_id", X.numbers(F.col("text")).alias("spans"))


@query()
def required_spans_all(spark, d):
    return _spanned(spark, d).select("conv_id", fidelity.spans(F.col("text")).alias("s")).select("conv_id", "s.*")


_PAIRS = f"SELECT o_orderkey, text AS source, CASE o_orderkey % 4 WHEN 0 THEN text WHEN 1 THEN replace(text, '`', '') WHEN 2 THEN substr(text, 1, 60) ELSE replace(text, '\"', '') END AS digest FROM (SELECT o_orderkey, {NOTE} || ' `run ' || o_custkey || '` \"quoted\" ' || o_orderkey AS text FROM orders)"
_N = "list_transform(regexp_extract_all({x}, '-?\\d[\\d,]*(?:\\.\\d+)?'), lambda v: replace(v, ',', ''))"


@query(f"""SELECT o_orderkey, list_filter(list_distinct(regexp_extract_all(source, '`[^`\\n]*`')), lambda s: NOT contains(digest, s)) AS missing_code,
list_filter(list_distinct(regexp_extract_all(regexp_replace(source, '`[^`\\n]*`', '', 'g'), '"[^"\\n]+"')), lambda s: NOT contains(digest, s)) AS missing_quotes, o_orderkey % 4 = 0 AS ok FROM ({_PAIRS})""")
def verify_fidelity_plain(spark, d):
    p = view(spark, d, "orders").sql(_PAIRS).withColumn("r", fidelity.verified_plain(F.col("source"), F.col("digest")))
    return p.select("o_orderkey", "r.missing_code", "r.missing_quotes", "r.ok")


@query()
def verify_fidelity(spark, d):
    p = fidelity.verify(view(spark, d, "orders").sql(_PAIRS))
    return p.select("o_orderkey", "fidelity.*", fidelity.summary(F.col("fidelity")).alias("summary"))


@query(f"""WITH RECURSIVE n AS (SELECT o_orderkey, {_N.format(x='source')} AS s, {_N.format(x='digest')} AS g FROM ({_PAIRS})),
f AS (SELECT o_orderkey, s, g, 1 AS i, 0 AS cur, CAST([] AS VARCHAR[]) AS missing FROM n
UNION ALL SELECT o_orderkey, s, g, i + 1, CASE WHEN coalesce(list_position(g[cur + 1 : len(g)], s[i]), 0) > 0 THEN cur + list_position(g[cur + 1 : len(g)], s[i]) ELSE cur END,
 CASE WHEN coalesce(list_position(g[cur + 1 : len(g)], s[i]), 0) > 0 THEN missing ELSE list_append(missing, s[i]) END FROM f WHERE i <= len(s))
SELECT o_orderkey, missing FROM f WHERE i = len(s) + 1""")
def ordered_number_loss(spark, d):
    p = view(spark, d, "orders").sql(_PAIRS)
    return p.select("o_orderkey", X.missing_in_order(X.numbers(F.col("source")), X.numbers(F.col("digest"))).alias("missing"))


@query()
def condense_offline_degrades(spark, d):
    return chunks.condense(transcripts(spark, d)).select("conv_id", "condensed")


@query()
def condense_fails_closed(spark, d):
    return chunks.condense(_spanned(spark, d), condenser=lambda system, user, budget: user[-40:]).select("conv_id", "condensed")


@query()
def condensing_plan(spark, d):
    return chunks.plan(transcripts(spark, d), most=800).select("conv_id", F.size("chunks").alias("n_chunks"), "required_spans")


# --- evaluation ----------------------------------------------------------------------------------------------------------

_ANSWERS = ("SELECT o_orderkey, 'Step 1: ' || o_custkey || '. #### 7 ' || chr(10) || '#### $' || o_orderkey || ',000' AS gold_text, "
            "'I guess the answer is ' || o_custkey || '.' || chr(10) || CASE o_orderkey % 4 WHEN 0 THEN 'Answer: $' || o_orderkey || ',000.' WHEN 1 THEN 'so ' || o_orderkey || '!' WHEN 2 THEN 'Final answer: actually -' || o_orderkey || '%' ELSE '' END AS reply FROM orders")
_PRED = "CASE o_orderkey % 4 WHEN 0 THEN o_orderkey * 1000.0 WHEN 2 THEN -1.0 * o_orderkey ELSE 1.0 * o_custkey END"


def _answers(spark, d):
    return view(spark, d, "orders").sql(_ANSWERS)


@query("SELECT o_orderkey, CAST(o_orderkey * 1000 AS DOUBLE) AS gold FROM orders")
def extract_gold(spark, d):
    return _answers(spark, d).select("o_orderkey", X.gold_answer(F.col("gold_text")).alias("gold"))


@query(f"SELECT o_orderkey, CAST({_PRED} AS DOUBLE) AS predicted FROM orders")
def extract_pred(spark, d):
    return _answers(spark, d).select("o_orderkey", X.predicted_answer(F.col("reply")).alias("predicted"))


@query(f"SELECT o_orderkey, abs(o_orderkey * 1000.0 - ({_PRED})) < 1e-4 AS correct FROM orders")
def answers_match(spark, d):
    a = _answers(spark, d)
    return a.select("o_orderkey", X.answers_match(X.gold_answer(F.col("gold_text")), X.predicted_answer(F.col("reply"))).alias("correct"))


_RESULTS = """SELECT o_orderkey AS id, v.condition, (o_orderkey * 7 + v.k * 3) % 10 < 8 AND (o_orderkey + v.k) % 37 <> 0 AS correct,
CASE WHEN (o_orderkey + v.k) % 37 = 0 OR (o_orderkey + v.k) % 41 = 0 THEN NULL ELSE CAST(o_orderkey AS DOUBLE) END AS predicted,
CAST(o_custkey % 90 AS INTEGER) AS input_tokens, CASE WHEN (o_orderkey + v.k) % 37 = 0 THEN 'timeout' END AS error, CAST(0 AS DOUBLE) AS latency_s
FROM orders, (VALUES ('baseline', 0), ('balanced', 1), ('safe', 2)) v(condition, k)"""


def _results(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey", F.explode(F.array(*[F.struct(F.lit(c).alias("condition"), F.lit(k).alias("k")) for k, c in enumerate(("baseline", "balanced", "safe"))])).alias("v"))
    i, k = F.col("id"), F.col("v.k")
    err = (i + k) % 37 == 0
    return o.select("id", "v.condition", (((i * 7 + k * 3) % 10 < 8) & ~err).alias("correct"), F.when(~err & ((i + k) % 41 != 0), i.cast("double")).alias("predicted"),
                    (F.col("o_custkey") % 90).cast("int").alias("input_tokens"), F.when(err, F.lit("timeout")).alias("error"), F.lit(0.0).alias("latency_s"))


_Z = evaluate.normal_quantile(0.975)


@query(f"""SELECT condition, n, correct, n_errors, n_unparseable, round(mean_input_tokens, 6) AS mean_input_tokens, round(correct / CAST(n AS DOUBLE), 6) AS accuracy,
round(greatest(0, (p + z2 / (2 * n) - sqrt((p * (1 - p) + z2 / (4 * n)) * z2 / n)) / (1 + z2 / n)), 6) AS low, round(least(1, (p + z2 / (2 * n) + sqrt((p * (1 - p) + z2 / (4 * n)) * z2 / n)) / (1 + z2 / n)), 6) AS high
FROM (SELECT condition, count(*) AS n, count(*) FILTER (correct) AS correct, count(*) FILTER (error IS NOT NULL) AS n_errors, count(*) FILTER (predicted IS NULL AND error IS NULL) AS n_unparseable,
 avg(input_tokens) AS mean_input_tokens, count(*) FILTER (correct) / CAST(count(*) AS DOUBLE) AS p, CAST({_Z!r} AS DOUBLE) * CAST({_Z!r} AS DOUBLE) AS z2 FROM ({_RESULTS}) GROUP BY 1)""")
def condition_summary(spark, d):
    s = evaluate.summarize(_results(spark, d))
    return s.select("condition", "n", "correct", "n_errors", "n_unparseable", F.round("mean_input_tokens", 6).alias("mean_input_tokens"), F.round("accuracy", 6).alias("accuracy"),
                    F.round(F.col("wilson_ci_95")[0], 6).alias("low"), F.round(F.col("wilson_ci_95")[1], 6).alias("high"))


_PAIRED = f"""SELECT *, CASE WHEN n_valid_pairs > 0 THEN round((c - b) / CAST(n_valid_pairs AS DOUBLE), 6) ELSE 0 END AS answer_stability_delta, CASE WHEN n_valid_pairs > 0 THEN round((b + c) / CAST(n_valid_pairs AS DOUBLE), 6) ELSE 0 END AS discordant_rate_psi
FROM (SELECT t.condition, count(*) FILTER (t.error IS NULL AND b.error IS NULL) AS n_valid_pairs, count(*) FILTER (t.error IS NOT NULL OR b.error IS NOT NULL) AS n_excluded_errors,
 count(*) FILTER (t.error IS NULL AND b.error IS NULL AND b.correct AND NOT t.correct) AS b, count(*) FILTER (t.error IS NULL AND b.error IS NULL AND NOT b.correct AND t.correct) AS c,
 count(*) FILTER (t.error IS NULL AND b.error IS NULL AND b.correct AND t.correct) AS both_correct, count(*) FILTER (t.error IS NULL AND b.error IS NULL AND NOT b.correct AND NOT t.correct) AS both_wrong
 FROM ({_RESULTS}) t JOIN ({_RESULTS}) b ON t.id = b.id AND b.condition = 'baseline' WHERE t.condition <> 'baseline' GROUP BY 1)"""


@query(_PAIRED)
def paired_compare(spark, d):
    c = evaluate.compare(_results(spark, d)).drop("mcnemar_exact_p")
    c = c.withColumnRenamed("baseline_correct_treatment_wrong", "b").withColumnRenamed("baseline_wrong_treatment_correct", "c")
    return c.withColumn("answer_stability_delta", F.round("answer_stability_delta", 6)).withColumn("discordant_rate_psi", F.round("discordant_rate_psi", 6))


@query("""WITH RECURSIVE g AS (SELECT b, c FROM range(0, 25) t(b), range(0, 25) u(c)),
f AS (SELECT b, c, CAST(0 AS BIGINT) AS x, CAST(1 AS DOUBLE) AS term, CAST(1 AS DOUBLE) AS total FROM g
UNION ALL SELECT b, c, x + 1, term * (b + c - x) / (x + 1), total + term * (b + c - x) / (x + 1) FROM f WHERE x < least(b, c))
SELECT b, c, CASE WHEN b + c = 0 THEN 1.0 ELSE round(least(1, 2 * total / pow(2, b + c)) + 1e-9, 6) END AS p FROM f WHERE x = least(b, c)""")
def mcnemar_p(spark, d):
    g = spark.range(25).withColumnRenamed("id", "b").withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(24)))).withColumn("c", F.col("c").cast("long"))
    return g.withColumn("p", F.round(evaluate.mcnemar_p(F.col("b"), F.col("c")) + F.lit(1e-9), 6))


_ZA, _ZB = evaluate.normal_quantile(0.975), evaluate.normal_quantile(0.8)


@query(f"""SELECT CAST(i AS BIGINT) AS i, CAST(ceil((p1 * (1 - p1) + p2 * (1 - p2)) * pow(CAST({_ZA + _ZB!r} AS DOUBLE), 2) / pow(p1 - p2, 2)) AS BIGINT) AS n
FROM (SELECT i, 0.9 + i / 1000.0 AS p1, 0.85 - i / 500.0 AS p2 FROM range(0, 50) t(i)) """.replace("0.9 + i / 1000.0", "CAST(0.9 AS DOUBLE) + CAST(i AS DOUBLE) / 1000").replace("0.85 - i / 500.0", "CAST(0.85 AS DOUBLE) - CAST(i AS DOUBLE) / 500"))
def required_n(spark, d):
    g = spark.range(50).withColumnRenamed("id", "i")
    p1, p2 = F.lit(0.9) + F.col("i").cast("double") / 1000, F.lit(0.85) - F.col("i").cast("double") / 500
    return g.select("i", evaluate.pairs_for_two_proportions(p1, p2).alias("n"))


_GRID = ", ".join(f"({psi}, {dd}, {pw}, {evaluate.normal_quantile(pw)!r})" for psi in (0.05, 0.10, 0.15, 0.20) for dd in (0.03, 0.05) for pw in (0.8, 0.9))


@query(f"""SELECT psi, d, power, CAST(ceil(pow(sqrt(psi) * CAST({_ZA!r} AS DOUBLE) + z * sqrt(psi - d * d), 2) / (d * d)) AS BIGINT) AS pairs
FROM (SELECT CAST(psi AS DOUBLE) AS psi, CAST(d AS DOUBLE) AS d, CAST(power AS DOUBLE) AS power, CAST(z AS DOUBLE) AS z FROM (VALUES {_GRID}) v(psi, d, power, z))""")
def power_grid(spark, d):
    return evaluate.power_grid(spark)


@query()
def min_detectable(spark, d):
    c = evaluate.compare(_results(spark, d))
    return c.select("condition", evaluate.least_detectable_column(F.col("discordant_rate_psi"), F.col("n_valid_pairs")).alias("least"))


@query("SELECT o_orderkey, o_custkey FROM (SELECT *, row_number() OVER (ORDER BY md5('1337|' || o_orderkey), o_orderkey) AS r FROM orders) WHERE r <= 200")
def sample_md5(spark, d):
    return evaluate.sample_by_hash(table(spark, d, "orders"), 200, 1337, "o_orderkey").select("o_orderkey", "o_custkey")


@query()
def sample_shuffled(spark, d):
    return evaluate.sample_by_shuffle(table(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("question")), 20, 1337)


@query()
def evaluate_builtin(spark, d):
    items = readers.builtin_questions(spark).withColumn("id", F.monotonically_increasing_id())
    run = evaluate.run_conditions(items, evaluate.conditions(("safe", "balanced")), lambda q: f"Answer: {len(q)}")
    return evaluate.summarize(run).select("condition", "n", "correct", "n_errors", "n_unparseable")


@query("SELECT CAST(i AS INTEGER) AS ord, c AS condition FROM (VALUES (0, 'baseline'), (1, 'baseline_repeat'), (2, 'safe'), (3, 'balanced'), (4, 'aggressive')) v(i, c)")
def condition_list(spark, d):
    return evaluate.condition_table(spark)


@query("SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'redundant' WHEN p_partkey % 4 = 1 THEN 'unique' WHEN p_partkey % 4 = 2 THEN 'mixed' ELSE 'other' END AS category FROM part")
def corpus_category(spark, d):
    prefix = F.element_at(F.array(*map(F.lit, ["redundant_", "unique_", "mixed_", "notes_"])), (F.col("p_partkey") % 4 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", readers.category_of(F.concat(prefix, F.col("p_partkey").cast("string"), F.lit(".txt"))).alias("category"))


@query("SELECT o_orderkey, 'q ' || o_orderkey AS question, '#### ' || o_custkey AS answer FROM orders")
def parse_question_lines(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.to_json(F.struct(F.concat(F.lit("q "), "o_orderkey").alias("question"), F.concat(F.lit("#### "), "o_custkey").alias("answer"))).alias("value"))
    parsed = F.from_json("value", readers.QA, {"mode": "FAILFAST"})
    return o.select("o_orderkey", parsed.alias("r")).select("o_orderkey", "r.question", "r.answer")


# --- flagship ------------------------------------------------------------------------------------------------------------


@query(f"""SELECT lang, tokens_before, tokens_after, saved_pct, {_VERDICT.replace('before_tokens', 'tokens_before')} AS verdict FROM (
SELECT lang, tokens_before, tokens_after, CASE WHEN tokens_before > 0 THEN CAST(round_even((tokens_before - tokens_after) / CAST(tokens_before AS DOUBLE) * 100.0, 2) AS DOUBLE) ELSE 0.0 END AS saved_pct
FROM (SELECT lang, CAST(sum({sql_tokens('text')}) AS BIGINT) AS tokens_before, CAST(sum(CASE WHEN r = 1 THEN {sql_tokens('text')} ELSE 0 END) AS BIGINT) AS tokens_after
 FROM (SELECT lang, text, row_number() OVER (PARTITION BY lang, {sql_key('text')} ORDER BY doc_id) AS r FROM documents) GROUP BY 1))""")
def redundancy_by_language(spark, d):
    """What exact repeats cost each language: digests are ranked, texts never move."""
    docs = table(spark, d, "documents").select("lang", "doc_id", X.tokens(F.col("text")).alias("t"), F.sha2(X.key(F.col("text")).cast("binary"), 256).alias("k"))
    each = docs.groupBy("lang", "k").agg(F.sum("t").alias("all"), F.min_by("t", "doc_id").alias("one"))
    out = each.groupBy("lang").agg(F.sum("all").alias("tokens_before"), F.sum("one").cast("long").alias("tokens_after"))
    out = out.withColumn("saved_pct", measure.saved_pct(F.col("tokens_before"), F.col("tokens_after"), 2))
    return out.withColumn("verdict", measure.verdict(F.col("saved_pct"), F.col("tokens_before")))
