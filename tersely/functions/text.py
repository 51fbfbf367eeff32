"""Text functions as Column expressions: they stay in the JVM and inside the scan's stage.

Java's classes are ASCII unless ``(?U)`` is given, and even then its white space lacks four separators and the
next-line family differs; ``SPACE`` says what Python calls white space.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K

SPACE = "[\\s\\x1c-\\x1f\\x85\\p{Z}]"
SOLID = "[^\\s\\x1c-\\x1f\\x85\\p{Z}]"
FENCE_MARK = "\x00\n\x00"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def words(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(f"{SOLID}+"), F.lit(0)))


def tokens(text: Column) -> Column:
    """The word-count estimate of tokens; ties go to the even number."""
    return F.bround(words(text) * F.lit(K.WORD_FACTOR), 0).cast("int")


def is_estimate(method: Column) -> Column:
    first, second = K.EXACT_METHODS
    return ~(method.startswith(first) | method.startswith(second))


def key(text: Column) -> Column:
    """What two texts must share to be the same: trimmed, white space collapsed, lower case."""
    return F.lower(F.regexp_replace(strip(text), f"{SPACE}+", " "))


def numbers(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit("(?U)-?\\d[\\d,]*(?:\\.\\d+)?"), F.lit(0))
    return F.transform(found, lambda n: F.replace(n, F.lit(","), F.lit("")))


def plain_numbers(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit("(?U)\\d+(?:\\.\\d+)?"), F.lit(0)))


def numbers_preserved(before: Column, after: Column) -> Column:
    return F.size(F.array_except(plain_numbers(before), plain_numbers(after))) == 0


def negations(text: Column) -> Column:
    """Marks of negation, lower case, sorted, with repeats."""
    found = F.regexp_extract_all(text, F.lit(f"(?iU){K.NEGATION}"), F.lit(0))
    return F.array_sort(F.transform(found, F.lower))


def paragraphs(text: Column) -> Column:
    return F.filter(F.split(text, f"\\n{SPACE}*\\n"), lambda p: strip(p) != "")


def sentences(text: Column) -> Column:
    return F.split(text, f"(?<=[.!?]){SPACE}+")


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once: inside a lambda an expression would run for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def first_of_each(items: Column, key_of) -> Column:
    """The items whose key has not come before; arrays of one document, no shuffle."""
    return let(items, lambda p: let(F.transform(p, key_of), lambda keys: F.filter(
        p, lambda _, i: F.array_position(keys, F.element_at(keys, i + 1)) == i + 1)))


def drop_repeated_paragraphs(text: Column) -> Column:
    return F.array_join(first_of_each(paragraphs(text), key), "\n\n")


def drop_invisible(text: Column) -> Column:
    return F.translate(text, K.INVISIBLE, "")


def rtrim_lines(text: Column) -> Column:
    return F.array_join(F.transform(F.split(F.replace(text, F.lit("\t"), F.lit("    ")), "\n"), lambda x: F.regexp_replace(x, f"{SPACE}+$", "")), "\n")


def squeeze_whitespace(text: Column, no_blank: bool = False) -> Column:
    t = F.regexp_replace(rtrim_lines(text), "\\n{3,}", "\n\n")
    if no_blank:
        t = F.array_join(F.filter(F.split(t, "\n"), lambda x: x != ""), "\n")
    return F.btrim(t, F.lit("\n"))


def drop_comments(text: Column) -> Column:
    """For text without code; the kernel of that name protects code."""
    return F.regexp_replace(text, "(?s)<!--.*?-->", "")


def shorten_phrases(text: Column, pairs=K.PHRASES) -> Column:
    """For text without code or quoted lines; a match that begins upper-case keeps that. Patterns are literals, which are
    compiled once a task, and a rule whose phrase a text has not costs a substring search; each step's text is bound
    once."""
    def rule(phrase: str, short: str):
        rest = f"(?i:{phrase[1:]})\\b"
        raised, low = f"(?U)\\b{phrase[0].upper()}{rest}", f"(?U)\\b{phrase[0]}{rest}"

        def apply(t: Column) -> Column:
            changed = F.regexp_replace(F.regexp_replace(t, raised, short[:1].upper() + short[1:]), low, short)
            return F.when(F.contains(F.lower(t), F.lit(phrase.lower())), changed).otherwise(t)

        return apply

    done = text
    for a, b in K.longest_first(pairs):
        done = let(done, rule(a, b))
    return F.regexp_replace(F.regexp_replace(done, "[ \\t]{2,}", " "), f"{SPACE}+([.,;:!?])", "$1")


def pack_json(text: Column) -> Column:
    """White space outside strings goes; possessive, so that long strings need no stack."""
    return F.regexp_replace(text, '("[^"\\\\]*+(?:\\\\.[^"\\\\]*+)*+")|[ \\t\\n\\r]+', "$1")


def tidy_lines(text: Column, blanks: str = "collapse") -> Column:
    lines = F.split(rtrim_lines(text), "\n")
    if blanks == "remove":
        lines = F.filter(lines, lambda x: x != "")
    elif blanks == "collapse":
        lines = let(lines, lambda all_: F.filter(all_, lambda x, i: (x != "") | (i == 0) | (F.element_at(all_, F.greatest(i, F.lit(1))) != "")))
    return F.btrim(F.array_join(lines, "\n"), F.lit("\n"))


def tidy_markdown(text: Column) -> Column:
    """For text without code or quoted lines."""
    t = F.regexp_replace(F.regexp_replace(text, "(?m)[ \\t]+$", ""), "\\n{3,}", "\n\n")

    def line(x: Column) -> Column:
        x = F.regexp_replace(x, "^(#{1,6}[ \\t].*?)[ \\t]+#+[ \\t]*$", "$1")
        bullet = F.regexp_replace(x, f"^({SPACE}*)[-*+][ \\t]+", "$1- ")
        ordered = F.regexp_replace(x, f"(?U)^({SPACE}*\\d+[.)])[ \\t]{{2,}}", "$1 ")
        is_break = x.rlike(f"^{SPACE}{{0,3}}([-*_])[ \\t]*(?:\\1[ \\t]*){{2,}}$")
        return F.when(is_break, x).when(x.rlike(f"^{SPACE}*[-*+][ \\t]+"), bullet).otherwise(ordered)

    return F.array_join(F.transform(F.split(t, "\n"), line), "\n")


def is_rule_row(line: Column) -> Column:
    return line.rlike(f"^{SPACE}*\\|?{SPACE}*:?-+:?{SPACE}*(?:\\|{SPACE}*:?-+:?{SPACE}*)+\\|?{SPACE}*$")


def is_row(line: Column) -> Column:
    return line.contains("|") & (strip(line) != "")


def is_list_item(line: Column) -> Column:
    return line.rlike(f"(?U)^{SPACE}*(?:[-*+]|\\d+[.)]){SPACE}+")


def item_content(line: Column) -> Column:
    return F.regexp_extract(line, f"(?U)^{SPACE}*(?:[-*+]|\\d+[.)]){SPACE}+(.*)$", 1)


def compact_row(line: Column) -> Column:
    """A table row without code or escaped bars, its cells trimmed, its rule as short as can be."""
    core = strip(line)
    inner = F.regexp_replace(core, "^\\||\\|$", "")
    rule = is_rule_row(line)
    cells = F.transform(F.split(inner, "\\|"), lambda c: F.when(rule, F.regexp_replace(strip(c), "-+", "-")).otherwise(strip(c)))
    edge = lambda test: F.when(test, F.lit("|")).otherwise(F.lit(""))
    return F.concat(F.regexp_extract(line, f"^{SPACE}*", 0), edge(core.startswith("|")), F.array_join(cells, "|"), edge(core.endswith("|")))


# --- code ----------------------------------------------------------------------------------------------------


def language(path: Column) -> Column:
    suffix = F.lower(F.regexp_extract(path, "[^/\\\\.][^/\\\\]*\\.([^./\\\\]+)$", 1))
    out = F.lit("unknown")
    for lang, known in K.EXTENSIONS.items():
        out = F.when(suffix.isin(*known), F.lit(lang)).otherwise(out)
    return F.coalesce(out, F.lit("unknown"))


def is_directive(comment: Column) -> Column:
    low = F.lower(strip(comment))
    return low.startswith("#!") | F.exists(F.array(*[F.lit(k) for k in K.DIRECTIVES]), lambda k: F.contains(low, k))


def strip_line_comments(src: Column, marker: str) -> Column:
    """Cuts lines at a marker outside quotes; directives stay."""
    quoted = "\"(?:\\\\.|[^\"\\\\])*+(?:\"|\\\\?$)|'(?:\\\\.|[^'\\\\])*+(?:'|\\\\?$)"
    code = f"^(?:{quoted}|(?!{marker})[^\"'])*+"

    def one(x: Column) -> Column:
        ahead = F.regexp_extract(x, code, 0)
        comment = F.substring(x, F.length(ahead) + 1, F.length(x))
        return F.when((comment == "") | is_directive(comment), x).otherwise(F.regexp_replace(ahead, f"{SPACE}+$", ""))

    pairs = F.transform(F.split(src, "\n"), lambda x: F.struct(x.alias("line"), one(x).alias("cut")))
    kept = F.filter(pairs, lambda x: (x["cut"] != "") | (x["line"] == ""))
    return F.array_join(F.transform(kept, lambda x: x["cut"]), "\n")


def strip_block_comments(src: Column) -> Column:
    """C-family comments out of source without directives; literals stay."""
    literal = "\"(?:\\\\.|[^\"\\\\])*+\"|'(?:\\\\.|[^'\\\\])*+'|`(?:\\\\.|[^`\\\\])*+`"
    return F.regexp_replace(src, f"(?s)({literal})|//[^\\n]*+|/\\*.*?(?:\\*/|\\z)", "$1")


# --- required spans and fidelity -----------------------------------------------------------------------------


def without_code(text: Column) -> Column:
    """Fences and inline code out. A removed fence leaves a mark with a line break until inline code is gone, so
    that no inline span reaches across it."""
    t = F.regexp_replace(text, f"(?s){K.FENCE}", FENCE_MARK)
    return F.replace(F.regexp_replace(t, K.INLINE, ""), F.lit(FENCE_MARK), F.lit(""))


def code_spans(text: Column) -> Column:
    fences = F.regexp_extract_all(text, F.lit(f"(?s){K.FENCE}"), F.lit(0))
    inline = F.regexp_extract_all(F.regexp_replace(text, f"(?s){K.FENCE}", FENCE_MARK), F.lit(K.INLINE), F.lit(0))
    return F.array_sort(F.array_distinct(F.concat(fences, F.filter(inline, lambda x: F.regexp_replace(x, "[` ]", "") != ""))))


def quotes(text: Column) -> Column:
    lines = F.filter(F.transform(F.split(text, "\n"), strip), lambda x: x.startswith(">"))
    return F.array_sort(F.array_union(lines, F.regexp_extract_all(without_code(text), F.lit('"[^"\\n]+"'), F.lit(0))))


def missing_in_order(source: Column, digest: Column) -> Column:
    """Numbers of the source without a match in the digest from where the last match was."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("missing"))

    def step(state: Column, n: Column, found: Column) -> Column:
        rest = F.slice(found, state["at"] + 1, F.greatest(F.size(found) - state["at"], F.lit(0)))
        hit = F.array_position(rest, n).cast("int")
        return F.struct(F.when(hit > 0, state["at"] + hit).otherwise(state["at"]).alias("at"),
                        F.when(hit > 0, state["missing"]).otherwise(F.concat(state["missing"], F.array(n))).alias("missing"))

    return let(digest, lambda found: F.aggregate(source, start, lambda s, n: step(s, n, found), lambda s: s["missing"]))


def absent(spans: Column, digest: Column) -> Column:
    return F.array_sort(F.filter(spans, lambda s: ~F.contains(digest, s)))


# --- answers -------------------------------------------------------------------------------------------------

# What a number looks like in an answer, and what announces one.
NUM_CORE = "\\d[\\d,]*(?:\\.\\d+)?%?"
MARKER = ("(?i)(?:final answer is|final answer|the answer is|answer is|answer)\\s*[:\\-]?\\s*"
          "(?:actually|really|indeed|therefore|thus|now|approximately|about|roughly|around|equal to|equals|=)?\\s*(-?\\$?" + NUM_CORE + ")")


def as_number(token: Column) -> Column:
    plain = F.regexp_replace(F.regexp_replace(F.trim(token), "[.,;:!?)。]+$", ""), "^\\(+|[$,%]", "")
    return plain.try_cast("double")


def last_match(text: Column, pattern: str, group: int) -> Column:
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    return F.when(F.size(found) > 0, F.element_at(found, -1))


def gold_answer(text: Column) -> Column:
    return as_number(last_match(text, f"(?U)####\\s*(-?\\$?{NUM_CORE})", 1))


def predicted_answer(text: Column) -> Column:
    """The last marked number of the last line, else of the text, else the last number."""
    lines = F.filter(F.split(text, "[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029]"), lambda x: strip(x) != "")
    last_line = F.when(F.size(lines) > 0, F.element_at(lines, -1))
    return as_number(F.coalesce(last_match(last_line, f"(?U){MARKER}", 1), last_match(text, f"(?U){MARKER}", 1),
                                last_match(text, f"(?U)(?<![\\w.])-?\\$?{NUM_CORE}", 0)))


def answers_match(gold: Column, predicted: Column, tolerance: float = 1e-4) -> Column:
    return F.coalesce(F.abs(gold - predicted) < tolerance, F.lit(False))


def value_set(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(f"(?U)(?<![\\w.])-?\\$?{NUM_CORE}"), F.lit(0))
    return F.array_distinct(F.filter(F.transform(found, as_number), lambda x: x.isNotNull()))


def lost_values(before: Column, after: Column) -> Column:
    """Values of ``before`` that ``after`` no longer has, as sorted text."""
    return F.array_sort(F.transform(F.array_except(value_set(before), value_set(after)), lambda x: x.cast("string")))
