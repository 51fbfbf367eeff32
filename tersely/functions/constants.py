"""Fixed values of the operators: word lists, tables, thresholds and levels."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

# Filler phrases, in the order in which they are removed.
FILLERS = (
    "it is important to note that", "it should be noted that", "it is worth noting that", "please note that",
    "as previously mentioned", "as mentioned above", "as already stated", "as a matter of fact", "it goes without saying that",
    "the fact of the matter is that", "needless to say", "at the end of the day", "when all is said and done",
    "for all intents and purposes", "in the final analysis", "in conclusion", "to summarize", "to sum up", "basically",
    "essentially", "actually",
)

# Verbose phrases and their short forms, in file order; they are applied longest first.
PHRASES = (
    ("in order to", "to"), ("due to the fact that", "because"), ("for the reason that", "because"),
    ("in light of the fact that", "because"), ("on account of the fact that", "because"), ("in the event that", "if"),
    ("in the event of", "if"), ("at this point in time", "now"), ("at the present time", "now"),
    ("a large number of", "many"), ("a great deal of", "much"), ("has the ability to", "can"), ("have the ability to", "can"),
    ("is able to", "can"), ("are able to", "can"), ("was able to", "could"), ("in spite of the fact that", "although"),
    ("despite the fact that", "although"), ("with regard to", "about"), ("with respect to", "about"),
    ("in reference to", "about"), ("in the near future", "soon"), ("in the majority of cases", "usually"),
    ("the vast majority of", "most"), ("a sufficient number of", "enough"), ("in close proximity to", "near"),
    ("in the absence of", "without"), ("prior to", "before"), ("subsequent to", "after"), ("in addition to", "besides"),
    ("in conjunction with", "with"), ("for the purpose of", "for"), ("with the exception of", "except"), ("in order for", "so"),
    ("take into consideration", "consider"), ("make a decision", "decide"), ("give consideration to", "consider"),
    ("a number of", "several"), ("at all times", "always"), ("on a regular basis", "regularly"), ("in a timely manner", "promptly"),
    ("in the process of", "currently"),
)

# What a comment says that must stay.
DIRECTIVES = (
    "noqa", "type:", "pragma", "pylint", "pyright", "mypy", "flake8", "ruff", "isort", "fmt:", "yapf", "nosec", "coding:",
    "coding=", "eslint", "tslint", "ts-ignore", "ts-expect-error", "ts-nocheck", "prettier", "stylelint", "istanbul", "c8 ",
    "v8 ", "jshint", "jslint", "biome-ignore", "go:build", "go:generate", "go:embed", "clippy", "allow(", "deny(", "warn(",
    "rustfmt", "deno-lint", "sonar", "checkstyle", "spotless", "license", "copyright", "spdx", "todo", "fixme", "safety:", "nolint",
)

# File extensions by language family.
EXTENSIONS = {
    "python": ("py", "pyi"),
    "c": ("js", "jsx", "ts", "tsx", "mjs", "cjs", "c", "h", "cpp", "hpp", "cc", "hh", "cs", "java", "go", "rs", "swift", "kt",
          "kts", "scala", "php", "m", "mm", "dart", "proto"),
    "hash": ("sh", "bash", "zsh", "rb", "yml", "yaml", "toml", "pl", "r", "ps1"),
    "dash": ("lua", "sql"),
    "ini": ("ini", "cfg", "conf"),
}

# Marks that turn a sentence into its opposite; "n't" counts anywhere.
NEGATIONS = (
    "not", "no", "never", "without", "cannot", "can't", "won't", "don't", "doesn't", "didn't", "isn't", "aren't", "wasn't",
    "weren't", "hasn't", "haven't", "hadn't", "shouldn't", "wouldn't", "couldn't", "mustn't", "shan't", "needn't", "none",
    "nobody", "nothing", "nowhere", "nor", "neither",
)
NEGATION = r"\b(?:" + "|".join(NEGATIONS) + r")\b|n't"

# Characters that show nothing (zero-width space, non-joiner, joiner, byte-order mark, word joiner).
INVISIBLE = "​‌‍﻿⁠"
NUMBER = r"-?\d[\d,]*(?:\.\d+)?"
FENCE = r"```.*?```|~~~.*?~~~"
INLINE = r"`[^`\n]*`"
METHOD = "heuristic(words*1.3)"
# How the names of exact counting methods begin.
EXACT_METHODS = ("tiktoken", "anthropic-api")
WORD_FACTOR = 1.3
MIN_SENTENCE = 25
LIST_SIMILARITY = 0.90

# Verdicts (percent saved, tokens) and task sizes.
HIGH_PCT, LOW_PCT, SMALL_TOKENS, NOTE_TOKENS = 10.0, 5.0, 2000, 200
TASK_TOKENS, TASK_FILES, TASK_SOURCES = 15_000, 8, 5
CHUNK_CHARS, CONDENSE_CHARS = 6000, 1200


@dataclass(frozen=True)
class Level:
    """Which passes run, and how alike near-duplicates must be."""

    json: bool = True
    whitespace: bool = True
    invisibles: bool = True
    phrases: bool = True
    filler: bool = True
    dedup: bool = True
    sentence_dedup: bool = True
    near_dedup_sentences: bool = True
    similarity_sent: float = 0.95
    near_dedup: bool = True
    similarity: float = 0.90
    dedup_lists: bool = True
    dedup_lists_near: bool = False
    compact_tables: bool = True
    strip_html_comments: bool = False
    markdown: bool = True
    drop_all_blank: bool = False

    def with_(self, **overrides) -> "Level":
        """A copy with the overrides that are not None."""
        known = {f.name for f in fields(self)}
        return replace(self, **{k: v for k, v in overrides.items() if v is not None and k in known})


LEVELS = {
    "safe": Level(phrases=False, sentence_dedup=False, near_dedup_sentences=False, similarity=0.92, dedup_lists=False,
                  compact_tables=False, markdown=False),
    "balanced": Level(),
    "aggressive": Level(similarity_sent=0.90, similarity=0.85, dedup_lists_near=True, drop_all_blank=True),
}


def level_named(name: str, **overrides) -> Level:
    """An unknown name is the balanced level."""
    return LEVELS.get(name, LEVELS["balanced"]).with_(**overrides)


def longest_first(pairs=PHRASES) -> list[tuple[str, str]]:
    return sorted((p for p in pairs if p[0] and p[0].lower() != p[1].lower()), key=lambda p: -len(p[0]))
