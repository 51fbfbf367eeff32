"""Toxicity by weak supervision (operator 5).

Voters are many weak signs that a text is toxic: words of a short seed lexicon in four languages, words and word
beginnings that the labelled rows suggest, patterns of form, and the given label itself. A generative label model
estimates, by expectation maximisation, how often each voter fires on toxic and on clean texts, the label like any
other; voters that fire together far more than their rates say count as one, sharing its weight. Its posterior
labels train a linear classifier over the same signs, whose logistic score is the result. Scores use nothing but
the text.

The fit reads at most ``most_rows`` distinct labelled texts, those with the smallest hash of their id among the rows
that are not held out. Every sign whose share among toxic texts chance hardly explains (at one in the root of all
signs seen) is a voter; their number is set by that test, not by a cap. Voters that fire on the very same texts are
fitted as one column that stands for all of them, which gives the weights that they would have one by one.

Edge cases: null text scores like the empty text; null labels and ids are not learned from; a repeated id has
its mean label, as has a repeated text, and a tie counts as toxic; without labels the seed lexicon alone decides;
a text of megabytes is scored whole; extra columns are kept, whatever their names, and a column named like a
result is replaced unless another name for the result is given; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, ship, unused

ship(__name__)

# A seed lexicon of common insults, English, German, French and Spanish.
SEEDS = ["idiot", "moron", "stupid", "loser", "scum", "trash", "pathetic", "worthless", "disgusting", "clown", "imbecile",
         "fool", "dumb", "ugly", "vermin", "filth", "garbage", "coward", "liar", "hate", "kill", "bastard", "jerk",
         "trottel", "dummkopf", "versager", "abschaum", "erbärmlich", "wertlos", "widerlich", "arschloch", "feigling", "lügner",
         "imbécile", "crétin", "connard", "salaud", "ordure", "minable", "débile", "dégoûtant", "menteur", "stupide",
         "idiota", "imbécil", "estúpido", "basura", "patético", "asqueroso", "escoria", "payaso", "mentiroso", "cobarde"]
SHORTEST, LONGEST = 3, 9
FORMS = ("many capitals", "many exclamations", "second person", "many symbols")
WORD = re.compile(r"[^\W\d_]+")
SECOND = re.compile(r"\b(?:you are|you're|du bist|tu es|eres)\b", re.IGNORECASE)
WHOLE = "$"


def signs(word: str) -> list[str]:
    """The signs of one lower-case word: its beginnings, and the word itself, marked as whole."""
    return [word[:n] for n in range(SHORTEST, min(len(word), LONGEST) + 1)] + [word + WHOLE]


def words_in(text: str) -> set[str]:
    return {m.group() for m in WORD.finditer(text.lower())} if len(text) > 1 << 20 else set(WORD.findall(text.lower()))


def forms(text: str) -> list[bool]:
    n = max(1, len(text))
    capitals = sum(map(str.isupper, text)) if text[:1] else 0
    return [capitals > 0.3 * n, text.count("!") > 0.01 * n + 2, SECOND.search(text) is not None,
            sum(map(text.count, "#$%&*")) > 0.03 * n]


@dataclass
class Model:
    voters: list[str]  # word signs; the forms follow
    weights: np.ndarray
    bias: float

    def scorer(self):
        table = {s: i for i, s in enumerate(self.voters)}
        weights, bias, first_form = self.weights, self.bias, len(self.voters)
        known: dict[str, tuple] = {}
        with_forms = bool(np.any(weights[first_form:]))

        def score(text: str | None) -> float:
            text = text or ""
            fired: set[int] = set()
            for w in words_in(text):
                hit = known.get(w)
                if hit is None:
                    if len(known) > 400_000:
                        known.clear()
                    hit = known[w] = tuple(table[s] for s in signs(w) if s in table)
                fired.update(hit)
            if with_forms:
                fired.update(first_form + i for i, f in enumerate(forms(text)) if f)
            z = bias + sum(weights[i] for i in sorted(fired))
            return float(1 / (1 + np.exp(-max(-30.0, min(30.0, z)))))

        return score


def held_out(doc_id):
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def training_rows(docs: DataFrame, labels: DataFrame, most_rows: int) -> DataFrame:
    """(text, label) of a bounded set of labelled texts, none of them held out, each text once.

    Ids are met and bounded before any text moves; of an id with several texts the smallest is taken.
    """
    known = (labels.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id")))
             .groupBy("doc_id").agg((F.avg("toxic") >= 0.5).cast("double").alias("label")))
    there = docs.select("doc_id").join(known, "doc_id").groupBy("doc_id").agg(F.first("label").alias("label"))
    chosen = there.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    one = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label"))
    return one.groupBy("text").agg((F.avg("label") >= 0.5).cast("double").alias("label"))


def candidates(rows: DataFrame) -> list[tuple[str, int]]:
    """(sign, group): the word signs that are signs of toxicity beyond chance, strongest first. The chance of such a
    share among n texts is at most exp(-evidence), which must be below one in the root of all signs seen. A group
    is what fires on the same texts."""
    def count(batches):
        from hashlib import blake2b

        sums: dict[str, list] = {}
        for batch in batches:
            for text, label in zip(batch.column(0), batch.column(1).to_pylist()):
                text = text.as_py()
                mark = int.from_bytes(blake2b(text.encode(), digest_size=8).digest()) >> 1
                for sign in {s for w in words_in(text) for s in signs(w)}:
                    entry = sums.setdefault(sign, [0, 0, 0])
                    entry[0] += 1
                    entry[1] += label >= 0.5
                    entry[2] ^= mark
        for at in range(0, len(names := list(sums)), 50_000):
            part = names[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), *[pa.array([sums[s][i] for s in part], pa.int64()) for i in range(3)]], ["sign", "n", "t", "texts"])

    n, t = rows.agg(F.count("*"), F.sum("label")).first()
    if not n or not t or t == n:
        return []
    p = float(t) / n
    counted = rows.mapInArrow(count, "sign string, n long, t long, texts long").groupBy("sign").agg(F.sum("n").alias("n"), F.sum("t").alias("t"), F.bit_xor("texts").alias("texts"))
    counted = cut(counted.where("n >= 3"))
    share = F.least(F.col("t") / F.col("n"), F.lit(1 - 1e-9))
    evidence_ = F.col("n") * (share * F.log(share / p) + (1 - share) * F.log((1 - share) / (1 - p)))
    good = counted.where(F.col("t") >= F.col("n") * max(0.5, p)).withColumn("e", F.round(evidence_, 6)).where(F.col("e") > 0.5 * math.log(counted.count() + 2))
    groups: dict[tuple, int] = {}
    return [(r["sign"], groups.setdefault((r["n"], r["t"], r["texts"]), len(groups))) for r in good.orderBy(F.col("e").desc(), "sign").collect()]


def votes(rows: DataFrame, columns: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(fires, labels) over the training rows, a column for each sign and form: a bounded matrix."""
    def fire(batches):
        table = {s: i for i, s in enumerate(columns)}
        for batch in batches:
            out = []
            for text in batch.column(0):
                text = text.as_py()
                own = {table[s] for w in words_in(text) for s in signs(w) if s in table}
                out.append(sorted(own) + [len(columns) + i for i, f in enumerate(forms(text)) if f])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.int32())), batch.column(1)], ["fired", "label"])

    got = sorted(rows.mapInArrow(fire, "fired array<int>, label double").collect(), key=lambda r: (r["fired"], r["label"]))  # ``most_rows`` at most
    x = np.zeros((len(got), len(columns) + len(FORMS)), np.float32)
    for i, r in enumerate(got):
        x[i, r["fired"]] = 1
    return x, np.array([r["label"] for r in got])


def blocks_of(x: np.ndarray, size: int = 1024):
    """A matrix in blocks of rows, in double precision, so that no second copy of it is held."""
    for at in range(0, len(x), size):
        yield slice(at, at + size), x[at : at + size].astype(np.float64)


def label_model(x: np.ndarray, y: np.ndarray, trust: float = 0.9, rounds: int = 25, copies: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Posterior labels and the voters' shares: naive Bayes voters with shared weights, the given label being one more
    voter whose rates are learned like theirs, from ``trust`` on. A voter's share falls with the voters that it is
    correlated with beyond what the label explains. A column stands for ``copies`` voters."""
    n, k = x.shape
    copies = np.ones(k) if copies is None else copies
    given = y > 0.5
    post = np.where(given, trust, 1 - trust)
    share = np.ones(k)
    for _ in range(rounds):
        on, off = post.sum() + 1, (1 - post).sum() + 1
        fired, fired_on, together = np.zeros(k), np.zeros(k), np.zeros((k, k))
        for rows, part in blocks_of(x):
            fired += part.sum(axis=0)
            fired_on += post[rows] @ part
        a, b = (fired_on + 0.05) / on, (fired - fired_on + 0.05) / off  # firing rates on toxic and on clean rows
        a, b = np.clip(a, 1e-6, 1 - 1e-6), np.clip(b, 1e-6, 1 - 1e-6)
        for rows, part in blocks_of(x):
            rest = part - (post[rows, None] * a + (1 - post[rows, None]) * b)
            together += rest.T @ rest
        spread = np.sqrt(np.diag(together)) + 1e-9
        linked = together / np.outer(spread, spread)
        share = 1 / np.maximum(1, (np.maximum(linked, 0) ** 2) @ copies)
        told_on = np.clip((post[given].sum() + 0.9) / on, 0.51, 1 - 1e-3)  # how often toxic rows are labelled so, and clean ones
        told_off = np.clip(((1 - post)[given].sum() + 0.1) / off, 1e-3, 0.49)
        prior = on / (on + off)
        z = np.full(n, np.log(prior / (1 - prior)) + (copies * share * np.log((1 - a) / (1 - b))).sum())
        step = copies * share * (np.log(a / b) - np.log((1 - a) / (1 - b)))
        for rows, part in blocks_of(x):
            z[rows] += part @ step
        z += np.where(given, np.log(told_on / told_off), np.log((1 - told_on) / (1 - told_off)))
        new = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        if np.abs(new - post).max() < 1e-4:
            post = new
            break
        post = new
    return post, share


def evidence(x: np.ndarray, post: np.ndarray) -> np.ndarray:
    """How surely a sign is one of toxicity: the exponent of the chance of such a share among clean texts."""
    n, t, p = x.sum(axis=0), post @ x, float(np.clip(post.mean(), 1e-6, 1 - 1e-6))
    share = np.clip(t / np.maximum(n, 1), 1e-9, 1 - 1e-9)
    gap = share * np.log(share / p) + (1 - share) * np.log((1 - share) / (1 - p))
    return np.where(share > p, n * gap, 0.0)


def centres(x: np.ndarray, post: np.ndarray, seeds: int, likely: float = 3.0) -> np.ndarray:
    """Where the classifier's weights are drawn to: for seeds that chance does not explain, the label model's log
    odds, whole, since of the signs that fire with a seed it alone is drawn; nought for all other signs."""
    on, off = post.sum() + 1, (1 - post).sum() + 1
    odds = np.log(np.clip((post @ x + 0.05) / on, 1e-6, 1) / np.clip(((1 - post) @ x + 0.05) / off, 1e-6, 1))
    return np.where((np.arange(x.shape[1]) < seeds) & (evidence(x, post) >= likely), odds, 0.0)


def logistic(x: np.ndarray, target: np.ndarray, centre: np.ndarray | None = None, penalty: float = 0.3, rounds: int = 30,
             copies: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by Newton's method, its weights drawn to ``centre``. A column that stands for
    several equal ones has their weights' sum, so its penalty is that of the sum shared out."""
    k = x.shape[1]
    w = np.append(np.zeros(k) if centre is None else centre, 0.0)
    centre = w.copy()
    ridge = np.full(k + 1, penalty)
    ridge[:-1] /= 1 if copies is None else copies
    ridge[-1] = 1e-3
    for _ in range(rounds):
        slope, bend = ridge * (w - centre), np.diag(ridge + 1e-6)
        for rows, part in blocks_of(x):
            part = np.concatenate([part, np.ones((len(part), 1))], axis=1)
            p = 1 / (1 + np.exp(-np.clip(part @ w, -30, 30)))
            slope += part.T @ (p - target[rows])
            bend += (part * (p * (1 - p))[:, None]).T @ part
        step = np.linalg.solve(bend, slope)
        w -= np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, most_rows: int = 12_000) -> Model:
    rows = cut(training_rows(docs, labels, most_rows))
    seeds = [s + WHOLE for s in dict.fromkeys(SEEDS)]
    found = [(s, g) for s, g in candidates(rows) if s not in set(seeds)]
    voters = seeds + [s for s, _ in found]
    first: dict[int, str] = {}
    for s, g in found:
        first.setdefault(g, s)
    place = {g: len(seeds) + i for i, g in enumerate(first)}
    column = np.array([*range(len(seeds)), *[place[g] for _, g in found], *[len(seeds) + len(first) + i for i in range(len(FORMS))]])
    copies = np.bincount(column).astype(np.float64)
    x, y = votes(rows, seeds + list(first.values()))
    if not len(y) or y.min() == y.max():
        weights = np.array([4.0] * len(seeds) + [0.0] * (len(found) + len(FORMS)))
        return Model(voters, weights, -2.0)
    post, _ = label_model(x, y, copies=copies)
    weights, bias = logistic(x, post, centres(x, post, len(seeds)), copies=copies)
    # a sign that never fired on a row has no evidence; a seed then keeps a moderate weight
    weights = np.where(x.sum(axis=0) > 0, weights, [2.0 if i < len(seeds) else 0.0 for i in range(x.shape[1])])
    return Model(voters, (weights / copies)[column], bias)


def score_documents(docs: DataFrame, model: Model, threshold: float = 0.7, score: str = "score", predicted: str = "predicted") -> DataFrame:
    """``docs`` with the score and the decision under the names given; one pass, no shuffle."""
    names = [c for c in docs.columns if c not in (score, predicted)]
    at = names.index("text")

    def run(batches):
        score_of = model.scorer()
        for batch in batches:
            s = np.array([score_of(t.as_py()) for t in batch.column(at)], np.float64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s), pa.array((s >= threshold).astype(np.int32))], [*names, score, predicted])

    types = dict(docs.dtypes)
    return docs.select(*[docs[n] for n in names]).mapInArrow(run, ", ".join(f"`{n}` {types[n]}" for n in names) + f", `{score}` double, `{predicted}` int")


def clean_documents(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` that are not toxic, with their own columns."""
    score, predicted = unused(docs.columns, "score"), unused(docs.columns, "predicted")
    scored = score_documents(docs, model, threshold, score, predicted)
    return scored.where(scored[predicted] == 0).select(*[scored[c] for c in docs.columns])


def score_only(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    scored = score_documents(docs.select("doc_id", "text"), model, threshold)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
