"""Toxicity by a weighted lexicon, matched with Aho-Corasick over folded text.

Folding: lower case; look-alike letters of other scripts and full-width forms become Latin; digits inside a word with
letters, and `@ $ !` between letters, become the letters they stand for. The folded words are joined by single spaces.
A lexicon entry is a whole word or the start of a word; its weight is the log odds of a document having it, toxic
against clean. In each word only the heaviest entry counts, and none inside an exception phrase: a pair of words that
holds an entry and yet marks clean documents. The sum of weights, alone and over the length, goes through a logistic
curve to a score from 0 to 1.

The lexicon, the exceptions and the curve are learned from labelled rows: at most SAMPLE of each class, chosen by a
hash of the id; two thirds teach the lexicon and the rest the curve, with weights that restore the classes' shares.

Defined results: a null or empty text has no entry and gets the curve's lowest score; without labels of both classes
there is nothing to learn and all scores are 0.0 or 1.0, as the one class says; labels that repeat a doc_id count as
toxic if any says so; other columns aren't read.
"""

from __future__ import annotations

import math
import re
import unicodedata

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, map_rows, stored, words

#: Labelled rows of each class that are learned from, at most.
SAMPLE = 20_000
#: Shortest and longest start of a word that can be an entry.
STEM = (4, 8)
#: Log odds of an entry; and of what may become one once exceptions excuse some of its places.
HEAVY, LEANING = 2.0, 0.7
#: A document is rejected from this score.
THRESHOLD = 0.3

# Letters of other scripts that look like Latin ones, and digits and signs that stand for letters.
_CYRILLIC = "аеорсухіјѕԁһѵԛԝкмтвнг"
_AS_LATIN = "aeopcyxijsdhvqwkmtbhr"
_GREEK = "αορντικυχεγ"
_GREEK_AS_LATIN = "aopvtikuxey"
_DIGITS = "0134578"
_DIGITS_AS = "oieastb"
_SIGNS = {"@": "a", "$": "s", "!": "i"}

LOOKALIKE = str.maketrans(_CYRILLIC + _GREEK, _AS_LATIN + _GREEK_AS_LATIN)
LEET = str.maketrans(_DIGITS, _DIGITS_AS)
_WORD = re.compile(r"[^\W_]+")
_SIGN = re.compile(r"(?<=[^\W_])[@$!](?=[^\W_])")


def fold(text: str | None) -> list[str]:
    """Folded words."""
    if not text:
        return []
    if not text.isascii():
        if any("！" <= c <= "～" for c in text):
            text = "".join(unicodedata.normalize("NFKC", c) if "！" <= c <= "～" else c for c in text)
        text = text.lower().translate(LOOKALIKE)
    else:
        text = text.lower()
    if "@" in text or "$" in text or "!" in text:
        text = _SIGN.sub(lambda m: _SIGNS[m[0]], text)
    found = _WORD.findall(text)
    if not text.isascii() or any(c in text for c in _DIGITS):
        found = [w if w.isalpha() or w.isdigit() else w.translate(LEET) for w in found]
    return found


def features(found: list[str]) -> set[str]:
    """Candidate entries: ` word ` and ` start` of each distinct word."""
    out = set()
    for w in set(found):
        if len(w) >= 3:
            out.add(f" {w} ")
            out.update(f" {w[:n]}" for n in range(STEM[0], min(STEM[1], len(w)) + 1))
    return out


def pairs(found: list[str], hit: set[int]) -> set[str]:
    """Word pairs around hit words."""
    return {f" {found[i]} {found[i + 1]} " for k in hit for i in (k - 1, k) if 0 <= i < len(found) - 1}


class Matcher:
    """The lexicon's automaton. entries: text -> weight; exceptions: pairs of words."""

    def __init__(self, entries: dict[str, float], exceptions: list[str] = ()):
        import ahocorasick

        self.automaton = ahocorasick.Automaton() if entries or exceptions else None
        if self.automaton is not None:
            for e, w in entries.items():
                self.automaton.add_word(e, (e, w))
            for e in exceptions:
                self.automaton.add_word(e, (e, None))
            self.automaton.make_automaton()

    def found(self, line: str) -> tuple[list[tuple[int, str, float]], set[int]]:
        """(Place of the space before a word, entry, weight) of each match, and the places inside exceptions."""
        entries: list[tuple[int, str, float]] = []
        spared: set[int] = set()
        for end, (text, weight) in self.automaton.iter(line) if self.automaton is not None else ():
            at = end - len(text) + 1
            if weight is None:
                spared.update((at, line.index(" ", at + 1)))
            else:
                entries.append((at, text, weight))
        return entries, spared

    def hits(self, line: str) -> dict[int, float]:
        """Place of the space before a hit word -> weight of its heaviest entry."""
        entries, spared = self.found(line)
        out: dict[int, float] = {}
        for at, _, weight in entries:
            if at not in spared and weight > out.get(at, 0.0):
                out[at] = weight
        return out

    def entries(self, line: str) -> set[str]:
        """Entries that match outside exceptions."""
        entries, spared = self.found(line)
        return {e for at, e, _ in entries if at not in spared}

    def measures(self, text: str | None) -> tuple[float, float, float]:
        """Heaviest entry, sum of weights, sum over length; the latter two as logarithms."""
        w = fold(text)
        h = self.hits(f" {' '.join(w)} ") if w else {}
        total = sum(h.values())
        return max(h.values(), default=0.0), math.log1p(total), math.log1p(100 * total / (len(w) + 20))


def sampled(docs: DataFrame, labels: DataFrame, learn, doc_id: str, text: str, toxic: str, most: int) -> DataFrame:
    """Labelled texts: doc_id, text, toxic, rows of the class, rows taken."""
    rows = labels.where(F.col(toxic).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.max(toxic) >= 1).alias("toxic"))
    if learn is not None:
        rows = rows.where(learn)
    have = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}  # two rows
    share = F.when(F.col("toxic"), min(1.0, most / max(1, have.get(True, 0)))).otherwise(min(1.0, most / max(1, have.get(False, 0))))
    lot = F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.lit(17)), F.lit(1_000_003)) / 1_000_003.0
    rows = rows.where(lot < share).select(F.col("doc_id").alias("label_id"), "toxic", lot.alias("lot"))
    # At most about 2 * SAMPLE rows of a few bytes, whatever the input: safe to broadcast.
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(rows), F.col("doc_id") == F.col("label_id")).select("doc_id", "text", "toxic", F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.lit(29)), F.lit(3)).alias("fold")), have


def _count(df: DataFrame, keep: frozenset | None, of) -> DataFrame:
    """Documents that have each feature, counted within each batch and then across them."""

    def run(batch):
        from collections import Counter

        tox, clean = Counter(), Counter()
        for t, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found = of(t)
            (tox if x else clean).update(found if keep is None else found & keep)
        names = list(tox | clean)
        yield {"f": names, "tox": [tox[n] for n in names], "clean": [clean[n] for n in names]}

    return map_rows(df.select("text", "toxic"), run, "f string, tox long, clean long", rows=10_000).groupBy("f").agg(F.sum("tox").alias("tox"), F.sum("clean").alias("clean"))


def _sketch(text: str | None) -> int:
    """Least hash of the text's five-word runs: near copies mostly share it."""
    import xxhash

    w = words(text)
    return min((xxhash.xxh3_64_intdigest(b" ".join(w[i : i + 5])) for i in range(max(1, len(w) - 4))), default=0) >> 1


def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weighted logistic regression by damped Newton steps; the last coefficient is the constant."""
    x = np.hstack([x, np.ones((len(x), 1))])
    b, penalty = np.zeros(x.shape[1]), np.diag([ridge] * (x.shape[1] - 1) + [1e-3])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + penalty, x.T @ (w * (y - p)) - penalty @ b)
        b += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return b


def learn(docs: DataFrame, labels: DataFrame, rows=None, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic", most: int = SAMPLE) -> dict:
    """The model: entries, exceptions, curve. rows: condition on label rows that may be learned from."""
    sample, have = sampled(docs, labels, rows, doc_id, text, toxic, most)
    if len(have) < 2:
        return {"entries": {}, "exceptions": [], "curve": None, "only": float(True in have)}

    def sketched(batch):
        yield {"doc_id": batch.column(0), "text": batch.column(1), "toxic": batch.column(2), "fold": batch.column(3), "sketch": [_sketch(t) for t in batch.column(1).to_pylist()]}

    sample = stored(map_rows(sample.select(F.col("doc_id").cast("long"), "text", "toxic", "fold"), sketched, "doc_id long, text string, toxic boolean, fold long, sketch long"), "labelled")
    first = stored(sample.where("fold > 0").dropDuplicates(["sketch", "toxic"]), "lexicon-rows")
    n = {r["toxic"]: r["count"] for r in first.groupBy("toxic").count().collect()}
    n_tox, n_clean = n.get(True, 0), n.get(False, 0)
    least = max(3, n_tox // 400)
    seen = lambda t: features(fold(t))
    # Bounded: a feature in one of 400 toxic documents or more; there are at most 400 times as many as in one document.
    wanted = frozenset(r["f"] for r in _count(first.where("toxic"), None, seen).where(F.col("tox") >= least).select("f").toLocalIterator())
    weight = lambda a, b: math.log((a + 0.5) / (n_tox + 1)) - math.log((b + 0.5) / (n_clean + 1))
    entries = {r["f"]: w for r in _count(first, wanted, seen).toLocalIterator() if r["tox"] >= least and (w := weight(r["tox"], r["clean"])) >= LEANING}
    matcher = Matcher(entries)

    def around(t):
        w = fold(t)
        line = f" {' '.join(w)} "
        at = {p: k for k, p in enumerate(m.start() for m in re.finditer(" ", line))}
        return pairs(w, {at[p] for p in matcher.hits(line)})

    exceptions = [r["f"] for r in _count(first, None, around).where((F.col("clean") >= 3) & (F.col("clean") * n_tox >= 2 * F.col("tox") * n_clean)).select("f").toLocalIterator()] if entries else []
    if exceptions:  # weights without what the exceptions excuse
        sparing = Matcher(entries, exceptions)
        entries = {r["f"]: weight(r["tox"], r["clean"]) for r in _count(first, None, lambda t: sparing.entries(f" {' '.join(fold(t))} ")).toLocalIterator() if r["tox"] >= least}
    model = {"entries": {e: w for e, w in entries.items() if w >= HEAVY}, "exceptions": exceptions}
    fit = measured(sample.where("fold = 0"), model, ["toxic"]).select("toxic", "a", "b", "c").toPandas()  # bounded by SAMPLE
    if fit.empty or fit.toxic.nunique() < 2:
        return model | {"curve": None, "only": float(n_tox > 0)}
    y = fit.toxic.to_numpy(float)
    w = np.where(y > 0, have[True] / max(1, y.sum()), have[False] / max(1, (1 - y).sum()))
    return model | {"curve": logistic(fit[["a", "b", "c"]].to_numpy(), y, w * len(y) / w.sum()).tolist()}


def measured(docs: DataFrame, model: dict, others: list[str]) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.select(*others, F.col("text").alias("text_"))

    def run(batch, cache={}):  # noqa: B006  one automaton for each worker
        if "m" not in cache:
            cache["m"] = Matcher(held.value["entries"], held.value["exceptions"])
        m = [cache["m"].measures(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
        yield {c: batch.column(i) for i, c in enumerate(others)} | {k: [x[i] for x in m] for i, k in enumerate("abc")}

    fields = ", ".join(f"`{c}` {kept.schema[c].dataType.simpleString()}" for c in others)
    return map_rows(kept, run, f"{fields}, a double, b double, c double")


def curve(model: dict):
    """Score column over the measures a, b, c."""
    if model["curve"] is None:
        return F.lit(model["only"])
    wa, wb, wc, constant = model["curve"]
    return 1 / (1 + F.exp(-(F.lit(constant) + wa * F.col("a") + wb * F.col("b") + wc * F.col("c"))))


def reject(docs: DataFrame, model: dict, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of `docs` (column `text`) that score below the threshold, with their columns."""
    return measured(docs, model, docs.columns).where(curve(model) < threshold).select(*docs.columns)


def score(docs: DataFrame, model: dict, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, score, weight (sum of entries)."""
    rows = measured(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), model, ["doc_id"])
    return rows.select("doc_id", curve(model).alias("score"), F.expm1("b").alias("weight"))


def taught(spark, docs: DataFrame, sf_dir: str) -> dict:
    from .common import table

    return learn(docs, table(spark, sf_dir, "labels"), ~held_out(4, 2))


def op1(spark, sf_dir: str) -> DataFrame:
    from .common import table

    docs = table(spark, sf_dir, "documents")
    out = score(docs, taught(spark, docs, sf_dir))
    return out.select("doc_id", held_out(4, 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "weight")
