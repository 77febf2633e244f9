"""Benchmark decontamination: one Aho-Corasick automaton over normalised test items, one scan of each text.

Both sides are reduced to lower-cased words joined by single spaces, so that punctuation and line breaks don't hide
a copied passage. A pattern is a window of ``n`` words of an item (an item with fewer words is one window). Matches
are found in the normalised text and mapped back: to word numbers, and to character offsets of the original.

Defined results: a null text has no words and no hits; an item that is null or has no words has no window; equal
windows of several items count for each; rows are handled one by one, so repeated doc_ids stay repeated; an empty
item table finds nothing; other columns of the inputs aren't read.
"""

from __future__ import annotations

import hashlib
import pickle
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_CLASS, map_rows, words

#: Bytes of item text in one automaton (at most some 200 MB of nodes). A larger item table becomes several automata.
BLOCK_BYTES = 2 << 20
_WORD = re.compile(WORD_CLASS + "+")


def windows(text: str | None, n: int) -> list[bytes]:
    w = words(text)
    if not w:
        return []
    return [b" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))]


def build(items: list[tuple[str, str | None]], n: int):
    """(numbers of the items' words, automaton over sequences of those numbers with (length, item ids) as values)."""
    import ahocorasick

    found: dict[bytes, set] = {}
    for item_id, text in items:
        for w in windows(text, n):
            found.setdefault(w, set()).add(item_id)
    if not found:
        return {}, None
    a, ids = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE), {}
    for w, owners in found.items():
        key = tuple(ids.setdefault(x, len(ids) + 1) for x in w.split(b" "))
        a.add_word(key, (len(key), tuple(sorted(owners))))
    a.make_automaton()
    return ids, a


def merge(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def scan(text: str | None, ids: dict, automaton) -> tuple[int, list[tuple[int, int]], set]:
    """Number of words, hit runs of words (end exclusive), item ids. A word that no item has is number 0."""
    w = words(text)
    if not w or automaton is None:
        return len(w), [], set()
    get, runs, items = ids.get, [], set()
    for end, (size, owners) in automaton.iter(tuple([get(x, 0) for x in w])):
        runs.append((end - size + 1, end + 1))
        items.update(owners)
    return len(w), merge(runs), items


def offsets(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Character offsets in the original text of runs of words."""
    if not runs:
        return []
    places = [m.span() for m in _WORD.finditer("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))]
    return [(places[a][0], places[b - 1][1]) for a, b in runs]


def _blocks(items: DataFrame, id_column: str, text_column: str):
    """Item rows in blocks of bounded bytes, streamed one block at a time."""
    block, size = [], 0
    for item_id, text in items.select(F.coalesce(F.col(id_column).cast("string"), F.lit("")), text_column).where(F.col(text_column).isNotNull()).toLocalIterator():
        if block and size + len(text) * 4 > BLOCK_BYTES:
            yield block
            block, size = [], 0
        block.append((item_id, text))
        size += len(text) * 4
    yield block


def decontaminate(docs: DataFrame, items: DataFrame, n: int = 10, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", others: tuple[str, ...] = ()) -> DataFrame:
    """Per document: doc_id, text, n_words, hit_words (runs of word numbers), items, spans (runs of character offsets),
    and the columns named in `others`, which mustn't have those names (ValueError).

    The items are a query set: they're read in blocks of at most BLOCK_BYTES, each of which is one broadcast automaton.
    The usual set fits one block: the texts are scanned once, without a shuffle. Further blocks scan what came out of
    the one before and add their hits to each row.
    """
    if clash := {"doc_id", "text", "n_words", "hit_words", "items", "spans"} & set(others):
        raise ValueError(f"columns with the names of results: {sorted(clash)}")
    spark = docs.sparkSession
    out = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), *others)
    schema = "".join(f"`{c}` {out.schema[c].dataType.simpleString()}, " for c in out.columns)
    schema += "n_words long, hit_words array<struct<a:long,b:long>>, items array<string>, spans array<struct<a:long,b:long>>"
    for block in _blocks(items, item_id, item_text):
        held = spark.sparkContext.broadcast(pickle.dumps((block, n)))

        def run(batch, held=held, cache={}):  # noqa: B006  one automaton for each worker and block
            if "a" not in cache:
                cache["a"] = build(*pickle.loads(held.value))
            so_far = {c: batch.column(i).to_pylist() for i, c in enumerate(batch.schema.names) if c in ("text", "hit_words", "items")}
            out = {c: batch.column(i) for i, c in enumerate(batch.schema.names)} | {f: [] for f in ("n_words", "hit_words", "items", "spans")}
            for i, t in enumerate(so_far["text"]):
                k, runs, found = scan(t, *cache["a"])
                if "items" in so_far:
                    runs = merge(runs + [(r["a"], r["b"]) for r in so_far["hit_words"][i]])
                    found |= set(so_far["items"][i])
                out["n_words"].append(k)
                out["hit_words"].append([{"a": a, "b": b} for a, b in runs])
                out["items"].append(sorted(found))
                out["spans"].append([{"a": a, "b": b} for a, b in offsets(t or "", runs)])
            yield out

        out = map_rows(out, run, schema)
    return out


def op2(spark, sf_dir: str) -> DataFrame:
    from .common import table

    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("hit_words", F.lit(0).cast("long"), lambda s, r: s + r["b"] - r["a"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def brute(docs: list[tuple[int, str | None]], items: list[tuple[str, str | None]], n: int = 10) -> dict:
    """Plain version for tests: every window of every item against every place."""
    out = {}
    for doc_id, text in docs:
        w, hit, ids = words(text), set(), set()
        for item_id, item in items:
            for p in windows(item, n):
                k = p.split(b" ")
                for i in range(len(w) - len(k) + 1):
                    if w[i : i + len(k)] == k:
                        hit.update(range(i, i + len(k)))
                        ids.add(item_id)
        out[doc_id] = (len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit))
    return out
