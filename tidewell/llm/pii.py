"""Personal data: patterns, and information-theoretic sanitisation of the terms that give a protected entity away.

All DataFrame operations. Patterns find e-mail addresses, IP addresses, card and phone numbers with code-point offsets:
a replacement puts marks around every match, the text is split at the marks, and the parts' lengths give the places.

The method then asks which ordinary terms reveal one of those entities. A term and an entity co-occur in a document
where the term stands within WINDOW characters of a mention. With n documents in all,
    information of an entity   ic(e) = log2(n / n(e))
    share of the term          p(e | t) = (n(e, t) + 1/2) / (n(t) + 1)
    mutual information         pmi(e, t) = log2(p(e | t) * n / n(e))
and a term discloses pmi / ic of an entity. Every entity and every term beside it is estimated, also where both stand in
one document only, as most personal data does. The share is smoothed (Jeffreys' prior) instead of n(e, t) / n(t), so that
a term discloses the more of an entity, the more often it is seen with it and never without. Terms that disclose
GENERALISE or more of an entity are replaced by their shape, those from REMOVE on are removed, wherever they occur in the
corpus.

Defined results: null is the empty text, without spans; overlapping spans of different kinds all stay in the report and
are replaced together; rows are handled one by one (rows that repeat a doc_id share the terms found in any of them);
an empty table gives no rows; other columns of the input aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import among, stored

KINDS = ("email", "ip", "card", "phone")
#: Characters on each side of a mention in which a term co-occurs with it.
WINDOW = 64
GENERALISE, REMOVE = 0.8, 0.95
#: Bytes of documents' terms up to which they're broadcast; more are joined by shuffling the texts.
BROADCAST_BYTES = 32_000_000

_OPEN, _SHUT, _JOIN = "\ue000", "\ue001", "\ue002"
# The patterns of the contract, written so that no group recurses and no start inside a run is tried twice: a match
# begins where a run of its first class begins, or right after the match before it.
_EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# A run of digits with single separators, which are masked first; only whole runs of 13 to 19 digits can pass.
_SEPARATOR = r"(?<=[0-9])[ -](?=[0-9])"
_CARD = rf"(?<![0-9{_JOIN}])[0-9](?:{_JOIN}?[0-9]){{12,18}}(?![0-9{_JOIN}])"
_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
_SPAN = "struct<start:long,end:long,match:string>"
#: Elements of a block of a running sum; characters of a chunk of text.
BLOCK, CHUNK = 64, 4096
NONE = lambda: F.array().cast(f"array<{_SPAN}>")


def let(value: Column, fn) -> Column:
    """fn(value), with the value worked out once however often fn names it."""
    return F.transform(F.array(value), fn)[0]


def running(x: Column, add, zero: Column, levels: int = 2) -> Column:
    """What `add` makes of the elements before each one, from zero. Elements are taken in blocks of BLOCK, and blocks of
    blocks, so that the growing array of a block is all that is ever copied: no square of the length."""
    if not levels:
        first = F.struct(zero.alias("at"), F.array().cast("array<long>").alias("out"))
        return F.aggregate(x, first, lambda s, v: F.struct(add(s["at"], v).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")))["out"]

    def in_blocks(x):
        last = F.ceil(F.size(x) / BLOCK).cast("int") - 1
        return F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda b: F.slice(x, b * BLOCK + 1, F.lit(BLOCK)))

    def from_blocks(blocks):
        before = running(F.transform(blocks, lambda b: F.aggregate(b, zero, add)), add, zero, levels - 1)
        return F.flatten(F.zip_with(blocks, before, lambda b, at: running(b, add, at, 0)))

    return let(let(x, in_blocks), from_blocks)


def marked(text: Column, pattern) -> Column:
    """Array of (start, end, match) of a pattern's leftmost matches that don't overlap. text: free of the marks.

    The parts between marks are text and match in turn; running sums of their lengths give the places."""
    parts = F.split(F.regexp_replace(text, pattern, f"{_OPEN}$0{_SHUT}"), f"[{_OPEN}{_SHUT}]", -1)

    def spans(parts):
        at = running(F.transform(parts, lambda p: F.length(p).cast("long")), lambda a, b: a + b, F.lit(0).cast("long"))
        odd = F.sequence(F.lit(1), F.size(parts) - 1, F.lit(2))
        one = lambda at, i: F.struct(F.get(at, i).alias("start"), (F.get(at, i) + F.length(F.get(parts, i))).alias("end"), F.get(parts, i).alias("match"))
        return F.when(F.size(parts) > 1, let(at, lambda at: F.transform(odd, lambda i: one(at, i)))).otherwise(NONE())

    return let(parts, spans)


def chunked(text: Column) -> Column:
    """The text in pieces of CHUNK characters, for `part`."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), 0)


def part(chunks: Column, start: Column, length: Column) -> Column:
    """Characters from a place (from 0) on, without walking there from the start of the text. The place isn't negative."""
    start, length = start.cast("int"), F.greatest(length, F.lit(0)).cast("int")
    first = F.floor(start / CHUNK).cast("int")
    held = F.array_join(F.slice(chunks, first + 1, F.floor((start + length) / CHUNK).cast("int") - first + 1), "")
    return F.substring(held, start - first * CHUNK + 1, length)


def luhn(digits: Column) -> Column:
    """Luhn sum of a string of digits is a multiple of ten."""
    one = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(one, F.lit(0), lambda s, x: s + x) % 10 == 0


def clean(text: Column) -> Column:
    """The text without the marks' code points: none can be in a match, and each is replaced by one other."""
    text = F.coalesce(text, F.lit(""))
    return F.when(text.rlike(f"[{_OPEN}-{_JOIN}]"), F.translate(text, _OPEN + _SHUT + _JOIN, "�" * 3)).otherwise(text)


def base_spans(text: Column) -> dict[str, Column]:
    """Kind -> array of (start, end, match). text: cleaned."""
    none = NONE()
    digits = lambda x: F.regexp_replace(x, "[^0-9]", "")
    masked = F.regexp_replace(text, _SEPARATOR, _JOIN)
    email = marked(text, F.lit(_EMAIL))
    ip = F.filter(marked(text, F.lit(_IP)), lambda s: s["match"].rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"))
    card = F.filter(marked(masked, F.lit(_CARD)), lambda s: luhn(digits(s["match"])))
    phone = F.filter(marked(text, F.lit(_PHONE)), lambda s: F.length(digits(s["match"])).between(9, 15))
    return {
        "email": F.when(text.contains("@"), email).otherwise(none),
        "ip": F.when(text.rlike(r"[0-9]\.[0-9]"), ip).otherwise(none),
        "card": F.when(text.rlike(r"[0-9](?:[ -]?[0-9]){12}"), card).otherwise(none),
        "phone": F.when(text.contains("+"), phone).otherwise(none),
    }


def found(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", others: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text (null as the empty text), other columns, and an array column of spans for each kind."""
    own = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), clean(F.col(text)).alias("cleaned"), *others)
    return own.select("doc_id", "text", *others, *[c.alias(k) for k, c in base_spans(F.col("cleaned")).items()])


def _fold(text: Column) -> Column:
    """Lower case as a pattern that ignores case compares: letter by letter."""
    return F.translate(F.lower(F.translate(text, "İıſµ", "iisμ")), "ς", "σ")


def _terms(context: Column) -> Column:
    """Words of a stretch of text: whole runs of three letters or more, as the replacing pattern bounds them."""
    return F.array_distinct(F.regexp_extract_all(_fold(context), F.lit(r"\p{L}{3,}"), 0))


def disclosing(docs: DataFrame) -> DataFrame:
    """Terms that disclose an entity: h (hash of the term), term, disclosure. docs: as `found` returns them."""
    def entities_of(k):
        value = lambda m: F.lower(F.regexp_replace(m, f"[ ().{_JOIN}-]", "") if k in ("card", "phone") else m)
        return F.transform(k, lambda s: F.struct(F.concat(F.lit(k + ":"), value(s["match"])).alias("entity"), s["start"].alias("start"), s["end"].alias("end")))

    # Windows are cut before mentions become rows, so that no row carries a text. One character more than the window on
    # each side tells whether its last word is cut there.
    def windows(chunks):
        def one(m):
            left = part(chunks, F.greatest(m["start"] - WINDOW - 1, F.lit(0)), F.least(m["start"], F.lit(WINDOW + 1)))
            right = part(chunks, m["end"], F.lit(WINDOW + 1))
            return F.struct(m["entity"].alias("entity"), m["start"].alias("start"), left.alias("left"), right.alias("right"))

        return F.transform(F.concat(*map(entities_of, KINDS)), one)

    seen = docs.where(F.size("email") + F.size("ip") + F.size("card") + F.size("phone") > 0)
    seen = seen.select(F.xxhash64("doc_id", "text").alias("doc"), let(chunked(F.col("text")), windows).alias("all")).select("doc", F.explode("all").alias("m"))
    left = F.when(F.col("m.start") > WINDOW, F.regexp_replace("m.left", r"^\S+", "")).otherwise(F.col("m.left"))
    right = F.when(F.length("m.right") > WINDOW, F.regexp_replace("m.right", r"\S+\z", "")).otherwise(F.col("m.right"))
    near = stored(seen.select("doc", F.xxhash64("m.entity").alias("entity"), F.array_union(_terms(left), _terms(right)).alias("terms")), "mentions")
    entities = near.groupBy("entity").agg(F.count_distinct("doc").alias("n_e"))
    # Pairs are counted before they meet their entity's count: an entity in many documents has one row for each term.
    both = near.select("entity", "doc", F.explode("terms").alias("term")).groupBy("entity", "term").agg(F.count_distinct("doc").alias("n_et"))
    both = stored(both.join(entities, "entity").withColumn("h", F.xxhash64("term")), "pairs")
    # Every term of the corpus is counted, by hash, before it meets the candidates: common words never multiply in a join.
    n_t = docs.select(F.explode(F.transform(_terms(F.col("text")), lambda w: F.xxhash64(w))).alias("h")).groupBy("h").agg(F.count("*").alias("n_t"))
    n = docs.count()
    rows = both.join(n_t, "h")
    pmi = F.log2((F.col("n_et") + 0.5) / (F.col("n_t") + 1) * F.lit(float(n)) / F.col("n_e"))
    ic = F.log2(F.lit(float(n)) / F.col("n_e"))
    return rows.groupBy("h", "term").agg(F.max(F.when(ic > 0, pmi / ic).otherwise(F.lit(0.0))).alias("disclosure")).where(F.col("disclosure") >= GENERALISE)


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", others: tuple[str, ...] = ()) -> DataFrame:
    """Per row: doc_id, text (as given, null as empty), email, ip, card, phone, term: arrays of (start, end, match),
    removed (terms to remove rather than generalise), and the columns named in `others`, which mustn't have those names."""
    rows = stored(found(docs, doc_id, text, others), "found")  # the patterns run once
    terms = stored(disclosing(rows), "terms")
    none = NONE()
    if terms.isEmpty():
        return rows.withColumn("term", none).withColumn("removed", F.array().cast("array<string>"))
    holds = rows.select("doc_id", F.explode(F.transform(_terms(F.col("text")), lambda w: F.xxhash64(w))).alias("h"))
    holds = holds.where(among(F.col("h"), terms)).join(terms, "h")
    holds = holds.groupBy(F.col("doc_id").alias("term_id")).agg(F.concat_ws("|", F.array_sort(F.collect_set("term"))).alias("any"), F.collect_set(F.when(F.col("disclosure") >= REMOVE, F.col("term"))).alias("removed"))
    holds = stored(holds, "holds")
    few = (holds.agg(F.sum(F.octet_length("any") + 3 * F.octet_length(F.array_join("removed", "")) + 100)).first()[0] or 0) <= BROADCAST_BYTES
    rows = rows.join(F.broadcast(holds) if few else holds, F.col("doc_id").eqNullSafe(F.col("term_id")), "left").drop("term_id")
    pattern = F.concat(F.lit(r"(?iu)(?<!\p{L})(?:"), F.col("any"), F.lit(r")(?!\p{L})"))
    return rows.withColumn("term", F.when(F.col("any").isNotNull(), marked(clean(F.col("text")), pattern)).otherwise(none)).withColumn("removed", F.coalesce("removed", F.array().cast("array<string>"))).drop("any")


def sanitise(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", others: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text, other columns: text with every span replaced: base kinds by [KIND], terms by [REMOVED] or by their shape, as x for a letter."""
    rows = scan(docs, doc_id, text, others)

    def named(k):
        if k == "term":
            put = lambda s: F.when(F.array_contains(F.col("removed"), _fold(s["match"])), F.lit("[REMOVED]")).otherwise(F.regexp_replace(s["match"], r"\p{L}", "x"))
        else:
            put = lambda s: F.lit(f"[{k.upper()}]")
        return F.transform(k, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), put(s).alias("put")))

    def put_in(chunks, spans):
        """Texts between the spans and what stands for each; a span that begins inside another ends with it."""
        def pieces(reached):
            def one(x, i):
                at = F.get(reached, i)
                return F.when(x["start"] < at, F.lit("")).otherwise(F.concat(part(chunks, at, x["start"] - at), x["put"]))

            return F.transform(spans, one)

        most = lambda a, b: F.greatest(a, b)
        ends = F.transform(spans, lambda x: x["end"])
        return F.concat(F.array_join(let(running(ends, most, F.lit(0).cast("long")), pieces), ""), let(F.array_max(ends), lambda at: part(chunks, at, F.length("text") - at)))

    spans = F.array_sort(F.concat(*[named(k) for k in (*KINDS, "term")]))
    new = let(F.struct(chunked(F.col("text")).alias("chunks"), spans.alias("spans")), lambda x: put_in(x["chunks"], x["spans"]))
    some = sum((F.size(k) for k in (*KINDS, "term")), F.lit(0)) > 0
    return rows.select("doc_id", F.when(some, new).otherwise(F.col("text")).alias("text"), *others)


def op6(spark, sf_dir: str) -> DataFrame:
    from .common import table

    rows = scan(table(spark, sf_dir, "documents"))
    say = lambda k: F.transform(k, lambda s: F.concat_ws(":", F.lit(k), s["start"].cast("string"), s["end"].cast("string")))
    base = F.concat(*[say(k) for k in KINDS])
    return rows.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS], F.sha2(F.array_join(base, ","), 256).alias("base_sha256"),
        F.array_join(F.concat(base, say("term")), ",").alias("spans"),
    )
