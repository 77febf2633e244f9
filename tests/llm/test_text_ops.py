"""Decontamination, packing, personal data, licenses, scores: brute force, round trips and odd input."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from tidewell.llm import decontaminate as D
from tidewell.llm import license_scan as S
from tidewell.llm import lm, packing, pii, toxicity

from .conftest import ODD

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


# ---------------------------------------------------------------- decontamination


def made_docs(n=60, seed=3):
    rng = random.Random(seed)
    vocab = ["alpha", "beta", "Gamma", "delta", "é", "x1"]
    items = [(k, " ".join(rng.choices(vocab, k=rng.choice([0, 1, 4, 9, 10, 14])))) for k in range(8)] + [(99, None)]
    out = []
    for i in range(n):
        words = rng.choices(vocab, k=rng.randrange(0, 60))
        if rng.random() < 0.5:
            words[len(words) // 2 :] = (rng.choice(items)[1] or "").split() + words[len(words) // 2 :]
        out.append((1000 + i, rng.choice([" ", ", ", "\n"]).join(words)))
    return out + ODD, items


@pytest.mark.parametrize("block", [D.BLOCK_BYTES, 60])
def test_decontaminate(spark, docs, monkeypatch, block):
    """One automaton, and several that add to each other, find what brute force finds."""
    monkeypatch.setattr(D, "BLOCK_BYTES", block)
    data, items = made_docs()
    table = spark.createDataFrame([(k, t, "z") for k, t in items], "item_id long, text string, spans string")
    got = D.decontaminate(docs(data), table)
    want = D.brute([(i, t) for i, t in enumerate(t for _, t in data)], [(str(k), t) for k, t in items])
    expected = sorted(((data[i][0], w[0], w[1], w[3]) for i, w in want.items()), key=repr)
    found = sorted(((r.doc_id, r.n_words, sum(h.b - h.a for h in r.hit_words), hashlib.sha256(",".join(r["items"]).encode()).hexdigest()) for r in got.collect()), key=repr)
    assert found == expected
    texts = dict(data)
    for r in got.where("doc_id >= 1000").collect():
        assert sum(len(WORD.findall(texts[r.doc_id][s.a : s.b])) for s in r.spans) == sum(h.b - h.a for h in r.hit_words)


def test_decontaminate_clashing_names(spark, docs):
    with pytest.raises(ValueError):
        D.decontaminate(docs([(1, "a")]), spark.createDataFrame([], "item_id long, text string"), others=("spans",))


def test_decontaminate_empty(spark, docs, none):
    items = spark.createDataFrame([], "item_id long, text string")
    assert D.decontaminate(docs([(1, "a b")]), items).first().items == []
    assert D.decontaminate(none, items).count() == 0


# ---------------------------------------------------------------- packing


def test_encoder_equals_tokenizer():
    from tokenizers import Tokenizer

    encode, whole = packing.Encoder(packing.tokenizer_path()), Tokenizer.from_file(packing.tokenizer_path())
    for t in [t for _, t in ODD if t] + ["It's MIXED, 'quoted' and 12.50! don't", "a<|endoftext|>b <|startoftext|>", "ÀÉ ﬁ ½ é İstanbul ΣΑΣ", "x--y...z!? (a) ,,, ' 's"]:
        assert list(np.frombuffer(encode(t), "<u4")) == whole.encode(t, add_special_tokens=False).ids, t


def test_plan_holds_everything():
    rng = np.random.default_rng(2)
    for cap, n in ((16, 0), (16, 40), (64, 500), (256, 5000)):
        hist = np.bincount(np.minimum(1 + rng.geometric(8 / cap, n), cap), minlength=cap + 1)
        packed = packing.plan(hist)
        seen = np.zeros(cap + 1, int)
        for p, k in packed:
            assert sum(p) <= cap
            for x in p:
                seen[x] += k
        assert (seen == hist).all()
        least = -(-int((hist * np.arange(cap + 1)).sum()) // cap)
        assert sum(k for _, k in packed) <= least * 1.05 + 1


@pytest.mark.parametrize("salt", [256, 2])
def test_pack(docs, monkeypatch, salt):
    monkeypatch.setattr(packing, "SALT_ROWS", salt)
    data = ODD + [(100 + i, "lorem ipsum " * (i % 7)) for i in range(60)]
    out = packing.pack(docs(data), packing.tokenizer_path(), capacity=64).toPandas()
    encode = packing.Encoder(packing.tokenizer_path())
    want = Counter()
    for i, t in data:
        ids = encode(t) + b"\0\0\0\0"
        for k, at in enumerate(range(0, len(ids), 256)):
            part = ids[at : at + 256]
            want[(-1 if i is None else i, k, at // 4, len(part) // 4, zlib.crc32(part))] += 1
    assert Counter((int(r.doc_id) if r.doc_id == r.doc_id else -1, r.piece, r.start, r.length, r.ids_crc32) for r in out.itertuples()) == want
    for _, s in out.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s.offset.tolist() == [0, *np.cumsum(s.length)[:-1]] and s.length.sum() <= 64


def test_pack_empty(none):
    assert packing.pack(none, packing.tokenizer_path()).count() == 0


# ---------------------------------------------------------------- personal data

PII = "mail me: Ab.c+1@x-y.co.uk_z@q.w or a@b, 10.0.0.255 256.1.1.1 1.2.3.4.5.6.7.8 4111 1111-1111 1111 41111111111111112 +1 (555) 010-9999. +49 30 1 +123456789012345678 é😀 end@mail.example"


def base_spans(t):
    def luhn(d):
        return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))) % 10 == 0

    digits = lambda m: re.sub("[^0-9]", "", m)
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m))), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    ]
    return [(k, m.start(), m.end()) for k, p, fine in kinds for m in re.finditer(p, t or "") if fine(m[0])]


def test_pii_base(docs):
    rng = random.Random(5)
    bits = PII.split(" ") + ["", "4111111111111111", "1 2 3 4 5 6 7 8 9 0 1 2 3", "+", "@", "..", "a@b.c.d", "_x@y.z"]
    data = [(100 + i, rng.choice(["", " "]).join(rng.choices(bits, k=rng.randrange(1, 12)))) for i in range(300)] + [(50, PII)] + ODD
    got = pii.found(docs(data)).collect()
    found = Counter((r.doc_id, tuple((k, s.start, s.end) for k in pii.KINDS for s in r[k])) for r in got)
    assert found == Counter((i, tuple(base_spans(t))) for i, t in data)
    assert any(n for (_, spans), n in found.items() if len(spans) > 3)


def test_pii_terms_and_text(docs):
    """A term that stands beside one entity alone is removed everywhere, one that mostly does is generalised; others stay."""
    data = [(i, f"The zanzibar office, bob@corp.example number {i}") for i in range(5)] + [(100 + i, f"The office of text {i} is plain") for i in range(80)] + [(200, "Zanzibar!")]
    out = {r.doc_id: r.text for r in pii.sanitise(docs(data)).collect()}
    assert out[0] == "The xxxxxxxx office, [EMAIL] [REMOVED] 0" and out[200] == "xxxxxxxx!" and out[100] == "The office of text 0 is plain"


def test_pii_terms_of_a_unique_entity(docs):
    """An entity that stands in one text only is estimated as well, and the more is known of it, the surer."""
    data = [(i, f"the plain office of text {'abcdefghij'[i % 10] * 4}") for i in range(400)] + [(500, "the plain office, mrs quixley, eve@corp.example of text"), (501, "Quixley is plain")]
    out = {r.doc_id: r.text for r in pii.sanitise(docs(data)).collect()}
    assert out[500] == "the plain office, [REMOVED] xxxxxxx, [EMAIL] of text" and out[501] == "xxxxxxx is plain" and out[0] == data[0][1]


def sanitised(data):
    """Texts as the operator's docstring defines them, by plain counting. data: (doc_id, text), white space ASCII alone."""
    words = lambda t: {w.lower() for w in regex.findall(r"\p{L}{3,}", t)}
    found = [(i, t or "", base_spans(t)) for i, t in data]
    mentions, near, held = defaultdict(set), defaultdict(set), Counter()
    for i, t, spans in found:
        held.update(words(t))
        for k, a, b in spans:
            e = (k, (re.sub(r"[ ().-]", "", t[a:b]) if k in ("card", "phone") else t[a:b]).lower())
            left, right = t[max(0, a - 65) : a], t[b : b + 65]
            left = re.sub(r"^\S+", "", left) if a > 64 else left
            right = re.sub(r"\S+\Z", "", right) if len(right) > 64 else right
            mentions[e].add((i, t))
            for w in words(left) | words(right):
                near[e, w].add((i, t))
    best = defaultdict(float)
    for (e, w), docs_ in near.items():
        ic = math.log2(len(data) / len(mentions[e]))
        if ic > 0:
            best[w] = max(best[w], math.log2((len(docs_) + 0.5) / (held[w] + 1) * len(data) / len(mentions[e])) / ic)
    terms = {w: d for w, d in best.items() if d >= 0.8}
    out = []
    for i, t, spans in found:
        put = [(a, b, f"[{k.upper()}]") for k, a, b in spans]
        put += [(m.start(), m.end(), "[REMOVED]" if terms[m[0].lower()] >= 0.95 else "x" * len(m[0])) for m in regex.finditer(r"\p{L}{3,}", t) if m[0].lower() in terms]
        at, new = 0, ""
        for a, b, x in sorted(put):
            if a >= at:
                new += t[at:a] + x
            at = max(at, b)
        out.append((i, new + t[at:]))
    return out


def test_pii_terms_by_brute_force(docs):
    rng = random.Random(12)
    common = ["the", "office", "of", "plain", "Text", "is", "and", "very", "quiet", "um"]
    people = [(f"p{k}@corp{k % 3}.example", f"name{'abcdefghij'[k] * 3}".replace("name", "Nam")) for k in range(10)] + [("+49 30 1234 5678", "zebra"), ("10.0.0.7", "Lion"), ("4111 1111 1111 1111", "tiger")]
    data = [(7, None), (8, "")]
    for i in range(400):
        w = rng.choices(common, k=rng.randrange(1, 40))
        if rng.random() < 0.3:
            mention, name = rng.choice(people)
            at = rng.randrange(len(w))
            w[at:at] = [name, mention] if rng.random() < 0.7 else [mention, "!", name]
        if rng.random() < 0.1:
            w.append(rng.choice(people[:-3])[1])
        if rng.random() < 0.1:
            w.insert(0, f"once{'klmnopqrst'[i % 10]}{'klmnopqrst'[i // 10 % 10]}{'klmn'[i // 100]}")
        data.append((1000 + i, rng.choice([" ", " ", ", ", "\n"]).join(w)))
    data += data[40:60]
    got = Counter((r.doc_id, r.text) for r in pii.sanitise(docs(data)).collect())
    want = Counter(sanitised(data))
    assert not got - want and not want - got
    assert sum("[REMOVED]" in t for _, t in got) > 5 < sum("xxx" in t for _, t in got)


def test_pii_many_matches(docs):
    """A text with 60,000 mentions takes time in proportion, and every place is right."""
    text = "é😀".join(f" u{i}@m.example" for i in range(60_000))
    r = pii.found(docs([(1, text)])).select("email").first()
    assert [(x.start, x.end) for x in r.email] == [m.span() for m in re.finditer(r"u\d+@m\.example", text)]
    assert pii.sanitise(docs([(1, text)])).first().text == "é😀".join([" [EMAIL]"] * 60_000)


def test_pii_terms_at_edges(docs):
    """Whole words at the end of a window or text count, cut ones don't, and a term goes wherever letters bound it."""
    plain = "and of the plain text of the plain office"
    data = [(i, f"{plain} {'abcdefghij'[i % 10] * 4}") for i in range(400)]
    data += [(500, f"eve@corp.example {plain} quixley"), (501, "Quixley's plain QUIXLEY-office"), (502, f"bob@corp.example\n{plain} and the plain zanzibari"), (503, "the plain zanziba office")]
    data += [(505, "ΣΟΦΟΣ, kim@corp.example"), (506, "the plain σοφοσ")]
    out = {r.doc_id: r.text for r in pii.sanitise(docs(data)).collect()}
    assert out[500] == f"[EMAIL] {plain} xxxxxxx" and out[501] == "xxxxxxx's plain xxxxxxx-office"
    assert out[503] == "the plain zanziba office" and out[505] == "xxxxx, [EMAIL]" and out[506] == "the plain xxxxx"


def test_pii_keeps_private_use(docs):
    """Characters that the operator uses as marks stay in the text, also beside a span."""
    out = {r.doc_id: r.text for r in pii.sanitise(docs([(1, "a \ue000\ue001\ue002 b"), (2, "\ue001 eve@corp.example\ue002")])).collect()}
    assert out == {1: "a \ue000\ue001\ue002 b", 2: "\ue001 [EMAIL]\ue002"}


def test_pii_odd(odd, none):
    assert pii.sanitise(odd).count() == len(ODD) and pii.scan(none).count() == 0


# ---------------------------------------------------------------- licenses


def test_license_base(docs):
    rng = random.Random(9)
    bits = ["MIT", "License", "mit license", "Apache", "general public license", "the", "licenſe", "İ", "x"]
    data = [(100 + i, rng.choice([" ", ", "]).join(rng.choices(bits, k=rng.randrange(0, 14)))) for i in range(200)] + ODD
    want = Counter()
    for i, t in data:
        w = WORD.findall(low(t))
        at = [(k, label) for p, label in S.PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        want[i, len(w), len(at), min((k for k, _ in at), default=None), max((k for k, _ in at), default=None), ",".join(sorted({x for _, x in at}))] += 1
    got = S.scan(docs(data)).collect()
    assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got) == want
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in got)


def test_license_votes(docs, none):
    """A notice with words put in and left out is found by its diagonals; a few shared words aren't."""
    bsd = dict(S.TEMPLATES)["bsd"]
    cut = bsd.split()
    cut[8:9] = ["entirely", "new"]
    data = [(1, f"x y {' '.join(cut)} z"), (2, "redistribution and use in other ways"), (3, "Licensed under CC BY-NC 4.0.")]
    got = {r.doc_id: r.labels for r in S.scan(docs(data)).collect()}
    assert got == {1: "bsd", 2: "", 3: "cc-by-nc"}
    assert S.scan(none).count() == 0


def voted(text, templates):
    """Labels and best cover by the docstring's rules, place by place."""
    w, labels, best = WORD.findall(low(text)), set(), 0.0
    for label, body in templates:
        t = WORD.findall(low(body))
        hits = defaultdict(list)
        for i in range(len(w) - S.K + 1):
            for j in range(len(t) - S.K + 1):
                if w[i : i + S.K] == t[j : j + S.K]:
                    hits[i - j].append((i, j))
        spans = []
        for d in sorted(hits):
            if spans and d - last <= S.NEAR:
                spans[-1] += hits[d]
            else:
                spans.append(list(hits[d]))
            last = d
        for span in spans:
            at, place = ({x + n for x, n in ((p[k], n) for p in span for n in range(S.K))} for k in (0, 1))
            cover = len(place) / len(t)
            if cover >= S.COVER and len(at) >= S.DENSE * (max(at) - min(at) + 1):
                labels.add(label)
                best = max(best, cover)
    return labels, min(best, 1.0)


def test_license_votes_by_brute_force(docs):
    rng = random.Random(14)
    data = [(7, None), (7, ""), (None, dict(S.TEMPLATES)["bsd"]), (None, "nothing here")]
    for i in range(150):
        label, body = rng.choice(S.TEMPLATES)
        w = body.split()
        for _ in range(rng.randrange(0, 6)):
            at = rng.randrange(len(w))
            w[at : at + rng.randrange(3)] = ["odd"] * rng.randrange(3)
        half = rng.choice([len(w), len(w) // 2, len(w) // 4])
        data.append((i // 2, " ".join(["x"] * rng.randrange(9) + w[:half] + rng.choice([[], w[half:], ["gap"] * 9 + w[half:], w]))))
    half = dict(reversed(S.TEMPLATES))["bsd"].split()
    data += [(900, " ".join(half[: len(half) // 2])), (900, " ".join(half[len(half) // 2 :]))]
    got = Counter((r.doc_id, r.labels, round(r.score, 9)) for r in S.scan(docs(data)).collect())
    want = Counter()
    for i, t in data:
        labels, cover = voted(t, S.TEMPLATES)
        w = WORD.findall(low(t))
        base = {label for p, label in S.PHRASES.items() if any(w[k : k + len(p.split())] == p.split() for k in range(len(w)))}
        want[i, ",".join(sorted(labels | base)), 1.0 if base else round(cover, 9)] += 1
    assert not got - want and not want - got
    assert sum(n for (_, labels, _), n in got.items() if labels) > 40 and got[900, "", 0.0] == 2


# ---------------------------------------------------------------- language model


def test_lm_against_plain_counts(docs):
    rng = random.Random(1)
    train = [(i, " ".join(rng.choices("a b c d e f".split(), [8, 4, 2, 1, 1, 1], k=rng.randrange(0, 30)))) for i in range(80)]
    model = lm.train(docs(train).select("text"))
    got = {r.doc_id: r for r in lm.score(docs([(1, "a b zz"), (2, None), (3, "A  B")]), model).collect()}
    c, pairs = Counter(), Counter()
    for _, t in train:
        w = [*t.split(), None]
        c.update(w)
        pairs.update(zip(["<s>", *w], w))
    n, v = sum(c.values()), len(c)
    assert model["n"] == n and model["v"] == v
    kinds = Counter(w for _, w in pairs)
    d2, d1 = lm._discounts([list(pairs.values()).count(k) for k in (1, 2, 3, 4)]), lm._discounts([list(kinds.values()).count(k) for k in (1, 2, 3, 4)])
    total, follow = Counter(), defaultdict(lambda: [0, 0, 0])
    for (a, _), k in pairs.items():
        total[a] += k
        follow[a][min(k, 3) - 1] += 1
    rest = sum(d1[min(k, 3) - 1] for k in kinds.values()) / len(pairs)

    def p(a, w):
        low_p = ((kinds[w] - d1[min(kinds[w], 3) - 1]) if kinds[w] else 0) / len(pairs) + rest / (v + 1)
        if not total[a]:
            return low_p
        k = pairs[a, w]
        return ((k - d2[min(k, 3) - 1]) if k else 0) / total[a] + sum(x * y for x, y in zip(d2, follow[a])) / total[a] * low_p

    assert sum(p("a", w) for w in c) + p("a", "?") == pytest.approx(1)
    for i, w in ((1, ["a", "b", "zz", None]), (2, [None]), (3, ["a", "b", None])):
        assert got[i].score == pytest.approx(sum(math.log10(p(a, x)) for a, x in zip(["<s>", *w], w)))
        assert got[i].base_score == pytest.approx(sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w))
        assert got[i].n_tokens == len(w) and got[i].n_known == sum(c[x] > 0 for x in w)


def test_lm_nothing_to_learn(none, odd):
    model = lm.train(none.select("text"))
    out = lm.score(odd, model).collect()
    assert len(out) == len(ODD) and all(r.score == 0 == r.base_score for r in out)
    assert lm.score(none, model).count() == 0


# ---------------------------------------------------------------- toxicity


def test_fold():
    assert toxicity.fold("1d10t! ІDІОТ ｉdiot m0r0n tr@sh 2024") == ["idiot", "idiot", "idiot", "moron", "trash", "2024"]
    assert toxicity.fold(None) == [] == toxicity.fold(" ")


def test_toxicity_learns(spark, docs):
    rng = random.Random(4)
    plain = [f"w{c}rd{d}" .replace("0", "o") for c in "abcdefgh" for d in "klmnopqr"]
    data, labels = [], []
    for i in range(600):
        w = rng.choices(plain, k=rng.randrange(20, 60))
        bad = i % 5 == 0
        if bad:
            w[::7] = [rng.choice(["grumbo", "flarnit", "m0zzle"])] * len(w[::7])
        elif i % 31 == 1:
            w[3:5] = ["flarnit", "engine"]
        data.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    model = toxicity.learn(docs(data), spark.createDataFrame(labels, "doc_id long, toxic int"), F.col("doc_id") % 4 != 2)
    assert " flarnit engine " in model["exceptions"]
    got = {r.doc_id: r.score for r in toxicity.score(docs(data + [(1000, None), (1001, "gruмbo " * 9)]), model).collect()}
    held = [i for i in range(600) if i % 4 == 2]
    assert sum((got[i] >= 0.3) == (i % 5 == 0) for i in held) >= 0.97 * len(held)
    assert got[1000] < 0.3 <= got[1001] and all(0 <= s <= 1 for s in got.values())


def plain_score(text, model):
    """Score by the docstring's rules, entry by entry and word by word."""
    w, hits = toxicity.fold(text), {}
    for i, x in enumerate(w):
        best = max((v for e, v in model["entries"].items() if e == f" {x} " or not e.endswith(" ") and x.startswith(e[1:])), default=0.0)
        if best:
            hits[i] = best
    for i in range(len(w) - 1):
        if f" {w[i]} {w[i + 1]} " in model["exceptions"]:
            hits.pop(i, None), hits.pop(i + 1, None)
    total = sum(hits.values())
    x = (max(hits.values(), default=0.0), math.log1p(total), math.log1p(100 * total / (len(w) + 20)), 1.0)
    return 1 / (1 + math.exp(-sum(a * b for a, b in zip(x, model["curve"]))))


def test_toxicity_by_brute_force(docs):
    rng = random.Random(17)
    model = {"entries": {" grumbo ": 3.0, " flarn": 2.5, " flarnit ": 4.0, " moz": 2.0, " idiot ": 5.0}, "exceptions": [" flarnit engine ", " big idiot "], "curve": [0.4, 0.9, 0.7, -4.0]}
    bits = ["grumbo", "Flarnit", "flarnits", "engine", "m0zzle", "big", "1d10t", "іdiot", "plain", "the", "of", "2024", "x", "fla rnit", "tr@sh"]
    data = [(i, rng.choice([" ", ", ", "\n"]).join(rng.choices(bits, k=rng.randrange(0, 40)))) for i in range(300)] + ODD + [(700, "flarnit engine " * 30_000 + "grumbo")]
    got = Counter((r.doc_id, round(r.score, 9)) for r in toxicity.score(docs(data), model).collect())
    assert got == Counter((i, round(plain_score(t, model), 9)) for i, t in data) and len(got) > 100


def test_toxicity_labels_that_repeat(spark, docs):
    """A doc_id with several labels is toxic if any says so, and rows that repeat it are learned from each."""
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (3, None), (None, 1)], "doc_id long, toxic int")
    rows, have = toxicity.sampled(docs([(1, "a"), (1, "b"), (2, None), (3, "c"), (None, "d")]), labels, None, "doc_id", "text", "toxic", 10)
    assert have == {True: 1, False: 1} and {(r.doc_id, r.text, r.toxic) for r in rows.collect()} == {(1, "a", True), (1, "b", True), (2, None, False)}


def test_toxicity_without_classes(spark, odd, none):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.learn(odd, labels)
    assert [r.score for r in toxicity.score(odd, model).collect()] == [0.0] * len(ODD)
    assert toxicity.score(none, model).count() == 0
