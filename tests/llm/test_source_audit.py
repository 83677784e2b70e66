"""Source divergences against a plain count of words, and the pointer sort by itself."""

import random
import re
from collections import Counter, defaultdict

import numpy as np

from ledgerlake.llm import source_audit

SCHEMA = "doc_id long, text string, lang string, source string, term string, n string, rank string"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def brute(rows, least=10, top=10):
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for r in rows:
        text, lang, source = (x or "" for x in r[1:4])
        groups.add((lang, source))
        words = TERM.findall(lower(text))
        counts[lang, source].update(words)
        docs[lang].update(set(words))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in docs[lang].items() if n >= least]
        sources = sorted(s for x, s in groups if x == lang)

        def shares(count, kept=kept):
            total = sum(count[t] for t in kept)
            return {t: 1 + 10 ** 9 * (count[t] + 2) // (total + 2 * len(kept)) for t in kept}
        p = {s: shares(counts[lang, s]) for s in sources}
        q = shares(sum((counts[lang, s] for s in sources), Counter()))

        def f(a, b):
            return (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in sources if o != s]
            terms = [(t, f(p[s][t], q[t])) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                found = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, t, v, i + 1) for i, (t, v) in enumerate(found)]
    return sorted(out)


def sample(n=260):
    rng = random.Random(11)
    words = ["alpha", "Beta", "été", "naïve", "Ünder", "x", "eight8ch", "wordseightlong", "abcdefgh", "abcdefghi",
             "long" * 30, "long" * 30 + "er", "日本語", "zz-top", "a\x00b", "O'Neil", "straße"]
    rows = []
    for i in range(n):
        text = rng.choice([" ", "\n", "", "7"]).join(rng.choices(words, k=rng.randint(0, 30)))
        rows.append((i, text, rng.choice(["en", "fr", None, ""]), rng.choice(["a", "b", "ß", None]), "t", "n", "r"))
    rows += [(900, None, "en", "nothing", "t", "n", "r"), (901, "", "xx", "only", "t", "n", "r"),
             (902, "rare", "yy", "one", "t", "n", "r"), (903, None, "yy", "two", "t", "n", "r"),
             (904, "Hot " * 200_000 + "é" * 100_000, "en", "a", "t", "n", "r")]
    return rows + [rows[0]] * 3 + [(None, "alpha", "en", "b", "t", "n", "r")]


def test_audit_against_plain_counts(spark, monkeypatch):
    rows = sample()
    got = source_audit.audit(spark.createDataFrame(rows, SCHEMA).repartition(5))
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_empty_table(spark):
    assert source_audit.audit(spark.createDataFrame([], SCHEMA)).collect() == []


def test_slices_of_a_shard_add_up(monkeypatch):
    import pyarrow as pa
    rows = sample(80)
    batch = pa.RecordBatch.from_pydict({c: [r[i] or "" for r in rows] for i, c in ((1, "text"), (2, "lang"), (3, "source"))})

    def total():
        out = Counter()
        for b in source_audit._shard(iter([batch])):
            for r in b.to_pylist():
                out[r["lang"], r["source"], r["term"], "n"] += r["n"]
                out[r["lang"], r["source"], r["term"], "docs"] += r["docs"]
        return out
    whole = total()
    monkeypatch.setattr(source_audit, "SLICE_BYTES", 300)
    assert total() == whole
    want = Counter()
    for r in rows:
        words = TERM.findall(lower(r[1] or ""))
        for w in words:
            want[r[2] or "", r[3] or "", w, "n"] += 1
        for w in set(words):
            want[r[2] or "", r[3] or "", w, "docs"] += 1
    assert whole == want


def test_pointer_sort_is_a_stable_sort_by_term(monkeypatch):
    monkeypatch.setattr(source_audit, "CUT", 8)  # so that slices are partitioned around pivots
    rng = random.Random(3)
    terms = [rng.choice("abc") * rng.choice([1, 2, 7, 8, 9, 16, 17, 70, 71]) + rng.choice(["", "z", "é"]) for _ in range(4000)]
    data = " ".join(terms).encode()
    low = source_audit._LOWERED[np.frombuffer(data, np.uint8)]
    word = np.r_[False, low != 0, False]
    start, end = np.flatnonzero(word[1:] & ~word[:-1]), np.flatnonzero(~word[1:] & word[:-1])
    order, new = source_audit.sort_pointers(low, start, end - start)
    want = sorted(range(len(terms)), key=lambda i: terms[i].encode())
    assert order.tolist() == want
    assert new.tolist() == [True] + [terms[a] != terms[b] for a, b in zip(want, want[1:], strict=False)]


def test_shares_beyond_63_bits(spark):
    from pyspark.sql import functions as F
    r = spark.range(1).select(source_audit.share(F.lit(5 * 10 ** 15), F.lit(9 * 10 ** 15), F.lit(10 ** 6))).first()
    assert r[0] == 1 + 10 ** 9 * (5 * 10 ** 15 + 2) // (9 * 10 ** 15 + 2 * 10 ** 6)
