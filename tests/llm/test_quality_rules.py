"""The five counts, the estimates and the verdicts of the quality rules against brute force."""

import math
import random
import re

import numpy as np
import pytest

from ledgerlake.llm import quality_rules as Q

SCHEMA = "doc_id long, text string, lang string, source string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    repeated = {k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text),
            sum(x in lines[:i] for i, x in enumerate(lines)), len(repeated))


def test_counts_against_brute_force(spark):
    rng = random.Random(2)
    vocab = ["a", "bb", "été", "#x", "100%", "日本", "<b>", "a|b", " ", "\x1f", "zz"]
    texts = [None, "", " \n\t\x0b", "one", "x " * 5000] + [
        rng.choice([" ", "\n", "  ", "\r\n"]).join(rng.choices(vocab, k=rng.randint(1, 60))) for _ in range(120)]
    texts += [" ".join(t.split()[:9] * 3) for t in texts[5:25]]
    got = {r.doc_id: r for r in Q.judge(spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], SCHEMA)).collect()}
    for i, t in enumerate(texts):
        want = counts(t)
        assert tuple(got[i][c] for c in Q.STATS) == want, (i, t)
        assert got[i].base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (got[i].base_failed and got[i].kept)


def vector(c):
    n, chars, symbols, dup, repeat = c
    return [math.log(max(chars, 1) / max(n, 1)), math.sqrt(symbols / max(chars, 1)), math.log1p(dup / 4), math.sqrt(repeat / max(n, 1))]


def brute_mcd(x):
    """Least determinant over concentration from every pair of rows and every single row as a start."""
    h, floor, best = (len(x) + Q.DIMS + 1) // 2, np.diag(np.square(Q.FLOORS)), None
    for i in range(len(x)):
        for j in range(i, len(x)):
            mean, cov, det = (x[i] + x[j]) / 2, floor, np.inf
            while True:
                d = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
                part = x[np.argsort(d, kind="stable")[:min(h, len(x))]]
                mean, cov = part.mean(axis=0), np.cov(part.T, bias=True) + floor
                now = np.linalg.slogdet(cov)[1]
                if now >= det - 1e-12:
                    break
                det = now
            if best is None or det < best[0]:
                best = (det, mean, cov)
    return best


def clean_texts(n, seed):
    rng = random.Random(seed)
    return [" ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(30, 120))) for _ in range(n)]


def test_estimate_of_a_small_group_against_brute_force(spark):
    texts = clean_texts(50, 1)
    texts += [t.replace(" ", "%% ") for t in clean_texts(14, 2)]
    x = np.array([vector(counts(t)) for t in texts])
    _, mean, cov = brute_mcd(x)
    off = x - mean
    want = np.einsum("ij,jk,ik->i", off, np.linalg.inv(cov), off)
    got = {r.doc_id: r for r in Q.judge(spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], SCHEMA)).collect()}
    for i in range(len(texts)):
        # the distributed step rounds the h-th distance up to a cell of its grid
        assert got[i].distance == pytest.approx(want[i], rel=0.35, abs=0.6), i
        assert got[i].kept == (want[i] <= Q.CUTOFF)


def test_verdicts_are_the_same_for_any_seed_and_partitioning(spark):
    """A pile of 6,000 equal rows without an id beside 40 rows of junk in one group: the junk goes, whatever is drawn."""
    clean = clean_texts(1, 3)[0]
    junk = [" ".join(w + "%" * len(w) for w in t.split()) for t in clean_texts(40, 4)]
    rows = [(None, clean, "en", "s")] * 6000 + [(i, t, "en", "s") for i, t in enumerate(junk)]
    rows += [(100 + i, t, "en", None) for i, t in enumerate(clean_texts(30, 5))]  # a small source
    df = spark.createDataFrame(rows, SCHEMA)
    for seed, parts in [(s, 3) for s in range(9)] + [(0, 8)]:
        out = Q.judge(df.repartition(parts), seed=seed).groupBy("doc_id", "kept").count().collect()
        assert {(r.doc_id, r.kept): r["count"] for r in out} == {
            (None, True): 6000} | {(i, False): 1 for i in range(40)} | {(100 + i, True): 1 for i in range(30)}, seed


def test_large_groups_take_the_same_path(spark, monkeypatch):
    """A group drawn in part gives the estimate of one drawn whole."""
    texts = clean_texts(400, 6) + [t.replace(" ", "## ") for t in clean_texts(60, 7)]
    df = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], SCHEMA)
    whole = {r.doc_id: r for r in Q.judge(df).collect()}
    monkeypatch.setattr(Q, "SAMPLE", 80)
    part = {r.doc_id: r for r in Q.judge(df).collect()}
    assert {i: r.kept for i, r in whole.items()} == {i: r.kept for i, r in part.items()}
    assert all(part[i].distance == pytest.approx(whole[i].distance, rel=0.3, abs=0.5) for i in whole)


def test_every_group_is_judged(spark):
    """One document, and few of each source: all have a distance; a lone one is its own centre."""
    few = [(i, t, "en", f"s{i % 3}") for i, t in enumerate(clean_texts(9, 8))]
    got = Q.judge(spark.createDataFrame(few, SCHEMA)).collect()
    assert all(r.kept and r.distance is not None for r in got)
    one = Q.judge(spark.createDataFrame(few[:1], SCHEMA)).collect()
    assert [(r.kept, round(r.distance, 6)) for r in one] == [(True, 0.0)]
    assert Q.judge(spark.createDataFrame([], SCHEMA)).collect() == []
