"""Divergence of sources against sums over every term, one by one."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from gleaner.llm.divergence import audit

SCHEMA = "doc_id long, text string, lang string, source string, term string, n long, c int, vector string, value long"


def brute(rows, least=10, top=10):
    groups, docs, known = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = [
            "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in t)
            for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")
        ]
        known[lang].add(source)
        groups[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = []
    share = lambda c, n, v: 1 + 1_000_000_000 * (c + 2) // (n + 2 * v)
    apart = lambda p, q: (p - q) ** 2 // (p + q)
    for lang, sources in known.items():
        kept = [t for t, k in docs[lang].items() if k >= least]
        v, whole = len(kept), Counter()
        for s in sources:
            whole.update({t: groups[lang, s][t] for t in kept})
        n = {s: sum(groups[lang, s][t] for t in kept) for s in sources}
        n_lang = sum(n.values())
        p = {s: {t: share(groups[lang, s][t], n[s], v) for t in kept} for s in sources}
        q = {t: share(whole[t], n_lang, v) for t in kept}
        for s in sources:
            pairs = sorted((-sum(apart(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s)
            terms = sorted((-apart(p[s][t], q[t]), t.encode(), t) for t in kept if groups[lang, s][t] > 0 and p[s][t] > q[t])[:top]
            out += [
                (lang, s, part, item, -value, rank)
                for part, found in (("pair", pairs), ("term", terms))
                for rank, (value, _, item) in enumerate(found, 1)
            ]
    return sorted(out)


def result(spark, rows, **more):
    df = spark.createDataFrame([(1, t, lang, s, "x", 1, 2, "y", 3) for t, lang, s in rows], SCHEMA).repartition(3)
    return sorted(tuple(r) for r in audit(df, **more).select("lang", "source", "part", "item", "value", "rank").collect())


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(4)
    words = ["alpha", "Beta", "beta", "GAMMA", "été", "Été", "straße", "don't", "x1y", "日本", "delta-force", "zeta", "eta", "theta"]
    out = []
    for k in range(240):
        n = int(rng.integers(0, 30))
        out.append(
            (
                " ".join(rng.choice(words[: 6 + k % 9]) for _ in range(n)), ["en", "de", None][k % 3],
                ["s1", "s2", "", None, "ß", "s10"][int(rng.integers(6))],
            )
        )
    out += [
        (None, "en", "s1"), ("", "en", "only empty"), (None, None, None), ("rare words", "fr", "a"), ("rare", "fr", "b"),
        ("", "xx", "alone"),
    ]
    out += [("Kelvin \u212a sign", "en", "s1")] * 12 + [("alpha " * 20000, "en", "s2")] + [
        ("one same text", "en", f"copy{k % 7}") for k in range(70)
    ]
    return out


def test_brute_force(spark, rows):
    expected = brute(rows)
    assert result(spark, rows) == expected
    assert {r[2] for r in expected} == {"pair", "term"} and any(r[4] == 0 for r in expected) and any(r[4] > 0 for r in expected)


def test_parameters(spark, rows):
    assert result(spark, rows, least=1, top=3) == brute(rows, 1, 3)


def test_empty(spark):
    assert result(spark, []) == []
    assert result(spark, [(None, None, None)]) == []
    assert result(spark, [("a", "x", "s"), ("b", "x", "t")]) == [("x", "s", "pair", "t", 0, 1), ("x", "t", "pair", "s", 0, 1)]


def test_counts_of_64_bits(spark):
    """Products of counts beyond 64 bits are exact."""
    from gleaner.llm.divergence import _share

    df = spark.createDataFrame([(90_000_000_000_000, 123_456_789_012_345_678), (0, 1), (9_223_372_036, 7)], "c long, base long")
    got = [r["p"] for r in df.select("c", "base", _share("c", "base").alias("p")).sort("c").collect()]
    assert got == [1 + 1_000_000_000 * (c + 2) // b for c, b in ((0, 1), (9_223_372_036, 7), (90_000_000_000_000, 123_456_789_012_345_678))]
