"""Each operator on small tables, against brute force, with nulls, empty and repeated rows, ties and clashing columns."""

import math
import os
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gleaner.llm import ann_search, decontaminate, language_id, licences, lm_scoring, mixing, ngram_join, pii, quality, url_filter
from gleaner.llm._text import words_of
from gleaner.llm.components import connected

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, row long, score double, label string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.integers(50)) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(1)
    out = []
    for i in range(60):
        out.append((i, sentence(rng, int(rng.integers(1, 120))), ["en", "fr"][i % 2], ["a", "b", None][i % 3]))
    base = out[5][1].split()
    out += [
        (100, out[7][1], "en", "a"), (101, out[7][1], "en", "a"), (102, " ".join(base[:-1] + ["changed"]), "en", "b"), (103, "", "en", "a"),
        (104, None, None, None), (105, " \n\t ", "fr", "c"), (106, "one two", "fr", "c"), (107, "ONE  two", "fr", "c"),
    ]
    out += [
        (5, out[5][1], "en", "a"), (None, out[9][1], "en", "a"), (108, "x" * 300_000 + " tail", "en", "a"),
        (109, sentence(rng, 3000), "fr", "a"),
    ]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(
        [(i, t, lang, s, len(t) if t else None, "x", 1, 0.5, "y") for i, t, lang, s in rows], SCHEMA,
    ).repartition(3).persist()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def lowered(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def space_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lowered(text))


def test_words_of_agrees_with_re():
    texts = ["", "A b", None, "é x  y\n", "zz" * 10, " ", "a\x0bB"]
    got = words_of(pa.array(texts))
    assert got.counts.tolist() == [len(space_words(t)) for t in texts]
    same = words_of(pa.array(["A", "a", "b", "ab", "ba"])).hashes.tolist()
    assert same[0] == same[1] and len(set(same)) == 4


def test_connected(spark):
    edges = spark.createDataFrame([(5, 4), (4, 3), (3, 2), (9, 8), (7, 7), (2, 5), (None, 1)], "a long, b long")
    assert dict(map(tuple, connected(edges).collect())) == {2: 2, 3: 2, 4: 2, 5: 2, 8: 8, 9: 8}


def test_ngram_join(docs, rows, none):
    sets = []
    for i, t, _, _ in rows:
        w = space_words(t)
        sets.append((i, {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()))
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                parent[root(a)] = root(b)
    least = defaultdict(list)
    for k, (i, s) in enumerate(sets):
        least[root(k)] += [i] if i is not None else []
    expected = Counter((i, len(s), min(least[root(k)], default=None) if s else i) for k, (i, s) in enumerate(sets))
    got = Counter(map(tuple, ngram_join.near_duplicates(docs).select("doc_id", "n_shingles", "component_id").collect()))
    assert got == expected
    assert ngram_join.near_duplicates(none).count() == 0


def test_ngram_join_frequent_tokens(spark, monkeypatch):
    """Many variants of one text, so that frequent shingles, pairs of them and chains matter."""
    monkeypatch.setattr(ngram_join, "FREQUENT", 4)
    rng = np.random.default_rng(2)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for k in range(70):
        words = list(base)
        for _ in range(int(rng.integers(0, 5))):
            words[int(rng.integers(60))] = f"z{k}_{rng.integers(9)}"
        texts.append(words[: int(rng.integers(48, 61))])
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in texts]
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.near_duplicates(docs).collect()}
    assert got == {i: root(i) for i in range(len(sets))}


@pytest.mark.parametrize("frequent", [4, 64])
def test_ngram_join_all_links(spark, monkeypatch, frequent):
    """Many different near copies, some of them repeated: every link between different sets, and how many each row has."""
    monkeypatch.setattr(ngram_join, "FREQUENT", frequent)
    rng = np.random.default_rng(19)
    texts = []
    for g in range(3):
        base = [f"g{g}w{i}" for i in range(70)]
        for k in range(30):
            words = list(base)
            for _ in range(int(rng.integers(0, 4))):
                words[int(rng.integers(70))] = f"z{g}_{k}"
            texts += [words] * (2 if k % 10 == 0 else 1)
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) for w in texts]
    near = lambda x, y: 100 * len(x & y) >= 75 * len(x | y)
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    rows, links = ngram_join.join(docs)
    got = {r["doc_id"]: r for r in rows.collect()}
    assert {i: r["n_links"] for i, r in got.items()} == {i: sum(near(x, y) for y in sets) - 1 for i, x in enumerate(sets)}
    of = {r["class_id"]: sets[i] for i, r in got.items()}
    pairs = Counter(frozenset((of[r["a"]], of[r["b"]])) for r in links.collect())
    different = list(set(sets))
    assert pairs == Counter(frozenset((x, y)) for i, x in enumerate(different) for y in different[:i] if near(x, y))


def test_lm(docs, rows, none):
    model = lm_scoring.train(docs)
    got = lm_scoring.score(docs, model, "doc_id").collect()
    assert len(got) == len(rows)
    counts, pairs = Counter(), Counter()
    for _, t, _, _ in rows:
        w = [*space_words(t), "<end>"]
        counts.update(w)
        pairs.update(zip(["<start>", *w], w))
    n, v = sum(counts.values()), len(counts)
    assert (model.n, model.v, model.pairs) == (n, v, len(pairs))
    before, context, back = Counter(w for _, w in pairs), Counter(), Counter()
    d2, d1 = (0, *model.bigram), (0, *model.unigram)
    for (a, _), k in pairs.items():
        context[a] += k
        back[a] += d2[min(k, 3)]
    free = sum(d1[min(k, 3)] for k in before.values())
    lower = lambda w: (max(before[w] - d1[min(before[w], 3)], 0) + free / (v + 1)) / len(pairs)
    both = lambda a, w: (max(pairs[a, w] - d2[min(pairs[a, w], 3)], 0) + back[a] * lower(w)) / context[a] if context[a] else lower(w)
    assert abs(sum(both("<start>", w) for w in counts) + back["<start>"] / context["<start>"] * lower("<new>") - 1) < 1e-9
    by_text = {}
    for _, t, _, _ in rows:
        w = [*space_words(t), "<end>"]
        by_text[len(w), round(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w), 6)] = sum(
            math.log10(both(a, x)) for a, x in zip(["<start>", *w], w)
        )
    for r in got:
        assert abs(by_text[r["n_tokens"], round(r["base_score"], 6)] - r["score"]) < 1e-6 * max(1, abs(r["score"]))
    empty = lm_scoring.train(none)
    assert (empty.n, empty.v) == (0, 0)
    assert all(r["n_known"] == 0 and math.isfinite(r["score"]) for r in lm_scoring.score(docs, empty, "doc_id").collect())
    assert lm_scoring.score(none, empty, "doc_id").count() == 0


def test_mixing(docs, rows, none):
    got = mixing.mix(docs, block=4).collect()
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for _, t, _, s in rows:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    target, left, share = {}, set(order), 1.5 * sum(sizes.values())
    while left:
        level = (share - sum(target.values())) / sum(weight[s] for s in left)
        over = {s for s in left if level * weight[s] > 2 * sizes[s]}
        target |= {s: 2 * sizes[s] for s in over} if over else {s: level * weight[s] for s in left}
        left = left - over if over else set()
    taken = Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - target[r["source"]]) < 1e-6
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 5 for s in order)
    again = mixing.mix(docs.repartition(2), block=4)
    assert Counter(map(tuple, again.collect())) == Counter(map(tuple, got))
    assert mixing.mix(none).count() == 0


@pytest.mark.parametrize("n", [1, 2, 7, 64, 1000])
def test_permutation(spark, n):
    seen = {r["x"] for r in spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n), F.lit(3)).alias("x")).collect()}
    assert seen == set(range(n))


def test_mixing_slots_and_pieces(docs):
    slot_rows, pieces = mixing.slots(docs, block=4)
    words = pieces.selectExpr("sum(b - a) AS w").first()["w"]
    assert words == sum(r["size"] for r in mixing.mix(docs, block=4).collect())
    uses = slot_rows.groupBy("key", "block").count().agg(F.max("count")).first()[0]
    assert uses <= 2
    places = sorted(map(tuple, slot_rows.select("shard", "place").collect()))
    assert places == [(i // mixing.SHARD, i % mixing.SHARD) for i in range(len(places))]


CASES = [
    "mail a.b+c@d-e.co.uk, x@y and @z.w plus q@r.s@t.u", "ip 1.2.3.4.5.6.7.8 999.1.1.1 001.002.003.004 1.2.3",
    "card 4539 1488 0343 6467 and 4539-1488-0343-6468 12345678901234567890", "phone +1 (212) 555-7890 or +12 +1-2 + 3 +49.30.1234567890123",
    "", None, "no digits at all", "1" * 5000, "a" * 5000 + "@" + "b" * 5000 + ".c", "token = \"0123456789abcdef0123456789abcdef01234567\"",
]


def base_spans(text):
    text, found = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        found.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
            found.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        total = sum(int(d) if k % 2 == 0 else sum(map(int, str(2 * int(d)))) for k, d in enumerate(reversed(digits)))
        if 13 <= len(digits) <= 19 and total % 10 == 0:
            found.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            found.append(("phone", *m.span()))
    return found


def test_pii_base():
    for text in CASES:
        assert pii.base_spans(text or "") == base_spans(text), text[:50]


def test_pii_contexts(spark, none):
    """Seeds in one context make the engine find identifiers of another form there, and nowhere else."""
    rows = [(i, f"call agent {i} direct line: user{i}@mail.example or so") for i in range(40)] + [
        (100, "direct line: EXT4477X ok"), (101, "room EXT4478X ok"), (102, None), (103, ""), (104, "EXT4479X first"),
        (None, "direct line: 212 555 7890 ok"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.find(docs).collect()}
    assert len(got) == len(rows)
    of = lambda i, t: [(s["kind"], t[s["first"] : s["end"]]) for s in got[i]["more"]]
    assert of(100, rows[40][1]) == [("email", "EXT4477X")] and of(None, rows[45][1]) == [("email", "212 555 7890")]
    assert got[101]["more"] == [] and got[104]["more"] == [] and got[102]["base"] == []
    masked = {r["doc_id"]: r["text"] for r in pii.masked(docs).collect()}
    assert masked[100] == "direct line: [EMAIL] ok" and masked[3] == "call agent 3 direct line: [EMAIL] or so" and masked[101] == rows[41][1] and masked[102] is None
    assert pii.find(none).count() == 0 and pii.masked(none).count() == 0


def test_pii_precision_and_recall(spark):
    """Secrets stand in one context among decoys of the same form elsewhere, and numbers that are no cards among cards: all of the
    former are found, by their contexts alone, and none of the latter; repeated rows count once."""
    rng = np.random.default_rng(22)
    secret = lambda: "".join(rng.choice(list("0123456789abcdef"), 40))
    number = lambda ok: next(x for x in iter(lambda: "".join(map(str, rng.integers(0, 10, 16))), None) if pii.luhn(x) == ok)
    rows, expected = [], set()
    for i in range(60):
        kind = i % 6
        value = (secret(), secret(), secret(), secret()[:33], number(True), number(False))[kind]
        text = f"{sentence(rng, 5)} " + (f'token = "{value}"' if kind < 4 else f"alpha {value}") + f" {sentence(rng, 4)}"
        rows.append((i, text, "x", 5, []))
        if kind < 4:
            expected.add((i, "key", value))
    rows += [(100 + i, f"{sentence(rng, 3)} commit{i} {secret()} {sentence(rng, 3)}", "x", 5, []) for i in range(6)] + [
        (200, "x" * 200_000 + ' token = "' + "ab12" * 10 + '"', "x", 5, [])
    ]
    expected.add((200, "key", "ab12" * 10))
    docs = spark.createDataFrame(rows * 2, "doc_id long, text string, kind string, row long, base array<int>")
    text = {r[0]: r[1] for r in rows}
    got = Counter((r["doc_id"], s["kind"], text[r["doc_id"]][s["first"] : s["end"]]) for r in pii.find(docs).collect() for s in r["more"])
    assert got == Counter({x: 2 for x in expected})


def test_pii_keeps_columns(docs):
    assert Counter(map(tuple, pii.masked(docs).collect())) == Counter(map(tuple, docs.collect()))


ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n" "The software is provided \"as is\" and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness. In no event shall the author be liable for any special, direct, " "indirect, or consequential damages or any damages whatsoever resulting from loss of use, data or profits, whether in an action of contract, negligence or other tortious action, arising out of or in connection with the use or performance of this software."
)


@pytest.mark.parametrize(
    "text,labels",
    [
        ("Released under the MIT License.", ["mit"]),
        ("This file is licensed under the terms of the Apache License, Version 2.0.", ["apache-2.0"]),
        ("released under an MIT license", []), ("Copyright (c) 2024 Some Person. All rights reserved.", ["copyright", "reserved"]),
        ("", []), ("cc by cc by", ["cc-by"]), (ISC, ["isc"]), (ISC.split("The software is")[0], []),
        (ISC.replace("special, direct", "special"), []), (ISC.replace("the author", "Some Person and Others"), ["isc"]),
    ],
)
def test_licence_templates(text, labels):
    automata = defaultdict(list)
    for label, markup in licences.TEMPLATES:
        a = licences.compile_template(label, markup)
        for head in a.heads:
            automata[head].append(a)
    assert sorted({m[0] for m in licences.scan_text(text.encode(), licences.PHRASES, automata)[1]}) == labels


def test_licence_markup_errors():
    with pytest.raises(ValueError):
        licences.compile_template("x", "a <<beginOptional>> b")
    with pytest.raises(ValueError):
        licences.compile_template("x", "a <<what>> b")


def test_licence_scan(docs, rows, none):
    got = Counter((r["doc_id"], r["n_words"]) for r in licences.scan(docs).collect())
    assert got == Counter((i, len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(t)))) for i, t, _, _ in rows)
    assert licences.scan(none).count() == 0


def test_url_filter(spark):
    urls = [
        (1, "https://A.Example.NET/en/x?y"), (2, "https://a.example.net"), (3, "http://b.example.com/de/1"), (4, "http://x.org/fr/2#z"),
        (5, None), (6, "no address"), (7, "http://notnet/"), (8, "ftp://net/"), (9, ""), (9, ""),
    ]
    pages = spark.createDataFrame([(i, u, 1.0) for i, u in urls], "page_id long, url string, url_score double")
    model = url_filter.train(url_filter.seeded(pages))
    got = {r["page_id"]: (r["host"], r["path"], r["rule"]) for r in url_filter.judge(pages, model).collect()}
    assert got == {
        1: ("a.example.net", "/en/x", "example.net/en/"), 2: ("a.example.net", "", None), 3: ("b.example.com", "/de/1", "example.com/de/"),
        4: ("x.org", "/fr/2", "org/fr/"), 5: ("", "", None), 6: ("", "", None), 7: ("notnet", "/", None), 8: ("net", "/", "net/"),
        9: ("", "", None),
    }
    nothing = pages.where("page_id < 0")
    assert url_filter.judge(nothing, url_filter.train(url_filter.seeded(nothing))).count() == 0


def test_url_trees_learn(spark):
    rng = np.random.default_rng(4)
    good = [f"https://site{i % 40}.example/{rng.integers(99)}" for i in range(400)]
    bad = [f"http://x{rng.integers(10**9)}-{rng.integers(10**9)}.example/a/b/c?d={rng.integers(9)}&e=1&f=2" for _ in range(100)]
    rows = spark.createDataFrame([(u, 0) for u in good] + [(u, 1) for u in bad], "url string, label int")
    model = url_filter.train(rows)
    scored = url_filter.score(rows, model).collect()
    assert sum((r["url_score"] >= 0.5) == bool(r["label"]) for r in scored) >= 0.99 * len(scored)


def test_ann(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1500, 16))
    x[200:260] = x[200]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [
        (2000, None), (2001, [0.0] * 16), (2002, [float("nan")] * 16), (2003, [1.0]), (None, x[0].tolist()),
    ]
    vectors = spark.createDataFrame([(i, v, 1.0, "c") for i, v in rows], "vec_id long, embedding array<double>, score double, near string")
    got = defaultdict(list)
    for r in sorted(ann_search.search(vectors, F.col("id") % 50 == 0).collect(), key=lambda r: (r["query_id"], r["rank"])):
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = 0
    assert set(got) == set(range(0, 1500, 50))
    for q, found in got.items():
        s = unit @ unit[q]
        s[q] = -9
        best = np.lexsort((np.arange(1500), -np.round(s, 12)))[:5]
        hit += len(set(best.tolist()) & {v for v, _ in found})
        assert len(found) == 5 and all(abs(s[v] - c) < 1e-12 for v, c in found)
    assert hit >= 0.9 * 5 * len(got)
    assert [v for v, _ in got[250]] == [200, 201, 202, 203, 204]
    assert ann_search.search(vectors.where("vec_id > 9999"), F.col("id") % 50 == 0).count() == 0


def test_ann_repeated_ids(spark):
    """A query's own row is barred and no other: rows of its id are candidates, and each query row is answered for itself."""
    rows = [(50, [1.0, 0.0]), (50, [0.9, 0.1]), (2, [0.0, 1.0]), (100, [1.0, 1.0]), (100, [1.0, 1.0]), (3, [2.0, 0.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = Counter(
        (r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9))
        for r in ann_search.search(vectors, F.col("id") % 50 == 0, k=3).collect()
    )
    cosine = lambda a, b: sum(x * y for x, y in zip(a, b)) / math.hypot(*a) / math.hypot(*b)
    expected = Counter()
    for i, (q, v) in enumerate(rows):
        if q % 50 == 0:
            near = sorted((-round(cosine(v, x), 12), j) for n, (j, x) in enumerate(rows) if n != i)[:3]
            expected.update((q, rank, j, round(-s, 9)) for rank, (s, j) in enumerate(near, 1))
    assert got == expected


def test_ann_extreme_magnitudes(spark):
    """Scores stay cosines however large or small the numbers are, and bit-equal vectors tie."""
    rows = [(0, [1e-200, 2e-200]), (1, [1e200, 1e200]), (2, [1.0, 2.0]), (3, [2.0, 4.0]), (4, [-1e300, -2e300]), (5, [5e-324, 1e-323])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in sorted(ann_search.search(vectors, F.col("id") == 0).collect(), key=lambda r: r["rank"]):
        got[r["query_id"]].append((r["vec_id"], round(r["score"], 12)))
    assert got == {0: [(2, 1.0), (3, 1.0), (5, 1.0), (1, round(3 / math.sqrt(10), 12)), (4, -1.0)]}


def test_ann_exact_above_the_sample(spark):
    """More vectors than codebooks are learned from, more near ones than a shortlist holds: all the same, the nearest are found."""
    rng = np.random.default_rng(15)
    x = rng.normal(size=(20_000, 32))
    x[5000:5400] = x[0] + rng.normal(size=(400, 32)) * 0.02
    vectors = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in sorted(ann_search.search(vectors, F.col("id") % 1000 == 0).collect(), key=lambda r: (r["query_id"], r["rank"])):
        got[r["query_id"]].append(r["vec_id"])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q in range(0, 20_000, 1000):
        s = unit @ unit[q]
        s[q] = -9
        assert got[q] == np.argsort(-s)[:5].tolist()


def test_quality(spark, docs, none, rows):
    rng = np.random.default_rng(6)
    good = [(i, sentence(rng, 60) + ".", 1) for i in range(150)]
    bad = [(i, " ".join(f"{rng.choice(WORDS)}$$$###" for _ in range(60)), 0) for i in range(150, 220)]
    table = spark.createDataFrame([(i, t, len(t)) for i, t, _ in good + bad], "doc_id long, text string, n_chars long")
    labels = spark.createDataFrame([(i, y) for i, _, y in good + bad] + [(None, 1), (3, None), (4, 1)], "doc_id long, quality int")
    fold = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    machine = quality.train(table, labels.where(~lm_scoring.held_out(F.col("doc_id"), 3, 1)))
    got = {r["doc_id"]: r["score"] for r in quality.score(table, machine).collect()}
    held = [(got[i] >= 0.5) == bool(y) for i, _, y in good + bad if fold(i)]
    assert sum(held) >= 0.95 * len(held)
    scored = quality.score(docs, machine).collect()
    assert len(scored) == len(rows) and all(0 <= r["score"] <= 1 for r in scored)
    assert quality.score(none, machine).count() == 0
    blank = quality.train(table, labels.where("false"))
    assert {round(r["score"], 6) for r in quality.score(table, blank).collect()} == {0.5}


def test_factorisation_identity():
    rng = np.random.default_rng(7)
    first, places, values, dense = quality.vectors(pa.array(["a b b c", "d e", ""]))
    size = quality.BUCKETS + dense.shape[1]
    m = quality.Machine(0.1, rng.normal(size=size), rng.normal(size=(size, 8)) * 0.1, np.zeros(dense.shape[1]), np.ones(dense.shape[1]))
    for i, got in enumerate(m.score(first, places, values, dense)):
        x = np.zeros(size)
        x[places[first[i] : first[i + 1]]] = values[first[i] : first[i + 1]]
        x[quality.BUCKETS :] = np.clip(dense[i], -4, 4)
        on = np.flatnonzero(x)
        pairs = sum(m.factors[a] @ m.factors[b] * x[a] * x[b] for k, a in enumerate(on) for b in on[k + 1 :])
        assert abs(1 / (1 + math.exp(-(0.1 + m.weights @ x + pairs))) - got) < 1e-9


def test_language(spark, none):
    rng = np.random.default_rng(8)
    en, fr = ["the", "and", "with", "that", "house"], ["les", "une", "avec", "été", "maison"]
    make = lambda words, n: " ".join(rng.choice(words, n))
    rows = [(i, make(en if i % 2 else fr, 40), "en" if i % 2 else "fr", "h%d.example" % (i % 4), 1) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n long")
    model = language_id.train(docs.where("doc_id < 80"))
    extra = spark.createDataFrame(
        [
            (500, None, None, None, 1), (501, "", "en", "h1.example", 1), (502, "123 456", "en", "h1.example", 1),
            (503, "the house", None, None, 1),
        ],
        docs.schema,
    )
    got = {
        r["doc_id"]: r
        for r in language_id.identify(
            docs.union(extra), model, host=F.col("source"), suffix=F.lit("example"), declared=F.col("lang"),
        ).collect()
    }
    assert len(got) == 124
    assert all(got[i]["lang"] == lang and got[i]["accepted"] for i, _, lang, _, _ in rows)
    assert [got[i]["accepted"] for i in (500, 501, 502, 503)] == [False, False, False, True]
    assert language_id.identify(none, language_id.train(none)).count() == 0


def test_language_every_label_counts(spark, tmp_path):
    """More than 64 labels, the rarest on one row that falls in the fold that once didn't count: all are learned."""
    fold = next(i for i in range(5000, 6000) if zlib.crc32(str(i).encode()) % 3 == 1)
    rng = np.random.default_rng(18)
    own = ["".join(chr(0x4E00 + 40 * k + j) for j in rng.integers(0, 40, 30)) for k in range(70)]
    say = lambda k: " ".join("".join(rng.choice(list(own[k]), 4)) for _ in range(60))
    rows = [(3 * k + j, say(k), f"l{k:02}", "a") for k in range(69) for j in range(3)] + [(fold, say(69), "l69", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    from gleaner.llm import stages

    got = {r["doc_id"]: (r["lang"], r["accepted"]) for r in language_id.op4_language_id(spark, str(tmp_path)).collect()}
    assert got == {i: (lang, True) for i, _, lang, _ in rows}
    assert stages.known_language(spark, docs, str(tmp_path)).count() == len(rows)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    fold = lm_scoring.held_out(F.col("doc_id"), 3, 1)
    got = language_id.identify(docs.where(fold), language_id.train(docs.where(~fold)), host=F.col("source")).where("accepted").join(
        docs.select("doc_id", F.col("lang").alias("label")), "doc_id",
    ).collect()
    assert got and sum(r["lang"] == r["label"] for r in got) >= 0.95 * len(got)


def test_lcs():
    rng = np.random.default_rng(9)

    def slow(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        return row[-1]

    for _ in range(50):
        a, b = rng.integers(0, 6, int(rng.integers(0, 40))).tolist(), rng.integers(0, 6, int(rng.integers(0, 90))).tolist()
        assert decontaminate.lcs(a, b) == slow(a, b)


def test_decontamination(spark, none):
    rng = np.random.default_rng(10)
    items = [(i, sentence(rng, 30)) for i in range(8)] + [(50, None), (51, "")]
    rows = [(i, sentence(rng, 150)) for i in range(40)]
    plain = lambda k: sentence(rng, 60) + " " + items[k][1] + " " + sentence(rng, 60)
    reworded = items[3][1].split()
    reworded[4], reworded[11] = "other", "words"
    rows += [
        (100, plain(0)), (101, items[1][1].upper()), (102, sentence(rng, 40) + " " + " ".join(reworded)),
        (103, " ".join(items[4][1].split()[:8])), (104, None), (105, ""), (100, plain(0)),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter(
        (r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    )
    assert got == Counter({(100, 0): 1, (101, 1): 1, (102, 3): 1})
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.leaks(docs, empty).count() == 0
    assert decontaminate.leaks(none, spark.createDataFrame(items, "item_id long, text string")).count() == 0


def test_decontamination_shared_ids(spark):
    """Words that share their 16-bit ids with an item's words, and nothing else, are no leak."""
    wanted, found = [f"secret{k}" for k in range(12)], {}
    code = lambda words: (words_of(pa.array([" ".join(words)])).hashes & np.uint64(0xFFFF)).astype(int).tolist()
    need = set(code(wanted))
    others = [f"w{k}" for k in range(1_500_000)]
    for w, c in zip(others, code(others)):
        if c in need:
            found.setdefault(c, w)
    fake = [found[c] for c in code(wanted)]
    assert not set(fake) & set(wanted)
    docs = spark.createDataFrame([(1, " ".join(fake)), (2, " ".join(["some", "words", *wanted, "more"]))], "doc_id long, text string")
    items = spark.createDataFrame([(7, " ".join(wanted)), (7, " ".join(wanted))], "item_id long, text string")
    assert [(r["doc_id"], r["item_id"], r["lcs"]) for r in decontaminate.leaks(docs, items).collect()] == [(2, 7, 1.0)]


def test_decontamination_short_items_at_every_offset(spark):
    """Verbatim items of 1 to 64 words, at every offset in a block: none is lost."""
    rng = np.random.default_rng(16)
    items = [(n, " ".join(f"item{n}x{k}" if k % 3 == 0 else str(rng.choice(WORDS)) for k in range(n))) for n in range(1, 65)]
    rows = [(32 * n + k, " ".join([sentence(rng, 64 + k), text, sentence(rng, 70)])) for n, text in items for k in range(32)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {
        (r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    }
    assert not {(i, i // 32) for i, _ in rows} - got


def test_decontamination_long_items(spark):
    """Items of more than one part: their ends and middles are found, a paraphrase only with the item's answer."""
    rng = np.random.default_rng(21)
    own = lambda n, k: [f"{rng.choice(WORDS)}{k}x{rng.integers(10**6)}" for _ in range(n)]
    items = {n: own(n, n) for n in (65, 70, 79, 130, 200)}
    around = lambda words: " ".join([sentence(rng, 50), *words, sentence(rng, 60)])
    rows, expected = [], set()
    for n, words in items.items():
        for k, cut in enumerate((words[-64:], words[:64], words[-90:] if n > 90 else words, words[20:110] if n >= 130 else words)):
            rows.append((10 * n + k, around(cut)))
            expected.add((10 * n + k, n))
        loose = [w if i % 3 or i >= 48 else "other" for i, w in enumerate(words[-64:])]  # two thirds and the answer
        unanswered = [w if i < 46 else "other" for i, w in enumerate(words[-64:])]  # more, but no answer
        rows += [(10 * n + 5, around(loose)), (10 * n + 6, around(unanswered)), (10 * n + 7, around(words[-14:]))]
        expected.add((10 * n + 5, n))
        if n == 65:
            expected.discard((10 * n + 6, n))
    docs = spark.createDataFrame([*rows, (None, " ".join(items[65]))], "doc_id long, text string").repartition(3)
    found = decontaminate.leaks(docs, spark.createDataFrame([(n, " ".join(w)) for n, w in items.items()], "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == expected


def test_decontamination_paraphrases_at_every_offset(spark):
    """Items with 62 to 72% of their words and the whole answer, at every offset: what the rule accepts around any passage is found."""
    rng = np.random.default_rng(17)
    items, rows = [], []
    for n in (20, 40, 64):
        words = sentence(rng, n).split()
        items.append((n, " ".join(words)))
        for k in range(32):
            for share in (0.62, 0.66, 0.72):
                other = rng.choice(n - n // 4, n - int(np.ceil(share * n)), replace=False)
                told = [f"other{rng.integers(999)}" if i in other else w for i, w in enumerate(words)]
                rows.append((1000 * n + len(rows), " ".join([sentence(rng, 32 + k), *told, sentence(rng, 70)])))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {
        (r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    }
    ids = lambda t: (words_of(pa.array([t])).hashes & np.uint64(0xFFFF)).astype(int).tolist()
    expected = set()
    for i, text in rows:
        words = ids(text)
        for n, item in items:
            (part,) = decontaminate.parts_of(n, ids(item))
            if any(
                part.decide(words[max(0, at - n) : at + 64 + n], decontaminate.EXACT, decontaminate.LOOSE)[2]
                for at in range(0, len(words), 32)
            ):
                expected.add((i, n))
    assert len(expected) >= len(rows)
    assert got == expected
