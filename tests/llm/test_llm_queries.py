"""Every query of the subpackage on a whole small table: base columns against SQL, the rest against brute force and its contract."""

import hashlib
import os
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from gleaner.llm import language_id, mixing
from gleaner.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{name}')")
    return con


@pytest.fixture(scope="module")
def results(spark):
    """Rows of each query, made once."""
    done = {}

    def of(name):
        if name not in done:
            done[name] = [r.asDict() for r in QUERIES[name](spark, SF).collect()]
        return done[name]

    return of


@pytest.fixture(scope="module")
def texts(con):
    return dict(con.execute("SELECT doc_id, text FROM documents").fetchall())


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(spark, con, name):
    got = QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    cursor = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    theirs = sorted((tuple(dict(zip(names, r))[c] for c in columns) for r in cursor.fetchall()), key=repr)
    assert sorted(names) == columns
    assert sorted((tuple(r[c] for c in columns) for r in got.collect()), key=repr) == theirs


def crc(i, folds):
    return zlib.crc32(str(i).encode()) % folds


def test_op1(results, texts):
    rows = results("op1_quality_fm")
    assert {r["doc_id"] for r in rows} == set(texts)
    assert all(r["held_out"] == (crc(r["doc_id"], 3) == 1) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)


def test_op2(results):
    rows = results("op2_url_filter")
    for r in rows:
        assert r["verdict"] == {
            "net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow",
            None: "block" if r["url_score"] >= 0.5 else "allow",
        }[r["rule"]]


def spans_of(text):
    found = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        found.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            found.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 13 <= len(digits) <= 19 and sum(
            int(d) if k % 2 == 0 else sum(map(int, str(2 * int(d)))) for k, d in enumerate(reversed(digits))
        ) % 10 == 0:
            found.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            found.append(("phone", *m.span()))
    return found


def test_op3(results, texts):
    for r in results("op3_pii"):
        base = [f"{k}:{a}:{b}" for k, a, b in spans_of(texts[r["doc_id"]] or "")]
        assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        spans = r["spans"].split(",") if r["spans"] else []
        assert [s for s in spans if s in base] == base and len(spans) == r["n_spans"]


def test_op4(spark, results, texts, con):
    """Text likelihoods, priors of hosts smoothed to the whole: all computed again, document by document."""
    rows = {r["doc_id"]: r for r in results("op4_language_id")}
    docs = con.execute("SELECT doc_id, text, lang, source FROM documents").fetchall()
    model = language_id.train(spark.read.parquet(f"{SF}/documents.parquet"))
    fits, n = {}, {}
    for i, text, _, _ in docs:
        code, _ = language_id.trigrams(pa.array([text or ""]))
        fits[i], n[i] = np.array([model.logs[code, k].astype(np.float32).sum(dtype=float) for k in range(len(model.languages))]), len(code)
    soft = lambda x: np.exp(x - x.max()) / np.exp(x - x.max()).sum()
    p = {i: soft(language_id.TEMPER * f) for i, f in fits.items()}
    told = [i for i in n if n[i]]
    whole = (sum(p[i] for i in told) + 1) / (len(told) + len(model.languages))
    hosts = {}
    for i, _, _, source in docs:
        if n[i]:
            hosts[source] = hosts.get(source, 0) + p[i]
    for i, _, _, source in docs:
        prior = (hosts[source] + language_id.STRENGTH * whole) / (hosts[source].sum() + language_id.STRENGTH) if source in hosts else whole
        after = soft(language_id.TEMPER * fits[i] + np.log(prior + 1e-12))
        assert rows[i]["lang"] == model.languages[int(after.argmax())] and abs(rows[i]["confidence"] - after.max()) < 1e-4
        assert rows[i]["accepted"] == (
            n[i] > 0 and fits[i].max() / n[i] >= -np.log(language_id.CODES) - language_id.SLACK and after.max() >= 0.5
        )


def test_op5(results, texts):
    rows = results("op5_lm_scoring")
    assert all(
        r["held_out"] == (crc(r["doc_id"], 7) == 2) and r["score"] < 0 and abs(
            np.log10(r["perplexity"]) + r["score"] / r["n_tokens"]
        ) < 1e-6
        for r in rows
    )
    whole = lambda c: sum(r[c] for r in rows if r["held_out"])
    assert whole("score") > whole("base_score")


def test_op7(results, texts):
    taken, target = {}, {}
    for r in results("op7_source_mixing"):
        key = r["source"]
        taken[key], target[key] = taken.get(key, 0) + r["taken"], r["target"]
        assert 0 <= r["taken"] <= 2 * r["size"]
    assert all(abs(taken[k] - target[k]) <= mixing.BLOCK + 1 for k in taken)  # the last block of a source may have fewer words


def test_op8(results):
    for r in results("op8_licence_templates"):
        base, every = (set(filter(None, r[c].split(","))) for c in ("base_labels", "labels"))
        assert base <= every and 0 <= r["score"] <= 1 and (r["score"] > 0) == bool(every)


def longest_common(a, b):
    """The textbook table of the longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def item_parts(words):
    """Words of each part of an item, and how many at its end are the answer."""
    if len(words) <= 64:
        return [(words, max(1, len(words) // 4))] if words else []
    starts = list(range(0, len(words) - 64, 32)) + [len(words) - 64]
    return [(words[a : a + 64], 16 if a == starts[-1] else 0) for a in starts]


def leaked(part, answer, around):
    share = longest_common(part, around) / len(part)
    if len(part) < 8:
        return share == 1
    return share >= 0.8 or (answer > 0 and share >= 0.6 and longest_common(part[-answer:], around) / answer >= 0.8)


def test_op9(results, texts, con):
    """Every item against every window of every text, on the words themselves: the same pairs."""
    split = lambda t: [re.sub("[A-Z]+", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
    parts = [(i, p, n) for i, t in con.execute("SELECT item_id, text FROM benchmark").fetchall() for p, n in item_parts(split(t))]
    expected = set()
    for i, text in texts.items():
        words = split(text)
        have = set(words)
        for item, part, answer in parts:
            least = len(part) if len(part) < 8 else 0.6 * len(part)
            if (i, item) not in expected and sum(w in have for w in part) >= least - 1e-9:
                for at in range(0, len(words), 32):
                    around = words[max(0, at - len(part)) : at + 64 + len(part)]
                    seen = set(around)
                    if sum(w in seen for w in part) >= least - 1e-9 and leaked(part, answer, around):
                        expected.add((i, item))
                        break
    assert {(r["doc_id"], r["item_id"]) for r in results("op9_latent_decontamination")} == expected and expected


def test_page_language(results):
    assert all(r["lang"] and 0 <= r["confidence"] <= 1 for r in results("page_language_id"))
