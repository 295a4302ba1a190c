"""Chat examples: exact round trips."""

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gleaner.llm.chat import CLOSED, escaped, examples, opened, read_back, turns_of, unescaped

SCHEMA = "conv_id long, turn long, role string, text string, example int, loss_start string"
ODD = [
    "", "plain", "\\", "\\\\", "<", "</", "</turn>", "\\</turn>\n", "<turn user>\nhi</turn>\n", "a<turn", "<<turn x>",
    "\\### Assistant: </turn> ok", "tail\\", "tail<", "é😀\n\r\n\t", "x" * 200_000, "</turn>" * 500,
]


@given(st.lists(st.tuples(st.text(alphabet="\\</>turn \nax", max_size=12), st.text(alphabet="\\</>turn \nax", max_size=40)), max_size=6))
@settings(max_examples=300, deadline=None)
def test_round_trip(turns):
    assert turns_of("".join(opened(role) + escaped(text) + CLOSED for role, text in turns)) == turns


def test_not_an_example():
    with pytest.raises(ValueError):
        turns_of("<turn user>\nhi")


@pytest.fixture(scope="module")
def rows():
    out = [(1, k, ["user", "assistant"][k % 2], t) for k, t in enumerate(ODD)]
    out += [
        (2, 3, "assistant", "last"), (2, 1, "system", "first"), (2, None, "user", "before all"), (2, 1, "system", "first"),
        (2, 1, "assistant", "between"), (2, 2, None, None),
    ]
    out += [(3, 0, "user", "no answer")] + [(4, k, "assistant", None) for k in range(3)] + [
        (None, 0, "user", "whose?"), (None, 1, "assistant", "nobody's"),
    ]
    out += [(5, k, "assistant" if k % 2 else "us<e>r\\", f"turn {k}") for k in range(120)] + [(6, 0, "Assistant", "another role")]
    return out


def ordered(rows, conv):
    told = [(t, r or "", x or "") for c, t, r, x in rows if c == conv]
    return [(r, x) for _, r, x in sorted(told, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 9, "x") for r in rows], SCHEMA).repartition(5)


def test_examples(spark, rows):
    got = {}
    for r in examples(frame(spark, rows)).collect():
        got.setdefault(r["conv_id"], []).append(r)
    assert set(got) == {r[0] for r in rows}
    for conv, found in got.items():
        turns, due = ordered(rows, conv), 0
        assert [r["example"] for r in found] == list(range(len(found)))
        at = [k for k, (role, _) in enumerate(turns) if role == "assistant"]
        ends = at + ([len(turns) - 1] if turns[-1][0] != "assistant" else [])
        assert len(found) == len(ends)
        for r, end in zip(found, ends):
            assert turns_of(r["text"]) == turns[: end + 1]
            if end in at:
                assert unescaped(r["text"][r["loss_start"] : r["loss_end"]]) == turns[end][1] and r["text"][r["loss_end"] :] == CLOSED
                due += 1
            else:
                assert r["loss_start"] is None and r["loss_end"] is None
        assert due == len(at)


def test_read_back(spark, rows):
    got = {r["conv_id"]: r for r in read_back(examples(frame(spark, rows))).collect()}
    for conv in {r[0] for r in rows}:
        turns, r = ordered(rows, conv), got[conv]
        loss = "".join(x for role, x in turns if role == "assistant")
        assert (r["n_turns"], r["loss_chars"]) == (len(turns), len(loss))
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()


def test_empty_and_other_targets(spark, rows):
    assert examples(frame(spark, [])).count() == 0 and read_back(examples(frame(spark, []))).count() == 0
    found = examples(frame(spark, [(1, 0, "user", "a"), (1, 1, "assistant", "b")]), target="user").sort("example").collect()
    assert [(r["loss_start"] is None, len(turns_of(r["text"]))) for r in found] == [(False, 1), (True, 2)]
