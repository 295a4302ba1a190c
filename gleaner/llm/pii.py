"""Personal data: fixed patterns find seeds, and bootstrapped contexts find what those miss.

Seeds are the base kinds and 40-digit hexadecimal keys. Every other run of words that may be an identifier (words with a digit,
up to ``JOINED`` short ones in a row, ``LEAST`` characters in all) is a candidate. Each of both has up to three lexical patterns:
the two words before; the word before; the word before with the shape of the identifier and what follows it. Spark scores the
graph of patterns and instances for some rounds: a pattern's score is the mean of its instances' scores, shrunk towards 0; an
unknown instance gets the score of its best pattern; what looks like a base kind and fails its check counts 0. Patterns with a high score and enough different seeds, nearly all of one kind,
give their candidates that kind. Keys are only seeds: a key is reported where its context is trusted. Where no word stands
before, there is no pattern.

Null and empty texts have no spans. A null id stays null. Repeated rows stay rows, and count once for an instance. Texts are read
whole; runs of any length are scanned in linear time. Other columns are ignored, those of :func:`masked` kept. Ties between
patterns go to the greater score, then the kind later in the alphabet.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._store import get, new_dir, put, saved, seal
from ._text import by_text, pieces, raw

KINDS = ("email", "ip", "card", "phone")
#: What looks like a base kind and fails its check: evidence against a pattern, and never reported.
FAILED = "none"
LEAST, JOINED, SEEDS, CONFIDENT, ROUNDS = 6, 4, 8, 0.85, 3

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_KEY = re.compile(r"(?<![0-9A-Za-z])[0-9a-fA-F]{40}(?![0-9A-Za-z])")
_DIGIT = re.compile(r"[0-9]")
_SPACE = "\t\n\v\f\r "
_STRIP = "\"'`()[]{}<>,;:!?.*#$%&|="


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the base kinds, kind by kind."""
    spans = [("email", a, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m[0].split(".")):
            spans.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            spans.append(("card", *m.span()))
    if "+" in text:
        spans += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return spans


def _hash(s: str) -> int:
    return int.from_bytes(hashlib.blake2b(s.encode(errors="replace"), digest_size=8).digest(), "little", signed=True)


_HEX = re.compile("[0-9a-fA-F]{16,}")
_LEXICAL = re.compile(r"[^\W_]")


def _shape(word: str) -> str:
    """Digits as 0, letters as a, runs of either as one; long hexadecimal words and numbers by their length."""
    if _HEX.fullmatch(word):
        return f"{'0' if word.isdecimal() else 'x'}{len(word)}"
    if word.isascii() and word.isdecimal():
        return f"0{len(word)}"
    return re.sub("[^\\W\\d_]+", "a", re.sub("[0-9]+", "0", word[:48]))


def _patterns(text: str, start: int, end: int) -> list[int]:
    before, kept, lexical = text[max(0, start - 80) : start].split(), [], 0
    found = []
    while before and lexical < 2:
        word = re.sub("[0-9]+", "0", before.pop().lower())
        kept.insert(0, word)
        if _LEXICAL.search(word):
            lexical += 1
            found.append(" ".join(kept))
    if not found:
        return []
    after = text[end : end + 1]
    shaped = f"{found[0]}\t{_shape(text[start:end])}\t{after if after not in _SPACE else ' '}"
    return [_hash(f"{kind}\t{p}") for kind, p in zip("1s2", (found[0], shaped, *found[1:]))]


def _identifiers(text: str, taken: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Words with a digit, stripped of punctuation, short ones in a row together; none that a base span overlaps."""
    at, row, k = 0, [], 0

    def whole() -> Iterator[tuple[int, int]]:
        if row and row[-1][1] - row[0][0] >= LEAST:
            yield row[0][0], row[-1][1]

    while m := _DIGIT.search(text, at):
        a = b = m.start()
        while a > at and text[a - 1] not in _SPACE:
            a -= 1
        while b < len(text) and text[b] not in _SPACE:
            b += 1
        at = edge = b
        whole_word = a
        while a < b and text[a] in _STRIP:
            a += 1
        while b > a and text[b - 1] in _STRIP:
            b -= 1
        while k < len(taken) and taken[k][1] <= a:
            k += 1
        free = not (k < len(taken) and taken[k][0] < b)
        joins = free and row and len(row) < JOINED and row[-1][2] + 1 == whole_word and row[-1][1] == row[-1][2] and a == whole_word and b - a <= LEAST and row[-1][1] - row[-1][0] <= LEAST
        if not joins:
            yield from whole()
            row = []
        if free and b > a:
            row.append((a, b, edge))
    yield from whole()


def candidates(text: str, spans: list[tuple[str, int, int]]) -> list[tuple[int, int, list[int], int, str | None]]:
    """``(start, end, patterns, instance, kind)``; the kind of seeds, None of what may be an identifier. Seeds of ``spans`` come first."""
    found = [(a, b, _patterns(text, a, b), _hash(text[a:b]), kind) for kind, a, b in spans]
    for a, b in _identifiers(text, sorted((a, b) for _, a, b in spans)):
        word = text[a:b]
        kind = "key" if _KEY.fullmatch(word) else FAILED if _IP.fullmatch(word) or (
            _CARD.fullmatch(word) and 13 <= sum(c.isdecimal() for c in word) <= 19
        ) else None
        found.append((a, b, _patterns(text, a, b), _hash(word), kind))
    return found


_DIGITS_AT = np.zeros(256, np.int64)
_DIGITS_AT[0x30:0x3A] = 1
_DIGITS_AT[0x40] = 1
_FOUND = "row long, id long, base array<struct<kind:string,first:int,end:int>>, seen array<struct<first:int,end:int,patterns:array<bigint>,instance:bigint,kind:string>>"


def _lists(rows: list[list[tuple]], names: tuple[str, ...], kinds: tuple[pa.DataType, ...]) -> pa.ListArray:
    flat = list(zip(*(x for row in rows for x in row))) or [()] * len(names)
    offsets = np.r_[0, np.cumsum([len(r) for r in rows])].astype(np.int32)
    return pa.ListArray.from_arrays(
        pa.array(offsets), pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(flat, kinds)], names=list(names)),
    )


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span, seen_kinds = (pa.string(), pa.int32(), pa.int32()), (pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.int64(), pa.string())
    for batch in pieces(batches):
        data, offsets = raw(batch.column("text"))
        some = by_text(_DIGITS_AT[data], offsets) > 0
        base, seen = [[] for _ in some], [[] for _ in some]
        for i in np.flatnonzero(some).tolist():
            text = batch.column("text")[i].as_py()
            base[i] = base_spans(text)
            seen[i] = [c for c in candidates(text, base[i]) if c[2]]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("row"), batch.column("id"), _lists(base, ("kind", "first", "end"), span),
                _lists(seen, ("first", "end", "patterns", "instance", "kind"), seen_kinds),
            ],
            names=["row", "id", "base", "seen"],
        )


def patterns(seen: DataFrame, rounds: int = ROUNDS, seeds: int = SEEDS, confident: float = CONFIDENT) -> DataFrame:
    """``(pattern, instance, kind)`` -> ``(pattern, kind, confidence)`` of the patterns to trust."""
    edges = seen.groupBy("pattern", "instance").agg(F.max("kind").alias("kind"))
    seeded = seen.where(F.col("kind") != FAILED).select("pattern").distinct()  # others can't be trusted
    edges = saved(edges.join(seeded, "pattern", "left_semi"), "edges")
    known = edges.groupBy("instance").agg(F.max(F.when(F.col("kind").isNotNull(), (F.col("kind") != FAILED).cast("double"))).alias("known"))
    instances = known.select("instance", F.coalesce("known", F.lit(0.0)).alias("score"), "known")
    scored = None
    for _ in range(rounds):
        scored = saved(
            edges.join(instances, "instance").groupBy("pattern").agg((F.sum("score") / (F.count("*") + 1)).alias("confidence")), "patterns",
        )
        best = edges.join(scored, "pattern").groupBy("instance").agg(F.max("confidence").alias("best"))
        instances = saved(
            instances.select("instance", "known").join(best, "instance").select(
                "instance", F.coalesce("known", "best").alias("score"), "known",
            ),
            "instances",
        )
    by_kind = edges.where(F.col("kind") != FAILED).groupBy("pattern", "kind").agg(F.count("*").alias("n"))
    kinds = by_kind.groupBy("pattern").agg(F.sum("n").alias("seeds"), F.max(F.struct("n", "kind")).alias("most"))
    return scored.join(kinds, "pattern").where((F.col("seeds") >= seeds) & (F.col("confidence") >= confident) & (F.col("most.n") >= confident * F.col("seeds"))).select("pattern", F.col("most.kind").alias("kind"), "confidence")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``row`` (a number of its own), ``id_col``, ``base`` and ``more``, arrays of kind, first and end code point."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    found = saved(rows.mapInArrow(_find, _FOUND), "pii")
    seen = found.where(F.size("seen") > 0).select("row", F.explode("seen").alias("s")).select("row", "s.*")
    trusted = patterns(seen.select(F.explode("patterns").alias("pattern"), "instance", "kind"))
    fresh = seen.where("kind is null or kind = 'key'").select(
        "row", "first", "end", F.explode("patterns").alias("pattern"),
    ).join(trusted, "pattern")
    fresh = fresh.groupBy("row", "first", "end").agg(F.max(F.struct("confidence", "kind")).alias("best")).select(
        "row", F.struct("best.kind", "first", "end").alias("span"),
    )
    more = fresh.groupBy("row").agg(F.sort_array(F.collect_list("span")).alias("more"))  # those of one text
    return found.join(more, "row", "left").select(
        "row", F.col("id").alias(id_col), "base",
        F.coalesce("more", F.array().cast("array<struct<kind:string,first:int,end:int>>")).alias("more"),
    )


def told(spans, kinds: tuple[str, ...] = KINDS):
    """``kind:start:end``, by kind as listed, others after, then by start."""
    place = lambda s: F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, kinds)), s["kind"]), F.lit(0)), F.lit(len(kinds) + 1))
    keyed = F.array_sort(
        F.transform(
            spans, lambda s: F.struct(place(s).alias("place"), s["kind"].alias("kind"), s["first"].alias("first"), s["end"].alias("end")),
        )
    )
    return F.array_join(F.transform(keyed, lambda s: F.concat_ws(":", s["kind"], s["first"].cast("string"), s["end"].cast("string"))), ",")


def masked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """The same rows and columns, with every span of ``text_col`` replaced by its kind in brackets and ``length_col`` brought in line.

    Fixed patterns and trusted contexts are found anew in each text from the trusted patterns alone, so no text is shuffled.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    found = saved(rows.mapInArrow(_find, _FOUND), "pii")
    seen = found.select(F.explode("seen").alias("s")).select("s.*")
    trusted = patterns(seen.select(F.explode("patterns").alias("pattern"), "instance", "kind"))
    at = _trusted_store(trusted)
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, scores, kinds = at()
        for batch in pieces(batches, text_col):
            data, offsets = raw(batch.column(text_col))
            some = np.flatnonzero(by_text(_DIGITS_AT[data], offsets) > 0)
            changed: dict[int, str] = {}
            for i in some.tolist():
                text = batch.column(text_col)[i].as_py()
                spans = base_spans(text)
                all_ = list(spans)
                for a, b, own, _, kind in candidates(text, spans)[len(spans) :]:
                    at_ = [] if kind == FAILED else [
                        k for p in own for k in [int(np.searchsorted(keys, p))] if k < len(keys) and keys[k] == p
                    ]
                    if at_:
                        all_.append((max((float(scores[k]), str(kinds[k])) for k in at_)[1], a, b))
                if all_:
                    out, done = [], 0
                    for a, b, kind in sorted((a, -b, kind) for kind, a, b in all_):
                        if a >= done:
                            out += [text[done:a], f"[{kind.upper()}]"]
                        done = max(done, -b)
                    changed[i] = "".join([*out, text[done:]])
            if changed:
                columns = {n: batch.column(n) for n in batch.schema.names}
                texts = columns[text_col].to_pylist()
                for i, t in changed.items():
                    texts[i] = t
                columns[text_col] = pa.array(texts, batch.schema.field(text_col).type)
                if length_col in columns:
                    lengths = columns[length_col].to_pylist()
                    for i, t in changed.items():
                        lengths[i] = len(t)
                    columns[length_col] = pa.array(lengths, batch.schema.field(length_col).type)
                batch = pa.RecordBatch.from_arrays(list(columns.values()), schema=batch.schema)
            yield batch

    return docs.mapInArrow(run, schema)


def _trusted_store(trusted: DataFrame):
    """Trusted patterns as sorted arrays in the shared folder, for workers to map."""
    uri = new_dir(trusted.sparkSession, "trusted")
    trusted = saved(trusted, "patterns")
    shards = max(1, trusted.count() // 1_000_000)

    def write(pdf):
        pdf = pdf.sort_values("pattern")
        put(
            uri, int(pdf["shard"].iloc[0]),
            {
                "pattern": pdf["pattern"].to_numpy(np.int64), "confidence": pdf["confidence"].to_numpy(float),
                "kind": pdf["kind"].to_numpy().astype("U8"),
            },
        )
        return pdf[["shard"]].iloc[:1]

    done = trusted.withColumn("shard", F.pmod(F.hash("pattern"), F.lit(shards))).groupBy("shard").applyInPandas(
        write, "shard int",
    ).collect()
    seal(uri, shards, [r["shard"] for r in done], "pattern", "confidence", "kind")

    def read() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        keys, scores, kinds = (
            np.concatenate([np.asarray(get(uri, k, n)) for k in range(shards)]) for n in ("pattern", "confidence", "kind")
        )
        if not len(keys):
            return np.empty(0, np.int64), np.empty(0), np.empty(0, "U8")
        order = np.argsort(keys)
        return keys[order], scores[order], kinds[order]

    return read


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = find(spark.read.parquet(f"{sf_dir}/documents.parquet"))

    def count(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    every = F.concat("base", "more")
    return rows.select(
        "doc_id", *map(count, KINDS), F.sha2(told(F.col("base")), 256).alias("base_sha256"), told(every).alias("spans"),
        F.size(every).cast("long").alias("n_spans"),
    )
