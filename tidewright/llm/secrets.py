"""Secret scans: base patterns, and character Markov models compared by log-likelihood ratio.

Two first-order models of characters are trained on labelled strings: random strings (secret values that the base
patterns find in the sample, and seeded draws from the alphabets keys are written in) and ordinary strings (the sample's
other words, and identifiers made of its neighbouring words: snake_case, camelCase, kebab-case, dotted or slashed paths). A
long run of key characters is a secret where the random model explains it better by a margin, in all and a character.
The models are fitted on `train_docs` documents at most, those with the smallest hashed ids (an id of more documents than
that takes no part); all texts are scanned whole.

Null and empty texts have no spans. A very long text is scanned in one pass: candidates are sought between the base
spans, so a method span never overlaps one, and what a base span leaves of a longer run is still judged. Spans are code
points, end exclusive. Spans that start together are ordered by kind as listed. Repeated rows are each scanned. An empty
table gives no rows. Other columns are passed through, those named like a result replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
WORD = re.compile(r"[A-Za-z0-9+/_=.-]{3,}")
KINDS = ["assign", "access", "hex", "markov"]
#: Alphabets of the seeded random strings (fixed values).
ALPHABETS = [
    "0123456789abcdef",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
]
#: Marks whose runs draw lines, which are ordinary (fixed values).
RULERS = "-_=+/"
#: Forms of dates, which are ordinary (fixed values).
DATES = ("{:04}-{:02}-{:02}", "{:04}/{:02}/{:02}", "{:04}_{:02}_{:02}", "{2:02}-{1:02}-{0:04}", "{2:02}/{1:02}/{0:04}")
SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind as listed."""
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def _pairs(value: str) -> list[int]:
    codes = value.encode("ascii")
    return [a << 7 | b for a, b in zip(codes, codes[1:])]


def _gaps(spans: list[tuple[str, int, int]], end: int) -> Iterator[tuple[int, int]]:
    """What lies between spans that are ordered by start."""
    at = 0
    for _, a, b in spans:
        if a > at:
            yield at, a
        at = max(at, b)
    if at < end:
        yield at, end


#: How neighbouring words make an identifier.
STYLES = (
    "_".join,
    "-".join,
    "/".join,
    lambda words: "_".join(words).upper(),
    lambda words: "".join(w.capitalize() for w in words),
    lambda words: words[0] + "".join(w.capitalize() for w in words[1:]),
    lambda words: "_".join(words) + str(len(words[0])),
)


def identifiers(words: list[str]) -> list[str]:
    """Identifiers of four neighbouring words each, in all styles by turns."""
    plain = [w.lower() for w in words if w.isalpha() and w.isascii()]
    return [STYLES[k // 4 % len(STYLES)](plain[k : k + 4]) for k in range(0, len(plain) - 3, 4)]


def _labelled(text: str) -> tuple[list[str], list[str]]:
    """The base patterns' values, and the words outside their spans with the identifiers they make."""
    spans = base_spans(text)
    random = [ASSIGN.match(text, a)[2] if kind == "assign" else text[a:b] for kind, a, b in spans]
    words = [m[0] for a, b in _gaps(spans, len(text)) for m in WORD.finditer(text, a, b) if len(m[0]) < 20]
    return random, words + identifiers(words)


def ratio_table(docs: DataFrame, key: str = "doc_id", text: str = "text", train_docs: int = 2000, draws: int = 400, seed: int = 7):
    """log P(b|a, random) - log P(b|a, ordinary) for ASCII characters, as a flat array of 128 * 128."""
    import numpy as np

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        seen = np.zeros((2, 1 << 14), np.int64)
        for batch in batches:
            for x in batch.column(0).to_pylist():
                for side, values in zip((1, 0), _labelled(x or ""), strict=True):
                    np.add.at(seen[side], [p for v in values for p in _pairs(v)], 1)
        label, pair = np.nonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(label), pa.array(pair), pa.array(seen[label, pair])], ["label", "pair", "n"])

    # The sample is drawn from the ids alone, so that no task meets the texts of all tasks' candidates.
    ids = docs.groupBy(F.col(key).alias("id")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= train_docs).orderBy(F.xxhash64("id"), "id").limit(train_docs)
    so_far = F.sum("n").over(Window.orderBy(F.xxhash64("id"), "id"))  # over train_docs rows at most
    ids = ids.withColumn("so_far", so_far).where(F.col("so_far") <= train_docs).select("id")
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    sample = rows.join(F.broadcast(ids), F.col("key").eqNullSafe(F.col("id")), "left_semi")
    counted = sample.select("text").mapInArrow(count, "label long, pair long, n long").groupBy("label", "pair").agg(F.sum("n").alias("n"))
    seen = np.zeros((2, 128, 128))
    for r in counted.collect():  # two tables of 128 * 128 at most
        seen[r["label"], r["pair"] >> 7, r["pair"] & 127] = r["n"]
    draw = np.random.default_rng(seed)
    for letters in ALPHABETS:
        codes = np.frombuffer(letters.encode(), np.uint8)[draw.integers(0, len(letters), (draws, 40))]
        np.add.at(seen[1], (codes[:, :-1], codes[:, 1:]), 1)
    for mark in RULERS.encode():
        seen[0, mark, mark] += 100 * draws
    for year, month, day in draw.integers((1990, 1, 1), (2040, 13, 32), (draws, 3)):
        for form in DATES:
            np.add.at(seen[0].reshape(-1), _pairs(form.format(year, month, day)), 1)
    return log_ratio(seen)


def log_ratio(seen):
    """From pair counts (label, first, second). A pair that was rarely seen leans on how often its kind of character follows the other's."""
    import numpy as np

    kind = np.array([0 if chr(c).isdigit() else 1 if chr(c).islower() else 2 if chr(c).isupper() else 3 + c for c in range(128)])
    kind = np.unique(kind, return_inverse=True)[1]
    of = np.eye(kind.max() + 1)[kind]
    steps = of.T @ seen @ of  # (label, kind, kind)
    steps = (steps + 0.1) / (steps + 0.1).sum(2, keepdims=True)
    alone = seen.sum(1) + 0.5
    alone = alone / (alone @ of)[:, kind]  # of a character among its kind
    lean = steps[:, kind][:, :, kind] * alone[:, None, :]
    prob = (seen + 30 * lean) / (seen.sum(2, keepdims=True) + 30)
    return (np.log(prob[1]) - np.log(prob[0])).ravel()


def method_spans(text: str, table, base: list[tuple[str, int, int]], margin: float, per_char: float) -> list[tuple[str, int, int]]:
    found = []
    for low, high in _gaps(base, len(text)):
        for m in CANDIDATE.finditer(text, low, high) if high - low >= 20 else ():
            a, b = m.span()
            total = table[_pairs(m[0])].sum()
            if total >= margin and total >= per_char * (b - a - 1):
                found.append(("markov", a, b))
    return found


def scanned(docs: DataFrame, key: str = "doc_id", text: str = "text", train_docs: int = 2000, margin: float = 25.0, per_char: float = 1.7) -> DataFrame:
    """docs with secret_spans: array of (kind, start, end), by start and then kind."""
    table = ratio_table(docs, key, text, train_docs)
    kept = [c for c in docs.columns if c != "secret_spans"]
    schema = T.StructType([*(docs.schema[c] for c in kept), T.StructField("secret_spans", SPAN)])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in slices(batches, text):
            out = []
            for x in batch.column(text).to_pylist():
                base = base_spans(x) if x else []
                more = method_spans(x, table, base, margin, per_char) if x else []
                spans = sorted(base + more, key=lambda s: (s[1], KINDS.index(s[0])))
                out.append([{"kind": k, "start": a, "end": b} for k, a, b in spans])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(out, kind)], [*kept, "secret_spans"])

    return docs.select(*kept).mapInArrow(run, schema)


def redacted(docs: DataFrame, text: str = "text", mask: str = "[secret]", **how) -> DataFrame:
    """docs with every secret span of the text replaced by a mask."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            out = []
            for x, spans in zip(batch.column(text).to_pylist(), batch.column("secret_spans").to_pylist(), strict=True):
                at, parts = 0, []
                for s in spans or []:
                    if s["start"] >= at:
                        parts += [x[at : s["start"]], mask]
                    at = max(at, s["end"])
                out.append("".join([*parts, x[at:]]) if x is not None else None)
            names = [c for c in batch.schema.names if c != "secret_spans"]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if c == text else batch.column(c) for c in names], names)

    found = scanned(docs, text=text, **how)
    return found.mapInArrow(run, T.StructType([f for f in found.schema if f.name != "secret_spans"]))


def digests(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts by kind, the hash of the base spans, and all spans as text."""
    spans = F.col("secret_spans")
    shown = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    count = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter(spans, lambda s: s["kind"] != "markov")
    return found.select(
        key, *(count(k) for k in KINDS[:3]),
        F.sha2(F.array_join(F.transform(base, shown), ","), 256).alias("base_sha256"),
        F.array_join(F.transform(spans, shown), ",").alias("spans"),
        count("markov"),
    )
