"""Cross-tokenizer alignment of distinct texts.

Documents are shuffled by their full texts, and every distinct text is tokenised and aligned once: by tokenizer A with a space in
front, by tokenizer B, which adds that space itself. Tokens become byte ranges; where tokens of both end, the text is cut into
groups, and in a group every token of A is linked with every token of B whose range overlaps. A pair of ids counts the links that hold
it, each text's links weighted by its copies. Pair counts then meet the texts' own pairs, and the measures go to the documents
by the SHA-256 of their texts.

Neither tokenizer has a token across the end of a word, so a word, with the white space before it, is encoded once a worker
(`CACHE` words are kept), and a text's ids are put together from its words (`words_at` checks this in the tokenizers' files;
with other files whole texts are encoded). Alignment runs in arrays over many texts. A task sums its pairs before they are
shuffled. Pair counts are broadcast up to `MOST_BROADCAST` counted pairs, shuffled beyond.

Null and empty texts, and texts whose tokens don't give their bytes back, have no tokens: all measures are 0, the digest
is ''. A very long text is put together from its words like any other. Of a B id's pairs, all that tie for the highest count
are best. Repeated rows and copies are counted each. An empty table gives no rows. Input columns named like a measure are
replaced, others passed through, except the text.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MOST_BROADCAST, joined, slices, stored, text_bytes

#: Words whose alignment a worker keeps.
CACHE = 500_000
#: Stands for the ids of a word that its tokens don't give back. No id has a byte of 255 four times.
LOST = b"\xff\xff\xff\xff"
#: Distinct pairs that a task holds before it sends their sums.
PAIRS_HELD = 1_000_000
MEASURES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
#: White space that is not ASCII's, which tokenizers tell apart from it in ways of their own.
OTHER_SPACE = re.compile("[\\x1c-\\x1f\\x85\\xa0\\u1680\\u180e\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]")
SPACES = " \t\n\x0b\x0c\r"

def default_tokenizers() -> tuple[str, str]:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json")), str(public_tokenizers.path("piece_bpe_32k.model"))


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves, the others from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(0x100 + j): b for j, b in enumerate(rest)}


@dataclass(frozen=True)
class Alignment:
    """Of some texts: counts (n_a, n_b, n_groups, n_links) and digests, each distinct pair of each text (by text, then code) with its links."""

    counts: np.ndarray
    digests: list[str]
    ends: np.ndarray  # behind each text's pairs
    pairs: np.ndarray
    links: np.ndarray


class Aligner:
    """Token ids of texts, word by word, and their alignment in arrays over many texts at once."""

    def __init__(self, a: str, b: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a), sentencepiece.SentencePieceProcessor(model_file=b)
        self.a.encode_special_tokens = True
        letters = byte_letters()
        vocabulary = self.a.get_vocab()
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            if all(c in letters for c in token):
                self.a_bytes[i] = bytes(map(letters.__getitem__, token))
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        byte = lambda p: bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode()
        self.b_bytes = [byte(p) for p in pieces]
        self.space = self.b.piece_to_id("▁")
        self.sizes = [np.array([len(x) for x in own], np.int64) for own in (self.a_bytes, self.b_bytes)]
        self.words = words_at(a, pieces)
        # A token as it stands in the groups: its number and what follows it.
        self.shown = [b"%d%c" % (i, mark) for own in (self.a_bytes, self.b_bytes) for i in range(len(own)) for mark in b",|;"]
        self.known_a: dict[str, bytes] = {}
        self.known_b: dict[str, bytes] = {}

    def _cut(self, words: list[str], ids: list[int], which: int) -> list[bytes] | None:
        """The ids of words that were encoded as one text; None if they don't give its words back."""
        sizes, own = self.sizes[which], np.array(ids, np.int64)
        raw = [w.encode() for w in words]
        tokens = (self.a_bytes, self.b_bytes)[which]
        if b"".join([tokens[i] for i in ids]) != b"".join(raw):
            return None
        ends, at = np.cumsum([len(x) for x in raw]), np.cumsum(sizes[own])
        last = np.searchsorted(at, ends)
        if not np.array_equal(at[last], ends):
            return None
        data, cuts = own.astype(np.uint32).tobytes(), [0, *(4 * (last + 1)).tolist()]
        return [data[x:y] for x, y in zip(cuts[:-1], cuts[1:])]

    def learn(self, words: set[str]) -> None:
        """The ids of words, many encoded as one text, or each for itself where that text doesn't come back."""
        new = words - self.known_a.keys()
        if len(self.known_a) + len(new) > CACHE:
            self.known_a, self.known_b, new = {}, {}, words
        plain = [w for w in new if w[0] == " " and w[-1] not in SPACES] if self.words else []
        alone = list(new.difference(plain))
        for k in range(0, len(plain), 500):
            part = plain[k : k + 500]
            text = "".join(part)
            a = self._cut(part, self.a.encode(text, add_special_tokens=False).ids, 0)
            b = a and self._cut(part, self.b.encode(text[1:]), 1)
            if b:
                self.known_a.update(zip(part, a, strict=True))
                self.known_b.update(zip(part, b, strict=True))
            else:
                alone += part
        # What B puts in front counts as the word's own first space, or goes where a word begins with other white space.
        pieces = self.b.encode([w[1:] if w[0] == " " else w for w in alone], num_threads=1)
        for w, x, y in zip(alone, self.a.encode_batch_fast(alone, add_special_tokens=False), pieces, strict=True):
            a, b, raw = x.ids, [self.space] if w == " " else y if w[0] == " " else y[1:], w.encode()
            same = b"".join([self.a_bytes[i] for i in a]) == raw == b"".join([self.b_bytes[i] for i in b])
            self.known_a[w] = array("I", a).tobytes() if same else LOST
            self.known_b[w] = array("I", b).tobytes() if same else LOST

    def of(self, texts: list[str]) -> Alignment:
        split = [(self.words.findall(" " + x) if self.words and not OTHER_SPACE.search(x) else [" " + x]) if x else [] for x in texts]
        self.learn(set().union(*split))
        data = []
        for words in split:
            a = b"".join(map(self.known_a.__getitem__, words))
            data.append((b"", b"") if LOST in a else (a, b"".join(map(self.known_b.__getitem__, words))))
        n_a, n_b = (np.array([len(d[j]) // 4 for d in data]) for j in (0, 1))
        a, b = (np.frombuffer(b"".join([d[j] for d in data]), np.uint32).astype(np.int64) for j in (0, 1))
        return self._aligned(a, b, n_a, n_b)

    def _aligned(self, a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> Alignment:
        """Of the ids of several texts, one after another. Between two neighbouring token ends lies what one A and one B token share: a link."""
        end_a, end_b = np.cumsum(self.sizes[0][a]), np.cumsum(self.sizes[1][b])
        bytes_in = int(end_a[-1]) if len(a) else 0
        ends_at = np.zeros(bytes_in + 1, np.uint8)  # 1 where A's token ends, 2 where B's does
        ends_at[end_a] = 1
        ends_at[end_b] += 2
        at = np.flatnonzero(ends_at)
        kind = ends_at[at].astype(np.int64)
        done_a, done_b = np.cumsum(kind & 1), np.cumsum(kind >> 1)
        first_a, first_b = np.r_[0, np.cumsum(n_a)], np.r_[0, np.cumsum(n_b)]
        link_a, link_b = done_a - (kind & 1), done_b - (kind >> 1)
        text = np.searchsorted(first_a, link_a, "right") - 1
        code, n = np.unique((text << 32) | (a[link_a] * len(self.b_bytes) + b[link_b]), return_counts=True)
        both = np.flatnonzero(kind == 3)
        # Tokens in the order of the groups: A's before B's.
        group_a, group_b = np.r_[0, done_a[both]], np.r_[0, done_b[both]]
        of_a, of_b = (np.repeat(np.arange(len(both)), np.diff(x)) for x in (group_a, group_b))
        shown = np.empty(len(a) + len(b), np.int64)
        shown[np.arange(len(a)) + group_b[of_a]] = 3 * a
        shown[np.arange(len(b)) + group_a[1:][of_b]] = 3 * (b + len(self.a_bytes))
        shown[group_a[1:] + group_b[:-1] - 1] += 1
        shown[group_a[1:] + group_b[1:] - 1] += 2
        cuts, table = (first_a + first_b).tolist(), self.shown
        shown = shown.tolist()
        digests = [hashlib.sha256(b"".join([table[i] for i in shown[x:y]])[:-1]).hexdigest() if y > x else "" for x, y in zip(cuts[:-1], cuts[1:])]
        texts = len(n_a)
        per = lambda x: np.bincount(x, minlength=texts)
        counts = np.stack([n_a, n_b, per(text[both]), per(text)], 1)
        return Alignment(counts, digests, np.cumsum(per(code >> 32)), code & 0xFFFFFFFF, n)


def words_at(a: str, pieces: list[str]) -> re.Pattern | None:
    """Finds a text's words with the white space before them; None where tokens may reach across their ends.

    A must split at white space as byte-level vocabularies do and leave the text as it is. B must have no piece with a space
    behind another character; other white space begins a word only if no longer piece has it.
    """
    with open(a) as f:
        file = json.load(f)
    splits = (file["pre_tokenizer"] or {}).get("type") == "ByteLevel" and file["pre_tokenizer"].get("use_regex", True) and not file["pre_tokenizer"]["add_prefix_space"]
    if not splits or file["normalizer"] is not None or any("▁" in p.lstrip("▁") for p in pieces):
        return None
    inside = "".join(c for c in SPACES if any(c in p for p in pieces if len(p) > 1))
    every = re.escape(SPACES)
    more = f"(?:[{re.escape(inside)}][{every}]*[^{every}]*)*" if inside else ""
    return re.compile(f"[{every}]+[^{every}]*{more}")


@functools.cache
def aligner(a: str, b: str) -> Aligner:
    """One for each worker, which later tasks go on using."""
    return Aligner(a, b)


def texts_aligned(texts: DataFrame, a: str, b: str) -> DataFrame:
    """Of distinct texts (text, copies): (digest, copies, n_a, n_b, n_groups, n_links, groups_sha256, pairs, links): pairs as sorted codes with their links."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        tool = aligner(a, b)
        for batch in slices(batches, "text", 2_000_000):
            found = tool.of([x.decode() for x in text_bytes(batch, "text")])
            ends = pa.array(np.r_[0, found.ends].astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (found.pairs, found.links)]
            measures = [pa.array(found.counts[:, j]) for j in range(4)]
            yield pa.RecordBatch.from_arrays([batch.column("digest"), batch.column("copies"), *measures, pa.array(found.digests, pa.string()), *lists], names)

    names = ["digest", "copies", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "links"]
    schema = "digest binary, copies long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, links array<long>"
    return texts.select("text", F.unhex(F.sha2("text", 256)).alias("digest"), "copies").mapInArrow(run, schema)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, n): the links that hold each pair, over all documents."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def summed(codes: list, counts: list):
            code, at = np.unique(np.concatenate(codes), return_inverse=True)
            n = np.zeros(len(code), np.int64)
            np.add.at(n, at, np.concatenate(counts))
            return [code], [n]

        codes, counts, more = [np.empty(0, np.int64)], [np.empty(0, np.int64)], 0
        for batch in batches:
            own = batch.column("pairs")
            sizes = np.diff(own.offsets.to_numpy())
            codes.append(own.flatten().to_numpy())
            counts.append(batch.column("links").flatten().to_numpy() * np.repeat(batch.column("copies").to_numpy(), sizes))
            more += len(codes[-1])
            if more > PAIRS_HELD:
                codes, counts = summed(codes, counts)
                more = 0
                if len(codes[0]) > PAIRS_HELD:
                    yield pa.RecordBatch.from_arrays([pa.array(codes[0]), pa.array(counts[0])], ["pair", "n"])
                    codes, counts = [codes[0][:0]], [counts[0][:0]]
        codes, counts = summed(codes, counts)
        yield pa.RecordBatch.from_arrays([pa.array(codes[0]), pa.array(counts[0])], ["pair", "n"])

    return aligned.select("copies", "pairs", "links").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def aligned_documents(docs: DataFrame, text: str = "text", a: str | None = None, b: str | None = None) -> DataFrame:
    """docs, without their texts, with n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256."""
    own_a, own_b = default_tokenizers()
    a, b = a or own_a, b or own_b
    kept = [c for c in docs.columns if c != text and c not in MEASURES]
    body = F.coalesce(F.col(text), F.lit(""))
    # Copies meet by their full text; a task counts its own copies first.
    texts = docs.select(body.alias("text")).groupBy("text").agg(F.count(F.lit(1)).alias("copies"))
    aligned = stored(texts_aligned(texts, a, b))
    counts = stored(pair_counts(aligned))
    b_ids = F.lit(piece_count(b))
    best = counts.groupBy((F.col("pair") % b_ids).alias("b")).agg(F.max("n").alias("most"))
    ranked = stored(counts.join(best, F.col("pair") % b_ids == F.col("b")).select("pair", "n", (F.col("n") == F.col("most")).alias("best")))
    ranked = F.broadcast(ranked) if ranked.count() <= MOST_BROADCAST else ranked
    held = aligned.select("digest", F.explode(F.arrays_zip("pairs", "links")).alias("x")).select("digest", F.col("x.pairs").alias("pair"), F.col("x.links").alias("of"))
    weighed = held.join(ranked, "pair").groupBy("digest").agg(F.sum(F.when(F.col("best"), F.col("of")).otherwise(0)).alias("n_best"), F.sum(F.col("of") * F.col("n")).alias("count_sum"))
    measured = aligned.drop("pairs", "links").join(weighed, "digest", "left")
    whole = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    measured = stored(measured.select("digest", "copies", "n_a", "n_b", "n_groups", "n_links", whole("n_best"), whole("count_sum"), "groups_sha256"))
    rows = docs.select(*kept, F.unhex(F.sha2(body, 256)).alias("digest"))
    return joined(rows, measured, "digest", "copies").select(*kept, *MEASURES)


def piece_count(b: str) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=b).vocab_size()
