"""Best-fit packing by bin completion.

A document is its token ids and one end id; only longer ones are cut. Pieces that fill a sequence stand alone. All
others are dealt evenly into groups of about `group_pieces`, each packed by itself, so the sequences lost against one
global packing are about one a group. Within a group, branch and bound completes bins around the largest piece left
(`bin_completion`), with best-fit decreasing as the first incumbent; where that meets the lower bound, it is optimal.

Null and empty texts have the end id alone. A very long text is cut into as many pieces as it takes; one text is held
at a time. Pieces of equal length change places freely: which one goes where is not defined, the lengths of each sequence
are. Repeated rows are packed once each. An empty table gives no rows. Input columns named like a result are replaced;
others are passed through, except the text.

White-space separated strings are encoded once each, in lower case, where the tokenizer's file says that white space and
case do not matter (`word_by_word`); with any other file whole texts are encoded.
"""

from __future__ import annotations

import functools
import json
import re
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bin_completion import bin_completion
from .common import slices, stored, text_bytes

CAPACITY = 4096
#: With more strings' ids than that, a worker keeps those it has used since the last time there were so many.
CACHE = 100_000
#: What is neither letter, digit nor white space in ASCII.
MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum())
PIECE = [("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType())]


def default_tokenizer() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def word_by_word(path: str) -> bool:
    """Whether the file's normaliser drops case and white space's kind, its pre-tokens are letters, single digits or marks with word ends, and added tokens look like `<|word|>`."""
    with open(path) as f:
        file = json.load(f)
    parts = lambda key, inner: [x for x in ((file[key] or {}).get(inner) or [file[key]]) if x]
    lower = any(x["type"] == "Lowercase" for x in parts("normalizer", "normalizers"))
    split = any(x["type"] == "Split" and x["behavior"] == "Removed" and x["invert"] and r"[^\s\p{L}\p{N}]+" in x["pattern"].get("Regex", "") for x in parts("pre_tokenizer", "pretokenizers"))
    bare = all(x["type"] == "Split" or x["type"] == "ByteLevel" and not x["add_prefix_space"] for x in parts("pre_tokenizer", "pretokenizers"))
    added = all(re.fullmatch(r"<\|\w+\|>", t["content"]) and not t["lstrip"] and not t["rstrip"] for t in file.get("added_tokens") or [])
    return lower and split and bare and added and file["model"].get("end_of_word_suffix") == "</w>"


class Ids:
    """Token ids as little-endian bytes. White space always separates tokens here, so strings between it are looked up once for each slice."""

    def __init__(self, path: str):
        import os

        import numpy as np

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer, self.word_by_word = Tokenizer.from_file(path), word_by_word(path)
        self.known: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}  # those known until the last time there were too many
        self.ascii = Tokenizer.from_file(path)  # for lower-case a-z between spaces, which normaliser and pre-tokens leave alone
        if self.word_by_word:
            self.ascii.normalizer, self.ascii.pre_tokenizer = normalizers.Sequence([]), pre_tokenizers.WhitespaceSplit()
        self.added = [t.content.encode().lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def lowered(self, text: bytes) -> bytes:
        """A-Z in lower case, but for strings that hold an added token then: only its own case is the token."""
        lower = text.lower()
        if not any(t in lower for t in self.added):
            return lower
        return b" ".join(w if any(t in w.lower() for t in self.added) else w.lower() for w in text.split())

    def learn(self, strings: list[bytes]) -> None:
        """Marks behind plain letters are one pre-token of their own, so many strings follow from others."""
        parts, needed = [], {}
        for x in strings:
            core = x.rstrip(MARKS)
            if core and len(core) < len(x) and (core.isalpha() or core.decode().lower().isalpha()):  # a letter's lower case may end in a mark
                tail = x[len(core) :]
                parts.append((x, core, tail))
                needed[core] = needed[tail] = None
            else:
                needed[x] = None
        self._encode([y for y in needed if y not in self.known])
        known = self.known
        known.update([(x, known[core] + known[tail]) for x, core, tail in parts])

    def _encode(self, strings: list[bytes]) -> None:
        """Letters alone are one pre-token, whose last token ends a word; so they are encoded together and cut there."""
        import numpy as np

        plain, letters, other = [], [], []
        for x in strings:
            (plain if x.isalpha() and x.islower() else letters if x.decode().lower().isalpha() else other).append(x)
        for tokenizer, words in ((self.ascii, plain), (self.tokenizer, letters)):
            chunks = [words[k : k + 200] for k in range(0, len(words), 200)]
            for part, e in zip(chunks, tokenizer.encode_batch_fast([b" ".join(part).decode() for part in chunks], add_special_tokens=False), strict=True):
                ids = np.array(e.ids, "<u4")
                cuts = [0, *((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()]
                if len(cuts) != len(part) + 1:
                    other += part
                    continue
                data = ids.tobytes()
                self.known.update((x, data[a:b]) for x, a, b in zip(part, cuts[:-1], cuts[1:], strict=True))
        for x, e in zip(other, self.tokenizer.encode_batch_fast([x.decode() for x in other], add_special_tokens=False), strict=True):
            self.known[x] = np.array(e.ids, "<u4").tobytes()

    def _ids(self, strings: list[bytes]) -> list[bytes]:
        """The ids of distinct strings."""
        if len(self.known) > CACHE:
            self.known, self.before = {}, self.known
        found = list(map(self.known.get, strings))
        missing = [k for k, x in enumerate(found) if x is None]
        again = [(x, old) for k in missing if (old := self.before.get(x := strings[k])) is not None]
        self.known.update(again)
        self.learn([x for k in missing if (x := strings[k]) not in self.known])
        for k in missing:
            found[k] = self.known[strings[k]]
        return found

    def of(self, texts: list[bytes]) -> Iterator[bytes]:
        """The ids of each text."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        if not self.word_by_word:
            for x in texts:
                yield np.array(self.tokenizer.encode(x.decode(), add_special_tokens=False).ids, "<u4").tobytes()
            return
        split = pc.ascii_split_whitespace(pa.array([self.lowered(x) for x in texts], pa.large_binary()).cast(pa.large_string()))
        words = split.flatten().dictionary_encode()
        found = self._ids(words.dictionary.cast(pa.large_binary()).to_pylist())
        which = words.indices.to_numpy()
        places = np.r_[0, np.cumsum(pc.list_value_length(split).to_numpy())].tolist()
        for a, b in zip(places[:-1], places[1:], strict=True):
            yield b"".join(map(found.__getitem__, which[a:b].tolist()))


@functools.cache
def ids_of(path: str) -> Ids:
    """One for each worker, which later tasks go on using."""
    return Ids(path)


def pieces(docs: DataFrame, text: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = 1) -> DataFrame:
    """A row for each piece of each document, with the document's other columns."""
    path = tokenizer or default_tokenizer()
    kept = [c for c in docs.columns if c not in {text, *(n for n, _ in PIECE)}]
    schema = T.StructType([*(docs.schema[c] for c in kept), *(T.StructField(n, t) for n, t in PIECE)])
    tail = end_id.to_bytes(4, "little")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        ids = ids_of(path)
        for batch in slices(batches, text, 3_000_000):
            rows, cut = [], []
            for k, own in enumerate(ids.of(text_bytes(batch, text))):
                data = own + tail
                for piece, at in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[at : at + 4 * capacity]
                    rows.append(k)
                    cut.append((piece, at // 4, len(part) // 4, zlib.crc32(part)))
            columns = [pa.array([c[j] for c in cut], pa.int32() if j == 0 else pa.int64()) for j in range(4)]
            own = batch.select(kept).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*own.columns, *columns], schema.names)

    return docs.select(*kept, text).mapInArrow(run, schema)


def packed_lengths(lengths: list[int], capacity: int, nodes_per_piece: int | None = 100) -> list[list[int]]:
    """The lengths in each bin, by bin completion with a bound on its nodes; None: as many as the optimum takes."""
    nodes = None if nodes_per_piece is None else max(200_000, nodes_per_piece * len(lengths))
    return bin_completion(lengths, capacity, nodes)


def packed(docs: DataFrame, text: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = 1, group_pieces: int = 20_000, nodes_per_piece: int | None = 100) -> DataFrame:
    """The pieces of all documents with sequence_id and offset."""
    cut = stored(pieces(docs.drop("sequence_id", "offset"), text, tokenizer, capacity, end_id))
    whole = cut.where(F.col("length") == capacity).select("*", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    part = cut.where(F.col("length") < capacity)
    n = max(1, -(-part.count() // group_pieces))
    schema = T.StructType([*cut.schema, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def pack(key, table):
        import numpy as np
        import pyarrow as pa

        lengths = table.column("length").to_numpy()
        of: dict[int, list[int]] = {}
        for row, x in enumerate(lengths.tolist()):
            of.setdefault(x, []).append(row)
        ids, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        for b, filling in enumerate(packed_lengths(lengths.tolist(), capacity, nodes_per_piece)):
            at = 0
            for x in filling:
                row = of[x].pop()
                ids[row], offsets[row] = (key[0].as_py() << 32) + b, at
                at += x
        return table.drop_columns(["group"]).append_column("sequence_id", pa.array(ids)).append_column("offset", pa.array(offsets))

    # Consecutive rows of the stored table go to different groups, so that groups are even whatever the ids are.
    dealt = part.withColumn("group", F.pmod(F.monotonically_increasing_id(), F.lit(n)))
    return whole.unionByName(dealt.groupBy("group").applyInArrow(pack, schema))
