"""Token counts by dynamic programming over a trie of distinct pre-tokens.

The best segmentation of a pre-token under a unigram model of pieces needs, at each position, the best score of the
text before it: its forward score. Distinct pre-tokens are inserted in a trie whose nodes hold the forward score and the
token count of their prefix, so a shared prefix is scored once, and a pre-token's token count is stored where it ends. A
worker's trie outlives its tasks; it starts anew beyond `NODES` nodes, which changes no result. A document's count is the sum over
its pre-tokens. Nothing is shuffled.

The pieces are those of a public SentencePiece file; a piece's log probability falls with its rank by Zipf's law.
A character that no piece covers costs its UTF-8 bytes. Of equal scores the segmentation whose last piece is longest
wins. Null and empty texts have no tokens; a very long text is held by itself, and a very long pre-token takes a node for
each of its characters while it is counted. Repeated rows are each counted; an empty table gives no rows. Other columns
are passed through but the text; input columns named like a result are replaced.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import slices, text_bytes

MARK = "▁"
#: Bounds of what a worker keeps: trie nodes, and pre-tokens with their counts.
NODES = 1_000_000
CACHE = 500_000


def default_pieces() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


class Pieces:
    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [k for k in range(model.get_piece_size()) if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k))]
        total = sum(1 / (r + 1) for r in range(len(plain)))
        self.score = {model.id_to_piece(k): -math.log((r + 1) * total) for r, k in enumerate(plain)}
        self.longest = max(map(len, self.score))
        self.byte_score = min(self.score.values()) - 10
        self.known: dict[bytes, int] = {}
        self._clear()

    def _clear(self) -> None:
        self.child: dict[tuple[int, str], int] = {}
        self.best, self.count = [0.0], [0]  # of each node; 0 is the root
        self.path, self.before = [0], ""  # the nodes of the pre-token inserted last

    def insert(self, word: str) -> int:
        """The token count of a pre-token, stored at the node where it ends. What it shares with the one before needs no walk."""
        child, best, count, score, longest, path = self.child, self.best, self.count, self.score, self.longest, self.path
        before, same = self.before, 0
        most = min(len(word), len(before))
        while same < most and word[same] == before[same]:
            same += 1
        del path[same + 1 :]
        node = path[same]
        for j in range(same + 1, len(word) + 1):
            letter = word[j - 1]
            after = child.get((node, letter))
            if after is None:
                top, n = -math.inf, 0
                if letter not in score:
                    size = len(letter.encode())
                    top, n = best[node] + size * self.byte_score, count[node] + size
                for i in range(j - longest if j > longest else 0, j):
                    s = score.get(word[i:j])
                    if s is not None and best[path[i]] + s > top:
                        top, n = best[path[i]] + s, count[path[i]] + 1
                after = child[node, letter] = len(best)
                best.append(top)
                count.append(n)
            node = after
            path.append(node)
        self.before = word
        return count[node]

    def learn(self, strings: set[bytes]) -> None:
        known = self.known
        new = {x for x in strings if x not in known}
        if len(known) + len(new) > CACHE:
            known.clear()
            new = strings
        for x in sorted(new):
            if len(self.best) > NODES:
                self._clear()
            known[x] = self.insert(MARK + x.decode())


@functools.cache
def pieces_of(path: str) -> Pieces:
    """One for each worker, which later tasks go on using."""
    return Pieces(path)


def counted(docs: DataFrame, text: str = "text", pieces: str | None = None) -> DataFrame:
    """docs without the text, with n_pretokens and n_tokens."""
    path = pieces or default_pieces()
    kept = [c for c in docs.columns if c not in (text, "n_pretokens", "n_tokens")]
    schema = T.StructType([*(docs.schema[c] for c in kept), T.StructField("n_pretokens", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        model = pieces_of(path)
        for batch in slices(batches, text):
            split = [x.split() for x in text_bytes(batch, text)]
            model.learn({w for words in split for w in words})
            known = model.known.__getitem__
            tokens = pa.array([sum(map(known, words)) for words in split], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array([len(w) for w in split], pa.int64()), tokens], schema.names)

    return docs.select(*kept, text).mapInArrow(run, schema)
