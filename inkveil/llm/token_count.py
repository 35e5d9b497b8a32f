"""Token counts by a linear longest-match automaton.

Greedy word pieces take, again and again, the longest piece that starts the rest of a
word. The automaton is a trie of the vocabulary in which every node has a failure link
and the number of pieces that are popped when it is followed: reading a word is one pass
over its characters, and the count is the sum of what was popped. No piece is ever built.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkveil.llm._common import Batches, id_and_text, utf8

MARK = "▁"
CACHE_WORDS = 300_000  # words whose count a worker remembers
LONG_WORD = 64  # bytes over which a word isn't remembered

_AUTOMATA: dict[str, LongestMatch] = {}


class LongestMatch:
    """first: pieces that start a word; later: pieces that continue one."""

    def __init__(self, first: Iterable[str], later: Iterable[str]):
        # node 0: start of a word; node 1: start of a later piece
        self.child: list[dict[str, int]] = [{}, {}]
        self.fail = [-1, -1]
        self.popped = [0, 0]
        ends = [False, False]
        for root, pieces in ((0, first), (1, later)):
            for p in pieces:
                at = root
                for c in p:
                    if c not in self.child[at]:
                        self.child[at][c] = len(self.child)
                        self.child.append({})
                        self.fail.append(-1)
                        self.popped.append(0)
                        ends.append(False)
                    at = self.child[at][c]
                ends[at] = at > 1
        layer = [0, 1]
        while layer:
            below = []
            for v in layer:
                for c, u in self.child[v].items():
                    below.append(u)
                    if ends[u]:
                        self.fail[u], self.popped[u] = 1, 1
                        continue
                    z, n = self.fail[v], self.popped[v]
                    while z >= 0 and c not in self.child[z]:
                        n += self.popped[z]
                        z = self.fail[z]
                    if z >= 0:
                        self.fail[u], self.popped[u] = self.child[z][c], n
            layer = below
        self._known: dict[bytes, int] = {}

    def count(self, word: str) -> int:
        """Pieces of a word; 0 if the greedy pieces don't cover it (an unknown word)."""
        at, n = 0, 0
        child, fail, popped = self.child, self.fail, self.popped
        for c in word:
            while (to := child[at].get(c)) is None:
                n += popped[at]
                at = fail[at]
                if at < 0:
                    return 0
            at = to
        while at != 1:
            n += popped[at]
            at = fail[at]
            if at < 0:
                return 0
        return n

    def counts(self, words: list[bytes]) -> np.ndarray:
        known = self._known
        if len(known) > CACHE_WORDS:
            known.clear()
        new = set(words).difference(known)
        for w in new:
            known[w] = self.count(w.decode())
        out = np.fromiter(map(known.__getitem__, words), dtype=np.int64, count=len(words))
        for w in new:
            if len(w) > LONG_WORD:  # so that the memory of words is bounded in bytes
                del known[w]
        return out


def automaton(path: str) -> LongestMatch:
    """From a SentencePiece model's pieces: those with the word mark start words."""
    if path not in _AUTOMATA:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        _AUTOMATA[path] = LongestMatch([p[1:] for p in pieces if p[0] == MARK and len(p) > 1 and MARK not in p[1:]], [p for p in pieces if MARK not in p])
    return _AUTOMATA[path]


def count_tokens(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_tokens, n_unknown for every row, over the whole text.

    Words are what ASCII white space separates. A word that the greedy pieces don't
    cover counts as one unknown token. Null and empty texts have none; a null id stays
    null; very long texts and words are read whole; repeated rows are counted each; an
    empty table gives an empty table; other columns are not read. Texts stay in the task
    that reads them.
    """

    def count(batches: Batches) -> Batches:
        a = automaton(model)
        for batch in batches:
            n_words, n_tokens, n_unknown = [], [], []
            for data in utf8(batch):
                counts = a.counts(data.split())
                unknown = int((counts == 0).sum())
                n_words.append(len(counts))
                n_unknown.append(unknown)
                n_tokens.append(int(counts.sum()) + unknown)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, type=pa.int64()) for x in (n_words, n_tokens, n_unknown))], names=["doc_id", "n_words", "n_tokens", "n_unknown"])

    kept = id_and_text(docs, id_col, text_col)
    return kept.mapInArrow(count, "doc_id bigint, n_words bigint, n_tokens bigint, n_unknown bigint")
