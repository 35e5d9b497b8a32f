"""SentencePiece encoding and decoding by shared-prefix Viterbi.

A text is cut into marked words (a word with the spaces before it, each written as the
mark), which no piece crosses. The distinct words of a batch are sorted, which visits
their trie depth-first: a word keeps the forward state of the prefix it shares with the
word before it, and only the rest is computed.

The forward state at a position is the best segmentation of the prefix that ends there;
an automaton over the pieces gives those that end at each position, and its state is
part of what words share. For unigram models the best is the highest sum of piece scores.
A BPE model has merge ranks instead of scores that add up, so there is no forward score:
the best segmentation is the one that the merges give. Its last piece is the longest one that is
compatible with the last piece of what is before it (two pieces are compatible if
merging their joint characters gives just these two), so the state is again a backward
pointer for each position and the ids equal the library's. Characters without a piece
become byte pieces.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkveil.llm._common import Batches, id_and_text, utf8

MARK = "▁"
CACHE_WORDS = 120_000  # words of a generation; a worker remembers the ids of two
MARKS = ".,;:!?%)"  # what may be split off a word's end
LONG_WORD = 64  # characters over which a word isn't remembered
CACHE_PAIRS = 200_000  # pairs of pieces of a generation whose compatibility is remembered

_CODECS: dict[tuple[str, str], Codec] = {}


class Codec:
    """kind: "bpe" or "unigram", as the model was trained; the model must not change characters
    (identity normalisation) and must put a mark before the text."""

    _nodes = _names = None  # built at first use
    _fits: dict[int, bool] = {}
    _older_fits: dict[int, bool] = {}

    def __init__(self, path: str, kind: str = "bpe"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        plain = [i for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.kind, self.unknown = kind, model.unk_id()
        self.piece = {model.id_to_piece(i): i for i in plain}
        self.score = {model.id_to_piece(i): model.get_score(i) for i in plain}
        self.byte = {int(model.id_to_piece(i)[3:5], 16): i for i in range(size) if model.is_byte(i)}
        self.bytes_of = [b""] * size
        for p, i in self.piece.items():
            self.bytes_of[i] = p.replace(MARK, " ").encode()
        for b, i in self.byte.items():
            self.bytes_of[i] = bytes([b])
        if 0 <= self.unknown < size:
            self.bytes_of[self.unknown] = " ⁇ ".encode()
        inside = any(MARK in p.lstrip(MARK) for p in self.piece)
        breaks = any("\n" in p for p in self.piece)
        if inside:
            raise ValueError("a piece of this model crosses words")
        self.marks = "".join(m for m in MARKS if not any(y == m and x.isalpha() for p in self.piece for x, y in zip(p, p[1:], strict=False)))
        self.words = re.compile(" *[^ ]+| +" if breaks else " *[^ \n]+| +|\n").findall
        self._known: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}
        self._fits: dict[int, bool] = {}
        self._older_fits: dict[int, bool] = {}

    def merged(self, text: str) -> list[str]:
        """Pieces after all merges, highest score first, leftmost of equal ones."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _fit(self, key: int) -> bool:
        """Whether the merges of two pieces' joint characters give just these two; key holds both ids."""
        fits = self._older_fits.get(key)
        if fits is None:
            left, right = self._piece_of(key >> 32), self._piece_of(key & 0xFFFFFFFF)
            fits = self.merged(left + right) == [left, right]
        if len(self._fits) > CACHE_PAIRS:
            self._older_fits = dict(self._fits)
            self._fits.clear()
        self._fits[key] = fits
        return fits

    def _piece_of(self, i: int) -> str:
        if self._names is None:
            self._names = {i: p for p, i in self.piece.items()}
        return self._names[i]

    def _automaton(self) -> tuple[list[dict[str, int]], list[int], list[tuple[tuple[int, int], ...]]]:
        """Trie of the pieces with suffix links: children, links, and what ends at each node as (length, id), longest first."""
        if self._nodes is None:
            child, own = [{}], {}
            for p, i in self.piece.items():
                at = 0
                for c in p:
                    if c not in child[at]:
                        child[at][c] = len(child)
                        child.append({})
                    at = child[at][c]
                own[at] = (len(p), i)
            link, ending = [0] * len(child), [()] * len(child)
            layer = [0]
            while layer:
                below = []
                for v in layer:
                    for c, u in child[v].items():
                        z = link[v]
                        while z and c not in child[z]:
                            z = link[z]
                        link[u] = child[z][c] if v and c in child[z] else 0
                        ending[u] = ((own[u],) if u in own else ()) + ending[link[u]]
                        below.append(u)
                layer = below
            self._nodes = child, link, ending
        return self._nodes

    def _forward(self, words: Iterable[str]) -> Iterator[tuple[str, list[int], bool]]:
        """(word, piece ids, whether all are pieces) in the order of the words' trie; a character without a piece is -1."""
        child, link, ending = self._automaton()
        fits, fit, bpe = self._fits.get, self._fit, self.kind == "bpe"
        score = None if bpe else {i: self.score[p] for p, i in self.piece.items()}
        lowest = None if bpe else min(score.values()) - 10  # of a character without a piece
        before = ""
        node, last, size, total = [0], [-1], [0], [0.0]  # of each prefix: automaton node, last piece, its length, score
        for word in sorted(set(words)):
            shared = 0
            for a, b in zip(before, word):  # noqa: B905
                if a != b:
                    break
                shared += 1
            del node[shared + 1 :], last[shared + 1 :], size[shared + 1 :], total[shared + 1 :]
            whole, at = True, node[shared]
            for j in range(shared, len(word)):
                c = word[j]
                while (to := child[at].get(c)) is None and at:
                    at = link[at]
                at = to or 0
                found, long, best = -1, 1, None
                if bpe:
                    for n, p in ending[at]:
                        i = j + 1 - n
                        left = last[i]
                        if left < 0:
                            found, long = p, n
                            break
                        key = left << 32 | p  # a number holds no text alive
                        ok = fits(key)
                        if fit(key) if ok is None else ok:
                            found, long = p, n
                            break
                else:
                    for n, p in ending[at]:
                        s = total[j + 1 - n] + score[p]
                        if best is None or s > best:
                            found, long, best = p, n, s
                    if long > 1 or found < 0:  # the character alone, if it is no piece, is an unknown one
                        if not any(n == 1 for n, _ in ending[at]) and (best is None or total[j] + lowest > best):
                            found, long, best = -1, 1, total[j] + lowest
                    total.append(best)
                node.append(at)
                last.append(found)
                size.append(long)
            ids, j = [], len(word)
            while j:
                ids.append(last[j])
                whole &= last[j] >= 0
                j -= size[j]
            ids.reverse()
            yield word, ids, whole
            before = word

    def segment(self, words: Iterable[str]) -> dict[str, list[str]]:
        """Pieces (or single unknown characters) of each distinct word."""
        out = {}
        for word, ids, _ in self._forward(words):
            parts, at = [], 0
            for i in ids:
                parts.append(word[at] if i < 0 else self._piece_of(i))
                at += len(parts[-1])
            out[word] = parts
        return out

    def _with_bytes(self, word: str, pieces: list[int]) -> list[int]:
        """The ids with byte pieces (or the unknown piece) for characters that have none."""
        ids: list[int] = []
        at = 0
        for i in pieces:
            if i >= 0:
                ids.append(i)
                at += len(self._piece_of(i))
                continue
            if self.byte:
                ids += [self.byte[b] for b in word[at].encode()]
            elif not ids or ids[-1] != self.unknown:  # a run of unknown characters is one unknown piece
                ids.append(self.unknown)
            at += 1
        return ids

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        cut = [self.words(" " + t.replace(MARK, " ")) if t else [] for t in texts]
        if len(self._known) > CACHE_WORDS:
            self._older, self._known = self._known, {}
        known, old = self._known, self._older
        new = {w for c in cut for w in c if w not in known}
        ends, whole = [], {}
        for w in new:
            ids = old.get(w)
            if ids is not None:
                known[w] = ids
                continue
            stem = w.rstrip(self.marks)
            if len(stem) == len(w) or not stem[-1:].isalpha():
                whole[w.replace(" ", MARK)] = w
                continue
            # no piece holds a letter and a mark after it, so the word's pieces end with the letter
            ends.append((w, stem, w[len(stem) :]))
            for x in (stem, w[len(stem) :]):
                if x not in known:
                    if x in old:
                        known[x] = old[x]
                    else:
                        whole[x.replace(" ", MARK)] = x
        for m, ids, plain in self._forward(whole):
            known[whole[m]] = array("i", ids if plain else self._with_bytes(m, ids)).tobytes()
        for w, stem, mark in ends:
            known[w] = known[stem] + known[mark]
        out = [b"".join(map(known.__getitem__, c)) for c in cut]
        for w in new:
            if len(w) > LONG_WORD:  # so that the memory of words is bounded in bytes
                for x in (w, w.rstrip(self.marks)):
                    known.pop(x, None)
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids; the mark before the text is taken away, bytes that are no UTF-8 become U+FFFD."""
        data = b"".join(map(self.bytes_of.__getitem__, ids))
        return (data[1:] if data[:1] == b" " else data).decode(errors="replace")


def codec(path: str, kind: str = "bpe") -> Codec:
    if (path, kind) not in _CODECS:
        _CODECS[path, kind] = Codec(path, kind)
    return _CODECS[path, kind]


def _lists(encoded: list[bytes]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(e) // 4 for e in encoded])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(encoded), "<i4")))


def encode_pieces(docs: DataFrame, model: str, kind: str = "bpe", text_col: str = "text", into: str = "piece_ids") -> DataFrame:
    """All input columns and rows plus `into` array<int>: the ids of the whole text.

    Null and empty texts have no ids; repeated rows are encoded each; an input column
    called `into` is replaced. Texts stay in the task that reads them.
    """

    def encode(batches: Batches) -> Batches:
        c = codec(model, kind)
        for batch in batches:
            texts = [(d or b"").decode() for d in utf8(batch, text_col)]
            ids = [e for k in range(0, len(texts), 200) for e in c.encode(texts[k : k + 200])]
            yield pa.RecordBatch.from_arrays([*batch.columns, _lists(ids)], names=[*batch.schema.names, into])

    kept = docs.drop(into)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return kept.mapInArrow(encode, f"{schema}, `{into}` array<int>")


def decode_pieces(df: DataFrame, model: str, kind: str = "bpe", ids_col: str = "piece_ids", into: str = "decoded") -> DataFrame:
    """All input columns and rows plus `into` string: the text of the ids; null ids give null."""

    def decode(batches: Batches) -> Batches:
        c = codec(model, kind)
        for batch in batches:
            ids = batch.column(ids_col)
            flat, texts = ids.values.to_numpy(zero_copy_only=False), []
            at = ids.offsets.to_numpy()
            for k in range(batch.num_rows):
                texts.append(None if not ids[k].is_valid else c.decode(flat[at[k] : at[k + 1]].tolist()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, type=pa.string())], names=[*batch.schema.names, into])

    kept = df.drop(into)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return kept.mapInArrow(decode, f"{schema}, `{into}` string")


def round_trips(docs: DataFrame, model: str, kind: str = "bpe", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_pieces, piece_ids, ids_crc32 and round_trip, whether the decoded ids give the text again.

    Null texts count as empty, and empty texts have no pieces; a null id stays null; very
    long texts are encoded whole; repeated rows are encoded each; an empty table gives an
    empty table; other columns are not read. A text that holds the word mark itself
    doesn't come back, as it reads as a blank.
    """

    def both(batches: Batches) -> Batches:
        c = codec(model, kind)
        for batch in batches:
            for k in range(0, batch.num_rows, 200):
                part = batch.slice(k, 200)
                texts = [d.decode() for d in utf8(part)]
                ids = c.encode(texts)
                same = [c.decode(np.frombuffer(e, "<i4").tolist()) == t for e, t in zip(ids, texts, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([len(e) // 4 for e in ids], type=pa.int64()), _lists(ids), pa.array(map(zlib.crc32, ids), type=pa.int64()), pa.array(same)],
                    names=["doc_id", "n_pieces", "piece_ids", "ids_crc32", "round_trip"],
                )

    kept = id_and_text(docs, id_col, text_col)
    return kept.mapInArrow(both, "doc_id bigint, n_pieces bigint, piece_ids array<int>, ids_crc32 bigint, round_trip boolean")
