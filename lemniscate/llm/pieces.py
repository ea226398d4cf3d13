"""SentencePiece encoding and decoding by an Aho-Corasick automaton and one Viterbi pass.

The automaton holds all pieces of a model.  A text is read once; at every
position the automaton's outputs (the longest piece that ends there, and by
output links all shorter ones) relax the best score of the position.  Scores
are the model's; the sum over the pieces is maximal, ties go to the longer
last piece.  A character that no piece covers costs more than any piece and is
written as byte pieces.

Spaces become U+2581 and one is put in front.  No piece but a run of U+2581
holds it after another character, so texts fall into words that are segmented
on their own, and equal words of a task are looked up.

Cases: a null text is empty; an empty text has no ids; lone surrogates become
"?"; a literal U+2581 decodes as a space, as in the model's own library;
repeated rows come back repeated; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from typing import Any

import numpy as np
from pyspark.sql import DataFrame

MARK = "▁"
#: Words that a task's cache holds before it is emptied; a matter of memory only.
CACHE = 250_000


class PieceCodec:
    def __init__(self, path: str) -> None:
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.surface: list[bytes] = []
        self.byte: list[int] = [0] * 256
        self.scores: dict[str, int] = {}
        auto = ahocorasick.Automaton()
        least = 0.0
        for i in range(sp.get_piece_size()):
            piece, score = sp.id_to_piece(i), sp.get_score(i)
            if sp.is_control(i) or sp.is_unknown(i):
                self.surface.append(b"")
            elif sp.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
                self.surface.append(bytes([int(piece[3:5], 16)]))
            else:
                self.surface.append(piece.replace(MARK, " ").encode())
                auto.add_word(piece, (i, len(piece), score))
                least = min(least, score)
        auto.make_automaton()
        self.auto = auto
        self.unknown = least - 10
        self.cache: dict[str, bytes] = {}

    def segment(self, word: str) -> list[int]:
        """Ids of a normalised word: Viterbi over the automaton's outputs."""
        n = len(word)
        best = [0.0] + [float("-inf")] * n
        back: list[tuple[int, int]] = [(-1, 0)] * (n + 1)
        reached = 0

        def unknown(upto: int) -> None:
            # Positions are settled from the left; one that no piece reaches takes an unknown character.
            nonlocal reached
            while reached < upto:
                reached += 1
                if not single[reached - 1]:
                    cost = best[reached - 1] + self.unknown
                    if cost > best[reached]:
                        best[reached], back[reached] = cost, (-1, 1)

        found: list[list[tuple[int, int, float]]] = [[] for _ in range(n)]
        single = [False] * n
        for end, x in self.auto.iter(word):
            found[end].append(x)
            if x[1] == 1:
                single[end] = True
        for end in range(n):
            for i, length, score in found[end]:
                s = best[end + 1 - length] + score
                if s > best[end + 1]:
                    best[end + 1], back[end + 1] = s, (i, length)
            unknown(end + 1)
        ids: list[int] = []
        at = n
        while at:
            i, length = back[at]
            if i < 0:
                ids.extend(self.byte[b] for b in reversed(word[at - 1].encode("utf-8", "replace")))
            else:
                ids.append(i)
            at -= length
        ids.reverse()
        return ids

    def _look_up(self, word: str) -> bytes:
        out = np.array(self.segment(word), dtype="<u4").tobytes()
        if len(self.cache) >= CACHE:
            self.cache.clear()
        if len(word) <= 64:
            self.cache[word] = out
        return out

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit numbers."""
        if not text:
            return b""
        words = text.split(" ")
        if "" in words or MARK in text:
            units = re.findall(f"{MARK}+[^{MARK}]*", MARK + text.replace(" ", MARK))
        else:
            units = [MARK + w for w in words]
        get, look_up = self.cache.get, self._look_up
        return b"".join([get(w) or look_up(w) for w in units])

    def decode(self, ids: bytes) -> str:
        surface = self.surface
        return b"".join([surface[i] for i in memoryview(ids).cast("I")])[1:].decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str) -> PieceCodec:
    return PieceCodec(path)


def _clean(x: str | None) -> str:
    return (x or "").encode("utf-8", "replace").decode("utf-8")


def _encoded(path: str):
    def run(batches: Iterator[Any]) -> Iterator[Any]:
        import pyarrow as pa

        c = codec(path)
        for batch in batches:
            ids = [np.frombuffer(c.encode(_clean(x.as_py())), dtype="<u4").astype(np.int32) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return run


def _decoded(path: str):
    def run(batches: Iterator[Any]) -> Iterator[Any]:
        import pyarrow as pa

        c = codec(path)
        for batch in batches:
            texts = [c.decode(np.array(x.as_py() or [], dtype="<u4").tobytes()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return run


def _digest(path: str):
    def run(batches: Iterator[Any]) -> Iterator[Any]:
        import pyarrow as pa

        c = codec(path)
        for batch in batches:
            n, crc, same = [], [], []
            for x in batch.column(1):
                text = _clean(x.as_py())
                ids = c.encode(text)
                n.append(len(ids) // 4)
                crc.append(zlib.crc32(ids))
                same.append(c.decode(ids) == text.replace(MARK, " "))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(same, pa.bool_())],
                names=["doc_id", "n_ids", "ids_crc32", "round_trip"],
            )

    return run


def _model(path: str | None) -> str:
    import public_tokenizers

    return path or public_tokenizers.path("piece_bpe_32k.model")


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids (array of int)."""
    return docs.select("doc_id", "text").mapInArrow(_encoded(_model(path)), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, text."""
    return encoded.select("doc_id", "ids").mapInArrow(_decoded(_model(path)), "doc_id long, text string")


def digest(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Encodes and decodes every text: doc_id, n_ids, ids_crc32 (little-endian unsigned 32-bit ids), round_trip."""
    return docs.select("doc_id", "text").mapInArrow(_digest(_model(path)), "doc_id long, n_ids long, ids_crc32 long, round_trip boolean")
