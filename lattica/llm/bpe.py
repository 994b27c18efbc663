"""Byte-pair merging over a SentencePiece BPE vocabulary, by a heap of pairs and a linked list of symbols.

The vocabulary's pieces hold a white-space marker only in front, so no merge can cross from one marked
chunk to the next, nor a line break where no piece holds one.  A text is therefore cut into chunks, and a
table keeps what a chunk came to (one table for each worker process, emptied when it is full).
"""

from __future__ import annotations

import functools
import heapq
import re
from collections.abc import Callable

import numpy as np

MARK = "▁"
#: Chunks of each of a table's two generations, and the longest chunk that it holds.
TABLE_SIZE, TABLE_CHUNK = 250_000, 48


class PieceModel:
    """Pieces, scores and ids of a SentencePiece BPE model file."""

    def __init__(self, path: str):
        import sentencepiece

        self.processor = p = sentencepiece.SentencePieceProcessor(model_file=path)
        kinds = [(p.is_control(i) or p.is_unknown(i), p.is_byte(i), p.is_unused(i)) for i in range(p.get_piece_size())]
        if any(k[2] for k in kinds):
            raise ValueError("a model with unused pieces is not supported")
        normal = [i for i, k in enumerate(kinds) if not any(k)]
        self.ids = {p.id_to_piece(i): i for i in normal}
        self.rank = {p.id_to_piece(i): -p.get_score(i) for i in normal if len(p.id_to_piece(i)) > 1}
        first = next((i for i, k in enumerate(kinds) if k[1]), None)
        if first is None:
            raise ValueError("the model has no byte pieces")
        self.first_byte, self.bos, self.eos = first, p.bos_id(), p.eos_id()
        if any(re.search(f"[^{MARK}]{MARK}", x) for x in self.ids):
            raise ValueError("a piece crosses a white-space marker")
        self.line_alone = not any("\n" in x for x in self.rank)

    def merge(self, chunk: str) -> tuple[list[str], int]:
        """The symbols left when no adjacent pair is a piece, and how many merges were made.

        The pair of the lowest rank goes first, the leftmost among equals.
        """
        symbols, n, rank = list(chunk), len(chunk), self.rank
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(r, i, 2) for i in range(n - 1) if (r := rank.get(symbols[i] + symbols[i + 1])) is not None]
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, i, size = heapq.heappop(heap)
            left, j = symbols[i], after[i]
            if not left or j < 0 or len(left) + len(symbols[j]) != size:
                continue  # one of the two has since been merged
            symbols[i] = left = left + symbols[j]
            symbols[j] = ""
            after[i] = k = after[j]
            merges += 1
            if k >= 0:
                before[k] = i
                if (r := rank.get(left + symbols[k])) is not None:
                    heapq.heappush(heap, (r, i, size + len(symbols[k])))
            if (h := before[i]) >= 0 and (r := rank.get(symbols[h] + left)) is not None:
                heapq.heappush(heap, (r, h, size + len(symbols[h])))
        return [s for s in symbols if s], merges

    def parts(self, key: str) -> list[str]:
        """The parts of a chunk that merge by themselves. The key is the chunk without its first marker."""
        chunk = MARK + key.replace(" ", MARK)
        return [x for x in re.split("(\n)", chunk) if x] if self.line_alone and "\n" in chunk else [chunk]

    def count(self, key: str) -> int:
        """Tokens of a chunk: its first symbols (bytes, for characters without a piece) less the merges."""
        total = 0
        for part in self.parts(key):
            first = sum(1 if c in self.ids else len(c.encode()) for c in part)
            total += first - self.merge(part)[1]
        return total

    def encode(self, key: str) -> bytes:
        """Ids of a chunk, as little-endian 32-bit integers."""
        out: list[int] = []
        for part in self.parts(key):
            for s in self.merge(part)[0]:
                if (i := self.ids.get(s)) is not None:
                    out.append(i)
                else:
                    out += [self.first_byte + b for b in s.encode()]
        return np.array(out, "<u4").tobytes()


class ChunkTable(dict):
    """What each distinct chunk comes to; filled as chunks are met.

    When it is full it becomes the older generation, from which chunks that are met again come back.
    """

    def __init__(self, fn: Callable[[str], object]):
        super().__init__()
        self.fn, self.older = fn, {}

    def __missing__(self, key: str):
        value = self.older.get(key)
        if value is None:
            value = self.fn(key)
        if len(key) <= TABLE_CHUNK:
            if len(self) >= TABLE_SIZE:
                self.older = dict(self)
                self.clear()
            self[key] = value
        return value


def chunks(text: str) -> list[str]:
    """Keys of a text's chunks in order: each chunk starts with a run of markers, the first of which is left off.

    A marker stands for a space, and one is put before the text.  The empty text has no chunk.
    """
    if not text:
        return []
    text = text.replace(MARK, " ")
    if "  " in text or text[0] == " " or text[-1] == " ":
        return [x[1:] for x in re.findall(" +[^ ]*", " " + text)]
    return text.split(" ")


def model_path(model: str | None) -> str:
    """The file of `model`: a path, or None for the 32k BPE model of the installed public tokenizers."""
    if model:
        return model
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@functools.cache
def load(path: str) -> PieceModel:
    return PieceModel(path)


@functools.cache
def table_of(path: str, what: str) -> ChunkTable:
    """The worker's table; `what` is "count" or "encode"."""
    return ChunkTable(getattr(load(path), what))
