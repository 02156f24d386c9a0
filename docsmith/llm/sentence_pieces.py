"""Operator 7, SentencePiece encoding and decoding by an Aho-Corasick Viterbi.

The encoding of a text is the sequence of pieces with the greatest sum of scores, as in
the library's unigram models; a character without a piece of its own becomes byte pieces.
An Aho-Corasick automaton over all pieces reads each text once.  At a character's end
the output links give every piece that ends there, longest first, and each relaxes the
best score of that position; the first best stays, so of equal paths the one with the
longer last piece wins.

No piece goes on with a blank after something else, so a blank after another character is
a piece boundary in every encoding, and the stretches between such boundaries (words) can be
searched on their own.  The distinct words of a slice (by hash, then by their bytes) advance together, one byte a
step; long words go by themselves.  One pass over the table, no shuffle.

Edge cases: a null or empty text has no pieces; U+2581, the vocabulary's mark for a blank,
counts as a blank and comes back as one; ids that stand for nothing (begin, end) decode to
nothing, the unknown id to U+2047 between blanks; byte pieces that are no UTF-8 decode to U+FFFD; an
empty table gives an empty table.  Columns other than id and text are not carried over.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import flat_texts, ragged, release, slices
from .suffix_dedup import LETTERS, mix, powers

MARK = "▁".encode()
UNKNOWN_PENALTY = 10.0


class Spelling:
    """What the ids of a model file stand for; a blank is the byte 32."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.byte_ids = np.full(256, -1, np.int64)
        spelling: list[bytes] = []
        for i in range(model.get_piece_size()):
            name = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(name[3:5], 16)] = i
                spelling.append(bytes([int(name[3:5], 16)]))
            elif model.is_unknown(i):
                spelling.append(" ⁇ ".encode())
            elif model.is_control(i) or model.is_unused(i):
                spelling.append(b"")
            else:
                spelling.append(name.encode().replace(MARK, b" "))
        if (self.byte_ids < 0).any():
            raise ValueError("the model has no byte pieces to fall back to")
        self.spelling = np.frombuffer(b"".join(spelling), np.uint8)
        self.spelled = np.fromiter(map(len, spelling), np.int64, len(spelling))
        self.spelling_at = np.cumsum(self.spelled) - self.spelled

    def decode(self, ids: np.ndarray, at: np.ndarray) -> list[str]:
        """The texts of ids[at[i]:at[i + 1]], without the blank that starts them."""
        size = self.spelled[ids]
        raw = self.spelling[ragged(self.spelling_at[ids], size)].tobytes()
        ends = np.concatenate([[0], np.cumsum(size)])[at]
        out = []
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
            out.append(raw[a + (raw[a : a + 1] == b" " and b > a) : b].decode(errors="replace"))
        return out


class Automaton(Spelling):
    """The pieces of a model file, as an automaton over bytes."""

    def __init__(self, path: str):
        super().__init__(path)
        model = self.model
        child: dict[tuple[int, int], int] = {}
        depth, piece, score = [0], [-1], [0.0]
        edges: list[tuple[int, int, int]] = []
        worst = 0.0
        for i in range(model.get_piece_size()):
            if model.is_byte(i) or model.is_control(i) or model.is_unused(i) or model.is_unknown(i):
                continue
            word = model.id_to_piece(i).encode().replace(MARK, b" ")
            if b" " in word.lstrip(b" "):
                raise ValueError(f"piece {i} goes on after a blank: words cannot be searched on their own")
            worst = min(worst, model.get_score(i))
            node = 0
            for b in word:
                to = child.get((node, b))
                if to is None:
                    to = child[node, b] = len(depth)
                    depth.append(depth[node] + 1)
                    piece.append(-1)
                    score.append(0.0)
                    edges.append((node, b, to))
                node = to
            piece[node], score[node] = i, model.get_score(i)
        self.unknown_score = worst - UNKNOWN_PENALTY
        self.piece, self.score, self.depth = np.array(piece, np.int64), np.array(score), np.array(depth, np.int64)
        self._link(np.array(edges, np.int64))

    def _link(self, edges: np.ndarray) -> None:
        """Failure transitions, level by level, and output links: where the next shorter piece that ends here is."""
        nodes = len(self.piece)
        self.step = np.zeros((nodes, 256), np.int32)
        fail = np.zeros(nodes, np.int64)
        self.out, self.next_out = np.zeros(nodes, np.int64), np.zeros(nodes, np.int64)
        level = self.depth[edges[:, 2]]
        for d in range(1, int(self.depth.max()) + 1):
            parent, byte, node = edges[level == d].T
            fail[node] = self.step[fail[parent], byte] if d > 1 else 0
            # a node's own edges replace those of its failure node, one level on
            self.step[parent, byte] = node
            self.step[node] = self.step[fail[node]]
            self.next_out[node] = self.out[fail[node]]
            self.out[node] = np.where(self.piece[node] >= 0, node, self.next_out[node])

    def search(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words data[start:start + size], one word after the other, and how many each has.

        Words come longest first.
        """
        words, longest = len(start), int(size[0])
        best = np.full((longest + 1, words), -np.inf)
        best[0] = 0
        back, back_size = np.zeros((longest + 1, words), np.int32), np.ones((longest + 1, words), np.int32)
        state = np.zeros(words, np.int64)
        width = np.zeros(words, np.int64)
        for i in range(longest):
            on = int(np.searchsorted(-size, -i, "left"))
            state, width = state[:on], width[:on]
            byte = data[start[:on] + i]
            # bytes of the character so far; and whether it ends here
            width = np.where((byte & 0xC0) == 0x80, width + 1, 1)
            follow = data[np.minimum(start[:on] + i + 1, len(data) - 1)]
            whole = (i + 1 == size[:on]) | ((follow & 0xC0) != 0x80)
            state = self.step[state, byte].astype(np.int64)
            top, at = best[i + 1], self.out[state]
            own = np.zeros(on, bool)
            lane = np.flatnonzero(at)
            at = at[lane]
            while len(lane):
                length = self.depth[at]
                score = best[i + 1 - length, lane] + self.score[at]
                better = score > top[lane]
                won = lane[better]
                top[won], back[i + 1, won], back_size[i + 1, won] = score[better], self.piece[at[better]], length[better]
                own[lane[length == width[lane]]] = True
                at = self.next_out[at]
                more = at > 0
                lane, at = lane[more], at[more]
            lost = np.flatnonzero(whole & ~own)
            if len(lost):
                score = best[i + 1 - width[lost], lost] + self.unknown_score
                better = score > top[lost]
                lost, score = lost[better], score[better]
                top[lost], back[i + 1, lost], back_size[i + 1, lost] = score, -1, width[lost]
        chosen = np.full((words, longest + 1), -1, np.int32)
        lane, at = np.arange(words), size.astype(np.int64).copy()
        while len(lane):
            piece, length = back[at, lane], back_size[at, lane]
            known = piece >= 0
            chosen[lane[known], at[known]] = piece[known]
            odd = np.flatnonzero(~known)
            for k in range(int(length[odd].max(initial=0))):
                some = odd[length[odd] > k]
                chosen[lane[some], at[some] - k] = self.byte_ids[data[start[lane[some]] + at[some] - k - 1]]
            at = at - length
            on = at > 0
            lane, at = lane[on], at[on]
        ids = chosen.ravel()
        return ids[ids >= 0], (chosen >= 0).sum(axis=1)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and the offsets between texts."""
        data, at = flat_texts(column)
        raw = data.tobytes()
        if MARK in raw:
            parts = [raw[a:b].replace(MARK, b" ") for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            at = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
            data = np.frombuffer(b"".join(parts), np.uint8)
        some = np.diff(at) > 0
        # every text starts with a blank
        data = np.insert(data, at[:-1][some], 32)
        at = at + np.concatenate([[0], np.cumsum(some)])
        if not len(data):
            return np.zeros(0, np.int32), at
        opens = np.zeros(len(data), bool)
        opens[1:] = (data[1:] == 32) & (data[:-1] != 32)
        opens[at[:-1][some]] = True
        start = np.flatnonzero(opens)
        size = np.diff(np.concatenate([start, [len(data)]]))
        up, down = powers(len(data) + 1)
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(LETTERS[data] * up[: len(data)], out=total[1:])
        word = mix((total[start + size] - total[start]) * down[start] + size.astype(np.uint64))
        _, first, inverse = np.unique(word, return_index=True, return_inverse=True)
        first, inverse = told_apart(data, start, size, first, inverse)
        order = np.argsort(-size[first], kind="stable")
        counts, flat = np.zeros(len(first), np.int64), []
        a = 0
        while a < len(order):
            # words of similar length share a table of bounded size
            longest = int(size[first[order[a]]])
            b = int(np.searchsorted(-size[first[order]], -(longest // 2), "right")) if longest > 8 else len(order)
            b = min(max(a + 1, b), a + max(1, (1 << 22) // (longest + 1)))
            part = order[a:b]
            ids, n = self.search(data, start[first[part]], size[first[part]])
            counts[part] = n
            flat.append(ids)
            a = b
        flat = np.concatenate(flat)
        # where the ids of each distinct word are
        place = np.zeros(len(first), np.int64)
        place[order] = np.cumsum(counts[order]) - counts[order]
        n = counts[inverse]
        ids = flat[ragged(place[inverse], n)]
        ends = np.concatenate([[0], np.cumsum(n)])
        return ids, ends[np.searchsorted(start, at, "left")]


def told_apart(data: np.ndarray, start: np.ndarray, size: np.ndarray, first: np.ndarray, inverse: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Groups of words (their first words, and the group of each word) as their bytes have it: a word that only shares its group's hash gets one of its own."""
    like = first[inverse]
    same = size == size[like]
    look = np.flatnonzero(same & (like != np.arange(len(start))))
    wrong = [np.flatnonzero(~same)]
    a = 0
    total = np.cumsum(size[look])
    while a < len(look):
        # a bounded stretch of bytes at a time
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + (1 << 20), "right")))
        part = look[a:b]
        differ = data[ragged(start[part], size[part])] != data[ragged(start[like[part]], size[part])]
        if differ.any():
            wrong.append(np.unique(np.repeat(part, size[part])[differ]))
        a = b
    wrong = np.concatenate(wrong)
    if not len(wrong):
        return first, inverse
    inverse, own, more = inverse.copy(), {}, []
    for k in wrong.tolist():
        spelled = data[start[k] : start[k] + size[k]].tobytes()
        if spelled not in own:
            own[spelled] = len(first) + len(more)
            more.append(k)
        inverse[k] = own[spelled]
    return np.concatenate([first, np.array(more, first.dtype)]), inverse


@lru_cache(maxsize=1)
def automaton(path: str) -> Automaton:
    return Automaton(path)


@lru_cache(maxsize=1)
def spelling(path: str) -> Spelling:
    return Spelling(path)


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, ids): the piece ids of each text, beside the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                ids, at = automaton(path).encode(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("text"), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32)))], names=["id", "text", "ids"])
        release()

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, text string, ids array<int>").withColumnsRenamed({"id": id_col, "text": text_col})


def decode(df: DataFrame, path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """The table with the text of its ids in another column; null ids give null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                batch = whole.slice(k, 256)
                column = batch.column(ids_col)
                size = np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
                texts = spelling(path).decode(column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(size)]))
                texts = [t if ok else None for t, ok in zip(texts, column.is_valid().to_pylist())]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, out_col])
        release()

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, f"{fields}, `{out_col}` string")
