"""Byte-pair encoding compiled to a deterministic transducer, run in lockstep.

Inside one pretoken, a sequence of tokens is the encoding exactly when every
adjacent pair of its tokens stays unmerged.  Reading symbols from the left, the
machine keeps, for each place where the token being read may have begun, the
token before that place, the node of the token trie reached since, and how many
fewer tokens there were.  That set of hypotheses is the state.  It depends on
recent symbols only, so equal states meet again; a transition is worked out once,
in Python, and is a table look-up from then on.  A transition is annotated
with the count of tokens it emits (which may be negative: a token can swallow
those before it), a state with the last token of what has been read.

Texts are cut into chunks.  All chunks advance together, one look-up a symbol.
The map of a chunk from entry state to exit state and count is constant from the
first pretoken start in it on; that part runs at once for every chunk.
The bytes before it run afterwards, from the exit state to which the chunks
before compose.  Maps of chunks inside one long pretoken are tabulated for the states that occur and
composed by a parallel prefix scan, so k chunks take about log k rounds.
"""

from __future__ import annotations

import json
from array import array

import numpy as np

CHUNK = 256
#: The table is dropped and grown anew beyond this many states, which bounds a worker's memory.
MAX_STATES = 160_000
ROOT, IDLE = 0, 1


def byte_alphabet() -> dict[str, int]:
    """The byte for each printable stand-in in byte-level vocabularies."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class Transducer:
    """The machine for the merges of a ``tokenizers`` byte-level BPE file.

    A symbol is a byte; with an end-of-word suffix the last byte of a pretoken
    is the symbol 256 + byte.
    """

    def __init__(self, path: str, max_states: int = MAX_STATES):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, suffix, self.max_states = model["vocab"], model.get("end_of_word_suffix") or "", max_states
        self.rank: dict[tuple[int, int], int] = {}
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        self.made: dict[int, int] = {}
        words: dict[int, tuple[int, ...]] = {}
        for char, byte in byte_alphabet().items():
            if char in vocab:
                words[vocab[char]] = (byte,)
            if suffix and char + suffix in vocab:
                words[vocab[char + suffix]] = (256 + byte,)
        for rank, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            a, b, t = vocab[a], vocab[b], vocab[a + b]
            self.rank.setdefault((a, b), rank)
            if t not in self.made:
                self.left[t], self.right[t], self.made[t], words[t] = a, b, rank, words[a] + words[b]
        self.pairs: dict[int, bool] = {}
        self.spines: dict[tuple[bool, int], list[tuple[int, float]]] = {}
        self.child: dict[int, int] = {}
        self.token_at = [-1]
        for t, word in words.items():
            node = 0
            for s in word:
                node = self.child.setdefault(node << 9 | s, len(self.token_at))
                if node == len(self.token_at):
                    self.token_at.append(-1)
            self.token_at[node] = t
        self.length = np.ones(max(words) + 2, np.int64)
        self.length[list(words)] = [len(w) for w in words.values()]
        self.reset()

    def spine(self, t: int, right: bool) -> list[tuple[int, float]]:
        """The symbols on that edge of the token while it is built, each with the merge that uses it up."""
        known = self.spines.get((right, t))
        if known is None:
            side, token, known, gone = self.right if right else self.left, t, [], float("inf")
            while True:
                known.append((token, gone))
                if token not in self.made:
                    break
                gone, token = self.made[token], side[token]
            self.spines[right, t] = known
        return known

    def apart(self, t: int, u: int) -> bool:
        """Whether token u may follow token t: no merge ever takes a symbol of either side."""
        known = self.pairs.get(t << 20 | u)
        if known is None:
            known = True
            for a, gone_a in self.spine(t, True):
                for b, gone_b in self.spine(u, False):
                    merge = self.rank.get((a, b))
                    # of equal merges the left one comes first
                    if merge is not None and merge < gone_a and merge <= gone_b:
                        known = False
            if len(self.pairs) > 1_000_000:
                self.pairs.clear()
            self.pairs[t << 20 | u] = known
        return known

    def reset(self) -> None:
        """Forget the states."""
        # a state is three numbers for each hypothesis: token before, node, tokens behind
        self.hypotheses: list[bytes] = [array("q", (-1, 0, 0)).tobytes(), b""]
        self.number = {h: i for i, h in enumerate(self.hypotheses)}
        self.column = np.full(512, -1, np.int32)
        self.columns = 0
        self.symbol_of: list[int] = []
        # the table holds the state's number and 1, or 0 where a transition is not compiled: pages nobody wrote cost nothing
        self.table = np.zeros((self.max_states + (1 << 17), 128), np.int32)
        self.emits = np.zeros(self.table.shape, np.int8)
        self.last = np.full(len(self.table), -1, np.int32)
        self.table[IDLE] = IDLE + 1

    def _grow(self) -> None:
        rows, width = self.table.shape
        if self.columns > width:
            self.table = np.pad(self.table, ((0, 0), (0, width)))
            self.emits = np.pad(self.emits, ((0, 0), (0, width)))
            self.table[IDLE] = IDLE + 1
        if len(self.hypotheses) >= rows:
            self.table = np.pad(self.table, ((0, rows // 2), (0, 0)))
            self.emits = np.pad(self.emits, ((0, rows // 2), (0, 0)))
            self.last = np.pad(self.last, (0, rows // 2), constant_values=-1)

    def _compile(self, state: int, symbol: int) -> None:
        found, won, emitted = array("q"), -1, 0
        now = array("q")
        now.frombytes(self.hypotheses[state])
        for i in range(0, len(now), 3):
            before, behind = now[i], now[i + 2]
            node = self.child.get(now[i + 1] << 9 | symbol)
            if node is None:
                continue
            found.extend((before, node, behind))
            token = self.token_at[node]
            if won < 0 and token >= 0 and (before < 0 or self.apart(before, token)):
                won, emitted = token, behind + 1
        for i in range(2, len(found), 3):
            found[i] -= emitted
        found.extend((won, 0, 0))
        to = found.tobytes()
        number = self.number.get(to)
        if number is None:
            number = self.number[to] = len(self.hypotheses)
            self.hypotheses.append(to)
            self._grow()
            self.last[number] = won
        self.table[state, self.column[symbol]] = number + 1
        self.emits[state, self.column[symbol]] = emitted

    def _step(self, now: np.ndarray, columns: np.ndarray) -> np.ndarray:
        """The places of the transitions in the table."""
        at = now * self.table.shape[1] + columns
        missing = np.flatnonzero(self.table.ravel().take(at) == 0)
        if len(missing):
            symbol = self.symbol_of
            for key in np.unique(now[missing] << 9 | columns[missing]).tolist():
                self._compile(key >> 9, symbol[key & 511])
        return at

    def run(self, symbols: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The last token of the encoding of each pretoken up to each symbol, and the tokens each symbol emits.

        start marks the first symbol of every pretoken and holds at position 0.
        """
        n = len(symbols)
        if not n:
            return np.zeros(0, np.int32), np.zeros(0, np.int8)
        if len(self.hypotheses) > self.max_states:
            self.reset()
        for s in np.flatnonzero(np.bincount(symbols, minlength=512)[:512]).tolist():
            if self.column[s] < 0:
                self.column[s], self.columns = self.columns, self.columns + 1
                self.symbol_of.append(s)
                self._grow()
        lanes = -(-n // CHUNK)
        grid = np.zeros(lanes * CHUNK, np.int64)
        grid[:n] = self.column[symbols]
        grid[n:] = grid[n - 1]
        fresh = np.ones(lanes * CHUNK, bool)
        fresh[:n] = start
        grid, fresh = np.ascontiguousarray(grid.reshape(lanes, CHUNK).T), np.ascontiguousarray(fresh.reshape(lanes, CHUNK).T)
        state, emitted = np.empty((CHUNK, lanes), np.int32), np.empty((CHUNK, lanes), np.int8)
        now = np.full(lanes, IDLE, np.int64)
        for i in range(CHUNK):
            now[fresh[i]] = ROOT
            at = self._step(now, grid[i])
            emitted[i] = self.emits.ravel().take(at)
            state[i] = now = self.table.ravel().take(at).astype(np.int64) - 1
        open_lanes = np.flatnonzero(state[0] == IDLE)
        if len(open_lanes):
            entry = self._entries(grid, fresh, state)
            active, now = open_lanes, entry[open_lanes]
            for i in range(CHUNK):
                on = ~fresh[i, active]
                active, now = active[on], now[on]
                if not len(active):
                    break
                at = self._step(now, grid[i, active])
                emitted[i, active] = self.emits.ravel().take(at)
                state[i, active] = now = self.table.ravel().take(at).astype(np.int64) - 1
        return self.last[state.T.ravel()[:n]], emitted.T.ravel()[:n]

    def _entries(self, grid: np.ndarray, fresh: np.ndarray, state: np.ndarray) -> np.ndarray:
        """The state in which each chunk is entered, by a prefix scan over the chunks' maps.

        A chunk with a pretoken start leaves in one state whatever it is entered in.  The map of one without
        is tabulated for the states that its neighbours are found to leave in, beginning with a guess, for all chunks at
        once; a run ends where it meets the path of the guess, which is soon, as states
        forget.  Then maps are composed over 1, 2, 4, ... chunks.
        """
        lanes = grid.shape[1]
        entry = np.full(lanes, IDLE, np.int64)
        leaves = state[CHUNK - 1].astype(np.int64)
        entry[1:] = leaves[:-1]
        inner = np.flatnonzero(leaves == IDLE)
        if not len(inner):
            return entry
        is_inner = np.zeros(lanes + 1, bool)
        is_inner[inner] = True
        # the guess: as if a pretoken began with the chunk
        column = np.zeros(lanes, np.int64)
        column[inner] = np.arange(len(inner))
        guess = np.empty((CHUNK, len(inner)), np.int32)
        now = np.full(len(inner), ROOT, np.int64)
        for i in range(CHUNK):
            guess[i] = now = self.table.ravel().take(self._step(now, grid[i, inner])).astype(np.int64) - 1
        # the tabulated part of all maps, as sorted keys (chunk, state) and the states they lead to
        width = np.int64(1 << 32)
        keys, exits = inner * width + ROOT, now
        heads = inner[(inner > 0) & ~is_inner[inner - 1]]
        wanted = np.unique(np.concatenate([heads * width + entry[heads], (inner + 1)[is_inner[inner + 1]] * width + now[is_inner[inner + 1]]]))
        while True:
            wanted = wanted[~np.isin(wanted, keys)]
            if not len(wanted):
                break
            lane, now = wanted // width, wanted % width
            out, alive = np.empty(len(lane), np.int64), np.arange(len(lane))
            for i in range(CHUNK):
                now = self.table.ravel().take(self._step(now, grid[i, lane[alive]])).astype(np.int64) - 1
                met = now == guess[i, column[lane[alive]]]
                out[alive[met]] = guess[CHUNK - 1, column[lane[alive[met]]]]
                alive, now = alive[~met], now[~met]
                if not len(alive):
                    break
            out[alive] = now
            keys, exits = np.concatenate([keys, wanted]), np.concatenate([exits, out])
            follows = is_inner[lane + 1]
            wanted = np.unique((lane[follows] + 1) * width + out[follows])
        order = np.argsort(keys)
        keys, exits = keys[order], exits[order]
        lane = keys // width
        end = len(keys)
        # the pair that each pair leads to; the last of a stretch leads nowhere
        jump = np.append(np.where(is_inner[lane + 1], np.searchsorted(keys, (lane + 1) * width + exits), end), end)
        real = np.searchsorted(keys, heads * width + entry[heads])
        while True:
            more = jump[real]
            more = more[more < end]
            if not len(more):
                break
            real, jump = np.concatenate([real, more]), jump[jump]
        entry[lane[real]] = keys[real] % width
        after = lane[real] + 1
        on = after < lanes
        entry[after[on]] = exits[real][on]
        return entry

    def trace(self, last: np.ndarray, first: np.ndarray, final: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of the pretokens first..final (positions, inclusive): where each token ends, and its id, in order."""
        ends, at, left = [], final.astype(np.int64), first.astype(np.int64)
        while len(at):
            ends.append(at)
            at = at - self.length[last[at]]
            on = at >= left
            at, left = at[on], left[on]
        marks = np.zeros(len(last), bool)
        for x in ends:
            marks[x] = True
        places = np.flatnonzero(marks)
        return places, last[places]
