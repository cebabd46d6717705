"""SentencePiece encoding and decoding by a weighted finite-state transducer.

A model is compiled to machines of states and arcs (Machine), whose weights are in the tropical semiring (sums along a path,
the least over paths):

- the normaliser N: a tree of the strings that the model's character map rewrites, a loop for every other character, spaces
  to the mark U+2581, and a mark in front;
- the pieces P: a tree of the pieces' characters; where a piece ends its state emits it and is the first state again;
- byte fallback B: for a character that no piece is, an arc that emits its UTF-8 bytes (or the unknown piece);
- for BPE models the context C: a state for each piece, and an arc for each pair of pieces.  Its arcs are made as paths ask for them.

The weight of a unigram model's piece is its negative score, of a fallback ten more than the largest.  A BPE model's pieces weigh nothing, and
C's arc for a piece after another weighs 0 if merging their joined text by rank gives these two pieces again, and infinity if a
merge across their border comes first.  A sequence of pieces is the BPE encoding of its text if and only if every neighbouring
pair is, so exactly one path to every prefix has a finite weight.

N is composed with each text, the result with P and B (and C): a lattice, of which the shortest path is found by relaxing the
arcs into each position in turn.  Where no piece has a mark after another character, paths meet at every mark, so what
stands between marks is composed once for each distinct word.  Of equally short paths that with the longest last piece is taken.

Defined results: null and empty texts give no ids, and no ids decode to the empty text (a null list to null); an
empty table gives an empty result; repeated rows give repeated results; extra columns are kept.  decode(encode(text)) is text
if the normaliser keeps it, except that a U+2581 in the text comes back as a space, as in the library.  Weights are summed in double
precision, word by word: the library sums whole texts in single precision, so for unigram models nearly equal paths of long texts may differ.
"""

from __future__ import annotations

import re
import struct
import zlib
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_arrow, mix, text_slices

MARK = "▁"
#: Distinct words kept by a worker, and how many bytes their texts and ids may take; beyond either the table starts anew.
MEMO = 200_000
MEMO_BYTES = 12 << 20
#: Longer words are composed one character at a time, shorter ones many at once.
LONG = 60
_NEVER = 1 << 60
_INF = float("inf")
#: What the best path adds for a character that no piece has.
_UNKNOWN_COST = 10.0


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _varint(b: bytes, i: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        value |= (b[i] & 127) << shift
        shift += 7
        i += 1
        if b[i - 1] < 128:
            return value, i


def _fields(b: bytes) -> Iterator[tuple[int, object]]:
    """Fields of a protocol buffer message."""
    i = 0
    while i < len(b):
        key, i = _varint(b, i)
        if key & 7 == 0:
            value, i = _varint(b, i)
        else:
            n, i = {1: (8, i), 5: (4, i)}.get(key & 7) or _varint(b, i)
            value, i = b[i : i + n], i + n
        yield key >> 3, value


class Machine:
    """A tree of strings as states and arcs.  An arc leads from a state by a character to a state; `final` says what a state emits (-1: nothing).

    Arcs are held twice: in a dictionary for single steps, and as a hash table (open addressing) for a step of many states at once.
    """

    def __init__(self, strings: Iterable[tuple[str, int]]):
        self.arcs: dict[int, int] = {}
        self.final = [-1]
        for text, emits in strings:
            state = 0
            for c in text:
                key = state << 21 | ord(c)
                state = self.arcs.get(key, 0)
                if not state:
                    state = self.arcs[key] = len(self.final)
                    self.final.append(-1)
            self.final[state] = emits
        self.emits = np.array(self.final, np.int32)
        keys, targets = np.fromiter(self.arcs.keys(), np.int64, len(self.arcs)), np.fromiter(self.arcs.values(), np.int32, len(self.arcs))
        self.bits = max(4, (4 * max(1, len(keys)) - 1).bit_length())
        self.keys, self.targets = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int32)
        at, left, self.probes = self._slot(keys), np.arange(len(keys)), 1
        while len(left):
            # Of the arcs that want a free slot the first gets it; the others go on to the next one.
            _, first = np.unique(at[left], return_index=True)
            put = left[first][self.keys[at[left[first]]] == -1]
            self.keys[at[put]], self.targets[at[put]] = keys[put], targets[put]
            left = np.setdiff1d(left, put)
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)
            self.probes += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (mix(keys.astype(np.uint64)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def step(self, states: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The state that each state's arc by its code leads to, or -1."""
        keys = states.astype(np.int64) << 21 | codes
        out, at, left = np.full(len(keys), -1, np.int32), self._slot(keys), np.arange(len(keys))
        for _ in range(self.probes):
            got = self.keys[at]
            hit = got == keys[left]
            out[left[hit]] = self.targets[at[hit]]
            on = ~hit & (got >= 0)
            if not on.any():
                break
            left, at = left[on], (at[on] + 1) & ((1 << self.bits) - 1)
        return out

    def longest(self, text: str, at: int) -> tuple[int, int]:
        """What the longest string that stands in text at `at` emits, and where it ends; (-1, at) if there is none."""
        state, best, end = 0, -1, at
        for k in range(at, len(text)):
            state = self.arcs.get(state << 21 | ord(text[k]), 0)
            if not state:
                break
            if self.final[state] >= 0:
                best, end = self.final[state], k + 1
        return best, end


def character_map(blob: bytes) -> dict[str, str]:
    """What a model's precompiled character map rewrites: a double-array tree of UTF-8 strings, then the results, each with a zero behind."""
    if not blob:
        return {}
    size = struct.unpack_from("<I", blob)[0]
    units, results = np.frombuffer(blob, "<u4", size // 4, 4).astype(np.int64), blob[4 + size :]
    offset = (units >> 10) << ((units & 512) >> 6)
    label, leaf = units & 0x800000FF, (units >> 8) & 1
    out, todo, letters = {}, [(int(offset[0]), b"")], np.arange(1, 256)
    while todo:
        base, text = todo.pop()
        child = base ^ letters
        fits = child < len(units)
        for c in letters[fits][label[child[fits]] == letters[fits]].tolist():
            node = base ^ c
            below = int(node ^ offset[node])
            key = text + bytes([c])
            if leaf[node]:
                begin = int(units[below] & 0x7FFFFFFF)
                out[key.decode("utf-8", "replace")] = results[begin : results.index(b"\0", begin)].decode("utf-8", "replace")
            todo.append((below, key))
    return out


class Normaliser:
    """N.  compose() gives the only path through it that a text allows: leftmost longest strings are rewritten."""

    def __init__(self, rules: dict[str, str], prefix: bool = True, collapse: bool = False, escape: bool = True, suffix: bool = False):
        self.results = list(rules.values())
        self.machine = Machine((k, i) for i, k in enumerate(rules))
        self.prefix, self.collapse, self.mark, self.suffix = prefix, collapse, MARK if escape else " ", suffix
        # Only a string of one character, or the second character of a longer one, can change a text.
        changing = {k[0] for k in rules if len(k) == 1} | {k[1] for k in rules if len(k) > 1}
        self.changes = re.compile("[" + "".join(map(re.escape, sorted(changing))) + "]") if changing else None
        #: Whether a text without repeated, first or last spaces only gets marks.
        self.plain = prefix and not suffix and escape

    def rewritten(self, text: str) -> str:
        if self.changes is None or not self.changes.search(text):
            return text
        out, at = [], 0
        while at < len(text):
            rule, end = self.machine.longest(text, at)
            if rule < 0:
                out.append(text[at])
                at += 1
            else:
                out.append(self.results[rule])
                at = end
        return "".join(out)

    def compose(self, text: str) -> str:
        text = self.rewritten(text)
        if self.collapse:
            text = re.sub(" +", " ", text).strip(" ")
        if not text:
            return ""
        front, behind = " " * (self.prefix and not self.suffix), " " * (self.prefix and self.suffix)
        return (front + text + behind).replace(" ", self.mark)


class Transducer:
    """A compiled model.  encode() gives ids as little-endian unsigned 32-bit integers."""

    def __init__(self, model: bytes):
        kinds, self.text = [], []
        trainer, norm = {}, {}
        for field, value in _fields(model):
            if field == 1:
                piece = dict(_fields(value))
                self.text.append(piece.get(1, b"").decode())
                kinds.append((piece.get(3, 1), struct.unpack("<f", piece.get(2, b"\0\0\0\0"))[0]))
            elif field == 2:
                trainer = dict(_fields(value))
            elif field == 3:
                norm = dict(_fields(value))
        kind = trainer.get(3, 1)
        if kind not in (1, 2):
            raise ValueError("the model is neither unigram nor BPE")
        if any(k == 4 for k, _ in kinds):
            raise ValueError("pieces that a user defined are not compiled")
        self.bpe = kind == 2
        self.normaliser = Normaliser(character_map(norm.get(2, b"")), bool(norm.get(3, 1)), bool(norm.get(4, 1)), bool(norm.get(5, 1)), bool(trainer.get(24, 0)))
        self.ids = {t: i for i, (t, (k, _)) in enumerate(zip(self.text, kinds, strict=True)) if k == 1 and t}
        self.pieces = Machine(self.ids.items())
        #: Paths meet at every mark.
        self.meet = not any(MARK in t.lstrip(MARK) or t.strip(MARK) and t.rstrip(MARK) != t for t in self.ids)
        self.byte = {int(t[3:5], 16): i for i, (t, (k, _)) in enumerate(zip(self.text, kinds, strict=True)) if k == 6} if trainer.get(35, 0) else {}
        #: Nothing merges with a character without a piece, so words may also begin at line ends if no piece has those.
        self.lines = self.bpe and bool(self.byte) and not any("\n" in t for t in self.ids)
        order = sorted(self.ids.values(), key=lambda i: -kinds[i][1])
        self.rank = {i: n for n, i in enumerate(order)}
        self.cost = np.array([0.0 if self.bpe else -s for _, s in kinds])
        self.fallback = 0.0 if self.bpe else _UNKNOWN_COST + max((self.cost[i] for i in self.rank), default=0.0)
        self.unknown = next((i for i, (k, _) in enumerate(kinds) if k == 2), 0)
        if self.byte and len(self.byte) < 256:
            raise ValueError("byte pieces are missing")
        self.longest = max(map(len, self.ids), default=1)
        back = {i: bytes([b]) for b, i in self.byte.items()}
        self.bytes = [back.get(i, b"" if k != 1 else t.replace(MARK, " ").encode()) for i, (t, (k, _)) in enumerate(zip(self.text, kinds, strict=True))]
        self.bytes[self.unknown] = " ⁇ ".encode()
        self.memo: dict[str, bytes] = {}
        self.held = 0
        self.size = np.array([len(t) for t in self.text], np.int64)
        if self.bpe:
            self._context()

    def _context(self) -> None:
        """What C's arcs are made of.  A piece's spines are the pieces that have, one after another, stood at its left and at its right end while
        merging gave it; `real` says whether merging ever does; `joins` finds a merge by its two parts."""
        n, found = len(self.text), {}
        for piece in self.rank:
            parts = [self.ids.get(c) for c in self.text[piece]]
            if None in parts:
                continue
            left, right = [parts[0]], [parts[-1]]
            while len(parts) > 1:
                low, at, made = min(((self.rank.get(m, _NEVER), k, m) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if (m := self.ids.get(self.text[a] + self.text[b])) is not None), default=(_NEVER, 0, None))
                if made is None:
                    break
                parts[at : at + 2] = [made]
                left += [made] * (at == 0)
                right += [made] * (at == len(parts) - 1)
            if parts == [piece]:
                found[piece] = left, right
        depth = max((len(e) for pair in found.values() for e in pair), default=1) + 1
        self.real = np.zeros(n, bool)
        self.real[list(found)] = True
        ranks = np.full(n + 1, _NEVER, np.int64)
        ranks[list(self.rank)] = list(self.rank.values())
        self.ranks, self.spine = ranks, np.full((2, n, depth), n, np.int64)
        for i, pair in found.items():
            for side in (0, 1):
                self.spine[side, i, : len(pair[side])] = pair[side]
        # Any two parts of a piece that are pieces themselves make it; the key is the state of the first part in P and the second piece.
        keys, made = [], []
        for t, i in self.ids.items():
            for k in range(1, len(t)):
                a, b = self.ids.get(t[:k]), self.ids.get(t[k:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    made.append(self.rank[i])
        order = np.argsort(np.array(keys, np.int64))
        self.join_keys, self.join_ranks = np.append(np.array(keys, np.int64)[order], 1 << 62), np.append(np.array(made, np.int64)[order], _NEVER)
        self._open: dict[int, bool] = {}

    def joined(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of the piece that a and b together are, or a number above all ranks."""
        key = a << 32 | b
        at = np.searchsorted(self.join_keys, key)
        return np.where(self.join_keys[at] == key, self.join_ranks[at], _NEVER)

    def free(self, before: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """Whether C's arc by `piece` from the state `before` weighs 0 (else infinity); before is -1 at the beginning and after a fallback."""
        out = self.real[piece] & ((before == -1) | self.real[before])
        key, back = np.unique(before.astype(np.int64) << 32 | piece, return_inverse=True)
        on = np.flatnonzero(key >= 0)  # pairs after -1 are settled
        a, b = key[on] >> 32, key[on] & 0xFFFFFFFF
        good = np.ones(len(key), bool)
        i, j = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
        while len(on):
            # What comes next: a merge inside the left one, across the border, or inside the right one; ties from the left.
            inner, outer = self.ranks[self.spine[1, a, i + 1]], self.ranks[self.spine[0, b, j + 1]]
            across = self.joined(self.spine[1, a, i], self.spine[0, b, j])
            bad = (across < inner) & (across <= outer)
            good[on[bad]] = False
            go = ~bad & ((inner < _NEVER) | (outer < _NEVER))
            left = inner <= outer
            on, a, b, i, j = on[go], a[go], b[go], (i + left)[go], (j + ~left)[go]
        return out & good[back]

    def weight(self, before: int, piece: int) -> float:
        """The weight of the arc by `piece` after `before` in P composed with C."""
        if not self.bpe:
            return float(self.cost[piece])
        key = before << 32 | piece
        known = self._open.get(key)
        if known is None:
            if len(self._open) > MEMO:
                self._open.clear()
            known = self._open[key] = bool(self.free(np.array([before]), np.array([piece]))[0])
        return 0.0 if known else _INF

    def lattice(self, code: np.ndarray, within: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
        """Composes chunks with P: for each length n the piece of n characters that ends at each place, or -1.

        code: characters of all chunks; within: places in their chunks; size: characters of the chunk that each belongs to.
        """
        total, out = len(code), []
        begin, state = np.arange(total), np.zeros(total, np.int32)
        for n in range(1, self.longest + 1):
            fits = within[begin] + n <= size[begin]
            begin, state = begin[fits], state[fits]
            state = self.pieces.step(state, code[begin + n - 1])
            begin, state = begin[state >= 0], state[state >= 0]
            if not len(begin):
                break
            ends = np.full(total, -1, np.int32)
            ends[begin + n - 1] = self.pieces.emits[state]
            out.append(ends)
        return out

    def shortest_of(self, chunks: list[str]) -> list[bytes]:
        """shortest() of many chunks, position by position in all of them at once."""
        if not chunks:
            return []
        size = np.array([len(c) for c in chunks])
        order = np.argsort(-size, kind="stable")
        size = size[order]
        code = np.frombuffer("".join([chunks[k] for k in order]).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        start, total = np.cumsum(size) - size, int(size.sum())
        within = np.arange(total) - np.repeat(start, size)
        at = self.lattice(code, within, np.repeat(size, size))
        # Fallback arcs stand where no piece is the character.
        lacks = at[0] < 0 if at else np.ones(total, bool)
        width = int(size[0]) + 1
        last, best = np.full((len(chunks), width), -1, np.int64), np.full((len(chunks), width), _INF)
        best[:, 0] = 0
        for j in range(1, width):
            active = int(np.searchsorted(-size, -j, "right"))
            flat = start[:active] + j - 1
            rows, pieces, lengths = [], [], []
            for n in range(min(j, len(at)), 0, -1):
                p = at[n - 1][flat]
                r = np.flatnonzero((p >= 0) & (best[:active, j - n] < _INF))
                rows.append(r)
                pieces.append(p[r])
                lengths.append(np.full(len(r), n))
            if rows:
                r, p, n = np.concatenate(rows), np.concatenate(pieces).astype(np.int64), np.concatenate(lengths)
                if self.bpe:
                    ok = self.free(last[r, j - n], p)
                    last[r[ok], j], best[r[ok], j] = p[ok], best[r[ok], j - n[ok]]
                elif len(r):
                    # The least weight of each row; of equal ones the first, which is the longest piece.
                    cost = best[r, j - n] + self.cost[p]
                    by = np.lexsort((np.arange(len(r)), cost, r))
                    by = by[np.append(True, np.diff(r[by]) > 0)]
                    last[r[by], j], best[r[by], j] = p[by], cost[by]
            r = np.flatnonzero(lacks[flat])
            r = r[best[r, j - 1] + self.fallback < best[r, j]]
            last[r, j], best[r, j] = -1, best[r, j - 1] + self.fallback
        value = np.full(total, -2, np.int64)  # at the end of each arc of the path its piece, -1 for a fallback
        cur, w = size.copy(), np.arange(len(chunks))
        while len(w):
            p = last[w, cur[w]]
            value[start[w] + cur[w] - 1] = p
            cur[w] -= np.where(p < 0, 1, self.size[p])
            w = w[cur[w] > 0]
        place = np.flatnonzero(value > -2)
        ids, many = value[place], np.ones(len(place), np.int64)
        other = np.flatnonzero(ids == -1)
        if self.byte:
            spelled = [[self.byte[b] for b in chr(c).encode("utf-8", "replace")] for c in code[place[other]].tolist()]
            many[other] = [len(x) for x in spelled]
            ids = np.repeat(ids, many)
            ids[ids == -1] = [i for x in spelled for i in x]
        else:
            # Unknown characters that stand together are one piece.
            again = other[1:][(np.diff(other) == 1) & (within[place[other[1:]]] > 0)]
            ids[other], many[again] = self.unknown, 0
            ids = np.repeat(ids, many)
        first = np.searchsorted(place, np.append(start, total))
        edge = 4 * np.concatenate([[0], np.cumsum(many)])[first]
        out: list = [b""] * len(chunks)
        packed = ids.astype("<u4").tobytes()
        for k, x, y in zip(order.tolist(), edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            out[k] = packed[x:y]
        return out

    def shortest(self, chunk: str) -> list[int]:
        """Ids on the shortest path through chunk (normalised), arc by arc."""
        arcs, final, n = self.pieces.arcs, self.pieces.final, len(chunk)
        best, via = [_INF] * (n + 1), [-2] * (n + 1)  # via: the piece that ends here; -1: none before, or a fallback
        best[0], via[0] = 0.0, -1
        for i in range(n):
            have, before, state, single = best[i], via[i], 0, False
            for j in range(i, n):
                state = arcs.get(state << 21 | ord(chunk[j]), 0)
                if not state:
                    break
                piece = final[state]
                if piece >= 0:
                    single = single or j == i
                    if have < _INF:
                        cost = have + self.weight(before, piece)
                        if cost < best[j + 1]:
                            best[j + 1], via[j + 1] = cost, piece
            if not single and have + self.fallback < best[i + 1]:
                best[i + 1], via[i + 1] = have + self.fallback, -1
        out: list[int] = []
        j, unknown = n, False
        while j:
            if via[j] == -1:
                j -= 1
                if self.byte:
                    out += reversed([self.byte[b] for b in chunk[j].encode("utf-8", "replace")])
                elif not unknown:
                    out.append(self.unknown)  # unknown characters that stand together are one piece
                unknown = True
            else:
                out.append(via[j])
                j -= len(self.text[via[j]])
                unknown = False
        return out[::-1]

    def encode_many(self, texts: list[str | None]) -> list[bytes]:
        """encode() of each text; the words that the memo lacks are composed together."""
        memo = self.memo
        lists = [self._words(t) if t else [] for t in texts]
        new = set().union(*(x for x in lists if x is not None)).difference(memo)
        short = [w for w in new if len(w) < LONG]
        memo.update(zip(short, self.shortest_of([self._chunk(w) for w in short]), strict=True))
        memo.update((w, array("I", self.shortest(self._chunk(w))).tobytes()) for w in new if len(w) >= LONG)
        out = [self._whole(t) if x is None else b"".join(map(memo.__getitem__, x)) for t, x in zip(texts, lists, strict=True)]
        self.held += sum(len(w) + len(memo[w]) for w in new)
        if len(memo) > MEMO or self.held > MEMO_BYTES:
            memo.clear()
            self.held = 0
        return out

    def _chunk(self, word: str) -> str:
        return word if self.lines and word[0] == "\n" else MARK + word

    def _words(self, text: str) -> list[str] | None:
        """What stands between single spaces, to be composed with a mark in front; None if the text has to be composed as a whole."""
        if not (self.meet and self.normaliser.plain):
            return None
        text = self.normaliser.rewritten(text)
        plain = text.replace("\n", " \n") if self.lines else text
        return None if MARK in plain or "  " in plain or not plain or plain[0] == " " or plain[-1] == " " else plain.split(" ")

    def _whole(self, text: str) -> bytes:
        composed = self.normaliser.compose(text)
        chunks = re.findall(f"{MARK}*[^{MARK}]+|{MARK}+$", composed) if self.meet else [composed] * bool(composed)
        return b"".join([array("I", self.shortest(c)).tobytes() for c in chunks])

    def encode(self, text: str | None) -> bytes:
        return self.encode_many([text])[0]

    def decode(self, ids) -> str:
        table = self.bytes
        out = b"".join([table[i] for i in ids]).decode("utf-8", "replace")
        return out[1:] if out[:1] == " " and self.normaliser.prefix else out


@lru_cache(maxsize=4)
def _compiled(model: bytes) -> Transducer:
    return Transducer(model)


def _load(path: str | None) -> bytes:
    with open(path or default_model(), "rb") as f:
        return f.read()


def _types(df: DataFrame, keep: list[str]) -> list[str]:
    return [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep]


def encode(docs: DataFrame, model: str | None = None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (all) of docs and `ids`, array<int>.  The model file is read on the driver and sent along."""
    keep = [c for c in (docs.columns if keep is None else keep) if c != "ids"]
    held = docs.sparkSession.sparkContext.broadcast(_load(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst = _compiled(held.value)
        for batch in batches:
            for piece in text_slices(batch, text):
                texts = piece.column(text).to_pylist()
                made = fst.encode_many(texts)
                offsets = np.concatenate([[0], np.cumsum([len(m) // 4 for m in made])]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(made), "<i4")))
                yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in keep), ids], [*keep, "ids"])

    return map_arrow(docs.select(*dict.fromkeys([*keep, text])), run, ", ".join([*_types(docs, keep), "ids array<int>"]))


def decode(encoded: DataFrame, model: str | None = None, ids: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (all) of encoded and `decoded`, the text of its ids."""
    keep = [c for c in (encoded.columns if keep is None else keep) if c != "decoded"]
    held = encoded.sparkSession.sparkContext.broadcast(_load(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst = _compiled(held.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [None if x is None else fst.decode(x.values.to_numpy(zero_copy_only=False).tolist()) for x in part.column(ids)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(texts, pa.string())], [*keep, "decoded"])

    return map_arrow(encoded.select(*dict.fromkeys([*keep, ids])), run, ", ".join([*_types(encoded, keep), "decoded string"]))


def checked(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """(doc_id, n_pieces, ids_crc32, round_trip) of encoded documents (doc_id, text, ids): crc32 of the ids as little-endian unsigned 32-bit integers."""
    held = encoded.sparkSession.sparkContext.broadcast(_load(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst = _compiled(held.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                lists = [x.values.to_numpy(zero_copy_only=False) for x in part.column("ids")]
                same = [fst.decode(x.tolist()) == (t or "") for x, t in zip(lists, part.column("text").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(x) for x in lists], pa.int64()), pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in lists], pa.int64()), pa.array(same)], ["doc_id", "n_pieces", "ids_crc32", "round_trip"])

    return map_arrow(encoded.select("doc_id", "text", "ids"), run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, n_pieces long, ids_crc32 long, round_trip boolean")
