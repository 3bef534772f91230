"""SentencePiece encoding and decoding with seeded merge-dropout.

The vocabulary is that of a BPE model of the sentencepiece library (its path is a parameter). Text is cut into units, a
run of spaces with the run of other characters after it, or a line feed: no piece has a space after another character or a
line feed beside one, so merges never leave a unit. Within a unit the agenda holds every pair of neighbours whose union is a
piece; the best (by score, then leftmost) comes up, and is merged or skipped for good, until none is left. What decides is
a hash keyed by the seed, the document, the unit's place in it and how many merges of the unit were skipped before: it says
how many merges are made before the next is skipped, so that each is skipped with the chance `dropout`. Every occurrence of
a word in every document is thus decided for itself, and the same key gives the same pieces. Without dropout the pieces are
those of the library.

What doesn't depend on the key is kept in a bounded table: a unit's pieces after merges number i, j, ... were skipped, and
how many merges come up after that. It is a tree for each unit, from which an occurrence needs one place; all new places
of a run of texts are worked on together, with one merge for each in a round.

Characters without a piece become byte pieces, and so does the sign that stands for a space in pieces; decoding joins the
bytes of pieces and takes off the first space, which encoding put there. So decode(encode(x)) = x for every text, whatever
was skipped. Pieces are returned as little-endian 16-bit numbers (32-bit for vocabularies of more than 65,536).

Defined results: null text gives null pieces and null decoded text; an empty text gives no pieces; rows of one id and text
have the same pieces (unless `by_row` is set); an empty table gives an empty table; other columns are carried along.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from itertools import chain, compress, repeat
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.arrays import mix
from foliant.llm.runtime import kept, released, small_batches

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
DROPOUT, SEED = 0.1, 1
#: Places of trees that a worker keeps, and characters that are worked on at once.
KEPT, RUN_CHARS = 300_000, 1 << 20
SPACE = "▁"
UNIT = re.compile(r" *[^ \n]+|\n| +")
BATCH = 1000
#: Longer units are worked on one by one, with a list for an agenda.
LONG = 48


def units_of(text: str) -> list[str]:
    """Units of a text, which begins with the space that encoding puts there."""
    if not text:
        return []
    text = " " + text
    if "  " in text:
        return UNIT.findall(text)
    out = []
    for line in text.split("\n"):
        first, *words = line.split(" ")
        if first:
            out.append(first)
        out += [" " + w for w in words]
        out.append("\n")
    return out[:-1]


class Pieces:
    """Vocabulary, merges by pair, and bytes by piece of a BPE model with byte fallback."""

    def __init__(self, model: bytes):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = sp.vocab_size()
        names = [sp.id_to_piece(i) for i in range(size)]
        self.bytes = {int(names[i][1:-1], 16): i for i in range(size) if sp.is_byte(i)}
        normal = [i for i in range(size) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.ids = {names[i]: i for i in normal}
        score = {i: sp.get_score(i) for i in normal}
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.text = [b""] * size
        for b, i in self.bytes.items():
            self.text[i] = bytes([b])
        for i in normal:
            self.text[i] = names[i].replace(SPACE, " ").encode()
        self.bytes_of = np.frombuffer(b"".join(self.text), np.uint8)
        self.sizes = np.array([len(t) for t in self.text], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        # symbols: pieces by id, then single characters that have no piece, which only byte pieces can show
        pairs = {}
        for name, i in self.ids.items():
            for k in range(1, len(name)):
                a, b = self.ids.get(name[:k]), self.ids.get(name[k:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = i
        order = np.array(sorted(pairs), np.int64)
        self.pair = pairs
        self._table(np.array(list(pairs), np.int64), np.array(list(pairs.values()), np.int32))
        # equal scores are equal ranks
        values = np.array([score.get(i, 0.0) for i in range(size)])
        _, ranks = np.unique(-values, return_inverse=True)
        self.rank = ranks.astype(np.int32)
        # one symbol for each character, or negative (-1 - code point) where only bytes can show it
        self.chars = -1 - np.arange(0x110000, dtype=np.int32)
        for name, i in self.ids.items():
            if len(name) == 1 and name != SPACE:
                self.chars[ord(name)] = i
        self.chars[ord(" ")] = self.ids[SPACE]

    def _table(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Three hash tables, each for what finds its place in the one before taken; multipliers of the last are tried until all fit."""
        multiplier = 0x9E3779B97F4A7C15
        self.tables, rest = [], np.arange(len(keys))
        for bits in (19, 16, 14):
            while True:
                slot = ((keys[rest].view(np.uint64) * np.uint64(multiplier)) >> np.uint64(64 - bits)).astype(np.int64)
                _, first = np.unique(slot, return_index=True)
                if bits > 14 or len(first) == len(rest):
                    break
                multiplier = (multiplier * 0xD1342543DE82EF95 + 2) % (1 << 64) | 1
            k, v = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)
            k[slot[first]], v[slot[first]] = keys[rest[first]], values[rest[first]]
            self.tables.append((np.uint64(multiplier), np.uint64(64 - bits), k, v))
            rest = np.delete(rest, first)
            multiplier = (multiplier * 0xD1342543DE82EF95 + 2) % (1 << 64) | 1

    def lookup(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The piece that two symbols make, or -1."""
        key = a.astype(np.int64) << 32 | b.astype(np.int64)
        found = np.full(key.shape, -1, np.int32)
        for multiplier, shift, keys, values in self.tables:
            slot = ((key.view(np.uint64) * multiplier) >> shift).astype(np.int64)
            hit = keys[slot] == key
            found[hit] = values[slot[hit]]
        return found

    def symbols(self, unit: str) -> list[int]:
        return self.chars[np.frombuffer(unit.encode("utf-32-le", "surrogatepass"), np.uint32)].tolist()

    def shown(self, symbols: list[int]) -> bytes:
        out: list[int] = []
        for s in symbols:
            if s >= 0:
                out.append(s)
            else:
                out += [self.bytes[b] for b in chr(-1 - s).encode("utf-8", "surrogatepass")]
        return np.array(out, self.dtype).tobytes()


NEVER = np.iinfo(np.int32).max


def segment(p: Pieces, units: list[str], skips: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """Packed pieces of each unit, and how many merges came up.

    skips: a row for each unit with the merges that are skipped, by the order in which they come up (from 0), then NEVER.
    """
    out, rounds = [b""] * len(units), np.zeros(len(units), np.int64)
    length = np.fromiter(map(len, units), np.int64, len(units))
    by_length = np.argsort(length, kind="stable")
    length = length[by_length]
    first = 0
    while first < len(units):
        width = max(6, -(-int(length[first]) // 3) * 3)
        last = min(int(np.searchsorted(length, width, "right")), first + max(1, (1 << 19) // width))
        chosen = by_length[first:last]
        _merge(p, [units[i] for i in chosen.tolist()], chosen, width, skips[chosen], out, rounds)
        first = last
    return out, rounds


def _merge(p: Pieces, texts: list[str], chosen: np.ndarray, width: int, skips: np.ndarray, out: list[bytes], rounds: np.ndarray) -> None:
    n, none = len(texts), NEVER
    length = np.fromiter(map(len, texts), np.int32, n)
    sym = np.full((n, width + 1), -(1 << 30), np.int32)  # what is no character is no part of a piece
    sym[np.arange(width + 1)[None, :] < length[:, None]] = p.chars[np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)]
    made = p.lookup(sym[:, :-1], sym[:, 1:])
    rank = np.where(made >= 0, p.rank[made], none)
    live, skipped, now = np.arange(n), np.zeros(n, np.int32), 0
    while len(live):
        at = rank.argmin(axis=1)
        rows = np.arange(len(live))
        over = rank[rows, at] == none
        if over.any():
            ended = sym[over]
            rounds[chosen[live[over]]] = now
            inside = np.arange(sym.shape[1])[None, :] < length[over][:, None]
            if int(np.where(inside, ended, 0).min()) >= 0:
                flat, ends = ended[inside].astype(p.dtype).tobytes(), np.cumsum(length[over]) * p.dtype.itemsize
                for i, a, b in zip(chosen[live[over]].tolist(), [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                    out[i] = flat[a:b]
            else:
                for i, row, m in zip(chosen[live[over]].tolist(), ended, length[over].tolist(), strict=True):
                    out[i] = p.shown(row[:m].tolist())
            go = ~over
            live, length, at, skips, skipped = live[go], length[go], at[go], skips[go], skipped[go]
            if not len(live):
                break
            most = int(length.max())
            sym, rank, rows = sym[go, : most + 1], rank[go, :most], rows[: len(live)]
        skip = skips[rows, skipped] == now
        now += 1
        if skip.any():
            rank[rows[skip], at[skip]] = none
            skipped[skip] += 1
            rows, at = rows[~skip], at[~skip]
            if not len(rows):
                continue
        sym[rows, at] = p.lookup(sym[rows, at], sym[rows, at + 1])
        # take out symbol at + 1 and the pair before it
        behind = np.full(len(live), sym.shape[1], np.int64)
        behind[rows] = at
        for x in (sym, rank):
            np.copyto(x[:, :-1], x[:, 1:].copy(), where=np.arange(x.shape[1] - 1)[None, :] > behind[:, None])
        rank[rows, -1] = none
        length[rows] -= 1
        for side in (at - 1, at):  # only the pairs beside the new symbol change
            ok = (side >= 0) & (side + 1 < length[rows])
            r, c = rows[ok], side[ok]
            made = p.lookup(sym[r, c], sym[r, c + 1])
            rank[r, c] = np.where(made >= 0, p.rank[made], none)
            ends = ~ok & (side >= 0)
            rank[rows[ends], side[ends]] = none


def _agenda(p: Pieces, unit: str, gaps: Iterator[int]) -> list[int]:
    """The same for one long unit: candidates in a heap, symbols in a linked list. gaps: merges made before each skip."""
    symbols, n = p.symbols(unit), len(unit)
    ends, before = list(range(1, n + 1)), list(range(-1, n - 1))  # by start: where the symbol ends, and who stands before
    heap: list[tuple[int, int, int, int]] = []

    def add(a: int, b: int) -> None:
        if 0 <= a and b < n and symbols[a] >= 0 <= symbols[b] and (made := p.pair.get(symbols[a] << 32 | symbols[b])) is not None:
            heapq.heappush(heap, (int(p.rank[made]), a, b, ends[b]))

    for i in range(n - 1):
        add(i, i + 1)
    left = next(gaps)
    while heap:
        _, a, b, end = heapq.heappop(heap)
        if ends[a] != b or ends[b] != end:
            continue
        if not left:
            left = next(gaps)
            continue
        left -= 1
        symbols[a], ends[a], ends[b] = p.pair[symbols[a] << 32 | symbols[b]], end, -1
        if end < n:
            before[end] = a
        add(before[a], a)
        add(a, end)
    out, at = [], 0
    while at < n:
        out.append(symbols[at])
        at = ends[at]
    return out


class Gaps:
    """How many merges are made before the next is skipped, from a hash: k or more with the chance (1 - dropout)**k."""

    def __init__(self, dropout: float):
        self.dropout = dropout
        chances, x = [], 1.0
        while dropout and x * (1 << 53) > 1 and len(chances) < 1 << 20:
            x *= 1 - dropout
            chances.append(int(x * (1 << 53)))
        self.table = np.array(chances[::-1], np.int64)
        # by the first 12 bits, where they decide
        low, high = (self._search((np.arange(1 << 12) << 41) + x) for x in (0, (1 << 41) - 1))
        self.known = np.where(low == high, low, -1)

    def _search(self, x: np.ndarray) -> np.ndarray:
        return len(self.table) - np.searchsorted(self.table, x, "right")

    def of(self, keys: np.ndarray, places: np.ndarray, level: int) -> np.ndarray:
        """keys: of documents; places of units in them; level: merges of the unit that were skipped before."""
        if not self.dropout:
            return np.full(len(keys), NEVER, np.int64)
        x = mix(mix(keys + places.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) + np.uint64((level + 1) * 0xC2B2AE3D27D4EB4F % (1 << 64)))
        x = (x >> np.uint64(11)).astype(np.int64)
        out = self.known[x >> 41]
        open_ = np.flatnonzero(out < 0)
        out[open_] = self._search(x[open_])
        return out

    def skips(self, keys: np.ndarray, places: np.ndarray, level: int, last: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Merges that are skipped after the last, by their order, as far as `most`; at least one column."""
        out, at = [], last.astype(np.int64)
        while not out or (at < most).any():
            at = np.minimum(at + 1 + self.of(keys, places, level), NEVER)
            out.append(at)
            level += 1
        return np.stack(out, axis=1)

    def one(self, key: int, place: int) -> Iterator[int]:
        level = 0
        while True:
            yield int(self.of(np.array([key], np.uint64), np.array([place]), level)[0])
            level += 1


class Trees:
    """Pieces of units by the merges that were skipped; a place is (unit, skips), known by a number.

    last, parent: the merge that was skipped last, and the place without it (-1 at a root, where none was); after: how many
    merges come up after that; hits: how often the place was reached.
    """

    def __init__(self, p: Pieces, kept: int):
        self.p, self.kept = p, kept
        self.roots: dict[str, int] = {}
        self.below: dict[int, int] = {}  # by place << 32 | merges made before the next skip
        self.units: list[str] = []
        self.packed: list[bytes] = []
        self.last, self.parent, self.after, self.hits = (np.zeros(1 << 12, np.int32) for _ in range(4))

    def add(self, units: list[str], last: np.ndarray, parent: np.ndarray, further: np.ndarray) -> tuple[list[bytes], np.ndarray]:
        """Pieces of each unit, and its new place. further: merges that are skipped beyond the place; where one of them came
        up, the pieces are those of a place further on, of which the numbers are not known (-1)."""
        at = parent
        skips = np.concatenate([np.where(last >= 0, last, NEVER)[:, None].astype(np.int32), further, np.full((len(units), 1), NEVER, np.int32)], axis=1)
        while (at >= 0).any():
            skips = np.concatenate([np.where((at >= 0) & (self.last[at] >= 0), self.last[at], NEVER)[:, None], skips], axis=1)
            at = np.where(at >= 0, self.parent[at], -1)
        packed, rounds = segment(self.p, units, np.sort(skips, axis=1))
        here = rounds <= further[:, 0]
        place = np.where(here, len(self.packed) - 1 + np.cumsum(here), -1)
        n = len(self.packed) + int(here.sum())
        while len(self.last) < n:
            self.last, self.parent, self.after, self.hits = (np.concatenate([x, np.zeros_like(x)]) for x in (self.last, self.parent, self.after, self.hits))
        new = slice(len(self.packed), n)
        self.last[new], self.parent[new], self.after[new], self.hits[new] = last[here], parent[here], (rounds - (last + 1))[here], 0
        which = np.flatnonzero(here).tolist()
        self.units += [units[i] for i in which]
        self.packed += [packed[i] for i in which]
        return packed, place

    def reached(self, places: np.ndarray) -> None:
        n = len(self.packed)
        self.hits[:n] += np.bincount(places, minlength=n).astype(np.int32)

    def shrink(self) -> None:
        """Beyond the bound, only the places reached most often stay; who reaches one has reached its parent."""
        n = len(self.packed)
        if n <= self.kept:
            return
        least = max(1, int(np.partition(self.hits[:n], n - self.kept // 2)[n - self.kept // 2]) + 1)
        stay = np.flatnonzero(self.hits[:n] >= least)
        number = np.full(n + 1, -1, np.int64)
        number[stay] = np.arange(len(stay))
        to = number.tolist()
        self.roots = {u: to[i] for u, i in self.roots.items() if to[i] >= 0}
        self.below = {to[c >> 32] << 32 | c & 0xFFFFFFFF: to[i] for c, i in self.below.items() if to[i] >= 0}
        self.units, self.packed = [self.units[i] for i in stay.tolist()], [self.packed[i] for i in stay.tolist()]
        for x in (self.last, self.after, self.hits):
            x[: len(stay)] = x[stay]
        self.parent[: len(stay)] = number[self.parent[stay]]
        self.hits[: len(stay)] //= 2


class Encoder:
    def __init__(self, model: bytes, dropout: float = DROPOUT, seed: int = SEED):
        self.pieces, self.gaps, self.seed = Pieces(model), Gaps(dropout), seed
        self.trees = Trees(self.pieces, KEPT)

    def encode(self, texts: list[str | None], keys: list[int]) -> Iterator[bytes | None]:
        """Pieces of each text as packed numbers; keys: of documents, as 64-bit numbers."""
        first = 0
        while first < len(texts):
            last, size = first, 0
            while last < len(texts) and (last == first or size + len(texts[last] or "") <= RUN_CHARS):
                size += len(texts[last] or "")
                last += 1
            rows = [units_of(text or "") for text in texts[first:last]]
            packed, at = self._run(rows, np.array(keys[first:last], np.int64).view(np.uint64)), 0
            for units, text in zip(rows, texts[first:last], strict=True):
                yield None if text is None else b"".join(packed[at : at + len(units)])
                at += len(units)
            first = last

    def _run(self, rows: list[list[str]], keys: np.ndarray) -> list[bytes]:
        trees = self.trees
        trees.shrink()
        counts = np.array([len(units) for units in rows], np.int64)
        key = np.repeat(keys, counts)
        place = np.arange(len(key)) - np.repeat(np.cumsum(counts) - counts, counts)
        units = list(chain.from_iterable(rows))
        long = np.flatnonzero(np.fromiter(map(len, units), np.int64, len(units)) > LONG).tolist()
        alone = {i: self.pieces.shown(_agenda(self.pieces, units[i], self.gaps.one(int(key[i]), int(place[i])))) for i in long}
        for i in long:
            units[i] = "\n"

        def reach(which: np.ndarray, names: list, known: dict, last: np.ndarray, parent: np.ndarray, level: int) -> np.ndarray:
            """Move occurrences to the places of these names; those that have theirs alone are left out of what comes back."""
            found = np.fromiter(map(known.get, names, repeat(-1)), np.int64, len(names))
            missing = np.flatnonzero(found < 0)
            if len(missing):
                number: dict = {}
                which_name = np.array([number.setdefault(names[i], len(number)) for i in missing.tolist()])
                first = np.zeros(len(number), np.int64)
                first[which_name[::-1]] = missing[::-1]
                w = which[first]
                mine = [units[i] for i in w.tolist()]
                further = np.full((len(first), 1), NEVER, np.int32)
                once = np.bincount(which_name) == 1
                # an occurrence that is the only one is taken to its end at once
                if self.gaps.dropout and once.any():
                    further = np.where(once[:, None], self.gaps.skips(key[w], place[w], level, last[first], 4 * np.fromiter(map(len, mine), np.int64, len(mine))), NEVER).astype(np.int32)
                packed, places = trees.add(mine, last[first], parent[first], further)
                known.update(compress(zip(number, places.tolist(), strict=True), (places >= 0).tolist()))
                alone.update((i, packed[k]) for k, i in zip(np.flatnonzero(places < 0).tolist(), w[places < 0].tolist(), strict=True))
                found[missing] = places[which_name]
            at[which] = found
            trees.reached(found[found >= 0])
            return which[found >= 0]

        at, none = np.full(len(units), -1, np.int64), np.full(len(units), -1, np.int32)
        live, level = reach(np.arange(len(units)), units, trees.roots, none, none, 0), 0
        while len(live) and self.gaps.dropout:
            gaps = self.gaps.of(key[live], place[live], level)
            more = gaps < trees.after[at[live]]
            live, gaps, level = live[more], gaps[more], level + 1
            live = reach(live, (at[live] << 32 | gaps).tolist(), trees.below, trees.last[at[live]] + 1 + gaps.astype(np.int32), at[live].astype(np.int32), level)
        packed = list(map(trees.packed.__getitem__, at.tolist())) if trees.packed else [b""] * len(units)
        for i, x in alone.items():
            packed[i] = x
        return packed

    def decode(self, packed: list[bytes | None]) -> list[str | None]:
        p, out = self.pieces, []
        for first in range(0, len(packed), 100):
            some = packed[first : first + 100]
            ids = np.frombuffer(b"".join(x or b"" for x in some), p.dtype)
            sizes = p.sizes[ids]
            ends = np.concatenate([[0], np.cumsum(sizes)])
            data = p.bytes_of[np.arange(ends[-1]) + np.repeat(p.starts[ids] - ends[:-1], sizes)].tobytes()
            bounds = ends[np.cumsum([0, *(len(x or b"") // p.dtype.itemsize for x in some)])].tolist()
            out += [None if x is None else data[a:b][1:].decode("utf-8", "surrogatepass") for x, a, b in zip(some, bounds[:-1], bounds[1:], strict=True)]
        return out


def encoder(model: bytes, **options) -> Encoder:
    """A worker keeps its encoder, and what it has segmented, from task to task."""
    key, mine = (len(model), hash(model), *sorted(options.items())), kept.setdefault("pieces", {})
    if key not in mine:
        mine.clear()
        mine[key] = Encoder(model, **options)
    return mine[key]


def _encoded(check: bool, model, options: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(model.value, **options)
        for whole in batches:
            for at in range(0, len(whole), BATCH):  # what is in Python at once is small
                batch = whole.slice(at, BATCH)
                texts = batch.column("text").to_pylist()
                packed = list(e.encode(texts, batch.column("key").to_pylist()))
                counts = [None if p is None else len(p) // e.pieces.dtype.itemsize for p in packed]
                rest = batch.drop_columns(["key", "text"])
                columns, names = [*rest.columns, pa.array(packed, pa.binary()), pa.array(counts, pa.int64())], [*rest.schema.names, "pieces", "n_pieces"]
                if check:
                    back = e.decode(packed)
                    columns.append(pa.array([None if b is None else hashlib.sha256(b.encode("utf-8", "surrogatepass")).hexdigest() for b in back], pa.string()))
                    columns.append(pa.array([a == b for a, b in zip(texts, back, strict=True)]))
                    names += ["decoded_sha256", "lossless"]
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def _decoded(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(model.value)
        for batch in batches:
            text = e.decode(batch.column("pieces").to_pylist())
            rest = batch.drop_columns(["pieces"])
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(text, pa.string())], [*rest.schema.names, "decoded"])

    return run


def _sent(spark: SparkSession, model: str):
    small_batches(spark)
    return spark.sparkContext.broadcast(Path(model).read_bytes())  # half a MB, read where the driver is


def _carried(df: DataFrame, names: list[str]) -> tuple[list, str, list[str]]:
    """The columns under names of our own, their types, and the way back."""
    inner = [f"c{i}" for i in range(len(names))]
    return [df[f"`{n}`"].alias(c) for n, c in zip(names, inner, strict=True)], "".join(f"{c} {df.schema[n].dataType.simpleString()}, " for n, c in zip(names, inner, strict=True)), inner


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, model: str = MODEL, check: bool = False, by_row: bool = False, **options) -> DataFrame:
    """The columns in keep (all if None) with pieces (packed numbers) and n_pieces, in place and without a shuffle.

    check: also decodes, and adds decoded_sha256 and lossless. by_row: rows that repeat an id are decided for themselves,
    by their place in the files that docs reads. options: dropout, seed.
    """
    more = ["pieces", "n_pieces", *(["decoded_sha256", "lossless"] if check else [])]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in more]
    columns, kinds, inner = _carried(docs, keep)
    key = F.xxhash64(F.lit(options.get("seed", SEED)), docs[f"`{id_col}`"], *([F.monotonically_increasing_id()] if by_row else []))
    rows = docs.select(*columns, key.alias("key"), docs[f"`{text_col}`"].alias("text"))
    checked = ", decoded_sha256 string, lossless boolean" if check else ""
    out = rows.mapInArrow(released(_encoded(check, _sent(docs.sparkSession, model), options), keeps="pieces"), f"{kinds}pieces binary, n_pieces long{checked}")
    return out.select(*[F.col(c).alias(n) for c, n in zip(inner, keep, strict=True)], *more)


def decode(encoded: DataFrame, model: str = MODEL, pieces_col: str = "pieces") -> DataFrame:
    """encoded with the column decoded."""
    keep = [c for c in encoded.columns if c != "decoded"]
    columns, kinds, inner = _carried(encoded, keep)
    rows = encoded.select(*columns, encoded[f"`{pieces_col}`"].alias("pieces"))
    out = rows.mapInArrow(released(_decoded(_sent(encoded.sparkSession, model)), keeps="pieces"), f"{kinds}decoded string")
    return out.select(*[F.col(c).alias(n) for c, n in zip(inner, keep, strict=True)], "decoded")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode(docs, keep=["doc_id"], check=True).select("doc_id", "n_pieces", "pieces", "decoded_sha256", "lossless")
