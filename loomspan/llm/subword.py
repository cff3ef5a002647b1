"""SentencePiece BPE encoding and decoding in numpy, equal to the library's.

Texts are cut where no merge can cross: before a space that follows another
character, around line ends, and inside a word between characters that stand
side by side in no piece. Each distinct stretch of a batch is encoded once, all
of them together: flat arrays hold the symbols of every stretch, each round
finds the least pair rank of every segment, merges its pairs of that rank from
the left in all segments at once, and drops segments without a pair. Characters
without a piece become byte pieces. Decoding gathers piece bytes by table lookup.

The library pops the least rank, leftmost first. A round may merge all pairs of
the least rank if no pair with the merged piece has a lesser rank, else only the
leftmost. In a segment longer than ``reach`` symbols a pair need only be least
among the pairs within ``reach`` of it: no piece has more than half as many
characters, so nothing that is merged before it can come so far.
"""

from __future__ import annotations

import codecs
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches
from .words import UnitCache, text_slices, utf8

SPACE = "▁"
NO_PAIR = np.int64(1 << 40)


class Pieces:
    """Lookup tables of one BPE model with byte fallback and no text normalisation."""

    def __init__(self, path: str) -> None:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        model.ParseFromString(sentencepiece.SentencePieceProcessor(model_file=path).serialized_model_proto())
        kinds, norm = proto.ModelProto.SentencePiece, model.normalizer_spec
        plain = not norm.precompiled_charsmap and norm.add_dummy_prefix and not norm.remove_extra_whitespaces and norm.escape_whitespaces
        if model.trainer_spec.model_type != model.trainer_spec.BPE or not model.trainer_spec.byte_fallback or not plain or any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in model.pieces):
            raise ValueError("only BPE models with byte fallback, a dummy prefix, no normalisation and no user-defined or unused pieces are supported")
        self.size = len(model.pieces)
        normal = {p.piece: i for i, p in enumerate(model.pieces) if p.type == kinds.NORMAL}
        self.byte_id = np.zeros(256, np.int32)
        for i, p in enumerate(model.pieces):
            if p.type == kinds.BYTE:
                self.byte_id[int(p.piece[3:5], 16)] = i
        # symbols: piece ids, then characters that occur in pieces without being one
        chars = sorted({c for piece in normal for c in piece})
        symbol = dict(normal)
        for c in chars:
            symbol.setdefault(c, self.size + len(symbol))
        self.base = self.size + len(symbol) + 1
        self.chars = np.array([ord(c) for c in chars], np.int64)
        self.char_symbol = np.array([symbol[c] for c in chars], np.int64)
        scores = sorted({model.pieces[i].score for i in normal.values()}, reverse=True)
        order = {s: k for k, s in enumerate(scores)}
        pairs, beside = [], set()
        for piece, i in normal.items():
            beside.update(zip(piece, piece[1:], strict=False))
            for k in range(1, len(piece)):
                left, right = symbol.get(piece[:k]), symbol.get(piece[k:])
                if left is not None and right is not None:
                    pairs.append((left * self.base + right, order[model.pieces[i].score], i))
        pairs.sort()
        self.pair_key, self.pair_rank, self.pair_piece = (np.array(x, np.int64) for x in zip(*pairs, strict=True))
        # ranks of one piece, whose pairs with others all rank behind it
        rank_of = np.full(self.base, NO_PAIR)
        rank_of[self.pair_piece] = self.pair_rank
        self.apart = np.bincount(np.array([order[model.pieces[i].score] for i in normal.values()])) == 1
        for part in (self.pair_key // self.base, self.pair_key % self.base):
            early = self.pair_rank <= rank_of[part]
            self.apart[rank_of[part[early & (rank_of[part] < NO_PAIR)]]] = False
        self.reach = 2 * max(map(len, normal))
        self.beside = np.sort(np.array([ord(a) << 21 | ord(b) for a, b in beside], np.int64))
        # where a text may always be cut
        if any(b == SPACE and a != SPACE for a, b in beside):
            raise ValueError("pieces that hold a space inside are not supported")
        self.cut_lines = not any("\n" in ab for ab in beside)
        # bytes of each piece for decoding
        surface = []
        for i, p in enumerate(model.pieces):
            if p.type == kinds.BYTE:
                surface.append(bytes([int(p.piece[3:5], 16)]))
            elif p.type == kinds.UNKNOWN:
                surface.append(model.trainer_spec.unk_surface.encode())
            else:
                surface.append(b"" if p.type == kinds.CONTROL else p.piece.replace(SPACE, " ").encode())
        self.surface = np.frombuffer(b"".join(surface), np.uint8)
        self.surface_size = np.array([len(x) for x in surface], np.int64)
        self.surface_start = np.cumsum(self.surface_size) - self.surface_size
        self.is_control = np.array([p.type == kinds.CONTROL for p in model.pieces])
        self.spaced = np.array([p.type == kinds.NORMAL and p.piece.startswith(SPACE) for p in model.pieces])

    def _find(self, table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
        return at, table[at] == keys

    def encode_units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all units one after another, and the number of each."""
        codes = np.frombuffer("".join(units).encode("utf-32-le"), "<u4").astype(np.int64)
        unit = np.repeat(np.arange(len(units)), [len(u) for u in units])
        at, known = self._find(self.chars, codes)
        symbols = np.where(known, self.char_symbol[at], self.base - 1)
        joined = self._find(self.beside, codes[:-1] << 21 | codes[1:])[1] & (unit[:-1] == unit[1:])
        bounds = np.concatenate(([0], np.flatnonzero(~joined) + 1, [len(codes)])) if len(codes) else np.zeros(1, np.int64)
        place, out = self._merge(symbols, bounds)
        whole = out < self.size
        ids, sizes = out.astype(np.int32), np.ones(len(out), np.int64)
        pieces = [b"" if w else chr(codes[p]).encode() for w, p in zip(whole, place, strict=True)] if not whole.all() else None
        if pieces is not None:
            sizes = np.array([len(p) or 1 for p in pieces], np.int64)
            ids = np.repeat(ids, sizes)
            ids[~np.repeat(whole, sizes)] = self.byte_id[np.frombuffer(b"".join(pieces), np.uint8)]
        return ids, np.bincount(np.repeat(unit[place], sizes), minlength=len(units))

    def _merge(self, symbols: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merges every segment to the end; gives first places and symbols in text order."""
        size = np.diff(bounds)
        single = bounds[:-1][size == 1]
        done = [(single, symbols[single])]
        for work, wide in (((size > 1) & (size <= self.reach), False), (size > self.reach, True)):
            if work.any():
                done += self._rounds(symbols, bounds[:-1][work], size[work], wide)
        places, values = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(places)
        return places[order], values[order]

    def _rounds(self, symbols: np.ndarray, begin: np.ndarray, size: np.ndarray, wide: bool) -> list[tuple[np.ndarray, np.ndarray]]:
        """Rounds over segments of ``size`` symbols from ``begin``; ``wide`` compares pairs within reach only."""
        done = []
        place = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        current = symbols[place]
        at, hit = self._find(self.pair_key, current[:-1] * self.base + current[1:])
        rank, piece = np.full(len(current), NO_PAIR), np.zeros(len(current), np.int64)
        hit[(np.cumsum(size) - 1)[:-1]] = False
        rank[:-1][hit], piece[:-1][hit] = self.pair_rank[at[hit]], self.pair_piece[at[hit]]
        while len(size):
            start = np.cumsum(size) - size
            least = np.minimum.reduceat(rank, start)
            alive = least < NO_PAIR
            near = _least_within(rank, np.repeat(np.arange(len(size)), size), self.reach) if wide else np.repeat(least, size)
            spot = np.flatnonzero((rank == near) & (rank < NO_PAIR))
            owner = np.searchsorted(start, spot, side="right") - 1
            spot, owner = self._together(spot, owner, rank, least)
            current[spot] = piece[spot]
            keep = np.repeat(alive, size)
            done.append((place[~keep], current[~keep]))
            keep[spot + 1] = False
            moved = np.cumsum(keep) - 1
            size = (size - np.bincount(owner, minlength=len(size)))[alive]
            place, current, rank, piece = place[keep], current[keep], rank[keep], piece[keep]
            # only pairs beside a merge have changed
            last = np.zeros(len(current) + 1, bool)
            last[np.cumsum(size) - 1] = True
            spot = moved[spot]
            fresh = np.concatenate((spot, spot[spot > 0] - 1))
            inner = fresh[~last[fresh]]
            rank[fresh] = NO_PAIR
            at, hit = self._find(self.pair_key, current[inner] * self.base + current[inner + 1])
            rank[inner[hit]], piece[inner[hit]] = self.pair_rank[at[hit]], self.pair_piece[at[hit]]
        return done

    def _together(self, spot: np.ndarray, owner: np.ndarray, rank: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the least pairs of each segment those that one round may merge: they don't overlap, and the rest would follow anyway."""
        first = np.ones(len(spot), bool)  # the leftmost least pair of a segment
        lowest = np.flatnonzero(rank[spot] == least[owner])
        first[lowest[1:]] = owner[lowest[1:]] != owner[lowest[:-1]]
        first[rank[spot] > least[owner]] = False
        same = rank[spot - 1] == rank[spot]
        same[spot == 0] = False
        follows = np.zeros(len(spot), bool)
        follows[1:] = same[1:] & (spot[1:] == spot[:-1] + 1)
        head = np.flatnonzero(~follows)
        run = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(spot))))
        cut = (same & ~follows)[head]  # an overlapping pair before the run has to wait
        even = ((np.arange(len(spot)) - head[run]) % 2 == 0) & ~cut[run]
        pick = first | (even & self.apart[rank[spot]])
        return spot[pick], owner[pick]


def _least_within(rank: np.ndarray, segment: np.ndarray, reach: int) -> np.ndarray:
    """Least rank among the pairs up to ``reach`` places before or after, of the same segment."""
    left, right, wide = rank.copy(), rank.copy(), 1
    while wide <= reach:  # each step doubles the width that is seen
        same = segment[wide:] == segment[:-wide]
        ahead, behind = right[wide:].copy(), left[:-wide].copy()
        right[:-wide][same] = np.minimum(right[:-wide][same], ahead[same])
        left[wide:][same] = np.minimum(left[wide:][same], behind[same])
        wide *= 2
    return np.minimum(left, right)


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One for each Python worker, so that its later tasks know the words of earlier ones."""
    return Encoder(pieces(path))


class Encoder:
    """Encodes batches of texts, remembering the stretches it has seen."""

    def __init__(self, model: Pieces) -> None:
        self.model = model
        self.cache = UnitCache(lambda units: model.encode_units([u.decode().replace(" ", SPACE) for u in units]), most_units=240_000)  # idle workers keep it

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all texts one after another, and ``len(texts) + 1`` offsets."""
        marked = [b" " + t.replace(SPACE.encode(), b" ") if t else t for t in texts]
        blob = np.frombuffer(b"".join(marked), np.uint8)
        begins = np.cumsum([0] + [len(t) for t in marked])
        first = np.zeros(len(blob) + 1, bool)
        first[begins] = True
        space = blob == 32
        first[1:-1] |= space[1:] & ~space[:-1]
        if self.model.cut_lines:
            line = blob == 10
            first[:-1] |= line
            first[1:] |= line
        starts = np.flatnonzero(first)
        rows, which = self.cache.find(blob, np.diff(starts))
        starts = starts[:-1]
        ids, size = self.cache.tokens(rows[which])
        upto = np.concatenate(([0], np.cumsum(size)))
        return ids, upto[np.searchsorted(starts, begins)]


def _one_by_one(error: UnicodeDecodeError) -> tuple[str, int]:
    return "�", error.start + 1


def decode_ids(model: Pieces, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
    """Texts of id lists laid end to end; each byte that is no valid UTF-8 becomes U+FFFD."""
    codecs.register_error("each-byte", _one_by_one)
    size = model.surface_size[ids]
    upto = np.concatenate(([0], np.cumsum(size)))
    data = model.surface[np.repeat(model.surface_start[ids] - upto[:-1], size) + np.arange(int(upto[-1]))].tobytes()
    texts = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        k = a
        while k < b and model.is_control[ids[k]]:
            k += 1
        begin = upto[a] + (1 if k < b and model.spaced[ids[k]] else 0)
        texts.append(data[begin : upto[b]].decode("utf-8", "each-byte"))
    return texts


def encode(docs: DataFrame, model_path: str, text_column: str = "text", ids_column: str = "ids", decoded_column: str | None = None) -> DataFrame:
    """Adds ``ids_column`` (array<int>): the whole text encoded, without begin or end ids or sampling.

    ``decoded_column``, if named, is what the ids decode to, without a second
    pass through Python. Null and empty texts have no ids. Other columns pass
    through; one that is already called like a new column is replaced, and the
    text too if ``decoded_column`` has its name. Rows, ties and repeats stay; an
    empty table gives no rows.
    """
    added = [ids_column] + ([decoded_column] if decoded_column else [])
    rest = [c for c in docs.columns if c not in added]
    needed = docs.select(*(F.col(f"`{c}`") for c in dict.fromkeys([*rest, text_column])))
    schema = docs.select(*(F.col(f"`{c}`") for c in rest)).withColumn(ids_column, F.lit(None).cast("array<int>"))
    schema = (schema.withColumn(decoded_column, F.lit(None).cast("string")) if decoded_column else schema).schema

    def run(batches):
        for batch in text_slices(batches, text_column):
            ids, offsets = encoder(model_path)(utf8(batch.column(text_column)))
            columns = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))]
            if decoded_column:
                columns.append(pa.array(decode_ids(pieces(model_path), ids, offsets), pa.string()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), *columns], [*rest, *added])

    bounded_batches(docs.sparkSession)
    return needed.mapInArrow(run, schema)


def decode(df: DataFrame, model_path: str, ids_column: str = "ids", text_column: str = "decoded") -> DataFrame:
    """Adds ``text_column``: the text of each id list; a null or empty list gives an empty text.

    Other columns pass through; one that is already called ``text_column`` is replaced.
    """
    rest = [c for c in df.columns if c != text_column]
    schema = df.select(*(F.col(f"`{c}`") for c in rest)).withColumn(text_column, F.lit(None).cast("string")).schema

    def run(batches):
        model = pieces(model_path)
        for batch in text_slices(batches, ids_column):
            lists = batch.column(ids_column)
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            offsets = np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))))
            texts = decode_ids(model, flat, offsets)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(texts, pa.string())], [*rest, text_column])

    bounded_batches(df.sparkSession)
    return df.select(*(F.col(f"`{c}`") for c in rest)).mapInArrow(run, schema)
