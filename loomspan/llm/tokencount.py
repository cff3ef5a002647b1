"""Token counts of byte-level BPE tokenizers, by merges on a heap.

A text is cut where blanks follow other characters and marks follow letters, and there into
the stretches that the tokenizer's pattern gives; no merge crosses either cut. Each
distinct stretch is counted once: its bytes are symbols in a linked list, a heap
holds the adjacent pairs that merge, and the pair of the lowest rank, leftmost
first, is popped and merged until none is left. The count is the number of
bytes less the number of merges, so no ids are made. Special strings in a text
are one token each.
"""

from __future__ import annotations

import json
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches
from .words import BLANKS, text_slices, utf8

#: How a byte-level pre-tokenizer cuts a text. Fixed value of the tokenizer format.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Stretches of which a worker remembers the counts, twice over; forgetting costs time only.
MOST_UNITS = 500_000
#: Longest stretch, in bytes, that is remembered.
LONGEST = 256
_LETTER = np.array([b < 128 and chr(b).isalpha() for b in range(256)])
_MARK = np.array([b < 128 and not chr(b).isalnum() and not BLANKS[b] for b in range(256)])
_BLANK = regex.compile(r"\s")


def byte_symbols() -> list[str]:
    """The character that stands for each byte: itself where it can be seen, else the next from U+0100 on."""
    seen = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    other = iter(range(256, 512))
    return [chr(b if b in seen else next(other)) for b in range(256)]


class TokenCounter:
    """Counts as the tokenizers library does for the byte-level BPE model at ``path``, without added tokens, truncation or padding."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        self.spec = spec = json.loads(library.to_str())
        model, cut, added = spec["model"], spec["pre_tokenizer"] or {}, spec["added_tokens"]
        plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges"))
        plain = plain and cut.get("type") == "ByteLevel" and cut["use_regex"] and not cut["add_prefix_space"] and not spec["normalizer"]
        vocabulary, signs = model["vocab"], byte_symbols()
        if not plain or any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("only byte-level BPE models without normalisation or prefix space are supported")
        self.symbol = [vocabulary[s] for s in signs]
        self.byte_of = {s: b for b, s in enumerate(signs)}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.first, self.second, self.merged_id = zip(*((vocabulary[a], vocabulary[b], vocabulary[a + b]) for a, b in merges), strict=True)
        self.ranks: list[dict[int, int]] = [{} for _ in range(max(vocabulary.values()) + 1)]
        for rank, (one, other) in enumerate(zip(self.first, self.second, strict=True)):
            self.ranks[one][other] = rank
        self.cut = library.pre_tokenizer
        self.specials = regex.compile("|".join(regex.escape(t["content"]) for t in sorted(added, key=lambda t: -len(t["content"])))) if added else None
        self.pattern = regex.compile(PATTERN)
        self.marks = [t["content"].encode() for t in added]
        self.recent: dict[bytes, int] = {}
        self.older: dict[bytes, int] = {}
        self.odd: dict[str, bool] = {}

    def merged(self, data: bytes) -> int:
        """Number of tokens of one stretch."""
        n, bits, ranks = len(data), len(data).bit_length(), self.ranks
        if n < 2:
            return n
        symbols = [self.symbol[b] for b in data]
        symbols.append(-1)  # the end, which pairs with nothing
        after, before = list(range(1, n + 2)), list(range(-1, n))
        heap, one = [], symbols[0]
        for k, other in enumerate(symbols[1:]):
            rank = ranks[one].get(other)
            if rank is not None:
                heap.append(rank << bits | k)  # rank, then place, in one number
            one = other
        heapify(heap)
        left, places = n, (1 << bits) - 1
        while heap:
            top = heappop(heap)
            at, rank = top & places, top >> bits
            other = after[at]
            if symbols[at] != self.first[rank] or symbols[other] != self.second[rank]:
                continue  # one of the two has been merged since
            now = symbols[at] = self.merged_id[rank]
            symbols[other] = -2
            left -= 1
            follows = after[at] = after[other]
            before[follows] = at
            rank = ranks[now].get(symbols[follows])
            if rank is not None:
                heappush(heap, rank << bits | at)
            leads = before[at]
            if leads >= 0:
                rank = ranks[symbols[leads]].get(now)
                if rank is not None:
                    heappush(heap, rank << bits | leads)
        return left

    def _apart(self, c: str) -> bool:
        """Whether a text with this character is cut by the library: it is blank without being ASCII's, or the library, of another Unicode version, takes it for another class."""
        if c not in self.odd:
            same = [len(self.cut.pre_tokenize_str(x + c)) == len(self.pattern.findall(x + c)) for x in "a1!"]
            self.odd[c] = not all(same) or (bool(_BLANK.match(c)) and c not in " \t\n\v\f\r")
        return self.odd[c]

    def _keep(self, data: bytes, n: int) -> int:
        if len(data) <= LONGEST:
            if len(self.recent) >= MOST_UNITS:
                self.recent, self.older = {}, self.recent
            self.recent[data] = n
        return n

    def _stretch(self, data: bytes) -> int:
        n = self.recent.get(data)
        return self._keep(data, self.merged(data)) if n is None else n

    def _unit(self, unit: bytes) -> int:
        """Tokens of a stretch of words that the pattern may cut further."""
        n = self.older.get(unit)
        if n is None:
            parts = self.pattern.findall(unit.decode())
            n = self.merged(unit) if len(parts) == 1 else sum(self._stretch(x.encode()) for x in parts)
        return self._keep(unit, n)

    def _one(self, text: str) -> int:
        """Tokens of a text that holds special strings or odd characters."""
        parts = self.specials.split(text) if self.specials is not None else [text]
        stretches = (u for part in parts for u, _ in self.cut.pre_tokenize_str(part))
        return len(parts) - 1 + sum(self._stretch(bytes(self.byte_of[c] for c in u)) for u in stretches)

    def __call__(self, texts: list[bytes]) -> np.ndarray:
        whole = b"".join(texts)
        blob = np.frombuffer(whole, np.uint8)
        begins = np.cumsum([0] + [len(t) for t in texts])
        first = np.zeros(len(blob) + 1, bool)
        first[begins] = True
        blank = BLANKS[blob]
        first[1:-1] |= blank[1:] & ~blank[:-1]  # of blanks only a single space, in front, is in one stretch with other characters
        first[1:-1] |= _LETTER[blob[:-1]] & _MARK[blob[1:]]
        starts = np.flatnonzero(first)
        strings = pa.LargeBinaryArray.from_buffers(pa.large_binary(), max(len(starts) - 1, 0), [None, pa.py_buffer(starts), pa.py_buffer(blob)])
        told = strings.dictionary_encode()
        one_by_one = {}
        apart = {c for c in set(whole.decode()) if (c > "\x7f" or c < " ") and self._apart(c)}
        for k, text in enumerate(texts):
            if (apart and not apart.isdisjoint(text.decode())) or (self.specials is not None and any(x in text for x in self.marks)):
                one_by_one[k] = self._one(text.decode())
        sizes = np.fromiter((self._unit(u) if (n := self.recent.get(u)) is None else n for u in told.dictionary.to_pylist()), np.int64, len(told.dictionary))
        upto = np.concatenate(([0], np.cumsum(sizes[told.indices.to_numpy()])))[np.searchsorted(starts, begins)]
        counts = np.diff(upto)
        counts[list(one_by_one)] = list(one_by_one.values())
        return counts


@lru_cache(maxsize=1)
def counter(path: str) -> TokenCounter:
    """One for each Python worker, so that its later tasks know the stretches of earlier ones."""
    return TokenCounter(path)


def token_counts(docs: DataFrame, tokenizer_path: str, text_column: str = "text", limit: int = 1024) -> DataFrame:
    """Adds ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens) and drops the text.

    Whole texts are counted; null and empty ones have no tokens. Special strings
    inside a text count as one token each, as the library does by default. Other
    columns pass through; one that is called like a new column is replaced. Rows,
    ties and repeats stay; an empty table gives no rows.
    """
    added = ["n_bytes", "n_tokens", "over_limit"]
    rest = [c for c in docs.columns if c not in (*added, text_column)]
    asked = docs.select(*(F.col(f"`{c}`") for c in rest), F.coalesce(F.col(f"`{text_column}`"), F.lit("")).alias("__text"))
    asked = asked.withColumn("n_bytes", F.octet_length("__text").cast("long"))
    kept = [*rest, "n_bytes"]
    schema = asked.drop("__text").withColumn("n_tokens", F.lit(None).cast("long")).schema

    def run(batches):
        for batch in text_slices(batches, "__text"):
            counts = counter(tokenizer_path)(utf8(batch.column("__text")))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(counts, pa.int64())], [*kept, "n_tokens"])

    bounded_batches(docs.sparkSession)
    return asked.mapInArrow(run, schema).withColumn("over_limit", F.col("n_tokens") > limit)
