"""Periodic runs of words, by string synchronising sets.

A run is a longest stretch of consecutive words with smallest period q, at least
four times as long as q and six words or more. All texts of a batch are one flat
array of word codes with a sign of its own after each text, so a run never
leaves its text.

* Periods 1 to 3 are read off by comparing the words with themselves, shifted.
* Longer ones are found at scales t = 4, 8, 16 ...: those with t <= q < 2t. A
  position is chosen if, of the hashes of the windows of t words that begin in
  the t + 1 places from it on, the least is the first or the last. So whether it is
  chosen depends on its context of 2t words alone, and a run of such a period has
  a chosen position in every t places. Windows of a run with period t/4 or less,
  all of which smaller scales have found, are left out of the choice.
* Two neighbouring chosen positions of equal context propose their distance as
  a period. Overlapping proposals of one distance are chained, and the words
  themselves say how far the chain reaches.

The work is n log(n) in the number of words for each scale, whatever they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches
from .words import mix, text_slices, utf8

#: Least length of a run in words, and in periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Periods that are found by shifting; scales begin above.
SHIFTED = 3
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_ODD = np.uint64(0xA24BAED4963EE407)
#: Words compared at once when chains are followed.
_STEP = 1 << 20


def _stretches(same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each maximal stretch of True."""
    edges = np.flatnonzero(np.diff(np.concatenate(([False], same, [False])).astype(np.int8)))
    return edges[::2], edges[1::2]


def _shifted(words: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of periods up to ``SHIFTED``, all of which are primes or 1, as begins, lengths and periods."""
    for q in range(1, min(SHIFTED, len(words) - 1) + 1):
        begin, end = _stretches(words[:-q] == words[q:])
        length = end - begin + q
        long = length >= LEAST_PERIODS * q
        begin, length = begin[long], length[long]
        own = np.full(len(begin), q == 1)  # else no smaller period: the first q words aren't all equal
        for k in range(1, q):
            own |= words[begin] != words[begin + k]
        yield begin[own], length[own], np.full(int(own.sum()), q)


def _chosen(window: np.ndarray, covered: np.ndarray, t: int) -> np.ndarray:
    """Positions of which the first or last window is the least of ``t + 1``; ``covered`` windows don't count."""
    ids = np.where(covered, _NONE, window)
    least, wide = ids.copy(), 1
    while wide < t:  # doubles the number of windows that are seen
        least = np.minimum(least[:-wide], least[wide:])
        wide *= 2
    least = np.minimum(least[:-1], least[1:])
    n = len(least)
    return np.flatnonzero(((least == ids[:n]) | (least == ids[t : n + t])) & (least != _NONE))


def _chains(place: np.ndarray, context: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distance, begin and end of stretches that agree with what follows them at the distance."""
    order = np.argsort(context, kind="stable")
    place, context = place[order], context[order]
    apart = place[1:] - place[:-1]
    good = (context[1:] == context[:-1]) & (apart >= t) & (apart < 2 * t)
    at, apart = place[:-1][good], apart[good]
    order = np.lexsort((at, apart))
    at, apart = at[order], apart[order]
    first = np.ones(len(at), bool)
    first[1:] = (apart[1:] != apart[:-1]) | (at[1:] > at[:-1] + 2 * t)
    begin = np.flatnonzero(first)
    a, d = at[begin], apart[begin]
    b = at[np.append(begin[1:], len(at)) - 1] + 2 * t if len(at) else a
    reach = b - a + 2 * t + d >= LEAST_PERIODS * d  # each end of a run is less than t further
    return d[reach], a[reach], b[reach]


def _followed(words: np.ndarray, d: np.ndarray, a: np.ndarray, b: np.ndarray, t: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The longest stretches around each chain, word by word, that are long enough."""
    low, high = np.maximum(a - t, 0), np.minimum(b + t, len(words) - d)
    total = np.concatenate(([0], np.cumsum(high - low + 1)))
    done = 0
    while done < len(d):
        upto = max(done + 1, int(np.searchsorted(total, total[done] + _STEP, side="right")) - 1)
        part = slice(done, upto)
        size = high[part] - low[part] + 1  # one place more, where a chain ends
        start = np.cumsum(size) - size
        owner = np.repeat(np.arange(len(size)), size)
        place = np.arange(int(size.sum())) - start[owner] + low[part][owner]
        inside = place < high[part][owner]
        place = np.where(inside, place, 0)
        begin, end = _stretches((words[place] == words[place + d[part][owner]]) & inside)
        who = owner[begin]
        s, e = begin - start[who] + low[part][who], end - start[who] + low[part][who]
        period = d[part][who]
        good = (s < b[part][who]) & (e > a[part][who]) & (e - s + period >= LEAST_PERIODS * period)
        yield s[good], (e - s + period)[good], period[good]
        done = upto


def find_runs(codes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begins in ``codes``, lengths and periods of all runs of texts laid end to end, sorted by begin and period.

    ``codes`` are words as numbers from 0 on, ``offsets`` the bounds of the texts.
    """
    count = np.diff(offsets)
    n = len(codes) + len(count)
    words = np.empty(n, np.int64)
    ends = offsets[1:] + np.arange(len(count))  # places of the signs after the texts
    is_word = np.ones(n, bool)
    is_word[ends] = False
    words[is_word], words[ends] = codes, -1 - np.arange(len(count))
    source = np.where(is_word, np.cumsum(is_word) - 1, -1)  # places in codes
    room = np.repeat(count, count + 1)
    found = [[source[s], length, q] for s, length, q in _shifted(words)]
    known = [(s, length, q) for s, length, q in _shifted(words)]
    hashes, t = mix(words.astype(np.uint64)), 1
    while True:
        t *= 2
        if not len(words) or int(room.max()) < LEAST_PERIODS * t:
            break
        hashes[: -t // 2] = mix(hashes[: -t // 2] * _ODD + hashes[t // 2 :])  # of t words; those that reach beyond the end hold its sign
        keep = room >= LEAST_PERIODS * t  # shorter texts have no longer run
        if not keep.all():
            moved = np.cumsum(keep) - 1
            known = [(moved[s[k]], length[k], q[k]) for s, length, q in known for k in [keep[s]]]
            words, source, room, hashes = words[keep], source[keep], room[keep], hashes[keep]
        if t <= SHIFTED:
            continue
        covered = np.zeros(len(words) + 1, np.int64)
        for s, length, q in known:
            high = (q * 4 <= t) & (length >= t)
            np.add.at(covered, s[high], 1)
            np.add.at(covered, (s + length - t + 1)[high], -1)
        place = _chosen(hashes, np.cumsum(covered[:-1]) > 0, t)
        for s, length, q in _followed(words, *_chains(place, mix(hashes[place] * _ODD + hashes[place + t]), t), t):
            known.append((s, length, q))
            found.append([source[s], length, q])
    start, length, period = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 3
    good = length >= LEAST_WORDS
    order = np.lexsort((period[good], start[good]))
    return start[good][order], length[good][order], period[good][order]


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def runs_of(texts: list[bytes]) -> tuple[pa.Array, list[bytes]]:
    """Runs of each text, and its words without those that any run holds after its first period."""
    tokens = [t.split() for t in texts]  # at space, tab, LF, VT, FF and CR
    offsets = np.cumsum([0] + [len(t) for t in tokens])
    codes = pa.array([w for t in tokens for w in t], pa.large_binary()).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    start, length, period = find_runs(codes, offsets)
    change = np.zeros(len(codes) + 1, np.int64)
    np.add.at(change, start + period, 1)
    np.add.at(change, start + length, -1)
    gone = np.cumsum(change[:-1]) > 0
    owner = np.searchsorted(offsets, start, side="right") - 1
    bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
    values = pa.StructArray.from_arrays([pa.array(start - offsets[owner]), pa.array(length), pa.array(period)], ["start", "length", "period"])
    lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), values)
    left = []
    for k, own in enumerate(tokens):
        if bounds[k] < bounds[k + 1]:
            own = [own[i] for i in np.flatnonzero(~gone[offsets[k] : offsets[k + 1]]).tolist()]
        left.append(b" ".join(own))
    return lists.cast(_RUNS), left


def periodic_runs(docs: DataFrame, text_column: str = "text", runs_column: str = "runs", collapsed_column: str = "collapsed") -> DataFrame:
    """Adds ``runs_column``, array<struct<start, length, period>> by start and period, and ``collapsed_column``; drops the text.

    Words are ``[^\\x20\\x09-\\x0D]+``, numbered from 0. The collapsed text has the
    words that no run holds after its first period, joined by one space. Null and
    empty texts have no runs and an empty collapsed text. Other columns pass
    through; one that is called like a new column is replaced. Rows, ties and
    repeats stay; an empty table gives no rows. Texts are worked on whole, and
    each row on its own, so nothing is shuffled.
    """
    added = [runs_column, collapsed_column]
    rest = [c for c in docs.columns if c not in (*added, text_column)]
    asked = docs.select(*(F.col(f"`{c}`") for c in rest), F.col(f"`{text_column}`").alias("__text"))
    empty = {runs_column: F.lit(None).cast("array<struct<start:bigint,length:bigint,period:bigint>>"), collapsed_column: F.lit(None).cast("string")}
    schema = asked.drop("__text").withColumns(empty).schema

    def run(batches):
        for batch in text_slices(batches, "__text"):
            lists, left = runs_of(utf8(batch.column("__text")))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), lists, pa.array(left, pa.binary()).cast(pa.string())], [*rest, *added])

    bounded_batches(docs.sparkSession)
    return asked.mapInArrow(run, schema)
