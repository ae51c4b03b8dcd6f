"""Exact substring deduplication with a run-length index (r-index).

Every byte covered by a `length`-byte string that also starts in a document with a smaller doc_id is removed. Plan:

1. Anchors. Of the KMER-byte strings inside a window of `length` bytes the one with the least hash owns it, so equal windows have
   equal owners at equal places. Documents are dealt to buckets once, and that exchange is used three times. Each bucket sends
   its different anchor hashes, in shards by hash; a shard answers with those that occur in more than one document.
2. Index. A bucket sends, for those anchors only, the different contexts (the bytes of the windows that an anchor owns) with
   the least doc_id of each. A shard so holds all windows of its anchors. Where an anchor has contexts of several documents, the contexts
   are grouped by the bytes next to the anchor that they have to share, and ranked by their least doc_id. Each has to be compared with those of smaller rank: for each bit of the rank, contexts with
   the bit unset go into the index and those with the bit set, and the same higher bits, are streamed against it. In place of the anchor's
   bytes stands a symbol of its own for each such comparison, so one index serves many of them. The index is a run-compressed Burrows-Wheeler
   transform with suffix-array samples at run ends; matching statistics are streamed, all contexts a byte at a time, and where
   the match at the sampled place has as many symbols as a window, the window occurs in an earlier document. Nothing else decides.
3. Answers go back by bucket: the least doc_id of each context and a mask of its windows that occur earlier. With the contexts a bucket sends
   itself where its documents have which of them, so they aren't made again. A document removes
   those windows, and all windows of contexts that an earlier document has.

Buckets and shards are as many as the bytes ask for, whatever the session's partitions, and a message is never empty, so there
are never more messages than anchors. A bucket sends a context once however many of its documents hold it, so copies and common
passages don't pile up in a task. An anchor of HOT documents or more is split by the windows it owns, each of which is
a context of its own, so that no shard has to hold all surroundings of a very common string.

Defined cases: null text is empty; texts under `length` bytes lose nothing; a null doc_id is after all others; equal doc_ids
aren't smaller than each other, so repeated rows keep their text alike; matches never cross documents; an empty table
gives no row; extra columns are ignored; very long texts are hashed in blocks.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.llm.common import small_batches, table

LENGTH, KMER = 50, 24
#: Text bytes of a bucket, and shards for each bucket.
BUCKET_BYTES, SHARDS = 12 << 20, 2
#: Documents with an anchor from which on its windows are sent one by one.
HOT = 1 << 14
#: Strings that are compared in one index, and kinds of groups of them.
PART, PARTED = 1 << 14, 3
BLOCK = 1 << 15
#: Symbols from here on tell comparisons apart; below are bytes, shifted by one, and the terminator zero.
TAGS = 257
_PLACE = np.uint64((1 << 22) - 1)
_R = 0x9E3779B97F4A7C15 | 1
_LAST = np.iinfo(np.int64).max


# ---- anchors


def _kmer_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """A mixed 64-bit hash of each k-byte string: polynomials by doubling, from eight bytes read as one word where k is as much."""
    if k < 8:
        powers, size = {1: data.astype(np.uint64) + np.uint64(1)}, 1
    else:
        word = np.ndarray(len(data) - 7, np.uint64, data, strides=(1,)) * np.uint64(_R)
        word ^= word >> np.uint64(32)
        powers, size = {8: word}, 8
    while size * 2 <= k:
        h = powers[size]
        powers[size * 2] = h[:-size] * np.uint64(pow(_R, size, 1 << 64))
        powers[size * 2] += h[size:]
        size *= 2
    h, at = powers[size], size
    least = min(powers)
    # what is left over is read anew with some bytes that count already
    while at < k:
        part = max(least, 1 << ((k - at).bit_length() - 1))
        at = min(at + part, k)
        tail = powers[part][at - part :]
        h = h[: len(tail)] * np.uint64(pow(_R, part, 1 << 64))
        h += tail
    return _mixed(h)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(29))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    return np.minimum(values[: len(values) - (width - size)], values[width - size :])


def anchors(raw: bytes, length: int = LENGTH, kmer: int = KMER, ends: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first window, past the last window, place of the anchor) of each stretch of windows with one owner. Texts that are joined have their ends given, and no window is in two of them."""
    out: list[tuple[np.ndarray, ...]] = []
    data = np.frombuffer(raw, dtype=np.uint8)
    windows = max(0, len(raw) - length + 1)
    ends = np.array([len(raw)]) if ends is None else ends
    # windows that reach over an end
    over = np.zeros(windows, dtype=bool)
    for a, b in zip(np.maximum(np.r_[0, ends[:-1]], ends - length + 1).tolist(), ends.tolist(), strict=True):
        over[a:b] = True
    for begin in range(0, windows, BLOCK):
        h = _kmer_hashes(data[begin : begin + BLOCK + length - 1], kmer)
        place = h & ~_PLACE
        place |= np.arange(len(h), dtype=np.uint64)
        least = _sliding_least(place, length - kmer + 1)
        not_one = over[begin : begin + BLOCK]
        new = least[1:] != least[:-1]
        new |= not_one[1:] != not_one[:-1]
        first = np.flatnonzero(np.r_[True, new])
        past = np.r_[first[1:], len(least)]
        one = ~not_one[first]
        first, past = first[one], past[one]
        owner = (least[first] & _PLACE).astype(np.int64)
        # owners have small hashes; mixed again they spread over the shards
        own = h[owner] * np.uint64(0xD6E8FEB86659FD93)
        out.append(((own ^ (own >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93), begin + first, begin + past, begin + owner))
    if not out:
        return np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 3
    own, first, past, owner = (np.concatenate(x) for x in zip(*out, strict=True))
    # a block's end is no stretch's
    new = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (first[1:] != past[:-1])][: len(owner)])
    return own[new], first[new], past[np.r_[new[1:], len(owner)] - 1] if len(new) else past, owner[new]


# ---- the run-length index


class RunLengthIndex:
    """Burrows-Wheeler transform of a collection of short strings as runs, with suffix-array samples at both ends of each run.

    Strings are rows of a zero-padded matrix of symbols above zero, suffixes end in terminators ordered by string. Positions are row * width + offset."""

    def __init__(self, strings: np.ndarray, sizes: np.ndarray) -> None:
        self.text, self.sizes = strings, sizes
        m, width = strings.shape
        self.width = width
        where = np.flatnonzero((np.arange(width)[None, :] <= sizes[:, None]).ravel())
        suffixes = self._order(strings, where)
        bwt = np.where(suffixes % width == 0, 0, strings.ravel()[np.maximum(suffixes - 1, 0)]).astype(np.int64)
        starts = np.flatnonzero(np.r_[True, bwt[1:] != bwt[:-1]])
        ends = np.r_[starts[1:], len(bwt)]
        heads = bwt[starts]
        order = np.lexsort((starts, heads))
        self.rows = len(bwt)
        self.head, self.start, self.run = heads[order], starts[order], (ends - starts)[order]
        self.sample_first, self.sample_last = suffixes[starts][order], suffixes[ends - 1][order]
        before = np.cumsum(self.run) - self.run
        self.earlier = before - before[np.searchsorted(self.head, self.head)]
        # rows that start with smaller symbols; every string has a row for its terminator
        counts = np.bincount(bwt[bwt > 0], minlength=TAGS)
        self.smaller = m + np.cumsum(counts) - counts
        self.key = self.head * self.rows + self.start

    @staticmethod
    def _order(strings: np.ndarray, where: np.ndarray) -> np.ndarray:
        """The order of the suffixes at `where`: as many symbols as fit into a word, then as many ranks as fit, of the suffixes that are still tied."""
        m, width = strings.shape
        held = np.zeros(int(strings.max(initial=0)) + 1, dtype=bool)
        held[strings.ravel()] = True
        units, depth, top = (np.cumsum(held) - held[0])[strings], 1, int(held.sum())
        order = tied = None
        while True:
            many = min(63 // top.bit_length(), -(-width // depth))
            key = np.zeros((m, width), dtype=np.int64)
            for i in range(many):
                key <<= top.bit_length()
                if i * depth < width:
                    key[:, : width - i * depth] |= units[:, i * depth :]
            key, depth = key.ravel(), depth * many
            if order is None:
                order = where[np.argsort(key[where])]
                last = key[order]
                start = np.r_[True, last[1:] != last[:-1]]
            else:
                # keys begin with the ranks, so groups of tied suffixes stay where they are
                some = order[tied]
                last = key[some]
                by = np.argsort(last)
                order[tied], last = some[by], last[by]
                start[tied] |= np.r_[True, last[1:] != last[:-1]]
            rank = np.cumsum(start)
            tied = np.flatnonzero(~start | ~np.r_[start[1:], True])
            if depth >= width or not len(tied):
                # equal suffixes by string
                order[tied] = order[tied][np.argsort(rank[tied] * (m * width) + order[tied])]
                return order
            top = int(rank[-1])
            units = np.zeros(m * width, dtype=np.int64)
            units[order] = rank
            units = units.reshape(m, width)

    def common(self, patterns: np.ndarray, at: np.ndarray, places: np.ndarray, most: int) -> np.ndarray:
        """Symbols that the patterns' places `at` and the text's `places` have in common, `most` at most. Strings end in zero, so none reaches the next one."""
        steps = np.arange(most)[None, :]
        x = patterns.take(at[:, None] + steps, mode="clip")
        other = (x != self.text.take(places[:, None] + steps, mode="clip")) | (x == 0)
        return np.where(other.any(axis=1), other.argmax(axis=1), most)

    def matching_statistics(self, patterns: np.ndarray, sizes: np.ndarray, most: int) -> np.ndarray:
        """For each symbol of each pattern, from the right, a text position where the longest match of what follows (as far as
        `most` symbols) starts; -1 without any."""
        order = np.argsort(-sizes, kind="stable")
        patterns, sizes = patterns[order], sizes[order]
        m, width = patterns.shape
        columns = np.ascontiguousarray(patterns.T).astype(np.int64)
        found = np.full((width, m), -1, dtype=np.int64)
        q_all, sa_all = np.zeros(m, dtype=np.int64), np.full(m, -1, dtype=np.int64)
        last = len(self.head) - 1
        for off in range(width - 1, -1, -1):
            n = int(np.searchsorted(-sizes, -off, side="left"))  # those with more than off symbols
            if not n:
                continue
            c, q, sa = columns[off, :n], q_all[:n], sa_all[:n]
            j = np.searchsorted(self.key, c * self.rows + q, side="right") - 1
            at = np.maximum(j, 0)
            held = (j >= 0) & (self.head[at] == c)
            move = np.flatnonzero(~(held & (q < self.start[at] + self.run[at]) & (sa >= 0)))
            if len(move):
                pick = j[move]
                nxt = np.minimum(pick + 1, last)
                down, up = held[move], (pick < last) & (self.head[nxt] == c[move])
                both = np.flatnonzero(down & up)
                if len(both):
                    after = move[both] * width + off + 1
                    upper = self.common(patterns, after, self.sample_first[nxt[both]], most) > self.common(patterns, after, self.sample_last[pick[both]], most)
                    up[both], down[both] = upper, ~upper
                chosen = np.where(down, pick, nxt)
                q[move] = np.where(down, self.start[chosen] + self.run[chosen] - 1, self.start[chosen])
                sa[move] = np.where(down, self.sample_last[chosen], self.sample_first[chosen])
                j[move] = chosen
                lost = move[~(down | up)]
                q[lost], sa[lost], j[lost] = 0, -1, -1
            good = slice(None) if not len(move) or j.min() >= 0 else np.flatnonzero(j >= 0)
            run = j[good]
            q[good] = self.smaller[c[good]] + self.earlier[run] + q[good] - self.start[run]
            sa[good] -= 1
            found[off, :n] = sa
        out = np.empty((m, width), dtype=np.int64)
        out[order] = found.T
        return out

    def occurs(self, patterns: np.ndarray, sizes: np.ndarray, length: int) -> np.ndarray:
        """For each place of each pattern whether the `length` symbols from there on occur in the text."""
        out = np.zeros(patterns.shape, dtype=bool)
        for begin in range(0, len(patterns), 1 << 15):
            part, size = patterns[begin : begin + (1 << 15)], sizes[begin : begin + (1 << 15)]
            found = self.matching_statistics(part, size, length)
            rows, offs = np.nonzero((np.arange(part.shape[1])[None, :] + length <= size[:, None]) & (found >= 0))
            whole = self._equal(part, rows, offs, found[rows, offs], length)
            out[begin + rows[whole], offs[whole]] = True
        return out

    def _equal(self, patterns: np.ndarray, rows: np.ndarray, offs: np.ndarray, places: np.ndarray, length: int) -> np.ndarray:
        """Those whose `length` symbols are the text's at places."""
        keep = np.flatnonzero((places % self.width) + length <= self.sizes[places // self.width])
        flat, own, text = patterns.ravel(), rows * patterns.shape[1] + offs, self.text.ravel()
        for i in range(length - 1, -1, -1):
            ok = flat[own[keep] + i] == text[places[keep] + i]
            if not ok.all():
                keep = keep[ok]
        return keep


def comparisons(group: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(member, tag, later): every two members of one group with different least doc_ids share exactly one tag, the
    smaller doc_id's as earlier and the other's as later. A member has no more tags than its group's size has bits."""
    order = np.lexsort((least, group))
    g, x = group[order], least[order]
    opens = np.r_[True, g[1:] != g[:-1]]
    step = np.cumsum(opens | np.r_[True, x[1:] != x[:-1]])
    number = np.cumsum(opens) - 1
    rank = step - step[opens][number]
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))]
    tags = 0
    for bit in range(int(rank.max(initial=0)).bit_length()):
        block, later = rank >> (bit + 1), (rank >> bit & 1).astype(bool)
        of = np.cumsum(np.r_[True, (number[1:] != number[:-1]) | (block[1:] != block[:-1])]) - 1
        both = (np.bincount(of, later) > 0) & (np.bincount(of, ~later) > 0)
        kept = np.flatnonzero(both[of])
        out.append((order[kept], tags + (np.cumsum(both) - 1)[of[kept]], later[kept]))
        tags += int(both.sum())
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _sides(matrix: np.ndarray, sizes: np.ndarray, anchor: np.ndarray, place: np.ndarray, length: int, kmer: int) -> tuple[np.ndarray, np.ndarray]:
    """(context, group): strings of one anchor that share a window have so many bytes before and behind it in common, as many as the window has outside of the anchor.
    Whatever part of them lies before it, they share the bytes next to it of one of PARTED kinds, so they share a group by these. Groups within a group of another kind are left
    out, and strings that are alone in a group."""
    flat, width = matrix.ravel(), matrix.shape[1]
    outside = length - kmer
    step = -(-(outside + 1) // PARTED)
    contexts, groups = [], []
    known: list[np.ndarray] = []
    for kind in range(PARTED):
        before, behind = kind * step, max(0, outside + 1 - (kind + 1) * step)
        rows = np.flatnonzero((place >= before) & (sizes - place - kmer >= behind))
        h = anchor[rows].astype(np.uint64) * np.uint64(_R)
        own = rows * width + place[rows]
        for i in (*range(-before, 0), *range(kmer, kmer + behind)):
            h = _mixed(h * np.uint64(_R) + flat[own + i].astype(np.uint64))
        # anchors are exact, hashes needn't be
        order = np.lexsort((h, anchor[rows]))
        new = np.r_[True, (h[order][1:] != h[order][:-1]) | (anchor[rows][order][1:] != anchor[rows][order][:-1])][: len(order)]
        starts = np.flatnonzero(new)
        if not len(starts):
            continue
        of = np.cumsum(new) - 1
        kept = np.bincount(of) > 1
        for other in known:
            mine = other[rows[order]]
            least = np.minimum.reduceat(mine, starts)
            kept &= (least < 0) | (least != np.maximum.reduceat(mine, starts))
        some = kept[of]
        contexts.append(rows[order][some])
        groups.append(of[some] + sum(len(x) for x in groups) + len(matrix) * kind)
        mine = np.full(len(matrix), -1)
        mine[contexts[-1]] = groups[-1]
        known.append(mine)
    return np.concatenate(contexts or [np.zeros(0, np.int64)]), np.concatenate(groups or [np.zeros(0, np.int64)])


def _kmers(matrix: np.ndarray, anchor: np.ndarray, place: np.ndarray, kmer: int) -> np.ndarray:
    """Numbers of strings' anchors by their bytes, where anchors of one hash may differ."""
    _, first, of = np.unique(anchor, return_index=True, return_inverse=True)
    own = matrix.ravel()[(np.arange(len(matrix)) * matrix.shape[1] + place)[:, None] + np.arange(kmer)[None, :]]
    if (own == own[first[of]]).all():
        return of
    return np.unique(np.c_[of, own], axis=0, return_inverse=True)[1].ravel()


def occurs_earlier(strings: list[bytes], anchor: np.ndarray, place: np.ndarray, least: np.ndarray, length: int, kmer: int) -> np.ndarray:
    """For each string a mask of its windows that occur in a string of its anchor with a smaller least doc_id. Strings of one comparison have one anchor, so a symbol is enough for it."""
    masks = np.zeros(len(strings), dtype=np.int64)
    _, of, counts = np.unique(anchor, return_inverse=True, return_counts=True)
    some = np.flatnonzero(counts[of] > 1)
    if not len(some):
        return masks
    sizes, place = np.array([len(strings[i]) for i in some.tolist()], dtype=np.int64), place[some]
    matrix = np.zeros((len(some), int(sizes.max()) + 1), dtype=np.int32)
    matrix[np.arange(matrix.shape[1])[None, :] < sizes[:, None]] = np.frombuffer(b"".join([strings[i] for i in some.tolist()]), np.uint8).astype(np.int32) + 1
    member, group = _sides(matrix, sizes, _kmers(matrix, anchor[some], place, kmer), place, length, kmer)
    if not len(member):
        return masks
    entry, tag, later = comparisons(group, least[some][member])
    context = member[entry]
    # one symbol instead of the anchor's bytes
    behind = np.arange(matrix.shape[1] - kmer + 1)[None, :]
    behind = np.where(behind > place[:, None], behind + kmer - 1, behind)
    matrix, sizes = np.take_along_axis(matrix, behind, axis=1), sizes - kmer + 1
    order = np.argsort(tag, kind="stable")
    context, tag, later = context[order], tag[order], later[order]
    if not len(tag):
        return masks
    # a part holds whole comparisons, and more than PART strings only for one that has more
    opens = np.flatnonzero(np.r_[True, tag[1:] != tag[:-1]])
    cuts = np.unique(np.searchsorted(opens, np.arange(0, len(tag), PART)))
    cuts = opens[cuts[cuts < len(opens)]].tolist()

    def tagged(rows: np.ndarray, tags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        symbols = matrix[rows]
        symbols[np.arange(len(rows)), place[rows]] = TAGS + tags
        return symbols, sizes[rows]

    for a, b in zip(cuts, [*cuts[1:], len(tag)], strict=True):
        c, t, x = context[a:b], tag[a:b] - tag[a], later[a:b]
        hit, off = np.nonzero(RunLengthIndex(*tagged(c[~x], t[~x])).occurs(*tagged(c[x], t[x]), length - kmer + 1))
        np.bitwise_or.at(masks, some[c[x][hit]], np.int64(1) << off)
    return masks


# ---- what is sent

_CODEC = "zstd"


def _pack(values: np.ndarray) -> bytes:
    """Integers by byte planes, compressed."""
    wide = np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.dtype.itemsize)
    return len(wide).to_bytes(8, "little") + pa.compress(np.ascontiguousarray(wide.T).tobytes(), codec=_CODEC, asbytes=True)


def _unpack(blob: bytes, kind: type) -> np.ndarray:
    size, n = np.dtype(kind).itemsize, int.from_bytes(blob[:8], "little")
    planes = pa.decompress(blob[8:], decompressed_size=n * size, codec=_CODEC, asbytes=True)
    return np.frombuffer(np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(size, -1).T).tobytes(), kind)


def _pack_sorted(values: np.ndarray) -> bytes:
    return _pack(np.diff(values, prepend=np.uint64(0)))


def _unpack_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(_unpack(blob, np.uint64), dtype=np.uint64)


def _shard(hashes: np.ndarray, shards: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)


def _found(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Whether each value is among sorted ones."""
    return among[np.minimum(np.searchsorted(among, values), len(among) - 1)] == values if len(among) else np.zeros(len(values), dtype=bool)


def _split(raw: bytes, found: tuple[np.ndarray, ...], hot: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Stretches, where those of hot anchors are cut into windows that are anchors of their own."""
    hashes, begin, end, owner = found
    common = _found(hashes, hot)
    if not common.any():
        return found
    wide = np.where(common, end - begin, 1)
    row = np.repeat(np.arange(len(wide)), wide)
    step = np.arange(len(row)) - np.repeat(np.cumsum(wide) - wide, wide)
    cut = common[row]
    start = begin[row] + step
    own = np.array([int.from_bytes(hashlib.blake2b(raw[b : b + length], digest_size=8).digest(), "little") for b in start[cut].tolist()], dtype=np.uint64)
    hashes = hashes[row]
    hashes[cut] = own
    return hashes, start, np.where(cut, start + 1, end[row]), np.where(cut, start, owner[row])


def _in_order(docs: pd.DataFrame) -> list[int]:
    """Documents' places by key and text, which are the same wherever a bucket is read."""
    keys, raws = docs["key"].tolist(), docs["raw"].tolist()
    return sorted(range(len(keys)), key=lambda i: (keys[i], raws[i]))


def _buffers(texts: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """Where texts begin (and the last one ends), and their bytes."""
    _, cuts, data = texts.buffers()
    cuts = np.frombuffer(cuts, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    return cuts, np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


class _Contexts:
    """The different contexts of a bucket's repeated anchors by shard, and the stretches of the joined documents with the contexts' places.
    Equal contexts have equal owners, so bytes decide the shard."""

    def __init__(self, docs: pd.DataFrame, repeated: np.ndarray, hot: np.ndarray, shards: int, length: int, kmer: int) -> None:
        texts = docs["raw"].tolist()
        order = _in_order(docs)
        raw = b"".join([texts[i] for i in order])
        ends = np.cumsum([len(texts[i]) for i in order])
        found = anchors(raw, length, kmer, ends)
        kept = np.flatnonzero(_found(found[0], repeated))
        hashes, self.begin, self.end, owner = _split(raw, tuple(x[kept] for x in found), hot, length)
        found = pa.array([raw[a:b] for a, b in zip(self.begin.tolist(), (self.end + (length - 1)).tolist(), strict=True)], pa.large_binary()).dictionary_encode()
        places, names = found.indices.to_numpy(), found.dictionary
        # the first document that has a context has the least key, since keys are in order
        first = np.flatnonzero(places > np.r_[-1, np.maximum.accumulate(places)[:-1]]) if len(places) else places
        hashes, offsets = hashes[first], (owner - self.begin)[first].astype(np.uint8)
        least = docs["key"].to_numpy(np.int64)[order][np.searchsorted(ends, self.begin[first], side="right")]
        of = _shard(hashes, shards).astype(np.int64)
        by_shard = np.argsort(of, kind="stable")
        self.names, self.hashes, self.offsets, self.least, of = names.take(by_shard), hashes[by_shard], offsets[by_shard], least[by_shard], of[by_shard]
        to = np.empty(len(names), dtype=np.uint32)
        to[by_shard] = np.arange(len(names), dtype=np.uint32)
        self.places = to[places]
        starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(names) else by_shard
        #: (shard, first, past the last) of contexts
        self.spans = list(zip(of[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(names)][: len(starts)], strict=True))


PARTS = "shard int, bucket int, kind int, a binary, b binary, c binary, d binary, e binary"
_NAMES = ["shard", "bucket", "kind", "a", "b", "c", "d", "e"]
REMOVED = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def _rows(rows: list[tuple], names: list[str] | None = None) -> pd.DataFrame:
    return pd.DataFrame([(*r, *[None] * (len(_NAMES) - len(r))) for r in rows] if names is None else rows, columns=names or _NAMES)


def remove_repeats(documents: DataFrame, length: int = LENGTH, kmer: int = KMER, keep_text: bool = True, bucket_bytes: int = BUCKET_BYTES, hot: int = HOT) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the bytes that stay (kept; null without keep_text).
    A window's mask has a bit for each window of a context, so length - kmer is 62 at most."""
    if not 0 <= length - kmer <= 62:
        raise ValueError("length - kmer must be 0 to 62")
    spark = documents.sparkSession
    small_batches(spark)
    rows = documents.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("raw"))
    n = max(1, -(-(rows.agg(F.sum(F.octet_length("raw"))).first()[0] or 0) // bucket_bytes))
    shards = n * SHARDS
    dealt = rows.withColumn("key", F.coalesce("doc_id", F.lit(int(_LAST)))).withColumn("bucket", F.pmod(F.xxhash64("doc_id", "raw"), F.lit(n)).cast("int"))

    def send_anchors(key: tuple, docs: pd.DataFrame) -> pd.DataFrame:
        raws = docs["raw"].tolist()
        ends = np.cumsum([len(x) for x in raws])
        own, begin, *_ = anchors(b"".join(raws), length, kmer, ends)
        of = np.searchsorted(ends, begin, side="right")
        order = np.argsort(own)
        h = own[order]
        tied = np.flatnonzero(np.r_[False, h[1:] == h[:-1]] | np.r_[h[1:] == h[:-1], False]) if len(h) else order
        order[tied] = order[tied][np.lexsort((of[order[tied]], h[tied]))]
        of = of[order]
        # a document counts once
        new = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (of[1:] != of[:-1])][: len(h)])
        h = h[new]
        starts = np.flatnonzero(np.r_[True, h[1:] != h[:-1]][: len(h)])
        hashes, counts = h[starts], np.diff(np.r_[starts, len(h)])
        cuts = np.searchsorted(_shard(hashes, shards), np.arange(shards + 1))
        return _rows([(s, key[0], 0, _pack_sorted(hashes[a:b]), _pack(counts[a:b].astype(np.uint32))) for s, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a])

    def find_repeated(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        each = [_unpack_sorted(x) for x in parts["a"]]
        _, inverse = np.unique(np.concatenate(each), return_inverse=True)
        total = np.bincount(inverse, np.concatenate([_unpack(x, np.uint32) for x in parts["b"]]))
        out, at = [], 0
        for bucket, h in zip(parts["bucket"], each, strict=True):
            many = total[inverse[at : at + len(h)]]
            at += len(h)
            if len(mine := h[many > 1]):
                out.append((key[0], bucket, 1, _pack_sorted(mine), _pack_sorted(h[many >= hot])))
        return _rows(out)

    def repeated_of(parts: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        mine = parts[parts["kind"] == 1]
        return tuple(np.sort(np.concatenate([_unpack_sorted(x) for x in mine[c]])) if len(mine) else np.zeros(0, np.uint64) for c in ("a", "b"))

    def send_contexts(docs: pd.DataFrame, parts: pd.DataFrame) -> pd.DataFrame:
        if docs.empty or parts.empty:
            return _rows([])
        found, out = _Contexts(docs, *repeated_of(parts), shards, length, kmer), []
        bucket = int(docs["bucket"].iloc[0])
        cuts, texts = _buffers(found.names)
        for shard, a, b in found.spans:
            anchor = (found.hashes[a:b] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            out.append((shard, bucket, 2, _pack(texts[cuts[a] : cuts[b]]), (np.diff(cuts[a : b + 1]) - length).astype(np.uint8).tobytes(), _pack(found.least[a:b]), _pack(anchor), _pack(found.offsets[a:b])))
        # to itself: the stretches, and the places of their contexts among all it sent
        out.append((shards + bucket, bucket, 4, _pack(np.diff(found.begin, prepend=0).astype(np.uint32)), _pack((found.end - found.begin).astype(np.uint8)), _pack(found.places)))
        return _rows(out)

    def index(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        if key[0] >= shards:
            return parts
        columns: tuple[list[np.ndarray], ...] = ([], [], [], [], [])
        for packed in zip(*(parts[c] for c in ("a", "b", "c", "d", "e")), strict=True):
            for x, blob, kind in zip(columns, packed, (np.uint8, None, np.int64, np.uint32, np.uint8), strict=True):
                x.append(_unpack(blob, kind) if kind else np.frombuffer(blob, np.uint8))
        texts, sizes, *columns = map(np.concatenate, columns)
        ends = np.r_[0, np.cumsum(sizes.astype(np.int64) + length)]
        found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(texts)]).dictionary_encode()
        of, names = found.indices.to_numpy(), found.dictionary.to_pylist()
        least = np.full(len(names), _LAST)
        np.minimum.at(least, of, columns[0])
        anchor, place = np.zeros(len(names), dtype=np.int64), np.zeros(len(names), dtype=np.int64)
        anchor[of], place[of] = columns[1:]
        masks = occurs_earlier(names, anchor, place, least, length, kmer)
        cuts = np.cumsum([len(x) for x in parts["b"]])[:-1]
        return _rows([(key[0], bucket, 3, _pack(least[mine]), _pack(masks[mine])) for bucket, mine in zip(parts["bucket"], np.split(of, cuts), strict=True)])

    def remove(docs: pd.DataFrame, parts: pd.DataFrame) -> pd.DataFrame:
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
        if docs.empty:
            return _rows([], names)
        order = _in_order(docs)
        raws, ids, keys = ([x[i] for i in order] for x in (docs["raw"].tolist(), docs["doc_id"].tolist(), docs["key"].tolist()))
        ends = np.cumsum([len(x) for x in raws])
        starts = np.zeros(int(ends[-1]) + 1, dtype=np.int32)
        for a, b, c in parts[parts["kind"] == 4][["a", "b", "c"]].itertuples(index=False):
            begin, wide, places = np.cumsum(_unpack(a, np.uint32), dtype=np.int64), _unpack(b, np.uint8).astype(np.int64), _unpack(c, np.uint32)
            answers = parts[parts["kind"] == 3].sort_values("shard")
            least, masks = (np.concatenate([_unpack(x, np.int64) for x in answers[k]])[places] for k in ("a", "b"))
            mask = np.where(least < np.array(keys, dtype=np.int64)[np.searchsorted(ends, begin, side="right")], np.int64(-1), masks)
            some = np.flatnonzero(mask)
            begin, wide, mask = begin[some], wide[some], mask[some]
            step = np.arange(int(wide.sum())) - np.repeat(np.cumsum(wide) - wide, wide)
            repeat = (np.repeat(mask, wide) >> step & 1).astype(bool)
            starts[(np.repeat(begin, wide) + step)[repeat]] = 1
        # a byte goes if one of the last `length` windows goes
        upto = np.cumsum(starts, dtype=np.int32)
        upto[length:] -= upto[:-length].copy()
        covered = upto[:-1] > 0
        out = []
        for doc_id, raw, end in zip(ids, raws, ends.tolist(), strict=True):
            size, spans, kept = len(raw), 0, raw
            mine = covered[end - size : end]
            if removed := int(np.count_nonzero(mine)):
                spans = int(mine[0]) + int(np.count_nonzero(mine[1:] > mine[:-1]))
                kept = np.frombuffer(raw, np.uint8)[~mine].tobytes()
            out.append((None if pd.isna(doc_id) else doc_id, size, removed, spans, hashlib.sha256(kept).hexdigest(), kept if keep_text else None))
        return _rows(out, names).astype({"doc_id": "Int64"})

    hashes = dealt.groupBy("bucket").applyInPandas(send_anchors, PARTS)
    repeated = hashes.groupBy("shard").applyInPandas(find_repeated, PARTS)
    contexts = dealt.groupBy("bucket").cogroup(repeated.groupBy("bucket")).applyInPandas(send_contexts, PARTS)
    answers = contexts.groupBy("shard").applyInPandas(index, PARTS)
    return dealt.groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInPandas(remove, REMOVED)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), keep_text=False).drop("kept")
