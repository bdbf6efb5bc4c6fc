"""Removal of byte strings that repeat from an earlier document, by suffix arrays.

1. Every string of LEAST bytes (a window) has an anchor: of its GRAM-byte
   strings the one with the least hash. Equal windows have equal anchors.
   Windows in a row with one anchor overlap in a short stretch of text.
2. Documents are dealt to pieces. A piece lists its distinct anchors, which are
   counted over all pieces; stretches whose anchor two documents have are kept.
3. Kept stretches are dealt by anchor to blocks, equal ones of a piece once.
   A very frequent anchor's windows are dealt one by one, by their own hash.
4. A block sorts its suffixes by LEAST bytes and takes the Burrows-Wheeler
   transform. Breadth-first backward extension of intervals, from the empty
   string on, yields the common prefixes of neighbouring suffixes by increasing
   value; it stops at LEAST, and what is still undecided then is equal for
   LEAST bytes. Each class of equal windows has its first document.
5. The pieces get their stretches' first documents back and remove every byte
   of a window whose first document is before their own.

All three steps on pieces read the texts through one shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewright.llm.common import ID, TH, identified, partitions
from tapewright.llm.lm_score import _counts, _parts, _planes

#: Bytes of a repeat, and of an anchor.
LEAST, GRAM = 50, 20
#: About so many bytes of text in a piece, so many anchors in a part, so many bytes of text for each block of stretches.
PIECE, PART, BLOCK = 8 << 20, 1 << 20, 2 << 20
#: Documents of one anchor from which its windows are dealt one by one.
FREQUENT = 4096
#: Most windows of a stretch, bytes scanned together, bytes of stretches sorted together if anchors allow.
LONGEST, SCAN, SORT = 256, 1 << 18, 4 << 20
#: Never in UTF-8: ends each stretch.
END = 0xFF
NEVER = np.iinfo(np.int64).max
_TABLE = np.random.Generator(np.random.Philox(key=12)).integers(0, 2**63, 256, dtype=np.uint64)
_MUL = np.uint64(0x9E3779B97F4A7C15)


def gram_hashes(x: np.ndarray, size: int = GRAM) -> np.ndarray:
    """Hash of the `size` bytes at each place, put together from powers of two."""
    n = len(x) - size + 1
    power, step, out, done = _TABLE[x], 1, None, 0
    while True:
        if size & step:
            part = power[done : done + n]
            out = part.copy() if out is None else out * _MUL + part
            done += step
        if done == size:
            break
        power = power[:-step] * np.uint64(2 * 0x5851F42D4C957F2D + 1 & (1 << 64) - 1) ** np.uint64(step) + power[step:]
        step *= 2
    out = (out ^ out >> np.uint64(32)) * _MUL
    return out ^ out >> np.uint64(29)


def window_min(x: np.ndarray, size: int) -> np.ndarray:
    """Least of the `size` values from each place on."""
    n, have = len(x) - size + 1, 1
    while 2 * have <= size:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[:n], x[size - have : size - have + n])


def stretches(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, first byte, windows, anchor's hash) of the runs of windows with one anchor; texts follow each other in `data`."""
    doc = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
    got: list[tuple[np.ndarray, ...]] = []
    for a in range(0, max(0, len(data) - LEAST + 1), SCAN):
        b = min(a + SCAN, len(data) - LEAST + 1)
        low = window_min(gram_hashes(data[a : b + LEAST - 1]), LEAST - GRAM + 1)
        inside = np.arange(a, b) + LEAST <= offsets[doc[a:b] + 1]
        new = np.ones(b - a, bool)
        new[1:] = (low[1:] != low[:-1]) | ~inside[:-1]
        start = np.flatnonzero(new & inside)
        stops = np.append(np.flatnonzero(new | ~inside), b - a)
        n = stops[np.searchsorted(stops, start, "right")] - start
        # A text that repeats itself without end would be one stretch.
        pieces = -(-n // LONGEST)
        part = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start, n = np.repeat(start, pieces) + part * LONGEST, np.minimum(np.repeat(n, pieces) - part * LONGEST, LONGEST)
        # Anchors are the least of many hashes: mixed again they are even.
        key = low[start] * _MUL
        got.append((doc[a + start], a + start, n, key ^ key >> np.uint64(32)))
    if not got:
        return np.zeros(0, np.int32), *(np.zeros(0, t) for t in (np.int64, np.int64, np.uint64))
    return tuple(np.concatenate(x) for x in zip(*got))


def equal_windows(flat: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, True at the first suffix of each class) of a circular string, suffixes being equal if `least` bytes are.

    The order beyond `least` bytes is left open. Counts of letters before an
    interval's border don't depend on it, so neither does backward extension.
    """
    n = len(flat)
    round_ = np.concatenate([flat, np.resize(flat, 8)])
    key = np.zeros(n, np.uint64)
    for j in range(8):
        key = key << np.uint64(8) | round_[j : j + n]
    have = 8
    while True:
        sa = np.argsort(key)
        if have >= least:
            break
        by = key[sa]
        rank = np.empty(n, np.uint64)
        rank[sa] = np.cumsum(np.concatenate([[0], by[1:] != by[:-1]])).astype(np.uint64)
        more = min(have, least - have)
        key = rank << np.uint64(32) | np.roll(rank, -more)
        have += more
    bwt = flat[sa - 1]
    by = np.argsort(bwt, kind="stable")
    back = np.empty(n, np.int64)
    back[by] = np.arange(n)
    same = bwt[by[1:]] == bwt[by[:-1]]
    before, after = np.full(n, -1), np.full(n, n)
    before[by[1:][same]] = by[:-1][same]
    after[by[:-1][same]] = by[1:][same]
    known = np.zeros(n + 1, bool)
    known[[0, n]] = True
    lo, hi = np.array([0]), np.array([n])
    for _ in range(least):
        # The rows of all intervals; a letter's first and last row in an interval bound the extended one.
        size = hi - lo
        row = np.arange(size.sum()) + np.repeat(lo - np.cumsum(size) + size, size)
        first = row[before[row] < np.repeat(lo, size)]
        last = row[after[row] >= np.repeat(hi, size)]
        # Extended intervals are apart from each other, so sorted ends pair up.
        lo, hi = np.sort(back[first]), np.sort(back[last]) + 1
        new = ~known[hi]
        lo, hi = lo[new], hi[new]
        if not len(hi):
            break
        known[hi] = True
    return sa, known[:n]


def first_documents(texts: list[bytes], docs: np.ndarray) -> list[np.ndarray]:
    """For each window of each of the distinct stretches the least document of any stretch that has it."""
    size = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    flat = np.frombuffer(bytes([END]).join(texts) + bytes([END]), np.uint8)
    sa, new = equal_windows(flat)
    start = np.cumsum(size) - size
    own = np.repeat(docs, size)
    own[np.arange(len(flat)) - np.repeat(start, size) > np.repeat(size, size) - 1 - LEAST] = NEVER
    least = np.empty(len(flat), np.int64)
    least[sa] = np.repeat(np.minimum.reduceat(own[sa], np.flatnonzero(new)), np.diff(np.append(np.flatnonzero(new), len(flat))))
    return [least[s : s + n - LEAST] for s, n in zip(start.tolist(), size.tolist())]


class Piece:
    """The texts of a piece in a fixed order, and their stretches."""

    def __init__(self, table: pa.Table, bits: int):
        table = table.sort_by([("at", "ascending"), (TH, "ascending")])
        self.ids, self.at = table.column(ID), table.column("at").to_numpy()
        text = table.column("text").cast(pa.large_binary()).combine_chunks()
        text = text.chunk(0) if isinstance(text, pa.ChunkedArray) and text.num_chunks else text
        self.offsets = np.concatenate([[0], np.cumsum(pc.binary_length(text).to_numpy(zero_copy_only=False))]).astype(np.int64)
        start = np.frombuffer(text.buffers()[1], np.int64)[text.offset] if len(text) else 0
        whole = text.buffers()[2] if len(text) else None
        self.data = np.frombuffer(whole, np.uint8)[start : start + self.offsets[-1]] if whole is not None else np.zeros(0, np.uint8)
        self.doc, self.start, self.n, key = stretches(self.data, self.offsets)
        self.key = key >> np.uint64(64 - bits) << np.uint64(64 - bits)

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct anchors, sorted, and the number of their documents in the piece."""
        order = np.lexsort((self.doc, self.key))
        key, doc = self.key[order], self.doc[order]
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        other = new.copy()
        other[1:] |= doc[1:] != doc[:-1]
        return key[new], np.add.reduceat(other, np.flatnonzero(new), dtype=np.int64) if len(key) else np.zeros(0, np.int64)

    def kept(self, kinds: dict[int, bytes], n_parts: int) -> None:
        """Leaves the stretches whose anchor is shared; windows of very frequent ones become stretches of their own."""
        keys, _ = self.anchors()
        edges = _parts(keys, n_parts)
        kind = np.concatenate([np.frombuffer(kinds[p], np.uint8) if p in kinds else np.zeros(0, np.uint8) for p in range(n_parts) if edges[p + 1] > edges[p]] or [np.zeros(0, np.uint8)])
        kind = kind[np.searchsorted(keys, self.key)]
        some = np.flatnonzero(kind == 1)
        often = np.flatnonzero(kind == 2)
        n = self.n[often]
        own = np.repeat(self.start[often], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        doc, start, size, key = (np.concatenate(x) for x in (
            (self.doc[some], np.repeat(self.doc[often], n)), (self.start[some], own), (self.n[some], np.ones(len(own), np.int64)), (self.key[some], np.zeros(len(own), np.uint64))))
        self.place: list[int] = []
        self.texts: dict[bytes, int] = {}
        hashes: list[int] = []
        data = self.data.tobytes()
        for s, m, k, alone in zip(start.tolist(), size.tolist(), key.tolist(), (np.arange(len(start)) >= len(some)).tolist()):
            text = data[s : s + m + LEAST - 1]
            i = self.texts.setdefault(text, len(self.texts))
            self.place.append(i)
            if i == len(hashes):
                hashes.append(xxhash.xxh3_64_intdigest(text) if alone else k)
        self.doc, self.start, self.n = doc, start, size
        h = np.array(hashes, np.uint64) * _MUL
        self.hash = h ^ h >> np.uint64(29)

    def blocks(self, n_blocks: int) -> Iterator[tuple[int, np.ndarray]]:
        """(block, places of its stretches)."""
        block = (self.hash % np.uint64(n_blocks)).astype(np.int64)
        order = np.argsort(block, kind="stable")
        cut = np.flatnonzero(np.diff(block[order], prepend=-1))
        for a, b in zip(cut, np.append(cut[1:], len(order))):
            yield int(block[order[a]]), order[a:b]

    def removed(self, firsts: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """True for each byte of a window whose first document is before its own; firsts: of the windows of each stretch, from `begin` on."""
        flag = np.zeros(len(self.data), np.int32)
        place = np.array(self.place, np.int64)
        for a in range(0, len(place), 1 << 16):
            n = self.n[a : a + (1 << 16)]
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            mine = np.repeat(self.at[self.doc[a : a + (1 << 16)]], n)
            flag[np.repeat(self.start[a : a + (1 << 16)], n) + step] = firsts[np.repeat(begin[place[a : a + (1 << 16)]], n) + step] < mine
        total = np.cumsum(flag, dtype=np.int32)
        total[LEAST:] -= total[:-LEAST].copy()
        return total > 0


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", piece: int = PIECE, frequent: int = FREQUENT) -> DataFrame:
    """Rows doc_id, n_bytes, removed (list of byte ranges), kept (binary: the bytes left); one for each row of docs.

    A byte goes if a string of LEAST bytes over it also starts in a document
    with a smaller id. Null texts are empty; texts under LEAST bytes stay.
    Rows with one id don't remove from each other, repeated rows get equal
    results. Null ids come after all others, among themselves by text hash;
    ids are below 2**62. Matches may cut characters, so `kept` need not be
    UTF-8. An empty table gives no rows.
    """
    spark = docs.sparkSession
    texts = identified(docs, id_col, text_col)
    size = texts.agg(F.sum(F.octet_length("text")).cast("long")).first()[0] or 0
    wide = partitions(spark)
    n_pieces, n_parts, n_blocks = max(2 * wide, -(-size // piece)), max(1, wide // 4, size // (16 * PART)), max(wide, -(-size // BLOCK))
    # Wide enough for chance to keep under one in 1,000 of the anchors; keeping too many is harmless.
    bits = min(64, max(32, size.bit_length() + 8))
    at = F.coalesce(F.col(ID), F.lit(1 << 62) + F.shiftrightunsigned(F.col(TH), 2))
    dealt = texts.select(F.pmod(F.xxhash64(ID, TH, F.monotonically_increasing_id()), F.lit(n_pieces)).cast("int").alias("piece"), ID, TH, at.alias("at"), "text")

    def list_anchors(key: tuple, table: pa.Table) -> pa.Table:
        keys, counts = Piece(table, bits).anchors()
        edges = _parts(keys, n_parts)
        some = np.flatnonzero(np.diff(edges))
        cut = [(edges[p], edges[p + 1]) for p in some]
        small = keys >> np.uint64(64 - bits)
        return pa.table({
            "piece": pa.array([key[0].as_py()] * len(some), pa.int32()), "part": pa.array(some, pa.int32()),
            "keys": pa.array([_planes(np.diff(small[a:b], prepend=np.uint64(0))) for a, b in cut], pa.binary()),
            "counts": pa.array([np.minimum(counts[a:b], 255).astype(np.uint8).tobytes() for a, b in cut], pa.binary())})

    def judge(table: pa.Table) -> pa.Table:
        keys = [np.cumsum(_counts(x.as_py()), dtype=np.uint64) for x in table.column("keys")]
        counts = np.concatenate([np.frombuffer(x.as_py(), np.uint8) for x in table.column("counts")])
        each, place = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(place, weights=counts, minlength=len(each))
        kind = ((total > 1).astype(np.uint8) + (total >= frequent))[place].astype(np.uint8)
        cut = np.cumsum([len(k) for k in keys])
        return pa.table({"piece": table.column("piece"), "part": table.column("part"), "kinds": pa.array([x.tobytes() for x in np.split(kind, cut[:-1])], pa.binary())})

    def restored(left: pa.Table, right: pa.Table) -> Piece:
        got = Piece(left, bits)
        got.kept(dict(zip(right.column("part").to_pylist(), right.column("kinds").to_pylist())), n_parts)
        return got

    def hand_out(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        got = restored(left, right)
        first = np.full(len(got.texts), NEVER)
        if len(first):
            np.minimum.at(first, np.array(got.place), got.at[got.doc])
        every, rows = list(got.texts), []
        for block, some in got.blocks(n_blocks):
            mine = [every[i] for i in some]
            rows.append((block, np.fromiter(map(len, mine), np.uint16, len(mine)).tobytes(), b"".join(mine), first[some].tobytes(), got.hash[some].tobytes()))
        cols = list(zip(*rows)) if rows else [[]] * 5
        return pa.table({"piece": pa.array([key[0].as_py()] * len(rows), pa.int32()), "block": pa.array(cols[0], pa.int32()),
                         **{c: pa.array(x, pa.binary()) for c, x in zip(("sizes", "bytes", "first", "hashes"), cols[1:])}})

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        known: dict[bytes, int] = {}
        least: list[int] = []
        hashes: list[int] = []
        rows = []
        for sizes, data, first, keys in zip(*(table.column(c).to_pylist() for c in ("sizes", "bytes", "first", "hashes"))):
            here, s = [], 0
            for m, d, k in zip(*(np.frombuffer(x, t).tolist() for x, t in ((sizes, np.uint16), (first, np.int64), (keys, np.uint64)))):
                i = known.setdefault(data[s : s + m], len(known))
                if i == len(least):
                    least.append(d)
                    hashes.append(k)
                elif d < least[i]:
                    least[i] = d
                here.append(i)
                s += m
            rows.append(here)
        texts, docs, key = list(known), np.array(least, np.int64), np.array(hashes, np.uint64)
        windows = np.fromiter(map(len, texts), np.int64, len(texts)) - LEAST + 1
        # A stretch that is alone with its anchor shares no window; the others are compared, a large block in parts by anchor.
        _, place, count = np.unique(key, return_inverse=True, return_counts=True)
        found = [None] * len(texts)
        shared = np.flatnonzero(count[place] > 1)
        parts = 1 + int((windows[shared] + LEAST).sum()) // SORT
        group = place[shared] % parts
        for g in range(parts):
            some = shared[group == g]
            if len(some):
                for i, x in zip(some.tolist(), first_documents([texts[i] for i in some], docs[some])):
                    found[i] = x
        for i in np.flatnonzero(count[place] == 1).tolist():
            found[i] = np.broadcast_to(docs[i], windows[i])
        lengths, values = [], []
        for here in rows:
            flat = np.concatenate([found[i] for i in here])
            cut = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
            lengths.append(np.diff(np.append(cut, len(flat))).astype(np.uint32).tobytes())
            values.append(flat[cut].tobytes())
        return pa.table({"piece": table.column("piece"), "block": table.column("block"), "lengths": pa.array(lengths, pa.binary()), "values": pa.array(values, pa.binary())})

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        told = right.filter(pc.is_valid(right.column("part")))
        got = restored(left, told)
        found = right.filter(pc.is_valid(right.column("block")))
        answers = {b: np.repeat(np.frombuffer(v, np.int64), np.frombuffer(n, np.uint32)) for b, n, v in zip(*(found.column(c).to_pylist() for c in ("block", "lengths", "values")))}
        windows = np.fromiter(map(len, got.texts), np.int64, len(got.texts)) - LEAST + 1
        begin, done, parts = np.zeros(len(windows), np.int64), 0, [np.zeros(0, np.int64)]
        for block, some in got.blocks(n_blocks):
            begin[some] = done + np.cumsum(windows[some]) - windows[some]
            parts.append(answers[block])
            done += len(parts[-1])
        gone = got.removed(np.concatenate(parts), begin)
        edge = np.zeros(len(gone) + 1, bool)
        edge[got.offsets] = True
        up = np.flatnonzero(gone & (np.concatenate([[True], ~gone[:-1]]) | edge[:-1])) if len(gone) else np.zeros(0, np.int64)
        down = np.flatnonzero(gone & (np.concatenate([~gone[1:], [True]]) | edge[1:])) + 1 if len(gone) else np.zeros(0, np.int64)
        per = np.searchsorted(up, got.offsets)
        ranges, kept = [], []
        for i, (a, b) in enumerate(zip(got.offsets[:-1].tolist(), got.offsets[1:].tolist())):
            own = slice(per[i], per[i + 1])
            ranges.append(np.stack([up[own], down[own]], 1).__sub__(a).tolist())
            kept.append(got.data[a:b][~gone[a:b]].tobytes() if per[i] < per[i + 1] else got.data[a:b].tobytes())
        return pa.table({"doc_id": got.ids, "n_bytes": pa.array(np.diff(got.offsets), pa.int64()), "removed": pa.array(ranges, pa.list_(pa.list_(pa.int64()))), "kept": pa.array(kept, pa.binary())})

    asked = dealt.groupBy("piece").applyInArrow(list_anchors, "piece int, part int, keys binary, counts binary")
    told = asked.groupBy("part").applyInArrow(judge, "piece int, part int, kinds binary")
    handed = dealt.groupBy("piece").cogroup(told.groupBy("piece")).applyInArrow(hand_out, "piece int, block int, sizes binary, bytes binary, first binary, hashes binary")
    back = handed.groupBy("block").applyInArrow(compare, "piece int, block int, lengths binary, values binary")
    both = told.unionByName(back, allowMissingColumns=True)
    return dealt.groupBy("piece").cogroup(both.groupBy("piece")).applyInArrow(cut, "doc_id bigint, n_bytes bigint, removed array<array<bigint>>, kept binary")
