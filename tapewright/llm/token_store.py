"""Token ids in binary form: range asymmetric numeral coding with shared static frequencies.

File format (a Parquet container, so that Spark commits, splits and reads it):
* `table`: one row per token id that occurs, with its share of 2^PRECISION;
* `segments`: rows (shard, segment, n_tokens, index, payload). A segment holds
  whole documents in ascending id order. `index` lists id and length of each
  document. `payload` holds independent blocks of BLOCK tokens; its head lists
  for each block (checkpoint) the token count, byte offset and CRC-32 of the
  decoded ids, so blocks can be decoded in parallel or alone.
Within a block LANES coders are interleaved: token i belongs to lane i mod LANES.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapewright.llm.common import ID, TH, identified, partitions, slices, stored, worker_store

END = 0
PRECISION, LANES, BLOCK, SEGMENT = 18, 2048, 1 << 17, 1 << 18
#: Distinct pieces whose ids a worker keeps, twice at most.
KNOWN = 400_000


def tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class _Known(dict):
    """Piece -> its ids' bytes. An unknown piece gets an empty slot and is noted in `new`, to be filled soon."""

    def __init__(self, older: dict):
        super().__init__({b"": b""})
        self.older, self.new = older, []

    def __missing__(self, piece: bytes):
        data = self.older.get(piece)
        if data is None:
            data = bytearray()
            self.new.append(piece)
        self[piece] = data
        return data


class Encoder:
    """Token ids of UTF-8 texts, as the library's `encode(text, add_special_tokens=False)` gives them.

    Byte-level BPE never merges across pre-tokens, so texts may be cut where a
    pre-token surely begins, and the pieces' ids kept and joined. Such places
    are a space before another character but white space, a comma or stop after a
    letter or digit, and both sides of a lone newline. Texts where a cut might fall inside a
    pre-token or a special token are cut at spaces only, or not at all.
    """

    def __init__(self, path: str):
        self.tokenizer, self.known = tokenizer(path), _Known({})
        vocab = self.tokenizer.get_vocab()
        self.spaced = np.zeros(max(vocab.values()) + 1, bool)
        self.spaced[[i for t, i in vocab.items() if t.startswith("\u0120")]] = True

    def _encode(self, texts: list[bytes]) -> list[np.ndarray]:
        got = self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)
        return [np.array(e.ids, np.uint32) for e in got]

    def _learn(self) -> None:
        known = self.known
        words, rest = [], []
        for w in known.new:
            (words if w[0] == 32 else rest).append(w)
        known.new = []
        found = list(zip(rest, (x.tobytes() for x in self._encode(rest))))
        # Words with a space in front are encoded many in a row; a token with that space begins a word.
        for a in range(0, len(words), 256):
            some = words[a : a + 256]
            ids, = self._encode([b"".join(some)])
            starts = np.flatnonzero(self.spaced[ids])
            if len(starts) != len(some):
                # A vocabulary with tokens that begin inside a word, or words of several such tokens.
                found += zip(some, (x.tobytes() for x in self._encode(some)))
                continue
            data, at = ids.tobytes(), [*(4 * starts).tolist(), 4 * len(ids)]
            found += [(w, data[i:j]) for w, i, j in zip(some, at, at[1:])]
        for w, data in found:
            known[w].extend(data)
        known.update(found)

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        if len(self.known) > KNOWN:
            older, self.known.older = self.known, {}
            self.known = _Known(older)
        get = self.known.__getitem__
        found = [list(map(get, cut)) if (cut := _cut(t)) else None for t in texts]
        self._learn()
        whole = iter(self._encode([t for t, data in zip(texts, found) if data is None]))
        return [next(whole) if data is None else np.frombuffer(b"".join(data), np.uint32) for data in found]


#: Classes of bytes for `_cut`: P marks, W white space but B blank, U other separators, L letters and digits, S all else; bytes beyond ASCII count as letters.
_CLASS = bytes(ord("P" if c in b",." else "B" if c == 32 else "W" if c in b"\t\n\v\f\r" else "U" if c in b"\0\x1c\x1d\x1e\x1f" else "L" if c >= 128 or chr(c).isalnum() else "S") for c in range(256))
_ASCII = bytes(range(128))
_OTHER, _SPACE = re.compile(r"[^\w\x00-\x7f]"), re.compile(r" (?=\s|$)|[\x85\u180e]")


def _cut(raw: bytes) -> list[bytes] | None:
    """Pieces that begin where a pre-token begins; None if the text has to stay whole."""
    marks = raw.translate(_CLASS)
    if b"U" in marks or b"BB" in marks or b"BW" in marks or marks[-1:] == b"B" or b"<|endoftext|>" in raw:
        return None
    plain = raw.isascii()
    if not plain:
        # U+00C0 to U+00FF are letters but for two; other characters are looked at one by one.
        high = raw.translate(None, _ASCII)
        plain = not high[::2].strip(b"\xc3") and b"\xc3\x97" not in raw and b"\xc3\xb7" not in raw
        if not plain:
            text = raw.decode()
            plain = not _OTHER.search(text)
            if not plain and _SPACE.search(text):
                return None
    if plain:
        lines = b"WW" not in marks
        if not any(x in marks for x in (b"PP", b"SP", b"BP", b"WP")) and marks[:1] != b"P":
            raw = raw.replace(b",", b"\0,").replace(b".", b"\0.")
        if lines:
            raw = raw.replace(b"\n", b"\0\n\0")
    return raw.replace(b" ", b"\0 ").split(b"\0")


def encoder(path: str) -> Encoder:
    """One for each worker, so that what it has learned serves later tasks; it goes when another operator's task begins."""
    return worker_store(path, lambda: Encoder(path))


def _pack(ids: np.ndarray, press: zstandard.ZstdCompressor) -> bytes:
    return press.compress(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def _unpack(data: bytes, press: zstandard.ZstdDecompressor) -> np.ndarray:
    raw = np.frombuffer(press.decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(4, -1).T).view("<u4").ravel()


def tokenized(texts: DataFrame, path: str) -> DataFrame:
    """Rows: identity, n, ids (packed), salt (place in the task); and one row per task with the counts of its ids (other columns null, n -1)."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, press, counts = encoder(path), zstandard.ZstdCompressor(level=1), np.zeros(1 << 16, np.int64)
        done = 0
        for batch in slices(batches, store=path):
            ids = [np.append(x, np.uint32(END)) for x in own.encode(batch.column("text").cast(pa.binary()).to_pylist())]
            got = np.bincount(np.concatenate(ids))
            if len(got) > len(counts):
                counts = np.pad(counts, (0, len(got) - len(counts)))
            counts[: len(got)] += got
            n = np.array([len(x) for x in ids], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(ID), batch.column(TH), pa.array(n), pa.array([_pack(x, press) for x in ids], pa.binary()),
                                              pa.array(np.arange(done, done + len(ids))), pa.array([None] * len(ids), pa.binary())], [ID, TH, "n", "ids", "salt", "counts"])
            done += len(ids)
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64())] * 2 + [pa.array([-1], pa.int64()), pa.array([None], pa.binary()), pa.array([None], pa.int64()),
                                           pa.array([press.compress(counts.tobytes())], pa.binary())], [ID, TH, "n", "ids", "salt", "counts"])

    return texts.mapInArrow(work, f"{ID} bigint, {TH} bigint, n bigint, ids binary, salt bigint, counts binary")


def frequencies(parts: DataFrame) -> DataFrame:
    """Rows (token, freq): counts of all tasks scaled to 2^PRECISION in all, at least 1 each."""
    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("counts").to_pylist():
                counts = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.int64)
                at = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(counts[at])], ["token", "count"])

    counts = parts.filter("n = -1").select("counts").mapInArrow(spread, "token bigint, count bigint")
    return counts.groupBy("token").agg(F.sum("count").alias("count"))


@dataclass
class Table:
    """Frequencies and their running sums; `slot` gives the id of each of the 2^PRECISION places."""

    token: np.ndarray
    freq: np.ndarray

    def __post_init__(self):
        size = int(self.token.max()) + 1 if len(self.token) else 1
        #: Frequency in the high half, running sum in the low half: one look-up for both.
        self.both = np.zeros(size, np.uint64)
        self.both[self.token] = (self.freq.astype(np.uint64) << np.uint64(32)) | (np.cumsum(self.freq) - self.freq).astype(np.uint64)
        self.slot = np.repeat(self.token, self.freq.astype(np.int64)).astype(np.uint32)


def scaled(token: np.ndarray, count: np.ndarray) -> Table:
    """Frequencies of 1 or more that sum to 2^PRECISION; the vocabulary must be smaller than that."""
    by = np.argsort(token)
    token, count = token[by], count[by]
    if not len(token):
        return Table(token.astype(np.int64), np.zeros(0, np.int64))
    total = 1 << PRECISION
    if len(token) > total // 2:
        raise ValueError(f"{len(token)} tokens don't fit a table of {total}")
    free = total - len(token)
    freq = 1 + np.floor(count / count.sum() * free).astype(np.int64)
    freq[np.lexsort((token, -count))[: total - int(freq.sum())]] += 1
    return Table(token.astype(np.int64), freq)


_LOW, _HALF, _WORD = np.uint64(1 << 31), np.uint64(32), np.uint64(0xFFFFFFFF)
_P, _MASK = np.uint64(PRECISION), np.uint64((1 << PRECISION) - 1)


def encode_block(ids: np.ndarray, table: Table) -> bytes:
    """Lane states, then the 32-bit words in the order in which the decoder reads them."""
    steps = -(-len(ids) // LANES)
    state = np.full(LANES, _LOW, np.uint64)
    words = []
    for s in range(steps - 1, -1, -1):
        some = ids[s * LANES : (s + 1) * LANES]
        x = state[: len(some)]
        both = table.both[some]
        f = both >> _HALF
        full = np.flatnonzero(x >= (f << np.uint64(63 - PRECISION)))
        if len(full):
            over = x[full]
            words.append((over & _WORD).astype("<u4"))
            x[full] = over >> _HALF
        q = x // f
        state[: len(some)] = (q << _P) + (x - q * f) + (both & _WORD)
    return state.astype("<u8").tobytes() + b"".join(w.tobytes() for w in reversed(words))


def decode_block(data: bytes, n: int, table: Table) -> np.ndarray:
    state = np.frombuffer(data, "<u8", LANES).copy()
    words, at = np.frombuffer(data, "<u4", offset=8 * LANES).astype(np.uint64), 0
    out = np.empty(n, np.uint32)
    for s in range(0, n, LANES):
        m = min(LANES, n - s)
        x = state[:m]
        low = x & _MASK
        some = table.slot[low]
        out[s : s + m] = some
        both = table.both[some]
        x = (both >> _HALF) * (x >> _P) + low - (both & _WORD)
        need = np.flatnonzero(x < _LOW)
        if len(need):
            x[need] = (x[need] << _HALF) | words[at : at + len(need)]
            at += len(need)
        state[:m] = x
    return out


def encode_segment(ids: np.ndarray, table: Table) -> bytes:
    blocks = [ids[a : a + BLOCK] for a in range(0, len(ids), BLOCK)]
    data = [encode_block(b, table) for b in blocks]
    offsets = np.cumsum([0, *map(len, data)])
    head = struct.pack("<I", len(blocks)) + b"".join(struct.pack("<IQI", len(b), int(o), zlib.crc32(b.astype("<u4").tobytes())) for b, o in zip(blocks, offsets))
    return head + b"".join(data)


def decode_segment(payload: bytes, table: Table) -> np.ndarray:
    """All ids of a segment; a block whose checksum differs raises."""
    n, = struct.unpack_from("<I", payload)
    heads = [struct.unpack_from("<IQI", payload, 4 + 16 * k) for k in range(n)]
    base = 4 + 16 * n
    ends = [o for _, o, _ in heads[1:]] + [len(payload) - base]
    out = []
    for (size, start, crc), end in zip(heads, ends):
        ids = decode_block(payload[base + start : base + end], size, table)
        if zlib.crc32(ids.astype("<u4").tobytes()) != crc:
            raise ValueError("a block's checksum differs")
        out.append(ids)
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def _table(freqs: DataFrame) -> Table:
    """The table on the driver; its size is bounded by the vocabulary, which `scaled` checks."""
    rows = freqs.toArrow()
    return scaled(rows.column("token").to_numpy(), rows.column("count").to_numpy())


def write(docs: DataFrame, folder: str, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Files of all texts (null: empty) in ascending id order, null ids first, equal ids by text hash; each ends with id 0.

    Shards are ranges of ids of about equal row counts. Equal rows are stored
    each. An id that holds a large share of the rows is split over shards by
    text hash, and rows equal in both by their stored salt.
    """
    spark = docs.sparkSession
    parts = stored(tokenized(identified(docs, id_col, text_col), vocabulary), "ids")
    table = _table(frequencies(parts))
    shared = spark.sparkContext.broadcast(table)
    rows = parts.filter("n >= 0").drop("counts")
    n = partitions(spark)
    ranged = rows.repartitionByRange(n, F.asc_nulls_first(ID), TH, "salt").withColumn("shard", F.spark_partition_id()).sortWithinPartitions(F.asc_nulls_first(ID), TH)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, press = shared.value, zstandard.ZstdDecompressor()
        held: list[np.ndarray] = []
        index: list[tuple[int, int, int]] = []
        shard = segment = size = 0

        def flush() -> pa.RecordBatch:
            ids = np.concatenate(held)
            look = np.array(index, np.int64)
            return pa.RecordBatch.from_arrays([
                pa.array([shard], pa.int32()), pa.array([segment], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([len(index)], pa.int64()),
                pa.array([look.astype("<i8").tobytes()], pa.binary()), pa.array([encode_segment(ids, table)], pa.binary())],
                ["shard", "segment", "n_tokens", "n_docs", "index", "payload"])

        for batch in batches:
            for d, data, s in zip(batch.column(ID).to_pylist(), batch.column("ids"), batch.column("shard").to_pylist()):
                shard = s
                ids = _unpack(data.as_py(), press)
                if held and size + len(ids) > SEGMENT:
                    yield flush()
                    held, index, size, segment = [], [], 0, segment + 1
                held.append(ids)
                index.append((d is not None, d or 0, len(ids)))
                size += len(ids)
        if held:
            yield flush()

    ranged.select(ID, "ids", "shard").mapInArrow(pack, "shard int, segment bigint, n_tokens bigint, n_docs bigint, index binary, payload binary") \
        .write.option("compression", "none").parquet(f"{folder}/segments")
    spark.createDataFrame(list(zip(map(int, table.token), map(int, table.freq))), "token bigint, freq bigint").coalesce(1).write.parquet(f"{folder}/table")


def read(spark, folder: str) -> DataFrame:
    """Rows doc_id, start, n_tokens, ids_crc32 decoded from the files, every checksum verified; no rows from empty files."""
    rows = spark.read.schema("token bigint, freq bigint").parquet(f"{folder}/table").toArrow()
    by = np.argsort(rows.column("token").to_numpy())
    shared = spark.sparkContext.broadcast(Table(rows.column("token").to_numpy()[by], rows.column("freq").to_numpy()[by]))
    segments = spark.read.schema("shard int, segment bigint, n_tokens bigint, n_docs bigint, index binary, payload binary").parquet(f"{folder}/segments")
    # Start of each segment: running sums over shards (few rows), then over a shard's segments.
    sizes = segments.select("shard", "segment", "n_tokens")
    shards = sizes.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    shards = shards.select(F.col("shard").alias("b_shard"), (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("before"))
    inside = F.sum("n_tokens").over(Window.partitionBy("shard").orderBy("segment")) - F.col("n_tokens")
    starts = sizes.withColumn("inside", inside).join(shards, F.col("shard") == F.col("b_shard")).select(
        F.col("shard").alias("a_shard"), F.col("segment").alias("a_segment"), (F.col("inside") + F.col("before")).alias("start"))

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, segment, index, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                ids = decode_segment(payload.as_py(), shared.value).astype("<u4")
                look = np.frombuffer(index.as_py(), "<i8").reshape(-1, 3)
                ends = np.cumsum(look[:, 2])
                crc = [zlib.crc32(ids[e - k : e].tobytes()) for e, k in zip(ends, look[:, 2])]
                m = len(look)
                yield pa.RecordBatch.from_arrays([
                    pa.array([shard] * m, pa.int32()), pa.array([segment] * m, pa.int64()), pa.array(look[:, 1], mask=look[:, 0] == 0),
                    pa.array(ends - look[:, 2]), pa.array(look[:, 2]), pa.array(crc, pa.int64())], ["shard", "segment", "doc_id", "offset", "n_tokens", "ids_crc32"])

    found = segments.select("shard", "segment", "index", "payload").mapInArrow(
        unpack, "shard int, segment bigint, doc_id bigint, offset bigint, n_tokens bigint, ids_crc32 bigint")
    return found.join(starts, (F.col("shard") == F.col("a_shard")) & (F.col("segment") == F.col("a_segment"))).select(
        "doc_id", (F.col("start") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, vocabulary: str, **columns) -> DataFrame:
    """Rows doc_id, start, n_tokens, ids_crc32, one for each row of docs, from files written to the shared folder and read back.

    Null texts are empty: their only token is the end. Documents follow each
    other by id, null ids first, then by text hash; repeated rows are repeated
    documents. Texts of any length may take several blocks of a segment. Other
    columns of docs are left out; an empty table writes empty files and gives
    no rows.
    """
    import uuid

    from tapewright.session import shared_dir

    folder = f"{shared_dir(docs.sparkSession).rstrip('/')}/llm-tokens-{uuid.uuid4().hex}"
    write(docs, folder, vocabulary, **columns)
    return read(docs.sparkSession, folder)
