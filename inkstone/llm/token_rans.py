"""Token ids in compressed binary blocks: static range asymmetric numeral system.

Texts are encoded with a tokenizer where they are read; their ids, not the texts, are then sorted by document id in ranges
and cut into blocks of whole documents. One frequency table, counted over all ids, is shared by all blocks. A block interleaves up to LANES coder
states, which step together, and can be decoded alone; checkpoints inside it hold all states and the place in the stream, so the stretches between
them decode side by side. Checksums guard the bytes and the ids.

The files are Parquet tables of blocks, so that any Spark file system holds them and a retried task leaves no half-written
file. Layout of a payload, little-endian: magic, lanes u32, ids u64, steps between checkpoints u32, checkpoints u32, table
checksum u32, checksum of the ids u32; per checkpoint the stream place u64 and the states u64; the stream of u32; crc32 of all before.

Words are encoded apart only for a tokenizer whose normalizer and splitter are those of NORMALIZER and SPLITTER; any other one gets whole texts.

Defined cases: null texts are empty and hold the end id only; equal doc_ids follow each other in the order of the hash of
their texts; a null doc_id comes first; a document longer than a block is one block; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkstone.llm.common import discard, lean, materialize

END_ID = 2
SCALE_BITS = 20
LANES, STEPS, BLOCK_IDS = 1024, 512, 1 << 19
#: Text bytes whose distinct pieces are encoded together, and pieces that a worker remembers; a task needs many times over what these hold.
SLICE_BYTES, REMEMBERED = 2 << 20, 100_000
MAGIC = b"IRB1"
HEAD = struct.Struct("<4sIQIIII")
_LOW = np.uint64(1 << 31)
_MASK = np.uint64((1 << SCALE_BITS) - 1)

# The text pipeline for which words can be encoded apart.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLITTER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
# With that pipeline, texts of these characters need no normalising but lower case: their pieces go to the tokenizer's model without it.
PLAIN = r"\A[ \t\r\nA-Za-zÀ-ÖØ-öø-ÿ!-&(-~]*\z"
SPECIAL = "<|"
APART = r"([!-&(-/:-@\[-`{-~]+|[0-9])"


def _byte_letters() -> dict[int, str]:
    """The usual printable stand-in of every byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class WordEncoder:
    """Ids of words and of pieces of words, by a tokenizer that drops white space and never joins across it. Pieces met lately
    are remembered; when there are too many, only those of the last slice stay."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        pipeline = json.loads(self.tokenizer.to_str())
        self.by_word = pipeline["normalizer"] == NORMALIZER and pipeline["pre_tokenizer"] == SPLITTER and pipeline["post_processor"] is None
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.known, self.count, self.flat = pa.array([], pa.large_string()), np.zeros(0, np.int32), np.zeros(0, "<u4")

    def pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of distinct pieces, each one run of lower-case letters, one digit or one run of marks: all ids, and of each piece the
        place of its first id and their number."""
        at = pc.index_in(pieces, value_set=self.known)
        new = pieces.filter(pc.is_null(at))
        place = np.asarray(at.fill_null(-1), dtype=np.int64)
        place[place < 0] = len(self.known) + np.arange(len(new))
        tokenize, letters = self.model.tokenize, self.letters
        found = [[t.id for t in tokenize(p if p.isascii() else "".join([letters[b] for b in p.encode()]))] if p else [] for p in new.to_pylist()]
        self.known = pa.concat_arrays([self.known, new])
        self.count = np.r_[self.count, np.fromiter(map(len, found), np.int32, len(found))]
        self.flat = np.r_[self.flat, np.fromiter((i for ids in found for i in ids), "<u4")]
        count = self.count[place]
        first = (np.cumsum(self.count, dtype=np.int64) - self.count)[place]
        flat = self.flat
        if len(self.known) > REMEMBERED:
            self.known, self.count = pieces, count
            self.flat = flat[np.repeat(first - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))]
        return flat, first, count

    def words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same for distinct words, or whole texts, through the whole tokenizer."""
        coded = [c.ids for c in self.tokenizer.encode_batch_fast(words.to_pylist(), add_special_tokens=False)]
        count = np.fromiter(map(len, coded), np.int64, len(coded))
        return np.fromiter((i for ids in coded for i in ids), "<u4"), np.cumsum(count) - count, count


_ENCODERS: dict[str, WordEncoder] = {}


def _encode_lists(lists: pa.Array, encode) -> tuple[np.ndarray, np.ndarray]:
    """Ids of texts given as lists of strings, END_ID after each text, and the number of ids of each; every distinct string is encoded once."""
    coded = lists.flatten().dictionary_encode()
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    flat, first, per_word = encode(coded.dictionary)
    flat, first, per_word = np.append(flat, np.uint32(END_ID)), np.append(first, len(flat)), np.append(per_word, 1)
    count = np.asarray(pc.list_value_length(lists), dtype=np.int64)
    index = np.insert(np.asarray(coded.indices, dtype=np.int32), np.cumsum(count), len(per_word) - 1)
    n = per_word[index]
    ends = np.cumsum(n, dtype=np.int64)
    at = np.repeat(first[index] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)
    last = ends[np.cumsum(count + 1) - 1] if len(count) else ends[:0]
    return flat[at], np.diff(last, prepend=0)


def _gather(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The stretches of flat one after the other."""
    return flat[np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]


def encode_texts(encoder: WordEncoder, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the texts, END_ID after each, and the number of ids of each text; equal texts are encoded once."""
    coded = texts.fill_null("").cast(pa.large_string()).dictionary_encode()
    flat, n = _encode_distinct(encoder, coded.dictionary)
    if len(coded.dictionary) == len(texts):
        return flat, n
    index = np.asarray(coded.indices, dtype=np.int64)
    return _gather(flat, (np.cumsum(n) - n)[index], n[index]), n[index]


def _encode_distinct(encoder: WordEncoder, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    if not encoder.by_word:
        return _encode_lists(pa.LargeListArray.from_arrays(np.arange(len(texts) + 1), texts), encoder.words)
    plain = pc.and_(pc.match_substring_regex(texts, PLAIN), pc.invert(pc.match_substring(texts, SPECIAL)))
    easy = pc.ascii_split_whitespace(pc.replace_substring_regex(pc.utf8_lower(texts.filter(plain)), APART, r" \1 "))
    flat, n = _encode_lists(easy, encoder.pieces)
    hard = texts.filter(pc.invert(plain))
    if not len(hard):
        return flat, n
    more, m = _encode_lists(pc.split_pattern(pc.replace_substring(hard, "\n", " "), " "), encoder.words)
    mask = np.asarray(plain.to_numpy(zero_copy_only=False), bool)
    size, start = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    size[mask], size[~mask] = n, m
    start[mask], start[~mask] = np.cumsum(n) - n, len(flat) + np.cumsum(m) - m
    return _gather(np.concatenate([flat, more]), start, size), size


def packed_ids(flat: np.ndarray, n: np.ndarray) -> pa.Array:
    """The ids of each document as bytes: two for each id where all of the slice fit, else four, little-endian."""
    wide = 4 if len(flat) and int(flat.max()) >> 16 else 2
    offsets = np.r_[0, np.cumsum(n)].astype(np.int64) * wide
    return pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(flat, f"<u{wide}"))]).cast(pa.binary())


def unpack_ids(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, "<u2" if len(data) == 2 * n else "<u4")


CODED = "doc_id long, tie long, n_tokens long, ids binary, seen binary"


def tokenizer_job(path: str):
    """A mapInArrow function (doc_id, tie, text) -> CODED: a row for each document, and last one row whose seen holds how often
    each id came up in the partition, as pairs of u64."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _ENCODERS.setdefault(path, None) or WordEncoder(path)
        _ENCODERS[path] = encoder
        total, names = np.zeros(0, np.int64), [x.split()[0] for x in CODED.split(", ")]
        for batch in batches:
            size = np.asarray(pc.fill_null(pc.binary_length(batch.column("text")), 0), dtype=np.int64)
            slot = (np.cumsum(size) - size) // SLICE_BYTES
            cuts = np.r_[0, np.flatnonzero(np.diff(slot)) + 1, len(size)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if lo == hi:
                    continue
                flat, n = encode_texts(encoder, batch.column("text").slice(lo, hi - lo))
                now = np.bincount(flat, minlength=len(total))
                now[: len(total)] += total
                total = now
                own = [batch.column(c).slice(lo, hi - lo) for c in ("doc_id", "tie")]
                yield pa.RecordBatch.from_arrays([*own, pa.array(n), packed_ids(flat, n), pa.nulls(hi - lo, pa.binary())], names=names)
        ids = np.flatnonzero(total)
        seen = np.stack([ids, total[ids]]).astype("<u8").tobytes()
        yield pa.RecordBatch.from_arrays([*(pa.nulls(1, pa.int64()) for _ in range(3)), pa.nulls(1, pa.binary()), pa.array([seen], pa.binary())], names=names)

    return run


def _spread_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for data in batch.column("seen"):
            ids, n = np.frombuffer(data.as_py(), "<u8").astype(np.int64).reshape(2, -1)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n)], names=["id", "n"])


class Table:
    """Frequencies scaled to 2 ** SCALE_BITS; every id that occurs keeps at least 1."""

    def __init__(self, ids: np.ndarray, freq: np.ndarray):
        self.ids, self.freq = ids.astype(np.uint32), freq.astype(np.uint64)
        self.start = (np.cumsum(self.freq) - self.freq).astype(np.uint64)
        self.check = zlib.crc32(self.ids.tobytes() + self.freq.tobytes())
        self.slot = np.repeat(np.arange(len(ids)), freq.astype(np.int64)).astype(np.int32)
        self.rank = np.zeros(int(ids.max()) + 1 if len(ids) else 1, np.int32)
        self.rank[ids] = np.arange(len(ids))

    @classmethod
    def of_counts(cls, ids: np.ndarray, counts: np.ndarray) -> Table:
        whole = 1 << SCALE_BITS
        if len(ids) > whole // 4:
            raise ValueError("more ids than the frequency scale can hold")
        freq = np.maximum(1, np.floor(counts * (whole / counts.sum()))).astype(np.int64)
        order = np.argsort(-freq, kind="stable")
        spare = whole - int(freq.sum())
        while spare:  # the most frequent ids take or give what rounding left
            step = 1 if spare > 0 else -1
            at = order[: abs(spare)]
            at = at[freq[at] + step >= 1]
            freq[at] += step
            spare -= step * len(at)
        return cls(ids, freq)


def encode_block(ids: np.ndarray, table: Table) -> bytes:
    n = len(ids)
    lanes = 1
    while lanes < LANES and lanes * 256 < n:
        lanes *= 2
    state = np.full(lanes, _LOW, np.uint64)
    room = np.uint64(63 - SCALE_BITS)
    steps = -(-n // lanes)
    words, written, marks = [], 0, []
    for t in range(steps - 1, -1, -1):
        a, b = t * lanes, min(n, t * lanes + lanes)
        rank = table.rank[ids[a:b]]
        x, f = state[: b - a], table.freq[rank]
        full = x >= f << room
        if full.any():
            out = x[full]
            words.append(out.astype(np.uint32))
            written += len(out)
            x = np.where(full, x >> np.uint64(32), x)
        q = x // f
        state[: b - a] = (q << np.uint64(SCALE_BITS)) + (x - q * f) + table.start[rank]
        if t % STEPS == 0:
            marks.append((written, state.copy()))
    marks = marks[::-1] or [(0, state)]
    head = HEAD.pack(MAGIC, lanes, n, STEPS, len(marks), table.check, zlib.crc32(ids.astype("<u4").tobytes()))
    body = b"".join(struct.pack("<Q", written - w) + s.astype("<u8").tobytes() for w, s in marks)
    stream = np.concatenate(words[::-1]).astype("<u4").tobytes() if words else b""
    data = head + body + stream
    return data + struct.pack("<I", zlib.crc32(data))


def decode_block(data: bytes, table: Table) -> np.ndarray:
    """The ids of a block. Stretches between checkpoints step together, each reading its own part of the stream."""
    if zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
        raise ValueError("block bytes are damaged")
    magic, lanes, n, steps, marks, table_check, ids_check = HEAD.unpack_from(data)
    if magic != MAGIC or table_check != table.check:
        raise ValueError("not a block of this table")
    at, place, state = HEAD.size, np.zeros(marks, np.int64), np.zeros((marks, lanes), np.uint64)
    for k in range(marks):
        place[k] = struct.unpack_from("<Q", data, at)[0]
        state[k] = np.frombuffer(data, "<u8", lanes, at + 8)
        at += 8 + 8 * lanes
    stream = np.frombuffer(data, "<u4", (len(data) - 4 - at) // 4, at)
    ids = np.zeros(n, np.uint32)
    base = np.arange(marks) * steps * lanes
    for t in range(min(steps, -(-n // lanes)) if n else 0):
        left = n - (base + t * lanes)
        live = int((left > 0).sum())
        x = state[:live]
        slot = (x & _MASK).astype(np.int64)
        rank = table.slot[slot]
        fresh = table.freq[rank] * (x >> np.uint64(SCALE_BITS)) + slot.astype(np.uint64) - table.start[rank]
        width = np.minimum(left[:live], lanes)
        active = np.arange(lanes)[None, :] < width[:, None] if width[-1] < lanes else None
        need = fresh < _LOW
        if active is not None:
            need &= active
            fresh = np.where(active, fresh, x)
        take = need.sum(axis=1)
        if take.any():
            first = np.repeat(place[:live] - (np.cumsum(take) - take), take) + np.arange(int(take.sum()))
            fresh[need] = (fresh[need] << np.uint64(32)) | stream[first].astype(np.uint64)
            place[:live] += take
        state[:live] = fresh
        value = table.ids[rank]
        for k in range(live):
            ids[base[k] + t * lanes : base[k] + t * lanes + width[k]] = value[k, : width[k]]
    if zlib.crc32(ids.astype("<u4").tobytes()) != ids_check:
        raise ValueError("block ids are damaged")
    return ids


BLOCKS = "part int, first_pos long, n_docs long, n_tokens long, doc_ids array<long>, lengths array<long>, payload binary"


def block_job(table, block_ids: int = BLOCK_IDS):
    """A mapInArrow function over sorted ranges: (doc_id, n_tokens, ids) -> BLOCKS. A block ends before it would pass its size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, names = table.value, [x.split()[0] for x in BLOCKS.split(", ")]
        part, first, docs, lengths, held, size = TaskContext.get().partitionId(), 0, [], [], [], 0

        def block() -> pa.RecordBatch:
            data = encode_block(np.concatenate(held), model)
            values = ([part], [first], [len(docs)], [size], [docs], [lengths], [data])
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names=names)

        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("doc_id", "n_tokens")]
            for doc, n, data in zip(*cols, batch.column("ids"), strict=True):
                if docs and size + n > block_ids:
                    yield block()
                    first, docs, lengths, held, size = first + len(docs), [], [], [], 0
                docs.append(doc)
                lengths.append(n)
                held.append(unpack_ids(data.as_py(), n))
                size += n
        if docs:
            yield block()

    return run


def read_job(table):
    """A mapInArrow function (start, doc_ids, lengths, payload) -> (doc_id, start, n_tokens, ids_crc32), all from decoded blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = table.value
        for batch in batches:
            for start, docs, lengths, payload in zip(*[batch.column(c).to_pylist() for c in ("start", "doc_ids", "lengths", "payload")], strict=True):
                ids = decode_block(payload, model).astype("<u4")
                n = np.array(lengths, np.int64)
                ends = np.cumsum(n)
                crc = [zlib.crc32(ids[e - k : e].tobytes()) for e, k in zip(ends, n, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(start + ends - n), pa.array(n), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return run


def write_blocks(docs: DataFrame, tokenizer_path: str, block_ids: int = BLOCK_IDS) -> tuple[DataFrame, DataFrame]:
    """Encode docs(doc_id, text) and write the files: a table of blocks, one folder for each id range, and the table of frequencies."""
    spark = docs.sparkSession
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("tie"), "text")
    coded = materialize(plain.mapInArrow(lean(tokenizer_job(tokenizer_path)), CODED), "token-ids")
    counts = coded.where("seen is not null").select("seen").mapInArrow(_spread_counts, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()  # the vocabulary at most
    counts = sorted((r["id"], r["n"]) for r in counts)
    ids, n = np.array([c[0] for c in counts], np.int64), np.array([c[1] for c in counts], np.int64)
    table = Table.of_counts(ids, n) if len(ids) else Table(ids, n)
    frequencies = materialize(spark.createDataFrame([(int(i), int(f)) for i, f in zip(table.ids, table.freq, strict=True)], "id long, freq long").coalesce(1), "token-table")
    order = [F.col("doc_id").asc_nulls_first(), F.col("tie")]
    sorted_ = coded.where("seen is null").drop("seen").repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "n_tokens", "ids")
    blocks = materialize(sorted_.mapInArrow(lean(block_job(spark.sparkContext.broadcast(table), block_ids)), BLOCKS).sortWithinPartitions("part", "first_pos"), "token-blocks", ["part"])
    discard(coded)
    return blocks, frequencies


def read_documents(blocks: DataFrame, frequencies: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files, decoded from them."""
    rows = sorted((r["id"], r["freq"]) for r in frequencies.collect())
    table = Table(np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64))
    sizes = blocks.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))  # one row for each range
    index = blocks.select("part", "first_pos", "n_tokens").join(before, "part")
    own = Window.partitionBy("part").orderBy("first_pos")
    starts = index.select("part", "first_pos", (F.col("before") + F.sum("n_tokens").over(own) - F.col("n_tokens")).alias("start"))
    placed = blocks.join(F.broadcast(starts), ["part", "first_pos"]) if starts.limit(BROADCAST_BLOCKS + 1).count() <= BROADCAST_BLOCKS else blocks.join(starts, ["part", "first_pos"])
    return placed.select("start", "doc_ids", "lengths", "payload").mapInArrow(lean(read_job(blocks.sparkSession.sparkContext.broadcast(table))), "doc_id long, start long, n_tokens long, ids_crc32 long")


#: The list of block starts (three numbers each) is broadcast up to so many blocks, and joined by shuffle beyond.
BROADCAST_BLOCKS = 100_000


def round_trip(docs: DataFrame, tokenizer_path: str, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Write the files and read every document back from them."""
    return read_documents(*write_blocks(docs, tokenizer_path, block_ids))
