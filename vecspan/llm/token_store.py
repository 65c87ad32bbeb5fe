"""Token ids in compressed shard files with an offset index.

File layout (all integers little-endian)::

    magic "VTOK1\\n\\0\\0" | 32-byte SHA-256 of the dictionary | dictionary size u64 | dictionary
    documents: one zstandard frame each, of its ids as unsigned 32-bit integers
    index: doc_id i64, offset u64, frame size u32, ids u32 for each document (doc_id null: -2**63)
    number of documents u64 | position of the index u64 | magic

One dictionary is trained for all shards, on serialized id arrays of a bounded sample of documents.
A document is read with the file's footer, the index and one frame. Shards hold ascending ranges of doc_id.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import uuid
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import materialize, scratch, trimmed

MAGIC = b"VTOK1\n\0\0"
ENTRY = np.dtype([("doc_id", "<i8"), ("offset", "<u8"), ("size", "<u4"), ("ids", "<u4")])
NULL_ID = -(1 << 63)
END_ID = 2
SAMPLE_DOCS = 1_000  #: documents whose ids train the dictionary; the bound of its sample
SAMPLE_CHARS = 20_000  #: longest text that may be in the sample
DICT_BYTES = 64 << 10
SHARD_DOCS = 20_000  #: documents of a shard file, about
MAX_SHARDS = 100_000  #: of a store; beyond two billion documents the shards get larger
LEVEL = 3
_SPREAD = 1 << 20


def default_tokenizer() -> str:
    """Path of the vocabulary file that the installed package of public tokenizers has."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _kinds() -> np.ndarray:
    """Of each byte: 0 a blank, 1 an ASCII letter, 2 punctuation of a tail, 3 anything else."""
    kinds = np.full(256, 3, np.uint8)
    kinds[[0x20, 0x0A]] = 0
    kinds[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = 1
    kinds[[k for k in range(0x21, 0x7F) if kinds[k] == 3 and not chr(k).isdigit() and chr(k) not in "'<"]] = 2
    return kinds


_KIND = _kinds()
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_BLANK = re.compile(b"[ \n]")
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_MULT = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def _spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The positions in all spans, one span after the other."""
    return np.repeat(start - np.cumsum(size) + size, size) + np.arange(int(size.sum()))


class Encoder:
    """Whole texts to little-endian u32 ids, each distinct stretch between blanks encoded once.

    The vocabulary's normalizer (NFC, white space, lower case) and pre-tokenizer (whose matches hold no
    white space) act within a stretch without U+0020 and U+000A as they do in the whole text, so that
    the ids of a text are those of its stretches in turn; tests compare with the library on whole texts.
    Two things could cross a stretch's edge, the added tokens and a leading combining mark, and neither
    holds or composes with a blank. Of a stretch of letters up to U+00FF and a tail of ASCII punctuation, the pre-tokenizer
    makes two units: the letters, in lower case, and the tail. Units of up to 24 bytes are found, for a whole chunk of texts at
    once, in a table of SLOTS places that holds these bytes themselves; a new unit takes its place. New letters are encoded many at
    a time, as one text whose words end where the vocabulary has tokens that end a word. All other stretches go by a dict; long ones
    aren't remembered. Ids are kept in one array; at POOL ids all is forgotten, so that the memory is bounded.
    """

    CHUNK = 1 << 20
    SLOTS = 1 << 19
    POOL = 1 << 22
    WIDE = 24
    LONG = 64
    WORD_END = "</w>"
    _NORMALIZER = ["NFC", "Replace", "Lowercase"]
    _PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
    _made: dict[str, "Encoder"] = {}

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words = self._of_words(path) or self.tokenizer
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[k for t, k in vocabulary.items() if t.endswith(self.WORD_END)]] = True
        self._forget()

    @classmethod
    def of(cls, path: str) -> "Encoder":
        """The process's encoder, with what it remembers from earlier tasks."""
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    @classmethod
    def _of_words(cls, path: str):
        """The same model without normalizer and pattern, which leave lower-case letters up to U+00FF as they are; None for another kind of vocabulary."""
        from tokenizers import Tokenizer, pre_tokenizers
        from tokenizers.models import BPE

        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        model, pre, norm = made["model"], (made.get("pre_tokenizer") or {}).get("pretokenizers") or [], (made.get("normalizer") or {}).get("normalizers") or []
        plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges"))
        kinds = [x["type"] for x in pre] == ["Split", "ByteLevel"] and [x["type"] for x in norm] == cls._NORMALIZER
        if not plain or not kinds or model["type"] != "BPE" or model.get("end_of_word_suffix") != cls.WORD_END or pre[0]["pattern"] != {"Regex": cls._PATTERN}:
            return None
        merges = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in model["merges"]]
        found = Tokenizer(BPE(model["vocab"], merges, cache_capacity=0, end_of_word_suffix=cls.WORD_END))
        found.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        return found

    def _forget(self) -> None:
        self.pool, self.used = np.zeros(self.POOL + self.CHUNK, "<u4"), 0
        self.table = np.zeros((self.SLOTS, 4), np.uint64)  #: 24 bytes of a unit, and where its ids are in the pool, with their number in the lowest byte
        self.known: dict[bytes, tuple[int, int]] = {}

    def _plain(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def _add(self, ids: np.ndarray) -> int:
        """Put ids into the pool; where they begin."""
        at = self.used
        self.used += len(ids)
        if self.used > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(self.used, "<u4")])
        self.pool[at : self.used] = ids
        return at

    def _learn_units(self, low: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, number) in the pool of the ids of units of lower-cased bytes."""
        start, count = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        letters = _KIND[low[at]] != 2
        for k in np.flatnonzero(~letters).tolist():
            ids = self._plain(low[at[k] : at[k] + size[k]].tobytes().decode())
            start[k], count[k] = self._add(ids), len(ids)
        words = np.flatnonzero(letters)
        for some in np.split(words, range(4096, len(words), 4096)) if len(words) else []:
            stop = np.cumsum(size[some] + 1)
            text = low[_spans(at[some], size[some] + 1)]
            text[stop - 1] = 0x20
            ids = np.array(self.words.encode_batch_fast([text[:-1].tobytes().decode()], add_special_tokens=False)[0].ids, "<u4")
            last = np.flatnonzero(self.ends[ids]) + 1
            if len(last) == len(some) and last[-1] == len(ids):
                count[some] = np.diff(last, prepend=0)
                start[some] = self._add(ids) + last - count[some]
                continue
            for k in some.tolist():
                ids = self._plain(low[at[k] : at[k] + size[k]].tobytes().decode())
                start[k], count[k] = self._add(ids), len(ids)
        return start, count

    def _learn_others(self, parts: list[bytes]) -> None:
        for at in range(0, len(parts), 4096):
            some = parts[at : at + 4096]
            texts = [q.decode() for q in some]
            encoding = self.tokenizer.encode(texts, is_pretokenized=True, add_special_tokens=False)
            words = np.array([-1 if w is None else w for w in encoding.word_ids], np.int64)
            if len(words) and (words.min() < 0 or (np.diff(words) < 0).any()):
                for q, text in zip(some, texts):
                    ids = self._plain(text)
                    self.known[q] = self._add(ids), len(ids)
                continue
            edges = np.searchsorted(words, np.arange(len(some) + 1))
            first = self._add(np.array(encoding.ids, "<u4"))
            for q, a, b in zip(some, edges[:-1].tolist(), edges[1:].tolist()):
                self.known[q] = first + a, b - a

    def _rows(self, data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """The ids of some texts, given as UTF-8 bytes and where each begins and ends."""
        if self.used > self.POOL:
            self._forget()
        n = len(data)
        if not n:
            return [b""] * (len(offsets) - 1)
        low, kind = np.zeros(n + self.WIDE, np.uint8), _KIND[data]
        low[:n] = _LOWER[data]
        # letters from U+00C0 to U+00FF are two bytes; of these a multiplication and a division sign aren't letters
        two = np.flatnonzero(data[:-1] == 0xC3)
        if len(two):
            two = two[((data[two + 1] & 0xC0) == 0x80) & ((data[two + 1] & 0xDF) != 0x97)]
            kind[two] = kind[two + 1] = 1
            low[two + 1] |= np.where(data[two + 1] == 0x9F, 0, 0x20).astype(np.uint8)
        blank = kind == 0
        first, last = ~blank, ~blank
        first[1:] &= blank[:-1]
        last[:-1] &= blank[1:]
        edges = offsets[1:-1]
        edges = edges[(edges > 0) & (edges < n)]
        first[edges], last[edges - 1] = ~blank[edges], ~blank[edges - 1]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1

        letters, tails = np.zeros(n + 1, np.int32), np.zeros(n + 1, np.int32)
        np.cumsum(kind == 1, out=letters[1:])
        np.cumsum(kind == 2, out=tails[1:])
        head, tail, size = letters[ends] - letters[starts], tails[ends] - tails[starts], ends - starts
        simple = (head > 0) & (head <= self.WIDE) & (tail <= self.WIDE) & (head + tail == size) & (letters[starts + head] - letters[starts] == head)
        some = np.stack([np.ones(len(starts), bool), simple & (tail > 0)], 1)
        at = np.stack([starts, starts + head], 1)[some]
        sizes = np.stack([np.where(simple, head, size), tail], 1)[some]
        simple = np.stack([simple, simple], 1)[some]
        start, count = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)

        mine = np.flatnonzero(simple)
        eight = np.ndarray((n + self.WIDE - 7,), "<u8", low.data, strides=(1,))
        keys = [eight[at[mine] + 8 * k] & _MASK[np.clip(sizes[mine] - 8 * k, 0, 8)] for k in range(3)]
        with np.errstate(over="ignore"):
            mixed = keys[0] * _MULT[0] + (keys[1] ^ keys[1] >> np.uint64(29)) * _MULT[1] + keys[2] * _MULT[2]
            mixed = (mixed ^ mixed >> np.uint64(32)) * _MULT[0]
        slot = (mixed >> np.uint64(40)).astype(np.int64) & (self.SLOTS - 1)
        held = self.table[slot]
        hit = (held[:, 0] == keys[0]) & (held[:, 1] == keys[1]) & (held[:, 2] == keys[2])
        place = held[:, 3].astype(np.int64)
        new = np.flatnonzero(~hit)
        if len(new):
            new = new[np.argsort(mixed[new], kind="stable")]
            once = np.ones(len(new), bool)
            once[1:] = (keys[0][new[1:]] != keys[0][new[:-1]]) | (keys[1][new[1:]] != keys[1][new[:-1]]) | (keys[2][new[1:]] != keys[2][new[:-1]])
            unit = new[once]
            of, number = self._learn_units(low, at[mine[unit]], sizes[mine[unit]])
            packed = of << 8 | number
            place[new] = packed[np.cumsum(once) - 1]
            self.table[slot[unit]] = np.stack([*(x[unit] for x in keys), packed.astype(np.uint64)], 1)
        start[mine], count[mine] = place >> 8, place & 255

        other = np.flatnonzero(~simple)
        if len(other):
            parts = [data[a : a + k].tobytes() for a, k in zip(at[other].tolist(), sizes[other].tolist())]
            unknown = sorted(set(parts) - self.known.keys())
            self._learn_others(unknown)
            start[other], count[other] = np.array([self.known[q] for q in parts], np.int64).T
            for q in unknown:
                if len(q) > self.LONG:
                    del self.known[q]

        ids = self.pool[_spans(start, count)].tobytes()
        units = np.concatenate([np.zeros(1, np.int64), np.cumsum(some.sum(1))])[np.searchsorted(starts, offsets)]
        bounds = (4 * np.concatenate([np.zeros(1, np.int64), np.cumsum(count)])[units]).tolist()
        return [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:])]

    def _long_row(self, data: np.ndarray) -> bytes:
        """The ids of a long text, from parts that end before blanks."""
        out, at = [], 0
        while at < len(data):
            found = _BLANK.search(data, min(len(data), at + self.CHUNK))
            to = found.start() if found else len(data)
            out += self._rows(data[at:to], np.array([0, to - at]))
            at = to
        return b"".join(out)

    def encode(self, texts: pa.Array) -> Iterator[list[bytes]]:
        """The ids of each text, for some texts at a time; null has none."""
        texts = texts.cast(pa.large_binary()).fill_null(b"")
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + self.CHUNK, "right")) - 1)
            some = data[offsets[at] : offsets[to]]
            yield [self._long_row(some)] if len(some) > self.CHUNK else self._rows(some, offsets[at : to + 1] - offsets[at])
            at = to


def train_dictionary(docs: DataFrame, tokenizer: str, sample_docs: int = SAMPLE_DOCS, dict_bytes: int = DICT_BYTES) -> bytes:
    """A zstandard dictionary from the ids of whole documents: the ``sample_docs`` that hash lowest among those of at most SAMPLE_CHARS.

    Too few or too short samples, as in an empty table, give an empty dictionary, and frames do without one.
    """
    fit = docs.select("doc_id", "text").where(F.char_length("text") <= SAMPLE_CHARS)
    lowest = fit.orderBy(F.xxhash64("doc_id"), F.xxhash64("text")).limit(sample_docs)

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(tokenizer)
        for batch in batches:
            for raw in encoder.encode(batch.column("text")):
                yield pa.RecordBatch.from_arrays([pa.array(raw, pa.binary())], ["ids"])

    samples = [bytes(r[0]) for r in lowest.mapInArrow(trimmed(ids), "ids binary").collect() if len(r[0]) >= 8]
    try:
        return zstandard.train_dictionary(dict_bytes, samples, level=LEVEL).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or not uri.startswith("file:") else uri.replace("file:", "file://", 1))


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)


def write_token_store(docs: DataFrame, out: str, tokenizer: str | None = None, end_id: int | None = END_ID, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """Encode ``docs`` (doc_id, text) into shard files under ``out``; return their manifest.

    ``out`` is a URI that every executor can write. The manifest (shard, path, docs, ids, start) is in
    the order of doc_id, nulls first, and ``start`` counts the ids of all shards before. Null and empty
    texts hold the end id alone. Rows with equal doc_id are kept, in the order of a hash of their texts and then of their
    ids; many of them, or many nulls, have shards of their own.
    A file is written under a name of its own and then renamed, so that a task may run again
    or twice. Other columns are ignored.
    """
    spark = docs.sparkSession
    tokenizer = tokenizer or default_tokenizer()
    docs = docs.select("doc_id", "text")
    dictionary = train_dictionary(docs, tokenizer)
    tail = b"" if end_id is None else struct.pack("<I", end_id)

    # Ranges come from doc_id alone: ranging the encoded rows would encode them twice.
    rows, numbered = docs.agg(F.count(F.lit(1)), F.count("doc_id")).first()
    wanted = min(MAX_SHARDS, max(1, -(-numbered // shard_docs)))
    met = docs.agg(F.percentile_approx("doc_id", [k / wanted for k in range(1, wanted)], 10 * wanted)).first()[0] if wanted > 1 else []
    cuts, parts = _ranges(met or [], -(-(rows - numbered) // shard_docs))
    place = _Places(cuts, parts)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer = Encoder.of(tokenizer), _compressor(dictionary)
        for batch in batches:
            at = 0
            for found in encoder.encode(batch.column("text")):
                raw = [x + tail for x in found]
                ids, spread = (batch.column(k).slice(at, len(raw)) for k in ("doc_id", "spread"))
                ids = ids.cast(pa.int64())
                at += len(raw)
                yield pa.RecordBatch.from_arrays([pa.array(place.shard(ids, spread)), ids, spread, pa.array([len(x) // 4 for x in raw], pa.int64()), pa.array([packer.compress(x) for x in raw], pa.binary())], ["shard", "doc_id", "spread", "n", "frame"])

    spread = F.pmod(F.xxhash64("text"), F.lit(_SPREAD))
    frames = docs.withColumn("spread", spread).mapInArrow(trimmed(encode), "shard long, doc_id long, spread long, n long, frame binary")
    placed = frames.repartition(max(1, min(place.shards, rows)), "shard").sortWithinPartitions("shard", F.col("doc_id").asc_nulls_first(), "spread", "frame")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _open(out)
        system.create_dir(root, recursive=True)
        file = None
        for batch in batches:
            for shard, doc_id, n, frame in zip(*(batch.column(k).to_pylist() for k in ("shard", "doc_id", "n", "frame"))):
                if file is None or file.shard != shard:
                    if file:
                        yield file.close()
                    file = _ShardWriter(system, root, out, shard, dictionary)
                file.add(doc_id, n, frame)
        if file:
            yield file.close()

    manifest = materialize(placed.mapInArrow(trimmed(write), "shard long, path string, docs long, ids long"), "manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per shard file
    return manifest.withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0)).cast("long"))


def _ranges(met: list[int], null_parts: int) -> tuple[list[int], list[int]]:
    """Sorted cuts and the shards of each range: nulls first, then what is up to each cut and above the cut before, then the rest.

    An id that is several cuts has so many rows that its range holds nothing else and has as many shards.
    """
    often = Counter(met)
    cuts: list[int] = []
    parts = [max(1, null_parts)]
    for c in sorted(often):
        if often[c] > 1 and (not cuts or cuts[-1] < c - 1):
            cuts.append(c - 1)
            parts.append(1)
        cuts.append(c)
        parts.append(often[c])
    return cuts, [*parts, 1]


class _Places:
    """The shard of each row, from what ``_ranges`` gave. The plan is the same whatever the number of cuts."""

    def __init__(self, cuts: list[int], parts: list[int]) -> None:
        self.cuts, self.parts = np.array(cuts, np.int64), np.array(parts, np.int64)
        self.first = np.concatenate([np.zeros(1, np.int64), np.cumsum(self.parts)])
        self.shards = int(self.first[-1])

    def shard(self, ids: pa.Array, spread: pa.Array) -> np.ndarray:
        at = np.searchsorted(self.cuts, ids.fill_null(0).to_numpy(zero_copy_only=False)) + 1
        at[ids.is_null().to_numpy(zero_copy_only=False)] = 0
        return self.first[at] + spread.to_numpy(zero_copy_only=False) * self.parts[at] // _SPREAD


class _ShardWriter:
    def __init__(self, system: fs.FileSystem, root: str, out: str, shard: int, dictionary: bytes) -> None:
        self.system, self.shard = system, shard
        self.name = f"shard-{shard:08d}.vtok"
        self.at, self.uri = f"{root}/{self.name}", f"{out}/{self.name}"
        self.temporary = f"{root}/.{self.name}.{uuid.uuid4().hex}"
        self.file = system.open_output_stream(self.temporary)
        self.file.write(MAGIC + hashlib.sha256(dictionary).digest() + struct.pack("<Q", len(dictionary)) + dictionary)
        self.position = len(MAGIC) + 40 + len(dictionary)
        self.index: list[tuple[int, int, int, int]] = []

    def add(self, doc_id: int | None, n: int, frame: bytes) -> None:
        self.file.write(frame)
        self.index.append((NULL_ID if doc_id is None else doc_id, self.position, len(frame), n))
        self.position += len(frame)

    def close(self) -> pa.RecordBatch:
        index = np.array(self.index, ENTRY)
        self.file.write(index.tobytes() + struct.pack("<QQ", len(index), self.position) + MAGIC)
        self.file.close()
        self.system.move(self.temporary, self.at)
        return pa.RecordBatch.from_arrays([pa.array([self.shard], pa.int64()), pa.array([self.uri]), pa.array([len(index)], pa.int64()), pa.array([int(index["ids"].sum(dtype=np.int64))], pa.int64())], ["shard", "path", "docs", "ids"])


class ShardReader:
    """One shard file: ``index`` (structured array), ``ids(k)`` of its k-th document, ``find(doc_id)``."""

    def __init__(self, uri: str) -> None:
        system, at = _open(uri)
        self.file = system.open_input_file(at)
        head = self.file.read(len(MAGIC) + 40)
        if head[: len(MAGIC)] != MAGIC:
            raise ValueError(f"{uri} isn't a token shard")
        dictionary = self.file.read(struct.unpack("<Q", head[-8:])[0])
        if hashlib.sha256(dictionary).digest() != head[len(MAGIC) : -8]:
            raise ValueError(f"{uri}: the dictionary doesn't match its hash")
        end = self.file.size()
        count, position = struct.unpack("<QQ", self.file.read_at(16, end - 16 - len(MAGIC)))
        self.index = np.frombuffer(self.file.read_at(count * ENTRY.itemsize, position), ENTRY)
        self.unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)

    def raw(self, k: int) -> bytes:
        e = self.index[k]
        return self.unpacker.decompress(self.file.read_at(int(e["size"]), int(e["offset"])), max_output_size=int(e["ids"]) * 4)

    def ids(self, k: int) -> np.ndarray:
        return np.frombuffer(self.raw(k), "<u4")

    def find(self, doc_id: int) -> list[int]:
        """Positions of the documents with this id."""
        return np.flatnonzero(self.index["doc_id"] == doc_id).tolist()


def read_token_store(manifest: DataFrame, value: Callable[[bytes], object] | None = None, kind: str = "binary") -> DataFrame:
    """(doc_id, start, n_tokens, value) of every document, from the shard files of ``manifest``.

    ``value`` makes the last column, of SQL type ``kind``, from the document's ids as bytes; without it
    the column holds these bytes. ``start`` counts the ids of all documents before it.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
                shard = ShardReader(path)
                n = shard.index["ids"].astype(np.int64)
                starts = start + np.concatenate([np.zeros(1, np.int64), np.cumsum(n)[:-1]]) if len(n) else n
                for at in range(0, len(n), 500):
                    some = range(at, min(len(n), at + 500))
                    raw = [shard.raw(k) for k in some]
                    ids = [None if x == NULL_ID else x for x in shard.index["doc_id"][at : at + 500].tolist()]
                    if [len(x) // 4 for x in raw] != n[at : at + 500].tolist():
                        raise ValueError(f"{path}: a document's ids don't match the index")
                    values = pa.array(raw, pa.binary()) if value is None else pa.array([value(x) for x in raw])
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts[at : at + 500]), pa.array(n[at : at + 500]), values], ["doc_id", "start", "n_tokens", "value"])

    spread = manifest.select("path", "start").repartition(max(1, manifest.count()), "path")
    return spread.mapInArrow(trimmed(read), f"doc_id long, start long, n_tokens long, value {kind}")


def token_digests(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Write ``docs`` as a token store in the shared folder and return, from its files, doc_id, start, n_tokens, ids_crc32."""
    manifest = write_token_store(docs, scratch(docs.sparkSession, "tokens"), tokenizer)
    return read_token_store(manifest, zlib.crc32, "long").withColumnRenamed("value", "ids_crc32")


def lookup(spark: SparkSession, manifest: DataFrame, doc_id: int) -> list[np.ndarray]:
    """The ids of one document, from the few shards that may hold it."""
    return [r.ids(k) for row in manifest.select("path").collect() for r in [ShardReader(row[0])] for k in r.find(doc_id)]
