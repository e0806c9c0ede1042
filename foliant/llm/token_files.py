"""Token ids of documents in files of shuffled planes.

A file holds the ids of consecutive documents as blocks of BLOCK ids. A block is transposed: plane i has bit i (or byte i) of all its ids, is compressed
with zstandard by itself, and the planes' places stand in the chunk index, so that any run of ids is read by the blocks that it touches. Layout:

    planes of block 0, planes of block 1, ... | documents: Arrow streams of id and n_tokens, compressed | index (JSON) | length of the index, MAGIC

Files follow each other in ascending order of the documents' ids. Tasks write under names of their own and only files named in a committed table are read,
so a task that is run again leaves nothing wrong.
"""

from __future__ import annotations

import array
import bisect
import functools
import itertools
import json
import os
import unicodedata
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._spark import new_path, ship, slices, table

#: Ids in a block; bytes of text in a file, about.
BLOCK, FILE_BYTES = 1 << 16, 16 << 20
MAGIC = b"PLANES01"
#: Words that a worker remembers before it starts anew, the longest of them in bytes, and how much of a text is looked at at once.
WORDS_KEPT, WORD_BYTES, PIECE_BYTES = 1_500_000, 64, 1 << 20
#: Words that are encoded as one text.
AT_ONCE = 2_000


@functools.cache
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def id_bytes(path: str, end: int) -> int:
    """2 or 4: bytes that hold any id of the tokenizer, and the end id."""
    return 2 if max([end, *_tokenizer(path).get_vocab().values()]) < 1 << 16 else 4


#: ASCII marks, and the letters and digits beside which words may be cut: those of ASCII and U+00C0 to U+00FF.
_MARKS = [chr(i) for i in range(33, 127) if not chr(i).isalnum()]
_BESIDE = [c for c in map(chr, range(256)) if c.isalnum() and (c.isascii() or c >= "\u00c0")]


class Encoder:
    """Ids of texts, as bytes. For tokenizers that drop white space and join nothing over it: a text's ids are then those of its words, and each word is encoded once.

    Case is lowered first if the tokenizer does so, and words are cut where the pre-tokenizer always cuts between a letter or digit and a mark; neither in texts that may hold a
    special token. If the tokenizer marks the ends of words, words of letters alone are encoded many at once and told apart by their ends.
    """

    def __init__(self, path: str, width: int):
        self.tokenizer, self.code, self.width = _tokenizer(path), "H" if width == 2 else "I", width
        self.lowers = self.tokenizer.normalizer is not None and self.tokenizer.normalizer.normalize_str("A") == "a"
        special = [self._lowered(t.content.encode()) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = os.path.commonprefix(special) if special else None  # what holds it may hold a special token
        suffix, vocab = getattr(self.tokenizer.model, "end_of_word_suffix", None), self.tokenizer.get_vocab()
        self.is_end = np.zeros(max(vocab.values(), default=0) + 1, bool)
        if suffix:
            self.is_end[[i for t, i in vocab.items() if t.endswith(suffix)]] = True
        # bits of a byte as the left and as the right one of two: 1 if a letter or digit is cut from the mark behind it, 2 if from the mark before it
        self.left, self.right = np.zeros((2, 256), np.uint8)
        for c in _BESIDE:
            if c.isascii():
                self.left[ord(c)], self.right[ord(c)] = 1, 2
        for m in _MARKS:
            self.right[ord(m)] = 1 if all(self._pieces(c + m + x)[:1] == [(0, 1)] for c in _BESIDE for x in ("", c)) else 0
            self.left[ord(m)] = 2 if all(self._pieces(x + m + c)[-1:] == [(len(x) + 1, len(x) + 2)] for c in _BESIDE for x in ("", c)) else 0
        self.known: dict[bytes, bytes] = {}

    def _pieces(self, text: str) -> list[tuple[int, int]]:
        """Where the pre-tokenizer's pieces of a text are."""
        return [at for _, at in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)] if self.tokenizer.pre_tokenizer else []

    def _lowered(self, text: bytes) -> bytes:
        return text.lower() if self.lowers else text

    def _words(self, texts: list[bytes]) -> list[list[bytes]]:
        """The words of each text, parted at ASCII white space and where words are cut."""
        data = self._lowered(b" ".join(texts))
        if self.special is not None and self.special in data:
            return [t.split() if self.special in self._lowered(t) else self._words([t])[0] for t in texts]
        raw = np.frombuffer(data, np.uint8)
        left = self.left[raw]
        wide = np.flatnonzero(raw[:-1] == 0xC3) + 1  # letters of two bytes
        left[wide[(raw[wide] != 0x97) & (raw[wide] != 0xB7)]] = 1
        at = np.flatnonzero(left[:-1] & self.right[raw[1:]]) + 1
        ends = np.cumsum([len(t) + 1 for t in texts])
        data = np.insert(raw, at, 32).tobytes()
        return [data[lo:hi].split() for lo, hi in itertools.pairwise([0, *(ends + np.searchsorted(at, ends)).tolist()])]

    def _alone(self, words: list[bytes]) -> Iterator[bytes]:
        got = self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in words], add_special_tokens=False)
        return (array.array(self.code, e.ids).tobytes() for e in got)

    def _together(self, words: list[bytes]) -> Iterator[bytes]:
        """The ids of words of letters, each of which is one piece to the pre-tokenizer; should one not be, all are encoded alone."""
        ids = np.array(self.tokenizer.encode_batch_fast([b" ".join(words).decode()], add_special_tokens=False)[0].ids, f"u{self.width}")
        ends = (np.flatnonzero(self.is_end[ids]) + 1) * self.width
        if len(ends) != len(words):
            return self._alone(words)
        data = ids.tobytes()
        return (data[lo:hi] for lo, hi in itertools.pairwise([0, *ends.tolist()]))

    def _encoded(self, words: set[bytes]) -> dict[bytes, bytes]:
        plain = [w for w in words if _letters(w)] if self.is_end.any() else []
        out: dict[bytes, bytes] = {}
        for i in range(0, len(plain), AT_ONCE):
            out.update(zip(plain[i : i + AT_ONCE], self._together(plain[i : i + AT_ONCE]), strict=True))
        rest = [w for w in words if w not in out]
        out.update(zip(rest, self._alone(rest), strict=True))
        return out

    def many(self, texts: list[bytes]) -> list[bytes]:
        """The ids of texts that have PIECE_BYTES together, about."""
        if len(self.known) > WORDS_KEPT:
            self.known = {}
        split = self._words(texts)
        ids = [list(map(self.known.get, words)) for words in split]
        gaps = [[i for i, x in enumerate(found) if x is None] for found in ids]
        if new := {words[i] for words, gap in zip(split, gaps, strict=True) for i in gap}:
            encoded = self._encoded(new)
            for words, found, gap in zip(split, ids, gaps, strict=True):
                for i in gap:
                    found[i] = encoded[words[i]]
            self.known.update((w, x) for w, x in encoded.items() if len(w) <= WORD_BYTES)
        return list(map(b"".join, ids))

    def __call__(self, text: bytes) -> bytes:
        return b"".join(self.many([p])[0] for p in (pieces(text, PIECE_BYTES) if len(text) > PIECE_BYTES else [text]))


def _letters(word: bytes) -> bool:
    """Whether a word is letters alone, also when it is normalized and lowered."""
    if word.isascii():
        return word.isalpha()
    text = word.decode("utf-8", "replace")
    return text.isalpha() and unicodedata.normalize("NFC", text).lower().isalpha()


@functools.lru_cache(maxsize=1)
def _encoder(path: str, width: int, job: str) -> Encoder:
    """A worker's encoder, which remembers words from task to task of one job; the next job begins anew."""
    return Encoder(path, width)


def pieces(text: bytes, most: int) -> Iterator[bytes]:
    """Parts of a text that end at a space or a line's end, where there is one within `most` bytes; else at the next one."""
    at = 0
    while at < len(text):
        cut = max(text.rfind(b" ", at, at + most), text.rfind(b"\n", at, at + most)) if at + most < len(text) else len(text)
        if cut <= at:
            cut = min((x for x in (text.find(b" ", at + 1), text.find(b"\n", at + 1)) if x > 0), default=len(text))
        yield text[at:cut]
        at = cut


def _turned(x: np.ndarray) -> np.ndarray:
    """64-bit words as eight rows of eight bits, transposed."""
    for shift, mask in ((7, 0x00AA00AA00AA00AA), (14, 0x0000CCCC0000CCCC), (28, 0x00000000F0F0F0F0)):
        t = (x ^ (x >> np.uint64(shift))) & np.uint64(mask)
        x = x ^ t ^ (t << np.uint64(shift))
    return x


def to_planes(ids: np.ndarray, bits: bool = True) -> list[bytes]:
    """Planes of a block of unsigned ids, the lowest first; planes of bits are filled up to whole bytes with zeros."""
    parts = ids.view(np.uint8).reshape(len(ids), ids.itemsize).T
    if not bits:
        return [p.tobytes() for p in parts]
    room = np.zeros((ids.itemsize, -(-len(ids) // 8) * 8), np.uint8)
    room[:, : len(ids)] = parts
    return [p.tobytes() for part in room for p in _turned(part.view("<u8")).view(np.uint8).reshape(-1, 8).T]


def from_planes(planes: list[bytes], n: int, width: int, bits: bool = True) -> np.ndarray:
    """The ids of to_planes()."""
    out = np.empty((n, width), np.uint8)
    for i in range(width):
        if bits:
            rows = np.stack([np.frombuffer(p, np.uint8) for p in planes[8 * i : 8 * i + 8]], axis=1)
            out[:, i] = _turned(np.ascontiguousarray(rows).view("<u8").reshape(-1)).view(np.uint8)[:n]
        else:
            out[:, i] = np.frombuffer(planes[i], np.uint8)
    return out.view(f"<u{width}").reshape(-1)


class _Writer:
    def __init__(self, folder: str, width: int, bits: bool, block: int, kind: pa.DataType):
        self.name, self.width, self.bits, self.block = f"{folder}/{uuid.uuid4().hex}.planes", width, bits, block
        self.schema = pa.schema([("id", kind), ("n", pa.int64())])
        store, path = fs.FileSystem.from_uri(self.name)
        store.create_dir(path.rsplit("/", 1)[0], recursive=True)
        self.out, self.at, self.n_ids, self.n_docs = store.open_output_stream(path, compression=None), 0, 0, 0
        self.chunks: list[list[int]] = []
        self.rest = bytearray()
        self.ids: list[pa.Array] = []
        self.ns: list[pa.Array] = []
        self.press = zstandard.ZstdCompressor(level=3)

    def _put(self, data: bytes) -> list[int]:
        packed = self.press.compress(data)
        self.out.write(packed)
        self.at += len(packed)
        return [self.at - len(packed), len(packed)]

    def add(self, ids: pa.Array, data: bytes, ns: np.ndarray) -> None:
        """Documents' ids, all their token ids, and how many each has."""
        self.ids.append(ids)
        self.ns.append(pa.array(ns, pa.int64()))
        self.n_docs += len(ns)
        self.rest += data
        whole = len(self.rest) // (self.block * self.width) * self.block * self.width
        self._blocks(bytes(memoryview(self.rest)[:whole]))
        del self.rest[:whole]

    def _blocks(self, data: bytes) -> None:
        ids = np.frombuffer(data, f"<u{self.width}")
        for i in range(0, len(ids), self.block):
            part = ids[i : i + self.block]
            self.chunks.append([len(part), *itertools.chain.from_iterable(map(self._put, to_planes(part, self.bits)))])
            self.n_ids += len(part)

    def close(self) -> tuple:
        self._blocks(bytes(self.rest))
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, self.schema) as w:
            w.write_table(pa.Table.from_arrays([pa.chunked_array(self.ids, self.schema.field(0).type), pa.chunked_array(self.ns, pa.int64())], schema=self.schema))
        docs = self._put(sink.getvalue().to_pybytes())
        index = json.dumps({"width": self.width, "bits": self.bits, "block": self.block, "documents": docs, "chunks": self.chunks}).encode()
        self.out.write(index + len(index).to_bytes(8, "little") + MAGIC)
        self.out.close()
        return self.name, self.n_docs, self.n_ids


class IdFile:
    """A file of shuffled planes; reads no more blocks than it is asked for."""

    def __init__(self, name: str):
        store, path = fs.FileSystem.from_uri(name)
        self.file = store.open_input_file(path)
        size = self.file.size()
        tail = self.file.read_at(16, size - 16)
        if tail[8:] != MAGIC:
            raise ValueError(f"{name} isn't a whole file of planes")
        length = int.from_bytes(tail[:8], "little")
        self.index = json.loads(self.file.read_at(length, size - 16 - length))
        self.width, self.chunks = self.index["width"], self.index["chunks"]
        self.starts = np.concatenate([[0], np.cumsum([c[0] for c in self.chunks], dtype=np.int64)]).astype(np.int64)
        self.open = zstandard.ZstdDecompressor()
        self.kept: tuple[int, np.ndarray] = (-1, np.zeros(0, f"<u{self.width}"))

    def documents(self) -> pa.Table:
        """Their ids (id) and numbers of token ids (n), in order."""
        at, length = self.index["documents"]
        return pa.ipc.open_stream(self.open.decompress(self.file.read_at(length, at))).read_all()

    def block(self, i: int) -> np.ndarray:
        if self.kept[0] != i:
            n, *places = self.chunks[i]
            data = self.file.read_at(places[-2] + places[-1] - places[0], places[0])
            planes = [self.open.decompress(data[at - places[0] : at - places[0] + length]) for at, length in zip(places[::2], places[1::2], strict=True)]
            self.kept = (i, from_planes(planes, n, self.width, self.index["bits"]))
        return self.kept[1]

    def read(self, start: int, stop: int) -> Iterator[np.ndarray]:
        """The ids from start to before stop, a block's at a time."""
        i = max(0, int(np.searchsorted(self.starts, start, side="right")) - 1)
        while i < len(self.chunks) and self.starts[i] < stop:
            yield self.block(i)[max(0, start - self.starts[i]) : stop - self.starts[i]]
            i += 1


def _place(key, tie: int) -> tuple:
    return (key is None, 0 if key is None else key, tie)


def cuts(docs: DataFrame, file_bytes: int) -> list[tuple]:
    """The least (id, hash of the text) of each range of documents but the first; as many ranges as files, so a group of equal rows may have several equal ones.

    A row for each file comes to the driver.
    """
    total = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    n = total // file_bytes + 1
    if n == 1:
        return []
    keys = docs.select("id", F.xxhash64("text").alias("tie")).withColumn("salt", F.rand(7)).repartitionByRange(int(n), F.col("id").asc_nulls_last(),
        "tie", "salt")
    least = keys.groupBy(F.spark_partition_id().alias("part")).agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "tie")).alias("least")).collect()
    return sorted(_place(r["least"]["id"], r["least"]["tie"]) for r in least)[1:]


def write_ids(docs: DataFrame, tokenizer: str, end: int, id: str = "doc_id", text: str = "text", bits: bool = True, block: int = BLOCK, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Encodes texts and writes their ids, each document's followed by `end`, into the shared folder. Returns a table of the files: part (their order), file, n_docs, n_ids.

    Documents are in ascending order of id, null last; those that share an id in order of their texts' hashes. Documents are dealt into ranges before they are
    encoded, so only ids are shuffled, once. Documents with the same id and text are dealt over all ranges that such a group spans. A null or empty text has the
    end id alone. An empty table gives no file. Other columns aren't read; a text of any length is encoded in pieces that end at white space.
    """
    spark = docs.sparkSession
    ship(spark)
    width, folder = id_bytes(tokenizer, end), new_path(spark, "token-ids")
    rows = docs.select(F.col(id).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    places = spark.sparkContext.broadcast(cuts(rows, file_bytes))  # one a file
    kind = rows.schema["id"].dataType
    encoded = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("id", kind), T.StructField("tie", T.LongType()), T.StructField("ids", T.BinaryType())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, last, at, count = _encoder(tokenizer, width, folder), end.to_bytes(width, "little"), places.value, 0
        for batch in batches:
            for part in slices(batch, 2):
                parts = []
                for key, tie in zip(*(c.to_pylist() for c in part.columns[:2]), strict=True):
                    place = _place(key, tie)
                    lo = bisect.bisect_left(at, place)
                    hi = bisect.bisect_right(at, place, lo)
                    parts.append(lo + count % (hi - lo + 1) if hi - lo > 1 else hi)  # cuts that equal it: its group spans these ranges
                    count += 1
                texts = part.column(2).cast(pa.large_binary()).to_pylist()
                out = [ids + last for ids in (encoder.many(texts) if len(texts) > 1 else map(encoder, texts))]
                yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), part.column(0), part.column(1), pa.array(out, pa.binary())], names=encoded.names)

    dealt = rows.select("id", F.xxhash64("text").alias("tie"), "text").mapInArrow(encode, encoded).repartition(len(places.value) + 1, "part")
    ordered = dealt.sortWithinPartitions("part", F.col("id").asc_nulls_last(), "tie")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, writer, done = -1, None, []
        for batch in batches:
            number = batch.column(0).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), len(number)]
            for lo, hi in itertools.pairwise(edges):
                if lo == hi:
                    continue
                if number[lo] != now:
                    if writer:
                        done.append((now, *writer.close()))
                    now, writer = int(number[lo]), _Writer(folder, width, bits, block, batch.schema.field(1).type)
                for part in slices(batch.slice(lo, hi - lo), 3):
                    data = part.column(3)
                    sizes = np.array([len(x.as_buffer()) for x in data], np.int64)
                    writer.add(part.column(1), b"".join(x.as_buffer() for x in data), sizes // width)
        if writer:
            done.append((now, *writer.close()))
        names = ("part", "file", "n_docs", "n_ids")
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], k) for i, k in enumerate((pa.int32(), pa.string(), pa.int64(), pa.int64()))], names=names)

    return table(ordered.mapInArrow(write, "part int, file string, n_docs long, n_ids long"), "token-files")


def read_ids(files: DataFrame, kind: T.DataType | str = "long") -> DataFrame:
    """Each document of the files: id (of type kind), start (ids of all documents before it), n_tokens, ids_crc32 (of the ids as 32-bit little-endian numbers) and ids_ok (whether its
    ids are all there). A task reads a file from its beginning to its end; the number of files, not of documents, comes to the driver."""
    spark = files.sparkSession
    ship(spark)
    listed = sorted((r["part"], r["file"], r["n_ids"]) for r in files.collect())
    starts = [0, *itertools.accumulate(n for *_, n in listed)]
    todo = spark.createDataFrame([(f, s) for (_, f, _), s in zip(listed, starts, strict=False)], "file string, start long").repartition(max(1, len(listed)), "file")
    kind = T._parse_datatype_string(kind) if isinstance(kind, str) else kind
    schema = T.StructType([T.StructField("id", kind), *T._parse_datatype_string("start long, n_tokens long, ids_crc32 long, ids_ok boolean").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                file, at = IdFile(name), 0
                for docs in file.documents().to_batches(max_chunksize=10_000):
                    ns = docs.column(1).to_numpy()
                    ends = at + np.cumsum(ns)
                    sums, whole = [], []
                    for stop, n in zip(ends.tolist(), ns.tolist(), strict=True):
                        crc, got = 0, 0
                        for ids in file.read(stop - n, stop):
                            crc, got = zlib.crc32(ids.astype("<u4").tobytes(), crc), got + len(ids)
                        sums.append(crc)
                        whole.append(got == n)
                    yield pa.RecordBatch.from_arrays([docs.column(0), pa.array(start + ends - ns, pa.int64()), docs.column(1), pa.array(sums, pa.int64()), pa.array(whole)],
                        names=schema.names)
                    at = int(ends[-1])

    return todo.mapInArrow(run, schema)
