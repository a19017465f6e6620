"""Token-id output: a store of shard files whose documents are compressed one by one with a shared zstandard dictionary.

A store is a folder: ``dictionary`` (bytes of the dictionary, empty if none could be trained), ``shard-*.ftok`` and a table
``manifest`` with a row for each shard, in whose order (task, seq) ids ascend. A shard file holds documents in ascending id order::

    b"FTOKEN01"  sha256 of the dictionary (32 bytes)  id width in bytes (u4)
    frames       each document's ids, little-endian, compressed by itself
    index        ids (i8 * n)  token counts (u4 * n)  offsets of the frames (u8 * (n + 1))
    footer       n (u8)  offset of the index (u8)  b"FTOKEN01"

so that one short document is read by its index entry and one small frame, without its neighbours.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import NULL_ID, fresh_path, id_and_text, id_key, part_count, sample_rows, schema
from .pieces import CACHED, PieceCache

MAGIC = b"FTOKEN01"
#: Documents that are encoded together.
ROWS = 1000
HEAD, FOOT = struct.Struct("<8s32sI"), struct.Struct("<QQ8s")


def byte_letters() -> str:
    """The letter that byte-level vocabularies write for each byte: printable ones stand for themselves, the rest follow 255."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = iter(range(256, 512))
    return "".join(chr(b) if b in plain else chr(next(rest)) for b in range(256))


class Encoder(PieceCache):
    """The tokenizers library with a bounded cache; gives the ids of ``Tokenizer.encode(text, add_special_tokens=False)``.

    Under the byte-level pre-tokenizer with its own splitting pattern, new parts that are one pre-token each go through the
    library together, already split; the rest, and all texts under other tokenizers, are encoded as they are.
    """

    def __init__(self, path: str):
        super().__init__()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        split = made.get("pre_tokenizer") or {}
        self.special = tuple(t["content"] for t in made.get("added_tokens", []))
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.letters = byte_letters()
        self.line = self.tokenizer.token_to_id(self.letters[10])
        self.by_piece = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and not made.get("normalizer") and self.line is not None
        self.split = Tokenizer.from_file(path)
        self.split.pre_tokenizer = pre_tokenizers.Split(self.letters[10], "isolated")
        self.words, self.word_ids = pa.array([], pa.string()), pa.array([], pa.large_binary())
        self.asked = np.zeros(0, np.int64)  # when each word was last asked for

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def _joined(self, tokenizer, text: str) -> list[bytes]:
        """Ids of each line of a text in which no line break is within or beside other white space."""
        ids = np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype)
        width = self.dtype.itemsize
        cuts = (np.flatnonzero(ids == self.line) * width).tolist()
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip([0, *(c + width for c in cuts)], [*cuts, len(raw)])]

    def solid(self, texts: list[str]) -> list[bytes]:
        letters = [i for i, t in enumerate(texts) if t.lstrip(" ").isalpha()]
        out: list = [b""] * len(texts)
        if letters:
            joined = "\n".join([texts[i] for i in letters]).encode("utf-8", "surrogatepass").decode("latin-1").translate(self.letters)
            for i, ids in zip(letters, self._joined(self.split, joined)):
                out[i] = ids
        if len(letters) < len(texts):
            done = set(letters)
            rest = [i for i in range(len(texts)) if i not in done]
            for i, ids in zip(rest, self._joined(self.tokenizer, "\n".join([texts[i] for i in rest]))):
                out[i] = ids
        return out

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        return super().encode_batch(texts) if self.by_piece else self.whole(texts)

    def encode_each(self, texts: pa.StringArray) -> list[bytes]:
        """The ids of each text of an Arrow column."""
        if not self.by_piece:
            return self.whole(texts.to_pylist())
        odd = self._odd(texts)
        slow = odd.to_numpy(zero_copy_only=False)
        plain = iter(self._by_words(texts.filter(pc.invert(odd)).cast(pa.string())) if not slow.all() else ())
        rest = iter(self.encode_batch(texts.filter(odd).to_pylist()) if slow.any() else ())
        return [next(rest) if s else next(plain) for s in slow]

    def _by_words(self, texts: pa.StringArray) -> list[bytes]:
        """Ids of texts without odd white space or special tokens; words after spaces are looked up, and their ids put together, by Arrow."""
        self.pieces.age()
        cut = pc.split_pattern(texts, " ")
        bounds = cut.offsets.to_numpy().astype(np.int64)
        bounds = bounds - bounds[0]
        coded = cut.flatten().dictionary_encode()
        which = coded.indices.to_numpy().astype(np.int64)
        heads = coded.dictionary.take(pa.array(which[bounds[:-1]])).to_pylist()  # nothing stands before these
        first = self._looked_for(heads, self.pieces)
        inner = np.ones(len(which), bool)
        inner[bounds[:-1]] = False
        place = np.zeros(len(coded.dictionary), np.int64)
        used = np.zeros(len(place), bool)
        used[which[inner]] = True
        place[used] = self._places(coded.dictionary.filter(pa.array(used)))
        at = place[which]
        at[bounds[:-1]] = len(self.word_ids) + np.arange(len(heads))
        found = pa.concat_arrays([self.word_ids, pa.array(first, pa.large_binary())]).take(pa.array(at))
        ends = np.frombuffer(found.buffers()[1], np.int64, len(found) + 1, 8 * found.offset)[bounds].tolist()
        data = found.buffers()[2]
        raw = memoryview(b"" if data is None else data)
        return [bytes(raw[a:b]) for a, b in zip(ends, ends[1:])]

    def _looked_for(self, keys: list[str], known) -> list[bytes]:
        found = list(map(known.__getitem__, keys))
        if self.parts.missed or self.pieces.missed:
            self._learn()
            self._fill(found, keys, known.__getitem__)
        return found

    def _places(self, words: pa.StringArray) -> np.ndarray:
        """Where the ids of distinct words that follow a space stand in ``word_ids``; new words are added there."""
        if len(self.words) > 2 * CACHED:
            kept = pa.array(np.sort(np.argpartition(-self.asked, CACHED)[:CACHED]))  # the last asked for
            self.words, self.word_ids, self.asked = self.words.take(kept), self.word_ids.take(kept), self.asked[kept.to_numpy()]
        found = pc.index_in(words, value_set=self.words)
        new = pc.is_null(found)
        places = pc.fill_null(found, 0).to_numpy().astype(np.int64)
        mask = new.to_numpy(zero_copy_only=False)
        if mask.any():
            places[mask] = len(self.words) + np.arange(mask.sum())
            missed = words.filter(new)
            self.words, self.word_ids = pa.concat_arrays([self.words, missed]), pa.concat_arrays([self.word_ids, self._ids_of(missed)])
            self.asked = np.r_[self.asked, np.zeros(len(missed), np.int64)]
        self.asked[places] = self.asked.max(initial=0) + 1
        return places

    def _ids_of(self, words: pa.StringArray) -> pa.LargeBinaryArray:
        """The ids of each word after a space. ASCII letters are one pre-token, a stop after them another; each stem is encoded once."""
        plain = pc.match_substring_regex(words, "^[A-Za-z]+[,.]?$")
        simple = words.filter(plain)
        stems = pc.ascii_rtrim(simple, characters=",.").dictionary_encode()
        ids = self._stem_ids(stems.dictionary).take(stems.indices)
        comma, point = self._looked_for([",", "."], self.pieces)
        byte = lambda x: pa.scalar(x, pa.large_binary())
        stop = pc.if_else(pc.ends_with(simple, ","), byte(comma), pc.if_else(pc.ends_with(simple, "."), byte(point), byte(b"")))
        ids = pc.binary_join_element_wise(ids, stop, byte(b""))
        self.parts.age()
        rest = self._looked_for(words.filter(pc.invert(plain)).to_pylist(), self.parts)
        mask = plain.to_numpy(zero_copy_only=False)
        at = np.where(mask, np.cumsum(mask) - 1, len(ids) + np.cumsum(~mask) - 1)
        return pa.concat_arrays([ids, pa.array(rest, pa.large_binary())]).take(pa.array(at))

    def _stem_ids(self, stems: pa.StringArray) -> pa.LargeBinaryArray:
        if not len(stems):
            return pa.array([], pa.large_binary())
        between, space = self.letters[10], self.letters[32]
        joined = space + pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(stems)], pa.int32()), stems), between + space)[0].as_py()
        ids = np.array(self.split.encode_batch_fast([joined], add_special_tokens=False)[0].ids, self.dtype)
        ends = np.append(np.flatnonzero(ids == self.line), len(ids)) - np.arange(len(stems))
        offsets = np.r_[0, ends].astype(np.int64) * self.dtype.itemsize
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(stems), [None, pa.py_buffer(offsets), pa.py_buffer(ids[ids != self.line].tobytes())])


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each worker process and vocabulary."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def train_dictionary(samples: list[bytes], size: int) -> bytes:
    """A dictionary of at most ``size`` bytes; the samples' own bytes where there are too few to train on."""
    samples = [s for s in samples if s]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if len(data) >= 8 else None


def _put(uri: str, data: bytes) -> None:
    """Write a file whole or not at all; a repeated attempt writes the same bytes over it."""
    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(os.path.dirname(path), recursive=True)
    own = f"{path}.{os.getpid()}.part"
    with store.open_output_stream(own) as f:
        f.write(data)
    if store.get_file_info(path).type != fs.FileType.NotFound and store.type_name != "local":
        store.delete_file(path)
    store.move(own, path)


def _uri(path: str) -> str:
    return path if re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*:", path) else f"file://{os.path.abspath(path)}"


def pack_shard(ids: list[int], frames: list[bytes], counts: list[int], dict_hash: bytes, width: int) -> bytes:
    head = HEAD.pack(MAGIC, dict_hash, width)
    offsets = np.cumsum([len(head), *map(len, frames)]).astype("<u8")
    body = b"".join(frames)
    return b"".join((head, body, np.array(ids, "<i8").tobytes(), np.array(counts, "<u4").tobytes(), offsets.tobytes(), FOOT.pack(len(ids), len(head) + len(body), MAGIC)))


class Shard:
    """A shard file opened for reading; documents are decompressed one at a time."""

    def __init__(self, uri: str, dictionary: bytes):
        store, path = fs.FileSystem.from_uri(uri)
        self.file = store.open_input_file(path)
        size = self.file.size()
        n, index, magic = FOOT.unpack(self.file.read_at(FOOT.size, size - FOOT.size))
        first, made_with, self.width = HEAD.unpack(self.file.read_at(HEAD.size, 0))
        if magic != MAGIC or first != MAGIC:
            raise ValueError(f"{uri} is not a token shard")
        if made_with != hashlib.sha256(dictionary).digest():
            raise ValueError(f"{uri} was written with another dictionary")
        raw = self.file.read_at(size - FOOT.size - index, index)
        self.ids = np.frombuffer(raw, "<i8", n)
        self.counts = np.frombuffer(raw, "<u4", n, 8 * n)
        self.offsets = np.frombuffer(raw, "<u8", n + 1, 12 * n)
        self.decompressor = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary))

    def tokens(self, i: int) -> np.ndarray:
        a, b = int(self.offsets[i]), int(self.offsets[i + 1])
        raw = self.decompressor.decompress(self.file.read_at(b - a, a))
        return np.frombuffer(raw, f"<u{self.width}")


#: Range partitions of one write at most; each task writes as many shards as its rows fill.
MOST_TASKS = 20_000


def write_tokens(docs: DataFrame, tokenizer_path: str, to: str | None = None, end_id: int | None = 2, id_col: str = "doc_id", text_col: str = "text", sample: int = 1000, dictionary_kb: int = 32, shard_mb: int = 16, longest: int = 50_000) -> str:
    """Encode every whole text of ``docs`` and write a store; returns its path (a new one in the shared folder if not given).

    A null text is empty; ``end_id`` (None: none) is appended to each document. Shards follow each other in ascending order of
    id; null ids come first, equal ids are ordered by a hash of their text, and one id may go on in the next shard; repeated
    rows are all written. A task sorts its range of ids and streams it into shards of about ``shard_mb`` MB, so it never holds
    more than one shard. The dictionary is trained on about ``sample`` documents (at most twice as many) of at most ``longest``
    characters, chosen by a hash of id and text. An empty table makes an empty store.
    """
    spark = docs.sparkSession
    to = _uri(to or fresh_path(spark, "tokens"))
    held = id_and_text(docs, id_col, text_col)
    end = [] if end_id is None else [end_id]
    encode = encoder(tokenizer_path)
    picked = sample_rows(held.where(F.length("text") <= longest), sample, ("doc_id", "text"))
    dictionary = train_dictionary([encode.encode(r["text"]) for r in picked], dictionary_kb << 10)
    dict_hash = hashlib.sha256(dictionary).digest()
    width = encode.dtype.itemsize
    _put(f"{to}/dictionary", dictionary)
    names = ["task", "seq", "file", "n_docs", "n_tokens", "n_bytes", "first_id", "last_id"]
    form = pa.schema([("task", pa.int32()), ("seq", pa.int32()), ("file", pa.string()), *((c, pa.int64()) for c in names[3:])])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = encoder(tokenizer_path)
        last = np.array(end, made.dtype).tobytes()
        press = zstandard.ZstdCompressor(level=1, dict_data=_dictionary(dictionary))
        task, seq, size = TaskContext.get().partitionId(), 0, 0
        ids: list[int] = []
        frames: list[bytes] = []
        counts: list[int] = []

        def close() -> pa.RecordBatch:
            nonlocal seq, size
            name = f"shard-{task:06d}-{seq:06d}.ftok"
            data = pack_shard(ids, frames, counts, dict_hash, width)
            _put(f"{to}/{name}", data)
            row = [task, seq, name, len(ids), sum(counts), len(data), ids[0], ids[-1]]
            seq, size = seq + 1, 0
            for held in (ids, frames, counts):
                held.clear()
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, form)], schema=form)

        for batch in batches:
            keys = batch.column("doc_id").fill_null(NULL_ID).to_pylist()
            for at in range(0, len(keys), ROWS):
                for key, raw in zip(keys[at : at + ROWS], made.encode_each(batch.column("text")[at : at + ROWS])):
                    frame = press.compress(raw + last)
                    ids.append(key)
                    frames.append(frame)
                    counts.append((len(raw) + len(last)) // width)
                    size += len(frame)
                    if size >= shard_mb << 20:
                        yield close()
        if ids:
            yield close()

    # the last key deals out a row that is repeated very often; it does not depend on who computes it
    keys = [id_key("doc_id"), F.xxhash64("text"), F.monotonically_increasing_id()]
    ordered = held.select("doc_id", "text", *(k.alias(f"k{i}") for i, k in enumerate(keys)))
    ordered = ordered.repartitionByRange(min(MOST_TASKS, part_count(docs, shard_mb)), "k0", "k1", "k2").sortWithinPartitions("k0", "k1", "k2").select("doc_id", "text")
    ordered.mapInArrow(write, schema(task="int", seq="int", file="string", n_docs="long", n_tokens="long", n_bytes="long", first_id="long", last_id="long")).write.parquet(f"{to}/manifest")
    return to


def _load_dictionary(to: str) -> bytes:
    store, path = fs.FileSystem.from_uri(f"{_uri(to)}/dictionary")
    with store.open_input_stream(path) as f:
        return f.read()


def read_tokens(spark: SparkSession, store: str) -> DataFrame:
    """The documents of a store: doc_id, start (ids of all documents before it), n_tokens, ids (little-endian u4, as bytes).

    The running start takes one window over the manifest, which has a row for each shard, never over documents.
    """
    store = _uri(store)
    manifest = spark.read.parquet(f"{store}/manifest")
    before = F.sum("n_tokens").over(Window.orderBy("task", "seq").rowsBetween(Window.unboundedPreceding, -1))
    todo = manifest.select("file", F.coalesce(before, F.lit(0)).alias("before"))
    shards = max(1, min(MOST_TASKS, manifest.count()))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dictionary = None
        for batch in batches:
            for name, at in zip(batch.column("file").to_pylist(), batch.column("before").to_pylist()):
                dictionary = _load_dictionary(store) if dictionary is None else dictionary
                shard = Shard(f"{store}/{name}", dictionary)
                starts = at + np.cumsum(shard.counts, dtype=np.int64) - shard.counts
                for i in range(0, len(shard.ids), 500):
                    j = min(i + 500, len(shard.ids))
                    ids = [None if x == NULL_ID else int(x) for x in shard.ids[i:j]]
                    blobs = [shard.tokens(k).astype("<u4").tobytes() for k in range(i, j)]
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts[i:j]), pa.array(shard.counts[i:j].astype(np.int64)), pa.array(blobs, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    return todo.repartition(shards, "file").mapInArrow(read, schema(doc_id="long", start="long", n_tokens="long", ids="binary"))


def read_document(spark: SparkSession, store: str, doc_id: int) -> list[np.ndarray]:
    """The ids of one document (of each row that has this id): its shards are found by the manifest's id ranges, its frame by the index."""
    store = _uri(store)
    near = spark.read.parquet(f"{store}/manifest").where((F.col("first_id") <= doc_id) & (F.col("last_id") >= doc_id)).orderBy("task", "seq").collect()
    dictionary, found = _load_dictionary(store), []
    for row in near:
        shard = Shard(f"{store}/{row['file']}", dictionary)
        a, b = np.searchsorted(shard.ids, doc_id), np.searchsorted(shard.ids, doc_id, side="right")
        found += [shard.tokens(i) for i in range(a, b)]
    return found


__all__ = ["Encoder", "Shard", "read_document", "read_tokens", "write_tokens"]
