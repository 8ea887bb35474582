"""Token ids in binary shards: each document compressed by itself with one shared zstandard dictionary.

A store is a folder: ``dictionary-<hash>.zdict``, trained on the serialized ids of a bounded sample
(at most twice ``SAMPLE`` documents drawn by a hash, of each ``SAMPLE_CHARS`` characters at a hashed place; this touches the
compression only, never the ids), and shards ``ids-<range>-<roll>.tok``:

    magic (8 bytes) | header length (4) | JSON header: dictionary hash, documents, ids
    | validity of the document ids (n x 1) | document ids (n x 8) | id counts (n x 8) | frame offsets ((n + 1) x 8) | frames

Ids are little-endian 16-bit integers where the vocabulary allows it (``width`` in the header), else 32-bit. Shards follow the ascending document id; a shard is written
under a temporary name and renamed, so a lost executor's tasks are repeated without harm, and a manifest lists what is whole. ``get`` reads
a document by its id: the manifest's spans of ids name the shard, then the shard's index and the document's frame are read at their places.

Defined results:
- null text is empty: only the end id; very long texts are one frame;
- rows with equal ids follow each other in the order of their texts' hashes, null ids come first; an id of very many rows is cut between texts;
- an empty table makes a store without shards; with too few documents to train on, the dictionary is their raw content;
- further columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import struct
from collections.abc import Callable, Iterator
from itertools import chain, pairwise, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.llm import flat, ranges, staging

MAGIC, END = b"PLTOKS1\n", 1
SAMPLE, SAMPLE_CHARS, DICT_BYTES = 2000, 2000, 64 << 10
#: Text bytes of a range (a task), and id bytes after which a shard is rolled.
RANGE_BYTES, SHARD_BYTES = 16 << 20, 64 << 20
#: Words that a process remembers, the bytes of the longest that it does, and the ids of all: about 70 MB.
CACHE_WORDS, CACHE_WORD_BYTES, CACHE_IDS = 300_000, 64, 4 << 20
MANIFEST = "path string, shard_range int, roll int, documents long, ids long, bytes long, first_id long, last_id long"


def _byte_letters() -> dict[int, str]:
    """For the letters of SPLIT, the signs that byte-level vocabularies write their UTF-8 bytes with: printable ones as they are, others counted up from 256."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in printable]
    sign = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(other)}
    return {c: "".join(sign[b] for b in chr(c).encode()) for c in range(0xDF, 0x100)}


#: A word of letters that normalising leaves as they are, and the ASCII signs after it: the two are split before any merge.
SPLIT = r"^(?P<stem>[a-z\x{DF}-\x{F6}\x{F8}-\x{FF}]+)(?P<tail>[!-/:-@\[-`{-~]*)\z"
BYTE_LETTERS = _byte_letters()


def _spans(words: pa.Array) -> list[bytes]:
    """The values of an unsliced large binary array without nulls."""
    begins, blob = np.frombuffer(words.buffers()[1], np.int64)[: len(words) + 1].tolist(), (words.buffers()[2] or pa.py_buffer(b"")).to_pybytes()
    return [blob[i:j] for i, j in pairwise(begins)]


def _room(held: np.ndarray, need: int) -> np.ndarray:
    """The array with room for ``need`` elements, at least doubled if it has less."""
    return held if len(held) >= need else np.concatenate([held, np.zeros(max(need - len(held), len(held)), held.dtype)])


class Encoder:
    """Whole texts to id bytes. Words between ASCII white space are encoded once and remembered: the tokenizer never joins ids across white space.

    A known word has a row: its ids are ``size`` elements of ``pool`` from ``begin`` on, and it was met in ``seen`` portions."""

    def __init__(self, tokenizer_path: str, width: int, plain: bool = False):
        """``plain``: the special tokens' strings in a text are ordinary text."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.tokenizer.encode_special_tokens = plain
        if not self._plain_letters():
            raise ValueError(f"{tokenizer_path}: not a byte-level tokenizer that lower-cases")
        self.kind = "<u2" if width == 2 else "<u4"
        self._reset([b""], np.zeros(0, self.kind), np.zeros(1, np.int64), np.ones(1, np.int32))

    def _whole(self, words: list[str]) -> list[list[int]]:
        return [code.ids for code in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _merged(self, word: str) -> list[int]:
        """Normalising leaves the letters of ``SPLIT`` as they are and they are one run, so the model's merges are all that is left to do."""
        return [t.id for t in self.tokenizer.model.tokenize(word if word.isascii() else word.translate(BYTE_LETTERS))]

    def _plain_letters(self) -> bool:
        """Whether the short way for words of letters, and signs after them, gives what the whole tokenizer gives."""
        words, tails = ["the", "ciónue", "für", "ÿþàçß", "xqzjk"], ["", ",", "!!", "...", "'", '")', "<|", "$&"]
        return all(self._merged(w) + ids == self._whole([w + t])[0] for w in words for t, ids in zip(tails, self._whole(tails), strict=True))

    def _reset(self, words: list[bytes], ids: np.ndarray, sizes: np.ndarray, seen: np.ndarray) -> None:
        self.place: dict[bytes, int] = {}
        self.rows, self.held, self.long = 0, 0, []
        self.pool, self.begin, self.size, self.seen = np.zeros(1 << 16, self.kind), np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int32)
        self._add(words, ids, sizes)
        self.seen[: len(seen)] = seen

    def _add(self, words: list[bytes], ids: np.ndarray, sizes: np.ndarray) -> None:
        """Rows for new words, whose ids follow each other."""
        rows, held = self.rows + len(words), self.held + len(ids)
        self.pool, self.begin, self.size, self.seen = _room(self.pool, held), _room(self.begin, rows), _room(self.size, rows), _room(self.seen, rows)
        self.pool[self.held : held], self.size[self.rows : rows], self.seen[self.rows : rows] = ids, sizes, 0
        self.begin[self.rows : rows] = self.held + np.cumsum(sizes) - sizes
        self.place.update(zip(words, range(self.rows, rows), strict=True))
        self.long += [w for w in words if len(w) > CACHE_WORD_BYTES]
        self.rows, self.held = rows, held

    def _gather(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows, one after the other, and where each begins (with the total at the end)."""
        sizes = self.size[rows]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        at = np.repeat((self.begin[rows] - ends[:-1]).astype(np.int32), sizes)  # a portion, and the pool, have far fewer than 2^31 ids
        at += np.arange(ends[-1], dtype=np.int32)
        return self.pool[at], ends

    def _places(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.place.get, words, repeat(-1)), np.int64, len(words))

    def _learn(self, words: pa.Array) -> None:
        """Rows for distinct words that have none."""
        split = pc.extract_regex(words.cast(pa.large_string()), SPLIT)
        plain = split.is_valid()
        stems, tails = (split.field(i).filter(plain).cast(pa.large_binary()) for i in range(2))
        new = [w for w in _spans(stems.unique()) if w not in self.place]
        for i in range(0, len(new), 5_000):
            self._add_lists(new[i : i + 5_000], list(map(self._merged, (w.decode() for w in new[i : i + 5_000]))))
        new = [w for w in chain(_spans(tails.unique()), _spans(words.filter(pc.invert(plain)))) if w not in self.place]
        for i in range(0, len(new), 5_000):
            self._add_lists(new[i : i + 5_000], self._whole([w.decode("utf-8", "replace") for w in new[i : i + 5_000]]))
        both = pc.greater(pc.binary_length(tails), 0)
        stems, tails = (self._places(_spans(x.filter(both))) for x in (stems, tails))
        ids, ends = self._gather(np.stack([stems, tails], 1).reshape(-1))
        self._add(_spans(words.filter(plain).filter(both)), ids, np.diff(ends[::2]))

    def _add_lists(self, words: list[bytes], ids: list[list[int]]) -> None:
        self._add(words, np.fromiter(chain.from_iterable(ids), self.kind), np.fromiter(map(len, ids), np.int64, len(ids)))

    def trim(self) -> None:
        """Words beyond ``CACHE_WORD_BYTES``, of which there may be any, are forgotten; of too many words those met in most portions stay."""
        for word in self.long:
            self.place.pop(word, None)
        self.long = []
        if len(self.place) <= CACHE_WORDS and self.held <= CACHE_IDS:
            return
        words, rows = list(self.place), np.fromiter(self.place.values(), np.int64, len(self.place))
        best = np.flatnonzero(self.seen[rows] > 1)
        best = best[np.argsort(-self.seen[rows[best]], kind="stable")[: CACHE_WORDS // 2]]
        best = np.append(0, best[best > 0])  # the empty word is the first
        ids, ends = self._gather(rows[best])
        self._reset([words[i] for i in best.tolist()], ids, np.diff(ends), self.seen[rows[best]] // 2)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and where each begins (with the total at the end). Distinct words are found by Arrow, the ids are put together by numpy."""
        self.trim()
        # copied first: Arrow's kernels misread a slice that was cast
        texts = texts.take(pa.array(np.arange(len(texts)))).cast(pa.large_string()).fill_null("")
        # lower case first makes fewer words; the tokenizer lower-cases too, but finds its special strings before
        texts = pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts))
        lists = pc.ascii_split_whitespace(texts)
        coded = lists.flatten().cast(pa.large_binary()).dictionary_encode()
        words = _spans(coded.dictionary)
        rows = self._places(words)
        new = np.flatnonzero(rows < 0)
        if len(new):
            self._learn(coded.dictionary.take(pa.array(new)))
            rows[new] = self._places([words[i] for i in new.tolist()])
        self.seen[rows] += 1
        joined, ends = self._gather(rows[coded.indices.to_numpy()])
        offsets = lists.offsets.to_numpy()
        return joined, ends[offsets - offsets[0]]


_encoders: dict[tuple[str, int, bool], Encoder] = {}


def encoder_of(tokenizer_path: str, width: int, plain: bool = False) -> Encoder:
    """This process's encoder: tasks that follow each other in a worker share the words it knows."""
    key = (tokenizer_path, width, plain)
    if key not in _encoders:
        _encoders[key] = Encoder(*key)
    return _encoders[key]


def portions(batch: pa.RecordBatch, column: int, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of at most about ``limit`` characters of text (or one row)."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + limit, "right")))
        yield batch.slice(i, j - i)
        i = j


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def vocabulary(tokenizer_path: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path).get_vocab_size(with_added_tokens=True)


def train_dictionary(samples: list[bytes], size: int = DICT_BYTES) -> bytes:
    """Dictionary bytes; with too little to train on, the samples themselves."""
    try:
        return zstandard.train_dictionary(min(size, max(1024, sum(map(len, samples)) // 8)), samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def as_dictionary(raw: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(raw) if len(raw) >= 8 else None


def shard_bytes(rows: list[tuple[int | None, int, bytes]], dictionary_hash: str, width: int) -> bytes:
    """A shard of (document id, ids, frame)."""
    n = len(rows)
    header = json.dumps({"dictionary": dictionary_hash, "documents": n, "ids": sum(r[1] for r in rows), "width": width}, sort_keys=True).encode()
    offsets = np.concatenate([[0], np.cumsum([len(r[2]) for r in rows])]).astype("<i8")
    return b"".join([
        MAGIC, struct.pack("<I", len(header)), header,
        np.array([r[0] is not None for r in rows], np.uint8).tobytes(),
        np.array([r[0] or 0 for r in rows], "<i8").tobytes(),
        np.array([r[1] for r in rows], "<i8").tobytes(),
        offsets.tobytes(), *[r[2] for r in rows],
    ])


class Shard:
    """A shard's index, and its documents one by one."""

    def __init__(self, blob: bytes, dictionary: Callable[[str], bytes]):
        if blob[:8] != MAGIC:
            raise ValueError("not a token shard")
        size = struct.unpack_from("<I", blob, 8)[0]
        self.header = json.loads(blob[12 : 12 + size])
        n, at = self.header["documents"], 12 + size
        self.valid = np.frombuffer(blob, np.uint8, n, at).astype(bool)
        self.doc_ids, self.counts = (np.frombuffer(blob, "<i8", n, at + n + 8 * n * k) for k in (0, 1))
        self.offsets = np.frombuffer(blob, "<i8", n + 1, at + 17 * n)
        self.base, self.blob = at + 17 * n + 8 * (n + 1), memoryview(blob)
        raw = dictionary(self.header["dictionary"])
        if hashlib.sha256(raw).hexdigest() != self.header["dictionary"]:
            raise ValueError("the dictionary is not the one this shard was written with")
        shared = as_dictionary(raw)
        self.reader = zstandard.ZstdDecompressor(dict_data=shared) if shared else zstandard.ZstdDecompressor()

    def ids(self, i: int) -> np.ndarray:
        """The ids of the i-th document, as 32-bit integers."""
        return self.decode(self.blob[self.base + self.offsets[i] : self.base + self.offsets[i + 1]])

    def decode(self, frame: bytes | memoryview) -> np.ndarray:
        """The ids in a document's frame."""
        kind = "<u2" if self.header["width"] == 2 else "<u4"
        return np.frombuffer(self.reader.decompress(frame), kind).astype("<u4")


def _width_and_dictionary(texts: list[str], tokenizer_path: str, end_id: int) -> tuple[int, bytes]:
    width = 2 if max(vocabulary(tokenizer_path) - 1, end_id) < 1 << 16 else 4
    encoder = encoder_of(tokenizer_path, width)
    ids, cuts = encoder.encode(pa.array(texts, pa.string()))
    encoder.trim()
    return width, train_dictionary([x for x in (ids[i:j].tobytes() for i, j in pairwise(cuts.tolist())) if x])


def _learned(drawn: DataFrame, tokenizer_path: str, end_id: int) -> tuple[int, bytes]:
    """Bytes of an id, and the dictionary trained on the texts ``drawn``. One task of an executor makes them: the driver holds neither the tokenizer nor the sample."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width, raw = _width_and_dictionary([t for batch in batches for t in batch.column(0).to_pylist()], tokenizer_path, end_id)
        flat.tidy()
        yield pa.RecordBatch.from_arrays([pa.array([width], pa.int32()), pa.array([raw], pa.binary())], names=["width", "raw"])

    # an empty text has no ids; with it there is a task even where nothing was drawn
    empty = drawn.sparkSession.range(0, 1, 1, 1).select(F.lit("").alias("text"))
    got = drawn.unionByName(empty).coalesce(1).mapInArrow(work, "width int, raw binary").first()
    return got["width"], bytes(got["raw"])


def write(documents: DataFrame, at: str, *, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None, end_id: int = END, range_bytes: int = RANGE_BYTES, shard_limit: int = SHARD_BYTES, level: int = 3) -> DataFrame:
    """Write the store and return its manifest, in order: a row for each shard."""
    spark = documents.sparkSession
    tokenizer_path = tokenizer_path or default_tokenizer()
    rows = documents.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    # pieces at hashed places of hashed documents, so that every part of every text may be drawn
    draw = F.pmod(F.xxhash64("id", "text"), F.lit(1 << 30))
    begin = F.pmod(F.xxhash64("id", "text", F.lit("begin")), F.greatest(F.lit(1), F.length("text") - SAMPLE_CHARS + 1)).cast("int") + 1
    some = min(1.0, 1.5 * SAMPLE / max(1, rows.count()))
    drawn = rows.where(draw < int(some * (1 << 30))).select(draw.alias("draw"), F.substr("text", begin, F.lit(SAMPLE_CHARS)).alias("text")).orderBy("draw", "text").limit(2 * SAMPLE)
    width, raw = _learned(drawn.select("text"), tokenizer_path, end_id)
    name = hashlib.sha256(raw).hexdigest()
    staging.commit_file(f"{at}/dictionary-{name}.zdict", raw)
    shared = spark.sparkContext.broadcast(raw)

    rows = rows.withColumn("tie", F.pmod(F.xxhash64("text"), F.lit(ranges.TIES)))
    place, count = ranges.places(rows, "id", F.octet_length("text") + 16, range_bytes, F.col("tie"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer_path, width)
        end = np.array([end_id], encoder.kind).tobytes()
        known = as_dictionary(shared.value)
        writer = zstandard.ZstdCompressor(level=level, dict_data=known) if known else zstandard.ZstdCompressor(level=level)
        made: list[tuple] = []
        held: list[tuple[int | None, int, bytes]] = []
        size, roll, part = 0, 0, None

        def close() -> None:
            nonlocal size, roll, held
            if held:
                blob = shard_bytes(held, name, width)
                path = f"ids-{part:06d}-{roll:04d}.tok"
                staging.commit_file(f"{at}/{path}", blob)
                given = [r[0] for r in held if r[0] is not None]
                made.append((path, part, roll, len(held), sum(r[1] for r in held), len(blob), min(given, default=None), max(given, default=None)))
            size, roll, held = 0, roll + 1, []

        for batch in batches:
            for piece in portions(batch, 2):
                ids, cuts = encoder.encode(piece.column(2))
                for p, doc, i, j in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                    code = ids[i:j].tobytes()
                    if p != part:
                        close()
                        part, roll = p, 0
                    elif size >= shard_limit:
                        close()
                    held.append((doc, len(code) // width + 1, writer.compress(code + end)))
                    size += len(code) + width
        close()
        encoder.trim()
        flat.tidy()
        kinds = [pa.string(), pa.int32(), pa.int32(), *[pa.int64()] * 5]
        columns = list(zip(*made, strict=True)) if made else [[]] * len(kinds)
        names = ["path", "shard_range", "roll", "documents", "ids", "bytes", "first_id", "last_id"]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    ordered = rows.withColumn("part", place).repartitionById(count, F.col("part")).sortWithinPartitions("part", F.col("id").asc_nulls_first(), "tie", "text")
    ordered.select("part", "id", "text").mapInArrow(work, MANIFEST).write.parquet(f"{at}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{at}/manifest").orderBy("shard_range", "roll")


def read(spark: SparkSession, at: str) -> DataFrame:
    """``doc_id``, ``start`` (ids of all documents before it), ``n_tokens``, ``ids`` (little-endian 32-bit), from the files."""
    files = ranges.files(spark.read.schema(MANIFEST).parquet(f"{at}/manifest"), "shard_range", "ids")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dictionaries: dict[str, bytes] = {}

        def dictionary(name: str) -> bytes:
            if name not in dictionaries:
                dictionaries[name] = staging.read_file(f"{at}/dictionary-{name}.zdict")
            return dictionaries[name]

        for batch in batches:
            for path, start in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                shard = Shard(staging.read_file(f"{at}/{path}"), dictionary)
                begins = start + np.concatenate([[0], np.cumsum(shard.counts)])
                for i in range(0, len(shard.counts), 256):
                    rows = range(i, min(i + 256, len(shard.counts)))
                    own = slice(rows.start, rows.stop)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(shard.doc_ids[own], mask=~shard.valid[own]), pa.array(begins[own]), pa.array(shard.counts[own]), pa.array([shard.ids(k).tobytes() for k in rows], pa.binary())],
                        names=["doc_id", "start", "n_tokens", "ids"],
                    )

    return files.mapInArrow(work, "doc_id long, start long, n_tokens long, ids binary")


def get(spark: SparkSession, at: str, doc_id: int) -> list[np.ndarray]:
    """The ids of the rows with this document id, in the store's order, without reading whole shards: the manifest tells which shards
    can hold it, and of each only the header, the index and the document's own frame are read, at their places."""
    fits = (F.col("first_id") <= doc_id) & (F.col("last_id") >= doc_id)
    shards = spark.read.schema(MANIFEST).parquet(f"{at}/manifest").where(fits).orderBy("shard_range", "roll").select("path").collect()
    found = []
    for shard in shards:
        files, path = staging.open_fs(f"{at}/{shard.path}")
        with files.open_input_file(path) as f:
            start = f.read_at(12, 0)
            size = struct.unpack_from("<I", start, 8)[0]
            n = json.loads(f.read_at(size, 12))["documents"]
            index = Shard(f.read_at(12 + size + 25 * n + 8, 0), lambda name: staging.read_file(f"{at}/dictionary-{name}.zdict"))
            for i in np.flatnonzero(index.valid & (index.doc_ids == doc_id)).tolist():
                begin, end = index.offsets[i : i + 2].tolist()
                found.append(index.decode(f.read_at(end - begin, index.base + begin)))
    return found


def digest(store: DataFrame) -> DataFrame:
    """``doc_id``, ``start``, ``n_tokens`` and the CRC-32 of the ids."""
    return store.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def query(spark, sf_dir: str) -> DataFrame:
    """``op3_token_store``: writes the store of all documents and reads it back."""
    at = staging.folder(spark, "tokens")
    write(spark.read.parquet(f"{sf_dir}/documents.parquet"), at)
    return digest(read(spark, at))
