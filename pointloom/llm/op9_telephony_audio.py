"""Telephony audio in media columns: mu-law, A-law and ADPCM in WAV files, decoded and resampled.

G.711 samples are expanded by 256-entry tables. ADPCM (IMA, in WAV blocks of ``BLOCK`` bytes) is decoded
by numpy across blocks: all blocks of a batch are stepped through together, a nibble at a time.
``decode`` gives 16-bit PCM at twice the telephone rate, made by a 4-tap half-band filter.
``pack`` writes any 16-bit PCM without loss: its even samples, and how far each odd one is from the half-band value of the even ones
(left out where none is off, as in all PCM that was resampled here). ``unpack`` needs nothing else to give the same bytes back.

Defined results:
- null media, and media that are no WAV file of these three formats, decode to null PCM;
- a file without samples decodes to empty PCM; a last block that is cut short gives the samples it has;
- step indexes beyond the table are held at its ends;
- null or empty text (in the query) is a payload of 192 spaces; equal texts give equal values;
- repeated rows and ids are each treated alike; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pointloom.llm import staging

RATE, BLOCK = 8000, 192
#: How the media and their PCM are written.
PARQUET = {"parquet.compression.codec.zstd.level": "9", "parquet.page.size": str(8 << 20)}
#: WAVE format tags. Fixed values.
TAGS = {"mulaw": 7, "alaw": 6, "adpcm": 17}
#: IMA ADPCM step sizes and index changes. Fixed values.
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449,
    494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493,
    10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
], np.int32)
MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)


def _mulaw() -> np.ndarray:
    code = ~np.arange(256) & 0xFF
    size = (((code & 15) << 3) + 132 << (code >> 4 & 7)) - 132
    return np.where(code & 128, -size, size).astype(np.int16)


def _alaw() -> np.ndarray:
    code = np.arange(256) ^ 0x55
    power, low = code >> 4 & 7, (code & 15) << 4
    size = np.where(power == 0, low + 8, low + 264 << np.maximum(power - 1, 0))
    return np.where(code & 128, size, -size).astype(np.int16)


TABLES = {"mulaw": _mulaw(), "alaw": _alaw()}


def adpcm(data: np.ndarray) -> np.ndarray:
    """Blocks x bytes to blocks x samples."""
    blocks, width = data.shape
    out = np.empty((1 + 2 * (width - 4), blocks), np.int16)
    value = data[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(data[:, 2], 88).astype(np.int32)
    out[0] = value
    body = np.ascontiguousarray(data[:, 4:].T)
    for k in range(2 * (width - 4)):
        code = (body[k >> 1] >> (4 * (k & 1)) & 15).astype(np.int32)
        step = STEPS[index]
        move = (step >> 3) + np.where(code & 4, step, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 1, step >> 2, 0)
        value = np.clip(np.where(code & 8, value - move, value + move), -32768, 32767)
        index = np.clip(index + MOVES[code & 7], 0, 88)
        out[k + 1] = value
    return out.T


def wrap(codec: str, payload: bytes) -> bytes:
    """A WAV file that holds the payload as it is."""
    per_block, align = (1 + 2 * (BLOCK - 4), BLOCK) if codec == "adpcm" else (1, 1)
    samples = len(payload) // align * per_block
    extra = struct.pack("<H", per_block) if codec == "adpcm" else b""
    fmt = struct.pack("<HHIIHHH", TAGS[codec], 1, RATE, RATE * align // per_block, align, 4 if codec == "adpcm" else 8, len(extra)) + extra
    chunks = b"".join(k + struct.pack("<I", len(v)) + v + b"\0" * (len(v) & 1) for k, v in ((b"fmt ", fmt), (b"fact", struct.pack("<I", samples)), (b"data", payload)))
    return b"RIFF" + struct.pack("<I", 4 + len(chunks)) + b"WAVE" + chunks


def unwrap(media: bytes | None) -> tuple[str, int, bytes] | None:
    """(codec, block bytes, payload) of a WAV file, or None."""
    if not media or media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        return None
    at, codec, align, payload = 12, None, 1, None
    while at + 8 <= len(media):
        kind, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        body = media[at + 8 : at + 8 + size]
        if kind == b"fmt " and len(body) >= 14:
            codec = {v: k for k, v in TAGS.items()}.get(struct.unpack_from("<H", body)[0])
            align = struct.unpack_from("<H", body, 12)[0]
        elif kind == b"data":
            payload = body
        at += 8 + size + (size & 1)
    return (codec, align, payload) if codec and payload is not None and (codec != "adpcm" or align > 4) else None


def expand(found: list[tuple[str, int, bytes] | None]) -> list[np.ndarray | None]:
    """16-bit samples at the telephone rate; ADPCM blocks of equal width are decoded together."""
    out: list[np.ndarray | None] = [None] * len(found)
    groups: dict[int, list[int]] = {}
    for i, x in enumerate(found):
        if x and x[0] in TABLES:
            out[i] = TABLES[x[0]][np.frombuffer(x[2], np.uint8)]
        elif x:
            groups.setdefault(x[1], []).append(i)
            out[i] = np.zeros(0, np.int16)
    for width, rows in groups.items():
        whole = {i: len(found[i][2]) // width for i in rows}
        for run in _runs(rows, whole, width):
            made = adpcm(np.frombuffer(b"".join(found[i][2][: whole[i] * width] for i in run), np.uint8).reshape(-1, width))
            at = 0
            for i in run:
                out[i] = made[at : at + whole[i]].reshape(-1)
                at += whole[i]
        for i in rows:
            rest = found[i][2][whole[i] * width :]
            if len(rest) >= 4:
                out[i] = np.concatenate([out[i], adpcm(np.frombuffer(rest, np.uint8).reshape(1, -1))[0]])
    return out


def _runs(rows: list[int], whole: dict[int, int], width: int, limit: int = 4 << 20) -> Iterator[list[int]]:
    run, size = [], 0
    for i in rows:
        if not whole[i]:
            continue
        run.append(i)
        size += whole[i] * width
        if size >= limit:
            yield run
            run, size = [], 0
    if run:
        yield run


def _between(pcm: np.ndarray) -> np.ndarray:
    """The half-band value between each sample and the next. The ends are held."""
    x = np.concatenate([pcm[:1], pcm, pcm[-1:], pcm[-1:]]).astype(np.int32)
    return np.clip(9 * (x[1:-2] + x[2:-1]) - x[:-3] - x[3:] + 8 >> 4, -32768, 32767).astype(np.int16)


def resample(pcm: np.ndarray) -> np.ndarray:
    """Twice the rate: each sample, then the half-band value between it and the next."""
    if not len(pcm):
        return pcm
    out = np.empty(2 * len(pcm), np.int16)
    out[0::2] = pcm
    out[1::2] = _between(pcm)
    return out


def pack(pcm: np.ndarray) -> bytes:
    """16-bit samples without loss: a byte (1: differences follow, 2: the last even sample has no odd one after it), the even samples, the odd ones' differences from the half-band values."""
    if not len(pcm):
        return b""
    even, odd = pcm[0::2], pcm[1::2]
    off = odd - _between(even)[: len(odd)]  # modulo 2 ** 16
    return bytes([bool(off.any()) + 2 * (len(even) - len(odd))]) + even.astype("<i2").tobytes() + (off.astype("<i2").tobytes() if off.any() else b"")


def unpack(stored: bytes) -> np.ndarray:
    """The samples that ``pack`` was given."""
    if not stored:
        return np.zeros(0, np.int16)
    short, values = stored[0] >> 1, np.frombuffer(stored, "<i2", offset=1).astype(np.int16)
    evens = len(values) + short + 1 >> 1 if stored[0] & 1 else len(values)
    out = resample(values[:evens])[: 2 * evens - short]
    if stored[0] & 1:
        out[1::2] += values[evens:]
    return out


def decode(media: DataFrame, *, media_col: str = "media", pcm_col: str = "pcm16k", packed: bool = False) -> DataFrame:
    """``media`` with a column of resampled little-endian 16-bit PCM at 16 kHz, or that PCM ``packed``: what is stored for training. A given column of that name is replaced."""
    media = media.drop(pcm_col)
    form = pack if packed else (lambda x: x.astype("<i2").tobytes())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(media_col)
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                pcm = [None if x is None else form(resample(x)) for x in expand([unwrap(x.as_py()) for x in part.column(at)])]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(pcm, pa.binary())], names=[*part.schema.names, pcm_col])

    return media.mapInArrow(work, T.StructType([*media.schema.fields, T.StructField(pcm_col, T.BinaryType())]))


def feature(codec: str, stored: bytes) -> str:
    """From resampled PCM: codec, rate, and samples, root mean square and zero crossings of the telephone signal in it, then the PCM's CRC-32."""
    pcm = np.frombuffer(stored, "<i2")[::2]
    level = float(np.sqrt(np.mean(pcm.astype(np.float64) ** 2))) if len(pcm) else 0.0
    crossings = int(np.count_nonzero((pcm[1:] < 0) != (pcm[:-1] < 0)))
    return f"{codec}/{2 * RATE}/{len(pcm)}/{level:.3f}/{crossings}/{zlib.crc32(stored):08x}"


def payload_of(text: bytes) -> bytes:
    size = max(BLOCK, -(-len(text) // BLOCK) * BLOCK)
    return text.ljust(size, b" ")


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = list(TAGS)
    for batch in batches:
        for i in range(0, batch.num_rows, 512):
            part = batch.slice(i, 512)
            texts = [x.as_py() for x in part.column(1).cast(pa.large_binary())]
            payloads = [payload_of(x) for x in texts]
            media = [wrap(names[zlib.crc32(p) % 3], p) for p in payloads]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(map(len, texts)), pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            part = batch.slice(i, 256)
            media = [x.as_py() for x in part.column(2)]
            found = [unwrap(x) for x in media]
            rows = [
                (len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), len(m), hashlib.sha256(m).hexdigest(), feature(codec, unpack(pcm.as_py()).astype("<i2").tobytes()))
                for m, (codec, _, p), pcm in zip(media, found, part.column(3), strict=True)
            ]
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *[pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])


def query(spark, sf_dir: str) -> DataFrame:
    """``op9_telephony_audio``: each text as the samples of a WAV file (the codec follows the payload's CRC-32), stored with its resampled PCM (``packed``), and both read back."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    stored = staging.keep(decode(documents.mapInArrow(_store, "doc_id long, n_bytes long, media binary"), packed=True), "media", PARQUET)
    return stored.mapInArrow(_read, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
