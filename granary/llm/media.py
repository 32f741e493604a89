"""Media columns: content-addressed payloads in tar shards, read back by byte range.

A task writes the payloads it meets first as lossless 8-bit grey PNG members of a tar shard in the shared
folder; rows carry digest, shard, offset and length. Metadata columns are filled from the first bytes of a
member alone; features read the member. Shards have names of their own for each attempt and are renamed into
place when complete, so a retried task never mixes with a lost one; only rows of the attempt that counts name
its shard. Equal payloads share a member within a task; the rows of other tasks point to members of their own
shards, with the same bytes.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import shared_dir, ship, written

UNIT = 64
HEADER_BYTES = 33  # signature and IHDR chunk
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
_WIDEST = 256
REMEMBERED = 20_000  # members whose features a reading task remembers


def payload_of(text: str | None) -> bytes:
    """A text's UTF-8 bytes, then zeros up to a positive multiple of UNIT."""
    raw = (text or "").encode()
    return raw + bytes(max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes, level: int = 6) -> bytes:
    """8-bit grey PNG whose samples are ``payload``; its width is UNIT times the largest divisor that fits."""
    units = len(payload) // UNIT
    width = UNIT * max(d for d in range(1, _WIDEST + 1) if units % d == 0)
    rows = np.zeros((len(payload) // width, width + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, width)
    head = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), level)) + _chunk(b"IEND", b"")


def png_header(head: bytes) -> tuple[int, int, int]:
    """(width, height, bit depth) from the first HEADER_BYTES."""
    if head[:8] != _SIGNATURE or head[12:16] != b"IHDR":
        raise ValueError("not a PNG member")
    width, height, depth = struct.unpack(">IIB", head[16:25])
    return width, height, depth


def from_png(data: bytes) -> bytes:
    width, height, _ = png_header(data)
    at, body = 8, b""
    while at < len(data):
        (n,) = struct.unpack(">I", data[at : at + 4])
        if data[at + 4 : at + 8] == b"IDAT":
            body += data[at + 8 : at + 8 + n]
        at += n + 12
    return np.frombuffer(zlib.decompress(body), np.uint8).reshape(height, width + 1)[:, 1:].tobytes()


def _features(payload: bytes, width: int, height: int) -> str:
    counts = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
    p = counts[counts > 0] / len(payload)
    mean = float((counts * np.arange(256)).sum()) / len(payload)
    return f"{width}x{height};mean={mean:.4f};entropy={abs(float((p * np.log2(p)).sum())):.4f};values={len(p)}"


def _open(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def store(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = 256 << 20) -> DataFrame:
    """Write the payloads of ``docs`` to tar shards in ``folder``; one manifest row for each row.

    ``doc_id, n_bytes, payload_sha256, shard, offset, length``; copies within a task share one member.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def write(batches):
        filesystem, root = _open(folder)
        filesystem.create_dir(root, recursive=True)
        out, name, at, seen = None, "", 0, {}

        def close():
            out.write(bytes(1024))
            out.close()
            filesystem.move(f"{root}/.{name}", f"{root}/{name}")

        for batch in batches:
            rows = []
            for key, text in zip(batch["doc_id"], batch["_text"], strict=True):
                payload = payload_of(text)
                digest = hashlib.sha256(payload).hexdigest()
                if digest not in seen:
                    if out is not None and at > shard_bytes:
                        close()
                        out, seen = None, {}
                    if out is None:
                        name, at = f"shard-{uuid.uuid4().hex}.tar", 0
                        out = filesystem.open_output_stream(f"{root}/.{name}")
                    data = to_png(payload)
                    info = tarfile.TarInfo(f"{digest}.png")
                    info.size = len(data)
                    head = info.tobuf(tarfile.USTAR_FORMAT)
                    out.write(head + data + bytes(-len(data) % 512))
                    seen[digest] = (name, at + len(head), len(data))
                    at += len(head) + len(data) + -len(data) % 512
                rows.append((key, len((text or "").encode()), digest, *seen[digest]))
            yield pd.DataFrame(rows, columns=["doc_id", "n_bytes", "payload_sha256", "shard", "offset", "length"])
        if out is not None:
            close()

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text")).mapInPandas(
        write, f"doc_id {kind}, n_bytes long, payload_sha256 string, shard string, offset long, length long"
    )


def read_headers(members: DataFrame, folder: str) -> DataFrame:
    """``width, height, depth`` added to rows with ``shard, offset``, from HEADER_BYTES of each member."""

    def read(batches):
        filesystem, root = _open(folder)
        shard, file = None, None
        for batch in batches:
            found = []
            for name, at in zip(batch["shard"], batch["offset"], strict=True):
                if name != shard:
                    shard, file = name, filesystem.open_input_file(f"{root}/{name}")
                found.append(png_header(file.read_at(HEADER_BYTES, at)))
            batch["width"], batch["height"], batch["depth"] = zip(*found, strict=True) if found else ([], [], [])
            yield batch

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in members.schema)
    return members.mapInPandas(read, f"{schema}, width long, height long, depth long")


def read_features(manifest: DataFrame, folder: str) -> DataFrame:
    """One row for each row of ``manifest`` with what its stored bytes give: digests, sizes, features.

    A task reads members in the order in which they were written: the metadata from HEADER_BYTES of each, then the
    member. What it found for the last ones, at most REMEMBERED, serves their copies; a copy of another is read again.
    """
    kind = manifest.schema["doc_id"].dataType.simpleString()

    def read(batches):
        filesystem, root = _open(folder)
        shard, file, found = None, None, {}
        for batch in batches:
            rows = []
            for key, n, name, at, length in zip(*[batch[c] for c in ("doc_id", "n_bytes", "shard", "offset", "length")], strict=True):
                if name != shard:
                    shard, file, found = name, filesystem.open_input_file(f"{root}/{name}"), {}
                if at not in found:
                    if len(found) >= REMEMBERED:
                        found.clear()
                    width, height, _ = png_header(file.read_at(HEADER_BYTES, at))
                    data = file.read_at(length, at)
                    payload = from_png(data)
                    found[at] = (
                        len(payload),
                        hashlib.sha256(payload).hexdigest(),
                        zlib.crc32(payload[-UNIT:]),
                        len(data),
                        hashlib.sha256(data).hexdigest(),
                        _features(payload, width, height),
                    )
                rows.append((key, n, *found[at]))
            yield pd.DataFrame(rows, columns=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return manifest.select("doc_id", "n_bytes", "shard", "offset", "length").mapInPandas(
        read, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    )


def media_columns(docs: DataFrame, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store every text's payload, read it back, and return one row per document.

    ``doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature``, all of which
    hang on the text alone, so equal texts have equal values whichever member they were read from. No row leaves its
    task, so there is nothing to shuffle or sort, and no group of copies to meet in one place.

    Defined cases: a null text is an empty one, whose payload is UNIT zeros; texts of any length are one
    member each; repeated rows and null ids give a row each; an empty table gives an empty result; other
    columns are ignored. ``folder`` is a URI that all executors see; by default a new one in the shared folder.
    """
    spark = docs.sparkSession
    ship(spark)
    folder = folder or f"{shared_dir(spark).rstrip('/')}/media-{uuid.uuid4().hex}"
    if "://" not in folder:
        folder = f"file://{folder.removeprefix('file:')}"
    return read_features(written(store(docs, folder, id_col, text_col), "manifest"), folder)
