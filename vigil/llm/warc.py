"""WARC archives as seekable Zstandard bundles.

Each bundle is one file: records grouped into independent Zstandard frames of about ``FRAME_BYTES``, a
skippable frame with the record map (record id -> frame, offset within the decompressed frame, length),
and the seek table of the Zstandard seekable format (sizes of all frames) as footer.  A reader finds a
record from the file's end: seek table, record map, then the one frame that holds it.

Of records with equal payloads of at least ``MIN_DUPLICATE`` bytes the one with the smallest id is a
response, the others are revisits that refer to it; smaller payloads are always responses.

Writing: equal payloads are found on (id, digest) rows; the payload joins its digest group once (Spark
splits a hot group) and each task packs its rows into bundles of bounded size.  Bundles
are written by Spark's own text writer (one row, one file: any file system, task commit, retries): the
row is the file without its last four bytes, and the line separator is the seek table's magic number.
Reading uses Spark's binaryFile source.

Defined results: null payloads are empty; null urls write an empty target; rows repeated under the
smallest id are each a response; a null id is never referred to while the group has another; empty
tables write no bundle; a payload larger than a frame is a frame of its own.
"""

from __future__ import annotations

import hashlib
import struct
import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm import common as C

FRAME_BYTES = 1 << 18
BUNDLE_BYTES = 1 << 23
MIN_DUPLICATE = 100
LEVEL = 3
# Fixed values of the Zstandard formats: skippable frame, seek table frame, seekable magic number.
_SKIPPABLE, _SEEK_TABLE, _SEEKABLE_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
_MAP_ENTRY = np.dtype([("id", "S16"), ("frame", "<u4"), ("offset", "<u4"), ("length", "<u4")])


def record_id(key: object) -> uuid.UUID:
    return uuid.uuid5(uuid.NAMESPACE_URL, f"record:{key}")


def _record(key, url, payload: bytes, digest: str, refers_to, is_revisit: bool) -> bytes:
    """One WARC/1.1 record; a revisit keeps the HTTP header only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if is_revisit else http + payload
    target = " ".join((url or "").split())
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if is_revisit else 'response'}",
            f"WARC-Record-ID: <{record_id(key).urn}>", "WARC-Date: 1970-01-01T00:00:00Z",
            f"WARC-Target-URI: {target}", "Content-Type: application/http; msgtype=response",
            f"WARC-Payload-Digest: sha256:{digest}", f"Content-Length: {len(block)}",
            f"X-Record-Key: {'' if key is None else key}", f"X-Payload-Length: {len(payload)}"]
    if is_revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 f"WARC-Refers-To: <{record_id(refers_to).urn}>", f"X-Refers-To-Key: {'' if refers_to is None else refers_to}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (lower-case names, ``version`` too) and payload of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    fields = {"version": lines[0]}
    for line in lines[1:]:
        name, _, value = line.partition(":")
        fields[name.lower()] = value.strip()
    block = rest[: int(fields["content-length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


class Bundle:
    """Records gathered into frames; ``finish`` gives the file's bytes."""

    def __init__(self):
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True)
        self.frames: list[bytes] = []
        self.sizes: list[tuple[int, int]] = []
        self.open: list[bytes] = []
        self.open_bytes = self.written = 0
        self.map: list[tuple[bytes, int, int, int]] = []

    def add(self, key: uuid.UUID, record: bytes) -> None:
        if self.open and self.open_bytes + len(record) > FRAME_BYTES:
            self._close()
        self.map.append((key.bytes, len(self.frames), self.open_bytes, len(record)))
        self.open.append(record)
        self.open_bytes += len(record)

    def _close(self) -> None:
        frame = self.compressor.compress(b"".join(self.open))
        self.frames.append(frame)
        self.sizes.append((len(frame), self.open_bytes))
        self.written += len(frame)
        self.open, self.open_bytes = [], 0

    def finish(self) -> bytes:
        if self.open:
            self._close()
        entries = np.array(self.map, _MAP_ENTRY).tobytes()
        self.frames.append(struct.pack("<II", _SKIPPABLE, len(entries)) + entries)
        self.sizes.append((len(entries) + 8, 0))
        table = b"".join(struct.pack("<II", *x) for x in self.sizes)
        footer = struct.pack("<IBI", len(self.sizes), 0, _SEEKABLE_MAGIC)
        return b"".join([*self.frames, struct.pack("<II", _SEEK_TABLE, len(table) + len(footer)), table, footer])


def read_map(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Frame sizes (compressed, decompressed) and the record map, from the file's end."""
    n, flags, magic = struct.unpack("<IBI", data[-9:])
    if magic != _SEEKABLE_MAGIC or flags:
        raise ValueError("no seek table at the end")
    sizes = np.frombuffer(data[-9 - 8 * n: -9], "<u4").reshape(n, 2).astype(np.int64)
    start = int(sizes[:-1, 0].sum())
    return sizes, np.frombuffer(data[start + 8: start + int(sizes[-1, 0])], _MAP_ENTRY)


def read_frame(data: bytes, sizes: np.ndarray, frame: int) -> bytes:
    start = int(sizes[:frame, 0].sum())
    return zstandard.ZstdDecompressor().decompress(data[start: start + int(sizes[frame, 0])])


def _pack(batches):
    bundle = Bundle()
    for batch in batches:
        keys, urls, digests = (batch.column(c).to_pylist() for c in ("key", "url", "digest"))
        revisit, refers = batch.column("revisit").to_pylist(), batch.column("refers_to").to_pylist()
        for lo, hi, buf, bounds in C.text_groups(batch, "payload", 1 << 22):
            for r in range(hi - lo):
                i = lo + r
                payload = buf[bounds[r]: bounds[r + 1]].tobytes()
                bundle.add(record_id(keys[i]), _record(keys[i], urls[i], payload, digests[i], refers[i], revisit[i]))
                if bundle.written + bundle.open_bytes >= BUNDLE_BYTES:
                    yield pa.RecordBatch.from_pydict({"file": pa.array([bundle.finish()[:-4]], pa.binary())})
                    bundle = Bundle()
    if bundle.map:
        yield pa.RecordBatch.from_pydict({"file": pa.array([bundle.finish()[:-4]], pa.binary())})


def write(pages: DataFrame, key: str, url: str, payload: str, path: str) -> None:
    """Write every row as a record into bundles under ``path``."""
    body = F.coalesce(F.col(payload).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(key).cast("long").alias("key"), F.col(url).cast("string").alias("url"),
                        body.alias("payload"), F.sha2(body, 256).alias("digest"))
    equal = (rows.where(F.octet_length("payload") >= MIN_DUPLICATE).groupBy("digest")
             .agg(F.min("key").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first"))
    marked = rows.join(equal, "digest", "left")
    is_revisit = F.col("first").isNotNull() & ~F.col("key").eqNullSafe(F.col("first"))
    marked = marked.select("key", "url", "digest", is_revisit.alias("revisit"),
                           F.when(is_revisit, F.col("first")).alias("refers_to"), "payload")
    files = C.map_arrow(marked, _pack, "file binary")
    (files.select(F.col("file").cast("string").alias("value")).write.option("maxRecordsPerFile", 1)
     .option("encoding", "ISO-8859-1").option("lineSep", struct.pack("<I", _SEEKABLE_MAGIC).decode("latin-1")).text(path))


_READ = ("key long, url string, record_type string, refers_to long, stated_digest string, "
         "stated_bytes long, payload_bytes long, payload_digest string, payload binary")


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).where("length > 0").select("path", "content")


def _row(record: bytes, with_payload: bool) -> dict:
    fields, payload = parse_record(record)
    number = lambda x: int(x) if x else None
    return {"key": number(fields["x-record-key"]), "url": fields["warc-target-uri"], "record_type": fields["warc-type"],
            "refers_to": number(fields.get("x-refers-to-key")),
            "stated_digest": fields["warc-payload-digest"].removeprefix("sha256:"),
            "stated_bytes": int(fields["x-payload-length"]), "payload_bytes": len(payload),
            "payload_digest": hashlib.sha256(payload).hexdigest(), "payload": payload if with_payload else None}


_ARROW = pa.schema([("key", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
                    ("stated_digest", pa.string()), ("stated_bytes", pa.int64()), ("payload_bytes", pa.int64()),
                    ("payload_digest", pa.string()), ("payload", pa.binary())])


def read(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """Every record of the bundles under ``path``, frame by frame."""
    def run(batches):
        for batch in batches:
            for data in batch.column("content"):
                data = data.as_py()
                sizes, records = read_map(data)
                for frame in range(len(sizes) - 1):
                    plain = read_frame(data, sizes, frame)
                    own = records[records["frame"] == frame]
                    rows = [_row(plain[o: o + n], with_payload) for o, n in zip(own["offset"].tolist(), own["length"].tolist())]
                    yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)
    return C.map_arrow(_files(spark, path), run, _READ)


def lookup(spark: SparkSession, path: str, keys: list[int]) -> DataFrame:
    """The records of some keys (a bounded list): only the frames that hold them are decompressed."""
    wanted = np.array([record_id(k).bytes for k in keys], "S16")

    def run(batches):
        for batch in batches:
            for data in batch.column("content"):
                data = data.as_py()
                sizes, records = read_map(data)
                own = records[np.isin(records["id"], wanted)]
                for frame in np.unique(own["frame"]):
                    plain = read_frame(data, sizes, int(frame))
                    at = own[own["frame"] == frame]
                    rows = [_row(plain[o: o + n], True) for o, n in zip(at["offset"].tolist(), at["length"].tolist())]
                    yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)
    return C.map_arrow(_files(spark, path), run, _READ)
