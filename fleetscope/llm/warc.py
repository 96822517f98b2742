"""Operator 6: WARC archives in seekable Zstandard bundles.

Records are grouped into frames that decompress on their own; a bundle ends with the seek table of the public seekable
format (a skippable frame with the compressed and plain size of every frame). An index maps record ids to bundle, frame
and offset inside the frame, so one record is read by decompressing one frame.

Among records with equal payloads of at least ``least`` bytes the one with the largest page id is the response; the
others are revisits that refer to it and carry no payload. Only digest and id of the repeated payloads are gathered for
that, combined before the shuffle; a payload moves once, and adaptive execution splits the partition of a hot digest.

Bundles are written by tasks through the file system of the shared folder: under a name of the attempt first, then
renamed, so that a lost or repeated task leaves one whole file.

Edge cases: a missing html counts as empty; a missing url gives no target. Rows that repeat the largest page id of their
payload are all responses; a missing page id is never the largest unless all are missing. An empty table gives no bundle.
"""

from __future__ import annotations

import math
import re
import struct
from hashlib import sha1
from uuid import NAMESPACE_URL, uuid4, uuid5

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Numbers of the seekable format.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
DATE = "2000-01-01T00:00:00Z"
INDEX = "record_id string, page_id long, bundle string, frame int, offset long, length long"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"


def open_folder(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub(r"^(\w+):/+(?=[^/])", r"\1:///", folder) if folder.startswith("file:") else folder)


def clean(value: str) -> str:
    """A header value in one line."""
    return re.sub(r"[\x00-\x20\x7f]", lambda found: f"%{ord(found[0]):02X}", value)


def record(record_id: str, page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None) -> bytes:
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {clean(url)}")
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {size}"]
    if refers_to is None:
        body = HTTP + payload
        head.append("Content-Type: application/http; msgtype=response")
    else:
        body = HTTP
        head += [f"X-Refers-To-Page-ID: {refers_to}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head.append(f"Content-Length: {len(body)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_record(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers, body, and where the next record begins."""
    end = data.index(b"\r\n\r\n", at)
    lines = data[at:end].decode().split("\r\n")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    start = end + 4
    stop = start + int(headers["Content-Length"])
    return headers, data[start:stop], stop + 4


def read_back(headers: dict[str, str], body: bytes) -> tuple:
    payload = body[len(HTTP) :]
    kind = headers["WARC-Type"]
    whole = kind == "response"
    page, refers = headers.get("X-Page-ID"), headers.get("X-Refers-To-Page-ID")
    return (
        None if page is None else int(page),
        len(payload) if whole else int(headers["X-Payload-Length"]),
        sha1(payload).hexdigest() if whole else headers["WARC-Payload-Digest"].removeprefix("sha1:"),
        kind,
        None if refers is None else int(refers),
        headers.get("WARC-Target-URI"),
    )


class BundleWriter:
    """Writes records as independent frames of about ``frame_bytes`` plain bytes, and the seek table at the end."""

    def __init__(self, out, frame_bytes: int, level: int = 3):
        self.out, self.most = out, frame_bytes
        self.packer = zstandard.ZstdCompressor(level=level)
        self.frames: list[tuple[int, int]] = []
        self.held: list[bytes] = []
        self.size = 0

    def add(self, data: bytes) -> tuple[int, int]:
        """Frame and offset of the record."""
        place = (len(self.frames), self.size)
        self.held.append(data)
        self.size += len(data)
        if self.size >= self.most:
            self.flush()
        return place

    def flush(self) -> None:
        if self.held:
            packed = self.packer.compress(b"".join(self.held))
            self.out.write(packed)
            self.frames.append((len(packed), self.size))
            self.held, self.size = [], 0

    def close(self) -> None:
        self.flush()
        table = b"".join(struct.pack("<II", *frame) for frame in self.frames)
        foot = table + struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(foot)) + foot)


def seek_table(file) -> list[tuple[int, int]]:
    """Start and packed size of every frame."""
    size = file.size()
    count, _, magic = struct.unpack("<IBI", file.read_at(9, size - 9))
    if magic != SEEKABLE:
        raise ValueError("no seek table at the end of the bundle")
    table = file.read_at(8 * count, size - 9 - 8 * count)
    frames, at = [], 0
    for packed, _ in struct.iter_unpack("<II", table):
        frames.append((at, packed))
        at += packed
    return frames


def read_frame(file, frame: tuple[int, int]) -> bytes:
    return zstandard.ZstdDecompressor().decompress(file.read_at(frame[1], frame[0]))


def choose_responses(pages: DataFrame, least: int = 1000) -> DataFrame:
    """``page_id``, ``url``, ``html`` with digest, size and, for revisits, ``refers_to``."""
    payload = F.coalesce("html", F.lit("")).cast("binary")
    sized = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", "html", F.sha1(payload).alias("digest"), F.octet_length(payload).cast("long").alias("size")
    )
    repeated = (
        sized.where(F.col("size") >= least)
        .groupBy(F.col("digest").alias("of_digest"))
        .agg(F.max("page_id").alias("largest"), F.count(F.lit(1)).alias("copies"))
        .where("copies > 1")
        .drop("copies")
    )
    joined = sized.join(repeated, sized.digest == repeated.of_digest, "left").drop("of_digest")
    revisit = F.col("largest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("largest"))
    return joined.select("page_id", "url", F.when(~revisit, F.col("html")).alias("html"), "digest", "size", F.when(revisit, F.col("largest")).alias("refers_to"))


def write_bundles(pages: DataFrame, folder: str, least: int = 1000, frame_bytes: int = 1 << 20) -> DataFrame:
    """Write the bundles of ``pages`` below ``folder``, and the index of their records as a table, which is returned."""
    spark = pages.sparkSession

    def work(batches):
        store, root = open_folder(folder)
        name = f"{root}/bundle-{TaskContext.get().partitionId():06d}.warc.zst"
        store.create_dir(root, recursive=True)
        draft, writer = f"{root}/.{uuid4().hex}.draft", None
        rows: list[tuple] = []
        for batch in batches:
            for page in batch.to_pylist():
                if writer is None:
                    writer = BundleWriter(store.open_output_stream(draft), frame_bytes)
                record_id = f"<urn:uuid:{uuid5(NAMESPACE_URL, f'{name}#{len(rows)}')}>"
                data = record(record_id, page["page_id"], page["url"], (page["html"] or "").encode(), page["digest"], page["size"], page["refers_to"])
                frame, offset = writer.add(data)
                rows.append((record_id, page["page_id"], name.rpartition("/")[2], frame, offset, len(data)))
        if writer is not None:
            writer.close()
            writer.out.close()
            store.move(draft, name)
            kinds = (pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64())
            columns = [pa.array(list(values), kind) for values, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, ["record_id", "page_id", "bundle", "frame", "offset", "length"])

    index = f"{folder}-index"
    choose_responses(pages, least).mapInArrow(work, INDEX).write.parquet(index)
    return spark.read.schema(INDEX).parquet(index)


def record_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
    columns = [list(values) for values in zip(*rows, strict=True)] or [[]] * 6
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"]
    return pa.RecordBatch.from_arrays([pa.array(values, kind) for values, kind in zip(columns, kinds, strict=True)], names)


def read_bundles(index: DataFrame, folder: str, task_bytes: int = 32 << 20) -> DataFrame:
    """All records, frame by frame. The frames are dealt out over as many tasks as their plain bytes ask for: the index
    itself is far too small to tell how much work there is."""
    plain = index.agg(F.sum("length")).first()[0] or 0
    tasks = max(1, math.ceil(plain / task_bytes))
    frames = index.groupBy("bundle", "frame").count().select("bundle", "frame").repartition(tasks, "bundle", "frame")

    def work(batches):
        store, root = open_folder(folder)
        for batch in batches:
            places = sorted(zip(batch.column("bundle").to_pylist(), batch.column("frame").to_pylist(), strict=True))
            opened, file, table = None, None, []
            for bundle, frame in places:
                if bundle != opened:
                    opened, file = bundle, store.open_input_file(f"{root}/{bundle}")
                    table = seek_table(file)
                data, at, rows = read_frame(file, table[frame]), 0, []
                while at < len(data):
                    headers, body, at = parse_record(data, at)
                    rows.append(read_back(headers, body))
                yield record_batch(rows)

    return frames.mapInArrow(work, RECORDS)


def fetch(index: DataFrame, folder: str, record_ids: DataFrame) -> DataFrame:
    """The records with the given ``record_id``, each by its frame and offset."""
    wanted = index.join(record_ids.select("record_id").distinct(), "record_id").select("bundle", "frame", "offset")

    def work(batches):
        store, root = open_folder(folder)
        for batch in batches:
            rows, kept = [], (None, b"")
            for place in sorted(batch.to_pylist(), key=lambda place: (place["bundle"], place["frame"], place["offset"])):
                if kept[0] != (place["bundle"], place["frame"]):
                    file = store.open_input_file(f"{root}/{place['bundle']}")
                    kept = ((place["bundle"], place["frame"]), read_frame(file, seek_table(file)[place["frame"]]))
                headers, body, _ = parse_record(kept[1], place["offset"])
                rows.append(read_back(headers, body))
            yield record_batch(rows)

    return wanted.mapInArrow(work, RECORDS)
