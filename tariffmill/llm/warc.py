"""WARC archives as seekable Zstandard bundles.

Records are grouped into frames that decompress on their own; a bundle ends in a skippable
frame that lists the frames' sizes (the seekable format: its footer is found from the file's
end).  The index maps each record to its bundle, frame, and offset and length inside the frame,
so one record costs one seek and one frame.

Among records of equal payloads the one with the largest id is stored as ``response``; the others
are ``revisit`` records with the same headers, the payload's digest and a reference, but no
payload.  Payloads below ``least`` bytes are all stored.

Bundles are written by the executors below a folder that all of them share.  Names hold a random
part, so a repeated task writes another file; the index comes from the attempts that
counted, and only files that it names are read.

Defined results: a null html is an empty payload; a null url leaves its header out; rows that
share both the id and the payload are each stored as the response; a null page_id is stored
as a response with an empty id and read back as null; extra columns are ignored; an empty table
gives no bundles, an empty index and no records.  A record is held whole by its task, and one
above ``frame_bytes`` is a frame of its own, so a very long page costs memory in proportion to itself alone.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, shared_dir

#: Fixed values of the seekable format: magic numbers of the skippable frame and of its footer.
_SKIPPABLE, _SEEKABLE = 0x184D2A5E, 0x8F92EAB1
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "page_id long, bundle string, frame int, offset long, length long"
READ = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, told: str, refers_to: int | None, date: str) -> bytes:
    """One WARC record; a revisit if it refers to another."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    name = lambda i: f"<urn:page:{'' if i is None else i}>"
    body = http if refers_to is not None else http + payload
    heads = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        heads.append("WARC-Target-URI: " + "".join(c if c > " " and c != "\x7f" and c != "%" else "".join(f"%{b:02X}" for b in c.encode()) for c in url))
    if refers_to is not None:
        heads += [f"WARC-Refers-To: {name(refers_to)}", f"WARC-Profile: {_PROFILE}"]
    heads += [f"WARC-Payload-Digest: sha1:{told}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(heads).encode("utf-8") + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> tuple[dict, int]:
    """The record that begins at ``at`` as a row of READ, and where the next one begins.  A payload that doesn't have its digest is an error."""
    end = data.index(b"\r\n\r\n", at)
    lines = data[at:end].decode("utf-8").split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not at a record")
    head = dict(x.split(": ", 1) for x in lines[1:])
    size = int(head["Content-Length"])
    body = data[end + 4 : end + 4 + size]
    cut = body.index(b"\r\n\r\n") + 4
    number = lambda x: int(x[10:-1]) if len(x) > 11 else None
    told = head["WARC-Payload-Digest"][5:]
    full = int(next(x for x in body[:cut].split(b"\r\n") if x.startswith(b"Content-Length: "))[16:])
    stored = head["WARC-Type"] == "response"
    if stored and (len(body) - cut != full or digest(body[cut:]) != told):
        raise ValueError(f"the payload of {head['WARC-Record-ID']} differs from its digest")
    url = head.get("WARC-Target-URI")
    if url is not None:
        from urllib.parse import unquote

        url = unquote(url)
    row = {"page_id": number(head["WARC-Record-ID"]), "url": url, "record_type": head["WARC-Type"], "refers_to": number(head["WARC-Refers-To"]) if "WARC-Refers-To" in head else None, "payload_digest": told, "payload_bytes": full, "payload": body[cut:] if stored else None}
    return row, end + 4 + size + 4


class _Bundle:
    """A bundle being written: frames of about ``frame_bytes``, then the seek table."""

    def __init__(self, folder: str, frame_bytes: int, level: int):
        files, path = pyarrow.fs.FileSystem.from_uri(folder)
        self.name, self.frame_bytes = f"bundle-{uuid.uuid4().hex}.warc.zst", frame_bytes
        files.create_dir(path, recursive=True)
        self.out, self.pack = files.open_output_stream(f"{path}/{self.name}", compression=None), zstandard.ZstdCompressor(level=level)
        self.held, self.size, self.sizes, self.written = [], 0, [], 0

    def add(self, data: bytes) -> tuple[int, int]:
        """Where the record will be: its frame and its offset there."""
        if self.held and self.size + len(data) > self.frame_bytes:
            self._frame()
        place = len(self.sizes), self.size
        self.held.append(data)
        self.size += len(data)
        return place

    def _frame(self) -> None:
        packed = self.pack.compress(b"".join(self.held))
        self.out.write(packed)
        self.sizes.append((len(packed), self.size))
        self.written += len(packed)
        self.held, self.size = [], 0

    def close(self) -> None:
        if self.held:
            self._frame()
        table = b"".join(struct.pack("<II", *s) for s in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, _SEEKABLE)
        self.out.write(struct.pack("<II", _SKIPPABLE, len(table)) + table)
        self.out.close()


class Reader:
    """Random access to a bundle's frames through its seek table."""

    def __init__(self, folder: str, name: str):
        files, path = pyarrow.fs.FileSystem.from_uri(folder)
        self.file, self.unpack = files.open_input_file(f"{path}/{name}"), zstandard.ZstdDecompressor()
        size = self.file.size()
        self.file.seek(size - 9)
        n, _, magic = struct.unpack("<IBI", self.file.read(9))
        if magic != _SEEKABLE:
            raise ValueError(f"{name} has no seek table")
        self.file.seek(size - 9 - 8 * n)
        sizes = list(struct.iter_unpack("<II", self.file.read(8 * n)))
        self.frames, at = [], 0
        for packed, plain in sizes:
            self.frames.append((at, packed, plain))
            at += packed

    def frame(self, k: int) -> bytes:
        at, packed, plain = self.frames[k]
        self.file.seek(at)
        return self.unpack.decompress(self.file.read(packed), max_output_size=plain)

    def close(self) -> None:
        self.file.close()


def write(pages: DataFrame, folder: str, frame_bytes: int = 128 << 10, bundle_bytes: int = 256 << 20, least: int = 0, level: int = 3, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write all pages below ``folder``; returns the index (see INDEX), itself a table in the shared folder."""
    html = F.coalesce("html", F.lit(""))
    keyed = pages.select(F.col("page_id").cast("long"), "url", html.alias("html"), F.sha1(html).alias("sha"))
    # one narrow row per payload that occurs more than once; a payload's copies never meet in one task with their texts
    top = keyed.where(F.octet_length("html") >= least).groupBy("sha").agg(F.max("page_id").alias("top"), F.count("*").alias("n")).where("n > 1").select("sha", "top")
    told = keyed.join(top.hint("shuffle_hash"), "sha", "left").select("page_id", "url", "html", F.expr("case when page_id < top then top end").alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle = None
        for batch in batches:
            rows: dict[str, list] = {"page_id": [], "bundle": [], "frame": [], "offset": [], "length": []}
            for page_id, url, text, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                if bundle is None:
                    bundle = _Bundle(folder, frame_bytes, level)
                payload = text.encode("utf-8")
                data = record(page_id, url, payload, digest(payload), refers_to, date)
                frame, offset = bundle.add(data)
                for column, x in zip(rows.values(), (page_id, bundle.name, frame, offset, len(data))):
                    column.append(x)
                if bundle.written > bundle_bytes:
                    bundle.close()
                    bundle = None
            yield pa.RecordBatch.from_arrays([pa.array(rows["page_id"], pa.int64()), pa.array(rows["bundle"], pa.string()), pa.array(rows["frame"], pa.int32()), pa.array(rows["offset"], pa.int64()), pa.array(rows["length"], pa.int64())], list(rows))
        if bundle is not None:
            bundle.close()

    return materialise(told.mapInArrow(run, INDEX), "warc_index")


_READ_ARROW = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())])


def read_all(index: DataFrame, folder: str, payloads: bool = True, frames: int = 64, task_bytes: int = 64 << 20) -> DataFrame:
    """Every record of the bundles that the index names, frame by frame, each payload checked against its digest.

    A task reads stretches of ``frames`` frames, found through the bundles' seek tables; there are as many
    tasks as the records' bytes ask for at ``task_bytes`` each, and at least as many as cores if there are stretches enough.
    """
    stretches = index.select("bundle", (F.col("frame") / frames).cast("int").alias("stretch"), "length").groupBy("bundle", "stretch").agg(F.sum("length").alias("bytes"))
    size = stretches.agg(F.count("*").alias("n"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first()
    tasks = max(1, min(size["n"], max(-(-size["bytes"] // task_bytes), index.sparkSession.sparkContext.defaultParallelism)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, stretch in zip(*(batch.column(k).to_pylist() for k in (0, 1))):
                reader = Reader(folder, name)
                for k in range(stretch * frames, min((stretch + 1) * frames, len(reader.frames))):
                    data, at, rows = reader.frame(k), 0, []
                    while at < len(data):
                        row, at = parse(data, at)
                        rows.append(row if payloads else row | {"payload": None})
                    yield pa.RecordBatch.from_pylist(rows, _READ_ARROW)
                reader.close()

    # a stated number of partitions: these rows are few bytes, and adaptive execution would put them all into one task
    return stretches.select("bundle", "stretch").repartition(tasks, "bundle", "stretch").mapInArrow(run, READ)


def fetch(index: DataFrame, folder: str) -> DataFrame:
    """Just the records of these index rows, each by one seek to its frame and its offset there; a frame's rows are served together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, reader, last, data = None, None, None, b""
        for batch in batches:
            rows = []
            for bundle, frame, offset in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3))):
                if bundle != name:
                    if reader:
                        reader.close()
                    name, reader, last = bundle, Reader(folder, bundle), None
                if frame != last:
                    last, data = frame, reader.frame(frame)
                rows.append(parse(data, offset)[0])
            yield pa.RecordBatch.from_pylist(rows, _READ_ARROW)

    return index.sortWithinPartitions("bundle", "frame", "offset").mapInArrow(run, READ)


def own_folder(df: DataFrame, name: str) -> str:
    """A new folder for bundles in the shared one."""
    return f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
