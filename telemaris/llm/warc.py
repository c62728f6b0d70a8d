"""WARC archives compressed with Zstandard and a dictionary (.warc.zst), written and read.

A file starts with a skippable frame that holds the dictionary; then follows one frame for each record, so that a
record can be read by itself. The reader takes the dictionary from the leading frame, steps from frame
to frame by their block headers, decodes one at a time, and checks each record's version line, its fields, its
length and its digests.

Of records with equal payloads one is a response, which has the payload; the others are revisits, whose HTTP
header still tells the payload's length and whose fields tell its digest and the response they refer to.

Archives of other writers are read too: records of any type, with any id, with or without digests.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from telemaris.llm import common as c

# Fixed values of the formats.
DICTIONARY_FRAME = 0x184D2A5D
FRAME = 0xFD2FB528
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

DATE = "2000-01-01T00:00:00Z"  # pages carry no time; a fixed one makes reruns agree
DIGEST, FIRST = f"{c.OWN}digest", f"{c.OWN}first"


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}>"


def ours(urn: str) -> bool:
    return urn.startswith("<urn:x-page:") and urn.endswith(">")


def page_of(urn: str) -> int | None:
    """The page of a record id of this writer; none for others."""
    number = urn[len("<urn:x-page:") : -1] if ours(urn) else ""
    return int(number) if number else None


def target(url: str | None, page_id: int | None) -> str:
    """The URL with white space and control characters as %XX; a page without one gets its record id's URN."""
    quoted = "".join(f"%{b:02X}" if b <= 32 or b == 127 else chr(b) if b < 127 else f"%{b:02X}" for b in (url or "").encode("utf-8", "surrogatepass"))
    return quoted or record_id(page_id)[1:-1]


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    fields = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": record_id(page_id),
        "WARC-Date": DATE,
        "WARC-Target-URI": target(url, page_id),
        "Content-Type": "application/http; msgtype=response",
        "WARC-Payload-Digest": f"sha1:{sha1_base32(payload)}",
        "WARC-Block-Digest": f"sha1:{sha1_base32(block)}",
    }
    if revisit:
        fields |= {"WARC-Refers-To": record_id(refers_to), "WARC-Profile": PROFILE}
    fields["Content-Length"] = str(len(block))
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def fields_of(lines: bytes) -> dict[str, str]:
    out = {}
    for line in lines.decode("utf-8").split("\r\n"):
        name, colon, value = line.partition(":")
        if not colon or not name or name != name.strip():
            raise ValueError(f"malformed field: {line[:80]!r}")
        out[name.lower()] = value.strip()
    return out


def parsed(raw: bytes) -> dict:
    """A record's type, id, page, url, payload length and digest, the page it refers to, and its payload (None: revisit).

    The payload is what follows the HTTP header in a record of HTTP, else the whole block. Digests are checked where they are
    SHA-1 in base32; the HTTP header's length is checked in this writer's records (servers send wrong ones).
    """
    head, gap, rest = raw.partition(b"\r\n\r\n")
    version, _, lines = head.partition(b"\r\n")
    if not gap or version not in (b"WARC/1.0", b"WARC/1.1"):
        raise ValueError(f"no WARC record: {raw[:40]!r}")
    fields = fields_of(lines)
    if missing := {"warc-type", "warc-record-id", "warc-date", "content-length"} - fields.keys():
        raise ValueError(f"fields are missing: {sorted(missing)}")
    length = int(fields["content-length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise ValueError(f"{fields['warc-record-id']}: Content-Length is {length}, the block has {len(rest) - 4} bytes")
    block, kind, name = rest[:length], fields["warc-type"], fields["warc-record-id"]
    if differs(fields.get("warc-block-digest"), block):
        raise ValueError(f"{name}: the block's digest differs")
    payload, size, revisit = block, None, kind == "revisit"
    if kind in ("response", "revisit", "request") and (ours(name) or fields.get("content-type", "").startswith("application/http")):
        http, gap, payload = block.partition(b"\r\n\r\n")
        status, _, lines = http.partition(b"\r\n")
        if not (gap or revisit) or not (b"HTTP/" in status or (revisit and not block)):
            raise ValueError(f"{name}: no HTTP header")
        told = {k.lower().strip(): v.strip() for k, _, v in (x.partition(":") for x in lines.decode("latin-1").split("\r\n"))}.get("content-length", "")
        size = int(told) if told.isdigit() else None
    digest = fields.get("warc-payload-digest")
    if not revisit:
        if differs(digest, payload) or (ours(name) and size != len(payload)):
            raise ValueError(f"{name}: the payload is not what its header says")
        size = len(payload)
    elif ours(name) and (payload or size is None or "warc-refers-to" not in fields):
        raise ValueError(f"{name}: a malformed revisit")
    bare = digest.removeprefix("sha1:") if digest else None if revisit else sha1_base32(payload)
    return {"record_id": name, "page_id": page_of(name), "url": fields.get("warc-target-uri"), "record_type": kind, "payload_bytes": size, "payload_digest": bare, "refers_to": page_of(fields.get("warc-refers-to", "")) if revisit else None, "payload": None if revisit else payload}


def differs(digest: str | None, data: bytes) -> bool:
    """Whether a digest is SHA-1 in base32, and another than the data's."""
    kind, _, value = (digest or "").partition(":")
    return kind.lower() == "sha1" and len(value) == 32 and value.upper() != sha1_base32(data)


# Frames


def exactly(stream, n: int) -> bytes:
    got = stream.read(n)
    if len(got) != n:
        raise ValueError("the archive is cut short")
    return got


def frames(stream) -> Iterator[tuple[int, bytes]]:
    """(magic number, whole frame) for each frame; a skippable one is returned without its header."""
    while head := stream.read(4):
        if len(head) != 4:
            raise ValueError("the archive is cut short")
        magic = struct.unpack("<I", head)[0]
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            yield magic, exactly(stream, struct.unpack("<I", exactly(stream, 4))[0])
            continue
        if magic != FRAME:
            raise ValueError(f"no Zstandard frame: {magic:#x}")
        flags = exactly(stream, 1)
        single, checksum = flags[0] >> 5 & 1, flags[0] >> 2 & 1
        more = (0 if single else 1) + (0, 1, 2, 4)[flags[0] & 3] + ((1 if single else 0), 2, 4, 8)[flags[0] >> 6]
        parts = [head, flags, exactly(stream, more)]
        last = False
        while not last:
            block = exactly(stream, 3)
            number = int.from_bytes(block, "little")
            last, kind, size = number & 1, number >> 1 & 3, number >> 3
            if kind == 3:
                raise ValueError("a reserved block type")
            parts += [block, exactly(stream, 1 if kind == 1 else size)]
        yield magic, b"".join([*parts, exactly(stream, 4 * checksum)])


def records(stream) -> Iterator[bytes]:
    """The records of an archive, one frame each. A leading skippable frame's dictionary is used; other skippable frames are passed over."""
    decompressor = zstandard.ZstdDecompressor()
    for i, (magic, frame) in enumerate(frames(stream)):
        if magic == DICTIONARY_FRAME and i == 0:
            raw = zstandard.ZstdDecompressor().decompressobj().decompress(frame) if frame[:4] == struct.pack("<I", FRAME) else frame
            decompressor = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
        elif magic == FRAME:
            yield decompressor.decompressobj().decompress(frame)


class Writer:
    """Writes one archive. The first records, up to `sample` bytes, wait until they have taught the dictionary."""

    def __init__(self, stream, dictionary_bytes: int = 64 << 10, sample: int = 4 << 20, level: int = 6):
        self.stream, self.dictionary_bytes, self.sample, self.level = stream, dictionary_bytes, sample, level
        self.waiting: list[bytes] = []
        self.held, self.compressor = 0, None

    def add(self, raw: bytes) -> None:
        if self.compressor:
            self.stream.write(self.compressor.compress(raw))
            return
        self.waiting.append(raw)
        self.held += len(raw)
        if self.held >= self.sample:
            self.begin()

    def begin(self) -> None:
        try:
            trained = zstandard.train_dictionary(self.dictionary_bytes, [x[: 128 << 10] for x in self.waiting])
        except zstandard.ZstdError:  # too few or too uniform records teach nothing: their plain bytes serve as one
            trained = zstandard.ZstdCompressionDict(b"".join(self.waiting)[: self.dictionary_bytes], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        raw = trained.as_bytes()
        self.stream.write(struct.pack("<II", DICTIONARY_FRAME, len(raw)) + raw)
        self.compressor = zstandard.ZstdCompressor(level=self.level, dict_data=trained, write_checksum=True, write_content_size=True)
        for x in self.waiting:
            self.stream.write(self.compressor.compress(x))
        self.waiting = []

    def close(self) -> None:
        if not self.compressor:
            self.begin()


# Spark


def archived(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html", archive_bytes: int = 64 << 20) -> DataFrame:
    """Write a record for each row below `folder`; return the manifest (path, n_records).

    The payload is the text in UTF-8, null as no bytes. Of rows with equal payloads of any length, those with the
    smallest id are responses (more than one only if a row repeats, id and all), the others revisit it; where all
    ids are null, all are responses. Other columns are left out. An empty table writes nothing.
    folder: a URI that executors can write to. archive_bytes: of records, after which a task starts the next file.
    Only files in the manifest count, so what a lost task has left is never read.
    """
    c.check_columns(pages, page_id, url, html)
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html), F.lit("")).cast("binary").alias("payload"))
    digests = rows.select("page_id", F.sha2("payload", 256).alias(DIGEST))
    repeated = digests.groupBy(DIGEST).agg(F.min("page_id").alias(FIRST), F.count("*").alias("n")).where("n > 1").drop("n")
    rows = rows.withColumn(DIGEST, F.sha2("payload", 256)).join(repeated, DIGEST, "left").drop(DIGEST)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = c.file_system(folder)
        names, counts = [], []
        stream = writer = None
        size = 0
        for batch in batches:
            for page, link, payload, first in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if writer and size >= archive_bytes:
                    writer.close()
                    stream.close()
                    writer = None
                if not writer:
                    names.append(f"{root}/pages-{uuid.uuid4().hex}.warc.zst")
                    counts.append(0)
                    stream, size = system.open_output_stream(names[-1], compression=None), 0
                    writer = Writer(stream)
                raw = record(page, link, payload, first, first is not None and first != page)
                writer.add(raw)
                size += len(raw)
                counts[-1] += 1
        if writer:
            writer.close()
            stream.close()
        if names:
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(counts, pa.int64())], names=["path", "n_records"])

    system, root = c.file_system(folder)
    system.create_dir(root, recursive=True)
    return c.written(rows.mapInArrow(run, "path string, n_records long"), "archives")


RECORDS = "record_id string, page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def archive_records(manifest: DataFrame, folder: str, batch_bytes: int = 4 << 20, keep_malformed: bool = False) -> DataFrame:
    """The records of the manifest's archives (path, n_records; null: any number), each decoded and checked.

    A malformed one fails the job; with keep_malformed it is a row of type `malformed` whose payload is the whole record.
    payload is null for revisits. One record is decoded at a time.
    """
    files = manifest.repartition(max(1, manifest.count()), "path")
    names = [x.split()[0] for x in RECORDS.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]

    def packed(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = c.file_system(folder)
        for batch in batches:
            for path, expected in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows, size, n = [], 0, 0
                with system.open_input_stream(path, compression=None, buffer_size=1 << 20) as stream:
                    for raw in records(stream):
                        try:
                            rows.append(parsed(raw))
                        except ValueError:
                            if not keep_malformed:
                                raise
                            rows.append(dict.fromkeys(names) | {"record_type": "malformed", "payload": raw})
                        size, n = size + len(raw), n + 1
                        if size >= batch_bytes:
                            yield packed(rows)
                            rows, size = [], 0
                if expected is not None and n != expected:
                    raise ValueError(f"{path} has {n} records, the manifest says {expected}")
                if rows:
                    yield packed(rows)

    return files.mapInArrow(run, RECORDS)


def op6_warc(spark, sf_dir: str) -> DataFrame:
    """Every page's record, as read back from the archives that hold it."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    folder = c.shared_dir(spark, "warc")
    return archive_records(archived(pages, folder), folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
