"""Dictionary-compressed WARC archives.

Each page becomes one WARC/1.1 record, compressed on its own as a Zstandard frame with a dictionary that was built from a
sample of the records. An archive starts with a skippable frame (magic 0x184D2A5D) that holds the dictionary, so a
reader needs nothing but the file, and any record can be read alone. Of pages with equal payloads the one with the smallest
page_id is a response; the others are revisits that refer to it.

Scale: tasks write archives of bounded size side by side, straight into the folder that all machines share, under
a name that depends on what is in them; a file gets its name when it is whole, so a task that runs again replaces it
by the same bytes. Which payloads are repeated is found from digests alone, combined before the shuffle; their list is
broadcast while it is short and joined by a shuffle beyond. Payloads themselves are never shuffled.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow, materialize, seeded, shared_folder

#: Records that the dictionary is built from, and bytes of each that are used.
SAMPLE = 400
DICTIONARY_BYTES = 64 << 10
MAGIC = 0x184D2A5D
LEVEL = 6
ARCHIVE_BYTES = 1 << 30
BROADCAST_ROWS = 200_000
#: Payloads under this size are always responses.
LEAST_BYTES = 0


def record(page_id, url: str | None, payload: bytes, refers_to) -> bytes:
    """The bytes of a WARC record; refers_to: the page_id that a revisit refers to, else None."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    body = b"" if refers_to is not None else b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {(url or 'about:blank').replace(chr(13), '%0D').replace(chr(10), '%0A')}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(body)}",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """A record's headers, in lower case, and its payload (empty for a revisit)."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    body = rest[: int(headers["content-length"])]
    return headers, body.partition(b"\r\n\r\n")[2] if body else b""


def build_dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary, or the plain tail of the samples where there are too few to train one."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-DICTIONARY_BYTES:]


class Writer:
    """An archive in the shared folder: write() records, then close(), which gives the file its name."""

    def __init__(self, folder: str, dictionary: bytes) -> None:
        self.fs, self.folder = pyarrow.fs.FileSystem.from_uri(folder)
        self.part = f"{self.folder}/.{uuid.uuid4().hex}.part"
        self.file = self.fs.open_output_stream(self.part, compression=None)
        self.pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary), write_content_size=True)
        self.sum, self.size, self.records = hashlib.sha256(), 0, 0
        self._put(struct.pack("<II", MAGIC, len(dictionary)) + dictionary)

    def _put(self, data: bytes) -> None:
        self.file.write(data)
        self.sum.update(data)
        self.size += len(data)

    def write(self, data: bytes) -> None:
        self._put(self.pack.compress(data))
        self.records += 1

    def close(self) -> str:
        self.file.close()
        name = f"{self.sum.hexdigest()[:32]}.warc.zst"
        self.fs.move(self.part, f"{self.folder}/{name}")
        return name


def read_archive(folder: str, name: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of an archive, one by one, by what the file itself says."""
    fs, path = pyarrow.fs.FileSystem.from_uri(folder)
    with fs.open_input_stream(f"{path}/{name}", compression=None) as f:
        magic, n = struct.unpack("<II", f.read(8))
        if magic != MAGIC:
            raise ValueError("no dictionary frame")
        unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(f.read(n)))
        held, frame = b"", unpack.decompressobj()
        out = io.BytesIO()
        while held or (held := f.read(1 << 20)):
            out.write(frame.decompress(held))
            held = b""
            if frame.eof:
                yield parse(out.getvalue())
                held, frame, out = frame.unused_data, unpack.decompressobj(), io.BytesIO()
        if out.getvalue():
            raise ValueError("archive ends inside a record")


def _as_uri(folder: str) -> str:
    return folder if ":" in folder.split("/", 1)[0] else f"file://{folder}"


def write_archives(pages: DataFrame, least_bytes: int = LEAST_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> tuple[str, DataFrame]:
    """Writes a record for each row of pages; the folder, and a table of the archives (name, records, bytes)."""
    spark = pages.sparkSession
    folder = _as_uri(shared_folder(spark, "warc"))
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    raw = F.encode("html", "UTF-8")
    keyed = rows.withColumns({"digest": F.sha1(raw), "n": F.length(raw)})
    firsts = keyed.where(F.col("n") >= least_bytes).groupBy("digest", "n").agg(F.min("page_id").alias("first_id"), F.count("*").alias("c"))
    firsts = materialize(firsts.where("c > 1 and first_id is not null").select("digest", "n", "first_id"), "payloads")
    few = firsts.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    told = keyed.join(F.broadcast(firsts) if few else firsts, ["digest", "n"], "left")
    refers = F.when(F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id"))
    told = told.select("page_id", "url", "html", refers.alias("refers_to"))

    ids = rows.select("page_id").where("page_id is not null").orderBy(seeded("page_id", seed=9), "page_id").limit(SAMPLE)
    picked = rows.join(F.broadcast(ids), "page_id").orderBy("page_id", "html").limit(SAMPLE)
    samples = [record(r.page_id, r.url, r.html.encode("utf-8", "surrogatepass"), None)[: 2 * DICTIONARY_BYTES] for r in picked.toLocalIterator()]
    dictionary = spark.sparkContext.broadcast(build_dictionary(samples))
    fs, path = pyarrow.fs.FileSystem.from_uri(folder)
    fs.create_dir(path, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(w: Writer) -> pa.RecordBatch:
            n, size = w.records, w.size
            return pa.RecordBatch.from_arrays([pa.array([w.close()]), pa.array([n], pa.int64()), pa.array([size], pa.int64())], ["name", "records", "bytes"])

        w = None
        for b in batches:
            for page_id, url, html, refers_to in zip(*(c.to_pylist() for c in b.columns), strict=True):
                w = w or Writer(folder, dictionary.value)
                w.write(record(page_id, url, html.encode("utf-8", "surrogatepass"), refers_to))
                if w.size >= archive_bytes:
                    yield done(w)
                    w = None
        if w:
            yield done(w)

    return folder, materialize(arrow(told, write, "name string, records bigint, bytes bigint"), "archives")


def read_archives(folder: str, archives: DataFrame, kind: str = "bigint") -> DataFrame:
    """A row for each record in the archives: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    key_type = pa.string() if kind == "string" else pa.int64()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def page(urn: str | None):
            key = urn.removeprefix("<urn:page:").removesuffix(">") if urn else ""
            return None if key == "" else key if kind == "string" else int(key)

        def batch(rows: list) -> pa.RecordBatch:
            types = [key_type, pa.int64(), pa.string(), pa.string(), key_type]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

        for b in batches:
            for name in b.column("name").to_pylist():
                rows = []
                for h, payload in read_archive(folder, name):
                    digest = h["warc-payload-digest"].removeprefix("sha1:")
                    n = int(h["x-payload-length"])
                    if h["warc-type"] == "response" and (len(payload) != n or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
                        raise ValueError(f"{name}: a payload does not match its digest")
                    rows.append((page(h["warc-record-id"]), n, digest, h["warc-type"], page(h.get("warc-refers-to"))))
                    if len(rows) == 5000:
                        yield batch(rows)
                        rows = []
                if rows:
                    yield batch(rows)

    spread = archives.select("name").repartition(max(1, archives.sparkSession.sparkContext.defaultParallelism * 2), "name")
    return arrow(spread, read, f"page_id {kind}, payload_bytes bigint, payload_digest string, record_type string, refers_to {kind}")


def round_trip(pages: DataFrame) -> DataFrame:
    """The records of pages as the archives that were written from them give them back.

    A null html is an empty payload; empty payloads are equal to each other. Rows that repeat the smallest page_id of a payload are
    each a response. A null page_id never is the smallest: such a row is a revisit where another row has its payload, else a
    response. An empty table writes no archive and gives no rows; other columns take no part.
    """
    folder, archives = write_archives(pages)
    kind = pages.schema["page_id"].dataType.simpleString()
    return read_archives(folder, archives, "string" if kind == "string" else "bigint")
