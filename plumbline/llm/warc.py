"""WARC archives compressed record by record with a Zstandard dictionary that each file carries in a leading skippable frame.

Each task writes its own files: it reads records until SAMPLE_BYTES of payload are seen, trains a dictionary on those archived
records, writes it in a skippable frame, then compresses every record as a frame of its own, so that one record can be read
without the others. A file is closed at FILE_BYTES. Files are written under a temporary name and renamed, under names that
depend on the task alone: a task that runs again replaces its own files. Which record of a group of equal payloads is the
response is settled beforehand by an aggregation to the largest id, so no group is gathered.

Defined cases: a null html is an empty payload; payloads under LEAST_REVISIT bytes are never revisits; of equal payloads the
largest page id is the response (rows that share that id all are; if all ids are null, all are); a null page id or url has no
header and reads back as null; too few or too small samples make a file without a dictionary frame; an empty table makes no
file. Columns other than the three named ones are not archived.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, shared_dir

LEAST_REVISIT, SAMPLE_BYTES, DICTIONARY_BYTES, FILE_BYTES, LEVEL = 1000, 2_000_000, 32_768, 256_000_000, 3
SKIPPABLE, DATE = 0x184D2A5D, "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_NAMES = uuid.UUID("8f1c2a34-6f0b-4a0c-9a55-0d5c8c1f7e21")


def plan(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, html, response_id: the largest id of the rows with the same payload, null where nothing is revisited."""
    df = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    df = df.withColumns({"size": F.octet_length("html"), "digest": F.sha1(F.col("html").cast("binary"))})
    groups = df.filter(F.col("size") >= LEAST_REVISIT).groupBy("digest", "size").agg(F.max("page_id").alias("response_id"), F.count(F.lit(1)).alias("n"))
    return df.join(groups.filter("n > 1").drop("n"), ["digest", "size"], "left").select("page_id", "url", "html", "response_id")


def _record_id(page_id: str | None, salt: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMES, salt if page_id is None else page_id)}>"


def _record(page_id: str | None, url: str | None, payload: bytes, response_id: str | None, salt: str) -> bytes:
    revisit = response_id is not None and response_id != page_id
    digest = "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_record_id(page_id, salt)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe=":/?#[]@!$&'()*+,;=%~"))
    head.append(f"WARC-Payload-Digest: {digest}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_record_id(response_id, '')}", f"X-Refers-To-Page: {response_id}"]
    if page_id is not None:
        head.append(f"X-Page: {page_id}")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def train(samples: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=256, d=8)
    except zstandard.ZstdError:
        return None


class _File:
    """One archive in the making."""

    def __init__(self, store: fs.FileSystem, folder: str, name: str, dictionary: zstandard.ZstdCompressionDict | None):
        self.store, self.path, self.temporary = store, f"{folder}/{name}", f"{folder}/.{name}.{uuid.uuid4().hex}"
        self.out, self.size, self.records = store.open_output_stream(self.temporary, compression=None), 0, 0
        self.packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_checksum=True)
        if dictionary is not None:
            raw = dictionary.as_bytes()
            self._put(struct.pack("<II", SKIPPABLE, len(raw)) + raw)

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def add(self, record: bytes) -> None:
        self._put(self.packer.compress(record))
        self.records += 1

    def close(self) -> tuple[str, int, int]:
        self.out.close()
        self.store.move(self.temporary, self.path)
        return self.path, self.records, self.size


def _writer(folder: str):
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = fs.FileSystem.from_uri(folder)
        part, done, waiting, seen, file, row = TaskContext.get().partitionId(), [], [], 0, None, 0

        def opened(samples: list[bytes]) -> _File:
            store.create_dir(root, recursive=True)
            return _File(store, root, f"part-{part:06d}-{len(done):04d}.warc.zst", train(samples))

        for pdf in batches:
            for page_id, url, html, response_id in pdf.astype(object).where(pdf.notna(), None).itertuples(index=False):
                record = _record(page_id, url, html.encode("utf-8", "surrogatepass"), response_id, f"{part}/{row}")
                row += 1
                if file is None:
                    waiting.append(record)
                    seen += len(record)
                    if seen < SAMPLE_BYTES:
                        continue
                    file = opened(waiting)
                    for r in waiting:
                        file.add(r)
                    waiting, seen = [], 0
                else:
                    file.add(record)
                if file.size >= FILE_BYTES:
                    done.append(file.close())
                    file = None
        if waiting:
            file = opened(waiting)
            for r in waiting:
                file.add(r)
        if file is not None:
            done.append(file.close())
        yield pd.DataFrame(done, columns=["path", "records", "bytes"])

    return write


def write_archives(pages: DataFrame, folder: str, **columns: str) -> DataFrame:
    """Write the archives; returns a stored table of path, records, bytes, one row for each file."""
    df = plan(pages, **columns)
    df = df.withColumns({c: F.col(c).cast("string") for c in ("page_id", "response_id")})  # pandas would make doubles of ids with nulls
    return materialise(df.mapInPandas(_writer(folder), "path string, records bigint, bytes bigint"), "manifest")


def read_file(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an open archive, read in pieces."""
    buffer, dictionary, unpacker = b"", None, zstandard.ZstdDecompressor()

    def more(least: int) -> bool:
        nonlocal buffer
        while len(buffer) < least and (got := stream.read(1 << 20)):
            buffer += got
        return len(buffer) >= least

    while more(4):
        if struct.unpack_from("<I", buffer)[0] == SKIPPABLE:
            more(8)
            size = struct.unpack_from("<I", buffer, 4)[0]
            if not more(8 + size):
                raise ValueError("the dictionary frame is cut off")
            dictionary = zstandard.ZstdCompressionDict(buffer[8 : 8 + size])
            unpacker, buffer = zstandard.ZstdDecompressor(dict_data=dictionary), buffer[8 + size :]
            continue
        frame, parts = unpacker.decompressobj(), []
        while not frame.eof:
            if not buffer and not more(1):
                raise ValueError("a frame is cut off")
            parts.append(frame.decompress(buffer))
            buffer = frame.unused_data if frame.eof else b""
        record = b"".join(parts)
        head, _, rest = record.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        headers = dict(line.split(": ", 1) for line in lines[1:])
        yield headers, rest[: int(headers["Content-Length"])]


def _read(folder: str):
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, _ = fs.FileSystem.from_uri(folder)
        for pdf in batches:
            for path in pdf["path"]:
                rows = []
                with store.open_input_stream(path, compression=None) as stream:
                    for head, block in read_file(stream):
                        http, _, payload = block.partition(b"\r\n\r\n")
                        told = base64.b32decode(head["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                        if head["WARC-Type"] == "response":
                            size = len(payload)
                            if hashlib.sha1(payload).hexdigest() != told:
                                raise ValueError(f"a payload in {path} doesn't have its digest")
                        else:
                            size = int(http.rpartition(b"Content-Length: ")[2])
                        back = [head.get(k) for k in ("X-Page", "X-Refers-To-Page")]
                        page, refers = (None if x is None else int(x) for x in back)
                        rows.append((page, size, told, head["WARC-Type"], refers))
                        if len(rows) == 5000:
                            yield _frame(rows)
                            rows = []
                yield _frame(rows)

    return read


def _frame(rows: list) -> pd.DataFrame:
    names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    columns = zip(*rows, strict=True) if rows else [()] * len(names)
    kinds = {"page_id": "Int64", "payload_bytes": "int64", "refers_to": "Int64"}  # nullable whole numbers, never doubles
    return pd.DataFrame({n: pd.array(list(c), dtype=kinds.get(n, "object")) for n, c in zip(names, columns, strict=True)})


def read_archives(spark: SparkSession, manifest: DataFrame, folder: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every archived record, from the files of manifest."""
    files = manifest.select("path").repartition(max(1, spark.sparkContext.defaultParallelism * 2))
    return files.mapInPandas(_read(folder), "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint")


def archive_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
