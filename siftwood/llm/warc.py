"""Web archives in Zstandard: one frame per record, behind a shared dictionary.

An archive starts with a skippable frame that holds a dictionary; every record
is a frame of its own, compressed with it. Tasks write archives of about
ROLL_BYTES to the shared folder and list them; only archives that the written
list names are read, so what a lost or repeated task left is ignored. Reading
streams an archive frame by frame and checks versions, required headers,
lengths and digests; anything odd raises.

Records with equal payloads (SHA-1 and length) are written once: the one with
the smallest page id is a response, the others are revisits that refer to it.
Rows with that same id are responses too. A page without an id is a revisit
where an equal page has one, and refers to nothing where none has. Null html is
an empty payload; a page without a url is named by its id.

The folder may be any that ``pyarrow.fs`` opens by its address.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import quote

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwood.cluster import broadcast_if_small, materialise, scratch_path
from siftwood.llm.frames import spread

# Fixed values of the format: the dictionary frame's magic number and profile names.
DICTIONARY_MAGIC = 0x184D2A5D
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
REQUIRED = ["WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length"]

ROLL_BYTES = 64 << 20
READ_BYTES = 128 << 10
DICTIONARY_BYTES = 64 << 10
# The dictionary is trained on the heads of at most about this many pages.
SAMPLE_PAGES = 1000
SAMPLE_HEAD = 8 << 10
LEVEL = 3


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _folder(address: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(address)


# --- one record --------------------------------------------------------------


def record(headers: dict[str, str], block: bytes) -> bytes:
    lines = [VERSION, *(f"{k}: {v}" for k, v in headers.items()), f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def page_record(page_id, url, payload: bytes, digest: str, first, date: str) -> bytes:
    """A response, or a revisit of page ``first``."""
    name = "null" if pd.isna(page_id) else int(page_id)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = first is not False
    block = http if revisit else http + payload
    headers = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": f"<urn:page:{name}>",
        "WARC-Date": date,
        "WARC-Target-URI": quote(url, safe="%/:=&?~#+!$,;'@()*[]") if isinstance(url, str) and url else f"urn:page:{name}",
        "WARC-Payload-Digest": f"sha1:{digest}",
        "WARC-Block-Digest": f"sha1:{sha1_base32(block)}",
        "Content-Type": "application/http;msgtype=response",
    }
    if revisit:
        headers["WARC-Profile"] = REVISIT_PROFILE
        headers["WARC-Refers-To"] = "<urn:page:null>" if pd.isna(first) else f"<urn:page:{int(first)}>"
    return record(headers, block)


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of a record; ValueError unless it is whole and sound."""
    head, found, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not found or lines[0] != VERSION:
        raise ValueError(f"not a {VERSION} record: {lines[0][:40]!r}")
    headers = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise ValueError(f"bad header line {line[:80]!r}")
        headers[name.strip()] = value.strip()
    missing = [k for k in REQUIRED if k not in headers]
    if missing:
        raise ValueError(f"headers missing: {missing}")
    if not headers["Content-Length"].isdigit() or int(headers["Content-Length"]) != len(rest) - 4 or rest[-4:] != b"\r\n\r\n":
        raise ValueError(f"{headers['WARC-Record-ID']}: block of {len(rest) - 4} bytes, header says {headers['Content-Length']}")
    block = rest[:-4]
    if headers.get("WARC-Block-Digest", "").removeprefix("sha1:") not in ("", sha1_base32(block)):
        raise ValueError(f"{headers['WARC-Record-ID']}: block digest differs")
    return headers, block


def parse_page(headers: dict[str, str], block: bytes) -> dict:
    """The page of a response or revisit record."""
    http, _, payload = block.partition(b"\r\n\r\n")
    lengths = [x.split(b":")[1] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
    digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
    size = int(lengths[0])
    if headers["WARC-Type"] == "response" and (size != len(payload) or digest != sha1_base32(payload)):
        raise ValueError(f"{headers['WARC-Record-ID']}: payload differs from its headers")
    page = lambda name: None if (x := name.removeprefix("<urn:page:").removesuffix(">")) == "null" else int(x)
    return {
        "page_id": page(headers["WARC-Record-ID"]),
        "payload_bytes": size,
        "payload_digest": digest,
        "record_type": headers["WARC-Type"],
        "refers_to": page(headers["WARC-Refers-To"]) if "WARC-Refers-To" in headers else None,
        "url": headers["WARC-Target-URI"],
        "payload": payload if headers["WARC-Type"] == "response" else None,
    }


# --- archives ------------------------------------------------------------------


def train_dictionary(samples: list[bytes]) -> bytes:
    """A dictionary for records; a short text of common headers where there is too little to train on."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return page_record(0, "http://", b"", sha1_base32(b""), False, "1970-01-01T00:00:00Z") * 4


def dictionary_frame(dictionary: bytes) -> bytes:
    return struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary


def read_frames(stream) -> Iterator[bytes]:
    """The records of an open archive, one frame each."""
    start = stream.read(8)
    if len(start) < 8 or struct.unpack("<II", start)[0] != DICTIONARY_MAGIC:
        raise ValueError("no dictionary frame at the start of the archive")
    size = struct.unpack("<II", start)[1]
    dictionary = stream.read(size)
    if len(dictionary) != size:
        raise ValueError("the dictionary frame is cut off")
    decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
    rest = b""
    while rest := rest or stream.read(READ_BYTES):
        frame, parts = decoder.decompressobj(), []
        while True:
            parts.append(frame.decompress(rest))
            if frame.eof:
                rest = frame.unused_data
                break
            rest = stream.read(READ_BYTES)
            if not rest:
                raise ValueError("the last frame is cut off")
        yield b"".join(parts)


def _write(folder: str, dictionary, roll: int, date: str) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, root = _folder(folder)
        # Frames keep no state between records, so one compressor serves all.
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary.value))
        out, path, n, size = None, "", 0, 0
        for batch in batches:
            for page_id, url, html, first, revisit in zip(*(batch[c] for c in ("page_id", "url", "html", "first", "revisit")), strict=True):
                if out is None:
                    path, n, size = f"{root}/{uuid.uuid4().hex}.warc.zst", 0, 0
                    out = files.open_output_stream(path)
                    out.write(dictionary_frame(dictionary.value))
                    about = {"WARC-Type": "warcinfo", "WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>", "WARC-Date": date, "Content-Type": "application/warc-fields"}
                    out.write(packer.compress(record(about, b"format: WARC File Format 1.1\r\n")))
                payload = html.encode("utf-8", "surrogatepass")
                frame = packer.compress(page_record(page_id, url, payload, sha1_base32(payload), first if revisit else False, date))
                out.write(frame)
                n, size = n + 1, size + len(frame)
                if size >= roll:
                    out.close()
                    out = None
                    yield pd.DataFrame({"path": [path], "records": [n], "bytes": [size]})
        if out is not None:
            out.close()
            yield pd.DataFrame({"path": [path], "records": [n], "bytes": [size]})

    return run


def _read(folder: str, payloads: bool) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, _ = _folder(folder)
        for batch in batches:
            for path, records in zip(batch["path"], batch["records"], strict=True):
                seen, rows, size = 0, [], 0
                with files.open_input_stream(path) as stream:
                    for data in read_frames(stream):
                        headers, block = parse_record(data)
                        if headers["WARC-Type"] not in ("response", "revisit"):
                            continue
                        row = parse_page(headers, block)
                        if not payloads:
                            row.pop("payload")
                        rows.append(row)
                        seen, size = seen + 1, size + len(data) * payloads
                        if len(rows) >= 5000 or size > 16 << 20:
                            yield _frame(rows)
                            rows, size = [], 0
                if seen != records:
                    raise ValueError(f"{path}: {seen} records, {records} were written")
                if rows:
                    yield _frame(rows)

    return run


def _frame(rows: list[dict]) -> pd.DataFrame:
    return pd.DataFrame(rows).astype({"page_id": "Int64", "refers_to": "Int64"})


def with_firsts(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, url, html, first (the smallest page id of its payload) and revisit."""
    html = F.coalesce(F.col("html"), F.lit(""))
    keys = [F.sha1(F.col("html").cast("binary")).alias("sha1"), F.octet_length("html").alias("size")]
    pages = spread(pages.select("page_id", "url", html.alias("html"))).select("*", *keys)
    repeated = pages.where(F.col("size") >= least).groupBy("sha1", "size").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    repeated = materialise(repeated.where("n > 1").select("sha1", "size", "first", F.lit(True).alias("many")), "repeated")
    joined = pages.join(broadcast_if_small(repeated, 100_000), ["sha1", "size"], "left")
    revisit = F.coalesce(F.col("many"), F.lit(False)) & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select("page_id", "url", "html", "first", revisit.alias("revisit"))


def write_archives(pages: DataFrame, least: int = 0, roll: int = ROLL_BYTES, date: str = "1970-01-01T00:00:00Z") -> tuple[str, DataFrame]:
    """Write all pages; returns the folder and the list of archives (path, records, bytes)."""
    spark = pages.sparkSession
    n = pages.count()
    some = F.pmod(F.xxhash64("page_id", "url"), F.lit(1 << 20)) < int((1 << 20) * min(1.0, SAMPLE_PAGES / max(n, 1)))
    heads = pages.where(some).select(F.substring("html", 1, SAMPLE_HEAD).alias("html")).where("html IS NOT NULL").limit(2 * SAMPLE_PAGES)
    dictionary = spark.sparkContext.broadcast(train_dictionary(sorted(r["html"].encode() for r in heads.collect())))
    folder = scratch_path(spark, "warc")
    files, root = _folder(folder)
    files.create_dir(root, recursive=True)
    write = _write(folder, dictionary, roll, date)
    listed = with_firsts(pages, least).mapInPandas(write, "path string, records bigint, bytes bigint")
    return folder, materialise(listed, "archives")


def read_archives(folder: str, listed: DataFrame, payloads: bool = True) -> DataFrame:
    """The pages of listed archives, from their records."""
    schema = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url string"
    dealt = listed.repartition(max(1, min(listed.count(), 10_000)))
    return dealt.mapInPandas(_read(folder, payloads), schema + (", payload binary" if payloads else ""))
