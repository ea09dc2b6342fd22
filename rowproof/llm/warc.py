"""WARC records in seekable Zstandard bundles.

Records are grouped into frames of about `frame_bytes`, each compressed on its own, and a bundle ends
in a seek table: a skippable frame that lists the compressed and full size of every frame. The index
maps a record to its bundle, its frame and its offset within the frame, so one record costs one frame.
A bundle's bytes are kept as rows of (bundle, part, bytes): put in order they are one .warc.zst file,
which any Zstandard reader can read; `save_bundles` writes them out. Spark commits the rows, so a
lost executor leaves no half bundle.

Of records with equal payloads of at least `least_bytes` bytes the one with the largest id is a
response and the others are revisits, which name it and hold no payload; smaller payloads are all
responses. A null html is an empty payload, a null url an empty target. Rows with a null id, or that
repeat an id, each get a record; of equal payloads under one largest id the id's records are all responses.
"""
from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
PARTS = "bundle bigint, part int, kind string, bytes binary, page_ids array<bigint>, offsets array<int>"
READ = ("page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, "
        "target_uri string, bundle bigint, part int, offset int, intact boolean")


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, size: int, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit has the response's id and no payload."""
    kind = "response" if refers_to is None else "revisit"
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
            f"WARC-Target-URI: {(url or '').encode('unicode_escape').decode()}", f"WARC-Payload-Digest: sha1:{digest}",
            f"WARC-Payload-Length: {size}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>",
                 "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        payload = b""
    head += ["Content-Type: text/html", f"Content-Length: {len(payload)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def records(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, header fields, payload) of every record of a frame."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        first, *lines = data[at:end].decode().split("\r\n")
        if first != "WARC/1.1":
            raise ValueError(f"no record at {at}")
        fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
        size = int(fields["Content-Length"])
        yield at, fields, data[end + 4:end + 4 + size]
        at = end + 8 + size


def seek_table(sizes: list[tuple[int, int]]) -> bytes:
    entries = b"".join(struct.pack("<II", *s) for s in sizes)
    return struct.pack("<II", SKIPPABLE, len(entries) + 9) + entries + struct.pack("<IBI", len(sizes), 0, SEEKABLE)


def read_seek_table(bundle: bytes) -> list[tuple[int, int]]:
    """(compressed, full) size of every frame of a bundle file, from its end."""
    count, _, magic = struct.unpack("<IBI", bundle[-9:])
    if magic != SEEKABLE:
        raise ValueError("not a seekable bundle")
    body = bundle[-9 - 8 * count:-9]
    return [struct.unpack_from("<II", body, 8 * i) for i in range(count)]


def revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, url, html, size, refers_to): refers_to is null for responses.

    The largest id of each digest is found from digests alone, summed up before they move.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    known = pages.select("page_id", "url", "html", F.octet_length(payload).cast("bigint").alias("size"), F.sha1(payload).alias("sha"))
    largest = (known.where(F.col("size") >= least_bytes).groupBy("size", "sha")
               .agg(F.max("page_id").alias("largest"), F.count("*").alias("n")).where("n > 1").drop("n"))
    named = known.join(largest, ["size", "sha"], "left")
    return named.select("page_id", "url", "html", "size",
                        F.when(F.col("page_id") != F.col("largest"), F.col("largest")).alias("refers_to"))


def write_bundles(pages: DataFrame, least_bytes: int = 0, frame_bytes: int = 1 << 18, bundle_bytes: int = 1 << 26,
                  level: int = 3) -> DataFrame:
    """Rows of bundles: frames (kind 'frame', with their index) and seek tables (kind 'seek')."""
    def bundled(batches):
        import zstandard
        from pyspark import TaskContext

        squeeze = zstandard.ZstdCompressor(level=level, write_content_size=True)
        bundle, part, sizes, written = TaskContext.get().partitionId() << 32, 0, [], 0
        held, ids, offsets, filled = [], [], [], 0

        def row(kind, data, ids=(), offsets=()):
            return pa.RecordBatch.from_arrays(
                [pa.array([bundle], pa.int64()), pa.array([part], pa.int32()), pa.array([kind]), pa.array([data], pa.binary()),
                 pa.array([list(ids)], pa.list_(pa.int64())), pa.array([list(offsets)], pa.list_(pa.int32()))],
                ["bundle", "part", "kind", "bytes", "page_ids", "offsets"])

        def close():
            nonlocal part, written, filled
            frame = squeeze.compress(b"".join(held))
            sizes.append((len(frame), filled))
            out = row("frame", frame, ids, offsets)
            part, written, filled = part + 1, written + len(frame), 0
            held.clear(), ids.clear(), offsets.clear()
            return out

        for batch in batches:
            for page, url, html, refers in zip(*(batch[c].to_pylist() for c in ("page_id", "url", "html", "refers_to"))):
                payload = (html or "").encode("utf-8", "surrogatepass")
                piece = record(page, url, payload, len(payload), digest_of(payload), refers)
                ids.append(page), offsets.append(filled), held.append(piece)
                filled += len(piece)
                if filled >= frame_bytes:
                    yield close()
                    if written >= bundle_bytes:
                        yield row("seek", seek_table(sizes))
                        bundle, part, written = bundle + 1, 0, 0
                        sizes.clear()
        if held:
            yield close()
        if sizes:
            yield row("seek", seek_table(sizes))

    return revisits(pages, least_bytes).select("page_id", "url", "html", "refers_to").mapInArrow(bundled, PARTS)


def read_bundles(parts: DataFrame) -> DataFrame:
    """Every record of the bundles. intact: the bytes read have the digest and the length their header states,
    and the record lies where the index says."""
    def opened(batches):
        import zstandard

        expand = zstandard.ZstdDecompressor()
        for batch in batches:
            out = []
            for bundle, part, data, ids, offsets in zip(*(batch[c].to_pylist() for c in ("bundle", "part", "bytes", "page_ids", "offsets"))):
                for (at, fields, payload), page, offset in zip(records(expand.decompress(data)), ids, offsets, strict=True):
                    digest, size = fields["WARC-Payload-Digest"].removeprefix("sha1:"), int(fields["WARC-Payload-Length"])
                    named = fields["WARC-Record-ID"][len("<urn:page:"):-1]
                    response = fields["WARC-Type"] == "response"
                    fine = at == offset and named == ("" if page is None else str(page))
                    if response:
                        fine = fine and digest_of(payload) == digest and len(payload) == size
                    out.append((int(named) if named else None, size, digest, fields["WARC-Type"],
                                None if response else int(fields["WARC-Refers-To"][len("<urn:page:"):-1]),
                                fields["WARC-Target-URI"], bundle, part, at, fine))
            if out:
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)],
                                                 [f.split()[0] for f in READ.split(", ")])

    return parts.where("kind = 'frame'").select("bundle", "part", "bytes", "page_ids", "offsets").mapInArrow(opened, READ)


def index_of(parts: DataFrame) -> DataFrame:
    """(page_id, bundle, part, offset): where each record begins, relative to its frame."""
    return (parts.where("kind = 'frame'").select("bundle", "part", F.explode(F.arrays_zip("page_ids", "offsets")).alias("at"))
            .select(F.col("at.page_ids").alias("page_id"), "bundle", "part", F.col("at.offsets").alias("offset")))


def fetch(parts: DataFrame, page_ids: DataFrame) -> DataFrame:
    """The records of the given ids (page_id), from their frames alone."""
    wanted = index_of(parts).join(page_ids.select("page_id").distinct(), "page_id", "left_semi")
    frames = parts.join(wanted.select("bundle", "part").distinct(), ["bundle", "part"], "left_semi")
    return read_bundles(frames).join(page_ids.select("page_id").distinct(), "page_id", "left_semi")


def save_bundles(parts: DataFrame, folder: str) -> DataFrame:
    """Write each bundle as a file in a folder that all executors mount; returns (bundle, file, bytes).

    A file appears under its name only when whole. A bundle's rows meet in one task, a frame at a time.
    """
    def saved(batches):
        import os

        name = open_file = None
        done = []

        def finish():
            open_file.close()
            os.replace(open_file.name, name)
            done.append((int(os.path.basename(name).split(".")[0]), name, os.path.getsize(name)))

        for batch in batches:
            for bundle, data in zip(batch["bundle"].to_pylist(), batch["bytes"].to_pylist()):
                target = os.path.join(folder, f"{bundle}.warc.zst")
                if target != name:
                    if open_file:
                        finish()
                    name, open_file = target, open(f"{target}.{os.getpid()}.part", "wb")
                open_file.write(data)
        if open_file:
            finish()
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.string()),
                                          pa.array([d[2] for d in done], pa.int64())], ["bundle", "file", "bytes"])

    ordered = parts.repartition("bundle").sortWithinPartitions("bundle", "part").select("bundle", "bytes")
    return ordered.mapInArrow(saved, "bundle bigint, file string, bytes bigint")
