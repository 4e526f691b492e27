"""WARC archives: pages are written as records of compressed volumes, and a salvage reader gets them back.

Writing. Of pages with equal payloads of REVISIT_BYTES bytes at least, the one with the smallest page_id is a response and
the others are revisits of it; smaller payloads are always responses. A volume is a complete .warc.gz file of VOLUME_BYTES or
little more, one gzip member a record, kept as a binary value: Spark's writers put it in any store, and tasks that run again
give the same bytes. Volumes in ordinary files are read through read_files().

Reading. A record counts if its version line, headers and length hold, and its payload has the digest its header names (SHA-256,
or SHA-1 in base 32 as other writers have it; other digests aren't checked). A member of one or more records is inflated, and its
checksum tested. After a failed check the reader searches for the next gzip member that gives a record, or the next version line,
in the archive and inside the inflated bytes of a member alike, and goes on there; the bytes between are logged as a quarantined
gap, those inside a member by their places in it. Of a member that is cut off, the records before the cut count. Of one that is
damaged, those before the fault count whose payload has its digest; a revisit has no payload to prove it by and stays in the gap.

Cases. A null html is an empty payload; a null url gives a record without a target. A null page_id gives a record without a
number, read back as null, never the one that others refer to unless all are null. Rows that repeat a smallest page_id are
responses each. Extra columns are ignored; an empty table gives no volumes and no records.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerlens.llm.common import only, stored

REVISIT_BYTES = 100
VOLUME_BYTES = 8 << 20
#: Digests of several pages go to every task if they are no more than this (40 bytes each); else they are joined, salted.
BROADCAST_DIGESTS = 200_000
SALTS = 32
#: Fixed values of the format.
VERSION, DATE, NAME = b"WARC/1.1", "2024-01-01T00:00:00Z", "urn:page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HEAD = re.compile(rb"WARC/1\.[01]\r?\n")

VOLUME = "volume string, records long, archive binary"
RECORD = "volume string, start long, length long, gap string, record_type string, record_id string, refers_to string, target string, payload_digest string, payload_bytes long, payload binary"


def _record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    kind = "revisit" if revisit else "response"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: <{NAME}{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if revisit:
        head += [f"WARC-Refers-To: <{NAME}{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return VERSION + b"\r\n" + "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def _volumes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    members, size, first, n = [], 0, None, 0

    def done() -> pd.DataFrame:
        name = hashlib.sha256(b"".join(x[-8:] for x in members)).hexdigest()[:12]
        return pd.DataFrame({"volume": [f"pages-{first}-{name}.warc.gz"], "records": [n], "archive": [b"".join(members)]})

    for frame in frames:
        ids = [None if pd.isna(x) else int(x) for x in frame["page_id"]]
        refs = [None if pd.isna(x) else int(x) for x in frame["refers_to"]]
        for page_id, url, html, digest, ref in zip(ids, frame["url"], frame["html"], frame["digest"], refs, strict=True):
            payload = b"" if html is None else html.encode("utf-8", "surrogatepass")
            member = gzip.compress(_record(page_id, url, payload, digest, ref, ref is not None), 6, mtime=0)
            first = page_id if first is None else first
            members.append(member)
            size, n = size + len(member), n + 1
            if size >= VOLUME_BYTES:
                yield done()
                members, size, first, n = [], 0, None, 0
    if members:
        yield done()


def written(pages: DataFrame) -> DataFrame:
    """Volumes (volume, records, archive) that hold a record for each row of pages(page_id, url, html)."""
    rows = only(pages, "page_id", "url", "html").withColumn("page_id", F.col("page_id").cast("long"))
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = rows.withColumns({"bytes": F.octet_length(payload), "digest": F.sha2(payload, 256)})
    large = rows.where(F.col("bytes") >= REVISIT_BYTES).groupBy(F.unhex("digest").alias("__key")).agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    several = stored(large.where("n > 1 AND first IS NOT NULL").select("__key", "first"), "digests")
    rows = rows.withColumn("__key", F.unhex("digest"))
    if several.count() <= BROADCAST_DIGESTS:
        joined = rows.join(F.broadcast(several), "__key", "left")
    else:
        salted = several.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.withColumn("__salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")).join(salted, ["__key", "__salt"], "left")
    refers_to = F.when((F.col("bytes") >= REVISIT_BYTES) & ~F.col("first").eqNullSafe(F.col("page_id")), F.col("first"))
    return joined.select("page_id", "url", "html", "digest", refers_to.alias("refers_to")).mapInPandas(_volumes, VOLUME)


def _proved(payload: bytes, digest: str) -> bool | None:
    """Whether the payload has the digest, null if its algorithm isn't known."""
    kind, colon, value = digest.partition(":")
    if not colon:
        return hashlib.sha256(payload).hexdigest() == digest.lower()
    if kind.lower() == "sha1":
        return base64.b32encode(hashlib.sha1(payload).digest()).decode() == value.upper()
    return None


def _parsed(data: bytes, start: int = 0) -> tuple[dict, int]:
    """The record at start, and where it ends; ValueError if a check fails."""
    if not (m := _HEAD.match(data, start)):
        raise ValueError("version line")
    over = data.find(b"\r\n\r\n", m.end())
    if over < 0:
        raise ValueError("headers")
    head = {}
    for line in data[m.end() : over].decode("utf-8", "replace").split("\r\n"):
        key, colon, value = line.partition(":")
        if not colon:
            raise ValueError("header line")
        head[key.strip().lower()] = value.strip()
    if not head.get("content-length", "").isdigit():
        raise ValueError("length")
    begin = over + 4
    end = begin + int(head["content-length"])
    if data[end : end + 4] != b"\r\n\r\n":
        raise ValueError("block end")
    block = data[begin:end]
    # Records of other kinds than HTTP messages, such as warcinfo, are payload throughout.
    is_http = head.get("content-type", "application/http").lower().startswith("application/http")
    http, _, payload = block.partition(b"\r\n\r\n") if is_http else (b"", b"", block)
    kind, digest = head.get("warc-type", ""), head.get("warc-payload-digest", "").removeprefix("sha256:")
    size = len(payload)
    if kind == "revisit":
        found = re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", http)
        size = int(found[1]) if found else None
    elif digest and _proved(payload, digest) is False:
        raise ValueError("payload digest")
    name = lambda key: head[key].strip("<>") if key in head else None
    return {"record_type": kind, "record_id": name("warc-record-id"), "refers_to": name("warc-refers-to"), "target": head.get("warc-target-uri"), "payload_digest": digest or None, "payload_bytes": size, "payload": payload}, end + 4


def _inflated(data: bytes, start: int) -> tuple[bytes, int, str | None, bool]:
    """The gzip member at start as far as it inflates, where it ends, what is wrong with it, and whether that is no more than a cut."""
    inflate, out, at = zlib.decompressobj(31), [], start
    while not inflate.eof:
        piece = data[at : at + 65_536]
        if not piece:
            return b"".join(out), at, "cut off", True
        before = inflate.copy()
        try:
            out.append(inflate.decompress(piece))
        except zlib.error as failed:
            # What the piece gives before its fault, byte by byte.
            for i in range(len(piece)):
                try:
                    out.append(before.decompress(piece[i : i + 1]))
                except zlib.error:
                    break
            return b"".join(out), at, str(failed), False
        at += len(piece)
    return b"".join(out), at - len(inflate.unused_data), None, False


def _inner(data: bytes, only_proved: bool) -> Iterator[tuple[int, int, str | None, dict]]:
    """(start, end, why, record) of each record or gap of plain bytes, in order."""
    at = 0
    while at < len(data):
        p, why = at, None
        while p >= 0:
            try:
                found, end = _parsed(data, p)
                if only_proved and (found["record_type"] == "revisit" or not found["payload_digest"] or not _proved(found["payload"], found["payload_digest"])):
                    raise ValueError("not proved by a digest")
                break
            except ValueError as failed:
                why = why or f"ValueError: {failed}"
                p = data.find(b"WARC/1.", p + 1)
        if why is not None:
            yield at, len(data) if p < 0 else p, why, {}
        if p < 0:
            return
        yield p, end, None, found
        at = end


def _unit(data: bytes, p: int) -> tuple[list[dict], list[str], int | None]:
    """Records of the member or plain record at p, what was wrong, and where it ends (null if that isn't known)."""
    if data[p : p + 2] != b"\x1f\x8b":
        try:
            found, end = _parsed(data, p)
        except ValueError as failed:
            return [], [f"ValueError: {failed}"], None
        return [found], [], end
    inner, end, fault, cut = _inflated(data, p)
    rows = list(_inner(inner, fault is not None and not cut))
    # The last gap of a member with a fault is what the fault left.
    faults = [f"{why}; bytes {a} to {b} inside the member" for a, b, why, _ in rows if why is not None and (fault is None or b < len(inner))]
    if fault is not None:
        faults.insert(0, f"error: {fault}")
    elif not rows:
        faults = ["ValueError: empty member"]
    return [one for _, _, why, one in rows if why is None], faults, end if fault is None else None


def records(data: bytes) -> Iterator[tuple[int, int, str | None, dict]]:
    """(start, length, why, record) of each record, or of each quarantined gap, of one archive in order; why is null for records.

    Records and gaps of one member have the member's start and length.
    """

    def candidates(p: int) -> Iterator[int]:
        member, line = data.find(b"\x1f\x8b\x08", p), data.find(b"WARC/1.", p)
        while member >= 0 or line >= 0:
            if line < 0 or 0 <= member < line:
                yield member
                member = data.find(b"\x1f\x8b\x08", member + 1)
            else:
                yield line
                line = data.find(b"WARC/1.", line + 1)

    at, unit = 0, None
    while at < len(data):
        found, faults, end = unit or _unit(data, at)
        unit = None
        if end is None:
            end = len(data)
            for p in candidates(at + 1):
                later = _unit(data, p)
                if later[0]:
                    end, unit = p, later
                    break
        for one in found:
            yield at, end - at, None, one
        for why in faults:
            yield at, end - at, why[:200], {}
        at = end


def _read(with_payload: bool):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in RECORD.split(", ")]
        for frame in frames:
            for volume, archive in zip(frame["volume"], frame["archive"], strict=True):
                rows, size = [], 0
                for start, length, gap, found in records(bytes(archive or b"")):
                    if not with_payload:
                        found.pop("payload", None)
                    rows.append({"volume": volume, "start": start, "length": length, "gap": gap} | found)
                    size += len(found.get("payload") or b"")
                    if size > VOLUME_BYTES or len(rows) >= 10_000:
                        yield pd.DataFrame(rows, columns=names)
                        rows, size = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=names)

    return run


def read(volumes: DataFrame, *, payload: bool = True) -> DataFrame:
    """Records and, where gap isn't null, quarantined byte ranges of volumes(volume, archive)."""
    return only(volumes, "volume", "archive").mapInPandas(_read(payload), RECORD)


def read_files(spark: SparkSession, path: str, *, payload: bool = True) -> DataFrame:
    """The same of archive files, plain or compressed, in any store that Spark reads."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("volume"), F.col("content").alias("archive"))
    return read(files, payload=payload)


def page_number(record_id: str):
    """The number in a record's name, null if it has none."""
    return F.nullif(F.regexp_extract(record_id, f"^{NAME}(-?[0-9]+)$", 1), F.lit("")).cast("long")


def digests(pages: DataFrame) -> DataFrame:
    """Writes the pages, reads the archives back, and gives page_id, payload_bytes, payload_digest, record_type and refers_to."""
    found = read(stored(written(pages), "archives"), payload=False).where("gap IS NULL")
    return found.select(page_number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page_number("refers_to").alias("refers_to"))
