"""WARC 1.1 records as bytes: one gzip member each, written and read one after another; no Spark.

Header names and the layout of a record are fixed by the WARC 1.1 specification.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import quote

CHUNK = 1 << 16
END = b"\r\n\r\n"
MAGIC = b"\x1f\x8b\x08"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def member(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as one gzip member; no time in it, so equal records are equal bytes."""
    head = "WARC/1.1\r\n" + "".join(f"{name}: {value}\r\n" for name, value in fields)
    head += f"WARC-Block-Digest: sha1:{digest(block)}\r\nContent-Length: {len(block)}\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(head.encode("utf-8", "surrogatepass")) + packer.compress(block) + packer.compress(END) + packer.flush()


def safe_uri(uri: str | None, otherwise: str) -> str:
    """The uri without characters that would break a header line."""
    return quote(uri, safe=":/?#[]@!$&'()*+,;=%-._~") if uri else otherwise


def response(record_id: str, uri: str, date: str, payload: bytes) -> bytes:
    block = HTTP + str(len(payload)).encode() + END + payload
    fields = [
        ("WARC-Type", "response"),
        ("WARC-Record-ID", f"<{record_id}>"),
        ("WARC-Date", date),
        ("WARC-Target-URI", uri),
        ("WARC-Payload-Digest", f"sha1:{digest(payload)}"),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    return member(fields, block)


def revisit(record_id: str, uri: str, date: str, payload_digest: str, refers_to: str) -> bytes:
    fields = [
        ("WARC-Type", "revisit"),
        ("WARC-Record-ID", f"<{record_id}>"),
        ("WARC-Date", date),
        ("WARC-Target-URI", uri),
        ("WARC-Payload-Digest", f"sha1:{payload_digest}"),
        ("WARC-Refers-To", f"<{refers_to}>"),
        ("WARC-Profile", REVISIT_PROFILE),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    return member(fields, b"HTTP/1.1 200 OK\r\n\r\n")


def info(name: str, date: str) -> bytes:
    fields = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:archive:{name}>"), ("WARC-Date", date), ("Content-Type", "application/warc-fields")]
    return member(fields, b"format: WARC File Format 1.1\r\n")


class BadRecord(ValueError):
    """A record that cannot be read or whose digest differs."""


def members(stream) -> Iterator[tuple[int, bytes | BadRecord]]:
    """Offset and content of each gzip member, decompressed as the stream is read.

    After a damaged member reading goes on at the next place that looks like the begin of one.
    """
    offset, pending = 0, b""
    while True:
        pending = pending or stream.read(CHUNK)
        if not pending:
            return
        unpacker, parts, used = zlib.decompressobj(31), [], 0
        try:
            while not unpacker.eof:
                if not pending:
                    pending = stream.read(CHUNK)
                    if not pending:
                        raise BadRecord("the archive ends within a record")
                parts.append(unpacker.decompress(pending))
                used += len(pending) - len(unpacker.unused_data)
                pending = unpacker.unused_data if unpacker.eof else b""
            yield offset, b"".join(parts)
            offset += used
        except (zlib.error, BadRecord) as error:
            yield offset, BadRecord(str(error))
            pending = pending[1:] if not used else pending  # the first bytes were no member
            offset += used or 1
            while True:
                at = pending.find(MAGIC)
                if at >= 0:
                    pending, offset = pending[at:], offset + at
                    break
                kept = pending[-2:]
                more = stream.read(CHUNK)
                if not more:
                    return
                offset += len(pending) - len(kept)
                pending = kept + more


def parse(content: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (names in lower case) and block of a record, framed by its content length."""
    cut = content.find(END)
    if cut < 0 or not content.startswith(b"WARC/"):
        raise BadRecord("no record header")
    fields = {}
    for line in content[:cut].decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    length = fields.get("content-length", "")
    if not length.isdigit():
        raise BadRecord("no content length")
    block = content[cut + 4 : cut + 4 + int(length)]
    if len(block) != int(length) or content[cut + 4 + int(length) :] != END:
        raise BadRecord("the content length does not frame the record")
    stated = fields.get("warc-block-digest")
    if stated and stated.removeprefix("sha1:") != digest(block):
        raise BadRecord("the block digest differs")
    return fields, block


def payload_of(fields: dict[str, str], block: bytes) -> bytes:
    """The HTTP body of a response, checked against its digest."""
    cut = block.find(END)
    payload = block[cut + 4 :] if cut >= 0 and block.startswith(b"HTTP/") else block
    stated = fields.get("warc-payload-digest")
    if stated and stated.removeprefix("sha1:") != digest(payload):
        raise BadRecord("the payload digest differs")
    return payload
