"""Secret scan with structural confirmation.

Three base patterns report as they match. Further candidates (base64 and hex runs, PEM blocks, dotted tokens) are
reported only after decoding confirms a structure: a DER private key whose nested lengths add up, an OpenSSH private key
whose length-prefixed fields fit, or a signed token whose header is a JSON object that names its algorithm. Base64 may be
wrapped into lines, with line ends written as they are or escaped, and a key may begin and end inside a run: where it
begins follows from its first bytes, where it ends from its length.

DER keys: PKCS#1, PKCS#8 (plain, or encrypted under a password scheme), SEC1 and DSA. PEM blocks hold one of these or an
OpenSSH key, or name a cipher in their header lines and hold whole blocks of it. Other encodings are not confirmed.

Spans are (kind, start, end) in code points, end exclusive, ordered by start, then kind as listed in KINDS, then end.
Texts of any length are scanned whole, as bytes; all patterns are ASCII. Null counts as empty: no span. Repeated rows each
report; spans that begin together are ordered as above, so there are no ties. An empty table gives an empty result. Extra
columns are ignored.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metaloom.llm.shared import SLICE

#: Kinds in their order; the first three are the base patterns.
KINDS = ("assign", "access", "hex", "token", "pem", "der", "openssh")
BASE = 3
#: On lower-cased bytes (A-Z only), so that letters match in either case.
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([a-z0-9+/_.=-]+)""")
ASSIGN_HINTS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{16,}")  # the maximal runs of [0-9a-f]+ with 16 characters or more
MIN_ASSIGN, MIN_ACCESS = 12, 18
#: A JSON object's first byte is 0x7B, so its base64 begins with e and one of the last 16 digits.
SIGNED = re.compile(rb"(?<![A-Za-z0-9_-])(e[w-z0-9_-][A-Za-z0-9_-]{8,})\.([A-Za-z0-9_-]{2,})\.([A-Za-z0-9_-]*)")
PEM_EDGE = re.compile(rb"-----(BEGIN|END) ([A-Z0-9 ]{0,40}PRIVATE KEY)-----")
#: What stands before a key's digits; nothing is given back, so that white space is read once.
PEM_HEAD = re.compile(rb"(?:\s|\\[rn])*+(?:[A-Za-z0-9-]{1,40}: [^\n\\]{0,200}(?:\n|\\[rn])++)*+")
PEM_BODY = re.compile(rb"(?:[A-Za-z0-9+/=\s]|\\[rn])++")
ENCRYPTED = re.compile(rb"Proc-Type: 4,ENCRYPTED\b.*DEK-Info: [A-Z0-9-]+,[0-9A-Fa-f]{16,}", re.S)
LINE_END = rb"(?:\r?\n[ \t]*|(?:\\r)?\\n)"
RUN64 = re.compile(rb"[A-Za-z0-9+/]{40,}(?:" + LINE_END + rb"[A-Za-z0-9+/]+)*={0,2}")
DIGITS64 = re.compile(rb"(?:\\[rn])+|[^A-Za-z0-9+/]+")
RUN16 = re.compile(rb"[0-9A-Fa-f]{64,}")
#: How a SEQUENCE begins: byte 0x30, then a length of one to three bytes.
START64, START16 = re.compile(rb"M[A-I]"), re.compile(rb"30")
MAGIC64 = base64.b64encode(b"openssh-key-v1\0")
#: Object identifiers of password-based encryption (PKCS#5 and PKCS#12), as far as they are alike.
PASSWORD_SCHEMES = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))
OPENSSH = b"openssh-key-v1\0"


def _tlv(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """(tag, start of value, end of value) of the DER element at a place; None unless it lies within end."""
    if at + 2 > end:
        return None
    tag, size, at = data[at], data[at + 1], at + 2
    if size >= 0x80:
        n = size & 0x7F
        if not 1 <= n <= 4 or at + n > end:
            return None
        size, at = int.from_bytes(data[at : at + n], "big"), at + n
        if size < 0x80:
            return None
    return (tag, at, at + size) if at + size <= end else None


def _children(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """The elements that fill at..end exactly; None if lengths do not add up."""
    out = []
    while at < end:
        x = _tlv(data, at, end)
        if x is None or len(out) == 64:
            return None
        out.append(x)
        at = x[2]
    return out


def is_der_private_key(data: bytes, start: int = 0, stop: int | None = None) -> bool:
    """PKCS#1, PKCS#8, SEC1 or DSA private key: one SEQUENCE over all bytes from start to stop with the fields of that kind,
    lengths nested. Values are stepped over, so the time does not go with their lengths."""
    stop = len(data) if stop is None else stop
    top = _tlv(data, start, stop)
    if top is None or top[0] != 0x30 or top[2] != stop:
        return False
    parts = _children(data, top[1], top[2])
    if not parts:
        return False
    tags = [p[0] for p in parts]
    if tags == [0x30, 0x04]:
        algorithm = _children(data, parts[0][1], parts[0][2])
        return bool(algorithm) and algorithm[0][0] == 0x06 and data.startswith(PASSWORD_SCHEMES, algorithm[0][1]) and parts[1][2] > parts[1][1]
    if tags[0] != 0x02 or parts[0][2] - parts[0][1] != 1:
        return False
    version = data[parts[0][1]]
    if len(tags) >= 9 and set(tags[:9]) == {0x02} and version in (0, 1):
        return all(p[2] > p[1] for p in parts)
    if tags == [0x02] * 6 and version == 0:
        return parts[1][2] - parts[1][1] >= 64 and all(p[2] > p[1] for p in parts)
    if tags[1:3] == [0x30, 0x04] and version in (0, 1):
        algorithm = _children(data, parts[1][1], parts[1][2])
        return bool(algorithm) and algorithm[0][0] == 0x06 and parts[2][2] > parts[2][1]
    if len(tags) >= 2 and tags[1] == 0x04 and version == 1 and parts[1][2] - parts[1][1] >= 16:
        return all(t in (0xA0, 0xA1) and _children(data, a, b) for t, a, b in parts[2:])
    return False


def openssh_size(data: bytes, start: int = 0) -> int:
    """Bytes of the OpenSSH private key from start on: the magic, then cipher, kdf and kdf options, a count, as many public
    keys and the private part, all by length; 0 if there is none."""
    if not data.startswith(OPENSSH, start):
        return 0
    at, stop = start + len(OPENSSH), len(data)

    def string() -> int:
        """Steps over a string; its length, or -1 where it does not fit."""
        nonlocal at
        n = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + n > stop:
            return -1
        at += 4 + n
        return n

    if string() <= 0 or string() <= 0 or string() < 0 or at + 4 > stop:
        return 0
    keys, at = int.from_bytes(data[at : at + 4], "big"), at + 4
    if not 1 <= keys <= 16:
        return 0
    return at - start if all(string() > 0 for _ in range(keys + 1)) else 0


class Decoded:
    """A run of digits decoded once from each place within a group of digits (4 digits are 3 bytes in base64, 2 are 1 in
    hexadecimal), whatever the number of keys that seem to begin in it."""

    def __init__(self, run: bytes, decode: Callable[[bytes], bytes], group: int, size: int) -> None:
        self.run, self.decode, self.group, self.size, self.kept = run, decode, group, size, {}

    def at(self, start: int) -> tuple[bytes, int]:
        """(bytes, place among them of the digit at start)."""
        shift = start % self.group
        if shift not in self.kept:
            self.kept[shift] = self.decode(self.run[shift:])
        return self.kept[shift], (start - shift) // self.group * self.size


def _sequence_size(head: bytes) -> int:
    """Bytes of the SEQUENCE that begins here, if its first element may be that of a key; 0 if not."""
    if len(head) < 8 or head[0] != 0x30:
        return 0
    n = head[1] & 0x7F if head[1] & 0x80 else 0
    if n > 3 or head[1] == 0x80:
        return 0
    size = int.from_bytes(head[2 : 2 + n], "big") if n else head[1]
    first = head[2 + n : 4 + n]
    return 2 + n + size if first == b"\x02\x01" or first[0] == 0x30 else 0


def _keys(run: bytes, starts: re.Pattern, decoded: Decoded, digits: Callable[[int], int]) -> Iterator[tuple[int, int]]:
    """(start, end) of the DER keys in a run of digits."""
    at = 0
    while m := starts.search(run, at):
        at = m.start() + 1
        size = _sequence_size(decoded.decode(run[m.start() : m.start() + 16]))
        end = m.start() + digits(size)
        if size >= 24 and end <= len(run):
            data, place = decoded.at(m.start())
            if place + size <= len(data) and is_der_private_key(data, place, place + size):
                yield m.start(), end
                at = end


def _unbase64(run: bytes) -> bytes:
    body = run.rstrip(b"=")
    body = body[:-1] if len(body) % 4 == 1 else body
    try:
        return base64.b64decode(body + b"=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return b""


def _unhex(run: bytes) -> bytes:
    return bytes.fromhex(run[: len(run) // 2 * 2].decode())


def is_signed_token(header: bytes, payload: bytes) -> bool:
    """The header decodes to a JSON object with a text alg; the payload decodes."""
    turn = bytes.maketrans(b"-_", b"+/")
    try:
        head = json.loads(_unbase64(header.translate(turn)))
    except (ValueError, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(head.get("alg"), str) and bool(_unbase64(payload.translate(turn)))


def _keys64(block: bytes) -> Iterator[tuple[int, int, int]]:
    """(start, end, kind) of the keys in a base64 block, line ends within it left out of the decoding."""
    run, places = block, None
    if DIGITS64.search(block.rstrip(b"=")):
        cuts = [(m.start(), m.end()) for m in DIGITS64.finditer(block)]
        inside = np.ones(len(block), bool)
        for a, b in cuts:
            inside[a:b] = False
        places = np.nonzero(inside)[0]
        run = np.frombuffer(block, np.uint8)[places].tobytes()
    decoded = Decoded(run, _unbase64, 4, 3)
    found = [(a, b, 5) for a, b in _keys(run, START64, decoded, lambda n: -(-n * 4 // 3))]
    at = run.find(MAGIC64)
    while at >= 0:
        name = int.from_bytes(_unbase64(run[at : at + 28])[15:19], "big")  # bytes of the cipher's name
        if 1 <= name <= 64 and (size := openssh_size(*decoded.at(at))):
            found.append((at, at - (-size * 4 // 3), 6))
        at = run.find(MAGIC64, at + 1)
    for a, b, kind in found:
        a, b = (a, b) if places is None else (int(places[a]), int(places[b - 1]) + 1)
        while block[b : b + 1] == b"=":
            b += 1
        yield a, b, kind


def _is_pem_key(header: bytes, body: bytes) -> bool:
    data = _unbase64(DIGITS64.sub(b"", body))
    if ENCRYPTED.search(header):
        return len(data) >= 32 and len(data) % 8 == 0
    return is_der_private_key(data) or openssh_size(data) == len(data) > 0


def _pem_blocks(raw: bytes) -> Iterator[tuple[int, int]]:
    """(start, end) of the private keys between BEGIN and END lines of one name, without another such line between."""
    begin = None
    for m in PEM_EDGE.finditer(raw):
        if m[1] == b"END" and begin is not None and begin[2] == m[2]:
            head = PEM_HEAD.match(raw, begin.end(), m.start())
            if PEM_BODY.fullmatch(raw, head.end(), m.start()) and _is_pem_key(head[0], raw[head.end() : m.start()]):
                yield begin.start(), m.end()
        begin = m if m[1] == b"BEGIN" else None


def find_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(start, end, number of the kind) of a whole text, in order."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    low = raw.lower()
    found = []
    if any(h in low for h in ASSIGN_HINTS):
        found += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(low) if m.end(2) - m.start(2) >= MIN_ASSIGN]
    if b"AKIA" in raw:
        found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(raw) if m.end() - m.start() >= MIN_ACCESS]
    found += [(m.start(), m.end(), 2) for m in HEX.finditer(raw)]
    if b"." in raw:
        found += [(m.start(), m.end(), 3) for m in SIGNED.finditer(raw) if is_signed_token(m[1], m[2])]
    blocks = []
    if b"-----BEGIN " in raw:
        blocks = list(_pem_blocks(raw))
        found += [(a, b, 4) for a, b in blocks]
    begins = [a for a, _ in blocks]
    for m in RUN64.finditer(raw):
        block = bisect_right(begins, m.start()) - 1
        if block < 0 or m.start() >= blocks[block][1]:
            found += [(m.start() + a, m.start() + b, kind) for a, b, kind in _keys64(m[0])]
    for m in RUN16.finditer(raw):
        found += [(m.start() + a, m.start() + b, 5) for a, b in _keys(m[0], START16, Decoded(m[0], _unhex, 2, 1), lambda n: 2 * n)]
    found = sorted(set(found), key=lambda s: (s[0], s[2], s[1]))
    if found and len(raw) != len(text or ""):
        points = np.concatenate(([0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)))
        found = [(int(points[a]), int(points[b]), k) for a, b, k in found]
    return found


def _join(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def scan_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_confirmed: a row per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, SLICE):
                part = batch.slice(i, SLICE)
                rows = []
                for text in part.column("text").to_pylist():
                    spans = find_spans(text)
                    kinds = [k for _, _, k in spans]
                    base = _join([s for s in spans if s[2] < BASE])
                    rows.append((*(kinds.count(k) for k in range(BASE)), hashlib.sha256(base.encode()).hexdigest(), _join(spans), sum(k >= BASE for k in kinds)))
                cols = list(zip(*rows))
                kinds_of = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, kinds_of))], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_confirmed"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_confirmed long")
