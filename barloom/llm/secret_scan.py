"""Secret scans with structural confirmation.

Base patterns give candidate spans per kind.  Beyond them, long base64 and hex runs are decoded and
reported only if their structure holds: DER private keys by nested lengths, OpenSSH keys by their
magic and length-prefixed fields, signed tokens by a JSON header that names an algorithm, PEM
private-key blocks by the decoded body, and encoded text by base secrets found in it.

Null and empty texts have no spans.  Offsets are code points, ends exclusive; bytes that are no UTF-8
count as replacement characters.  Texts may have any length; one is held at a time with its spans.  Of
spans that begin together the kind first in ``KINDS`` comes first.  Rows are independent: repeated rows,
null ids and further columns change nothing, and an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from barloom.llm.common import binary_text

BASE_KINDS = ("assign", "access", "hex")
#: All kinds, in the order that breaks ties of a start.
KINDS = (*BASE_KINDS, "pem", "der", "openssh", "token", "encoded")

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
_WORDS = (b"password", b"passwd", b"secret", b"token", b"api_key", b"apikey")

_JWT = re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]*\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*")
# Encoded texts of 16 bytes, the fewest that ``structure`` confirms, have 22 base64 or 32 hex digits.
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{22,}={0,2}")
_HEXKEY = re.compile(r"(?<![0-9A-Fa-f])(?:[0-9A-Fa-f]{2}){16,}(?![0-9A-Fa-f])")
_PEM = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*)PRIVATE KEY-----([A-Za-z0-9+/=\s]*)-----END \1PRIVATE KEY-----")
# Any place where a run of 22 characters of the base64 alphabets begins.
_RUN = re.compile(rb"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{22}")


def base_spans(text: str, low: bytes | None = None) -> list[tuple[str, int, int]]:
    low = text.encode().lower() if low is None else low
    found = []
    if any(w in low for w in _WORDS):
        found += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    if b"akia" in low:
        found += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return found


def decode_base64(run: str) -> bytes | None:
    body = run.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def tlv(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """Tag, start and end of the DER element at ``at``, or None if its length doesn't fit in ``end``."""
    if at + 2 > end:
        return None
    tag, n, at = data[at], data[at + 1], at + 2
    if n & 0x80:
        k = n & 0x7F
        if not 1 <= k <= 4 or at + k > end or data[at] == 0:
            return None
        n, at = int.from_bytes(data[at : at + k], "big"), at + k
        if n < 0x80:
            return None
    return (tag, at, at + n) if at + n <= end else None


def children(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    out = []
    while at < end:
        x = tlv(data, at, end)
        if x is None:
            return None
        out.append(x)
        at = x[2]
    return out


def _is_rsa_key(parts: list[tuple[int, int, int]]) -> bool:
    """PKCS#1: a version and the eight numbers of the key, then at most further primes."""
    return len(parts) >= 9 and all(tag == 0x02 and stop > start for tag, start, stop in parts[:9]) and all(tag == 0x30 for tag, _, _ in parts[9:])


def _is_ec_key(data: bytes, parts: list[tuple[int, int, int]]) -> bool:
    """SEC1: version 1, the private octets, then at most curve and public key."""
    if len(parts) < 2 or data[parts[0][1] : parts[0][2]] != b"\x01" or parts[1][0] != 0x04 or parts[1][2] - parts[1][1] < 16:
        return False
    return all(tag in (0xA0, 0xA1) and children(data, start, stop) is not None for tag, start, stop in parts[2:])


def _names_algorithm(data: bytes, part: tuple[int, int, int]) -> bool:
    inner = children(data, part[1], part[2]) if part[0] == 0x30 else None
    return bool(inner) and inner[0][0] == 0x06 and inner[0][2] > inner[0][1]


def is_der_private_key(data: bytes) -> bool:
    """PKCS#1, SEC1 or PKCS#8 private key, plain or encrypted, whose nested lengths all fit; of PKCS#8 the key inside too."""
    top = tlv(data, 0, len(data))
    if top is None or top[0] != 0x30 or top[2] != len(data):
        return False
    parts = children(data, top[1], top[2])
    if not parts:
        return False
    if len(parts) == 2 and parts[1][0] == 0x04 and _names_algorithm(data, parts[0]):  # encrypted in blocks of 8 or 16
        size = parts[1][2] - parts[1][1]
        return size >= 16 and size % 8 == 0
    if parts[0][0] != 0x02 or parts[0][2] - parts[0][1] != 1:
        return False
    if _is_rsa_key(parts) or _is_ec_key(data, parts):
        return True
    if len(parts) < 3 or parts[2][0] != 0x04 or not _names_algorithm(data, parts[1]) or any(tag not in (0xA0, 0xA1, 0x81) for tag, _, _ in parts[3:]):
        return False
    key = data[parts[2][1] : parts[2][2]]
    whole = tlv(key, 0, len(key))
    if whole is None or whole[2] != len(key):
        return False
    if whole[0] == 0x30:
        inner = children(key, whole[1], whole[2])
        return bool(inner) and inner[0][0] == 0x02 and (_is_rsa_key(inner) or _is_ec_key(key, inner))
    return whole[0] in (0x02, 0x04) and whole[2] - whole[1] >= 16


def _field(data: bytes, at: int) -> tuple[bytes, int] | None:
    """The length-prefixed field at ``at`` and where it ends, or None if it doesn't fit."""
    if at + 4 > len(data):
        return None
    end = at + 4 + int.from_bytes(data[at : at + 4], "big")
    return (data[at + 4 : end], end) if end <= len(data) else None


def is_openssh_key(data: bytes) -> bool:
    """Magic, three fields, the number of keys, as many public keys that name their type, and the private block, nothing after."""
    magic = b"openssh-key-v1\0"
    if not data.startswith(magic):
        return False
    at, head = len(magic), []
    for _ in range(3):  # cipher, key derivation, its options
        got = _field(data, at)
        if got is None:
            return False
        head.append(got[0])
        at = got[1]
    n = int.from_bytes(data[at : at + 4], "big")
    if at + 4 > len(data) or not 1 <= n <= 64 or not head[0].isascii() or not head[0]:
        return False
    at += 4
    for _ in range(n):
        public = _field(data, at)
        kind = _field(public[0], 0) if public else None
        if kind is None or not kind[0] or not kind[0].isascii():
            return False
        at = public[1]
    private = _field(data, at)
    if private is None or private[1] != len(data) or len(private[0]) < 16 or len(private[0]) % 8:
        return False
    # Two equal check numbers begin an unencrypted block.
    return head[0] != b"none" or private[0][:4] == private[0][4:8]


def is_signed_token(run: str) -> bool:
    """A JSON header that names an algorithm, a payload that decodes, and a signature of 16 bytes or more (none for "none")."""
    head, body, tail = run.split(".")
    try:
        header = json.loads(decode_base64(head) or b"")
    except ValueError:
        return False
    if not isinstance(header, dict) or not isinstance(header.get("alg"), str) or decode_base64(body) is None:
        return False
    signature = decode_base64(tail)
    return not tail if header["alg"].lower() == "none" else signature is not None and len(signature) >= 16


def structure(data: bytes | None) -> str | None:
    if not data:
        return None
    if data[0] == 0x30 and is_der_private_key(data):
        return "der"
    if is_openssh_key(data):
        return "openssh"
    if len(data) >= 16 and all(32 <= c < 127 or c in (9, 10, 13) for c in data):
        return "encoded" if base_spans(data.decode("ascii")) else None
    return None


def confirmed_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of candidates whose decoded structure is that of a key, a signed token or encoded secrets."""
    found = []
    for m in _PEM.finditer(text):
        if structure(decode_base64("".join(m[2].split()))) in ("der", "openssh"):
            found.append(("pem", *m.span()))
    found += [("token", *m.span()) for m in _JWT.finditer(text) if is_signed_token(m[0])]
    for m in _BASE64.finditer(text):
        if kind := structure(decode_base64(m[0])):
            found.append((kind, *m.span()))
    for m in _HEXKEY.finditer(text):
        if kind := structure(bytes.fromhex(m[0])):
            found.append((kind, *m.span()))
    return found


def scan(text: str | None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans and all spans, each by start, then kind as in KINDS, then end."""
    if not text:
        return [], []
    raw = text.encode()
    order = lambda x: (x[1], KINDS.index(x[0]), x[2])
    base = sorted(base_spans(text, raw.lower()), key=order)
    more = confirmed_spans(text) if b"PRIVATE KEY-----" in raw or b"eyJ" in raw or _RUN.search(raw) else []
    return base, sorted({*base, *more}, key=order)


def render(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def secret_scan(docs: DataFrame) -> DataFrame:
    """Every row of ``docs`` as (doc_id, base, spans): arrays of structs (kind, start, end)."""
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, spans = [], []
            for t in binary_text(batch):
                a, b = scan(t.decode("utf-8", "replace"))
                base.append([dict(zip(("kind", "start", "end"), x, strict=True)) for x in a])
                spans.append([dict(zip(("kind", "start", "end"), x, strict=True)) for x in b])
            ids = batch.column(batch.schema.get_field_index("doc_id"))
            yield pa.RecordBatch.from_arrays([ids, pa.array(base, pa.list_(span)), pa.array(spans, pa.list_(span))], ["doc_id", "base", "spans"])

    spans = "array<struct<kind:string,start:long,end:long>>"
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, base {spans}, spans {spans}")


def sha256_text(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
