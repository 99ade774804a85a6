"""Secrets in text, confirmed by their structure.

Plain secrets are found by their grammar.  Besides, every long run of base64 or
hexadecimal digits, every armoured block and every dotted triple is a candidate:
it is decoded, and what it decodes to is parsed.  A private key counts when its
lengths nest exactly, down to the fields of a known key; a signed token when its
header is an object that names an algorithm and the signature has that
algorithm's size.  What decodes to text is searched in turn, NESTED times.
Certificates, public keys, unsigned tokens and data that merely look random do
not count.

Defined results: a null or empty text has no spans.  Offsets count code points
and ends are exclusive.  Plain spans always stay, whatever is confirmed beside
or within them.  Every row gives a row, repeated ones too; no rows give none.
Other columns are not read.  The time grows with the length of a text.
"""

from __future__ import annotations

import binascii
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import released

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "key", "signed")
KEY, SIGNED = 3, 4
SCHEMA = "doc_id long, spans array<struct<kind: string, start: long, end: long, base: boolean>>"

ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
#: Least digits of an encoded key, and of its shortest kind in hexadecimal.
RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{40,}+={0,2}")
ALL_HEX = re.compile(r"(?:[0-9a-f]{2}){32,}+|(?:[0-9A-F]{2}){32,}+")
#: An armoured block; its lines end as such or with a written-out \n.
ARMOUR = re.compile(r"-----BEGIN (?P<label>(?:[A-Z0-9]{1,12} ){0,3}PRIVATE KEY)-----(?P<body>(?:[A-Za-z0-9+/=\s]|\\[nr])++)-----END (?P=label)-----")
#: A triple whose first part can decode to an object.
TRIPLE = re.compile(r"(?<![A-Za-z0-9_.-])(e[wy][A-Za-z0-9_-]{10,}+)\.([A-Za-z0-9_-]{2,}+)\.([A-Za-z0-9_-]{16,}+)(?![.=])")
NESTED = 2

# Tags of the distinguished encoding.
INTEGER, BITS, OCTETS, OID, SEQUENCE, FIRST, SECOND = 0x02, 0x03, 0x04, 0x06, 0x30, 0xA0, 0xA1
# Object identifiers of password-based encryption and of bundled data.
SEALED = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c"))
BUNDLED = bytes.fromhex("2a864886f70d0107")
OPENSSH = b"openssh-key-v1\x00"
# Bytes of a signature, by algorithm; those of a modulus can be more.
SIGNATURE = {"HS256": 32, "HS384": 48, "HS512": 64, "ES256": 64, "ES256K": 64, "ES384": 96, "ES512": 132, "EdDSA": 64}
MODULUS = {f"{kind}{bits}" for kind in ("RS", "PS") for bits in (256, 384, 512)}


def decoded(digits: str) -> bytes | None:
    """The bytes of base64 digits of either alphabet, or None."""
    digits = digits.rstrip("=").replace("-", "+").replace("_", "/")
    if len(digits) % 4 == 1:
        return None
    try:
        return binascii.a2b_base64(digits + "=" * (-len(digits) % 4), strict_mode=True)
    except binascii.Error:
        return None


def fields(data: bytes, at: int, end: int, most: int = 16) -> list[tuple[int, int, int]] | None:
    """(tag, start, end) of the values that fill data[at:end] exactly, or None."""
    out = []
    while at < end:
        if len(out) == most or end - at < 2:
            return None
        tag, size, at = data[at], data[at + 1], at + 2
        if size & 0x80:
            n = size & 0x7F
            if not 1 <= n <= 4 or end - at < n or data[at] == 0:
                return None
            size, at = int.from_bytes(data[at : at + n], "big"), at + n
            if size < 0x80:
                return None
        if size > end - at:
            return None
        out.append((tag, at, at + size))
        at += size
    return out


def is_der_key(data: bytes) -> bool:
    """Whether data is a private key, sealed key or key bundle in the distinguished encoding."""
    whole = fields(data, 0, len(data), 1)
    if not whole or whole[0][0] != SEQUENCE:
        return False
    own = fields(data, *whole[0][1:])
    if not own or len(own) < 2:
        return False
    tags, value = [t for t, _, _ in own], [data[a:b] for _, a, b in own]

    def names(i: int) -> bytes:
        """The object identifier that the i-th field, a sequence, begins with."""
        inner = fields(data, *own[i][1:]) if tags[i] == SEQUENCE else None
        return data[inner[0][1] : inner[0][2]] if inner and inner[0][0] == OID else b""

    number = [int.from_bytes(v, "big") if t == INTEGER else -1 for t, v in zip(tags, value, strict=True)]
    if len(own) >= 9 and tags[:9] == [INTEGER] * 9 and number[0] in (0, 1):
        return number[1] == number[4] * number[5]
    if len(own) == 6 and tags == [INTEGER] * 6 and number[0] == 0:
        return 1 < number[3] < number[1] and 0 < number[5] < number[2] < number[1]
    if number[0] in (0, 1) and len(own) >= 3 and tags[1:3] == [SEQUENCE, OCTETS] and set(tags[3:]) <= {FIRST, SECOND, 0x81}:
        return bool(names(1)) and len(value[2]) >= 16
    if number[0] == 1 and tags[1] == OCTETS and set(tags[2:]) <= {FIRST, SECOND} and len(own) <= 4:
        return 20 <= len(value[1]) <= 66
    if len(own) == 2 and tags == [SEQUENCE, OCTETS]:
        return names(0).startswith(SEALED) and len(value[1]) >= 16
    return number[0] == 3 and tags[1] == SEQUENCE and len(own) <= 3 and names(1).startswith(BUNDLED)


def is_openssh_key(data: bytes) -> bool:
    """Whether data is a private key in that format: three names, a count, as many public keys and the private part, with nothing behind."""
    if not data.startswith(OPENSSH):
        return False
    at, left = len(OPENSSH), 3
    counted = False
    while left:
        if len(data) - at < 4:
            return False
        size, at = int.from_bytes(data[at : at + 4], "big"), at + 4
        if size > len(data) - at:
            return False
        at, left = at + size, left - 1
        if not left and not counted:
            if len(data) - at < 4:
                return False
            left, at, counted = int.from_bytes(data[at : at + 4], "big") + 1, at + 4, True
            if not 2 <= left <= 17:
                return False
    return at == len(data) and size > 0


def is_signed(head: str, payload: str, signature: str) -> bool:
    """Whether the parts are those of a signed token."""
    raw, body, sign = decoded(head), decoded(payload), decoded(signature)
    if raw is None or body is None or sign is None:
        return False
    try:
        header = json.loads(raw)
    except (ValueError, RecursionError):
        return False
    known = header.get("alg") if isinstance(header, dict) else None
    if not isinstance(known, str) or not known or known.lower() == "none":
        return False
    if known in SIGNATURE:
        return len(sign) == SIGNATURE[known]
    return len(sign) >= (128 if known in MODULUS else 16)


def confirmed(text: str, nested: int = NESTED) -> Iterator[tuple[int, int, int]]:
    """(start, kind's number, end) of what the structure of encoded data confirms."""
    if "-----BEGIN" in text:
        for m in ARMOUR.finditer(text):
            data = decoded(re.sub(r"\s|\\[nr]", "", m["body"]))
            if data and (is_der_key(data) or is_openssh_key(data)):
                yield m.start(), KEY, m.end()
    for m in TRIPLE.finditer(text):
        if is_signed(*m.groups()):
            yield m.start(), SIGNED, m.end()
    for m in RUN.finditer(text):
        run = m[0]
        readings = [binascii.unhexlify(run)] if ALL_HEX.fullmatch(run) else []
        if (data := decoded(run)) is not None:
            readings.append(data)
        kind = next((k for data in readings if (k := _kind(data, nested)) is not None), None)
        if kind is not None:
            yield m.start(), kind, m.end()


def _kind(data: bytes, nested: int) -> int | None:
    if is_der_key(data) or is_openssh_key(data):
        return KEY
    if nested and data.isascii():
        return next((k for _, k, _ in confirmed(data.decode("ascii"), nested - 1)), None)
    return None


def plain(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) by the grammar alone."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end() - m.start(1) >= 8]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)] if "AKIA" in text else []
    return out + [(m.start(), 2, m.end()) for m in HEX.finditer(text)]


def find(text: str | None) -> list[tuple[int, int, int, bool]]:
    """(start, kind's number, end, whether plain), in order."""
    if not text:
        return []
    return sorted([(*x, True) for x in plain(text)] + [(*x, False) for x in set(confirmed(text))])


def secret_spans(docs: DataFrame) -> DataFrame:
    """doc_id and the spans of every row of docs (doc_id, text)."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))

    @released
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [[{"kind": KINDS[k], "start": a, "end": b, "base": p} for a, k, b, p in find(text.as_py())] for text in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, kind)], ["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(task, SCHEMA)


def digest(found: DataFrame) -> DataFrame:
    """Counts and hash of the plain spans, and all spans as one string."""
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["base"])
    of = lambda kind: F.filter(base, lambda s: s["kind"] == kind)
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), F.size(F.filter("spans", lambda s: ~s["base"])).cast("long").alias("n_confirmed"))
