from __future__ import annotations

import base64
import hashlib
import json
import random
import re

import pytest

from tessera.llm import secrets

P, Q = (1 << 521) - 1, (1 << 607) - 1


def tlv(tag, *parts):
    body = b"".join(parts)
    size = len(body)
    return bytes([tag]) + (bytes([size]) if size < 128 else bytes([0x80 | (size.bit_length() + 7) // 8]) + size.to_bytes((size.bit_length() + 7) // 8, "big")) + body


def number(n):
    return tlv(2, n.to_bytes(n.bit_length() // 8 + 1, "big"))


RSA_NAME = tlv(0x30, tlv(6, bytes.fromhex("2a864886f70d010101")), tlv(5))
RSA = tlv(0x30, *map(number, (0, P * Q, 65537, 3**600, P, Q, 5, 7, 11)))
PKCS8 = tlv(0x30, number(0), RSA_NAME, tlv(4, RSA))
EC = tlv(0x30, number(1), tlv(4, bytes(range(32))), tlv(0xA0, tlv(6, bytes.fromhex("2a8648ce3d030107"))), tlv(0xA1, tlv(3, bytes(66))))
DSA = tlv(0x30, *map(number, (0, 23**30, 11**20, 5**20, 7, 9)))
SEALED = tlv(0x30, tlv(0x30, tlv(6, bytes.fromhex("2a864886f70d01050d")), tlv(0x30)), tlv(4, bytes(64)))
BUNDLE = tlv(0x30, number(3), tlv(0x30, tlv(6, bytes.fromhex("2a864886f70d010701")), tlv(0xA0, tlv(4, bytes(40)))))
PUBLIC = tlv(0x30, RSA_NAME, tlv(3, b"\0", tlv(0x30, number(P * Q), number(65537))))


def ssh(*names, keys=(b"public",), private=b"private part", count=None):
    text = lambda b: len(b).to_bytes(4, "big") + b
    return b"openssh-key-v1\0" + b"".join(map(text, names)) + (len(keys) if count is None else count).to_bytes(4, "big") + b"".join(map(text, (*keys, private)))


SSH = ssh(b"none", b"none", b"")
KEYS = {"rsa": RSA, "pkcs8": PKCS8, "ec": EC, "dsa": DSA, "sealed": SEALED, "bundle": BUNDLE, "ssh": SSH}


def b64(data, url=False):
    return (base64.urlsafe_b64encode(data).rstrip(b"=") if url else base64.b64encode(data)).decode()


def armour(data, label="PRIVATE KEY", end="\n"):
    digits = b64(data)
    return end.join([f"-----BEGIN {label}-----", *(digits[i : i + 64] for i in range(0, len(digits), 64)), f"-----END {label}-----"])


def token(alg="HS256", size=32, payload=b'{"sub":"1"}', **more):
    return ".".join(b64(x, True) for x in (json.dumps({"alg": alg, **more}).encode(), payload, bytes(range(size))))


def added(text):
    return [(secrets.KINDS[k], text[a:b]) for a, k, b, base in secrets.find(text) if not base]


@pytest.mark.parametrize("name", KEYS)
def test_keys_are_found_however_they_are_written(name):
    data = KEYS[name]
    for written in (b64(data), b64(data, True), data.hex(), data.hex().upper(), armour(data, "RSA PRIVATE KEY"), armour(data, end="\\n"), b64(armour(data).encode()), b64(b64(data).encode())):
        assert added(f'é key: "{written}" end') == [("key", written)]


@pytest.mark.parametrize("name", KEYS)
def test_a_length_that_does_not_fit_is_no_key(name):
    data = KEYS[name]
    for wrong in (data[:-1], data + b"\0", data[:1] + bytes([data[1] ^ 1]) + data[2:], b"\x31" + data[1:]):
        assert added(f"x {b64(wrong)} y") == []
        assert added(armour(wrong)) == []
        assert added(wrong.hex()) == []


def test_what_is_no_secret():
    draw = random.Random(5)
    noise = [b64(draw.randbytes(n)) for n in (30, 64, 200, 1000) for _ in range(50)]
    assert not any(added(x) for x in [*noise, b64(PUBLIC), armour(PUBLIC, "PUBLIC KEY"), b64(b"just a long sentence of plain words"), "a" * 100_000, "-----BEGIN PRIVATE KEY-----\n" * 500])
    assert added(b64(tlv(0x30, *map(number, (0, P * Q + 2, 65537, 3, P, Q, 5, 7, 11))))) == []  # no product of its primes
    assert added(b64(ssh(b"none", b"none", b"", count=2))) == [] == added(b64(ssh(b"none", b"none", b"", private=b"")))


def test_signed_tokens():
    good = [token(), token("ES256", 64, typ="JWT"), token("RS256", 256), token("custom", 20)]
    for t in good:
        assert added(f"Bearer {t}, and") == [("signed", t)]
    assert added(b64(token().encode())) == [("signed", b64(token().encode()))]
    for t in (token("none", 32), token("HS256", 31), token("RS256", 64), token()[:-30], "eyJ" + token(), token() + ".x", b64(b"[1,2,3,4,5,6,7,8]", True) + token()[10:], b64(b"[" * 90_000) + "." + token()):
        assert added(t) == []


def plainly(text):
    """The grammar as given, one match after another."""
    out = []
    for k, (kind, pattern) in enumerate({"assign": r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", "access": r"AKIA[A-Z0-9]+", "hex": r"[0-9a-f]+"}.items()):
        for m in re.finditer(pattern, text):
            if len(m[2] if k == 0 else m[0]) >= (8, 16, 32)[k]:
                out.append((m.start(), k, m.end(), kind))
    return ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in sorted(out))


def test_plain_spans_are_the_grammar(spark, make, odd):
    draw = random.Random(6)
    bits = ["password", "Passwd", "SECRET", "token", "api_key", "ApiKey", "ſecret", "toKen", '"', "'", " ", "  ", ":", "=", "abc12345", "short", "AKIA", "AKIAABCDEFGHIJKL", "0123456789abcdef" * 2, "f" * 31, "é", "\n", ".", RSA.hex(), token()]
    texts = [*odd, *("".join(draw.choices(bits, k=draw.randrange(1, 12))) for _ in range(400)), "token = " + "x" * 200_000 + " " + "deadbeef" * 30_000]
    got = secrets.digest(secrets.secret_spans(make(texts))).orderBy("doc_id").collect()
    assert len(got) == len(texts)
    for text, row in zip(texts, got, strict=True):
        want = plainly(text or "")
        assert row["base_sha256"] == hashlib.sha256(want.encode()).hexdigest(), text
        assert [row[f"n_{k}"] for k in secrets.BASE] == [want.count(f"{k}:") for k in secrets.BASE]
        assert set(filter(None, want.split(","))) <= set(row["spans"].split(","))


def test_no_rows_and_repeated_ones(make):
    assert secrets.secret_spans(make([])).collect() == []
    got = secrets.secret_spans(make([b64(EC)] * 3 + [None], ids=[1, 1, None, 2])).collect()
    assert sorted(len(r["spans"]) for r in got) == [0, 1, 1, 1]
