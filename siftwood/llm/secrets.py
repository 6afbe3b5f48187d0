"""Secrets: patterns, and candidates confirmed by the structure they decode to.

Three patterns give the base spans, which always stay. The method adds spans of
its own kinds. Runs of base64 or hexadecimal digits, base64 also over line
breaks, are decoded and reported only if the bytes parse as what they claim:

- ``private_key``: a DER key (PKCS#1, PKCS#8 plain or encrypted, SEC 1, DSA or a
  PKCS#12 store) whose nested lengths all add up, or an OpenSSH key whose strings
  do; also inside a base64-encoded PEM text, up to DEPTH encodings deep. A key
  between PEM marks is reported with them.
- ``signed_token``: three base64url parts whose first is a JSON object naming a
  signature algorithm, whose second is a JSON object and whose third is as long
  as that algorithm's signatures; unsigned tokens are no secrets.
- ``sealed_token``: five parts, a JSON header naming key management and content
  encryption, and a nonce and tag of the lengths that encryption needs.
- ``caveat_token``: a macaroon, packets that each state their length in four
  hexadecimal digits and end with a signature of 32 bytes.

A run is decoded once per alignment and only read where a known first byte
pattern stands, so long runs cost linear time. Texts are read whole, each row by
itself: null and empty texts hold no secrets, repeated rows and ids and rows
without an id each give a row, other columns of the table are not looked at.
Offsets are code points, ends exclusive. Spans may overlap those of other kinds;
of one kind they don't.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwood.llm.frames import whole_text

# Kinds in the order in which spans of one start are listed; the first three are the base.
KINDS = ["assign", "access", "hex", "private_key", "signed_token", "sealed_token", "caveat_token"]
BASE = {
    "assign": re.compile(r"""(?ia)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Z0-9+/_.=-]+)"""),
    "access": re.compile(r"AKIA[A-Z0-9]{12,}"),
    "hex": re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}"),
}
LEAST_VALUE = 8

# Digits in lines of one run, and what stands between the lines: breaks, also as
# escapes, and indentation.
_RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{40,}={0,2}(?:(?:\r?\n|\\r\\n|\\n)[\x20\t]*[A-Za-z0-9+/_-]{4,}={0,2})*")
_BREAK = re.compile(r"\r?\n[\x20\t]*|\\r\\n[\x20\t]*|\\n[\x20\t]*|=")
_HEX_RUN = re.compile(r"(?<![0-9a-fA-F])[0-9a-fA-F]{64,}")
_TOKEN = re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]*){2,4}")
_PEM_OPEN = re.compile(r"-----BEGIN ([A-Z0-9 ]{0,40}?)PRIVATE KEY-----(?:\\r|\\n|\s)*$")
_PEM_CLOSE = re.compile(r"(?:\\r|\\n|\s)*-----END [A-Z0-9 ]{0,40}PRIVATE KEY-----")
_MARK = 120  # code points that a PEM mark and the blanks beside it may take
DEPTH = 3

# Base64 and hexadecimal digits that the structures begin with: a DER sequence by
# the form of its length, an OpenSSH key, a PEM mark, plain or encoded itself, and
# (in base64 as the first) a packet's length.
_STARTS64 = re.compile(r"M[C-I]|b3BlbnNzaC1rZXkt|LS0tLS1CRUdJTi|TFMwdExTMUNSVWRK")
_STARTS16 = re.compile(r"(?i)30(?:8[123]|[2-7][0-9a-f])|6f70656e7373682d6b65792d|2d2d2d2d2d424547494e|4c5330744c5331435255|30303[0-9a-f]")

# Signature lengths in bytes by algorithm (RSA: by its key's
# size), and nonce and tag lengths by content encryption.
SIGNATURES = {"HS256": (32, 32), "HS384": (48, 48), "HS512": (64, 64), "ES256": (64, 64), "ES256K": (64, 64)}
SIGNATURES |= {"ES384": (96, 96), "ES512": (132, 132), "EdDSA": (64, 114)}
SIGNATURES |= {name: (128, 1024) for name in ["RS256", "RS384", "RS512", "PS256", "PS384", "PS512"]}
SEALS = {"A128GCM": (12, 16), "A192GCM": (12, 16), "A256GCM": (12, 16)}
SEALS |= {"A128CBC-HS256": (16, 16), "A192CBC-HS384": (16, 24), "A256CBC-HS512": (16, 32)}

INTEGER, BITS, OCTETS, NULL, NAME, SEQUENCE, TAGGED = 2, 3, 4, 5, 6, 0x30, 0xA0


# --- nested lengths --------------------------------------------------------------


def element(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """Tag, start and end of the contents of the DER element at ``at``; None if
    its length is not in the shortest form or passes ``end``."""
    if at + 2 > end:
        return None
    tag, size, at = data[at], data[at + 1], at + 2
    if size >= 0x80:
        width = size - 0x80
        if not 1 <= width <= 4 or at + width > end:
            return None
        size = int.from_bytes(data[at : at + width], "big")
        at += width
        if size < 0x80 or size >> (8 * (width - 1)) == 0:
            return None
    return (tag, at, at + size) if at + size <= end else None


def elements(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """All elements from ``at`` that fill the space to ``end`` exactly."""
    found = []
    while at < end:
        one = element(data, at, end)
        if one is None or len(found) > 16:
            return None
        found.append(one)
        at = one[2]
    return found


def _number(data: bytes, one: tuple[int, int, int]) -> int:
    return int.from_bytes(data[one[1] : min(one[2], one[1] + 8)], "big") if one[2] - one[1] <= 8 else -1


def _named_algorithm(data: bytes, one: tuple[int, int, int]) -> bool:
    inside = elements(data, one[1], one[2]) if one[0] == SEQUENCE else None
    return bool(inside) and inside[0][0] == NAME and 3 <= inside[0][2] - inside[0][1] <= 32


def der_key(data: bytes, at: int) -> int | None:
    """Where the private key that starts at ``at`` ends; None if none does."""
    outer = element(data, at, len(data))
    if outer is None or outer[0] != SEQUENCE or outer[2] - outer[1] < 32:
        return None
    parts = elements(data, outer[1], outer[2])
    if not parts:
        return None
    tags = [tag for tag, _, _ in parts]
    size = lambda i: parts[i][2] - parts[i][1]
    version = _number(data, parts[0]) if tags[0] == INTEGER else -1
    if tags in ([INTEGER] * 9, [INTEGER] * 9 + [SEQUENCE]) and version in (0, 1):
        # PKCS#1: modulus, exponents and two primes of half the modulus' length.
        good = size(1) >= 32 and abs(size(4) + size(5) - size(1)) <= 4 and size(2) <= 9 and size(3) <= size(1) + 1
    elif tags == [INTEGER] * 6 and version == 0:
        # DSA: prime, order, generator, public and private number.
        good = size(1) >= 64 and 20 <= size(2) <= 33 and size(3) <= size(1) + 1 and size(5) <= size(2) + 1
    elif tags[:3] == [INTEGER, SEQUENCE, OCTETS] and version in (0, 1) and all(t & 0xE0 in (0x80, TAGGED) for t in tags[3:]):
        good = _named_algorithm(data, parts[1]) and size(2) >= 16 and _held_key(data, parts[2])
    elif tags[:2] == [INTEGER, OCTETS] and version == 1 and tags[2:] and all(t in (0xA0, 0xA1) for t in tags[2:]):
        good = 16 <= size(1) <= 72  # SEC 1: the number, the curve, the point
        for part in parts[2:]:
            inner = elements(data, part[1], part[2])
            good = good and bool(inner) and inner[0][0] == (NAME if part[0] == 0xA0 else BITS)
    elif tags == [SEQUENCE, OCTETS]:
        # PKCS#8 under a password: whole cipher blocks, and a scheme with its settings.
        scheme = elements(data, parts[0][1], parts[0][2])
        good = _named_algorithm(data, parts[0]) and len(scheme) == 2 and scheme[1][0] == SEQUENCE and size(1) >= 32 and size(1) % 8 == 0
    elif tags in ([INTEGER, SEQUENCE], [INTEGER, SEQUENCE, SEQUENCE]) and version == 3:
        # PKCS#12: contents, and the digest that guards them.
        inner = elements(data, parts[1][1], parts[1][2])
        good = bool(inner) and [t for t, _, _ in inner] == [NAME, TAGGED]
    else:
        good = False
    return outer[2] if good else None


def _held_key(data: bytes, held: tuple[int, int, int]) -> bool:
    """The key inside PKCS#8 is DER itself: a sequence, a number or a short string."""
    inner = element(data, held[1], held[2])
    return inner is not None and inner[2] == held[2] and inner[0] in (SEQUENCE, INTEGER, OCTETS)


def openssh_key(data: bytes, at: int) -> int | None:
    """As ``der_key``, for the OpenSSH form: strings after their 32-bit lengths."""
    magic = b"openssh-key-v1\0"
    if data[at : at + len(magic)] != magic:
        return None
    at += len(magic)

    def string(at: int) -> tuple[int, int]:
        """Start and end of a string's bytes; the end passes the data if it is cut off."""
        return at + 4, at + 4 + int.from_bytes(data[at : at + 4], "big")

    for _ in range(3):  # cipher, key derivation and its settings
        start, at = string(at)
        if at - start > 1024 or at + 4 > len(data):
            return None
    keys, at = int.from_bytes(data[at : at + 4], "big"), at + 4
    if not 1 <= keys <= 16:
        return None
    for _ in range(keys):  # public keys: a named type first
        start, at = string(at)
        if at + 4 > len(data) or string(start)[1] > at:
            return None
    start, at = string(at)
    return at if at <= len(data) and at - start >= 64 and (at - start) % 8 == 0 else None


def macaroon(data: bytes, at: int) -> int | None:
    """As ``der_key``, for packets "0011key value"; the last one is the signature."""
    names: list[bytes] = []
    while re.fullmatch(rb"[0-9a-f]{4}", data[at : at + 4]):
        size = int(data[at : at + 4], 16)
        packet = data[at + 4 : at + size]
        if size < 8 or len(packet) != size - 4 or packet[-1:] != b"\n":
            return None
        at += size
        names.append(packet.split(b" ", 1)[0])
        if names[-1] == b"signature":
            known = names[:2] == [b"location", b"identifier"] and set(names[2:-1]) <= {b"cid", b"vid", b"cl"}
            return at if known and len(packet) == len(b"signature ") + 32 + 1 else None
    return None


# --- runs of digits --------------------------------------------------------------


def _url_decode(part: str) -> bytes | None:
    """Bytes of unpadded base64url; None if the digits can't be some."""
    if len(part) % 4 == 1:
        return None
    return base64.urlsafe_b64decode(part + "=" * (-len(part) % 4))


def _json_object(part: str) -> dict | None:
    data = _url_decode(part)
    try:
        found = json.loads(data) if data else None
    except (ValueError, RecursionError):
        return None
    return found if isinstance(found, dict) else None


def token(text: str) -> tuple[str, int] | None:
    """What a dotted token is, by its header and the lengths of its parts, and where it ends."""
    parts = text.split(".")
    header = _json_object(parts[0])
    if header is None:
        return None
    algorithm, seal = header.get("alg"), header.get("enc")
    if len(parts) == 5 and isinstance(algorithm, str) and isinstance(seal, str) and seal in SEALS:
        decoded = [_url_decode(p) for p in parts[1:]]
        if None not in decoded and (len(decoded[1]), len(decoded[3])) == SEALS[seal] and decoded[2]:
            return "sealed_token", len(text)
    if isinstance(algorithm, str) and algorithm in SIGNATURES and _json_object(parts[1]) is not None:
        low, high = SIGNATURES[algorithm]
        signature = _url_decode(parts[2])
        if signature is not None and low <= len(signature) <= high:
            return "signed_token", len(".".join(parts[:3]))
    return None


class _Digits:
    """A run's digits, decoded once per alignment."""

    def __init__(self, digits: str, bits: int):
        self.digits = digits
        self.per, self.bytes = (4, 3) if bits == 6 else (2, 1)
        self.decoded: dict[int, bytes] = {}
        self.keys: dict[int, dict[int, int]] = {}

    def at(self, i: int) -> tuple[bytes, int]:
        """The bytes of the alignment of digit ``i``, and that digit's place in them."""
        shift = i % self.per
        if shift not in self.decoded:
            part = self.digits[shift:]
            if self.per == 2:
                part = part[: len(part) // 2 * 2]
                self.decoded[shift] = binascii.unhexlify(part)
            else:
                part = part[: len(part) - (len(part) % 4 == 1)].replace("-", "+").replace("_", "/")
                self.decoded[shift] = base64.b64decode(part + "=" * (-len(part) % 4))
        return self.decoded[shift], (i - shift) // self.per * self.bytes

    def marked(self, shift: int, depth: int) -> dict[int, int]:
        """Start and end of the keys in the text that an alignment decodes to."""
        if shift not in self.keys:
            inner = confirmed_spans(self.decoded[shift].decode("latin-1"), depth)
            self.keys[shift] = {start: end for start, kind, end in inner if kind == "private_key"}
        return self.keys[shift]

    def after(self, i: int, n_bytes: int) -> int:
        """The place after the digits that hold ``n_bytes`` from digit ``i``."""
        return i + (n_bytes * self.per + self.bytes - 1) // self.bytes


_READERS = {
    b"0": [("private_key", der_key), ("caveat_token", macaroon)],
    b"o": [("private_key", openssh_key)],
}


def _confirmed(run: _Digits, i: int, depth: int) -> tuple[str, int] | None:
    """Kind and end, in digits, of the structure that starts at digit ``i``."""
    data, at = run.at(i)
    for kind, reader in _READERS.get(data[at : at + 1], []):
        if (end := reader(data, at)) is not None:
            return kind, run.after(i, end - at)
    if depth > 1 and data[at : at + 1] in (b"-", b"L"):
        end = run.marked(i % run.per, depth - 1).get(at)
        return None if end is None else ("private_key", run.after(i, end - at))
    return None


def _runs(text: str) -> Iterator[tuple[int, _Digits, list[int] | None, re.Pattern]]:
    """Start, digits, places of the digits in the text (None: one after another)
    and first digits to look for, of every run."""
    for m in _RUN.finditer(text):
        whole = m[0]
        if _BREAK.search(whole):
            places, parts, at = [], [], 0
            for gap in [*_BREAK.finditer(whole), None]:
                end = gap.start() if gap else len(whole)
                parts.append(whole[at:end])
                places.extend(range(m.start() + at, m.start() + end))
                at = gap.end() if gap else end
            yield m.start(), _Digits("".join(parts), 6), places, _STARTS64
        else:
            yield m.start(), _Digits(whole, 6), None, _STARTS64
    for m in _HEX_RUN.finditer(text):
        yield m.start(), _Digits(m[0], 4), None, _STARTS16


def confirmed_spans(text: str, depth: int = DEPTH) -> list[tuple[int, str, int]]:
    """(start, kind, end) of what the structure confirms, in order."""
    found: list[tuple[int, str, int]] = []
    if "eyJ" in text:
        for m in _TOKEN.finditer(text):
            if one := token(m[0]):
                found.append((m.start(), one[0], m.start() + one[1]))
    for base, run, places, starts in _runs(text):
        at = 0
        while m := starts.search(run.digits, at):
            at = m.start() + 1
            if one := _confirmed(run, m.start(), depth):
                kind, end = one
                first, last = (base + m.start(), base + end - 1) if places is None else (places[m.start()], places[min(end, len(places)) - 1])
                found.append(_with_marks(text, first, kind, last + 1))
                at = end
    found.sort(key=lambda s: (s[0], KINDS.index(s[1]), -s[2]))
    kept, ends = [], dict.fromkeys(KINDS, 0)
    for start, kind, end in found:  # a run may be read as base64 and as hexadecimal
        if start >= ends[kind]:
            kept.append((start, kind, end))
            ends[kind] = end
    return kept


def _with_marks(text: str, start: int, kind: str, end: int) -> tuple[int, str, int]:
    """The span with its padding, and with the PEM marks around it if there are."""
    while text[end : end + 1] == "=":
        end += 1
    if kind == "private_key":
        before = _PEM_OPEN.search(text[max(0, start - _MARK) : start])
        after = _PEM_CLOSE.match(text[end : end + _MARK])
        if before and after:
            return start - (min(start, _MARK) - before.start()), kind, end + after.end()
    return start, kind, end


# --- documents -------------------------------------------------------------------


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the base patterns, in order."""
    found = [(m.start(), "assign", m.end()) for m in BASE["assign"].finditer(text) if len(m[1]) >= LEAST_VALUE]
    for kind in ("access", "hex"):
        found += [(m.start(), kind, m.end()) for m in BASE[kind].finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[1])))


def find(text: str | None) -> tuple[list[tuple[int, str, int]], list[tuple[int, str, int]]]:
    """Base spans of a text, and all of its spans in order; null holds none."""
    if not text:
        return [], []
    base = base_spans(text)
    every = base + confirmed_spans(text)
    return base, sorted(every, key=lambda s: (s[0], KINDS.index(s[1])))


def listed(spans: list[tuple[int, str, int]]) -> str:
    """Spans as kind:start:end, comma-joined."""
    return ",".join(f"{kind}:{start}:{end}" for start, kind, end in spans)


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for text in batch["text"]:
            base, every = find(text)
            rows.append(([s[0] for s in every], [s[1] for s in every], [s[2] for s in every], listed(base), len(base)))
        out = pd.DataFrame(rows, columns=["starts", "kinds", "ends", "base", "n_base"])
        yield out.assign(doc_id=batch["doc_id"].array)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, base (listed) and spans, an array of (start, kind, end), of every document."""
    rows = whole_text(docs, "doc_id").mapInPandas(
        _scan, "doc_id bigint, starts array<int>, kinds array<string>, ends array<int>, base string, n_base int"
    )
    spans = F.transform(
        F.arrays_zip("starts", "kinds", "ends"),
        lambda s: F.struct(s["starts"].alias("start"), s["kinds"].alias("kind"), s["ends"].alias("end")),
    )
    return rows.select("doc_id", "base", spans.alias("spans"))


def digest(docs: DataFrame) -> DataFrame:
    """Counts, the hash of the base spans and all spans of each document."""
    of_kind = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")
    text = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return scan(docs).select(
        "doc_id",
        *[of_kind(k).alias(f"n_{k}") for k in BASE],
        F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"),
        text.alias("spans"),
    )

