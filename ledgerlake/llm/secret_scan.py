"""Secret scans: candidate patterns, and structural confirmation of encoded ones.

Base kinds (assigned values, access key ids, long hexadecimal runs) are reported as matched. Long base64 and hexadecimal runs
are reported as further kinds only when their decoded bytes parse: ``der`` is a private key as nested, exactly fitting
DER lengths, ``openssh`` a private key in OpenSSH's own format, ``jwt`` a signed token whose header is JSON with an
algorithm, ``armour`` an encrypted body between PEM lines whose headers say so. Key bodies are taken with what they are
wrapped in: line breaks of any width, escaped breaks (``\\n`` written out, as in JSON and environment files), header lines
behind the BEGIN line, the URL alphabet, hexadecimal with a digit too many. A DER key says in its first bytes how long it is, and
so many digits are taken from there on. Each text is scanned whole, in Arrow batches in the tasks; nothing is shuffled.

Defined cases: a null text is empty and has no spans; repeated rows are scanned alike; an empty table gives an empty one;
columns of the input named like a result are replaced by it."""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

#: The base kinds, in the order in which ties are listed.
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_either = lambda word: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)
ASSIGN = re.compile("(" + "|".join(map(_either, ("password", "passwd", "secret", "token"))) + "|" + _either("api") + "_?" + _either("key") + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")

#: Candidates of the structural kinds.
BEGIN = re.compile(r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----")
HEADER = re.compile(r"^[A-Za-z][A-Za-z0-9-]*: .*$", re.MULTILINE)
DIGITS = re.compile(r"[A-Za-z0-9+/]+={0,2}")
LONG = re.compile(r"[A-Za-z0-9+/]{40,}={0,2}")
LONG_URL = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{40,}={0,2}")
LONG_HEX = re.compile(r"[0-9A-Fa-f]{64,}")
JWT = re.compile(r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+")
#: A line break inside a wrapped body, written as it is or escaped, with the indentation around it.
BREAK = re.compile(r"[ \t]*(?:\\r)?(?:\\n|\r?\n|\r)[ \t]*")
#: Digits of the longest key body that is looked for (an RSA key of 65,536 bits has some 50,000).
MOST_DIGITS = 1 << 17
KINDS = ("assign", "access", "hex", "der", "openssh", "jwt", "armour")
_ORDER = {k: i for i, k in enumerate(KINDS)}

#: Identifiers of password-based encryption, PKCS #5 and PKCS #12.
ENCRYPTIONS = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))


def element(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """Tag, first and end byte of the content of one DER element, or None where lengths do not fit."""
    if at + 2 > end:
        return None
    tag, size, at = data[at], data[at + 1], at + 2
    if size & 0x80:
        n = size & 0x7F
        if not 1 <= n <= 4 or at + n > end or data[at] == 0:
            return None
        size, at = int.from_bytes(data[at : at + n], "big"), at + n
        if size < 0x80:
            return None
    return (tag, at, at + size) if at + size <= end else None


def children(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """The elements that fill a span exactly."""
    found = []
    while at < end:
        one = element(data, at, end)
        if one is None:
            return None
        found.append(one)
        at = one[2]
    return found


def is_der_key(data: bytes) -> bool:
    """A sequence over all bytes that holds a version and then the numbers of an RSA or DSA key, an EC key's octets, or an
    algorithm and an octet string (a wrapped key); or, without a version, an encryption and an octet string."""
    whole = element(data, 0, len(data))
    if whole is None or whole[0] != 0x30 or whole[2] != len(data):
        return False
    parts = children(data, whole[1], whole[2])
    if not parts or len(parts) < 2:
        return False
    tags, size = [p[0] for p in parts], lambda p: p[2] - p[1]
    if tags == [0x30, 0x04]:
        inner = children(data, parts[0][1], parts[0][2])
        return bool(inner) and inner[0][0] == 0x06 and data[inner[0][1] : inner[0][2]].startswith(ENCRYPTIONS) and size(parts[1]) >= 16
    if tags[0] != 0x02 or size(parts[0]) != 1 or data[parts[0][1]] > 3:
        return False
    if tags[1] == 0x04:  # an EC key; curve and public key may be left out
        return 16 <= size(parts[1]) <= 72 and data[parts[0][1]] == 1 and all(t & 0xE0 == 0xA0 for t in tags[2:])
    if tags[1] == 0x30 and len(tags) > 2 and tags[2] == 0x04:
        inner = children(data, parts[1][1], parts[1][2])
        return bool(inner) and inner[0][0] == 0x06 and size(parts[2]) >= 16
    return len(parts) >= 6 and all(t == 0x02 for t in tags)


def is_openssh_key(data: bytes) -> bool:
    """The format's magic, then four length-prefixed fields with a key count between the third and the fourth."""
    magic = b"openssh-key-v1\0"
    if not data.startswith(magic):
        return False
    at = len(magic)
    for k in range(4):
        if at + 4 > len(data):
            return False
        at += 4 + int.from_bytes(data[at : at + 4], "big")
        if k == 2:
            at += 4
    return at <= len(data)


def _decoded(text: str) -> bytes:
    text = "".join(text.split()).rstrip("=")
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True) if len(text) % 4 != 1 else b""
    except (ValueError, binascii.Error):
        return b""


def key_kind(data: bytes) -> str | None:
    return "der" if is_der_key(data) else "openssh" if is_openssh_key(data) else None


def der_size(head: bytes) -> int | None:
    """How many bytes the sequence that begins here takes up, or None where none begins."""
    if len(head) < 6 or head[0] != 0x30:
        return None
    n = head[1] & 0x7F if head[1] & 0x80 else 0
    if n > 4 or (head[1] & 0x80 and (n == 0 or head[2] == 0)):
        return None
    return 2 + n + (int.from_bytes(head[2 : 2 + n], "big") if n else head[1])


def wrapped(text: str, at: int, digits: int | None = None) -> tuple[str, int]:
    """The digits from a place on, over line breaks, and where they end: as many as asked for, or else those of all lines as
    wide as the first and of one shorter line."""
    out, taken, width = [], 0, 0
    while m := DIGITS.match(text, at):
        piece = m[0] if digits is None else m[0][: digits - taken]
        if digits is None and out and len(piece) > width:
            break
        out.append(piece)
        taken, at = taken + len(piece), m.start() + len(piece)
        if taken == digits or taken > MOST_DIGITS or piece.endswith("=") or (digits is None and width and len(piece) < width):
            break
        width = width or len(piece)
        if not (gap := BREAK.match(text, at)) or not DIGITS.match(text, gap.end()):
            break
        at = gap.end()
    return "".join(out), at


def encoded_key(text: str, at: int) -> tuple[int, str] | None:
    """Where the key encoded from a place on ends, and its kind."""
    size = der_size(_decoded(text[at : at + 12]))
    if size is not None and size * 4 <= MOST_DIGITS * 3:
        body, end = wrapped(text, at, -(-size // 3) * 4)
        if key_kind(_decoded(body)):
            return end, "der"
    elif text.startswith("b3BlbnNzaC1rZXktdjEA", at):
        body, end = wrapped(text, at)
        if is_openssh_key(_decoded(body)):
            return end, "openssh"
    return None


def armoured(text: str) -> Iterator[tuple[int, int, str]]:
    """Bodies between PEM lines. A body that its headers call encrypted is told by them and by whole cipher blocks."""
    begins = list(BEGIN.finditer(text))
    for k, m in enumerate(begins):
        close = f"-----END {m[1]}-----"
        end = text.find(close, m.end(), begins[k + 1].start() if k + 1 < len(begins) else len(text))
        if end < 0:
            continue
        body = re.sub(r"(?:\\r)?\\n|\\r", "\n", text[m.end() : end])
        data = _decoded(HEADER.sub("", body))
        kind = key_kind(data) or ("armour" if "ENCRYPTED" in body and len(data) >= 32 and len(data) % 8 == 0 else None)
        if kind:
            yield m.start(), end + len(close), kind


def is_signed_token(text: str) -> bool:
    header, payload, _ = text.split(".")
    try:
        parts = [json.loads(base64.urlsafe_b64decode(x + "=" * (-len(x) % 4))) for x in (header, payload)]
    except (ValueError, binascii.Error):
        return False
    return all(isinstance(x, dict) for x in parts) and isinstance(parts[0].get("alg"), str)


_PLAIN = str.maketrans("-_", "+/")


def scan(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all spans in code points, by start and then by the order of kinds."""
    found = []
    low = text.lower() if len(text) < 64 or not text.islower() else text
    if any(w in low for w in ("passw", "secret", "token", "api")):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    extra = set(armoured(text)) if "-----BEGIN" in text else set()
    done = 0
    inside = sorted((a, b) for a, b, _ in extra)
    for m in LONG.finditer(text):
        start = m.start() + (1 if text[m.start() - 1 : m.start() + 1] == "\\n" and m.start() else 0)  # the n of an escaped break
        if start < done or any(a <= start < b for a, b in inside):
            continue
        if one := encoded_key(text, start):
            extra.add((start, one[0], one[1]))
            done = one[0]
    for m in LONG_URL.finditer(text):
        if ("-" in m[0] or "_" in m[0]) and (size := der_size(_decoded(m[0][:12].translate(_PLAIN)))) is not None:
            body = m[0][: -(-size * 4 // 3)]
            if not any(a <= m.start() < b for a, b in inside) and is_der_key(_decoded(body.translate(_PLAIN))):
                extra.add((m.start(), m.start() + len(body), "der"))
    for m in LONG_HEX.finditer(text):
        for skip in (0, 1):  # a digit too many may stand on either side
            size = der_size(bytes.fromhex(m[0][skip : skip + 12]))
            if size is not None and skip + 2 * size <= len(m[0]) and is_der_key(bytes.fromhex(m[0][skip : skip + 2 * size])):
                extra.add((m.start() + skip, m.start() + skip + 2 * size, "der"))
                break
    if "eyJ" in text:
        extra |= {(m.start(), m.end(), "jwt") for m in JWT.finditer(text) if is_signed_token(m[0])}
    return sorted([*found, *extra], key=lambda s: (s[0], _ORDER[s[2]], s[1]))


def scanned(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The key and ``found``, the spans of each row as an array of (start, end, kind)."""
    kind = next(f for f in docs.schema.fields if f.name == key).dataType.simpleString()
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1):
                rows = [[{"start": a, "end": b, "kind": k} for a, b, k in scan(t or "")] for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, spans)], ["key", "found"])

    return docs.select(F.col(key).alias("key"), text).mapInArrow(run, f"key {kind}, found array<struct<start:bigint,end:bigint,kind:string>>").withColumnRenamed("key", key)


def listed(found, kinds=KINDS):
    """Spans as ``kind:start:end``, comma-joined, as a column expression."""
    wanted = F.filter(found, lambda s: s["kind"].isin(list(kinds)))
    return F.array_join(F.transform(wanted, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redacted(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows with all columns, each secret in the text replaced by its kind in brackets. Of overlapping spans the
    union is replaced under the first one's kind. A text without secrets, also a null one, stays as it is."""
    schema, at = docs.schema, docs.columns.index(text)

    def clean(value: str | None) -> str | None:
        if not value or not (found := scan(value)):
            return value
        out, last, k = [], 0, 0
        while k < len(found):
            start, end, kind = found[k]
            while k + 1 < len(found) and found[k + 1][0] < end:
                k, end = k + 1, max(end, found[k + 1][1])
            out += [value[last:start], f"[{kind}]"]
            last, k = end, k + 1
        return "".join([*out, value[last:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, at):
                texts = pa.array([clean(t) for t in batch.column(at).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([texts if i == at else c for i, c in enumerate(batch.columns)], batch.schema.names)

    return docs.mapInArrow(run, schema)


