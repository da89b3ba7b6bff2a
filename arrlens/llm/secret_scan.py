"""Secret scan with structural confirmation.

Base kinds (assign, access, hex) are plain patterns. On top of them, every run
of base64, base64url (also over wrapped lines) or hex is decoded and parsed
before it is reported: signed-token headers (jwt), PEM bodies (pem), DER private
keys (der) and length-prefixed SSH blobs (ssh), each also one level deeper, as
in base64 of a PEM. Public keys and certificates parse too, but their structure
tells them from private keys and they are no secrets. A candidate that does not
parse is not reported; base spans always stay.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import id_and_text, table

# Kinds in the order in which spans with one start are listed.
KINDS = ("assign", "access", "hex", "jwt", "pem", "der", "ssh")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
# Encoded candidates start a run, or follow a line end written as \n or \r.
JWT = re.compile(r"e(?:(?<![A-Za-z0-9_-]e)|(?<=\\[nr]e))[A-Za-z0-9_-]{9,}\.[A-Za-z0-9_-]{2,}\.[A-Za-z0-9_-]*")
PEM_MARK = re.compile(r"-----(BEGIN|END) ([A-Z0-9 ]{1,40})(?=-----)")
BASE64_DER = re.compile(r"M(?:(?<![A-Za-z0-9+/]M)|(?<=\\[nr]M))[A-Za-z0-9+/]{30,}={0,2}")
SSH = re.compile(r"(?:(?<![A-Za-z0-9+/])|(?<=\\[nr]))(?:AAAA|b3BlbnNzaC1rZXktdjE)[A-Za-z0-9+/]{20,}={0,2}")
RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{32,}={0,2}")
WRAP = re.compile(r"(?:\r\n|[\r\n]|(?:\\+r)?\\+n|\\+r)(?:[ \t>|]*)")
LINE = re.compile(r"[A-Za-z0-9+/_-]+={0,2}")
HEX_RUN = re.compile(r"(?<![0-9A-Za-z])[0-9A-Fa-f]{48,}(?![0-9A-Za-z])")
PUBLIC_LINE = re.compile(r"(?:ssh|ecdsa|sk)-[a-z0-9@.-]{2,60}[ \t]+\Z")
QUOTED = re.compile(r"^[ \t>|]+")
# JSON escapes of the characters that an armoured body holds
ESCAPED = re.compile(r"\\+(?:([nr])|(/)|u00(0[adAD]|2[bBfF]|3[aAdD]))")
MAGIC = b"openssh-key-v1\0"


def _decode64(s: str) -> bytes | None:
    s = s.rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(s + "=" * (-len(s) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _elements(data: bytes, lo: int, hi: int) -> list[tuple[int, int, int]] | None:
    """(tag, start, end) of the DER elements that fill data[lo:hi] exactly."""
    out = []
    while lo < hi:
        if hi - lo < 2:
            return None
        tag, n, p = data[lo], data[lo + 1], lo + 2
        if n & 0x80:
            width = n & 0x7F
            if not 1 <= width <= 4 or p + width > hi or data[p] == 0:
                return None
            n, p = int.from_bytes(data[p:p + width], "big"), p + width
        if p + n > hi:
            return None
        out.append((tag, p, p + n))
        lo = p + n
    return out


def der_is_whole(data: bytes) -> bool:
    """A SEQUENCE that fills ``data`` exactly, whose elements' nested lengths add up."""
    todo = _elements(data, 0, len(data))
    if not todo or len(todo) != 1 or todo[0][0] != 0x30 or todo[0][2] - todo[0][1] < 6:
        return False
    leaves = 0
    while todo:
        tag, lo, hi = todo.pop()
        if tag & 0x20:  # constructed
            inner = _elements(data, lo, hi)
            if inner is None:
                return False
            todo += inner
        elif tag & 0x1F in (0, 0x1F):
            return False
        else:
            leaves += 1
    return leaves >= 2


INTEGER, OCTETS, OID, SEQUENCE = 2, 4, 6, 0x30  # DER tags


def der_is_private(data: bytes) -> bool:
    """A whole DER structure of a private key. A small version number comes
    first, and then either integers only (RSA, DSA), an octet string (EC), an
    algorithm and an octet string (PKCS #8) or, with version 3, a PKCS #12
    bundle; or else an algorithm with parameters and an octet string (encrypted
    PKCS #8). Certificates, requests and public keys have none of these forms."""
    if len(data) < 2 or data[0] != SEQUENCE or not der_is_whole(data):
        return False
    (_, lo, hi), = _elements(data, 0, len(data))
    parts = _elements(data, lo, hi)
    tags = [t for t, _, _ in parts]

    def inner(i: int) -> list[int]:
        return [t for t, _, _ in _elements(data, *parts[i][1:])] if tags[i] == SEQUENCE else []

    if len(parts) == 2 and tags[1] == OCTETS:
        return inner(0) == [OID, SEQUENCE] or tags[0] == INTEGER and data[parts[0][1]:parts[0][2]] == b"\1"
    if tags[0] != INTEGER or parts[0][2] - parts[0][1] != 1 or len(parts) < 2:
        return False
    version = data[parts[0][1]]
    if version == 3:
        return inner(1)[:1] == [OID]
    if version > 1 or len(parts) < 3:
        return False
    return (set(tags) == {INTEGER} or tags[1] == OCTETS and tags[2] in (0xA0, 0xA1) or
            inner(1)[:1] == [OID] and tags[2] == OCTETS)


def ssh_is_whole(data: bytes) -> bool:
    """Length-prefixed strings that fill the blob, the first one a key type or
    the header of a private-key file."""
    lo = len(MAGIC) if data.startswith(MAGIC) else 0
    names, n = [], 0
    if lo:  # cipher, kdf, options, number of keys
        for _ in range(3):
            n = int.from_bytes(data[lo:lo + 4], "big")
            if lo + 4 + n > len(data):
                return False
            names.append(data[lo + 4:lo + 4 + n])
            lo += 4 + n
        return len(data) >= lo + 4 and names[0].isascii() and len(names[0]) > 0
    while lo < len(data):
        n = int.from_bytes(data[lo:lo + 4], "big")
        if lo + 4 + n > len(data) or len(data) - lo < 4:
            return False
        names.append(data[lo + 4:lo + 4 + n])
        lo += 4 + n
    return len(names) >= 2 and re.fullmatch(rb"(ssh|ecdsa|sk)-[a-z0-9@.-]{2,60}", names[0]) is not None


def jwt_is_signed_token(s: str) -> bool:
    head = _decode64(s.split(".", 1)[0])
    try:
        head = json.loads(head) if head else None
    except (ValueError, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(head.get("alg"), str)


def pem_bodies(text: str):
    """(start, end, label, body) from each END mark back to the nearest BEGIN
    mark, if both have one label. The body may hold hyphens; one linear scan."""
    begin = None
    for m in PEM_MARK.finditer(text):
        if m[1] == "BEGIN":
            begin = m
        elif begin and begin[2] == m[2]:
            yield begin.start(), m.end() + 5, m[2], text[begin.end() + 5:m.start()]
            begin = None


def _unescaped(body: str) -> str:
    return ESCAPED.sub(lambda m: "\n" if m[1] else m[2] or chr(int(m[3], 16)), body) if "\\" in body else body


def _pem_is_key(label: str, body: str) -> bool:
    body = _unescaped(body)
    # without encryption headers and marks of quotation
    lines = [QUOTED.sub("", x) for x in re.split(r"[\r\n]", body) if ":" not in x]
    data = _decode64("".join("".join(lines).split()))
    if not data:
        return False
    return (der_is_private(data) or data.startswith(MAGIC) and ssh_is_whole(data) or
            "ENCRYPTED" in label + body and len(data) >= 32)


def decoded_kind(data: bytes | None, deeper: bool = True) -> int | None:
    """The kind of secret that decoded bytes are, or that the text which they
    hold is or armours, one level deeper; None for anything else."""
    if not data:
        return None
    if der_is_private(data):
        return 5
    if data.startswith(MAGIC):
        return 6 if ssh_is_whole(data) else None
    if not deeper or not data.isascii():
        return None
    text = data.decode("ascii")
    if "-----BEGIN " in text and any(_pem_is_key(label, body) for _, _, label, body in pem_bodies(text)):
        return 4
    text = "".join(text.split())
    if JWT.fullmatch(text):
        return 3 if jwt_is_signed_token(text) else None
    if LINE.fullmatch(text):
        kind = decoded_kind(_decode64(text), False)
        return kind or (decoded_kind(bytes.fromhex(text), False) if HEX_RUN.fullmatch(text) and len(text) % 2 == 0 else None)
    return None


def encoded_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base64 or base64url runs that decode to a
    secret: lines of one width and a shorter last one as a whole, without that
    last one, or each by itself. Every line is read a fixed number of times."""
    out, at = [], 0
    while m := RUN.search(text, at):
        start = m.start()
        if start and text[start - 1] == "\\" and m[0][0] in "nr":  # the end of a JSON escape
            start += 1
        lines = [(start, m.end())]
        width = m.end() - start
        while text[lines[-1][1] - 1] != "=" and lines[-1][1] - lines[-1][0] == width:
            gap = WRAP.match(text, lines[-1][1])
            line = LINE.match(text, gap.end()) if gap else None
            if line is None or line.end() - line.start() > width:
                break
            lines.append(line.span())
        at = lines[-1][1]
        whole = range(len(lines), max(len(lines) - 2, 0), -1)
        for n in whole:
            kind = decoded_kind(_decode64("".join(text[a:b] for a, b in lines[:n])))
            if kind is not None:
                out.append((start, kind, lines[n - 1][1]))
                break
        else:
            if len(lines) > 1:
                for a, b in lines:
                    if b - a >= 32 and (kind := decoded_kind(_decode64(text[a:b]))) is not None:
                        out.append((a, kind, b))
    for m in HEX_RUN.finditer(text):
        if len(m[0]) % 2 == 0 and (kind := decoded_kind(bytes.fromhex(m[0]))) is not None:
            out.append((m.start(), kind, m.end()))
    return out


def find_spans(text: str | None) -> list[tuple[int, int, int]]:
    """Sorted (start, kind index, end), in code points, end exclusive."""
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    runs = [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    out += runs
    for start, _, end in runs:
        if text.startswith("30", start) and (end - start) % 2 == 0 and der_is_private(bytes.fromhex(text[start:end])):
            out.append((start, 5, end))
    out += [(m.start(), 3, m.end()) for m in JWT.finditer(text) if jwt_is_signed_token(m[0])] if "." in text else []
    inside = []
    if "-----BEGIN " in text:
        for start, end, label, body in pem_bodies(text):
            if _pem_is_key(label, body):
                out.append((start, 4, end))
                inside.append((start, end))
    found = []
    for pattern, kind, whole in ((BASE64_DER, 5, der_is_private), (SSH, 6, ssh_is_whole)):
        for m in pattern.finditer(text):
            if (data := _decode64(m[0])) and whole(data) and not (
                    kind == 6 and PUBLIC_LINE.search(text, max(0, m.start() - 72), m.start())):
                found.append((m.start(), kind, m.end()))
    found += encoded_spans(text)
    inside.sort()
    before = [a for a, _ in inside]
    for span in found:
        i = bisect_right(before, span[0]) - 1
        if i < 0 or span[0] >= inside[i][1]:
            out.append(span)
    return sorted(set(out))


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def redact(text: str | None) -> str | None:
    """Text with every span (overlapping ones merged) replaced by ``[SECRET]``."""
    spans = find_spans(text)
    if not spans:
        return text
    out, at, hidden = [], 0, -1
    for a, _, b in spans:
        if a >= hidden:
            out += [text[at:a], "[SECRET]"] if a >= at else ["[SECRET]"]
        hidden = at = max(hidden, b)
    return "".join(out) + text[at:]


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, n_confirmed long, base_sha256 string, spans string"


def _scan(batches):
    for batch in batches:
        rows = []
        for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
            spans = find_spans(text)
            base = [s for s in spans if s[1] < 3]
            n = [sum(s[1] == k for s in base) for k in range(3)]
            rows.append((doc_id, *n, len(spans) - len(base), hashlib.sha256(joined(base).encode()).hexdigest(),
                         joined(spans)))
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64()] * 5 + [pa.string()] * 2)] if rows else
            [pa.array([], t) for t in [pa.int64()] * 5 + [pa.string()] * 2],
            ["doc_id", "n_assign", "n_access", "n_hex", "n_confirmed", "base_sha256", "spans"])


def scan(docs: DataFrame) -> DataFrame:
    """One row per document row (repeated rows give repeated results, a null
    doc_id stays null, null text counts as empty and has no spans; an empty
    table gives no rows; other columns are ignored). Each text is read whole
    in one narrow pass: no shuffle, so hot sources do not matter."""
    return id_and_text(docs).mapInArrow(_scan, SCHEMA)


def _redact(batches):
    for batch in batches:
        texts = batch["text"].to_pylist()
        clean = [redact(t) for t in texts]
        i = batch.schema.get_field_index("text")
        batch = batch.set_column(i, batch.schema.field(i), pa.array(clean, batch.schema.field(i).type))
        i = batch.schema.get_field_index("n_chars")
        if i >= 0:
            old = batch.column(i).to_pylist()
            new = [n if a is b or a == b else len(b) for n, a, b in zip(old, texts, clean)]
            batch = batch.set_column(i, batch.schema.field(i), pa.array(new, batch.schema.field(i).type))
        yield batch


def redact_documents(docs: DataFrame) -> DataFrame:
    """All rows and columns of ``docs``; found secrets are replaced in ``text``
    and ``n_chars``, if there is such a column, is brought up to date. Rows
    without secrets, null texts included, come back unchanged."""
    return docs.mapInArrow(_redact, docs.schema)


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
