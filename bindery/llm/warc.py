"""Derivatives of WARC responses: linked metadata and plain-text conversion records.

Each response gives one metadata record (JSON with all source headers, the
HTTP headers, digests, title and links) and one conversion record (the page's
text). Both keep target URI and date, carry their own identifier and digests,
and refer to the response by WARC-Refers-To. Work is per record, so a scan is
all there is to it.
"""

from __future__ import annotations

import base64
import hashlib
import html
import json
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

_DROPPED = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|template|noscript|head)\b[^>]*>.*?(?:</\1\s*>|\Z)", re.S | re.I)
_BREAK = re.compile(r"</?(?:p|div|br|hr|li|ul|ol|tr|table|h[1-6]|article|section|header|footer|nav|aside|main|blockquote|pre|dl|dt|dd|form|title|body|html)\b[^>]*>", re.I)
_CELL = re.compile(r"</?t[dh]\b[^>]*>", re.I)
_TAG = re.compile(r"</?[a-zA-Z!?][^>]*>")
_BLANKS = re.compile(r"[^\S\n]+")
_TITLE, _TITLE_END = re.compile(r"<title\b[^>]*>", re.I), re.compile(r"</title\s*>", re.I)
# An open tag ends at the next < or >, so tags that are never closed are passed over once.
_LINK = re.compile(r"<(a|link|img|script|iframe)\b[^<>]*?\b(href|src)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HEX = re.compile(rb"[0-9A-Fa-f]+")
#: Responses that have no body, whatever their headers say.
_BODILESS = re.compile(r"HTTP/\S+\s+(?:1\d\d|204|304)\b")
_CHARSET = re.compile(r"charset\s*=\s*[\"']?([A-Za-z0-9_.:-]+)", re.I)

OUT = "kind string, record_id string, refers_to string, target_uri string, date string, block_digest string, payload_digest string, source_digests_ok boolean, error string, record binary"
#: Bytes of derived records that are handed on at once.
OUT_BYTES = 1 << 22
_NAMES = [x.split()[0] for x in OUT.split(", ")]


def _tagged(page: str) -> tuple[str, str]:
    """A page up to its last >, where every tag that is opened ends somewhere, and the rest."""
    at = page.rfind(">") + 1
    return page[:at], page[at:]


def _without_hidden(page: str) -> tuple[str, str]:
    """`_tagged` without comments, scripts and the like; what is left open hides all behind it."""
    head, tail = _tagged(page)
    parts, at, open_ = [], 0, False
    for m in _DROPPED.finditer(head):
        parts.append(head[at : m.start()])
        at = m.end()
        closed = rf"(?i)</{m[1]}\s*>\Z" if m[1] else r"-->\Z"
        open_ = at == len(head) and not re.search(closed, m.group())
    comment = tail.find("<!--")
    tail = "" if open_ else tail[:comment] if comment >= 0 else tail
    return "".join([*parts, head[at:]]), tail


def page_text(page: str) -> str:
    """Visible text, a line per block."""
    head, tail = _without_hidden(page)
    page = _TAG.sub("", _CELL.sub(" ", _BREAK.sub("\n", head))) + tail
    lines = (x.strip() for x in _BLANKS.sub(" ", html.unescape(page)).split("\n"))
    return "\n".join(x for x in lines if x)


def page_title(page: str) -> str | None:
    head, _ = _tagged(page)
    start = _TITLE.search(head)
    end = _TITLE_END.search(head, start.end()) if start else None
    return head[start.end() : end.start()] if end else None


def _headers(block: bytes) -> list[tuple[str, str]]:
    out: list[tuple[str, str]] = []
    for line in block.decode("utf-8", "replace").replace("\r\n", "\n").split("\n"):
        if line[:1] in (" ", "\t") and out:
            out[-1] = (out[-1][0], f"{out[-1][1]} {line.strip()}")
        elif ":" in line:
            name, _, value = line.partition(":")
            out.append((name.strip(), value.strip()))
    return out


def _split(raw: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """First line, headers and body of a message."""
    ends = [(raw.find(gap), len(gap)) for gap in (b"\r\n\r\n", b"\n\n")]
    at, size = min((x for x in ends if x[0] >= 0), default=(len(raw), 0))
    first, _, rest = raw[:at].partition(b"\n")
    return first.decode("utf-8", "replace").strip(), _headers(rest), raw[at + size :]


def _get(headers: list[tuple[str, str]], name: str) -> str | None:
    return next((v for k, v in headers if k.lower() == name.lower()), None)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _same(stated: str | None, data: bytes) -> bool:
    """No digest stated, or one that holds (base 32 or hexadecimal; algorithms not known here pass)."""
    algorithm, _, value = (stated or "").partition(":")
    if not value or algorithm.lower().replace("-", "") not in ("sha1", "sha256", "md5"):
        return True
    own = hashlib.new(algorithm.lower().replace("-", ""), data)
    return value.lower() == own.hexdigest() or value.rstrip("=").upper() == base64.b32encode(own.digest()).decode().rstrip("=")


def _codings(headers: list[tuple[str, str]], name: str) -> list[str]:
    """Encodings that a header lists, last applied first."""
    listed = ",".join(v for k, v in headers if k.lower() == name.lower()).lower().split(",")
    return [x for x in (y.strip() for y in reversed(listed)) if x not in ("", "identity")]


def _joined(body: bytes) -> bytes:
    """The chunks of a body; ValueError if one, or the last of size 0, is missing."""
    out, at = [], 0
    while (end := body.find(b"\n", at)) >= 0:
        size = body[at:end].split(b";")[0].strip()
        if not _HEX.fullmatch(size):
            raise ValueError("no chunk size")
        if not (n := int(size, 16)):
            return b"".join(out)
        out.append(body[end + 1 : end + 1 + n])
        at = end + 1 + n
        at += 2 if body[at : at + 2] == b"\r\n" else body[at : at + 1] == b"\n"
    raise ValueError("no last chunk")


def _inflated(coding: str, body: bytes) -> bytes:
    """All members of a compressed body; ValueError if the last one ends early. No bytes are an empty body."""
    out = []
    while body.strip(b"\0") or body and not out:
        member = zlib.decompressobj(47 if "gzip" in coding or body[:1] == b"\x78" else -15)
        out.append(member.decompress(body))
        if not member.eof:
            raise ValueError("compressed data end early")
        body = member.unused_data
    return b"".join(out)


def _entity(headers: list[tuple[str, str]], body: bytes) -> bytes:
    """The body without transfer and content encodings; ValueError or zlib.error if one can't be undone."""
    for coding in _codings(headers, "Transfer-Encoding") + _codings(headers, "Content-Encoding"):
        if coding == "chunked":
            body = _joined(body)
        elif coding in ("gzip", "x-gzip", "deflate"):
            body = _inflated(coding, body)
        else:
            raise ValueError(f"encoding {coding} is not known")
    return body


def _decode(headers: list[tuple[str, str]], body: bytes) -> str:
    named = _CHARSET.search(_get(headers, "Content-Type") or "") or _CHARSET.search(body[:2048].decode("latin-1"))
    try:
        return body.decode(named[1] if named else "utf-8", "replace")
    except LookupError:
        return body.decode("utf-8", "replace")


def _record(kind: str, source: list[tuple[str, str]], content_type: str, block: bytes) -> dict:
    refers = _get(source, "WARC-Record-ID") or ""
    ident = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{refers}#{kind}')}>"
    uri, date = _get(source, "WARC-Target-URI"), _get(source, "WARC-Date")
    lines = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: {ident}", f"WARC-Refers-To: {refers}"]
    lines += [f"{k}: {v}" for k, v in (("WARC-Target-URI", uri), ("WARC-Date", date)) if v is not None]
    lines += [f"WARC-Block-Digest: {digest(block)}", f"Content-Type: {content_type}", f"Content-Length: {len(block)}"]
    raw = "\r\n".join([*lines, "", ""]).encode() + block + b"\r\n\r\n"
    return {"kind": kind, "record_id": ident, "refers_to": refers, "target_uri": uri, "date": date, "block_digest": digest(block), "record": raw}


def derive_one(raw: bytes | None) -> list[dict]:
    """The metadata and conversion record of a response; an error row if it can't be read; nothing for other types."""
    version, source, rest = _split(raw or b"")
    if not version.startswith("WARC/"):
        return [{"kind": "error", "error": "no WARC record"}]
    if (_get(source, "WARC-Type") or "").lower() != "response":
        return []
    row = {"refers_to": _get(source, "WARC-Record-ID"), "target_uri": _get(source, "WARC-Target-URI"), "date": _get(source, "WARC-Date")}
    try:
        length = int(_get(source, "Content-Length") or "")
    except ValueError:
        return [row | {"kind": "error", "error": "no content length"}]
    block = rest[:length]
    if len(block) < length:
        return [row | {"kind": "error", "error": "block is cut off"}]
    if not row["refers_to"]:
        return [row | {"kind": "error", "error": "no record identifier"}]
    status, headers, body = _split(block)
    if not status.startswith("HTTP/"):
        return [row | {"kind": "error", "error": "no HTTP response"}]
    try:
        entity = body if not body and _BODILESS.match(status) else _entity(headers, body)
    except (ValueError, zlib.error):
        return [row | {"kind": "error", "error": "encoding of the body can't be undone"}]
    page = _decode(headers, entity)
    title = page_title(page)
    links = [{"path": f"{m[1].upper()}@/{m[2].lower()}", "url": html.unescape(m[3] or m[4] or m[5] or "")} for m in _LINK.finditer(page)]
    about = {
        "Envelope": {
            "WARC-Header-Length": len(raw) - len(rest),
            "WARC-Header-Metadata": source,
            "Block-Digest": digest(block),
            "Payload-Metadata": {
                "HTTP-Response-Metadata": {
                    "Response-Line": status,
                    "Headers": headers,
                    "Entity-Length": len(body),
                    "Entity-Digest": digest(body),
                    "HTML-Metadata": {"Title": page_text(title) if title is not None else None, "Links": links},
                }
            },
        }
    }
    intact = _same(_get(source, "WARC-Block-Digest"), block) and _same(_get(source, "WARC-Payload-Digest"), body)
    more = {"payload_digest": digest(body), "source_digests_ok": intact}
    return [
        _record("metadata", source, "application/json", json.dumps(about, ensure_ascii=False).encode()) | more,
        _record("conversion", source, "text/plain", page_text(page).encode()) | more,
    ]


def derive(records: DataFrame, key: str = "page_id", record: str = "record") -> DataFrame:
    """A row per derived record: the key, its identifiers and digests, and its bytes.

    Only responses have derivatives. What is null, empty or malformed gives an
    error row with the reason, so nothing is lost unseen. Repeated rows give
    repeated results, keys may be null, other columns are ignored, and an
    empty table gives no rows.
    """

    def run(batches):
        for batch in batches:
            at, rows, size = [], [], 0
            for i, raw in enumerate(batch.column(1)):
                made = derive_one(raw.as_py())
                at += [i] * len(made)
                rows += made
                size += sum(len(r.get("record", b"")) for r in made)
                if size > OUT_BYTES or i + 1 == batch.num_rows:
                    arrays = [pa.array([r.get(n) for r in rows], kinds.get(n, pa.string())) for n in _NAMES]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), *arrays], [key, *_NAMES])
                    at, rows, size = [], [], 0

    kinds = {"record": pa.binary(), "source_digests_ok": pa.bool_()}
    kind = records.schema[key].dataType.simpleString()
    return records.select(F.col(key), F.col(record).cast("binary")).mapInArrow(run, f"`{key}` {kind}, {OUT}")


def responses(pages: DataFrame) -> DataFrame:
    """(page_id, record): pages as WARC responses, to derive from."""
    line = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts], F.lit("\r\n"))
    body = F.coalesce("html", F.lit(""))
    http = F.concat(line("HTTP/1.1 200 OK"), line("Content-Type: text/html; charset=utf-8"), line("Content-Length: ", F.octet_length(body).cast("string")), F.lit("\r\n"), body)
    ident = F.sha1(F.concat_ws("|", F.col("page_id").cast("string"), "url"))
    urn = F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(ident, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))
    when = F.date_format(F.timestamp_seconds(F.lit(1_700_000_000) + F.coalesce("page_id", F.lit(0))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    head = F.concat(
        line("WARC/1.0"), line("WARC-Type: response"), line("WARC-Record-ID: ", urn), line("WARC-Target-URI: ", F.coalesce("url", F.lit(""))), line("WARC-Date: ", when),
        line("WARC-Block-Digest: sha1:", F.sha1(http)), line("WARC-Payload-Digest: sha1:", F.sha1(body)), line("Content-Type: application/http; msgtype=response"), line("Content-Length: ", F.octet_length(http).cast("string")),
    )
    return pages.select("page_id", F.concat(head, F.lit("\r\n"), http, F.lit("\r\n\r\n")).cast("binary").alias("record"))
