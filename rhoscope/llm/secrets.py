"""Secret scans with a worklist of decoded layers.

The text itself is the first layer. A layer is scanned for secrets; then percent escapes, Unicode escapes
and base64 tokens in it are unwrapped, base64 bytes that are compressed (gzip, zlib, bz2) are unpacked, and
every new layer joins the worklist until none is left. A layer that was seen before at the same place is not
taken up again, and nor is a compressed one that it is itself in, so cycles end. Every span is mapped back to code points of the original text: escapes
character by character, base64 and compressed layers to the whole token that held them.

Cases: a null or empty text has no spans; texts are never cut; repeated rows are scanned apart; further
columns stay in ``redact_secrets`` and are ignored in ``scan_secrets``. Invalid bytes of a layer count as
replacement characters. Compressed layers, all their members, are read as streams of any length in blocks of
16 MB that end where no secret or token can go on; a run of over 64 MB without such a place is scanned in blocks
that overlap by 1 MB. ``unopened`` is set where a layer is larger than a caller's own ``max_unpacked``, or lies
in more than 100 different compressed ones.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import re
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
UNICODE = re.compile(r"(?:\\u[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2})+")
#: 16 characters hold 12 bytes, the length of the shortest secret.
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
HEX_RUN = b"x" * 24
CODE_RUN = b"x" * 16
HEX_CLASS = bytes(120 if chr(i) in "0123456789abcdef" else 32 for i in range(256))
CODE_CLASS = bytes(120 if chr(i).isascii() and (chr(i).isalnum() or chr(i) in "+/_-") else 32 for i in range(256))


def scan(text: str, raw: bytes | None = None) -> list[tuple[int, int, int]]:
    """(start, kind, end) of one layer's secrets; kinds as indexes into KINDS."""
    raw = text.encode("utf-8", "surrogatepass") if raw is None else raw
    out = []
    low = raw.lower()
    if any(w in low for w in map(str.encode, ASSIGN_WORDS)):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if b"AKIA" in raw:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if HEX_RUN in raw.translate(HEX_CLASS):
        out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return out


MAGIC = ((b"\x1f\x8b", lambda: zlib.decompressobj(31)), (b"\x78", zlib.decompressobj), (b"BZh", bz2.BZ2Decompressor))
#: Characters that are in no secret, escape or token, at any layer.
APART = [c.encode() for c in "\n\r\t\0,;()<>{}[]|&!?#*"]
BLOCK, RUN, OVERLAP = 1 << 24, 1 << 26, 1 << 20


def compressed(raw: bytes) -> bool:
    return raw.startswith(tuple(magic for magic, _ in MAGIC))


def inflated(raw: bytes, pieces: Iterator[bytes], most: int | None) -> Iterator:
    """First whether the bytes could be opened at all, then their content, member after member, and as they are
    those that follow the last member or can't be opened."""
    total, told = 0, False
    while compressed(raw):
        opener = next(make for magic, make in MAGIC if raw.startswith(magic))()
        given, tried, some = raw, [raw], False
        try:
            while not opener.eof:
                out = opener.decompress(given, BLOCK)
                # zlib hands back what it has not read, bz2 keeps it.
                given = getattr(opener, "unconsumed_tail", b"")
                if out:
                    total += len(out)
                    if most is not None and total > most:
                        raise OverflowError
                    if not told:
                        told = True
                        yield True
                    some, tried = True, []
                    yield out
                elif not given and not opener.eof:
                    given = next(pieces, b"")
                    if not given:  # cut short
                        break
                    if not some:
                        tried.append(given)
        except (zlib.error, OSError, EOFError, ValueError):
            tried = tried if not some else [given]
            opener = None
        if opener is None or not some and not opener.eof:
            if not told:
                yield False
            yield from tried
            yield from pieces
            return
        if not told:
            told = True
            yield True
        raw = opener.unused_data if opener.eof else b""
        while len(raw) < 3 and (more := next(pieces, b"")):
            raw += more
    if raw:
        yield raw
    yield from pieces


def head(pieces: Iterator[bytes]) -> bytes:
    """The first bytes, enough to tell what they are."""
    first = b""
    while len(first) < 3 and (more := next(pieces, b"")):
        first += more
    return first


def unpacked(fresh: Callable[[], Iterator[bytes]], most: int | None, depth: int = 100, around: tuple[bytes, ...] = ()) -> Iterator[bytes]:
    """Bytes unpacked until they aren't compressed; ``fresh`` begins to read them anew.

    A layer that equals one ``around`` it holds itself and adds nothing. OverflowError beyond ``most`` bytes, and
    beyond ``depth`` layers.
    """
    pieces = fresh()
    first = head(pieces)
    if not compressed(first):
        yield first
        yield from pieces
        return
    digest = hashlib.blake2b(digest_size=16)
    for piece in fresh():
        digest.update(piece)
    if digest.digest() in around:
        return
    if not depth:
        raise OverflowError

    def inner() -> Iterator:
        again = fresh()
        return inflated(head(again), again, most)

    def inside() -> Iterator[bytes]:
        out = inner()
        next(out)
        return out

    opened = inner()
    yield from unpacked(inside, most, depth - 1, (*around, digest.digest())) if next(opened) else opened


def contents(raw: bytes, most: int | None = None) -> Iterator[bytes]:
    """What is in a token's bytes, unpacked, in blocks that cut no secret or token."""
    held = b""
    for piece in unpacked(lambda: iter([raw]), most):
        held += piece
        if len(held) >= BLOCK:
            cut = max(held.rfind(c) for c in APART) + 1
            if cut:
                yield held[:cut]
                held = held[cut:]
            elif len(held) >= RUN:
                yield held
                held = held[-OVERLAP:]
    if held:
        yield held


def as_text(raw: bytes) -> str | None:
    """Bytes that are plainly text."""
    try:
        text = raw.decode()
    except UnicodeDecodeError:
        return None
    return text if text and not re.search(r"[\x00-\x08\x0e-\x1f\x7f]", text) else None


def _escapes(text: str, pattern: re.Pattern, decode) -> tuple[str, list[tuple[int, int]]] | None:
    """The layer with every escape decoded, and each character's span in ``text``."""
    parts, spans, at, found = [], [], 0, False
    for m in pattern.finditer(text):
        chars = decode(m)
        found = True
        parts.append(text[at : m.start()])
        spans += [(i, i + 1) for i in range(at, m.start())]
        for char, a, b in chars:
            parts.append(char)
            spans.append((a, b))
        at = m.end()
    if not found:
        return None
    parts.append(text[at:])
    spans += [(i, i + 1) for i in range(at, len(text))]
    return "".join(parts), spans


def _percent(m: re.Match) -> list[tuple[str, int, int]]:
    decoded = bytes.fromhex(m[0].replace("%", "")).decode(errors="surrogateescape")
    out, at = [], m.start()
    for c in decoded:
        invalid = 0xDC80 <= ord(c) <= 0xDCFF
        n = 3 if invalid else 3 * len(c.encode())
        out.append(("\ufffd" if invalid else c, at, at + n))
        at += n
    return out


def _unicode(m: re.Match) -> list[tuple[str, int, int]]:
    out = []
    for x in re.finditer(r"\\u([0-9A-Fa-f]{4})|\\x([0-9A-Fa-f]{2})", m[0]):
        code, a, b = int(x[1] or x[2], 16), m.start() + x.start(), m.start() + x.end()
        if 0xDC00 <= code < 0xE000 and out and 0xD800 <= ord(out[-1][0]) < 0xDC00:
            high, a, _ = out.pop()
            code = 0x10000 + ((ord(high) - 0xD800) << 10) + code - 0xDC00
        out.append((chr(code), a, b))
    return out


def _tokens(text: str):
    """(bytes, start, end) of base64 tokens; if a run as a whole isn't plainly one, so are its pieces between / + _ -."""
    for m in BASE64.finditer(text):
        whole = _decoded(m[0])
        if whole is not None:
            yield whole, m.start(), m.end()
            if compressed(whole) or as_text(whole) is not None:
                continue
        pieces = [p for p in re.finditer(r"[A-Za-z0-9]{16,}={0,2}", m[0]) if p[0] != m[0]]
        for p in pieces:
            if (part := _decoded(p[0])) is not None:
                yield part, m.start() + p.start(), m.start() + p.end()


def _decoded(token: str) -> bytes | None:
    """A token's bytes, if it has a length that base64 can have."""
    bare = token.rstrip("=")
    if len(bare) % 4 == 1:
        return None
    try:
        return base64.b64decode(bare.replace("-", "+").replace("_", "/") + "=" * (-len(bare) % 4))
    except (binascii.Error, ValueError):
        return None


def find_secrets(text: str | None, max_unpacked: int | None = None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]], bool]:
    """Base spans, all spans, and whether a layer was too large or too deep to open; spans are (start, kind, end)."""
    if not text:
        return [], [], False
    raw = text.encode("utf-8", "surrogatepass")
    base = sorted(scan(text, raw))
    found, unopened = set(base), False
    work: list[Iterator[tuple[str, bytes, list[tuple[int, int]] | tuple[int, int] | None]]] = [iter([(text, raw, None)])]
    seen: set[tuple] = set()

    def layers(content: bytes, span: tuple[int, int]):
        nonlocal unopened
        try:
            for block in contents(content, max_unpacked):
                yield block.decode(errors="replace"), block, span
        except OverflowError:
            unopened = True

    while work:
        # One block of a stream at a time, with all that it holds.
        if (item := next(work[-1], None)) is None:
            work.pop()
            continue
        layer, raw, spans = item
        whole = isinstance(spans, tuple)
        place = (lambda a, b, s=spans: s) if whole else (lambda a, b: (a, b)) if spans is None else (lambda a, b, s=spans: (s[a][0], s[b - 1][1]))
        key = (hashlib.blake2b(raw, digest_size=16).digest(), spans if whole else None) if spans is not None else None
        if key is not None:
            if key in seen:
                continue
            seen.add(key)
            for a, kind, b in scan(layer, raw):
                lo, hi = place(a, b)
                found.add((lo, kind, hi))
        for mark, pattern, decode in ((b"%", PERCENT, _percent), (b"\\", UNICODE, _unicode)):
            if mark in raw and (opened := _escapes(layer, pattern, decode)):
                inner = spans if whole else [place(a, b) for a, b in opened[1]]
                work.append(iter([(opened[0], opened[0].encode("utf-8", "surrogatepass"), inner)]))
        if CODE_RUN in raw.translate(CODE_CLASS):
            work += [layers(content, place(a, b)) for content, a, b in _tokens(layer)]
    return base, sorted(found), unopened


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _text_column(batch: pa.RecordBatch) -> list[str | None]:
    return batch.column("text").to_pylist()


def scan_secrets(df: DataFrame, max_unpacked: int | None = None) -> DataFrame:
    """(doc_id, base, spans, unopened): spans as arrays of (kind, start, end), base the plain text's own."""
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    listed = lambda found: [{"kind": KINDS[k], "start": a, "end": b} for a, k, b in found]

    def work(batches):
        for batch in batches:
            found = [find_secrets(t, max_unpacked) for t in _text_column(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([listed(f[0]) for f in found], span), pa.array([listed(f[1]) for f in found], span), pa.array([f[2] for f in found], pa.bool_())], names=["doc_id", "base", "spans", "unopened"])

    kind = "array<struct<kind:string,start:int,end:int>>"
    return df.select("doc_id", "text").mapInArrow(work, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, base {kind}, spans {kind}, unopened boolean")


def redacted(text: str | None, max_unpacked: int | None = None) -> str | None:
    """The text with every secret, or the token that holds it, replaced by its kind; overlapping spans are one."""
    found = find_secrets(text, max_unpacked)[1]
    if not found:
        return text
    parts, at, i = [], 0, 0
    while i < len(found):
        a, kind, b = found[i]
        i += 1
        while i < len(found) and found[i][0] < b:
            b = max(b, found[i][2])
            i += 1
        parts += [text[at:a], f"[{KINDS[kind]}]"]
        at = b
    return "".join(parts) + text[at:]


def redact_secrets(df: DataFrame, max_unpacked: int | None = None) -> DataFrame:
    """The same rows and columns; ``text`` without secrets, ``n_chars``, if there, to match."""
    schema = df.schema

    def work(batches):
        for batch in batches:
            before = _text_column(batch)
            after = [redacted(t, max_unpacked) for t in before]
            columns = []
            for name, column in zip(batch.schema.names, batch.columns, strict=True):
                if name == "text":
                    column = pa.array(after, column.type)
                elif name == "n_chars":
                    column = pa.array([n if a == b else len(a) for n, a, b in zip(column.to_pylist(), after, before, strict=True)], column.type)
                columns.append(column)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return df.mapInArrow(work, schema)
