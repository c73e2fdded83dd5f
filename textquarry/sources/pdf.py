"""A PDF reader for text layers, written from the format's specification.

Objects are found by their headers anywhere in the file (the last of a number wins), so a damaged cross-reference table
does no harm. Streams are decoded through FlateDecode, ASCII85Decode and ASCIIHexDecode; object streams are opened.
Strings become text through the ToUnicode maps of the fonts of their page, or as they stand where a font has none.
Everything that a hostile file could blow up is bounded.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

MOST_STREAM, MOST_OBJECTS, DEPTH, MOST_RANGE = 64 << 20, 20_000, 32, 0xFFFF
LAYER_CHARS = 120
_BLANK, _DELIMITER = b"\x00\t\n\x0c\r ", b"()<>[]{}/%"
_TOKEN = re.compile(rb"[^\x00\t\n\x0c\r ()<>\[\]{}/%]+")
_SKIP = re.compile(rb"(?:[\x00\t\n\x0c\r ]+|%[^\r\n]*)*")


class Name(str):
    """A PDF name."""


class Op(str):
    """A keyword or operator."""


@dataclass(frozen=True)
class Ref:
    number: int


@dataclass
class Stream:
    info: dict
    raw: bytes


class Lexer:
    """Reads objects from bytes. With ``refs``, two integers before R are a reference."""

    def __init__(self, data: bytes, at: int = 0, refs: bool = True):
        self.data, self.at, self.refs = data, at, refs

    def blank(self) -> None:
        self.at = _SKIP.match(self.data, self.at).end()

    def next(self, depth: int = 0):
        """The next object, or None at the end."""
        self.blank()
        data, at = self.data, self.at
        if at >= len(data):
            return None
        c = data[at : at + 1]
        if c == b"/":
            m = re.compile(rb"[^\x00\t\n\x0c\r ()<>\[\]{}/%]*").match(data, at + 1)
            self.at = m.end()
            return Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda h: bytes([int(h[1], 16)]), m[0]).decode("latin-1"))
        if c == b"(":
            return self._literal()
        if data[at : at + 2] == b"<<":
            self.at += 2
            return self._dict(depth)
        if c == b"<":
            end = data.find(b">", at)
            end = len(data) if end < 0 else end
            self.at = end + 1
            digits = re.sub(rb"[^0-9A-Fa-f]", b"", data[at + 1 : end])
            return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        if c == b"[":
            self.at += 1
            out = []
            while (x := self.next(depth + 1) if depth < DEPTH else None) is not None and x != Op("]"):
                out.append(x)
            return out
        if c in (b"]", b">", b"{", b"}", b")"):
            self.at += 2 if data[at : at + 2] == b">>" else 1
            return Op(data[at : self.at].decode())
        word = _TOKEN.match(data, at)[0]
        self.at = at + len(word)
        if re.fullmatch(rb"[+-]?\d+", word):
            if self.refs and (m := re.compile(rb"[\x00\t\n\x0c\r ]+\d+[\x00\t\n\x0c\r ]+R(?![A-Za-z])").match(data, self.at)):
                self.at = m.end()
                return Ref(int(word))
            return int(word)
        if re.fullmatch(rb"[+-]?(?:\d+\.\d*|\.\d+)", word):
            return float(word)
        return Op(word.decode("latin-1"))

    def _dict(self, depth: int) -> dict:
        out = {}
        while depth < DEPTH:
            key = self.next(depth + 1)
            if key is None or key == Op(">>"):
                break
            if not isinstance(key, Name):
                continue
            value = self.next(depth + 1)
            if value is None or value == Op(">>"):
                break
            out[str(key)] = value
        return out

    def _literal(self) -> bytes:
        data, at, depth, out = self.data, self.at + 1, 1, bytearray()
        plain = {110: 10, 114: 13, 116: 9, 98: 8, 102: 12}
        while at < len(data) and depth:
            c = data[at]
            at += 1
            if c == 92 and at < len(data):
                e = data[at]
                at += 1
                if 48 <= e <= 55:
                    m = re.compile(rb"[0-7]{1,3}").match(data, at - 1)
                    out.append(int(m[0], 8) & 255)
                    at = m.end()
                elif e in (10, 13):
                    at += data[at - 1 : at + 1] == b"\r\n"
                else:
                    out.append(plain.get(e, e))
                continue
            depth += (c == 40) - (c == 41)
            if depth:
                out.append(c)
        self.at = at
        return bytes(out)


def _ascii85(data: bytes) -> bytes:
    data = re.sub(rb"[\x00\s]", b"", data.split(b"~>")[0].removeprefix(b"<~"))
    out, group = bytearray(), []
    for c in data:
        if c == 122 and not group:
            out += b"\0\0\0\0"
        elif 33 <= c <= 117:
            group.append(c - 33)
            if len(group) == 5:
                out += (sum(d * 85 ** (4 - k) for k, d in enumerate(group)) & 0xFFFFFFFF).to_bytes(4, "big")
                group = []
    if len(group) > 1:
        n = len(group)
        group += [84] * (5 - n)
        out += (sum(d * 85 ** (4 - k) for k, d in enumerate(group)) & 0xFFFFFFFF).to_bytes(4, "big")[: n - 1]
    return bytes(out)


def _inflate(data: bytes) -> bytes:
    for wbits in (15, -15):
        worker = zlib.decompressobj(wbits)
        try:
            return worker.decompress(data, MOST_STREAM)
        except zlib.error:
            continue
    # A damaged stream gives what comes before the damage.
    worker, out = zlib.decompressobj(), bytearray()
    try:
        for k in range(0, len(data), 256):
            out += worker.decompress(data[k : k + 256], MOST_STREAM - len(out))
    except zlib.error:
        pass
    return bytes(out)


class Document:
    def __init__(self, data: bytes):
        self.objects: dict[int, object] = {}
        trailers = [Lexer(data, m.end()).next() for m in re.finditer(rb"\btrailer\b", data)]
        for m in re.finditer(rb"(?<![0-9])(\d{1,10})\s+\d+\s+obj\b", data):
            self.objects[int(m[1])] = self._object(data, m.end())
        for x in [*trailers, *[o.info for o in self.objects.values() if isinstance(o, Stream)]]:
            if isinstance(x, dict) and "Encrypt" in x:
                raise ValueError("the document is encrypted")
        self.root = next((x["Root"] for x in reversed(trailers) if isinstance(x, dict) and "Root" in x), None)
        for o in list(self.objects.values()):
            if isinstance(o, Stream) and o.info.get("Type") == "ObjStm":
                self._open(o)
            if isinstance(o, Stream) and o.info.get("Type") == "XRef" and self.root is None:
                self.root = o.info.get("Root")

    def _object(self, data: bytes, at: int):
        lexer = Lexer(data, at)
        value = lexer.next()
        if isinstance(value, dict):
            m = re.compile(rb"[\x00\t\n\x0c\r ]*stream(?:\r\n|\n|\r)?").match(data, lexer.at)
            if m:
                length = value.get("Length")
                end = m.end() + length if isinstance(length, int) else -1
                if end < 0 or not re.match(rb"\s*endstream", data[end : end + 20]):
                    end = data.find(b"endstream", m.end())
                    end = len(data) if end < 0 else end
                return Stream(value, data[m.end() : end])
        return value

    def _open(self, stream: Stream) -> None:
        data = self.decoded(stream)
        first, n = self.at(stream.info.get("First"), 0), min(self.at(stream.info.get("N"), 0), MOST_OBJECTS)
        if not isinstance(first, int) or not isinstance(n, int):
            return
        head = Lexer(data[:first], refs=False)
        numbers = [head.next() for _ in range(2 * n)]
        for number, offset in zip(numbers[::2], numbers[1::2]):
            if isinstance(number, int) and isinstance(offset, int) and number not in self.objects:
                self.objects[number] = Lexer(data, first + offset).next()

    def at(self, x: object, default: object = None):
        for _ in range(DEPTH):
            if not isinstance(x, Ref):
                break
            x = self.objects.get(x.number)
        return default if x is None else x

    def decoded(self, stream: Stream) -> bytes:
        data = stream.raw[:MOST_STREAM]
        filters = self.at(stream.info.get("Filter"), [])
        for name in filters if isinstance(filters, list) else [filters]:
            name = self.at(name)
            if name in ("FlateDecode", "Fl"):
                data = _inflate(data)
            elif name in ("ASCII85Decode", "A85"):
                data = _ascii85(data)
            elif name in ("ASCIIHexDecode", "AHx"):
                digits = re.sub(rb"[^0-9A-Fa-f]", b"", data.split(b">")[0])
                data = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
            else:
                break
        return data

    def pages(self) -> Iterator[tuple[dict, dict]]:
        """Pages in order with their resources, which they may inherit."""
        seen: set[int] = set()

        def walk(ref: object, inherited: dict, depth: int) -> Iterator[tuple[dict, dict]]:
            node = self.at(ref)
            if not isinstance(node, dict) or depth > DEPTH or id(node) in seen:
                return
            seen.add(id(node))
            resources = self.at(node.get("Resources"))
            resources = resources if isinstance(resources, dict) else inherited
            kids = self.at(node.get("Kids"))
            if isinstance(kids, list):
                for kid in kids:
                    yield from walk(kid, resources, depth + 1)
            elif node.get("Type") == "Page" or "Contents" in node:
                yield node, resources

        root = self.at(self.root)
        yield from walk(root.get("Pages") if isinstance(root, dict) else None, {}, 0)
        for o in list(self.objects.values()):
            if isinstance(o, dict) and o.get("Type") == "Page" and id(o) not in seen:
                up, resources = o, None
                for _ in range(DEPTH):
                    resources = self.at(up.get("Resources"))
                    if isinstance(resources, dict) or not isinstance(up := self.at(up.get("Parent")), dict):
                        break
                seen.add(id(o))
                yield o, resources if isinstance(resources, dict) else {}

    def fonts(self, resources: dict) -> dict[str, CMap]:
        out = {}
        for name, ref in (self.at(resources.get("Font"), {}) or {}).items() if isinstance(self.at(resources.get("Font"), {}), dict) else ():
            font = self.at(ref)
            chain = [font, *(self.at(font.get("DescendantFonts"), []) if isinstance(font, dict) and isinstance(self.at(font.get("DescendantFonts"), []), list) else [])]
            for x in chain:
                x = self.at(x)
                cmap = self.at(x.get("ToUnicode")) if isinstance(x, dict) else None
                if isinstance(cmap, Stream):
                    out[name] = CMap.parsed(self.decoded(cmap))
                    break
        return out

    def contents(self, page: dict) -> bytes:
        found = self.at(page.get("Contents"), [])
        listed = found if isinstance(found, list) else [found]
        return b"\n".join(self.decoded(s) for s in map(self.at, listed) if isinstance(s, Stream))


@dataclass
class CMap:
    """Codes of a font as text: ``wide`` for two-byte codes."""

    codes: dict[tuple[int, int], str] = field(default_factory=dict)
    widths: set[int] = field(default_factory=set)

    @staticmethod
    def _text(raw: object) -> str:
        return raw.decode("utf-16-be", "ignore") if isinstance(raw, bytes) and len(raw) > 1 else raw.decode("latin-1") if isinstance(raw, bytes) else ""

    @classmethod
    def parsed(cls, data: bytes) -> CMap:
        out = cls()
        for block in re.findall(rb"begincodespacerange(.*?)endcodespacerange", data, re.DOTALL):
            lexer = Lexer(block, refs=False)
            while isinstance(x := lexer.next(), bytes):
                out.widths.add(len(x))
        for block in re.findall(rb"beginbfchar(.*?)endbfchar", data, re.DOTALL):
            lexer = Lexer(block, refs=False)
            while isinstance(code := lexer.next(), bytes):
                out.codes[len(code), int.from_bytes(code, "big")] = cls._text(lexer.next())
        for block in re.findall(rb"beginbfrange(.*?)endbfrange", data, re.DOTALL):
            lexer = Lexer(block, refs=False)
            while isinstance(low := lexer.next(), bytes) and isinstance(high := lexer.next(), bytes):
                to, a = lexer.next(), int.from_bytes(low, "big")
                n = min(int.from_bytes(high, "big") - a, MOST_RANGE) + 1
                if isinstance(to, list):
                    for k, x in enumerate(to[:n]):
                        out.codes[len(low), a + k] = cls._text(x)
                elif isinstance(to, bytes) and to:
                    for k in range(n):
                        last = int.from_bytes(to[-2:], "big") + k
                        out.codes[len(low), a + k] = cls._text(to[:-2] + (last & 0xFFFF).to_bytes(2, "big")) if len(to) > 1 else chr(to[0] + k)
        return out

    def decode(self, raw: bytes) -> str:
        """Two-byte codes are tried first where the font has them; a code without text gives nothing."""
        out, at, wide = [], 0, 2 in self.widths or any(n == 2 for n, _ in self.codes)
        narrow = 1 in self.widths or not wide or any(n == 1 for n, _ in self.codes)
        while at < len(raw):
            if wide and at + 1 < len(raw) and (x := self.codes.get((2, int.from_bytes(raw[at : at + 2], "big")))) is not None:
                out.append(x)
                at += 2
            elif narrow:
                out.append(self.codes.get((1, raw[at]), ""))
                at += 1
            else:
                at += 2
        return "".join(out)


def _plain(raw: bytes) -> str:
    return raw[2:].decode("utf-16-be", "ignore") if raw.startswith(b"\xfe\xff") else raw.decode("cp1252", "replace")


def page_text(content: bytes, fonts: dict[str, CMap]) -> str:
    """What a content stream shows. A new line where the place moves down or up, a space where it jumps to the side."""
    lexer, stack, out = Lexer(content, refs=False), [], []
    cmap, size, leading = None, 0.0, 0.0
    x = y = 0.0
    last: tuple[float, float] | None = None

    def show(raw: bytes) -> None:
        nonlocal last
        text = cmap.decode(raw) if cmap is not None else _plain(raw)
        if last is not None:
            if abs(y - last[1]) > 1:
                out.append("\n")
            elif abs(x - last[0]) > (1.3 * size if size else 1):
                out.append(" ")
        last = (x, y)
        out.append(text)
        if len(text) > 1:
            out.append(" ")

    numbers = lambda n: [float(v) if isinstance(v, int | float) else 0.0 for v in ([0] * n + stack)[-n:]]
    while (token := lexer.next()) is not None:
        if not isinstance(token, Op) or token in ("]", ">>"):
            stack.append(token)
            del stack[:-64]
            continue
        if token == "BT":
            x = y = 0.0
            last = None
            if out:
                out.append("\n")
        elif token == "Tf" and len(stack) > 1:
            cmap, size = fonts.get(str(stack[-2])), abs(numbers(1)[0])
        elif token in ("Td", "TD"):
            dx, dy = numbers(2)
            x, y = x + dx, y + dy
            leading = -dy if token == "TD" else leading
        elif token == "Tm":
            x, y = numbers(2)
        elif token == "TL":
            leading = numbers(1)[0]
        elif token == "T*":
            y -= leading or 2.0
        elif token in ("Tj", "'", '"') and stack and isinstance(stack[-1], bytes):
            if token != "Tj":
                y -= leading or 2.0
            show(stack[-1])
        elif token == "TJ" and stack and isinstance(stack[-1], list):
            show(b"".join(s for s in stack[-1] if isinstance(s, bytes)))
        elif token == "ID":
            end = re.compile(rb"\sEI\b").search(content, lexer.at)
            lexer.at = end.end() if end else len(content)
        stack.clear()
    return "".join(out)


def looks_readable(text: str) -> bool:
    """Long enough, mostly letters, marks and digits, and hardly any replacement characters."""
    solid = [c for c in text if not c.isspace()]
    if len(text.strip().encode("utf-8", "replace")) < 20 or not solid:
        return False
    good = sum(unicodedata.category(c)[0] in "LMN" and unicodedata.category(c) != "No" for c in solid)
    return good / len(solid) > 0.45 and text.count("�") <= 0.01 * len(text)


def raw_text(content: bytes) -> str:
    document = Document(content)
    pages = [page_text(document.contents(page), document.fonts(resources)) for page, resources in document.pages()]
    text = "\n\n".join(p for p in pages if p.strip())
    text = re.sub(r"[ \t]+", " ", text.replace("\x00", ""))
    return re.sub(r"\n{3,}", "\n\n", re.sub(r" *\n *", "\n", text)).strip()


def text_of(content: bytes) -> str:
    """The text layer; an error says that there is none or that it can't be decoded."""
    if b"%PDF" not in content[:1024]:
        raise ValueError("not a PDF file")
    text = raw_text(content)
    if looks_readable(text):
        return text
    raise ValueError("the text of the PDF can't be decoded" if len(text) >= LAYER_CHARS else "the PDF holds no text layer; it may be a scan")


def fields_of(content: bytes) -> dict[str, str]:
    out = {}
    for tag, name in (("Producer", "producer"), ("Creator", "creator"), ("Author", "author"), ("CreationDate", "creationdate"), ("ModDate", "moddate")):
        m = re.search(rb"/" + tag.encode() + rb"\s*(?=\()", content[:400_000])
        if m and (value := _plain(Lexer(content, m.end()).next() or b"").strip()):
            out[name] = value[:200]
    return out
