"""A small reader of DICOM metadata: ten tags, no pixels.

Reads Part 10 files and bare data sets in implicit and explicit little endian, explicit big
endian and deflated transfer syntaxes.  Sequences are passed over; reading stops at pixel data.
"""

from __future__ import annotations

import struct
import zlib

#: Fixed values of the public standard: tags read, by keyword.
TAGS = {
    (0x0008, 0x0016): "SOPClassUID",
    (0x0008, 0x0018): "SOPInstanceUID",
    (0x0008, 0x0060): "Modality",
    (0x0010, 0x0020): "PatientID",
    (0x0010, 0x0021): "IssuerOfPatientID",
    (0x0020, 0x000D): "StudyInstanceUID",
    (0x0020, 0x000E): "SeriesInstanceUID",
    (0x0028, 0x0008): "NumberOfFrames",
    (0x0028, 0x0010): "Rows",
    (0x0028, 0x0011): "Columns",
}
_CHARSET = (0x0008, 0x0005)
_NUMBERS = {"Rows", "Columns"}
_PIXELS = 0x7FE0
_LONG_FORM = {b"OB", b"OD", b"OF", b"OL", b"OV", b"OW", b"SQ", b"SV", b"UC", b"UN", b"UR", b"UT", b"UV"}
_VALUE_FORMS = _LONG_FORM | {b"AE", b"AS", b"AT", b"CS", b"DA", b"DS", b"DT", b"FD", b"FL", b"IS", b"LO", b"LT", b"PN", b"SH", b"SL", b"SS", b"ST", b"TM", b"UI", b"UL", b"US"}
_ENCODINGS = {"ISO_IR 100": "latin-1", "ISO_IR 101": "iso8859-2", "ISO_IR 109": "iso8859-3", "ISO_IR 110": "iso8859-4", "ISO_IR 144": "iso8859-5", "ISO_IR 127": "iso8859-6", "ISO_IR 126": "iso8859-7", "ISO_IR 138": "iso8859-8", "ISO_IR 148": "iso8859-9", "ISO_IR 13": "shift_jis", "ISO_IR 166": "tis-620", "ISO_IR 192": "utf-8", "GB18030": "gb18030", "GBK": "gbk"}
_IMPLICIT, _BIG, _DEFLATED = "1.2.840.10008.1.2", "1.2.840.10008.1.2.2", "1.2.840.10008.1.2.1.99"
_UNDEFINED = 0xFFFFFFFF
_ITEM, _ITEM_END, _SEQUENCE_END = (0xFFFE, 0xE000), (0xFFFE, 0xE00D), (0xFFFE, 0xE0DD)


class NotDicom(ValueError):
    """The bytes are no data set."""


class Window:
    """Bytes that come in order, of which only those from the last place asked for are held."""

    def __init__(self) -> None:
        self.start, self.held = 0, b""

    def pull(self) -> bytes:
        """The next bytes; none at the end."""
        raise NotImplementedError

    def get(self, at: int, size: int) -> bytes:
        """Up to `size` bytes from `at` on, fewer only at the end; nothing before `at` can be asked for again."""
        while self.start + len(self.held) < at + size:
            more = self.pull()
            if not more:
                break
            keep = max(0, at - self.start)
            self.start, self.held = self.start + min(keep, len(self.held)), self.held[keep:] + more
        return self.held[max(0, at - self.start) : max(0, at - self.start + size)]

    def reaches(self, end: int) -> bool:
        """There are bytes up to `end`."""
        return end == 0 or len(self.get(end - 1, 1)) == 1


class Held(Window):
    def __init__(self, data: bytes) -> None:
        self.start, self.held = 0, data

    def pull(self) -> bytes:
        return b""


class _Inflated(Window):
    """What a deflated stream holds, from a place of another window on."""

    def __init__(self, source: Window, at: int) -> None:
        super().__init__()
        self.source, self.at, self.unpack, self.left = source, at, zlib.decompressobj(-15), b""

    def pull(self) -> bytes:
        while not self.unpack.eof:
            packed = self.left or self.source.get(self.at, 1 << 16)
            if not packed:
                return self.unpack.flush()
            if not self.left:
                self.at += len(packed)
            try:
                out = self.unpack.decompress(packed, 1 << 20)
            except zlib.error as e:
                raise NotDicom("the deflated data set is damaged") from e
            self.left = self.unpack.unconsumed_tail
            if out:
                return out
        return b""


class _Elements:
    """Data elements of a window from an offset on."""

    def __init__(self, data: Window, at: int, explicit: bool, big: bool) -> None:
        self.data, self.at, self.explicit, self.order = data, at, explicit, ">" if big else "<"

    def _take(self, form: str) -> tuple:
        size = struct.calcsize(form)
        got = self.data.get(self.at, size)
        if len(got) < size:
            raise NotDicom("an element is cut short")
        self.at += size
        return struct.unpack(self.order + form, got)

    def head(self) -> tuple[tuple[int, int], bytes, int]:
        tag = self._take("HH")
        if tag[0] == 0xFFFE or not self.explicit:
            return tag, b"", self._take("I")[0]
        form = self.data.get(self.at, 2)
        self.at += 2
        if form not in _VALUE_FORMS:
            raise NotDicom("an element has no value form")
        if form in _LONG_FORM:
            self.at += 2
            return tag, form, self._take("I")[0]
        return tag, form, self._take("H")[0]

    def skip_sequence(self, depth: int = 0) -> None:
        """To the end of a sequence of undefined length."""
        if depth > 64:
            raise NotDicom("sequences are nested too deeply")
        while True:
            tag, _, size = self.head()
            if tag == _SEQUENCE_END:
                return
            if tag != _ITEM:
                raise NotDicom("a sequence holds something else than items")
            if size != _UNDEFINED:
                self.at += size
                continue
            while True:
                tag, _, size = self.head()
                if tag == _ITEM_END:
                    break
                if size == _UNDEFINED:
                    self.skip_sequence(depth + 1)
                else:
                    self.at += size

    def until(self, stop: int, wanted):
        """(tag, value) of the wanted elements below a group number; the others are passed over unheld."""
        while first := self.data.get(self.at, 2):
            if struct.unpack(self.order + "H", first.ljust(2, b"\0"))[0] >= stop:
                return  # what follows may be of another form
            tag, _, size = self.head()
            if size == _UNDEFINED:
                self.skip_sequence()
                continue
            if tag in wanted:
                value = self.data.get(self.at, size)
                if len(value) < size:
                    raise NotDicom("a value is cut short")
                yield tag, value
            elif not self.data.reaches(self.at + size):
                raise NotDicom("a value is cut short")
            self.at += size


def _text(value: bytes, encoding: str) -> str:
    return value.decode(encoding, "replace").rstrip("\0 ")


def read_metadata(data: bytes | Window) -> dict[str, object]:
    """Values of the tags that are present, by keyword: texts, and numbers for Rows and Columns.

    Reads no further than to the pixels, and holds one wanted value at a time.
    """
    if isinstance(data, bytes):
        data = Held(data)
    at, explicit, big = 0, None, False
    head = data.get(0, 132)
    if head[128:] == b"DICM":
        meta = _Elements(data, 132, True, False)
        syntax = ""
        for _, value in meta.until(0x0003, {(0x0002, 0x0010)}):
            syntax = _text(value, "ascii")
        at = meta.at
        explicit, big = syntax != _IMPLICIT, syntax == _BIG
        if syntax == _DEFLATED:
            data, at = _Inflated(data, at), 0
    if explicit is None:
        explicit = head[4:6] in _VALUE_FORMS
    found: dict[str, object] = {}
    charset = "ascii"
    elements = _Elements(data, at, explicit, big)
    for tag, value in elements.until(_PIXELS, {*TAGS, _CHARSET}):
        if tag == _CHARSET:
            names = [n.strip() for n in _text(value, "ascii").split("\\")]
            charset = next((_ENCODINGS[n.replace("ISO 2022 IR", "ISO_IR")] for n in names if n.replace("ISO 2022 IR", "ISO_IR") in _ENCODINGS), "ascii")
        elif tag in TAGS:
            name = TAGS[tag]
            if name in _NUMBERS:
                found[name] = struct.unpack(elements.order + "H", value[:2])[0] if len(value) >= 2 else None
            else:
                text = _text(value, charset if name in ("PatientID", "IssuerOfPatientID") else "latin-1")
                parts = text.split("\\")
                found[name] = text if len(parts) == 1 else str(parts)
    return found
