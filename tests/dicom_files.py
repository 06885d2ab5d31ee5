"""Writes small DICOM objects byte by byte: explicit little endian, metadata only."""

import struct
import zlib
from pathlib import Path

ROOT = "1.2.826.0.1.3680043.10.5432"
FORMS = {"SOPInstanceUID": (0x0008, 0x0018, b"UI"), "Modality": (0x0008, 0x0060, b"CS"), "PatientID": (0x0010, 0x0020, b"LO"), "IssuerOfPatientID": (0x0010, 0x0021, b"LO"), "StudyInstanceUID": (0x0020, 0x000D, b"UI"), "SeriesInstanceUID": (0x0020, 0x000E, b"UI"), "NumberOfFrames": (0x0028, 0x0008, b"IS")}
DEFAULTS = {"PatientID": "PATIENT-001", "IssuerOfPatientID": "TEST-HOSPITAL", "StudyInstanceUID": f"{ROOT}.1", "SeriesInstanceUID": f"{ROOT}.1.1", "SOPInstanceUID": f"{ROOT}.1.1.1", "Modality": "DX"}


def element(group: int, number: int, form: bytes, value: bytes, order: str = "<", explicit: bool = True) -> bytes:
    value += b" " * (len(value) % 2) if form != b"UI" else b"\0" * (len(value) % 2)
    head = struct.pack(order + "HH", group, number)
    if not explicit:
        return head + struct.pack(order + "I", len(value)) + value
    if form == b"SQ":
        return head + form + b"\0\0" + struct.pack(order + "I", len(value)) + value
    return head + form + struct.pack(order + "H", len(value)) + value


def data_set(order: str = "<", explicit: bool = True, extra: bytes = b"", **values) -> bytes:
    found = {**DEFAULTS, **values}
    parts = {(g, n): element(g, n, form, found[k].encode(), order, explicit) for k, (g, n, form) in FORMS.items() if found.get(k) is not None}
    parts[(0x0028, 0x0010)] = element(0x0028, 0x0010, b"US", struct.pack(order + "H", 1), order, explicit)
    return b"".join(parts[k] for k in sorted(parts)) + extra


def part10(syntax: str, body: bytes) -> bytes:
    meta = element(0x0002, 0x0010, b"UI", syntax.encode())
    return b"\0" * 128 + b"DICM" + meta + body


def write_dicom(path: Path, **values) -> Path:
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(part10("1.2.840.10008.1.2.1", data_set(**values)))
    return path


def deflated(body: bytes) -> bytes:
    packer = zlib.compressobj(9, zlib.DEFLATED, -15)
    return packer.compress(body) + packer.flush()
