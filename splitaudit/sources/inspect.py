"""One pass over files on the executors: probe, fingerprint, metadata, run-local tokens.

Raw identifiers never leave the worker: what comes out are tokens keyed by a random value that
the driver draws for each run, statuses and codes.  An error becomes a code, never a text.
"""

from __future__ import annotations

import hashlib
import hmac
import os
import re
import secrets
import unicodedata
from pathlib import PurePath

import pyarrow as pa
from pyspark.sql import DataFrame

from splitaudit.functions.scalars import DICOM_SUFFIXES, DUMMY_PATIENT_IDS, RASTER_SUFFIXES, UID_LENGTH, UID_PATTERN
from splitaudit.sources import dicom_reader

MIN_KEY_BYTES = 16
_UID = re.compile(UID_PATTERN)
_COLUMNS = ["media_type", "access_issue", "file_sha256", "hash_failed", "parse_error", "patient_id_status", "patient_group_token", "study_uid_token", "series_uid_token", "sop_uid_token", "modality", "number_of_frames"]
SCHEMA = "ord long, path binary, split string, source_namespace string, split_fold string, namespace_fold string, media_type string, access_issue string, file_sha256 string, hash_failed boolean, parse_error string, patient_id_status string, patient_group_token string, study_uid_token string, series_uid_token string, sop_uid_token string, modality string, number_of_frames long"
#: Attributes of which one at least a data set must have (fixed values).
STRUCTURE = ["SOPClassUID", "SOPInstanceUID", "StudyInstanceUID", "SeriesInstanceUID", "PatientID", "Modality", "Rows", "Columns"]


class Tokenizer:
    """Keyed equality tokens: the same values give the same token within one run only."""

    def __init__(self, key: bytes | None = None) -> None:
        self._key = secrets.token_bytes(32) if key is None else key
        if len(self._key) < MIN_KEY_BYTES:
            raise ValueError("the key is too short")

    def token(self, *parts: str) -> str:
        return hmac.new(self._key, "\x1f".join(parts).encode("utf-8", "surrogatepass"), hashlib.sha256).hexdigest()


def clean_text(value: object | None) -> str | None:
    """NFKC, without NUL and outer white space; null if nothing is left."""
    return None if value is None else unicodedata.normalize("NFKC", str(value)).replace("\0", "").strip() or None


def patient_id_status(value: str | None) -> str:
    if value is None:
        return "missing"
    folded = re.sub(r"[\s_./-]+", "", value).casefold()
    return "dummy" if folded in DUMMY_PATIENT_IDS or re.fullmatch("0+|x+", folded) else "usable"


def valid_uid(value: str | None) -> str | None:
    return value if value is not None and len(value) <= UID_LENGTH and _UID.fullmatch(value) else None


def number_of_frames(value: str | None) -> int | None:
    try:
        return None if value is None else int(value)
    except ValueError:
        return None


class FileBytes(dicom_reader.Window):
    """A file's bytes in chunks, with the digest of what has been read: one opening serves all that is asked of it."""

    def __init__(self, path: bytes, chunk: int) -> None:
        super().__init__()
        self.file, self.chunk, self.digest = open(path, "rb"), chunk, hashlib.sha256()  # noqa: SIM115

    def __enter__(self) -> FileBytes:
        return self

    def __exit__(self, *_: object) -> None:
        self.file.close()

    def pull(self) -> bytes:
        data = self.file.read(self.chunk)
        self.digest.update(data)
        return data

    def fingerprint(self) -> str:
        """SHA-256 of the whole file; what is left of it is read and not held."""
        self.held = b""
        while self.pull():
            pass
        return self.digest.hexdigest()


def _has_preamble(data: dicom_reader.Window) -> bool:
    return data.get(0, 132)[128:] == b"DICM"


def classify(path: bytes) -> tuple[str, str | None]:
    """Media type by suffix, or by the preamble of a file without one; and why it could not be told."""
    kind = kind_of(path)
    if kind:
        return kind, None
    try:
        with FileBytes(path, 132) as data:
            return ("dicom", None) if _has_preamble(data) else ("unsupported", None)
    except OSError:
        return "unreadable", "file_probe_failed"


def kind_of(path: bytes) -> str | None:
    """Media type by suffix; None where the content decides."""
    suffix = PurePath(os.fsdecode(path)).suffix.casefold()
    if suffix in DICOM_SUFFIXES:
        return "dicom"
    return "raster" if suffix in RASTER_SUFFIXES else "unsupported" if suffix else None


def metadata(data: dicom_reader.Window) -> tuple[dict | None, str | None]:
    """Metadata, or the code of what went wrong."""
    try:
        found = dicom_reader.read_metadata(data)
    except Exception:  # any text of the error may hold an identifier
        return None, "dicom_parse_failed"
    if all(found.get(k) is None for k in STRUCTURE):
        return None, "dicom_structure_missing"
    return found, None


def read_file(path: bytes, chunk: int) -> tuple[dict, dict | None]:
    """Media type, issue, digest and parse error of a file, and its metadata; the file is opened once."""
    kind, found = kind_of(path), None
    out: dict = {"media_type": kind or "unreadable", "access_issue": None if kind else "file_probe_failed", "hash_failed": False}
    if kind == "unsupported":
        return out, None
    try:
        with FileBytes(path, chunk) as data:
            if kind is None:
                kind = "dicom" if _has_preamble(data) else "unsupported"
                out |= {"media_type": kind, "access_issue": None}
                if kind == "unsupported":
                    return out, None
            if kind == "dicom":
                found, out["parse_error"] = metadata(data)
            out["file_sha256"] = data.fingerprint()
    except OSError:
        if kind:
            out["hash_failed"] = True
            if kind == "dicom" and "parse_error" not in out:
                out["parse_error"] = "dicom_parse_failed"
    return out, found


def inspect_file(path: bytes, namespace: str, chunk: int, tokens: Tokenizer) -> dict:
    """The inspected columns of one file."""
    facts, found = read_file(path, chunk)
    out: dict = dict.fromkeys(_COLUMNS) | facts
    if found is None:
        return out
    text = {k: clean_text(found.get(k)) for k in ("PatientID", "IssuerOfPatientID", "Modality", "NumberOfFrames")}
    status = patient_id_status(text["PatientID"])
    out |= {"patient_id_status": status, "modality": text["Modality"], "number_of_frames": number_of_frames(text["NumberOfFrames"])}
    if status == "usable":
        out["patient_group_token"] = tokens.token("patient-group-v1", namespace, text["IssuerOfPatientID"] or "", text["PatientID"])
    for column, name, domain in (("study_uid_token", "StudyInstanceUID", "study-uid-v1"), ("series_uid_token", "SeriesInstanceUID", "series-uid-v1"), ("sop_uid_token", "SOPInstanceUID", "sop-uid-v1")):
        uid = valid_uid(clean_text(found.get(name)))
        out[column] = None if uid is None else tokens.token(domain, uid)
    return out


def inspect(artifacts: DataFrame, chunk: int, tokens: Tokenizer) -> DataFrame:
    """Inspects every artifact that is to be opened; the others are `unavailable` with their issue."""
    spark = artifacts.sparkSession
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    given = names[:6]

    def run(batches):
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                if row["access_issue"] is None:
                    found = inspect_file(row["path"], row["source_namespace"], chunk, tokens)
                else:
                    found = dict.fromkeys(_COLUMNS) | {"media_type": "unavailable", "access_issue": row["access_issue"], "hash_failed": False}
                rows.append({c: row[c] for c in given} | found)
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    kinds = {"long": pa.int64(), "binary": pa.binary(), "string": pa.string(), "boolean": pa.bool_()}
    arrow = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in SCHEMA.split(", ")])
    parts = max(1, spark.sparkContext.defaultParallelism)
    return artifacts.repartition(parts).mapInArrow(run, SCHEMA)
