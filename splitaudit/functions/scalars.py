"""Column forms of the scalar derivations: media type, identifier status, UID form, ids and texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Suffixes by media type, placeholder identifiers, and the form of a valid UID.
DICOM_SUFFIXES = [".dcm", ".dicom"]
RASTER_SUFFIXES = [".bmp", ".jpeg", ".jpg", ".png", ".tif", ".tiff"]
DUMMY_PATIENT_IDS = ["0", "anon", "anonymous", "anonymized", "deidentified", "dummy", "na", "none", "null", "patient", "removed", "test", "unknown", "unk", "withheld"]
UID_PATTERN = r"(0|[1-9][0-9]*)(\.(0|[1-9][0-9]*))*"
UID_LENGTH = 64


def path_suffix(path: Column) -> Column:
    """Last suffix of a path's name, lowered; a leading dot alone makes no suffix, nor does a last one."""
    name = F.regexp_extract(path, r"([^/]*)/*$", 1)
    return F.lower(F.regexp_extract(name, r"[^.].*?(\.[^.]+)$", 1))


def media_type(path: Column, has_preamble: Column | None = None) -> Column:
    """dicom, raster or unsupported; `has_preamble` decides for paths without suffix."""
    suffix = path_suffix(path)
    by_content = F.coalesce(has_preamble if has_preamble is not None else F.lit(False), F.lit(False))
    return F.when(suffix.isin(DICOM_SUFFIXES), "dicom").when(suffix.isin(RASTER_SUFFIXES), "raster").when((suffix == "") & by_content, "dicom").otherwise("unsupported")


def has_dicom_preamble(content: Column) -> Column:
    """Bytes 128 to 131 of a binary column are DICM."""
    return F.coalesce(F.substring(content, 129, 4) == F.lit(b"DICM"), F.lit(False))


def patient_id_status(value: Column) -> Column:
    """missing, dummy or usable."""
    compact = F.translate(F.lower(F.regexp_replace(value, r"(?U)[\s_./-]+", "")), "\u017f", "s")
    for joined, letters in (("\ufb01", "fi"), ("\ufb05", "st"), ("\ufb06", "st")):  # what case folding takes apart
        compact = F.replace(compact, F.lit(joined), F.lit(letters))
    return F.when(value.isNull(), "missing").when(compact.isin(DUMMY_PATIENT_IDS) | compact.rlike(r"\A(0+|x+)\z"), "dummy").otherwise("usable")


def valid_uid(value: Column) -> Column:
    """The UID, or null if it has not a UID's form."""
    return F.when((F.length(value) <= UID_LENGTH) & value.rlike(rf"\A{UID_PATTERN}\z"), value)


def frames(value: Column) -> Column:
    """Number of frames, or null if the text is no number."""
    return F.trim(value).try_cast("bigint")


def component_id(rule_id: Column, aliases: Column) -> Column:
    """Short hash of a rule and its sorted record aliases."""
    return F.concat(F.lit("component-"), F.substring(F.sha2(F.concat_ws("\u001f", rule_id, aliases), 256), 1, 16))


def record_alias(ordinal: Column, width: int) -> Column:
    return F.format_string(f"record-%0{width}d", ordinal)


def alias_width(records: int) -> int:
    return max(6, len(str(records)))
