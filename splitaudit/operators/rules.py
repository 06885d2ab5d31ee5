"""The table of checks.  A check is a nullable key, an eligibility and what its findings say."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

VERSION = "1"


@dataclass(frozen=True)
class Rule:
    rule_id: str
    key: str  # catalog column, null where there is no evidence
    category: str
    strength: str
    observed: str  # format of (records, splits)
    method: str
    explanation: str
    limitation: str
    recommendation: str
    by_content: bool = False

    def eligible(self) -> Column:
        return F.col("supported") if self.by_content else F.col("media_type") == "dicom"

    def evaluated(self) -> Column:
        return self.eligible() & F.col(self.key).isNotNull()

    def reasons(self) -> Column:
        """Why an eligible record has no evidence: an array, empty for others."""
        none = F.array().cast("array<string>")
        if self.by_content:
            why = F.transform(F.filter("issues", lambda i: i["category"] == "unreadable"), lambda i: i["code"])
        elif self.rule_id == "ML101":
            why = F.array(F.when(F.col("patient_id_status").isNull(), "dicom_metadata_unavailable").otherwise(F.concat(F.lit("patient_id_"), F.col("patient_id_status"))))
        else:
            why = F.array(F.when(F.col("patient_id_status").isNull(), "dicom_metadata_unavailable").otherwise("identifier_missing_or_invalid"))
        return F.when(self.eligible() & F.col(self.key).isNull(), why).otherwise(none)


def _identifier(rule_id: str, key: str, category: str, strength: str, label: str, explanation: str, limitation: str) -> Rule:
    return Rule(
        rule_id,
        key,
        category,
        strength,
        f"%d DICOM records in %d splits share the same usable {label}.",
        f"Exact normalized {label} equality",
        explanation,
        limitation,
        "Review the related source records and intended split policy before model training.",
    )


#: Ids, categories and wording are part of the report's contract.
RULES = [
    Rule(
        "ML001",
        "file_sha256",
        "exact_file_content_relationship",
        "exact_content_match",
        "%d records in %d splits have identical file bytes.",
        "SHA-256 over the complete stored file bytes",
        "The same byte content was observed in more than one declared split, which is a potential split-contamination risk.",
        "This proves an exact content relationship, not patient identity; it does not detect files rewritten with different metadata or encoding.",
        "Review the source records and split assignment before model training.",
        by_content=True,
    ),
    _identifier(
        "ML101",
        "patient_group_token",
        "authoritative_group_relationship",
        "scoped_identifier_match",
        "source/issuer-scoped PatientID",
        "A usable PatientID within the same declared source and issuer scope appears in more than one split, which may conflict with a new-patient evaluation design.",
        "PatientID is an administrative identifier, may be reused or regenerated, and does not prove a person's real-world identity.",
    ),
    _identifier(
        "ML102",
        "study_uid_token",
        "acquisition_identifier_relationship",
        "acquisition_identifier_match",
        "StudyInstanceUID",
        "The same DICOM study identifier appears in more than one split, which indicates a shared acquisition-level relationship.",
        "A StudyInstanceUID identifies a study, not a real-world patient, and incorrect or regenerated UIDs remain possible.",
    ),
    _identifier(
        "ML103",
        "series_uid_token",
        "acquisition_identifier_relationship",
        "acquisition_identifier_match",
        "SeriesInstanceUID",
        "The same DICOM series identifier appears in more than one split, which indicates a shared series-level relationship.",
        "A SeriesInstanceUID identifies a series, not a real-world patient, and incorrect or regenerated UIDs remain possible.",
    ),
    _identifier(
        "ML104",
        "sop_uid_token",
        "acquisition_identifier_relationship",
        "acquisition_identifier_match",
        "SOPInstanceUID",
        "The same DICOM object identifier appears in more than one split, which indicates a shared instance-level relationship.",
        "A SOPInstanceUID identifies a DICOM object, not a real-world patient, and incorrect or regenerated UIDs remain possible.",
    ),
]
BY_ID = {r.rule_id: r for r in RULES}

#: What each issue code is told as.
MESSAGES = {
    "dicom_modality_missing": "The DICOM modality is missing, so the v0.1 primary profile could not be confirmed.",
    "dicom_modality_outside_primary_profile": "The DICOM modality is outside the v0.1 primary CR/DX profile.",
    "dicom_multiframe_inventory": "A multi-frame DICOM object was inventoried outside the v0.1 primary profile.",
    "dicom_parse_failed": "DICOM metadata could not be parsed.",
    "dicom_structure_missing": "The file did not contain recognizable DICOM structure.",
    "empty_declared_split": "At least one declared split contained no discovered record.",
    "file_hash_failed": "The file could not be read for exact fingerprinting.",
    "file_probe_failed": "The extensionless file could not be inspected for a DICOM preamble.",
    "insufficient_evaluable_splits": "Fewer than two splits contained records evaluable by the active checks.",
    "insufficient_split_count": "A split-integrity audit requires at least two distinct splits.",
    "non_regular_file": "A non-regular filesystem entry was not inspected.",
    "path_missing": "A declared input path does not exist.",
    "patient_id_dummy": "The PatientID was excluded because it is a common dummy value.",
    "patient_id_missing": "No PatientID was available for this DICOM record.",
    "symlink_not_followed": "A symbolic link was inventoried but not followed or inspected.",
    "unsupported_file_type": "The file type is not supported by v0.1 detectors.",
}
UNKNOWN_MESSAGE = "Evidence was unavailable for this record."
#: Issue codes of the dataset as a whole.
DATASET_CODES = ("insufficient_split_count", "empty_declared_split", "insufficient_evaluable_splits")
