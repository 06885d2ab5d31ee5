"""Audits of files: the cases of the report's contract."""

import json
import os
from pathlib import Path

import pytest
from dicom_files import ROOT, data_set, deflated, part10, write_dicom

from splitaudit import AuditConfig, DatasetSpec, SplitSpec, audit, audit_manifest, audit_split_roots, terminal_summary, write_json
from splitaudit.cli import main
from splitaudit.sources import dicom_reader
from splitaudit.sources.inspect import Tokenizer, classify, clean_text, number_of_frames, patient_id_status, valid_uid


@pytest.fixture
def roots(spark, tmp_path):
    for name in ("train", "test"):
        (tmp_path / name).mkdir()
    return tmp_path


def run(root: Path, config=None, **namespaces):
    names = sorted(p.name for p in root.iterdir() if p.is_dir())
    return audit_split_roots([SplitSpec(n, root / n, namespaces.get(n, "local")) for n in names], config)


def rules(result):
    return [f.rule_id for f in result.findings]


def put(root: Path, **files: bytes) -> None:
    for place, data in files.items():
        split, name = place.split("__")
        (root / split / name.replace("_dot_", ".")).write_bytes(data)


def test_exact_duplicate_matches_the_published_report(roots):
    put(roots, train__first_dot_png=b"golden", test__renamed_dot_png=b"golden")
    result = run(roots)
    assert rules(result) == ["ML001"] and result.exit_code == 1 and result.audit_state == "complete_with_findings"
    found = result.findings[0].shown()
    assert found["component_id"] == "component-5d7a4195e4bf862d"
    assert found["record_aliases"] == ["record-000001", "record-000002"] and found["splits"] == ["test", "train"]
    assert result.config_digest == "b95844b91e6029e87c26b415979760b5c19875c2c3a90c0a75727c7f8ebdf8f0"
    assert [d["detector_id"] for d in result.to_dict()["coverage"]["detectors"]] == ["ML001", "ML101", "ML102", "ML103", "ML104"]
    assert set(result.to_dict()) == {"audit_state", "config_digest", "coverage", "coverage_status", "diagnostics", "finding_status", "findings", "policy", "provenance", "schema_version", "splits", "tool_version"}
    assert run(roots).to_json() == result.to_json()


def test_clean_partial_and_finding_with_gap(roots):
    put(roots, train__a_dot_png=b"1", test__b_dot_png=b"2")
    assert (run(roots).coverage_status, run(roots).exit_code) == ("complete", 0)
    put(roots, test__notes_dot_txt=b"x")
    result = run(roots)
    assert (result.coverage_status, result.exit_code, result.catalog_coverage.unsupported) == ("partial", 3, 1)
    assert [d.code for d in result.diagnostics] == ["unsupported_file_type"]
    put(roots, test__c_dot_png=b"1")
    result = run(roots)
    assert (result.coverage_status, result.exit_code, rules(result)) == ("partial", 1, ["ML001"])


def test_too_few_and_empty_splits(roots):
    put(roots, train__a_dot_png=b"1")
    result = run(roots)
    assert result.coverage_status == "inconclusive" and result.exit_code == 3
    assert dict(result.catalog_coverage.issue_counts) == {"empty_declared_split": 1, "insufficient_evaluable_splits": 1}
    (roots / "validation").mkdir()
    put(roots, validation__b_dot_png=b"2")
    assert run(roots).coverage_status == "partial"


def test_listing_loses_nothing(roots):
    put(roots, train___dot_hidden_dot_png=b"1", train___under_dot_png=b"", test__a_dot_png=b"1")
    (roots / "train" / "_dir").mkdir()
    (roots / "train" / "_dir" / "x.png").write_bytes(b"3")
    (roots / "outside").mkdir()
    (roots / "train" / "link.png").symlink_to(roots / "test" / "a.png")
    (roots / "train" / "linkdir").symlink_to(roots / "outside")
    (roots / "train" / "broken.png").symlink_to(roots / "nothing")
    os.mkfifo(roots / "train" / "pipe.png")
    (roots / "outside").rmdir()
    result = run(roots)
    assert result.catalog_coverage.discovered == 8
    assert dict(result.catalog_coverage.issue_counts) == {"non_regular_file": 1, "symlink_not_followed": 3}
    assert rules(result) == ["ML001"]


def test_operational_errors_hold_no_path(spark, tmp_path):
    result = audit_split_roots([SplitSpec("train", tmp_path / "secret-place"), SplitSpec("test", tmp_path)])
    assert result.exit_code == 2 and result.audit_state == "operational_error" and result.splits == ("test", "train")
    assert "secret" not in result.to_json()
    result = audit(DatasetSpec.from_split_roots([SplitSpec("a", tmp_path)]), AuditConfig(enabled_detector_ids=("ML999",)))
    assert result.diagnostics[0].code == "unknown_detector_configuration"


def test_identifiers(roots):
    write_dicom(roots / "train" / "a.dcm")
    write_dicom(roots / "test" / "b.dcm", StudyInstanceUID=f"{ROOT}.2", SeriesInstanceUID=f"{ROOT}.2.1", SOPInstanceUID=f"{ROOT}.2.1.1")
    result = run(roots)
    assert rules(result) == ["ML101"] and "PATIENT-001" not in result.to_json() + terminal_summary(result)
    assert rules(run(roots, train="one", test="two")) == []
    write_dicom(roots / "test" / "b.dcm", PatientID="OTHER")
    assert rules(run(roots)) == ["ML102", "ML103", "ML104"]


def test_missing_and_dummy_identifiers_and_profile(roots):
    write_dicom(roots / "train" / "a.dcm", PatientID=None, SOPInstanceUID=f"{ROOT}.8", Modality="CT")
    write_dicom(roots / "test" / "b", PatientID="ANON", StudyInstanceUID="1.02", SeriesInstanceUID=f"{ROOT}.3", NumberOfFrames="2")
    result = run(roots)
    by_id = {d["detector_id"]: d for d in result.detector_coverage}
    assert by_id["ML101"]["unavailable_records"] == 2
    assert by_id["ML101"]["reason_counts"] == [{"reason": "patient_id_dummy", "count": 1}, {"reason": "patient_id_missing", "count": 1}]
    assert by_id["ML102"]["reason_counts"] == [{"reason": "identifier_missing_or_invalid", "count": 1}]
    assert result.catalog_coverage.outside_primary_profile == 2 and result.catalog_coverage.dicom_identity_incomplete == 2


def test_damaged_dicom_still_has_a_fingerprint(roots):
    put(roots, train__a_dot_dcm=b"not a dicom object", test__b_dot_dcm=b"not a dicom object")
    result = run(roots)
    assert rules(result) == ["ML001"] and result.catalog_coverage.dicom_parsed == 0 and result.coverage_status == "partial"


def test_manifest(spark, tmp_path):
    (tmp_path / "image.png").write_bytes(b"1")
    manifest = tmp_path / "m.csv"
    manifest.write_text("﻿path,split,source_namespace,extra\nimage.png,train,site-a,x\nimage.png,test,,y\ngone.png,test,,\n", encoding="utf-8")
    result = audit_manifest(manifest)
    assert result.catalog_coverage.discovered == 3 and rules(result) == ["ML001"]
    assert [d.code for d in result.diagnostics] == ["path_missing"]
    for text in ("file,group\n", "path,split\n,train\n", 'path,split\na.png,"tr\x1b[2J"\n', 'path,split,source_namespace\na.png,train," "\n', ""):
        manifest.write_text(text)
        assert audit_manifest(manifest).diagnostics[0].code == "discovery_failed"
    manifest.write_bytes(b"path,split\nimage-\xff.png,train\n")
    assert audit_manifest(manifest).exit_code == 2
    manifest.write_text("path,split\n")
    assert audit_manifest(manifest).coverage_status == "inconclusive"


def test_writer_guards_inputs(roots, tmp_path_factory):
    put(roots, train__a_dot_png=b"1", test__b_dot_png=b"1")
    result = run(roots)
    with pytest.raises(ValueError):
        write_json(result, roots / "train" / "report.json")
    place = tmp_path_factory.mktemp("out") / "report.json"
    write_json(result, place, include_paths=True)
    report = json.loads(place.read_text())
    assert place.read_text().endswith("}\n") and len(report["record_paths"]) == 2
    assert [p.name for p in place.parent.iterdir()] == ["report.json"]


def test_command_line(roots, tmp_path_factory, capsys):
    put(roots, train__a_dot_png=b"1", test__b_dot_png=b"1")
    place = tmp_path_factory.mktemp("out") / "report.json"
    arguments = ["audit", "--split", f"train={roots / 'train'}", "--split", f"test={roots / 'test'}"]
    assert main([*arguments, "--output", str(place)]) == 1 and place.exists()
    assert main([*arguments, "--output", str(roots / "train" / "x.json")]) == 2
    assert "Potential contamination risk" in capsys.readouterr().out
    for bad in (["audit"], ["audit", "--split", "x"], ["audit", "--split", "a\x1b=/tmp"]):
        with pytest.raises(SystemExit):
            main(bad)


def test_transfer_syntaxes_and_sequences():
    want = {"PatientID": "PATIENT-001", "Modality": "DX", "Rows": 1}
    nested = b"\x40\x00\x75\x02SQ\0\0\xff\xff\xff\xff\xfe\xff\x00\xe0\xff\xff\xff\xff\x10\x00\x20\x00LO\x02\x00XX\xfe\xff\x0d\xe0\0\0\0\0\xfe\xff\xdd\xe0\0\0\0\0"
    pixels = b"\xe0\x7f\x10\x00OW\0\0\xff\xff\xff\x7f"
    for data in (
        part10("1.2.840.10008.1.2.1", data_set(extra=nested + pixels)),
        part10("1.2.840.10008.1.2", data_set(explicit=False)),
        part10("1.2.840.10008.1.2.2", data_set(order=">")),
        part10("1.2.840.10008.1.2.1.99", deflated(data_set())),
        data_set(),
        data_set(explicit=False),
    ):
        found = dicom_reader.read_metadata(data)
        assert {k: found[k] for k in want} == want
    with pytest.raises(ValueError):
        dicom_reader.read_metadata(part10("1.2.840.10008.1.2.1", data_set())[:-3])


def test_scalars(tmp_path):
    assert [patient_id_status(v) for v in (None, "0", "A-N.O_N", "x/x", "---", "P1")] == ["missing", "dummy", "dummy", "dummy", "usable", "usable"]
    assert clean_text(" Ａ\0 ") == "A" and clean_text("　") is None
    assert valid_uid("1.2.0") == "1.2.0" and valid_uid("1.02") is None and valid_uid("1" * 65) is None
    assert number_of_frames("1_0") == 10 and number_of_frames("x") is None
    assert classify(b"/x/.png") == ("unreadable", "file_probe_failed") and classify(b"/x/A.DCM") == ("dicom", None)
    with pytest.raises(ValueError):
        Tokenizer(b"short")
    assert Tokenizer(b"k" * 16).token("a", "b") != Tokenizer(b"k" * 16).token("a\x1fb", "")


@pytest.mark.parametrize("make", [lambda: SplitSpec(" ", "x"), lambda: SplitSpec("a", "x", "\n"), lambda: DatasetSpec(), lambda: AuditConfig(enabled_detector_ids=()), lambda: AuditConfig(file_hash_algorithm="md5"), lambda: AuditConfig(file_hash_chunk_bytes=0)])
def test_bad_configuration(make):
    with pytest.raises(ValueError):
        make()
