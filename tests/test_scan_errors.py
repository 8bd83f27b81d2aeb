"""Errors of a scanned tree: all are listed, and what a report leaves out is counted."""

from siltgauge.plans import scan


def test_no_error_is_dropped_silently(spark, tmp_path, monkeypatch):
    for k in range(1005):
        (tmp_path / f"broken{k:04}.py").write_text("def f(:\n")
    (tmp_path / "good.py").write_text("x = 1\n")
    report = scan.scan(spark, str(tmp_path))
    assert report.files_skipped == 1005 and len(report.errors) == 1005 and "broken1004.py" in report.errors[-1]
    monkeypatch.setattr(scan, "MOST_ERRORS", 10)
    report = scan.scan(spark, str(tmp_path))
    assert len(report.errors) == 11 and report.errors[-1] == "995 more files with errors are not listed"
