"""Rows without an id, and licences in other versions."""

import hashlib

from codeweft.llm import license_scan, line_dedup
from codeweft.llm.queries import QUERIES

NOTICE = "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."
TEXT = "one whole line of some words here\n\nanother line that stays"


def test_rows_without_ids(spark, tmp_path):
    rows = [(None, TEXT), (None, None), (1, TEXT), (2, TEXT + "\n" + license_scan.TEMPLATES["MIT"]), (None, license_scan.TEMPLATES["MIT"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    kept = {(r.doc_id, r.text) for r in line_dedup.without_lines(docs, line_dedup.line_dedup(docs)).collect()}
    assert {(None, TEXT), (None, None), (1, TEXT)} <= kept
    digest = lambda numbers: hashlib.sha256(numbers.encode()).hexdigest()
    lines = sorted((r.doc_id or 0, r.n_lines, r.n_removed, r.kept_sha256) for r in QUERIES["op8_line_dedup"](spark, str(tmp_path)).collect())
    assert lines[:4] == sorted([(0, 0, 0, digest("")), (0, 3, 0, digest("0,2")), (0, 1, 0, digest("0")), (1, 3, 0, digest("0,2"))])
    assert lines[4][2] == 2
    found = [(r.doc_id, r.licenses) for r in QUERIES["op10_license_scan"](spark, str(tmp_path)).collect()]
    assert len(found) == len(rows) and (2, "MIT") in found and (1, "") in found and (None, "MIT") in found


def test_other_versions_are_other_licences(spark):
    texts = dict(license_scan.TEMPLATES)
    texts |= {f"{name} {k}": text for name, several in license_scan.NOTICES.items() for k, text in enumerate(several)}
    versioned = {name: text for name, text in texts.items() if license_scan.numbers(license_scan.template_bigrams(text))}
    assert len(versioned) > 5
    swap = str.maketrans("0123456789", "7777777777")
    rows = [(k, text.translate(swap)) for k, text in enumerate(versioned.values())] + [(1000 + k, text) for k, text in enumerate(versioned.values())]
    rows += [(2000 + k, f"Some words before. {text.translate(swap)} And some words behind it, on the same line.") for k, text in enumerate(versioned.values())]
    got = {r.doc_id: r.license for r in license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    names = list(versioned)
    assert {k for k in got if k >= 1000 and k < 2000} == {1000 + k for k in range(len(names))}
    wrong = {names[k % 1000]: got[k] for k in got if not 1000 <= k < 2000 and license_scan.numbers(license_scan.template_bigrams(texts.get(got[k], texts.get(f"{got[k]} 0", ""))))}
    assert not wrong
