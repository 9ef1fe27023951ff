import copy
import hashlib
import json

import pytest

from inkwell.operators import ledger

SOURCE = "\n".join(f"line {i}" for i in range(1, 7))


def entry(n, first, last, **kw):
    base = {"block_id": f"B{n:03d}", "source_locator": f"L{first}-L{last}", "class": "shareable", "action": "keep", "confidence": "high", "review_state": "approved", "reason_codes": ["public-approved"], "proposal_bucket": "safe", "destinations": ["team"]}
    return base | kw


QUARANTINE = {"class": "quarantine", "action": "omit", "review_state": "blocked", "reason_codes": ["credentials"], "proposal_bucket": "excluded", "destinations": []}
PERSONAL = {"class": "personal", "action": "omit", "review_state": "blocked", "reason_codes": ["personal-data"], "proposal_bucket": "excluded", "destinations": []}
RESTRICTED = {"class": "restricted", "action": "generalize", "review_state": "borderline-review", "reason_codes": ["planning-resourcing"], "proposal_bucket": "individual-review"}
KEPT_OUT = {"class": "restricted", "action": "omit", "review_state": "blocked", "reason_codes": ["planning-resourcing"], "proposal_bucket": "excluded", "destinations": []}


def document(**kw):
    entries = [entry(1, 1, 1), entry(2, 2, 2, **QUARANTINE), entry(3, 3, 3, **PERSONAL), entry(4, 4, 4, **RESTRICTED), entry(5, 5, 6, **KEPT_OUT)]
    return {"taxonomy_version": "2026-09-10", "source_sha256": hashlib.sha256(SOURCE.encode()).hexdigest(), "source_line_count": 6, "entries": entries} | kw


def change(n, **kw):
    d = copy.deepcopy(document())
    d["entries"][n - 1] |= kw
    return d


def drop(n, key):
    d = copy.deepcopy(document())
    del d["entries"][n - 1][key]
    return d


CASES = {
    "valid": (document(), set()),
    "no object": ([], {("$ledger", "ledger-object")}),
    "no json": (None, {("$ledger", "ledger-object")}),
    "fields": (document(more=1), {("$ledger", "ledger-fields")}),
    "taxonomy": (document(taxonomy_version="x"), {("$ledger", "taxonomy-version")}),
    "taxonomy kind": (document(taxonomy_version=1), {("$ledger", "taxonomy-version")}),
    "sha": (document(source_sha256="0" * 64), {("$ledger", "source-sha256")}),
    "count": (document(source_line_count=5), {("$ledger", "source-line-count")}),
    "count kind": (document(source_line_count=True), {("$ledger", "source-line-count")}),
    "count float": (document(source_line_count=6.5), {("$ledger", "source-line-count")}),
    "entries": (document(entries=[]), {("$ledger", "entries-list")}),
    "entries kind": (document(entries={"a": 1}), {("$ledger", "entries-list")}),
    "entry object": (document(entries=[*document()["entries"], 7]), {("$entry-6", "entry-object")}),
    "missing field": (drop(1, "confidence"), {("B001", "required-fields"), ("B001", "confidence-value"), ("B001", "safe-confidence")}),
    "more fields": (change(1, note="x"), {("B001", "required-fields")}),
    "duplicate": (change(2, block_id="B001"), {("B001", "duplicate-block-id"), ("B001", "block-sequence")}),
    "block id": (change(1, block_id=" "), {(" ", "block-id"), (" ", "block-sequence")}),
    "block id kind": (change(1, block_id=5), {("$entry-1", "block-id"), ("$entry-1", "block-sequence")}),
    "sequence": (change(1, block_id="B009"), {("B009", "block-sequence")}),
    "locator": (change(5, source_locator="L05-L6"), {("B005", "source-locator-format"), ("$ledger", "source-coverage-gap")}),
    "locator kind": (change(5, source_locator=[1]), {("B005", "source-locator-format"), ("$ledger", "source-coverage-gap")}),
    "range": (change(5, source_locator="L6-L5"), {("B005", "source-locator-range"), ("$ledger", "source-coverage-gap")}),
    "gap": (change(2, source_locator="L3-L3"), {("B002", "source-coverage-gap"), ("B003", "source-coverage-overlap")}),
    "overlap": (change(2, source_locator="L1-L2"), {("B002", "source-coverage-overlap")}),
    "bounds": (change(5, source_locator="L5-L7"), {("B005", "source-locator-bounds")}),
    "huge": (change(5, source_locator="L5-L" + "9" * 40), {("B005", "source-locator-bounds")}),
    "tail": (change(5, source_locator="L5-L5"), {("$ledger", "source-coverage-gap")}),
    "class": (change(1, **{"class": "x"}), {("B001", "class-value"), ("B001", "safe-class")}),
    "action": (change(1, action="x"), {("B001", "action-value"), ("B001", "shareable-action")}),
    "action kind": (change(1, action=["keep"]), {("B001", "action-value"), ("B001", "shareable-action")}),
    "confidence": (change(3, confidence="x"), {("B003", "confidence-value")}),
    "review": (change(3, review_state="x"), {("B003", "review-state-value"), ("B003", "personal-review")}),
    "bucket": (change(3, proposal_bucket="x"), {("B003", "proposal-bucket-value"), ("B003", "personal-bucket")}),
    "bucket null": (change(3, proposal_bucket=None), {("B003", "proposal-bucket-value"), ("B003", "personal-bucket")}),
    "bucket absent": (drop(3, "proposal_bucket"), set()),
    "reasons empty": (change(3, reason_codes=[]), {("B003", "reason-codes")}),
    "reasons kind": (change(3, reason_codes=["personal-data", 1]), {("B003", "reason-codes")}),
    "reasons twice": (change(3, reason_codes=["personal-data", "personal-data"]), {("B003", "reason-codes")}),
    "reasons unknown": (change(3, reason_codes=["zzz"]), {("B003", "reason-codes")}),
    "reason class": (change(3, reason_codes=["credentials"]), {("B003", "reason-class")}),
    "reason class safe": (change(1, reason_codes=["harm-risk"]), {("B001", "reason-class")}),
    "destinations": (change(1, destinations=["elsewhere"]), {("B001", "destinations-value"), ("B001", "safe-destination")}),
    "destinations twice": (change(1, destinations=["team", "team"]), {("B001", "destinations-value"), ("B001", "safe-destination")}),
    "destinations kind": (change(1, destinations="team"), {("B001", "destinations-value"), ("B001", "safe-destination")}),
    "quarantine action": (change(2, action="keep"), {("B002", "quarantine-action")}),
    "quarantine rest": (change(2, review_state="approved", proposal_bucket="safe", destinations=["team"]), {("B002", x) for x in ("quarantine-review", "quarantine-bucket", "quarantine-destination", "safe-class", "safe-action", "reason-class")}),
    "personal action": (change(3, action="anonymize"), {("B003", "personal-action")}),
    "personal rest": (change(3, review_state="approved", destinations=["team"]), {("B003", "personal-review"), ("B003", "personal-destination")}),
    "restricted": (change(4, action="keep", review_state="approved", destinations=[]), {("B004", x) for x in ("restricted-action", "restricted-review", "restricted-destination", "individual-review-state", "individual-review-destination", "individual-review-action")}),
    "restricted bucket": (change(4, proposal_bucket="safe", review_state="approved", reason_codes=["planning-resourcing"]), {("B004", x) for x in ("restricted-review", "restricted-bucket", "safe-class", "reason-class")}),
    "restricted excluded": (change(5, action="generalize", review_state="approved", destinations=["team"]), {("B005", "restricted-excluded-action"), ("B005", "restricted-excluded-review"), ("B005", "restricted-excluded-destination")}),
    "shareable excluded": (change(1, proposal_bucket="excluded"), {("B001", "shareable-excluded-action"), ("B001", "shareable-excluded-review"), ("B001", "shareable-excluded-destination")}),
    "low confidence": (change(1, confidence="low"), {("B001", "low-confidence-review"), ("B001", "borderline-bucket"), ("B001", "safe-confidence")}),
    "borderline": (change(3, review_state="borderline-review"), {("B003", "personal-review"), ("B003", "borderline-bucket")}),
    "safe review": (change(1, review_state="blocked"), {("B001", "safe-review")}),
    "safe action": (change(1, action="omit"), {("B001", "safe-action")}),
}


@pytest.fixture(scope="module")
def tables(spark):
    rows = [(k, "not json {" if d is None else json.dumps(d)) for k, (d, _) in CASES.items()]
    ledgers = spark.createDataFrame(rows, "ledger_id string, json string")
    return ledgers, spark.createDataFrame([(k, SOURCE) for k in CASES], "ledger_id string, text string")


@pytest.fixture(scope="module")
def errors(tables):
    out = {k: set() for k in CASES}
    for r in ledger.validate(*tables, destinations=["team"]).collect():
        out[r.ledger_id].add((r.block_id, r.rule))
    return out


@pytest.mark.parametrize("case", CASES)
def test_case(errors, case):
    assert errors[case] == CASES[case][1]


def test_waiver_without_destinations(spark):
    """Without configured destinations, approved blocks may stay excluded."""
    e = [entry(1, 1, 3, action="keep", proposal_bucket="excluded", destinations=[]), entry(2, 4, 6, **KEPT_OUT | {"action": "generalize", "review_state": "approved"})]
    ledgers = spark.createDataFrame([("a", json.dumps(document(entries=e)))], "ledger_id string, json string")
    assert ledger.validate(ledgers, spark.createDataFrame([("a", SOURCE)], "ledger_id string, text string")).collect() == []


def test_exit_codes(tables):
    bad = ledger.validate(*tables, destinations=["team"])
    blocked = ledger.blocked_blocks(*tables, bad)
    codes = {r.ledger_id: r.exit_code for r in ledger.exit_codes(tables[0], bad, blocked).collect()}
    assert codes == {k: 2 if want else 3 for k, (_, want) in CASES.items()}
    assert {r.ledger_id: r.blocks for r in blocked.collect()}["valid"] == ["B002"]
