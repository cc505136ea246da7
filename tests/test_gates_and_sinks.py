"""Decoder contracts, report options, sinks of any size, generated ledgers and codecs."""

import json

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import codecs, labels, money
from ledgerloom.operators import candidates, contract, dispositions, evidence, families, hierarchy, outputs, reports, rows
from ledgerloom.operators.gates import LedgerError, bounded_broadcast
from ledgerloom.sinks import reports as sinks
from ledgerloom.sources import native, text
from tests.test_ledger import END, accounts, book, entries  # noqa: F401

META = sinks.Metadata("acme", END, "books.bin", "1", "2024-01-01T00:00:00Z")


def test_report_options():
    outputs.check_options("profit_and_loss", 9, start=3)
    outputs.check_options("general_ledger", 9, start=3, zero_activity=True)
    outputs.check_options("trial_balance", 9, fiscal_start=1, retained_account="kept", zero_accounts=True)
    for check, kind, more in (
        ("start_is_required", "profit_and_loss", {}), ("start_does_not_apply", "general_ledger", {"start": 1}), ("start_after", "profit_and_loss", {"start": 10}), ("unknown_report", "cash_flow", {}),
        ("zero_activity", "trial_balance", {"zero_activity": True}), ("fiscal_policy_is_required", "balance_sheet", {}), ("fiscal_start_after", "trial_balance", {"fiscal_start": 10, "retained_account": "kept"}),
        ("blank", "trial_balance", {"fiscal_start": 1, "retained_account": "kept", "retained_name": " "}), ("does_not_apply", "general_ledger", {"fiscal_start": 1}), ("zero_accounts", "general_ledger", {"zero_accounts": True}),
    ):
        with pytest.raises(LedgerError, match=check):
            outputs.check_options(kind, 9, **more)


def test_ledger_of_a_decoder(spark, book):  # noqa: F811
    made = book.postings.where("current_state = 'Current'").withColumns({"table_id": F.lit(3078), "disposition": F.when(F.col("posting_id") == "e0-d", "canonical_zero").otherwise("posting")})
    n = made.count()
    cover = spark.createDataFrame([(3078, n, n)], "table_id int, recognized long, handled long")
    built = contract.ledger_of(book.accounts, made, cover, ("a", "a"))
    assert built.postings.count() == n - 1 and built.zero_activity.count() == 1 and "signed_minor_units" not in built.zero_activity.columns
    with pytest.raises(LedgerError, match="snapshot_mismatch"):
        contract.ledger_of(book.accounts, made, cover, ("a", "b"))
    for bad, check in ((cover.union(cover), "duplicate_table"), (spark.createDataFrame([(3078, n + 1, n)], cover.schema), "coverage_mismatch"), (spark.createDataFrame([(3078, n + 1, n + 1)], cover.schema), "materialized_count")):
        with pytest.raises(LedgerError, match=check):
            contract.ledger_of(book.accounts, made, bad, ("a", "a"))
    shown = reports.zero_activity(built, END, validate=False).collect()
    assert [(r.posting_id, r.signed_minor_units) for r in shown] == [("e0-d", None)]
    assert contract.same_set(cover, cover.union(cover)) and not contract.same_set(cover, cover.limit(0))


def test_outputs_are_checked(book):  # noqa: F811
    report = reports.general_ledger(book, END).withColumn("entry_account_id", F.col("account_id"))
    outputs.validate_general_ledger(report, END)
    with pytest.raises(LedgerError, match="after_as_of"):
        outputs.validate_general_ledger(report, END - 1)
    trial = reports.trial_balance(book, END, validate=False)
    outputs.validate_trial_balance(trial)
    with pytest.raises(LedgerError, match="duplicate_account"):
        outputs.validate_trial_balance(trial.union(trial))
    chart = book.accounts.select("account_id", "account_name")
    assert outputs.merged_chart(chart, chart.limit(3)).count() == chart.count()
    with pytest.raises(LedgerError, match="conflicting_account"):
        outputs.merged_chart(chart, chart.limit(1).withColumn("account_name", F.lit("other")))


def test_one_key_one_candidate_one_plan(spark):
    seen = lambda *r: spark.createDataFrame(list(r), "page int, key int")
    assert candidates.the_key(seen((1, 7), (2, 7), (3, 7), (4, 7), (4, 8))) == 7
    with pytest.raises(LedgerError, match="too_few"):
        candidates.the_key(seen((1, 7), (2, 7)))
    with pytest.raises(LedgerError, match="conflicting"):
        candidates.the_key(seen((1, 7), (2, 7), (3, 7), (4, 8)))
    one = spark.createDataFrame([(5,)], "candidate int")
    assert candidates.only_candidate(one.union(one)) == 5
    with pytest.raises(LedgerError, match="no_unique"):
        candidates.only_candidate(one.limit(0))

    def fails():
        raise LedgerError("first")

    assert candidates.try_in_turn(fails, lambda: one).count() == 1
    with pytest.raises(LedgerError, match="first"):
        candidates.try_in_turn(fails)
    assert candidates.storage_layouts(spark).count() == 5 * 1 * 4 * 2 * 4 * 6
    columns = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (2, 1, "c")], "table_id int, column_id int, name string")
    tables = spark.createDataFrame([(1, "t"), (2, "u"), (3, "u")], "table_id int, name string")
    assert [r.name for r in candidates.schema_of(columns, tables, "t").collect()] == ["a", "b"]
    with pytest.raises(LedgerError, match="no_unique_table"):
        candidates.schema_of(columns, tables, "u")
    unparsed = spark.createDataFrame([(2,)], "table_id int")
    assert {tuple(r) for r in candidates.required_tables(tables, unparsed, [1, 2, 9]).collect()} == {("unknown_table", "9"), ("may_conflict", "2")}


def test_zero_terminals_and_journals(spark):
    row = "master int, target int, account int, next int, sibling int, date int, view int, cents long, is_source boolean, is_no_post boolean, is_memorized boolean, is_split boolean, is_arap boolean"
    pair = [(1, 10, 5, 11, 6, 3, 1, 0, True, False, False, True, True), (1, 11, 6, 12, 5, 3, 1, 0, False, False, False, True, True)]
    last = [(1, 12, None, None, 5, 3, 1, None, False, False, False, True, True)]
    heads = spark.createDataFrame([(1,)], "master int")
    found = lambda r, c: [x.target for x in families.zero_terminals(spark.createDataFrame(c, row), spark.createDataFrame(r, row), heads).collect()]
    assert found(pair, last) == [12]
    assert found(pair, [(*last[0][:4], 6, *last[0][5:])]) == [] and found(pair + [(2, 10, *pair[0][2:])], last) == []
    own = spark.createDataFrame([(1, 5, False, False), (2, 0, False, False), (3, None, False, False), (4, 5, True, False)], "target int, cents int, is_no_post boolean, is_memorized boolean")
    links = spark.createDataFrame([(7, 1), (8, None)], "target int, terminal int")
    chains = spark.createDataFrame([(9, "chain"), (10, "broken")], "target int, outcome string")
    got = {r.target: r.disposition for r in families.journal_dispositions(own, links, chains).collect()}
    assert got == {1: "posting", 2: "canonical_zero", 3: "unresolved", 4: "no_post", 7: "source", 8: "unresolved", 9: "source", 10: "unresolved"}
    checks = spark.createDataFrame([(1, 0), (2, 9)], "target int, cents int")
    rest = spark.createDataFrame([(3,)], "target int")
    assert {r.target: r.disposition for r in families.check_dispositions(checks, rest, rest.limit(0)).collect()} == {1: "canonical_zero", 2: "posting", 3: "source"}


def test_links_longer_than_any_fixed_depth(spark):
    n = 300
    nodes = spark.createDataFrame([(1, i, i + 1, i == n) for i in range(n + 1)] + [(2, 0, 1, False), (2, 1, 0, False), (2, 2, 9, False)], "master int, node int, next int, is_terminal boolean")
    got = {(r.master, r.node): r.terminal for r in dispositions.resolve_links(nodes).collect()}
    assert all(got[1, i] == n for i in range(n + 1)) and got[2, 0] is got[2, 1] is got[2, 2] is None


def test_account_rows(spark):
    made = spark.createDataFrame([(1, "Bank", 0), (2, " ", 0), (3, "Cash", 4), (4, None, 0)], "record int, name string, remaining int")
    assert [r.record for r in rows.exact_accounts(made).collect()] == [1] and sorted(r.record for r in rows.inexact_accounts(made).collect()) == [2, 3, 4]
    shape = spark.createDataFrame([(1, "id", "integer"), (2, "name", "char")], "column_id int, name string, domain string")
    rows.account_shape(shape, [(1, "id", "integer"), (2, "name", "char")])
    with pytest.raises(LedgerError, match="account_schema"):
        rows.account_shape(shape, [(1, "id", "integer")])
    chart = accounts(spark)
    assert rows.with_hierarchy(chart, hierarchy.names(chart)).count() == chart.count()
    with pytest.raises(LedgerError, match="blank_account_name"):
        rows.with_hierarchy(chart, hierarchy.names(chart).where("account_id <> 'till'"))
    life = spark.createDataFrame([(True, True, True), (False, True, True), (False, False, True), (False, False, False)], "a boolean, b boolean, c boolean")
    assert [r[0] for r in life.select(dispositions.account_lifecycle(F.col("a"), F.col("b"), F.col("c"))).collect()] == ["deleted", "delete_pending", "internal", "included"]


def test_ledgers_of_any_size_and_back(spark, book, tmp_path):  # noqa: F811
    file = sinks.general_ledger_file(reports.general_ledger(book, END), hierarchy.names(book.accounts), META)
    sinks.write_parts(file, str(tmp_path / "csv"))
    sinks.write_parts(file, str(tmp_path / "json"), "json")
    want = [(r.posting_day, r.posting_id, r.net_cents) for r in file.collect()]
    assert [(r.posting_day, r.posting_id, r.net_cents) for r in spark.read.json(str(tmp_path / "json")).orderBy("posting_day", "account_id", "transaction_id", "posting_id").collect()] == want
    back = native.read_generated_ledger(spark, str(tmp_path / "csv"), 0, END).collect()
    assert sorted((r.date, r.signed_minor_units) for r in back) == sorted((d, c) for d, _, c in want) and {r.transaction_type for r in back} == {"Journal"}
    with pytest.raises(LedgerError, match="too_many_rows"):
        list(sinks.csv_lines(file, most=3))
    head = "posting_day,account_name,net_cents,transaction_type\n"
    for body, why in (("5,a,,\n", "malformed"), ("x,a,1,\n", "invalid_date"), ("9,a,1,\n", "outside"), ("5,a,1.5,\n", "cents"), ("5,a,0,\n", "zero"), (",,,\n", "no_posting")):
        with pytest.raises(text.SourceError, match=why):
            native.generated_ledger_rows((head + body).encode(), 0, 8)
    with pytest.raises(text.SourceError, match="missing_generated_header"):
        native.generated_ledger_rows(b"posting_day,net_cents\n", 0, 8)
    status = spark.createDataFrame([(1, "b.bin", None, None, "input_error", "gone"), (0, "a.bin", 5, "ff", "unsupported", "x")], "input_index int, source_path string, byte_length long, sha256 string, status string, reason string")
    docs = [json.loads(r.document) for r in sinks.batch_status(status).collect()]
    assert docs[0]["snapshot"] == {"byte_length": 5, "sha256": "ff"} and docs[1]["snapshot"] is None and docs[1]["status"] == "input_error"
    pages = spark.range(9)
    types = spark.createDataFrame([("E", "A", 2)], "before string, after string, n long")
    delta = json.loads(sinks.snapshot_delta(pages, pages.limit(3), pages.limit(1), types).first().document)
    assert (delta["page_count"], delta["changed_page_count"], delta["subtracted_changed_page_count"]) == (9, 3, 2) and delta["page_type_transitions"] == [{"before": "E", "after": "A", "n": 2}]
    table = spark.createDataFrame([(2, "b"), (1, "a")], "table_id int, name string")
    tx, items = spark.createDataFrame([(1, "q")], "source_page int, qb_id string"), spark.createDataFrame([(1, 2)], "page_number int, page_offset int")
    sinks.write_migration(table, tx, items, str(tmp_path / "moved"))
    assert sorted(p.name for p in (tmp_path / "moved").iterdir()) == ["catalog", "lineitems", "transactions"]
    sinks.write_interchange(spark.createDataFrame([("b", 0, "TRNS"), ("a", 0, "TRNS")], "parent string, nth int, line string"), str(tmp_path / "iif"))
    assert b"\r\n" in b"".join(p.read_bytes() for p in (tmp_path / "iif").glob("part-*"))


def test_small_codecs(spark):
    one = lambda *c: spark.range(1).select(*c).first()
    data = lambda b: F.lit(bytes(b))
    got = one(*(codecs.date_type32(data(b)).cast("string").alias(f"c{i}") for i, b in enumerate(([7, 208, 2, 29], [7, 209, 2, 29], [0, 0, 0, 0], [7, 208, 2]))))
    assert list(got) == ["2000-02-29", None, None, None]
    assert one(F.hex(codecs.date_type32_bytes(F.lit("2000-02-29").cast("date"))))[0] == "07D0021D"
    assert [one(codecs.amount_type(data([k, 1, 2, 3])))[0] for k in (0, 3, 4)] == [0, 3, None]
    locator = [0x34, 0x12, 5, 0, 0, 0, 9, 0, 0, 0, 1, 2, 3, 4]
    at = lambda b, n=10: one(codecs.long_value_locator(data(b), 0x1234, F.lit(n)))[0]
    assert tuple(at(locator)) == (5, 9) and at(locator, 9) is None and at(locator[:-1]) is None and at([0] + locator[1:]) is None
    kept = one(codecs.with_defaults(F.create_map(F.lit(1), F.lit("own")), F.create_map(F.lit(1), F.lit("d1"), F.lit(2), F.lit("d2"))))[0]
    assert kept == {1: "own", 2: "d2"} and one(codecs.table_id_of(data([0, 0, 5, 1, 0, 0]), 2))[0] == 261 and one(codecs.table_id_of(data([0] * 8), 2))[0] is None
    assert [one(labels.csv_field(F.lit(x)))[0] for x in ("a", 'a"b', "a,b")] == ["a", '"a""b"', '"a,b"']
    assert [one(labels.activity_flag(F.lit(x)))[0] for x in ("active", "inactive", "unknown")] == [1, 0, None]
    assert one(money.parse_integer_cents(F.lit("-12")), money.parse_integer_cents(F.lit("")))[:2] == (-12, None)


def test_identifier_forms_and_tuples(spark):
    forms = evidence.identifier_forms("0A1B2C3D")
    assert bytes.fromhex("0A1B2C3D") in forms and bytes.fromhex("3D2C1B0A") in forms and b"0A1B2C3D" in forms
    found = evidence.form_hits(spark.createDataFrame([(b"xx" + bytes.fromhex("0A1B2C3D"),), (b"none",)], "bytes binary"), {"id": forms}).first()
    assert (found.name, found.pages, found.hits) == ("id", 1, 1)
    import struct

    data = b"\x99" * 3 + struct.pack("<IIHHI", 7, 9, 4, 0, 12) + b"\x99" * 5
    assert (3, 7, 9, 4, 12) in evidence.page_tuples(data)
    assert bounded_broadcast(spark.range(10), rows=5)._jdf.queryExecution().analyzed().toString().count("hint") == 0


def test_normalized_postings(spark):
    made = spark.createDataFrame([(1, 9, 5, 100, "posting", 3), (2, 9, 6, -100, "posting", 3), (3, 9, 7, 1, "posting", 3)], "record int, transaction_number int, account_number int, amount long, disposition string, page int")
    identity = spark.createDataFrame([(5, "a"), (6, "b")], "account_number int, account_id string")
    got = {r.posting_id: (r.account_id, r.side, r.cents, r.source_row) for r in dispositions.normalized(made, identity, "3078").collect()}
    assert got == {"line-3078-1": ("a", "debit", 100, "3078:3:1"), "line-3078-2": ("b", "credit", 100, "3078:3:2")}
    assert [r.record for r in dispositions.unidentified(made, identity).collect()] == [3]
    assert len(entries([(1, "till", "owner", 5)])) == 2
