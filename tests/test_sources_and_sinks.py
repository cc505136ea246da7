"""Strict text, native reports, sinks and their replacement rules."""

import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import hierarchy, pages, reconcile, reports, statements
from ledgerloom.operators.gates import LedgerError
from ledgerloom.operators.reports import AccrualPolicy
from ledgerloom.sinks import reports as sinks
from ledgerloom.sources import native, text
from tests.test_ledger import END, START, book  # noqa: F401

META = sinks.Metadata("acme", END, "books.bin", "1", "2024-01-01T00:00:00Z")


def test_csv_records():
    assert text.records('a,"b ""q"", c"\r\n"x"\ny,\n') == [["a", 'b "q", c'], ["x"], ["y", ""]]
    assert text.records("") == [] and text.records("a,") == [["a", ""]] and text.records('"a\nb"') == [["a\nb"]]
    for bad in ('a"b', '"a"b', '"open'):
        with pytest.raises(text.SourceError):
            text.records(bad)


def test_decoding_and_money():
    assert text.decode("é".encode()) == "é" and text.decode(b"caf\xe9 \x80 \x81") == "café € \x81"
    cases = {"": 0, " - ": 0, "1,234.5": 123450, "(12.34)": -1234, "-$5": -500, "$ 7.": 700, "+0.01": 1}
    assert {k: text.money(k) for k in cases} == cases
    for bad in ("x", "1.234", ".5", "()", "1-"):
        with pytest.raises(text.SourceError):
            text.money(bad)


NATIVE = "Acme\r\nTrial Balance\r\n,Debit,Credit\r\n1000 \xb7 Bank:Checking,\"1,200.50\",\r\nLoan,,\"1,200.50\"\r\nEmpty,0.00,\r\nTOTAL,\"1,200.50\",\"1,200.50\"\r\n"


def test_native_trial_balance(spark, tmp_path):
    (tmp_path / "tb.csv").write_bytes(NATIVE.encode("cp1252"))
    rows = {r.label: r.cents for r in native.read_trial_balance(spark, str(tmp_path)).collect()}
    assert rows == {"Bank:Checking": 120050, "Loan": -120050}
    with pytest.raises(text.SourceError, match="missing_required_header"):
        native.trial_balance_rows(b"a,b\n1,2\n")
    with pytest.raises(text.SourceError, match="duplicate"):
        native.trial_balance_rows(b"Account,Debit,Credit\nA,1,\nA,2,\n")


LEDGER = """Acme
,Type,Date,Num,Name,Debit,Credit,Balance
1000 \xb7 Bank,,,,,,,
Checking,,,,,,,5.00
,Invoice,1/5/00,7,,10.00,,
Checking opening,,,,,,,9.00
,Bill,02/01/2000,,,,"1,000.00",
,Void,2/2/00,,,,,
Total Checking,,,,,,,
Savings,,,,,,,
,Deposit,2/3/00,,,3,,
TOTAL,,,,,,,
"""


def test_native_general_ledger(spark, tmp_path):
    day = lambda t: native.desktop_day(t, 140000, 150000)
    (tmp_path / "gl.csv").write_bytes(LEDGER.encode("cp1252"))
    rows = native.read_general_ledger(spark, str(tmp_path), 145673, 146403).collect()
    assert [(r.date, r.account_full_name, r.signed_minor_units, r.transaction_type, r.transaction_number) for r in rows] == [
        (day("1/5/2000"), "Bank:Checking", 1000, "Invoice", "7"), (day("2/1/2000"), "Bank:Checking", -100000, "Bill", None), (day("2/3/2000"), "Bank:Savings", 300, "Deposit", None),
    ]
    for bad, why in (("2/30/00", "invalid_date"), ("1/1/1990", "outside"), ("1-1-00", "invalid_date"), ("2/29/00", "invalid_date")):
        with pytest.raises(text.SourceError, match=why):
            native.desktop_day(bad, 145673, 146403)
    with pytest.raises(text.SourceError, match="posting_without_account"):
        native.general_ledger_rows(b",Type,Date,Debit,Credit\n,Bill,1/5/00,1,\n", 145673, 146403)


def test_manifests():
    head = ",".join(native.MANIFEST)
    assert native.manifest_rows(f"{head}\na,p,s,2024-01-01,RE,Retained\n".encode()) == [("a", "p", "s", "2024-01-01", "RE", "Retained")]
    for body, why in (("a,p,s,2024-1-1,RE,R", "fiscal"), ("a,p,,2024-01-01,RE,R", "blank"), ("a,p,s,2024-01-01,RE,R\na,p,s,2024-01-01,RE,R", "duplicate")):
        with pytest.raises(text.SourceError, match=why):
            native.manifest_rows(f"{head}\n{body}\n".encode())
    good = {"company_file": "x", "read_only": True, "qbxml_version": "16.0", "account_count": 1, "journal_entry_count": 2, "journal_line_count": 4, "accounts_sha256": "0" * 64, "journal_sha256": "f" * 64}
    assert native.oracle_manifest(json.dumps(good)) == good
    for bad in (json.dumps(good | {"more": 1}), json.dumps(good | {"account_count": -1}), json.dumps(good)[:-1] + ', "account_count": 1}', json.dumps(good | {"read_only": 1})):
        with pytest.raises(text.SourceError):
            native.oracle_manifest(bad)


def test_xml_oracle(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<R><AccountRet><ListID>1</ListID><Name>Bank</Name><FullName>Bank</FullName><AccountType>Bank</AccountType><IsActive>true</IsActive></AccountRet></R>")
    (tmp_path / "j.xml").write_text(
        "<R><JournalEntryRet><TxnID>T</TxnID><TxnDate>2024-01-02</TxnDate><JournalDebitLine><TxnLineID>d</TxnLineID><AccountRef><ListID>1</ListID></AccountRef><Amount>12.34</Amount></JournalDebitLine>"
        "<JournalCreditLine><TxnLineID>c</TxnLineID><AccountRef><ListID>2</ListID></AccountRef><Amount>12.34</Amount></JournalCreditLine><JournalCreditLine><TxnLineID>e</TxnLineID></JournalCreditLine></JournalEntryRet></R>"
    )
    assert [tuple(r) for r in native.read_oracle_accounts(spark, str(tmp_path / "a.xml")).select("account_id", "classification", "active").collect()] == [("1", "Bank", True)]
    assert [(r.line_id, r.signed_minor_units) for r in native.read_oracle_journal(spark, str(tmp_path / "j.xml")).collect()] == [("d", 1234), ("c", -1234)]


def test_trial_balance_round_trip(book, tmp_path):  # noqa: F811
    names = hierarchy.names(book.accounts)
    report = reports.trial_balance(book, END, AccrualPolicy(START, "kept"))
    policy = {"source": "native", "as_of": END, "fiscal_year_start": START, "retained_earnings_account_id": "kept", "retained_earnings_report_name": "Held over"}
    file = sinks.trial_balance_file(report, names, META, policy)
    assert file.columns == sinks.TRIAL_BALANCE and len(file.columns) == 26
    target = tmp_path / "tb.csv"
    sinks.publish(sinks.csv_lines(file), str(target))
    back = dict(native.any_trial_balance_rows(target.read_bytes()))
    assert back["Held over"] == {r.account_id: r.net_cents for r in report.collect()}["kept"] and sum(back.values()) == 0
    with pytest.raises(LedgerError, match="target_exists"):
        sinks.publish(iter(["x"]), str(target))
    with pytest.raises(LedgerError, match="target_is_an_input"):
        sinks.publish(iter(["x"]), str(target), (str(target),), force=True)
    sinks.publish(iter(["x"]), str(target), force=True)
    assert target.read_text() == "x" and [p.name for p in tmp_path.iterdir()] == ["tb.csv"]

    def fails():
        yield "half"
        raise OSError("disk")

    with pytest.raises(OSError):
        sinks.publish(fails(), str(target), force=True)
    assert target.read_text() == "x"


def test_other_files(book, tmp_path):  # noqa: F811
    names = hierarchy.names(book.accounts)
    gl = sinks.general_ledger_file(reports.general_ledger(book, END), names, META)
    rows = gl.collect()
    assert gl.columns == sinks.GENERAL_LEDGER and len(gl.columns) == 30 and [r.posting_day for r in rows] == sorted(r.posting_day for r in rows)
    doc = json.loads("".join(sinks.json_document(gl, META)))
    assert doc["entity_id"] == "acme" and len(doc["rows"]) == len(rows) and doc["rows"][0]["credit"] == "750.00"
    pnl = statements.profit_and_loss(book, START, END, validate=False)
    shape = book.accounts.drop("account_name").join(names, "account_id").select("account_id", "account_number", "account_full_name", "account_display_name", "account_type", "classification", "activity")
    file = sinks.statement_file(pnl, shape, META, "profit_and_loss", START)
    assert file.columns == sinks.STATEMENT and len(file.columns) == 31 and file.count() == pnl.count()
    with pytest.raises(LedgerError, match="statement_policy"):
        sinks.statement_file(pnl, shape, META, "profit_and_loss", START, {})
    db = str(tmp_path / "out.db")
    for _ in range(2):
        sinks.write_sqlite(gl, db, "general_ledger")
    assert sqlite3.connect(db).execute("select count(*), sum(net_cents) from general_ledger").fetchone() == (len(rows), 0)
    for _ in range(2):
        sinks.replace_parquet(gl, str(tmp_path / "gl"))
    assert gl.sparkSession.read.parquet(str(tmp_path / "gl")).count() == len(rows)
    trial = reports.trial_balance(book, END, validate=False)
    sinks.validate_bundle(trial, book.current(END))
    with pytest.raises(LedgerError, match="trial_balance_disagrees"):
        sinks.validate_bundle(trial, book.current(END - 1))
    with pytest.raises(LedgerError, match="blank_metadata"):
        sinks.Metadata(" ", 1, "x", "1", "t").validate()


def test_reconciliation_of_labels_and_sections(spark):
    side = lambda *r: spark.createDataFrame(list(r), "label string, cents long")
    found = reconcile.trial_balances(side(("a", 1), ("b", 2), ("c", 0)), side(("a", 1), ("b", 3), ("d", 4)))
    assert {r.label: (r.outcome, r.variance_cents) for r in found.collect()} == {"a": ("match", 0), "b": ("mismatch", 1), "c": ("missing", 0), "d": ("extra", 4)}
    assert [r.line for r in reconcile.diagnostics(found).collect()] == ["missing c variance=0", "extra d variance=4", "mismatch b variance=1"] and not reconcile.passes(found)
    with pytest.raises(LedgerError, match="duplicate_label"):
        reconcile.trial_balances(side(("a", 1), ("a", 2)), side())
    moves = lambda owner, *r: [(owner, d, k, c) for d, k, c in r]
    schema = "owner string, date int, kind string, cents long"
    payable = [(1, "bill", 5), (1, "bill", 5), (2, "bill-pmt-check", -5)]
    native_rows = spark.createDataFrame(moves("Control", *payable) + moves("Bills only", (1, "bill", 5)), schema)
    own = spark.createDataFrame(moves("ap1", *payable) + moves("ap2", *payable[:2]) + moves("ap3", *payable, (3, None, 1)), schema)
    assert [tuple(r) for r in reconcile.control_sections(native_rows, own).collect()] == [("Control", "ap1")]


def a_page(kind, rows, start=0x71, order="<", free=()):
    """A page of the documented layout: prelude, falling offsets from `start` on, rows up to the end of the data; row i
    is slot i, the slots in `free` are zero."""
    import struct
    import zlib

    body = bytearray(pages.PAGE)
    at, offsets = pages.DATA_END, []
    for r in rows:
        at -= len(r)
        body[at : at + len(r)] = r
        offsets.append(at)
    for i in sorted(free):
        offsets.insert(i, 0)
    if rows:
        struct.pack_into(f"{order}6H", body, start - 12, 0x0404, 0x22, min(o for o in offsets if o), len(offsets), 1, 0)
        struct.pack_into(f"{order}{len(offsets)}H", body, start, *offsets)
    body[pages.TYPE_AT] = ord(kind)
    struct.pack_into("<I", body, pages.CRC_AT, zlib.crc32(bytes(body[: pages.CRC_AT])))
    return bytes(body)


def test_slot_directories():
    own = [b"first row", b"second", b"the third"]
    for start, order, free in ((0x71, "<", ()), (0x80, ">", ()), (0x9D, "<", (1, 3))):
        page = a_page("E", own, start, order, free)
        outcome, slots = pages.slots_of(page)
        at = [i for i in range(len(own) + len(free)) if i not in free]
        assert outcome == "rows" and [(s, page[a:b]) for s, a, b in reversed(slots)] == list(zip(at, own, strict=True))
    broken = bytearray(a_page("E", own))
    broken[0x71 - 6] -= 1  # one slot less than there are, so the least offset is not among them
    assert pages.slots_of(bytes(broken)) == ("no_slot_directory", [])
    assert pages.slots_of(a_page("A", own))[0] == "not_extent" and pages.slots_of(b"E" * 100)[0] == "not_extent"


def test_pages(spark):
    plain = a_page("E", [b"first row", b"second"])
    content = a_page("I", []) + plain + a_page("E", []) + a_page("A", [b"x", b"y"])
    split = pages.split_pages(spark.createDataFrame([("f", content)], "path string, content binary"))
    assert {r.page_type: (r.n, r.crc_ok) for r in pages.page_integrity(split).collect()} == {"I": (1, 1), "E": (2, 2), "A": (1, 1)}
    rows = [(r.page_number, r.outcome, r.slot, bytes(r.row or b"")) for r in pages.scan_rows(split).collect()]
    assert rows == [(1, "row", 1, b"second"), (1, "row", 0, b"first row"), (2, "no_slot_directory", None, b""), (3, "not_extent", None, b"")]
    number, key, step = 9, 77, 3
    hidden = bytearray(plain)
    for s in range(8):
        for i in range(512 if s < 7 else 496):
            hidden[s * 512 + i] = (plain[s * 512 + i] + key + number + s - (number % 16) // 2 * 4 + step * i) % 256
    assert pages.deobfuscate(bytes(hidden), number, key) == plain and pages.recover_key(bytes(hidden), number) == key


def test_catalog_scans(spark):
    import struct

    from ledgerloom.operators import catalog_scan as cs

    def row(body, prefix=b""):
        return prefix + struct.pack("<I", len(body) + 4) + body

    table = row(struct.pack("<IHQIII", 31, 1, 5, 7, 9, 2) + bytes(4) + struct.pack("<IQQ", 5, 1 << 40, 3) + bytes([6]) + b"orders" + bytes([1, 89, 2, 0]))
    column = row(struct.pack("<IIHBBIhQq", 31, 2, 4, 1, ord("Y"), 8, -2, 77, -7) + bytes([4]) + b"memo" + b"\x01x" + cs.COLUMN_TAG)
    index = row(b"\0" + b"\xaa\xbb\x01\x46" + struct.pack("<IIQ", 340, 0, 1 << 33) + bytes([6]) + b"fkey_a")
    header = b"zz" + b"\x0e\x00\x10" + b"0123456789abcdEF" + b"\xff" + struct.pack("<II", 15000, 12) + bytes(9)
    no_date = b"\x0e\x00\x10" + b"ZZZZZZZZZZZZZZZZ" + bytes(20)
    body = b"\x99" * 7 + table + b"\x99" + column + b"\x99" + index
    flat = (body + header + no_date).ljust(pages.DATA_END, b"\0") + bytes(2) + b"E" + bytes(13)
    slotted = a_page("E", [header + no_date, no_date])
    rows = spark.createDataFrame([(1, "abmc_bill_header", flat), (2, "abmc_bill_header", slotted), (3, "abmc_bill_line", flat)], "page_number int, owner string, bytes binary")
    one = rows.where("page_number = 1")
    (t,) = cs.scan(one, cs.table_rows).collect()
    assert (t.table_id, int(t.object_id), t.name, int(t.row_count), t.pages, t.external_pages, t.table_type, t.server_type, t.offset) == (31, 1 << 40, "orders", 5, 9, 2, 1, 2, 7)
    (c,) = cs.scan(one, cs.column_rows).collect()
    assert (c.table_id, c.column_id, c.name, c.domain_id, c.nullable, c.width, c.scale, int(c.object_id), c.max_identity, bytes(c.post_name)) == (31, 2, "memo", 4, True, 8, -2, 77, -7, b"\x01x")
    (i,) = cs.scan(one, cs.index_rows).collect()
    assert (int(i.owner_object_id), i.catalog_page_candidate, i.name) == (1 << 33, 340, "fkey_a")
    got = sorted((r.page_number, r.qb_id, r.txn_date_raw, r.counter) for r in cs.scan_headers(rows).collect())
    assert got == [(1, "0123456789abcdEF", 15000, 12), (1, "Z" * 16, None, None), (2, "0123456789abcdEF", 15000, 12), (2, "Z" * 16, None, None)]
    assert cs.scan(rows.limit(0), cs.table_rows).count() == 0


def test_upsert_and_migration(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    got = sinks.upsert(old, spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string"), ["k"]).collect()
    assert sorted(map(tuple, got)) == [(1, "a"), (2, "c"), (3, "d")]
    moved = sinks.migrate_activity(spark.createDataFrame([(1,), (0,), (None,)], "active int"))
    assert [r.activity for r in moved.collect()] == ["active", "inactive", "unknown"]
    line = sinks.tsv(spark.createDataFrame([("=1+1", "x\ty", None)], "a string, b string, c string"), ["a", "b", "c"]).first()[0]
    assert line == "'=1+1\tx y\t" and F is not None
