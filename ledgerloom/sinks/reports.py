"""Reports as CSV, JSON, SQLite, spreadsheet-safe TSV and interchange text; partitioned Parquet with replacement.

A General Ledger has as many rows as there are postings: it is written in parts, in order, by the tasks that hold
them (`write_parts`, `replace_parquet`). A single CSV, JSON or SQLite file is for reports as small as a chart of accounts;
its rows are counted against a bound before they come to the driver one by one.
"""

from __future__ import annotations

import csv
import io
import json
import os
import shutil
import sqlite3
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.labels import spreadsheet_safe
from ledgerloom.functions.money import format_cents
from ledgerloom.operators.gates import require, require_none
from ledgerloom.operators.reports import ORDER

#: Columns of the report files, in order.
_ACCOUNT = [
    "account_id", "account_number", "account_name", "account_full_name", "account_display_name", "parent_account_id", "account_type",
    "quickbooks_classification", "active", "activity",
]
_MONEY = ["debit_cents", "debit", "credit_cents", "credit", "net_cents", "net"]
_SOURCE = ["source_file", "parser_version", "generated_at"]
_POLICY = [
    "tb_policy_source", "tb_policy_as_of", "tb_policy_fiscal_year_start", "tb_policy_retained_earnings_account_id", "tb_policy_retained_earnings_report_name",
]
TRIAL_BALANCE = ["entity_id", "as_of_day", *_ACCOUNT, *_MONEY, *_SOURCE, *_POLICY]
GENERAL_LEDGER = [
    "entity_id", "as_of_day", "posting_day", "transaction_id", "posting_id", *_ACCOUNT, *_MONEY,
    "transaction_type", "memo", "source_row", "page_number", "slot_number", "decoder", *_SOURCE,
]
STATEMENT = [
    "entity_id", "report_type", "from_day", "as_of_day", "row_index", "row_kind", "row_key", "section", "label",
    *_ACCOUNT, "amount_cents", "amount", "net_cents", "net", *_SOURCE, *_POLICY,
]


@dataclass(frozen=True)
class Metadata:
    entity_id: str
    as_of_day: int
    source_file: str
    parser_version: str
    generated_at: str

    def validate(self) -> Metadata:
        for name in ("entity_id", "source_file", "parser_version", "generated_at"):
            require(bool(getattr(self, name).strip()), "blank_metadata", name)
        return self


def _shaped(rows: DataFrame, columns: list[str], meta: Metadata, policy: dict[str, object]) -> DataFrame:
    """rows with exactly the columns of a report file; what is absent is null."""
    given = {"entity_id": meta.entity_id, "as_of_day": meta.as_of_day, "source_file": meta.source_file, "parser_version": meta.parser_version, "generated_at": meta.generated_at} | policy
    have = set(rows.columns)
    money = {c: format_cents(F.col(f"{c}_cents")) for c in ("debit", "credit", "net", "amount") if f"{c}_cents" in have}
    renamed = {"quickbooks_classification": "classification", "posting_day": "date"}
    flag = F.when(F.col("activity") == "active", F.lit(1)).when(F.col("activity") == "inactive", F.lit(0)) if "activity" in have else F.lit(None)

    def column(c: str):
        if c in have:
            return F.col(c)
        if c in money:
            return money[c]
        if renamed.get(c) in have:
            return F.col(renamed[c])
        return flag if c == "active" else F.lit(given.get(c))

    return rows.select(*(column(c).alias(c) for c in columns))


def trial_balance_file(report: DataFrame, names: DataFrame, meta: Metadata, policy: dict[str, object] | None = None) -> DataFrame:
    """A Trial Balance with the 26 columns of its file, in order of account; the policy may rename the retained account."""
    policy = {k if k.startswith("tb_policy_") else f"tb_policy_{k}": v for k, v in (policy or {}).items()}
    rows = report.join(names, "account_id")
    if label := policy.get("tb_policy_retained_earnings_report_name"):
        own = F.col("account_id") == policy["tb_policy_retained_earnings_account_id"]
        rows = rows.withColumn("account_display_name", F.when(own, F.lit(label)).otherwise(F.col("account_display_name")))
    return _shaped(rows, TRIAL_BALANCE, meta.validate(), policy).orderBy("account_id")


def general_ledger_file(report: DataFrame, names: DataFrame, meta: Metadata) -> DataFrame:
    """A General Ledger with the 30 columns of its file in presentation order; non-monetary rows show a zero debit."""
    cents = F.col("signed_minor_units")
    rows = report.join(names, "account_id").withColumns({
        "debit_cents": F.when(cents > 0, cents).when(cents.isNull(), F.lit(0).cast("bigint")), "credit_cents": F.when(cents < 0, -cents), "net_cents": F.coalesce(cents, F.lit(0).cast("bigint")),
    })
    order = ["posting_day" if c == "date" else c for c in ORDER]
    return _shaped(rows, GENERAL_LEDGER, meta.validate(), {}).orderBy(*order)


def statement_file(report: DataFrame, chart: DataFrame, meta: Metadata, kind: str, start: int | None, policy: dict[str, object] | None = None) -> DataFrame:
    """A statement with the 31 columns of its file; a Profit & Loss has a start and no policy, a Balance Sheet the reverse."""
    require((kind == "profit_and_loss") == (start is not None), "statement_period", kind)
    require((kind == "profit_and_loss") == (policy is None), "statement_policy", kind)
    policy = {f"tb_policy_{k}": v for k, v in (policy or {}).items()} | {"report_type": kind, "from_day": start}
    return _shaped(report.join(chart, "account_id", "left"), STATEMENT, meta.validate(), policy).orderBy("row_index")


def validate_bundle(trial: DataFrame, ledger_rows: DataFrame) -> None:
    """A bundle's Trial Balance and General Ledger agree account by account."""
    from ledgerloom.operators.reconcile import report_agreement

    found = report_agreement(trial, ledger_rows)
    require_none(found.select(F.lit(0).alias("rank"), F.lit("trial_balance_disagrees").alias("check"), F.col("account_id").alias("key")))


#: Rows that a single file may have.
ONE_FILE = 1_000_000


def counted(file: DataFrame, most: int = ONE_FILE) -> DataFrame:
    """file, if a single file may hold its rows; else an error that names the ways without such a bound."""
    require(file.limit(most + 1).count() <= most, "too_many_rows_for_one_file", "use write_parts or replace_parquet")
    return file


def csv_lines(file: DataFrame, most: int = ONE_FILE) -> Iterator[str]:
    """The lines of a report file, heading first."""
    buffer = io.StringIO()
    writer = csv.writer(buffer, lineterminator="\n")
    writer.writerow(file.columns)
    yield buffer.getvalue()
    for row in counted(file, most).toLocalIterator():
        buffer.seek(0)
        buffer.truncate()
        writer.writerow(["" if v is None else v for v in row])
        yield buffer.getvalue()


def json_document(file: DataFrame, meta: Metadata, most: int = ONE_FILE) -> Iterator[str]:
    """The report as one JSON document: metadata, then rows in order."""
    yield json.dumps({"entity_id": meta.entity_id, "as_of_day": meta.as_of_day, "generated_at": meta.generated_at})[:-1] + ', "rows": ['
    own = file.select(F.to_json(F.struct(*file.columns), {"ignoreNullFields": "false"}).alias("j"))
    for i, row in enumerate(counted(own, most).toLocalIterator()):
        yield ("" if i == 0 else ",") + row["j"]
    yield "]}"


def write_parts(file: DataFrame, target: str, form: str = "csv") -> None:
    """A report of any size as a folder of parts whose names follow the report's order: CSV with a heading in each, or JSON
    lines. An existing target is refused; what a failed task leaves is never published."""
    require(form in ("csv", "json"), "unknown_form", form)
    writer = file.write.mode("errorifexists")
    if form == "csv":
        writer.option("header", True).option("nullValue", "").option("emptyValue", "").option("escape", '"').csv(target)
    else:
        writer.option("ignoreNullFields", False).json(target)


def write_migration(catalog: DataFrame, transactions: DataFrame, items: DataFrame, target: str) -> None:
    """The three folders of a migration: the catalog by table id, transactions and line items in physical order."""
    for name, rows, order in (("catalog", catalog, ["table_id"]), ("transactions", transactions, ["source_page", "qb_id"]), ("lineitems", items, ["page_number", "page_offset"])):
        write_parts(rows.orderBy(*order), f"{target}/{name}")


def batch_status(results: DataFrame) -> DataFrame:
    """(input_index, document): a JSON document for each input of a batch, in order; results: input_index, source_path,
    byte_length and sha256 (null if it could not be read), status, reason."""
    snapshot = F.when(F.col("sha256").isNotNull(), F.struct("byte_length", "sha256"))
    whole = F.struct("input_index", "source_path", snapshot.alias("snapshot"), "status", "reason")
    return results.select("input_index", F.to_json(whole, {"ignoreNullFields": "false"}).alias("document")).orderBy("input_index")


def snapshot_delta(pages: DataFrame, changed: DataFrame, remaining: DataFrame, transitions: DataFrame) -> DataFrame:
    """One JSON document of a comparison: pages compared, changed, left after control noise, and how often each pair of page
    types changed (transitions: before, after, n; page types are a few letters)."""
    counts = pages.agg(F.count("*").alias("page_count")).crossJoin(F.broadcast(changed.agg(F.count("*").alias("changed_page_count")))).crossJoin(F.broadcast(remaining.agg(F.count("*").alias("remaining_changed_page_count"))))
    types = transitions.agg(F.array_sort(F.collect_list(F.struct("before", "after", "n"))).alias("page_type_transitions"))  # one row on each side
    whole = counts.crossJoin(F.broadcast(types)).withColumn("subtracted_changed_page_count", F.col("changed_page_count") - F.col("remaining_changed_page_count"))
    return whole.select(F.to_json(F.struct("page_count", "changed_page_count", "subtracted_changed_page_count", "remaining_changed_page_count", "page_type_transitions")).alias("document"))


def publish(lines: Iterator[str], target: str, inputs: tuple[str, ...] = (), force: bool = False) -> None:
    """Writes a file completely or not at all: staged beside the target, then renamed over it.

    An existing target needs force and is kept as a backup until the rename is done; a target that is one of
    the inputs (also by a link) is refused.
    """
    path = Path(target)
    for name in inputs:
        require(not (path.exists() and os.path.exists(name) and os.path.samefile(path, name)), "target_is_an_input", target)
    require(force or not path.exists(), "target_exists", target)
    staged, backup = path.with_name(f".{path.name}.staged"), path.with_name(f".{path.name}.backup")
    try:
        with staged.open("w", encoding="utf-8", newline="") as f:
            f.writelines(lines)
        if path.exists():
            shutil.copy2(path, backup)
        os.replace(staged, path)
    finally:
        staged.unlink(missing_ok=True)
    backup.unlink(missing_ok=True)


def write_sqlite(file: DataFrame, target: str, table: str, keys: tuple[str, ...] = ("entity_id", "as_of_day"), most: int = ONE_FILE) -> None:
    """Replaces the report of the file's entity and day in a SQLite table, in one transaction."""
    counted(file, most)
    columns = ", ".join(f'"{c}"' for c in file.columns)
    with sqlite3.connect(target) as db:
        db.execute(f'CREATE TABLE IF NOT EXISTS "{table}" ({columns})')
        have = {r[1] for r in db.execute(f'PRAGMA table_info("{table}")')}
        for c in file.columns:  # older files gain the columns they lack
            if c not in have:
                db.execute(f'ALTER TABLE "{table}" ADD COLUMN "{c}"')
        done = set()
        for row in file.toLocalIterator():
            key = tuple(row[k] for k in keys)
            if key not in done:
                db.execute(f'DELETE FROM "{table}" WHERE ' + " AND ".join(f'"{k}" IS ?' for k in keys), key)
                done.add(key)
            db.execute(f'INSERT INTO "{table}" ({columns}) VALUES ({", ".join("?" * len(file.columns))})', [str(v) if v is not None and not isinstance(v, int | float | str) else v for v in row])


def replace_parquet(file: DataFrame, target: str, keys: tuple[str, ...] = ("entity_id", "as_of_day")) -> None:
    """The distributed form: only the partitions of the report's own entity and day are replaced."""
    file.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(target)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """new rows, and old ones whose key is not in new."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def migrate_activity(accounts: DataFrame) -> DataFrame:
    """Accounts of older output, with a flag `active`, in the present form with `activity`."""
    if "activity" in accounts.columns:
        return accounts
    return accounts.withColumn("activity", F.when(F.col("active") == 1, "active").when(F.col("active") == 0, "inactive").otherwise("unknown")).drop("active")


def tsv(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One text column of tab-separated fields that no spreadsheet takes for formulas."""
    safe = [spreadsheet_safe(F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), "[\t\r\n]", " ")) for c in columns]
    return rows.select(F.concat_ws("\t", *safe).alias("value"))


def write_interchange(lines: DataFrame, target: str) -> None:
    """Interchange text in order of parent and line, CRLF at line ends; the parts of the folder are in order."""
    lines.orderBy("parent", "nth").select("line").write.option("lineSep", "\r\n").text(target)
