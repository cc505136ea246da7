"""Row schemas and the fixed vocabularies of accounts and postings."""

from __future__ import annotations

from pyspark.sql import types as T

#: Source classification of an account by code (the position), and the broad type of each.
CLASSIFICATIONS = (
    "Bank", "AccountsReceivable", "OtherCurrentAsset", "FixedAsset", "OtherAsset",
    "AccountsPayable", "CreditCard", "OtherCurrentLiability", "LongTermLiability",
    "Equity", "Income", "CostOfGoodsSold", "Expense", "OtherIncome", "OtherExpense",
)
BROAD_TYPE = (
    dict.fromkeys(CLASSIFICATIONS[:5], "asset")
    | dict.fromkeys(CLASSIFICATIONS[5:9], "liability")
    | {"Equity": "equity", "Income": "income", "OtherIncome": "income", "CostOfGoodsSold": "cost_of_goods_sold"}
    | {"Expense": "expense", "OtherExpense": "expense"}
)
PROFIT_AND_LOSS_TYPES = ("income", "expense", "cost_of_goods_sold")
#: Types whose normal balance is credit; the others' is debit.
CREDIT_TYPES = ("liability", "equity", "income")
STATES = ("Current", "Superseded", "Deleted", "Ambiguous")
ACTIVITIES = ("active", "inactive", "unknown")

_S, _L = T.StringType(), T.LongType()
ACCOUNT = T.StructType(
    [
        T.StructField("account_id", _S), T.StructField("account_number", _S), T.StructField("account_name", _S),
        T.StructField("parent_account_id", _S), T.StructField("account_type", _S), T.StructField("classification", _S),
        T.StructField("activity", _S),
    ]
)
POSTING = T.StructType(
    [
        T.StructField("transaction_id", _S), T.StructField("posting_id", _S), T.StructField("account_id", _S),
        T.StructField("date", T.IntegerType()), T.StructField("signed_minor_units", _L), T.StructField("current_state", _S),
        T.StructField("source_row", _S), T.StructField("page_number", T.IntegerType()), T.StructField("slot_number", T.IntegerType()),
        T.StructField("decoder", _S), T.StructField("transaction_type", _S), T.StructField("memo", _S),
    ]
)
ZERO_ACTIVITY = T.StructType([f for f in POSTING.fields if f.name != "signed_minor_units"])
