"""Number and amount codecs against plain Python."""

from pyspark.sql import functions as F

from ledgerloom.functions import codecs
from ledgerloom.operators import evidence

NUMBERS = [0, 1, 127, 128, 16383, 16384, (1 << 21) - 1, 1 << 21, 2097160, (1 << 28) - 1, 1 << 28, (1 << 53) + 1, (1 << 63) - 1]


def sevens(value):
    out = [value & 127]
    while value := value >> 7:
        out.append(value & 127)
    return out


def test_numbers_of_any_size_in_groups_of_seven_bits(spark):
    rows = spark.createDataFrame([(n,) for n in NUMBERS], "n long")
    for n, little, big in rows.select("n", codecs.leb128(F.col("n")), codecs.be_base128(F.col("n"))).collect():
        groups = sevens(n)
        assert bytes(little) == bytes(g | 128 for g in groups[:-1]) + bytes(groups[-1:])
        assert bytes(big) == bytes(g | 128 for g in groups[:0:-1]) + bytes(groups[:1])
    forms = rows.where("n = 2097160").select(F.explode(evidence.number_forms(F.col("n"))).alias("f")).select("f.*").collect()
    assert {r.label: r.form for r in forms}.items() >= {("leb128", "88808001"), ("be_base128", "81808008")}


def test_base100_amounts_there_and_back(spark):
    cents = [0, 1, -1, 99, 100, -100, 123456, 10**17, (1 << 63) - 1, -((1 << 63) - 1)]
    rows = spark.createDataFrame([(c,) for c in cents], "c long").select("c", codecs.base100_token(F.col("c")).alias("t"))
    assert [r[0] for r in rows.select(codecs.base100_cents(F.col("t"))).collect()] == cents
    tokens = ["013F64", "02C0", "01C001", "02BF0102", "02BF010203", "00810000", "0080", "0CBF" + "0000000000000000000000" + "01", "0CBF01" + "00" * 11, "01C501", "01C601", "01BE01", "0ABF" + "63" * 10, "03BF0100", ""]
    wanted = [None, None, 100, 201, 201, 0, None, None, 1, 10**12, None, None, None, None, None]
    made = spark.createDataFrame([(bytes.fromhex(t),) for t in tokens], "t binary")
    assert [r[0] for r in made.select(codecs.base100_cents(F.col("t"))).collect()] == wanted


def test_decoding_an_amount_builds_its_token_once(spark):
    from ledgerloom.plans.page_queries import balance_codecs

    plan = balance_codecs(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Project") == 3 and "lambda" not in plan
