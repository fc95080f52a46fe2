from pyspark.sql import functions as F

from tablelens.functions.masks import mask_email, mask_financial, mask_id
from tablelens.operators import privacy as M


def one_col(spark, vals, typ, fn):
    df = spark.createDataFrame([(v,) for v in vals], f"v {typ}")
    return [r[0] for r in df.select(fn(F.col("v"))).collect()]


def test_financial_mask(spark):
    vals = [2095.23, 1000.5, 1001.5, -1234567.891, 12.0, -0.2, 1e6, None]
    want = ["***095", "***000", "***002", "-***568", "***", "-***", "***000", None]
    assert one_col(spark, vals, "double", mask_financial) == want
    assert one_col(spark, ["1,000", "abc", " 2095.23 "], "string", mask_financial) == \
        ["***", "***", "***095"]


def test_email_and_id_masks(spark):
    assert one_col(spark, ["john.doe@example.com", "plain", "@x", None], "string", mask_email) == \
        ["j***@example.com", "plain", "***@x", None]
    assert one_col(spark, ["12345-6789012-3", "abcd", None], "string", mask_id) == \
        ["12***********-3", "****", None]


def test_name_detection():
    assert M.sensitive_type_by_name("email") == "email"
    assert M.sensitive_type_by_name("customer_email") is None
    assert M.sensitive_type_by_name("customer_email", split_underscore=True) == "email"
    assert M.sensitive_type_by_name("Salary") == "financial"
    assert M.sensitive_type_by_name("phone") == "phone"
    assert M.sensitive_type_by_name("ssn") == "id"
    assert M.sensitive_type_by_name("name") is None


def test_mask_table_and_idempotence(spark):
    df = spark.createDataFrame(
        [("a@b.com", "john@x.org", 2095.23, "123456789", "ok"),
         ("c@d.com", "mary@y.org", None, "12", "fine")],
        "email string, contact string, salary double, ssn string, note string")
    once = M.mask_table(df)
    got = [tuple(r) for r in once.orderBy("note").collect()]
    assert got == [("c***@d.com", "m***@y.org", None, "****", "fine"),
                   ("a***@b.com", "j***@x.org", "***095", "12*****89", "ok")]
    twice = [tuple(r) for r in M.mask_table(once).orderBy("note").collect()]
    assert twice == got


def test_detect_email_content(spark):
    df = spark.createDataFrame([("a@b.com", "x"), ("c@d.com", "y"), (None, "z")], "p string, q string")
    got = {r.column_name: (r.email_share, r.is_email) for r in M.detect_email_content(df).collect()}
    assert got == {"p": (1.0, True), "q": (0.0, False)}
