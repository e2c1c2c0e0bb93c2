"""Texts of tasks, long ones too."""

from pyspark.sql import functions as F

from quarrylight.functions import text as T
from quarrylight.plans.registry import QUERIES


def test_cut_of_a_trimmed_text(spark):
    rows = ["", " ", "a", " \n a b \t", "abcde", "abcde  ", "  abcde f", "abc  ", "abc      ", "abc      x", "ab  c    ", None, "éàü€😀 x", "\tabcd e"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, x string")
    got = df.select("i", T.truncate_trimmed(F.col("x"), 5).alias("new"), T.truncate(T.trimmed(F.col("x")), 5).alias("old")).collect()
    assert [r for r in got if r.new != r.old] == []


def test_task_queries_of_large_ids(spark, tmp_path):
    """The selected text grows with the id; here it would have more characters than a string can hold."""
    rows = [(20_000_001, 0, "user", "hello"), (3, 1, "user", "hello"), (0, 0, "user", "hello")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in QUERIES["task_queries"](spark, str(tmp_path)).collect()}
    assert len(got) == 3 and 600 < got[20_000_001].length < 900 and got[3].length < 600 and got[0].length < 200
