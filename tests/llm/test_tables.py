from pyspark.sql import functions as F

from tests.llm.helpers import rows
from trendspark.llm import tables


def keys(df):
    return df.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def frame(spark, n, step=1):
    made = [(i if i % 7 else None, f"text {i}" if i % 5 else None, i, "x") for i in range(0, n, step)]
    return spark.createDataFrame(made, "doc_id long, text string, slot long, hash string")


def test_without_and_among_are_exact(spark, monkeypatch):
    table = frame(spark, 3000)
    plain = tables.sieve
    for step, bits in ((1, 20), (3, 20), (3, 0), (50, 20)):  # one slot: the sieve lets all through
        monkeypatch.setattr(tables, "sieve", lambda *args, bits=bits: plain(*args, slot_bits=bits))
        gone = frame(spark, 3000, step)
        left, right = {(r.doc_id, r.text) for r in gone.collect()}, table.collect()
        want = sorted(((r.doc_id, r.text, r.slot) for r in right if (r.doc_id, r.text) not in left), key=repr)
        out = tables.without(table, keys(gone))
        assert out.columns == table.columns and rows(out, "doc_id", "text", "slot") == want
        want = sorted(((r.doc_id, r.text, r.slot) for r in right if (r.doc_id, r.text) in left), key=repr)
        assert rows(tables.among(table, keys(gone)), "doc_id", "text", "slot") == want
    assert tables.without(table, keys(frame(spark, 0).limit(0))).count() == 3000
    assert tables.among(table, keys(frame(spark, 0).limit(0))).count() == 0


def test_most_rows_pass_the_sieve_unshuffled(spark):
    table = spark.range(20_000).select(F.col("id").alias("doc_id"))
    gone = spark.range(0, 20_000, 20).select("id")
    clear, maybe = tables.sieve(table, [F.col("doc_id")], gone)
    assert clear.count() + maybe.count() == 20_000
    assert 1_000 <= maybe.count() <= 1_600
    assert clear.join(gone, clear.doc_id == gone.id).count() == 0


def test_texts_are_not_shuffled(spark, tmp_path):
    """Above the broadcast threshold only rows that the sieve lets through reach an exchange."""
    frame(spark, 2000).write.parquet(f"{tmp_path}/docs")
    keys(frame(spark, 2000, 9)).write.parquet(f"{tmp_path}/gone")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = tables.without(spark.read.parquet(f"{tmp_path}/docs"), spark.read.parquet(f"{tmp_path}/gone"))
        plan = out._jdf.queryExecution().executedPlan().toString()
        clear = plan.split("Union")[1]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    first = clear[:clear.index("SortMergeJoin")] if "SortMergeJoin" in clear else clear
    assert "hashpartitioning" not in first.split("BroadcastExchange")[0]


def test_free_memory_is_handed_back_after_the_last_slice(monkeypatch):
    import pyarrow as pa

    from trendspark.llm import tables

    released = []
    monkeypatch.setattr(tables, "release", lambda: released.append(True))
    batch = pa.RecordBatch.from_arrays([pa.array(["ab", None, "c" * 9])], ["text"])
    parts = tables.slices(iter([batch]), limit=4)
    assert [bytes(data) for _, data, _ in parts] == [b"ab", b"c" * 9]
    assert released == [True]
