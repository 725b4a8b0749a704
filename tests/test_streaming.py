"""The streaming upsert against a dict."""

from heddle.streaming.upserts import start_upserts, version


def test_upserts_by_micro_batches(spark, tmp_path):
    model = {}
    for n in range(3):
        rows = [(f"k{(i * 7 + n) % 10}", n * 100 + i, f"v{n}-{i}") for i in range(12)]
        spark.createDataFrame(rows, "k string, seq long, v string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")
        for k, s, v in rows:
            if s >= model.get(k, (-1, ""))[0]:
                model[k] = (s, v)
        stream = spark.readStream.schema("k string, seq long, v string").parquet(f"{tmp_path}/log")
        start_upserts(stream, "k", "seq", f"{tmp_path}/table", f"{tmp_path}/checkpoint").awaitTermination(60)
        got = {r["k"]: (r["seq"], r["v"]) for r in version(spark, f"{tmp_path}/table", n).collect()}
        assert got == model
