import pytest
from pyspark.sql import functions as F

from motorlode.plans import specimens as S
from motorlode.sources import readers, writers
from motorlode.streaming import decode

DUMP = 'SET x;\nCOPY public.make (id, "name") FROM stdin;\n1\tA\\tb\n2\t\\N\n\\.\nCOPY public.none (id) FROM stdin;\n\\.\n'


def test_copy_dump(spark, tmp_path):
    (tmp_path / "dump.sql").write_text(DUMP)
    path = str(tmp_path / "dump.sql")
    assert [tuple(x) for x in readers.copy_table(spark, path, "make").orderBy("id").collect()] == [("1", "A\tb"), ("2", None)]
    assert {x["table"]: (x["n_columns"], x["n_rows"]) for x in readers.copy_inventory(spark, path).collect()} == {"make": (2, 2), "none": (1, 0)}


@pytest.mark.parametrize("bad", ["COPY a (x) FROM stdin;\n1\t2\n\\.\n", "COPY a (x) FROM stdin;\n1\n", "COPY a (x) FROM stdin;\n\\.\nCOPY a (x) FROM stdin;\n\\.\n"])
def test_copy_dump_rejects(spark, tmp_path, bad):
    (tmp_path / "dump.sql").write_text(bad)
    with pytest.raises(Exception, match="cells|no end|repeated"):
        readers.copy_table(spark, str(tmp_path / "dump.sql"), "a").collect()


def test_copy_dump_in_many_splits(spark, tmp_path):
    """Splits of the file are put in order; a row that looks like a beginning is a row."""
    rows = [(str(k), "COPY b (y) FROM stdin;" if k == 5 else f"row {k}\\n") for k in range(3000)]
    text = "COPY a (x, z) FROM stdin;\n" + "".join("\t".join(r) + "\n" for r in rows) + "\\.\n\nCOPY c (x) FROM stdin;\n1\n\\.\n"
    text = text.replace("5\tCOPY b", "COPY b\t5 COPY b")
    (tmp_path / "dump.sql").write_text(text)
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        assert readers._numbered(spark, str(tmp_path / "dump.sql")).rdd.getNumPartitions() > 3
        got = {x["x"]: x["z"] for x in readers.copy_table(spark, str(tmp_path / "dump.sql"), "a").collect()}
        assert len(got) == 3000 and got["7"] == "row 7\n" and got["COPY b"] == "5 COPY b (y) FROM stdin;"
        assert {x["table"]: x["n_rows"] for x in readers.copy_inventory(spark, str(tmp_path / "dump.sql")).collect()} == {"a": 3000, "c": 1}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)


def test_text_tables(spark, tmp_path):
    (tmp_path / "types.tsv").write_text("hsn\ttsn\tname\n0005\tAMQ\t\\N\n0006\tAMR\t\n")
    assert [tuple(x) for x in readers.null_tsv(spark, str(tmp_path / "types.tsv")).collect()] == [("0005", "AMQ", None), ("0006", "AMR", "")]
    (tmp_path / "again.tsv").write_text("a\tb\na\tb\n")
    assert [tuple(x) for x in readers.null_tsv(spark, str(tmp_path / "again.tsv")).collect()] == [("a", "b")]  # a row like the header
    (tmp_path / "odd.tsv").write_bytes("a\tb\t\r\nx\x0by\x1dz\tw\r\n".encode("cp1252"))
    assert [tuple(x) for x in readers.legacy_tsv(spark, str(tmp_path / "odd.tsv")).collect()] == [("x\x0by\x1dz", "w")]
    (tmp_path / "legacy.tsv").write_bytes("a\tb\t\nx\tü\t\ny\t\n".encode("cp1252"))
    assert [tuple(x) for x in readers.legacy_tsv(spark, str(tmp_path / "legacy.tsv")).collect()] == [("x", "ü"), ("y", "")]
    (tmp_path / "tagged.tsv").write_text("V\t1\nA\tx\teQ==\n")
    t = readers.tagged(spark, str(tmp_path / "tagged.tsv"), {"V": ["version"], "A": ["id", "name"]}, {"A": ["name"]})
    assert t["A"].first()["name"] == "y" and t["V"].count() == 1


def test_json_snapshot(spark, tmp_path):
    import gzip
    import hashlib

    raw = gzip.compress(b'[{"a": 1}, {"a": 2}]')
    (tmp_path / "rows.json.gz").write_bytes(raw)
    path = str(tmp_path / "rows.json.gz")
    assert readers.json_snapshot(spark, path, "a int", hashlib.sha256(raw).hexdigest()).count() == 2
    with pytest.raises(ValueError):
        readers.json_snapshot(spark, path, "a int", "0")


def test_manifest(spark, tmp_path):
    folder = tmp_path / "bundle"
    folder.mkdir()
    (folder / "a.tsv").write_text("x")
    (folder / "in").mkdir()
    (folder / "in" / "a.tsv").write_text("same name")
    known = writers.manifest(spark, str(folder)).select("name", "sha256").collect()
    (folder / "a.tsv").write_text("y")
    (folder / "b.tsv").write_text("z")
    got = {x["name"]: x["problem"] for x in readers.verified(spark, str(folder), spark.createDataFrame([*known, ("c.tsv", "0")], "name string, sha256 string")).collect()}
    assert got == {"a.tsv": "CHANGED", "b.tsv": "UNEXPECTED", "c.tsv": "MISSING"}


def test_sinks(spark, tmp_path):
    writers.bucketed(S.table(spark, "patterns").drop("schema_bucket"), str(tmp_path / "patterns"))
    pruned = readers.shards(spark, str(tmp_path / "patterns")).where("schema_bucket = 101")
    assert pruned.count() == 5 and "PartitionFilters: [isnotnull(schema_bucket" in pruned._jdf.queryExecution().toString()
    rows = S.table(spark, "approvals").drop("wmi").withColumn("masks", F.array(F.lit("TMBA............."), F.lit("WVWA............."), F.lit("TMBB.............")))
    writers.by_prefix(rows, str(tmp_path / "approvals"))
    assert spark.read.parquet(str(tmp_path / "approvals")).count() == 12
    writers.sorted_tsv(spark.createDataFrame([("b", None), ("a", "x")], "id string, v string"), str(tmp_path / "tsv"))
    assert [x["value"] for x in spark.read.text(str(tmp_path / "tsv")).collect()] == ["a\tx", "b\t\\N"]
    writers.report(spark.createDataFrame([(1, None)], "a int, b string"), str(tmp_path / "report"))
    assert spark.read.text(str(tmp_path / "report")).first()["value"] == '{"a":1,"b":null}'


def test_streamed_lookup_equals_batch(spark, tmp_path):
    r = spark.createDataFrame([(1, "1HGAAAAAAAAAAAAAA", None, None), (2, "ZZZAAAAAAAAAAAAAA", None, None)], "req_id bigint, supplied string, model_year int, market string")
    r.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(r.schema).parquet(str(tmp_path / "in"))
    q = decode.wmi_candidates(stream, S.table(spark, "assignments")).select("req_id", "assignment_id").writeStream.format("memory").queryName("looked_up").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("looked_up").collect())) == [(1, "a01"), (2, None)]
    seen = []
    q = decode.per_batch(stream, lambda b: b.groupBy().count(), lambda t, n: seen.append(t.first()[0]), str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sum(seen) == 2
