"""Readers of the source formats; each gives DataFrames and fails on what it can't read whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motorlode.functions.etl import strict_json, unescaped


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    """(value, at) of the lines of one file, split among tasks; `at` has the order of the lines."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select("value", F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n")).alias("at"))


def copy_blocks(spark: SparkSession, path: str) -> tuple[DataFrame, list[tuple[str, list[str], tuple, tuple]]]:
    """(numbered lines of a dump, its blocks: table, columns, place of the beginning and of the end).

    Only lines that can begin or end a block come to the driver: two a table. Repeated tables and
    blocks without an end raise ValueError.
    """
    lines = _numbered(spark, path)
    marks = lines.where((F.col("value") == r"\.") | (F.startswith("value", F.lit("COPY ")) & F.endswith("value", F.lit(" FROM stdin;"))))
    found, table = [], None
    for value, at in sorted(((r["value"], tuple(r["at"])) for r in marks.collect()), key=lambda x: x[1]):
        if table is None and value != r"\.":
            name, _, rest = value[5:-12].partition("(")
            table = name.strip().rpartition(".")[2], [c.strip().strip('"') for c in rest.rstrip(") ").split(",")], at
            if table[0] in (x[0] for x in found):
                raise ValueError(f"repeated table {table[0]}")
        elif table is not None and value == r"\.":
            found.append((*table, at))
            table = None
    if table is not None:
        raise ValueError(f"{table[0]} has no end")
    return lines, found


def _at(place: tuple):
    return F.struct(F.lit(place[0]).cast("long").alias("block"), F.lit(place[1]).cast("long").alias("n"))


def copy_table(spark: SparkSession, path: str, table: str) -> DataFrame:
    """One table of a dump in plain text, a string column for each of its own; rows of another width raise an error."""
    lines, found = copy_blocks(spark, path)
    for name, columns, begin, end in found:
        if name == table:
            rows = _split(lines.where((F.col("at") > _at(begin)) & (F.col("at") < _at(end))), columns, None)
            return rows.select(*[F.when(F.instr(c, "\\") == 0, F.col(c)).otherwise(unescaped(c)).alias(c) for c in columns])
    raise ValueError(f"no table {table}")


def copy_inventory(spark: SparkSession, path: str) -> DataFrame:
    """(table, n_columns, n_rows) of every table of a dump."""
    lines, found = copy_blocks(spark, path)
    inside = F.coalesce(*[F.when((F.col("at") > _at(begin)) & (F.col("at") < _at(end)), k) for k, (_, _, begin, end) in enumerate(found)], F.lit(-1))
    counts = lines.groupBy(inside.alias("k")).agg(F.count("*").alias("n_rows"))
    tables = spark.createDataFrame([(k, name, len(columns)) for k, (name, columns, _, _) in enumerate(found)], "k int, table string, n_columns int")
    return tables.join(counts, "k", "left").select("table", "n_columns", F.coalesce("n_rows", F.lit(0).cast("long")).alias("n_rows"))


def _split(lines: DataFrame, names: list[str], null: str | None) -> DataFrame:
    cells = F.split(F.col("value"), "\t", -1)
    checked = F.when(F.size(cells) == len(names), cells).otherwise(F.raise_error(F.concat(F.lit(f"row without {len(names)} cells: "), F.col("value"))))
    rows = lines.select(checked.alias("c"))
    return rows.select(*[(F.nullif(F.col("c")[i], F.lit(null)) if null is not None else F.col("c")[i]).alias(n) for i, n in enumerate(names)])


def null_tsv(spark: SparkSession, path: str) -> DataFrame:
    """A TSV without quoting whose header names its columns; backslash N is null, empty stays empty."""
    lines = _numbered(spark, path)
    header, at = lines.groupBy().agg(F.min_by("value", "at"), F.min("at")).first()
    return _split(lines.where(F.col("at") > _at(at)), header.split("\t"), r"\N")


def null_cells(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """Text as writers.sorted_tsv writes it, without a header."""
    return _split(spark.read.option("lineSep", "\n").text(path), names, r"\N")


def legacy_tsv(spark: SparkSession, path: str, encoding: str = "cp1252") -> DataFrame:
    """A TSV in a legacy code page whose header ends in an empty column that rows may leave out.

    The bytes are decoded in Python, since the JVM reader rejects this charset unless configured.
    """

    def lines(batches):
        import pandas as pd

        for b in batches:
            for raw in b["content"]:
                found = [x.removesuffix("\r") for x in bytes(raw).decode(encoding).removesuffix("\n").split("\n")]
                yield pd.DataFrame({"value": found, "n": range(len(found))})

    rows = spark.read.format("binaryFile").load(path).select("content").mapInPandas(lines, "value string, n long")
    header = rows.where("n = 0").first()["value"].split("\t")
    names = header[:-1] if header[-1] == "" else header
    body = rows.where("n > 0").select(F.regexp_replace("value", f"(\\A(?:[^\\t]*\\t){{{len(names) - 1}}}[^\\t]*)\\t\\z", "$1").alias("value"))
    return _split(body, names, None)


def tagged(spark: SparkSession, path: str, tags: dict[str, list[str]], encoded: dict[str, list[str]] | None = None) -> dict[str, DataFrame]:
    """Tables of a file whose rows begin with a tag: tag to column names; `encoded` cells are base64."""
    lines = spark.read.text(path)
    out = {}
    for tag, names in tags.items():
        rows = _split(lines.where(F.col("value").startswith(f"{tag}\t")), ["tag", *names], None).drop("tag")
        for c in (encoded or {}).get(tag, []):
            rows = rows.withColumn(c, F.unbase64(c).cast("string"))
        out[tag] = rows
    return out


def shards(spark: SparkSession, path: str) -> DataFrame:
    """A table partitioned by shard or key: only the partitions that a query needs are read."""
    return spark.read.parquet(path)


def contents(spark: SparkSession, folder: str) -> DataFrame:
    """(name, content, length) of all files below a folder; the name is the path from it on."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    root = "/" + folder.split("://")[-1].partition("/")[2] if "://" in folder else folder
    inner = F.split(F.col("path"), f"\\Q{root.rstrip('/')}/\\E", 2)
    return files.select(F.element_at(inner, -1).alias("name"), "content", "length")


def verified(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """(name, problem) of files that are missing, unexpected or other than in the manifest (name, sha256)."""
    files = contents(spark, folder).select("name", F.sha2("content", 256).alias("actual"))
    j = manifest.join(files, "name", "full_outer")
    problem = F.when(F.col("actual").isNull(), "MISSING").when(F.col("sha256").isNull(), "UNEXPECTED").when(F.col("sha256") != F.col("actual"), "CHANGED")
    return j.select("name", problem.alias("problem")).where("problem is not null")


def json_snapshot(spark: SparkSession, path: str, schema: str, sha256: str | None = None) -> DataFrame:
    """Rows of a JSON array, compressed or not; a file other than its digest says raises ValueError."""
    if sha256 is not None:
        found = spark.read.format("binaryFile").load(path).select(F.sha2("content", 256)).first()[0]
        if found != sha256:
            raise ValueError(f"{path} has the digest {found}")
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def settings(path: str):
    """Nested settings; an object that repeats a key raises ValueError."""
    with open(path, encoding="utf-8") as f:
        return strict_json(f.read())
