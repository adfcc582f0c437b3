"""Files in and out: JSON lines of batch services, checkpoints, caches, exports, page texts and dictionaries."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ENVELOPE = "custom_id string, error string, response struct<body: struct<choices: array<struct<message: struct<content: string>>>>>"


def batch_lines(requests: DataFrame, custom_id: str, model: str, system: str, user: str) -> DataFrame:
    """``value``: one JSON line per request of a batch service."""
    message = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    body = F.struct(F.lit(model).alias("model"), F.array(message("system", F.lit(system)), message("user", F.col(user))).alias("messages"))
    line = F.struct(F.col(custom_id).alias("custom_id"), F.lit("POST").alias("method"), F.lit("/v1/chat/completions").alias("url"), body.alias("body"))
    return requests.select(F.to_json(line).alias("value"))


def decoded_batch(lines: DataFrame, schema: str, errors: DataFrame | None = None, *, skip_failures: bool = False, with_failures: bool = False) -> DataFrame:
    """``custom_id, result``: the parsed content of every line of a batch result (column ``value``).

    An error, invalid JSON and content that isn't of the schema give a null result, or no row with ``skip_failures``. Lines of the
    error file fill in ids that the result file lacks. Blank lines are skipped; of several lines with one id one with a result is kept.
    NUL characters are taken out of the content. ``with_failures`` adds ``failed``: the lines of an id without a result, and the
    further ones of an id that has one.
    """
    def read(df: DataFrame) -> DataFrame:
        parsed = df.where("trim(value) <> ''").select(F.from_json("value", ENVELOPE).alias("e")).where("e.custom_id is not null")
        content = F.replace(F.replace(F.get("e.response.body.choices", 0)["message"]["content"], F.char(F.lit(0)), F.lit("")), F.lit("\\u0000"), F.lit(""))
        return parsed.select("e.custom_id", F.when(F.col("e.error").isNull(), F.from_json(content, schema, {"mode": "PERMISSIVE"})).alias("result"), F.when(F.col("e.error").isNull(), content).alias("content"))

    rows = read(lines)
    if errors is not None:
        rows = rows.unionByName(read(errors).select("custom_id", F.lit(None).cast(rows.schema["result"].dataType).alias("result"), F.lit(None).cast("string").alias("content")).join(rows.select("custom_id"), "custom_id", "left_anti"))
    # A struct without a single field read is content of another shape.
    fields = [f.name for f in rows.schema["result"].dataType.fields]
    held = F.col("result").isNotNull() & ~F.forall(F.array(*[F.col("result")[f].isNull() for f in fields]), lambda x: x)
    once = rows.withColumn("result", F.when(held, F.col("result"))).groupBy("custom_id").agg(
        F.max_by("result", F.struct(F.col("result").isNotNull(), "content")).alias("result"), (F.count(F.lit(1)) - F.when(F.count("result") > 0, 1).otherwise(0)).alias("failed")
    )
    once = once if with_failures else once.drop("failed")
    return once.where("result is not null") if skip_failures else once


def last_checkpoint(lines: DataFrame, schema: str, key: str, order: str) -> DataFrame:
    """The last line of each key of a JSONL checkpoint (columns value and ``order``); blank lines are skipped, null fields stay null."""
    parsed = lines.where("trim(value) <> ''").select(order, F.from_json("value", schema).alias("r"))
    return parsed.groupBy(F.col(f"r.{key}").alias(key)).agg(F.max_by("r", order).alias("r")).select("r.*").where(F.col(key).isNotNull())


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``value, file, line``: the lines of text files, numbered within each file from zero.

    A file is read as a whole by one task, so it must fit one (a checkpoint is appended file by file); the number then is its true place.
    """
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    lines = F.split(F.regexp_replace("value", r"\r?\n$", ""), r"\r?\n")
    return whole.select("file", F.posexplode(lines).alias("line", "value")).select("value", "file", F.col("line").cast("bigint").alias("line"))


def append_lines(df: DataFrame, path: str) -> None:
    """A checkpoint grows by one set of files a call; nothing written before is touched."""
    df.write.mode("append").json(path)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_cache(spark: SparkSession, path: str, schema: str, *, whole: bool = False) -> DataFrame | None:
    """A cached listing, or None where there is none yet; ``whole`` where a file is one JSON document (an array of entries), not a line each."""
    return spark.read.schema(schema).json(path, multiLine=whole) if exists(spark, path) else None


def write_cache(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def listed_files(spark: SparkSession, path: str, pattern: str = "*.pdf", limit: int | None = None, *, with_content: bool = True) -> DataFrame:
    """``path, length, modificationTime[, content]`` of files below a folder, by path; without the content no file is opened."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    files = (files if with_content else files.drop("content")).orderBy("path")
    return files if limit is None else files.limit(limit)


def page_texts(pages: DataFrame, doc: str, page: str, text: str, ocr_text: str, *, least: int = 20) -> DataFrame:
    """``<doc>, text, method``: pages joined in order, each from the text layer if that has enough letters, else from OCR."""
    layer = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"\p{L}")) >= least
    chosen = pages.select(doc, page, F.when(layer, F.col(text)).otherwise(F.coalesce(F.col(ocr_text), F.lit(""))).alias("t"), (~layer).alias("ocr"))
    grouped = chosen.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct(page, "t"))).alias("ps"), F.bool_or("ocr").alias("ocr"))
    return grouped.select(doc, F.array_join(F.transform("ps", lambda p: p["t"]), "\n").alias("text"), F.when(F.col("ocr"), "ocr").otherwise("text").alias("method"))


def mean_confidence(words: DataFrame, page: str, confidence: str) -> DataFrame:
    """``<page>, confidence``: the mean of the confidences from zero on, over 100; 0 for a page without."""
    return words.groupBy(page).agg((F.coalesce(F.avg(F.when(F.col(confidence) >= 0, F.col(confidence))), F.lit(0.0)) / 100).alias("confidence"))


def dictionary(spark: SparkSession, path: str, key: str, schema: str) -> DataFrame:
    """Entries of a versioned dictionary file (JSON, or YAML where a parser is installed) under ``key``; a missing file is an error.

    The file is read through Spark, so it may lie in any file system that the cluster shares.
    """
    if not exists(spark, path):
        raise FileNotFoundError(f"no dictionary at {path}")
    if path.endswith((".yaml", ".yml")):
        import yaml

        text = "".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())
        return spark.createDataFrame(yaml.safe_load(text)[key], schema)
    content = spark.read.schema(f"`{key}` array<struct<{schema}>>").json(path, multiLine=True)
    return content.select(F.inline(key))


def write_csv(df: DataFrame, path: str, order: Sequence[str]) -> int:
    """One CSV file with a header and a byte order mark, rows in order; the number of rows.

    Executors write the parts of the order side by side; the file system joins their bytes, which don't pass through Python.
    """
    from tavla.session import seen_while

    spark = df.sparkSession
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target, parts = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.parts")
    fs = target.getFileSystem(conf)
    counted, count = seen_while(df.repartitionByRange(*order).sortWithinPartitions(*order), n=F.count(F.lit(1)))
    plain = {"header": False, "escape": '"', "emptyValue": "", "nullValue": "", "lineSep": "\r\n", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    counted.write.mode("overwrite").options(**plain).csv(parts.toString())
    out = fs.create(target, True)
    try:
        out.write(bytearray(("\ufeff" + ",".join(df.columns) + "\r\n").encode()))
        for name in sorted(f.getPath().toString() for f in fs.listStatus(parts) if f.getPath().getName().startswith("part-")):
            part = fs.open(jvm.org.apache.hadoop.fs.Path(name))
            jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, conf, False)
            part.close()
    finally:
        out.close()
    fs.delete(parts, True)
    return count("n")


def write_report(df: DataFrame, path: str, order: Sequence[Column]) -> None:
    """Rows in order; the parts of the folder follow each other."""
    df.orderBy(*order).write.mode("overwrite").json(path)


def write_reports(reports: dict[str, tuple[DataFrame, Sequence[Column]]], folder: str) -> None:
    """Several reports, each in a folder of its name."""
    for name, (df, order) in reports.items():
        write_report(df, f"{folder}/{name}", order)


def modelled(df: DataFrame, text: str, out: str, function, *, out_type: str = "string", batch: int = 64) -> DataFrame:
    """``df`` with ``out`` by a model function (list of texts to list of values), called in batches in the workers.

    The function must be pure, so that a lost task can run again.
    """
    from pyspark.sql import types as T

    schema = T.StructType([*df.schema.fields, T.StructField(out, T._parse_datatype_string(out_type))])

    def run(batches):
        for pdf in batches:
            values = [v for lo in range(0, len(pdf), batch) for v in function(pdf[text].iloc[lo : lo + batch].tolist())]
            yield pdf.assign(**{out: pd.Series(values, index=pdf.index, dtype=object)})

    return df.mapInPandas(run, schema)

