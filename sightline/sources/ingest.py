"""Typed ingest, lossless text round trips and content-hash manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

IMU = "timestamp_us long, x double, y double, z double, type string"
PTS = "timestamp_us long"


def read_typed_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV with a header line and exactly these columns by position: no quoting, no inferred nulls, no lenience.

    An empty or malformed field fails the query rather than becoming null.
    """
    strict = spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("quote", "").option("mode", "FAILFAST").csv(path)
    return strict.select(*(F.when(F.col(c).isNotNull(), F.col(c)).otherwise(F.raise_error(F.lit(f"empty field in {c}")).cast(t)).alias(c) for c, t in strict.dtypes))


def between(df: DataFrame, at: str, first: int, last: int) -> DataFrame:
    """Rows of a closed time range; on Parquet sorted by time, row groups outside it are never read."""
    return df.filter(F.col(at).between(first, last))


def fixed_point(value: Column, decimals: int) -> Column:
    """Text of a double with so many decimals, halves to even, the sign of zero kept; an error if it can't be exact."""
    scale = 10**decimals
    whole = F.rint(F.abs(value) * scale)
    sure = F.when(F.isnan(value) | (whole >= float(2**53)), F.raise_error(F.lit("not representable")).cast("double")).otherwise(whole)
    negative = (value < 0) | ((value == 0) & (F.substring(value.cast("string"), 1, 1) == "-"))
    digits = F.lpad(sure.cast("decimal(20,0)").cast("string"), 20, "0")
    lead = F.regexp_replace(F.substring(digits, 1, 20 - decimals), "^0+(?=.)", "")
    tail = F.concat(F.lit("."), F.substring(digits, 21 - decimals, decimals)) if decimals else F.lit("")
    return F.concat(F.when(negative, "-").otherwise(""), lead, tail)


def as_csv_line(df: DataFrame, decimals: dict[str, int]) -> Column:
    """The CSV line of a row, doubles with their column's decimals; null if any field is."""
    fields = [fixed_point(F.col(c), decimals[c]) if c in decimals else F.col(c).cast("string") for c in df.columns]
    return F.concat(*(x for f in fields for x in (F.lit(","), f)), F.lit("")) if len(fields) == 1 else F.concat(fields[0], *(x for f in fields[1:] for x in (F.lit(","), f)))


def same_lines(original: DataFrame, table: DataFrame, decimals: dict[str, int]) -> DataFrame:
    """One row: how many lines differ as multisets; order and line ends are for convert_csv() to prove."""
    a = original.select(F.col(original.columns[0]).alias("line"), F.lit(1).alias("n"))
    b = table.select(as_csv_line(table, decimals).alias("line"), F.lit(-1).alias("n"))
    by_line = a.unionByName(b).groupBy("line").agg(F.sum("n").alias("n"))
    return by_line.agg(F.coalesce(F.sum(F.abs("n")), F.lit(0)).cast("long").alias("different"))


FLOATS = ("x", "y", "z")
PLAIN_NUMBER = r"^-?[0-9]+(\.[0-9]+)?$"


def _bare(name: Column) -> Column:
    return F.regexp_replace(name, r"^\s+|\s+$", "")


def _plain_line(kind: Column) -> Column:
    """The line that a typed row came from, without its end."""
    digits = {c: F.when(F.col(f"{c}_decimals") == 0, fixed_point(F.col(c), 0)) for c in FLOATS}
    for c in FLOATS:
        for d in range(1, 16):
            digits[c] = digits[c].when(F.col(f"{c}_decimals") == d, fixed_point(F.col(c), d))
    imu = F.concat(F.col("timestamp_us").cast("string"), *(x for c in FLOATS for x in (F.lit(","), digits[c])), F.lit(","), F.col("type"))
    return F.when(kind == "imu", imu).otherwise(F.col("timestamp_us").cast("string"))


def convert_csv(spark: SparkSession, folder: str, out: str, pattern: str = "*") -> DataFrame:
    """Sensor CSVs below a folder as one Parquet table at out, and the proof that nothing was lost: a row for each file.

    A line is read with its end, its place and its hash. What is written is typed: the header's kind, the first data row's decimals, whether lines end in CR LF. The
    written table is read again, every line made anew from it and its hash compared, line by line; lines and ends must add up to the file's size. Every step is row by
    row or a sum, so a file of any size is the work of many tasks.

    Returns file (its name), kind, rows, crlf, closing_newline, size, different (lines that can't be made again) and ok. Only files that are ok stay in the table at out. Unknown headers,
    empty fields, mixed decimals, exponents and mixed line ends make a file not ok.
    """
    raw = spark.read.option("lineSep", "\n").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(folder)
    meta = raw.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), F.col("value").alias("line"))
    crlf = F.col("line").endswith("\r")
    text = F.when(crlf, F.expr("left(line, length(line) - 1)")).otherwise(F.col("line"))
    lines = meta.withColumns({"crlf": crlf, "text": text})
    place = F.struct("block", "id")
    # the first line is the header, the second tells the decimals: two small aggregates, joined back
    heads = lines.filter("block = 0").groupBy("path").agg(F.min(F.struct(place.alias("at"), "text")).alias("h"))
    heads = heads.select("path", F.col("h.at").alias("head_at"), F.array_join(F.transform(F.split(F.col("h.text"), ","), _bare), ",").alias("header"))
    body = lines.join(heads, "path")
    first = body.filter(place > F.col("head_at")).groupBy("path").agg(F.min(F.struct(place.alias("at"), "text")).alias("f")).select("path", F.col("f.text").alias("first"))
    kind = F.when(F.col("header") == "timestamp_us,x,y,z,type", "imu").when(F.col("header") == "timestamp_us", "pts")
    body = body.join(first, "path", "left").withColumns({"kind": kind, "fields": F.split("text", ","), "is_head": place == F.col("head_at")})
    decimals = {f"{c}_decimals": F.length(F.regexp_extract(F.get(F.split("first", ","), F.lit(k + 1)), r"\.([0-9]*)$", 1)) for k, c in enumerate(FLOATS)}
    number = lambda k: F.when(F.get("fields", F.lit(k)).rlike(PLAIN_NUMBER), F.get("fields", F.lit(k)).cast("double"))
    typed = body.withColumns(decimals).select(
        "path", "size", "block", "id", "kind", "crlf", "is_head", F.sha2("text", 256).alias("line_hash"), (F.octet_length("line") + 1).alias("bytes"),
        F.when(~F.col("is_head"), F.get("fields", F.lit(0)).try_cast("long")).alias("timestamp_us"), *(F.when(~F.col("is_head"), number(k + 1)).alias(c) for k, c in enumerate(FLOATS)),
        F.when(~F.col("is_head"), F.get("fields", F.lit(4))).alias("type"), *decimals, F.size("fields").alias("width"),
    )
    held = f"{out}-all"
    typed.write.option("compression", "zstd").parquet(held)
    back = spark.read.schema(typed.schema).parquet(held)
    same = F.sha2(_plain_line(F.col("kind")), 256).eqNullSafe(F.col("line_hash")) & (F.col("width") == F.when(F.col("kind") == "imu", 5).otherwise(1))
    sums = back.groupBy("path", "size", "kind").agg(
        F.count_if(~F.col("is_head")).alias("rows"), F.bool_and("crlf").alias("all_crlf"), F.bool_or("crlf").alias("crlf"), F.sum("bytes").alias("bytes"), F.count_if(~F.col("is_head") & ~F.coalesce(same, F.lit(False))).alias("different"),
    )
    closing = F.col("bytes") == F.col("size")
    # a last line without an end can't carry a CR either
    ends = F.col("all_crlf") | ~F.col("crlf")
    ok = F.col("kind").isNotNull() & (F.col("different") == 0) & ends & (closing | (F.col("bytes") == F.col("size") + 1))
    report = sums.select("path", F.regexp_extract("path", "([^/]*)$", 1).alias("file"), "kind", "rows", "crlf", closing.alias("closing_newline"), "size", "different", F.coalesce(ok, F.lit(False)).alias("ok"))
    back.filter(~F.col("is_head")).join(report.filter("ok").select("path"), "path", "left_semi").write.option("compression", "zstd").parquet(out)
    return report


def sniffed(files: DataFrame) -> DataFrame:
    """kind, crlf, decimals (x,y,z; null without data) and closing newline of files (path, head, tail: the text of their first and last bytes); kind is null for what is
    neither a sensor nor a timestamp file, or whose first data row is not plain."""
    crlf = F.regexp_extract("head", "^[^\n]*(\r)\n", 1) == "\r"
    line = lambda k: F.regexp_replace(F.get(F.split("head", "\n"), F.lit(k)), "\r$", "")
    header = F.array_join(F.transform(F.split(line(0), ","), _bare), ",")
    row = F.split(line(1), ",")
    told = F.coalesce(F.length(line(1)) > 0, F.lit(False))
    plain = F.forall(F.slice(row, 2, 3), lambda x: x.rlike(PLAIN_NUMBER)) & (F.size(row) == 5)
    places = F.concat_ws(",", *(F.length(F.regexp_extract(F.get(row, F.lit(k)), r"\.([0-9]*)$", 1)).cast("string") for k in (1, 2, 3)))
    imu = header == "timestamp_us,x,y,z,type"
    kind = F.when(imu & (~told | plain), "imu").when(header == "timestamp_us", "pts")
    return files.select("path", kind.alias("kind"), crlf.alias("crlf"), F.when(imu & told & plain, places).alias("decimals"), F.col("tail").endswith("\n").alias("closing_newline"))


def manifest_of(files: DataFrame) -> DataFrame:
    """path, sha256, size and status of files (path, content)."""
    return files.select("path", F.sha2("content", 256).alias("sha256"), F.length("content").cast("long").alias("size"), F.lit("listed").alias("status"))


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path and content of every file below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path).select("path", "content")


def refreshed(manifest: DataFrame, listing: DataFrame) -> DataFrame:
    """Earlier rows that are more than listings stay; the listing replaces the others."""
    kept = manifest.filter(F.col("status") != "listed")
    return kept.unionByName(listing.join(kept.select("path"), "path", "left_anti"))


def append_manifest(spark: SparkSession, path: str, rows: DataFrame) -> DataFrame:
    """Adds rows to a manifest: files are only ever added, and what is there before is never read or rewritten."""
    rows.write.mode("append").option("compression", "zstd").parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def videos_of(listing: DataFrame, endings: list[str], least: int = 1024) -> DataFrame:
    """Files of a listing (path, size) with a video's ending, stubs aside."""
    return listing.filter(F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1)).isin(endings) & (F.col("size") >= least))


def passed_through(tree: DataFrame, skip: list[str], name: str, allowed: str) -> DataFrame:
    """What becomes of each member (path, type) of a file's tree: skip for what is at or below a path of skip, refuse for links and for datasets called name outside
    allowed, else copy."""
    below = F.lit(False)
    for s in skip:
        below = below | (F.col("path") == s) | F.col("path").startswith(f"{s}/")
    stray = (F.col("type") == "dataset") & (F.regexp_extract("path", "([^/]*)$", 1) == name) & ~F.col("path").startswith(f"{allowed}/")
    return tree.select("path", "type", F.when(F.col("type").isin("soft link", "external link") | stray, "refuse").when(below, "skip").otherwise("copy").alias("action"))


def fingerprint(code: Column, settings: dict[str, Column]) -> Column:
    """16 hex digits of a hash of code and settings, in order of their names."""
    return F.substring(F.sha2(F.concat_ws("\n", code, *(F.concat(F.lit(f"{n}="), settings[n].cast("string")) for n in sorted(settings))), 256), 1, 16)


def markdown(df: DataFrame, columns: list[str]) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *(F.coalesce(F.col(c).cast("string"), F.lit("n/a")) for c in columns)), F.lit(" |"))


SCHEMAS = {"imu": IMU, "pts": PTS}


def sniff(head: bytes, tail: bytes) -> dict:
    """Kind, line end, decimals and closing newline of a sensor CSV from its first and last bytes; ValueError if it is neither kind."""
    end = "\r\n" if b"\r\n" in head else "\n"
    lines = head.decode("ascii").split(end)
    header = [c.strip() for c in lines[0].split(",")]
    kind = next((k for k, s in SCHEMAS.items() if header == [c.split()[0] for c in s.split(", ")]), None)
    if kind is None:
        raise ValueError(f"unknown header {lines[0]!r}")
    first = lines[1].split(",") if len(lines) > 1 and lines[1] else []
    if any("e" in f.lower() for f in first[1:4]):
        raise ValueError("scientific notation")
    decimals = {c: len(f.partition(".")[2]) for c, f in zip(header, first, strict=False) if c in ("x", "y", "z")}
    return {"kind": kind, "line_end": end, "decimals": decimals, "closing_newline": tail.endswith(end.encode())}
