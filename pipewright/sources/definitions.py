"""Item definitions: documents of `{definition: {parts: [{path, payload, payloadType}]}}`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_PARTS = (
    "definition struct<parts: array<struct<path: string, payload: string, payloadType: string>>>"
)
TEXT, JSON = "text", "json"
BAD_JSON, BAD_BASE64, BAD_DOCUMENT = "not json", "not base64", "no definition"


def _content(payload: Column, payload_type: Column) -> Column:
    """The text of a part; NULL for Base64 that cannot be decoded."""
    decoded = F.try_to_binary(payload, F.lit("base64")).cast("string")
    return F.when(payload_type == "InlineBase64", decoded).otherwise(payload)


def _candidate(path: Column, payload_type: Column) -> Column:
    return (payload_type == "InlineBase64") & F.endswith(path, F.lit(".json"))


def _parsed(path: Column, payload_type: Column, content: Column) -> Column:
    """JSON value of a decoded `.json` part, NULL for anything that is not valid JSON."""
    return F.when(_candidate(path, payload_type), F.try_parse_json(content))


def _status(path: Column, payload_type: Column, content: Column, json: Column) -> Column:
    return (
        F.when((payload_type == "InlineBase64") & content.isNull(), BAD_BASE64)
        .when(json.isNotNull(), JSON)
        .when(_candidate(path, payload_type), BAD_JSON)
        .otherwise(TEXT)
    )


def _parts(document: str) -> Column:
    return F.from_json(F.col(document), _PARTS)["definition"]["parts"]


def definition_parts(documents: DataFrame, key: str, document: str) -> DataFrame:
    """One row per part: its text and, when the path says so and the text allows it, parsed JSON.

    JSON content is returned in compact form. Parts that are not Base64 pass through unchanged.
    `status` tells what became of a part: `json`, `text`, `not json` (its text is kept) or `not
    base64` (no content). A document without a list of parts has one row with the status `no
    definition`.
    """
    parts = documents.select(key, _parts(document).alias("parts"))
    found = parts.select(
        key, F.col("parts").isNull().alias("bad"), F.posexplode_outer("parts").alias("position", "p")
    ).where("bad OR position IS NOT NULL")
    path, kind = F.col("p.path"), F.col("p.payloadType")
    parsed = found.withColumn("raw", _content(F.col("p.payload"), kind)).withColumn(
        "json", _parsed(path, kind, F.col("raw"))
    )
    return parsed.select(
        key,
        "position",
        path.alias("path"),
        F.coalesce(F.to_json("json"), "raw").alias("content"),
        F.col("json").isNotNull().alias("is_json"),
        F.when(F.col("bad"), BAD_DOCUMENT)
        .otherwise(_status(path, kind, F.col("raw"), F.col("json")))
        .alias("status"),
    )


def definition_documents(documents: DataFrame, key: str, document: str) -> DataFrame:
    """Every definition as one JSON text, mapping each path to its content, in the order of paths.

    JSON parts are embedded as values, all others as strings, undecodable ones as null. Of a path
    given more than once the last part counts. `status` is `no definition`, and the text NULL, where
    there is no list of parts. Each document is rewritten inside its own row: nothing is shuffled.
    """

    def member(p: Column) -> Column:
        text = _content(p["payload"], p["payloadType"])
        value = F.coalesce(_parsed(p["path"], p["payloadType"], text), text.cast("variant"))
        pair = F.to_json(F.create_map(p["path"], value), {"ignoreNullFields": "false"})
        return F.substring(pair, F.lit(2), F.length(pair) - 2)

    def numbered(p: Column, i: Column) -> Column:
        return F.struct(p["path"].alias("path"), (-i).alias("age"), member(p).alias("member"))

    members = documents.select(
        key, F.sort_array(F.transform(_parts(document), numbered)).alias("members")
    )
    latest = F.filter(
        "members", lambda m, i: (i == 0) | (m["path"] != F.get(F.col("members"), i - 1)["path"])
    )
    texts = F.transform(latest, lambda m: m["member"])
    known = F.col("members").isNotNull()
    return members.select(
        key,
        F.when(known, F.concat(F.lit("{"), F.concat_ws(",", texts), F.lit("}"))).alias("document"),
        F.when(known, JSON).otherwise(BAD_DOCUMENT).alias("status"),
    )


def write_documents(documents: DataFrame, path: str, document: str = "document") -> None:
    """One JSON text per line."""
    documents.select(F.col(document).alias("value")).write.mode("overwrite").text(path)


def read_documents(spark: SparkSession, path: str, document: str = "document") -> DataFrame:
    return spark.read.text(path).withColumnRenamed("value", document)


def read_folder(spark: SparkSession, folder: str, item: str = "item") -> DataFrame:
    """The parts of one definition from a folder with one file a part, as `definition_parts` gives
    them: (item, position, path, content, is_json, status).

    A part's path is its place below the folder, and `position` numbers the paths in order. Parts
    are plain text; a `.json` file that is not valid JSON keeps its text and says so.
    """
    # Files come back with their full, encoded address; the root is cut off by its own length.
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    root = system.makeQualified(path).toUri().getPath().rstrip("/") + "/"
    files = (
        spark.read.option("recursiveFileLookup", True)
        # Hidden files such as .platform belong to an item, but Spark's listing leaves them out.
        .text(folder, wholetext=True)
        .select("value", F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B"))).alias("address"))
    )
    place = F.substring_index("address", root, -1)
    parsed = files.select(place.alias("path"), "value").withColumn(
        "json", F.when(F.endswith("path", F.lit(".json")), F.try_parse_json("value"))
    )
    status = (
        F.when(F.col("json").isNotNull(), JSON)
        .when(F.endswith("path", F.lit(".json")), BAD_JSON)
        .otherwise(TEXT)
    )
    # A definition has as many parts as a model has types and bindings.
    return parsed.select(
        F.lit(root.rstrip("/").rsplit("/", 1)[-1]).alias(item),
        (F.row_number().over(Window.orderBy("path")) - 1).alias("position"),
        "path",
        F.coalesce(F.to_json("json"), "value").alias("content"),
        F.col("json").isNotNull().alias("is_json"),
        status.alias("status"),
    )


def write_folder(parts: DataFrame, folder: str) -> None:
    """Every part of one definition as a file of its own below the folder, in place of what was
    there. Parts without content are left out, of a path given twice the last one counts.

    A definition is configuration: its parts go through the driver, one at a time.
    """
    spark = parts.sparkSession
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(folder)
    system = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    system.delete(root, True)
    rows = parts.where("content IS NOT NULL").orderBy("position").select("path", "content")
    for path, content in rows.toLocalIterator():
        steps = path.split("/")
        if path.startswith("/") or ".." in steps or "" in steps:
            raise ValueError(f"a part must stay inside its folder: {path}")
        out = system.create(jvm.org.apache.hadoop.fs.Path(f"{folder}/{path}"), True)
        try:
            out.write(bytearray(content.encode()))
        finally:
            out.close()
