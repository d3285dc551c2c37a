"""Readers of folders of notes, line files of experiments, reference exports and boards.

All read through Spark's own sources, so that any store that Spark reads will do. A file,
line or item that cannot be taken comes back with its ``error``; none is lost and none ends
a job.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.functions.interchange import parsed_front_matter
from folioscope.sources.shared import cut

# Keys and values that must not travel in a record of an experiment, and keys that look like them but may.
SENSITIVE_KEYS = re.compile(r"(?i)api[_-]?key|secret|(?<!max_)(?<!max-)(?<!max)token|password|auth|credential|private[_-]?key|prompt|patient|\bphi\b|\bpii\b|ssn")
HARMLESS_KEYS = re.compile(r"(?i)max[_-]?tokens?|tokens?[_-]per[_-]sec")
SENSITIVE_VALUES = re.compile(r"^sk-[a-zA-Z0-9_-]{20,}|(?i:bearer\s+[a-zA-Z0-9_.-]{20,})")
MOST_VALUE = 256
# How an experiment stands, how long its texts are, how many settings and metrics it has.
STATUSES = ("pending", "running", "completed", "failed", "cancelled")
TEXTS = {"runId": 256, "title": 500, "task": 256, "model": 256}
MOST_KEYS, MOST_KEY, MOST_CATEGORY = 50, 64, 128


def files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """(path, content) of the files below a folder; ``path`` is relative to it. Names that begin with a dot or underscore are passed over."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    root = re.sub(r"^[a-z0-9]+:/*", "/", path.rstrip("/"))
    bare = F.regexp_replace(F.url_decode(F.replace(F.col("path"), F.lit("+"), F.lit("%2B"))), r"^[a-z0-9]+:/*", "/")
    return found.select(F.when(F.startswith(bare, F.lit(f"{root}/")), F.substring(bare, len(root) + 2, 1 << 30)).otherwise(bare).alias("path"), "content")


def notes(spark: SparkSession, path: str) -> DataFrame:
    """(path, note_id, title, tags, body, revision, error) of the Markdown files below a folder.

    The id is that of the front matter, else the path; the revision is the hash of the
    bytes. Errors: ``encoding``, ``malformed`` front matter, ``repeated id`` (all but the
    first path of an id); a note without front matter is whole text.
    """
    read = files(spark, path, "*.md").withColumn("text", F.try_validate_utf8(F.col("content").cast("string")))
    head, body, fault = parsed_front_matter(F.col("text"))
    raw = F.regexp_extract("text", r"(?s)\A---\n(.*?)\n---\n", 1)
    own = F.coalesce(F.get_json_object(raw, "$.id"), F.col("path"))
    error = F.when(F.col("text").isNull(), "encoding").when(fault == "malformed", "malformed")
    told = read.select("path", F.when(error.isNull(), own).otherwise(F.col("path")).alias("note_id"), head["title"].alias("title"), head["tags"].alias("tags"), body.alias("body"), F.sha2("content", 256).alias("revision"), error.alias("error"))
    turn = F.row_number().over(Window.partitionBy("note_id", F.col("error").isNull()).orderBy("path"))
    return told.withColumn("error", F.coalesce("error", F.when(turn > 1, "repeated id")))


def reconciled(scanned: DataFrame, index: DataFrame) -> DataFrame:
    """(note_id, state) against an index (note_id, path, revision): ``new``, ``changed`` (content or path), ``missing``; what is as it was is not told. Notes with an error are left out."""
    now = scanned.where("error is null").select("note_id", F.col("path").alias("now_path"), F.col("revision").alias("now"))
    both = now.join(index.select("note_id", "path", "revision"), "note_id", "full")
    same = F.col("now").eqNullSafe(F.col("revision")) & F.col("now_path").eqNullSafe(F.col("path"))
    state = F.when(F.col("now_path").isNull(), "missing").when(F.col("path").isNull() & F.col("revision").isNull(), "new").when(~same, "changed")
    return both.select("note_id", state.alias("state")).where("state is not null")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, text): lines with their number in the file, counted in the blocks in which Spark reads it and added up over the blocks before."""
    read = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, n = None, 0
        for batch in batches:
            places = []
            for place in zip(batch.column("file").to_pylist(), batch.column("block").to_pylist()):
                at, n = (at, n + 1) if place == at else (place, 1)
                places.append(n)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(places, pa.int64())], names=[*batch.schema.names, "inside"])

    inside = read.mapInArrow(count, "file string, block long, text string, inside long")
    sizes = inside.groupBy("file", "block").agg(F.max("inside").alias("size"))
    before = F.sum("size").over(Window.partitionBy("file").orderBy("block")) - F.col("size")
    starts = sizes.select("file", "block", before.alias("before"))
    return inside.join(starts, ["file", "block"]).select("file", (F.col("before") + F.col("inside")).alias("line"), "text")


def sensitive_keys(value: object, prefix: str = "") -> list[str]:
    """Paths of keys that must not travel, for what they or their values say; lists are not looked into."""
    out = []
    for key, inner in value.items() if isinstance(value, dict) else ():
        path = f"{prefix}.{key}" if prefix else key
        named = SENSITIVE_KEYS.search(key) and not HARMLESS_KEYS.search(key)
        if named or (isinstance(inner, str) and (len(inner) > MOST_VALUE or SENSITIVE_VALUES.search(inner))):
            out.append(path)
        out += sensitive_keys(inner, path)
    return list(dict.fromkeys(out))


def _number(x: object) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool) and math.isfinite(x)


def _wrong(record: object, form: str) -> str | None:
    """What keeps a record from being one of an experiment."""
    if not isinstance(record, dict):
        return "no record"
    if record.get("format") != form:
        return "format"
    for field, most in TEXTS.items():
        if not isinstance(record.get(field), str) or not 1 <= len(record[field]) <= most:
            return field
    if record.get("status") not in STATUSES:
        return "status"
    commit = record.get("codeCommit")
    if commit is not None and not (isinstance(commit, str) and re.fullmatch("[a-f0-9]{7,40}", commit)):
        return "codeCommit"
    for field, fits in (("aggregateConfig", lambda x: isinstance(x, bool) or _number(x) or (isinstance(x, str) and len(x) <= MOST_VALUE)), ("aggregateMetrics", _number)):
        own = record.get(field, {})
        if not isinstance(own, dict) or not all(1 <= len(k) <= MOST_KEY and fits(v) for k, v in own.items()):
            return field
    categories = record.get("failureCategories", [])
    if not isinstance(categories, list) or not all(isinstance(c, str) and 1 <= len(c) <= MOST_CATEGORY for c in categories):
        return "failureCategories"
    for field in ("startedAt", "completedAt"):
        if record.get(field) is not None and not re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d(:\d\d(\.\d+)?)?Z", str(record[field])):
            return field
    return None


def _experiment(text: str, form: str) -> dict:
    try:
        record = json.loads(text, parse_constant=lambda _: 1 / 0)
    except (ValueError, ZeroDivisionError, RecursionError):
        return {"wrong": "malformed JSON", "run": None, "keys": None, "sensitive": []}
    wrong = _wrong(record, form)
    many = None
    if wrong is None:
        many = next((f for f in ("aggregateConfig", "aggregateMetrics") if len(record.get(f, {})) > MOST_KEYS), None)
    return {"wrong": wrong, "run": record["runId"] if wrong is None else None, "keys": many, "sensitive": sensitive_keys(record)}


_EXPERIMENT = T.StructType([T.StructField(c, T.StringType()) for c in ("wrong", "run", "keys")] + [T.StructField("sensitive", T.ArrayType(T.StringType()))])


def experiments(lines: DataFrame, form: str = "experiment-v1") -> DataFrame:
    """(file, line, run, error, sensitive) of line files (file, line, text): one row for each line that is not blank.

    Errors: ``malformed JSON``, the field that does not fit, ``repeated run`` (a run that an
    earlier accepted line of the file has), ``too many keys``. ``sensitive`` are the paths
    of keys that must not travel; a line may have them and be a record.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = [_experiment(t, form) for t in batch.column("text").to_pylist()]
            told = [pa.array([s[c] for s in said], pa.string()) for c in ("wrong", "run", "keys")]
            yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("line"), *told, pa.array([s["sensitive"] for s in said], pa.list_(pa.string()))], names=["file", "line", "wrong", "run", "keys", "sensitive"])

    own = lines.where(F.col("text").rlike(r"\S")).select("file", "line", "text").mapInArrow(read, "file string, line long, wrong string, run string, keys string, sensitive array<string>")
    own = cut(own)  # read three times
    claimed = own.where("run is not null and keys is null").groupBy("file", "run").agg(F.min("line").alias("first"))
    # Lines without a run would all meet in one task.
    joined = own.where("run is not null").join(claimed, ["file", "run"], "left").unionByName(own.where("run is null"), allowMissingColumns=True)
    error = F.coalesce("wrong", F.when(F.col("line") > F.col("first"), "repeated run"), F.when(F.col("keys").isNotNull(), "too many keys"))
    return joined.select("file", "line", "run", error.alias("error"), "sensitive")


def reference_items(spark: SparkSession, path: str) -> DataFrame:
    """(path, turn, key, item_type, title, creators, date, doi, url, tags, library, error) of reference manager exports: JSON lists of items, bare or wrapped as the web service sends them.

    A file that is no list is one row with an error, as is an item without key or type.
    """
    read = files(spark, path, "*.json").withColumn("text", F.try_validate_utf8(F.col("content").cast("string")))
    parsed = F.from_json("text", "array<string>")
    listed = F.trim("text").startswith("[") & F.try_parse_json("text").isNotNull()
    items = read.where(F.coalesce(listed, F.lit(False))).select("path", F.posexplode(parsed).alias("turn", "item"))
    wrapped = F.get_json_object("item", "$.data.key").isNotNull() & F.get_json_object("item", "$.key").isNotNull()
    data = F.when(wrapped, F.get_json_object("item", "$.data")).otherwise(F.col("item"))
    at = lambda name: F.get_json_object("data", f"$.{name}")
    names = F.transform(F.from_json(at("creators"), "array<struct<firstName: string, lastName: string, name: string>>"), lambda c: F.coalesce(c["name"], F.concat_ws(" ", c["firstName"], c["lastName"])))
    error = F.when(F.coalesce(F.length(at("key")), F.lit(0)).between(1, 64) & (F.coalesce(F.length(at("itemType")), F.lit(0)) > 0), None).otherwise("invalid item")
    rows = items.withColumns({"data": data, "library": F.when(wrapped, F.get_json_object("item", "$.library.id"))}).select(
        "path", "turn", at("key").alias("key"), at("itemType").alias("item_type"), F.coalesce(at("title"), F.lit("Untitled")).alias("title"), F.coalesce(names, F.array().cast("array<string>")).alias("creators"),
        F.coalesce(at("date"), F.lit("")).alias("date"), at("DOI").alias("doi"), at("url").alias("url"),
        F.coalesce(F.transform(F.from_json(at("tags"), "array<struct<tag: string>>"), lambda t: t["tag"]), F.array().cast("array<string>")).alias("tags"), "library", error.alias("error"),
    )
    return rows.unionByName(read.where(~F.coalesce(listed, F.lit(False))).select("path", F.lit(0).alias("turn"), F.lit("no list of items").alias("error")), allowMissingColumns=True)


def boards(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes (path, id, text, x, y, width, height), edges (path, id, source, target, label) and errors (path, what, id) of board files (nodes and edges in JSON).

    Errors: ``malformed`` files, ``invalid node`` or ``invalid edge`` (a field is missing or
    no number), ``repeated node`` (all but the first), ``dangling edge``. What has an error
    is not among nodes and edges.
    """
    read = files(spark, path, "*.canvas").withColumn("text", F.try_validate_utf8(F.col("content").cast("string")))
    fits = F.coalesce(F.try_parse_json("text").isNotNull() & F.trim("text").startswith("{"), F.lit(False))
    at = lambda kind: read.where(fits).select("path", F.posexplode(F.from_json(F.get_json_object("text", f"$.{kind}"), "array<string>")).alias("turn", "raw"))
    get = lambda name: F.get_json_object("raw", f"$.{name}")
    numbers = {c: get(c).try_cast("double") for c in ("x", "y", "width", "height")}
    named = lambda c: F.coalesce(F.length(c), F.lit(0)).between(1, 128)
    whole = lambda cs: F.forall(F.array(*cs), lambda c: c.isNotNull() & (F.abs(c) < F.lit(float("inf"))))
    nodes = at("nodes").select("path", "turn", get("id").alias("id"), get("text").alias("text"), *(v.alias(c) for c, v in numbers.items()), get("type").alias("type"))
    first = F.row_number().over(Window.partitionBy("path", "id").orderBy("turn"))
    good = named(F.col("id")) & (F.col("type") == "text") & F.col("text").isNotNull() & whole(map(F.col, numbers))
    nodes = nodes.withColumn("error", F.when(~F.coalesce(good, F.lit(False)), "invalid node").when(first > 1, "repeated node"))
    kept = nodes.where("error is null")
    edges = at("edges").select("path", get("id").alias("id"), get("fromNode").alias("source"), get("toNode").alias("target"), get("label").alias("label"))
    ends = kept.select("path", F.col("id").alias("end"))
    for side in ("source", "target"):
        held = ends.select("path", F.col("end").alias(side), F.lit(True).alias(f"has_{side}"))
        edges = edges.join(held, ["path", side], "left")
    valid = named(F.col("id")) & named(F.col("source")) & named(F.col("target"))
    edges = edges.withColumn("error", F.when(~valid, "invalid edge").when(F.col("has_source").isNull() | F.col("has_target").isNull(), "dangling edge"))
    errors = read.where(~fits).select("path", F.lit("malformed").alias("what"), F.lit(None).cast("string").alias("id"))
    for rows in (nodes, edges):
        errors = errors.union(rows.where("error is not null").select("path", F.col("error").alias("what"), "id"))
    return kept.select("path", "id", "text", *numbers), edges.where("error is null").select("path", "id", "source", "target", "label"), errors
