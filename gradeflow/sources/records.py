"""Record files: JSON Lines with a fixed schema, checksummed folders, write-once sinks, discovery and resuming."""

from __future__ import annotations

import hashlib
import json
import re
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.canonical import canonical_json
from ..operators.integrity import checksum, missing_and_unexpected
from .ordered import Versions
from .ranges import file_digests, file_ranges
from .shared import file_system, kept


def exists(spark: SparkSession, path: str) -> bool:
    fs, target = file_system(spark, path)
    return fs.exists(target)


# sources


def read_lines(spark: SparkSession, path: str | list[str], schema: StructType | str) -> DataFrame:
    """JSON Lines; blank lines are skipped, a malformed line fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_valid(spark: SparkSession, folder: str, schema: str, key: str, field: str = "record_checksum") -> DataFrame:
    """One JSON file a record; undecodable files and wrong checksums are dropped, of one key the last file by path counts."""
    raw = spark.read.schema(f"{schema}, {field} string, _corrupt string").option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt").json(folder)
    raw = raw.withColumn("_path", F.input_file_name())
    names = [c for c in raw.columns if c not in (field, "_corrupt", "_path")]
    good = raw.filter(F.col("_corrupt").isNull() & (F.col(field) == checksum(raw, *names)))
    return last_of_each(good, key, "_path").select(*names, field)


def last_of_each(df: DataFrame, key: str, order: str) -> DataFrame:
    """Of each key the row that stands last by ``order``."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(key, "_r.*")


def read_union(spark: SparkSession, pattern: str, schema: str, key: str) -> DataFrame:
    """All files of a pattern as one table; of a key in several files the last file by path counts."""
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(pattern).withColumn("_path", F.input_file_name())
    return last_of_each(rows, key, "_path").drop("_path")


def by_content(spark: SparkSession, folder: str) -> DataFrame:
    """(path, digest) of every file of a folder, read by byte ranges; up to 64 MB the plain SHA-256, beyond that of the ranges' digests."""
    return file_digests(spark, folder).select("path", "digest")


def source_of(spark: SparkSession, manifest: DataFrame, folder: str, digest: str = "source_digest") -> DataFrame:
    """``manifest`` with the path of the file that has the content it names; a digest without a file is an error."""
    files = by_content(spark, folder).groupBy("digest").agg(F.min("path").alias("path"))
    found = manifest.join(files.withColumnRenamed("digest", digest), digest, "left")
    return found.withColumn("path", F.coalesce("path", F.raise_error(F.concat(F.lit("no file with digest "), digest)).cast("string")))


def load_collection(spark: SparkSession, predictions: str, signatures: str, schema: str, other: str, key: str, field: str = "record_checksum") -> tuple[DataFrame, DataFrame]:
    """Both tables of a collection, if all checksums hold and both have the same keys; otherwise an error."""
    out = []
    for path, kind in ((predictions, schema), (signatures, other)):
        rows = read_lines(spark, path, f"{kind}, {field} string")
        names = [c for c in rows.columns if c != field]
        if rows.filter(~F.col(field).eqNullSafe(checksum(rows, *names))).limit(1).count():
            raise ValueError(f"a record of {path} does not match its checksum")
        out.append(rows)
    wrong = missing_and_unexpected(out[0], out[1], key).first()
    if wrong["missing"] or wrong["unexpected"] or wrong["duplicates"]:
        raise ValueError(f"keys differ: {wrong.asDict()}")
    return out[0], out[1]


def with_ablation(records: DataFrame, ablation: DataFrame, key: str, column: str) -> DataFrame:
    """``records`` with the fields of a second file of the same ids as a struct; null where it has none."""
    rest = [c for c in ablation.columns if c != key]
    return records.join(ablation.select(key, F.struct(*rest).alias(column)), key, "left")


def read_config(spark: SparkSession, path: str, limits: tuple[str, ...]) -> dict:
    """Settings of a JSON or YAML file whose ``limits`` must be positive whole numbers."""
    text = spark.read.option("wholetext", True).text(path).first()["value"]
    try:
        config = json.loads(text)
    except ValueError:
        import yaml

        config = yaml.safe_load(text)
    for name in limits:
        value = config.get(name)
        if not isinstance(value, int) or isinstance(value, bool) or value <= 0:
            raise ValueError(f"{name} must be a positive whole number, not {value!r}")
    return config


def checked_prompts(prompts: DataFrame, text: str = "template", digest: str = "digest") -> DataFrame:
    """``prompts``; a template whose digest isn't the one stated is an error."""
    wrong = F.sha2(text, 256) != F.col(digest)
    return prompts.withColumn(text, F.when(wrong, F.raise_error(F.concat(F.lit("changed prompt: "), text)).cast("string")).otherwise(F.col(text)))


def find_files(spark: SparkSession, folder: str, names: str = "*.json") -> DataFrame:
    """(path, name, text) of all files below a folder whose name fits and that aren't empty."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", names).load(folder)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("content").cast("string").alias("text"))


def below(path, folder: str):
    """The part of a file's path that lies below ``folder``."""
    plain = F.regexp_replace(path, "^[a-zA-Z0-9+.-]+:/*", "/")
    root = re.sub("^[a-zA-Z0-9+.-]+:/*", "/", folder.rstrip("/")) + "/"
    return F.substring(plain, F.lit(len(root) + 1), F.length(plain))


def artifacts(spark: SparkSession, folder: str, expected: list[str]) -> DataFrame:
    """(name, text) of each expected file by its path below ``folder``, null for one that isn't there."""
    wanted = spark.createDataFrame([(x,) for x in expected], "name string")
    return wanted.join(find_files(spark, folder, "*").select(below(F.col("path"), folder).alias("name"), "text"), "name", "left")


def file_counts(spark: SparkSession, folder: str) -> DataFrame:
    """(folder, files): the number of files directly in each folder, by its path below ``folder``; empty for that itself."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select(below(F.col("path"), folder).alias("p"))
    return files.groupBy(F.regexp_replace("p", "/?[^/]*$", "").alias("folder")).agg(F.count("*").alias("files"))


#: Why a file counts as left by an interrupted run.
PARTIAL_REASONS = ("temporary_file", "invalid_json", "checksum_mismatch")


def broken_files(spark: SparkSession, folder: str, schema: str, field: str = "record_checksum") -> DataFrame:
    """(path, reason) of the files of single records that an interrupted run left; nothing is deleted.

    Reasons in turn: a name that begins with ``tmp``; a ``.json`` file that isn't JSON of the schema; one whose checksum
    isn't that of its other fields. Files of other names are passed over.
    """
    kind = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    names = [f.name for f in kind.fields]
    read = F.from_json("text", f"{kind.toDDL()}, {field} string, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"})
    # Spark's own sources pass empty files over
    empty = file_ranges(spark, folder, digests=False).filter("size = 0").select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.lit("").alias("text"))
    files = find_files(spark, folder, "*").unionByName(empty).withColumn("r", read).select("path", "name", "text", "r.*")
    temporary, known, whole = F.col("name").startswith("tmp"), F.col("name").endswith(".json"), F.col("_corrupt").isNull() & (F.trim("text") != "")
    reason = F.when(temporary, PARTIAL_REASONS[0]).when(known & ~whole, PARTIAL_REASONS[1]).when(known & ~F.col(field).eqNullSafe(checksum(files, *names)), PARTIAL_REASONS[2])
    return files.select("path", reason.alias("reason")).filter("reason is not null")


def delete_broken(spark: SparkSession, folder: str, schema: str, confirmed: bool = False, field: str = "record_checksum") -> DataFrame:
    """What ``broken_files`` lists, with ``removed``; the files are deleted only if that is confirmed."""
    found = kept(broken_files(spark, folder, schema, field))
    for row in found.select("path").collect() if confirmed else []:  # leftovers of single records: some for each task that was stopped
        fs, target = file_system(spark, row["path"])
        fs.delete(target, False)
    return found.withColumn("removed", F.lit(confirmed))


# sinks


def with_checksum(df: DataFrame, field: str = "record_checksum") -> DataFrame:
    names = [c for c in df.columns if c != field]
    return df.withColumn(field, checksum(df, *names))


def write_once(df: DataFrame, path: str) -> None:
    """JSON Lines; refuses to replace what is there."""
    df.write.mode("errorifexists").json(path)


def write_atomically(df: DataFrame, path: str, order: list[str]) -> dict:
    """Replaces the records of ``path`` by those of ``df`` in one step: canonical lines in ``order`` as a version that counts once a pointer is renamed."""
    return Versions(df.sparkSession, path).replace(df.select(canonical_json(df).alias("value"), *order), order)


def read_current(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """The records that ``write_atomically`` put there last; a malformed line fails the read."""
    now = Versions(spark, path).current()
    if now is None:
        raise FileNotFoundError(path)
    return read_lines(spark, f"{path}/{now['version']}", schema)


def write_canonical(df: DataFrame, path: str, order: list[str]) -> dict:
    """Canonical JSON lines in ``order``, as files in the order of their names; refuses to replace what is there. Gives version, lines and digest."""
    files = Versions(df.sparkSession, path)
    if files.current() is not None:
        raise ValueError(f"{path} already exists")
    return files.replace(df.select(canonical_json(df).alias("value"), *order), order, after=0)


def compile_lines(manifest: DataFrame, records: DataFrame, key: str, order: str, path: str) -> dict:
    """The records of a manifest as one logical file in its order: version, lines and digest; a missing record is an error."""
    short = manifest.join(records.select(key), key, "left_anti").count()
    if short:
        raise ValueError(f"{short} records of the manifest are missing")
    rows = manifest.select(key, F.col(order).alias("_order")).join(records, key)
    lines = rows.select(canonical_json(rows.drop("_order")).alias("value"), "_order", key)
    return Versions(manifest.sparkSession, path).replace(lines, ["_order", key])


def write_or_equal(df: DataFrame, path: str) -> bool:
    """Write a decision once; later calls must bring the same rows. True if it was written now."""
    spark = df.sparkSession
    if not exists(spark, path):
        write_once(df, path)
        return True
    old = read_lines(spark, path, df.schema)
    if old.exceptAll(df).unionAll(df.exceptAll(old)).limit(1).count():
        raise ValueError(f"{path} holds another decision")
    return False


def next_report(spark: SparkSession, folder: str, prefix: str, digits: int = 3) -> str:
    """The path of the next numbered report; numbers are never used again while a report of theirs is there."""
    fs, target = file_system(spark, folder)
    names = [x.getPath().getName() for x in fs.listStatus(target)] if fs.exists(target) else []
    used = [int(m[1]) for m in (re.fullmatch(rf"{re.escape(prefix)}_(\d+)(?:\..*)?", n) for n in names) if m]
    return f"{folder}/{prefix}_{max(used, default=0) + 1:0{digits}d}"


def markdown(df: DataFrame, most_rows: int = 1_000) -> str:
    """A table of a report; more than ``most_rows`` rows are an error, as this is for summaries."""
    rows = df.limit(most_rows + 1).collect()
    if len(rows) > most_rows:
        raise ValueError(f"more than {most_rows} rows")
    cell = lambda v: "—" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v).replace("|", "\\|")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "-|" * len(df.columns)]
    return "\n".join([*lines, *("| " + " | ".join(map(cell, r)) + " |" for r in rows)])


def write_report(df: DataFrame, folder: str, prefix: str) -> tuple[str, str]:
    """The next numbered report as JSON lines, and its table; returns both."""
    path = next_report(df.sparkSession, folder, prefix)
    write_once(df, path)
    return path, markdown(df)


#: Where a model's folder has the artifacts of its report.
GATE_FILE, METADATA_FILE, CHECKSUM_FILE = "calibration_gate.json", "extraction_metadata/experiment.json", "verification_reports/artifact_checksums.json"


def model_artifacts(spark: SparkSession, root: str) -> DataFrame:
    """(section, name, gate, metadata, checksums, analyses): the artifacts below a model's folder as JSON texts, a row for each gate and dataset.

    Gates are ``calibration/NAME/calibration_gate.json``; datasets are folders of ``full``, and ``repairs/NAME/full`` as
    ``repair_NAME``; analyses are a map of the files in ``analysis``. What isn't there is null.
    """
    files = find_files(spark, root, "*.json").select(below(F.col("path"), root).alias("p"), "text")
    part = lambda pattern, i: F.regexp_extract("p", pattern, i)
    gates = files.filter(F.col("p").rlike(f"^calibration/[^/]+/{GATE_FILE}$")).select(F.lit("gate").alias("section"), part("^calibration/([^/]+)/", 1).alias("name"), F.lit("gate").alias("kind"), F.lit(None).cast("string").alias("file"), "text")
    inside = r"^(?:full/([^/]+)|repairs/([^/]+)/full)/(.*)$"
    own = files.filter(F.col("p").rlike(inside)).select(F.when(part(inside, 1) != "", part(inside, 1)).otherwise(F.concat(F.lit("repair_"), part(inside, 2))).alias("name"), part(inside, 3).alias("file"), "text")
    kind = F.when(F.col("file") == METADATA_FILE, "metadata").when(F.col("file") == CHECKSUM_FILE, "checksums").when(F.col("file").rlike("^analysis/[^/]+$"), "analysis")
    datasets = own.select(F.lit("dataset").alias("section"), "name", kind.alias("kind"), F.element_at(F.split("file", "/"), -1).alias("file"), "text")
    one = lambda k: F.max(F.when(F.col("kind") == k, F.col("text"))).alias(k)
    analyses = F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("kind") == "analysis", F.struct("file", "text")))))
    return gates.unionByName(datasets).groupBy("section", "name").agg(one("gate"), one("metadata"), one("checksums"), analyses.alias("analyses"))


def model_report(spark: SparkSession, root: str, folder: str, version: str) -> tuple[str, str]:
    """A numbered report of all a model's artifacts, nested by gate and dataset, and its summary as Markdown with the report's digest.

    A report is of some gates and datasets, each a row that the driver reads; a broken artifact is an error.
    """
    found = model_artifacts(spark, root).collect()
    read = lambda text: None if text is None else json.loads(text)
    gates = {r["name"]: read(r["gate"]) for r in found if r["section"] == "gate"}
    datasets = {r["name"]: {"metadata": read(r["metadata"]), "checksums": read(r["checksums"]), "analyses": {k: read(v) for k, v in r["analyses"].items()}} for r in found if r["section"] == "dataset"}
    text = json.dumps({"version": version, "model_root": root, "calibration_gates": gates, "datasets": datasets}, sort_keys=True, ensure_ascii=False, separators=(",", ":"))
    path = next_report(spark, folder, "report")
    fs, target = file_system(spark, f"{path}.json")
    out = fs.create(target, False)
    out.write(bytearray(text.encode()))
    out.close()
    return f"{path}.json", f"# {version}\n\nCalibration gates: {len(gates)}\n\nFull dataset directories: {len(datasets)}\n\nJSON checksum: `{text_digest(text)}`\n"


# resuming


def still_to_do(manifest: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows of a manifest whose key has no finished record."""
    return manifest.join(done.select(key).distinct(), key, "left_anti")


def complete(manifest: DataFrame, parts: list[DataFrame], key: str) -> DataFrame:
    """Rows of a manifest whose key stands in all parts."""
    for part in parts:
        manifest = manifest.join(part.select(key).distinct(), key, "left_semi")
    return manifest


def counted(df: DataFrame, name: str, **counts) -> tuple[DataFrame, Observation]:
    """``df`` with counters that are filled while it is written: all rows, and those where each condition holds."""
    seen = Observation(name)
    return df.observe(seen, F.count("*").alias("rows"), *(F.count_if(c).alias(k) for k, c in counts.items())), seen


def text_digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
