"""File sources: the walk with its reasons for skipping, ignore files, change stamps, lines, diffs, JSON sources."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.paths import unify
from tessera.model import CHUNKER_VERSION, HUNK, JOURNAL
from tessera.session import exists, keep, read_text

# Fixed values.
PROJECT_DOT_DIRS = ".github .gitlab .husky .circleci .devcontainer .buildkite .claude".split()
SKIP_DIRS = (
    "node_modules bower_components jspm_packages vendor Pods site-packages deps .venv venv .git .memory "
    "dist build _build target out obj Debug Release cmake-build-debug cmake-build-release __pycache__ .next .cache coverage htmlcov"
).split()
NAMED_ONLY = ".svg .drawio .puml .plantuml .mermaid .mmd .excalidraw .csv .tsv .rtf".split()
BINARY = (
    ".png .jpg .jpeg .gif .webp .bmp .ico .tiff .avif .mp3 .mp4 .wav .mov .avi .webm .ogg .flac .zip .gz .tar .rar .7z .bz2 .xz .jar .war .woff .woff2 .ttf .otf .eot "
    ".exe .dll .so .dylib .bin .o .a .class .wasm .pyc .pyo .node .db .sqlite .sqlite3 .pdf .doc .docx .xls .xlsx .ppt .pptx .odt .ods .psd .ai .sketch .fig .blend"
).split()
NEVER = ".env .pem .key .pfx .p12 .keystore .jks .crt .cer .lock .log .map .tsbuildinfo .pid .pack .idx .min.js .min.css .bundle.js .chunk.js".split()
NEVER_NAMES = (
    ".env.local .env.production .env.development package-lock.json yarn.lock pnpm-lock.yaml bun.lockb poetry.lock Cargo.lock composer.lock Gemfile.lock go.sum "
    "id_rsa id_ed25519 .npmrc .netrc credentials settings.local.json"
).split()
MAX_BYTES = 20_000_000
SNIFF_BYTES = 8192


def _any_of(names: list[str]) -> str:
    return "|".join(re.escape(n) for n in names)


def ignore_patterns(text: str) -> list[tuple[int, bool, str]]:
    """(number, negated, pattern) of an ignore file's rules: comments, ! , trailing and leading /, * ? and **."""
    rules = []
    for number, raw in enumerate(text.splitlines()):
        rule = raw.strip()
        if not rule or rule.startswith("#"):
            continue
        negated, rule = rule.startswith("!"), rule.removeprefix("!")
        folder, rule = rule.endswith("/"), rule.rstrip("/")
        anchored = "/" in rule
        rule = rule.lstrip("/")
        body = re.sub(r"\\\*\\\*/?|\\\*|\\\?", lambda m: {"\\*\\*/": "(?:.*/)?", "\\*\\*": ".*", "\\*": "[^/]*", "\\?": "[^/]"}[m.group()], re.escape(rule).replace("\\/", "/"))
        rules.append((number, negated, ("^" if anchored else "(?:^|/)") + body + ("/" if folder else "(?:/|$)")))
    return rules


def ignored(paths: DataFrame, rules: list[tuple[int, bool, str]]) -> DataFrame:
    """``paths`` (path) with ignored: the last rule that fits decides."""
    verdict = F.lit(False)
    for _, negated, pattern in rules:
        verdict = F.when(F.col("path").rlike(pattern), F.lit(not negated)).otherwise(verdict)
    return paths.withColumn("ignored", verdict)


def listed(spark: SparkSession, root: str) -> DataFrame:
    """path (under the root), size, at (whole path) of every file, whatever its name begins with.

    The Hadoop file system lists; Spark's own readers hide names that begin with _ or a dot. Only names and sizes pass the driver.
    """
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(root if "://" in root else "file://" + os.path.abspath(root))
    system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    base, found = system.makeQualified(where).toString().rstrip("/") + "/", []
    if system.exists(where):
        files = system.listFiles(where, True)
        while files.hasNext():
            one = files.next()
            at = one.getPath().toString()
            found.append((at.removeprefix(base), one.getLen(), at))
    return spark.createDataFrame(found, "path string, size long, at string")


def contents(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """``rows`` (at and more) with content, read on the executors, file by file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for batch in batches:
            for i in range(len(batch)):  # one file at a time: sizes differ by orders of magnitude
                part = batch.iloc[i : i + 1]
                at = part["at"].iloc[0]
                system, path = (fs.LocalFileSystem(), re.sub("^file:/+", "/", at)) if at.startswith("file:") else fs.FileSystem.from_uri(at)
                with system.open_input_stream(path) as f:
                    yield part.assign(content=[f.read()])

    schema = T.StructType([*rows.schema.fields, T.StructField("content", T.BinaryType())])
    return rows.repartition(spark.sparkContext.defaultParallelism * 4).mapInPandas(run, schema)


def walk(spark: SparkSession, root: str, rules: list[tuple[int, bool, str]] | None = None, named: list[str] | None = None) -> DataFrame:
    """path, size, reason, content of every file under ``root``; reason is null for files to read, content for the others.

    The first reason that fits stands: skipped folder, ignored, only when named, binary, secret or lock, too large, not text.
    All but the last are told from path and size, and such files are never opened. Files in ``named`` are read whatever the rules
    say, unless they are not text.
    """
    told = classify(ignored(listed(spark, root), rules or []), named or [])
    read = contents(spark, told.where("reason IS NULL"))
    text = read.withColumn("reason", F.when(_not_text(F.col("content")), "not text"))
    out = text.withColumn("content", F.when(F.col("reason").isNull(), F.col("content")))
    return out.unionByName(told.where("reason IS NOT NULL").withColumn("content", F.lit(None).cast("binary"))).select("path", "size", "reason", "content")


def _not_text(content: Column) -> Column:
    return F.hex(F.substring(content, 1, SNIFF_BYTES)).rlike("^(?:..)*?00")


def classify(rows: DataFrame, named: list[str]) -> DataFrame:
    """The reason column for path, size and ignored (and content, where it is there)."""
    parts = F.split("path", "/")
    dirs, name = F.slice(parts, F.lit(1), F.size(parts) - 1), F.lower(F.element_at(parts, -1))
    skipped_dir = F.exists(dirs, lambda d: d.isin(SKIP_DIRS) | (d.startswith(".") & ~d.isin(PROJECT_DOT_DIRS)))
    nul = _not_text(F.col("content")) if "content" in rows.columns else F.lit(False)
    reason = (
        F.when(skipped_dir, "skipped folder")
        .when(F.col("ignored"), "ignored")
        .when(name.rlike("(" + _any_of(NAMED_ONLY) + ")$"), "only when named")
        .when(name.rlike("(" + _any_of(BINARY) + ")$"), "binary")
        .when(name.isin([n.lower() for n in NEVER_NAMES]) | name.rlike("(" + _any_of(NEVER) + ")$"), "secret or lock")
        .when(F.col("size") > MAX_BYTES, "too large")
        .when(nul, "not text")
    )
    return rows.withColumn("reason", F.when(F.col("path").isin(named), F.when(nul, "not text")).otherwise(reason)).drop("ignored")


def resolve_target(spark: SparkSession, root: str, target: str) -> str:
    """A path under the root, else under the working folder; an error names both."""
    tried = [f"{root.rstrip('/')}/{target}", os.path.abspath(target)]
    for path in tried:
        if exists(spark, path):
            return path
    raise FileNotFoundError(f"neither {tried[0]} nor {tried[1]} exists")


def stamps(files: DataFrame, content: str = "content") -> DataFrame:
    """path, stamp: the reader's version and the hash of the content."""
    return files.select("path", F.concat(F.lit(f"{CHUNKER_VERSION}:"), F.sha2(F.col(content).cast("binary"), 256)).alias("stamp"))


def changed_files(files: DataFrame, known: DataFrame, force: bool = False) -> DataFrame:
    """Files whose stamp is not the one stored."""
    return files if force else files.join(stamps(files).join(known, ["path", "stamp"], "left_anti").select("path"), "path", "left_semi")


def vanished(known: DataFrame, listed: DataFrame, prefix: str = "") -> DataFrame:
    """Stored paths under the scanned prefix that are no longer there."""
    return known.where(F.col("path").startswith(prefix)).join(listed.select("path"), "path", "left_anti")


def lines(files: DataFrame, text: str = "text") -> DataFrame:
    """file_path, line, text."""
    return files.select(F.col("path").alias("file_path"), F.posexplode(F.split(F.col(text), "\r?\n"))).select("file_path", (F.col("pos") + 1).alias("line"), F.col("col").alias("text"))


def parse_diff(rows: DataFrame) -> DataFrame:
    """Hunks of unified diffs given as diff_id, line, text: paths and status are carried forward over the lines of a diff."""
    w = W.partitionBy("diff_id").orderBy("line").rowsBetween(W.unboundedPreceding, 0)
    t = F.col("text")
    section = F.sum(t.startswith("diff --git ").cast("int")).over(w)
    marked = rows.withColumn("section", section)
    inside = W.partitionBy("diff_id", "section").orderBy("line").rowsBetween(W.unboundedPreceding, 0)
    last = lambda value: F.last(value, ignorenulls=True).over(inside)
    new = F.when(t.rlike(r"^\+\+\+ b/"), F.regexp_extract(t, r"^\+\+\+ b/(.*)$", 1))
    old = F.when(t.rlike("^--- a/"), F.regexp_extract(t, "^--- a/(.*)$", 1))
    state = F.when(t.startswith("new file"), "added").when(t.startswith("deleted file"), "deleted").when(t.startswith("rename from"), "renamed")
    pattern = r"^@@ -([0-9]+)(?:,([0-9]+))? \+([0-9]+)(?:,([0-9]+))? @@"
    number = lambda i: F.regexp_extract("text", pattern, i)
    count = lambda i: F.when(number(i) == "", 1).otherwise(number(i).try_cast("int"))
    # the graph knows a renamed file by its old name
    named = marked.withColumn("file", F.coalesce(last(old), last(new))).withColumn("status", F.coalesce(last(state), F.lit("modified")))
    return named.where(t.rlike(pattern)).select("file", "status", number(1).cast("int").alias("old_start"), count(2).cast("int").alias("old_lines"), number(3).cast("int").alias("new_start"), count(4).cast("int").alias("new_lines"))


def read_diff(spark: SparkSession, path: str, separator: str | None = None) -> DataFrame:
    """Hunks of diff files; no file is an empty frame. With a ``separator`` a file holds many diffs, each a record of its own, however large the file."""
    if "://" not in path and not os.path.exists(path):
        return spark.createDataFrame([], HUNK)
    reader = spark.read.option("lineSep", separator) if separator else spark.read.option("wholetext", "true")
    number = F.monotonically_increasing_id().cast("string") if separator else F.input_file_name()
    raw = reader.text(path).select(number.alias("diff_id"), "value").select("diff_id", F.posexplode(F.split("value", "\r?\n")))
    return parse_diff(raw.select("diff_id", F.col("pos").alias("line"), F.col("col").alias("text")))


def commit_history(log: DataFrame, most: int = 100) -> DataFrame:
    """file, author, commits over the latest ``most`` commits of each file, from file, author, at."""
    recent = log.withColumn("n", F.row_number().over(W.partitionBy("file").orderBy(F.desc("at"), "author"))).where(F.col("n") <= most)
    return recent.groupBy("file", "author").agg(F.count("*").alias("commits"))


def changed_list(tracked: DataFrame, untracked: DataFrame | None = None) -> DataFrame:
    """Changed paths, with untracked ones for a working tree."""
    rows = tracked.select("path")
    return (rows if untracked is None else rows.union(untracked.select("path"))).distinct().orderBy("path")


def read_journal(spark: SparkSession, path: str) -> DataFrame:
    """Entries of session journals; lines that are not JSON are left out and can be counted by ``bad_lines``."""
    schema = T.StructType([*JOURNAL.fields, T.StructField("_corrupt_record", T.StringType())])
    return spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path).where("_corrupt_record IS NULL").drop("_corrupt_record")


def bad_lines(spark: SparkSession, path: str) -> int:
    return spark.read.text(path).where(F.trim("value") != "").where(F.try_parse_json("value").isNull()).count()


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A registry or group file; a missing or broken one is empty."""
    try:
        rows = json.loads(read_text(spark, path) or "[]")
        return spark.createDataFrame(rows if isinstance(rows, list) else [], schema)
    except (ValueError, TypeError):
        return spark.createDataFrame([], schema)


QUESTION = "id string, kind string, ask string, also string, expect array<string>, reject array<string>"


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """An evaluation set: {questions: [...]} or a bare array."""
    text = read_text(spark, path)
    if text is None:
        raise FileNotFoundError(path)
    data = json.loads(text)
    rows = data.get("questions", []) if isinstance(data, dict) else data
    keys = [c.split()[0] for c in QUESTION.split(", ")]
    return spark.createDataFrame([tuple(r.get(k) for k in keys) for r in rows], QUESTION)


def phrasings(questions: DataFrame) -> DataFrame:
    """query_id, text, expect, reject: each question in both its wordings."""
    both = F.explode(F.filter(F.array(F.struct(F.lit("a").alias("w"), F.col("ask").alias("text")), F.struct(F.lit("b").alias("w"), F.col("also").alias("text"))), lambda x: x["text"].isNotNull()))
    return questions.select("id", "expect", F.coalesce("reject", F.array().cast("array<string>")).alias("reject"), both.alias("q")).select(F.concat_ws("/", "id", "q.w").alias("query_id"), "q.text", "expect", "reject")


def harvest_questions(messages: DataFrame, least: int = 12, most: int = 300) -> DataFrame:
    """Questions that people asked in transcripts (role, text), once each."""
    asked = F.explode(F.regexp_extract_all("text", F.lit(r"([^.!?\n]+\?)"), F.lit(1)))
    rows = messages.where("role = 'user'").select(asked.alias("question")).select(F.trim("question").alias("question"))
    return rows.where(F.length("question").between(least, most)).distinct()


REGISTRY = "name string, root string, commit string"
GROUP = "name string, members array<string>"


def freshness(registry: DataFrame, heads: DataFrame) -> DataFrame:
    """Registered projects with fresh, stale or unknown, by the commit each was read at."""
    state = F.when(F.col("head").isNull() | F.col("commit").isNull(), "unknown").when(F.col("head") == F.col("commit"), "fresh").otherwise("stale")
    return registry.join(heads, "name", "left").withColumn("freshness", state)


def register(registry: DataFrame, projects: DataFrame) -> DataFrame:
    """The registry with projects added; one that is known gets its new root and commit."""
    return registry.join(projects.select("name"), "name", "left_anti").select(*projects.columns).unionByName(projects.dropDuplicates(["name"]))


def unregister(registry: DataFrame, groups: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Registry and groups without the projects of ``gone``; a group that loses its last member goes too."""
    left = registry.join(gone.select("name"), "name", "left_anti")
    member = groups.select("name", F.explode("members").alias("member")).join(gone.select(F.col("name").alias("member")), "member", "left_anti")
    return left, member.groupBy("name").agg(F.array_sort(F.collect_set("member")).alias("members"))


def set_group(groups: DataFrame, registry: DataFrame, name: str, members: list[str]) -> tuple[DataFrame, list[str]]:
    """Groups with ``name`` made of the members that are registered, and the names that aren't."""
    spark = groups.sparkSession
    asked = spark.createDataFrame([(m,) for m in members], "name string")
    known = [r.name for r in asked.join(registry.select("name"), "name", "left_semi").distinct().orderBy("name").collect()]
    rest = groups.where(F.col("name") != name)
    return (rest.unionByName(spark.createDataFrame([(name, known)], GROUP)) if known else rest), sorted(set(members) - set(known))


def list_projects(registry: DataFrame, heads: DataFrame, groups: DataFrame) -> DataFrame:
    """name, root, freshness, groups of every project."""
    of = groups.select(F.col("name").alias("in_group"), F.explode("members").alias("name")).groupBy("name").agg(F.array_sort(F.collect_set("in_group")).alias("groups"))
    return freshness(registry, heads).join(of, "name", "left").select("name", "root", "freshness", F.coalesce("groups", F.array().cast("array<string>")).alias("groups"))


def per_project(rows: DataFrame, work: Callable[[DataFrame], DataFrame], projects: list[str], at_once: int = 8) -> DataFrame:
    """``work`` for each project's rows (column project), at most ``at_once`` jobs side by side; results are kept tables, put together."""
    with ThreadPoolExecutor(max_workers=max(1, at_once)) as pool:
        done = list(pool.map(lambda p: keep(work(rows.where(F.col("project") == p)).withColumn("project", F.lit(p)), "project"), projects))
    out = done[0]
    for df in done[1:]:
        out = out.unionByName(df)
    return out


def canonical(df: DataFrame, col: str = "path") -> DataFrame:
    return df.withColumn(col, unify(F.col(col)))
