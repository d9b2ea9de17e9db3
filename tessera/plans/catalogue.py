"""The catalogue: what a query is registered with."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import HAND_FOLDED, STOP_WORDS

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with the SQL that gives the same rows."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def sql_values(name: str, columns: str, rows: list[tuple]) -> str:
    """A CTE of literal rows."""
    literal = lambda v: "NULL" if v is None else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"
    return f"{name}({columns}) AS (VALUES {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in rows)})"


QUESTIONS = [
    ("q01", "tionble ererha onth"), ("q02", "password token secret"), ("q03", "gesch heit einung"), ("q04", "ciónque sta gata"), ("q05", "éaux leçre ment"), ("q06", "pathetic idiot"),
    ("q07", "all rights reserved"), ("q08", "ouwhea threlyes ofthstthor"), ("q09", "Thinges and thatre"), ("q10", "keit ungen über"), ("q11", "haat eredts onder"), ("q12", "onAtHe re_ered"),
]
QUESTIONS_SQL = sql_values("questions", "query_id, text", QUESTIONS)


def fold_sql(c: str) -> str:
    for k, v in HAND_FOLDED.items():
        c = f"replace({c}, '{k}', '{v}')"
    return f"strip_accents({c})"


def terms_sql(source: str, node: str, text: str, name: str = "terms") -> str:
    """CTEs that end in ``name`` (node_id, term): the tokeniser in SQL, without CJK."""
    stops = ", ".join(f"'{w}'" for w in STOP_WORDS)
    return rf"""
{name}_runs AS (SELECT {node} AS node_id, unnest(regexp_extract_all(coalesce({text}, ''), '[\p{{L}}\p{{N}}_]+')) AS run FROM {source}),
{name}_folds AS (SELECT node_id, run, {fold_sql('run')} AS folded, regexp_full_match(run, '[\x00-\x7f]*') AS plain FROM {name}_runs),
{name}_parts AS (SELECT *, list_filter(string_split(lower(replace(regexp_replace(folded, '([\p{{Ll}}\p{{N}}])(\p{{Lu}})', '\1 \2', 'g'), '_', ' ')), ' '), lambda p: p <> '') AS parts FROM {name}_folds),
{name}_words AS (SELECT node_id, plain, unnest(parts) AS p FROM {name}_parts),
{name}_cut AS (SELECT node_id, plain, p, CASE WHEN length(p) > 3 AND p LIKE '%s' AND p NOT LIKE '%us' THEN left(p, length(p) - 1) ELSE p END AS w FROM {name}_words
  WHERE length(p) >= 2 AND NOT (plain AND p IN ({stops}))),
{name} AS (
  SELECT node_id, CASE WHEN NOT plain THEN p
    WHEN length(p) > 4 AND p LIKE '%ies' THEN left(p, length(p) - 3) || 'y'
    WHEN length(p) > 4 AND p LIKE '%sses' THEN left(p, length(p) - 2)
    WHEN length(p) > 3 AND p LIKE '%ss' THEN p
    WHEN length(w) > 5 AND w LIKE '%ing' THEN left(w, length(w) - 3)
    WHEN length(w) > 4 AND w LIKE '%ed' THEN left(w, length(w) - 2) ELSE w END AS term FROM {name}_cut
  UNION ALL SELECT node_id, lower(folded) FROM {name}_parts WHERE len(parts) > 1
  UNION ALL SELECT node_id, lower(run) FROM {name}_parts WHERE NOT plain AND length(run) >= 2 AND lower(run) <> lower(folded))"""


def levels_sql(edges: str, seeds: str, depth: int) -> str:
    """CTEs that end in found (source, node, depth, confidence, parent): a breadth-first search, level by level."""
    parts = [f"l0 AS (SELECT source, node, 0 AS depth, 1.0::DOUBLE AS confidence, NULL AS parent FROM {seeds})"]
    for d in range(1, depth + 1):
        seen = " UNION ALL ".join(f"SELECT source, node FROM l{i}" for i in range(d))
        parts.append(
            f"""l{d} AS (SELECT source, dst AS node, {d} AS depth, max(conf) AS confidence, arg_min(up, (-conf, up)) AS parent FROM
  (SELECT l.source, e.dst, round(l.confidence * e.confidence, 9) AS conf, l.node AS up FROM l{d - 1} l JOIN {edges} e ON e.src = l.node) x
  WHERE (source, dst) NOT IN ({seen}) GROUP BY source, dst)"""
        )
    return ",\n".join(parts) + ",\nfound AS (" + " UNION ALL ".join(f"SELECT * FROM l{d}" for d in range(depth + 1)) + ")"


# --- a code graph made from the part table: every fourth part is a class with three methods --------------


def _declared(p: Column) -> tuple[Column, Column, Column]:
    """The file, the first part's number and the id of the declaration that a part stands for."""
    g = (p - p % 4).cast("long")
    where = F.concat(F.when(g % 40 == 0, "tests/m").otherwise("src/m"), (g % 20).cast("string"), F.lit("/f"), (g % 28).cast("string"), F.lit(".ts"))
    tail = F.when(p % 4 == 0, F.concat(F.lit("C"), g.cast("string"))).otherwise(F.concat(F.lit("C"), g.cast("string"), F.lit(".fn"), p.cast("string")))
    return where, g, F.concat(F.lit("Symbol:"), where, F.lit(":"), tail)


def code_graph(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Edges join parts by number and name their ends afterwards. Tables that grow with part are joined by sorting: a file's size tells little of how large its names become, so
    the planner would take them for small and send them through the driver."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("p"), F.col("p_size").alias("size"))
    where, g, name = _declared(F.col("p"))
    is_class = F.col("p") % 4 == 0
    symbol = part.select(
        "p", "size", name.alias("id"), F.when(is_class, F.concat(F.lit("C"), (g % 50).cast("string"))).otherwise(F.concat(F.lit("fn"), (F.col("p") % 97).cast("string"))).alias("name"),
        where.alias("file_path"), F.when(is_class, "class").otherwise("method").alias("kind"), ((F.col("p") % 4) * 10 + 1).cast("int").alias("start_line"), F.when(is_class, 40).otherwise((F.col("p") % 4) * 10 + 9).cast("int").alias("end_line"),
    ).hint("merge")
    ids = part.select(F.col("p").alias("q")).hint("merge")
    (to_file, _, to), steps = _declared(F.col("q")), [(2, F.lit(True), "import"), (5, F.col("p") % 3 == 0, "unique"), (3, F.col("p") % 7 == 1, "other")]
    pairs = None
    for by, when, sure in steps:
        one = part.where(when & (F.col("p") >= by)).select("p", F.floor(F.col("p") / by).alias("q"), F.lit(by).alias("line"), F.lit(sure).alias("confidence")).join(ids, "q").where("p <> q")
        pairs = one if pairs is None else pairs.unionByName(one)
    calls = pairs.select(name.alias("src"), to.alias("dst"), F.lit("f").alias("name"), "line", "confidence")
    inherits = part.where(is_class & (F.col("p") >= 16)).select("p", (F.floor(F.col("p") / 16) * 4).alias("q")).join(ids, "q").select(name.alias("src"), to.alias("dst"), F.lit("import").alias("confidence"))
    files = symbol.groupBy("file_path").agg(F.min("p").alias("f"))
    imports = pairs.select(where.alias("src"), to_file.alias("dst"), F.lit("m").alias("module")).where("src <> dst").distinct()
    return {"symbol": symbol, "calls": calls, "inherits": inherits, "imports": imports, "files": files}


CODE_SQL = """
parts AS (SELECT p_partkey AS p, p_size AS size, p_partkey - p_partkey % 4 AS g FROM part),
placed AS (SELECT *, (CASE WHEN g % 40 = 0 THEN 'tests/m' ELSE 'src/m' END) || (g % 20) || '/f' || (g % 28) || '.ts' AS file_path FROM parts),
symbol AS (SELECT p, size, 'Symbol:' || file_path || ':C' || g || CASE WHEN p % 4 = 0 THEN '' ELSE '.fn' || p END AS id,
  CASE WHEN p % 4 = 0 THEN 'C' || (g % 50) ELSE 'fn' || (p % 97) END AS name, file_path, CASE WHEN p % 4 = 0 THEN 'class' ELSE 'method' END AS kind,
  (p % 4) * 10 + 1 AS start_line, CASE WHEN p % 4 = 0 THEN 40 ELSE (p % 4) * 10 + 9 END AS end_line, file_path LIKE 'tests/%' AS is_test FROM placed),
calls AS (
  SELECT a.id AS src, b.id AS dst, 0.85::DOUBLE AS confidence FROM symbol a JOIN symbol b ON b.p = a.p // 2 WHERE a.p >= 2
  UNION ALL SELECT a.id, b.id, 0.7 FROM symbol a JOIN symbol b ON b.p = a.p // 5 WHERE a.p >= 5 AND a.p % 3 = 0
  UNION ALL SELECT a.id, b.id, 0.5 FROM symbol a JOIN symbol b ON b.p = a.p // 3 WHERE a.p >= 3 AND a.p % 7 = 1),
inherits AS (SELECT a.id AS src, b.id AS dst, 0.85::DOUBLE AS confidence FROM symbol a JOIN symbol b ON b.p = (a.p // 16) * 4 WHERE a.kind = 'class' AND a.p >= 16),
member AS (SELECT b.id AS parent, a.id AS child FROM symbol a JOIN symbol b ON b.p = a.p - a.p % 4 WHERE a.p % 4 <> 0),
imports AS (SELECT DISTINCT a.file_path AS src, b.file_path AS dst FROM calls c JOIN symbol a ON a.id = c.src JOIN symbol b ON b.id = c.dst WHERE a.file_path <> b.file_path)"""


def load_all() -> None:
    """Import the modules that register queries."""
    import importlib

    for path in sorted(Path(__file__).parent.glob("q_*.py")):
        importlib.import_module(f"tessera.plans.{path.stem}")
