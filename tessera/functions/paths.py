"""Paths, routes and symbol names as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
CRITICAL = "(?i)auth|login|logout|session|token|password|passwd|credential|permission|role|acl|payment|billing|checkout|invoice|charge|refund|subscription|entitlement|crypto|encrypt|decrypt|secret|signature|security"
TYPE_KIND = "(?i)interface|type_alias|enum|struct|trait|class"
CONSTRUCTIBLE_KIND = "(?i)class|record|struct|interface|enum|type|trait|object|contract|module"
CALLABLE_KIND = "(?i)function|method|constructor|def|macro|command|predicate|init"
IDENTIFIER = r"^[A-Za-z_$][A-Za-z0-9_$]*$"
TEST_PATHS = (r"(^|/)(tests?|__tests__|spec|specs)/", r"\.(test|spec)\.[a-z0-9]+$", r"(^|/)test_[^/]+\.py$", r"_test\.(go|py|rb|exs?)$", r"tests?\.cs$")


def unify(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def is_path(text: Column) -> Column:
    return text.rlike(r"[/\\]") | text.rlike(r"(?i)\.[a-z0-9]{1,6}$")


def is_test_path(path: Column) -> Column:
    return F.lower(unify(path)).rlike("|".join(TEST_PATHS))


def is_critical(text: Column) -> Column:
    return text.rlike(CRITICAL)


def canonical_path(path: Column) -> Column:
    """Forward slashes, an upper-case drive, no doubled or trailing slash, no dot segments."""
    p = F.regexp_replace(unify(path), "/+", "/")
    p = F.regexp_replace(p, r"(^|/)(\./)+", "$1")
    for _ in range(8):  # a/../ folds one level at a time
        p = F.regexp_replace(p, r"(^|/)(?!\.\./)[^/]+/\.\./", "$1")
    p = F.when(p.rlike("^[a-z]:"), F.concat(F.upper(F.substring(p, 1, 1)), F.regexp_replace(p, "^.", ""))).otherwise(p)
    return F.when(F.length(p) > 1, F.regexp_replace(p, "/$", "")).otherwise(p)


def path_of(url: Column) -> Column:
    """The path of a URL: without origin, query and fragment, with a leading slash; null if nothing is left."""
    p = F.regexp_replace(F.regexp_replace(url, r"(?i)^[a-z]+://[^/]+", ""), r"[?#].*$", "")
    return F.when(p.startswith("/"), p).when(p != "", F.concat(F.lit("/"), p))


def normalise_path(path: Column) -> Column:
    """Placeholders of any style become *, so that both sides of a contract can meet."""
    p = path
    for pattern in (r"\$\{[^}]*\}", r":[A-Za-z_][A-Za-z0-9_]*", r"\{[^}]*\}", r"<[^>]*>"):
        p = F.regexp_replace(p, pattern, "*")
    p = F.lower(F.regexp_replace(p, "/+$", ""))
    return F.when(p == "", "/").otherwise(p)


def parameters_of(path: Column) -> Column:
    """Names a route path binds."""
    names = [F.regexp_extract_all(path, F.lit(p), F.lit(1)) for p in (r":([A-Za-z_][A-Za-z0-9_]*)", r"\{([A-Za-z_][A-Za-z0-9_]*)[^}]*\}", r"<(?:[a-z]+:)?([A-Za-z_][A-Za-z0-9_]*)>")]
    return F.array_distinct(F.concat(*names))


def module_of(path: Column) -> Column:
    """At most the first two directories; (root) for a file beside none."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) <= 1, "(root)").otherwise(F.array_join(F.slice(parts, F.lit(1), F.least(F.lit(2), F.size(parts) - 1)), "/"))


def directory_of(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(".")


def symbol_id(file: Column, qualified: Column) -> Column:
    return F.concat(F.lit("Symbol:"), file, F.lit(":"), qualified)


def qualified_name(sid: Column) -> Column:
    return F.regexp_replace(sid, "^.*:", "")


def parent_id(sid: Column) -> Column:
    """The id of the container that the name implies; null for a top-level name."""
    return F.when(qualified_name(sid).contains("."), F.regexp_replace(sid, r"\.[^.:/]*$", ""))


def label(sid: Column) -> Column:
    return F.regexp_replace(qualified_name(sid), r"^.*\.", "")


def container_candidates(dotted: Column, most: int = 4) -> Column:
    """Dotted prefixes, longest first."""
    parts = F.split(dotted, r"\.")
    n = F.size(parts)
    return F.slice(F.transform(F.sequence(n, F.lit(1), F.lit(-1)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), ".")), 1, most)


def source_span(ref: Column) -> Column:
    """path, first and last line of path#L1-L2."""
    pattern = r"^(.+?)#L([0-9]+)(?:-L([0-9]+))?$"
    first = F.regexp_extract(ref, pattern, 2).try_cast("int")
    return F.when(ref.rlike(pattern), F.struct(F.regexp_extract(ref, pattern, 1).alias("path"), first.alias("first"), F.coalesce(F.regexp_extract(ref, pattern, 3).try_cast("int"), first).alias("last")))


def mermaid_quote(text: Column, most: int = 60) -> Column:
    return F.substring(F.trim(F.regexp_replace(F.regexp_replace(text, r"""[\[\](){}"'`<>|]""", " "), r"\s+", " ")), 1, most)
