"""Chunks, declarations and relations of source files.

Declarations come from Python's own parser for Python and from line patterns for some other languages; files in any other language are chunked
by characters and give no declarations, and the report says so.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.session import spread

CHUNK_SIZE, OVERLAP = 1200, 120

# Language of an extension.
LANGUAGES = {
    "py": "python", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "java": "java", "go": "go",
    "cs": "csharp", "kt": "kotlin", "rs": "rust", "rb": "ruby", "php": "php", "swift": "swift", "scala": "scala", "c": "c", "h": "c", "cpp": "cpp", "hpp": "cpp", "vue": "vue",
    "md": "markdown", "markdown": "markdown", "txt": "text", "sh": "bash", "sql": "sql", "html": "html", "css": "css", "json": "json", "yaml": "yaml", "yml": "yaml", "toml": "toml",
    "lua": "lua", "dart": "dart", "ex": "elixir", "exs": "elixir", "hs": "haskell", "ml": "ocaml", "r": "r", "jl": "julia", "zig": "zig", "clj": "clojure", "lisp": "lisp",
}
#: Line patterns of declarations: language, pattern, kind; group 1 is the name.
LINE_RULES = (
    ("typescript javascript", r"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+([A-Za-z_$][\w$]*)", "class"),
    ("typescript", r"^\s*(?:export\s+)?interface\s+([A-Za-z_$][\w$]*)", "interface"),
    ("typescript javascript", r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*([A-Za-z_$][\w$]*)", "function"),
    ("typescript javascript", r"^\s*(?:export\s+)?const\s+([A-Za-z_$][\w$]*)\s*=\s*(?:async\s*)?\([^)]*\)\s*(?::[^=]+)?=>", "function"),
    ("typescript javascript", r"^\s+(?:public\s+|private\s+|protected\s+|static\s+|async\s+)*([A-Za-z_$][\w$]*)\s*\([^;]*\)\s*(?::[^{;]+)?\{", "method"),
    ("java csharp kotlin", r"^\s*(?:(?:public|private|protected|internal|static|final|abstract|sealed|partial|data|open)\s+)*(?:class|record|struct|object)\s+([A-Za-z_]\w*)", "class"),
    ("java csharp kotlin", r"^\s*(?:(?:public|private|protected|internal)\s+)*interface\s+([A-Za-z_]\w*)", "interface"),
    ("java csharp", r"^\s+(?:(?:public|private|protected|internal|static|final|async|override|virtual|abstract)\s+)+[\w<>\[\],.? ]+\s+([A-Za-z_]\w*)\s*\(", "method"),
    ("kotlin", r"^\s*(?:(?:public|private|internal|suspend|override|open)\s+)*fun\s+(?:[\w.<>]+\.)?([A-Za-z_]\w*)\s*\(", "function"),
    ("go", r"^func\s+(?:\([^)]*\)\s*)?([A-Za-z_]\w*)\s*\(", "function"),
    ("go", r"^type\s+([A-Za-z_]\w*)\s+(?:struct|interface)\b", "struct"),
    ("rust", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?fn\s+([A-Za-z_]\w*)", "function"),
    ("rust", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:struct|enum|trait)\s+([A-Za-z_]\w*)", "struct"),
    ("ruby", r"^\s*def\s+(?:self\.)?([A-Za-z_]\w*[!?]?)", "method"),
    ("ruby", r"^\s*(?:class|module)\s+([A-Z]\w*)", "class"),
    ("php", r"^\s*(?:(?:public|private|protected|static|abstract|final)\s+)*function\s+([A-Za-z_]\w*)", "function"),
    ("php", r"^\s*(?:(?:abstract|final)\s+)*class\s+([A-Za-z_]\w*)", "class"),
)
_NOT_NAMES = frozenset("if for while switch catch return function else do try with".split())


def language_of(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))), F.lit("unknown"))


def character_chunks(text: Column, size: int = CHUNK_SIZE, overlap: int = OVERLAP) -> Column:
    """(start, end) of windows of equal size and overlap that cover every character."""
    n, step = F.length(text), size - overlap
    count = F.when(n <= size, 1).otherwise(F.ceil((n - overlap) / step)).cast("int")
    return F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.struct((i * step).alias("start"), F.least(i * step + size, n).alias("end")))


def windows(text: str, size: int = CHUNK_SIZE, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """Windows that end at a line break past their middle where there is one; the next begins ``overlap`` before that end."""
    out, at = [], 0
    while True:
        end = min(len(text), at + size)
        if end < len(text):
            cut = text.rfind("\n", at + size // 2, end)
            end = cut + 1 if cut >= 0 else end
        out.append((at, end))
        if end >= len(text):
            return out
        at = max(end - overlap, at + 1)


def markdown_sections(text: str) -> list[tuple[list[str], int, int]]:
    """(headings in force, first, last line) of each section; headings inside fences are text."""
    stack: list[tuple[int, str]] = []
    out, start, fence = [], 1, None
    rows = text.split("\n")
    for i, row in enumerate(rows, 1):
        if m := re.match(r"\s*(```+|~~~+)", row):
            fence = None if fence and m[1][0] == fence else fence or m[1][0]
        elif not fence and (m := re.match(r"(#{1,6})\s+(.*?)\s*#*\s*$", row)):
            if i > start:
                out.append(([h for _, h in stack], start, i - 1))
            stack = [h for h in stack if h[0] < len(m[1])] + [(len(m[1]), m[2])]
            start = i
    out.append(([h for _, h in stack], start, len(rows)))
    return [(h, a, b) for h, a, b in out if any(r.strip() for r in rows[a - 1 : b])]


def chunk(path: str, text: str, size: int = CHUNK_SIZE, overlap: int = OVERLAP) -> list[dict]:
    """Chunks with headings, lines and mode: WHOLE, MARKDOWN, COMPONENT, PYTHON, REGEX or CHARACTER."""
    if not text.strip():
        return []
    language = LANGUAGES.get(path.rsplit(".", 1)[-1].lower(), "unknown")
    rows = text.split("\n")
    if len(text) <= size:
        return [{"headings": [], "first": 1, "last": len(rows), "text": text, "mode": "WHOLE"}]
    parts: list[tuple[list[str], int, int, str]] = []
    if language == "vue":
        parts = [([name], a, b, "COMPONENT") for name, a, b in component_blocks(text)]
    elif language == "markdown":
        parts = [(h, a, b, "MARKDOWN") for h, a, b in markdown_sections(text)]
    else:
        tops = sorted({d["start_line"] for d in declarations(path, text) if "." not in d["qualified"]})
        if tops:
            edges = [1, *[t for t in tops if t > 1], len(rows) + 1]
            parts = [([], a, b - 1, "PYTHON" if language == "python" else "REGEX") for a, b in zip(edges, edges[1:])]
    if not parts:
        parts = [([], 1, len(rows), "CHARACTER")]
    out = []
    for headings, a, b, mode in parts:
        body = "\n".join(rows[a - 1 : b])
        if not body.strip():
            continue
        for s, e in windows(body, size, overlap) if len(body) > size else [(0, len(body))]:
            first = a + body.count("\n", 0, s)
            out.append({"headings": headings, "first": first, "last": first + body.count("\n", s, e), "text": body[s:e], "mode": mode})
    return out


def _python(text: str) -> tuple[list[dict], list[dict], list[dict], list[dict]]:
    found, calls, imports, heirs = [], [], [], []
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        return found, calls, imports, heirs

    def visit(node: ast.AST, owner: list[str], local: bool, holder: str | None) -> None:
        for child in ast.iter_child_nodes(node):
            inner, inner_local, now = owner, local, holder
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)) and not local:
                inner = [*owner, child.name]
                now = ".".join(inner)
                kind = "class" if isinstance(child, ast.ClassDef) else "method" if owner else "function"
                found.append({"name": child.name, "qualified": now, "kind": kind, "start_line": child.lineno, "end_line": child.end_lineno or child.lineno})
                inner_local = kind != "class"
                if kind == "class":
                    heirs.extend({"qualified": now, "base": ast.unparse(b).split("[")[0].rsplit(".", 1)[-1]} for b in child.bases)
            elif isinstance(child, ast.Call):
                target = child.func
                if isinstance(target, ast.Name):
                    calls.append({"caller": holder, "name": target.id, "receiver": None, "line": child.lineno, "kind": "new" if target.id[:1].isupper() else "call"})
                elif isinstance(target, ast.Attribute):
                    receiver = target.value.id if isinstance(target.value, ast.Name) else None
                    calls.append({"caller": holder, "name": target.attr, "receiver": receiver, "line": child.lineno, "kind": "call"})
            elif isinstance(child, ast.Import):
                imports.extend({"module": a.name} for a in child.names)
            elif isinstance(child, ast.ImportFrom):
                imports.append({"module": "." * child.level + (child.module or "")})
            visit(child, inner, inner_local, now)

    visit(tree, [], False, None)
    return found, calls, imports, heirs


def declarations(path: str, text: str) -> list[dict]:
    """name, qualified, kind, start_line, end_line; of an overload the first keeps its lines."""
    language = _language(path)
    if language == "python":
        rows = _python(text)[0]
    elif language == "vue":
        rows = _by_lines("typescript", script_of(text))
    else:
        rows = _by_lines(language, text)
    seen: dict[str, dict] = {}
    for r in rows:
        seen.setdefault(r["qualified"], r)
    return list(seen.values())


def _by_lines(language: str, text: str) -> list[dict]:
    rules = [(re.compile(p), kind) for names, p, kind in LINE_RULES if language in names.split()]
    rows, out, depth, stack = text.split("\n"), [], 0, []
    for i, row in enumerate(rows, 1):
        while stack and depth <= stack[-1][1] and i > stack[-1][2]:
            stack.pop()
        for pattern, kind in rules:
            m = pattern.match(row)
            if m and m[1] not in _NOT_NAMES:
                owner = [s[0] for s in stack if s[3] in ("class", "interface", "struct")]
                if kind == "method" and not owner:
                    continue
                item = {"name": m[1], "qualified": ".".join([*owner, m[1]]), "kind": kind, "start_line": i, "end_line": _closing(rows, i)}
                out.append(item)
                stack.append((m[1], depth, item["end_line"], kind))
                break
        depth += row.count("{") - row.count("}")
    return out


def _closing(rows: list[str], start: int) -> int:
    """The line where braces opened at or soon after ``start`` balance; else the last line of deeper indentation."""
    depth, opened = 0, False
    for i in range(start, min(len(rows), start + 5000) + 1):
        depth += rows[i - 1].count("{") - rows[i - 1].count("}")
        opened |= "{" in rows[i - 1]
        if opened and depth <= 0:
            return i
        if not opened and i > start + 2:
            break
    indent = len(rows[start - 1]) - len(rows[start - 1].lstrip())
    last = start
    for i in range(start + 1, len(rows) + 1):
        row = rows[i - 1]
        if row.strip():
            if len(row) - len(row.lstrip()) <= indent:
                return i if row.strip() == "end" else last
            last = i
    return last


def python_dependences(text: str, first: int, last: int) -> list[dict]:
    """line, defines, uses, controlled_by of the statements of a Python declaration."""
    out = []
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        return out

    def names(node: ast.AST, kind: type) -> list[str]:
        return sorted({n.id for n in ast.walk(node) if isinstance(n, ast.Name) and isinstance(n.ctx, kind)})

    def visit(node: ast.AST, control: int | None) -> None:
        for child in ast.iter_child_nodes(node):
            line = getattr(child, "lineno", None)
            below = control
            if isinstance(child, ast.stmt) and line and first <= line <= last:
                head = child.test if isinstance(child, (ast.If, ast.While)) else child.iter if isinstance(child, ast.For) else None
                whole = not isinstance(child, (ast.If, ast.While, ast.For, ast.With, ast.Try, ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef))
                defines = names(child, ast.Store) if whole else names(child.target, ast.Store) if isinstance(child, ast.For) else []
                out.append({"line": line, "defines": defines, "uses": names(child, ast.Load) if whole else names(head, ast.Load) if head else [], "controlled_by": control})
                below = line if head is not None else control
            visit(child, below)

    visit(tree, None)
    return sorted(out, key=lambda r: r["line"])


SYMBOLS = "id string, name string, file_path string, kind string, start_line int, end_line int"
SITES = "call_id string, file_path string, from_symbol string, name string, receiver string, receiver_type string, line int, kind string"

SITE_NAMES = [c.split()[0] for c in SITES.split(", ")]
#: Files whose rows are held at a time in a worker.
FILES_AT_ONCE = 256


def _mapped(files: DataFrame, schema: str, make) -> DataFrame:
    """Rows of each file by ``make``, over all cores: parsing costs far more than moving a text."""
    names = StructType.fromDDL(schema).names

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), FILES_AT_ONCE):
                some = batch.iloc[at : at + FILES_AT_ONCE]
                rows = [r for path, text in zip(some["path"], some["text"]) for r in make(path, text or "")]
                yield pd.DataFrame(rows, columns=names)

    return spread(files.select("path", "text")).mapInPandas(run, schema)


def chunks_of(files: DataFrame) -> DataFrame:
    """path, n, of, headings, first, last, text, mode for every file (path, text)."""
    make = lambda path, text: [(path, i, len(c), x["headings"], x["first"], x["last"], x["text"], x["mode"]) for c in [chunk(path, text)] for i, x in enumerate(c, 1)]
    return _mapped(files, "path string, n int, of int, headings array<string>, first int, last int, text string, mode string", make)


def symbols_of(files: DataFrame) -> DataFrame:
    return _mapped(files, SYMBOLS, lambda path, text: [(f"Symbol:{path}:{d['qualified']}", d["name"], path, d["kind"], d["start_line"], d["end_line"]) for d in declarations(path, text)])


def relations_of(files: DataFrame) -> DataFrame:
    """path, calls, imports, bases, container, uses of every file: what it says about others, from one reading.

    Calls are exact for Python, by tokens for the languages of ``BRACES``. ``path`` of an import is where the module would lie; ``base`` is what a type
    names as its base; ``container`` is the file's namespace or package, or null; ``uses`` the namespaces it opens, its own among them.
    """

    def make(path: str, text: str) -> list[tuple]:
        found = relations_in(path, text)
        calls = [dict(zip(SITE_NAMES, (f"{path}:{c['line']}:{i}", path, f"Symbol:{path}:{c['caller']}" if c["caller"] else None, c["name"], c["receiver"], c.get("type"), c["line"], c["kind"]))) for i, c in enumerate(found.calls)]
        imports = [{"src": path, "module": m, "path": _module_path(path, m)} for m in found.imports]
        bases = [{"src": f"Symbol:{path}:{q}", "base": base} for q, base in found.bases]
        return [(path, calls, imports, bases, found.container, sorted({*found.uses, *([found.container] if found.container else [])}))]

    struct = lambda ddl: f"array<struct<{ddl.replace(' ', ': ').replace(',: ', ', ')}>>"
    return _mapped(files, f"path string, calls {struct(SITES)}, imports {struct('src string, module string, path string')}, bases {struct('src string, base string')}, container string, uses array<string>", make)


def _module_path(path: str, module: str) -> str:
    """The path that a module's name stands for: relative to the file where it says so, else from the root."""
    folder = path.split("/")[:-1]
    if _language(path) == "python":
        dots = len(module) - len(module.lstrip("."))
        base = folder[: len(folder) - dots + 1] if dots else []
        return "/".join([*base, *[p for p in module.lstrip(".").split(".") if p]])
    if module.startswith("."):
        for part in module.split("/"):
            folder = folder[:-1] if part == ".." else folder if part in (".", "") else [*folder, part]
        return "/".join(folder)
    return module if "/" in module else module.replace(".", "/")


@dataclass
class Relations:
    """What a file says about others: calls (caller, name, receiver, type, line, kind), modules, (type, base) pairs, its namespace and those it opens."""

    calls: list[dict] = field(default_factory=list)
    imports: list[str] = field(default_factory=list)
    bases: list[tuple[str, str]] = field(default_factory=list)
    container: str | None = None
    uses: list[str] = field(default_factory=list)


#: Languages with braces whose calls, imports and bases are read by tokens: those whose declarations are read too, without which the head of a function looks like a call.
BRACES = frozenset("typescript javascript java go csharp kotlin rust php vue".split())
#: How a module is named, per language; group 1 is the name.
IMPORT_RULES = (
    ("typescript javascript vue", r"""^\s*(?:import|export)\b[^'"`;]*?\bfrom\s*['"]([^'"]+)['"]"""),
    ("typescript javascript vue", r"""^\s*import\s*['"]([^'"]+)['"]"""),
    ("typescript javascript vue", r"""\b(?:require|import)\s*\(\s*['"]([^'"]+)['"]\s*\)"""),
    ("java kotlin", r"^\s*import\s+(?:static\s+)?([A-Za-z_][\w.]*[A-Za-z0-9_])\s*;?\s*$"),
    ("go", r"""^\s*(?:import\s+)?(?:[A-Za-z_.]\w*\s+)?"([^"\s]+)"\s*$"""),
    ("php", r"""^\s*(?:import|require|require_once|include)\s*\(?\s*['"]([^'"]+)['"]"""),
    ("c cpp", r"""^\s*#\s*include\s*"([^"]+)\""""),
    ("rust", r"^\s*(?:pub\s+)?mod\s+([a-z_]\w*)\s*;"),
)
CONTAINER_RULES = (("java kotlin", r"^\s*package\s+([A-Za-z_][\w.]*)"), ("csharp", r"^\s*namespace\s+([A-Za-z_][\w.]*)"), ("php", r"^\s*namespace\s+([A-Za-z_][\w\\]*)"), ("go", r"^package\s+([A-Za-z_]\w*)"))
USE_RULES = (("csharp", r"^\s*(?:global\s+)?using\s+(?:static\s+)?([A-Za-z_][\w.]*)\s*;"), ("java kotlin", r"^\s*import\s+(?:static\s+)?([A-Za-z_][\w.]*)\.[*_]\s*;?"), ("php", r"^\s*use\s+([A-Za-z_][\w\\]*)"))
_NOT_CALLS = frozenset("if for while switch catch return function func fn typeof sizeof nameof await yield else do try with when foreach using lock fixed defer go select throw throws super import require new delete in is as of and or not constructor".split())
_CALL = re.compile(r"(?:\b(new)\s+)?(?:\b([A-Za-z_$][\w$]*)\s*(?:\?\.|\.|::|->)\s*)?([A-Za-z_$][\w$]*)\s*(?:<[\w\s,.\[\]?]*>)?\(")
_TYPED = re.compile(r"\b(?:(?:const|let|var|val|final)\s+)?([A-Za-z_$][\w$]*)\s*(?::\s*([A-Z][\w]*)|(?::=|=)\s*(?:new\s+|&)?([A-Z]\w*)\s*[({])")
_DECLARED = re.compile(r"\b([A-Z]\w*)(?:<[^<>]*>)?\s+([a-z_]\w*)\s*(?=[=;,)])")
_HEIRS = re.compile(r"\b(?:class|interface|struct|record|object|trait)\s+([A-Za-z_$][\w$]*)(?:<[^{]*?>)?(?:\s*\([^)]*\))?([^{;]*)")
_MASK = re.compile(r"""//[^\n]*|/\*.*?\*/|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`""", re.S)


def _language(path: str) -> str:
    return LANGUAGES.get(path.rsplit(".", 1)[-1].lower(), "unknown")


def _rules(rules: tuple, language: str) -> list[re.Pattern]:
    return [re.compile(p, re.M) for names, p in rules if language in names.split()]


def masked(text: str) -> str:
    """The text with comments and what quotes hold as spaces, every line and column in its place."""
    return _MASK.sub(lambda m: re.sub(r"[^\n]", " ", m.group()), text)


def relations_in(path: str, text: str) -> Relations:
    """Relations of a file; none for a language that is not read."""
    language = _language(path)
    if language == "python":
        _, calls, imports, heirs = _python(text)
        return Relations(calls, [i["module"] for i in imports], [(h["qualified"], h["base"]) for h in heirs])
    if language not in BRACES:
        return Relations()
    code = script_of(text) if language == "vue" else text
    plain = masked(code)
    first = lambda rules: next((m[1] for r in _rules(rules, language) for m in r.finditer(plain)), None)
    imports = list(dict.fromkeys(m[1] for r in _rules(IMPORT_RULES, language) for m in r.finditer(code)))
    uses = list(dict.fromkeys(m[1] for r in _rules(USE_RULES, language) for m in r.finditer(plain)))
    found = declarations(path, text)
    return Relations(_calls(plain, found), imports, _bases(plain, found), first(CONTAINER_RULES), uses)


def _around(found: list[dict], line: int) -> str | None:
    """The innermost declaration of a line."""
    inside = [d for d in found if d["start_line"] <= line <= d["end_line"]]
    return min(inside, key=lambda d: (d["end_line"] - d["start_line"], d["qualified"]))["qualified"] if inside else None


def _calls(plain: str, found: list[dict]) -> list[dict]:
    heads = {(d["start_line"], d["name"]) for d in found}
    types = {m[1]: m[2] or m[3] for m in _TYPED.finditer(plain)} | {m[2]: m[1] for m in _DECLARED.finditer(plain)}
    out = []
    for number, row in enumerate(plain.split("\n"), 1):
        for m in _CALL.finditer(row):
            name, receiver = m[3], m[2]
            if (name in _NOT_CALLS and not receiver) or (number, name) in heads:
                continue
            receiver = None if receiver in ("this", "self", "base", "super", "return", "await") else receiver
            owner = _around(found, number)
            own = owner.rsplit(".", 1)[0] if owner and "." in owner and m[2] in ("this", "self") else types.get(receiver)
            out.append({"caller": owner, "name": name, "receiver": receiver, "type": own, "line": number, "kind": "new" if m[1] else "call"})
    return out


def _bases(plain: str, found: list[dict]) -> list[tuple[str, str]]:
    out = []
    for m in _HEIRS.finditer(plain):
        line = plain.count("\n", 0, m.start(1)) + 1
        own = next((d["qualified"] for d in found if d["name"] == m[1] and abs(d["start_line"] - line) <= 1), None)
        tail = re.sub(r"<[^<>]*>|\([^)]*\)", "", m[2])
        if own and (named := re.match(r"\s*(?::|extends\b|implements\b|<)(.*)", tail, re.S)):
            out += [(own, b.rsplit(".", 1)[-1]) for b in re.findall(r"[A-Za-z_$][\w$.]*", re.sub(r"\b(?:extends|implements|with|where\b.*)", ",", named[1])) if b[0].isalpha() or b[0] in "_$"]
    return list(dict.fromkeys(out))


def script_of(text: str) -> str:
    """The script blocks of a single-file component, every line in its place; all else is blank."""
    out, at = [], 0
    for m in re.finditer(r"<script\b[^>]*>(.*?)</script>", text, re.S | re.I):
        out += [re.sub(r"[^\n]", "", text[at : m.start(1)]), m[1]]
        at = m.end(1)
    return "".join([*out, re.sub(r"[^\n]", "", text[at:])])


def component_blocks(text: str) -> list[tuple[str, int, int]]:
    """(name, first, last line) of the top-level blocks of a single-file component: template, script, style and custom ones."""
    out, at = [], 0
    while m := re.compile(r"^<([A-Za-z][\w-]*)\b[^>]*>", re.M).search(text, at):
        end = re.compile(rf"^</{re.escape(m[1])}\s*>", re.M).search(text, m.end())
        stop = end.end() if end else m.end()
        out.append((m[1].lower(), text.count("\n", 0, m.start()) + 1, text.count("\n", 0, max(m.start(), stop - 1)) + 1))
        at = stop
    return out


def dependences(path: str, text: str, first: int, last: int) -> list[dict]:
    """line, defines, uses, controlled_by of the statements of a declaration: exact for Python, line by line for languages with braces."""
    if _language(path) == "python":
        return python_dependences(text, first, last)
    if _language(path) not in BRACES:
        return []
    out, stack, depth = [], [], 0
    word = re.compile(r"(?<![.\w$])[A-Za-z_$][\w$]*\b(?!\s*\()")
    for number, row in enumerate(masked(text).split("\n"), 1):
        if number > last:
            break
        while stack and (depth < stack[-1][1] or (depth == stack[-1][1] and row.strip().startswith("}"))):
            stack.pop()
        if number >= first and row.strip(" \t{}();"):
            target = re.match(r"\s*(?:(?:const|let|var|val|final|[A-Z][\w<>\[\]]*|int|long|double|bool|boolean|string|float|char)\s+)?([A-Za-z_$][\w$]*)\s*(?::[^=]+)?(?::=|[-+*/%|&^]?=(?!=))", row)
            names = [w for w in word.findall(row[target.end() :] if target else row) if w not in _NOT_CALLS and w not in ("const", "let", "var", "val", "final", "int", "long", "double", "bool", "string", "true", "false", "null", "nil")]
            out.append({"line": number, "defines": [target[1]] if target else [], "uses": sorted(set(names)), "controlled_by": stack[-1][0] if stack else None})
        opened = row.count("{") - row.count("}")
        if opened > 0 and re.match(r"\s*\}?\s*(?:else\s+)?(?:if|for|while|switch|else|foreach)\b", row):
            stack.append((number, depth + 1))
        depth += opened
    return out


def dense_files(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """Files with at least 500 chunks and more than one per 400 characters."""
    n = chunks.groupBy("path").agg(F.count("*").alias("chunks"))
    return n.join(files.select("path", F.length("text").alias("chars")), "path").where((F.col("chunks") >= 500) & (F.col("chunks") * 400 > F.col("chars")))
