"""Symbols, calls and data objects of source files, and the edges between them."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.text import module_qualname

MAX_BYTES = 512 * 1024
SYMBOL = "path string, qualname string, name string, kind string, line_start int, line_end int, doc string, raises array<string>"
CALL = "path string, caller string, name string, receiver string, line int, args array<string>"
#: Confidence of an edge by how it was found (fixed values).
OMEGA = {"contains": 1.0, "same_scope": 1.0, "import": 0.9, "fuzzy": 0.5, "literal": 0.85, "identifier": 0.6, "stem": 0.75}


def _walk(path: str, text: str) -> tuple[list[tuple], list[tuple]]:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return [], []
    symbols, calls = [], []

    def raised(node: ast.AST) -> list[str]:
        names, open_ = set(), list(ast.iter_child_nodes(node))
        while open_:
            n = open_.pop()
            if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                continue  # what a nested symbol raises is its own
            if isinstance(n, ast.Raise) and n.exc is not None:
                e = n.exc.func if isinstance(n.exc, ast.Call) else n.exc
                names.add(e.id if isinstance(e, ast.Name) else getattr(e, "attr", ""))
            open_.extend(ast.iter_child_nodes(n))
        return sorted(names - {""})

    def visit(node: ast.AST, scope: str) -> None:
        for child in ast.iter_child_nodes(node):
            inner = scope
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                inner = f"{scope}.{child.name}" if scope else child.name
                kind = "class" if isinstance(child, ast.ClassDef) else "method" if scope and scope in classes else "function"
                if kind == "class":
                    classes.add(inner)
                symbols.append((path, inner, child.name, kind, child.lineno, child.end_lineno, ast.get_docstring(child), raised(child)))
            elif isinstance(child, ast.Call):
                f = child.func
                name = f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else None
                if name:
                    receiver = ast.unparse(f.value)[:60] if isinstance(f, ast.Attribute) else None
                    calls.append((path, scope, name, receiver, child.lineno, [ast.unparse(a)[:60] for a in child.args]))
            visit(child, inner)

    classes: set[str] = set()
    symbols.append((path, "", path.rsplit("/", 1)[-1].removesuffix(".py"), "module", 1, text.count("\n") + 1, ast.get_docstring(tree), []))
    visit(tree, "")
    return symbols, calls


def _small(text: str) -> bool:
    return len(text) * 4 <= MAX_BYTES or len(text.encode("utf-8", "surrogatepass")) <= MAX_BYTES


def unread_files(files: DataFrame) -> DataFrame:
    """Python files (path, text) that give no symbols, with why: empty, too_large (by bytes) or unparsable. Their text windows are made all the same."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(p, "empty" if not t else "too_large" if not _small(t) else "unparsable") for p, t in zip(pdf["path"], pdf["text"]) if not t or not _small(t) or not _walk(p, t)[0]]
            if rows:
                yield pd.DataFrame(rows, columns=["path", "reason"])

    return files.select("path", "text").mapInPandas(run, "path string, reason string")


def python_symbols(files: DataFrame) -> DataFrame:
    """Symbols of Python files (path, text): modules, classes, methods, functions. Files that do not parse or are too large give none."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [s for p, t in zip(pdf["path"], pdf["text"]) if t and _small(t) for s in _walk(p, t)[0]]
            if rows:
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in SYMBOL.split(", ")])

    return files.select("path", "text").mapInPandas(run, SYMBOL)


def python_calls(files: DataFrame) -> DataFrame:
    """Calls in Python files: caller is the enclosing symbol's name, '' at module level."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [c for p, t in zip(pdf["path"], pdf["text"]) if t and _small(t) for c in _walk(p, t)[1]]
            if rows:
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in CALL.split(", ")])

    return files.select("path", "text").mapInPandas(run, CALL)


def contains_edges(symbols: DataFrame) -> DataFrame:
    """CONTAINS edges from each symbol to the symbols directly inside it, by name."""
    parent = F.when(F.col("qualname") == "", None).when(F.contains("qualname", F.lit(".")), F.regexp_replace("qualname", r"\.[^.]*$", "")).otherwise("")
    child = symbols.select("path", F.col("qualname").alias("b"), parent.alias("a")).where("a is not null")
    held = symbols.select("path", F.col("qualname").alias("a"))
    return child.join(held, ["path", "a"]).select("path", "a", "b", F.lit("CONTAINS").alias("kind"), F.lit(OMEGA["contains"]).alias("omega"))


def invokes_edges(symbols: DataFrame, calls: DataFrame, stop: tuple[str, ...] = ("get", "run", "apply", "set", "add", "close")) -> DataFrame:
    """INVOKES edges: a bare name of the same file first; else a name that is unique among all symbols, unless it is on the stop list.

    Columns: a_path, a, b_path, b, omega, provenance, lines. Calls that no rule settles make no edge.
    """
    functions = symbols.where("kind in ('function', 'class')").select(F.col("path").alias("b_path"), F.col("qualname").alias("b"), "name")
    bare = calls.where("receiver is null").select(F.col("path").alias("a_path"), F.col("caller").alias("a"), "name", "line")
    near = bare.join(functions, (F.col("a_path") == F.col("b_path")) & (bare["name"] == functions["name"])).select("a_path", "a", "b_path", "b", "line", F.lit(OMEGA["same_scope"]).alias("omega"), F.lit("same_file").alias("provenance"))
    unique = symbols.where("kind in ('function', 'method')").groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("path", "qualname")).alias("s")).where("n = 1")
    settled = near.select("a_path", "a", "line").distinct()
    others = calls.where(~F.col("name").isin(*stop)).select(F.col("path").alias("a_path"), F.col("caller").alias("a"), "name", "line")
    far = others.join(settled, ["a_path", "a", "line"], "left_anti").join(unique, "name").select("a_path", "a", F.col("s.path").alias("b_path"), F.col("s.qualname").alias("b"), "line", F.lit(OMEGA["fuzzy"]).alias("omega"), F.lit("unique_name").alias("provenance"))
    found = near.unionByName(far).where("not (a_path = b_path and a = b)")
    best = found.groupBy("a_path", "a", "b_path", "b").agg(F.max(F.struct("omega", "provenance")).alias("_e"), F.array_sort(F.collect_set("line")).alias("lines"))
    return best.select("a_path", "a", "b_path", "b", "_e.omega", "_e.provenance", "lines")


def raises_edges(symbols: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Raised names that are classes of the repository as edges (path, a, b_path, b), and the rest by symbol."""
    raised = symbols.select("path", F.col("qualname").alias("a"), F.explode("raises").alias("name"))
    classes = symbols.where("kind = 'class'").groupBy("name").agg(F.min(F.struct("path", "qualname")).alias("c"))
    both = raised.join(classes, "name", "left")
    edges = both.where("c is not null").select("path", "a", F.col("c.path").alias("b_path"), F.col("c.qualname").alias("b"), F.lit(OMEGA["import"]).alias("omega"))
    return edges, both.where("c is null").groupBy("path", "a").agg(F.array_sort(F.collect_set("name")).alias("raises"))


def resolve_chain(links: DataFrame, depth: int = 5) -> DataFrame:
    """Re-exports followed to their end: name, target, hops (at most ``depth``); a name that does not end by then is left out."""
    from marlstone.session import checkpointed

    open_ = links.select(F.col("name").alias("origin"), F.col("target"), F.lit(1).alias("hops"))
    done = None
    for hop in range(1, depth + 1):
        step = open_.alias("o").join(links.alias("l"), F.col("o.target") == F.col("l.name"), "left")
        ended = step.where(F.col("l.name").isNull()).select(F.col("origin").alias("name"), F.col("o.target").alias("target"), "hops")
        done = ended if done is None else done.unionByName(ended)
        open_ = checkpointed(step.where(F.col("l.name").isNotNull()).select("origin", F.col("l.target").alias("target"), F.lit(hop + 1).alias("hops")))
    return done


def overrides(methods: DataFrame, bases: DataFrame, depth: int = 5) -> DataFrame:
    """OVERRIDES edges: a method and the nearest inherited one of its name, base classes breadth first in their order.

    ``methods``: cls, name; ``bases``: cls, base, pos.
    """
    reach = bases.select("cls", "base", F.lit(1).alias("hops"), F.array("pos").alias("order"))
    every = reach
    for hop in range(2, depth + 1):
        reach = reach.alias("r").join(bases.alias("b"), F.col("r.base") == F.col("b.cls")).select("r.cls", "b.base", F.lit(hop).alias("hops"), F.concat("r.order", F.array("b.pos")).alias("order"))
        every = every.unionByName(reach)
    inherited = every.join(methods.withColumnRenamed("cls", "base"), "base")
    met = methods.join(inherited, ["cls", "name"])
    return met.groupBy("cls", "name").agg(F.min(F.struct("hops", "order", "base")).alias("_m")).select("cls", "name", F.col("_m.base").alias("overrides"))


def ddl_tables(files: DataFrame) -> DataFrame:
    """Tables of SQL files (path, text): path, table_name, line (of the statement, from 1), columns. Statements end at ``;``."""
    parts = files.select("path", F.posexplode(F.split("text", ";")).alias("n", "statement"))
    lines = F.length("statement") - F.length(F.replace("statement", F.lit("\n"), F.lit("")))
    before = F.coalesce(F.sum(lines).over(Window.partitionBy("path").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    lead = F.regexp_extract("statement", r"(?is)^(.*?)create\s+table", 1)
    name = F.regexp_extract("statement", r"(?i)create\s+table\s+(?:if\s+not\s+exists\s+)?([\w.\"`]+)\s*\(", 1)
    body = F.regexp_extract("statement", r"(?is)create\s+table[^(]*\((.*)\)", 1)
    columns = F.filter(F.transform(F.split(body, r",(?![^(]*\))"), lambda c: F.regexp_extract(c, r"^\s*[\"`]?(\w+)[\"`]?\s+\w", 1)), lambda c: (c != "") & ~F.upper(c).isin("PRIMARY", "FOREIGN", "UNIQUE", "CHECK", "CONSTRAINT"))
    return parts.withColumn("line", before + F.length(lead) - F.length(F.replace(lead, F.lit("\n"), F.lit(""))) + 1).where(name != "").select("path", name.alias("table_name"), "line", columns.alias("columns"))


#: What statements of a database literal begin with, those that change something, and graph query clauses (fixed values).
SQL_HEADS = (
    r"SELECT\s", r"INSERT\s+(INTO|OR)\s", r"UPDATE\s+\S+\s+SET\s", r"DELETE\s+FROM\s", r"CREATE\s+(OR\s+REPLACE\s+)?(TEMP\s+|TEMPORARY\s+)?(TABLE|VIEW|INDEX|MATERIALIZED\s+VIEW)\s",
    r"DROP\s+(TABLE|VIEW|INDEX)\s", r"ALTER\s+TABLE\s", r"TRUNCATE\s+(TABLE\s+)?\S", r"REPLACE\s+INTO\s", r"MERGE\s+INTO\s", r"WITH\s+\w+\s+AS\s*\(",
)
SQL_WRITES = ("INSERT", "UPDATE", "DELETE", "CREATE", "DROP", "ALTER", "TRUNCATE", "REPLACE", "MERGE")
GRAPH_CLAUSES = (r"OPTIONAL\s+MATCH", r"DETACH\s+DELETE", "MATCH", "MERGE", "CREATE", "UNWIND", "RETURN", "SET", "REMOVE", "DELETE")
GRAPH_WRITES = ("CREATE", "MERGE", "SET", "DELETE", "REMOVE")
LITERAL_PATTERNS = {
    "named": r"[(\[]\s*\w*\s*:\s*[A-Za-z_]\w*", "clause": rf"\b({'|'.join(GRAPH_CLAUSES)})\b", "graph_write": rf"\b({'|'.join(GRAPH_WRITES)})\b",
    "sql": rf"(?i)^\s*({'|'.join(SQL_HEADS)})", "sql_write": rf"(?i)^\s*({'|'.join(SQL_WRITES)})\b", "sentence": r"[.!?]\s*$",
}


def literal_access(literal: Column) -> Column:
    """What a text literal does: cypher_write, cypher_read, sql_write, sql_read, or null. Graph queries are told first, by a clause in capitals and a
    named node or relation; a literal that ends like a sentence is no SQL."""
    has = {name: literal.rlike(pattern) for name, pattern in LITERAL_PATTERNS.items()}
    graph, sql = has["named"] & has["clause"], has["sql"] & ~has["sentence"]
    return F.when(graph & has["graph_write"], "cypher_write").when(graph, "cypher_read").when(sql & has["sql_write"], "sql_write").when(sql, "sql_read")


def tested_by(symbols: DataFrame, calls: DataFrame) -> DataFrame:
    """TESTED_BY edges between files: a unique module with the test file's stem, or a resolved call from a test to a symbol outside tests.

    Columns: a_path (tested), b_path (test), omega: the better of the two.
    """
    from marlstone.functions.text import is_test_path, test_stem

    modules = symbols.where("kind = 'module'").select("path", is_test_path("path").alias("is_test"), test_stem("path").alias("stem"))
    unique = modules.where("not is_test").groupBy("stem").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("a_path")).where("n = 1")
    by_stem = modules.where("is_test").join(unique, "stem").select("a_path", F.col("path").alias("b_path"), F.lit(OMEGA["stem"]).alias("omega"))
    edges = invokes_edges(symbols, calls)
    by_call = edges.where(is_test_path("a_path") & ~is_test_path("b_path")).select(F.col("b_path").alias("a_path"), F.col("a_path").alias("b_path"), F.when(F.col("omega") >= 0.9, F.lit(OMEGA["literal"])).otherwise(F.lit(OMEGA["identifier"])).alias("omega"))
    return by_stem.unionByName(by_call).groupBy("a_path", "b_path").agg(F.max("omega").alias("omega"))


def modified_symbols(hunks: DataFrame, own: DataFrame) -> DataFrame:
    """MODIFIES edges: per (sha, symbol id) churn and first hunk. ``hunks``: sha, path, first, last, pos; ``own``: path, line, id (innermost symbol)."""
    lines = hunks.select("sha", "path", "pos", F.explode(F.sequence("first", F.greatest("last", "first"))).alias("line"))
    return lines.join(own, ["path", "line"]).groupBy("sha", "id").agg(F.count(F.lit(1)).alias("churn"), F.min("pos").alias("first_hunk"))


def commit_order(commits: DataFrame) -> DataFrame:
    """PRECEDES edges between kept commits (sha, ordinal, 0 is newest): each to the next newer one."""
    newer = F.lag("sha").over(Window.partitionBy("repo").orderBy("ordinal", "sha"))
    return commits.withColumn("b", newer).where("b is not null").select("repo", F.col("sha").alias("a"), "b")


def renamed_paths(renames: DataFrame, paths: DataFrame, depth: int = 5) -> DataFrame:
    """Old paths at their present name: follows (name=old, target=new) to the end; unrenamed paths stay."""
    ends = resolve_chain(renames, depth).select(F.col("name").alias("path"), F.col("target").alias("present"))
    return paths.select("path").distinct().join(ends, "path", "left").select("path", F.coalesce("present", "path").alias("present"))


def module_names(files: DataFrame) -> DataFrame:
    return files.select("path", module_qualname("path").alias("module"))
