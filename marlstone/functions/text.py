"""Text, name and identity functions as columns; all of them stay in the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Prefix of an id and the label of the node it names (fixed values).
LABELS = {"entity": "Entity", "passage": "Passage", "symbol": "Symbol", "data": "DataObject", "commit": "Commit", "fact": "Fact"}
#: Leading words that an answer is compared without (fixed values).
ARTICLES = ("a", "an", "the")
MIN_LETTERS = 3
ARG_WIDTH = 60
PREVIEW_WIDTH = 240


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_phrase(text: Column | str) -> Column:
    """Case-folded letters and digits, anything else a single space; null stays null."""
    folded = F.replace(F.lower(col(text)), F.lit("ß"), F.lit("ss"))
    return F.trim(F.regexp_replace(F.regexp_replace(folded, r"[^\p{L}\p{N}]", " "), " +", " "))


def fields_of_raw(raw: Column, names: Sequence[str]) -> dict[str, Column]:
    """Named values inside a text: a JSON object, or ``name: value`` or ``name=value`` pairs divided by ``;`` or ``|``.

    Names count in any order and letter case; the first of repeated names holds; what is not there is null.
    White space around the value of a pair is not part of it.
    """
    is_json = F.startswith(F.btrim(raw), F.lit("{"))
    entries = F.map_entries(F.from_json(F.when(is_json, raw), "map<string,string>"))
    any_name = "|".join(names)

    def named(name: str) -> Column:
        return F.filter(entries, lambda e: F.lower(F.btrim(e["key"])) == name)

    out = {}
    for name in names:
        held = named(name)
        pattern = rf"(?is)(?:^|[;|])\s*{name}\s*[:=](.*?)(?=[;|]\s*(?:{any_name})\s*[:=]|$)"
        pair = F.when(raw.rlike(pattern), F.btrim(F.regexp_extract(raw, pattern, 1)))
        out[name] = F.when(is_json, F.try_element_at(held, F.lit(1))["value"]).otherwise(pair)
    return out


def prefixed_id(prefix: str, content: Column | str) -> Column:
    return F.concat(F.lit(f"{prefix}-"), F.md5(col(content)))


def entity_id(name: Column | str) -> Column:
    """Id of an entity by its cleaned name."""
    return prefixed_id("entity", clean_phrase(name))


def fact_id(subject: Column | str, predicate: Column | str, object_: Column | str) -> Column:
    """Id of a triple of cleaned parts."""
    return prefixed_id("fact", F.concat_ws("\t", clean_phrase(subject), clean_phrase(predicate), clean_phrase(object_)))


def fact_text(subject: Column | str, predicate: Column | str, object_: Column | str) -> Column:
    return F.concat_ws(" ", col(subject), col(predicate), col(object_))


def label_of(node_id: Column | str) -> Column:
    """Label of a node id by its prefix; an unknown prefix is an error."""
    prefix = F.substring_index(col(node_id), "-", 1)
    out = F.when(col(node_id).isNull(), None)
    for key, label in LABELS.items():
        out = out.when(prefix == key, label)
    return out.otherwise(F.raise_error(F.concat(F.lit("unknown id prefix: "), col(node_id))))


def split_identifier(name: Column | str) -> Column:
    """Lower-case tokens of an identifier: split at separators, case humps and between letters and digits."""
    spaced = F.regexp_replace(col(name), r"[^\p{L}\p{N}]+", " ")
    spaced = F.regexp_replace(spaced, r"(\p{Lu}+)(\p{Lu}\p{Ll})", "$1 $2")
    spaced = F.regexp_replace(spaced, r"([\p{Ll}])(\p{Lu})", "$1 $2")
    spaced = F.regexp_replace(spaced, r"(\p{L})(\p{N})", "$1 $2")
    spaced = F.regexp_replace(spaced, r"(\p{N})(\p{L})", "$1 $2")
    return F.filter(F.split(F.lower(spaced), " "), lambda t: t != "")


def is_meaningful_phrase(text: Column | str) -> Column:
    """At least three letters or digits."""
    return F.length(F.regexp_replace(col(text), r"[^\p{L}\p{N}]", "")) >= MIN_LETTERS


def normalize_answer(text: Column | str) -> Column:
    """Lower case, then without ASCII punctuation, then without articles, then single spaces."""
    bare = F.regexp_replace(F.lower(col(text)), r"[!-/:-@\[-`{-~]", "")
    return F.array_join(F.filter(F.split(bare, r"\s+"), lambda w: (w != "") & ~w.isin(*ARTICLES)), " ")


def name_text(name: Column | str) -> Column:
    """Tokens of an identifier followed by its spelling, or the spelling alone where they are the same."""
    tokens = F.array_join(split_identifier(name), " ")
    return F.when(tokens == col(name), col(name)).otherwise(F.concat_ws(" ", tokens, col(name)))


def module_qualname(path: Column | str) -> Column:
    """Dotted module of a source path: without suffix and without a package's own file name."""
    bare = F.regexp_replace(F.regexp_replace(col(path), r"\.[A-Za-z0-9]+$", ""), r"(^|/)(__init__|index|mod)$", "")
    return F.replace(F.btrim(bare, F.lit("/")), F.lit("/"), F.lit("."))


def package_of(qualname: Column | str) -> Column:
    """Everything before the last dot; '' at top level."""
    return F.when(F.contains(col(qualname), F.lit(".")), F.regexp_replace(col(qualname), r"\.[^.]*$", "")).otherwise("")


def path_key(path: Column | str) -> Column:
    """Last part of a path, the bucket in which path suffixes are compared."""
    return F.element_at(F.split(F.replace(col(path), F.lit("\\"), F.lit("/")), "/"), -1)


def is_test_path(path: Column | str) -> Column:
    """A path inside a tests folder or with a test's file name."""
    p = F.lower(col(path))
    return p.rlike(r"(^|/)(tests?|__tests__|spec)/") | path_key(p).rlike(r"^test_|_test\.|\.test\.|\.spec\.|tests?\.cs$")


def test_stem(path: Column | str) -> Column:
    """File name without suffix and without what marks it as a test."""
    stem = F.regexp_replace(F.lower(path_key(path)), r"\.[^/]*$", "")
    return F.regexp_replace(F.regexp_replace(stem, r"^tests?_", ""), r"(_tests?|tests?)$", "")


def display_of(kind: Column | str, name: Column | str, module: Column | str) -> Column:
    """How a node is shown: commits by seven digits, tables with their kind, symbols under their module."""
    k, n = col(kind), col(name)
    return F.when(k == "commit", F.substring(n, 1, 7)).when(k.isin("table", "column", "collection"), F.concat_ws(" ", k, n)).otherwise(
        F.when(F.coalesce(col(module), F.lit("")) == "", n).otherwise(F.concat_ws(".", col(module), n))
    )


def normalise_url(url: Column | str) -> Column:
    """Scheme and host in lower case, default ports, fragment and trailing slash dropped."""
    u = F.regexp_replace(F.trim(col(url)), r"#.*$", "")
    head = F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)", 1))
    rest = F.regexp_replace(u, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*", "")
    head = F.regexp_replace(F.regexp_replace(head, r"^(http://.*):80$", "$1"), r"^(https://.*):443$", "$1")
    return F.concat(head, F.regexp_replace(rest, r"/+$", ""))


def normalise_path(path: Column | str) -> Column:
    """Relative path with forward slashes, without ``.`` parts and doubled slashes; null for a path that leaves its root."""
    parts = F.filter(F.split(F.replace(F.trim(col(path)), F.lit("\\"), F.lit("/")), "/"), lambda p: (p != "") & (p != "."))
    return F.when(F.array_contains(parts, ".."), None).otherwise(F.array_join(parts, "/"))


def normalise_sql_identifier(name: Column | str) -> Column:
    """Parts without quotes of any dialect, unquoted parts in lower case."""
    parts = F.split(F.trim(col(name)), r"\.")
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r'^["`\[]'), F.regexp_replace(p, r'^["`\[]|["`\]]$', "")).otherwise(F.lower(F.trim(p)))), ".")


def valid_triples(triples: Column | str) -> Column:
    """The arrays of exactly three parts, first of equals, in order."""
    return F.array_distinct(F.filter(col(triples), lambda t: F.size(t) == 3))


def clean_triples(triples: Column | str) -> Column:
    """Valid triples with cleaned parts, without those that lose subject or object."""
    cleaned = F.transform(valid_triples(triples), lambda t: F.transform(t, clean_phrase))
    return F.array_distinct(F.filter(cleaned, lambda t: (t[0] != "") & (t[2] != "")))


def unique_strings(values: Column | str) -> Column:
    """Stripped, without blanks, first of equals, in order."""
    return F.array_distinct(F.filter(F.transform(col(values), lambda v: F.trim(v)), lambda v: v != ""))


def split_answer(reply: Column | str) -> tuple[Column, Column]:
    """Thought and answer of a reply: parted at the last ``Answer:``; without one the whole reply is the answer."""
    r, pattern = col(reply), r"(?s)^(.*)Answer:(.*)$"
    there = r.rlike(pattern)
    return F.when(there, F.trim(F.regexp_extract(r, pattern, 1))).otherwise(""), F.when(there, F.trim(F.regexp_extract(r, pattern, 2))).otherwise(F.trim(r))


def preview(text: Column | str, width: int = PREVIEW_WIDTH) -> Column:
    return F.substring(col(text), 1, width)


def canonical_digest(*cols: Column | str) -> Column:
    """SHA-256 of the values in the given order, nulls told from empty texts."""
    return F.sha2(F.to_json(F.array(*[F.coalesce(F.to_json(F.array(col(c).cast("string"))), F.lit("null")) for c in cols])), 256)


def cut_argument(value: Column | str, width: int = ARG_WIDTH) -> Column:
    """A call's argument in at most ``width`` characters, the last one an ellipsis where it was cut."""
    v = col(value)
    return F.when(F.length(v) > width, F.concat(F.substring(v, 1, width - 1), F.lit("…"))).otherwise(v)


def render(template: str, **parts: Column | str) -> Column:
    """A text with ``{name}`` places filled by columns; a null part leaves nothing."""
    out, rest = [], template
    while "{" in rest:
        before, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        out += [F.lit(before), F.coalesce(col(parts[name]).cast("string"), F.lit(""))]
    return F.concat(*out, F.lit(rest))


def first_present(values: Sequence[Column | str]) -> Column:
    return F.coalesce(*[col(v) for v in values])
