"""Text as columns: names, hashes, token estimates, keywords, extractors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that are not table names.
SQL_WORDS = ("SELECT", "INSERT", "UPDATE", "DELETE", "FROM", "WHERE", "JOIN", "SET", "INTO", "VALUES", "AND", "OR", "NOT", "NULL", "LIKE", "ORDER", "GROUP", "HAVING")
CAMEL = r"(?<=\p{Ll})(?=\p{Lu})|(?<!^)(?=\p{Lu}\p{Ll})"
DIMENSIONS = 384


def method_id(project: Column, qualified: Column) -> Column:
    return F.concat(F.lit("method:"), project, F.lit("::"), qualified)


def qualified_name(namespace: Column, cls: Column, method: Column, params: Column) -> Column:
    """ns.Class.method(p1, p2); empty parts are left out."""
    return F.concat(F.concat_ws(".", F.nullif(namespace, F.lit("")), F.nullif(cls, F.lit("")), method), F.lit("("), F.concat_ws(", ", params), F.lit(")"))


def project_path(path: Column) -> Column:
    return F.lower(F.trim(F.translate(path, "\\", "/")))


def short_id(node_id: Column) -> Column:
    return F.substring_index(node_id, "::", -1)


def called_name(expression: Column) -> Column:
    """The method's name of a call: before ``(`` and ``<``, after the last dot."""
    return F.substring_index(F.substring_index(F.substring_index(expression, "(", 1), "<", 1), ".", -1)


def camel_words(name: Column) -> Column:
    return F.split(name, CAMEL)


def keywords(text: Column) -> Column:
    """Distinct lower-case words of more than one letter: camel parts and parts between ``. _ - /`` and spaces."""
    parts = F.flatten(F.transform(F.split(text, r"[\s._\-/,]+"), lambda w: F.concat(F.array(w), F.split(w, CAMEL))))
    return F.array_sort(F.array_distinct(F.filter(F.transform(parts, F.lower), lambda w: F.length(w) > 1)))


def token_estimate(text: Column) -> Column:
    """CJK characters, a quarter of the others and half the marks; 1 at least, 0 for nothing."""
    cjk = F.regexp_count(text, F.lit("[\\x{4e00}-\\x{9fff}]"))
    marks = F.regexp_count(text, F.lit(r"[(){};.,><  /\\_:]"))
    other = F.length(text) - cjk
    return F.when(F.length(text) == 0, 0).otherwise(F.greatest(cjk + (other / 4).cast("int") + (marks / 2).cast("int"), F.lit(1)))


def word_estimate(text: Column, n_keywords: Column) -> Column:
    return F.size(F.filter(F.split(text, r"[ \n\r\t]"), lambda w: F.length(F.trim(w)) > 0)) + 3 * n_keywords


def content_hash(text: Column) -> Column:
    return F.upper(F.substr(F.sha2(text.cast("binary"), 256), F.lit(1), F.lit(16)))


def hash_embedding(text: Column, dims: int = DIMENSIONS) -> Column:
    """A unit vector made of a text's SHA-256: pairs of its bytes, over and over."""
    digest = F.sha2(text.cast("binary"), 256)

    def value(i: Column) -> Column:
        return (F.conv(F.substr(digest, (2 * (i % 30) + 1).cast("int"), F.lit(4)), 16, 10).cast("double") - 32768) / 32768

    raw = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), value)
    norm = F.sqrt(F.aggregate(F.transform(raw, lambda x: x * x), F.lit(0.0), lambda a, x: a + x))
    return F.when(norm > 1e-8, F.transform(raw, lambda x: x / norm)).otherwise(raw)


def tables_of(text: Column) -> Column:
    """Table names in SQL within a text."""
    found = F.regexp_extract_all(text, F.lit(r"(?i)(?:INSERT\s+INTO|UPDATE|DELETE\s+FROM|FROM|JOIN)\s+[\[`\"]?(\w+)"), 1)
    return F.array_sort(F.array_distinct(F.filter(found, lambda t: ~F.upper(t).isin(*SQL_WORDS))))


def urls_of(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(r"https?://[^\s\"'<]+"), 0)))


#: Endings of transfer types, and words of a query.
TRANSFER = r"[Dd][Tt][Oo]|VO|Result|Request|Response"
QUERY_WORDS = ("SELECT", "INSERT", "UPDATE", "DELETE", "FROM", "WHERE", "JOIN")


def literals(body: Column) -> Column:
    """String literals of a body."""
    return F.regexp_extract_all(body, F.lit('"([^"]*)"'), 1)


def _joined(texts: Column, first: int) -> Column:
    return F.array_join(F.slice(texts, 1, first), "\x01")


def first_of_case(names: Column) -> Column:
    """Names in order, of those that differ in case alone the first."""
    ordered = F.array_sort(F.array_distinct(names))
    lower = F.transform(ordered, F.lower)
    return F.filter(ordered, lambda w, i: F.array_position(lower, F.lower(w)) == i + 1)


def tables_in(texts: Column, most: int = 10) -> Column:
    """Tables and entities that queries among the first 50 literals name."""
    joined = _joined(texts, 50)
    named = F.regexp_extract_all(joined, F.lit(r"(?i)(?:INSERT\s+INTO|UPDATE|DELETE\s+FROM|FROM|JOIN)\s+[\[`\"]?(\w+)"), 1)
    named = F.filter(named, lambda w: (F.length(w) > 1) & ~F.upper(w).isin(*SQL_WORDS))
    entities = F.filter(F.regexp_extract_all(joined, F.lit(r"\b(?:[A-Z][a-z]+){2,}\b"), 0), lambda w: F.length(w) > 3)
    return F.slice(first_of_case(F.concat(named, entities)), 1, most)


def urls_in(texts: Column, body: Column, most: int = 8) -> Column:
    """Addresses in the first 30 literals, and templates of route attributes."""
    marked = F.regexp_extract_all(body, F.lit(r"(?i)(?:HttpGet|HttpPost|Route)\(@?\"([^\"]+)\"\)"), 1)
    found = F.concat(F.regexp_extract_all(_joined(texts, 30), F.lit(r"https?://[^\s\"'\x01]+"), 0), marked)
    return F.slice(F.array_sort(F.array_distinct(F.filter(found, lambda w: F.length(w) > 1))), 1, most)


def files_in(texts: Column, most: int = 5) -> Column:
    """Paths among the first 20 literals: from a drive, a folder above or here, or home, with an ending."""
    paths = F.filter(F.slice(texts, 1, 20), lambda w: w.rlike(r"(?i)^(?:[A-Z]:\\|\.\.?[/\\]|~[/\\]).*\.[a-z]{2,4}$"))
    return F.slice(first_of_case(paths), 1, most)


def settings_in(body: Column, most: int = 5) -> Column:
    """Keys of settings that a body reads."""
    found = F.regexp_extract_all(body, F.lit(r"(?i)(?:Configuration\[|ConfigHelper\.\w+\(@?|AppSettings\[|GetConfigString\(@?)\"([^\"]+)\""), 1)
    return F.slice(F.array_sort(F.array_distinct(F.filter(found, lambda w: F.length(w) > 1))), 1, most)


def exceptions_in(body: Column, most: int = 5) -> Column:
    """Types that are caught or thrown, as they come."""
    found = F.regexp_extract_all(body, F.lit(r"\b(?:catch\s*\(\s*|throw\s+new\s+)([\w.]+)"), 1)
    return F.slice(F.array_distinct(found), 1, most)


def transfers_in(body: Column, most: int = 5) -> Column:
    """Transfer types that are made, as they come."""
    return F.slice(F.array_distinct(F.regexp_extract_all(body, F.lit(rf"\bnew\s+(\w*(?:{TRANSFER}))\b"), 1)), 1, most)


def query_like(text: Column) -> Column:
    return F.upper(text).rlike("|".join(QUERY_WORDS))


def action(method: Column) -> Column:
    """What a method does, by its name."""
    rules = (
        ("^(Get|Find|Query)", "query"), ("^(Save|Add|Insert|Create)", "create"), ("^(Update|Edit|Modify)", "update"), ("^(Delete|Remove)", "delete"),
        ("Copy|Clone", "clone"), ("Validate|Check|Verify", "validate"), ("Notify|Send|Publish", "notify"), ("Process|Handle|Execute", "process"),
        ("Sync|Import|Export", "sync"), ("Search|List|Load", "query"),
    )
    out = F.lit("")
    for pattern, name in reversed(rules):
        out = F.when(method.rlike(pattern), name).otherwise(out)
    return out


def folder_of(cls: Column) -> Column:
    """The folder where a class of this name is kept."""
    rules = (
        ("Controller$", "Controllers"), ("Service$", "Services"), ("Repository$", "Repositories"), ("Middleware", "Middleware"), ("(Filter|Attribute)$", "Filters"),
        ("Extension$|Extensions", "Extensions"), ("(Model|Dto|DTO)$", "Models"), ("Exception$", "Exceptions"), ("Validator$", "Validators"), ("(Mapper|Converter)$", "Mappers"),
        ("Handler$", "Handlers"), ("Provider$", "Providers"), ("(Options|Config|Configuration)$", "Config"),
    )
    out = F.lit("Helpers")
    for pattern, name in reversed(rules):
        out = F.when(cls.rlike(pattern), name).otherwise(out)
    return out


#: Types that are no entities, endings of types that are none, and those that only some tests leave out.
PLAIN_TYPES = ("int", "string", "bool", "long", "double", "float", "object", "void", "decimal", "DateTime", "Guid", "byte", "T", "TEntity", "TKey", "TValue")
NO_ENTITY = {
    "resolver": ("Exception", "Attribute", "EventArgs", "Delegate"),
    "registry": ("Exception", "Attribute", "EventArgs", "Delegate", "Handler", "Controller", "Service"),
    "field": ("Exception", "Attribute", "Service", "BLL", "Dao"),
}


def entity_type(name: Column, test: str = "resolver") -> Column:
    """Whether a type's name can be an entity's, by one of three tests; the last two want three letters and no I in front."""
    bare = name.isin(*PLAIN_TYPES) | ((name == "T1") if test == "registry" else type_parameter(name))
    out = name.rlike(r"^\p{Lu}") & ~bare & ~name.rlike(f"(?:{'|'.join(NO_ENTITY[test])})$")
    return out if test == "resolver" else out & (F.length(name) >= 3) & ~name.startswith("I")


def path_summary(node_ids: Column, kinds: Column) -> Column:
    """Short names of a path's nodes, 40 characters at most, with the kinds of the steps between them."""
    short = F.transform(node_ids, lambda x: F.substring_index(x, "::", -1))
    short = F.transform(short, lambda x: F.when(F.length(x) > 40, F.concat(F.substr(x, F.lit(1), F.lit(37)), F.lit("..."))).otherwise(x))
    steps = F.zip_with(kinds, F.slice(short, F.lit(2), F.size(short)), lambda k, x: F.concat(F.lit(" ─["), k, F.lit("]→ "), x))
    return F.concat(F.element_at(short, 1), F.array_join(steps, ""))


def truncated(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substr(text, F.lit(1), F.lit(n)), F.lit("..."))).otherwise(text)


def type_parameter(name: Column) -> Column:
    return name.rlike(r"^T\d*$")
