"""Scalar functions on paths, names, numbers and dates, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: File extensions by language.
LANGUAGES = {
    "rs": "rust", "py": "python", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "go": "go", "java": "java", "lean": "lean", "c": "c", "h": "c",
    "cpp": "cpp", "hpp": "cpp", "cc": "cpp", "cxx": "cpp", "md": "markdown", "json": "json", "yaml": "yaml", "yml": "yaml", "toml": "toml",
}
SOURCE_EXTENSIONS = ("rs", "py", "js", "ts", "tsx", "jsx", "go", "java", "c", "cpp", "h", "hpp", "rb", "ex", "exs")
TESTABLE_EXTENSIONS = ("rs", "py", "js", "ts", "tsx", "jsx", "go", "java", "c", "cpp", "h", "hpp")
MODULE_NAMES = ("mod.rs", "__init__.py", "index.ts", "index.js")
ENTRY_NAMES = ("main.rs", "lib.rs", "mod.rs", "index.ts", "index.tsx", "index.js", "index.jsx", "__init__.py", "main.py", "main.go", "main.c", "main.cpp", "app.rs", "app.ts", "app.tsx", "app.js", "app.jsx")
UTILITY_PARTS = ("/utils/", "/util/", "/helpers/", "/helper/", "/common/", "/shared/", "_utils", "_helpers")
STOP_WORDS = (
    "a", "an", "the", "to", "for", "of", "in", "on", "at", "by", "is", "it", "and", "or", "but", "not", "with", "from", "that", "this", "add", "implement", "create", "make", "build", "fix", "update", "remove", "delete", "change", "improve", "new", "all", "each", "every", "some", "any",
)
CPU_HINTS = ("parse", "parser", "transform", "encode", "decode", "normalize", "compute", "score", "scoring", "math", "algo", "hash", "token")
IO_HINTS = ("api", "route", "routes", "db", "database", "client", "server", "http", "orm", "model", "settings")
DYNAMIC_HINTS = ("plugin", "dynamic", "reflect", "eval", "monkey", "meta")
CHANGE_LABELS = {"Modified": "M", "Added": "A", "Deleted": "D", "RenamedFrom": "R", "RenamedTo": "R", "Untracked": "?"}


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), lambda x: body(x)), 1)


def lookup(table: dict, key: Column, other) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key), F.lit(other))


def holds_any(text: Column, parts) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | F.contains(text, F.lit(p))
    return F.coalesce(out, F.lit(False))


def file_name(path: Column | str) -> Column:
    return F.regexp_extract(col(path), r"([^/]*)$", 1)


def extension(path: Column | str) -> Column:
    """After the last dot of the file name; empty for none or a leading dot alone."""
    return F.regexp_extract(col(path), r"[^/]\.([^./]*)$", 1)


def language(path: Column | str) -> Column:
    return lookup(LANGUAGES, extension(path), "unknown")


def is_source_file(path: Column | str) -> Column:
    return extension(path).isin(*SOURCE_EXTENSIONS)


def node_kind(relative_path: Column | str, name: Column | str) -> Column:
    """Test, Module or File; only names with a source extension are looked at."""
    r, n = col(relative_path), col(name)
    test = F.contains(r, F.lit("test")) | n.startswith("test_")
    return F.when(~extension(r).isin(*TESTABLE_EXTENSIONS), "File").when(test, "Test").when(n.isin(*MODULE_NAMES), "Module").otherwise("File")


def is_entry_point(name: Column | str) -> Column:
    return file_name(F.lower(col(name))).isin(*ENTRY_NAMES)


def is_utility(name: Column | str) -> Column:
    return holds_any(F.lower(col(name)), UTILITY_PARTS)


def suggest_action(role: Column, gap: Column, in_degree: Column, has_test: Column) -> Column:
    none = F.when(gap <= 0, "none — at or above target")
    return (
        none.when((role == "entry_point") & ~has_test, "add integration tests for public API surface")
        .when(role == "entry_point", "document API contracts and invariants")
        .when((role == "hub") & ~has_test, "add comprehensive test suite (high fan-in)")
        .when((role == "hub") & (in_degree > 5), "extract interface to reduce coupling")
        .when(role == "hub", "add documentation and usage examples")
        .when(role == "directory_container", "review module boundaries and cohesion")
        .when((role == "utility_propagation") & ~has_test, "add unit tests for helper functions")
        .when(role == "utility_propagation", "document edge cases and invariants")
        .when(role == "sink", "verify this module is still needed (no dependents)")
        .when(~has_test & (in_degree > 0), "add tests (other modules depend on this)")
        .when(~has_test, "add basic test coverage")
        .when(in_degree > 3, "reduce coupling or extract stable interface")
        .otherwise("improve documentation and error handling")
    )


def impact_level(activation: Column) -> Column:
    return F.when(activation >= 0.7, "High").when(activation >= 0.3, "Medium").when(activation >= 0.05, "Low").otherwise("None")


def task_action(suggested: Column) -> Column:
    s = F.lower(suggested)
    return (
        F.when(holds_any(s, ["test"]), "AddTests").when(holds_any(s, ["document", "docs"]), "AddDocs").when(holds_any(s, ["coupling", "interface", "extract"]), "ReduceCoupling")
        .when(holds_any(s, ["goal-directed"]), "GoalDirected").when(holds_any(s, ["fix"]), "Fix").otherwise("Refactor")
    )


def goal_keywords(goal: Column) -> Column:
    """Lower-case words of 3 bytes at least, parted by all but letters, digits, ``_`` and ``-``, stop words left out."""
    words = F.split(F.lower(goal), r"[^\p{L}\p{N}_-]")
    return F.filter(words, lambda w: (F.octet_length(w) >= 3) & ~w.isin(*STOP_WORDS))


def matches_path(path: Column, targets: Column, keywords: Column) -> Column:
    p = F.lower(path)
    return F.exists(targets, lambda t: F.contains(p, F.lower(t))) | F.exists(keywords, lambda k: F.contains(p, k))


def shorten_path(path: Column, project: str) -> Column:
    """What follows the project's name and a slash; the path itself if it isn't there."""
    at = F.instr(path, f"{project}/")
    return F.when(at > 0, F.substring(path, at + F.lit(len(project) + 1), F.length(path))).otherwise(path)


def display_path(path: Column, root: str) -> Column:
    return F.when(path.startswith(root), F.regexp_replace(F.substring(path, F.lit(len(root) + 1), F.length(path)), "^/", "")).otherwise(path)


def epoch_to_iso(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def relative_time(seconds: Column) -> Column:
    part = lambda n, unit: F.concat(F.floor(seconds / n).cast("string"), F.lit(unit))
    return F.when(seconds < 60, "just now").when(seconds < 3600, part(60, "m ago")).when(seconds < 86400, part(3600, "h ago")).when(seconds < 604800, part(86400, "d ago")).when(seconds < 2592000, part(604800, "w ago")).otherwise(part(2592000, "mo ago"))


def truncate_label(label: Column, most: int) -> Column:
    return F.when(F.length(label) > most, F.concat(F.substring(label, 1, max(0, most - 3)), F.lit("..."))).otherwise(label)


def display_label(path: Column, label: Column, id_: Column) -> Column:
    return F.coalesce(F.nullif(file_name(path), F.lit("")), F.nullif(label, F.lit("")), F.concat(F.lit("#"), id_.cast("string")))


def size_category(n: Column) -> Column:
    return F.when(n < 1000, "Small").when(n < 3000, "Large").otherwise("Huge")


def frame_skip(n: Column) -> Column:
    return F.when(n < 1000, 1).when(n < 3000, 2).otherwise(4)


def scaled_size(value: Column, low: Column, high: Column, least: float = 4.0, most: float = 20.0) -> Column:
    """value between low and high mapped to sizes, clamped; the middle if there is no span."""
    t = F.when(high > low, (value - low) / (high - low)).otherwise(0.5)
    return F.greatest(F.lit(least), F.least(F.lit(most), least + t * (most - least)))


def pulse(seconds: Column, rate: float = 1.0, depth: float = 0.3) -> Column:
    return 1 + depth * F.sin(F.pmod(seconds * rate, F.lit(1.0)) * 2 * 3.141592653589793)


def merge_annotations(own: Column, other: Column) -> Column:
    """All of both; own values win."""
    keys = F.map_keys(own)
    return F.map_concat(F.map_filter(other, lambda k, v: ~F.array_contains(keys, k)), own)


def annotate(own: Column, key: str, value: Column) -> Column:
    return F.map_concat(F.map_filter(own, lambda k, v: k != key), F.create_map(F.lit(key), value))


def l2_norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0 for unequal lengths or a zero vector; sums in double."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = l2_norm(a) * l2_norm(b)
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot / norm).otherwise(0.0)


def diagnostic_line(text: Column) -> Column:
    """The first line with "timed out", else the first that isn't blank."""
    lines = F.split(text, "\n")
    return F.coalesce(F.get(F.filter(lines, lambda x: F.contains(x, F.lit("timed out"))), 0), F.get(F.filter(lines, lambda x: F.trim(x) != ""), 0))


def scrub_response(text: Column) -> Column:
    """JSON without a code fence around it."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), r"^```(?:json)?\s*", ""), r"\s*```$", ""))


def slugify(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(path), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def identifier(name: Column) -> Column:
    s = F.regexp_replace(name, "[^A-Za-z0-9_]", "_")
    return F.when(F.coalesce(F.regexp_like(s, F.lit("^[0-9]")), F.lit(False)) | (s == ""), F.concat(F.lit("_"), s)).otherwise(s)


def is_test_path(path: Column) -> Column:
    p = F.lower(path)
    return holds_any(p, ["/tests/", "\\tests\\", "/test_", "\\test_"]) | p.endswith("_test.py") | file_name(path).startswith("test_")


def is_actionable_risk(path: Column) -> Column:
    return ~(path.endswith(".d.ts") | holds_any(path, ["node_modules/", "dist/", "target/"]))


def has_inline_tests(content: Column, path: Column) -> Column:
    e = extension(path)
    return (
        F.when(e == "rs", holds_any(content, ["#[cfg(test)]", "#[test]"])).when(e == "py", holds_any(content, ["def test_", "class Test", "unittest.TestCase"]))
        .when(e.isin("ts", "tsx", "js", "jsx"), holds_any(content, ["describe(", "it(", "test("])).when(e == "go", holds_any(content, ["func Test"])).otherwise(False)
    )


def change_fingerprint(files) -> Column:
    """Of a set of paths: equal sets have equal values."""
    return F.sha2(F.array_join(F.sort_array(F.collect_set(files)), "\n"), 256)


def node_radius(n: Column) -> Column:
    """Of a node in a graph of ``n`` nodes."""
    return F.when(n < 1000, 8.0).when(n < 3000, 6.0).otherwise(4.0)


def epsilon(n: Column) -> Column:
    """Movement below which a layout of ``n`` nodes counts as still."""
    return F.when(n < 1000, 0.01).when(n < 3000, 0.05).otherwise(0.1)
