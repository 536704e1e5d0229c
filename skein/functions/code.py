"""References, contracts and risks read from source text, as columns over lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scalars import extension, holds_any

REFERENCE = "array<struct<kind:string,route:string>>"


def _lines(content: Column) -> Column:
    return F.transform(F.split(content, r"\r?\n"), lambda x: F.trim(x))


def _refs(pairs: Column) -> Column:
    return F.filter(F.flatten(pairs), lambda r: r.isNotNull())


def _ref(condition: Column, kind: str, route: Column) -> Column:
    return F.when(condition, F.struct(F.lit(kind).alias("kind"), route.alias("route")))


def _group(x: Column, pattern: str) -> Column:
    return F.regexp_extract(x, pattern, 1)


def rust_references(content: Column) -> Column:
    """``mod x;`` gives x.rs and x/mod.rs; ``use a::b::{..};`` gives a/b.rs without a leading crate, self or super."""

    def line(x):
        mod = F.trim(_group(x, r"^(?:pub )?mod ([^;]*)"))
        is_mod = F.regexp_like(x, F.lit("^(pub )?mod ")) & (mod != "") & ~F.contains(mod, F.lit("{"))
        use = F.trim(_group(x, r"^use ([^;{]*)"))
        path = F.regexp_replace(F.regexp_replace(F.regexp_replace(use, r"^(crate|self|super)::", ""), "::", "/"), r"[^\p{L}\p{N}_]+$", "")
        is_use = x.startswith("use ") & (use != "")
        return F.array(_ref(is_mod, "uses", F.concat(mod, F.lit(".rs"))), _ref(is_mod, "uses", F.concat(mod, F.lit("/mod.rs"))), _ref(is_use, "uses", F.concat(path, F.lit(".rs"))))

    return _refs(F.transform(_lines(content), line))


def python_references(content: Column) -> Column:
    """The first module of ``import a.b, c`` and the module of ``from m import``; ``.`` and ``..`` ones are dropped."""

    def line(x):
        first = _group(x, r"^import\s+([^\s,]+)")
        is_import = x.startswith("import ") & (first != "")
        module = F.trim(F.element_at(F.split(F.regexp_replace(x, "^from ", ""), " import "), 1))
        is_from = x.startswith("from ") & (module != "") & (module != ".") & ~module.startswith("..")
        route = lambda m: F.concat(F.regexp_replace(m, r"\.", "/"), F.lit(".py"))
        return F.array(_ref(is_import, "imports", route(first)), _ref(is_from, "imports", route(module)))

    return _refs(F.transform(_lines(content), line))


def ts_references(content: Column) -> Column:
    """The first quoted path of lines that begin with ``import``, if relative."""

    def line(x):
        path = F.regexp_extract(x, r"""^import [^'"]*(['"])(.*?)\1""", 2)
        return F.array(_ref(x.startswith("import ") & path.startswith("."), "imports", path))

    return _refs(F.transform(_lines(content), line))


def lean_references(content: Column) -> Column:
    """``import A.B`` gives A/B.lean; ``open A B in`` gives each name, ``scoped`` left out; comment lines are skipped."""

    def line(x):
        module = _group(x, r"^(?:public )?import\s+(\S+)")
        is_import = F.regexp_like(x, F.lit("^(public )?import ")) & (module != "")
        names = F.split(F.element_at(F.split(F.regexp_replace(x, "^open ", ""), " in"), 1), r"\s+")
        clean = F.filter(F.transform(names, lambda n: F.regexp_replace(n, r"[^\p{L}\p{N}.]+$", "")), lambda n: ~n.isin("", "scoped"))
        route = lambda m: F.concat(F.regexp_replace(m, r"\.", "/"), F.lit(".lean"))
        opened = F.transform(F.when(x.startswith("open "), clean).otherwise(F.array().cast("array<string>")), lambda n: F.struct(F.lit("uses").alias("kind"), route(n).alias("route")))
        found = F.concat(F.array(_ref(is_import, "imports", route(module))), opened)
        return F.when(x.startswith("--") | x.startswith("/-"), F.array().cast(REFERENCE)).otherwise(found)

    return _refs(F.transform(_lines(content), line))


def references(content: Column, path: Column) -> Column:
    """By the path's extension; none for others."""
    e = extension(path)
    return (
        F.when(e == "rs", rust_references(content)).when(e == "py", python_references(content)).when(e.isin("ts", "tsx", "js", "jsx"), ts_references(content))
        .when(e == "lean", lean_references(content)).otherwise(F.array().cast(REFERENCE))
    )


def reference_rows(sources: DataFrame) -> DataFrame:
    """source_id, kind, route from sources (id, path, content)."""
    return sources.select(F.col("id").alias("source_id"), F.explode(references(F.col("content"), F.col("path"))).alias("r")).select("source_id", "r.kind", "r.route")


def python_contract(sources: DataFrame) -> DataFrame:
    """id, line (from 1), kind (function, async, class, import) and name of each declaration."""
    lines = sources.select("id", F.posexplode(F.split("content", r"\r?\n")).alias("n", "raw")).withColumn("x", F.trim("raw"))
    kind = F.when(F.col("x").startswith("async def "), "async").when(F.col("x").startswith("def "), "function").when(F.col("x").startswith("class "), "class").when(F.regexp_like("x", F.lit("^(import|from) ")), "import")
    name = F.when(F.col("kind") == "import", F.col("x")).otherwise(F.trim(F.regexp_extract("x", r"^(?:async def|def|class) ([^(:]*)", 1)))
    return lines.withColumn("kind", kind).where("kind is not null").select("id", (F.col("n") + 1).alias("line"), "kind", name.alias("name"))


#: What marks a risk, in content and in paths.
RISKS = (
    ("async", ("async def ", "await "), (), "async runtime behavior needs explicit Rust/Python boundary design"),
    ("io", ("open(", "pathlib", "subprocess"), ("/io",), "filesystem or subprocess side effects make shadow comparison harder"),
    ("network", ("requests", "httpx", "urllib", "socket"), (), "network calls should stay in Python orchestration or be mocked first"),
    ("database", ("sqlalchemy", "sqlite3", "psycopg", "django.db"), (), "database coupling raises migration cost"),
    ("framework", ("fastapi", "flask", "django"), ("/routes", "/api"), "framework boundary should usually be deferred"),
    ("dynamic_python", ("eval(", "exec(", "getattr(", "setattr(", "importlib", "globals()", "locals()"), (), "dynamic behavior needs AST/runtime analysis before generation"),
)


def risk_signals(sources: DataFrame) -> DataFrame:
    """id, category, detail of each risk."""
    text, path = F.lower("content"), F.lower("path")
    found = F.array_compact(F.array(*[F.when(holds_any(text, inside) | holds_any(path, named), F.struct(F.lit(c).alias("category"), F.lit(d).alias("detail"))) for c, inside, named, d in RISKS]))
    return sources.select("id", F.explode(found).alias("r")).select("id", "r.*")


#: Beginnings of lines worth an excerpt, by language: doc comments, imports, signatures.
MARKERS = {
    "rust": (("///", "//!"), ("use ", "mod ", "pub mod "), ("pub fn ", "fn ", "pub struct ", "struct ", "pub enum ", "enum ", "pub trait ", "trait ", "impl ")),
    "python": (('"""', "#"), ("import ", "from "), ("def ", "async def ", "class ")),
    "typescript": (("/**", "*", "//"), ("import ",), ("export ", "function ", "class ", "interface ", "type ", "const ")),
    "javascript": (("/**", "*", "//"), ("import ",), ("export ", "function ", "class ", "const ")),
    "go": (("//",), ("import ",), ("func ", "type ")),
    "java": (("/**", "*"), ("import ",), ("public ", "class ", "interface ")),
    "lean": (("/--", "--"), ("import ", "open "), ("def ", "theorem ", "lemma ", "structure ", "class ", "instance ")),
}
EXCERPT_BYTES, MOST_IMPORTS, MOST_SIGNATURES = 1500, 15, 20


def excerpt(content: Column, language: Column) -> Column:
    """Doc lines, up to 15 imports and 20 signatures in order, up to 1,500 bytes, cut at a line end; null for other languages."""
    lines = _lines(content)
    begins = lambda x, marks: F.coalesce(sum((F.when(x.startswith(m), 1).otherwise(0) for m in marks), F.lit(0)) > 0, F.lit(False))
    arms = None
    for name, marks in MARKERS.items():
        arm = _excerpt(lines, marks, begins)
        arms = F.when(language == name, arm) if arms is None else arms.when(language == name, arm)
    return arms


def _excerpt(lines: Column, marks: tuple, begins) -> Column:
    doc, imports, signatures = marks
    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("i"), F.lit(0).alias("s"), F.lit(False).alias("full"))

    def step(a, x):
        k = F.when(begins(x, imports), "i").when(begins(x, signatures), "s").when(begins(x, doc), "d").otherwise("")
        wanted = ((k == "i") & (a["i"] < MOST_IMPORTS)) | ((k == "s") & (a["s"] < MOST_SIGNATURES)) | (k == "d")
        longer = F.when(a["text"] == "", x).otherwise(F.concat(a["text"], F.lit("\n"), x))
        fits = wanted & ~a["full"] & (F.octet_length(longer) <= EXCERPT_BYTES)
        seen = lambda c: (a[c] + F.when(fits & (k == c), 1).otherwise(0)).alias(c)
        return F.struct(F.when(fits, longer).otherwise(a["text"]).alias("text"), seen("i"), seen("s"), (a["full"] | (wanted & ~fits)).alias("full"))

    return F.aggregate(lines, start, step, lambda a: a["text"])


def node_text(kind: Column, language: Column, relative_path: Column, more: Column | None = None) -> Column:
    """What an embedder reads of a node."""
    return F.concat_ws(" ", kind, language, relative_path, *([more] if more is not None else []))
