"""Labels and owners of paths by glob rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shalecrest.functions.text import dirname, extension, glob_regex


def labels(paths: DataFrame, rules: list[tuple[str, list[str]]], path: str = "path") -> DataFrame:
    """Paths with a column ``labels``: what all matching rules add, each once, in the order of rules.

    Rules are few and part of the plan, so each path is read once and nothing is joined.
    """
    added = [F.when(F.col(path).rlike(glob_regex(p)), F.array(*map(F.lit, add))).otherwise(F.array().cast("array<string>")) for p, add in rules]
    return paths.withColumn("labels", F.array_distinct(F.concat(*added)) if added else F.array().cast("array<string>"))


def owners(paths: DataFrame, rules: list[tuple[str, list[str]]], path: str = "path") -> DataFrame:
    """Paths with ``owners`` by the last matching rule: @org/team is team:team and @user owner:user."""
    names = lambda who: [("team:" + w.split("/", 1)[1]) if "/" in w else "owner:" + w.lstrip("@") for w in who]
    out = F.array().cast("array<string>")
    base = F.element_at(F.split(path, "/"), -1)
    for pattern, who in rules:
        hit = (F.col(path) if "/" in pattern.strip("/") or pattern.startswith("/") else base).rlike(glob_regex(pattern.lstrip("/").rstrip("/")))
        if pattern.endswith("/"):
            hit = F.col(path).rlike("(?:^|/)" + glob_regex(pattern.strip("/"))[1:])
        out = F.when(hit, F.array(*map(F.lit, names(who)))).otherwise(out)
    return paths.withColumn("owners", out)


#: Labels by extension, without the dot.
_LANGUAGES = {"typescript": "ts tsx", "javascript": "cjs js jsx mjs", "python": "py", "java": "java", "go": "go", "rust": "rs", "c": "c", "cpp": "cc cpp cxx", "csharp": "cs", "ruby": "rb", "kotlin": "kt", "swift": "swift", "php": "php", "scala": "scala", "shell": "bash fish sh zsh"}
_FORMATS = {"markdown": "md mdx", "rst": "rst", "latex": "tex", "pdf": "pdf", "docx": "docx", "xlsx": "xlsx", "pptx": "pptx", "html": "htm html", "epub": "epub", "json": "json", "yaml": "yaml yml", "toml": "toml", "notebook": "ipynb"}
BY_EXTENSION = {e: f"{kind}:{name}" for kind, names in (("language", _LANGUAGES), ("format", _FORMATS)) for name, all_ in names.items() for e in all_.split()}


def extension_label(path: Column) -> Column:
    """What a path's extension says of it; null if nothing."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in BY_EXTENSION.items() for x in kv]), extension(path))


def inherited(paths: DataFrame, given: DataFrame, path: str = "path") -> DataFrame:
    """Paths with ``inherited``: the labels that the folders above give, from the top down.

    given: (dir, add, inherit), a row a folder, "" being the top. A folder with inherit = false ends the way down: what
    lies deeper isn't asked.
    """
    parts = F.split(dirname(F.col(path)), "/")
    above = F.array_distinct(F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))))
    files = paths.select(path).distinct()
    each = files.select(path, F.posexplode(above).alias("depth", "dir")).join(given, "dir")
    last = F.min(F.when(~F.col("inherit"), F.col("depth"))).over(Window.partitionBy(path))
    kept = each.withColumn("last", last).where("last is null or depth <= last").groupBy(path).agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("depth", "add"))), lambda x: x["add"])).alias("inherited"))
    return paths.join(kept, path, "left").withColumn("inherited", F.coalesce("inherited", F.array().cast("array<string>")))


def merged(*levels: Column) -> Column:
    """Labels of several levels, each once, where it comes first."""
    none = F.array().cast("array<string>")
    return F.array_distinct(F.array_compact(F.concat(*[F.coalesce(x, none) for x in levels])))
