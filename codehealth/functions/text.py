"""Scalar functions over paths and source text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Language by last extension.
LANGUAGES = {
    "java": "Java", "py": "Python", "ts": "TypeScript", "tsx": "TypeScript", "js": "JavaScript", "jsx": "JavaScript", "go": "Go", "vue": "Vue",
    "html": "HTML", "htm": "HTML", "css": "CSS", "scss": "CSS", "sql": "SQL", "sh": "Shell", "md": "Markdown", "json": "JSON", "xml": "XML",
    "yml": "YAML", "yaml": "YAML", "kt": "Kotlin", "c": "C", "cpp": "C++", "cs": "C#", "rb": "Ruby", "php": "PHP", "rs": "Rust", "swift": "Swift",
    "scala": "Scala", "dart": "Dart", "lua": "Lua", "r": "R", "groovy": "Groovy", "bat": "Shell", "ps1": "PowerShell", "gradle": "Groovy",
    "toml": "TOML", "ini": "INI",
}


def basename(path: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(path, r"\\", "/"), "/"), -1)


def language(path: Column) -> Column:
    """By lower-case last extension (the dot is not the first character); Dockerfile; else OTHER."""
    name = F.lower(basename(path))
    known = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    extension = F.regexp_extract(name, r"^.+\.([^.]+)$", 1)
    return F.when(name == "dockerfile", "Dockerfile").otherwise(F.coalesce(F.try_element_at(known, extension), F.lit("OTHER")))


def lines(content: Column) -> Column:
    """Lines as an array; a final line end makes no line."""
    parts = F.split(content, "\r\n|\r|\n", -1)
    return F.when(F.get(parts, F.size(parts) - 1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def loc(content: Column) -> Column:
    """Lines of code: blank lines, // and # lines do not count; block comments end on their */, and what follows counts."""

    def step(acc: Column, raw: Column) -> Column:
        line = F.trim(F.regexp_replace(raw, r"^[\t\f\x0B]+|[\t\f\x0B]+$", ""))
        note = line.startswith("//") | line.startswith("#")
        closes = line.contains("*/")
        rest = F.trim(F.regexp_extract(line, r"(?s)^.*?[*]/(.*)$", 1))
        code_after = closes & (rest != "") & ~(rest.startswith("//") | rest.startswith("#"))
        opens = line.startswith("/*")
        inside = acc["inside"]
        counts = F.when(line == "", False).when(inside, code_after).otherwise(~note & ~opens)
        stays = F.when(line == "", inside).when(inside, ~closes).otherwise(~note & opens & ~closes)
        return F.struct((acc["n"] + F.when(counts, 1).otherwise(0)).alias("n"), stays.alias("inside"))

    return F.aggregate(lines(content), F.struct(F.lit(0).alias("n"), F.lit(False).alias("inside")), step, lambda acc: acc["n"])


def token_estimate(text: Column) -> Column:
    """Words ceil(n/4), CJK ceil(1.5 n) over the text, punctuation runs ceil(n/2), space runs 1, other characters 1."""
    words, cjk, marks, spaces = r"[A-Za-z0-9_]+", "[㐀-䶿一-鿿豈-﫿]", "[^\\p{L}\\p{N}_\\s]+", r"\s+"
    found = lambda p: F.regexp_extract_all(text, F.lit(p), F.lit(0))
    cost = lambda p, by: F.aggregate(found(p), F.lit(0).cast("long"), lambda n, x: n + F.ceil(F.char_length(x) / by))
    seen = lambda p: F.aggregate(found(p), F.lit(0), lambda n, x: n + F.char_length(x))
    n_cjk = F.size(found(cjk))
    left = F.char_length(text) - seen(words) - n_cjk - seen(marks) - seen(spaces)
    return cost(words, 4) + F.ceil(n_cjk * 1.5) + cost(marks, 2) + F.size(found(spaces)) + F.greatest(left, F.lit(0))


def version_major(version: Column) -> Column:
    return F.nullif(F.regexp_extract(version, r"^[vV]?(\d+)(\..*)?$", 1), F.lit(""))


def clipped(text: Column, most: int) -> Column:
    """Trimmed, cut at `most` characters with an ellipsis; blank is null."""
    own = F.trim(text)
    return F.nullif(F.when(F.char_length(own) > most, F.concat(F.substring(own, 1, most), F.lit("…"))).otherwise(own), F.lit(""))


def first_block(text: Column) -> Column:
    """The first {...} of a text whose braces outside strings are balanced; null without one. A fold over braces and strings, which
    stops counting once the block is closed."""
    rest = F.regexp_extract(text, r"(?s)^[^{]*(\{.*)$", 1)
    tokens = F.regexp_extract_all(rest, F.lit(r'"[^"\\]*+(?:\\[\s\S][^"\\]*+)*+"?|[{}]|[^{}"]++'), F.lit(0))
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("at"), F.lit(False).alias("closed"))

    def step(acc: Column, t: Column) -> Column:
        depth = acc["depth"] + F.when(t == "{", 1).when(t == "}", -1).otherwise(0)
        return F.when(acc["closed"], acc).otherwise(F.struct(depth.alias("depth"), (acc["at"] + F.length(t)).cast("int").alias("at"), (depth == 0).alias("closed")))

    found = F.aggregate(tokens, start, step, lambda acc: F.when(acc["closed"], acc["at"]))
    return F.substring(rest, F.lit(1), found)


def json_object(text: Column, schema: str) -> Column:
    """What the schema finds in a JSON object that a text is or holds: the whole text, else what lies between its first and its last
    brace, else its first balanced block, which prose with braces may follow. Null if none of them is a JSON object."""
    whole = F.trim(F.regexp_replace(text, r"^\s+|\s+$", ""))
    outer = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    ok = lambda x: x.rlike(r"^\{") & F.try_parse_json(x).isNotNull()
    chosen = F.coalesce(*[F.when(ok(x), x) for x in (whole, outer, first_block(text))])
    return F.from_json(chosen, schema)
