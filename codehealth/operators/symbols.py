"""Symbols and calls of whole source files: a lexer and a fold, as array expressions over one row per file.

1. The text is cut into strings, comments and the rest by one pattern, so that a mark inside a string or a comment never opens
   another. Comments become blanks and strings one letter, line ends stay; code inside templates and formatted strings stays.
2. What is left is cut into heads of declarations (which may go over several lines), brackets, ends of statements and the rest,
   and a fold over these carries the depth and the open symbols. Where a head is a symbol: in Java a class at the top or
   straight inside another class; elsewhere at the top only. Each symbol ends with its own block or statement.
3. Calls are dotted names before a bracket inside a symbol: the first and the last name count. In Java the part before the
   last counts for the first, a field of the file for its declared type, and calls of an inner class are its outer's, too.

A file is one row and bounds the memory; only fields meet calls again, in a window by file. What a grammar sees and this does not:
regular-expression literals with quotes (a string ends with its line at the latest), names taken apart by destructuring,
brackets nested more than once in a template's code. Decorated Python definitions and abstract TypeScript classes are no
symbols, as they are declarations of another kind."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codehealth.functions.keys import file_keys
from codehealth.operators.graph import distinct_nodes, layer

_QUOTED = r'"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"?|' + r"'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'?"
_NOTES = r"//[^\n]*+|/\*[\s\S]*?(?:\*/|\z)"
_TEMPLATE = r"`[^`\\]*+(?:\\[\s\S][^`\\]*+)*+`?"
_PY_STRING = r"(?i:(?<!\w)[rbuf]{1,2})?(?:\"\"\"[\s\S]*?(?:\"\"\"|\z)|'''[\s\S]*?(?:'''|\z)|" + _QUOTED + ")"
#: Marks for a line end that ends a statement, and for a brace that ends a type and no block; each is one character, too.
_END, _TYPE = "\x01", "\x02"
_LINE = r"(?<=^|[\n\x01])"
_ANNOTATION = r"@(?!interface\b)[\w.]+(?:\s*\((?:[^()]|\([^()]*\))*+\))?"


class Language(NamedTuple):
    skipped: str  # strings and comments
    plain: str  # runs without either
    head: str  # up to the name, which is its last word
    is_head: str  # tells heads from other pieces
    line_end: str  # line ends that end a statement, beside semicolons
    words: str  # before a bracket no calls
    declared: str  # before a bracket names of declarations, or what else is no call
    nested: bool = False  # classes inside classes are symbols, too
    kept: str = ""  # code inside strings, as group 1
    blocks: str = "."  # heads that end with their block; the others end with their statement


_BRACES = "[^\"'`/]++"
_C_WORDS = "if for while switch catch return new super this do case throw else try typeof await yield synchronized assert"
_JS = Language(
    f"{_TEMPLATE}|{_QUOTED}|{_NOTES}",
    _BRACES,
    r"(?<=(?:^|[;}\n\x01])[ \t]{0,99})(?:export[\s\x01]+(?:default[\s\x01]+)?)?(?:async[\s\x01]+)?(?:function[\s\x01]*\*?|class|const|let|var)[\s\x01]+[\w$]+",
    r"^(?:export|async|function|class|const|let|var)[\s\x01*]",
    r"(?<![=,+\-*/%&|?:<>(!~^.{\[][ \t]{0,99})\n(?=\s*+[^\s.?:=+*/&|,)\]}>])",
    _C_WORDS + " function class in of import",
    r"\bfunction\s*\*?\s*[\w$]*\s*\(|(?<![\w$.])(?!(?:if|for|while|switch|catch|with)\b)[\w$]+\s*\((?=[^()]*\)\s*(?::[^={}();]*)?\{)",
    kept=r"\$\{([^{}`]*)\}",
    blocks=r"\b(?:function|class)\b",
)
#: Heads follow what the languages' grammars call a declaration.
LANGUAGES = {
    "java": Language(
        r'"""[\s\S]*?(?:"""|\z)|' + f"{_QUOTED}|{_NOTES}",
        _BRACES,
        rf"(?<![\w$.@])(?:(?:{_ANNOTATION}|(?:public|private|protected|static|final|abstract|sealed|non-sealed|strictfp)\b)\s*+)*+\bclass\s+\w+",
        r"(?s)^(?:.*\W)?class\s+\w+$",
        "",
        _C_WORDS,
        r"(?<![\w$@.])(?!(?:return|throw|new|else|do|case|assert|yield)\b)[\w$]*[\w$>\]]\s+[\w$]+\s*\((?=[^()]*\)\s*(?:throws[\s\w.,]+)?[{;])|(?<![\w$@.])(?!(?:if|for|while|switch|catch|synchronized)\b)\w+\s*\((?=[^()]*\)\s*(?:throws[\s\w.,]+)?\{)|@[\w.]+\s*\(",
        nested=True,
    ),
    "py": Language(
        _PY_STRING + r"|#[^\n]*+",
        r"(?:[^\"'#\w]|\w++(?![\"']))++|\w++",
        rf"{_LINE}(?:@[\w.]+(?:\((?:[^()]|\((?:[^()]|\([^()]*\))*+\))*+\))?[^\n\x01]*+[\s\x01]++)*+(?:async[ \t]+)?(?:def|class)[ \t]+\w+",
        r"^(?:async|def|class)[ \t]",
        r"\n(?=[^\s)\]}])",
        "if elif while for return def class and or not in is lambda with assert yield await except del raise else import from",
        r"\b(?:def|class)\s+\w+\s*\(",
        kept=r"\{([^{}]*)\}",
        blocks="$^",
    ),
    "go": Language(f"`[^`]*+`?|{_QUOTED}|{_NOTES}", _BRACES, rf"{_LINE}func\s*(?:\([^)]*\)\s*)?\w+", r"(?s)^func[\s(].*\w$", "", "if for switch return func select go defer case range struct interface map chan", r"\bfunc\s*\("),
    "js": _JS,  # and ts
}
#: Language by extension.
EXTENSIONS = {".java": "java", ".py": "py", ".go": "go", ".js": "js", ".jsx": "js", ".mjs": "js", ".cjs": "js", ".ts": "ts", ".tsx": "ts"}

_CALL = r"(?<![\w$])(?:new\s+)?[A-Za-z_$][\w$]*(?:\s*\??\.\s*[A-Za-z_$][\w$]*)*\s*\("
_FIELD = r"(?:^|[;{}])\s*(?:@[\w.]+(?:\([^()]*\))?\s*|(?:private|protected|public|static|final|transient|volatile)\s+)*([\w.]+(?:<[^;=(){}]*>)?(?:\[\])*)\s+(\w+)\s*"
_MADE = r"\bnew\s+([\w.]+)(?:<[^<>()]*>)?\s*\([^()]*\)\s*\.\s*\w+\s*\("

_OPEN = "array<struct<name:string,start:int,body:int,depth:int,block:boolean>>"
_DONE = "array<struct<name:string,start:int,body:int,end:int>>"


def _by_language(language: Column, make, other: Column) -> Column:
    out = other
    for name, spec in LANGUAGES.items():
        out = F.when(language == name, make(name, spec)).otherwise(out)
    return out


def code_only(content: Column, language: Column) -> Column:
    """The text with comments gone and each string as one S, line by line as before. Other languages: null."""

    def cleaned(name: str, spec: Language) -> Column:
        tokens = F.regexp_extract_all(content, F.lit(f"{spec.skipped}|{spec.plain}|[\\s\\S]"), F.lit(0))

        def one(t: Column) -> Column:
            ends = F.regexp_replace(t, r"[^\n]+", "")
            inner = F.lit("")
            if spec.kept:
                code = F.transform(F.regexp_extract_all(t, F.lit(spec.kept), F.lit(1)), lambda x: F.regexp_replace(F.regexp_replace(x, _QUOTED, "S"), r"\n", " "))
                inner = F.when(t.rlike(r"^(?i:r?fr?)[\"']" if name == "py" else "^`"), F.concat(F.lit(" + "), F.array_join(code, "; "))).otherwise("")
            note = t.startswith("#") if name == "py" else t.startswith("//") | t.startswith("/*")
            return F.when(note, F.concat(F.lit(" "), ends)).when(t.rlike(r"^(?i:[rbuf]{0,2})[\"'`]"), F.concat(F.lit("S"), inner, ends)).otherwise(t)

        return F.array_join(F.transform(tokens, one), "")

    return _by_language(language, cleaned, F.lit(None).cast("string"))


def symbol_spans(code: Column, language: Column) -> Column:
    """name, start, body, end of each symbol: places of characters from 0, of the head, of what follows the head, and after it."""

    def found(name: str, spec: Language) -> Column:
        marked = F.regexp_replace(code, r"\}(?=[ \t]*[{|&\[])", _TYPE)
        if spec.line_end:
            marked = F.regexp_replace(marked, spec.line_end, _END)
        tokens = F.regexp_extract_all(marked, F.lit(rf"{spec.head}|[{{}}()\[\];\x01\x02]|\w+|[^\w{{}}()\[\];@\n\x01\x02]++|[\s\S]"), F.lit(0))
        is_head = lambda t: t.rlike(spec.is_head)
        named = lambda t: F.regexp_extract(t, r"([\w$]+)$", 1)
        if name == "go":  # the receiver's type owns its methods
            receiver = lambda t: F.trim(F.regexp_replace(F.regexp_extract(t, r"^func\s*\(([^)]*)\)", 1), r"[*,\s]+", " "))
            named = lambda t: F.when(receiver(t) != "", F.element_at(F.split(receiver(t), " "), -1)).otherwise(F.regexp_extract(t, r"(\w+)$", 1))
        ends = [_END] if name == "py" else [";", _END]

        def item(t: Column) -> Column:
            kind = F.when(is_head(t), "h").when(t.isin("{", "(", "["), "o").when(t.isin("}", ")", "]", _TYPE), "c").when(t.isin(*ends), "e").otherwise("x")
            skip = F.length(F.regexp_extract(t, r"^((?:export[\s\x01]+(?:default[\s\x01]+)?)?)", 1)) if spec is _JS else F.lit(0)
            return F.struct(kind.alias("k"), F.length(t).alias("n"), t.alias("t"), F.when(is_head(t), named(t)).alias("name"), skip.alias("skip"), t.rlike(spec.blocks).alias("block"))

        start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("depth"), F.array().cast(_OPEN).alias("open"), F.array().cast(_DONE).alias("done"))

        def step(acc: Column, x: Column) -> Column:
            after = (acc["at"] + x["n"]).cast("int")
            depth = acc["depth"] + F.when(x["k"] == "o", 1).when(x["k"] == "c", -1).otherwise(0)
            free = acc["depth"] == F.size(acc["open"]) if spec.nested else (acc["depth"] == 0) & (F.size(acc["open"]) == 0)
            top = F.get(acc["open"], F.size(acc["open"]) - 1)
            by_block = (x["t"] == "}") & top["block"] & (top["depth"] == depth)
            by_end = (x["k"] == "e") & ~top["block"] & (top["depth"] == acc["depth"])
            closes = F.coalesce(by_block | by_end, F.lit(False))
            opens = (x["k"] == "h") & free
            own = F.struct(x["name"].alias("name"), (acc["at"] + x["skip"]).cast("int").alias("start"), after.alias("body"), acc["depth"].alias("depth"), x["block"].alias("block"))
            done = F.struct(top["name"].alias("name"), top["start"].alias("start"), top["body"].alias("body"), after.alias("end"))
            return F.struct(
                after.alias("at"),
                F.greatest(depth, F.lit(0)).alias("depth"),
                F.when(opens, F.concat(acc["open"], F.array(own))).when(closes, F.slice(acc["open"], 1, F.size(acc["open"]) - 1)).otherwise(acc["open"]).alias("open"),
                F.when(closes, F.concat(acc["done"], F.array(done))).otherwise(acc["done"]).alias("done"),
            )

        rest = lambda acc: F.transform(acc["open"], lambda o: F.struct(o["name"].alias("name"), o["start"].alias("start"), o["body"].alias("body"), acc["at"].alias("end")))
        return F.aggregate(F.transform(tokens, item), start, step, lambda acc: F.concat(acc["done"], rest(acc)))

    return _by_language(language, found, F.array().cast(_DONE))


def flat(body: Column, levels: int = 12) -> Column:
    """A class body without what stands in its inner blocks, up to so many levels."""
    for _ in range(levels):
        body = F.regexp_replace(body, r"\{[^{}]*\}", ";")
    return body


def symbols_of(files: DataFrame) -> DataFrame:
    """keys, language, name, line, body (code after the head) of each symbol of the files (keys, path, content). Language: a column of
    that name (java, py, go, js, ts), else by extension; files of other languages and null contents have no symbols."""
    keys = file_keys(files)
    known = F.create_map(*[F.lit(x) for pair in EXTENSIONS.items() for x in pair])
    language = F.col("language") if "language" in files.columns else F.try_element_at(known, F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)))
    language = F.when(language == "ts", "js").otherwise(language)
    rows = files.select(*keys, language.alias("language"), F.regexp_replace("content", "\r\n?", "\n").alias("content")).filter("language is not null")
    rows = rows.withColumn("code", code_only(F.col("content"), F.col("language"))).drop("content")
    rows = rows.withColumn("s", F.explode(symbol_spans(F.col("code"), F.col("language"))))
    text = lambda a, b: F.substring(F.col("code"), a + 1, b - a)
    line = F.regexp_count(text(F.lit(0), F.col("s.start")), F.lit("\n")) + 1
    return rows.select(*keys, "language", "s.name", line.alias("line"), text(F.col("s.body"), F.col("s.end")).alias("body"))


def symbols_and_calls_of(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes (keys but path, node_key, name, node_type, file_path, line) and calls (keys but path, source, called)."""
    keys = file_keys(files)
    own = [c for c in keys if c != "path"]
    rows, key = symbols_of(files), F.concat("path", F.lit("#"), "name")
    stem = F.element_at(F.split("path", "/"), -1)
    nodes = rows.select(*own, key.alias("node_key"), "name", layer(F.col("name"), stem).alias("node_type"), F.col("path").alias("file_path"), "line")
    body, bare = F.col("body"), F.array().cast("array<string>")
    for name, spec in LANGUAGES.items():
        body = F.when(F.col("language") == name, F.regexp_replace(body, spec.declared, " (")).otherwise(body)
        bare = F.when(F.col("language") == name, F.array(*map(F.lit, spec.words.split()))).otherwise(bare)
    inner = F.concat(F.lit(";"), flat(F.regexp_replace("body", r"^[^{]*\{", "")))
    pairs = F.regexp_extract_all(inner, F.lit(_FIELD + "(?=[=;])"), F.lit(0))
    field = lambda k: F.transform(pairs, lambda x: F.regexp_extract(x, _FIELD, k))
    java = F.col("language") == "java"
    none = lambda kind: F.lit(None).cast(kind)
    entry = lambda call, made, name, type_: F.struct(call.alias("call"), made.alias("made"), name.alias("name"), type_.alias("type"))
    text = none("string")
    # calls, objects made and called at once, and fields leave a symbol in one list, so that the files are lexed once
    found = F.concat(
        F.transform(F.regexp_extract_all(body, F.lit(_CALL), F.lit(0)), lambda x: entry(x, text, text, text)),
        F.when(java, F.transform(F.regexp_extract_all(F.col("body"), F.lit(_MADE), F.lit(1)), lambda x: entry(text, x, text, text))).otherwise(F.array()),
        F.when(java, F.transform(F.arrays_zip(field(2).alias("name"), field(1).alias("type")), lambda x: entry(text, text, x["name"], x["type"]))).otherwise(F.array()),
    )
    one = rows.select(*keys, java.alias("java"), key.alias("source"), bare.alias("bare"), F.explode(found).alias("e")).select(*keys, "java", "source", "bare", "e.*")
    one = one.filter(F.col("call").isNull() | ~F.col("call").rlike(r"^new\s")).withColumn("p", F.split(F.regexp_replace("call", r"[\s?(]+", ""), r"\."))
    size = F.size("p")
    one = one.filter(F.col("call").isNull() | ~((size == 1) & F.array_contains("bare", F.get("p", F.lit(0))))).drop("bare", "call")
    one = one.withColumn("leaf", F.coalesce(F.element_at("p", -1), "made")).withColumn("object", F.when(size > 1, F.when(F.col("java"), F.get("p", size - 2)).otherwise(F.get("p", F.lit(0)))))
    # fields of all classes of a file, one of a name, meet the calls on it; other calls are dealt by their own name
    at = Window.partitionBy(*keys, F.coalesce("name", F.when(F.col("java"), F.col("object")), F.concat(F.lit(" "), "leaf")))
    resolved = one.withColumn("type", F.max("type").over(at)).filter("name is null")
    resolved = resolved.withColumn("object", F.when(F.col("java") & (size == 2), F.coalesce("type", "object")).otherwise(F.col("object")))
    calls = resolved.select(*own, "source", F.explode(F.array_compact(F.array("object", "leaf"))).alias("called"))
    return distinct_nodes(nodes), calls.distinct()
