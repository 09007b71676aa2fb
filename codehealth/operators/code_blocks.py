"""Blocks of code: where they end, which are too long or too complex, and which stand twice.

A file is one row with its lines as an array, so that blocks are array expressions without a shuffle. Files are told apart by
project_id, analysis_id and path, as many of them as the caller has; results carry them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codehealth.functions.keys import file_keys
from codehealth.functions.text import lines as line_array
from codehealth.operators.line_rules import any_of

#: How definitions, branches and nested blocks start. A function has no control word at its head where its
#: complexity is measured; where its length is, any head counts, and there are more modifiers.
PY_DEF, PY_CLASS = r"^\s*(?:async\s+)?def\s+\w+\s*\(", r"^\s*class\s+\w+"
FUNCTION = r"^\s*(?!(?:for|if|while|switch|catch|do)\b)(?:(?:public|private|protected|static|final|async|export)\s+)*(?:function\s+\w+|[\w$<>,\s]+\s+\w+\s*\()\s*[^)]*\)\s*(?:throws[\s\w,]+)?\{"
BRACE_DEF = r"^\s*(?:(?:public|private|protected|static|final|async|export|abstract|override|synchronized|internal|open)\s+)*(?:function\s+\w+|[\w$<>,\s]+\s+\w+\s*\()\s*[^)]*\)\s*(?:throws[\s\w,]+)?\{"
BRACE_CLASS = r"^\s*(?:public|internal|open|final|abstract|sealed|export)?\s*class\s+\w+[^{]*\{"
BRANCH = r"\b(?:if|elif|else if|for|while|catch|switch)\b|\bcase\s|\b(?:&&|\|\||\?)\b"
NESTS, CLOSES = r"^\s*(if |for |while |catch|switch|else )", r"^\s*(\}|elif|else:)"


#: Texts that all stand in whatever a head matches, and for heads of functions what the line starts with: they are found much faster.
HEAD_NEEDS = {PY_DEF: ("def",), PY_CLASS: ("class",), FUNCTION: ("{", ")"), BRACE_DEF: ("{", ")"), BRACE_CLASS: ("class", "{")}
HEAD_STARTS = r"function|^[\w$<>,\s]++\("
BRANCH_NEEDS = ("if", "for", "while", "catch", "switch", "case", "&&", "||", "?")
CATCH, CATCH_ONE_LINE = r"catch\s*\([^)]*\)\s*\{\s*$", r"catch\s*\([^)]*\)\s*\{[\s/]*\}"
HEAD_NEEDS |= {CATCH: ("catch",), CATCH_ONE_LINE: ("catch",)}


def is_head(line: Column, pattern: str) -> Column:
    """If the line matches the pattern, which is tried only where its texts are."""
    near = F.lit(True)
    for x in HEAD_NEEDS.get(pattern, ()):
        near = near & line.contains(x)
    if pattern in (FUNCTION, BRACE_DEF):
        near = near & line.rlike(HEAD_STARTS)
    return near & line.rlike(pattern)


def _count(line: Column, pattern: str) -> Column:
    n = F.regexp_count(line, F.lit(pattern))
    if len(pattern) == 3 and pattern[0] == "[" and pattern[1] not in "\\^" and pattern[2] == "]":  # one character
        n = F.when(line.contains(pattern[1]), n).otherwise(0)
    return n


def with_lines(files: DataFrame) -> DataFrame:
    return files.withColumn("lines", line_array(F.col("content")))


SPANS = "array<struct<start:int,end:int>>"


def spans(items: Column, cumulative: bool, shift: int, nested: bool = True) -> Column:
    """start, end (lines from 0) of each block, by one fold that carries the open ones. items: an array of (level, opens,
    inside) per line, where level is the line's depth or, if `cumulative`, its change. A block that opens on a line ends on
    the first later line that is not deeper than it (less `shift`), else on the last line; `inside` measures its own depth
    after its first line, less one. Unless `nested`, what opens inside a block is passed by: the search goes on after its end,
    so at most one block is open."""
    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("depth"), F.array().cast("array<struct<start:int,level:int>>").alias("open"), F.array().cast(SPANS).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        depth = acc["depth"] + x["level"] if cumulative else x["level"]
        before = F.when(x["inside"], depth - 1).otherwise(acc["depth"]) if cumulative else x["level"]
        ended = F.exists(acc["open"], lambda o: o["level"] >= depth)
        closed = F.transform(F.filter(acc["open"], lambda o: o["level"] >= depth), lambda o: F.struct(o["start"].alias("start"), (acc["i"] - shift).alias("end")))
        still = F.when(ended, F.filter(acc["open"], lambda o: o["level"] < depth)).otherwise(acc["open"])
        free = F.lit(True) if nested else F.size(still if shift else acc["open"]) == 0  # without shift the last line is the block's own
        return F.struct(
            (acc["i"] + 1).alias("i"),
            depth.alias("depth"),
            F.when(x["opens"] & free, F.concat(still, F.array(F.struct(acc["i"].alias("start"), before.cast("int").alias("level"))))).otherwise(still).alias("open"),
            F.when(ended, F.concat(acc["out"], closed)).otherwise(acc["out"]).alias("out"),
        )

    last = lambda acc: F.transform(acc["open"], lambda o: F.struct(o["start"].alias("start"), (acc["i"] - 1).alias("end")))
    return F.aggregate(items, start, step, lambda acc: F.concat(acc["out"], last(acc)))


def brace_spans(lines: Column, starts: str, open_: str = "[{]", close: str = "[}]", at_line_end: bool = False, nested: bool = True) -> Column:
    change = lambda x: _count(x, open_) - _count(x, close)
    items = F.transform(lines, lambda x: F.struct(change(x).alias("level"), is_head(x, starts).alias("opens"), F.lit(at_line_end).alias("inside")))
    return F.when(F.exists(lines, lambda x: is_head(x, starts)), spans(items, True, 0, nested)).otherwise(F.array().cast(SPANS))


def indent_spans(lines: Column, starts: str = PY_DEF, nested: bool = True) -> Column:
    indent = lambda x: F.when(x.rlike(r"^\s*$"), 1_000_000).otherwise(F.length(F.regexp_extract(x, r"^(\s*)", 1)))
    items = F.transform(lines, lambda x: F.struct(indent(x).alias("level"), is_head(x, starts).alias("opens"), F.lit(False).alias("inside")))
    return F.when(F.exists(lines, lambda x: is_head(x, starts)), spans(items, False, 1, nested)).otherwise(F.array().cast(SPANS))


def _exploded(files: DataFrame, found: Column) -> DataFrame:
    keys = file_keys(files)
    return files.select(*keys, F.explode(found).alias("b")).select(*keys, "b.*")


def block_ends(files: DataFrame, starts: str, open_: str = "[{]", close: str = "[}]", at_line_end: bool = False) -> DataFrame:
    """keys, start, end (lines from 0): a block starts on a line that matches and ends on the first later line where depth is
    back at or below that before the start, else on the last line. at_line_end: the block opens with the last brace of
    its first line, which may close another block first."""
    return _exploded(with_lines(files), brace_spans(F.col("lines"), starts, open_, close, at_line_end))


def indent_ends(files: DataFrame, starts: str = PY_DEF) -> DataFrame:
    """keys, start, end: a block by indentation ends before the first non-blank line that is not deeper."""
    return _exploded(with_lines(files), indent_spans(F.col("lines"), starts))


def bloated_in(lines: Column, python: Column, method: int = 150, class_: int = 500, file: int = 1200) -> Column:
    """line, rule_key, size of methods, classes and files that are too long. Methods inside a method, and classes inside a class, are
    part of it and not judged by themselves."""

    def long_(found: Column, key: str, most: int) -> Column:
        size = lambda b: b["end"] - b["start"] + 1
        return F.transform(F.filter(found, lambda b: size(b) > most), lambda b: F.struct((b["start"] + 1).alias("line"), F.lit(key).alias("rule_key"), size(b).alias("size")))

    pair = lambda braces, indent: F.when(python, indent_spans(lines, indent, nested=False)).otherwise(brace_spans(lines, braces, nested=False))
    whole = F.filter(F.array(F.struct(F.lit(1).alias("line"), F.lit("BLOATED-FILE").alias("rule_key"), F.size(lines).alias("size"))), lambda x: x["size"] > file)
    return F.concat(long_(pair(BRACE_DEF, PY_DEF), "BLOATED-METHOD", method), long_(pair(BRACE_CLASS, PY_CLASS), "BLOATED-CLASS", class_), whole)


def bloated(files: DataFrame, method: int = 150, class_: int = 500, file: int = 1200) -> DataFrame:
    """keys, line, rule_key, size of what is too long, in one pass."""
    return _exploded(with_lines(files), bloated_in(F.col("lines"), F.col("path").endswith(".py"), method, class_, file))


def long_files(files: DataFrame, most: int) -> DataFrame:
    n = F.size(line_array(F.col("content")))
    return files.filter(n > most).select(*file_keys(files), F.lit(1).alias("line"), F.lit("BLOATED-FILE").alias("rule_key"), n.alias("size"))


def complexity(body: Column, branch: str = BRANCH) -> Column:
    """Sum over branch words of 1 + depth. A line counts at the depth before it; then depth rises after a nesting line or else
    falls, not below 0, after a closing one."""

    def step(acc: Column, line: Column) -> Column:
        n = F.regexp_count(line, F.lit(branch))
        if branch == BRANCH:
            n = F.when(any_of(line, BRANCH_NEEDS), n).otherwise(0)
        score = acc["score"] + n * (acc["depth"] + 1)
        depth = F.when(line.rlike(NESTS), acc["depth"] + 1).when(line.rlike(CLOSES), F.greatest(acc["depth"] - 1, F.lit(0))).otherwise(acc["depth"])
        return F.struct(score.alias("score"), depth.alias("depth"))

    return F.aggregate(body, F.struct(F.lit(0).alias("score"), F.lit(0).alias("depth")), step, lambda acc: acc["score"])


def complex_in(lines: Column, python: Column, least: int = 12, brace: str = FUNCTION, indent: str = PY_DEF, branch: str = BRANCH) -> Column:
    """line, score of functions that score `least` or more, head line included; a function inside another is part of it."""
    found = F.when(python, indent_spans(lines, indent, nested=False)).otherwise(brace_spans(lines, brace, nested=False))
    body = lambda b: F.slice(lines, b["start"] + 1, b["end"] - b["start"] + 1)
    scores = F.transform(found, lambda b: F.struct((b["start"] + 1).alias("line"), complexity(body(b), branch).alias("score")))
    return F.filter(scores, lambda x: x["score"] >= least)


def complex_functions(files: DataFrame, minor: int = 12, major: int = 20, brace: str = FUNCTION, python: str = PY_DEF, branch: str = BRANCH) -> DataFrame:
    """keys, line, score, severity of functions above the limits."""
    rows = _exploded(with_lines(files), complex_in(F.col("lines"), F.col("path").endswith(".py"), minor, brace, python, branch))
    return rows.withColumn("severity", F.when(F.col("score") >= major, "MAJOR").otherwise("MINOR"))


def empty_catch_lines(lines: Column, head: str = CATCH, nothing: str = r"^($|//|#|/\*|\*)", open_: str = "[{]", close: str = "[}]", one_line: str = CATCH_ONE_LINE) -> Column:
    inside = lambda b: F.slice(lines, b["start"] + 2, F.greatest(b["end"] - b["start"] - 1, F.lit(0)))
    empty = F.filter(brace_spans(lines, head, open_, close, True), lambda b: F.forall(inside(b), lambda x: F.trim(x).rlike(nothing)))
    alone = F.filter(F.transform(lines, lambda x, i: F.when(is_head(x, one_line), i + 1)), lambda i: i.isNotNull())
    return F.transform(F.concat(F.transform(empty, lambda b: b["start"] + 1), alone), lambda i: F.struct(i.alias("line")))


def empty_catches(files: DataFrame, head: str = CATCH, nothing: str = r"^($|//|#|/\*|\*)", open_: str = "[{]", close: str = "[}]", one_line: str = CATCH_ONE_LINE) -> DataFrame:
    """keys, line of catch blocks that hold nothing but blanks and comments."""
    return _exploded(with_lines(files), empty_catch_lines(F.col("lines"), head, nothing, open_, close, one_line))


# --- duplicates -----------------------------------------------------------------------------------------------------

WINDOW = 6


def normal_line(text: Column) -> Column:
    """String literals become one mark, white space goes, letters are lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(text, "[\"'][^\"']{0,200}[\"']", '"S"'), r"[ \t\r\n\f\x0B]+", ""))


def windows(lines: DataFrame, size: int = WINDOW) -> DataFrame:
    """keys, line, hash of every `size` successive lines of a file, without windows of blanks and brackets only."""
    own = Window.partitionBy(*file_keys(lines)).orderBy("line").rowsBetween(0, size - 1)
    rows = lines.withColumn("w", F.collect_list(normal_line(F.col("text"))).over(own)).filter(F.size("w") == size)
    bare = F.forall("w", lambda x: x.rlike(r"^[\[\](){};,]*$"))
    return rows.filter(~bare).select(*[c for c in lines.columns if c != "text"], F.md5(F.array_join("w", "\n")).alias("hash"))


def normal_lines(files: DataFrame) -> Column:
    """The lines of files (keys, content), each as normal_line has it: the text is made normal as a whole, then cut."""
    content = F.regexp_replace("content", "\r\n?", "\n")
    text = F.lower(F.regexp_replace(F.regexp_replace(content, "[\"'][^\"'\n]{0,200}[\"']", '"S"'), r"[ \t\f\x0B]+", ""))
    parts = F.split(text, "\n", -1)
    return F.when((content == "") | content.endswith("\n"), F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def windows_of(files: DataFrame, size: int = WINDOW, repeated: bool = False) -> DataFrame:
    """The windows of files (keys, content) as `windows` finds them in their lines, without a shuffle. A file is one row. repeated: only
    of files that can hold a window twice, at starts `size` lines apart: as many of their lines stand there before."""
    cut = lambda p: F.transform(F.sequence(F.lit(0), F.size(p) - size), lambda i: F.struct((i + 1).alias("line"), F.array_join(F.slice(p, i + 1, size), "\n").alias("w")))
    enough = lambda p: F.size(p) - F.size(F.array_distinct(p)) >= size if repeated else F.size(p) >= size
    found = F.transform(F.array(normal_lines(files)), lambda p: F.when(enough(p), cut(p)))[0]
    keys = file_keys(files)
    rows = files.select(*keys, F.explode(found).alias("x")).select(*keys, "x.*")
    return rows.filter(F.ltrim("w", F.lit("[](){};,\n")) != "").select(*keys, "line", F.md5("w").alias("hash"))


def same_file_duplicates(found: DataFrame, size: int = WINDOW, most: int = 10) -> DataFrame:
    """keys, first, second: the first two starts, `size` lines apart at least, of each window that a file repeats."""
    keys = file_keys(found)
    own = found.groupBy("hash", *keys).agg(F.sort_array(F.collect_list("line")).alias("at"))
    second = F.get(F.filter("at", lambda x: x - F.get("at", F.lit(0)) >= size), F.lit(0))
    rows = own.select(*keys, F.get("at", F.lit(0)).alias("first"), second.alias("second")).filter("second is not null")
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("first", "second"))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= most).drop("rank")


def cross_file_duplicates(found: DataFrame, most: int = 50) -> DataFrame:
    """project keys, path_a, line_a, path_b, line_b: files of a project (and analysis) that share a window, the two first paths of
    each window, each pair once. A task keeps the two first paths of a window before it is shuffled, so a window of boilerplate
    costs two rows a task, however many files hold it, and no pairs of files are made for it. This is the short list of a report;
    shared_windows has all files of all windows."""
    keys = [c for c in file_keys(found) if c != "path"]
    first = found.groupBy("hash", *keys, "path").agg(F.min("line").alias("line"))
    two = first.withColumn("rank", F.row_number().over(Window.partitionBy("hash", *keys).orderBy("path"))).filter(F.col("rank") <= 2)
    pair = two.groupBy("hash", *keys).agg(F.array_sort(F.collect_list(F.struct("path", "line"))).alias("p")).filter(F.size("p") > 1)
    rows = pair.groupBy(*keys, F.col("p")[0]["path"].alias("path_a"), F.col("p")[1]["path"].alias("path_b")).agg(F.min(F.struct(F.col("p")[0]["line"].alias("x"), F.col("p")[1]["line"].alias("y"))).alias("at"))
    rows = rows.select(*keys, "path_a", F.col("at.x").alias("line_a"), "path_b", F.col("at.y").alias("line_b"))
    order = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    return rows.withColumn("rank", F.row_number().over(order.orderBy("path_a", "line_a", "path_b"))).filter(F.col("rank") <= most).drop("rank")


def shared_windows(found: DataFrame) -> DataFrame:
    """project keys, path_a, line_a, path_b, line_b: each window that several files of a project (and analysis) hold, at its first line
    in the first path and in each other one. None is left out: two files share a window if and only if they meet in a (path_a, line_a).
    A window costs as many rows as it has files, not pairs; a hot one is dealt among tasks by the skewed join."""
    keys = [c for c in file_keys(found) if c != "path"]
    first = found.groupBy("hash", *keys).agg(F.min(F.struct("path", "line")).alias("a"), F.max("path").alias("last")).filter("last > a.path")
    first = first.select(*[F.col(c).alias(f"of_{c}") for c in ("hash", *keys)], F.col("a.path").alias("path_a"), F.col("a.line").alias("line_a"))
    same = F.lit(True)
    for c in ("hash", *keys):
        same = same & F.col(c).eqNullSafe(F.col(f"of_{c}"))
    other = found.join(first, same).filter("path <> path_a")
    rows = other.groupBy(*keys, "path_a", "line_a", "path").agg(F.min("line").alias("line_b"))
    return rows.select(*keys, "path_a", "line_a", F.col("path").alias("path_b"), "line_b")
