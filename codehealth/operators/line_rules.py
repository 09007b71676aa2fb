"""Rules over lines: a rule is data, all rules run in one pass, and findings are rows.

Lines have (project_id, analysis_id, path, line, text), as many of the first three as the caller has: they are the key of a
file wherever files are told apart, and every finding carries them. lines_of makes lines from files (keys, content). Findings
have (keys, line, rule_key, source, kind, severity, message). `findings` runs all scanners over one explosion of each text."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codehealth.functions.keys import file_keys
from codehealth.functions.text import lines as line_array


class LineRule(NamedTuple):
    rule_key: str
    source: str
    kind: str
    severity: str
    pattern: str
    #: A second pattern that the line must hold, too.
    also: str | None = None
    #: A match ends the line: no later rule is tried.
    last: bool = False
    message: str = ""
    #: Texts of which a matching line holds at least one; looked for before the pattern, as that is much cheaper.
    needs: tuple[str, ...] = ()


#: What the security rules look for, and the order of the dangerous calls, of which the first counts.
SECRET = r"(?i)\b(password|passwd|pwd|secret|api[_-]?key|access[_-]?key|token|auth[_-]?secret|private[_-]?key|client[_-]?secret)\s*(?:=|:)\s*['\"][^'\"]{8,}['\"]"
SQL_WORD, SQL_JOIN = r"(?i)\b(SELECT|INSERT INTO|UPDATE|DELETE FROM)\b", r"['\"]\s*[+&]\s*\{?\w+|\bformat\s*\(|f['\"]"
PASSWORD_COMPARE = r"(?i)(?:password|passwd|pwd|secret|token)\s*(?:==|!=|\.equals\s*\(|\.contentEquals\s*\(|strcmp\s*\()"
DANGEROUS = (
    (r"\beval\s*\(", "eval"),
    (r"\bexec\s*\(", "exec"),
    (r"\bos\.system\s*\(", "os.system"),
    (r"\bsubprocess\s*\(\s*[^,\n]*,\s*shell\s*=\s*True", "shell=True"),
    (r"System\.Runtime\.getRuntime\(\)\.exec", "Runtime.exec"),
    (r"\bexecCommand\s*\(", "execCommand"),
    (r"\bchild_process\.exec\s*\(", "child_process.exec"),
    (r"\brm\s+-rf\s+", "rm -rf"),
    (r"\bpickle\.loads?\s*\(", "pickle"),
    (r"\byaml\.load\s*\([^)]*Loader=.*yaml\.Load\b|yaml\.load\s*\([^)]*\)(?!.*SafeLoader)", "yaml.load"),
    (r"\breadObject\s*\(", "readObject"),
    (r"\bmd5\s*\(|\bhashlib\.md5\s*\(|MessageDigest\.getInstance\(\s*[\"']MD5[\"']", "MD5"),
    (r"\bsha1\s*\(|\bhashlib\.sha1\s*\(|MessageDigest\.getInstance\(\s*[\"']SHA-?1[\"']", "SHA1"),
    (r"\bMath\.random\s*\(|\brandom\.random\s*\(|\bRandom\(\).*next", "weak random"),
)
SECURITY = (
    LineRule("SECRET-HARDCODED", "SECURITY", "VULNERABILITY", "CRITICAL", SECRET, last=True, needs=("'", '"')),
    LineRule("DANGEROUS-CALL", "SECURITY", "VULNERABILITY", "MAJOR", "", needs=("(", "rm")),
    LineRule("SQL-INJECTION", "SECURITY", "VULNERABILITY", "CRITICAL", SQL_WORD, SQL_JOIN, needs=("'", '"', "(")),
    LineRule("PLAINTEXT-PASSWORD-COMPARE", "SECURITY", "VULNERABILITY", "CRITICAL", PASSWORD_COMPARE, needs=("=", "(")),
)
#: Texts of which one stands in whatever a pattern matches, as they are found much faster than the pattern; those of a pattern that
#: ignores case are looked for in the lower-case line.
NEAR = dict(zip((p for p, _ in DANGEROUS), (("eval",), ("exec",), ("os.system",), ("subprocess",), ("getRuntime",), ("execCommand",), ("child_process",), ("-rf",), ("pickle.load",), ("yaml.load",), ("readObject",), ("md5", "MD5"), ("sha1", "SHA"), ("andom",)), strict=True))
NEAR_LOWER = {
    SECRET: ("passw", "pwd", "secret", "key", "token"),
    SQL_WORD: ("select", "insert into", "update", "delete from"),
    PASSWORD_COMPARE: ("passw", "pwd", "secret", "token"),
}
SAFE_NUMBERS = ("100", "1000", "1024", "2048", "4096", "8192", "16384", "3600", "86400", "60", "24", "365", "7", "30", "31", "12", "128", "256", "512", "65535", "8080", "443", "80")
STRING = "[\"'][^\"']{0,200}[\"']"
MARKERS = {"TODO": "MINOR", "FIXME": "MAJOR", "HACK": "MAJOR", "XXX": "MAJOR"}
OPENER = r"(//|#|/\*|\*)"
#: After a marker: no letter of a longer word.
END = "([^A-Za-z0-9_]|$)"
#: Lines whose number is meant, as a declaration or an assignment.
DECLARED = r"^\s*(?:const|let|var|private|public|protected|static|final|readonly)\s+[A-Za-z_$][\w$]*\s*=\s*\d"
ASSIGNED = r"^[A-Za-z_$][\w$]*\s*=\s*\d"
#: Lines that end in blanks, and indents of both kinds.
TRAILING, MIXED = r"[ \t]+$", r"^( +\t|\t+ )"


def any_of(text: Column, words: tuple[str, ...]) -> Column:
    """If the text holds one of the words; without words, yes."""
    found = text.contains(words[0]) if words else F.lit(True)
    for x in words[1:]:
        found = found | text.contains(x)
    return found


def holds(text: Column, pattern: str) -> Column:
    """If the text matches the pattern, which is tried only where one of its texts is."""
    return any_of(text, NEAR.get(pattern, ())) & any_of(F.lower(text), NEAR_LOWER.get(pattern, ())) & text.rlike(pattern)


def rules_of(table: DataFrame, most: int = 1_000) -> tuple[LineRule, ...]:
    """Rules from a table (ord, rule_key, source, kind, severity, pattern; also, last, message, needs if it has them). They become
    column expressions, so there is a bound on their number."""
    rows = table.orderBy("ord").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rules")
    known = [c for c in LineRule._fields if c in table.columns]
    return tuple(LineRule(**{c: tuple(r[c]) if c == "needs" else r[c] for c in known if r[c] is not None}) for r in rows)


#: Rules that users add, by name; see scan_registered.
REGISTERED: dict[str, tuple[LineRule, ...]] = {}


def register_rules(table: DataFrame, name: str = "user") -> None:
    """Takes the rules of a table (see rules_of) for scan_registered, in place of an earlier table of that name."""
    REGISTERED[name] = rules_of(table)


def scan_registered(lines: DataFrame) -> DataFrame:
    """Findings of all registered rules, in one pass."""
    return scan_lines(lines, tuple(r for name in sorted(REGISTERED) for r in REGISTERED[name]))


def lines_of(files: DataFrame, *keep: str) -> DataFrame:
    """keys, line (from 1), text; with the columns `keep` of files."""
    own = [*file_keys(files), *(c for c in keep if c not in file_keys(files))]
    return files.select(*own, F.posexplode(line_array(F.col("content"))).alias("line", "text")).withColumn("line", F.col("line") + 1)


def first_label(text: Column, patterns: tuple[tuple[str, str], ...]) -> Column:
    """Label of the first pattern, in order, that the text holds."""
    return F.coalesce(*[F.when(holds(text, p), label) for p, label in patterns])


def line_hits(text: Column, rules: tuple[LineRule, ...] = SECURITY, dangerous=DANGEROUS) -> Column:
    """What the rules find on a line: an array of (rule_key, source, kind, severity, message). A rule without a pattern stands
    for the list `dangerous`."""
    hits, ended = [], F.lit(False)
    for rule in rules:
        label = F.when(any_of(text, rule.needs), first_label(text, dangerous) if not rule.pattern else F.when(holds(text, rule.pattern), F.lit(rule.message)))
        match = label.isNotNull() & ~ended
        if rule.also:
            match = match & text.rlike(rule.also)
        hits.append(F.when(match, finding(rule.rule_key, rule.source, rule.kind, F.lit(rule.severity), label)))
        if rule.last:
            ended = ended | match
    return F.array_compact(F.array(*hits))


def finding(rule_key, source: str, kind: str, severity: Column, message: Column) -> Column:
    key = F.lit(rule_key) if isinstance(rule_key, str) else rule_key
    return F.struct(key.alias("rule_key"), F.lit(source).alias("source"), F.lit(kind).alias("kind"), severity.alias("severity"), message.alias("message"))


def scan_lines(lines: DataFrame, rules: tuple[LineRule, ...] = SECURITY, dangerous=DANGEROUS) -> DataFrame:
    """All findings of all rules in one pass."""
    return lines.select(*[c for c in lines.columns if c != "text"], F.explode(line_hits(F.col("text"), rules, dangerous)).alias("f")).select("*", "f.*").drop("f")


def per_file(found: DataFrame, most: int) -> DataFrame:
    """The first `most` findings of each file."""
    own = Window.partitionBy(*file_keys(found)).orderBy("line", "rule_key")
    return found.withColumn("rank", F.row_number().over(own)).filter(F.col("rank") <= most).drop("rank")


def leftover(text: Column, markers: dict[str, str] = MARKERS) -> Column:
    """The first marker after a line's first comment opener, as a finding; null if there is none."""
    comment = F.regexp_extract(text, OPENER + "(.*)$", 0)
    marker = F.upper(F.regexp_extract(comment, f"(?i)({'|'.join(markers)})" + END, 1))
    detail = F.substring(F.trim(F.regexp_extract(comment, f"(?i)({'|'.join(markers)})([^A-Za-z0-9_].*|$)", 2)), 1, 40)
    severity = F.create_map(*[F.lit(x) for pair in markers.items() for x in pair])
    found = F.when(marker != "", finding(F.concat(F.lit("LEFTOVER-"), marker), "TODO", "CODE_SMELL", severity[marker], detail))
    plain = all(x.isascii() and x.isalnum() for x in markers)
    return F.when(any_of(text, ("//", "#", "*")), F.when(any_of(F.upper(text), tuple(x.upper() for x in markers) if plain else ()), found))


def leftovers(lines: DataFrame, markers: dict[str, str] = MARKERS, most: int = 10) -> DataFrame:
    """The leftovers of each line, at most `most` a file."""
    found = lines.select(*file_keys(lines), "line", leftover(F.col("text"), markers).alias("f")).filter("f is not null")
    return per_file(found.select("*", "f.*").drop("f"), most)


def numbers_of(text: Column, digits: int = 3, safe: tuple[str, ...] = SAFE_NUMBERS) -> Column:
    """Literals of that many digits outside strings and comments, without the safe ones; none on lines that are a comment, or whose
    code declares or assigns a number."""
    bare = F.regexp_replace(F.regexp_replace(text, STRING, "S"), "(//|#).*$", "")
    stripped = F.regexp_replace(bare, r"^\s+", "")
    runs = F.regexp_extract_all(bare, F.lit("[A-Za-z0-9_$]+"), F.lit(0))
    numbers = F.filter(runs, lambda x: x.rlike(f"^[0-9]{{{digits},}}$") & ~x.isin(*safe))
    code = ~text.rlike(r"^\s*(//|#|\*|/\*)") & ~stripped.rlike(DECLARED) & ~stripped.rlike(ASSIGNED)
    none = F.array().cast("array<string>")
    return F.when(text.rlike(f"[0-9]{{{digits}}}"), F.when(code, numbers).otherwise(none)).otherwise(none)


def number_candidates(lines: DataFrame, digits: int = 3, safe: tuple[str, ...] = SAFE_NUMBERS) -> DataFrame:
    """keys, line, numbers of the lines that have any."""
    return lines.select(*file_keys(lines), "line", numbers_of(F.col("text"), digits, safe).alias("numbers")).filter(F.size("numbers") > 0)


def first_numbers(rows: Column, most: int = 5) -> Column:
    """Of a file's candidate lines in order, an array of (line, numbers): (line, number) of each line's first number not yet
    reported, at most `most`. A fold, as what a line reports depends on the lines before it."""
    start = F.struct(F.array().cast("array<string>").alias("seen"), F.array().cast("array<struct<line:int,number:string>>").alias("out"))

    def step(acc: Column, row: Column) -> Column:
        new = F.get(F.filter(row["numbers"], lambda x: ~F.array_contains(acc["seen"], x)), F.lit(0))
        take = (F.size(acc["out"]) < most) & new.isNotNull()
        return F.struct(
            F.when(take, F.concat(acc["seen"], F.array(new))).otherwise(acc["seen"]).alias("seen"),
            F.when(take, F.concat(acc["out"], F.array(F.struct(row["line"].cast("int").alias("line"), new.alias("number"))))).otherwise(acc["out"]).alias("out"),
        )

    return F.aggregate(rows, start, step, lambda acc: acc["out"])


def magic_numbers(lines: DataFrame, most: int = 5, digits: int = 3, safe: tuple[str, ...] = SAFE_NUMBERS) -> DataFrame:
    """One finding a line: its first number not yet reported in the file; at most `most` a file."""
    keys = file_keys(lines)
    own = number_candidates(lines, digits, safe).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("line", "numbers"))).alias("rows"))
    found = own.select(*keys, F.explode(first_numbers(F.col("rows"), most)).alias("n"))
    return found.select(*keys, "n.line", finding("MAGIC-NUMBER", "MAGIC", "CODE_SMELL", F.lit("MINOR"), F.col("n.number")).alias("f")).select("*", "f.*").drop("f")


def swallowed(lines: DataFrame, head: str = r"^[ \t]*except[^:]*:[ \t]*$", body: str = r"^[ \t]*pass[ \t]*$", comment: str = r"^[ \t]*#") -> DataFrame:
    """Python: an except line, then only comments, then pass."""
    keys = file_keys(lines)
    rest = lines.filter(~F.col("text").rlike(comment))
    after = F.lead("text").over(Window.partitionBy(*keys).orderBy("line"))
    found = rest.withColumn("after", after).filter(F.col("text").rlike(head) & F.col("after").rlike(body))
    return found.select(*keys, "line", finding("SWALLOWED-EXCEPTION", "ERROR", "CODE_SMELL", F.lit("MAJOR"), F.lit("")).alias("f")).select("*", "f.*").drop("f")


def style_counts(trailing: str = TRAILING, mixed: str = MIXED) -> list[Column]:
    """What the style rules count over the lines of a file. Lines keep their \\r."""
    text = F.when(F.col("text").contains("\r"), F.regexp_replace("text", "\r$", "")).otherwise(F.col("text"))
    hit = lambda c: F.min(F.when(c, F.col("line")))
    blank = F.substring(text, -1, 1).isin(" ", "\t", "\r", "\n", "\x85", "\u2028", "\u2029")  # $ may stand before a last line end
    is_trailing = blank & text.rlike(trailing) if trailing == TRAILING else text.rlike(trailing)
    is_mixed = text.contains("\t") & text.rlike(mixed) if mixed == MIXED else text.rlike(mixed)
    crlf = F.col("text").endswith("\r")
    return [
        F.count("*").alias("n"), F.count_if(is_trailing).alias("n_trailing"), hit(is_trailing).alias("at_trailing"), F.count_if(is_mixed).alias("n_mixed"), hit(is_mixed).alias("at_mixed"),
        F.bool_or(text.startswith("\t")).alias("tabs"), F.bool_or(text.startswith(" ")).alias("spaces"), F.count_if(crlf).alias("n_crlf"), hit(crlf).alias("at_crlf"),
        F.bool_or((F.col("line") == 1) & text.startswith("\ufeff")).alias("bom"),
    ]


def style_found(least: int = 3) -> Column:
    """The style findings of a file from its style_counts, as an array of (line, f)."""
    rule = lambda c, key, at, level: F.when(c, F.struct(at.cast("int").alias("line"), finding(key, "STYLE", "CODE_SMELL", F.lit(level), F.lit("")).alias("f")))
    rules = F.array(
        rule(F.col("n_trailing") >= least, "TRAILING-WHITESPACE", F.col("at_trailing"), "INFO"),
        rule(F.col("n_mixed") >= 1, "MIXED-INDENT", F.col("at_mixed"), "MINOR"),
        rule(F.col("tabs") & F.col("spaces"), "INCONSISTENT-INDENT", F.lit(1), "MINOR"),
        rule((F.col("n_crlf") >= least) & (F.col("n_crlf") < F.col("n") - 3), "MIXED-EOL", F.col("at_crlf"), "MINOR"),
        rule(F.col("bom"), "UTF8-BOM", F.lit(1), "INFO"),
    )
    return F.array_compact(rules)


def style(lines: DataFrame, trailing: str = TRAILING, mixed: str = MIXED, least: int = 3) -> DataFrame:
    """One row per file and broken style rule, at the first line that breaks it."""
    keys = file_keys(lines)
    own = lines.groupBy(*keys).agg(*style_counts(trailing, mixed))
    return own.select(*keys, F.explode(style_found(least)).alias("s")).select(*keys, "s.line", "s.f.*")


def findings(files: DataFrame, rules: tuple[LineRule, ...] = SECURITY, dangerous=DANGEROUS, markers: dict[str, str] = MARKERS, most: int = 10, numbers: bool = True, styles: dict | None = None) -> DataFrame:
    """Findings of the line rules, leftovers, magic numbers (if `numbers`) and style of all files: each text is exploded once,
    and one aggregate by file, which the tasks that explode it have summed up beforehand, gathers findings, not lines."""
    lines = lines_of(files)
    keys, text = file_keys(lines), F.col("text")
    own = lines.withColumn("hits", line_hits(text, rules, dangerous)).withColumn("left", leftover(text, markers)).withColumn("numbers", numbers_of(text) if numbers else F.array().cast("array<string>"))
    at = lambda c, cond: F.array_sort(F.collect_list(F.when(cond, F.struct(F.col("line"), F.col(c).alias("f")))))
    file = own.groupBy(*keys).agg(at("hits", F.size("hits") > 0).alias("hits"), at("left", F.col("left").isNotNull()).alias("left"), at("numbers", F.size("numbers") > 0).alias("numbers"), *style_counts(**(styles or {})))
    single = lambda x: F.struct(x["line"].cast("int").alias("line"), x["f"].alias("f"))
    magic = F.transform(
        first_numbers(F.transform("numbers", lambda x: F.struct(x["line"].alias("line"), x["f"].alias("numbers")))),
        lambda x: F.struct(x["line"].alias("line"), finding("MAGIC-NUMBER", "MAGIC", "CODE_SMELL", F.lit("MINOR"), x["number"]).alias("f")),
    )
    every = F.concat(
        F.flatten(F.transform("hits", lambda x: F.transform(x["f"], lambda f: F.struct(x["line"].cast("int").alias("line"), f.alias("f"))))),
        F.transform(F.slice("left", 1, most), single),
        magic,
        style_found(),
    )
    return file.select(*keys, F.explode(every).alias("x")).select(*keys, "x.line", "x.f.*")


def all_issues(external: DataFrame | None, *found: DataFrame) -> DataFrame:
    """One list of findings with the keys of the files, external ones first in `rank`."""
    parts = ([external] if external is not None else []) + list(found)
    out = None
    for rank, part in enumerate(parts):
        own = part.select(*file_keys(part), "line", "rule_key", "source", "kind", "severity", "message", F.lit(rank).alias("rank"))
        out = own if out is None else out.unionByName(own)
    return out


def with_advice(issues: DataFrame, advice: DataFrame) -> DataFrame:
    """issues with impact and fix of the longest advice key that starts their rule_key, else a generic pair. Only the distinct
    rule keys look for advice, among the keys with the same first character."""
    a = advice.filter("rule_key <> ''").select(F.col("rule_key").alias("of"), F.substring("rule_key", 1, 1).alias("first"), "impact", "fix")
    asked = issues.select("rule_key").distinct().withColumn("first", F.substring("rule_key", 1, 1))
    hit = asked.join(a, "first").filter(F.col("rule_key").startswith(F.col("of"))).groupBy("rule_key").agg(F.max_by(F.struct("impact", "fix"), F.struct(F.length("of"), "of")).alias("best"))
    return issues.join(hit, "rule_key", "left").withColumn("impact", F.coalesce("best.impact", F.concat(F.lit("breaks "), "rule_key"))).withColumn("fix", F.coalesce("best.fix", F.lit("see the rule"))).drop("best")


#: Severities of the explanation texts; others count as MAJOR.
SEVERITY_TEXT = {"BLOCKER": "fix at once", "CRITICAL": "fix first", "MAJOR": "plan a fix", "MINOR": "fix in passing", "INFO": "note"}


def explained(issues: DataFrame, exact: dict[str, str], by_prefix: dict[str, str]) -> DataFrame:
    """issues with an explanation: of the exact key, else of the first prefix with the severity's text."""
    hint = F.try_element_at(F.create_map(*[F.lit(x) for pair in exact.items() for x in pair]), F.col("rule_key"))
    level = F.create_map(*[F.lit(x) for pair in SEVERITY_TEXT.items() for x in pair])
    text = F.coalesce(F.try_element_at(level, F.col("severity")), F.lit(SEVERITY_TEXT["MAJOR"]))
    family = F.coalesce(*[F.when(F.col("rule_key").startswith(k), F.lit(v)) for k, v in by_prefix.items()], F.lit("a rule"))
    return issues.withColumn("explanation", F.coalesce(hint, F.concat_ws(": ", family, text)))


RANKS = {"error": ("BLOCKER", "CRITICAL"), "warning": ("MAJOR",)}


def annotated(lines: DataFrame, issues: DataFrame) -> DataFrame:
    """Every line with its number of issues and the class of the worst: error, warning, info, or null."""
    rank = F.when(F.col("severity").isin(*RANKS["error"]), 3).when(F.col("severity").isin(*RANKS["warning"]), 2).otherwise(1)
    keys = file_keys(lines)
    own = issues.groupBy(*keys, "line").agg(F.count("*").alias("issues"), F.max(rank).alias("rank"))
    level = F.when(F.col("rank") == 3, "error").when(F.col("rank") == 2, "warning").when(F.col("rank") == 1, "info")
    return lines.join(own, [*keys, "line"], "left").select(*keys, "line", F.coalesce("issues", F.lit(0)).alias("issues"), level.alias("class"))
