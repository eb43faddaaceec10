"""String, path and prompt expressions: each takes columns and gives a column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Headings and fillers of prompts, which answers and other tools refer to.
FINDING_HEAD = "### SAST finding"
FUNCTION_HEAD = "### Function containing the warning line"
CALLERS_HEAD = "### Caller Context"
LEVEL_HEAD = "## Caller level "
CALLER_HEAD = "### Caller function: "
BODY_HEAD = "// Enclosing function body "
VARIANT_HEAD = "// Body variant "
NO_BODY = "// Body not provided"
TYPE_HEAD = "Warning type: "
LINE_HEAD = "Warning code line: "
NO_LINE = "unknown; source line was not provided in the record"
NO_TYPE = "unknown"

_EDGE = r"(?U)^\s+|\s+$"


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends; trim() knows blanks only."""
    return F.regexp_replace(c, _EDGE, "")


def blank(c: Column) -> Column:
    return c.isNull() | (strip(c) == "")


# labels


def extract_label(response: Column) -> Column:
    """The label of an answer: a JSON object's label, upper-cased, null where it is none of the three; where there is no such object or
    no label in it, the first that a pattern finds."""
    inside = F.get_json_object(response, "$.label")
    is_object = F.try_parse_json(response).isNotNull() & inside.isNotNull()
    told = F.upper(inside)
    found = F.upper(F.regexp_extract(response, r'(?iU)"label"\s*:\s*"(TP|FP|UNKNOWN)"', 1))
    return F.when(is_object, F.when(told.isin("TP", "FP", "UNKNOWN"), told)).otherwise(F.nullif(found, F.lit("")))


# source text

#: Literals, comments, plain runs, and the slash that starts neither.
TOKENS = r"""(?s)"(?:[^"\\]++|\\.)*+(?:"|\\?\z)|'(?:[^'\\]++|\\.)*+(?:'|\\?\z)|//[^\n]*+|/\*.*?(?:\*/|\z)|[^"'/]++|/"""


def strip_comments(code: Column) -> Column:
    """C comments go; literals stay; a block comment leaves its newlines, and a blank if it ends."""

    def kept(t: Column) -> Column:
        ended = (F.length(t) >= 4) & t.endswith("*/")
        return F.when(t.startswith("//"), F.lit("")).when(t.startswith("/*"), F.concat(F.regexp_replace(t, r"[^\n]", ""), F.when(ended, F.lit(" ")).otherwise(F.lit("")))).otherwise(t)

    return F.array_join(F.transform(F.regexp_extract_all(code, F.lit(TOKENS), F.lit(0)), kept), "")


def lines(text: Column) -> Column:
    """Rows between newlines; a last empty one is not a row."""
    cut = F.split(text, "\n")
    return F.when(text == "", F.array().cast("array<string>")).when(text.endswith("\n"), F.slice(cut, F.lit(1), F.size(cut) - 1)).otherwise(cut)


def number_lines(text: Column) -> Column:
    """Each row behind its number, filled with zeros to the width of the last."""
    rows = lines(text)
    width = F.length(F.size(rows).cast("string"))
    return F.array_join(F.transform(rows, lambda x, i: F.concat(F.lit("L"), F.lpad((i + 1).cast("string"), width, F.lit("0")), F.lit(": "), x)), "\n")


def normalize_type(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def pointer_prefix(c: Column) -> Column:
    return F.regexp_extract(strip(c), r"^[*&]*", 0)


# paths


def normalize_path(p: Column) -> Column:
    return F.replace(p, F.lit("\\"), F.lit("/"))


def basename(p: Column) -> Column:
    return F.substring_index(p, "/", -1)


def parent_name(p: Column) -> Column:
    return F.when(F.size(F.split(p, "/")) > 1, F.element_at(F.split(p, "/"), -2)).otherwise(F.lit(""))


def path_variants(path: Column, root: Column | None = None) -> Column:
    """The path, the path without leading dots and slashes, its base name, and the same of the path under root; first ones kept."""

    def three(p: Column) -> list[Column]:
        n = normalize_path(p)
        return [n, F.regexp_replace(n, r"^[./]+", ""), basename(n)]

    own = F.array(*three(path))
    if root is None:
        return F.array_distinct(own)
    under = F.when(path.startswith("/"), path).otherwise(F.concat(F.regexp_replace(root, "/+$", ""), F.lit("/"), F.regexp_replace(path, r"^(\./)+", "")))
    return F.array_distinct(F.when(root.isNull(), own).otherwise(F.concat(own, F.array(*three(under)))))


def sanitized(c: Column) -> Column:
    return F.regexp_replace(c, r"[^A-Za-z0-9._-]", "_")


def checkout_key(project: Column, commit: Column) -> Column:
    """A project's folder: its name and the commit's first twelve characters."""
    return F.when(F.coalesce(commit, F.lit("")) == "", sanitized(project)).otherwise(F.concat(sanitized(project), F.lit("__"), sanitized(F.substring(commit, 1, 12))))


def report_name(model: Column, warning_id: Column) -> Column:
    return F.concat(sanitized(model), F.lit("/"), F.replace(warning_id, F.lit(":"), F.lit("__")), F.lit(".json"))


def is_tarball(url: Column) -> Column:
    return F.lower(F.regexp_replace(url, "/+$", "")).rlike(r"\.(tar\.gz|tgz|tar\.bz2|tar\.xz|tar)$")


def literal(s: Column) -> Column:
    """A string as Python shows it: in single quotes, or in double ones if it holds only single ones."""
    escaped = F.replace(F.replace(F.replace(s, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")), F.lit("\t"), F.lit("\\t"))
    double = s.contains("'") & ~s.contains('"')
    return F.when(double, F.concat(F.lit('"'), escaped, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(escaped, F.lit("'"), F.lit("\\'")), F.lit("'")))


def signature_text(sig: Column) -> Column:
    params = F.array_join(F.transform(sig["param_types"], literal), ", ")
    tuple_ = F.when(F.size(sig["param_types"]) == 1, F.concat(F.lit("("), params, F.lit(",)"))).otherwise(F.concat(F.lit("("), params, F.lit(")")))
    truth = F.when(sig["is_static"], F.lit("True")).otherwise(F.lit("False"))
    return F.concat(F.lit("("), F.concat_ws(", ", literal(sig["ftype"]), literal(sig["name"]), literal(sig["return_type"]), truth, tuple_), F.lit(")"))


def identifier(file_key: Column, sig: Column, root: Column | None = None) -> Column:
    """File relative to root, and the signature."""
    rel = file_key
    if root is not None:
        base = F.concat(F.regexp_replace(root, "/+$", ""), F.lit("/"))
        rel = F.when(file_key.startswith(base), F.substr(file_key, F.length(base) + 1)).otherwise(file_key)
    return F.concat(normalize_path(rel), F.lit("::"), signature_text(sig))


# prompts


def bug_type(c: Column) -> Column:
    """A list of types joined by commas; unknown where there is none."""
    parts = F.filter(F.transform(c, strip), lambda x: x != "")
    return F.coalesce(F.nullif(F.array_join(parts, ", "), F.lit("")), F.lit(NO_TYPE))


def warning_line(*candidates: Column) -> Column:
    """The first that isn't blank, without newlines at its ends."""
    return F.coalesce(*[F.when(~blank(c), F.regexp_replace(c, r"^\n+|\n+$", "")) for c in candidates])


def finding(types: Column, line: Column) -> Column:
    return F.concat(F.lit(TYPE_HEAD), bug_type(types), F.lit(f"\n{LINE_HEAD}"), F.coalesce(line, F.lit(NO_LINE)))


def function_section(bodies: Column) -> Column:
    """Numbered bodies under their ordinals; null where all are blank."""
    told = F.transform(bodies, lambda b, i: F.when(~blank(b), F.concat(F.lit(BODY_HEAD), (i + 1).cast("string"), F.lit("\n"), number_lines(strip(b)))))
    return F.nullif(F.array_join(F.filter(told, lambda x: x.isNotNull()), "\n\n"), F.lit(""))


def caller_chunk(identifier_: Column, bodies: Column) -> Column:
    """One caller: its heading and its numbered bodies."""
    full = F.transform(F.filter(F.coalesce(bodies, F.array().cast("array<string>")), lambda b: ~blank(b)), strip)
    several = F.size(full) > 1
    told = F.transform(full, lambda b, i: F.concat(F.when(several, F.concat(F.lit(VARIANT_HEAD), (i + 1).cast("string"), F.lit("\n\n"))).otherwise(F.lit("")), number_lines(b)))
    return F.concat(F.lit(CALLER_HEAD), identifier_, F.lit("\n\n"), F.when(F.size(full) == 0, F.lit(NO_BODY)).otherwise(F.array_join(told, "\n\n")))


def input_sections(level: Column, sast: Column, function: Column, callers: Column) -> Column:
    """The prompt of a level, or null where a part that it needs is blank."""
    head = F.concat(F.lit(f"{FINDING_HEAD}\n"), strip(sast), F.lit(f"\n\n{FUNCTION_HEAD}\n"), strip(function))
    with_callers = F.concat(head, F.lit(f"\n\n{CALLERS_HEAD}\n"), strip(callers))
    return F.when((level < 1) | blank(sast) | blank(function), F.lit(None).cast("string")).when(level == 1, strip(head)).when(~blank(callers), strip(with_callers))


def estimated_tokens(context: Column, text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor((F.length(context) + F.length(text)) / 4).cast("int"))


def is_rate_limit(message: Column) -> Column:
    low = F.lower(message)
    return low.contains("ratelimiterror") | low.contains("rate_limit_error") | low.contains(" 429")


def messages(context: Column, prompt: Column) -> Column:
    """A prompt as turns: role and content of the system's and of the user's."""
    return F.array(F.struct(F.lit("system").alias("role"), context.alias("content")), F.struct(F.lit("user").alias("role"), prompt.alias("content")))
