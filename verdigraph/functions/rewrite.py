"""Source rewrites: plain functions of a text, and :func:`column` to run one over a column in Arrow batches.

They are lexers or need balanced parentheses, which no built-in expression has. All are total: a text they don't apply to comes back.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"?|\'(?:[^\'\\]|\\.)*\'?|//[^\n]*|/\*.*?(?:\*/|\Z)|#[^\n]*|;|.', re.S)
_ROW_END = re.compile(r"[;{}][^\S\n]*\n")
_LITERAL = re.compile(r'"(?:[^"\\]|\\.)*"(?:\s*"(?:[^"\\]|\\.)*")+|\'(?:[^\'\\]|\\.)*\'', re.S)


def column(rewrite: Callable[[str], str], kind: str = "string") -> Callable[[Column], Column]:
    @F.pandas_udf(kind)
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else rewrite(t))

    return run


def edited(text: str, edits: list[tuple[int, int, str]]) -> str:
    """The text with each stretch [start, end) replaced. Stretches don't overlap; insertions at one place keep their order."""
    out, at = [], 0
    for start, end, new in sorted(edits, key=lambda e: e[:2]):
        out += [text[at:start], new]
        at = end
    return "".join([*out, text[at:]])


def matched(text: str, kinds: str = "(){}") -> tuple[dict[int, int], bool]:
    """Places of opening brackets with those of the brackets that close them, and whether every bracket has its partner, in order."""
    closes, open_, found, whole = dict(zip(kinds[::2], kinds[1::2])), [], {}, True
    for m in re.finditer(f"[{re.escape(kinds)}]", text):
        if m[0] in closes:
            open_.append(m.start())
        elif open_ and closes[text[open_[-1]]] == m[0]:
            found[open_.pop()] = m.start()
        else:
            whole = False
    return found, whole and not open_


def is_nested(text: str) -> bool:
    """Round and curly brackets are balanced."""
    return matched(text)[1]


def statements_from(text: str, start: str) -> list[str]:
    """Each text from an occurrence of ``start`` to the end of the parentheses after it, or of the text where these stay open."""
    if not start:
        return []
    closing = matched(text, "()")[0]
    opened = ((m.start(), text.find("(", m.start())) for m in re.finditer(f"(?={re.escape(start)})", text))
    return [text[at : closing.get(bracket, len(text)) + 1] for at, bracket in opened if bracket >= 0]


def statements_like(text: str, pattern: str) -> list[str]:
    """Matches of a pattern whose brackets are balanced."""
    return [m[0] for m in re.finditer(pattern, text, re.M | re.S) if is_nested(m[0])]


def _line_place(text: str, at: int, without: list[tuple[int, int, str]] = ()) -> int | None:
    """The end of the last row before that of ``at`` which ends a statement or a block, and doesn't end in the stretches ``without``."""
    row = text.rfind("\n", 0, at) + 1
    ends = [m.end() for m in _ROW_END.finditer(text, 0, row) if not any(a < m.end() <= b for a, b, _ in without)]
    return ends[-1] if ends else None


def insert_before(text: str, match: str, line: str) -> str:
    """A line after the last statement or block that ends in a row before that of ``match``; none ends: no change."""
    at = text.find(match)
    place = None if at < 0 else _line_place(text, at)
    return text if place is None else edited(text, [(place, place, line.strip() + "\n")])


def replaced_statements(text: str, found: list[str], first: int = 0, inplace: bool = True, prefix: str = "statement") -> tuple[str, list[str], int]:
    """Each statement found becomes a name that a #define stands for: a definition before its statement (inplace; the rows it took
    stay, as newlines), or one in the list that comes back. Also the next free number. A statement takes its first place that no other
    has; one without a place (inside another, say) is left alone."""
    names = [f"{prefix}_{first + i}_replacement" for i in range(len(found))]
    defines = [f"#define {name} " + s.replace("\n", "\\\n") for name, s in zip(names, found)]
    edits: list[tuple[int, int, str]] = []
    lines = []
    for name, define, s in zip(names, defines, found):
        places = (m.start() for m in re.finditer(f"(?={re.escape(s)})", text))
        at = next((p for p in places if all(p + len(s) <= a or b <= p for a, b, _ in edits)), None)
        if at is not None:
            edits.append((at, at + len(s), name + "\n" * (inplace * s.rstrip("\n").count("\n"))))
            lines.append((at, define))
    if not inplace:
        return edited(text, edits), defines, first + len(found)
    placed = [(place, place, define.strip() + "\n") for at, define in reversed(lines) if (place := _line_place(text, at, edits)) is not None]
    return edited(text, placed + edits), [], first + len(found)


def without_call(text: str, name: str) -> str:
    """Drops ``name`` and the parentheses after it."""
    closing, edits = matched(text, "()")[0], []
    for m in re.finditer(rf"{re.escape(name)}\s*\(", text):
        if not edits or m.start() >= edits[-1][1]:
            edits.append((m.start(), closing.get(m.end() - 1, len(text)) + 1, ""))
    return edited(text, edits)


def joined_literals(text: str) -> str:
    """String literals beside each other become one; newlines between them come after it."""

    def join(m: re.Match) -> str:
        if m[0][0] == "'":
            return m[0]
        parts = re.findall(r'"((?:[^"\\]|\\.)*)"', m[0], re.S)
        gaps = re.sub(r'"(?:[^"\\]|\\.)*"', "", m[0])
        return '"' + "".join(parts) + '"' + "\n" * gaps.count("\n")

    return _LITERAL.sub(join, text)


def code_parts(text: str) -> list[str]:
    """The text cut after each semicolon, directive and comment that isn't inside a literal."""
    parts, start = [], 0
    for m in _TOKEN.finditer(text):
        if m[0] == ";" or m[0].startswith(("#", "//", "/*")):
            parts.append(text[start : m.end()])
            start = m.end()
    return [*parts, text[start:]] if start < len(text) else parts


def plain_c(text: str) -> str:
    """Without attributes, and with adjacent literals joined in each part."""
    return "".join(without_call(joined_literals(p), "__attribute__").replace(".__sigaction_handler", "") for p in code_parts(text))


def without_asm(text: str) -> str:
    """Without attributes; assembler statements become names that are defined at the top."""
    text = without_call(text, "__attribute__")
    text, defines, _ = replaced_statements(text, statements_from(text, "__asm__"), inplace=False)
    return "\n".join(defines) + "\n" + text


def blanked_ranges(text: str, ranges: list[tuple[tuple[int, int], tuple[int, int]]], drop_empty: bool = True) -> str:
    """Blanks in place of all that lies in ranges ((row, column), (row, column)), newlines too, so rows merge. Rows of blanks alone go."""
    starts = [0, *(m.end() for m in re.finditer("\n", text)), len(text)]
    out = text
    for (r0, c0), (r1, c1) in ranges:
        a, b = min(starts[r0] + c0, len(text)), min(starts[r1] + c1, len(text))
        out = out[:a] + " " * (b - a) + out[b:]
    return "".join(row for a, b in zip(starts, starts[1:]) if (row := out[a:b]).strip() or not drop_empty)


def marked(text: str, row: int) -> str:
    """The row tagged as target, between rows that switch formatting off and on. The last row can't be."""
    rows = text.splitlines()
    if not 0 <= row < len(rows):
        raise ValueError("no such row")
    rows.insert(row - 1, "// clang-format off")
    rows[row] = "/*target_line*/" + rows[row].strip()
    rows.insert(row + 1, "// clang-format on")
    return "\n".join(rows)


def without_entries(text: str, entries: list[dict], drop: set[tuple]) -> str:
    """Without the declarations whose (kind, name) or signature is in ``drop``. entries: rows of a parser."""
    sig = lambda e: (e["sig"]["ftype"], e["sig"]["name"], e["sig"]["return_type"], e["sig"]["is_static"], tuple(e["sig"]["param_types"]))
    gone = [e for e in entries if sig(e) in drop or sig(e)[:2] in drop]
    return blanked_ranges(text, [((e["start_row"], e["start_col"]), (e["end_row"], e["end_col"])) for e in gone])


def trimmed(text: str, entries: list[dict], name: str, row: int) -> str:
    """The function ``name`` without the rows after ``row`` up to its last one, which closes it."""
    cut = [((row + 1, 0), (e["end_row"], 0)) for e in entries if e["sig"]["ftype"] == "func" and e["sig"]["name"] == name and e["start_row"] <= row < e["end_row"] - 1]
    return blanked_ranges(text, cut)


def names_in_functions(entries: list[dict]) -> dict[str, set[str]]:
    return {e["sig"]["name"]: {x["name"] for x in e["expr_used"]} for e in entries if e["sig"]["ftype"] == "func"}


def global_names(entries: list[dict]) -> set[str]:
    return {e["sig"]["name"] for e in entries if e["sig"]["ftype"] in ("decl", "extern")}


def with_suffix(path: str, suffix: str) -> str:
    return re.sub(r"\.[^./]*$", "", path) + suffix


def file_stem(path: str) -> str:
    return re.sub(r"\.[^./]*$", "", path.rsplit("/", 1)[-1])
