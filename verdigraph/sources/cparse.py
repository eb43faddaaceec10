"""Declarations of C and C++ texts, by a tokenizer and no grammar.

Approximate, and swappable: any function of (file_key, text) that gives such rows can take its place (see :func:`parser`). Comments, literals and
directives are masked, so offsets stay. Statements at file level are cut at ; and at braces; namespaces, extern "C" blocks and
conditional branches are entered, function bodies are not. Return types lose qualifiers and pointers, parameter types join their pieces
without blanks, a function called main is called original_main, and definitions with parameter declarations between header and brace
(K&R) are found in .c files. Qualified names keep their last part. What it can't make out it skips; it never raises for a text.
"""

from __future__ import annotations

import re
from bisect import bisect_right

_MASK = re.compile(r'"(?:[^"\\\n]|\\.)*"?|\'(?:[^\'\\\n]|\\.)*\'?|//[^\n]*|/\*.*?(?:\*/|\Z)', re.S)
_DIRECTIVE = re.compile(r"^[ \t]*#(?:[^\n]*\\\n)*[^\n]*", re.M)
_DEFINE = re.compile(r"[ \t]*#[ \t]*define[ \t]+([A-Za-z_]\w*)")
_IDENT = re.compile(r"[A-Za-z_]\w*")
_CALL = re.compile(r"((?:[A-Za-z_]\w*\s*(?:->|\.)\s*)*[A-Za-z_]\w*)\s*\(")
_HEADER = re.compile(r"([A-Za-z_~][\w:~]*)\s*\(((?:[^()]|\([^()]*\))*)\)\s*(?:const|noexcept|override|final|\s)*(?::[^{;]*)?$", re.S)
_NAMES = re.compile(r"\b([A-Za-z_]\w*)\s*\(([\w\s,]*)\)\s*(?=[A-Za-z_])")
_ARRAY = re.compile(r"\[[^\]]*\]")
#: The language's words.
KEYWORDS = frozenset(
    "auto break case char const continue default do double else enum extern float for goto if inline int long register restrict return short signed sizeof static struct "
    "switch typedef union unsigned void volatile while bool class delete friend namespace new operator private protected public template this throw try catch typename using virtual".split()
)
PRIMITIVE = frozenset("void char short int long float double signed unsigned bool _Bool".split())
QUALIFIERS = frozenset("static extern inline const volatile register restrict auto virtual explicit friend constexpr __inline __inline__".split())


class Rows:
    """Row and column of offsets."""

    def __init__(self, text: str) -> None:
        self.starts = [0, *(m.end() for m in re.finditer("\n", text))]

    def __call__(self, at: int) -> tuple[int, int]:
        row = bisect_right(self.starts, at) - 1
        return row, at - self.starts[row]


def blanked(text: str) -> str:
    """Blanks in place of all but newlines."""
    return re.sub(r"[^\n]", " ", text)


def masked(text: str) -> tuple[str, list[tuple[str, int]]]:
    """The text without comments, literals and directives, and the macros it defines."""
    code = _MASK.sub(lambda m: blanked(m[0]) if m[0][0] == "/" else m[0][0] + blanked(m[0][1:-1]) + m[0][-1] if len(m[0]) > 1 else m[0], text)
    macros = []

    def directive(m: re.Match) -> str:
        if d := _DEFINE.match(m[0]):
            macros.append((d[1], m.start()))
        return blanked(m[0])

    return _DIRECTIVE.sub(directive, code), macros


def pieces(code: str) -> list[tuple[int, int, int]]:
    """(start, header end, end) of file-level statements; header end is the opening brace, or the end where there is none."""
    out, at, start, n = [], 0, 0, len(code)
    while at < n:
        c = code[at]
        if c == ";":
            out.append((start, at, at + 1))
            start = at = at + 1
        elif c == "}":
            start = at = at + 1
        elif c == "{":
            head = code[start:at]
            if re.search(r'(\bnamespace\b[^;(]*|\bextern\s*"\s*C?\s*")\s*$', head) or re.search(r"\b(class)\b[^;()]*$", head):
                start = at = at + 1
                continue
            end = closing(code, at)
            if re.search(r"\b(struct|union|enum)\b[^()]*$", head) or "=" in head or re.match(r"\s*typedef\b", head):
                stop = code.find(";", end)
                stop = n if stop < 0 else stop + 1
                out.append((start, at, stop))
                start = at = stop
            else:
                out.append((start, at, end))
                start = at = end
        else:
            at += 1
    return out


def closing(code: str, at: int) -> int:
    """After the brace that closes the one at ``at``, or the text's end."""
    depth = 0
    for m in re.compile(r"[{}]").finditer(code, at):
        depth += 1 if m[0] == "{" else -1
        if not depth:
            return m.end()
    return len(code)


def base_type(words: list[str]) -> str:
    kept = [w for w in words if w not in QUALIFIERS]
    return " ".join(kept)


def split_params(text: str) -> list[str]:
    out, depth, last = [], 0, 0
    for i, c in enumerate(text):
        depth += (c in "(<[") - (c in ")>]")
        if c == "," and not depth:
            out.append(text[last:i])
            last = i + 1
    return [p.strip() for p in [*out, text[last:]] if p.strip()]


def param(text: str) -> dict:
    """Type and name of one parameter."""
    plain = _ARRAY.sub("", text.split("=")[0]).strip()
    stars = "*" * text.count("[")
    if fn := re.match(r"(.*?)\(\s*\*\s*([A-Za-z_]\w*)?\s*\)\s*\((.*)\)$", plain, re.S):
        return {"parameter": text, "param_type": re.sub(r"\s+", "", fn[1]) + "*", "param_name": fn[2] or "", "function_ptr": True}
    tokens = re.findall(r"[A-Za-z_][\w:]*|[*&]+|\.\.\.", plain)
    words = [t for t in tokens if t[0] not in "*&."]
    named = len(words) > 1 and words[-1] not in PRIMITIVE and tokens[-1] == words[-1] and not (len(words) == 2 and words[0] in ("struct", "union", "enum", "const", "unsigned"))
    name = words[-1] if named else ""
    kind = "".join(tokens[:-1] if named else tokens)
    return {"parameter": text, "param_type": kind + stars, "param_name": name, "function_ptr": True}


def params(text: str) -> list[dict]:
    found = [param(p) for p in split_params(text)]
    return [] if len(found) == 1 and found[0]["param_type"] == "void" else found


def occurrences(code: str, start: int, end: int, rows: Rows) -> dict:
    """Calls, types and identifiers between two offsets, each once for a row."""
    part = code[start:end]
    calls = {(re.sub(r"\s+", "", m[1]), rows(start + m.start())[0]) for m in _CALL.finditer(part) if m[1].split("->")[-1].split(".")[-1] not in KEYWORDS}
    used = {(m[0], rows(start + m.start())[0]) for m in _IDENT.finditer(part) if m[0] not in KEYWORDS}
    types = {(m[1], rows(start + m.start())[0]) for m in re.finditer(r"\b([A-Za-z_]\w*)(?=\s*[*&]*\s+[*&]*[A-Za-z_]|\s*[*&]+\s*[A-Za-z_]\w*\s*[;,)=\[])", part) if m[1] not in KEYWORDS}
    told = lambda s: [{"name": n, "row": r} for n, r in sorted(s, key=lambda x: (x[1], x[0]))]
    return {"calls": told(calls), "types_used": told(types), "expr_used": told(used)}


def declarations(file_key: str, text: str) -> list[dict]:
    """Rows of a source text, one for each declarator; of those with equal signatures the last."""
    code, macros = masked(text)
    rows, source, out = Rows(text), text.split("\n"), []

    def add(ftype: str, name: str, ret: str, static: bool, ps: list[dict], start: int, end: int, function: bool) -> None:
        (r0, c0), (r1, c1) = rows(start), rows(max(start, end - 1))
        name = "original_main" if name == "main" and ftype == "func" else name
        types = [p["param_type"] for p in ps] if ftype in ("func", "func_decl") else []
        sig = {"ftype": ftype, "name": name, "return_type": ret if ftype in ("func", "func_decl") else "", "is_static": static, "param_types": types}
        seen = occurrences(code, start, end, rows)
        if ftype in ("func", "func_decl"):  # its own header is no call
            seen["calls"] = [c for c in seen["calls"] if not (c["name"] == (name if name != "original_main" else "main") and c["row"] <= rows(header_end)[0] and not _called_in(code, header_end, end, c, rows))]
        out.append({"file_key": file_key, "sig": sig, "start_row": r0, "start_col": c0, "end_row": r1, "end_col": c1 + 1, "is_function": function, "parameter": ps if ftype in ("func", "func_decl") else [], "body": "\n".join(source[r0 : r1 + 1]), **seen})

    for name, at in macros:
        header_end = at
        end = text.find("\n", at)
        add("macro", name, "", False, [], at, len(text) if end < 0 else end, False)
    cut = pieces(code)
    old = old_style(code, cut) if file_key.endswith(".c") else []
    inside = {i for first, last, *_ in old for i in range(first, last + 1)}
    for i, (start, header_end, end) in enumerate(cut):
        if i in inside:
            continue
        head = code[start:header_end]
        start += len(head) - len(head.lstrip())
        head = head.strip()
        words = _IDENT.findall(head)
        if not words:
            continue
        braces = code[header_end : header_end + 1] == "{"
        static = "static" in words[:3]
        if words[0] == "typedef":
            tail = code[header_end:end] if braces else head
            names = _IDENT.findall(tail.rsplit("}", 1)[-1])
            if names:
                add("typedef", names[-1], "", False, [], start, end, False)
        elif (m := _HEADER.search(head)) and m[1].split("::")[-1] not in KEYWORDS and "=" not in head[: m.start()]:
            before = re.sub(r"[*&]", " ", head[: m.start()])
            ret = base_type(_IDENT.findall(before))
            if braces or ret:
                add("func" if braces else "func_decl", m[1].split("::")[-1], ret, static, params(m[2]), start, end, True)
        elif braces and words[0] in ("struct", "union", "enum") and len(words) > 1 and "=" not in head:
            add(words[0], words[1], "", False, [], start, end, False)
        elif not braces or "=" in head:
            kind = "extern" if words[0] == "extern" else "decl"
            first = head.split("=")[0]
            for i, d in enumerate(split_params(_ARRAY.sub("", head if not braces else first))):
                names = [w for w in _IDENT.findall(d.split("=")[0]) if w not in KEYWORDS]
                if names and (i or len(_IDENT.findall(first)) > 1):
                    add(kind, names[-1], "", static, [], start, end, False)
    known = {d["sig"]["name"] for d in out if d["sig"]["ftype"] == "func"}
    for _, last, name, above, brace in old:
        if name not in known:
            known.add(name)
            (r0, _), (r1, c1) = rows(above), rows(cut[last][2] - 1)
            kind = source[r0].strip() if code[above : rows.starts[r0 + 1]].strip() else ""
            sig = {"ftype": "func", "name": name, "return_type": kind, "is_static": False, "param_types": []}
            out.append({"file_key": file_key, "sig": sig, "start_row": r0, "start_col": 0, "end_row": r1, "end_col": c1, "is_function": True, "parameter": [], "body": "\n".join(source[r0 : r1 + 1]), **occurrences(code, brace, cut[last][2], rows)})
    last = {(g["ftype"], g["name"], g["return_type"], g["is_static"], *g["param_types"]): d for d in out for g in [d["sig"]]}
    return list(last.values())


def _called_in(code: str, start: int, end: int, call: dict, rows: Rows) -> bool:
    return any(m[1] == call["name"] and rows(start + m.start())[0] == call["row"] for m in _CALL.finditer(code[start:end]))


def declared(text: str) -> set[str]:
    """Names that a declaration declares."""
    found = [[w for w in _IDENT.findall(d) if w not in KEYWORDS] for d in split_params(_ARRAY.sub("", text))]
    return {w[-1] for w in found if w}


def old_style(code: str, cut: list[tuple[int, int, int]]) -> list[tuple[int, int, str, int, int]]:
    """Definitions with parameter declarations between header and brace: first and last of the pieces ``cut``, the name, and where the
    type's row and the block begin. Before a block without a header lie declarations; the first of these follows a name and a list of names
    in the same piece, all that they declare is in the list, and the name begins a row under that of its type."""
    out = []
    for i, (start, brace, _) in enumerate(cut):
        if code[brace : brace + 1] != "{" or code[start:brace].strip():
            continue
        names: set[str] = set()
        for k in range(i - 1, -1, -1):
            first, stop, end = cut[k]
            if code[stop : stop + 1] != ";" or code[end : cut[k + 1][0]].strip():
                break
            head = code[first:stop]
            m = next((m for m in _NAMES.finditer(head) if m[1] not in KEYWORDS), None)
            names |= declared(head[m.end() :] if m else head)
            if m:
                above = head[: m.start()].rstrip()
                if above and "\n" in head[len(above) : m.start()] and names <= set(split_params(m[2])):
                    out.append((k, i, m[1], first + above.rfind("\n") + 1, brace))
                break
    return out


def parser(name: str = "tokens"):
    """A parser by name: tokens (this one)."""
    if name != "tokens":
        raise ValueError(f"unknown parser {name!r}")
    return declarations
