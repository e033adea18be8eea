"""Source code without grammars: what is comment, string or code; stripping, skeletons and symbols.

C-like languages (Rust, TypeScript, JavaScript) are read through a mask: the source with comments and the insides of
strings blanked, of the same length, so that brackets and keywords can be matched. Python goes through `ast` and
`tokenize`; where they refuse a text, callers fall back to patterns or to nothing.
"""

from __future__ import annotations

import ast
import bisect
import functools
import io
import re
import tokenize
from collections.abc import Iterator
from dataclasses import dataclass, field

C_LIKE = ("rust", "typescript", "javascript")
BODY = " { /* … */ }"
_OPEN, _CLOSE = "([{", ")]}"


# ---------------------------------------------------------------- the mask


def _end_of_quoted(s: str, i: int, quote: str) -> int:
    """Index behind a quoted string that begins at i."""
    j = i + 1
    while j < len(s) and s[j] != quote:
        if s[j] == "\n" and quote != "`" and quote != '"':
            return j
        j += 2 if s[j] == "\\" else 1
    return min(len(s), j + 1)


def _regex_may_stand(before: str) -> bool:
    t = before.rstrip()
    return not t or t[-1] in "(,=:[!&|?{};+-*%<>~^" or re.search(r"\b(return|typeof|case|in|of|delete|void|throw|new)$", t) is not None


def mask(s: str, lang: str) -> tuple[str, list[tuple[int, int]]]:
    """(masked source, comment spans)."""
    out, comments, i, n = list(s), [], 0, len(s)

    def blank(a: int, b: int) -> None:
        for k in range(a, min(b, n)):
            if out[k] != "\n":
                out[k] = " "

    template: list[int] = []  # bracket depth at which each open ${ ends
    depth = 0
    while i < n:
        c, two = s[i], s[i : i + 2]
        if two == "//":
            j = s.find("\n", i)
            j = n if j < 0 else j
            comments.append((i, j))
            blank(i, j)
            i = j
        elif two == "/*":
            j, level = i + 2, 1
            while j < n and level:
                if s[j : j + 2] == "*/":
                    level, j = level - 1, j + 2
                elif lang == "rust" and s[j : j + 2] == "/*":
                    level, j = level + 1, j + 2
                else:
                    j += 1
            comments.append((i, j))
            blank(i, j)
            i = j
        elif lang == "rust" and (m := re.compile(r"b?r(#*)\"").match(s, i)) and not (i and (s[i - 1].isalnum() or s[i - 1] == "_")):
            j = s.find('"' + m[1], m.end())
            j = n if j < 0 else j + 1 + len(m[1])
            blank(m.end(), j - 1 - len(m[1]))
            i = j
        elif c == '"' or (c == "'" and lang != "rust"):
            j = _end_of_quoted(s, i, c)
            blank(i + 1, j - 1)
            i = j
        elif c == "'":  # a character, or a lifetime
            m = re.compile(r"'(\\.[^']*|[^\\'\n])'").match(s, i)
            if m:
                blank(i + 1, m.end() - 1)
                i = m.end()
            else:
                i += 1
        elif c == "`" and lang != "rust" or (c == "}" and template and template[-1] == depth):
            if c == "}":
                template.pop()
            j = i + 1
            while j < n and s[j] != "`" and s[j : j + 2] != "${":
                j += 2 if s[j] == "\\" else 1
            blank(i + 1, j)
            if s[j : j + 2] == "${":
                template.append(depth)
                blank(j, j + 2)
                out[i] = " " if c == "}" else out[i]
                i = j + 2
            else:
                out[i] = " " if c == "}" else out[i]
                i = j + 1
        elif c == "/" and lang != "rust" and _regex_may_stand("".join(out[max(0, i - 40) : i])):
            j, inside = i + 1, False
            while j < n and s[j] != "\n" and (s[j] != "/" or inside):
                inside = s[j] == "[" or inside and s[j] != "]"
                j += 2 if s[j] == "\\" else 1
            if j < n and s[j] == "/":
                blank(i, j + 1)
                i = j + 1
            else:
                i += 1
        else:
            depth += (c == "{") - (c == "}")
            i += 1
    return "".join(out), comments


def closing(m: str, i: int) -> int:
    """Index behind the bracket that closes the one at i; the end where none does."""
    level = 0
    for j in range(i, len(m)):
        if m[j] in _OPEN:
            level += 1
        elif m[j] in _CLOSE:
            level -= 1
            if level <= 0:
                return j + 1
    return len(m)


# ---------------------------------------------------------------- stripping

_JS_LOG = re.compile(r"(?<![\w.$])console\.(?:log|debug|info|trace)[\w.$]*\s*(?=\()")
_RUST_LOG = re.compile(r"(?<![\w:])(?:println|eprintln|dbg)\s*!\s*(?=[(\[{])")


def _log_spans(s: str, m: str, lang: str) -> list[tuple[int, int]]:
    out = []
    for hit in (_RUST_LOG if lang == "rust" else _JS_LOG).finditer(m):
        end = closing(m, hit.end())
        while lang != "rust" and (more := re.compile(r"\s*\.\s*[\w$]+\s*(?=\()").match(m, end)):
            end = closing(m, more.end())
        out.append((hit.start(), end))
    return out


def _line_starts(s: str, base: int = 0) -> list[int]:
    return [base, *(base + m.end() for m in re.finditer("\n", s))]


#: Python sources of more characters are parsed in pieces of at least this many.
PIECE = 1 << 16


@functools.lru_cache(maxsize=1)
def _cuts(s: str) -> list[int]:
    """Offsets at which a Python source falls into pieces of whole top-level statements; none where it can't be read."""
    if len(s) <= PIECE or "\f" in s or "\r" in s:
        return [0]
    out, starts, level, fresh, bound = [0], _line_starts(s), 0, True, False
    try:
        for t in tokenize.generate_tokens(io.StringIO(s).readline):
            if t.type == tokenize.INDENT:
                level += 1
            elif t.type == tokenize.DEDENT:
                level -= 1
            elif t.type == tokenize.NEWLINE:
                fresh = True
            elif fresh and t.type not in (tokenize.NL, tokenize.COMMENT, tokenize.ENDMARKER):
                fresh = False
                at = starts[t.start[0] - 1]
                if level == 0 and t.start[1] == 0 and not bound and t.string not in ("else", "elif", "except", "finally") and at - out[-1] >= PIECE:
                    out.append(at)
                bound = level == 0 and t.string == "@"  # what a decorator stands on goes with it
    except (SyntaxError, tokenize.TokenError):
        return [0]
    return out


def _parsed(s: str) -> Iterator[tuple[ast.Module, _Places]]:
    """The syntax trees of a Python source, one piece at a time: a tree is hundreds of times as large as its text."""
    cuts = _cuts(s)
    for a, b in zip(cuts, [*cuts[1:], len(s)]):
        part = s[a:b]
        yield ast.parse(part), _Places(part, a)


def _python_spans(s: str, comments: bool, logs: bool) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """(comment spans, print spans) in characters; SyntaxError or tokenize.TokenError where Python refuses s."""
    starts = _line_starts(s)
    hashes, prints = [], []
    if comments:
        for t in tokenize.generate_tokens(io.StringIO(s).readline):
            if t.type == tokenize.COMMENT:
                hashes.append((starts[t.start[0] - 1] + t.start[1], starts[t.end[0] - 1] + t.end[1]))
    if logs:
        for tree, place in _parsed(s):
            for node in ast.walk(tree):
                if isinstance(node, ast.Expr) and isinstance(node.value, ast.Call) and isinstance(node.value.func, ast.Name) and node.value.func.id == "print":
                    a, b = place.span(node.value)
                    if s[a : a + 6] == "print(":
                        prints.append((a, b))
    return hashes, prints


def strip_exact(s: str, lang: str, comments: bool = True, logs: bool = True) -> str | None:
    """s without comments and debug logs, told from strings; None where the language is unknown or refuses."""
    if lang in C_LIKE:
        m, found = mask(s, lang)
        drop = list(found) if comments else []
        gone = _log_spans(s, m, lang) if logs else []
    elif lang == "python":
        try:
            drop, gone = _python_spans(s, comments, logs)
        except (SyntaxError, tokenize.TokenError, ValueError, IndexError, RecursionError):
            return None
    else:
        return None
    for a, b in gone:
        while b < len(s) and s[b] in "; \t":
            b += 1
        drop.append((a, b + 1 if b < len(s) and s[b] == "\n" else b))
    out, at = [], 0
    for a, b in sorted(drop):
        if a >= at:
            out.append(s[at:a])
            at = b
    return "".join([*out, s[at:]])


# ---------------------------------------------------------------- items


@dataclass(slots=True)
class Item:
    """kind: import, function, container or arrow. Spans are character offsets; body is -1 where there is none."""

    kind: str
    name: str
    start: int
    body: int
    end: int
    bases: list[str] = field(default_factory=list)
    children: list[Item] = field(default_factory=list)


_RUST_ITEM = re.compile(
    r"(?<![\w$])(?:pub(?:\s*\([^)]*\))?\s+)?(?:"
    r"(?P<imp>use)\s|"
    r"(?:(?:const|async|unsafe|default|extern(?:\s*\"[^\"]*\")?)\s+)*(?P<fn>fn)\s+(?P<fname>\w+)|"
    r"(?:unsafe\s+|auto\s+|default\s+)*(?P<con>struct|enum|trait|impl)\b)"
)
_JS_ITEM = re.compile(
    r"(?<![\w$.])(?:"
    r"(?P<imp>import)(?=\s*[\w$*{\"'])|"
    r"(?:async\s+)?(?P<fn>function)\b(?!\s*\*)\s*(?P<fname>[\w$]*)|"
    r"(?P<con>class|interface)\s+(?P<cname>[\w$]+)|"
    r"(?P<arrow>=>))|(?P<arrow2>=>)"
)
_JS_METHOD = re.compile(r"(?<![\w$.])(?:(?:public|private|protected|static|async|get|set|override|readonly)\s+)*\*?\s*(?P<name>[#\w$]+)\s*(?P<generic><[^(){};]*>)?\s*(?=\()")
_NOT_METHODS = {"if", "for", "while", "switch", "catch", "function", "return"}


def _find_body(m: str, i: int, hi: int, stop: str = ";") -> int:
    """Index of the `{` that opens a body from i on, or -1 if `stop` comes first; brackets are skipped whole."""
    while i < hi:
        if m[i] == "{":
            return i
        if m[i] in stop:
            return -1
        i = closing(m, i) if m[i] in "([" else i + 1
    return -1


def _rust_name(m: str, i: int) -> str:
    """The first plain type name behind `impl` or the name behind struct, enum, trait."""
    while i < len(m) and m[i].isspace():
        i += 1
    if i < len(m) and m[i] == "<":
        level = 0
        while i < len(m):
            level += (m[i] == "<") - (m[i] == ">" and m[i - 1] != "-")
            i += 1
            if level == 0:
                break
    for t in re.compile(r"(?P<path>\w+(?:::\w+)+)|(?P<name>\w+)\s*(?P<generic><)?|(?P<end>[{;(])").finditer(m, i):
        if t["end"]:
            break
        if t["name"] and not t["generic"] and t["name"] not in ("for", "dyn", "where"):
            return t["name"]
    return "<anonymous>"


def _items_c(s: str, m: str, lo: int, hi: int, lang: str, in_class: bool, arrows: bool) -> list[Item]:
    out, i = [], lo
    pattern = _RUST_ITEM if lang == "rust" else _JS_ITEM
    while i < hi:
        hit = pattern.search(m, i, hi)
        method = _JS_METHOD.search(m, i, hi) if in_class and lang != "rust" else None
        while method and (method["name"] in _NOT_METHODS or _find_body(m, closing(m, method.end()), hi, ";=,)") < 0):
            method = _JS_METHOD.search(m, closing(m, method.end()), hi)
        if method and (not hit or method.start() <= hit.start()):
            body = _find_body(m, closing(m, method.end()), hi, ";=")
            end = closing(m, body)
            start = method.start() + len(method[0]) - len(method[0].lstrip())
            out.append(Item("function", method["name"], start, body, end))
            i = end
            continue
        if not hit:
            break
        g = hit.groupdict()
        start = hit.start()
        if g["imp"]:
            if lang == "rust":
                end = m.find(";", hit.end(), hi)
            else:
                end = hit.end()
                while end < hi and m[end] not in ";\n":
                    end = closing(m, end) if m[end] in _OPEN else end + 1
                end = end - 1 if end >= hi or m[end] != ";" else end
            end = hi if end < 0 else end + 1
            out.append(Item("import", s[start:end].strip(), start, -1, end))
            i = end
        elif g.get("arrow") or g.get("arrow2"):
            i = hit.end()
            if arrows:
                a = hit.start()
                while a > lo and m[a - 1].isspace():
                    a -= 1
                one = re.search(r"[\w$]+$", m[lo:a])
                body = i
                while body < hi and m[body].isspace():
                    body += 1
                end = closing(m, body) if body < hi and m[body] == "{" else body
                while body < hi and m[body] != "{" and end < hi and m[end] not in ",;)\n]}":
                    end = closing(m, end) if m[end] in _OPEN else end + 1
                if one:
                    begin = lo + one.start()
                else:
                    begin, level = a - 1, 0
                    while begin > lo:
                        level += (m[begin] in _CLOSE) - (m[begin] in _OPEN)
                        if level == 0:
                            break
                        begin -= 1
                out.append(Item("arrow", one[0] if one else "<anonymous>", max(lo, begin), body, end))
                i = max(i, end)
        elif g["fn"]:
            body = _find_body(m, hit.end(), hi)
            if body < 0:
                i = hit.end()
                continue
            end = closing(m, body)
            out.append(Item("function", g["fname"] or "<anonymous>", start, body, end))
            i = end
        else:
            body = _find_body(m, hit.end(), hi)
            semi = m.find(";", hit.end(), hi)
            if lang == "rust":
                name = _rust_name(m, hit.end())
                par = m.find("(", hit.end(), body if body >= 0 else (semi if semi >= 0 else hi))
                if body < 0:
                    end = hi if semi < 0 else semi + 1
                    body = par if par >= 0 and g["con"] == "struct" else -1
                    out.append(Item("container", name, start, body, end))
                    i = end
                    continue
            else:
                name = g["cname"]
                if body < 0:
                    i = hit.end()
                    continue
            end = closing(m, body)
            bases = []
            if lang != "rust" and (e := re.search(r"\bextends\s+([\w$.]+)", m[hit.end() : body])):
                bases = [e[1]]
            out.append(Item("container", name, start, body, end, bases, _items_c(s, m, body + 1, end - 1, lang, True, arrows)))
            i = end
    return out


class _Places:
    """Character offsets of ast positions, whose columns are UTF-8 bytes; of a piece of a source that begins at base."""

    def __init__(self, s: str, base: int = 0):
        self.rows, self.starts = s.split("\n"), _line_starts(s, base)

    def at(self, line: int, col: int) -> int:
        row = self.rows[line - 1]
        return self.starts[line - 1] + (col if row.isascii() else len(row.encode()[:col].decode("utf-8", "ignore")))

    def span(self, node: ast.AST) -> tuple[int, int]:
        return self.at(node.lineno, node.col_offset), self.at(node.end_lineno, node.end_col_offset)


def _items_python(s: str, nodes: list, place: _Places) -> list[Item]:
    out = []
    for node in nodes:
        if isinstance(node, (ast.Import, ast.ImportFrom)):
            a, b = place.span(node)
            out.append(Item("import", s[a:b].strip(), a, -1, b))
        elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            a, b = place.span(node)
            out.append(Item("function", node.name, a, place.span(node.body[0])[0], b))
        elif isinstance(node, ast.ClassDef):
            a, b = place.span(node)
            bases = [s[slice(*place.span(x))].strip() for x in node.bases] + [f"{k.arg}={s[slice(*place.span(k.value))]}" for k in node.keywords if k.arg]
            first = node.body[0]
            top = min([first.lineno, *[d.lineno for d in getattr(first, "decorator_list", [])]])
            body = place.span(first)[0] if top == first.lineno else place.starts[top - 1]
            out.append(Item("container", node.name, a, body, b, bases, _items_python(s, node.body, place)))
        else:
            out += _items_python(s, [x for x in ast.iter_child_nodes(node)], place)
    return out


def items(s: str, lang: str, arrows: bool = False) -> list[Item] | None:
    """The file's imports, functions and containers, in order; None where the language is unknown or refuses."""
    if lang in C_LIKE:
        m, _ = mask(s, lang)
        return _items_c(s, m, 0, len(s), lang, False, arrows)
    if lang == "python":
        try:
            return [it for tree, place in _parsed(s) for it in _items_python(s, tree.body, place)]
        except (SyntaxError, ValueError, RecursionError):
            return None
    return None


def signature(s: str, it: Item) -> str:
    if it.body > it.start:
        return s[it.start : it.body].strip().rstrip("{").strip()
    return s[it.start : it.end].split("\n")[0]


def skeleton(s: str, lang: str) -> str | None:
    """Imports, signatures and container heads, two spaces a level; None where nothing is left."""
    out: list[str] = []

    def walk(found: list[Item], depth: int) -> None:
        for it in found:
            if it.kind == "import":
                line = it.name
            elif it.kind == "function":
                line = signature(s, it) + BODY
            else:
                line = signature(s, it) + " {"
            if line.strip():
                out.append("  " * depth + line + "\n")
            if it.kind == "container":
                walk(it.children, depth + 1)
                out.append("  " * depth + "}\n")

    walk(items(s, lang) or [], 0)
    return "".join(out) if "".join(out).strip() else None


# ---------------------------------------------------------------- symbols

_CALL = re.compile(r"(?P<before>\b(?:function|fn|new|class|struct|enum|trait)\s+)?(?P<name>[\w$]+)(?P<macro>\s*!)?(?:::<[^()]*>)?\s*(?P<open>[(\[{])")
_NO_CALL = {"if", "for", "while", "switch", "catch", "match", "return", "function", "fn", "loop", "in", "of", "await", "typeof", "impl", "where", "let", "else", "as", "move", "super", "async", "throw", "case"}


def _calls_c(m: str, it: Item, lang: str) -> list[str]:
    out = []
    lo = it.start if it.kind == "arrow" else max(it.body, it.start)
    for hit in _CALL.finditer(m, lo, it.end):
        if hit["macro"] and lang != "rust" or not hit["macro"] and hit["open"] != "(":
            continue
        if not hit["before"] and hit["name"] not in _NO_CALL and not hit["name"][0].isdigit():
            out.append(hit["name"])
    return out


def _calls_python(s: str, node_text: str) -> list[str]:
    out = []
    try:
        tree = ast.parse("if 1:\n" + node_text if node_text[:1] in " \t" else node_text)
    except (SyntaxError, ValueError, RecursionError):
        return out
    for n in ast.walk(tree):
        if isinstance(n, ast.Call):
            out.append(n.func.attr if isinstance(n.func, ast.Attribute) else n.func.id if isinstance(n.func, ast.Name) else re.split(r"[.:]", ast.unparse(n.func))[-1].strip())
    return out


def _all_imports(s: str, lang: str, m: str) -> list[Item]:
    """Imports anywhere in the file, inside functions too."""
    out: list[Item] = []
    if lang == "python":
        for tree, place in _parsed(s):
            for n in ast.walk(tree):
                if isinstance(n, (ast.Import, ast.ImportFrom)):
                    a, b = place.span(n)
                    out.append(Item("import", s[a:b].strip(), a, -1, b))
        return sorted(out, key=lambda x: x.start)

    def dig(lo: int, hi: int) -> None:
        for it in _items_c(s, m, lo, hi, lang, False, False):
            if it.kind == "import":
                out.append(it)
            elif it.body >= 0:
                dig(it.body + 1, it.end - 1)

    dig(0, len(s))
    return out


def symbols(s: str, lang: str, path: str) -> list[dict]:
    """Rows of a file: nodes of kind file, class, function, method, import, each with its parent's qualified name, the
    names it calls and the names of its bases."""
    return list(each_symbol(s, lang, path))


def each_symbol(s: str, lang: str, path: str) -> Iterator[dict]:
    """The same rows one by one."""
    starts = _line_starts(s)
    line = lambda i: bisect.bisect_right(starts, i)
    size = lambda a, b: len(s[a:b].encode())
    top = {"kind": "file", "name": path.rsplit("/", 1)[-1], "qualified": f"{path}::<file>", "start_line": 1, "end_line": max(1, len(s.splitlines())), "signature": None, "body_bytes": len(s.encode()), "parent": None, "calls": [], "bases": []}
    yield top
    found = items(s, lang, arrows=True)
    if found is None:
        return
    m = mask(s, lang)[0] if lang in C_LIKE else s

    def row(it: Item, kind: str, qualified: str, sig: str, parent: str | None, calls: list[str], bases: list[str]) -> dict:
        return {"kind": kind, "name": it.name, "qualified": qualified, "start_line": line(it.start), "end_line": line(max(it.start, it.end - 1)), "signature": sig, "body_bytes": size(it.start, it.end), "parent": parent, "calls": calls, "bases": bases}

    def walk(items_of: list[Item], owner: str | None, parent: str) -> Iterator[dict]:
        for it in items_of:
            if it.kind == "container":
                qualified = f"{path}::{it.name}"
                yield row(it, "class", qualified, s[it.start : it.end].split("\n")[0], parent, [], it.bases)
                yield from walk(it.children, it.name, qualified)
            elif it.kind in ("function", "arrow"):
                qualified = f"{path}::{owner}::{it.name}" if owner else f"{path}::{it.name}"
                first = starts[line(it.start) - 1]
                text = s[first : it.end] if lang == "python" and not s[first : it.start].strip() else s[it.start : it.end]
                calls = _calls_python(s, text) if lang == "python" else _calls_c(m, it, lang)
                yield row(it, "method" if owner else "function", qualified, signature(s, it), parent, calls, [])

    yield from walk(found, None, top["qualified"])
    for it in _all_imports(s, lang, m):
        if it.name:
            yield row(it, "import", f"{path}::import::{it.name}", it.name, top["qualified"], [], [])
