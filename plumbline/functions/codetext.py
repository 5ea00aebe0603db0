"""Functions of source text found by line: signatures, bodies, documentation.

Regular expressions find signatures; a body ends where the indentation falls back (Python) or where a stack of brackets,
or of block words and their `end`, empties; a comment belongs to the function that follows it at a line distance of
zero, not counting markers such as annotations and attributes between them. Which comment is documentation depends on
the language. Nothing here needs a text that parses. Strings and brackets of a text are looked at once for all of its
functions, so the time grows with the text and not with the number of functions times the text.
"""

from __future__ import annotations

import re
from typing import NamedTuple

_WORDS = r"(?:(?:pub(?:\([^)]*\))?|async|unsafe|const|extern(?:\s+\"[^\"]*\")?|export|default|public|private|protected|static|final|abstract|synchronized|native|override|open|internal|local|declare)\s+)*"
SIGNATURES = {
    "python": re.compile(r"\s*(?:async\s+)?def\s+(?P<name>\w+)\s*[(\[]"),
    "go": re.compile(r"\s*func\s+(?:\([^)]*\)\s*)?(?P<name>\w+)\s*[(\[]"),
    "rust": re.compile(rf"\s*{_WORDS}fn\s+(?P<name>\w+)\s*[(<]"),
    "java": re.compile(rf"\s*(?:@\w+(?:\([^)]*\))?\s+)*{_WORDS}(?:<[^>]+>\s*)?(?!return\b|new\b|throw\b|else\b)[\w.]+(?:<[^()]*>)?(?:\[\])*\s+(?P<name>(?!if\b|for\b|while\b|switch\b|catch\b)\w+)\s*\((?=[^;]*$)"),
    "javascript": re.compile(
        rf"\s*{_WORDS}(?:function\s*\*?\s*(?P<name>\w+)\s*[(<]|(?:const|let|var)\s+(?P<name2>\w+)\s*(?::[^=]+)?=\s*(?:async\s*)?(?:function\b|(?:<[^>]*>)?\([^)]*\)\s*(?::\s*[^=]+)?=>|\w+\s*=>)"
        rf"|(?P<name3>(?!if\b|for\b|while\b|switch\b|catch\b|return\b|function\b)[\w$#]+)\s*(?:<[^>]*>)?\([^;]*\)\s*(?::\s*[^{{]+)?\{{\s*$)"
    ),
    "ruby": re.compile(r"\s*def\s+(?:self\.)?(?P<name>\w+[?!=]?)"),
    "lua": re.compile(r"\s*(?:local\s+)?function\s+(?:\w+[.:])*(?P<name>\w+)\s*\("),
}
SIGNATURES["typescript"] = SIGNATURES["javascript"]
_MARKER = {"python": re.compile(r"\s*@"), "java": re.compile(r"\s*@(?!interface)"), "javascript": re.compile(r"\s*@\w"), "typescript": re.compile(r"\s*@\w"), "rust": re.compile(r"\s*#!?\["), "go": re.compile(r"\s*//(?:go:|nolint|export )"), "ruby": re.compile(r"(?!)"), "lua": re.compile(r"(?!)")}
_LINE_DOC = {"rust": re.compile(r"\s*///(?!/) ?"), "go": re.compile(r"\s*// ?"), "ruby": re.compile(r"\s*#(?!!) ?"), "lua": re.compile(r"\s*---? ?")}
_BLOCK_DOC = {"javascript": "/**", "typescript": "/**", "java": "/**", "rust": "/**", "go": "/*"}
_STRING_TOKEN = re.compile(r"\"\"\"|'''|#|\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'")
_QUIET = {  # what brackets do not count in
    "python": re.compile(r"\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|#.*"), "ruby": re.compile(r"\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|#.*"), "lua": re.compile(r"\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|--.*"),
    "rust": re.compile(r"\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)'|//.*|/\*.*?\*/"),
}
_QUIET_BRACES = re.compile(r"\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|`(?:[^`\\]|\\.)*`|//.*|/\*.*?\*/")
_OPENING_STRING = re.compile(r"(?:[uUrR]?)(\"\"\"|'''|\"|')")


class Function(NamedTuple):
    name: str
    line: int  # of the signature, from 0
    end: int  # the line after the last of the body
    documentation: str | None
    doc_lines: tuple[int, int]  # of the documentation, from 0; empty if there is none
    signature: str


def language_of(signature: str | None, source: str | None) -> str | None:
    """The language of a function by the shape of its signature, else of the source's first signature."""
    for text in (signature, source):
        for line in (text or "").split("\n"):
            for language in ("python", "go", "rust", "javascript", "java"):
                if SIGNATURES[language].match(line) and (language != "python" or not line.rstrip().endswith("{")):
                    return language
    return None


def functions(text: str, language: str) -> list[Function]:
    """All functions of a text, inner ones too, in order of their signatures."""
    pattern = SIGNATURES.get(language)
    if pattern is None:
        return []
    lines = text.split("\n")
    quiet = _inside_strings(lines) if language == "python" else set()
    starts = [(i, m) for i, line in enumerate(lines) if i not in quiet and (m := pattern.match(line))]
    heads = _signature_ends(lines, language) if starts else []
    out = []
    for i, m in starts:
        name = next(g for g in m.groups() if g)
        head = heads[i]
        end = _body_end(lines, i, head, language, quiet)
        doc, span = _documentation(lines, i, head, end, language)
        signature = " ".join(x.strip() for x in lines[i : head + 1]).rstrip("{: ").strip()
        out.append(Function(name, i, end, doc, span, signature))
    return out


def _inside_strings(lines: list[str]) -> set[int]:
    """Lines that begin within a string of three quotes."""
    out, mark = set(), None
    for i, line in enumerate(lines):
        if mark:
            out.add(i)
        at = 0
        while True:
            if mark:
                at = line.find(mark, at)
                if at < 0:
                    break
                mark, at = None, at + 3
            else:
                m = _STRING_TOKEN.search(line, at)
                if not m or m.group() == "#":
                    break
                at = m.end()
                if m.group() in ('"""', "'''"):
                    mark = m.group()
    return out


def _signature_ends(lines: list[str], language: str) -> list[int]:
    """For each line, the line on which the brackets that are open behind it are closed again: itself if none is, or if
    they never are. Brackets within strings and comments of one line do not count."""
    quiet = _QUIET.get(language, _QUIET_BRACES)
    depth, depths, opens = 0, [0], []
    for line in lines:
        if "(" in line or ")" in line or "[" in line or "]" in line:
            code = quiet.sub("", line)
            depth += code.count("(") + code.count("[") - code.count(")") - code.count("]")
        depths.append(depth)
        opens.append(depths[-1] > depths[-2])
    # the next line whose depth is not above that before the line, by a stack of lines not yet answered
    ends, waiting = list(range(len(lines))), []
    for j in range(len(lines)):
        if opens[j]:
            waiting.append(j)
        while waiting and waiting[-1] != j and depths[j + 1] <= depths[waiting[-1]]:
            ends[waiting.pop()] = j
    return ends


def _indent(line: str) -> int:
    return len(line) - len(line.lstrip())


def _body_end(lines: list[str], i: int, head: int, language: str, quiet: set[int]) -> int:
    if language == "python":
        end, base = head + 1, _indent(lines[i])
        for j in range(head + 1, len(lines)):
            if lines[j].strip() and j not in quiet and _indent(lines[j]) <= base:
                break
            if lines[j].strip():
                end = j + 1
        return end
    if language in ("ruby", "lua"):
        depth = 0
        for j in range(i, len(lines)):
            code = re.sub(r"(?:#|--).*|\"[^\"]*\"|'[^']*'", "", lines[j])
            depth += len(re.findall(r"^\s*(?:def|class|module|if|unless|while|until|case|begin|for|function)\b|\bdo\b(?!.*\bwhile\b)|=\s*function\b|\bfunction\s*\(", code)) - len(re.findall(r"\bend\b", code))
            if depth <= 0 and j >= head:
                return j + 1
        return len(lines)
    stack, comment, seen = 0, False, False
    for j in range(i, len(lines)):
        line, k = lines[j], 0
        while k < len(line):
            two, c = line[k : k + 2], line[k]
            if comment:
                k = line.find("*/", k)
                if k < 0:
                    break
                comment, k = False, k + 2
                continue
            if two == "//":
                break
            if two == "/*":
                comment, k = True, k + 2
                continue
            if c in "\"`" or c == "'" and language != "rust":
                closing = line.find(c, k + 1)
                while closing > 0 and line[closing - 1] == "\\" and line[closing - 2] != "\\":
                    closing = line.find(c, closing + 1)
                k = closing + 1 if closing > 0 else len(line)
                continue
            if c == "{":
                stack, seen = stack + 1, True
            elif c == "}":
                stack -= 1
            k += 1
        if j >= head and (seen and stack <= 0 or not seen and line.rstrip().endswith((";", ","))):
            return j + 1
    return len(lines)


def _documentation(lines: list[str], i: int, head: int, end: int, language: str) -> tuple[str | None, tuple[int, int]]:
    if language == "python":
        return _opening_string(lines, head, end)
    j = i - 1
    marker, line_doc, block = _MARKER[language], _LINE_DOC.get(language), _BLOCK_DOC.get(language)
    found: list[str] = []
    last = None
    while j >= 0:
        line = lines[j]
        if line_doc and line_doc.match(line) and not marker.match(line):
            found.append(line_doc.sub("", line, count=1))
            last = last if last is not None else j + 1
            j -= 1
        elif found:
            break
        elif marker.match(line):
            j -= 1
        elif block and line.rstrip().endswith("*/"):
            top = j
            while top >= 0 and "/*" not in lines[top]:
                top -= 1
            if top < 0 or not lines[top].lstrip().startswith(block) or lines[top].lstrip().startswith("/**/"):
                return None, (i, i)
            return clean("\n".join(lines[top : j + 1])), (top, j + 1)
        else:
            break
    if not found:
        return None, (i, i)
    return clean("\n".join(reversed(found))), (j + 1, last)


def _opening_string(lines: list[str], head: int, end: int) -> tuple[str | None, tuple[int, int]]:
    rest = re.sub(r"^.*?\)\s*(?:->[^:]*(?:\[[^\]]*\])?[^:]*)?:", "", lines[head], count=1).strip()
    j = head
    text = rest if rest and not rest.startswith("#") else ""
    while not text:
        j += 1
        if j >= min(end, len(lines)):
            return None, (head, head)
        s = lines[j].strip()
        if s and not s.startswith("#"):
            text = s
    m = _OPENING_STRING.match(text)
    if not m:
        return None, (head, head)
    mark = m.group(1)
    body = text[m.end() :] + "\n" + "\n".join(lines[j + 1 : end])
    if len(mark) == 1:
        body = body.split("\n")[0]
    closing = re.search(rf"(?<!\\){mark}", body)
    if not closing or re.match(r"\s*(?:[.\[+%]|if\b|in\b|==)", body[closing.end() :].split("\n")[0]):
        return None, (head, head)
    doc = body[: closing.start()]
    return clean(doc), (j, j + doc.count("\n") + 1)


def clean(text: str) -> str:
    """A documentation without comment marks, common indentation and blank ends."""
    t = text.strip()
    for mark in ('"""', "'''"):
        if t.startswith(mark):
            t = t[3:]
            t = t[:-3] if t.endswith(mark) else t
    if t.startswith("/*"):
        t = re.sub(r"^/\*+!?|\*+/$", "", t)
        t = "\n".join(re.sub(r"^\s*\*+(?!\*) ?", "", x) for x in t.split("\n"))
    elif re.match(r"//|#(?!\w)|--\s", t) and all(re.match(r"\s*(?://|#|--|$)", x) for x in t.split("\n")):
        t = "\n".join(re.sub(r"^\s*(?:///?!?|#+|---?) ?", "", x) for x in t.split("\n"))
    lines = [x.rstrip() for x in t.expandtabs(4).split("\n")]
    margin = min((_indent(x) for x in lines[1:] if x), default=0)
    return "\n".join([lines[0].strip(), *[x[margin:] for x in lines[1:]]]).strip()


# -- parameters, returns, raised errors --------------------------------------------------------------------------------

_PAIRS = {"(": ")", "[": "]", "{": "}", "<": ">"}
_RAISED = {
    "javascript": re.compile(r"\bthrow\s+(?:new\s+)?([\w.]+)"), "typescript": re.compile(r"\bthrow\s+(?:new\s+)?([\w.]+)"), "java": re.compile(r"\bthrow\s+new\s+([\w.]+)"), "go": re.compile(r"\b(panic)\s*\("), "rust": re.compile(r"\b(panic)!\s*[(\[{]"),
    "python": re.compile(r"\braise\s+([\w.]+)"),
}
_IMPL = re.compile(r"\s*impl(?:<[^>]*>)?\s+(?:[\w:<>, ]+\s+for\s+)?(\w+)")
_CLASS = re.compile(r"\s*(?:(?:export|default|abstract|public|private|protected|static|final|sealed)\s+)*(?:class|interface|enum|record)\s+(\w+)")
_RECEIVER = re.compile(r"\s*func\s+\(\s*\w*\s*\*?(\w+)")


def split_top(text: str, mark: str = ",") -> list[str]:
    """The parts of a text between marks that stand outside all brackets; blank parts are left out."""
    out, depth, at = [], 0, 0
    for i, c in enumerate(text):
        if c in _PAIRS:
            depth += 1
        elif c in _PAIRS.values() and not (c == ">" and text[i - 1 : i] in ("-", "=")):
            depth = max(0, depth - 1)
        elif c == mark and not depth:
            out.append(text[at:i])
            at = i + 1
    return [x.strip() for x in [*out, text[at:]] if x.strip()]


def parameter_text(signature: str, language: str) -> tuple[str, str]:
    """What stands within the parameter brackets of a signature, and what follows them."""
    at = signature.find("(", len(m.group(0)) if language == "go" and (m := re.match(r"func\s+\([^)]*\)", signature)) else 0)
    if at < 0:
        return "", ""
    depth = 0
    for i in range(at, len(signature)):
        depth += (signature[i] == "(") - (signature[i] == ")")
        if not depth:
            return signature[at + 1 : i], signature[i + 1 :]
    return signature[at + 1 :], ""


def parameters(signature: str, language: str) -> list[dict[str, str | None]]:
    """(name, annotation, default) of each parameter; receivers such as self are left out."""
    out: list[dict[str, str | None]] = []
    for part in split_top(parameter_text(signature, language)[0]):
        name, annotation, default = part, None, None
        if language in ("python", "typescript", "javascript"):
            halves = split_top(part, "=")
            name, default = halves[0], halves[1] if len(halves) > 1 else None
            sides = split_top(name, ":")
            name, annotation = sides[0].rstrip("?"), sides[1] if len(sides) > 1 else None
            name = re.sub(r"^(?:(?:public|private|protected|readonly)\s+)+", "", name).lstrip(".")
        elif language == "rust":
            sides = split_top(part, ":")
            name, annotation = re.sub(r"^(?:mut\s+)", "", sides[0]), sides[1] if len(sides) > 1 else None
            if name.lstrip("&").replace("mut ", "").strip() == "self":
                continue
        elif language == "java":
            bits = re.sub(r"@\w+(?:\([^)]*\))?\s*|\bfinal\s+", "", part).rsplit(None, 1)
            annotation, name = (bits[0], bits[1]) if len(bits) == 2 else (None, bits[0])
        elif language == "go":
            bits = part.split(None, 1)
            name, annotation = bits[0], bits[1] if len(bits) == 2 else None
        out.append({"name": name.strip(), "annotation": annotation, "default": default})
    if language == "go":  # a, b int: the type belongs to the names before it
        for p, q in zip(reversed(out[:-1]), reversed(out)):
            p["annotation"] = p["annotation"] or q["annotation"]
    return out


def return_type(signature: str, language: str) -> str | None:
    after = parameter_text(signature, language)[1].split("{")[0].split(" where ")[0].strip().rstrip("{:;").strip()
    if language in ("python", "rust"):
        return after.split("->", 1)[1].strip() or None if "->" in after else None
    if language == "typescript":
        return after.lstrip(":").replace("=>", "").strip() or None if after.startswith(":") else None
    if language == "go":
        return after or None
    if language == "java":
        m = re.match(rf"(?:@\w+(?:\([^)]*\))?\s+)*{_WORDS}(?:<[^>]+>\s*)?(.+?)\s+\w+\s*\(", signature)
        return m.group(1) if m else None
    return None


def raised(lines: list[str], first: int, end: int, language: str) -> list[dict]:
    """(exception_class, condition, lineno from 1) of the throws and panics on the lines first to end."""
    pattern, out = _RAISED[language], []
    for i in range(first, end):
        for m in pattern.finditer(lines[i]):
            guard = next((g.group(1) for j in range(i, max(first, i - 3) - 1, -1) if (g := re.match(r"\s*(?:\}\s*else\s+)?if\s*\(?(.+?)\)?\s*[{:]\s*$", lines[j]))), None)
            out.append({"exception_class": m.group(1).split(".")[-1], "condition": guard, "lineno": i + 1})
    return out


def _owners(lines: list[str], found: list[Function], language: str) -> list[str | None]:
    """The innermost class or impl block around each function, which come in order of their lines."""
    pattern = _IMPL if language == "rust" else _CLASS
    blocks = [(j, m.group(1)) for j, line in enumerate(lines) if (m := pattern.match(line))]
    out, around, k = [], [], 0
    for f in found:
        while k < len(blocks) and blocks[k][0] < f.line:
            j, name = blocks[k]
            around.append((j, _body_end(lines, j, j, "java", set()), name))
            k += 1
        while around and around[-1][1] <= f.line:
            around.pop()
        indent = max(_indent(lines[f.line]), 1)
        out.append(next((name for j, end, name in reversed(around) if end > f.line and _indent(lines[j]) < indent), None))
    return out


def qualified(lines: list[str], found: list[Function], language: str) -> list[str]:
    """The functions' names with the innermost class, receiver or impl block around them."""
    if language == "go":
        receivers = [_RECEIVER.match(lines[f.line]) for f in found]
        return [f"{m.group(1)}.{f.name}" if m else f.name for f, m in zip(found, receivers)]
    joint = "::" if language == "rust" else "."
    return [f"{owner}{joint}{f.name}" if owner else f.name for f, owner in zip(found, _owners(lines, found, language))]


def described(text: str, language: str) -> list[dict]:
    """All functions of a text as records of the model (columns of function_records without ids)."""
    lines, found = text.split("\n"), functions(text, language)
    names = qualified(lines, found, language) if language != "python" else [f.name for f in found]
    return [
        {
            "name": f.name, "qualified_name": name, "source": "\n".join(lines[f.line : f.end]), "lineno": f.line + 1, "end_line": f.end, "signature": f.signature, "docstring": f.documentation,
            "params": parameters(f.signature, language), "return_annotation": return_type(f.signature, language), "raise_statements": raised(lines, f.line, f.end, language), "mutation_patterns": [],
        }
        for f, name in zip(found, names)
    ]


def comments(text: str, language: str) -> list[dict]:
    """(text, start_line, end_line, function) of each documentation comment that belongs to a function; lines from 1."""
    return [{"text": f.documentation, "start_line": f.doc_lines[0] + 1, "end_line": f.doc_lines[1], "function": f.name} for f in functions(text, language) if f.documentation is not None]


def syntax_error(text: str, language: str) -> str | None:
    """What is wrong with the brackets of a text, None if nothing; Go also needs a package clause."""
    if language == "python":
        import ast

        try:
            ast.parse(text)
        except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
            return f"line {getattr(e, 'lineno', None) or 0}: {getattr(e, 'msg', None) or 'cannot be parsed'}"
        return None
    if language == "go" and not re.search(r"(?m)^\s*package\s+\w+", text):
        return "no package clause"
    stack: list[tuple[str, int]] = []
    i, line = 0, 1
    while i < len(text):
        c = text[i]
        if c == "\n":
            line += 1
        elif text.startswith("//", i):
            i = text.find("\n", i)
            if i < 0:
                break
            continue
        elif text.startswith("/*", i):
            end = text.find("*/", i)
            if end < 0:
                return f"line {line}: comment is not closed"
            line += text.count("\n", i, end)
            i = end + 2
            continue
        elif c == "'" and language == "rust":
            m = re.compile(r"'(?:\\.[^']*|[^'\\])'").match(text, i)
            i = m.end() if m else i + 1
            continue
        elif c in "\"'`":
            end = i + 1
            while end < len(text) and text[end] != c and not (text[end] == "\n" and c == "'"):
                end += 2 if text[end] == "\\" and not (c == "`" and language == "go") else 1
            if end >= len(text):
                return f"line {line}: string is not closed"
            line += text.count("\n", i, end)
            i = end + 1
            continue
        elif c in "([{":
            stack.append((c, line))
        elif c in ")]}":
            if not stack or _PAIRS[stack[-1][0]] != c:
                return f"line {line}: unexpected {c}"
            stack.pop()
        i += 1
    return f"line {stack[-1][1]}: {stack[-1][0]} is not closed" if stack else None
