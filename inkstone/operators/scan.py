"""Small text scanners: style sheets, tags with attributes, and the plain surface of scripts.

They give positioned facts and know nothing of rules; everything after them is joins and aggregates. Style columns are 1-based, tag
columns 0-based, lines 1-based everywhere. Scripts are not parsed: comments, strings, brackets and numbers are told apart, which is what the
rules ask for.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

Fact = dict


class Places:
    """Line and 0-based column of offsets in a text."""

    def __init__(self, text: str, shift: int = 0):
        self.starts = [0, *(m.end() for m in re.finditer("\n", text))]
        self.shift = shift

    def __call__(self, offset: int) -> tuple[int, int]:
        line = bisect.bisect_right(self.starts, offset)
        return line + self.shift, offset - self.starts[line - 1]


class Broken(ValueError):
    """A text that has no reading as what it should be."""


STYLE = re.compile(r"""/\*.*?(?:\*/|\Z)|(?<!:)//[^\n]*|"(?:\\.|[^"\\])*(?:"|\Z)|'(?:\\.|[^'\\])*(?:'|\Z)|#\{[^}]*\}|\((?:[^()"']|\([^()]*\)|"[^"]*"|'[^']*')*\)|[{};]""", re.S)


def style_facts(text: str, lang: str, shift: int = 0) -> Iterator[Fact]:
    """Declarations with their block and selector, variable at-rules and comments of one style sheet; Broken if a block, string or comment never
    ends or a block ends that never began."""
    place, blocks, number, start = Places(text, shift), [], 0, 0
    holes: list[tuple[int, int]] = []

    def piece(end: int) -> tuple[str, int]:
        raw, at = text[start:end], start
        for a, b in holes:
            raw = raw[: a - start] + " " * (b - a) + raw[b - start :]
        holes.clear()
        lead = len(raw) - len(raw.lstrip())
        return raw.strip(), at + lead

    def statement(end: int) -> Iterator[Fact]:
        body, at = piece(end)
        m = re.match(r"(@?[$\w*_-][\w-]*|@[\w-]+)\s*:(?!:)\s*(.*)", body, re.S)
        if not m:
            return
        line, col = place(at)
        value = re.sub(r"\s*!\s*important\s*$", "", m[2].strip(), flags=re.I)
        fact = "at_rule" if m[1].startswith("@") else "decl"
        yield {"fact": fact, "name": m[1] if m[1].startswith(("--", "$", "@")) else m[1].lower(), "value": value, "id": blocks[-1][0] if blocks else 0, "parent": None, "selector": blocks[-1][1] if blocks else "", "line": line, "col": col + 1}

    for m in STYLE.finditer(text):
        token = m.group()
        if token[0] in "\"'" and (len(token) == 1 or token[-1] != token[0]):
            raise Broken("Unclosed string")
        if token.startswith("/*") and not (len(token) > 3 and token.endswith("*/")):
            raise Broken("Unclosed comment")
        if token.startswith("/*") or (token.startswith("//") and lang != "css"):
            holes.append(m.span())
            line, col = place(m.start())
            yield {"fact": "comment", "name": "css", "value": token[2:].removesuffix("*/").strip(), "line": line, "col": col + 1}
        elif token == "{":
            selector, _ = piece(m.start())
            number += 1
            blocks.append((number, selector))
            start = m.end()
        elif token in ";}":
            yield from statement(m.start())
            start = m.end()
            if token == "}":
                if not blocks:
                    raise Broken("Unexpected }")
                blocks.pop()
    if blocks:
        raise Broken("Unclosed block")
    yield from statement(len(text))


SPANS = {
    "blade": r"\{\{.*?\}\}|\{!!.*?!!\}|@\w+(?:\s*\((?:[^()]|\([^()]*\))*\))?",
    "jinja2": r"\{\{.*?\}\}|\{%.*?%\}|\{#.*?#\}",
    "twig": r"\{\{.*?\}\}|\{%.*?%\}|\{#.*?#\}",
    "erb": r"<%=.*?%>|<%#.*?%>|<%.*?%>",
}


def without_template_code(text: str, dialect: str) -> str:
    """Template spans as spaces, line ends and length kept."""
    return re.sub(SPANS[dialect], lambda m: re.sub(r"[^\n]", " ", m.group()), text, flags=re.S) if dialect in SPANS else text


OPEN = re.compile(r"<(/?)([A-Za-z][\w.:-]*)?")
NAME = re.compile(r"\s*([^\s=/>{\"'<]+|\{\s*\.\.\.)")
VALUE = re.compile(r"\s*=\s*(\"[^\"]*\"|'[^']*'|(?=\{)|[^\s>\"'{]+)")
EMPTY = frozenset("area base br col embed hr img input link meta source track wbr".split())


def balanced(text: str, at: int) -> int:
    """End of the bracketed run that opens at an offset, strings skipped; the text's end if it never closes."""
    depth = 0
    for m in re.compile(r"""[{(\[]|[})\]]|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`|//[^\n]*|/\*.*?\*/""", re.S).finditer(text, at):
        depth += (m.group() in "{([") - (m.group() in "})]")
        if depth <= 0 and m.group() in "})]":
            return m.end()
    return len(text)


def tag_facts(text: str, script: bool, shift: int = 0) -> Iterator[Fact]:
    """Elements with their parent and attributes, and texts and expressions between them. An attribute's value keeps its quotes or
    braces; a bare attribute's is empty. In scripts a tag must stand where an expression can start."""
    place, stack, number, at, last = Places(text, shift), [], 0, 0, 0
    while (m := OPEN.search(text, at)) is not None:
        at = m.end()
        before = text[: m.start()].rstrip()[-8:] if script else ""
        if script and not m[1] and not stack and before and not (before[-1] in "(=>{},;?:&|[" or before.endswith("return")):
            continue
        if stack and script:
            between = text[last : m.start()]
            if between.strip():
                yield {"fact": "text", "name": "expression" if "{" in between else "text", "value": between.strip(), "parent": stack[-1][0], "line": place(last)[0], "col": place(last)[1]}
        if m[1]:
            end = text.find(">", at)
            at = last = len(text) if end < 0 else end + 1
            name = m[2] or ""
            if any(n == name for _, n in stack):
                while stack and stack.pop()[1] != name:
                    pass
            continue
        attrs: list[tuple[str, str, int]] = []
        closed = False
        while at < len(text):
            if (gap := re.compile(r"\s*(/?>|\{)").match(text, at)) and gap[1] != "{":
                at, closed = gap.end(), gap[1] == "/>"
                break
            if gap:
                at = balanced(text, gap.start(1))
                continue
            n = NAME.match(text, at)
            if not n:
                at += 1
                continue
            at, value = n.end(), ""
            if v := VALUE.match(text, at):
                at, value = v.end(), v[1] or ""
                if not value and at < len(text):
                    end = balanced(text, at)
                    value, at = text[at:end], end
            attrs.append((n[1], value, n.start(1)))
        number += 1
        line, col = place(m.start())
        yield {"fact": "element", "name": m[2] or "", "id": number, "parent": stack[-1][0] if stack else 0, "line": line, "col": col, "end_line": place(at)[0]}
        for seq, (name, value, where) in enumerate(attrs):
            yield {"fact": "attr", "name": name, "value": value, "id": number, "seq": seq, "selector": m[2] or "", "line": place(where)[0] if script else line, "col": place(where)[1] if script else col}
        last = at
        if not closed and (m[2] or "").lower() not in EMPTY:
            stack.append((number, m[2] or ""))


COMMENT, STRING, TEMPLATE = r"//[^\n]*|/\*.*?(?:\*/|\Z)", r"""\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'""", r"`(?:\\.|[^`\\])*`"
REST = r"(?P<number>(?<![\w.$])\d[\w.]*)|(?P<word>[A-Za-z_$][\w$]*)|(?P<mark>=>|[=!]==?|[<>]=|&&|\|\||\?\?|\*\*|[-+*/%<>=?:,;.(){}\[\]])"
SCRIPT = re.compile(rf"(?P<comment>{COMMENT})|(?P<string>{STRING}|{TEMPLATE})|{REST}", re.S)
TOKEN = re.compile(rf"(?P<comment>{COMMENT})|(?P<string>{STRING})|(?P<tick>`)|{REST}", re.S)
BINARY = frozenset("+ - * / % ** == === != !== < > <= >= && || ??".split())
COMPONENT = re.compile(r"(?:export\s+(?:default\s+)?)?(?:(?:async\s+)?function\s+(?P<f>[A-Z]\w*)\s*(?=\()|(?:const|let|var)\s+(?P<v>[A-Z]\w*)\s*(?::[^=\n]+)?=\s*(?:async\s*)?(?:function\b\s*\w*\s*)?(?=\(|\w+\s*=>)|class\s+(?P<c>[A-Z]\w*)\b[^{]*(?=\{))")


def script_facts(text: str) -> Iterator[Fact]:
    """Comments, masked lines of code (strings and comments blanked), numbers with the role they play, and top-level components."""
    place, kept, tokens = Places(text), list(text), []
    for m in SCRIPT.finditer(text):
        kind = m.lastgroup
        if kind in ("comment", "string"):
            blank = [c if c == "\n" else " " for c in m.group()]
            kept[m.start() : m.end()] = blank
            if kind == "comment":
                line, col = place(m.start())
                yield {"fact": "comment", "name": "js", "value": m.group()[2:].removesuffix("*/").strip(), "line": line, "col": col}
        if kind != "comment":
            tokens.append((kind, m.group(), m.start()))
    opened: list[tuple[str, bool]] = []
    choices = 0
    for i, (kind, word, at) in enumerate(tokens):
        before = tokens[i - 1][1] if i else ""
        before_kind = tokens[i - 1][0] if i else ""
        value_before = before_kind in ("word", "number", "string") or before in (")", "]")
        if word in ("(", "[", "{"):
            call = word == "(" and (before_kind == "word" and before not in ("if", "for", "while", "switch", "return", "function", "catch") or before in (")", "]"))
            opened.append((word, call))
        elif word in (")", "]", "}") and opened:
            opened.pop()
        elif word == "?":
            choices += 1
        elif kind == "number":
            after = tokens[i + 1][1] if i + 1 < len(tokens) else ""
            two_back = tokens[i - 2] if i > 1 else ("", "", 0)
            signed = before == "-" and not (two_back[0] in ("word", "number", "string") or two_back[1] in (")", "]"))
            role = ""
            if not signed:
                if before in BINARY and i > 1 or after in BINARY:
                    role = "binary"
                elif before == "return":
                    role = "return"
                elif before == "?" or (before == ":" and choices):
                    role = "conditional"
                elif before in ("(", ",") and opened and opened[-1][1]:
                    role = "call"
            if role:
                line, col = place(at)
                yield {"fact": "number", "name": role, "value": word, "line": line, "col": col}
        if word == ":" and choices and not value_before:
            choices = max(0, choices - 1)
        if word == ";":
            choices = 0
    masked = "".join(kept)
    for number, code in enumerate(masked.split("\n"), 1):
        if code.strip():
            yield {"fact": "code", "name": "", "value": code, "line": number, "col": 0}
    yield from component_facts(text, masked, place)


STATIC = re.compile(r"(?:\\.|[^`\\$]|\$(?!\{))*", re.S)


def tokens(text: str) -> Iterator[str]:
    """The tokens of a script without comments, as kind and line, column and text. The kind is a letter: w(ord), s(tring), n(umber), a bracket, point,
    comma or colon itself, ` and ' around a template, < and > around an expression in it, o(ther)."""
    place, open_, at = Places(text), [], 0

    def token(kind: str, value: str, offset: int) -> str:
        line, col = place(offset)
        return f"{kind}{line} {col} {value}"

    while at < len(text):
        if open_ and open_[-1] == "`":
            at = STATIC.match(text, at).end()
            if text.startswith("${", at):
                open_.append("<")
                yield token("<", "${", at)
                at += 2
            elif at < len(text):
                open_.pop()
                yield token("'", "`", at)
                at += 1
            continue
        m = TOKEN.search(text, at)
        if m is None:
            return
        at, kind, value = m.end(), m.lastgroup, m.group()
        if kind == "tick":
            open_.append("`")
            yield token("`", value, m.start())
        elif value == "}" and open_ and open_[-1] == "<":
            open_.pop()
            yield token(">", value, m.start())
        elif kind != "comment":
            if value == "{":
                open_.append(value)
            elif value == "}" and open_:
                open_.pop()
            yield token(kind[0] if kind in ("word", "string", "number") else value if value in "()[]{}.,:" else "o", value, m.start())


def component_facts(text: str, masked: str, place: Places) -> Iterator[Fact]:
    """Top-level capitalised functions and classes: span of lines, used properties, and the tags they render with sorted attributes."""
    at = 0
    depth_at = 0
    depth = 0
    for m in COMPONENT.finditer(masked):
        if m.start() < at:
            continue
        for bracket in re.finditer(r"[{}]", masked[depth_at : m.start()]):
            depth += 1 if bracket.group() == "{" else -1
        depth_at = m.start()
        if depth:
            continue
        name, is_class = m["f"] or m["v"] or m["c"], bool(m["c"])
        head, props = m.end(), []
        if not is_class and masked[head : head + 1] == "(":
            params_end = balanced(masked, head)
            params = masked[head + 1 : params_end - 1]
            if pattern := re.match(r"\s*\{(.*?)\}", params, re.S):
                props = re.findall(r"(?:^|,)\s*([A-Za-z_$][\w$]*)", pattern[1])
            elif param := re.match(r"\s*([A-Za-z_$][\w$]*)", params):
                props = [param[1]]
            head = params_end
        named = props[0] if props and not re.match(r"\s*\{", masked[m.end() + 1 :]) and not is_class else None
        arrow = re.compile(r"\s*(?::[^={]+)?(?:=>\s*)?").match(masked, head)
        start = arrow.end()
        end = balanced(masked, start) if masked[start : start + 1] in ("{", "(") else (masked.find("\n\n", start) + 1 or len(masked))
        body, code = text[start:end], masked[start:end]
        if named:
            props = re.findall(rf"\b{re.escape(named)}\.([A-Za-z_$][\w$]*)", code)
        elif is_class:
            props = re.findall(r"\bthis\.props\.([A-Za-z_$][\w$]*)", code)
        facts = list(tag_facts(body, True)) if "<" in code else []
        tags = {f["id"]: f["name"] for f in facts if f["fact"] == "element" and f["name"]}
        attrs: dict[int, list[str]] = {}
        for f in facts:
            if f["fact"] == "attr" and not f["name"].startswith("{"):
                attrs.setdefault(f["id"], []).append(f["name"])
        structure = [".".join([tag, *sorted(attrs.get(k, []))]) for k, tag in tags.items()]
        line, col = place(m.start())
        yield {"fact": "component", "name": name, "value": "block" if masked[start : start + 1] == "{" else "expression", "props": list(dict.fromkeys(props)), "structure": structure, "line": line, "col": col, "end_line": place(max(start, end - 1))[0], "id": place(start)[0]}
        at = end
        depth_at = end
