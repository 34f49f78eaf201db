"""Token streams of source texts: kinds, places, and the line ends that matter."""

from __future__ import annotations

import re

from codequarry.llm.grammars import grammar

BAD = "BAD"

# digits with underscores between them; a leading zero makes an octal number unless a point or an exponent follows
_D = r"\d(?:_*\d)*"
NUMBER = (
    r"(?:0[xX]_?(?:[0-9a-fA-F](?:_*[0-9a-fA-F])*)?\.?(?:[0-9a-fA-F](?:_*[0-9a-fA-F])*)?(?<![xX_])(?:[pP][+-]?\d+)?|0[bB]_?[01](?:_*[01])*|0[oO]_?[0-7](?:_*[0-7])*"
    rf"|(?:{_D})?\.{_D}(?:[eE][+-]?{_D})?|{_D}(?:\.(?:[eE][+-]?{_D})?|[eE][+-]?{_D})|0(?:_*[0-7])*(?=[lLi]?(?![\w.$]))|[1-9](?:_*\d)*|{_D}(?=[fFdDi]))"
)
DOUBLE, SINGLE = r'"(?:[^"\\\n\r]|\\(?:\r\n|[\s\S]))*"', r"'(?:[^'\\\n\r]|\\(?:\r\n|[\s\S]))*'"
SKIP = r"(?P<skip>(?:[ \t\f\v﻿\xa0  \r\n]|//[^\n\r]*|/\*[\s\S]*?\*/)*)"


class Lexed:
    """Kinds, start offsets and, for languages that end statements with lines, the tokens after a line end."""

    __slots__ = ("kinds", "at", "breaks")

    def __init__(self):
        self.kinds: list[str] = []
        self.at: list[int] = []
        self.breaks: set[int] | None = None


def _words(language: str) -> set[str]:
    return {w for w in grammar(language).literals if re.fullmatch(r"[a-z]+(-[a-z]+)?|None|True|False", w)}


def _marks(language: str, operators: str, augmented: str) -> tuple[str, dict[str, str]]:
    """A pattern of all marks, longest first, and the kinds of those that the grammar has no literal for."""
    literal = {t for t in grammar(language).literals if not t[0].isalnum()}
    kinds = dict.fromkeys(operators.split(), "OP") | dict.fromkeys(augmented.split(), "AUG") | {t: t for t in literal}
    return "|".join(re.escape(m) for m in sorted(kinds, key=len, reverse=True)), kinds


JSON_TOKEN = re.compile(
    r'[ \t\r\n]*(?:(?P<STR>"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")|(?P<NUM>-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?(?![\w.]))'
    r"|(?P<mark>[\[\]{}:,]|true\b|false\b|null\b)|(?P<end>\Z)|(?P<bad>[\s\S]))",
    re.A,
)


def lex_json(text: str) -> Lexed:
    out = Lexed()
    for m in JSON_TOKEN.finditer(text):
        kind = m.lastgroup
        if kind == "end":
            break
        out.kinds.append(m[kind] if kind == "mark" else BAD if kind == "bad" else kind)
        out.at.append(m.start(kind))
    return out


TOML_TOKEN = re.compile(
    r'[ \t]*(?:\#[^\n\r\x00-\x08\x0b\x0c\x0e-\x1f]*)?(?:(?P<NL>\r?\n)|(?P<LONG>"""(?:[^\\"]|\\(?:[btnfre"\\ \n\r]|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8})|""?(?!"))*"{3,5}'
    r"|'''[\s\S]*?'{3,5})|(?P<STR>\"(?:[^\"\\\n\r]|\\(?:[btnfr\"\\]|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}))*\"|'[^'\n\r]*')"
    r"|(?P<DATE>\d{4}-\d\d-\d\d(?:[Tt ]\d\d:\d\d:\d\d(?:\.\d+)?(?:[Zz]|[+-]\d\d:\d\d)?)?(?![\w-])|\d\d:\d\d:\d\d(?:\.\d+)?(?![\w-]))"
    r"|(?P<FLOAT>[+-]?(?:(?:0|[1-9](?:_?\d)*)(?:\.\d(?:_?\d)*(?:[eE][+-]?\d(?:_?\d)*)?|[eE][+-]?\d(?:_?\d)*)|inf|nan)(?![\w.-]))"
    r"|(?P<INT>(?:[+-]?(?:0|[1-9](?:_?\d)*)|0x[0-9a-fA-F](?:_?[0-9a-fA-F])*|0o[0-7](?:_?[0-7])*|0b[01](?:_?[01])*)(?![\w.-]))|(?P<BOOL>(?:true|false)(?![\w-]))"
    r"|(?P<BARE>[A-Za-z0-9_-]+)|(?P<mark>[\[\]{}=.,])|(?P<end>\Z)|(?P<bad>[\s\S]))"
)


TOML_KEY = re.compile(r"[ \t]*(?P<BARE>[A-Za-z0-9_-]+)")


def lex_toml(text: str) -> Lexed:
    """Where a key stands, what looks like a number, date or truth value is a bare key."""
    out, pos, key, open_marks = Lexed(), 0, True, []
    while True:
        m = key and TOML_KEY.match(text, pos) or TOML_TOKEN.match(text, pos)
        kind, pos = m.lastgroup, m.end()
        if kind == "end":
            return out
        out.at.append(m.start(kind))
        if kind == "mark":
            kind = m["mark"]
            if kind == "=":
                key = False
            elif kind in "[{" and not (key and kind == "["):
                open_marks.append(kind)
                key = kind == "{"
            elif kind in "]}" and not key or kind == "}":
                key = bool(open_marks and open_marks.pop() is None)
            elif kind == "," and open_marks and open_marks[-1] == "{":
                key = True
        elif kind == "NL" and not open_marks:
            key = True
        out.kinds.append(BAD if kind == "bad" else kind)


PY_MARKS, PY_KINDS = _marks("python", "/ // % << >> & ^ == != < > <= >=", "+= -= *= /= //= %= @= &= |= ^= >>= <<= **=")
PY_STRING = r"""(?P<STR>(?i:[rbu]|br|rb)?(?:\"\"\"(?:[^\\]|\\[\s\S])*?\"\"\"|'''(?:[^\\]|\\[\s\S])*?'''|"(?:[^"\\\n\r]|\\(?:\r\n|[\s\S]))*"|'(?:[^'\\\n\r]|\\(?:\r\n|[\s\S]))*'))"""
PY_FSTRING = r"""(?P<FSTR>(?i:f|fr|rf)(?:\"\"\"|'''|"|'))"""
PY_TOKEN = re.compile(
    rf"(?:[ \t\f]|\\\r?\n|\#[^\n\r]*)*(?:(?P<NL>\r\n|\n|\r)|{PY_FSTRING}|{PY_STRING}|(?P<NUM>(?:0[xX](?:_?[0-9a-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+"
    r"|(?:(?:\d(?:_?\d)*)?\.\d(?:_?\d)*|\d(?:_?\d)*\.?)(?:[eE][+-]?\d(?:_?\d)*)?)[jJ]?(?!\w)|\d+(?=(?:if|or|in|is|and|else)\b))"
    rf"|(?P<ID>[^\W\d]\w*)|(?P<mark>{PY_MARKS})|(?P<end>\Z)|(?P<bad>[\s\S]))"
)
PY_WORDS = _words("python")
# escapes that are errors, with an even number of backslashes before them; in bytes only \\x is an escape
_ESCAPED = r"(?<!\\)(?:\\\\)*\\"
PY_BROKEN = re.compile(_ESCAPED + r"(?:x(?![0-9a-fA-F]{2})|u(?![0-9a-fA-F]{4})|U(?!(?:000[0-9a-fA-F]|0010)[0-9a-fA-F]{4})|N(?!\{[^{}]+\}))")
PY_BROKEN_BYTES = re.compile(_ESCAPED + r"x(?![0-9a-fA-F]{2})|[^\x00-\x7f]")
GO_BROKEN = re.compile(_ESCAPED + r"(?![abfnrtv\\\"]|x[0-9a-fA-F]{2}|[0-3][0-7]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8})")
JAVA_BROKEN = re.compile(_ESCAPED + r"(?![btnfrs\"'\\\r\n]|[0-7]|u+[0-9a-fA-F]{4})")
JS_BROKEN = re.compile(_ESCAPED + r"(?:x(?![0-9a-fA-F]{2})|u(?![0-9a-fA-F]{4}|\{0*(?:10)?[0-9a-fA-F]{1,5}\})|[1-9]|0\d)")
PLAIN_TEXT = re.compile(r"[^\\{}\"'\n\r]+")
CONVERSION = re.compile(r"![rsa](?!\w)")


def _broken_python(token: str) -> bool:
    prefix = token[: min(token.find(q) % (len(token) + 1) for q in "\"'")].lower()
    if "b" in prefix:
        return bool(PY_BROKEN_BYTES.search(token)) if "r" not in prefix else not token.isascii()
    return "\\" in token and "r" not in prefix and bool(PY_BROKEN.search(token))


def _fstring(text: str, pos: int, quote: str, raw: bool, out: Lexed) -> int:
    """Tokens of an f-string from after its opening quote, fields lexed like code; its end, or -1 behind a BAD token."""
    begin = pos

    def put(kind: str, where: int) -> int:
        out.kinds.append(kind)
        out.at.append(where)
        return -1

    def field(pos: int) -> int:
        depth = 0
        while True:
            m = PY_TOKEN.match(text, pos)
            kind = m.lastgroup
            start, pos = m.start(kind), m.end()
            if kind == "NL":
                continue
            if kind == "FSTR":
                put(kind, start)
                pos = _fstring(text, pos, m[kind].lstrip("fFrR"), "r" in m[kind].lower(), out)
                if pos < 0:
                    return -1
                continue
            if kind == "ID":
                kind = m["ID"] if m["ID"] in PY_WORDS else kind
            elif kind == "mark":
                mark = m["mark"]
                if not depth and mark == "}":
                    put("CLOSE", start)
                    return pos
                if not depth and mark[0] == ":":
                    put("SPEC", start)
                    return literal(start + 1, True)
                kind = PY_KINDS[mark]
                depth += (kind in ("(", "[", "{")) - (kind in (")", "]", "}"))
                if depth < 0:
                    return put(BAD, start)
            elif kind == "bad" and not depth and (c := CONVERSION.match(text, start)):
                kind, pos = "CONV", c.end()
            elif kind in ("bad", "end") or kind == "NUM" and ZERO_LED.match(m["NUM"]) or kind == "STR" and _broken_python(m["STR"]):
                return put(BAD, start)
            elif kind == "STR" and BYTES.match(m["STR"]):
                kind = "BYTES"
            put(kind, start)

    def literal(pos: int, spec: bool) -> int:
        begin = pos
        while True:
            if m := PLAIN_TEXT.match(text, pos):
                pos = m.end()
            c = text[pos : pos + 1]
            if not c or len(quote) == 1 and c in "\n\r" or text.startswith(quote, pos) and spec:
                return put(BAD, pos)
            if text.startswith(quote, pos) or c == "}" and spec:
                if not raw and PY_BROKEN.search(text[begin:pos]):
                    return put(BAD, begin)
                put("CLOSE" if spec else "FEND", pos)
                return pos + (1 if spec else len(quote))
            if c in "{}" and not spec and text[pos + 1 : pos + 2] == c:
                pos += 2
            elif c == "}":
                return put(BAD, pos)
            elif c == "{":
                if not raw and PY_BROKEN.search(text[begin:pos]):
                    return put(BAD, begin)
                put("FIELD", pos)
                pos = begin = field(pos + 1)
                if pos < 0:
                    return -1
            elif c == "\\":
                named = not raw and re.compile(r"\\N\{[^{}\n]+\}").match(text, pos)
                after = text[pos + 1 : pos + 2]
                pos = named.end() if named else pos + (1 if after in "{}" else 3 if text[pos + 1 : pos + 3] == "\r\n" else 2)
            else:
                pos += 1

    return literal(begin, False)


BYTES = re.compile(r"[rR]?[bB]")
ZERO_LED = re.compile(r"0[\d_]*[1-9][\d_]*\Z")
INDENT = re.compile(r"[ \t\f]*")


def lex_python(text: str) -> Lexed:
    """Line structure included: NL, INDENT and DEDENT outside brackets; a tab that leaves the depth open is bad."""
    out = Lexed()
    kinds, at = out.kinds, out.at
    columns, tabless, depth, pos, fresh = [0], [0], 0, 1 if text.startswith("﻿") else 0, True
    while True:
        if fresh and not depth:
            fresh = False
            blank = INDENT.match(text, pos)
            rest = text[blank.end() : blank.end() + 1]
            if rest and rest not in "#\n\r":
                col = alt = 0
                for c in blank.group():
                    col, alt = (0, 0) if c == "\f" else ((col // 8 + 1) * 8, alt + 1) if c == "\t" else (col + 1, alt + 1)
                if col == columns[-1] and alt != tabless[-1] or (col > columns[-1]) != (alt > tabless[-1]) and col >= columns[-1]:
                    kinds.append(BAD)
                    at.append(blank.end())
                    return out
                if col > columns[-1]:
                    columns.append(col)
                    tabless.append(alt)
                    kinds.append("INDENT")
                    at.append(blank.end())
                while col < columns[-1]:
                    columns.pop()
                    tabless.pop()
                    kinds.append("DEDENT")
                    at.append(blank.end())
                if col != columns[-1] or alt != tabless[-1]:
                    kinds.append(BAD)
                    at.append(blank.end())
                    return out
        m = PY_TOKEN.match(text, pos)
        kind, start, pos = m.lastgroup, m.start(m.lastgroup), m.end()
        if kind == "end":
            break
        if kind == "NL":
            fresh = True
            if depth or not kinds or kinds[-1] in ("NL", "INDENT", "DEDENT"):
                continue
        elif kind == "ID":
            word = m["ID"]
            if word in PY_WORDS:
                kind = word
        elif kind == "mark":
            kind = PY_KINDS[m["mark"]]
            if kind in ("(", "[", "{"):
                depth += 1
            elif kind in (")", "]", "}"):
                depth = max(0, depth - 1)
        elif kind == "FSTR":
            kinds.append(kind)
            at.append(start)
            pos = _fstring(text, pos, m["FSTR"].lstrip("fFrR"), "r" in m["FSTR"].lower(), out)
            if pos < 0:
                return out
            continue
        elif kind == "bad" or kind == "NUM" and ZERO_LED.match(m["NUM"]) or kind == "STR" and _broken_python(m["STR"]):
            kinds.append(BAD)
            at.append(start)
            return out
        elif kind == "STR" and BYTES.match(m["STR"]):
            kind = "BYTES"
        kinds.append(kind)
        at.append(start)
    if kinds and kinds[-1] not in ("NL", "DEDENT") and not depth:
        kinds.append("NL")
        at.append(len(text))
    if not depth:
        kinds.extend(["DEDENT"] * (len(columns) - 1))
        at.extend([len(text)] * (len(columns) - 1))
    return out


GO_MARKS, GO_KINDS = _marks("go", "+ - / % & ^ << >> &^ == != < > <= >= && ||", "+= -= *= /= %= &= |= ^= <<= >>= &^=")
GO_TOKEN = re.compile(
    rf"{SKIP}(?:(?P<STR>{DOUBLE}|`[^`]*`)|(?P<CHAR>'(?:[^'\\\n]|\\(?:[abfnrtv\\'\"]|x[0-9a-fA-F]{{2}}|[0-7]{{3}}|u[0-9a-fA-F]{{4}}|U[0-9a-fA-F]{{8}}))')"
    rf"|(?P<NUM>{NUMBER}i?(?!\w))|(?P<ID>[^\W\d]\w*)|(?P<mark>{GO_MARKS})|(?P<end>\Z)|(?P<bad>[\s\S]))"
)
GO_WORDS = _words("go")
GO_ENDS = {"ID", "NUM", "STR", "CHAR", "break", "continue", "fallthrough", "return", "++", "--", ")", "]", "}"}


def lex_go(text: str) -> Lexed:
    """With the semicolons that line ends stand for."""
    out = Lexed()
    kinds, at, last = out.kinds, out.at, ""
    for m in GO_TOKEN.finditer(text):
        kind = m.lastgroup
        skipped = m["skip"]
        if last in GO_ENDS and (kind == "end" or "\n" in skipped):
            kinds.append(";")
            at.append(m.start())
        if kind == "end":
            break
        if kind == "ID":
            word = m["ID"]
            kind = word if word in GO_WORDS else kind
        elif kind == "mark":
            kind = GO_KINDS[m["mark"]]
        elif kind == "bad" or kind == "STR" and m["STR"][0] == '"' and GO_BROKEN.search(m["STR"]):
            kind = BAD
        last = kind
        kinds.append("NUM" if kind == "CHAR" else kind)
        at.append(m.start(m.lastgroup))
    return out


JAVA_MARKS, JAVA_KINDS = _marks("java", "+ - / % ^ << == != <= >= && || ~", "+= -= *= /= %= &= |= ^= <<=")
JAVA_TOKEN = re.compile(
    rf"{SKIP}(?:(?P<STR>\"\"\"[ \t]*\r?\n(?:[^\\]|\\[\s\S])*?\"\"\"|{DOUBLE})|(?P<CHAR>'(?:[^'\\\n\r]|\\(?:[btnfrs\"'\\]|[0-7]{{1,3}}|u+[0-9a-fA-F]{{4}}))')"
    rf"|(?P<NUM>{NUMBER}[lLfFdD]?(?![\w$]))|(?P<word>non-sealed\b)|(?P<ID>[^\W\d][\w$]*|\$[\w$]*)|(?P<mark>{JAVA_MARKS})|(?P<end>\Z)|(?P<bad>[\s\S]))"
)
JAVA_SOFT = {"record", "sealed", "permits", "yield"}
JAVA_WORDS = _words("java") - JAVA_SOFT
JAVA_MORE = {"goto", "const", "import", "package"}
PRIMITIVES = {"int", "long", "short", "byte", "char", "boolean", "float", "double"}


def lex_java(text: str) -> Lexed:
    out = Lexed()
    kinds, at = out.kinds, out.at
    for m in JAVA_TOKEN.finditer(text):
        kind = m.lastgroup
        if kind == "end":
            break
        if kind == "ID":
            word = m["ID"]
            if word in PRIMITIVES:
                kind = "PRIM"
            elif word in JAVA_WORDS or word in JAVA_MORE:
                kind = word
            elif word in JAVA_SOFT and re.compile(r"\s+[A-Za-z_]" if word != "yield" else r"\s+[\w\"(]").match(text, m.end()):
                kind = word
        elif kind == "mark":
            kind = JAVA_KINDS[m["mark"]]
        elif kind == "word":
            kind = m["word"]
        elif kind == "bad" or kind == "STR" and JAVA_BROKEN.search(m["STR"]):
            kind = BAD
        kinds.append(kind)
        at.append(m.start(m.lastgroup))
    return out


JS_OPERATORS, JS_AUGMENTED = "+ - / % ** ^ << == != === !== <= >= && || ?? ~", "+= -= *= /= %= **= &= |= ^= <<= &&= ||= ??="
JS_REGEX = r"/(?![*/])(?:[^/\\\[\n\r]|\\[^\n\r]|\[(?:[^\]\\\n\r]|\\[^\n\r])*\])+/[A-Za-z]*"
JS_NUMBER = r"(?:0[xX][0-9a-fA-F_]+n?|0[bB][01_]+n?|0[oO][0-7_]+n?|(?:0|[1-9][\d_]*)n|(?:(?:0|[1-9][\d_]*)(?:\.[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?)(?![\w$])"
JS_ESCAPED = r"\\u(?:[0-9a-fA-F]{4}|\{[0-9a-fA-F]+\})"
# after these a slash divides
JS_VALUES = {"ID", "NUM", "STR", "REGEX", "TPL", "TAIL", "PRIV", ")", "]", "this", "super", "null", "true", "false", "++", "--"}
JS_SOFT_VALUES = {"of", "get", "set", "async", "from", "as", "type"}


class _Script:
    """The token patterns of one of the two script languages."""

    def __init__(self, language: str):
        marks, self.kinds = _marks(language, JS_OPERATORS, JS_AUGMENTED)
        self.words = _words(language)
        head = rf"{SKIP}(?:(?P<STR>{DOUBLE}|{SINGLE})|(?P<NUM>{JS_NUMBER})|(?P<ID>(?:[^\W\d]|\$|{JS_ESCAPED})(?:[\w$‌‍]|{JS_ESCAPED})*)|(?P<PRIV>\#[^\W\d][\w$]*)"
        piece = r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*"
        tail = rf"|(?P<TPL>`{piece}`)|(?P<HEAD>`{piece}\$\{{)|(?P<mark>{marks})|(?P<end>\Z)|(?P<bad>[\s\S]))"
        self.dividing = re.compile(head + tail)
        self.starting = re.compile(head + rf"|(?P<REGEX>{JS_REGEX})" + tail)
        self.resumed = re.compile(rf"(?P<TAIL>{piece}`)|(?P<MID>{piece}\$\{{)|(?P<bad>)")


SCRIPTS = {language: _Script(language) for language in ("javascript", "typescript")}
RESTRICTED = {"return", "break", "continue", "yield", "throw"}
CONDITIONS = {"if", "while", "for", "with"}


def lex_script(text: str, language: str) -> Lexed:
    """With the places where a missing ';' may be put, and those that a line end forces."""
    s, out = SCRIPTS[language], Lexed()
    kinds, at, breaks = out.kinds, out.at, set()
    out.breaks = breaks
    last, pos, braces, parentheses = "", 0, [], []
    if text.startswith("#!"):
        pos = (text + "\n").index("\n")
    while True:
        pattern = s.dividing if last in JS_VALUES or last in JS_SOFT_VALUES else s.starting
        m = pattern.match(text, pos)
        kind = m.lastgroup
        start, pos, condition = m.start(kind), m.end(), False
        newline = "\n" in m["skip"] or "\r" in m["skip"]
        if kind == "end":
            break
        if kind == "ID":
            word = m["ID"]
            kind = word if word in s.words else kind
        elif kind == "mark":
            kind = s.kinds[m["mark"]]
            if kind == "(":
                parentheses.append(last in CONDITIONS or last == "await" and kinds[-2:-1] == ["for"])
            elif kind == ")" and parentheses and parentheses.pop():
                condition = True
            if kind == "{":
                braces.append("{")
            elif kind == "}":
                if braces and braces.pop() == "${":
                    t = s.resumed.match(text, pos)
                    kind, pos = t.lastgroup, t.end()
                    if kind == "MID":
                        braces.append("${")
        elif kind == "HEAD":
            braces.append("${")
        if kind == "bad" or kind == "STR" and JS_BROKEN.search(m["STR"]):
            kind = BAD
        if newline and (last in RESTRICTED or kind in ("++", "--") and last in JS_VALUES) and kind not in (";", "}"):
            kinds.append(";")
            at.append(start)
        if newline or kind == "}":
            breaks.add(len(kinds))
        last = "condition" if condition else kind
        kinds.append(kind)
        at.append(start)
        if kind == BAD:
            break
    return out


def lex(text: str, language: str) -> Lexed:
    if language in SCRIPTS:
        return lex_script(text, language)
    return {"json": lex_json, "toml": lex_toml, "python": lex_python, "go": lex_go, "java": lex_java}[language](text)
