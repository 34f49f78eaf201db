"""Credentials embedded in source code, and their redaction.

Unnatural strings are told by their characters per subword under a public tokenizer's vocabulary, which is low
for random strings and high for words. First all runs of a text are measured so. Then context says how natural a
string may read and still be a credential: a known token form, a header or a path needs an unnatural run;
the place of a login or command allows a word with digits; the literal of a name that speaks of a password or
key allows anything but plain long words, messages and placeholders. What is found is blanked out in place.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import cache, lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codequarry.llm.encode import VOCABULARIES, VOCABULARY

#: Characters per subword below which a string counts, by what stands around it: nothing but a form, a header or a vague
#: name; the same for letters with digits; the place of a password, or the literal of an explicit name.
UNNATURAL, MIXED, PLACED = 2.6, 4.0, 9.0
#: Values from this length on count.
SHORTEST = 4

# Token forms, words of secrets, of labels and of placeholders.
FORMS = (
    r"(?:AKIA|ASIA)[A-Z0-9]{16}|gh[opsur]_[A-Za-z0-9]{30,}|github_pat_[A-Za-z0-9_]{40,}|glpat-[A-Za-z0-9_-]{20,}|(?:sk|rk|pk)_(?:live|test)_[A-Za-z0-9]{16,}"
    r"|sk-(?:proj-|ant-)?[A-Za-z0-9_-]{32,}|npm_[A-Za-z0-9]{30,}|pypi-[A-Za-z0-9_-]{40,}|xox[abeoprs]-[A-Za-z0-9-]{16,}|AIza[A-Za-z0-9_-]{35}|ya29\.[A-Za-z0-9_-]{30,}"
    r"|eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}|SG\.[A-Za-z0-9_-]{16,}+\.[A-Za-z0-9_-]{16,}|hf_[A-Za-z0-9]{30,}|dop_v1_[a-f0-9]{40,}"
)
SECRET = (
    r"pass(?:word|wd|phrase|code)?|passwort|kennwort|contrase(?:na|ña)|mot[_-]?de[_-]?passe|senha|pwd|pw|secret(?:[_-]?access)?|token|credentials?|api[_-]?key"
    r"|(?:access|private|secret|signing|encryption|master|hmac|auth|service|account|shared|webhook)[_-]?key|auth"
)
LABELS = (
    r"ref|refs|pattern|regex|label|help|hint|field|name|header|url|uri|command|cmd|placeholder|prompt|title|text|message|msg|description|desc|id|type|length|len|min|max|count|size|ttl"
    r"|path|file|filename|dir|env|var|param|expiry|expires|policy|rule|rules|error|format|input|form|column|scope|issuer|endpoint|provider|method|class|count|limit|index"
)
_STUB = r"example|sample|dummy|placeholder|change[_-]?me|todo|fixme|redacted|not[_-]?a[_-]?real|fake|foobar|lorem"
#: Whole values that stand for a credential: marks, types, stub words with other words, and 'your ...', 'my ...' of a secret.
PLACEHOLDER = re.compile(
    rf"""(?:<[^>]*> | %[A-Z_]+% | \$[A-Za-z_]\w* | \{{\w*\}} | (?:[a-z]+[_-])*[*•.xX_\-]+ | (?:none|null|nil|true|false|undefined|empty)
    | (?:password|passwd|secret|token|test|testing|user_password|string|value|key|str|number|boolean|required|optional|invalid|missing|hidden|masked|default|include|omit|same-origin|basic|bearer)
    | (?:change|replace|fill|set)[_-]?(?:me|this|it)[\W_a-z]*\d{{0,4}}[\W_]*
    | (?:your|insert|enter|put|replace|add|fill|paste|provide|type|choose)(?:[\ _-]+[a-z]+)+[\W_]*
    | (?:your|my|our|the|an?|some|insert|enter|put|replace|change|add|set|fill|use|paste|provide|type|choose)(?:[\ _-]+(?:[a-z]+|\d{{1,4}}))*?[\ _-]+(?:{SECRET}|key|value|string|here|env|vault)(?:[\ _-]+(?:[a-z]+|\d{{1,4}}))*[\W_]*
    | (?:[a-z]*[\W_])*(?:{_STUB})(?:[\W_][a-z]*)*\d{{0,4}}
    | (?-i:[A-Za-z0-9/+_-]*EXAMPLE(?:KEY|TOKEN)?))\Z
    | \$\{{ | \$\( | \{{\{{ | %\(""",
    re.I | re.X,
)
#: A value of nothing but these, a stub word among them, is a placeholder too.
STUB, STUB_WORDS = re.compile(_STUB, re.I), re.compile(rf"{_STUB}|{SECRET}|key|value|string|user|for|my|your|only|here|test|[\W_]+|(?<!\d)\d{{1,4}}(?!\d)", re.I)
#: Values of several words that speak about a secret: prompts and messages.
MESSAGE = re.compile(rf".*(?<![a-z])(?:{SECRET}|must|should|cannot|can't|please|required|invalid|incorrect|missing|your|is|are|was|has|have|enter|forgot|show|confirm)(?![a-z])", re.I | re.S)
#: Names that also stand for other things than a literal secret: only values that don't read like language count there.
VAGUE = re.compile(r"(?:token|auth|credentials?|pass|pw)\Z", re.I)
#: What may follow a secret's name: environment, age, order, encoding.
SUFFIX = re.compile(r"(?:[_\-]?(?:prod(?:uction)?|staging|stage|dev(?:elopment)?|test|qa|uat|live|local|old|new|prev(?:ious)?|current|primary|secondary|backup|base64|b64|hex|raw|plain|v?\d{1,3}))+\Z", re.I)
ACCESS_ID = re.compile(r"access[_\-]?key[_\-]?id\Z", re.I)
#: Files whose values need no quotes.
SETTINGS = re.compile(r"(?:\.(?:env|ini|cfg|conf|properties|ya?ml|npmrc|pypirc)|(?:^|[\\/])\.env(?:\.[\w-]+)?)\Z", re.I)
REFERENCE = re.compile(
    r"(?:os|process|System|config|settings|env|vault|secrets?|var|local|data|self|this|request|req|params|args|ctx|module|each|inputs)\.[\w.\[\]\"'()]+|[A-Za-z_][\w.:]*\(.*|[\w.]+\[[^\]]*\].*|op://\S+|vault:\S+|arn:\S+"
)

QUOTED = r"(?:\"(?P<{0}d>[^\"\n]*+)\"|'(?P<{0}s>[^'\n]*+)'|`(?P<{0}b>[^`\n]*+)`)"

# Every rule below reads a text in time that grows with its length: names are whole runs, taken once.
RUN = re.compile(r"[\w.\-/$]+(?::+[\w.\-/$]+)*+")
VALUE_RUN = re.compile(r"[\w+/=.~!@#$%^&*?-]{4,}+")
SECRET_WORD = re.compile(SECRET, re.I)
TYPED = re.compile(r":(?:str|string|String|any|char)\Z")

BLOCK = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----(?:(?!-----BEGIN )[\s\S])*?-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
FORM = re.compile(rf"(?<![A-Za-z0-9+/=])(?:{FORMS})")
LOGIN_URL = re.compile(r"(?<=[A-Za-z0-9+.\-])://[^\s:/@\"'`<>{}$]*+:(?P<v>[^\s@/\"'`<>]++)@")
SCHEME = re.compile(r"\b(?:Basic|basic)\s+(?P<v>[A-Za-z0-9+/]{8,}={0,2})(?![A-Za-z0-9+/=])|\b(?:Bearer|bearer|token)\s+(?P<w>[A-Za-z0-9._~+/-]{12,}=*)")
OPTION = re.compile(rf"\s--?(?:[\w-]*[_-])?(?:{SECRET})(?:\s+|=)[\"']?(?P<v>[^\s\"',)]+)", re.I)
#: Commands, and the option that brings the password somewhere behind on the line.
COMMANDS = (
    (re.compile(r"\bcurl\b", re.I), re.compile(r"\s(?:-u|--user)\s*[\"']?[^\s:\"']++:(?P<v>[^\s\"']+)", re.I)),
    (re.compile(r"\blogin\b", re.I), re.compile(r"\s-p\s*[\"']?(?P<v>[^\s\"']+)", re.I)),
)
PAIR = re.compile(rf"auth\s*=\s*\(\s*(?:\"[^\"\n]*\"|'[^'\n]*')\s*,\s*{QUOTED.format('p')}|getConnection\(\s*\"[^\"\n]*\"\s*,\s*\"[^\"\n]*\"\s*,\s*{QUOTED.format('q')}", re.I)
ASSIGNED = re.compile(
    # behind a name: an optional type, an operator, perhaps what it falls back from, and a literal
    rf"[\"'`]?\]?\s*(?P<op>:\s*(?:str|string|String|any|char\[\])\s*=|\[\]\s*=|:=|===?|!==?|=>|[:=,])\s*(?:(?:[\w.\[\]\"']+)\s*(?:\|\||\?\?|or)\s*)?(?:[a-zA-Z]{{1,2}}(?=[\"']))?{QUOTED.format('a')}",
    re.I,
)
SETTER = re.compile(rf"\bset(?P<name>\w*?(?:{SECRET}))\(\s*{QUOTED.format('e')}", re.I)
ATTRIBUTE = re.compile(rf"\b(?:name|key|id)\s*[=:]\s*[\"']?(?P<name>[\w.\-]++)[\"']?\s*(?:[,\n]\s*)?\s*\bvalue\s*[=:]\s*(?:{QUOTED.format('v')}|(?P<vu>[^\s\"'<>]+))", re.I)
DEFAULT = re.compile(rf"(?<![\w-])--(?P<name>[\w-]++)[\"']\s*,\s*default\s*=\s*{QUOTED.format('f')}", re.I)
#: A line of settings: what may stand before the name, the name with all that could belong to it, and what follows.
LEAD = re.compile(r"[ \t]*(?:(?:\#|//|;|/\*|<!--|\*|--)\s*)?(?:-\s+)?(?:(?:export|set|ENV|ARG)[ \t]+)?", re.I)
NAMES = re.compile(r"[\w.\-/:]++")
PLAIN = re.compile(r"[ \t]*(?P<op>[=:])[ \t]*(?P<v>[^\s\"'`<{\[(|>][^\n\r]*?)[ \t]*(?:\*/|-->)?[ \t]*\r?$", re.M)
IN_PATH = re.compile(rf"(?P<name>(?:{SECRET}|key))=(?P<v>[A-Za-z0-9_.~+-]+?)(?=-page\d|\.[A-Za-z]\w*$|[&/\\]|$)", re.I)
NETRC = re.compile(r"\bpassword[ \t]+(?P<v>\S+)")
PGPASS = re.compile(r"^(?!\#)[^\s:]+:[^\s:]*:[^\s:]*:[^\s:]+:(?P<v>[^\s]+)[ \t]*\r?$", re.M)

#: What a text must contain to be looked at, in Java's regex dialect, for use before Python is entered: every rule above
#: needs a part of it, whatever the rule's path; letters match as in Python (``u``: also ``Ñ`` and the long s).
TRIGGER = rf"(?iu){SECRET}|key|://[^\s/@]*:|basic|bearer|curl|login|getConnection|-----BEGIN |{FORMS}"
#: But for this one, whose lines have no words: the ends of the paths it holds for.
WORDLESS = "pgpass"


@cache
def _encoding():
    import tiktoken

    from codequarry.llm.encode import vocabulary

    ranks = {token.encode("latin-1"): rank for token, rank in vocabulary(VOCABULARY, VOCABULARIES).items()}
    pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@lru_cache(1 << 16)
def _measured(value: str) -> float:
    return len(value) / max(1, len(_encoding().encode_ordinary(value)))


def characters_per_subword(value: str) -> float:
    """Length over subwords; short values, which come again and again, are remembered."""
    return _measured(value) if len(value) <= 64 else len(value) / max(1, len(_encoding().encode_ordinary(value)))


def unnatural_runs(text: str) -> tuple[list[int], list[int]]:
    """Starts and ends of all runs of a text that read like no language."""
    starts, ends = [], []
    for m in VALUE_RUN.finditer(text):
        if characters_per_subword(m.group()) < UNNATURAL:
            starts.append(m.start())
            ends.append(m.end())
    return starts, ends


def _labelled(name: str) -> bool:
    """Whether a name is about a secret but holds something else: ``token_header``, ``passwordLabel``."""
    last = re.split(r"[_.\-/:]|(?<=[a-z0-9])(?=[A-Z])", name.strip("\"'"))[-1]
    if ACCESS_ID.search(name.strip("\"'")):
        return False
    return bool(re.fullmatch(LABELS, last, re.I))


SECRET_PART = re.compile(rf"(?:{SECRET})\Z", re.I)


def _words(name: str) -> str:
    """The last part of a dotted name, its words set apart, without what may follow a secret's name."""
    return SUFFIX.sub("", re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", re.split(r"[./:]", name.strip("\"'"))[-1]))


def _explicit(name: str) -> bool:
    """Whether a literal given to the name is a secret whatever it reads like."""
    return not VAGUE.search(_words(name))


def _secret_name(name: str) -> bool:
    """Whether a name is one of a secret: its last words are such, not merely letters inside another word."""
    words = _words(name)
    m = ACCESS_ID.search(words) or SECRET_PART.search(words) or SECRET_PART.search(words.replace("_", ""))
    if not m or _labelled(name):
        return False
    short = m.group().lower() in ("pw", "pwd", "pass", "auth")
    return not short or m.start() == 0 or not words[m.start() - 1].isalpha() or "_" not in words and words.isupper()


def _placeholder(value: str) -> bool:
    v = value.strip()
    return len(v) < SHORTEST or bool(PLACEHOLDER.match(v)) or len(set(v.lower())) < 4 or bool(STUB.search(v)) and not STUB_WORDS.sub("", v)


def _counts(value: str, quoted: bool, explicit: bool = False) -> bool:
    """Whether a value in the place of a secret reads unnaturally enough for it; ``explicit``: whose name leaves no doubt."""
    if _placeholder(value) or not quoted and REFERENCE.fullmatch(value):
        return False
    words, measure = value.split(), characters_per_subword(value)
    if explicit:
        return measure < PLACED and (len(words) == 1 or not MESSAGE.match(value))
    digits = any(c.isdigit() for c in value)
    if len(words) > 1:  # a passphrase with a number at its end
        return measure < PLACED and len(words) <= 6 and words[-1][-1:].isdigit() and (not value[0].isupper() or words[-1].isdigit())
    if digits and any(c.isalpha() for c in value):
        return measure < MIXED
    return measure < UNNATURAL and (digits or len(value) >= 8)


def _group(m: re.Match, prefix: str) -> tuple[str, int, int] | None:
    for suffix in "dsb":
        if m[prefix + suffix] is not None:
            return m[prefix + suffix], m.start(prefix + suffix), m.end(prefix + suffix)
    return None


class _Places:
    """Spans that are taken or refused, so that a place is judged by the first rule that reaches it."""

    def __init__(self):
        self.starts: list[int] = []
        self.ends: list[int] = []

    def free(self, a: int, b: int) -> bool:
        i = bisect_left(self.starts, b)
        return i == 0 or self.ends[i - 1] <= a

    def take(self, a: int, b: int) -> None:
        i = bisect_left(self.starts, a)
        self.starts.insert(i, a)
        self.ends.insert(i, b)


def _lines_with(pattern: re.Pattern, text: str) -> Iterator[tuple[int, int, int]]:
    """Start and end of every line that the pattern finds something in, and where the first find ends."""
    pos = 0
    while m := pattern.search(text, pos):
        a, b = text.rfind("\n", 0, m.start()) + 1, text.find("\n", m.end())
        b = len(text) if b < 0 else b
        yield a, b, m.end()
        pos = b + 1


def _settings(text: str, a: int, b: int) -> tuple[str, str, str, int] | None:
    """Lead, name, operator and start of the value of a line ``name = value`` or ``name: value``, quotes aside."""
    lead = LEAD.match(text, a, b)
    names = NAMES.match(text, lead.end(), b)
    if not names:
        return None
    name, end = names.group(), names.end()
    if name.endswith(":") and text[end : end + 1] in " \t":
        name, end = name[:-1], end - 1
    elif text[end : end + 1] == "=" and ":" in name and _secret_name(name[: name.index(":")]):
        name, end = name[: name.index(":")], names.start() + name.index(":")  # ``key:value=``
    m = PLAIN.match(text, end, min(len(text), b + 1))
    return (lead.group(), name, m["op"], m.start("v")) if m and not (m["op"] == ":" and text[m.end("op") : m.end("op") + 1] not in " \t" and "=" not in m["v"]) else None


def credential_spans(text: str, path: str = "", is_path: bool = False) -> list[tuple[int, int]]:
    """Start and end of every credential in one text, in code points, without overlaps; ``path`` names its file."""
    starts, ends = unnatural_runs(text)
    places = _Places()

    def unnatural(a: int, b: int) -> bool:
        """Whether an unnatural run lies in the span or reaches into it."""
        i = bisect_left(starts, b)
        return i > 0 and ends[i - 1] > a

    def add(a: int, b: int, good: bool) -> None:
        if good and a < b and places.free(a, b):
            places.take(a, b)

    for m in BLOCK.finditer(text):
        add(m.start(), m.end(), m.end() - m.start() > 100 and unnatural(*m.span()))
    for m in FORM.finditer(text):
        body = re.sub(r"^(?:[a-z]+_live_|[a-z]+_test_|[a-z_]{2,11}[_-]|AKIA|ASIA|AIza)", "", m.group())
        add(m.start(), m.end(), len(set(body.lower())) > 5 and not _placeholder(m.group()) and unnatural(*m.span()))
    if is_path:
        for m in IN_PATH.finditer(text):
            add(*m.span("v"), len(m["v"]) >= 8 and not _placeholder(m["v"]) and unnatural(*m.span("v")))
        return list(zip(places.starts, places.ends))
    for m in LOGIN_URL.finditer(text):
        add(*m.span("v"), _counts(m["v"], True, True))
    for m in SCHEME.finditer(text):
        kind = "v" if m["v"] else "w"
        add(*m.span(kind), not _placeholder(m[kind]) and unnatural(*m.span(kind)) and any(c.isdigit() or c.isupper() for c in m[kind]))
    for m in PAIR.finditer(text):
        value, a, b = _group(m, "p") or _group(m, "q")
        add(a, b, _counts(value, True, True))
    for command, option in COMMANDS:
        for _, line_end, begin in _lines_with(command, text):
            for m in option.finditer(text, begin, line_end):
                add(*m.span("v"), _counts(m["v"], False))
    for m in OPTION.finditer(text):
        add(*m.span("v"), _counts(m["v"], False))
    for pattern, key in ((DEFAULT, "f"), (ATTRIBUTE, "v"), (SETTER, "e")):
        for m in pattern.finditer(text):
            if _secret_name(m["name"]):
                value, a, b = _group(m, key) or (m["vu"], *m.span("vu"))
                add(a, b, _counts(value, True, _explicit(m["name"])))
    read = 0  # what is the value of one name is no name itself
    for line, line_end, _ in _lines_with(SECRET_WORD, text):
        for run in RUN.finditer(text, line, line_end):
            if run.start() < read or not SECRET_WORD.search(run.group()) or not (m := ASSIGNED.match(text, run.end())):
                continue
            name, read = TYPED.sub("", run.group()), m.end()
            if _secret_name(name):
                value, a, b = _group(m, "a")
                add(a, b, _counts(value, True, m["op"] != "," and _explicit(name)))  # a comma: perhaps one name after another
        plain = _settings(text, line, line_end)
        if plain and _secret_name(plain[1]):
            lead, name, op, at = plain
            value = text[at:line_end].rstrip()
            for end in ("*/", "-->"):
                value = value.removesuffix(end).rstrip()
            spaced, commented = " " in value, bool(lead.strip())
            if not (value.endswith((";", ",", "{", "(")) or spaced and not (commented or op == "=")):
                add(at, at + len(value), _counts(value, False, bool(SETTINGS.search(path)) and _explicit(name)))
    base = re.split(r"[\\/]", path.lower())[-1]
    for rule in [NETRC] * base.endswith("netrc") + [PGPASS] * base.endswith(WORDLESS):
        for m in rule.finditer(text):
            add(*m.span("v"), _counts(m["v"], True, True))
    return list(zip(places.starts, places.ends))


SPANS = "array<struct<start_char:int,end_char:int>>"


def _of_interest(text: Column, path: Column) -> Column:
    """Whether any rule could find something; false only where none can."""
    return text.rlike(TRIGGER) | F.lower(F.coalesce(path, F.lit(""))).endswith(WORDLESS)


def _finder(is_path: bool):
    @F.pandas_udf(SPANS)
    def spans(texts: pd.Series, paths: pd.Series) -> pd.Series:
        rows = [[{"start_char": a, "end_char": b} for a, b in credential_spans(t, p or "", is_path)] for t, p in zip(texts, paths)]
        return pd.Series(rows, dtype=object)

    return spans


def find_credentials(rows: DataFrame, table_name: str, column: str, row_id: str, path: Column | None = None) -> DataFrame:
    """``table_name, column_name, row_id, start_char, end_char`` of every credential in one text column.

    With ``path`` None the column is itself a path. Null texts and ids have no rows; repeated rows give their
    spans once. Texts in which no rule could find anything never leave the JVM; all others are read whole.
    """
    is_path = path is None
    texts = rows.select(F.col(row_id).cast("string").alias("row_id"), F.col(column).alias("_t"), (F.lit("") if is_path else path).alias("_p"))
    return (
        texts.where(F.col("row_id").isNotNull() & _of_interest(F.col("_t"), F.col("_p")))
        .select("row_id", F.explode(_finder(is_path)("_t", "_p")).alias("s"))
        .select(F.lit(table_name).alias("table_name"), F.lit(column).alias("column_name"), "row_id", "s.start_char", "s.end_char")
        .distinct()
    )


def redact(text: Column, spans: Column, mark: str = "*") -> Column:
    """``text`` with the characters of each span replaced by ``mark``, line ends kept: all offsets and lines stay.

    ``spans`` is an array of structs ``start_char, end_char`` in order and without overlaps, as found in ``text``;
    null or empty spans leave the text as it is.
    """
    starts = F.concat(F.array(F.lit(0)), F.transform(spans, lambda s: s["end_char"]))
    ends = F.concat(F.transform(spans, lambda s: s["start_char"]), F.array(F.length(text)))
    kept = F.transform(F.arrays_zip(starts.alias("a"), ends.alias("b")), lambda x: F.substring(text, x["a"] + 1, x["b"] - x["a"]))
    hidden = F.transform(spans, lambda s: F.regexp_replace(F.substring(text, s["start_char"] + 1, s["end_char"] - s["start_char"]), r"[^\r\n]", mark))
    joined = F.array_join(F.transform(F.arrays_zip(kept.alias("k"), F.concat(hidden, F.array(F.lit(""))).alias("h")), lambda x: F.concat(x["k"], x["h"])), "")
    return F.when(F.size(F.coalesce(spans, F.array().cast(SPANS))) > 0, joined).otherwise(text)


def redacted(rows: DataFrame, column: str, row_id: str, path: Column | None = None) -> DataFrame:
    """``rows`` with ``column`` redacted; every row stays, repeated ones too, and null texts stay null.

    Rows in which no rule could find anything are set apart first, so that their texts never leave the JVM.
    """
    is_path, path = path is None, F.lit("") if path is None else path
    finder = _finder(is_path)
    marked = rows.withColumn("_credential_path", path)
    interest = F.coalesce(_of_interest(F.col(column), F.col("_credential_path")), F.lit(False))
    found = marked.where(interest).withColumn("_credential_spans", finder(column, "_credential_path"))
    plain = marked.where(~interest).select(rows.columns)
    return found.withColumn(column, redact(F.col(column), F.col("_credential_spans"))).select(rows.columns).unionByName(plain)
