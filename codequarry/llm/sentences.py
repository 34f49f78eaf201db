"""Sentence boundaries across languages and scripts.

A text is read by a pushdown automaton. At the bottom of its stack lie the levels of the lists that are open, by
indent; above them the open quotations and brackets of the passage being read. Blank lines end passages,
headings close all lists, and an item opens a level or goes back to one. A terminator with no quotation or bracket
open ends a sentence unless the word before it is an abbreviation (looked up backwards in a trie) that the next word
doesn't contradict. All languages share one table, so a wrong or missing language tag doesn't matter. Reading
takes time that grows with the length of the text, however deep or unbalanced its marks are.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Abbreviations by what may follow them.
#: A sentence never ends here.
NEVER = """vs cf e.g i.e eg ie viz al approx ca est
vgl bzw ggf evtl z.b d.h u.a i.d.r sog bspw inkl exkl zzgl env c.-à-d p.ex aprox p.ej ee av dpto tel
см ср рис напр т.е т.к т.н ок им ул г-н г-жа проф акад डॉ श्री श्रीमती पं د أ ج""".split()
#: Titles: as NEVER, but only with a capital letter ("Ms." but "12 ms.").
TITLES = "dr mr mrs ms prof st hr fr frl hrn mme mlle mm sr sra srta dra dn д-р".split()
#: A sentence doesn't end here if a number follows.
NUMBER = """no nos nr num núm nº fig figs sec secs ch chap vol p pp pg pág págs art arts abb kap tab ziff abs s eq ref v
jan feb mar apr jun jul aug sep sept oct nov dec jän febr стр рис гл п табл разд""".split()
#: A sentence may end here: the next word tells.
MAYBE = """etc usw inc ltd co corp jr plc llc gmbh a.m p.m u.s u.k u.n e.u uu usf uvm bros dept г гг т.д т.п др пр""".split()
#: Months that follow the ordinal number of a day.
MONTHS = """januar jänner februar märz april mai juni juli august september oktober november dezember
january february march june july october december""".split()
#: Commands whose names stay lower case at the start of a sentence.
COMMANDS = "npm npx pip git docker kubectl cargo make yarn pnpm go curl apt brew helm terraform".split()

PAIRS = {"«": "»", "“": "”", "「": "」", "『": "』", "（": "）", "(": ")", "[": "]", "【": "】", "《": "》", "〈": "〉", "｢": "｣"}
BRACKETS = "（([【"
CLOSERS = {c: o for o, c in PAIRS.items()}
STOPS = ".!?…。！？｡．؟।॥۔。"
TRAILING = "\"'»”“’」』）)]】》〉｣*_`"
CONTINUES = ",;:，、；：،؛)]）】。.!?！？…"

LINE = re.compile(r"[^\r\n]*(?:\r\n|\r|\n|\Z)")
HEADING = re.compile(r"\s{0,3}#{1,6}\s+\S")
ITEM = re.compile(r"\s*(?:[-*+•‣◦▪·–]|\d{1,3}[.)]|\(\d{1,3}\)|[a-z]\))\s+\S")
EVENT = re.compile(rf"[{re.escape(STOPS)}]+|[\"«»„“”「」『』（）()\[\]【】《》〈〉｢｣]|(?<=[฀-๿])\s+(?=[฀-๿])")
LETTER, WORD_PART = re.compile(r"[^\W\d_]"), re.compile(r"[^\W\d_]|[̀-ͯऀ-ॿ.’-]")
CODELIKE = re.compile(r"[^\s,;!?]*(?:\w_\w|\w\(\)|\w/\w|\w\.[a-z]{1,4}(?![a-z.])|[a-z][A-Z]\w*\()")
CJK = re.compile(r"[⺀-鿿가-퟿豈-﫿＀-￯]")
PARTICLE = re.compile(r"[とっがをはのにでもやよねかへ가-퟿]")
NUMERAL, LETTERS, DAY = re.compile(r"\d"), re.compile(r"[^\W\d_]+"), re.compile(r"(?<![\d.,])\d{1,2}\Z")


def _trie() -> dict:
    """Abbreviations, last letter first; the value at '' is their kind."""
    root: dict = {}
    for kind, words in (("never", NEVER), ("title", TITLES), ("number", NUMBER), ("maybe", MAYBE)):
        for w in words:
            node = root
            for c in reversed(w):
                node = node.setdefault(c, {})
            node.setdefault("", kind)
    return root


TRIE = _trie()


def abbreviation(word: str) -> str:
    """The kind of an abbreviation (without its last point), or ''."""
    node = TRIE
    for c in reversed(word.lower()):
        node = node.get(c)
        if node is None:
            return ""
    return node.get("", "")


def _shouts(word: str) -> bool:
    return sum(c.isalpha() for c in word) > 1 and word.isupper()


def starts_sentence(s: str, i: int, shouted: bool = False) -> bool:
    """Whether what stands at ``i`` (no white space) looks like the start of a sentence.

    After a word in capitals a further one in capitals proves nothing.
    """
    while i < len(s) and s[i] in "\"'(«„“「『（[*_¿¡":
        i += 1
    if i >= len(s):
        return True
    c = s[i]
    if c.islower():
        m = re.compile(r"[\w-]+").match(s, i)
        return bool(CODELIKE.match(s, i)) or (m is not None and m.group() in COMMANDS)
    if c.isupper():
        if not shouted:
            return True
        word = re.compile(r"[^\W\d_]+").match(s, i).group()
        return not _shouts(word) and len(word) > 1
    return c not in "-–—,;:)"


def _pairs(s: str, events: list[re.Match]) -> dict[int, int]:
    """Position of each opening mark that has a partner -> position of the partner."""
    stack: list[tuple[str, int]] = []
    open_marks: Counter = Counter()
    found: dict[int, int] = {}

    def opened(mark: str, at: int) -> None:
        stack.append((mark, at))
        open_marks[mark] += 1

    def close(kinds: str, at: int) -> bool:
        if not any(open_marks[k] for k in kinds):
            return False
        while True:  # what was opened since has no partner
            mark, where = stack.pop()
            open_marks[mark] -= 1
            if mark in kinds:
                found[where] = at
                return True

    for m in events:
        c, at = m.group(), m.start()
        if c == '"':
            follows = s[at + 1 : at + 2]
            if open_marks['"'] and (at and not s[at - 1].isspace() or not follows or follows.isspace()):
                close('"', at)
            elif follows and not follows.isspace():
                opened('"', at)
        elif c == "„":
            opened(c, at)
        elif c == "“":
            if not close("„", at):
                opened(c, at)
        elif c == "”":
            close("“„", at)
        elif c in PAIRS:
            opened(c, at)
        elif c in CLOSERS:
            close(CLOSERS[c], at)
    return found


def _word_before(s: str, i: int, begun: int) -> int:
    """Where the word that ends at ``i`` starts, not before ``begun``; ``i`` if there is none."""
    k = i
    while k > begun and WORD_PART.match(s[k - 1]):
        k -= 1
    while k < i and not LETTER.match(s[k]):
        k += 1
    return k


def _before(s: str, i: int, begun: int) -> int:
    """The place of the last character before ``i`` that is no white space, or one less than ``begun``."""
    while i > begun and s[i - 1].isspace():
        i -= 1
    return i - 1


def _after_stop(s: str, m: re.Match, begun: int) -> int:
    """End of the sentence that the terminator ``m`` closes, or 0 if it closes none."""
    run, i, end = m.group(), m.start(), m.end()
    while end < len(s) and s[end] in TRAILING and not (s[end] in "\"“'" and end + 1 < len(s) and not s[end + 1].isspace()):
        end += 1
    if end >= len(s):
        return len(s)
    spaced = s[end].isspace()
    at = end
    while at < len(s) and s[at].isspace():
        at += 1
    if at >= len(s):
        return end
    last = s[i - 1] if i > begun else ""
    ellipsis = "…" in run or (len(run) > 1 and set(run) == {"."})
    if any(c in "。！？｡।॥" for c in run) or (ellipsis and not spaced):
        if not spaced and ellipsis and not (last and CJK.match(last)):
            return 0
        return 0 if s[at] in CONTINUES else end
    if not spaced:
        cjk = last and CJK.match(last) and CJK.match(s[end]) and run[-1] in "!?"
        return end if cjk else 0
    begin = _word_before(s, i, begun)
    token = s[begin:i]
    if ellipsis:
        return end if starts_sentence(s, at, _shouts(token)) else 0
    if run != "." and run != "．":
        return 0 if s[at] in ",;" else end
    if last.isdigit() and NUMERAL.match(last):
        month = LETTERS.match(s, at)
        if month and month.group().lower() in MONTHS and DAY.search(s[max(begun, i - 3) : i]):
            return 0
        return end if starts_sentence(s, at) else 0
    if not token:
        return end
    k = _before(s, begin, begun)
    number_before = k >= begun and NUMERAL.match(s[k]) is not None
    # "z. B", "p. ex", "т. д": the single letter with a point before the word
    single = k > begun and s[k] == "." and s[k - 1].isalnum() and (k - 1 == begun or not (s[k - 2].isalnum() or s[k - 2] == "_"))
    pair = f"{s[k - 1]}.{token}" if single else ""
    kind = abbreviation(token) or abbreviation(re.split("['’]", token)[-1])
    if not kind and "." not in token:
        kind = abbreviation(pair) if pair else kind
    elif len(token) == 1:
        kind = (abbreviation(pair) if pair else "") or kind
    if len(token) == 1 and number_before:
        kind = "maybe"  # a unit after a number: "48.7 s."
    elif not kind and len(token) == 1:
        # initials, and the first of two single letters; a lone small letter ends a sentence if a new one starts
        kind = "never" if not token.islower() or re.compile(r"\w{1,3}\.").match(s, at) else "maybe"
    if kind == "title" and number_before:
        kind = "maybe"
    if kind == "title":
        kind = "never" if token[0].isupper() or not token[0].islower() else ""
    if kind == "never":
        return 0
    if kind == "number":
        return 0 if s[at].isdigit() or len(token) == 1 else end
    if kind == "maybe":
        return end if starts_sentence(s, at, _shouts(token.replace(".", ""))) else 0
    return end


def _after_close(s: str, opened: int, closed: int, begun: int) -> int:
    """End of the sentence if it ends with the mark at ``closed``, whose partner is at ``opened``; else 0."""
    k = closed - 1
    while k > opened and (s[k].isspace() or s[k] in TRAILING):
        k -= 1
    if k <= opened or s[k] not in STOPS:
        return 0
    if s[opened] in BRACKETS and s[begun:opened].strip():
        return 0
    end = closed + 1
    while end < len(s) and s[end] in TRAILING and s[end] not in "\"“":
        end += 1
    if end >= len(s):
        return len(s)
    if not s[end].isspace():
        if s[end] in CONTINUES or s[closed] not in "」』”）】》":
            return 0
        return end if s[closed] in "）】》" or not PARTICLE.match(s[end]) else 0
    at = end
    while at < len(s) and s[at].isspace():
        at += 1
    if at >= len(s):
        return end
    if s[at] in ",;:–—-，":
        return 0
    if s[k] in "。！？｡।॥":
        return end
    word = re.search(r"\w+\W*\Z", s[opened + 1 : k])
    return end if starts_sentence(s, at, bool(word) and _shouts(word.group().strip(STOPS + " "))) else 0


def _block(s: str) -> Iterator[tuple[int, int]]:
    """The sentences of one block without blank lines, headings and items."""
    events = list(EVENT.finditer(s))
    pairs = _pairs(s, events)
    begun, stack = 0, []
    for m in events:
        at = m.start()
        if at < begun:
            continue
        if at in pairs:
            stack.append(at)
            continue
        end = 0
        if stack and at == pairs[stack[-1]]:
            opened = stack.pop()
            while stack and pairs[stack[-1]] < at:
                stack.pop()
            if not stack:
                end = _after_close(s, opened, at, begun)
        elif not stack:
            if m.group()[0].isspace():
                end = at
            elif m.group()[0] in STOPS:
                end = _after_stop(s, m, begun)
        if end:
            yield begun, end
            begun, stack = end, []
    yield begun, len(s)


def _blocks(text: str) -> Iterator[tuple[int, int, bool]]:
    """Start, end and whether it is a unit by itself, of headings, items and paragraphs.

    ``levels`` are the indents of the open lists' items, the deepest last. A line with a mark is an item where a
    passage begins or in an open list; elsewhere only behind something complete, as numbers and dashes also start
    lines that merely go on.
    """
    start, end, fresh = 0, 0, True
    levels: list[int] = []
    for m in LINE.finditer(text):
        line = m.group()
        if not line:
            break
        a, b = m.span()
        if not line.strip():
            if end > start:
                yield start, end, bool(levels)
            start = end = b
            levels.clear()
            fresh = True
            continue
        heading = bool(HEADING.match(line))
        item = not heading and bool(ITEM.match(line))
        if item and not (fresh or levels):
            k = _before(text, end, start)
            item = text[k] == ":" or text[k] in STOPS and _complete(text, start, k, line)
        if heading or item:
            if end > start:
                yield start, end, bool(levels)
            start, end, fresh = a, b, False
            if heading:
                yield start, end, True
                start, fresh = b, True
                levels.clear()
            else:
                indent = len(line) - len(line.lstrip())
                while levels and levels[-1] >= indent:
                    levels.pop()
                levels.append(indent)
        else:
            end, fresh = b, False
    if end > start:
        yield start, end, bool(levels)


def _complete(text: str, start: int, k: int, line: str) -> bool:
    """Whether the terminator at ``k``, in a passage from ``start`` on, ends a sentence before ``line``."""
    begin = max(text.rfind("\n", start, k), text.rfind("\r", start, k), start - 1) + 1
    joined = text[begin : k + 1] + " " + line.lstrip()
    stop = EVENT.match(joined, k - begin)
    return stop is not None and _after_stop(joined, stop, 0) > 0


def sentence_spans(text: str | None) -> list[tuple[int, int]]:
    """Start and end of every sentence, in code points; none for null, empty and blank texts."""
    spans: list[tuple[int, int]] = []
    for a, b, unit in _blocks(text or ""):
        part = text[a:b]
        for x, y in [(0, len(part))] if unit else _block(part):
            piece = part[x:y]
            left = len(piece) - len(piece.lstrip())
            right = len(piece.rstrip())
            if right > left:
                spans.append((a + x + left, a + x + right))
    return spans


def sentences(documents: DataFrame, key: str, text: str) -> DataFrame:
    """``key, start_char, end_char`` of every sentence of every text.

    Null, empty and blank texts have no rows, null keys stay. Repeated rows give their sentences once. Texts
    are read whole, one at a time; nothing is shuffled but what removes repeated rows.
    """

    @F.pandas_udf("array<struct<start_char:int,end_char:int>>")
    def spans(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"start_char": a, "end_char": b} for a, b in sentence_spans(t)])

    return (
        documents.select(F.col(key), F.col(text).alias("_t"))
        .where(F.col("_t").isNotNull())
        .select(key, F.explode(spans("_t")).alias("s"))
        .select(key, "s.start_char", "s.end_char")
        .distinct()
    )
