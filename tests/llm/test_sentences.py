import pytest
from codequarry.llm.sentences import sentence_spans, sentences

CASES = [
    ["It failed at 4 p.m. on Monday.", "Dr. Who, e.g. the one in no. 7, left.", "npm install works!", "Really?!", "We kept keys, etc.", "The end"],
    ["Wait... the job still runs.", "Nothing here…", "See https://x.example/a?b=1 for more."],
    ['She asked "Is it safe?" and left.', 'He wrote: "Stop. It is live."', "(This was agreed.)", "Done (see Fig. 3)."],
    ["Am 22. Januar kam v2.0, d. h. später.", "„Gut?“, fragte er.", "Er schrieb: „Nein. Nie.“", "Das dauerte 3,5 s.", "Tokens usw."],
    ["M. Dupont a écrit : « Attendez. C’est actif. »", "Il reste env. 12 cas, p. ex. dans a.py.", "Voir l’art. 7 !"],
    ["¿Y la versión 1.2?", "El Sr. Paz cerró el aviso núm. 3.", "El servidor de EE. UU. va lento."],
    ["А. Н. Сторовец ушёл.", "Ключи и т. д. скрыты, т. е. чаще обычного.", "В 2024 г. файлов было меньше."],
    ["راجع د. عودوال التقرير.", "هل تم؟"],
    ["डॉ. ओदुवाल ने कहा, “रुकिए। अभी नहीं।”", "क्या यह ठीक है?"],
]


@pytest.mark.parametrize("parts", CASES)
@pytest.mark.parametrize("gap", [" ", "  ", "\n", "\r\n", "\u00a0"])
def test_spaced_scripts(parts, gap):
    text = gap.join(parts)
    assert [text[a:b] for a, b in sentence_spans(text)] == parts


@pytest.mark.parametrize(
    "parts",
    [
        ["审查员写道：“先别合并。令牌还有效。”", "他问：“好了吗？”，然后走了。", "（详见第0节。）", "真的吗？！", "已隐藏……", "merge仍然失败！"],
        ["「直りましたか？」と聞かれた。", "重複は約5.5件でした。", "（第9節を参照。）", "まだです！"],
    ],
)
def test_scripts_without_blanks(parts):
    text = "".join(parts)
    assert [text[a:b] for a, b in sentence_spans(text)] == parts


def test_korean_and_thai():
    for parts in (['검토자는 "기다리세요. 유효합니다."라고 썼다.', "자세한 내용은 그림 0을 보십시오."], ["พบ fluxkit ในบรรทัดที่ 1 นี้", "ใครดูแลโมดูลนี้"]):
        text = " ".join(parts)
        assert [text[a:b] for a, b in sentence_spans(text)] == parts


def test_structure():
    text = "# A. Head\nOne\ntwo. Three\n\n- item one. More\n- two\n  goes on\n3) x\n\n  \n\tLast"
    assert [text[a:b] for a, b in sentence_spans(text)] == ["# A. Head", "One\ntwo.", "Three", "- item one. More", "- two\n  goes on", "3) x", "Last"]
    wrapped = "as noted in no.\n25. The rest"
    assert [wrapped[a:b] for a, b in sentence_spans(wrapped)] == ["as noted in no.\n25.", "The rest"]


@pytest.mark.parametrize("text", [None, "", " \n\t\r\n", "\u00a0"])
def test_nothing(text):
    assert sentence_spans(text) == []


def test_spans_are_disjoint_and_trimmed_on_odd_texts():
    for text in ("((((. «", '"' * 9 + ". a", "a." * 4000, "🎉. B\u200b. c", ").” x. ", "…" * 50):
        spans = sentence_spans(text)
        assert all(a < b and text[a:b] == text[a:b].strip() for a, b in spans) and all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))


def test_table(spark):
    rows = [(1, "A b. C!", 5), (1, "A b. C!", 5), (2, None, 5), (3, "", 5), (None, "X.", 5)]
    got = sentences(spark.createDataFrame(rows, "doc_id int, text string, start_char int"), "doc_id", "text")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([(1, 0, 4), (1, 5, 7), (None, 0, 2)], key=repr)
    assert sentences(spark.createDataFrame([], "doc_id int, text string"), "doc_id", "text").count() == 0


MANY = {"(": 50_000, "()": 50_000, "« ": 50_000, '"a ': 30_000, "a. ": 30_000, "a.": 50_000, "x\n2. y\n": 10_000, "“a” ": 20_000, ". ": 50_000, "“„": 30_000, "a-": 50_000}


@pytest.mark.parametrize("part", MANY)
def test_time_grows_with_the_length(part):
    import time

    start = time.time()
    spans = sentence_spans(part * MANY[part] + ("a" * 1000 + ". B." if part == "a-" else ""))
    assert time.time() - start < 5 and all(a < b for a, b in spans)


def test_lists_of_several_levels():
    text = "Steps:\n1. First goes on\n   over two lines.\n  - inner (a. b.)\n    - deepest\n2. Second.\n\nIt began in\n2024. Then more."
    assert [text[a:b] for a, b in sentence_spans(text)] == ["Steps:", "1. First goes on\n   over two lines.", "- inner (a. b.)", "- deepest", "2. Second.", "It began in\n2024.", "Then more."]


def test_an_abbreviation_is_found_however_long_the_word_before():
    text = "x" * 200 + "-Dr. Smith came.  He left " + " " * 90 + "z. B. Bonn."
    assert [text[a:b] for a, b in sentence_spans(text)][-1].startswith("He left")
