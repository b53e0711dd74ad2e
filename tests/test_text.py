"""Text functions against golden rows, and against a plain reading of the rules in Python."""

from __future__ import annotations

import re

import pytest

from streetbook.dicts import phrases as P
from streetbook.functions import contacts as N
from streetbook.functions import text as T
from streetbook.operators import describe as D

BLANKS = " \t\n\r\x0b\x00"


def apply(spark, values, function):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string").repartition(1)
    rows = df.select("i", function("t").alias("x")).orderBy("i").collect()
    return [r["x"] for r in rows]


def long_text(t: str) -> str:
    t = re.sub(r"[ \t]+", " ", t)
    t = re.sub(r"\?(\s+)(?=[А-ЯA-Z])", r"?" + "\n" + r"\1", t)
    t = re.sub(r"!(\s+)(?=[А-ЯA-Z])", r"!" + "\n\n" + r"\1", t)
    t = re.sub(r"(.{100,}\.)(\s+)(?=[А-ЯA-Z])", r"\1" + "\n\n" + r"\2", t)
    for phrase in P.LONG_TEXT_PHRASES:
        t = re.sub(r"(\S.*?)(" + re.escape(phrase) + ")", r"\1" + "\n\n" + r"\2", t)
    t = re.sub(r"\n{3,}", "\n\n", t)
    return re.sub(r"(?m)^ +", "", t).strip(BLANKS)


def page_text(t: str) -> str:
    letter = r"[^\W\d_]"
    t = t.strip(BLANKS)
    t = re.sub(rf"({letter})\n+({letter})", r"\1\2", t)
    t = re.sub(r"([.!?])([А-ЯA-Z])", r"\1 \2", t)
    t = re.sub(r"[ \t]{2,}", " ", t)
    t = re.sub(r"\?\s+(?=[А-ЯA-Z])", "?\n", t)
    t = re.sub(r"!\s+(?=[А-ЯA-Z])", "!\n\n", t)
    t = re.sub(r"(.{30,}\.)(\s+)(?=[А-ЯA-Z][а-яa-z])", r"\1" + "\n\n", t)
    for phrase in P.PAGE_PHRASES:
        t = re.sub(r"([.!?])\s+(" + re.escape(phrase) + ")", r"\1" + "\n\n" + r"\2", t, flags=re.I)
    t = re.sub(r",\s+(?=[А-ЯA-Z][а-яa-z]{3,}\s+)(?![^\n]{0,50}\n)", ",\n", t)
    t = re.sub(r"\n{3,}", "\n\n", t)
    return re.sub(r"(?is)Ищите нас в соцсетях.*$", "", t).strip(BLANKS)


def fresh_text(t: str) -> str:
    t = re.sub(r"[ \t]+", " ", t)
    t = re.sub(r"(.{150,}[.!?])(\s+)(?=[А-ЯA-Z])", r"\1" + "\n\n" + r"\2", t)
    for phrase in P.REFRESH_PHRASES:
        t = re.sub(r"([.!?])\s+(" + re.escape(phrase) + ")", r"\1" + "\n\n" + r"\2", t)
    return re.sub(r"\n{3,}", "\n\n", t).strip(BLANKS)


@pytest.fixture(scope="module")
def texts(spark):
    """Documents, each also with Russian phrases put in and on one line."""
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()
    plain = [r["text"] for r in rows if len(r["text"]) < 2500]  # the plain reading is slow on long lines
    spiced = []
    for i, t in enumerate(plain[:90]):
        phrase = P.PAGE_PHRASES[i % len(P.PAGE_PHRASES)]
        spiced.append(t.replace(". ", f". {phrase} у нас. ", 2).replace("\n", " ", i % 4) + f" Да! Так? Ок. {phrase}Адрес Адрес")
    short = ["", "А", "Адрес", "  Адрес  Режим работы", "Вопрос? Ответ! Да.\n\n\n\nНет", "x" * 100 + ". Да. Нет\nДа. Нет"]
    return plain + spiced + [t.replace("\n", " ") for t in plain[:60]] + short


@pytest.mark.parametrize(
    "ours, rules",
    [(T.format_text, long_text), (T.format_description, page_text), (T.format_smart, fresh_text)],
)
def test_paragraphs_follow_the_rules(spark, texts, ours, rules):
    got = apply(spark, texts, ours)
    assert [g for g, t in zip(got, texts) if g != rules(t)] == []


def test_normalizer_on_unbroken_texts(spark, texts):
    lines = [t.replace("\n", " ") for t in texts if "@" not in t and ".com" not in t][:80]
    df = spark.createDataFrame([(i, t, None) for i, t in enumerate(lines)], "id int, description string, website string")
    rows = D.normalize_descriptions(df, own_hosts=()).orderBy("id").collect()
    for row, text in zip(rows, lines):
        clean = re.sub(r"(?is)Ищите нас в соцсетях:.*$", "", text)
        if re.search(r"[a-z0-9]\.[a-z]{2,}", clean, re.I) or re.search(r"\d{7}", re.sub(r"\D", "", clean)):
            continue
        want = long_text(clean) if len(clean.encode()) > 200 and "\n" not in clean else clean.strip(BLANKS)
        assert row["description"] == want


def test_boilerplate(spark):
    values = [
        "Текст. ИЩИТЕ нас в соцсетях: vk",
        "Текст. Описание скопировано с yell.ru сегодня\nещё",
        "Текст. Текст скопирован с Yell.ru",
        "Начало\n\nОсобенности: a, b\n\nКонец",
        "Начало\nОсобенности: a\nВ меню суп",
        "Начало\n\nВ меню представлены: суп",
        "Чисто",
        None,
    ]
    want = ["Текст. ", "Текст. ", "Текст. ", "Начало\n\nКонец", "Начало\n суп", "Начало\n\n", "Чисто", None]
    assert apply(spark, values, T.remove_boilerplate) == want


def test_slug_of_every_letter(spark):
    values = ["абвгдеёжзийклмнопрстуфхцчшщъыьэюя", " Рок & Ролл,  Бар ", "ЩУКА", "--a--"]
    want = ["abvgdeyozhziyklmnoprstufhtschshschyeyuya", "rok-and-roll-bar", "schuka", "a"]
    slugs = apply(spark, values, T.slugify)
    assert slugs == want
    assert apply(spark, slugs, T.slugify) == slugs


def test_price_and_portion(spark):
    values = ["1 250 руб. за 300 г", "1 250 руб.", "450 руб. за 0 шт", "бесплатно", "за 5 МЛ"]
    assert apply(spark, values, T.parse_price) == ["1250 руб.", "1250 руб.", "450 руб.", None, None]
    assert apply(spark, values, T.parse_portion) == ["300 г", None, "0 шт", None, "5 МЛ"]


def test_excerpt_and_short_text(spark):
    assert apply(spark, ["<b>Один</b> два\nтри", "односложноеслово"], lambda c: T.excerpt(c, 9)) == ["Один два...", "односложн..."]
    assert apply(spark, ["я" * 60, "z" * 100, None], T.short_text) == ["я" * 60 + "...", "z" * 100, ""]


def test_paragraph_list(spark):
    values = ["Один два. Три четыре.\n\nок\n\n  Пять шесть ", "abcde. F"]
    got = apply(spark, values, T.paragraph_list)
    assert got == [["Один два.", "Три четыре.", "Пять шесть"], ["abcde."]]


def test_append_info(spark):
    df = spark.createDataFrame(
        [("t", list("abcdef"), {"Суп": 1}), ("t", [], {}), (None, None, None)],
        "description string, features array<string>, menu map<string,int>",
    )
    got = [r[0] for r in D.add_structured_info(df).select("description").collect()]
    assert got == ["t\n\nОсобенности: a, b, c, d, e\n\nВ меню представлены: Суп", "t", ""]


def test_phones(spark):
    values = [
        "Тел. 8 (912) 345-67-89, +79123456789 и +7 (495) 1234567",
        "факс: 123 456 78 90; телефон 8(800)555-35-35",
        "+7 912 3456789",
        "нет",
    ]
    got = apply(spark, values, N.extract_phones)
    assert [r["phones"] for r in got] == [
        ["+79123456789", "+74951234567"], ["+78005553535", "+71234567890"], ["+79123456789"], [],
    ]
    assert got[0]["text"] == "Тел. 8 (912) 345-67-89,  и +7 (495) 1234567"
    raw = apply(spark, values, lambda c: N.extract_phones(c, strip_raw=True))
    assert "912" not in raw[0]["text"] and "495" not in raw[0]["text"]
    assert all(re.fullmatch(r"\+7\d{10}", p) for r in got for p in r["phones"])


def test_phone_is_idempotent(spark):
    values = ["8 (912) 345-67-89", "9123456789", "+7 912 345 67 89", "12", "19123456789", ""]
    once = apply(spark, values, N.normalize_phone)
    assert once == ["+79123456789", "+79123456789", "+79123456789", None, None, None]
    assert apply(spark, once, N.normalize_phone) == once


def test_website(spark):
    values = [
        "Сайт (http://a.example.ru/x?y=1). Почта",
        "приветabc.ru/menu,да",
        "пишите box@mail.example.ru",
        "Мы на VK.com",
        "см. https://www.yell.ru/a и shop.example.com.",
        "Информация скопирована с Yell.ru",
        "end.Start",
        "",
    ]
    got = apply(spark, values, N.extract_website)
    assert [r["website"] for r in got] == [
        "http://a.example.ru/x?y=1", "https://abc.ru/menu", None, None, "https://shop.example.com", None,
        "https://end.Start", None,
    ]
    assert got[1]["text"] == "привет,да" and got[3]["text"] == "Мы на "
    assert got[5]["text"] == values[5]
    strict = apply(spark, values, lambda c: N.extract_website(c, strict=True))
    assert [r["website"] for r in strict] == [
        "http://a.example.ru/x?y=1", None, "https://mail.example.ru", None, None, None, None, None,
    ]
    assert strict[3]["text"] == values[3]


def test_website_fills_only_an_empty_one(spark):
    df = spark.createDataFrame(
        [(1, "x a.example.ru", "http://own"), (2, "x a.example.ru", ""), (3, None, None)],
        "id int, description string, website string",
    )
    rows = D.normalize_descriptions(df).orderBy("id").collect()
    assert [r["website"] for r in rows] == ["http://own", "https://a.example.ru", None]
    assert rows[2]["description"] is None and rows[2]["phones"] == []


def test_contact_forms(spark):
    assert apply(spark, ["+7 (912) 3", "8-9"], N.tel_href) == ["+79123", "89"]
    assert apply(spark, ["https://a.ru", "http://b.ru", "c.ru"], N.bare_url) == ["a.ru", "b.ru", "c.ru"]
    assert apply(spark, ["https://d/com/p_12/", "https://d/x"], N.url_key) == ["p_12", None]
    assert apply(spark, ["https://msk.yp.ru/a", "https://msk.yp.com"], N.url_subdomain) == ["msk", None]
    assert apply(spark, ["DDoS-Guard", "Каталог", None], N.is_block_page) == [True, False, False]


def test_no_python_in_text_plans(spark):
    df = spark.createDataFrame([(1, "t", "w")], "id int, description string, website string")
    plan = D.normalize_descriptions(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
