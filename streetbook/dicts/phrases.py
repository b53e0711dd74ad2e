"""Phrases and patterns of the text normaliser."""

from __future__ import annotations

# Footers that a directory adds to a description; each is cut to the end of the text.
FOOTERS = [
    r"(?isu)Ищите нас в соцсетях:.*$",
    r"(?isu)Информация скопирована с Yell\.ru.*$",
    r"(?isu)Описание скопировано с Yell\.ru.*$",
    r"(?isu)Текст скопирован с Yell\.ru.*$",
]
FOOTER_MARKERS = [
    "ищите нас в соцсетях:",
    "информация скопирована с yell.ru",
    "описание скопировано с yell.ru",
    "текст скопирован с yell.ru",
]
SOCIAL_MARKER = "ищите нас в соцсетях"
PAGE_FOOTER = r"(?isuU)(?:Описание|Информация|Текст)\s+скопирован[ао]?\s+с\s+Yell\.ru.*"
SOCIAL_FOOTER = r"(?isu)Ищите нас в соцсетях.*$"

# Headings of the two blocks that the normaliser once added.
FEATURES_HEADING = "Особенности"
MENU_HEADING = "В меню представлены"
FEATURES_BLOCK_END = "Особенности"
MENU_BLOCK_END = "В меню"

# Phrases that start a new paragraph, for long texts without line breaks.
LONG_TEXT_PHRASES = [
    "Организация располагается по адресу",
    "Учреждение расположено по адресу",
    "Узнать подробности можно",
    "Двери заведения открыты",
    "Режим работы",
    "Телефон",
    "Номер телефона",
    "Адрес",
    "Компания ждёт посетителей",
    "Веб-сайт",
    "Ищите нас в соцсетях",
]

# Phrases that start a new paragraph, for descriptions taken from a page.
PAGE_PHRASES = [
    "Организация располагается",
    "Учреждение расположено",
    "Узнать подробности",
    "Двери заведения открыты",
    "Двери организации открыты",
    "Режим работы",
    "Телефон",
    "Номер телефона",
    "Адрес",
    "Адрес компании",
    "Компания ждёт посетителей",
    "Компания располагается",
    "Веб-сайт",
    "Ищите нас в соцсетях",
    "Ресторан работает",
    "Заведение работает",
    "Вы можете связаться",
    "Связаться с нами",
    "Позвоните по номеру",
    "По номеру телефона",
    "Приходите по адресу",
    "Ждём вас",
    "Ждем вас",
    "Будем рады видеть",
    "Сотрудники",
    "Также вы можете",
    "Дополнительно",
    "Обратите внимание",
    "Важно знать",
]

# Phrases that start a new paragraph, for refreshed descriptions.
REFRESH_PHRASES = [
    "Организация располагается",
    "Узнать подробности",
    "Двери заведения",
    "Адрес",
]

# Phone patterns, in order of search.
PHONE_PATTERNS = [
    r"(?U)\+7\s*\(?\d{3}\)?\s*\d{3}[-\s]?\d{2}[-\s]?\d{2}",
    r"(?U)8\s*\(?\d{3}\)?\s*\d{3}[-\s]?\d{2}[-\s]?\d{2}",
    r"(?iU)(?:тел|телефон|факс)\.?\s*:?\s*(\+7|8)?\s*\(?\d{3}\)?\s*\d{3}[-\s]?\d{2}[-\s]?\d{2}",
]

# Website patterns. The left bound counts Latin letters only, so a host glued to Cyrillic is found.
URL_PATTERN = r"(?i)https?://[^\s,]+"
URL_TAIL = ".,;:!?)'\""
LATIN_LEFT_BOUND = r"(?<![A-Za-z0-9_])"
HOST_PATH = r"(?:/[^\s,]*)?"
# Labels joined by dots. The repeats never give back, so a text of any length is walked once and without recursion; of such
# a chain the host reaches to its last label that begins with two letters.
HOST_CHAIN = r"[a-z0-9][a-z0-9\-]*+(?:\.[a-z0-9][a-z0-9\-]*+)++"
HOST_OF_CHAIN = r"(?i)^(.*\.[a-z]{2,})"
STRICT_HOST_OF_CHAIN = r"(?i)^([^.]++\..*\.[a-z]{2,})"

# Price and portion of a menu row.
PRICE_PATTERN = r"(?U)([\d\s]+)\s*руб\."
PORTION_PATTERN = r"(?iU)за\s*([\d\s]+(?:г|мл|шт))"
CURRENCY = " руб."

# Letters of the transliteration, one to one, dropped, and one to many.
TRANSLIT_SINGLE = ("абвгдезийклмнопрстуфхыэ ", "abvgdeziyklmnoprstufhye-")
TRANSLIT_DROP = "ъь,"
TRANSLIT_MULTI = [
    ("ё", "yo"), ("ж", "zh"), ("ц", "ts"), ("ч", "ch"), ("ш", "sh"), ("щ", "sch"), ("ю", "yu"), ("я", "ya"),
    ("&", "and"),
]

# Days of the week as the pages name them, and their local names.
WEEK_DAYS = ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")
LOCAL_DAYS = ("Пн", "Вт", "Ср", "Чт", "Пт", "Сб", "Вс")
TODAY_LABEL = "сегодня"
OPEN_LABEL = "Открыто до "
CLOSED_LABEL = "Закрыто до "
CLOSED_TODAY_LABEL = " сегодня"
