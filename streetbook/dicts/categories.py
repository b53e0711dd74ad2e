"""Category tables: source slug -> own slug, keyword cascade, crawl grid and tag groups."""

from __future__ import annotations


# Category slug of the first source -> own category slug.
FIRST_SITE = {
    "restorany": "restorany-i-kafe", "restorany-i-kafe-s-zhivoj-muzykoj": "restorany-i-kafe",
    "bary": "bary-i-kluby", "bary-i-kluby": "bary-i-kluby", "karaoke-kluby": "bary-i-kluby",
    "tancevalnye-kluby": "bary-i-kluby", "supermarkety": "magaziny", "magaziny": "magaziny", "apteki": "magaziny",
    "optiki": "magaziny", "salony-krasoty": "krasota", "barbershop": "krasota", "parikmakherskie": "krasota",
    "manikyur": "krasota", "pedikyur": "krasota", "manikyur-pedikyur": "krasota", "kosmetologiya": "krasota",
    "ehsteticheskie-kosmetologii": "krasota", "lazernaya-kosmetologiya": "krasota", "massazh": "krasota",
    "massazhnyj-salon": "krasota", "klassicheskiy-massaj": "krasota", "rasslablyayushchij-massazh": "krasota",
    "anticellyulitnyj-massazh": "krasota", "massazh-lica": "krasota", "massazh-spiny": "krasota",
    "epilyaciya": "krasota", "lazernaya-epilyaciya": "krasota", "depilyaciya": "krasota",
    "korrekciya-brovej": "krasota", "narashchivanie-resnic": "krasota", "narashchivanie-nogtej": "krasota",
    "dizajn-nogtej": "krasota", "apparatnyj-manikyur": "krasota", "gel-lak": "krasota",
    "laminirovanie-brovej": "krasota", "laminirovanie-resnic": "krasota", "permanentnyj-makiyazh": "krasota",
    "chistka-lica": "krasota", "piling-lica": "krasota", "mezoterapiya": "krasota", "obertyvanie": "krasota",
    "wellness": "krasota", "medicina": "medicina", "meditsinskie-kliniki-tsentry-uslugi": "medicina",
    "stomatologii": "medicina", "stomatologicheskaya-klinika": "medicina", "detskie-kliniki": "medicina",
    "medicinskie-laboratorii": "medicina", "laboratornaya-diagnostika": "medicina", "uzi": "medicina",
    "ultrazvuk": "medicina", "uzi-sosudov": "medicina", "uzi-shchitovidnoj-zhelezy": "medicina",
    "flyuorografiya": "medicina", "funkcionalnaya-diagnostika": "medicina", "fizioterapiya": "medicina",
    "nevrologiya": "medicina", "nevrologii": "medicina", "travmatologiya": "medicina", "ortopediya": "medicina",
    "ortodontiya": "medicina", "implantaciya-zubov": "medicina", "protezirovanie-zubov": "medicina",
    "lechenie-kariesa": "medicina", "chistka-zubov": "medicina", "metallokeramika": "medicina",
    "viniry": "medicina", "udalenie-zuba": "medicina", "gosudarstvennye-lechebnye-uchrezhdeniya": "medicina",
    "fitnes-kluby": "sport", "sport-i-fitnes": "sport", "sportivnye-bazy": "sport",
    "basseyny-plavatelnye": "sport", "razvlekatelnye-centry": "razvlecheniya",
    "razvlecheniya-i-otdyh": "razvlecheniya", "kinoteatry": "razvlecheniya",
    "kultura-i-iskusstvo": "razvlecheniya", "bany-saunyi": "razvlecheniya", "bani-basseiny": "razvlecheniya",
    "russkie-bani": "razvlecheniya", "bouling": "razvlecheniya", "kursy": "obrazovanie",
    "obrazovanie": "obrazovanie", "kyrsy-inostrannyh-jazykov": "obrazovanie", "detskie-sady": "obrazovanie",
    "yuridicheskie-uslugi": "uslugi-biznes", "uslugi": "uslugi-biznes",
    "biznes-finansy-strahovanie": "uslugi-biznes", "marketing-i-reklama": "uslugi-biznes",
    "it-i-telekommunikacii": "uslugi-biznes", "proizvodstvo-i-optovaya-torgovlya": "uslugi-biznes",
    "transport-i-logistika": "uslugi-biznes", "gosudarstvo-pravo-i-obshchestvo": "uslugi-biznes",
    "izdatelstva-smi": "uslugi-biznes", "tipografii": "uslugi-biznes", "turfirmy": "uslugi-biznes",
    "puteshestviya-i-turizm": "uslugi-biznes", "remont-bytovoj-tehniki": "uslugi-dom",
    "remont-bytovoy-tekhniki": "uslugi-dom", "remontnye-servisy": "uslugi-dom",
    "remont-telefonov-smartfonov": "uslugi-dom", "khimchistka": "uslugi-dom", "stroitelstvo": "uslugi-dom",
    "sad-ogorod-rasteniya": "uslugi-dom", "avtoservisy": "transport", "avtoservisy-i-tyuning": "transport",
    "avto-moto": "transport", "zamena-masla-v-dvigatele": "transport", "agentstva-nedvizhimosti": "nedvizhimost",
    "nedvizhimost": "nedvizhimost", "gostinicy": "oteli-arenda", "oteli": "oteli-arenda",
    "hostely": "oteli-arenda",
}

# Own category slug -> category slugs of the second source.
SECOND_SITE = {
    "restorany-i-kafe": [
        "restorany", "kafe", "bary", "kofeyni", "stolovye", "fastfud", "sushi-bary", "pizzerii",
    ],
    "bary-i-kluby": ["nochnye-kluby", "karaoke-kluby", "biljardnye-kluby", "paby"],
    "magaziny": [
        "supermarkety", "produktovye-magaziny", "khoztovary", "stroitelnye-magaziny", "mebelnye-magaziny",
        "elektronika", "odezhda-obuv", "kosmetika-parfyumeriya", "detskie-tovary", "sportivnye-tovary",
        "knizhnye-magaziny", "tsvety", "alkogolnye-magaziny", "tabak",
    ],
    "krasota": [
        "salony-krasoty", "parikmaherskie", "manikyurnye-salony", "kosmetologiya", "massazhnye-salony",
        "spasalony", "tatu-studii",
    ],
    "medicina": [
        "polikliniki", "stomatologiya", "gospitali", "apteki", "meditsinskie-tsentry", "diagnosticheskie-tsentry",
        "laboratorii", "fizioterapiya", "reabilitatsiya", "skoraya-pomoshch",
    ],
    "sport": [
        "fitnes-kluby", "sportivnye-kluby", "basseyny", "trenazhernye-zaly", "sportivnye-sektsii", "edy-v-sport",
        "velomagaziny",
    ],
    "obrazovanie": [
        "shkoly", "detskie-sady", "kursy", "instituty", "repetitory", "yazykovye-kursy", "vozhdenie", "tantsy",
        "muzykalnye-shkoly",
    ],
    "razvlecheniya": [
        "kinoteatry", "teatry", "muzei", "parki-razvlecheniy", "bowling", "kvesty", "antikafe", "zoo", "akvaparki",
    ],
    "uslugi-biznes": [
        "bukhgalteriya", "yuridicheskie-uslugi", "reklama", "konsalting", "ofisnye-pomeshcheniya",
        "kurierskie-uslugi", "logistika",
    ],
    "uslugi-dom": [
        "remont-kvartir", "santekhniki", "elektriki", "uborka", "klining", "khimchistka", "remont-techniki",
        "masterskie",
    ],
    "transport": [
        "avtoservisy", "avtomoyki", "shinomonrazh", "avtozapchasti", "avtosalony", "avtoshkoly", "taksi",
        "gruzoperevozki", "avtostoyanki",
    ],
    "nedvizhimost": [
        "agentsva-nedvizhimosti", "arenda-kvartir", "arenda-ofisov", "stroitelstvo", "remont-zdaniy",
    ],
    "oteli-arenda": ["oteli", "hostely", "gostinitsy", "sanatorii", "bazy-otdykha"],
}

# Own category slug -> search terms of the rendered source.
SEARCH_TERMS = {
    "restorany-i-kafe": ["кафе", "рестораны", "бары", "кофейни", "пиццерии", "суши"],
    "krasota": ["салоны красоты", "парикмахерские", "маникюр"],
    "medicina": ["поликлиники", "стоматология", "аптеки"],
    "sport": ["фитнес клубы", "спортивные клубы", "бассейны"],
    "obrazovanie": ["школы", "детские сады", "курсы"],
    "razvlecheniya": ["кинотеатры", "музеи", "развлечения"],
    "magaziny": ["магазины", "супермаркеты"],
    "transport": ["автосервисы", "шиномонтаж", "автомойки"],
    "uslugi-dlya-biznesa": ["бухгалтерские услуги", "юридические услуги"],
    "uslugi-dlya-doma": ["сантехники", "электрики", "уборка"],
    "nedvizhimost": ["агентства недвижимости"],
    "bary-i-kluby": ["бары", "клубы", "пабы"],
}

# Short source map of the keyword cascade.
CASCADE_SOURCE = {
    "restorany": "restorany-i-kafe", "bary": "bary-i-kluby", "supermarkety": "magaziny",
    "salony-krasoty": "krasota", "medicinskie-centry": "medicina", "fitnes-kluby": "sport",
    "razvlekatelnye-centry": "razvlecheniya", "kursy": "obrazovanie", "yuridicheskie-uslugi": "uslugi-biznes",
    "remont-bytovoj-tehniki": "uslugi-dom", "avtoservisy": "transport", "agentstva-nedvizhimosti": "nedvizhimost",
    "gostinicy": "oteli-arenda", "oteli": "oteli-arenda", "hostely": "oteli-arenda",
}

# Cascade rules for descriptions, in order of priority.
CASCADE_DESCRIPTION = {
    "magaziny": [
        "интернет-магазин", "интернет магазин", "интернет-бутик", "интернет бутик", "бутик", "товаров для дома",
        "посуда", "текстиль", "декор", "предметы интерьера", "мебельный", "фурнитура", "аксессуаров",
    ],
    "restorany-i-kafe": ["ресторан", "кафе", "кухня", "блюда", "меню", "повар", "шеф"],
    "krasota": ["салон красоты", "косметология", "маникюр", "педикюр", "стрижка", "уход за кожей"],
    "medicina": ["клиника", "медицинский центр", "врач", "лечение", "диагностика", "стоматология"],
    "sport": ["фитнес", "тренажерный", "спортивный", "тренировки", "бассейн"],
    "uslugi-dom": ["ремонт", "сантехник", "электрик", "уборка", "клининг", "доставка"],
    "nedvizhimost": [
        "агентство недвижимости", "недвижимости", "подберем участок", "купить", "продать", "аренда", "ипотека",
    ],
    "obrazovanie": ["курсы", "мастерская", "обучение", "навыки", "тренинг", "школа"],
    "oteli-arenda": [
        "отель", "гостиница", "пансионат", "хостел", "апартамент", "квартиры посуточно", "база отдыха",
    ],
    "razvlecheniya": [
        "кино", "театр", "концерт", "выставка", "музей", "парк", "боулинг", "квест", "баня", "сауна",
    ],
    "uslugi-biznes": ["франшиза", "франшизы", "бизнес под ключ", "страховая компания", "микрофинансовая"],
}

# Cascade rules for titles of feature groups, in order of priority.
CASCADE_GROUP = {
    "restorany-i-kafe": ["кухня", "тип ресторана", "меню"],
    "bary-i-kluby": ["бар", "клуб"],
    "krasota": ["услуги салона", "косметология", "ногтевой сервис"],
    "medicina": ["медицинские услуги", "специализации врачей"],
    "sport": ["спорт", "фитнес"],
}

# Cascade rules for features, in order of priority.
CASCADE_FEATURE = {
    "restorany-i-kafe": ["ресторан", "кафе", "кухня", "меню", "блюдо"],
    "bary-i-kluby": ["бар", "клуб", "коктейль", "напиток"],
    "krasota": ["салон", "стрижка", "маникюр", "косметология"],
    "medicina": ["клиника", "врач", "лечение", "диагностика"],
    "sport": ["тренажер", "фитнес", "тренировка", "бассейн"],
}

# Two spellings of one own slug.
SLUG_ALIASES = {"uslugi-dlya-doma": "uslugi-dom", "uslugi-dlya-biznesa": "uslugi-biznes"}

# Source slug and own slug of the crawl grid.
CRAWL_GRID = [
    ("restorany", "restorany-i-kafe"),
    ("bary-i-kluby", "bary-i-kluby"),
    ("supermarkety", "magaziny"),
    ("salony-krasoty", "krasota"),
    ("medicina", "medicina"),
    ("sport-i-fitnes", "sport"),
    ("razvlecheniya-i-otdyh", "razvlecheniya"),
    ("obrazovanie", "obrazovanie"),
    ("biznes-finansy-strahovanie", "uslugi-biznes"),
    ("remontnye-servisy", "uslugi-dom"),
    ("avto-moto", "transport"),
    ("agentstva-nedvizhimosti", "nedvizhimost"),
    ("gostinicy", "oteli-arenda"),
]

# Part of a feature group title -> tag group, in order of priority.
TAG_GROUPS = [
    ("Кухня", "кухня"),
    ("Тип", "тип"),
    ("Музыка", "музыка"),
    ("Услуги", "услуги"),
    ("Способы оплаты", "оплата"),
]

# Heading of tags that have no group.
OTHER_TAGS = "другое"
