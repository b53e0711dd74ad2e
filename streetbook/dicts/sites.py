"""Hosts, cities and quotas of the crawled directories."""

from __future__ import annotations

# Hosts of the crawled directories themselves, never the website of a company.
OWN_HOSTS = ("yell.ru",)
RENDERED_HOSTS = ("2gis.ru",)
SUBDOMAIN_HOST = "yp.ru"
OWN_LINKS = ("yell.ru", "vk.com/yellru")
IMAGE_BASE = "https://image2.yell.ru/responses/"

# Hosts that a description may name without meaning the company's own site.
COMMON_HOSTS = ("yandex.ru", "google.com", "vk.com", "facebook.com", "instagram.com", "youtube.com")

# Network -> pattern of its links.
SOCIAL_PATTERNS = [
    ("vk", r"(?i)vk\.com|vkontakte"),
    ("telegram", r"(?i)t\.me|telegram"),
    ("instagram", r"(?i)instagram\.com"),
    ("facebook", r"(?i)facebook\.com|fb\.com"),
    ("youtube", r"(?i)youtube\.com|youtu\.be"),
]

# Words in the title of a page that guards against bots.
BLOCK_WORDS = ("DDoS", "Guard")

# Subdomain -> city of the second source.
CITY_HOSTS = [
    ("msk", "Москва"),
    ("spb", "Санкт-Петербург"),
    ("chelyabinsk", "Челябинск"),
    ("tyumen", "Тюмень"),
    ("yekaterinburg", "Екатеринбург"),
    ("novosibirsk", "Новосибирск"),
    ("kazan", "Казань"),
    ("nizhny-novgorod", "Нижний Новгород"),
    ("rostov-na-donu", "Ростов-на-Дону"),
    ("ufa", "Уфа"),
    ("krasnoyarsk", "Красноярск"),
    ("voronezh", "Воронеж"),
    ("perm", "Пермь"),
    ("volgograd", "Волгоград"),
    ("krasnodar", "Краснодар"),
    ("samara", "Самара"),
    ("saratov", "Саратов"),
    ("tolyatti", "Тольятти"),
    ("izhevsk", "Ижевск"),
    ("barnaul", "Барнаул"),
    ("irkutsk", "Иркутск"),
    ("habarovsk", "Хабаровск"),
    ("yaroslavl", "Ярославль"),
    ("vladivostok", "Владивосток"),
    ("tver", "Тверь"),
    ("tula", "Тула"),
    ("kaliningrad", "Калининград"),
    ("sochi", "Сочи"),
]

# Slugs of cities set by name.
CITY_SLUG_FIXES = [
    ("Екатеринбург", "yekaterinburg"),
    ("Челябинск", "chelyabinsk"),
    ("Нижний Новгород", "nizhniynovgorod"),
]

# Cities left out when the next one is picked.
BIG_CITIES = ("moscow", "spb")

# Quota profiles, least weight -> records per category.
QUOTA_TIERS = {
    "list": [(500_000, 100), (100_000, 50), (50_000, 30), (None, 15)],
    "per_category": [(500_000, 30), (400_000, 25), (300_000, 20), (200_000, 15), (100_000, 10), (None, 5)],
}
BIG_CITY_QUOTA = {"moscow": 30, "spb": 20}

# Quality gate.
MIN_RATING = 4.0
MIN_REVIEWS = 5
