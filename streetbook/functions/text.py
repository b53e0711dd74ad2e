"""Description clean-up, paragraphing, slugs, prices and short forms."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from streetbook.dicts import phrases as P
from streetbook.functions.expr import col, let, replace_all, squeeze, trim_all

CAPITAL = "[А-ЯA-Z]"
SMALL = "[а-яa-z]"

# A match that starts inside a line would also start at the line's first character, or where the last match ended.
# Tying the search to these two places keeps it linear in the length of the text.
ANCHOR = r"(?:^|\G)"


@dataclass(frozen=True)
class Cut:
    """A replacement that can only apply where the lower-cased text holds ``marker``."""

    marker: str
    pattern: str
    replacement: str = ""


def _apply_cuts(text: Column, cuts: Sequence[Cut]) -> Column:
    """Apply cuts in order. Most texts hold few markers or none, and a plain search for them is far cheaper than a
    pass of every pattern; no cut can bring in the marker of another."""
    table = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in vars(c).items()]) for c in cuts])

    def run(t: Column) -> Column:
        present = let(F.lower(t), lambda low: F.filter(table, lambda c: F.contains(low, c["marker"])))
        return F.aggregate(present, t, lambda acc, c: F.regexp_replace(acc, c["pattern"], c["replacement"]))

    return let(text, run)


def _block_rules(heading: str, end: str) -> list[Cut]:
    """A block goes from its heading to the next empty line, the other block or the end of the text."""
    marker, tail = f"{heading}:".lower(), rf"{heading}:.*?($|\n\n|\n{end})"
    return [Cut(marker, rf"(?isu)\n\n{tail}", "\n\n"), Cut(marker, rf"(?isu)\n{tail}", "\n")] * 2


FOOTERS = [Cut(marker, pattern) for marker, pattern in zip(P.FOOTER_MARKERS, P.FOOTERS)]
BOILERPLATE: list[Cut] = [
    *FOOTERS,
    *_block_rules(P.FEATURES_HEADING, P.MENU_BLOCK_END),
    *_block_rules(P.MENU_HEADING, P.FEATURES_BLOCK_END),
    Cut(f"{P.FEATURES_HEADING}:".lower(), rf"(?isu){P.FEATURES_HEADING}:.*$"),
    Cut(f"{P.MENU_HEADING}:".lower(), rf"(?isu){P.MENU_HEADING}:.*$"),
]


def remove_boilerplate(text: Column | str, cuts: Sequence[Cut] = BOILERPLATE) -> Column:
    """Cut directory footers and generated blocks."""
    return _apply_cuts(col(text), cuts)


def remove_footers(text: Column | str, footers: Sequence[Cut] = FOOTERS) -> Column:
    """Cut directory footers only, then trim."""
    return trim_all(_apply_cuts(col(text), footers))


def format_text(text: Column | str, phrases: Sequence[str] = P.LONG_TEXT_PHRASES, min_sentence: int = 100) -> Column:
    """Paragraphs for a long text without line breaks."""
    sentences = [
        (r"[ \t]+", " "),
        (rf"(?U)\?(\s+)(?={CAPITAL})", "?\n$1"),
        (rf"(?U)!(\s+)(?={CAPITAL})", "!\n\n$1"),
        (rf"(?dmU){ANCHOR}(.{{{min_sentence},}}\.)(\s+)(?={CAPITAL})", "$1\n\n$2"),
    ]
    cuts = [Cut(p.lower(), rf"(?dmU){ANCHOR}([^\S\n]*\S.*?)(\Q{p}\E)", "$1\n\n$2") for p in phrases]
    split = _apply_cuts(replace_all(col(text), sentences), cuts)
    return trim_all(replace_all(split, [(r"\n{3,}", "\n\n"), (r"(?dm)^ +", "")]))


def format_description(
    text: Column | str, phrases: Sequence[str] = P.PAGE_PHRASES, social_footer: Cut = Cut(P.SOCIAL_MARKER, P.SOCIAL_FOOTER)
) -> Column:
    """Paragraphs for a description taken from a page, where line breaks may split words."""
    sentences = [
        (r"(?U)(\p{L})\n+(\p{L})", "$1$2"),
        (rf"([.!?])({CAPITAL})", "$1 $2"),
        (r"[ \t]{2,}", " "),
        (rf"(?U)\?\s+(?={CAPITAL})", "?\n"),
        (rf"(?U)!\s+(?={CAPITAL})", "!\n\n"),
        (rf"(?dmU){ANCHOR}(.{{30,}}\.)(\s+)(?={CAPITAL}{SMALL})", "$1\n\n"),
    ]
    cuts = [Cut(p.lower(), rf"(?iuU)([.!?])\s+(\Q{p}\E)", "$1\n\n$2") for p in phrases]
    rest = [
        (rf"(?U),\s+(?={CAPITAL}{SMALL}{{3,}}\s+)(?![^\n]{{0,50}}\n)", ",\n"),
        (r"\n{3,}", "\n\n"),
    ]
    split = _apply_cuts(replace_all(trim_all(col(text)), sentences), cuts)
    return trim_all(_apply_cuts(replace_all(split, rest), [social_footer]))


def format_smart(text: Column | str, phrases: Sequence[str] = P.REFRESH_PHRASES) -> Column:
    """Paragraphs for a refreshed description."""
    sentences = [
        (r"[ \t]+", " "),
        (rf"(?dmU){ANCHOR}(.{{150,}}[.!?])(\s+)(?={CAPITAL})", "$1\n\n$2"),
    ]
    cuts = [Cut(p.lower(), rf"(?U)([.!?])\s+(\Q{p}\E)", "$1\n\n$2") for p in phrases]
    split = _apply_cuts(replace_all(col(text), sentences), cuts)
    return trim_all(replace_all(split, [(r"\n{3,}", "\n\n")]))


def needs_paragraphs(text: Column) -> Column:
    """Over 200 bytes and not one line break."""
    return (F.octet_length(text) > 200) & ~F.contains(text, F.lit("\n"))


def text_grams(text: Column | str, n: int = 3) -> Column:
    """Distinct runs of ``n`` characters of the lower-cased text; its characters are taken apart once, so long texts stay linear."""

    def runs(chars: Column) -> Column:
        count = F.greatest(F.size(chars) - F.lit(n - 1), F.lit(0))
        return F.transform(F.slice(chars, F.lit(1), count), lambda c, i: F.concat(c, *[F.get(chars, i + k) for k in range(1, n)]))

    return F.array_distinct(let(F.split(F.lower(col(text)), ""), runs))


def strip_tags(text: Column | str) -> Column:
    return F.regexp_replace(col(text), "<[^>]*>", "")


def excerpt(text: Column | str, n: int = 150) -> Column:
    """Plain text cut at the last space before ``n`` characters."""

    def cut(t: Column) -> Column:
        head = F.substring(t, 1, n)
        back = F.instr(F.reverse(head), " ")
        body = F.when(back > 0, F.substring(head, F.lit(1), F.lit(n) - back)).otherwise(head)
        return F.when(F.length(t) <= n, t).otherwise(F.concat(body, F.lit("...")))

    return let(F.replace(strip_tags(text), F.lit("\n"), F.lit(" ")), cut)


def short_text(text: Column | str, n: int = 100) -> Column:
    """Card text: cut to ``n`` characters when it has more than ``n`` bytes."""
    t = F.coalesce(col(text), F.lit(""))
    return F.when(F.octet_length(t) > n, F.concat(F.substring(t, 1, n), F.lit("..."))).otherwise(t)


def paragraph_list(text: Column | str, min_bytes: int = 5) -> Column:
    """Display paragraphs: a period before a capital ends one; those of up to ``min_bytes`` bytes are dropped."""
    parts = F.split(F.regexp_replace(col(text), rf"(?U)\.\s+(?={CAPITAL})", ".\n\n"), "\n\n")
    return F.filter(F.transform(parts, trim_all), lambda p: F.octet_length(p) > min_bytes)


def slugify(text: Column | str) -> Column:
    """Latin slug of a Russian or Latin name."""
    source, target = P.TRANSLIT_SINGLE
    out = F.translate(F.lower(col(text)), source + P.TRANSLIT_DROP, target)
    for letter, latin in P.TRANSLIT_MULTI:
        out = F.replace(out, F.lit(letter), F.lit(latin))
    return F.regexp_replace(F.btrim(out, F.lit("-")), "-+", "-")


def parse_price(text: Column | str) -> Column:
    """Digits before the currency word, without spaces of any kind, with the currency put back."""
    # a match is never empty
    found = F.regexp_extract(col(text), P.PRICE_PATTERN, 1)
    return let(found, lambda f: F.when(f != "", F.concat(F.regexp_replace(f, r"(?U)\s", ""), F.lit(P.CURRENCY))))


def parse_portion(text: Column | str) -> Column:
    return let(F.regexp_extract(col(text), P.PORTION_PATTERN, 1), lambda f: F.when(f != "", squeeze(f)))


def append_info(
    text: Column | str, features: Column, sections: Column, n_features: int = 5, n_sections: int = 3
) -> Column:
    """Add the first features and the first menu sections to a text."""

    def part(heading: str, values: Column, n: int) -> Column:
        body = F.concat(F.lit(f"\n\n{heading}: "), F.array_join(F.slice(values, 1, n), ", "))
        return F.when(F.size(values) > 0, body).otherwise("")

    return F.concat(
        col(text), part(P.FEATURES_HEADING, features, n_features), part(P.MENU_HEADING, sections, n_sections)
    )
