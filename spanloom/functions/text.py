"""Text functions on columns: normalization profiles, tokens, token-set ratios, scripts, clean-up."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

# Character classes that results depend on.
CYRILLIC = "[А-Яа-яЁёІіЇїЄєҐґ]"
LATIN = "[A-Za-z]"
CONTENT = "[0-9A-Za-zА-Яа-яЁёІіЇїЄєҐґ]+"
VOCABULARY = r"[\p{L}\p{N}_\-]+|[.,;:!?()«»\"“”„]"
#: Words that carry little information.
LOW_INFORMATION = "а але бы в вас вже вот вы да же и или их к как ли мне мы на не нет но ну он она они ось по та так то ты у це что що я і".split()


@dataclass(frozen=True)
class Profile:
    name: str
    casefold: bool = True
    strip_punct: bool = True
    fold_yo: bool = False
    collapse_repeats: bool = False


PROFILES = {p.name: p for p in (Profile("default"), Profile("ru_fold", fold_yo=True), Profile("ru_fold_repeats", fold_yo=True, collapse_repeats=True))}


def profile(name: str | Profile | None) -> Profile:
    if isinstance(name, Profile):
        return name
    if (name or "default") not in PROFILES:
        raise ValueError(f"no profile {name!r}; there are {', '.join(sorted(PROFILES))}")
    return PROFILES[name or "default"]


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, though inner lambdas read it for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def squeeze(text: Column) -> Column:
    """White space runs as one space, none at the ends; case and punctuation stay. Null as empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))


def tokens(text: Column, using: str | Profile | None = None) -> Column:
    """Normalized words; an empty text has none."""
    p = profile(using)
    out = F.coalesce(text, F.lit(""))
    if p.casefold:
        out = F.translate(F.lower(F.replace(F.replace(out, F.lit("ß"), F.lit("ss")), F.lit("ẞ"), F.lit("ss"))), "ς", "σ")
    if p.fold_yo:
        out = F.translate(out, "ёЁ", "еЕ")
    if p.strip_punct:
        out = F.regexp_replace(out, r"(?U)[^\p{L}\p{N}_\s]", " ")
    words = F.filter(F.split(out, r"(?U)\s+"), lambda w: w != "")
    return without_repeats(words) if p.collapse_repeats else words


def without_repeats(words: Column) -> Column:
    """Words without those that repeat the one before."""
    return F.array_compact(F.zip_with(words, F.concat(F.array(F.lit("")), words), lambda w, before: F.when(w != before, w)))


def normalize(text: Column, using: str | Profile | None = None) -> Column:
    return F.array_join(tokens(text, using), " ")


def characters(text: Column, using: str | Profile | None = None) -> Column:
    """The normalized text without spaces."""
    return F.array_join(tokens(text, using), "")


def content_tokens(text: Column) -> Column:
    """Lower-case content words of two characters or more, in order."""
    return F.filter(F.transform(F.regexp_extract_all(squeeze(text), F.lit(CONTENT), 0), F.lower), lambda w: F.length(w) > 1)


def content_set(text: Column) -> Column:
    return F.array_distinct(content_tokens(text))


def meaningful_tokens(text: Column) -> Column:
    return F.filter(content_tokens(text), lambda w: ~w.isin(LOW_INFORMATION))


def overlap_ratio(a: Column, b: Column) -> Column:
    """Shared words of two sets over the larger one; 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.size(b)))


def source_ratio(candidate: Column, *sources: Column) -> Column:
    """Share of the candidate's words that any source has; 0 if the candidate has none."""
    return F.when(F.size(candidate) == 0, 0.0).otherwise(F.size(F.array_intersect(candidate, F.array_distinct(F.flatten(F.array(*sources))))) / F.size(candidate))


def unsupported(candidate: Column, *sources: Column) -> Column:
    """Number of the candidate's words that no source has."""
    return F.size(F.array_except(candidate, F.flatten(F.array(*sources))))


def has_script(text: Column, language: Column, other: bool = False) -> Column:
    """Whether a text has a letter of its language's script; ``other`` for languages besides ru, uk and en."""
    clean, code = squeeze(text), F.lower(F.coalesce(language, F.lit("")))
    return F.when(clean == "", False).when(code.isin("ru", "uk"), clean.rlike(CYRILLIC)).when(code == "en", clean.rlike(LATIN)).otherwise(F.lit(other))


def looks_foreign(text: Column, language: Column) -> Column:
    """For ru and uk: no Cyrillic letter and six Latin ones or more."""
    clean = squeeze(text)
    return F.coalesce(F.lower(language).isin("ru", "uk"), F.lit(False)) & ~clean.rlike(CYRILLIC) & (F.regexp_count(clean, F.lit(LATIN)) >= 6)


def sentences(text: Column, ends: str = ".!?") -> Column:
    return F.filter(F.transform(F.split(squeeze(text), rf"(?<=[{ends}])\s+"), lambda x: F.trim(x)), lambda s: s != "")


def has_adjacent_repeat(text: Column) -> Column:
    """Whether a content word comes twice in a row."""
    return bound(content_tokens(text), lambda w: F.size(F.filter(w, lambda x, k: (k > 0) & (F.get(w, k - 1) == x))) > 0)


def hot_words(raw: Column) -> Column:
    """The words of a comma-separated list, trimmed; empty ones dropped, null as none."""
    return F.filter(F.transform(F.split(F.coalesce(raw, F.lit("")), ","), lambda x: F.trim(x)), lambda w: w != "")


def slug(text: Column) -> Column:
    out = F.regexp_replace(F.regexp_replace(text, r"[^A-Za-z0-9._\-]+", "_"), r"^[._\-]+|[._\-]+$", "")
    return F.when(out == "", "case").otherwise(out)


def clean_decoded(text: Column) -> Column:
    """Decoder output without unknown marks and word-boundary pieces, punctuation set tight."""
    out = squeeze(F.regexp_replace(F.coalesce(text, F.lit("")), "⁇|<unk>|▁", " "))
    return squeeze(F.regexp_replace(F.regexp_replace(out, r"\s+([,.;:!?%)\]}»])", "$1"), r"([(\[{«])\s+", "$1"))


def clock(seconds: Column) -> Column:
    """HH:MM:SS.ss; hours may exceed two digits."""
    return F.format_string("%02d:%02d:%05.2f", F.floor(seconds / 3600), F.floor(F.pmod(seconds, F.lit(3600.0)) / 60), F.pmod(seconds, F.lit(60.0)))


def joined(left: Column, right: Column) -> Column:
    """Two texts with a space between; dashes that begin the right one go."""
    l, r = F.trim(F.coalesce(left, F.lit(""))), F.trim(F.regexp_replace(F.trim(F.coalesce(right, F.lit(""))), "^—+", ""))
    return F.trim(F.concat_ws(" ", F.nullif(l, F.lit("")), F.nullif(r, F.lit(""))))


def without_nested(text: Column, opener: str, closer: str) -> Column:
    """Text outside of balanced marks. Closers without an opener stay; an opener without its closer takes the rest along."""
    mark = F.lit("\x00")
    quoted = {"{{": r"\{\{", "}}": r"\}\}", "{|": r"\{\|", "|}": r"\|\}"}
    parts = F.split(F.regexp_replace(F.regexp_replace(text, quoted[opener], "\x00\x01"), quoted[closer], "\x00\x02"), mark)
    kind = lambda p: F.substring(p, 1, 1)
    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("out"))

    def step(acc: Column, p: Column) -> Column:
        opens, closes = kind(p) == "\x01", kind(p) == "\x02"
        depth = F.when(opens, acc.depth + 1).when(closes & (acc.depth > 0), acc.depth - 1).otherwise(acc.depth)
        body = F.when(opens | (closes & (acc.depth > 0)), F.substring(p, 2, 1 << 30)).when(closes, F.concat(F.lit(closer), F.substring(p, 2, 1 << 30))).otherwise(p)
        return F.struct(depth.alias("depth"), F.when(depth == 0, F.concat(acc.out, body)).otherwise(acc.out).alias("out"))

    return F.aggregate(parts, start, step, lambda acc: acc.out)


# What a page's mark-up looks like, each with its purpose; results depend on them and on their order.
COMMENTS = r"(?s)<!--.*?-->"
REFERENCES = r"(?si)<ref[^>/]*?>.*?</ref>|<ref[^>]*/>"
TAGGED_BLOCKS = r"(?si)<(math|code|nowiki|gallery|timeline|syntaxhighlight|table)[^>]*?>.*?</\1>"
OUTER_LINKS = r"\[(https?://[^\s\]]+)(?:\s+([^\]]+))?\]"
FILE_LINKS = r"(?iu)\[\[(file|image|category|файл|изображение|категория):[^\[\]]*\]\]"
INNER_LINKS = r"\[\[(?:[^\[\]]*\|)?\s*([^\[\]|]*?)\s*\]\]"
HEADINGS = r"=+\s*(.*?)\s*=+"
EMPHASIS = r"''+"
TAGS = r"<[^>]+>"
SPACED_MARKS = r"([,.;:!?()«»\"“”„])"

_LONG_NAMES = sorted(k[:-1] for k in html5 if k.endswith(";"))
_SHORT_NAMES = sorted((k for k in html5 if not k.endswith(";")), key=lambda k: (-len(k), k))


def unescaped(text: Column) -> Column:
    """HTML entities as characters: named ones, those that may lack their semicolon included, and numbers.

    Names come from Python's table of them. Numbers from 128 to 159 are those of Windows-1252, other control characters
    and noncharacters vanish, numbers beyond Unicode become U+FFFD; unknown names stay.
    """
    parts = F.split(text, "&")
    table = lambda pairs: F.str_to_map(F.lit("\x01".join(f"{k}\x02{v}" for k, v in pairs)), F.lit("\x01"), F.lit("\x02"))  # noqa: E731  folded to one literal
    names, short = table((k, html5[f"{k};"]) for k in _LONG_NAMES), table((k, html5[k]) for k in _SHORT_NAMES)
    windows = F.create_map(*(F.lit(x) for k in range(128, 160) for x in (k, bytes([k]).decode("cp1252", "ignore") or chr(k))))
    common = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "nbsp": "\u00a0", "apos": "'"}

    def named(part: Column) -> Column:
        name = F.regexp_extract(part, r"^([A-Za-z][A-Za-z0-9]*);", 1)
        head = F.regexp_extract(part, f"^({'|'.join(_SHORT_NAMES)})", 1)
        char = F.lit(None).cast("string")
        for k, c in common.items():
            char = F.when(name == k, c).otherwise(char)
        char = F.when(name == "", F.lit(None).cast("string")).when(name.isin(*common), char).otherwise(F.try_element_at(names, name))
        whole = F.concat(char, F.substring(part, F.length(name) + 2, F.length(part)))
        return F.coalesce(whole, F.when(head != "", F.concat(F.try_element_at(short, head), F.substring(part, F.length(head) + 1, F.length(part)))), F.concat(F.lit("&"), part))

    def numbered(part: Column) -> Column:
        digits = F.regexp_extract(part, r"^#(?:[xX]([0-9a-fA-F]+)|([0-9]+));?", 0)
        code = F.coalesce(F.conv(F.regexp_extract(part, r"^#[xX]0*([0-9a-fA-F]{1,8})(?![0-9a-fA-F])", 1), 16, 10).try_cast("long"), F.regexp_extract(part, r"^#0*([0-9]{1,8})(?![0-9])", 1).try_cast("long"), F.lit(1 << 40))
        valid = (code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF)
        nothing = code.between(1, 8) | code.isin(11, 127) | code.between(14, 31) | code.between(128, 159) | code.between(0xFDD0, 0xFDEF) | (code.bitwiseAND(0xFFFE) == 0xFFFE)
        char = F.when(code == 13, "\r").when(F.try_element_at(windows, code).isNotNull(), F.try_element_at(windows, code)).when(valid & nothing, "").when(valid, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise("\ufffd")
        return F.when(digits == "", F.concat(F.lit("&"), part)).otherwise(F.concat(char, F.substring(part, F.length(digits) + 1, F.length(part))))

    each = F.transform(parts, lambda p, k: F.when(k == 0, p).when(p.startswith("#"), numbered(p)).otherwise(named(p)))
    return F.when(F.contains(text, F.lit("&")), F.array_join(each, "")).otherwise(text)


def plain_sentences(markup: Column) -> Column:
    """Sentences of a marked-up page: comments, references, tagged blocks, templates, tables, links and tags removed."""
    t = F.regexp_replace(unescaped(F.coalesce(markup, F.lit(""))), COMMENTS, " ")
    t = F.regexp_replace(F.regexp_replace(t, REFERENCES, " "), TAGGED_BLOCKS, " ")
    braced = lambda x: without_nested(without_nested(x, "{{", "}}"), "{|", "|}")
    t = bound(t, lambda x: F.when(F.contains(x, F.lit("{")) | F.contains(x, F.lit("|}")), braced(x)).otherwise(x))  # few texts have any
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace(t, OUTER_LINKS, " $2 "), FILE_LINKS, " "), INNER_LINKS, "$1")
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace(t, HEADINGS, " $1. "), EMPHASIS, ""), TAGS, " ")
    return F.filter(F.split(squeeze(F.regexp_replace(t, SPACED_MARKS, " $1 ")), r"(?<=[.!?])\s+"), lambda s: F.length(s) >= 3)
