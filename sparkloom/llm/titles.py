"""Reading product titles and features: canonical words, sales phrases, stated attributes."""

from __future__ import annotations

import re
import unicodedata
from html import unescape

# --- fixed values -------------------------------------------------------------
#: Phrases that sell and say nothing about the product.
SALES_PHRASES = (
    "best choice", "best seller", "best price", "durable", "easy to use", "extra strong", "fast delivery", "fast shipping",
    "for home and office", "for home & office", "free shipping", "great gift", "great gift idea", "heavy duty", "high quality", "hot deal",
    "limited offer", "multi-purpose", "must have", "new", "new design", "on sale", "original", "premium", "professional", "sale",
    "space saving", "special offer", "stylish", "top quality", "top rated", "top seller", "upgraded",
)
#: Spellings of colours, each with its colour.
COLOURS = {
    "beige": "beige", "black": "black", "blk": "black", "blue": "blue", "blu": "blue", "brown": "brown", "brn": "brown", "gold": "gold",
    "gray": "grey", "green": "green", "grn": "green", "grey": "grey", "gry": "grey", "oak": "oak", "orange": "orange", "pink": "pink", "purple": "purple",
    "red": "red", "silver": "silver", "silvertone": "silver", "walnut": "walnut", "white": "white", "wht": "white", "yellow": "yellow",
}
NUMBER_WORDS = dict(zip("one two three four five six seven eight nine ten eleven twelve".split(), range(1, 13)))
#: What units measure, in a fixed order.
MEASURES = ("length", "volume", "weight", "power", "voltage", "charge", "memory")
#: Units: what they measure and how many of its base unit they are.
UNITS = {
    "mm": ("length", 1.0), "cm": ("length", 10.0), "m": ("length", 1000.0), "in": ("length", 25.4), "inch": ("length", 25.4), "inches": ("length", 25.4),
    '"': ("length", 25.4), "ft": ("length", 304.8), "feet": ("length", 304.8), "foot": ("length", 304.8),
    "ml": ("volume", 1.0), "cl": ("volume", 10.0), "l": ("volume", 1000.0), "litre": ("volume", 1000.0), "liter": ("volume", 1000.0), "litres": ("volume", 1000.0),
    "liters": ("volume", 1000.0), "fl oz": ("volume", 29.5735), "g": ("weight", 1.0), "kg": ("weight", 1000.0), "oz": ("weight", 28.3495), "lb": ("weight", 453.592),
    "lbs": ("weight", 453.592), "w": ("power", 1.0), "watt": ("power", 1.0), "watts": ("power", 1.0), "v": ("voltage", 1.0), "volt": ("voltage", 1.0), "volts": ("voltage", 1.0),
    "mah": ("charge", 1.0), "ah": ("charge", 1000.0), "mb": ("memory", 1 / 1024), "gb": ("memory", 1.0), "gigabyte": ("memory", 1.0), "gigabytes": ("memory", 1.0),
    "tb": ("memory", 1024.0), "terabyte": ("memory", 1024.0),
}
# -------------------------------------------------------------------------------

_TAG = re.compile(r"<[^<>]*>")
_SALES = re.compile(r"(?<![a-z0-9])(?:" + "|".join(re.escape(p) for p in sorted(SALES_PHRASES, key=len, reverse=True)) + r")(?![a-z0-9])")
_TOKEN = re.compile(r'[^\W_]+(?:\.\d+)?"?')
_UNIT = re.compile(
    r'(?<![a-z0-9.])(\d+(?:\.\d+)?)\s*-?\s*(fl\.? ?oz|"|' + "|".join(sorted((u for u in UNITS if u.isalpha()), key=len, reverse=True)) + r")(?![a-z0-9])"
)
_THOUSANDS = re.compile(r"(?<=\d),(?=\d{3})")
#: Names of entities in capitals, in titles that someone put in capitals.
_ENTITY = re.compile(r"&[A-Z]{2,};")
_WITHIN = re.compile(r"(?<=[^\W\d_])[-'’](?=[^\W\d_])")
_LETTERS, _DIGIT = re.compile(r"[a-z]+"), re.compile(r"\d")
_NUMBER_WORD = "|".join(NUMBER_WORDS)
_COUNT = re.compile(
    rf"\b(?:pack|set|box|lot) of (\d+|{_NUMBER_WORD})\b|(?<![\w.-])(\d{{1,4}})[ -]?(?:pack|pk|pcs|pc|pieces|piece|count|ct)\b(?! of)|\b(single)\b"
)
#: Two or three letters and a number of four to six digits, with a letter of the variant; a number with a unit is none.
_MODEL = re.compile(
    r"(?<![a-z0-9])(?!(?:of|by|in|to|pc)[ -])((?:[a-z]{2}[- ]?|[a-z]{3}-?))(\d{4,6})(?:[- ]?([a-fh-knp-uxyz]))?(?![a-z0-9])(?![ -]?(?:" + "|".join(sorted((u for u in UNITS if u.isalpha()), key=len, reverse=True)) + r")(?![a-z0-9]))"
)


def plain(text: str | None) -> str:
    """Lower case without markup, entities, accents; hyphens within words and commas within numbers go."""
    t = text or ""
    if "<" in t or "&" in t:
        t = _TAG.sub(" ", unescape(_ENTITY.sub(lambda m: m.group().lower(), _TAG.sub(" ", t))))
    if t.isascii():
        t = t.lower()
    else:
        t = unicodedata.normalize("NFKD", t)
        t = "".join(c for c in t if not unicodedata.combining(c)).casefold()
        t = t.replace("″", '"').replace("”", '"').replace("“", '"')
    return _THOUSANDS.sub("", t) if "," in t else t


def _stutter(words: list[str]) -> list[str]:
    """Runs of words that follow themselves at once are said once; the shortest runs first."""
    if len(set(words)) == len(words):
        return words
    for n in range(1, len(words) // 2 + 1):
        k = 0
        while k + 2 * n <= len(words):
            if words[k : k + n] == words[k + n : k + 2 * n]:
                words = words[: k + n] + words[k + 2 * n :]
            else:
                k += 1
    return words


def canonical_words(title: str | None, flat: str | None = None) -> tuple[str, ...]:
    """The words that tell a title: without sales phrases, each word of letters only once, in order. flat: plain(title), where it is known."""
    t = _SALES.sub(" ", " ".join(_stutter((plain(title) if flat is None else flat).split())))
    t = _WITHIN.sub("", t)
    seen: set[str] = set()
    out = []
    for w in _TOKEN.findall(t):
        if w.isalpha():
            if w in seen:
                continue
            seen.add(w)
        out.append(w)
    return tuple(out)


def protected(word: str) -> bool:
    """Whether a word is a number, unit, colour or count, or has a digit, and so bears no misspelling."""
    return word in COLOURS or word in NUMBER_WORDS or word in UNITS or any(c.isdigit() for c in word) or word in ("single", "pack", "finish")


def _stated(text: str) -> list[tuple[str, object]]:
    """What one text in plain() form states, as (kind, value)."""
    text = " ".join(text.split())
    out: list[tuple[str, object]] = []
    taken: list[tuple[int, int]] = []
    digits = _DIGIT.search(text) is not None
    if digits:
        for m in _MODEL.finditer(text):
            out.append(("model", (m.group(1).rstrip("- ") + m.group(2) + (m.group(3) or "")).upper()))
            taken.append(m.span())
    for m in _COUNT.finditer(text):
        if all(m.start() < s or m.start() >= e for s, e in taken):
            n = m.group(1) or m.group(2) or "1"
            out.append(("count", NUMBER_WORDS.get(n) or int(n)))
            taken.append(m.span())
    if digits:
        for m in _UNIT.finditer(text):
            if all(m.end() <= s or m.start() >= e for s, e in taken):
                kind, factor = UNITS[m.group(2).replace(".", "").replace("floz", "fl oz")]
                out.append((kind, round(float(m.group(1)) * factor, 1)))
    out += [("colour", COLOURS[w]) for w in COLOURS.keys() & set(_LETTERS.findall(text))]
    return out


#: What the parts of features, which many listings share, state; forgotten when it grows large.
_PARTS: dict[str, list[tuple[str, object]]] = {}
MOST_PARTS = 1 << 15


def attributes(title: str | None, features: str | None, flat: tuple[str, str] | None = None) -> dict[str, set]:
    """Stated measures (by what they measure), colours, counts and model codes of a listing. flat: both texts through plain(), where known."""
    out: dict[str, set] = {}
    name, rest = flat or (plain(title), plain(features))
    for kind, value in _stated(name):
        out.setdefault(kind, set()).add(value)
    for part in rest.split("|"):
        known = _PARTS.get(part)
        if known is None:
            if len(_PARTS) >= MOST_PARTS:
                _PARTS.clear()
            known = _PARTS[part] = _stated(part)
        for kind, value in known:
            out.setdefault(kind, set()).add(value)
    return out


def agree(a: dict[str, set], b: dict[str, set], slack: float = 0.03) -> bool:
    """Whether no attribute that both state differs; measures may differ by rounding."""
    for k, x in a.items():
        y = b.get(k)
        if not y:
            continue
        if k in ("count", "colour", "model"):
            if not x & y:
                return False
        elif not any(abs(i - j) <= slack * max(i, j) for i in x for j in y):
            return False
    return True
