"""English text normal form: clocks, contractions, titles, numbers, money, spelling and initials.

A text becomes words first.  Numbers are then read by a small reader over the
words: it takes a run of number words as groups (below a hundred, with hundreds,
with scales), joins groups that are read out side by side (nineteen | seventy-six
is 1976, six | thirty is 630) and keeps apart what does not belong together: a
number of three digits or more, or one with a hundred or a scale, takes no
further group, and a per cent value after a spoken year is a number of its own.
"""

from __future__ import annotations

import re
import unicodedata
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Number words.
UNITS = {w: i for i, w in enumerate("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split())}
ZEROS = ("o", "oh", "zero")
TENS = {w: 10 * i for i, w in enumerate("twenty thirty forty fifty sixty seventy eighty ninety".split(), 2)}
SCALES = {"thousand": 3, "million": 6, "billion": 9, "trillion": 12, "quadrillion": 15, "quintillion": 18}
ORDINALS = {w: i for i, w in enumerate("zeroth first second third fourth fifth sixth seventh eighth ninth tenth eleventh twelfth thirteenth fourteenth fifteenth sixteenth seventeenth eighteenth nineteenth".split())}
REPEATS = {"double": 2, "triple": 3}
SIGNS = {"minus": "-", "negative": "-", "plus": "+", "positive": "+"}
MONEY = {"dollar": "$", "dollars": "$", "pound": "£", "pounds": "£", "euro": "€", "euros": "€", "cent": "¢", "cents": "¢"}
# Fillers that are left out, and words written in full.
FILLERS = {"hmm", "mm", "mhm", "mmm", "uh", "um"}
FULL = {
    "won't": "will not", "can't": "can not", "let's": "let us", "ain't": "aint", "y'all": "you all", "wanna": "want to", "gotta": "got to", "gonna": "going to",
    "i'ma": "i am going to", "imma": "i am going to", "woulda": "would have", "coulda": "could have", "shoulda": "should have", "ma'am": "madam",
    "mr": "mister", "mrs": "missus", "st": "saint", "dr": "doctor", "prof": "professor", "capt": "captain", "gov": "governor", "ald": "alderman", "gen": "general",
    "sen": "senator", "rep": "representative", "pres": "president", "rev": "reverend", "hon": "honorable", "asst": "assistant", "assoc": "associate", "lt": "lieutenant",
    "col": "colonel", "jr": "junior", "sr": "senior", "esq": "esquire",
}
ENDINGS = {"n't": "not", "'re": "are", "'s": "is", "'d": "would", "'ll": "will", "'t": "not", "'ve": "have", "'m": "am"}
#: Of 'd and 's before these words.
PERFECT = {"been": "ds", "gone": "ds", "done": "d", "got": "s"}
# Letters without a decomposition.
LETTERS = str.maketrans({"œ": "oe", "ø": "o", "æ": "ae", "ß": "ss", "đ": "d", "ð": "d", "þ": "th", "ł": "l"})

_CLOCK = re.compile(r"(?<!\d)(\d{1,2}):([0-5]\d)(?!\d)")
_SPAN = re.compile(r"(?<=:[0-5]\d)\s*[-–—]\s*(?=\d{1,2}:[0-5]\d(?!\d))")
_ASIDE = re.compile(r"[<\[][^>\]]*[>\]]|\([^)]+\)")
_FIGURE = re.compile(r"([$£€¢]?)(\d+(?:\.\d+)?)(%|st|nd|rd|th|s)?")


def _words(text: str) -> list[str]:
    """Lower-case words without marks; figures keep their point, money sign and per cent sign."""
    text = _SPAN.sub(" to ", text)
    text = _CLOCK.sub(lambda m: m[0] if int(m[1]) > 23 else str(int(m[1])) + m[2].replace("00", ""), text)
    text = _ASIDE.sub("", text.lower().replace("’", "'"))
    text = re.sub(r"\s+'", "'", re.sub(rf"\b(?:{'|'.join(sorted(FILLERS))})\b", "", text))
    text = re.sub(r"(?<=\d),(?=\d)", "", text)
    spoken = []
    raw = re.findall(r"[^\s,;:!?\"/–—-]+(?:-(?=\d))?|-(?=\d)", text)
    for k, w in enumerate(raw):
        spoken += _contracted(w.strip(".'") if not any(c.isdigit() for c in w) else w, raw[k + 1] if k + 1 < len(raw) else "")
    marked = unicodedata.normalize("NFKD", " ".join(spoken).translate(LETTERS))
    kept = "".join(c if c in ".%$¢€£" else "" if unicodedata.category(c) == "Mn" else " " if unicodedata.category(c)[0] in "MSP" else c for c in marked)
    return re.sub(r"\.(?!\d)", " ", kept).split()


def _contracted(word: str, following: str) -> list[str]:
    if word in FULL:
        return FULL[word].split()
    for end, full in ENDINGS.items():
        if word.endswith(end) and len(word) > len(end):
            if following in PERFECT and end[1:] in PERFECT[following] and end[0] == "'":
                full = {"d": "had", "s": "has"}[end[1:]]
            return [*_contracted(word[: -len(end)], ""), full]
    return [word]


class _Reader:
    """Reads numbers from words."""

    def __init__(self, words: list[str]) -> None:
        self.words = words

    def at(self, i: int) -> str:
        return self.words[i] if 0 <= i < len(self.words) else ""

    def spoken(self, i: int) -> bool:
        """Whether a number word stands there."""
        w = self.at(i)
        return w in UNITS or w in TENS or w in ZEROS or w in ORDINALS or w == "hundred" or w in SCALES or self.plural(w) is not None or w in REPEATS and (self.at(i + 1) in UNITS or self.at(i + 1) in ZEROS)

    @staticmethod
    def plural(w: str) -> int | None:
        """The tens, hundred or scale of twenties, hundreds, thousands."""
        if w.endswith("ies") and w[:-3] + "y" in TENS:
            return TENS[w[:-3] + "y"]
        return 100 if w == "hundreds" else 10 ** SCALES[w[:-1]] if w.endswith("s") and w[:-1] in SCALES else None

    def percent(self, i: int) -> int:
        """Words of a per cent sign there."""
        return 1 if self.at(i) == "percent" else 2 if self.at(i) == "per" and self.at(i + 1) == "cent" else 0

    def small(self, i: int) -> tuple[str, int, str]:
        """Digits of what lies below a hundred, where it ends, and an ending (ordinal or plural) that closes it."""
        w, follow = self.at(i), self.at(i + 1)
        if w in REPEATS:
            return str(0 if follow in ZEROS else UNITS[follow]) * REPEATS[w], i + 2, ""
        if w in ZEROS:
            if w != "zero" and 0 < UNITS.get(follow, 0) < 10:
                return f"0{UNITS[follow]}", i + 2, ""
            return "0", i + 1, ""
        if w in ORDINALS:
            return str(ORDINALS[w]), i + 1, _ordinal(ORDINALS[w])
        if w in TENS:
            if 0 < UNITS.get(follow, 0) < 10:
                return str(TENS[w] + UNITS[follow]), i + 2, ""
            if 0 < ORDINALS.get(follow, 0) < 10:
                return str(TENS[w] + ORDINALS[follow]), i + 2, _ordinal(ORDINALS[follow])
            return str(TENS[w]), i + 1, ""
        if self.plural(w) is not None:
            return str(self.plural(w)), i + 1, "s"
        return str(UNITS[w]), i + 1, ""

    def whole(self, i: int) -> tuple[str, int, str, bool]:
        """Digits of one value with its hundreds and scales, where it ends, its ending, and whether it takes no further group."""
        w = self.at(i)
        if w.isdigit():
            value, i, end = w, i + 1, ""
        elif w == "hundred" or w in SCALES:
            value, end = "1", ""
        else:
            value, i, end = self.small(i)
        total, part, closed, least = 0, int(value), len(value) > 2 and w.isdigit() or bool(end), 99
        while not end:
            w = self.at(i)
            year = part in (19, 20)
            if w == "hundred" and part < 100:
                part, i, closed = part * 100, i + 1, True
                j = i + 1 if self.at(i) == "and" else i
                if self.spoken(j) and self.at(j) not in ("hundred", *SCALES, *REPEATS) and self.plural(self.at(j)) is None:
                    more, k, end_ = self.small(j)
                    if not (year and self.percent(k)) and self.at(k) != "hundred":
                        part, i, end = part + int(more), k, end_
            elif w in ("hundredth", "hundredths") and part < 100:
                part, i, closed, end = part * 100, i + 1, True, "th"
            elif w in SCALES and SCALES[w] < least:
                total, part, least, i, closed = total + part * 10 ** SCALES[w], 0, SCALES[w], i + 1, True
                j = i + 1 if self.at(i) == "and" else i
                if not self.spoken(j) or self.at(j) in ("hundred", *SCALES, *REPEATS) or self.plural(self.at(j)) is not None:
                    break
                more, i, end = self.small(j)
                part = int(more)
            elif w.removesuffix("th") in SCALES and w.endswith("th"):
                total, part, i, closed, end = total + part * 10 ** SCALES[w[:-2]], 0, i + 1, True, "th"
            else:
                break
        return (str(total + part) if closed and (total or part >= 100) else value), i, end, closed

    def number(self, i: int) -> tuple[list[str], int]:
        """The figures that begin at a word, and where they end."""
        first, groups, j, end, closed = i, [], i, "", False
        while not closed and (self.spoken(j) or not groups and self.at(j).isdigit()):
            value, k, end, closed = self.whole(j)
            if groups and len(value) > 2:  # a hundred or a scale begins a number of its own
                end, closed = "", False
                break
            groups.append((value, j))
            j = k
        figures, start = [], 0
        if self.percent(j) and len(groups) > 1 and self.at(first) in ("nineteen", "twenty") and groups[-1][1] - first > 1:
            figures, start = ["".join(v for v, _ in groups[:-1])], len(groups) - 1
        value = "".join(v for v, _ in groups[start:])
        if self.at(j) == "point" and (self.spoken(j + 1) or self.at(j + 1).isdigit()):
            j, after = j + 1, ""
            while self.at(j).isdigit() and not after or self.spoken(j) and self.at(j) not in ("hundred", *SCALES):
                more, j = (self.at(j), j + 1) if self.at(j).isdigit() else self.small(j)[:2]
                after += more
            value, j = self.scaled(f"{value}.{after}", j)
        elif [self.at(j), self.at(j + 1), self.at(j + 2)] == ["and", "a", "half"] and not end:
            value, j = self.scaled(f"{value}.5", j + 3)
        sign, j = self.unit(j, end)
        return [*figures, f"{sign[0]}{value}{end or sign[1]}"], j

    def scaled(self, value: str, j: int) -> tuple[str, int]:
        """A decimal times a scale that follows it."""
        if self.at(j) not in SCALES:
            return value, j
        product = Decimal(value) * 10 ** SCALES[self.at(j)]
        return (str(int(product)) if product == int(product) else str(product.normalize())), j + 1

    def unit(self, j: int, end: str) -> tuple[tuple[str, str], int]:
        """Money before a number or per cent behind it, from the word that follows."""
        if not end and self.percent(j):
            return ("", "%"), j + self.percent(j)
        if not end and self.at(j) in MONEY:
            return (MONEY[self.at(j)], ""), j + 1
        return ("", ""), j


def _ordinal(n: int) -> str:
    return "th" if 10 < n < 20 else {1: "st", 2: "nd", 3: "rd"}.get(n % 10, "th")


def figures(words: list[str]) -> list[str]:
    """The words with all numbers as figures."""
    reader, out, i = _Reader(words), [], 0
    while i < len(words):
        w = words[i]
        sign = SIGNS.get(w, "") if reader.spoken(i + 1) or reader.at(i + 1)[:1].isdigit() else ""
        if sign:
            i += 1
            w = words[i]
        shape = None if w.isdigit() else _FIGURE.fullmatch(w)
        if shape:
            # a figure with a point, a money sign or an ending
            value, j = (shape[2], i + 1) if shape[3] else reader.scaled(shape[2], i + 1)
            unit, j = ((shape[1], shape[3] or ""), j) if shape[1] or shape[3] else reader.unit(j, "")
            out.append(f"{sign}{unit[0]}{value}{unit[1]}")
            i = j
        elif w.isdigit() or reader.spoken(i):
            found, i = reader.number(i)
            out += [*found[:-1], sign + found[-1]] if len(found) == 1 else [sign + found[0], *found[1:]]
        else:
            out.append(w)
            i += 1
    return out


def _money(text: str) -> str:
    """Whole amounts and cents that stand together as one amount; amounts below one as cents; a lone 1 as a word."""
    text = re.sub(r"([€£$])(\d+) (?:and )?¢(\d{1,2})\b", lambda m: f"{m[1]}{m[2]}.{int(m[3]):02d}", text)
    text = re.sub(r"[€£$]0\.(\d{1,2})\b", lambda m: f"¢{int(m[1])}", text)
    return re.sub(r"\b1(s?)\b", r"one\1", text)


# British words by what changes in them; other forms of a word follow its ending.
_OUR = "arbour ardour armour behaviour candour clamour colour demeanour dishonour enamour endeavour favour fervour flavour harbour honour humour labour misdemeanour neighbour odour parlour rancour rigour rumour saviour savour splendour succour tumour valour vapour vigour".split()
_RE = "calibre centre fibre litre lustre meagre metre kilometre centimetre millimetre ochre sabre sceptre sepulchre sombre spectre theatre".split()
_LL = "cancel channel counsel dial duel enamel equal fuel funnel jewel label level libel marshal marvel model panel pedal quarrel revel rival shovel signal snorkel spiral total travel tunnel unravel".split()
_OGUE = "analogue catalogue demagogue dialogue epilogue monologue prologue travelogue".split()
_YSE = "analyse catalyse paralyse psychoanalyse".split()
_OTHER = {
    "aeroplane": "airplane", "aluminium": "aluminum", "anaemia": "anemia", "anaesthetic": "anesthetic", "axe": "ax", "cheque": "check", "chequered": "checkered", "cosy": "cozy",
    "defence": "defense", "diarrhoea": "diarrhea", "draught": "draft", "encyclopaedia": "encyclopedia", "enrol": "enroll", "fulfil": "fulfill", "grey": "gray", "haemorrhage": "hemorrhage",
    "instalment": "installment", "jewellery": "jewelry", "judgement": "judgment", "kerb": "curb", "licence": "license", "manoeuvre": "maneuver", "mould": "mold", "moustache": "mustache",
    "offence": "offense", "oesophagus": "esophagus", "paediatric": "pediatric", "plough": "plow", "practise": "practice", "pretence": "pretense", "programme": "program", "pyjamas": "pajamas",
    "sceptic": "skeptic", "sceptical": "skeptical", "skilful": "skillful", "smoulder": "smolder", "storey": "story", "sulphur": "sulfur", "tonne": "ton", "tyre": "tire", "wilful": "willful", "woollen": "woolen", "yoghurt": "yogurt",
}
#: Words in -ise that keep it.
_ISE = set("advertise advise apprise arise braise bruise chastise circumcise comprise compromise concise cruise demise despise devise disguise enfranchise enterprise excise exercise expertise franchise guise improvise incise likewise merchandise noise otherwise poise praise precise premise promise raise revise rise supervise surmise surprise televise treatise wise".split())
_AS_IN_IS = re.compile(r"(\w{3,}?)is(e|ed|es|er|ers|ing|ation|ations)")


def _respelled() -> dict[str, str]:
    """Every form of the listed words."""
    out: dict[str, str] = {}
    for w in _OUR:
        out |= {w + e: w[:-3] + "or" + e for e in ("", "s", "ed", "ing", "able", "ful", "less", "ite", "ites", "er", "ers", "ably", "hood", "hoods", "ed", "y")}
    for w in _RE:
        out |= {w: w[:-2] + "er", w + "s": w[:-2] + "ers", w + "d": w[:-2] + "ered"}
    for w in _LL:
        out |= {w + "l" + e: w + e for e in ("ed", "ing", "er", "ers", "or", "ors", "ings")}
    for w in _OGUE:
        out |= {w + e: w[:-2] + e for e in ("", "s")}
    for w in _YSE:
        out |= {w[:-1] + e: w[:-2] + "z" + e for e in ("e", "ed", "es", "er", "ers", "ing")}
    for w, to in _OTHER.items():
        out |= {w: to, w + "s": to + "s"}
    return out


_SPELLING = _respelled()


def spelled(word: str) -> str:
    """The American spelling of a word."""
    if word in _SPELLING:
        return _SPELLING[word]
    if (m := _AS_IN_IS.fullmatch(word)) and m[1] + "ise" not in _ISE and not m[1].endswith(("a", "o", "u", "w", "e")):
        return f"{m[1]}iz{m[2]}"
    return word


def english(text: str | None) -> str | None:
    """The normal form of a text; a null text stays null."""
    if text is None:
        return None
    words = _money(" ".join(figures(_words(text)))).split()
    words = re.sub(r"[.$¢€£](?!\d)|(?<!\d)%", " ", " ".join(map(spelled, words))).split()
    out: list[str] = []
    alone = False
    for w in words:
        letter = len(w) == 1 and "a" <= w <= "z"
        if letter and alone:
            out[-1] += w
        else:
            out.append(w)
        alone = letter
    return " ".join(out)


def english_text(text: Column) -> Column:
    def each(texts: pd.Series) -> pd.Series:
        return pd.Series([english(x) for x in texts], dtype=object)

    return F.pandas_udf(each, "string")(text)
