"""Sentence units with offsets, for any language and script (problem 5).

Segmentation is by cascading rule tables.  A rule is a pair of patterns, one
for the text before a position and one for the text after it, and says whether
a unit ends there.  Positions come from end marks (with the quotes and brackets
that close behind them); at each one the tables of the script's languages are
tried in order, between a common table in front and one behind, and the first
rule that matches decides.  Thai, which has no end marks, has its positions at
spaces.  A line break always ends a unit.

Defined results for odd inputs: null and empty texts, and lines of white space
or invisible characters alone, have no units; a text without end marks is one
unit per line; offsets are code points of the text as given, half-open, with no
white space at either end.
"""

from __future__ import annotations

from bisect import bisect_right
from typing import NamedTuple

import regex

# --------------------------------------------------------------------------
# Abbreviations and words the rules refer to.
# --------------------------------------------------------------------------
TITLES_EN = "Mr Mrs Ms Dr Prof St Rev Gen Col Capt Lt Hon Messrs Mt"
REFERENCES_EN = "No Nos Fig Figs Eq Eqs Sec Secs Ch Chs Chap Tab Tabs Vol Art Ref Refs Thm Def Prop Cor App Ex p pp l ll"
INSIDE_EN = "e.g i.e cf vs approx resp viz ca est incl esp"
CLOSING_EN = "etc a.m p.m al Inc Ltd Co Corp Jr Sr"
INSIDE_DE = "z.B d.h u.a u.U o.ä v.a z.T s.o s.u i.d.R bzw ca vgl evtl ggf inkl zzgl sog Nr Abb Tab Kap Abs Bd Dr Prof Hr Fr St Dipl Ing"
CLOSING_DE = "usw usf etc"
MONTHS_DE = "Januar Februar März April Mai Juni Juli August September Oktober November Dezember Jan Feb Mrz Apr Jun Jul Aug Sep Sept Okt Nov Dez"
ORDINAL_BEFORE_DE = "am der die das den dem des im vom zum zur ab bis seit beim ein eine einen jeder jede jedem jeden"
TITLES_FR = "M MM Mme Mmes Mlle Dr Pr Me St Ste Mgr"
INSIDE_FR = "fig figs chap vol art éq eq tab réf sect cf env c.-à-d p.ex éd ex n no p pp av apr"
TITLES_ES = "Sr Sra Srta Sres Dr Dra Dña Ud Uds Lic Ing Prof Profa"
INSIDE_ES = "pág págs fig figs núm aprox art cap ej p.ej ec ecs vol tel máx mín cf vs tab"
INSIDE_RU = "т.е т.к т.н т.о рис табл стр напр проф акад ул им тыс гл пп разд ур св см г с д п ч т"
CLOSING_RU = "т.д т.п др пр гг руб коп"
INSIDE_AR = "د أ م ص ج ق ت ط رقم أ.د"
INSIDE_HI = "डॉ श्री प्रो पृ सं क्र चित्र स्व"
STARTERS_EN = "The Then This That These Those It In We I So Now Next But And If However Therefore Thus Hence Wait First Okay Actually Hmm Alright At For A An As"
CONTINUES_EN = "the and or on in of at to until till but that is are was were while when for with"

END_MARKS = ".!?。！？．।॥؟۔…‥"
CLOSERS = "\"'”’»)\\]」』】〉》）*_`›"


def _any(words: str) -> str:
    """Alternation of abbreviations; inner full stops may be followed by a space."""
    return "|".join(regex.escape(w).replace(r"\.", r"\.\s?") for w in sorted(words.split(), key=len, reverse=True))


class Rule(NamedTuple):
    breaks: bool
    before: str
    after: str


_W = r"(?<![\p{L}\p{N}_.])"  # an abbreviation starts here
_NOT_AMOUNT = r"(?<!\d\s?)" + _W
_OPEN = r"[\"'“‘«„¿¡(\[「『*]"

COMMON_FIRST = [
    # numbers, versions, file names, dotted abbreviations
    Rule(False, r"\d[.．]$", r"\d"),
    Rule(False, r"[\p{L}\p{N}_)][.．]$", r"[\p{Ll}\d_]"),
    Rule(False, r"(?<!\p{L})\p{L}\.$", r"\p{L}\."),
    # factorials and other operators behind a mark
    Rule(False, r"[\p{N}\p{L})\]]!+$", r"\s?[=/*+^<>≤≥·×]|\s?[-−]\s?\d|\s*\\"),
    # punctuation that goes on
    Rule(False, r".$", r"\s?[,;:%،؛、，；：]|[-‐–]\p{L}"),
    # a list mark at the start of a line
    Rule(False, r"^\s*\\?(?:[-*•+>]\s*)?\(?(?:\d{1,3}|\p{L}|[ivxIVX]{1,4})\.$", r"\s"),
    # an ellipsis within a sentence
    Rule(False, r"(?:\.{2,}|…|‥)[" + CLOSERS + r"]*$", r"\s*\p{Ll}(?!\p{Lu})"),
    Rule(False, r"\p{Lo}(?:\.{3,}|…+|‥+)$", r"\s*[\p{Lo}]"),
    # a quotation that its sentence continues
    Rule(False, r"[.!?。！？…][\"'”’»“‘」』】)]+$", r"\s?[\p{Ll}(,;:–—-](?![\p{Lu}])"),
    Rule(False, r"[.。！？!?][」』]$", r"[ぁ-ゖ]"),
]

ENGLISH = [
    Rule(False, rf"{_NOT_AMOUNT}(?i:{_any(TITLES_EN)})\.$", r"\s*[\p{L}\p{N}\"“$\\]"),
    Rule(False, rf"{_W}(?i:{_any(REFERENCES_EN)})\.$", r"\s*[\d(\[#§$]"),
    Rule(False, rf"{_W}(?i:{_any(INSIDE_EN)})\.$", r"\s*\S"),
    Rule(False, rf"{_W}(?i:{_any(CLOSING_EN)})\.$", rf"\s+(?:\p{{Ll}}(?!\p{{Lu}})|[\d(&]|(?=\p{{Lu}}{{2}})(?i:{_any(CONTINUES_EN)})\b)"),
    Rule(False, rf"(?<=\p{{L}}\s|\p{{Lu}}\.\s?){_W}\p{{Lu}}\.$", rf"\s\p{{Lu}}\p{{Ll}}{{2}}(?<!\b(?:{'|'.join(w[:3] for w in STARTERS_EN.split() if len(w) > 2)}))"),
]
GERMAN = [
    Rule(False, r"(?<![\p{L}\p{N}])(?:[zdusvo]|i|i\.\s?d)\.$", r"\s?(?:B|h|a|ä|U|T|o|u|d|R)\."),
    Rule(False, rf"{_W}(?:{_any(INSIDE_DE)})\.$", r"\s*\S"),
    Rule(False, rf"{_W}S\.$", r"\s*\d"),
    Rule(False, rf"{_W}(?:{_any(CLOSING_DE)})\.$", r"\s+\p{Ll}(?!\p{Lu})"),
    Rule(False, rf"\b(?i:{_any(ORDINAL_BEFORE_DE)})\s\d{{1,3}}\.$", r"\s\p{L}"),
    Rule(False, r"(?<![\d.,])\d{1,2}\.$", rf"\s(?:{_any(MONTHS_DE)})\b"),
]
FRENCH = [
    Rule(False, rf"{_NOT_AMOUNT}(?:{_any(TITLES_FR)})\.$", r"\s?\p{Lu}"),
    Rule(False, rf"{_NOT_AMOUNT}(?:(?i:p|pp|n|no))\.$", r"\s*[\d(]"),
    Rule(False, rf"{_NOT_AMOUNT}(?:(?i:{_any(' '.join(w for w in INSIDE_FR.split() if w not in ('p', 'pp', 'n', 'no', 'ex')))}))\.$", r"\s*\S"),
]
SPANISH = [
    Rule(False, rf"{_NOT_AMOUNT}(?:(?i:{_any(TITLES_ES)}))\.$", r"\s*\S"),
    Rule(False, rf"{_NOT_AMOUNT}(?:(?i:{_any(INSIDE_ES)}))\.$", r"\s*\S"),
]
RUSSIAN = [
    Rule(False, r"(?<![\p{L}])т\.$", r"\s?[екнодп]\."),
    Rule(False, rf"{_NOT_AMOUNT}(?:(?i:{_any(INSIDE_RU)}))\.$", r"\s*\S"),
    Rule(False, rf"{_W}(?:(?i:{_any(CLOSING_RU)}))\.$", r"\s+[\p{Ll}\d]"),
    Rule(False, r"(?<![\p{L}\p{N}])\p{Lu}\.$", r"\s?\p{Lu}(?:\.|\p{Ll})"),
]
ARABIC = [Rule(False, rf"{_NOT_AMOUNT}(?:{_any(INSIDE_AR)})\.$", r"\s*\S")]
HINDI = [Rule(False, rf"(?<![\p{{L}}\p{{M}}\p{{N}}])(?:{_any(INSIDE_HI)})\.$", r"\s*\S")]
CJK = [Rule(True, r"[。！？．][" + CLOSERS + r"]*$", r"\s?\S")]

COMMON_LAST = [
    Rule(False, r"\d\.$", r"\s\p{Ll}{2}"),
    # a lower-case letter goes on, unless a name or a formula is written so
    Rule(True, r".$", r"\s+(?:\p{Ll}\p{Lu}|\p{Ll}\s?[=^]|\p{Ll}\s?[-+*/]\s?\d)"),
    Rule(False, r"\.[" + CLOSERS + r"]*$", r"\s+\p{Ll}"),
    Rule(True, r".$", r"\s"),
    # a unit may follow without a space
    Rule(True, r"[.!?।॥؟۔。！？…]+[" + CLOSERS + r"“]*$", r"[\p{Lu}\p{Lo}" + r"\"“‘«¿¡\[$\\]"),
    Rule(True, r"[!?。！？।॥؟۔]$", r"[\p{L}\p{N}\-−+]"),
    Rule(False, r"", r""),
]
#: In a text of one letter case, case tells nothing.
COMMON_LAST_CASELESS = [
    Rule(False, rf"{_W}(?i:{_any('a.m p.m')})\.$", rf"\s+(?i:{_any(CONTINUES_EN)})\b"),
    Rule(False, rf"{_W}(?i:al)\.$", r"\s"),
    Rule(True, r".$", r"\s"),
    Rule(True, r"[.!?]+[" + CLOSERS + r"“]*$", r"[\p{Lu}\p{Lo}\"“‘«¿¡]"),
    Rule(False, r"", r""),
]

#: Tables of the languages of each script, in the order they are tried.
CASCADES = {
    "latin": [ENGLISH, GERMAN, FRENCH, SPANISH],
    "cyrillic": [RUSSIAN, ENGLISH],
    "arabic": [ARABIC, ENGLISH],
    "devanagari": [HINDI, ENGLISH],
    "cjk": [CJK, ENGLISH, GERMAN, FRENCH, SPANISH],
    "thai": [ENGLISH],
}
_CASELESS_ENGLISH = [r for r in ENGLISH if CLOSING_EN.split()[0] not in r.before and "{Lu}\\.$" not in r.before]


class _Table:
    """A cascade as one pattern: its rules in order, each with an empty group whose number says which one decided.

    Rules see the whole line, back to its start and on to its end.
    """

    def __init__(self, tables: list[list[Rule]], last: list[Rule]):
        rules = [r for t in [COMMON_FIRST, *tables, last] for r in t]
        self.pattern = regex.compile("|".join(f"(?={r.after})(?<={r.before.removesuffix('$')})()" if r.before else f"(?={r.after})()" for r in rules))
        self.ends = [False, *(r.breaks for r in rules)]
        if self.pattern.groups != len(rules):
            raise ValueError("rules may not have groups of their own")

    def breaks(self, line: str, at: int) -> bool:
        m = self.pattern.match(line, at)
        return m is not None and self.ends[m.lastindex]


_CASED = {k: _Table(v, COMMON_LAST) for k, v in CASCADES.items()}
_CASELESS = {k: _Table([_CASELESS_ENGLISH, *v[1:]] if k == "latin" else v, COMMON_LAST_CASELESS if k == "latin" else COMMON_LAST) for k, v in CASCADES.items()}

_LINE = regex.compile(r"[^\n\r\x0b\x0c\x1c-\x1e\x85  ]+")
#: An end mark with what closes behind it; “ and straight quotes close only if no word follows.
_MARK = regex.compile(rf"[{END_MARKS}]+(?:[   ]?[»›]|[”’)\]」』】〉》）*_`]|[\"'“](?![\p{{L}}\p{{N}}]))*")
_MASK = regex.compile(r"\$\$.+?\$\$|\$[^$\n]+\$|\\\(.+?\\\)|\\\[.+?\\\]|`[^`]+`")
_QUOTE = regex.compile(r"“[^“”\n]*”|„[^„“\n]*[“”]|«[^«»\n]*»|「[^「」\n]*」|『[^『』\n]*』|(?<![\p{L}\p{N}])\"[^\"\n]*\"(?![\p{L}\p{N}])")
_GOES_ON = regex.compile(r"\s*[,;:،、，；：]|\s?[\p{Ll}](?!\p{Lu})|[ぁ-ゖ]")
_INVISIBLE = regex.compile(r"[\s\p{Cf}\p{Cc}⠀ㅤᅟᅠ]*\Z")
_THAI = regex.compile(r"[฀-๿]")
_SPACES = regex.compile(r"[ \t 　]+")
_SCRIPTS = [
    ("thai", _THAI),
    ("devanagari", regex.compile(r"[ऀ-ॿ]")),
    ("arabic", regex.compile(r"[؀-ۿ]")),
    ("cjk", regex.compile(r"[぀-ヿ㐀-鿿가-힯]")),
    ("cyrillic", regex.compile(r"[Ѐ-ӿ]")),
]
_ASCII_LINE = regex.compile(r"[\x00-\x7f]*\Z")
_UPPER, _LOWER = regex.compile(r"\p{Lu}"), regex.compile(r"\p{Ll}")
_ASCII_UPPER, _ASCII_LOWER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
_OPERATOR = set("=+*/^<>≤≥×·−")


def _thai_space(text: str, start: int, end: int) -> bool:
    """Whether the space text[start:end] in a Thai line ends a unit."""
    before, after = text[start - 1], text[end]
    if not (_THAI.match(before) or _THAI.match(after)):
        return False
    if before.isdigit() or after.isdigit() or before in _OPERATOR or after in _OPERATOR:
        return False
    if after in "-−" and end + 1 < len(text) and text[end + 1].isdigit():
        return False
    return not (before in "%°" and start > 1 and text[start - 2].isdigit())


def sentence_spans(text: str | None) -> list[tuple[int, int]]:
    """Units of one text as (start, end)."""
    if not text:
        return []
    caseless = not (_UPPER.search(text) and _LOWER.search(text))
    if not caseless and text.isascii():
        caseless = _mostly_one_case(text)
    tables = _CASELESS if caseless else _CASED
    out: list[tuple[int, int]] = []
    for m in _LINE.finditer(text):
        lo, hi = m.span()
        line = m.group()
        if not line.strip() or _INVISIBLE.match(line):
            continue
        if _ASCII_LINE.match(line):
            table = tables["latin"]
            thai = False
        else:
            script = next((name for name, p in _SCRIPTS if p.search(line)), "latin")
            table, thai = tables[script], script == "thai"
        masks = [(a.start(), a.end()) for a in _MASK.finditer(text, lo, hi)] if ("$" in line or "\\" in line or "`" in line) else []
        for q in _QUOTE.finditer(text, lo, hi):
            if q.end() < hi and _GOES_ON.match(text, q.end(), hi):
                masks.append((q.start(), q.end() + 1))
        masks.sort()
        starts = [a for a, _ in masks]
        cuts = []
        for k in _MARK.finditer(text, lo, hi):
            at = k.end()
            if at >= hi:
                break
            if masks and (i := bisect_right(starts, k.start()) - 1) >= 0 and at < masks[i][1]:
                continue
            if text[at].isdigit() and text[at - 1] in ".．" and text[at - 2 : at - 1].isdigit():
                continue
            if table.breaks(line, at - lo):
                cuts.append(at)
        if thai:
            cuts += [k.end() for k in _SPACES.finditer(text, lo, hi) if k.start() > lo and k.end() < hi and _thai_space(text, *k.span())]
            cuts.sort()
        start = lo
        for cut in [*cuts, hi]:
            piece = text[start:cut]
            core = piece.strip()
            if core and not _INVISIBLE.match(core):
                s = start + len(piece) - len(piece.lstrip())
                out.append((s, s + len(core)))
            start = cut
    return out


def _mostly_one_case(text: str) -> bool:
    """Whether an ASCII text is written in one letter case, single letters of formulas aside."""
    letters = text.encode()
    upper = len(letters) - len(letters.translate(None, _ASCII_UPPER))
    lower = len(letters) - len(letters.translate(None, _ASCII_LOWER))
    return upper > 20 * (lower + 1) or lower > 400 * (upper + 1) and lower > 40
