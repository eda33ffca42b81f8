"""Language votes from scripts and stopwords."""

from __future__ import annotations

import re

import regex

# --------------------------------------------------------------------------
# Function words that tell the Latin-script languages apart, and
# names of languages in requests for an answer.
# --------------------------------------------------------------------------
STOPWORDS = {
    "en": "the of and is are was were that this these it its to in for with from by as at be been has have which not we you they would should could can will there if then so an or but what when how does do did i my let",
    "de": "der die das den dem des und ist sind war nicht mit auf für von zu ein eine einen einem einer im am zum zur wird werden sich auch noch bei nach aus wie wenn dass daraus ich wir es um über durch also laut kein statt beide nur",
    "fr": "le la les des du est et une un que qui dans pour pas ne au aux par sur avec se ce cette il elle nous je on sont plus ou donc d'un d'une n'est c'est selon deux mais même leur si puis vaut reste pour",
    "es": "el la los las del de y que es en un una por con no se para su al como más pero lo queda así si hay según esta este son está cada dos después cuando qué cuál ser otra entre sale",
}
LANGUAGE_NAMES = {
    "en": "english englisch anglais inglés английск अंग्रेज़ी अंग्रेजी الإنجليزية อังกฤษ 英語 英语 英文",
    "de": "german deutsch allemand alemán немецк जर्मन الألمانية เยอรมัน ドイツ語 德语 德文",
    "fr": "french französisch français francés французск फ्रेंच फ़्रेंच الفرنسية ฝรั่งเศส フランス語 法语 法文",
    "es": "spanish spanisch espagnol español испанск स्पेनिश الإسبانية สเปน スペイン語 西班牙语",
    "ru": "russian russisch russe ruso русск रूसी الروسية รัสเซีย ロシア語 俄语",
    "zh": "chinese chinesisch chinois chino китайск चीनी الصينية จีน 中国語 中文 汉语",
    "ja": "japanese japanisch japonais japonés японск जापानी اليابانية ญี่ปุ่น 日本語 日语",
    "ar": "arabic arabisch arabe árabe арабск अरबी العربية อาหรับ アラビア語 阿拉伯语",
    "hi": "hindi хинди हिंदी हिन्दी الهندية ฮินดี ヒンディー語 印地语",
    "th": "thai thailändisch thaï tailandés тайск थाई التايلاندية ไทย タイ語 泰语",
}
REQUEST_VERBS = "answer reply respond write antworte antworten schreibe beantworte répondez réponds répondre responde responda contesta contestar conteste ответь ответьте отвечай отвечайте उत्तर जवाब أجب الإجابة ตอบ 答え 回答 答えて 作答"

_SCRIPT = regex.compile(r"(?P<kana>[぀-ヿ])|(?P<han>[㐀-鿿])|(?P<cyr>[Ѐ-ӿ])|(?P<arab>[؀-ۿ])|(?P<deva>[ऀ-ॿ])|(?P<thai>[฀-๿])|(?P<hang>[가-힯])")
_NON_LATIN = regex.compile(r"[ऀ-ॿ฀-๿؀-ۿЀ-ӿ぀-ヿ㐀-鿿가-힯]")
_SCRIPT_LANG = {"cyr": "ru", "arab": "ar", "deva": "hi", "thai": "th", "hang": "ko"}
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
_WORD_LANGS: dict[str, tuple[str, ...]] = {}
for _lang, _words in STOPWORDS.items():
    for _w in _words.split():
        _WORD_LANGS[_w] = (*_WORD_LANGS.get(_w, ()), _lang)
_NO_LETTERS = bytes(c for c in range(128) if not chr(c).isalpha())
_LETTERS = {"de": "äöüß", "fr": "êèçàâîôûœ", "es": "ñ¿¡óíú"}
_LETTER_LANG = {c: lang for lang, cs in _LETTERS.items() for c in cs}
_FORMULA = regex.compile(r"\$\$.*?\$\$|\$[^$\n]*\$|\\\[.*?\\\]|\\\(.*?\\\)|```.*?(?:```|\Z)", regex.S)


def unit_language(text: str) -> str | None:
    """Language of one unit, or None if it has no vote (formulas, numbers, names)."""
    if not text.isascii() and _NON_LATIN.search(text):
        n: dict[str, int] = {}
        for m in _SCRIPT.finditer(text):
            n[m.lastgroup] = n.get(m.lastgroup, 0) + 1
        kana = n.pop("kana", 0)
        han = n.pop("han", 0)
        votes = {_SCRIPT_LANG[k]: v for k, v in n.items()}
        if kana or han:
            votes["ja" if kana * 8 >= han and kana else "zh"] = kana + han
        best = max(votes, key=lambda k: (votes[k], k))
        latin = sum(c.isalpha() for c in text) - sum(votes.values())
        # letters of these scripts stand for more than a Latin one
        if 3 * votes[best] >= latin:
            return best
    votes = dict.fromkeys(STOPWORDS, 0.0)
    low = text.casefold()
    for langs in filter(None, map(_WORD_LANGS.get, _WORD.findall(low))):
        for lang in langs:
            votes[lang] += 1 / len(langs)
    if not low.isascii():
        for c in low:
            if c in _LETTER_LANG:
                votes[_LETTER_LANG[c]] += 0.7
    top = max(votes.values())
    if top < 1:
        return None
    best = [lang for lang, v in votes.items() if v == top]
    return best[0] if len(best) == 1 else None


def _letters(text: str) -> int:
    return len(text.encode().translate(None, _NO_LETTERS)) if text.isascii() else sum(map(str.isalpha, text))


def _vote(unit: str) -> tuple[str | None, int]:
    """Language and weight of a unit, formulas aside; one letter of a dense script counts as three."""
    if "$" in unit or "\\" in unit or "`" in unit:
        unit = _FORMULA.sub(" ", unit)
    lang = unit_language(unit)
    return lang, _letters(unit) * (3 if lang in ("zh", "ja") else 1) if lang else 0


def language_shares(units: list[str]) -> dict[str, float]:
    """Share of each language in the letters of units that have a vote."""
    weights: dict[str, float] = {}
    for u in units:
        lang, weight = _vote(u)
        if lang:
            weights[lang] = weights.get(lang, 0) + weight
    total = sum(weights.values())
    return {k: v / total for k, v in weights.items()} if total else {}


def other_language(units: list[str], expected: str, share: float) -> bool:
    """Whether more than this share of the letters with a vote is in one other language and less than the rest in the expected one.

    Stops where all letters that are left could not change that any more.
    """
    most = [_letters(u) * (1 if u.isascii() else 3) for u in units]
    left = sum(most)
    weights: dict[str, int] = {}
    own = others = 0
    for u, n in zip(units, most):
        lang, weight = _vote(u)
        left -= n
        if lang == expected:
            own += weight
            if own * share >= (others + left) * (1 - share):
                return False
        elif lang:
            others += weight
            weights[lang] = weights.get(lang, 0) + weight
    return bool(weights) and own < (own + others) * (1 - share) and max(weights.values()) > (own + others) * share


_NAMES = [(lang, regex.compile("|".join(regex.escape(w) for w in names.split()))) for lang, names in LANGUAGE_NAMES.items()]
_REQUEST = regex.compile(rf"(?:{'|'.join(regex.escape(v) for v in REQUEST_VERBS.split())})")


def expected_language(question: str | None) -> str | None:
    """The language a question asks for or else is written in."""
    if not question:
        return None
    pieces = [p for p in regex.split(r"(?<=[.?!。？！।؟])\s*|\n+", question) if p.strip()]
    for piece in reversed(pieces):
        low = piece.casefold()
        if _REQUEST.search(low):
            for lang, names in _NAMES:
                if names.search(low):
                    return lang
    shares = language_shares(pieces)
    return max(shares, key=lambda k: (shares[k], k)) if shares else None
