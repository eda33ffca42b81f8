"""Broken prompt and response pairs (problem 1).

Each response is held against its prompt and gets at most one defect, the first
that applies of empty, refusal, copy, other_language, truncated:

* copy: a suffix automaton of the prompt is traversed by the response; the
  share of the response covered by matches says how much of it is copied;
* refusal: automata over refusal and courtesy phrases mark the response's
  sentence units; a response of such units alone is a refusal;
* truncated: delimiter stacks find formulas, brackets and code blocks left
  open, rules on the last unit find words, sentences and announcements that
  break off;
* other_language: stopword and script votes of the units, weighed by letters.

Defined results for odd inputs: a null or blank response is ``empty`` whatever
its prompt; a response without prompt (null or unknown sample) cannot be a copy
or in another language; repeated rows of a trace count once, the one stored
last decides; prompts and responses are used whole, of any length.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.languages import expected_language, other_language
from spanloom.llm.sentences import (
    CLOSING_EN,
    INSIDE_DE,
    INSIDE_EN,
    INSIDE_ES,
    INSIDE_FR,
    INSIDE_RU,
    REFERENCES_EN,
    TITLES_EN,
    TITLES_ES,
    TITLES_FR,
    sentence_spans,
)
from spanloom.partitions import joined, spread

# --------------------------------------------------------------------------
# Placeholder words, refusal and courtesy phrases (lower case).
# --------------------------------------------------------------------------
PLACEHOLDERS = "null none nil nan n/a na undefined empty todo tbd blank void placeholder missing no_answer no-answer"
REFUSALS = [
    "can't help", "cannot help", "can not help", "unable to help", "can't assist", "cannot assist", "unable to assist",
    "can't answer", "cannot answer", "unable to answer", "not able to", "won't be able", "will not be able", "can't provide",
    "cannot provide", "unable to provide", "can't solve this", "cannot solve this", "can't work on", "cannot work on",
    "can't do that", "cannot do that", "can't comply", "cannot comply", "can't fulfill", "cannot fulfill", "have to decline",
    "must decline", "decline to", "i decline", "must not work", "must not answer", "rather not", "not be appropriate",
    "wouldn't be appropriate", "outside what i", "outside the scope", "beyond what i", "beyond the scope", "do not allow me",
    "don't allow me", "does not allow me", "not allowed to", "not permitted to", "am not permitted", "refuse to",
    "kann nicht helfen", "nicht helfen", "kann ich nicht", "nicht beantworten", "darf ich leider nicht", "darf ich nicht",
    "leider nicht bearbeiten", "nicht in der lage", "muss ich ablehnen", "nicht erlaubt",
    "ne peux pas", "impossible de", "ne suis pas en mesure", "pas autorisé", "refuser de", "dois décliner", "ne puis",
    "no puedo", "no me está permitido", "no me es posible", "no estoy autorizad", "no podré", "debo rechazar", "me niego",
    "не могу помочь", "не могу ответить", "не разрешено", "не имею права", "вынужден отказ", "не в состоянии", "не смогу",
    "无法回答", "无法帮助", "不能回答", "无法提供", "超出了我", "不能帮", "拒绝回答", "无法协助",
    "お答えできません", "お手伝いできません", "回答できません", "応じられません", "お応えできません", "対応できません", "許可されていません",
    "सहायता नहीं कर", "मदद नहीं कर", "उत्तर नहीं दे", "अनुमति नहीं", "जवाब नहीं दे",
    "لا أستطيع", "لا يمكنني", "غير مسموح", "لا يسمح لي", "أعتذر عن",
    "ไม่สามารถตอบ", "ไม่สามารถช่วย", "ไม่ได้รับอนุญาต", "ตอบคำถามนี้ไม่ได้", "ช่วยไม่ได้",
]
COURTESIES = [
    "thank you", "thanks for", "i'm sorry", "i am sorry", "sorry,", "apologi", "unfortunately", "i understand", "you are asking", "you're asking",
    "please ask", "consult", "feel free", "would you like", "anything else", "better source", "different question",
    "another question", "happy to help", "hope you", "as an assistant", "as an ai", "qualified", "a specialist", "great question", "good question",
    "es tut mir leid", "leider", "danke", "vielen dank", "entschuldigung", "bitte wende", "gerne", "verständnis",
    "désolé", "merci", "malheureusement", "veuillez", "compréhension", "n'hésitez pas",
    "lo siento", "gracias", "por desgracia", "lamentablemente", "consulte", "comprensión", "disculp",
    "извините", "к сожалению", "спасибо", "простите", "обратитесь", "сожалею",
    "抱歉", "对不起", "谢谢", "感谢", "请咨询", "很遗憾",
    "申し訳", "すみません", "ありがとう", "残念ながら", "ご了承",
    "क्षमा करें", "माफ़", "धन्यवाद", "खेद",
    "عذرا", "آسف", "شكرا", "للأسف", "نعتذر",
    "ขออภัย", "ขอบคุณ", "เสียใจ",
]
#: Words a complete Thai unit may end with.
THAI_ENDINGS = "ได้ กัน พอดี เท่าใด ใด ไร หรือไม่ ไม่ แล้ว ครับ ค่ะ คะ ลง ขึ้น เดียว เปลี่ยน ถูกต้อง ทดลอง กำหนด ข้าง กรัม กระบอก เมตร ลิตร บาท นาที ชั่วโมง วินาที วัน ปี องศา หน่วย นี้ นั้น ด้วย เลย คำถาม คำตอบ ผิด ถูก มาก น้อย เอง อยู่ ไป มา"

#: Least share of the response that matches the prompt, and of the prompt's length that the matches amount to.
COPY_RESPONSE_SHARE = 0.75
COPY_PROMPT_SHARE = 0.5
#: Most of a refusal's letters that neither refuse nor are courtesies.
REFUSAL_REST = 0.34
#: A response is in a language if more of its letters than this are.
LANGUAGE_SHARE = 0.5

_NOT_TEXT = regex.compile(r"</?[\p{L}_][^<>]*/?>|<!--.*?-->|&[a-z]+;", regex.S)
_NOTHING = regex.compile(r"[\s\p{P}\p{S}\p{Cf}\p{Cc}\p{Zs}⠀ㅤᅟᅠ]*\Z")
_KEPT, _KEPT_LAST = regex.compile(r"[^\s\p{Cf}\p{P}\p{S}]"), regex.compile(r"(?r)[^\s\p{Cf}\p{P}\p{S}]")


def _automaton(phrases: list[str]) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for p in phrases:
        a.add_word(p, p)
    a.make_automaton()
    return a


_REFUSAL, _COURTESY = _automaton(REFUSALS), _automaton(COURTESIES)


def _has(a: ahocorasick.Automaton, text: str) -> bool:
    return next(a.iter(text), None) is not None


def is_empty(text: str | None) -> bool:
    if text is None:
        return True
    rest = _NOT_TEXT.sub("", text)
    if _NOTHING.match(rest):
        # marks alone are nothing; a lone formula or tick with a number is no such text
        return True
    first, last = _KEPT.search(rest), _KEPT_LAST.search(rest)
    return (rest[first.start() : last.end()] if first else "").casefold() in PLACEHOLDERS.split()


def is_refusal(text: str, units: list[tuple[int, int]]) -> bool:
    low = text.lower().replace("’", "'")
    if len(low) != len(text) or not _has(_REFUSAL, low):
        if len(low) == len(text):
            return False
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text).replace("’", "'")
    refusals, total, rest = 0, 0, 0
    for s, e in units:
        total += e - s
        unit = low[s:e]
        if _has(_REFUSAL, unit):
            refusals += 1
        elif not _has(_COURTESY, unit):
            rest += e - s
    return refusals > 0 and rest <= REFUSAL_REST * total


# -- copies -----------------------------------------------------------------
class SuffixAutomaton:
    """Automaton of all substrings of one string."""

    def __init__(self, s: str):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.len = [-1], [0]
        last = 0
        for c in s:
            cur = len(self.next)
            self.next.append({})
            self.len.append(self.len[last] + 1)
            self.link.append(0)
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = cur
                p = self.link[p]
            if p >= 0:
                q = self.next[p][c]
                if self.len[p] + 1 == self.len[q]:
                    self.link[cur] = q
                else:
                    clone = len(self.next)
                    self.next.append(dict(self.next[q]))
                    self.len.append(self.len[p] + 1)
                    self.link.append(self.link[q])
                    while p >= 0 and self.next[p].get(c) == q:
                        self.next[p][c] = clone
                        p = self.link[p]
                    self.link[q] = self.link[cur] = clone
            last = cur

    def covered(self, t: str, least: int, wanted: float = 0.0) -> int:
        """Characters of t that lie in matches of at least so many characters.

        Stops with a number below ``wanted`` as soon as too many characters lie
        outside of matches for it to be reached.
        """
        spare = len(t) - wanted
        state = n = total = 0
        done = 0  # t[:done] is counted
        nxt, link, length = self.next, self.link, self.len
        for i, c in enumerate(t):
            to = nxt[state].get(c)
            if to is None:
                while state and to is None:
                    state = link[state]
                    to = nxt[state].get(c)
                n = length[state]
                if i - n - total > spare:  # what lies before the match is settled
                    return total
                if to is None:
                    n = 0
                    continue
            state = to
            n += 1
            if n >= least:
                start = i + 1 - n
                total += i + 1 - (start if start > done else done)
                done = i + 1
        return total


_KEEP = regex.compile(r"[^\p{L}\p{N}\p{M}]+")
_ASCII_REST = bytes(c for c in range(128) if not chr(c).isalnum())


def _plain(text: str) -> str:
    """Letters and digits, without case."""
    if text.isascii():
        return text.lower().encode().translate(None, _ASCII_REST).decode()
    return _KEEP.sub("", text.casefold())


class _Prompts:
    """Automata and languages of prompts that were met, as far as all of them hold at most so many letters."""

    def __init__(self, letters: int = 1 << 20):
        self.most, self.letters, self.known = letters, 0, {}

    def get(self, question: str) -> tuple[int, SuffixAutomaton, str | None]:
        got = self.known.get(question)
        if got is None:
            q = _plain(question)
            got = len(q), SuffixAutomaton(q), expected_language(question)
            if self.letters + len(q) > self.most:
                self.known, self.letters = {}, 0
            self.known[question] = got
            self.letters += len(q)
        return got


_PROMPTS = _Prompts()


def is_copy(text: str, question: str | None) -> bool:
    if not question:
        return False
    n, automaton, _ = _PROMPTS.get(question)
    if n < 4:
        return False
    plain = _plain(text)
    if not plain:
        return False
    matched = automaton.covered(plain, max(4, min(12, n // 5)), COPY_RESPONSE_SHARE * len(plain))
    return matched >= COPY_RESPONSE_SHARE * len(plain) and matched >= COPY_PROMPT_SHARE * n


# -- truncation -------------------------------------------------------------
_FENCE = regex.compile(r"^\s*(?:```|~~~)", regex.M)
_END = regex.compile(r"[.!?。！？।॥؟۔…‥](?:[\"'”’“»)\]」』】〉》）*_`›]|\s»|\$)*\Z")
_ABBREVIATION_END = regex.compile(
    r"(?<![\p{L}\p{N}.])(?<!\d\s?)(?:(?i:"
    + "|".join(regex.escape(w) for w in {*TITLES_EN.split(), *REFERENCES_EN.split(), *INSIDE_EN.split(), *TITLES_ES.split(), *"bzw ca vgl z.B d.h z d Nr Abb aprox pág núm fig Mme c.-à-d c.-à рис табл т.е т г د डॉ".split()} - {"l", "ll"})
    + r")|M)\.\Z"
)
_UNIT = r"(?:\s?(?:[\p{Latin}\p{Greek}\p{Cyrillic}°%µΩ€$£¥]{1,12}(?:[/·^]?[\p{Latin}\d]{1,4}){0,3}|\p{Lo}{1,4}))?"
_NUMBER = r"[-−+±~≈]?\s?\d[\d.,/\s]*(?:[eE][-+]?\d+)?"
_RESULT = regex.compile(
    rf"\s*(?:(?:[-*•>✓✔☑=→⇒∴]|\*\*|__|\#+)\s?)*(?:(?:\p{{L}}[\p{{L}}\s]{{0,40}}[:：]|[\p{{L}}][\w{{}}]{{0,6}}\s?[=≈])\s*)?(?:\*\*|__)?{_NUMBER}{_UNIT}(?:\s?\((?:rounded|approx|gerundet|arrondi)[^()]*\))?(?:\*\*|__)?\s*\Z"
)
_CHOICE = regex.compile(r"(?:^|[\s:：*(])\(?[A-Ea-e0-9]\)(?:\*\*)?\Z|(?:answer|antwort|réponse|respuesta|ответ|答案|答え|option|choice)\b?\s*(?:is|:|：|=)?\s*\**\(?[A-E]\)?\**\Z", regex.I)
_MARK_END = regex.compile(r"(?:\b(?:QED|q\.e\.d|qed|wzbw|CQFD|End|END|Done|EOF)\b\.?|[∎■□▪◼✓✔☑✅]|\\(?:blacksquare|qed|square)\$?|</?[a-z_]+>)\Z")
_BOX = regex.compile(r"\\(?:boxed|fbox|framebox)\{")
_HEADING = regex.compile(r"\s*(?:#{1,6}\s|\*\*[^*]+\*\*:?\s*\Z|__[^_]+__\s*\Z|(?:step|part|case|schritt|teil|étape|paso|шаг|часть)\s+[\dIVX]+\s*:?\s*\Z)", regex.I)
_ANNOUNCES = regex.compile(r"[:：,，、;；—–(\[{“„«「=+*/^<>\\-]\s*(?:\*\*|\$)?\Z")
_LIST_ITEM = regex.compile(r"\s*(?:\\?[-*•+]|\(?\d{1,3}[.)]|\(?[a-zA-Z][.)])\s+\S")
_EQUATION = regex.compile(r"\s*(?!.*\p{L}{4})[\p{L}\d({\\][^\p{Lo}]{0,80}=[^\p{Lo}]{0,80}[\p{L}\d)}\]]\s*\Z")
_THAI = regex.compile(r"[฀-๿]")
_THAI_DONE = regex.compile("(?:" + "|".join(THAI_ENDINGS.split()) + r")\Z")
_PAIRS = {")": "(", "]": "[", "}": "{", "）": "（", "」": "「", "』": "『", "】": "【", "》": "《", "”": "“"}
_CODE = regex.compile(r"^[^\S\n]*(```|~~~).*?^[^\S\n]*\1[^\n]*$", regex.M | regex.S)
_BLOCK = regex.compile(r"\\\\|\\[\[\]()$]|\\(begin|end)\{([^{}]*)\}|\$\$")
_BLANK = regex.compile(r"(?:\r\n?|\n)[^\S\r\n]*(?:\r\n?|\n)")
_BRACE = regex.compile(r"\\.|[{}]", regex.S)
_BRACKET = regex.compile(r"\\.|[()\[\]{}（）「」『』【】《》“”]", regex.S)
_OPENERS = set(_PAIRS.values())


def _open_delimiters(line: str) -> bool:
    """Whether brackets or formulas of a line are left open."""
    stack: list[str] = []
    i, n = 0, len(line)
    formula: str | None = None
    while i < n:
        two = line[i : i + 2]
        if two in ("\\(", "\\["):
            formula = two
            i += 2
        elif two in ("\\)", "\\]"):
            formula = None
            i += 2
        elif two == "$$":
            formula = None if formula == "$$" else "$$"
            i += 2
        elif line[i] == "\\":
            i += 2
        elif line[i] == "$":
            if formula == "$":
                formula = None
            elif formula is None and (i + 1 < n or True):
                formula = "$"
            i += 1
        else:
            c = line[i]
            if c in _OPENERS:
                stack.append(c)
            elif c in _PAIRS:
                if stack and stack[-1] == _PAIRS[c]:
                    stack.pop()
            i += 1
    return bool(stack) or formula is not None


def _no_code(text: str, filler: str = "") -> str:
    return _CODE.sub(filler, text) if "```" in text or "~~~" in text else text


def _open_blocks(text: str) -> bool:
    """Whether a formula or an environment that may run over lines is left open, code aside."""
    environments: Counter[str] = Counter()
    formula = ""
    for m in _BLOCK.finditer(_no_code(text)):
        mark = m.group()
        if m.group(2):
            environments[m.group(2)] = max(0, environments[m.group(2)] + (1 if m.group(1) == "begin" else -1))
        elif mark in ("\\[", "\\("):
            formula = mark
        elif mark in ("\\]", "\\)"):
            formula = ""
        elif mark == "$$":
            formula = "" if formula == "$$" else "$$"
    return bool(formula) or any(environments.values())


def _open_bracket(text: str) -> bool:
    """Whether a bracket of the last paragraph is left open; half-open intervals close as well."""
    paragraph = _BLANK.split(_no_code(text, "\n\n"))[-1]
    stack: list[str] = []
    for m in _BRACKET.finditer(paragraph):
        c = m.group()
        if c in _OPENERS:
            stack.append(c)
        elif c in _PAIRS and stack and (stack[-1] == _PAIRS[c] or c in ")]" and stack[-1] in "(["):
            stack.pop()
    return bool(stack)


def _closing_box(text: str) -> bool:
    """Whether the last box of a text is closed on its last line."""
    boxes = list(_BOX.finditer(text)) if "box" in text else []
    depth = 0
    for m in _BRACE.finditer(text, boxes[-1].end() - 1) if boxes else ():
        depth += {"{": 1, "}": -1}.get(m.group(), 0)
        if not depth:
            return not regex.search(r"[\n\r]", text[m.end() :])
    return False


def is_truncated(text: str, units: list[tuple[int, int]]) -> bool:
    body = text.rstrip()
    if not units:
        return False
    if ("```" in body or "~~~" in body) and len(_FENCE.findall(body)) % 2:
        return True
    if "<think>" in body and "</think>" not in body:
        return True
    start, end = units[-1]
    last = text[start:end]
    line = body[max(body.rfind("\n"), body.rfind("\r")) + 1 :]
    if regex.fullmatch(r"\s*(?:```|~~~)\s*", line):
        return False
    if _open_blocks(body) or _open_delimiters(last) or _open_bracket(body):
        return True
    if _closing_box(body) and regex.search(r"\}\$*[.。]?\**\Z", line):
        return False
    if _MARK_END.search(line):
        return False
    if _HEADING.match(line):
        return not _RESULT.match(line) or bool(regex.match(r"\s*(?:step|part|case)\b", line, regex.I))
    if _ANNOUNCES.search(line):
        return True
    if _RESULT.match(line) or _RESULT.match(last) or _CHOICE.search(line):
        return False
    if _END.search(line):
        return bool(_ABBREVIATION_END.search(line)) or bool(regex.match(r"\s*\\?(?:\d{1,3}|[a-z])[.)]\Z", line))
    if line.endswith("$") or line.endswith("\\)") or line.endswith("\\]"):
        return False
    if regex.fullmatch(r"\s*\|.*\|\s*", line):
        return False
    if _THAI.search(last):
        return not (last[-1].isdigit() or last[-1] in ")%”" or _THAI_DONE.search(last))
    if _EQUATION.match(line) and not _LIST_ITEM.match(line):
        return False
    return True


def defect(question: str | None, response: str | None) -> str | None:
    """Defect type of one pair, or None."""
    if is_empty(response):
        return "empty"
    units = sentence_spans(response)
    if is_refusal(response, units):
        return "refusal"
    if is_copy(response, question):
        return "copy"
    expected = _PROMPTS.get(question)[2] if question else None
    if expected and other_language([response[s:e] for s, e in units], expected, LANGUAGE_SHARE):
        return "other_language"
    return "truncated" if is_truncated(response, units) else None


_OUT = pa.schema([("rtrace_id", pa.string()), ("stored_at", pa.timestamp("us", tz="UTC")), ("defect", pa.string())])


def _defects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [defect(q, r) for q, r in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
        yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.string()), b.column(3).cast(_OUT.field(1).type), pa.array(found, pa.string())], schema=_OUT)


def broken_pairs(samples: DataFrame, traces: DataFrame) -> DataFrame:
    """(rtrace_id, defect) of each trace with a defect.

    Prompts are sent to the traces, so no text of a trace is shuffled, unless
    they are measured to be too large; a sample that holds a large part of all
    traces is then dealt over parts.  Traces are judged row by row and repeated
    rows are settled on the verdicts.  Traces with null id are left out; of rows
    of one id the one stored last decides, a null time counting as the earliest.
    """
    prompts = samples.where("id IS NOT NULL").select(F.col("id").alias("_sample"), "question").groupBy("_sample").agg(F.max("question").alias("question"))
    rows = spread(traces.where("id IS NOT NULL").select("id", F.col("sample_id").alias("_sample"), "rt", "stored_at"))
    pairs = joined(rows, prompts, ["_sample"], F.col("id"), F.octet_length("question") + 64, "left").select("id", "question", "rt", "stored_at")
    verdicts = pairs.mapInArrow(_defects, "rtrace_id string, stored_at timestamp, defect string")
    return (
        verdicts.groupBy("rtrace_id")
        .agg(F.max(F.struct("stored_at", "defect"))["defect"].alias("defect"))
        .where("defect IS NOT NULL")
    )
