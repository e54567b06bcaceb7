"""Broken prompt and response pairs: empty, copied, refusing, foreign or truncated answers and reasonings.

A suffix automaton of the prompt's words measures how much of a response is copied runs; an automaton of refusal phrases
finds refusals; stop words of five languages vote on the language of both texts; a delimiter stack and the shape of the
ending find responses that stop early.  Each record is judged alone, so the pass needs no shuffle.
"""

from __future__ import annotations

import json
import re
import unicodedata

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..workspace import spread

DEFECTS = ("empty", "copy", "refusal", "other_language", "truncated")
#: Shortest copied run that counts, in words, and least share of a copy's words in such runs.
RUN, COVERED = 4, 0.85
#: Least length of a copy, as a share of the prompt's words.
COPY_LENGTH = 0.5

#: Placeholders for an answer, folded, without punctuation (fixed values).
PLACEHOLDERS = frozenset("n/a|na|nan|null|none|nil|tbd|todo|blank|empty|undefined|missing|not available|no answer|answer|response|antwort|respuesta|reponse|tra loi|placeholder|pending|to be determined|to be added|xxx|lorem ipsum".split("|"))

#: Phrases by which a response declines, folded to ASCII and lower case (fixed values).
REFUSALS = (
    "can't help with|cannot help with|can not help with|can't assist|cannot assist|unable to assist|not able to assist|not able to provide|unable to provide medical|cannot provide medical|can't provide medical"
    "|cannot provide an answer|can't provide an answer|i cannot answer|i can't answer|i am unable to answer|i'm unable to answer|unable to say which|i must decline|decline to answer|have to decline|request declined|request denied"
    "|not allow me to|won't be able to|will not be able to answer|as a language model|as an ai|have to pass on this|no answer can be given|inappropriate for me to|rather not comment|rather not answer|prefer not to answer"
    "|do not feel comfortable|don't feel comfortable|not comfortable recommending|outside what i'm permitted|outside what i am permitted|not permitted to|is restricted|cannot make treatment decisions|cannot give medical|can't give medical|consult a qualified professional|please consult a|please speak to a|is the right person to ask|seek professional advice"
    "|kann ich leider nicht|leider nicht beantworten|kann ich keine|kann ich nicht beantworten|darf ich keine|darf ich nicht|als sprachmodell|mochte ich mich nicht|nicht aussern|wenden sie sich an|keine medizinische auskunft"
    "|no puedo ofrecer|no puedo dar|no puedo responder|no puedo ayudar|no puedo recomendar|no me es posible|no me esta permitido|no debo recomendar|como modelo de|prefiero no|no estoy autorizad|consulte con su|consulte a su|consulte a un"
    "|je ne peux pas|je ne suis pas en mesure|il m'est impossible|en tant que modele|je ne dois pas|je prefere ne pas|je ne suis pas autorise|adressez-vous a|consultez un|veuillez consulter"
    "|toi khong the|toi khong tra loi|khong the tra loi|toi xin phep khong|toi khong duoc phep|la mot mo hinh ngon ngu|vui long hoi|xin loi, toi|hay hoi y kien|toi khong dua ra"
).split("|")

#: Stop words that tell the languages apart, folded (fixed values).
STOPWORDS = {
    "en": "the was were is are has had by which that and from for not than did when unless over those while been be this there these it its as did more most who what how should would after before because between during".split(),
    "de": "der das und ist nicht mit von bei nach dem den ein eine einer einem einen wurde wurden fuhrt zu fur auf zwischen unter uber wahrend ohne dass wird sich zur zum ob oder kann blieb welche welcher welches auch aus nur sehr noch gegen hatte haben sind eines wenn seit".split(),
    "es": "el los las del que y con por para una fue fueron mas despues sin se cuando aunque segun todavia como su esta mostro sobre hay ha ser son puede cual al lo pero donde desde tras hasta".split(),
    "fr": "le les est une dans pour avec par du au aux pas ete chez sur et ce qui ont lorsque apres mais il elle cette ses quelle quel ou etaient etait ne selon meme encore depuis lors".split(),
    "vi": "khong cua duoc nguoi benh nhan trong khi dung lieu thuong giam tang dieu hoac nhung truong vung sau moi ngay tuan thang giua nong thuoc dong thoi vay huong voi nhom bang bao cao viec lay mau nao nghi ngo ngoai va cho nay rang".split(),
}
_LANGUAGE = {w: k for k, ws in STOPWORDS.items() for w in ws}

_MARKUP = re.compile("<[^<>]*>|&[a-z]+;|&#\\d+;|[​-‏⁠﻿]", re.I)
_WORD = re.compile(r"[^\W_]+")
_LETTER = re.compile(r"^\W*[A-Ha-h]\W{0,2}$")
_LABEL = re.compile(r"^\s*(?:(?:final )?answer|response|antwort|respuesta|reponse|réponse|tra loi|trả lời|đáp án|a)\s*:\s*", re.I)
_CUT = re.compile(r"\s*(?:…|\.\.\.|\[\s*(?:…|\.\.\.|more|cut|truncated)\s*\]|\(\s*(?:…|\.\.\.|more|cut|truncated|cont\.?|continued)\s*\)|<\s*(?:cut|truncated)\s*>|>{2,})\s*$", re.I)
_END = re.compile(r"[.!?。](?:[\"'”’»)\]]|\s*\[[A-Za-z_]+:\s?[^\[\]\s]+\]|\s*\([^()]{0,60}\))*$")
_SENTENCE = re.compile(r"(?<=[.!?。])\s+|\n+")
_OPEN, _CLOSE = "([{“«", ")]}”»"
_AUTOMATON: list = []


def folded(text: str) -> str:
    """NFKC, lower case, without accents, straight quotes."""
    t = unicodedata.normalize("NFKC", text).lower().replace("’", "'").replace("‘", "'").replace("đ", "d").replace("ß", "ss")
    return t if t.isascii() else "".join(c for c in unicodedata.normalize("NFD", t) if not unicodedata.combining(c))


class SuffixAutomaton:
    """All runs of a word sequence, in states linear in its length."""

    def __init__(self, words):
        self.next, self.link, self.length = [{}], [-1], [0]
        last = 0
        for w in words:
            cur = len(self.next)
            self.next.append({})
            self.link.append(0)
            self.length.append(self.length[last] + 1)
            p = last
            while p >= 0 and w not in self.next[p]:
                self.next[p][w] = cur
                p = self.link[p]
            if p >= 0:
                q = self.next[p][w]
                if self.length[p] + 1 == self.length[q]:
                    self.link[cur] = q
                else:
                    clone = len(self.next)
                    self.next.append(dict(self.next[q]))
                    self.link.append(self.link[q])
                    self.length.append(self.length[p] + 1)
                    while p >= 0 and self.next[p].get(w) == q:
                        self.next[p][w] = clone
                        p = self.link[p]
                    self.link[q] = self.link[cur] = clone
            last = cur

    def covered(self, words, run: int) -> int:
        """Words that lie in a run of at least ``run`` words which the sequence has too."""
        s = size = covered = upto = 0
        for i, w in enumerate(words):
            while s and w not in self.next[s]:
                s = self.link[s]
                size = self.length[s]
            if w in self.next[s]:
                s = self.next[s][w]
                size += 1
            if size >= run:
                covered += i + 1 - max(upto, i + 1 - size)
                upto = i + 1
        return covered


def is_empty(answer: str | None) -> bool:
    """No content: null, blank, markup, punctuation or a placeholder."""
    if answer is None:
        return True
    bare = folded(_MARKUP.sub(" ", answer)).strip()
    core = re.sub(r"^[\W_]+|[\W_]+$", "", bare)
    return not core or core in PLACEHOLDERS


def is_copy(prompt_words: list[str], response_words: list[str]) -> bool:
    n = len(response_words)
    if n < max(RUN, COPY_LENGTH * len(prompt_words)) or not prompt_words:
        return False
    known = set(prompt_words)
    if sum(w in known for w in response_words) < COVERED * n:
        return False
    return SuffixAutomaton(prompt_words).covered(response_words, RUN) >= COVERED * n


def is_refusal(low: str) -> bool:
    """At least half of the sentences of a folded text decline."""
    if not _AUTOMATON:
        import ahocorasick

        a = ahocorasick.Automaton()
        for k, p in enumerate(REFUSALS):
            a.add_word(p, k)
        a.make_automaton()
        _AUTOMATON.append(a)
    if next(_AUTOMATON[0].iter(low), None) is None:
        return False
    parts = [s for s in _SENTENCE.split(low) if len(s) > 1]
    return 2 * sum(next(_AUTOMATON[0].iter(s), None) is not None for s in parts) >= len(parts)


def language(words: list[str]) -> tuple[str | None, float]:
    """The language that most stop words vote for, and its margin; English words of names count little elsewhere."""
    votes = dict.fromkeys(STOPWORDS, 0)
    for w in words:
        k = _LANGUAGE.get(w)
        if k:
            votes[k] += 1
    en = votes.pop("en")
    best = max(votes, key=votes.get)
    rest = sorted(votes.values())[-2]
    v = votes[best]
    if v >= 2 and v >= 0.05 * len(words) and v >= 0.6 * en and v > 1.5 * rest:
        return best, v
    if en >= 2 and v <= 0.2 * en:
        return "en", en
    return None, 0


def _unclosed(text: str) -> bool:
    stack = []
    for ch in text:
        if ch in _OPEN:
            stack.append(_CLOSE[_OPEN.index(ch)])
        elif ch in _CLOSE and stack and stack[-1] == ch:
            stack.pop()
    return bool(stack)


def is_truncated(text: str, short: bool, sound: set[str]) -> bool:
    """Whether the text stops inside a word or sentence.  ``short``: answers that are no sentence are sound."""
    t = (_MARKUP.sub(" ", text) if "<" in text or "&" in text or not text.isascii() else text).strip()
    if not t:
        return False
    if t[0] in "[{":
        try:
            json.loads(t)
            return False
        except ValueError:
            if re.match(r'[\[{]\s*["{\[]', t):
                return True
    body = _LABEL.sub("", t)
    tail = t[-300:]
    cut = _CUT.search(tail)
    if cut:
        rest = tail[: cut.start()].rstrip()
        return bool(rest) and not _END.search(rest)
    if short:
        name = re.sub(r"^\W*[A-Ha-h]\s*[.):]\W*", "", body).strip()
        if _LETTER.match(body) or folded(name).rstrip(".") in sound or folded(body).rstrip(".") in sound:
            return False
    sentence = [x for x in _SENTENCE.split(t) if x.strip()][-1]
    if _END.search(tail):
        return bool(re.search(r"\d\.$", t)) and _unclosed(sentence)  # a number's own point, as in "(p = 0."
    if _unclosed(sentence):
        return True
    words = _WORD.findall(folded(body))
    if short and len(words) <= 12:
        # a name, a dose or a phrase has no verb and starts no sentence
        votes = sum(w in _LANGUAGE and w not in ("the", "and", "after", "for", "by") for w in words)
        names = len(words) <= 9 and votes <= 1 and not (body[:1].isupper() and "," in body)
        if names and not (votes == 1 and len(words) > 6):
            return False
    return True


def judge(question: str | None, answer: str | None, reasoning: str | None, options: list[str] | None) -> tuple[str, str] | None:
    """(field, defect) of the gravest defect, the answer's first."""
    from .text import body

    if is_empty(answer):
        return "answer", "empty"
    part = body(question)
    prompt = _WORD.findall(folded(part))
    whole = prompt if len(part) == len(question or "") else _WORD.findall(folded(question))
    asked = None
    sound = {folded(re.sub(r"^\W*[A-Ha-h]\s*[.):]\W*", "", o)).strip().rstrip(".") for o in options or () if o}
    found = []
    for rank, (field, text) in enumerate((("answer", answer), ("reasoning", reasoning))):
        if not text or not text.strip():
            continue
        low = folded(text)
        words = _WORD.findall(low)
        if not words:
            continue
        if is_copy(prompt, words) or (len(whole) > len(prompt) and is_copy(whole, words)):
            found.append((0, rank, field, "copy"))
        elif is_refusal(low):
            found.append((0, rank, field, "refusal"))
        elif len(words) >= 7 and prompt:
            asked = asked or language(prompt)
            said = language(words)
            if said[0] and asked[0] and said[0] != asked[0] and (said[0] != "en" or said[1] >= 3):
                found.append((0, rank, field, "other_language"))
            elif is_truncated(text, field == "answer", sound):
                found.append((1, rank, field, "truncated"))
        elif is_truncated(text, field == "answer", sound):
            found.append((1, rank, field, "truncated"))
    return min(found)[2:] if found else None


def broken_pairs(records: DataFrame) -> DataFrame:
    """record_id, field, defect of each defective record; at most one a record.

    A null or blank answer is empty; a null or blank reasoning is no case.  A record without question can only be empty,
    refusing or truncated.  Texts are judged whole.  Empty tables give no rows.
    """
    src = spread(
        records.select(
            F.col("record_id").cast("bigint").alias("record_id"),
            *[F.col(c).cast("string").alias(c) for c in ("question", "answer", "reasoning")],
            F.col("options").cast("array<string>").alias("options"),
        )
    )

    def run(batches):
        import pyarrow as pa

        for b in batches:
            ids, field, defect = [], [], []
            for i, q, a, r, o in zip(*(b.column(c).to_pylist() for c in ("record_id", "question", "answer", "reasoning", "options"))):
                got = judge(q, a, r, o)
                if got:
                    ids.append(i)
                    field.append(got[0])
                    defect.append(got[1])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(field, pa.string()), pa.array(defect, pa.string())], ["record_id", "field", "defect"])

    return src.mapInArrow(run, "record_id bigint, field string, defect string")


def defect_counts(records: DataFrame) -> DataFrame:
    """dataset_name, field, defect, n per data set."""
    named = records.select(F.col("record_id").cast("bigint").alias("record_id"), "dataset_name")
    return broken_pairs(records).join(named, "record_id").groupBy("dataset_name", "field", "defect").agg(F.count("*").alias("n"))
