"""Text cut off by field limits or in transfer.

Per source, a log-normal length distribution is fitted by maximum likelihood with right-censoring at each candidate
limit (a length, in characters or UTF-8 bytes, at which more values pile up than chance allows).  The fit gives the
posterior that a value at the limit is censored: the prior of that value; away from limits the prior is the share of
values cut in transfer, which is estimated too.  It is combined with the evidence of the ending by Bayes' rule.

The evidence is a likelihood ratio that is learned from the corpus itself.  Sampled texts are cut at a random place:
these are endings of cut texts.  The endings that the texts really have are a mixture of both kinds, which expectation
maximisation takes apart, with the priors as given.  What an ending is like (a mark, an open bracket, a full stop, a
bare word, ...) is read from the whole last line; how often its words end lines, begin sentences, headlines or closing
lines is counted over all texts and joined to the endings that need it.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from itertools import islice

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import heavy_light_join
from ..workspace import Workspace, spread

#: Texts whose endings train the likelihood ratio (drawn by hash); the only sample, all else covers every text.
SAMPLE = 20_000
#: Distinct strings that a task holds before it hands their counts on.
HELD = 300_000
#: Rows of the limit table that may be broadcast.
LIMIT_ROWS = 50_000
#: Chance, over all lengths of a source, at which a pile still counts as a limit.
CHANCE = 1e-4
#: A cut that steps back to a word's end lies at most so many characters below the limit.
BACK = 3
#: Lengths below a source's greatest length in which cuts at a word's end fall.
WORD = 12

COUNTED = ("inner", "final", "last_line", "sentence_start", "headline_start")
#: Kinds of endings that need no look-up, then those that do.
PLAIN = ("blank", "mark", "mark_word", "mark_after_stop", "open", "stop", "stop_number", "reference", "tags", "ruled", "list_less", "list_arrow")
LOOKED_UP = ("many", "list", "lines", "line")
SIGNS = ("bare", "lower", "long", "code", "step", "label", "short", "digits")
KEYS = ("inner", "final", "inner_shape", "final_shape", "last_line", "last_line_shape", "sentence_start", "headline_start")
#: Marks that are put behind some of the sample's cuts (fixed values).
MARKS = ("…", "...", " …", " ...", " [truncated]", " [...]", "[…]", " (continued)", " <cut>", " [more]", " >>>")

_TAIL = re.compile("(?:<[^<>]*>|&nbsp;|[​﻿\\s])$")
_MARK = re.compile(
    r"(?:…|\.\.\.|\[\s*(?:…|\.\.\.|more|cut|truncated|continued|cont\.?)\s*\]|\(\s*(?:…|\.\.\.|more|cut|truncated|continued|cont(?:'d|\.)?)\s*\)"
    r"|<\s*(?:cut|truncated|more)\s*>|-*[ \t]*(?:read|see|show) more[ \t]*-*|\btruncated|\bcontinued|>{2,}|»{2,})$",
    re.I,
)
_STOPS, _QUOTES = ".!?。！？؟।", "\"'”’»)]」』"
_REFERENCE = re.compile(r"(?:\[[A-Za-z_]+:\s?[^\[\]\s]+\]|\[\d+(?:[,–-]\s?\d+)*\]|\((?:see|siehe|ver|voir|xem)\b[^()]*\))$")
_TAGS = re.compile(r"^(?:#[\w-]+)(?:[ ,]+#[\w-]+)*$")
_RULED = re.compile(r"^(?:[-=*_~]{2,}|\*).*(?:[-=*_~]{2,})$")
_LISTED = re.compile(r"^(?:[-*•–]\s|\d+[.)]\s)|\s[|]\s|\s->\s")
_LABEL = re.compile(r"^[A-Z][a-z]+(?: [a-z]+){0,2}: ")
_STEP = re.compile(r"^(?:[^\W\d_]{3,8}\s*\d+\s*[:.]|[A-Z]{4,}:)\s*")
_DIGITS, _LETTERS = re.compile(r"\d+"), re.compile(r"[^\W\d_]+")
_WORD = re.compile(r"[^\W_]+(?:[-_][^\W_]+)*")
_SPLIT = re.compile(r"(?<=[.!?。])\s+|[\r\n]+")
_OPEN, _CLOSE = "([{“«", ")]}”»"


def start_of(line: str) -> str:
    """First two words, words with digits masked."""
    return " ".join("#" if _DIGITS.search(m[0]) else m[0].lower() for m in islice(_WORD.finditer(line), 2))


def last_word(line: str) -> str:
    """The last run of letters and digits, hyphens and underscores within; found from the end."""
    j = len(line)
    while j and not line[j - 1].isalnum():
        j -= 1
    i = j
    while i and (line[i - 1].isalnum() or (line[i - 1] in "-_" and i > 1 and line[i - 2].isalnum())):
        i -= 1
    return line[i:j]


def trimmed(text: str) -> str:
    """Without white space, tags and invisible characters at the end."""
    t = text.rstrip()
    while t and (t[-1] in ">;​﻿"):
        if t[-1] == ">":
            i = t.rfind("<")
            if i < 0 or ">" in t[i:-1] or _MARK.match(t[i:]):
                break
            t = t[:i].rstrip()
        elif t.endswith("&nbsp;"):
            t = t[:-6].rstrip()
        elif t[-1] == ";":
            break
        else:
            t = t[:-1].rstrip()
    return t


def ends_sentence(t: str) -> bool:
    """Whether a full stop ends the text, with closing quotes and bracketed references behind it."""
    while t:
        if t[-1] in _STOPS:
            return True
        if t[-1] == "]" and (i := t.rfind("[")) >= 0 and "]" not in t[i:-1] and i + 1 < len(t) - 1:
            t = t[:i].rstrip()
        elif t[-1] in _QUOTES:
            t = t[:-1]
        else:
            return False
    return False


def shape(word: str) -> str:
    """The word itself, or the shape of a code with digits: codes of one shape end lines alike."""
    return _LETTERS.sub("A", _DIGITS.sub("#", word)) if _DIGITS.search(word) else word


class Tallies:
    """Counts of strings by name, handed on as (hash, count) rows; no string is left out, however many there are."""

    def __init__(self):
        import xxhash

        self.digest = xxhash.xxh3_64_intdigest
        self.held = {n: Counter() for n in COUNTED}
        self.done: list[tuple[int, int]] = []

    def key(self, name: str, text: str) -> int:
        return self.digest(text.encode("utf-8", "surrogatepass"), COUNTED.index(name)) - (1 << 63)

    def add(self, name: str, texts) -> None:
        held = self.held[name]
        held.update(texts)
        if len(held) > HELD:
            self.flush(name)

    def flush(self, name: str) -> None:
        self.done += [(self.key(name, w), c) for w, c in self.held[name].items()]
        self.held[name].clear()

    def rows(self) -> list[tuple[int, int]]:
        out, self.done = self.done, []
        return out


def _end_keys(lines) -> list[str]:
    w = [last_word(x) for x in lines]
    return w + ["\0" + shape(x) for x in w if shape(x) != x]


def observe(c: Tallies, u: str, lines: list[str], title: str | None) -> None:
    """Add one document's words, line ends and line beginnings; ``u`` is trimmed, ``lines`` its lines that are not blank."""
    words = _WORD.findall(u)
    c.add("inner", words[:-1])  # the last word may be a piece
    c.add("inner", ["\0" + shape(x) for x in words[:-1] if not x.isalpha() and _DIGITS.search(x)])
    if not lines:
        return
    c.add("final", _end_keys(x for x in lines[:-1] if not ends_sentence(x)))
    if len(lines) > 1 and not ends_sentence(lines[-1]):
        start = start_of(_STEP.sub("", lines[-1]))
        c.add("last_line", [start, f"{start}|{shape(last_word(lines[-1]))}"])
    c.add("sentence_start", [start_of(_STEP.sub("", s)) for s in _SPLIT.split(u) if ends_sentence(s)])
    if title and title.strip():
        c.add("final", _end_keys([title]))
        c.add("headline_start", [start_of(title)])
    if len(lines) == 1 and len(u) < 120 and not ends_sentence(u):
        c.add("headline_start", [start_of(u)])
        c.add("final", _end_keys([u]))


def _unclosed(s: str) -> bool:
    """Whether a bracket or quote of the line is still open (a delimiter stack)."""
    stack = []
    for ch in s:
        if ch in _OPEN:
            stack.append(_CLOSE[_OPEN.index(ch)])
        elif ch in _CLOSE and stack and ch == stack[-1]:
            stack.pop()
    return bool(stack)


def _mark(line: str):
    """The match of a mark of a cut at the end of a line, if any."""
    c = line[-1]
    if c in ".…])>»":
        i = {"]": line.rfind("["), ")": line.rfind("("), ">": line.rfind("<") if line[-2:] != ">>" else -1}.get(c, -1)
        i = i if i >= 0 else len(line.rstrip(c)) if c in ">»" else len(line) - 3
        return _MARK.match(line, max(i, 0)) or (_MARK.match(line, len(line) - 1) if c == "…" else None)
    low = line[-12:].lower().rstrip("- ")
    return _MARK.search(line, len(line) - 30 if len(line) > 30 else 0) if low.endswith(("more", "truncated", "continued")) else None


def ending(u: str, lines: list[str], own: bool, tallies: Tallies):
    """(kind, signs, keys, discounts) of how a trimmed text ends.

    signs are read from the last line, keys name the counts to look up (None for kinds that need none), discounts are
    what the text itself added to those counts (``own``: the text as it is, not a trial cut).
    """
    none = ([], None, None)
    if not u or not lines:
        return "blank", *none
    line = lines[-1]
    m = _mark(line)
    if m:
        rest = line[: m.start()].rstrip()
        if not rest or ends_sentence(rest):
            return "mark_after_stop", *none
        return ("mark_word" if m.group().lower() in ("continued", "truncated") else "mark"), *none
    if _unclosed(line) or line[-1] == "\ufffd":  # a bracket, or the bytes of a character
        return "open", *none
    if ends_sentence(line):
        return ("stop_number" if re.search(r"(?:^|[^\w.])\d{1,3}\.$", line[-6:]) else "stop"), *none
    refers = line[-1] in ")]" and _REFERENCE.search(line) is not None
    if refers and (re.search(r"[.!?。]\s*(?:\[[^\[\]]*\]|\([^()]*\)|\s)+$", line) or len(lines) > 1 and not _SPLIT.search(line)):
        return "reference", *none
    if _TAGS.match(line):
        return "tags", *none
    if len(lines) > 1 and _RULED.match(line):
        return "ruled", *none
    listed = bool(_LISTED.search(line))
    if len(lines) > 1 and listed:
        like = [x for x in lines[:-1] if _LISTED.search(x)]
        marks = lambda x: (x.count(" | "), x.count(" -> "), x.count(", ") if x.count(", ") > 1 else 0, "(" in x)
        if like and any(a < b for a, b in zip(marks(line), marks(like[-1]))):
            return "list_less", *none
        if line.endswith(")") and " -> " in line:
            return "list_arrow", *none
    many = not listed and not refers and sum(1 for s in _SPLIT.split(line) if s) > 1
    kind = "many" if many else "list" if len(lines) > 1 and listed else "lines" if len(lines) > 1 else "line"
    w = last_word(line)
    sh, step = shape(w), _STEP.match(line)
    start = start_of(line[step.end() :] if step else line)
    bare = not line[-1].isalnum() and line[-1] not in ")%°\"'”’»]#"
    signs = [float(x) for x in (bare or not w, line[:1].islower(), min(math.log(len(line) + 1) / 7, 1.0), sh != w, step is not None, bool(_LABEL.match(line)) and not step, len(line) < 40, line[-1:].isdigit())]
    k = tallies.key
    keys = [k("inner", w), k("final", w), k("inner", "\0" + sh), k("final", "\0" + sh), k("last_line", start), k("last_line", f"{start}|{sh}"), k("sentence_start", start), k("headline_start", start)]
    alone = own and len(lines) == 1 and len(u) < 120
    after = own and len(lines) > 1
    return kind, signs, keys, [0, int(alone), 0, int(alone), int(after), int(after), 0, int(alone)]


def trial_cut(u: str, seed: int) -> tuple[str, bool, bool] | None:
    """(text cut inside a sentence, word or list entry at a random place, whether a word was left whole, whether marked)."""
    r = random.Random(seed)
    for _ in range(4):
        if len(u) < 16:
            return None
        p = r.randrange(8, len(u) - 1)
        cut = u[:p].rstrip()
        if not cut or u[len(cut) :].lstrip(" \t")[:1] in ("\n", "\r", "") or ends_sentence(cut.splitlines()[-1].strip()):
            continue
        whole = not (cut[-1].isalnum() and u[len(cut)].isalnum())
        if r.random() < 0.15:
            return cut + r.choice(MARKS), whole, True
        return cut, whole, False
    return None


def _chance(pile: float, rate: float) -> float:
    """Upper tail of the Poisson distribution at ``pile``, by the geometric bound of its terms."""
    if pile <= rate:
        return 1.0
    log = -rate + pile * math.log(max(rate, 1e-9)) - math.lgamma(pile + 1)
    return math.exp(min(log, 0.0)) / max(1 - rate / (pile + 1), 1e-3)


def _censored_normal(n: float, s1: float, s2: float, censored: float, at: float) -> tuple[float, float]:
    """Mean and deviation of ``n`` values of sums s1 and s2 and of ``censored`` values above ``at``, by EM."""
    mu, sd, total = s1 / n, 1.0, n + censored
    for _ in range(60):
        z = (at - mu) / sd
        tail = max(0.5 * math.erfc(z / math.sqrt(2)), 1e-12)
        h = math.exp(-z * z / 2) / math.sqrt(2 * math.pi) / tail
        m1, m2 = mu + sd * h, sd * sd * (1 + z * h) + mu * mu + 2 * mu * sd * h
        mu_new = (s1 + censored * m1) / total
        sd_new = math.sqrt(max((s2 + censored * m2) / total - mu_new**2, 1e-4))
        moved = abs(mu_new - mu) + abs(sd_new - sd)
        mu, sd = mu_new, sd_new
        if moved < 1e-6:
            break
    return mu, sd


def fit_limits(lengths, tallies, least: int = 5):
    """[(limit, posterior that a value of that length is censored, how far below it counts)] of one source's histogram.

    Every length with more values than its neighbourhood allows by chance is a candidate, whatever its share of the
    source; so is the source's greatest length with the word's length below it, where cuts step back to a word's end.  For
    each, mean and deviation of the log length are fitted by maximum likelihood (EM) with the pile and all longer values
    as right-censored; the posterior weighs the pile against what the fitted density and the neighbourhood expect.
    """
    import numpy as np

    x, k = np.asarray(lengths, float), np.asarray(tallies, float)
    total = k.sum()
    if total < 2 * least:
        return []
    order = np.argsort(x)
    x, k = x[order], k[order]
    cum = np.concatenate([[0.0], np.cumsum(k)])
    lx = np.log(np.maximum(x, 1.0))
    s1, s2 = np.concatenate([[0.0], np.cumsum(k * lx)]), np.concatenate([[0.0], np.cumsum(k * lx * lx)])
    out = []

    def weigh(i: int, pile: float, c: float, lengths_in: float, expected: float, back: int):
        """``i``: the histogram rows below the pile."""
        if cum[i] < 3:
            out.append((int(c), 0.9 if total - cum[i] - pile < pile else 0.5, back))
            return
        mu, sd = _censored_normal(cum[i], s1[i], s2[i], total - cum[i], math.log(c - lengths_in + 1))
        z = (math.log(c) - mu) / sd
        density = math.exp(-z * z / 2) / (math.sqrt(2 * math.pi) * sd * c) * total * lengths_in
        out.append((int(c), float(min(max((pile - max(density, expected)) / pile, 0.01), 0.995)), back))

    for i in np.flatnonzero((k >= least) & (x >= 16)):
        c, width = x[i], max(5.0, 0.05 * x[i])
        a, b = np.searchsorted(x, [c - width, c + width + 1e-9])
        rate = max((cum[i] - cum[a]) / width, (cum[b] - cum[i + 1]) / width)
        if _chance(k[i], max(rate, 0.2)) <= CHANCE / len(x):
            weigh(i, k[i], c, 1.0, rate, BACK)
    top = x[-1]
    if top >= 4 * WORD and not any(c == int(top) for c, *_ in out):
        i, a = np.searchsorted(x, [top - WORD + 1, top - 4 * WORD + 1])
        pile, expected = total - cum[i], (cum[i] - cum[a]) / 3
        if pile >= 4 * least and _chance(pile, max(expected, 1.0)) <= CHANCE / len(x):
            weigh(i, pile, top, WORD, expected, WORD - 1)
    return out


def _source_limits(lens: DataFrame) -> DataFrame:
    """source, unit, lim, posterior; one row a limit.  Repeated texts count once; every length counts, however long."""
    tall = lens.distinct().select("source", F.explode(F.array(F.struct(F.lit("chars").alias("unit"), F.col("chars").alias("len")), F.struct(F.lit("bytes").alias("unit"), F.col("bytes").alias("len")))).alias("x")).select("source", "x.*")
    hist = tall.groupBy("source", "unit", "len").agg(F.count("*").alias("n"))

    def fit(table):
        import pyarrow as pa

        got = fit_limits(table.column("len").to_pylist(), table.column("n").to_pylist())
        m = len(got)
        return pa.table({"source": pa.array(table.column("source").to_pylist()[:1] * m, pa.string()), "unit": pa.array(table.column("unit").to_pylist()[:1] * m, pa.string()), "lim": pa.array([g[0] for g in got], pa.int64()), "posterior": pa.array([g[1] for g in got], pa.float64()), "back": pa.array([g[2] for g in got], pa.int32())})

    return hist.groupBy("source", "unit").applyInArrow(fit, "source string, unit string, lim bigint, posterior double, back int")


def _docs(documents: DataFrame) -> DataFrame:
    return documents.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("source").cast("string").alias("source"), F.col("title").cast("string").alias("title")
    ).where("text is not null")


_FIELDS = "doc_id bigint, source string, chars bigint, bytes bigint, h bigint, trial boolean, kind string, signs array<double>, keys array<bigint>, own array<int>, key bigint, n bigint"


def _read_texts(docs: DataFrame, rate: float) -> DataFrame:
    """One pass over the texts: a row for each ending, real or trial; and, as rows with a key, the partial counts."""

    def run(batches):
        import pyarrow as pa
        import xxhash

        c = Tallies()
        schema = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("chars", pa.int64()), ("bytes", pa.int64()), ("h", pa.int64()), ("trial", pa.bool_()), ("kind", pa.string()), ("signs", pa.list_(pa.float64())), ("keys", pa.list_(pa.int64())), ("own", pa.list_(pa.int32())), ("key", pa.int64()), ("n", pa.int64())])

        def tally_batch(rows):
            m = len(rows)
            return pa.RecordBatch.from_arrays([*[pa.nulls(m, f.type) for f in list(schema)[:-2]], pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())], schema=schema)

        for b in batches:
            rows = []
            for i, x, s, t in zip(*(b.column(n).to_pylist() for n in ("doc_id", "text", "source", "title"))):
                raw = x.encode("utf-8", "surrogatepass")
                h = xxhash.xxh3_64_intdigest(raw)
                u = trimmed(x)
                lines = [y for z in u.splitlines() if (y := z.strip())]
                observe(c, u, lines, t)
                head = (i, s, len(x), len(raw), h - (1 << 63))
                rows.append((*head, False, *ending(u, lines, True, c)))
                if h < rate * 2.0**64:
                    got = trial_cut(u, h)
                    if got:
                        cut, whole, marked = got
                        kind, signs, keys, own = ending(cut, [y for z in cut.splitlines() if (y := z.strip())], False, c)
                        if own and whole and not marked:
                            own[0] = own[2] = 1
                        rows.append((*head, True, kind, signs, keys, own))
            cols = list(zip(*rows)) or [()] * 10
            m = len(rows)
            yield pa.RecordBatch.from_arrays([*[pa.array(list(col), f.type) for col, f in zip(cols, schema)], pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64())], schema=schema)
            if c.done:
                yield tally_batch(c.rows())
        for name in COUNTED:
            c.flush(name)
        yield tally_batch(c.rows())

    return docs.mapInArrow(run, _FIELDS)


def _looked_up(rows: DataFrame, counts: DataFrame, work: Workspace) -> DataFrame:
    """keys and tallies (array<double>, in the order of KEYS) of each distinct list of keys."""
    lists = work.keep(rows.where("keys is not null").select("keys").distinct(), "lists")
    each = work.keep(lists.select("keys", F.posexplode("keys").alias("pos", "key")), "each")
    got = heavy_light_join(each, counts, ["key"], "left")
    tally = lambda p: F.coalesce(F.max(F.when(F.col("pos") == p, F.col("n"))), F.lit(0)).cast("double")
    return got.groupBy("keys").agg(F.array(*[tally(p) for p in range(len(KEYS))]).alias("tallies"))


WIDTH = len(PLAIN) + len(LOOKED_UP) * (len(SIGNS) + 11)


def features(kinds, signs, tallies, own):
    """A row of WIDTH numbers for each ending: an indicator a plain kind, and a block of signs for each looked-up kind."""
    import numpy as np

    out = np.zeros((len(kinds), WIDTH))
    index = {k: j for j, k in enumerate(PLAIN)}
    block = len(SIGNS) + 11
    for r, (kind, sg, ty, ow) in enumerate(zip(kinds, signs, tallies, own)):
        if kind in index:
            out[r, index[kind]] = 1.0
            continue
        inner, final, inner_s, final_s, last, last_s, sentence, headline = (max(a - b, 0.0) for a, b in zip(ty, ow))
        known, code = inner + final, sg[3] > 0
        if code:
            inner, final = inner_s, final_s
        end = math.log((final + 0.3) / (0.02 * inner + 0.6))
        head = math.log((headline + 0.5) / (0.05 * sentence + 0.5))
        close = math.log((last + 0.5) / (sentence + 0.5))
        usual = math.log((last_s + 0.3) / (0.02 * last + 0.6))
        few = float(known < 1.5)
        at = len(PLAIN) + LOOKED_UP.index(kind) * block
        out[r, at : at + block] = [1.0, *sg, few, few * (not code), min(math.log1p(known), 4.0) / 2, min(max(end, -2.0), 4.0), min(max(head, -2.0), 4.0), min(max(close, -3.0), 4.0), min(max(usual, -1.0), 4.0), float(end > 1), float(head > 1), float(close > 0 and last >= 3)]
    return out


#: Prior log likelihood ratios and how many endings each is worth.  What is cut or whole by its definition is as good as
#: fixed: a mark and an open bracket are cuts, a full stop is none; a sentence behind others lacks its end.  Every other
#: weight starts from 0.
EXPECTED = {"mark": (8.0, 1e4), "open": (8.0, 1e4), "stop": (-8.0, 1e4), "mark_after_stop": (-4.0, 1e4), "stop_number": (-4.0, 2.0), "list_less": (4.0, 2.0), "many": (7.0, 1e4)}


def learn(x, trial, prior, rounds: int = 24, held: int = 8, start: float = 0.2, ridge: float = 0.02):
    """(weights, base rate): log likelihood ratio of cut against whole endings, linear in the features.

    ``trial`` rows are cut.  Of the others each has ``prior``, its censoring posterior (nan: the base rate, to be
    estimated after ``held`` rounds at ``start``).  Expectation: their posteriors.  Maximisation: a ridge logistic regression by Newton steps.
    """
    import numpy as np

    real = ~trial
    mean, ridge = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    for kind, (m, strength) in EXPECTED.items():
        j = PLAIN.index(kind) if kind in PLAIN else len(PLAIN) + LOOKED_UP.index(kind) * (len(SIGNS) + 11)
        if kind in LOOKED_UP:
            ridge[j : j + len(SIGNS) + 11] = 200.0
        mean[j], ridge[j] = m, strength
    w, base = mean.copy(), start
    first = np.log(np.clip(np.where(np.isnan(prior), base, prior), 1e-4, 0.995))
    y = np.where(trial, 1.0, 1 / (1 + np.exp(-(x @ w + first - np.log1p(-np.exp(first))))))
    if not real.any() or not trial.any():
        return w, base
    for round_ in range(rounds):
        ones, zeros = np.where(trial, 1.0, y), np.where(trial, 0.0, 1 - y)
        offset = math.log(max(ones.sum(), 1e-9) / max(zeros.sum(), 1e-9))
        for _ in range(12):
            z = np.clip(x @ w + offset, -30, 30)
            p = 1 / (1 + np.exp(-z))
            weight = (ones + zeros) * p * (1 - p)
            gradient = x.T @ (ones - (ones + zeros) * p) - ridge * (w - mean)
            step = np.linalg.solve((x * weight[:, None]).T @ x + np.diag(ridge + 1e-6), gradient)
            step *= min(1.0, 5.0 / max(np.abs(step).max(), 1e-9))
            w = w + step
            if np.abs(step).max() < 1e-4:
                break
        off = np.isnan(prior)
        for _ in range(30):
            q = np.clip(np.where(off, base, prior), 1e-4, 0.995)
            y = np.where(trial, 1.0, 1 / (1 + np.exp(-np.clip(x @ w + np.log(q / (1 - q)), -30, 30))))
            free = real & off
            if round_ < held:
                break
            new = float(np.clip(y[free].mean(), 1e-3, 0.5)) if free.any() else base
            if abs(new - base) < 1e-6:
                break
            base = new
    return w, base


def score_documents(documents: DataFrame) -> DataFrame:
    """doc_id, source, limit_posterior (0 away from the source's limits), ending (log likelihood ratio), cut, cut_by_ending.

    One row for each document with a text; null texts are no values, blank ones are never cut.  A null source is a
    source of its own.  ``cut``: the posterior odds of prior and ending exceed 1; ``cut_by_ending``: the same with the base
    rate in place of the censoring posterior, to show what the fit decides.  Empty tables give no rows.
    """
    import numpy as np

    spark = documents.sparkSession
    work = Workspace(spark, "cut")
    docs = _docs(documents)
    total = docs.count()
    first = work.keep(_read_texts(spread(docs), min(1.0, SAMPLE / max(total, 1))), "first")
    rows = first.where("key is null").drop("key", "n").withColumn("source_", F.coalesce("source", F.lit("")))
    real = rows.where("not trial")
    limits = work.keep(_source_limits(real.select(F.col("source_").alias("source"), "chars", "bytes", "h")).groupBy("source").agg(F.collect_list(F.struct("unit", "lim", "posterior", "back")).alias("limits")), "limits")
    counts = first.where("key is not null").groupBy("key").agg(F.sum("n").alias("n"))
    tallies = work.keep(_looked_up(rows, counts, work), "tallies")
    # a cut at a word's end lies a little below the limit
    hit = F.aggregate(
        F.coalesce("limits", F.array().cast("array<struct<unit:string,lim:bigint,posterior:double,back:int>>")),
        F.lit(0.0),
        lambda acc, x: F.greatest(acc, F.when(F.when(x["unit"] == "chars", F.col("chars")).otherwise(F.col("bytes")).between(x["lim"] - x["back"], x["lim"]), x["posterior"]).otherwise(0.0)),
    )
    by_source = limits.withColumnRenamed("source", "source_")
    if limits.limit(LIMIT_ROWS + 1).count() <= LIMIT_ROWS:
        placed = rows.join(F.broadcast(by_source), "source_", "left")
    else:
        placed = heavy_light_join(rows, by_source, ["source_"], "left")
    placed = work.keep(placed.withColumn("limit_posterior", hit).drop("limits", "source_"), "placed")
    joined = work.keep(heavy_light_join(placed, tallies, ["keys"], "left"), "joined")

    pick = ["trial", "kind", "signs", "tallies", "own", "limit_posterior"]
    sample = joined.where(F.col("trial") | (F.shiftrightunsigned(F.col("h").bitwiseXOR(F.lit(-(1 << 63))), 11) < F.lit(min(1.0, SAMPLE / max(total, 1)) * 2.0**53))).select(*pick).collect()
    x = features([r["kind"] for r in sample], [r["signs"] for r in sample], [r["tallies"] for r in sample], [r["own"] for r in sample])
    trial = np.array([r["trial"] for r in sample], bool)
    prior = np.array([r["limit_posterior"] or np.nan for r in sample], float)
    weights, base = learn(x, trial, np.where(prior > 0, prior, np.nan))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            z = features(*(b.column(c).to_pylist() for c in ("kind", "signs", "tallies", "own"))) @ weights
            kinds = np.array(b.column("kind").to_pylist(), object)
            p = b.column("limit_posterior").to_numpy(zero_copy_only=False)
            odds = lambda q: z + np.log(q / (1 - q))  # noqa: E731, B023
            sure = kinds == "blank"
            by_all = (odds(np.where(p > 0, np.clip(p, 0.01, 0.995), base)) > 0) & ~sure
            by_end = (odds(np.full(len(z), base)) > 0) & ~sure
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), pa.array(np.round(p, 6)), b.column("kind"), pa.array(np.round(z, 6)), pa.array(by_all), pa.array(by_end)], ["doc_id", "source", "limit_posterior", "kind", "ending", "cut", "cut_by_ending"])

    return joined.where("not trial").mapInArrow(run, "doc_id bigint, source string, limit_posterior double, kind string, ending double, cut boolean, cut_by_ending boolean")


def cut_share(documents: DataFrame) -> DataFrame:
    """source, n_docs, n_cut, cut_share per source, of documents with a text."""
    s = score_documents(documents)
    return s.groupBy("source").agg(F.count("*").alias("n_docs"), F.count_if("cut").alias("n_cut"), F.round(F.avg(F.col("cut").cast("double")), 6).alias("cut_share"))
