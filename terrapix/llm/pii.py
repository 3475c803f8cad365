"""Personal data by a semi-Markov conditional random field.

Fixed patterns give the base spans. Around every character that could belong to personal data a window of tokens is cut; a
semi-Markov CRF scores candidate segments of at most MAX_TOKENS tokens by features of the whole span (its shape, digits,
checksum, octets, surroundings), and dynamic programming over segment ends chooses boundaries and types together. The model
is trained here on windows whose base spans serve as labels, and on copies of them written in other ways (an address with
"at" and "dot", a telephone number without its plus, a card number with dots), so that it adds spans which the patterns
cannot see. One kind has no base pattern: a secret (a token, key or password), learned from long runs of letters and digits
that are assigned to a name of that sort. Base spans always stay; a span is added where it overlaps none of them.
"""

from __future__ import annotations

import bisect
import math
import random
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_sample

KINDS = ("email", "ip", "card", "phone")
SECRET = "secret"
EVERY_KIND = (*KINDS, SECRET)
# The base patterns.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: What serves as a label of a secret in training.
ASSIGNED = re.compile(r"(?i)\b(?:token|secret|passw(?:or)?d|pwd|api[_-]?key|access[_-]?key|auth|bearer)[\"']?\s{0,3}[:=]?\s{0,3}[\"']?((?:[A-Za-z]{2,8}[_-])*(?=[A-Za-z]*[0-9])(?=[0-9]*[A-Za-z])[A-Za-z0-9]{16,})")

MAX_TOKENS = 22
REACH = 48
MAX_ROWS = 300
MAX_CHARS = 2_000_000
EPOCHS = 4
RATE = 0.3
L2 = 1e-3
#: Examples to train on, and the longest of them in characters; longer windows are cut.
MAX_EXAMPLES = 600
MAX_WINDOW = 1000
#: Length from which a run of both letters and digits is one token.
LONG_RUN = 16
_token = re.compile(rf"(?=[A-Za-z]*[0-9])(?=[0-9]*[A-Za-z])[A-Za-z0-9]{{{LONG_RUN},}}|[A-Za-z]+|[0-9]+|[^A-Za-z0-9]").finditer
_trigger = re.compile(r"@|[0-9]|(?<![A-Za-z])(?:dot|DOT)(?![A-Za-z])").finditer
_joined_after = re.compile(r"[\s(\[]{0,2}dot\b|\.[A-Za-z]", re.I).match
_joined_before = re.compile(r"\bdot[\s)\]]{1,2}\Z|[A-Za-z0-9]\.\Z", re.I).search
_runs = re.compile(r"(.)\1+")
CLUES = {"mail": "email", "email": "email", "contact": "email", "ip": "ip", "host": "ip", "server": "ip", "address": "ip", "card": "card", "visa": "card", "payment": "card", "phone": "phone", "tel": "phone", "telephone": "phone", "call": "phone", "mobile": "phone", "fax": "phone", "token": "secret", "secret": "secret", "key": "secret", "password": "secret", "passwd": "secret", "pwd": "secret", "auth": "secret", "bearer": "secret", "credential": "secret"}


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


#: IP from the start of a run of digits: a later start in the run can match only if this one does. Keeps long runs linear.
FROM_RUN_START = re.compile(rf"(?<![0-9]){IP.pattern}")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_domain = re.compile(EMAIL.pattern.partition("@")[2]).match


def emails(t: str) -> Iterator[tuple[int, int]]:
    """The matches of EMAIL, found from each @ instead of from each possible start, in linear time."""
    end, at = 0, t.find("@")
    while at >= 0:
        start = end + len(t[end:at].rstrip(LOCAL))
        m = _domain(t, at + 1)
        if m and start < at:
            yield start, m.end()
        end = m.end() if m and start < at else at + 1  # no local part reaches over an @
        at = t.find("@", max(at + 1, end))


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the fixed patterns, by kind as listed and then start; a failing match is dropped without another try."""
    t = text or ""
    out = []
    if "@" in t:
        out += [("email", *x) for x in emails(t)]
    if "." in t:
        out += [("ip", *m.span()) for m in FROM_RUN_START.finditer(t) if all(len(p) <= 3 and int(p) <= 255 for p in (x.lstrip("0") or "0" for x in m[0].split(".")))]
    for m in CARD.finditer(t):
        digits = re.sub("[ -]", "", m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in t:
        out += [("phone", *m.span()) for m in PHONE.finditer(t) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def windows(text: str) -> Iterator[tuple[int, int]]:
    """Stretches of text around triggers, merged where they touch and cut at the edges of words."""
    lo = hi = -1
    for m in _trigger(text):
        a, b = max(0, m.start() - REACH), min(len(text), m.end() + REACH)
        if a <= hi:
            hi = b
        else:
            if hi >= 0:
                yield lo, hi
            lo, hi = a, b
    if hi >= 0:
        yield lo, hi


def _secret_features(text: str, a: int, b: int) -> list[str]:
    """Features of a long run of letters and digits, with what is joined to it."""
    s, ahead = text[a:b], text[max(0, a - 24) : a].lower()
    run = max(re.findall("[A-Za-z0-9]+", s), key=len)
    share = sum(c.isdigit() for c in run) / len(run)
    quoted = text[a - 1 : a] in ("'", '"') and text[b : b + 1] == text[a - 1 : a]
    clue = {CLUES[w] for w in re.findall("[a-z]+", ahead) if w in CLUES}
    return [
        f"long={min(len(run) // 8, 8)}",
        f"hex={all(c in '0123456789abcdefABCDEF' for c in run)}",
        f"digits={int(share * 4)}",
        f"mixed={run.lower() != run and run.upper() != run}",
        f"quoted={quoted}",
        f"assigned={bool(re.search(r'[:=]\s*.?$', ahead))}",
        f"clue={SECRET in clue}{bool(clue - {SECRET})}",
        f"joined={len(s) > len(run)}",
        f"edge={text[a - 1 : a] in ('.', '-', '/', '@', '_')}{text[b : b + 1] in ('-', '@', '_', '/')}",
    ]


def span_features(kind: str, text: str, tokens: list[tuple[int, int]], i: int, j: int) -> list[str]:
    """Features of tokens i..j-1 of text as one span of the kind."""
    a, b = tokens[i][0], tokens[j - 1][1]
    s = text[a:b]
    if kind == SECRET:
        return [f"{kind}|{x}" for x in _secret_features(text, a, b)]
    digits = "".join(c for c in s if c.isdigit())
    lower = s.lower()
    shape = _runs.sub(r"\1", re.sub("[A-Za-z]+", "a", re.sub("[0-9]+", "9", s)))
    before, after = text[a - 1 : a], text[b : b + 1]
    out = [f"n={min(len(digits), 20)}", f"luhn={16 <= len(digits) <= 19 and luhn(digits)}", f"open={before.isalnum()}{after.isalnum()}", f"edge={before in ('.', '-', '+', '@', '_')}{after in ('-', '@', '_')}", f"sep={''.join(sorted(set(re.sub('[A-Za-z0-9]', '', s))))[:4]}"]
    if "@" in s or re.search(r"\s(at|dot)\s", lower):
        plain = re.sub(r"[\s(\[]*\bdot\b[\s)\]]*", ".", re.sub(r"[\s(\[]*\bat\b[\s)\]]*", "@", lower))
        out.append(f"mail={bool(EMAIL.fullmatch(plain))}{'dot' in lower or '@' in s}{' ' in plain}")
        out.append(f"more={bool(_joined_after(text, b))}{bool(_joined_before(text[max(0, a - 6) : a]))}")
    elif kind == "email":
        return []
    parts = s.split(".")
    out.append(f"octets={len(parts) == 4 and all(p.isdigit() and len(p) < 4 and int(p) < 256 for p in parts)}")
    if len(shape) <= 12:
        out.append(f"shape={shape}")
    out.append(f"ends={s[0] if not s[0].isalnum() else '9' if s[0].isdigit() else 'a'}{s[-1] if not s[-1].isalnum() else '9' if s[-1].isdigit() else 'a'}")
    clue = {CLUES[w] for w in re.findall("[a-z]+", text[max(0, a - 20) : a].lower()) if w in CLUES}
    out.append(f"clue={kind in clue}{bool(clue - {kind})}")
    return [f"{kind}|{x}" for x in out]


def candidates(text: str, tokens: list[tuple[int, int]]) -> dict[int, list[tuple[int, str, list[str]]]]:
    """By end: (start, kind, features) of the segments that are worth scoring; all other tokens are outside segments of one token."""
    found: dict[int, list] = {}
    kinds = [text[a] for a, _ in tokens]
    n = len(tokens)
    odd = [not c.isalnum() for c in kinds]
    long = [b - a >= LONG_RUN and not odd[k] and not text[a:b].isalpha() and not text[a:b].isdigit() for k, (a, b) in enumerate(tokens)]
    for j in [k + 1 for k in range(n) if long[k]]:
        i = j - 1
        while True:  # the run alone, and with up to three words joined to its front
            found.setdefault(j, []).append((i, SECRET, span_features(SECRET, text, tokens, i, j)))
            if i < 2 or j - i >= 7 or kinds[i - 1] not in "_-" or odd[i - 2]:
                break
            i -= 2
    for i in range(n):
        if kinds[i].isspace() or (odd[i] and kinds[i] not in "+("):
            continue
        mail = at = False
        digits = 0
        for j in range(i + 1, min(n, i + MAX_TOKENS) + 1):
            c = kinds[j - 1]
            if c == "\n":
                break
            word = text[tokens[j - 1][0] : tokens[j - 1][1]]
            if long[j - 1]:
                break
            if c.isdigit():
                digits += len(word)
            at = at or c == "@" or word.lower() == "at"
            mail = mail or (at and (c == "." or word.lower() == "dot"))
            alpha = c.isalpha()
            if alpha and not at and not mail and digits and not any(x in "@" for x in kinds[i : i + MAX_TOKENS]):
                break
            if odd[j - 1]:
                continue
            if digits > 24:
                break
            for kind in KINDS:
                if (kind == "email") != (mail and at) or (kind != "email" and (digits < 4 or not kinds[j - 1].isdigit() or kinds[i].isalpha())):
                    continue
                f = span_features(kind, text, tokens, i, j)
                if f:
                    found.setdefault(j, []).append((i, kind, f))
    return found


class SegmentModel:
    """Weights of span features; a token outside scores 0, and adjacent entities pay a transition weight."""

    def __init__(self, weights: dict[str, float] | None = None):
        self.weights = weights or {}

    def value(self, kind: str, features: list[str]) -> float:
        get = self.weights.get
        return get(f"{kind}|", 0.0) + sum(get(f, 0.0) for f in features)

    def decode(self, text: str) -> list[tuple[str, int, int]]:
        """The best segmentation of a window, as (kind, start, end)."""
        tokens = [m.span() for m in _token(text)]
        segments = candidates(text, tokens)
        best, back = [0.0], [None]
        touch = self.weights.get("touch", 0.0)
        for j in range(1, len(tokens) + 1):
            top, how = best[j - 1], None
            for i, kind, f in segments.get(j, ()):
                v = best[i] + self.value(kind, f) + (touch if back[i] is not None else 0.0)
                if v > top:
                    top, how = v, (i, kind)
            best.append(top)
            back.append(how)
        out, j = [], len(tokens)
        while j:
            if back[j] is None:
                j -= 1
            else:
                i, kind = back[j]
                out.append((kind, tokens[i][0], tokens[j - 1][1]))
                j = i
        return out[::-1]

    def train(self, examples: list[tuple[str, set[tuple[str, int, int]]]], epochs: int = EPOCHS, seed: int = 0) -> None:
        """Stochastic gradient ascent on the conditional log-likelihood of the given segmentations."""
        prepared = []
        for text, gold in examples:
            tokens = [m.span() for m in _token(text)]
            segments = candidates(text, tokens)
            prepared.append((len(tokens), segments, [[(kind, tokens[i][0], tokens[j - 1][1]) in gold for i, kind, _ in cs] for j, cs in segments.items()]))
        history: dict[str, float] = {}
        order = random.Random(seed)
        for _ in range(epochs):
            order.shuffle(prepared)
            for n, segments, truth in prepared:
                grad: dict[str, float] = {}
                scores = {j: [self.value(k, f) for _, k, f in cs] for j, cs in segments.items()}
                ahead = [0.0] * (n + 1)
                for j in range(1, n + 1):
                    terms = [ahead[j - 1]] + [ahead[i] + v for (i, _, _), v in zip(segments.get(j, ()), scores.get(j, ()), strict=True)]
                    top = max(terms)
                    ahead[j] = top + math.log(sum(math.exp(x - top) for x in terms))
                behind = [-math.inf] * (n + 1)
                behind[n] = 0.0
                for j in range(n, 0, -1):
                    for i, v in [(j - 1, 0.0), *((c[0], v) for c, v in zip(segments.get(j, ()), scores.get(j, ()), strict=True))]:
                        x = behind[j] + v
                        hi, lo = max(behind[i], x), min(behind[i], x)
                        behind[i] = hi + math.log1p(math.exp(lo - hi)) if lo > -math.inf else hi
                for (j, cs), right in zip(segments.items(), truth, strict=True):
                    for (i, kind, f), v, is_gold in zip(cs, scores[j], right, strict=True):
                        g = is_gold - math.exp(min(0.0, ahead[i] + v + behind[j] - ahead[n]))
                        if abs(g) > 1e-4:
                            for x in (f"{kind}|", *f):
                                grad[x] = grad.get(x, 0.0) + g
                for x, g in grad.items():
                    g -= L2 * self.weights.get(x, 0.0)
                    history[x] = history.get(x, 1e-2) + g * g
                    self.weights[x] = self.weights.get(x, 0.0) + RATE * g / math.sqrt(history[x])


def _rewritten(text: str, gold: set, rng: random.Random) -> tuple[str, set] | None:
    """A window with one of its spans written in a way that the patterns miss, and the spans of the result."""
    kind, a, b = rng.choice(sorted(gold))
    s = text[a:b]
    if kind == "email":
        new = s.replace("@", rng.choice([" at ", " (at) ", " [at] "])).replace(".", " dot ")
    elif kind == "phone":
        new = re.sub(r"^\+[0-9]{1,3}[ .-]?", "", s)
        if not new[:1].isdigit() and not new.startswith("("):
            return None
    elif kind == "card":
        digits = re.sub(r"\D", "", s)
        new = ".".join(digits[k : k + 4] for k in range(0, len(digits), 4))
    else:
        return None
    shift = len(new) - (b - a)
    return text[:a] + new + text[b:], {(k, x + shift * (x >= b), y + shift * (y >= b)) for k, x, y in gold if (k, x, y) != (kind, a, b)} | {(kind, a, a + len(new))}


def _pieces(text: str) -> Iterator[tuple[int, int]]:
    """The windows of a text, those over MAX_WINDOW characters in pieces."""
    for lo, hi in windows(text):
        for k in range(lo, hi, MAX_WINDOW):
            yield k, min(k + MAX_WINDOW, hi)


def _examples(texts: list[str], limit: int = MAX_EXAMPLES) -> list[tuple[str, set]]:
    """Windows of the texts with the spans that serve as labels, and copies written another way; at most limit windows, drawn evenly from all."""
    rng = random.Random(10)
    places = [(k, lo, hi) for k, t in enumerate(texts) for lo, hi in _pieces(t)]
    if len(places) > limit:
        places = sorted(rng.sample(places, limit))
    out, spans, last = [], [], -1
    for k, lo, hi in places:
        t = texts[k]
        if k != last:
            spans, last = [*base_spans(t), *((SECRET, *m.span(1)) for m in ASSIGNED.finditer(t))], k
        gold: set = set()
        for kind, a, b in spans:
            if lo <= a and b <= hi and not any(x < b - lo and a - lo < y for _, x, y in gold):
                gold.add((kind, a - lo, b - lo))
        out.append((t[lo:hi], gold))
        if gold and (again := _rewritten(t[lo:hi], gold, rng)):
            out.append(again)
    return out


#: Examples that do not depend on the corpus: what looks like personal data but is not, and plain cases of each kind.
SEEDS = [("call +1 (555) 010-9999 now", "phone", "+1 (555) 010-9999"), ("mail ann.lee@mail.example.org today", "email", "ann.lee@mail.example.org"), ("mail ann at example dot org today", "email", "ann at example dot org"), ("write to bo.ek at mail dot example dot net or", "email", "bo.ek at mail dot example dot net"), ("is c_d (at) example dot com it", "email", "c_d (at) example dot com"), ("from host 203.0.113.7 again", "ip", "203.0.113.7"), ("paid by 4111 1111 1111 1111 then", "card", "4111 1111 1111 1111"), ("paid by 4111.1111.1111.1111 then", "card", "4111.1111.1111.1111"), ("call (555) 010-9999 now", "phone", "(555) 010-9999"), ("version 12.4.1 of 2024-01-31 at noon", "", ""), ("order 4111111111111112 at 10.30 for 250", "", ""), ("we met at the dot of noon in 1999", "", ""), ("commit a1b2c3d4e5f60718293a4b5c of the branch", "", ""), ("see page /p/3f2a9c0b17de4471a0c5 for more", "", ""), ("sha1 da39a3ee5e6b4b0d3255bfef95601890afd80709 of it", "", ""), ('token = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b" in', "secret", "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"), ("api key: ab_live_4eC39HqLyjWDarjtT1zdp7dc now", "secret", "ab_live_4eC39HqLyjWDarjtT1zdp7dc"), ("password=hunter2hunter2hunter2x9", "secret", "hunter2hunter2hunter2x9"), ("1,234,567.89 in 2020 - 2021", "", "")]


def fit(docs: DataFrame, max_rows: int = MAX_ROWS, max_chars: int = MAX_CHARS, max_examples: int = MAX_EXAMPLES) -> SegmentModel:
    """Trains on the texts of docs (doc_id, text) that hold a trigger: a sample bounded by max_rows and max_chars, and at most max_examples windows drawn evenly from all of its texts."""
    rows = docs.select("doc_id", "text").filter(F.col("text").rlike("@|[0-9]{4}|\\.[0-9]+\\."))
    texts = [t for _, t in text_sample(rows, max_rows, max_chars, 10)]
    seeds = [(t, {(k, t.index(s), t.index(s) + len(s))} if k else set()) for t, k, s in SEEDS] * 8
    model = SegmentModel({f"{k}|": -2.0 for k in EVERY_KIND})
    model.train(_examples(texts, max_examples) + seeds)
    return model


def all_spans(text: str | None, model: SegmentModel) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, is base) of a whole text, by kind as listed and then start."""
    t = text or ""
    base = base_spans(t)
    taken = sorted((a, b) for _, a, b in base)
    out = [(*x, True) for x in base]
    starts = [a for a, _ in taken]
    longest = max((b - a for a, b in taken), default=0)
    for lo, hi in windows(t):
        for kind, a, b in model.decode(t[lo:hi]):
            a, b = a + lo, b + lo
            k = bisect.bisect_left(starts, a - longest)
            if not any(y > a for _, y in taken[k : bisect.bisect_left(starts, b)]):
                out.append((kind, a, b, False))
    return sorted(out, key=lambda x: (EVERY_KIND.index(x[0]), x[1], x[2]))


def digest(spans: list[tuple]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b, *_ in spans)


def find(docs: DataFrame, model: SegmentModel, into: str = "pii") -> DataFrame:
    """Adds, under the name into, an array of (kind, start, end, base) to docs (text, ...): all spans of the whole text in code points, end exclusive, by kind and start.

    Null and empty texts have none. Repeated rows each get their spans; an empty table gives an empty one. Other columns are
    passed on unread, but one named like into is replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("array<struct<kind:string,start:long,end:long,base:boolean>>")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in texts:
            yield pd.Series([[{"kind": k, "start": a, "end": b, "base": s} for k, a, b, s in all_spans(x, sent.value)] for x in t], dtype="object")

    return docs.withColumn(into, run("text"))
