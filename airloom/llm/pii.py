"""Personal data by fixed patterns and a semi-Markov conditional random field.

Fixed patterns give the base spans. The field adds spans that the patterns miss (other separators, spelled-out
signs). It looks at islands: runs of tokens near a digit or an at sign; elsewhere no entity is possible. A segment is
one to ``MAX_TOKENS`` tokens of an island on one line; features of the whole segment score each kind, transition weights score
neighbouring kinds, and the forward-backward recursions over segments sum over all cuts and kinds. A span is
added if its segment is on the best path, its posterior is at least ``MIN_POSTERIOR`` and no base span overlaps it.
Of equally good paths the one with the first previous kind, then the shorter segment, is taken.

Training rows: at most ``MAX_ISLANDS`` distinct islands with a base span and as many without (those of smallest hash, of at most
``FIT_TOKENS`` tokens), labelled by the base patterns; islands with one base span are also learnt from with its separators or signs
rewritten in each of ``REWRITES``'s ways, and numbers of other things (prices, dates, order numbers) as what is no personal data. The weights maximise the conditional likelihood. Without base spans nothing is added.

Null texts are empty and have no spans. Very long texts are read whole: an island's features are held for ``BLOCK`` tokens at a time.
Spans count code points; ends are exclusive. Each row is read by itself, so repeated rows and other columns don't matter.
"""

import hashlib
import re
from bisect import bisect_left
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import session, table, written

KINDS = ["email", "ip", "card", "phone"]
MAX_TOKENS = 7
#: Without an at sign, a segment is looked at only if it has so many digits and no letters but those of spelled-out dots.
LEAST_DIGITS, MOST_DIGITS = 4, 19
MAX_ISLANDS = 300
FIT_TOKENS = 16
MIN_POSTERIOR = 0.9
BLOCK = 2048

#: The base patterns. An address is a run of local signs, ``@`` and a domain; an ip starts at the start of its digits,
#: so that long runs are read once.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

TRIGGER = re.compile(r"[0-9@]|[(\[{<](?:at|dot)[)\]}>]|(?<=\s)dot(?=\s)", re.I)
#: Spelled-out signs, in any brackets or as words; ``at`` as a word only before a dot.
AT_WORD = re.compile(r"\s*[(\[{<]\s?at\s?[)\]}>]\s*|\s+@\s+|\s+at\s+(?=\S+?\s?(?:\sdot\s|[(\[{<]\s?(?:dot|\.)))", re.I)
DOT_WORD = re.compile(r"\s*[(\[{<]\s?(?:dot|\.)\s?[)\]}>]\s*|\s+dot\s+|\s+\.\s+", re.I)
ADDRESS = re.compile(r"[\w.%+-]+@[\w-]+(?:\.[\w-]+)+")
DIGITS = re.compile("[0-9]+")
TOKEN = re.compile(r"[^\x20\x09-\x0D]+")


def digits_of(s):
    return [int(c) for c in s if "0" <= c <= "9"]


def luhn(s):
    d = digits_of(s)[::-1]
    return sum(d[0::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2]) if d else 1


def base_spans(text):
    """``[(start, end, kind)]`` of the fixed patterns, by start and then kind."""
    if not text or not TRIGGER.search(text):
        return []
    out, at, done = [], text.find("@"), 0
    while at >= 0:
        lo = at
        while lo > done and text[lo - 1] in LOCAL:
            lo -= 1
        m = DOMAIN.match(text, at + 1) if lo < at else None
        if m:
            done = m.end()
            out.append((lo, done, 0))
        at = text.find("@", done if m else at + 1)
    out += [(m.start(), m.end(), 1) for m in IP.finditer(text) if all(len(p) < 4 and int(p or 0) < 256 for p in (q.lstrip("0") for q in m.group().split(".")))]
    out += [(m.start(), m.end(), 2) for m in CARD.finditer(text) if 14 <= len(digits_of(m.group())) <= 19 and luhn(m.group()) % 10 == 0]
    out += [(m.start(), m.end(), 3) for m in PHONE.finditer(text) if 10 <= len(digits_of(m.group())) <= 15]
    return sorted(out, key=lambda x: (x[0], x[2]))


def islands(text, near=2):
    """Lists of ``(start, end)`` tokens: all within ``near`` tokens of one that holds a trigger."""
    if not text or not TRIGGER.search(text):
        return []
    tokens = [m.span() for m in TOKEN.finditer(text)]
    starts = [s for s, _ in tokens]
    hot = np.searchsorted(starts, [m.start() for m in TRIGGER.finditer(text)], side="right") - 1
    out, last = [], -1
    for k in np.unique(hot).tolist():
        back = near + 2 * (text[slice(*tokens[k])].lower() == "dot")  # a name and its sign are before the word
        lo, hi = max(0, k - back), min(len(tokens), k + near + 1)
        if out and lo <= last:
            out[-1] += tokens[last:hi]
        else:
            out.append(tokens[lo:hi])
        last = hi
    return out


def trimmed(text, start, end):
    """The span without quotes, brackets and sentence marks at its edges."""
    while start < end and not (text[start].isalnum() or text[start] in "+("):
        start += 1
    while start < end and not text[end - 1].isalnum():
        end -= 1
    if text[start:end].startswith("(") and ")" not in text[start:end]:
        start += 1
    return start, end


def bucket(n, edges):
    return [float(a <= n < b) for a, b in zip(edges, [*edges[1:], 1 << 62])]


MARK = re.compile(r"[^\W0-9]|[@(\[{<]|\s\.\s")


def signs(x):
    """The span with spelled-out signs as signs."""
    return DOT_WORD.sub(".", AT_WORD.sub("@", x)) if MARK.search(x) else x


PRICE = re.compile(r"[0-9]{1,3}(?:,[0-9]{3})+(?:\.[0-9]+)?|[0-9]+[.,][0-9]{1,2}")
DATE = re.compile(r"[0-9]{4}[-/.][0-9]{1,2}[-/.][0-9]{1,2}|[0-9]{1,2}[-/.][0-9]{1,2}[-/.](?:[0-9]{4}|[0-9]{2})")
#: A word that says that a number is one of an order, a page or the like.
LABEL = re.compile(r"(?i)[(\"']*(?:no|nr|id|isbn|sku|order|ticket|invoice|ref|reference|page|item|serial|code|case|version)[.:#]*|#")


def features(x, n_tokens, before=""):
    """Features of a whole span and of the word before it."""
    groups = DIGITS.findall(x)
    sizes = list(map(len, groups)) or [0]
    digits, letters = sum(sizes), sum(map(str.isalpha, x))
    plain = signs(x)
    parts = plain.split(".")
    between = set(x) - set("0123456789")
    gaps = {g.strip(" ") for g in DIGITS.split(x)[1:-1]}
    small = len(groups) == 4 and all(len(g) < 4 and int(g) < 256 for g in groups)
    numeric = letters == 0 and digits > 0
    return [
        1.0,
        *bucket(n_tokens, [1, 2, 3, 4]),
        *bucket(digits, [0, 1, 7, 10, 12, 14, 16, 17, 20]),
        *bucket(letters, [0, 1, 4]),
        *bucket(len(groups), [0, 1, 2, 3, 4, 5]),
        float(bool(ADDRESS.fullmatch(plain))),
        float(plain.count("@") > 1),
        float("@" in plain and not ADDRESS.fullmatch(plain)),
        float(len(parts) == 4 and all(p.isdecimal() and len(p) < 4 and int(p) < 256 for p in parts)),
        float(numeric and 14 <= digits <= 19 and luhn(x) % 10 == 0),
        float(numeric and 14 <= digits <= 19 and luhn(x) % 10 != 0),
        float(numeric and len(between) == 1),
        float(numeric and sizes[:3] == [4, 4, 4]),
        float(numeric and sizes[-3:] == [3, 3, 4]),
        float(numeric and between <= set(" -.()+")),
        float(numeric and bool(between - set(" -.()+"))),
        float(numeric and x[0] == "+"),
        float(numeric and x[0] == "0" and x[:2] != "00"),
        float(numeric and x[:2] == "00"),
        float(numeric and x[0] == "("),
        float(numeric and max(sizes) > 7),
        float(numeric and 10 <= digits <= 15 and 2 <= len(groups) <= 5),
        float(bool(between - set(" -.()+@[]/_")) and letters > 0),
        float(numeric and small and len(gaps) == 1 and gaps <= {".", ",", "(.)", "[.]", "{.}", ":", "_"}),
        float(numeric and small and (len(gaps) != 1 or gaps <= {"", "-", "/"})),
        float(numeric and len(groups) == 4 and not small),
        float(bool(PRICE.fullmatch(x))),
        float(bool(DATE.fullmatch(x))),
        float(numeric and digits == 13 and x[:3] in ("978", "979")),
        float(numeric and "," in between and not small),
        float(numeric and len(groups) > 1 and sizes[-1] < 3 and sizes[0] > 2),
        float(numeric and bool(LABEL.fullmatch(before))),
    ]


N_FEATURES = len(features("a", 1))


AT = re.compile(r"@|[(\[{<]at[)\]}>]", re.I)
NO_DIGIT = re.compile("[^0-9]+")


def lattice(text, tokens, lo=0, hi=None):
    """For each end token from ``lo`` to ``hi``, ``(first token, span, features)`` of the segments that end there and could be an entity."""
    hi, out = len(tokens) if hi is None else hi, []
    first = max(0, lo - MAX_TOKENS)
    words = [text[s:e] for s, e in tokens[first:hi]]
    digits, ats = [len(NO_DIGIT.sub("", x)) for x in words], [AT.search(x) is not None or x.lower() == "at" for x in words]
    for j in range(lo, hi):
        row, n, at = [], 0, False
        for i in range(j, max(-1, j - MAX_TOKENS), -1):
            if i < j and text.find("\n", tokens[i][1], tokens[i + 1][0]) >= 0:
                break
            n, at = n + digits[i - first], at or ats[i - first]
            if not at and not LEAST_DIGITS <= n <= MOST_DIGITS:
                continue
            s, e = trimmed(text, tokens[i][0], tokens[j][1])
            if s < e and s < tokens[i][1] and e > tokens[j][0] and ("@" in signs(text[s:e]) if at else not any(map(str.isalpha, signs(text[s:e])))):
                row.append((i, (s, e), features(text[s:e], j - i + 1, words[i - 1 - first] if i > first else "")))
        out.append(row)
    return out


class Field:
    """Weights: ``w[kind, feature]`` and ``t[previous, kind]``; the last kind is no entity, with score zero."""

    def __init__(self, w=None, t=None):
        k = len(KINDS)
        self.w = np.zeros((k, N_FEATURES)) if w is None else w
        self.t = np.zeros((k + 1, k + 1)) if t is None else t

    def scores(self, rows):
        """For each end token, the first tokens of its segments and their scores by kind; one product for all."""
        firsts = [np.array([i for i, _, _ in row], np.int64) for row in rows]
        x = [f for row in rows for _, _, f in row]
        s = np.array(x) @ self.w.T if x else np.zeros((0, len(KINDS)))
        return list(zip(firsts, np.split(s, np.cumsum([len(i) for i in firsts])[:-1]))) if rows else []

    def forward(self, alpha, scores, lo=0):
        """Fills ``alpha[j, kind]`` for the end tokens from ``lo``: log sum over the cuts of the first j tokens whose last segment is of that kind."""
        k = len(KINDS)
        for j, (i, s) in enumerate(scores, lo + 1):
            alpha[j, k] = np.logaddexp.reduce(alpha[j - 1] + self.t[:, k])
            if len(i):
                into = np.logaddexp.reduce(alpha[i][:, :, None] + self.t[:, :k], axis=1)
                alpha[j, :k] = np.logaddexp(alpha[j, :k], np.logaddexp.reduce(into + s, axis=0))

    def backward(self, beta, scores, lo=0):
        """The same from the end: fills ``beta`` for all tokens that the segments ending from ``lo`` begin at."""
        k = len(KINDS)
        for j in range(lo + len(scores), lo, -1):
            beta[j - 1] = np.logaddexp(beta[j - 1], self.t[:, k] + beta[j, k])
            i, s = scores[j - 1 - lo]
            if len(i):
                beta[i] = np.logaddexp(beta[i], np.logaddexp.reduce(self.t[None, :, :k] + (s + beta[j, :k])[:, None, :], axis=2))

    def extend(self, top, back, scores, lo=0):
        """Fills ``top`` with the best cuts' scores and ``back`` with (segment length, previous kind)."""
        k = len(KINDS)
        for j, (i, s) in enumerate(scores, lo + 1):
            p = int(np.argmax(top[j - 1] + self.t[:, k]))
            top[j, k], back[j, k] = top[j - 1, p] + self.t[p, k], (1, p)
            if len(i):
                into = top[i][:, :, None] + self.t[:, :k]
                p = into.argmax(axis=1)
                value = np.take_along_axis(into, p[:, None], axis=1)[:, 0] + s
                best = value.argmax(axis=0)  # of equal ones the first, which is the shorter segment
                for c in range(k):
                    m = best[c]
                    top[j, c], back[j, c] = value[m, c], (j - i[m], p[m, c])

    def path(self, top, back):
        """``[(first, end, kind)]``: the entities of the best cut, last first."""
        j, c, found = len(top) - 1, int(top[-1].argmax()), []
        while j:
            size, p = back[j, c].tolist()
            if c < len(KINDS):
                found.append((j - size, j, c))
            j, c = j - size, p
        return found

    def decoded(self, text, tokens):
        """``[(first, end, kind, span, log posterior)]`` of an island's best cut. Features are made for a block of tokens at a time."""
        k, n = len(KINDS), len(tokens)
        starts, held = range(0, n, BLOCK), None
        alpha, top, back = np.full((n + 1, k + 1), -1e30), np.full((n + 1, k + 1), -1e30), np.zeros((n + 1, k + 1, 2), np.int8)
        alpha[0, k] = top[0, k] = 0.0
        for lo in starts:
            rows = lattice(text, tokens, lo, min(n, lo + BLOCK))
            held = (lo, rows, self.scores(rows))
            self.forward(alpha, held[2], lo)
            self.extend(top, back, held[2], lo)
        z, want = np.logaddexp.reduce(alpha[n]), self.path(top, back)
        beta, out = np.full((n + 1, k + 1), -1e30), []
        beta[n] = 0.0
        at = 0
        for lo in reversed(starts):
            if at == len(want):
                break
            if held[0] != lo:
                rows = lattice(text, tokens, lo, min(n, lo + BLOCK))
                held = (lo, rows, self.scores(rows))
            _, rows, scores = held
            self.backward(beta, scores, lo)
            while at < len(want) and want[at][1] > lo:
                i, j, c = want[at]
                seen = next(x for x, (first, _, _) in enumerate(rows[j - 1 - lo]) if first == i)
                p = np.logaddexp.reduce(alpha[i] + self.t[:, c]) + scores[j - 1 - lo][1][seen, c] + beta[j, c] - z
                out.append((i, j, c, rows[j - 1 - lo][seen][1], float(p)))
                at += 1
        return out

    def added(self, text, taken):
        """Spans of the best path that are sure enough and overlap none of ``taken``, which are in order."""
        starts, ends = [s for s, _, _ in taken], np.maximum.accumulate([0, *[e for _, e, _ in taken]])
        out = []
        for tokens in islands(text):
            for _, _, c, (s, e), p in self.decoded(text, tokens):
                if p >= np.log(MIN_POSTERIOR) and ends[bisect_left(starts, e)] <= s:
                    out.append((s, e, c))
        return out


def dashed(x, sign):
    return sign.join(re.findall("[0-9]{1,4}", re.sub("[^0-9]", "", x)))


#: For each kind, other ways to write a base span.
REWRITES = {
    0: [
        lambda x: x.replace("@", " (at) "),
        lambda x: x.replace("@", " [at] "),
        lambda x: x.replace("@", "(at)"),
        lambda x: x.replace("@", " @ "),
        lambda x: re.sub("[0-9]", "", x).replace("@", " [at] "),
        lambda x: "{} [at] {}".format(x.partition("@")[0], x.partition("@")[2].replace(".", " [dot] ")),
        lambda x: x.replace("@", "{AT}"),
        lambda x: "{} at {}".format(x.partition("@")[0], x.partition("@")[2].replace(".", " dot ")),
    ],
    1: [lambda x: x.replace(".", "[.]"), lambda x: x.replace(".", "(.)"), lambda x: x.replace(".", " [dot] "), lambda x: x.replace(".", "(dot)"), lambda x: x.replace(".", ","), lambda x: x.replace(".", " . ")],
    2: [lambda x: dashed(x, "."), lambda x: dashed(x, "/"), lambda x: dashed(x, "_"), lambda x: dashed(x, " / "), lambda x: "{}.{}-{}".format(*cut(x, 6, 12))],
    3: [
        lambda x: "00" + x[1:],
        lambda x: re.sub(r"^\+[0-9]+[ .-]+", "0", x) if re.match(r"\+[0-9]+[ .-]+[0-9]", x) else x,
        lambda x: "({}) {}-{}".format(*national(x)),
        lambda x: "-".join(national(x)),
        lambda x: ".".join(national(x)),
        lambda x: " ".join(national(x)),
        lambda x: "0{}/{}".format(*cut("".join(national(x))[1:], 2)),
        lambda x: "0{} {}".format(*cut("".join(national(x))[1:], 2)),
        lambda x: "{} (0){}/{}-{}".format(x[: re.search("[ .(-]|$", x).start()], *national(x)),
        lambda x: "".join(national(x)),
    ],
}


def cut(x, *at):
    """The digits in pieces."""
    d = re.sub("[^0-9]", "", x)
    return [d[i:j] for i, j in zip([0, *at], [*at, len(d)])]


def numbers_of_things():
    """Islands without personal data: prices, dates, times, versions, book and order numbers, measures."""
    out = []
    for i in range(1, 25):
        a, b, c = 7919 * i % 900 + 100, 104729 * i % 900 + 100, 1299709 * i % 9000 + 1000
        out += [
            f"paid {i},{a},{b}.{c % 90 + 10} for all", f"it cost {a},{b}.{c % 100:02d} euro", f"sum of {a} {b} {c} people there", f"on {1990 + i}-{i % 12 + 1:02d}-{i % 28 + 1:02d} we met", f"on {i % 28 + 1}.{i % 12 + 1}.{1990 + i} we met",
            f"at {i % 24:02d}:{i % 60:02d}:{a % 60:02d}.{b} sharp", f"version {i % 9}.{a % 20}.{b % 30} of it", f"isbn 978-{i % 9}-{a}-{c}{i % 10}-{b % 10} in print", f"order {a}-{b}-{c}-{i + 10} was sent", f"part {a}-{b}-{c}-{i + 10} was sent",
            f"ticket {a}-{b}-{c} is open", f"ref {a}{b}{c} is open", f"pages {a}-{b} and {c} too", f"about {a}.{b} {b}.{a} degrees", f"in {a} / {b} of {c} cases", f"from {1900 + i} to {1950 + i} and on",
        ]
    return out


def national(x):
    """A phone number's last ten digits in three groups."""
    d = re.sub("[^0-9]", "", x)[-10:]
    return d[:3], d[3:6], d[6:]


def rewritten(text, span, how):
    """(island, span): the island with one base span spelled another way."""
    s, e, kind = span
    y = REWRITES[kind][how](text[s:e])
    return text[:s] + y + text[e:], (s, s + len(y), kind)


def example(text, spans):
    """``(rows, gold)`` if every span is a segment of the text's one island; else None."""
    tokens = [m.span() for m in TOKEN.finditer(text)]
    rows = lattice(text, tokens)
    at = {span: (i, j) for j, row in enumerate(rows, 1) for i, span, _ in row}
    gold = [(*at[s, e], c) for s, e, c in spans if (s, e) in at]
    ok = len(gold) == len(spans) and all(a[1] <= b[0] for a, b in zip(gold, gold[1:]))
    return (rows, gold) if ok and any(rows) else None


class Likelihood:
    """Conditional log likelihood of examples, all at once: arrays over (example, token, segment length, kind)."""

    def __init__(self, data):
        data = sorted(data, key=lambda x: -len(x[0]))
        size = [len(rows) for rows, _ in data]
        self.n, self.t = np.array(size), max(size)
        self.active = [int((self.n > i).sum()) for i in range(self.t)]
        cells, x = [], []
        for b, (rows, _) in enumerate(data):
            for j, row in enumerate(rows):
                for i, _, f in row:
                    cells.append((b, j, j - i))
                    x.append(f)
        self.cells, self.x = tuple(np.array(cells).T), np.array(x)
        where = {c: k for k, c in enumerate(cells)}
        k = len(KINDS)
        self.gw, self.gt = np.zeros((k, N_FEATURES)), np.zeros((k + 1, k + 1))
        self.gold = []
        for b, (rows, gold) in enumerate(data):
            at, prev = 0, k
            for i, j, c in [*gold, (len(rows), len(rows), None)]:
                for _ in range(i - at):
                    self.gt[prev, k] += 1
                    prev = k
                if c is not None:
                    self.gt[prev, c] += 1
                    self.gw[c] += self.x[where[b, j - 1, j - 1 - i]]
                    prev = c
                at = j

    def __call__(self, w, t, l2):
        """(value, gradient by w, gradient by t) of the penalised mean log likelihood."""
        k, n_b, t_n = len(KINDS), len(self.n), self.t
        score = np.full((n_b, t_n, MAX_TOKENS, k), -1e30)
        score[self.cells] = self.x @ w.T
        alpha, into = np.full((n_b, t_n + 1, k + 1), -1e30), np.full((n_b, t_n, k), -1e30)
        alpha[:, 0, k] = 0.0
        for j in range(1, t_n + 1):
            a = self.active[j - 1]
            into[:a, j - 1] = np.logaddexp.reduce(alpha[:a, j - 1, :, None] + t[None, :, :k], axis=1)
            alpha[:a, j, k] = np.logaddexp.reduce(alpha[:a, j - 1] + t[:, k], axis=1)
            alpha[:a, j, :k] = np.logaddexp.reduce([into[:a, j - 1 - m] + score[:a, j - 1, m] for m in range(min(MAX_TOKENS, j))], axis=0)
        rows = np.arange(n_b)
        z = np.logaddexp.reduce(alpha[rows, self.n], axis=1)
        beta, out = np.full((n_b, t_n + 1, k + 1), -1e30), np.full((n_b, t_n, k), -1e30)
        beta[rows, self.n] = 0.0
        for i in range(t_n - 1, -1, -1):
            a = self.active[i]
            out[:a, i] = np.logaddexp.reduce([score[:a, i + m, m] + beta[:a, i + m + 1, :k] for m in range(min(MAX_TOKENS, t_n - i))], axis=0)
            beta[:a, i] = np.logaddexp(t[None, :, k] + beta[:a, i + 1, k, None], np.logaddexp.reduce(t[None, :, :k] + out[:a, i, None, :], axis=2))
        b, j, m = self.cells
        p = np.exp(np.minimum(into[b, j - m] + score[self.cells] + beta[b, j + 1, :k] - z[b, None], 0.0))
        inside = (np.arange(t_n)[None] < self.n[:, None])[:, :, None]
        et = np.zeros_like(t)
        et[:, k] = (np.exp(np.minimum(alpha[:, :-1] + t[:, k] + beta[:, 1:, k, None] - z[:, None, None], 0.0)) * inside).sum(axis=(0, 1))
        et[:, :k] = (np.exp(np.minimum(alpha[:, :-1, :, None] + t[None, None, :, :k] + out[:, :, None, :] - z[:, None, None, None], 0.0)) * inside[..., None]).sum(axis=(0, 1))
        value = (self.gw * w).sum() + (self.gt * t).sum() - z.sum() - l2 * n_b / 2 * ((w * w).sum() + (t * t).sum())
        return value / n_b, (self.gw - p.T @ self.x) / n_b - l2 * w, (self.gt - et) / n_b - l2 * t


def fit(texts, rounds=60, l2=1e-4, learnt=lambda kind, how: True):
    """A field fitted to island texts by gradient ascent with momentum; each weight has its own step, which follows the sign of its gradient.

    ``learnt(kind, how)`` leaves out rewrites, to measure what the field makes of spellings that it has not seen."""
    data = []
    for x in [*texts, *numbers_of_things()]:
        spans = base_spans(x)
        data.append(example(x, spans))
        for how in [h for h in range(len(REWRITES[spans[0][2]])) if learnt(spans[0][2], h)] if len(spans) == 1 else []:
            other, span = rewritten(x, spans[0], how)
            if other != x:
                data.append(example(other, [span]))
    data = [x for x in data if x]
    field = Field()
    if not any(gold for _, gold in data):
        field.w[:, 0] = -10.0
        return field
    likelihood = Likelihood(data)
    step_w, step_t = np.full_like(field.w, 0.3), np.full_like(field.t, 0.1)
    old_w, old_t = np.zeros_like(field.w), np.zeros_like(field.t)
    for _ in range(rounds):
        _, gw, gt = likelihood(field.w, field.t, l2)
        for value, g, old, step in ((field.w, gw, old_w, step_w), (field.t, gt, old_t, step_t)):
            turn = np.sign(g * old)
            np.clip(np.where(turn > 0, 1.2 * step, np.where(turn < 0, 0.5 * step, step)), 1e-4, 1.0, out=step)
            g = np.where(turn < 0, 0.0, g)
            value += np.sign(g) * step
            old[:] = g
    return field


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("x", T.StringType()), T.StructField("has", T.BooleanType())])))
def island_texts(text: pd.Series) -> pd.Series:
    def each(x):
        own = (x[t[0][0] : t[-1][1]] for t in islands(x) if len(t) <= FIT_TOKENS)
        return [{"x": y, "has": bool(base_spans(y))} for y in own]

    return text.map(each)


def fitted(docs: DataFrame) -> Field:
    """A field for these documents, from at most ``MAX_ISLANDS`` of their islands with a base span and as many without."""
    session(docs)
    pieces = docs.filter(F.col("text").rlike("[0-9@]")).select(F.explode(island_texts("text")).alias("p")).select("p.*")
    pieces = written(pieces.distinct())
    some = [r.x for has in ("has", "not has") for r in pieces.filter(has).orderBy(F.xxhash64("x"), "x").limit(MAX_ISLANDS).collect()]
    return fit(sorted(some))


def all_spans(field, text):
    """``(base, all)``, each ``[(start, end, kind)]`` in order."""
    base = base_spans(text)
    more = field.added(text, base) if text else []
    return base, sorted(base + more, key=lambda x: (x[0], x[2]))


def joined(spans):
    return ",".join(f"{KINDS[c]}:{s}:{e}" for s, e, c in spans)


def masked(field, text):
    """The text with each span replaced by its kind, as ``[EMAIL]``; overlapping spans become one, named by the first."""
    if not text:
        return text
    out, at = [], 0
    for s, e, c in all_spans(field, text)[1]:
        if s >= at:
            out += [text[at:s], f"[{KINDS[c].upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


FOUND = T.StructType([*[T.StructField(f"n_{k}", T.LongType()) for k in KINDS], T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())])


def summary(field, text):
    base, spans = all_spans(field, text)
    counts = [sum(c == k for _, _, c in base) for k in range(len(KINDS))]
    return *counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)


def scan(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans)`` of each document."""
    field = fitted(docs)

    @F.pandas_udf(FOUND)
    def found(text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(map(partial(summary, field), text), columns=FOUND.names)

    return docs.select("doc_id", found("text").alias("f")).select("doc_id", "f.*")


def redact(docs: DataFrame) -> DataFrame:
    """The documents with personal data masked; ``n_chars`` follows the text where the table has it."""
    field = fitted(docs)

    @F.pandas_udf(T.StringType())
    def clean(text: pd.Series) -> pd.Series:
        return text.map(partial(masked, field))

    out = docs.withColumn("text", clean("text"))
    return out.withColumn("n_chars", F.length("text").cast(out.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op3_semi_markov_crf(spark, sf_dir):
    return scan(table(spark, sf_dir, "documents"))
