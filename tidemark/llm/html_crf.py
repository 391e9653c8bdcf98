"""Main text of web pages: a linear-chain CRF over DOM leaf blocks, decoded by Viterbi.

A page is read into leaf blocks in one pass; blocks point to the marked elements around them (landmark elements, and elements whose
class or id holds a word of OTHER or CONTENT), which form a tree with the prose that each holds. Blocks get binary features of these marks, of
their element and of their text; marks are evidence beside the text, and the mark of an element that holds more of its page's prose than such a part does counts for nothing: the less a mark is
worth, the sooner. A chain of two labels, main and other, is trained on labelled pages and finds each page's best labelling.

Labelled pages: those of llm/html_pages.py, labelled by hand, and at most SAMPLE different pages of the table. A page of the table is labelled by its own
<article> or <main> alone; class words label nothing, and pages that have such words or landmarks inside that element teach nothing, nor do those of over MOST_BLOCKS
blocks. Each page is learned twice, once without its marks, so that text features are learned as well.

A page with prose of which nothing is decoded as main is decoded again without its marks, as far as no element or whole name marks a block otherwise; if that finds nothing either, its main text is the
stretch with most prose.

Defined results: null and empty html gives an empty text; a no-break space is a character like any other; markup cut off at the end is no text; a quote that is not closed
ends with its tag; repeated pages keep one row each; pages of any length and depth are decoded whole, in time and memory of their length.
"""

import html
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import table
from tidemark.llm.html_pages import PAGES

#: Most pages of the table that training uses, and most blocks of such a page.
SAMPLE, MOST_BLOCKS = 300, 400
STEPS, RATE, DECAY, STILL = 300, 0.5, 0.3, 1e-4
#: Part of a page's prose that must stand outside a marked element for its mark to count, by how it is marked; for comments, which may be longer than their article.
OUTSIDE, OUTSIDE_COMMENTS = {"element": 0.15, "name": 0.25, "part": 0.5}, 0.03
#: Words that make a block prose.
PROSE_WORDS = 8

_TAG = re.compile(r"<(?:!--|[!?]|(/?)([a-zA-Z][^\s/>]*))")
_NAME = re.compile(r"[\s/]*([^\s/>=][^\s/>=]*|=[^\s/>=]*|)\s*(=?)\s*")
_BARE = re.compile(r"[^\s>]*")
_HIDDEN = re.compile(r"display\s*:\s*none", re.I)
_SPACE = re.compile(r"[ \t\n\x0b\f\r]+")
_LONG_NUMBER = re.compile(r"&#[0-9]{1000,};?")
#: Elements whose content is raw text or never shown; those of the second group only if they are closed.
RAW = frozenset("script style textarea title template xmp noembed".split())
SHUT = frozenset("noscript iframe object svg math select option button".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: A start tag closes open elements of these names, up to the nearest container.
CLOSES = {"li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "tr": ("tr", "td", "th", "p"), "td": ("td", "th", "p"), "th": ("td", "th", "p")}
CONTAINERS = frozenset("html body div article section main aside nav header footer ul ol dl table form blockquote fieldset details figure".split())
#: Words in class and id names that mark parts of a page.
CONTENT = frozenset("article main content post entry story body articlebody hentry".split())
OTHER = {
    "nav": "nav navigation navbar menu breadcrumb breadcrumbs toc pagination pager skip topbar toolbar tabs",
    "header": "header masthead banner logo",
    "footer": "footer copyright colophon legal imprint",
    "side": "aside sidebar widget related recommended recommendations popular trending complementary tags",
    "notice": "notice cookie cookies consent gdpr alert popup modal overlay newsletter subscribe subscription paywall disclaimer warning",
    "ad": "ad ads advert advertisement adverts adsense sponsor sponsored promo promotion promoted",
    "social": "share sharing social follow",
    "comment": "comment comments reply replies discussion disqus responses respond",
    "form": "form search login signup signin contact",
}
#: Words after another one that say no more than that an element holds it.
HOLDERS = frozenset("area wrapper container list section box inner block bar top main thread".split())
#: Words that make a name describe the whole page or element: what they speak of is not in it, or only part of it.
DESCRIBING = frozenset("no not non without has have with is hide hidden show layout template page col cols grid theme single".split())
#: Words that say little by themselves.
WEAK = frozenset("widget tags trending".split())
_KIND = {word: kind for kind, words in OTHER.items() for word in words.split()}
#: Elements that are marks by themselves.
LANDMARKS = {"article": "content", "main": "content", "nav": "nav", "header": "header", "footer": "footer", "aside": "side", "form": "form", "menu": "nav", "dialog": "notice"}


def attributes(page: str, at: int, lost: set) -> tuple[dict[str, str], int]:
    """The attributes of the tag whose name ends at `at`, and where the tag ends. A quote that has no end is read as a bare value; `lost` has the quotes of which no more follow."""
    out: dict[str, str] = {}
    n = len(page)
    while at < n:
        m = _NAME.match(page, at)
        at = m.end()
        if at >= n:
            break
        value, ch = "", page[at]
        if m[2]:
            end = page.find(ch, at + 1) if ch in "\"'" and ch not in lost else -1
            if end >= 0:
                value, at = page[at + 1 : end], end + 1
            else:
                if ch in "\"'":
                    lost.add(ch)
                bare = _BARE.match(page, at)
                value, at = bare[0], bare.end()
        elif not m[1]:  # only '>' can stand here
            return out, at + 1
        if m[1]:
            out.setdefault(m[1].lower(), value)
    return out, n


def mark(tag: str, given: dict[str, str]) -> tuple[str, str] | None:
    """What an element marks: a kind of OTHER or 'content', and how it says so: 'element', 'name' (a whole class or id) or 'part' (a word in one)."""
    own = LANDMARKS.get(tag)
    found: dict[str, str] = {}
    for name in f"{given.get('class', '')} {given.get('id', '')} {given.get('role', '')}".lower().split():
        words = re.split(r"[-_]+", name)
        if words[0] in DESCRIBING and len(words) > 1:
            continue
        kinds = [_KIND[w] for w in words if w in _KIND] or ["content"] * (not CONTENT.isdisjoint(words))
        if kinds:
            how = "part" if words[-1] in WEAK or words == ["widget"] else "name" if words[-1] in _KIND or len(words) == 1 or (words[0] in _KIND and words[0] != "widget" and len(words) == 2 and words[1] in HOLDERS) else "part"
            if found.get(kinds[-1]) != "name":
                found[kinds[-1]] = how
    if "comment" in found:
        return "comment", found["comment"]
    if own:
        return own, "element"
    others = [k for k in found if k != "content"]
    if named := [k for k in others if found[k] == "name"]:
        return named[0], "name"
    if "content" in found:
        return "content", found["content"]
    return (others[0], "part") if others else None


class Page:
    """A page's leaf blocks in order: text, characters inside links, label (data-main), own element, whether in a list, and innermost mark. Marks: parent, kind, how, prose."""

    def __init__(self):
        self.blocks: list[tuple[str, int, bool, str, bool, int]] = []
        self.marks: list[tuple[int, str, str]] = []
        self.prose: list[int] = []

    def outside(self) -> list[bool]:
        """For each mark, whether it counts: enough of the page's prose stands outside its element."""
        held, total = self.prose[:], 0
        for text, linked, *_, at in self.blocks:
            if 2 * linked < len(text) and text.count(" ") + 1 >= PROSE_WORDS:
                total += len(text)
                if at >= 0:
                    held[at] += len(text)
        for i in range(len(held) - 1, -1, -1):
            if (parent := self.marks[i][0]) >= 0:
                held[parent] += held[i]
        return [kind == "content" or n <= 0 or total - n >= (OUTSIDE_COMMENTS if kind == "comment" else OUTSIDE[how]) * total for n, (_, kind, how) in zip(held, self.marks)]


def parsed(page: str) -> Page:
    """Reads a page in one pass; every element on the stack carries what its descendants need, so that nothing is searched for."""
    out = Page()
    # element, innermost mark, own block, in a list, in a link, labelled main, hidden, nearest container below
    stack: list[tuple[str, int, str, bool, bool, bool, bool, int]] = []
    top = ("", -1, "body", False, False, False, False, -1)
    open_: dict[str, list[int]] = {}
    parts: list[str] = []
    linked, lost, endless, known = 0, set(), set(), {}

    def flush():
        nonlocal linked
        if parts:
            text = _SPACE.sub(" ", html.unescape(_LONG_NUMBER.sub("�", "".join(parts)))).strip(" \t\n\x0b\f\r")
            if text:
                out.blocks.append((text, linked, top[5], top[2], top[3], top[1]))
            parts.clear()
        linked = 0

    def close(upto: int):
        nonlocal top
        while len(stack) > upto:
            open_[stack.pop()[0]].pop()
        top = stack[-1] if stack else ("", -1, "body", False, False, False, False, -1)

    def nearest(tags) -> int:
        """The innermost open element of these names that no container encloses further in, or -1."""
        i = max((open_[t][-1] for t in tags if open_.get(t)), default=-1)
        return i if i > top[7] else -1

    at, n = 0, len(page)
    while at < n:
        m = _TAG.search(page, at)
        end = m.start() if m else n
        if end > at and not top[6]:
            parts.append(page[at:end])
            linked += (end - at) * top[4]
        if not m:
            break
        at = m.end()
        if not m[2]:
            close_with = "-->" if m[0] == "<!--" else ">"
            at = page.find(close_with, at)
            at = n if at < 0 else at + len(close_with)
            continue
        tag = m[2].lower()
        given, at = attributes(page, at, lost)
        if m[1]:
            if tag in CONTAINERS:
                i = open_[tag][-1] if open_.get(tag) else -1
            else:
                i = nearest((tag,))
            if i >= 0 or tag == "p":
                if tag in BLOCKS:
                    flush()
                if i >= 0:
                    close(i)
            continue
        if tag in RAW or tag in SHUT:
            parts.append(" ")
            if page[at - 2 : at] == "/>":
                continue
            if tag not in endless:
                shut = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, at)
                if shut:
                    at = shut.end()
                    continue
                endless.add(tag)
            if tag in RAW:
                at = n
            continue
        if tag in VOID:
            if tag in ("br", "hr") and not top[6]:
                parts.append(" ")
            continue
        if tag in BLOCKS:
            flush()
            if (i := nearest(CLOSES.get(tag, ("p",)))) >= 0:
                close(i)
        key = (tag, given.get("class"), given.get("id"), given.get("role"))
        if key not in known:
            known[key] = mark(tag, given)
        at_mark = top[1]
        if known[key] and tag not in ("body", "html"):
            out.marks.append((at_mark, *known[key]))
            out.prose.append(0)
            at_mark = len(out.marks) - 1
        hides = top[6] or "hidden" in given or given.get("aria-hidden", "").lower() == "true" or "style" in given and bool(_HIDDEN.search(given["style"]))
        open_.setdefault(tag, []).append(len(stack))
        top = (tag, at_mark, tag if tag in BLOCKS else top[2], top[3] or tag in ("ul", "ol"), top[4] or tag == "a", top[5] or "data-main" in given, hides, len(stack) if tag in CONTAINERS else top[7])
        stack.append(top)
    flush()
    return out


HOWS = ("element", "name", "part")
NAMES = [
    "bias", *[f"inner={k}" for k in ("content", "other", "none")], *[f"{how}={kind}" for how in HOWS for kind in OTHER], *[f"{how} in content" for how in HOWS], "others in content",
    "tag=p", "tag=h", "tag=li", "tag=div", "tag=cell", "tag=other", "links=0", "links<half", "links>half",
    "words<3", "words<8", "words<20", "words<60", "words>60", "ends", "no end", "comma", "capital", "sign", "bar", "digits", "list", "first", "last", "notice words", "near heading", "address", "elsewhere", "after comments", "comments head", "row of cells", "most prose", "prose of it", "letter",
]
_NUMBER = {n: i for i, n in enumerate(NAMES)}
MARKED = slice(_NUMBER["inner=content"], _NUMBER["tag=p"])
_TAGS = {"p": "tag=p", "pre": "tag=p", "blockquote": "tag=p", "li": "tag=li", "dd": "tag=li", "dt": "tag=li", "td": "tag=cell", "th": "tag=cell", "div": "tag=div", "section": "tag=div", "article": "tag=div", "main": "tag=div"} | {f"h{i}": "tag=h" for i in range(1, 7)}
#: How texts send the reader elsewhere, and what stands above readers' comments.
_ELSEWHERE = re.compile(r"(?:read|see|watch|listen)\s+(?:also|more|next|on)\b|(?:lesen|siehe)\s+(?:sie\s+)?auch\b|(?:à\s+)?lire\s+aussi\b|(?:lea|vea|ver|leer)\s+también\b|related\b|more (?:from|on|about)\b|you (?:may|might) also", re.I)
_COMMENTS = re.compile(r"(?:\(?\d+\)?\s*)?(?:reader(?:s'?|'s)?\s+|leser)?(?:comments?|responses?|replies|kommentare?|commentaires?|comentarios?|respuestas|réactions)(?:\s*\(?\d*\)?)?\s*:?$|leave a (?:reply|comment)|join the (?:discussion|conversation)|what (?:readers|others) say", re.I)
_NOTICE = re.compile(r"cookie|all rights reserved|privacy|log in|advert", re.I)
_LETTER = re.compile(r"subscribe|sign up|newsletter|abonnieren|abonnez|suscríb", re.I)


def evidence(page: Page) -> list[tuple[int, ...]]:
    """For each mark, the feature numbers that it and the marks around it give; they are at most as many as NAMES."""
    out, shared, counts = [], {}, page.outside()
    for (parent, kind, how), use in zip(page.marks, counts):
        above = set(out[parent]) if parent >= 0 else {_NUMBER["inner=none"]}
        within = _NUMBER["inner=content"] in above or any(_NUMBER[f"{h} in content"] in above for h in HOWS)
        if use and not (kind == "header" and how == "element" and within):  # a header inside content is a title
            above -= {_NUMBER[f"inner={k}"] for k in ("content", "other", "none")}
            if kind == "content":
                above |= {_NUMBER["inner=content"], _NUMBER[f"{how} in content"]}
            else:
                above |= {_NUMBER["inner=other"], _NUMBER[f"{how}={kind}"]} | ({_NUMBER["others in content"]} if within else set())
        own = tuple(sorted(above))
        out.append(shared.setdefault(own, own))
    return out


def prose_runs(page: Page) -> list[bool]:
    """For each block, whether it stands in the stretch that holds most prose of its page; links, and what stands above comments, part stretches."""
    run, held, of = 0, [0], []
    for text, linked, *_ in page.blocks:
        if 2 * linked >= len(text) or (text.count(" ") < 7 and _COMMENTS.match(text)):
            held.append(0)
            run = len(held) - 1
        elif text.count(" ") + 1 >= PROSE_WORDS:
            held[run] += len(text)
        of.append(run)
    most = max(range(len(held)), key=held.__getitem__)
    return [x == most and held[x] > 0 and 2 * b[1] < len(b[0]) for x, b in zip(of, page.blocks)]


def features(page: Page) -> list[list[int]]:
    """The numbers of each block's features."""
    marks, out, heading, commented = evidence(page), [], False, False
    own_tags, most = [own for *_, own, _, _ in page.blocks], prose_runs(page)
    none = (_NUMBER["inner=none"],)
    for i, (text, linked, _, own, listed, at) in enumerate(page.blocks):
        n = text.count(" ") + 1
        kind = _TAGS.get(own, "tag=other")
        names = ["bias", kind]
        names.append("links=0" if not linked else "links<half" if 2 * linked < len(text) else "links>half")
        names.append("words<3" if n < 3 else "words<8" if n < 8 else "words<20" if n < 20 else "words<60" if n < 60 else "words>60")
        names.append("ends" if text[-1] in ".!?:;\"'”»)" else "no end")
        for name, holds in (("comma", ", " in text), ("capital", text[0].isupper()), ("sign", "©" in text), ("bar", "|" in text or "·" in text), ("digits", text[0].isdigit()), ("list", listed), ("first", i == 0), ("last", i == len(page.blocks) - 1), ("notice words", n < 25 and _NOTICE.search(text)), ("near heading", heading), ("letter", n < 25 and _LETTER.search(text)), ("address", own == "address"), ("elsewhere", n < 25 and _ELSEWHERE.match(text)), ("after comments", commented), ("most prose", most[i]), ("prose of it", most[i] and n >= PROSE_WORDS), ("row of cells", kind == "tag=cell" and (own_tags[i - 1 : i] == [own] or own_tags[i + 1 : i + 2] == [own]))):
            if holds:
                names.append(name)
        if n < 8 and (kind != "tag=p" or n < 4) and _COMMENTS.match(text):
            names.append("comments head")
            commented = True
        heading = kind == "tag=h"
        out.append([*(_NUMBER[x] for x in names), *(marks[at] if at >= 0 else none)])
    return out


def hide_marks(numbers: list[list[int]]) -> list[list[int]]:
    return [[x for x in own if not MARKED.start <= x < MARKED.stop] + [_NUMBER["inner=none"]] for own in numbers]


def labelled(page: str) -> tuple[list[list[int]], list[int]] | None:
    """A page's features and labels by its own <article> or <main>, if nothing in that element is marked otherwise."""
    found = parsed(page)
    if not 2 <= len(found.blocks) <= MOST_BLOCKS:
        return None
    inside: list[bool | None] = []  # None: marked otherwise, inside the article
    for parent, kind, how in found.marks:
        held = inside[parent] if parent >= 0 else False
        if held is False:
            inside.append(kind == "content" and how == "element")
        else:
            inside.append(True if held and kind in ("content", "header") else None)
    labels = [inside[at] if at >= 0 else False for *_, at in found.blocks]
    if None in labels or not any(labels) or all(labels):
        return None
    return features(found), [int(x) for x in labels]


def gradient(x: np.ndarray, y: np.ndarray, live: np.ndarray, weight: np.ndarray, w: np.ndarray, t: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Conditional log likelihood of weighted chains of one padded length and its gradients, by forward and backward sums. x: (chains, blocks, features)."""
    long = x.shape[1]
    e = (x @ w) * live[..., None]
    forward, backward = np.zeros_like(e), np.zeros_like(e)
    forward[:, 0] = e[:, 0]
    for s in range(1, long):
        step = np.logaddexp(forward[:, s - 1, :1] + t[0], forward[:, s - 1, 1:] + t[1]) + e[:, s]
        forward[:, s] = np.where(live[:, s, None], step, forward[:, s - 1])
    for s in range(long - 2, -1, -1):
        ahead = e[:, s + 1] + backward[:, s + 1]
        step = np.logaddexp(t[:, 0] + ahead[:, :1], t[:, 1] + ahead[:, 1:])
        backward[:, s] = np.where(live[:, s + 1, None], step, 0)
    z = np.logaddexp(forward[:, -1, 0], forward[:, -1, 1])
    node = np.exp(forward + backward - z[:, None, None]) * live[..., None]
    pairs = live[:, 1:] & live[:, :-1]
    edge = np.exp(forward[:, :-1, :, None] + t + (e + backward)[:, 1:, None, :] - z[:, None, None, None]) * pairs[..., None, None]
    one = np.eye(2)[y] * live[..., None]
    seen = one[:, :-1, :, None] * one[:, 1:, None, :]
    score = (e * one).sum((1, 2)) + (seen * t).sum((1, 2, 3)) - z
    left = ((one - node) * weight[:, None, None]).reshape(-1, 2)
    return float(score @ weight), x.reshape(-1, x.shape[2]).T @ left, ((seen - edge) * weight[:, None, None, None]).sum((0, 1))


def fit(pages: list[tuple[list[list[int]], list[int], float]]) -> tuple[np.ndarray, np.ndarray]:
    """Weights (features by labels) and transitions by gradient ascent on the conditional log likelihood of (features, labels, weight); it ends when the likelihood stands still.
    Equal chains are one chain of greater weight, and chains are held in groups of like length."""
    alike: Counter = Counter()
    for f, y, weight in pages:
        for own in (f, hide_marks(f)):
            alike[tuple(tuple(sorted(set(v))) for v in own), tuple(y)] += weight
    groups: dict[int, list] = {}
    for (f, y), weight in sorted(alike.items()):
        groups.setdefault(max(2, 1 << (len(y) - 1).bit_length()), []).append((f, y, weight))
    held = []
    for long, some in groups.items():
        x, y, live = np.zeros((len(some), long, len(NAMES))), np.zeros((len(some), long), np.int64), np.zeros((len(some), long), bool)
        for i, (f, own, _) in enumerate(some):
            for s, v in enumerate(f):
                x[i, s, list(v)] = 1
            y[i, : len(own)], live[i, : len(own)] = own, True
        held.append((x, y, live, np.array([weight for *_, weight in some], float)))
    w, t = np.zeros((len(NAMES), 2)), np.zeros((2, 2))
    square, last = [np.full_like(w, 1e-8), np.full_like(t, 1e-8)], -np.inf
    for step in range(STEPS):
        got = [gradient(*g, w, t) for g in held]
        value = sum(v for v, *_ in got) - DECAY / 2 * ((w * w).sum() + (t * t).sum())
        if step > 20 and abs(value - last) < STILL * abs(value):
            break
        last = value
        for p, g, sq in zip((w, t), (sum(g for _, g, _ in got) - DECAY * w, sum(g for *_, g in got) - DECAY * t), square):
            sq += g * g
            p += RATE * g / np.sqrt(sq)
    return w, t


def viterbi(numbers: list[list[int]], w: list, t: list) -> list[int]:
    """The likeliest labels of a chain."""
    if not numbers:
        return []
    gain = [b - a for a, b in w]
    d = [(0.0, sum(gain[i] for i in own)) for own in numbers]
    (a, b), back = d[0], []
    t00, t01, t10, t11 = t[0][0], t[0][1], t[1][0], t[1][1]
    for e0, e1 in d[1:]:
        stay0, stay1 = a + t00 >= b + t10, a + t01 > b + t11
        back.append((0 if stay0 else 1, 0 if stay1 else 1))
        a, b = max(a + t00, b + t10) + e0, max(a + t01, b + t11) + e1
    out = [int(b > a)]
    for step in reversed(back):
        out.append(step[out[-1]])
    return out[::-1]


def train(pages: DataFrame, column: str = "html") -> tuple[list, list]:
    """The model, as lists. The table gives the SAMPLE different pages of least hash."""

    def run(batches):
        for batch in batches:
            got = [x for p in batch.column(0).to_pylist() if (x := labelled(p))]
            yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in got], pa.list_(pa.list_(pa.int64()))), pa.array([y for _, y in got], pa.list_(pa.int64()))], ["f", "y"])

    hashed = pages.where(F.col(column).isNotNull()).select(F.xxhash64(column).alias("h"), F.col(column).alias("page"))
    least = [r.h for r in hashed.select("h").distinct().orderBy("h").limit(SAMPLE).collect()]
    some = hashed.where(F.col("h").isin(least)).groupBy("h").agg(F.min("page").alias("page")).select("page") if least else hashed.select("page")
    cases = [([list(f) for f in r.f], list(r.y)) for r in some.mapInArrow(run, "f array<array<long>>, y array<long>").collect()]
    # All pages of the table weigh as much as those labelled by hand.
    weighed = [(f, y, min(1.0, len(PAGES) / len(cases))) for f, y in cases]
    for page in PAGES:
        found = parsed(page)
        weighed.append((features(found), [int(b[2]) for b in found.blocks], 1.0))
    w, t = fit(weighed)
    return w.tolist(), t.tolist()


def labels(found: Page, w: list, t: list) -> list[int]:
    """The best labelling; where it finds nothing on a page with prose, the best one by the text alone of what no strong mark excludes."""
    numbers = features(found)
    best = viterbi(numbers, w, t)
    if any(best) or not any(2 * linked < len(text) and text.count(" ") + 1 >= PROSE_WORDS for text, linked, *_ in found.blocks):
        return best
    strong = {_NUMBER[f"{how}={kind}"] for how in ("element", "name") for kind in OTHER}
    for again in (viterbi(hide_marks(numbers), w, t), [_NUMBER["prose of it"] in own for own in numbers]):
        best = [int(main and strong.isdisjoint(own)) for main, own in zip(again, numbers)]
        if any(best):
            break
    return best


def main_text(page: str | None, w: list, t: list) -> str:
    found = parsed(page or "")
    return " ".join(b[0] for b, main in zip(found.blocks, labels(found, w, t)) if main)


def extracted(pages: DataFrame, columns: list[str], column: str = "html") -> DataFrame:
    """The named columns of pages and _tm_text, the main text."""
    given = pages.sparkSession.sparkContext.broadcast(train(pages, column))

    def run(batches):
        w, t = given.value
        for batch in batches:
            text = pa.array([main_text(p, w, t) for p in batch.column("_tm_html").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), text], [*columns, "_tm_text"])

    picked = pages.select(*columns, F.col(column).alias("_tm_html"))
    return picked.mapInArrow(run, picked.select(*columns, F.lit("").alias("_tm_text")).schema)


def op1(spark, sf_dir) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extracted(pages, ["page_id", "url"]).select("page_id", "url", F.col("_tm_text").alias("text"), F.length("_tm_text").cast("long").alias("n_chars"))
