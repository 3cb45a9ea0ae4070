"""Main text of web pages by a maximum-scoring subsequence.

A page is read as a sequence of words and tags. A word's score is the sum of
weights: one for being a word, and one for each feature of the place it stands in
(the elements around it, the words of their class, id and role, link, list,
heading); a tag's score is the weight of its name. The weights come from labelled
pages by an averaged perceptron that starts from words +1 and tags -1. One linear
scan finds the contiguous stretch with the highest sum: that is the content
region. Words in it whose own score isn't positive (an advert inside the article,
say) are left out. Only what browsers don't show as text (scripts, styles, markup)
is left out by its element's name.

Defined results: null and empty html give empty text; so does a page without a
word of positive weight. Damaged markup (open quotes, missing end tags, a lone
`<`) never fails: what can't be a tag is text; time is linear in the page's
length, whatever the damage. Repeated rows are read each;
columns besides page_id, url and html are ignored.
"""

from __future__ import annotations

import html as entities
import json
import random
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, tidy

# Element names and the words of class and id attributes, by what they mean for content.
RAW = frozenset("script style noscript template svg math iframe object canvas audio video head title".split())
BOILER = frozenset("nav header footer aside form button select option textarea input label dialog menu address".split())
BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol option p pre section select summary table tbody td textarea tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTAINERS = frozenset("article aside body blockquote button center details dialog div dl fieldset figure footer form header html label main menu nav ol section select table tbody td tfoot th thead tr ul address textarea".split()) | RAW
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LISTS = frozenset("ul ol li dl dt dd".split())
BAD_HINTS = frozenset("ad ads advert adverts advertisement advertising alert banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer discussion disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notification pagination pager popup promo promotion recommended related replies reply respond share sharing shoutbox sidebar signup skip social sponsor sponsored subscribe subscription tags toolbar widget widgets".split())
BAD_ROLES = frozenset("alert banner complementary contentinfo dialog form navigation search menu menubar toolbar".split())
GOOD_HINTS = frozenset("article body content entry main post story text".split())

_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_REST = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
_HINT = re.compile(r"\b(class|id|role|hidden)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"[a-z]+")


def _hints(attributes: str) -> set[str]:
    """The words of class, id and role as features."""
    out = set()
    for kind, *values in _HINT.findall(attributes):
        words = _WORD.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", "".join(values)).lower())
        out.update(f"role {x}" if kind.lower() == "role" else f"hint {x}" for x in words if kind.lower() != "hidden")
    return out


#: Elements that only lay out what is in them, and those that an article can stand in whatever else they are for.
LAYOUT = frozenset(f"in {x}" for x in "table tbody thead tfoot tr td th ul ol dl section center figure".split())
WHOLES = frozenset(("in article", "in main"))
OPEN_NAMES = LAYOUT | frozenset(f"in {x}" for x in "form article main".split())
#: What the tags between two runs of words cost at most, in words.
GAP = 2.5
#: A text of fewer words is a reason to look at the page again without the names of elements that hold most of it.
FEW = 10
WEIGHTS = Path(__file__).with_name("html_weights.json")

#: A text run or a tag: its features (of a tag, one), how often they count, and the text.
Token = tuple[tuple[str, ...], int, str]


@dataclass
class Box:
    """An element: the tokens [first, end) in it, and what its own name, class, id and role say."""

    first: int
    end: int
    own: frozenset[str]


def parse(page: str) -> list[Token]:
    """Text runs and tags in page order. A run counts once for each of its words, white space alone not at all."""
    return read(page)[0]


def read(page: str) -> tuple[list[Token], list[Box]]:
    """The tokens of a page, and its elements in the order in which they begin."""
    out: list[Token] = []
    boxes: list[Box] = []
    stack: list[tuple[str, tuple[str, ...], Box]] = []  # open containers, and the features of what is in them
    opened: Counter = Counter()
    endless: set[str] = set()  # raw elements with no end tag from here on
    link, heading, listed = False, False, 0
    at, n, quotes = 0, len(page), True
    ends = True  # a '>' may still follow

    def words(raw: str) -> None:
        text = entities.unescape(raw)
        if count := len(text.split()):
            around = stack[-1][1] if stack else ()
            out.append((("words", *around, *("listed link" if listed else "link",) * link, *("heading",) * heading, *("list",) * (listed > 0)), count, text))
        elif text and out:
            out.append((("space",), 0, text))

    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            words(page[at:])
            break
        start, named = lt, None
        while lt >= 0:
            if page.startswith(("<!", "<?"), lt) or (ends and (named := _NAME.match(page, lt + 1))):
                break
            lt = page.find("<", lt + 1)
        if lt != start:
            words(page[at:lt] if lt >= 0 else page[at:])
        elif start > at:
            words(page[at:start])
        if lt < 0:
            break
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = end + 3 if end >= 0 else n
            continue
        if named is None:
            end = page.find(">", lt)
            at = end + 1 if end >= 0 else n
            continue
        name = named[2].lower()
        rest = _REST.match(page, named.end()) if quotes else None
        if rest:
            end = rest.end()
        else:
            quotes = False  # an open quote: from here on the next '>' ends a tag
            end = page.find(">", named.end()) + 1
            if not end:
                ends = False
                words(page[lt : lt + 1])
                at = lt + 1
                continue
        attributes, at = page[named.end() : end - 1], end
        closing = bool(named[1])
        if not closing and name in RAW and name != "head":
            close = None if name in endless else _end_of(name).search(page, end)
            out.append((("tag raw",), 1, ""))
            if close:
                at = close.end()
                continue
            endless.add(name)
            if name in ("script", "style"):
                at = n
                continue
        if name in CONTAINERS:
            if closing:
                while opened[name]:
                    last, _, box = stack.pop()
                    box.end = len(out)
                    opened[last] -= 1
                    if last == name:
                        break
            else:
                around = stack[-1][1] if stack else ()
                own = set() if name in ("html", "body") else _hints(attributes) if attributes else set()
                if name not in ("html", "body", "div"):
                    own.add("inner header" if name == "header" and (opened["article"] or opened["main"]) else f"in {name}")
                boxes.append(Box(len(out), -1, frozenset(own)))
                stack.append((name, (*around, *sorted(own.difference(around))), boxes[-1]))
                opened[name] += 1
            link = heading = False
        if name == "a":
            link = not closing
        elif name in HEADINGS:
            heading = not closing
            link = False
        elif name in ("p", "li", "td"):
            link = heading = False
        if name in ("ul", "ol", "dl"):
            listed = max(0, listed + (-1 if closing else 1))
        out.append(((f"tag {name}",), 1, " " if name in BLOCK else ""))
    for _, _, box in stack:
        box.end = len(out)
    return out, boxes


@lru_cache(64)
def _end_of(name: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I)


def weight(weights: dict[str, float], features: tuple[str, ...]) -> float:
    """Of one word or tag. What no labelled page has counts 0, an unknown tag as a tag."""
    if features[0] == "words":
        return sum(weights.get(f, 0.0) for f in features)
    return weights.get(features[0], weights["tag"]) if features[0] != "space" else 0.0


def scores(tokens: list[Token], weights: dict[str, float]) -> list[float]:
    """The score of every token. All tags between two runs of words cost GAP words at most, however many wrappers there are."""
    most = GAP * weights["words"]
    known: dict[tuple[str, ...], float] = {}
    out: list[float] = []
    first, gap = 0, 0.0

    def close() -> None:
        if gap < -most:
            for j in range(first, len(out)):
                out[j] *= most / -gap

    for features, factor, _ in tokens:
        if (w := known.get(features)) is None:
            w = known[features] = weight(weights, features)
        if features[0] == "words":
            close()
            out.append(w * factor)
            first, gap = len(out), 0.0
        else:
            out.append(w * factor)
            gap += w * factor
    close()
    return out


def region(tokens: list[Token], weights: dict[str, float]) -> tuple[int, int]:
    """The stretch [a, b) with the highest sum; of equal sums the first, and the longest from there."""
    best, span = 0.0, (0, 0)
    total, start = 0.0, 0
    for i, (score, (_, factor, _)) in enumerate(zip(scores(tokens, weights), tokens, strict=True)):
        if total <= 0 and not (total == 0 and factor == 0):
            total, start = 0.0, i
        total += score
        if total > best or (total == best and best > 0 and span[0] == start):
            best, span = total, (start, i + 1)
    return span


def content(features: tuple[str, ...], weights: dict[str, float], strict: bool = False) -> bool:
    """Whether a run stays. In the region one is left out if its weight isn't positive and what elements around it are called speaks against it too; strict asks for a positive weight. Tables and lists as such speak against nothing."""
    if strict:
        return sum(weights.get(f, 0.0) for f in features if f not in LAYOUT) > 0
    return weight(weights, features) > 0 or sum(weights.get(f, 0.0) for f in features if f.startswith(("in ", "hint ", "role ")) and f not in LAYOUT) >= 0


def text_of(tokens: list[Token], span: tuple[int, int], weights: dict[str, float], wide: tuple[int, int] | None = None) -> str:
    """Blocks in page order, with white space inside and between them as one space; of what wide adds to span, runs with a weight above 0."""
    a, b = wide or span
    known: dict[tuple[bool, tuple[str, ...]], bool] = {}
    parts = []
    for i in range(a, b):
        features, _, text = tokens[i]
        if features[0] == "words":
            key = (not span[0] <= i < span[1], features)
            if (good := known.get(key)) is None:
                good = known[key] = content(features, weights, key[0])
            text = text if good else " "
        parts.append(text)
    return " ".join("".join(parts).split())


def widened(tokens: list[Token], boxes: list[Box], span: tuple[int, int], weights: dict[str, float]) -> tuple[int, int]:
    """The region with the headings right before it, and the rest of the article (or main part) around it that it fills by half at least."""
    a, b = span
    if a == b:
        return span
    sums = [0]
    for features, factor, _ in tokens:
        sums.append(sums[-1] + factor * (features[0] == "words" and content(features, weights, True)))
    for box in reversed([x for x in boxes if x.first <= span[0] and x.end >= span[1] and x.own & WHOLES]):
        if sums[box.end] - sums[box.first] > 2 * (sums[b] - sums[a]):
            break
        a, b = min(a, box.first), max(b, box.end)
    i = a - 1
    while i >= 0 and (tokens[i][0][0] != "words" or ("heading" in tokens[i][0] and content(tokens[i][0], weights, True))):
        a = i if tokens[i][0][0] == "words" else a
        i -= 1
    return a, b


#: Words of labelled pages that aren't content begin with this.
NOISE = "~"


def train(pages: list[str], rounds: int = 10) -> dict[str, float]:
    """Weights from labelled pages, by an averaged perceptron: on each run by itself, and on the region from the first content run to the last."""
    parsed = []
    for page in pages:
        tokens = parse(page)
        runs = [i for i, x in enumerate(tokens) if x[0][0] == "words"]
        content = [i for i in runs if NOISE not in tokens[i][2]]
        parsed.append((tokens, [(tokens[i][0], 1 if NOISE not in tokens[i][2] else -1) for i in runs], (content[0], content[-1] + 1)))
    weights: dict[str, float] = {"words": 1.0, "tag": -1.0}
    total: Counter = Counter()
    seen = 0

    def add(features: tuple[str, ...], by: float) -> None:
        for f in features:
            weights[f] = weights.get(f, weights["tag"] if f.startswith("tag ") else 0.0) + by

    def counts(tokens: list[Token], span: tuple[int, int]) -> Counter:
        out: Counter = Counter()
        for features, factor, _ in tokens[span[0] : span[1]]:
            if factor:
                out[features] += factor
        return out

    for _ in range(rounds):
        for tokens, runs, gold in parsed:
            for features, label in runs:
                if label * weight(weights, features) <= 0.5 and any(f != "words" for f in features):  # plain words are the region's matter
                    add(features[1:], 0.2 * label)
            guess = region(tokens, weights)
            if guess != gold:
                a, b = counts(tokens, gold), counts(tokens, guess)
                both = {k: a[k] - b[k] for k in {*a, *b}}
                size = sum(map(abs, both.values())) or 1
                for features, k in both.items():
                    add(features[:1], k / size)
                weights["words"] = max(weights["words"], 0.2)  # the sign that the method rests on
            total.update(weights)
            seen += 1
    return {k: v / seen for k, v in total.items()}


def labelled_pages(n: int = 300, seed: int = 5) -> list[str]:
    """Pages of several layouts made from invented words; those that aren't content begin with NOISE.

    They know the usual names of page parts. Some parts have no telling name at
    all: a few words among many tags, which only the region leaves out.
    """
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 9)))
    say = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))
    noise = lambda a, b: " ".join(NOISE + word() for _ in range(rng.randint(a, b)))
    links = lambda a, b: "".join(f'<li><a href="/{word()}">{noise(1, 2)}</a></li>' for _ in range(rng.randint(a, b)))

    def part(inside: bool) -> str:
        """A part with a telling name."""
        k = rng.random()
        body = rng.choice([f"<p>{noise(3, 60)}</p>", noise(2, 40), f"<ul>{links(2, 7)}</ul>", f"<h2>{noise(1, 3)}</h2><p>{noise(4, 60)}</p><p>{noise(4, 60)}</p>", f"<a href='/'>{noise(1, 4)}</a>"])
        if k < 0.35:
            name = rng.choice(sorted(BOILER - {"option", "input", "select", "address"} - ({"header"} if inside else set())))
            return f"<{name}>{body}</{name}>"
        if k < 0.45:
            return f'<div role="{rng.choice(sorted(BAD_ROLES))}">{body}</div>'
        kind, hints = rng.choice(["class", "id"]), [rng.choice(sorted(BAD_HINTS)), *[rng.choice(["box", "block", "inner", "x1"])] * (rng.random() < 0.3)]
        name = rng.choice(["div", "div", "section", "aside", "ul", "p"]) if kind == "class" else "div"
        return f'<{name} {kind}="{rng.choice(["-", " ", "_"]).join(hints)}">{noise(2, 60) if name == "p" else links(2, 6) if name == "ul" else body}</{name}>'

    def bare() -> str:
        """Parts without a name."""
        return rng.choice([f"<ul>{links(3, 9)}</ul>", "".join(f"<div><span>{noise(1, 2)}</span></div>" for _ in range(rng.randint(2, 5))), f"<div><div><a href='/'><b>{noise(1, 2)}</b></a></div></div>", f"<table><tr><td><span>{noise(1, 1)}</span></td><td><i>{noise(1, 1)}</i></td></tr></table>"])

    def some(most: int, chance: float, make: Callable[[], str]) -> str:
        return "".join(make() for _ in range(most) if rng.random() < chance)

    out = []
    for _ in range(n):
        end = lambda: "</p>" if rng.random() < 0.8 else ""
        blocks = [rng.choice([f"<p>{say(12, 120)}{end()}", f"<p>{say(12, 60)}{end()}", f"<p><b>{say(6, 12)}<br>{say(4, 20)}{end()}", f'<p>{say(5, 40)} <a href="/x">{say(1, 3)}</a> {say(5, 40)}{end()}', f"<p>{say(1, 6)}{end()}"]) for _ in range(rng.randint(2, 12))]
        if rng.random() < 0.25:
            blocks.insert(rng.randint(1, len(blocks)), "<ul>" + "".join(f"<li>{say(6, 16)}</li>" for _ in range(3)) + "</ul>")
        if rng.random() < 0.5:
            blocks.insert(rng.randint(1, len(blocks)), part(True))
        head = f"<h1>{say(1, 9)}</h1>" if rng.random() < 0.7 else ""
        shell = rng.choice(["article", "article", "main", "section", "td", "div", *[f'div {rng.choice(["id", "class"])}="{rng.choice(sorted(GOOD_HINTS))}{rng.choice(["", "-box", "-text"])}"' for _ in range(3)]])
        head = f"<header>{head}</header>" if head and shell in ("article", "main") and rng.random() < 0.3 else head
        name = shell.split()[0]
        outer = rng.choice(["", "", f'<div class="{rng.choice(sorted(GOOD_HINTS))}">', '<div id="wrap">'])
        page = f"{some(3, 0.5, lambda: part(False))}{some(1, 0.4, bare)}<{shell}>{head}{''.join(blocks)}{some(1, 0.2, lambda: part(True))}</{name}>{some(3, 0.4, lambda: part(False))}{some(1, 0.3, bare)}"
        foot = f"<footer>&copy; {noise(3, 40)}</footer>" if rng.random() < 0.8 else ""
        out.append(f"<!DOCTYPE html><html><head><title>{noise(3, 9)}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head><body>{outer}{page}{'</div>' if outer else ''}{foot}</body></html>")
    return out


def without_names(tokens: list[Token], boxes: list[Box], span: tuple[int, int], weights: dict[str, float]) -> list[Token] | None:
    """The tokens, when forms and other elements with more than half of the page's words don't count by their names; None if there is no such element.

    A part that isn't content is a part: what nearly the whole page stands in (a
    page-wide form, an article of class `shared-widget`) is no such part. Where
    something was found outside of it that isn't a mere heading, its name stands.
    """
    sums = [0]
    for features, factor, _ in tokens:
        sums.append(sums[-1] + factor * (features[0] == "words"))
    found = [x[0] for x in tokens[span[0] : span[1]] if x[0][0] == "words"]
    bare = all("heading" in x for x in found)
    large = [
        x for x in boxes
        if x.own and 2 * (sums[x.end] - sums[x.first]) > sums[-1] and not any(f.startswith("in ") and f not in OPEN_NAMES for f in x.own)
        and sum(weights.get(f, 0.0) for f in x.own) < 0 and (bare or x.first <= span[0] and x.end >= span[1])
    ]
    if not large:
        return None
    gone = frozenset().union(*[x.own for x in large])
    low, high = large[0].first, max(x.end for x in large)
    return [(tuple(f for f in x[0] if f not in gone), *x[1:]) if low <= i < high and x[0][0] == "words" else x for i, x in enumerate(tokens)]


def extract(page: str | None, weights: dict[str, float]) -> str:
    if not page:
        return ""
    tokens, boxes = read(page)
    span = region(tokens, weights)
    found = text_of(tokens, span, weights, widened(tokens, boxes, span, weights))
    if len(found.split()) < FEW and (again := without_names(tokens, boxes, span, weights)):
        span = region(again, weights)
        found = text_of(again, span, weights, widened(again, boxes, span, weights))
    return found


@lru_cache(1)
def shipped_weights() -> dict[str, float]:
    """The result of train(labelled_pages()), kept beside the module; `python -m folioscope.llm.html_text` makes it anew."""
    return json.loads(WEIGHTS.read_text())


def extract_pages(pages: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every page; one pass, no shuffle."""
    own = weights or shipped_weights()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, column="html"):
            texts = [extract(x, own) for x in part.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    return rows.mapInArrow(tidy(run), "page_id long, url string, text string, n_chars long")


if __name__ == "__main__":
    WEIGHTS.write_text(json.dumps({k: round(v, 6) for k, v in sorted(train(labelled_pages()).items())}, indent=0) + "\n")
