"""Personal information in free text: mailboxes, phones, identity numbers, street addresses, names.

A character-level BiLSTM-CRF reads the text and tags mentions; what it decodes is what is found. It reads every line of
every text from end to end, in windows; a window that occurred before is not read again. The tagger is trained on a
bounded sample of documents: on windows around places where a mention could be by a look at character classes (a sign
for "at", runs of digits, a number next to a capitalised word, capitals in a row), on other lines, and once more on
those windows of the sample that it then reads otherwise than they are labelled. They are labelled by the known forms of numbers and addresses and, for names, by a lexicon that the
sample itself gives: family names are what stands behind initials, given names what stands before many of them, and so
on in turns. In part of the training windows other words of the sample take a name's place, so that the tagger learns
where names stand and not only how these ones are spelt. Long lines are read in overlapping windows, of which each
character takes the tag from the window in whose middle it lies nearer. A decoded span is then only put on word limits
or, where a form of its type overlaps it, on that form's ends.

Defined cases: null and empty texts have no mentions; texts are read whole, however long; a mention found in two
windows counts once; repeated rows of a document give each mention once; line ends are left as they are, and positions
count code points of the text as stored.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from factloom.llm.tagger import Tagger
from factloom.operators.sampling import smallest_hashes
from factloom.session import cut

TYPES = ("email", "phone", "id_number", "street_address", "person_name")
TAGS = 1 + 2 * len(TYPES)
_NAME_STARTS = 1 + 2 * TYPES.index("person_name")
#: Documents whose windows are labelled for training at most, and windows and lines without places trained on.
SAMPLE_DOCS, SAMPLE_WINDOWS, SAMPLE_LINES = 4_000, 4_000, 2_000
#: Rounds of training, and of those with what was read wrongly.
HIDDEN, ROUNDS, AGAIN = 28, 12, 4
#: Share of the training passages with names in which other words take the names' places.
OTHER_NAMES = 0.3
#: Characters before and behind a place, of a window at most, and that neighbouring windows share; and windows whose tags
#: a task keeps at most.
BEFORE, BEHIND, LONGEST, SHARED, KEPT = 26, 34, 160, 80, 200_000

# Letters of the alphabets that have capitals, up to Latin Extended Additional.
_UP, _LOW = ("".join(c for c in map(chr, [*range(0x41, 0x530), *range(0x1E00, 0x1F00)]) if getattr(c, kind)()) for kind in ("isupper", "islower"))
_CAP = rf"[{_UP}](?:[{_LOW}]|['’][{_UP}][{_LOW}])[{_UP}{_LOW}'’-]*"
#: Small words that may stand before a family name.
_PARTICLES = r"(?:(?:van|von|vom|zu|zur|de|del|della|der|den|di|da|dos|du|la|le|ter|ten|bin|ibn|al|el|y) ){0,3}"
_HOST = r"[A-Za-z0-9-]+"
# The forms that mentions take.
EMAIL = re.compile(rf"[A-Za-z0-9][\w.%+-]*(?:@|\s?[(\[{{]\s?(?:at|@)\s?[)\]}}]\s?)(?:{_HOST}(?:\.|\s?[(\[{{]\s?dot\s?[)\]}}]\s?))+[A-Za-z]{{2,}}\b|[A-Za-z0-9][\w.%+-]* at (?:{_HOST} dot )+[A-Za-z]{{2,}}\b|[A-Za-z0-9][\w.%+-]* at (?:{_HOST}\.)+(?:com|org|net|example|test|invalid|edu|io)\b")
PHONE = re.compile(r"(?<![\w+./-])(?:\+\d{1,3}[ -]?(?:\(\d{1,4}\)[ -]?)?\d{1,4}(?:[ .-]?\d{2,5}){1,5}|00\d{2}-\d{1,4}(?:-\d{3,4}){1,3}|0\d{2,4}/\d{4,6}-\d{2,4}|0\d{3,4} \d{3}[ -]?\d{3,4}|\(\d{3}\) ?\d{3}[ -]\d{4}|\d{3}\.\d{3}\.\d{4}|\d{3}-\d{3}-\d{4})(?!\d|[-/.]\d)")
ID_NUMBER = re.compile(r"(?<![\w/+-])(?:\d{3}[- ]\d{2}[- ]\d{4}|[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]|[A-Z]\d{8}|[A-Z]\d{2}[A-Z]{2}\d{3}[A-Z]|\d{8}-[A-Z]|EMP-?\d{4,6}|[A-Z]-\d{6}|\d{3}/\d{4})(?![\w/+]|-\d)")
_STREET = r"(?:Street|St\b\.?|Road|Rd\b\.?|Avenue|Ave\b\.?|Lane|Ln\b\.?|Close|Court|Ct\b\.?|Drive|Dr\b\.?|Blvd\b\.?|Boulevard|Way|Place|Square|Terrace|Row|Crescent|Grove|Hill|Gardens)"
ADDRESS = re.compile(
    rf"(?<![\w-])(?:(?:Flat|Apt\.?|Apartment|Unit|Suite|Room) \d+[A-Za-z]?, )?\d{{1,5}}[a-z]? (?:{_CAP} ){{1,3}}{_STREET}(?!\w)"
    rf"|(?<![\w-])[A-ZÄÖÜ][a-zäöüß]*(?:straße|strasse|str\.|gasse|weg|graben|ring|allee|platz|damm|ufer|steig|hof) \d{{1,4}}[a-z]?(?!\w)"
    rf"|(?<![\w-])(?:Am|An der|Im|In der|Zum|Zur|Alte[rs]?|Neue[rs]?|Hinter|Unter den) {_CAP} \d{{1,4}}[a-z]?(?!\w)"
    rf"|(?<![\w-])(?:Calle|Avenida|Paseo|Plaza|Camino|Ronda|Carrera)(?: (?:de|del|la|las|los|el))*(?: {_CAP}){{1,3}},? \d{{1,4}}(?!\w)"
)
FORMS = {"email": EMAIL, "phone": PHONE, "id_number": ID_NUMBER, "street_address": ADDRESS}
_GIVEN = rf"(?:{_CAP}|[{_UP}]\.)(?: [{_UP}]\.)?"
NAME = re.compile(rf"(?<![\w.@<])(?:{_GIVEN} {_PARTICLES}{_CAP}|{_CAP}, (?:{_CAP}(?: [{_UP}]\.)?|[{_UP}]\.))(?![\w@])")
# What stands before a number of another kind, for labels.
_NOT_NUMBERS = re.compile(r"\b(?:Build|build|port|order|ledger id|tag|commit|version) $")
#: Places where a mention could be, by classes of characters, each pattern starting with a plain set so that scanning is
#: quick: a sign for "at"; digits in groups; a number before a capitalised word; capitals before digits; a capitalised
#: word or an initial before another or before a number.
_SIGN = re.compile(r"@(?=[A-Za-z0-9])(?<=[\w.%+-]@)|[(\[{]\s?at\s?[)\]}]| at (?=[\w-]+(?: dot |\.[a-z]))")
_DIGITS = re.compile(r"\d[\d ()./-]{5,}\d|\d{3}/\d{4}|\d{1,5}[a-z]? [A-ZÀ-ÖØ-Þ][\w'’-]+ [A-ZÀ-ÖØ-Þ]")
_LETTERS = re.compile(rf"[{_UP}](?:[A-Z]{{0,2}}[ -]?\d{{2}}[A-Z\d ]{{2,}}|[{_UP}{_LOW}'’-]*[.,]? (?:[{_UP}]\. )?(?:{_PARTICLES}[{_UP}](?:[{_LOW}'’]|\.(?!\w))|\d{{1,4}}[a-z]?(?=[,.;:)\s\"']|\Z)))")
_DATE = re.compile(r"\d{4}-\d\d-\d\d(?:[T /]|\Z)")
_RUN = re.compile(r"\w+|.", re.S)


def _matches(pattern: re.Pattern, text: str, kept: Callable[[re.Match], bool]) -> Iterator[tuple[int, int]]:
    """Matches that are kept; behind one that is not, the scan goes on at the next word or number."""
    at = 0
    while m := pattern.search(text, at):
        if kept(m):
            yield m.start(), m.end()
            at = m.end()
        else:
            at = _RUN.match(text, m.start()).end()


def places(text: str) -> list[tuple[int, int]]:
    """Where a mention could be. Dates, plain numbers, type arguments and what stands within longer tokens are no such
    places."""

    def number(m: re.Match) -> bool:
        a, found = m.start(), m[0]
        before = text[a - 1 : a]
        if before.isalnum() or before in ("_", ".", "#", "/") and a and text[a - 2 : a - 1].isalnum() or _DATE.match(found):
            return False
        if found[-1].isalpha() or "/" in found and len(found) == 8 or sum(map(str.isdigit, found)) > 6:
            return not found.isdigit() or text[a - 1 : a] == "+" or text[m.end() : m.end() + 1] == "-"
        return False

    def letters(m: re.Match) -> bool:
        before = text[m.start() - 1 : m.start()]
        return not (before.isalnum() or before in ("_", ".", "@", "<", "/", "+")) and text[m.end() : m.end() + 1] not in ("(", "<", "=")

    out = [(m.start(), m.end()) for m in _SIGN.finditer(text)]
    out += _matches(_DIGITS, text, number)
    out += _matches(_LETTERS, text, letters)
    out.sort()
    return out


def windows(text: str) -> list[tuple[int, int]]:
    """Starts and ends of the windows around the places of a text, for the training sample: with their surroundings,
    joined, and cut where too long."""
    spans: list[list[int]] = []
    for start, end in places(text):
        a, b = max(0, start - BEFORE), min(len(text), end + BEHIND)
        if spans and a <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], b)
        else:
            spans.append([a, b])
    return [w for a, b in spans for w in _short(a, b)]


def _short(a: int, b: int) -> Iterator[tuple[int, int]]:
    """A stretch in overlapping windows, if it is too long for one."""
    while b - a > LONGEST:
        yield a, a + LONGEST
        a += LONGEST - SHARED
    yield a, b


_LINE = re.compile(r"\S(?:[^\n]*\S)?")


def pieces(text: str) -> list[tuple[int, int]]:
    """Starts and ends of the windows in which a text is read: its lines without the blanks around them, cut where too long."""
    return [w for m in _LINE.finditer(text) for w in (_short(*m.span()) if m.end() - m.start() > LONGEST else (m.span(),))]


def known_forms(text: str) -> list[tuple[int, int, str]]:
    """Mentions that have a form of their own, the longer first where they overlap."""
    found: list[tuple[int, int, str]] = []
    for kind, form in FORMS.items():
        for m in form.finditer(text):
            if plausible(kind, m[0], text, m.start(), m.end()):
                found.append((m.start(), m.end(), kind))
    found.sort(key=lambda x: (x[0] - x[1], x[0]))
    out: list[tuple[int, int, str]] = []
    for a, b, kind in found:
        if all(b <= x or a >= y for x, y, _ in out):
            out.append((a, b, kind))
    return sorted(out)


def plausible(kind: str, mention: str, text: str, a: int, b: int) -> bool:
    """The exact check of a mention's form and nearest surroundings."""
    if kind == "email":
        return not re.match(r"(?:git|hg|svn|ssh)\W", mention) and not re.search(r"@\d+(?:\.\d+)+$", mention) and not re.match(r":[\w~./-]+\.git\b", text[b : b + 80])
    if kind in ("phone", "id_number"):
        return not _NOT_NUMBERS.search(text[max(0, a - 12) : a]) and not (kind == "id_number" and re.fullmatch(r"\d{3}/\d{4}", mention) and not re.search(r"(?i)(?:number|no\.|id|nr\.|nummer|passport\W+|pasted|employee|staff|personnel)\W{0,5}$", text[max(0, a - 24) : a]))
    return True


_BEFORE_NAME = rf"(?<![\w.@<'’-])(?:([{_UP}])\.|({_CAP}))(?: [{_UP}]\.)? (?=({_CAP})(?![\w@]))"
_TURNED_NAME = rf"(?<![\w.@<'’-])({_CAP}), (?=([{_UP}])\.(?![\w@]))"
_OWNERS = re.compile(r"['’]s?$")


def names_of(texts: Iterable[str]) -> tuple[set[str], set[str]]:
    """Given names and family names of the texts, by where words stand.

    Family names to begin with are words behind an initial, or before one and a comma. A given name stands before at
    least two of them; what stands behind given names is a family name; and a word stays a given name if most of what
    follows it is one.
    """
    behind: set[str] = set()
    follow: dict[str, Counter[str]] = defaultdict(Counter)
    for t in texts:
        for m in re.finditer(_BEFORE_NAME, t):
            word = _OWNERS.sub("", m[3])
            if m[1]:
                behind.add(word)
            else:
                follow[m[2]][word] += 1
        behind |= {m[1] for m in re.finditer(_TURNED_NAME, t)}
    family = behind
    given = {g for g, c in follow.items() if len(c.keys() & family) >= 2}
    for _ in range(2):
        family = (behind | {f for g in given for f in follow[g]}) - given
        given = {g for g, c in follow.items() if len(c.keys() & family) >= 2 and sum(n for f, n in c.items() if f in family) >= 0.6 * c.total()}
    return {p for g in given for p in (g, *g.split("-"))}, family


def label(text: str, names: tuple[set[str], set[str]]) -> list[tuple[int, int, str]]:
    """Mentions of a training text."""
    out = known_forms(text)
    given, family = names
    last = 0
    for start in _CAPITAL.finditer(text):
        m = NAME.match(text, start.start()) if start.start() >= last else None
        if not m:
            continue
        whole = re.sub(r"['’]s$", "", m[0])
        first, after = whole.split(", ", 1)[::-1] if ", " in whole else (whole.split(" ")[0], whole.split(" ")[-1])
        first = first.split(" ")[0]
        known = after in family if first.endswith(".") else all(p in given for p in first.split("-")) and after not in given
        if known:
            last = m.start() + len(whole)
            if all(last <= x or m.start() >= y for x, y, _ in out):
                out.append((m.start(), last, "person_name"))
    return sorted(out)


def other_names(text: str, mentions: list[tuple[int, int, str]], words: list[str], pick: np.random.Generator) -> tuple[str, list[tuple[int, int, str]]]:
    """The text with other words in place of the family names and, where it has one name, of some given names, and where
    its mentions then are. In lists of names the given names tell in which order each stands, so they stay."""
    parts, last, moved = [], 0, []
    size, alone = 0, sum(kind == "person_name" for *_, kind in mentions) == 1
    for a, b, kind in mentions:
        name = text[a:b]
        if kind == "person_name":
            turned = ", " in name
            pieces = name.split(", ") if turned else name.rsplit(" ", 1)
            own, at = str(words[pick.integers(len(words))]), 0 if turned else 1
            lead = pick.random()
            pieces[at] = f"O'{own}" if lead < 0.08 else f"{('van', 'de', 'von', 'da')[pick.integers(4)]} {own}" if lead < 0.16 and not turned else own
            if alone and pick.random() < 0.5 and not pieces[1 - at].endswith("."):
                pieces[1 - at] = str(words[pick.integers(len(words))])
            name = (", " if turned else " ").join(pieces)
        parts += [text[last:a], name]
        size += a - last
        moved.append((size, size + len(name), kind))
        size += len(name)
        last = b
    return "".join([*parts, text[last:]]), moved


def _tags(length: int, mentions: list[tuple[int, int, str]], offset: int) -> list[int]:
    out = [0] * length
    for a, b, kind in mentions:
        for k in range(max(a, offset), min(b, offset + length)):
            out[k - offset] = 1 + 2 * TYPES.index(kind) + (k > a)
    return out


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text").where(F.col("text").rlike(r"\S"))


def _whole_words(text: str, a: int, b: int) -> str:
    """A passage without the parts of words at its ends."""
    out = text[a:b]
    if a > 0:
        out = re.sub(r"^\S{1,40}(?=\s)", "", out)
    return re.sub(r"(?<=\s)\S{1,40}$", "", out) if b < len(text) else out


def sample_windows(docs: DataFrame, most: int = SAMPLE_DOCS) -> list[str]:
    """Passages of the ``most`` documents with the smallest hashes, each once: those around windows and of
    all other pieces as many at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, around = [], []
            for t in batch.column(1).to_pylist():
                out += [_whole_words(t, max(0, a - 40), b + 40) for a, b in windows(t)]
                around += [True] * (len(out) - len(around))
                out += [x for a, b in pieces(t) if not places(x := t[a:b])]
                around += [False] * (len(out) - len(around))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), pa.array(around, pa.bool_())], ["passage", "around"])

    ids = smallest_hashes(docs.select("doc_id"), "doc_id", most).distinct()
    passages = cut(_texts(docs).join(F.broadcast(ids), "doc_id").mapInArrow(run, "passage string, around boolean").distinct(), "passages")
    near, other = ([r.passage for r in smallest_hashes(passages.where(kind).select("passage"), "passage", 8 * SAMPLE_WINDOWS).collect()] for kind in ("around", "NOT around"))
    return list(dict.fromkeys([*near, *other]))


def _shape(text: str) -> str:
    """A window's look, letters and digits by kind and runs as one."""
    return re.sub(r"(.)\1+", r"\1", re.sub(r"[^\W\d_]", "a", re.sub(r"\d", "0", re.sub(rf"[{_UP}]", "A", text))))


def train(passages: list[str], seed: int = 11, rounds: int = ROUNDS) -> Tagger:
    """A tagger trained on labelled windows of the passages: those with mentions, of each kind and of several names as many,
    some of them with other names put in, others without, of as many looks as there are, and lines without places."""
    names, pick = names_of(passages), np.random.default_rng(seed)
    words = sorted({w.capitalize() for p in passages for w in re.findall(r"(?<![\w-])[^\W\d_]{3,12}(?![\w-])", p)}) or ["Name"]
    by: dict[tuple[int, bool], dict[str, list[int]]] = {}
    plain: dict[str, tuple[str, list[int]]] = {}
    other: dict[str, tuple[str, list[int]]] = {}
    seen: dict[str, list[int]] = {}
    for p in passages:
        mentions = label(p, names)
        read = [(p, mentions)]
        if any(kind == "person_name" for *_, kind in mentions) and pick.random() < OTHER_NAMES:
            read = [other_names(p, mentions, words, pick)]
        for text, found in read:
            for a, b in pieces(text):
                tags = _tags(b - a, found, a)
                if any(tags):
                    by.setdefault((max(tags), tags.count(_NAME_STARTS) > 1), {})[text[a:b]] = tags
                else:
                    (plain if places(text[a:b]) else other).setdefault(_shape(text[a:b]), (text[a:b], tags))
                seen[text[a:b]] = tags
    # rarer kinds are taken first
    chosen: dict[str, list[int]] = {}
    lists = sorted(by.values(), key=len)
    room = 3 * SAMPLE_WINDOWS // 5
    for k, own in enumerate(lists):
        take = list(own.items())[: max(0, room - len(chosen)) // (len(lists) - k)]
        chosen |= dict(take)
    chosen |= dict(list(plain.values())[: SAMPLE_WINDOWS - len(chosen)])
    chosen |= dict(list(other.values())[:SAMPLE_LINES])
    tagger = Tagger.fresh(HIDDEN, TAGS, seed)
    if chosen:
        tagger.train(list(chosen), list(chosen.values()), rounds)
        rest = sorted(seen, key=len)
        wrong = {x: seen[x] for x, tags in zip(rest, tagger.tags(rest)) if x not in chosen and (tags or [0] * len(x)) != seen[x]}
        if wrong:
            chosen |= {x: wrong[x] for x in sorted(wrong, key=lambda x: x[::-1])[:SAMPLE_WINDOWS]}
            tagger.train(list(chosen), list(chosen.values()), AGAIN, rate=0.004)
    return tagger


_OWNER = re.compile(r"['’]s$")
_CAPITAL = re.compile(rf"(?<![\w'’-])[{_UP}]")


#: What a mention of a type consists of at least, in characters: a sign for "at", so many digits, letters and digits, or two
#: words. A span without is none, whatever was decoded.
_LEAST = {
    "email": re.compile(r"\w[\s\S]*(?:@|\bat\b)[\s\S]*\w"),
    "phone": re.compile(r"\D*(?:\d\D*){7}"),
    "id_number": re.compile(r"\D*(?:\d\D*){4}"),
    "street_address": re.compile(r"(?=[\s\S]*[^\W\d_])[\s\S]*\d"),
    "person_name": re.compile(r"\w[\s\S]*\s[\s\S]*\w"),
}


def snap(kind: str, a: int, b: int, text: str) -> list[tuple[int, int]]:
    """A decoded span on word limits or, where forms of its type overlap it by more than half, on the ends of the one
    whose ends lie nearest; several where it runs over names one behind another; none if it lacks what a mention of its
    type consists of."""
    start, end = a, b
    while a < b and not (text[a].isalnum() or text[a] in "+("):
        a += 1
    while b > a and not (text[b - 1].isalnum() or text[b - 1] in ".)"):
        b -= 1
    while a > 0 and text[a : a + 1].isalnum() and text[a - 1].isalnum():
        a -= 1
    while 0 < b < len(text) and text[b - 1].isalnum() and text[b].isalnum():
        b += 1
    if kind == "person_name":
        row, at = [], a
        while (m := NAME.match(text, at)) and m.end() <= b + 2:
            row.append((at, m.end() - 2 * bool(_OWNER.search(m[0]))))
            at = m.end() + 2
            if text[m.end() : at] != ", ":
                break
        if len(row) > 1 and row[-1][1] >= b:
            return row
        forms = ((m.start(), m.end() - 2 * bool(_OWNER.search(m[0]))) for s in _CAPITAL.finditer(text, max(0, a - 26), b) if (m := NAME.match(text, s.start())))
    else:
        forms = (m.span() for m in FORMS[kind].finditer(text, max(0, a - 60), b + 60))
    best = min(((abs(x - start) + abs(y - end), x, y) for x, y in forms if 2 * (min(b, y) - max(a, x)) > min(b - a, y - x)), default=None)
    a, b = best[1:] if best else (a, b)
    return [(a, b)] if a < b and _LEAST[kind].match(text, a, b) else []


def decode(texts: list[str], tagger: Tagger, known: dict[str, list[int] | None] | None = None) -> list[list[tuple[int, int, str, bool]]]:
    """Mentions of each text with whether they differ from the decoded span, in order, without overlaps of one kind.

    ``known`` holds the tags of windows that were read, None where no tag is set, and takes those that are read now.
    """
    cut: list[tuple[int, int, int]] = [(k, a, b) for k, t in enumerate(texts) for a, b in pieces(t)]
    parts = [texts[k][a:b] for k, a, b in cut]
    known = {} if known is None else known
    if len(known) > KEPT:
        known.clear()
    todo = sorted({x for x in parts if x not in known}, key=len)
    known |= zip(todo, tagger.tags(todo))
    out: list[list[tuple[int, int, str, bool]]] = [[] for _ in texts]
    k = last = 0
    while k < len(cut):
        # overlapping windows of one text are joined: each character follows the window it lies deeper in
        doc, a, b = cut[k]
        found = known[parts[k]]
        k += 1
        if found is None and (k == len(cut) or cut[k][0] != doc or cut[k][1] >= b):
            continue
        tags = list(found or [0] * (b - a))
        while k < len(cut) and cut[k][0] == doc and cut[k][1] < b:
            _, x, y = cut[k]
            middle = (x + b) // 2
            tags = tags[: middle - a] + (known[parts[k]] or [0] * (y - x))[middle - x :]
            b = y
            k += 1
        at = 0
        while at < len(tags):
            if tags[at] == 0:
                at += 1
                continue
            kind, end = (tags[at] - 1) // 2, at + 1
            while end < len(tags) and tags[end] == 2 + 2 * kind:
                end += 1
            for x, y in snap(TYPES[kind], a + at, a + end, texts[doc]):
                moved = abs(x - a - at) + abs(y - a - end)
                if out[doc] and out[doc][-1][2] == TYPES[kind] and x < out[doc][-1][1]:
                    # two spans on one form, or on forms that overlap: the one moved less stays
                    x, y, moved = min((*out[doc].pop()[:2], last), (x, y, moved), key=lambda s: s[2])
                out[doc].append((x, y, TYPES[kind], moved > 0))
                last = moved
            at = end
    for row in out:
        # a name within a mailbox or an address is none
        others = [(a, b) for a, b, kind, _ in row if kind != "person_name"]
        row[:] = sorted({x for x in row if x[2] != "person_name" or all(x[1] <= a or x[0] >= b for a, b in others)})
    return out


def mentions(docs: DataFrame, tagger: Tagger) -> DataFrame:
    """``(doc_id, pii_type, start_char, end_char, snapped)`` of all mentions; no shuffle.

    ``snapped`` says that the decoded span was put on other limits.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list[int] | None] = {}
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                found = decode(part.column(1).to_pylist(), tagger, known=known)
                at = pa.array([i for i, row in enumerate(found) for _ in row], pa.int64())
                start, end, what, snapped = zip(*[x for row in found for x in row]) if len(at) else ((), (), (), ())
                yield pa.RecordBatch.from_arrays([part.column(0).take(at), pa.array(what, pa.string()), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(snapped, pa.bool_())], ["doc_id", "pii_type", "start_char", "end_char", "snapped"])

    return _texts(docs).mapInArrow(run, f"doc_id {kind}, pii_type string, start_char int, end_char int, snapped boolean")


def redact(docs: DataFrame, tagger: Tagger) -> DataFrame:
    """``docs (doc_id, text)`` with each mention replaced by its type in square brackets, such as ``[EMAIL]``."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list[int] | None] = {}
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                texts = part.column(1).to_pylist()
                out = []
                for text, found in zip(texts, decode([t or "" for t in texts], tagger, known=known)):
                    parts, last = [], 0
                    for a, b, what, _ in found:
                        if a >= last:
                            parts += [text[last:a], f"[{what.upper()}]"]
                            last = b
                    out.append(None if text is None else "".join([*parts, text[last:]]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.string())], ["doc_id", "text"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, text string")
