"""Personal data in texts, disguised forms included, with spans in the source's code points.

Plain identifiers are found in the text itself. Then a chain of transducers rewrites the text: homoglyphs become ASCII,
invisible characters vanish, spelled digits become digits, "at" and "dot" in their disguises become @ and a full stop.
Every rewritten character remembers the source characters that it stands for, so what the same detectors find in the
rewritten text maps back to a span of the source. Such a span is added unless it lies in a plain one of its kind, so an
address of which only a part is plain is found whole, besides its plain part.

Bounds of disguised addresses (plain ones have none): names of 64 characters, six labels of 63, endings of 24 letters; "mail"
and the like count up to 32 characters before a name. Between words stand single blanks, tabs or line ends; dashes, low
lines and stars ("jo-at-example-dot-com") and blanks around plain signs ("jo @ example . com") count before the endings in
ENDINGS alone, as words and code use them too.

Null and empty text: no spans. Very long texts: searched whole, in time linear in their length. Repeated rows: each
searched. Ties: detectors take the leftmost match and never overlap themselves. Columns besides those named are dropped,
so their names can't clash. Empty table: empty result.
"""

from __future__ import annotations

import re
import unicodedata
from functools import cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.common import bounded, map_rows

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

# Letters of other scripts that look like ASCII ones.
LOOKALIKES = dict(
    zip(
        "аеорсухіјѕԁһӏАВЕКМНОРСТХУІЈЅαοορνικΑΒΕΖΗΙΚΜΝΟΡΤΥΧ",
        "aeopcyxijsdhlABEKMHOPCTXYIJSaoopvikABEZHIKMNOPTYX",
    )
)
INVISIBLE = frozenset("\u00ad\u200b\u200c\u200d\u2060\ufeff")
SPELLED = {
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
DIGIT_WORD = "|".join(sorted(SPELLED, key=len, reverse=True))
FIRST = "".join(sorted({w[0] for w in SPELLED}))
#: Two or more digits in a row, at least one of them spelled, with single separators or "plus" and "dot" between.
DIGIT_RUN = re.compile(rf"(?=[0-9{FIRST}])(?<![^\W_])(?:(?:{DIGIT_WORD}|[0-9]+)(?:[ ]dot[ ]|, |[ .-]))+(?:{DIGIT_WORD}|[0-9]+)(?![^\W_])", re.I)
SPELLED_WORD = re.compile(rf"(?=[{FIRST}])(?<![^\W_])(?:{DIGIT_WORD})(?![^\W_])", re.I)
BRACKETED_AT = re.compile(r"[ ]?[\[({<][ ]?(?:at|@|arroba|arobase)[ ]?[\])}>][ ]?", re.I)
BRACKETED_DOT = re.compile(r"[ ]?[\[({<][ ]?(?:dot|\.|punto|point|punkt)[ ]?[\])}>][ ]?", re.I)
# Endings that leave no doubt.
ENDINGS = "com|org|net|edu|gov|info|io|de|fr|es|uk|eu|ru|jp|cn|br|nl|ch"
#: What stands around "at" and "dot": white space, or signs that join.
BLANK, JOINT = r"[ \t\r\n]", r"[ ]?[-_*]{1,2}[ ]?"
#: Without brackets only as a whole: name at host dot name, where every dot after the host is a word or a full stop.
WORDED = re.compile(rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{{1,64}}(?:{BLANK}dot{BLANK}[A-Za-z0-9_%+-]{{1,64}}){{0,3}}{BLANK}at{BLANK}[A-Za-z0-9-]{{1,63}}(?:(?:{BLANK}dot{BLANK}|\.)[A-Za-z0-9-]{{1,63}}){{0,4}}{BLANK}dot{BLANK}[A-Za-z]{{2,24}}(?![A-Za-z0-9-])", re.I)
JOINED = re.compile(rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{{1,64}}{JOINT}at{JOINT}[A-Za-z0-9-]{{1,63}}(?:(?:{JOINT}dot{JOINT}|\.)[A-Za-z0-9-]{{1,63}}){{0,4}}{JOINT}dot{JOINT}(?:{ENDINGS})(?![A-Za-z0-9_-])", re.I)
STARRED = re.compile(rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9.%+-]{{1,64}}(?:\*{{1,2}}at\*{{1,2}}|_at_)(?=[A-Za-z0-9-]{{1,63}}(?:\.[A-Za-z0-9-]{{1,63}}){{0,4}}\.(?:{ENDINGS})(?![A-Za-z0-9_-]))", re.I)
SPACED = re.compile(rf"(?<=[A-Za-z0-9])[ ]?@[ ]?[A-Za-z0-9-]{{1,63}}(?:[ ]?\.[ ]?[A-Za-z0-9-]{{1,63}}){{0,4}}[ ]?\.[ ]?(?:{ENDINGS})(?![A-Za-z0-9-])")
WORD_AT, WORD_DOT, JOINED_AT = re.compile(rf"{BLANK}at{BLANK}"), re.compile(rf"{BLANK}dot{BLANK}"), re.compile(r"[-_*][ ]?at[ ]?[-_*]")
#: An address with @, whose dots on either side may be words.
DOTS_AFTER = re.compile(r"@[A-Za-z0-9-]{1,63}(?:(?:[ ]dot[ ]|\.)[A-Za-z0-9-]{1,63}){0,4}[ ]dot[ ][A-Za-z]{2,24}(?![A-Za-z0-9-])", re.I)
DOTS_BEFORE = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9_%+-]{1,64}(?:[ ]dot[ ][A-Za-z0-9_%+-]{1,64}){1,3}(?=@[A-Za-z0-9-]+\.)", re.I)
#: A name at a host with plain dots is prose ("look at example.com"), unless the name isn't a word or what is before it speaks of mail.
PLAIN_HOST = re.compile(rf"(?<![A-Za-z0-9._%+-])([A-Za-z0-9._%+-]{{1,64}}){BLANK}at{BLANK}[A-Za-z0-9-]{{1,63}}(?:\.[A-Za-z0-9-]{{1,63}}){{0,4}}\.[A-Za-z]{{2,24}}(?![A-Za-z0-9-])", re.I)
HANDLE = re.compile(r"[A-Za-z0-9][._%+-][A-Za-z0-9]|[0-9]")
MAIL_BEFORE = re.compile(r"(?:mail|courriel|correo|adress|address|adresse|dirección|kontakt|contact)[^\W_]*(?:[ ](?:is|ist|est|es|me|us|to|an|at|mich|uns)){0,2}[ ]?[:=]?[ ]?\Z", re.I)
SPACED_AT = re.compile(r"(?<=[A-Za-z0-9])[ ]@[ ](?=[A-Za-z0-9-]+[ ]?\.)|(?<=[A-Za-z0-9])[ ]@(?=[A-Za-z0-9-]+\.)")
PLUS = re.compile(r"(?<![^\W_])plus[ ](?=[0-9])", re.I)
FIGURE = re.compile(rf"(?P<word>{DIGIT_WORD})|(?P<dot>[ ]dot[ ])|, |[ ]", re.I)
GROUP = rf"(?:[0-9]+|(?:{DIGIT_WORD}|[0-9])(?:[ ](?:{DIGIT_WORD}|[0-9])){{1,2}}|{DIGIT_WORD})"
#: Four number groups, each in digits or spelled.
DOTTED = re.compile(rf"(?=[0-9{FIRST}])(?<![^\W_]){GROUP}(?:(?:[ ]dot[ ]|\.){GROUP}){{3}}(?![^\W_])", re.I)
PLUS_BEFORE = re.compile(r"(?:\+|(?<![^\W_])plus[ ])\Z", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = ord(d) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def plain(text: str) -> dict[str, list[tuple[int, int]]]:
    """The spans of each kind in the text itself."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out["email"].append((start, m.end()))
            done = m.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", done)
    for m in IP.finditer(text):
        if all(len(p := g.lstrip("0")) <= 3 and int(p or "0") <= 255 for g in m.groups()):
            out["ip"].append(m.span())
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out["card"].append(m.span())
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                out["phone"].append(m.span())
    return out


class Mapped:
    """A text with, for each of its characters, the source span that it stands for."""

    def __init__(self, text: str) -> None:
        self.text, self.starts, self.ends = text, range(len(text)), range(1, len(text) + 1)

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """edits: ordered, disjoint (start, end, new); each new character stands for the whole of what it replaces."""
        if not edits:
            return
        text, starts, ends, at = [], [], [], 0
        for a, b, new in edits:
            text += [self.text[at:a], new]
            starts += [*self.starts[at:a], *[self.starts[a]] * len(new)]
            ends += [*self.ends[at:a], *[self.ends[b - 1]] * len(new)]
            at = b
        self.text, self.starts, self.ends = "".join([*text, self.text[at:]]), [*starts, *self.starts[at:]], [*ends, *self.ends[at:]]

    def span(self, start: int, end: int) -> tuple[int, int]:
        return min(self.starts[start:end]), max(self.ends[start:end])


@cache
def _ascii(c: str) -> str | None:
    """What a character that isn't ASCII looks like; None: itself."""
    if c in INVISIBLE:
        return ""
    if c in LOOKALIKES:
        return LOOKALIKES[c]
    if (d := unicodedata.digit(c, None)) is not None:
        return str(d)
    folded = unicodedata.normalize("NFKC", c)
    return folded if len(folded) == 1 and folded.isascii() and folded != " " else None


def figures(run: str, start: int) -> list[tuple[int, int, str]]:
    """The edits that turn a run of digits, in part spelled, into digits and full stops; start: where it is."""
    out = []
    for y in FIGURE.finditer(run):
        out.append((start + y.start(), start + y.end(), SPELLED[y[0].lower()] if y["word"] else "." if y["dot"] else ""))
    return out


def rewritten(run: str, start: int, edits: list[tuple[int, int, str]]) -> str:
    m = Mapped(run)
    m.rewrite([(a - start, b - start, new) for a, b, new in edits])
    return m.text


def normalise(text: str) -> Mapped:
    m = Mapped(text)
    if not text.isascii():
        m.rewrite([(i, i + 1, new) for i, c in enumerate(text) if c > "\x7f" and (new := _ascii(c)) is not None])
    m.rewrite([(*x.span(), "@") for x in BRACKETED_AT.finditer(m.text)])
    m.rewrite([(*x.span(), ".") for x in BRACKETED_DOT.finditer(m.text)])
    low = m.text.lower()
    at, dot = WORD_AT.search(low), WORD_DOT.search(low)  # what the patterns can't match without
    edits = []
    for x in WORDED.finditer(m.text) if at and dot else ():
        for y in re.finditer(rf"{BLANK}(at|dot){BLANK}", x[0], re.I):
            edits.append((x.start() + y.start(), x.start() + y.end(), "@" if y[1].lower() == "at" else "."))
    for x in PLAIN_HOST.finditer(m.text) if at else ():
        if HANDLE.search(x[1]) or MAIL_BEFORE.search(m.text, max(0, x.start() - 32), x.start()):
            edits.append((x.end(1), x.end(1) + 4, "@"))
    m.rewrite(sorted({*edits}))
    if JOINED_AT.search(low):
        m.rewrite([(x.start() + y.start(), x.start() + y.end(), "@" if y[1].lower() == "at" else ".") for x in JOINED.finditer(m.text) for y in re.finditer(rf"{JOINT}(at|dot){JOINT}", x[0], re.I)])
        m.rewrite([(x.start() + y.start(), x.end(), "@") for x in STARRED.finditer(m.text) for y in re.finditer(r"(?:\*{1,2}at\*{1,2}|_at_)\Z", x[0], re.I)])
    if "@ " in m.text or " ." in m.text and "@" in m.text:
        m.rewrite([(x.start() + y.start(), x.start() + y.end(), y[1]) for x in SPACED.finditer(m.text) for y in re.finditer(r"[ ]?([@.])[ ]?", x[0]) if y[0] != y[1]])
    if " @" in m.text:
        m.rewrite([(*x.span(), "@") for x in SPACED_AT.finditer(m.text)])
    if "@" in m.text and dot:
        for part in (DOTS_AFTER, DOTS_BEFORE):
            m.rewrite([(x.start() + y.start(), x.start() + y.end(), ".") for x in part.finditer(m.text) for y in re.finditer(r"[ ]dot[ ]", x[0], re.I)])
    spelled = SPELLED_WORD.search(m.text)  # without one and without " dot ", no run would change
    edits, x = [], DOTTED.search(m.text) if spelled or " dot " in low else None
    while x:
        parts = figures(x[0], x.start())
        groups = rewritten(x[0], x.start(), parts).split(".")
        valid = parts and all(len(p := g.lstrip("0")) <= 3 and int(p or "0") <= 255 for g in groups)
        edits += parts if valid else []
        x = DOTTED.search(m.text, x.end() if valid else x.start() + 1)
    m.rewrite(edits)
    edits = []
    for x in DIGIT_RUN.finditer(m.text) if spelled else ():
        count = len(SPELLED_WORD.findall(x[0]))
        parts = figures(x[0], x.start())
        if count < 4:  # a number word or two are prose, unless they complete a card or a phone
            digits = re.sub("[^0-9]", "", rewritten(x[0], x.start(), parts)) if count else ""
            if not (16 <= len(digits) <= 19 and luhn(digits) or 8 <= len(digits) <= 15 and PLUS_BEFORE.search(m.text, max(0, x.start() - 6), x.start())):
                continue
        edits += parts
    m.rewrite(edits)
    m.rewrite([(*x.span(), "+") for x in PLUS.finditer(m.text)])
    return m


def find(text: str | None) -> tuple[dict[str, list[tuple[int, int]]], dict[str, list[tuple[int, int]]]]:
    """Plain spans, and all spans, of each kind in order of their starts."""
    text = text or ""
    base = plain(text)
    every = {k: list(v) for k, v in base.items()}
    m = normalise(text)
    if m.text != text:
        for kind, found in plain(m.text).items():
            for a, b in found:
                start, end = m.span(a, b)
                if not any(s <= start and end <= e for s, e in every[kind]):
                    every[kind].append((start, end))
            every[kind].sort()
    return base, every


def listed(spans: dict[str, list[tuple[int, int]]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in KINDS for a, b in spans[k])


def redact(text: str | None, spans: dict[str, list[tuple[int, int]]]) -> str | None:
    """The text with each span, overlapping ones as one, replaced by its kind in brackets."""
    if not text:
        return text
    out, at = [], 0
    for a, b, kind in sorted((a, b, k) for k in KINDS for a, b in spans[k]):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def detect(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, base and spans: comma-joined kind:start:end by kind, then start; and the count of base spans of each kind."""

    def make():
        def step(batch, rows) -> None:
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                base, every = find(t)
                rows.add(k, *(len(base[x]) for x in KINDS), listed(base), listed(every), size=256)

        return step

    return map_rows(df.select(F.col(key).cast("long"), text), f"{key} long,n_email long,n_ip long,n_card long,n_phone long,base string,spans string", make)


def redacted(df: DataFrame, text: str) -> DataFrame:
    """The same columns, with all spans of the text replaced. Other columns pass through untouched."""
    bounded(df.sparkSession)
    place = df.columns.index(text)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            new = pa.array([redact(t, find(t)[1]) for t in batch.column(place).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([new if i == place else c for i, c in enumerate(batch.columns)], names=batch.schema.names)

    return df.mapInArrow(run, df.schema)
