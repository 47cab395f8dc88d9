"""Text kernels in plain Python, for Arrow stages over whole pages.

They say the same as the Column expressions of ``text``, line for line: white space and digits are
ASCII, ``^`` of the noise patterns stands behind any of Java's line ends. Higher-order functions are
interpreted by Spark, and an expression that stands twice in one is computed twice; a page in Python
is read once. Each kernel takes time in proportion to the page.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from . import text as T

SPACE = " \t\n\x0b\f\r"
STOP = frozenset(T.STOPWORDS)
_TOKEN = re.compile(T.TOKEN)
#: Of a text without white space at its end; white space that ends the line is left to be stripped.
_HEADING = re.compile(r"^(#{1,6})\s++(.++)", re.M | re.A)
_NUMBERED = re.compile(r"\d+[.)] ", re.A)
_RUN = re.compile(r"\s+", re.A)
_STOPS = re.compile(r"(?<=[.!?。！？]) ")
_BREAKS = re.compile(r"\n+|;\s+", re.A)
_CODE, _CODE_BY = re.compile(T.NOISE[0][0]), T.NOISE[0][1]
_HASH, _BULLET = (p.removeprefix("(?m)^") for p, _ in T.NOISE[4:])
#: ^ of Java's (?m), and the same where all line ends are line feeds and one stands in front: a heading mark
#: may end in the feed that the next one stands behind, a bullet ends in a blank.
_CARET = r"(?:\A|(?<=[\n\r\x85\u2028\u2029]))(?!\Z)(?!(?<=\r)\n)"
#: White space before no bullet is matched as well and put back: else it is read again from each line end in it.
_ANY_HASHES, _ANY_BULLETS = re.compile(_CARET + _HASH, re.A), re.compile(rf"{_CARET}(?:{_BULLET}|(\s++))", re.A)
_HASHES, _BULLETS = re.compile(r"(?<=\n)" + _HASH, re.A), re.compile(rf"\n(?:{_BULLET}|(\s*+))", re.A)
_OTHER_END = re.compile("[\r\x85\u2028\u2029]")


def lower(text: str) -> str:
    """Lower case, as far as it makes no ASCII letter of another one."""
    return text.lower() if "\u212a" not in text and "\u0130" not in text else re.sub("[A-Z]+", lambda m: m[0].lower(), text)


def tokens(text: str) -> list[str]:
    return _TOKEN.findall(lower(text))


def count_terms(rows: DataFrame, column: str, terms: list[str] | None = None) -> DataFrame:
    """rows without the text ``column`` and with dl, its number of tokens, and tf: how often it has each of
    the terms, in their order; without terms an array of all its terms, sorted, with their counts. One
    Arrow stage, which nothing after it repeats within a plan branch."""
    others = [f for f in rows.schema if f.name != column]
    kind = ArrayType(IntegerType()) if terms is not None else ArrayType(StructType.fromDDL("term string, tf int"))
    schema = StructType([*others, StructField("dl", IntegerType()), StructField("tf", kind)])
    arrow = to_arrow_schema(schema)
    wanted = None if terms is None else frozenset(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                dl, tf = [], []
                for text in part.column(column).to_pylist():
                    toks = tokens(text)
                    dl.append(len(toks))
                    if wanted is None:
                        tf.append(sorted(Counter(toks).items()))
                    else:
                        found = Counter(filter(wanted.__contains__, toks))
                        tf.append([found[t] for t in terms])
                made = [pa.array(dl, pa.int32()), pa.array(tf, arrow.field("tf").type)]
                yield pa.RecordBatch.from_arrays([*(part.column(f.name).cast(arrow.field(f.name).type) for f in others), *made], schema=arrow)

    return rows.mapInArrow(run, schema)


def strip(text: str) -> str:
    """Without white space at either end; a last line end that is none of it hides no white space before it."""
    text = text.lstrip(SPACE)
    if text.endswith(("\x85", "\u2028", "\u2029")):
        return text[:-1].rstrip(SPACE) + text[-1]
    return text.rstrip(SPACE)


def prose_lines(lines: list[str]) -> list[str]:
    """Lines that are neither fences, nor fenced, nor indented by four or a tab."""
    out, fenced = [], False
    for x in lines:
        if x.lstrip(SPACE).startswith(("```", "~~~")):
            fenced = not fenced
        elif not fenced and not x.startswith(("    ", "\t")):
            out.append(x)
    return out


def brackets(text: str, mark: str, least: int = 1, named: bool = False) -> Iterator[tuple[int, int, int, int]]:
    """(start, start and end of what is shown, end) of the links that begin with mark, as the patterns of
    ``text`` find them: ``[[`` ends in ]], others in ](...). least: characters in either pair of brackets; named:
    ``[[a|b]]`` shows a. Patterns would look for the same ] from every mark before it; here none is looked for twice."""
    at, close, end, bar = 0, -1, -1, -1
    while (i := text.find(mark, at)) >= 0:
        at, inner = i + 1, i + len(mark)
        if close < inner and (close := text.find("]", inner)) < 0:
            return
        shown = close
        if named:
            if bar < inner and (bar := text.find("|", inner)) < 0:
                bar = len(text)
            if bar < close:
                if bar + 1 == close:
                    continue
                shown = bar
        if shown - inner < least:
            continue
        if mark == "[[":
            if text.startswith("]", close + 1):
                at = close + 2
                yield i, inner, shown, at
        elif text.startswith("(", close + 1):
            if end < close + 2 and (end := text.find(")", close + 2)) < 0:
                return
            if end - close - 2 >= least:
                at = end + 1
                yield i, inner, shown, at


def _shown(text: str, mark: str, least: int, named: bool, by: str | None) -> str:
    out, at = [], 0
    for start, a, b, end in brackets(text, mark, least, named):
        out += text[at:start], text[a:b] if by is None else by
        at = end
    return "".join([*out, text[at:]]) if out else text


def strip_noise(text: str) -> str:
    if "`" in text:
        text = _CODE.sub(_CODE_BY, text)
    if "[" in text:
        for link in (("![", 0, False, " "), ("[[", 1, True, None), ("[", 1, False, None)):
            text = _shown(text, *link)
    if _OTHER_END.search(text):
        return _ANY_BULLETS.sub(r"\1", _ANY_HASHES.sub("", text))
    text = "\n" + text
    if "#" in text:
        text = _HASHES.sub("", text)
    return _BULLETS.sub(r"\n\1", text)[1:]


def sentences(text: str) -> list[str]:
    compact = _RUN.sub(" ", strip(text))
    if not compact:
        return []
    parts = _STOPS.split(compact)
    if len(parts) == 1:
        parts = _BREAKS.split(text)
    return [x for x in map(strip, parts) if x]


def sections(body: str, front: int) -> list[tuple[str, int, str, int, int, int]]:
    """(heading, level, text, start_line, end_line, line_count) of each section."""
    body = strip(body)
    if not body:
        return []
    found = list(_HEADING.finditer(body)) if "#" in body else []
    if not found:
        n = body.count("\n") + 1
        return [("(document)", 0, body, front + 1, front + n, n)]
    out, line, at = [], 1, 0
    for m, stop in zip(found, [*(m.start() for m in found[1:]), len(body)]):
        line, at = line + body.count("\n", at, m.start()), m.start()
        inner = body.count("\n", at, stop - 1)
        out.append((m[2].rstrip(SPACE), len(m[1]), strip(body[at:stop]), line + front, line + inner + front, inner + 1))
    return out


def heading_repetition(secs: list[tuple]) -> float:
    """Share of heading words that stand six times or more in their section, heading included."""
    marks = []
    for heading, _, text, *_ in secs:
        words = [w for w in tokens(heading) if w not in STOP]
        low, toks = lower(text) if words else "", None
        for i, w in enumerate(words):
            if toks is None and (i == 8 or low.count(w) >= 6):  # else it can't be a token so often
                toks = Counter(_TOKEN.findall(low))
            marks.append(toks is not None and toks[w] >= 6)
    return sum(marks) / max(len(marks), 1)


_ODD = [np.uint64((0x9E3779B97F4A7C15 * (2 * k + 1)) % 2**64 | 1) for k in range(8)]


def repeated_ratio(hashed: np.ndarray, n: int) -> float:
    """Share of n-grams that occurred before; hashed: a 64-bit hash of each token."""
    m = len(hashed) - n + 1
    if m < 1:
        return 0.0
    grams = hashed[:m] * _ODD[0]
    for k in range(1, n):
        grams += (hashed[k : m + k] ^ (hashed[k : m + k] >> np.uint64(29))) * _ODD[k]
    grams.sort()
    return int((grams[1:] == grams[:-1]).sum()) / m


def near_duplicate_ratio(sets: list[set[str]], window: int = 40, least: float = 0.82) -> float:
    """Share of sentence pairs, no more than ``window`` apart, whose token sets overlap so far.

    Sets that overlap so far have one of their rarest few tokens in common, as many as may be missing
    in the other and one more: pairs come from an index of those.
    """
    n = len(sets)
    often = Counter(t for s in sets for t in s)
    places: dict[str, list[int]] = {}
    hits = 0
    for i, a in enumerate(sets):
        size = len(a)
        first = size - int(np.ceil(least * size - 1e-9)) + 1
        near = set()
        common = [t for t in a if often[t] > 1]
        first -= size - len(common)  # what stands once comes first, and leads nowhere
        for t in sorted(common, key=lambda t: (often[t], t))[:first] if first > 0 else ():
            at = places.setdefault(t, [])
            for j in reversed(at):
                if i - j > window:
                    break
                near.add(j)
            at.append(i)
        for j in near:
            b = sets[j]
            if min(size, len(b)) >= least * max(size, len(b)):
                both = len(a & b)
                hits += both / max(size + len(b) - both, 1) >= least
    checks = window * n - window * (window + 1) / 2 if n > window else n * (n - 1) / 2
    return hits / max(checks, 1)


def shares(lines: list[str]) -> tuple[int, int]:
    """How many lines are bullets, and how many are of tables."""
    bullets = tables = 0
    for x in lines:
        y = x.lstrip(SPACE)
        c = y[:1]
        if c and c in "-*+":
            bullets += y[1:2] == " "
        elif c and c in "0123456789":
            bullets += _NUMBERED.match(y) is not None
        tables += "|" in x or y.startswith(("---", ":---"))
    return bullets, tables


def metrics(text: str, body: str, front: int, long_sentence: int, include_code: bool) -> tuple[dict, list[tuple], str]:
    """The metrics of a page but for gzip, its sections, and its prose."""
    lines = body.splitlines()
    plain = prose_lines(lines)
    prose = strip_noise(body if include_code else "\n".join(plain))
    by_sentence = [_TOKEN.findall(x) for x in sentences(lower(prose))]
    toks = [t for x in by_sentence for t in x]  # sentences are parted between tokens
    lengths = [len(x) for x in by_sentence if x]
    sets = [s for s in (set(x) - STOP for x in by_sentence if len(x) >= 4) if len(s) >= 4]
    hashed = np.fromiter(map(hash, toks), np.int64, len(toks)).view(np.uint64)
    worded = [t for t in toks if t not in STOP]
    content = [t for t in worded if t[0] > "9" or not t.isdigit()]
    secs = sections(body, front)
    sizes = [s[5] for s in secs]
    line_count = len(lines) if text is body else len(text.splitlines())
    bullets, tables = shares(lines)
    n, chars, said = len(toks), sum(map(len, toks)), max(len(lengths), 1)
    long = sum(x >= long_sentence for x in lengths)
    linked = "[" in body
    n1, heads, all_lines = max(n, 1), len(secs), max(len(lines), 1)
    out = {
        "line_count": line_count,
        "body_line_count": len(lines),
        "word_count": n,
        "char_count": len(text),
        "heading_count": heads,
        "max_section_lines": max(sizes) if sizes else len(lines) or line_count,
        "avg_section_lines": sum(sizes) / max(heads, 1),
        "lines_per_heading": len(lines) / max(heads, 1),
        "bullet_line_ratio": bullets / all_lines,
        "table_line_ratio": tables / all_lines,
        "code_line_ratio": (len(lines) - len(plain)) / all_lines,
        "wikilink_count": sum(1 for _ in brackets(body, "[[")) if linked else 0,
        "markdown_link_count": sum(1 for _ in brackets(body, "[")) if linked else 0,
        "sentence_count": len(lengths),
        "avg_sentence_words": sum(lengths) / said,
        "max_sentence_words": max(lengths, default=0),
        "long_sentence_count": long,
        "long_sentence_ratio": long / said,
        "avg_word_chars": chars / n1,
        "ari_score": 4.71 * (chars / n1) + 0.5 * (n / said) - 21.43,
        "repeated_5gram_ratio": repeated_ratio(hashed, 5),
        "repeated_8gram_ratio": repeated_ratio(hashed, 8),
        "near_duplicate_sentence_ratio": near_duplicate_ratio(sets),
        "heading_repetition_ratio": heading_repetition(secs),
        "unique_token_ratio": len(set(toks)) / n1,
        "unique_content_word_ratio": len(set(content)) / max(len(content), 1),
        "lexical_density": len(content) / n1,
        "stopword_ratio": (n - len(worded)) / n1,
    }
    return out, secs, prose


_ATX = re.compile(r"(#{1,6})[ \t]+(.+?)[ \t]*$")
_CLOSING = re.compile(r"[ \t]+#+[ \t]*$")
_FENCE = re.compile(r"`{3,}|~{3,}")


def headings(lines: list[str]) -> list[tuple[int, int, str, str]]:
    """(line, level, text, raw) of the headings outside front matter and fences.

    A fence closes at one of the same character that is at least as long.
    """
    dashes = lambda x: "-" in x and x.translate(_NO_SPACE) == "---"
    skip = 0
    if lines and dashes(lines[0]):
        skip = next((no for no, x in enumerate(lines[1:], 2) if dashes(x)), 0)
    out, fence = [], ""
    for no, x in enumerate(lines[skip:], skip + 1):
        if x.startswith("#"):
            if not fence and (m := _ATX.match(x)) and (text := _CLOSING.sub("", m[2].strip(" ")).strip(" ")):
                out.append((no, len(m[1]), text, x))
        elif (y := x.lstrip(SPACE)).startswith(("```", "~~~")):
            mark = _FENCE.match(y)[0]
            if not fence:
                fence = mark
            elif mark[0] == fence[0] and len(mark) >= len(fence):
                fence = ""
    return out


_NO_SPACE = dict.fromkeys(map(ord, SPACE))


def spans(lines: list[str]) -> list[tuple[str, int, int, int, int]]:
    """(heading, level, start_line, end_line, occurrence) of every section: it reaches to the next heading of
    its level or above."""
    found = headings(lines)
    ends, open_ones = [len(lines)] * len(found), []
    for i, (line, level, *_) in enumerate(found):
        while open_ones and found[open_ones[-1]][1] >= level:
            ends[open_ones.pop()] = line - 1
        open_ones.append(i)
    seen: Counter[str] = Counter()
    out = []
    for (line, level, text, _), end in zip(found, ends):
        seen[text] += 1
        out.append((text, level, line, end, seen[text]))
    return out
