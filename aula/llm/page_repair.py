"""Problem 2: noise in text from scanned pages.

Input is one recognised token per line. Output is, per record, the noisy lines and the repaired text.

1. *Layout.* A page of running text (several tokens end a sentence) may have a running header or footer and a printed
   page number at its edges: a run of title-like tokens that belongs to no sentence, beside it a number in one of the
   usual forms, misread digits included.
2. *Lexicon.* Counts of words printed or spoken elsewhere (texts and titles that a vision model read, speech) and of
   words recognised on frames, words broken over two lines included. It is a table, not a broadcast.
3. *Candidates.* Each distinct reading without evidence of its own (single, broken over a line end, or torn apart) is
   joined with the lexicon on a canonical form in which all characters that are mistaken for each other are the same, so that
   any number of confusions is found; an alignment then counts them. A reading that no word explains as a whole is looked up
   in pieces: those at its ends, and those between them where the ends leave a gap. A piece or word needs evidence of its
   own: a printed or spoken word, or at least three times as many frames.
4. *Decoding.* Per record, dynamic programming over the stream of characters without line breaks chooses the joint
   segmentation of least cost. Its edges are tokens as they are, words with their confusions, words broken by a hyphen or
   torn into several tokens, and pieces of tokens that ran together; frequent words, and words that the record holds
   elsewhere, cost a little less. Cost is the only limit.
5. *Paragraphs.* A second dynamic programme places paragraph boundaries between sentences, weighing even lengths
   against the words that neighbouring sentences share.

Defined results: NULL text gives no lines and NULL text; empty text gives no lines and empty text; confidences that are
missing, -1 or of another number than the tokens are not used; runs of
more than 64 letters are no words; repeated rows come out repeatedly (queries read
records); an empty table gives no rows.
"""

from __future__ import annotations

import itertools
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aula.session import cut_lineage

HYPHENS = "-‐‑¬­"
#: Recognised characters and the printed ones they may stand for.
CONFUSIONS = {
    "c": ("e",), "o": ("a",), "f": ("t",), "l": ("i",), "i": ("l",), "b": ("h",), "y": ("v",), "m": ("in", "rn"), "d": ("cl",),
    "ri": ("n",), "rn": ("m",), "cl": ("d",), "ii": ("u",), "vv": ("w",),
    "0": ("o",), "1": ("i", "l"), "2": ("z",), "5": ("s",), "6": ("b",), "8": ("b",), "9": ("g",),
}
SUSPENDED = {"and", "or", "to", "nor", "und", "oder", "et", "ou", "y", "o"}
LEAST_LENGTH = 4
#: A longer run of letters is no word and is left as it is.
MOST_LENGTH = 64
LEAST_FRAMES = 3
GLUE_CONFIDENCE = 0.6
#: Tokens that end a sentence on a page of running text.
PAGE_SENTENCES = 3
JOINED, GLUED = "|", "+"

_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_WORD = re.compile(r"(?=.*[^\W\d_].*[^\W\d_].*[^\W\d_])[^\W_]+(?:-[^\W_]+)*")
_CODE = re.compile(r"[a-z]{1,4}\d+[a-z]?|\d+[a-z]{1,3}|.*\d{3,}.*|.*[3478].*")
_SENTENCE_END = re.compile(r"[.!?][\"'”)\]]*$")
_DIGITS = r"[0-9lIoOSsgBbZz]"
_PAGE_FORMS = re.compile(rf"[-–—]{_DIGITS}{{1,4}}[-–—]|[Pp][.]{_DIGITS}{{1,4}}|{_DIGITS}{{1,4}}/{_DIGITS}{{1,4}}|(?=.*\d){_DIGITS}{{1,4}}|[ivxlc]{{1,7}}|[IVXLC]{{2,7}}")
_NUMBER = re.compile(rf"(?=.*\d){_DIGITS}{{1,4}}")
_PAGE_WORD = re.compile(r"[Pp][ao][g9][ec]")


@lru_cache(1 << 16)
def normal(token: str) -> str:
    return _EDGE.sub("", token.lower())


def stem_of(token: str) -> str | None:
    """The letters before a line-end hyphen, if the token can be the first half of a word."""
    if len(token) > 2 and token[-1] in HYPHENS and token[-2].isalnum():
        return token[:-1]
    return None


@lru_cache(1 << 16)
def _ends_sentence(token: str) -> bool:
    return len(token) > 2 and _SENTENCE_END.search(token) is not None


def is_page(tokens: list[str]) -> bool:
    return sum(map(_ends_sentence, tokens)) >= PAGE_SENTENCES


def _title_like(token: str) -> bool:
    return token[0].isupper() or token[0].isdigit() or token in ("—", "–", "|")


def _page_at(tokens: list[str], i: int, step: int) -> int:
    """Length of a page number that begins (step 1) or ends (step -1) at i."""
    n = len(tokens)
    if not 0 <= i < n:
        return 0
    if step == 1:
        if i + 1 < n and _PAGE_WORD.fullmatch(tokens[i]) and _NUMBER.fullmatch(tokens[i + 1]):
            return 2
        if i + 2 < n and _NUMBER.fullmatch(tokens[i]) and tokens[i + 1] in ("of", "0f") and _NUMBER.fullmatch(tokens[i + 2]):
            return 3
    else:
        if i >= 2 and _NUMBER.fullmatch(tokens[i]) and tokens[i - 1] in ("of", "0f") and _NUMBER.fullmatch(tokens[i - 2]):
            return 3
        if i >= 1 and _NUMBER.fullmatch(tokens[i]) and _PAGE_WORD.fullmatch(tokens[i - 1]):
            return 2
    return 1 if _PAGE_FORMS.fullmatch(tokens[i]) else 0


def layout(tokens: list[str]) -> dict[int, str]:
    """Positions that belong to a running header or footer, or to a printed page number."""
    out: dict[int, str] = {}
    n = len(tokens)
    if not is_page(tokens):
        return out
    # top: a number at the very edge, then a title-like run of which the last part opens the first sentence
    i = _page_at(tokens, 0, 1)
    if i:
        followed = i < n and (_title_like(tokens[i]) or i > 1)
        if not followed:
            i = 0
        out.update(dict.fromkeys(range(i), "page"))
    j = i
    inner: range = range(0)
    while j < n:
        k = _page_at(tokens, j, 1) if j > i and not (_NUMBER.fullmatch(tokens[j]) and j + 1 < n and not _title_like(tokens[j + 1]) and tokens[j + 1] not in ("of", "0f")) else 0
        if k and j - i >= 2 and (j + k >= n or _title_like(tokens[j + k])):
            inner = range(j, j + k)
            j += k
            break
        if not _title_like(tokens[j]):
            break
        j += 1
    if inner:
        out.update(dict.fromkeys(inner, "page"))
        head = range(i, inner.start)
    else:
        # the run's own sentence: one capitalised token, or one and its number ("Figure 12")
        own = 2 if j - i >= 2 and _NUMBER.fullmatch(tokens[j - 1].rstrip(",")) else 1
        head = range(i, max(j - own, i))
    if len(head) >= 2:
        out.update(dict.fromkeys(head, "header"))
    elif inner:
        for p in inner:
            del out[p]
    # bottom: what follows the last sentence, read from the end
    last = max((p for p in range(n) if _ends_sentence(tokens[p])), default=-1)
    e = n - 1
    k = _page_at(tokens, e, -1)
    if k and e - k + 1 > last:
        out.update(dict.fromkeys(range(e - k + 1, e + 1), "page"))
        e -= k
    s = e
    while s > last and _title_like(tokens[s]):
        s -= 1
    if e - s >= 2:
        first = s + 1
        k = _page_at(tokens, first, 1)
        if k and e not in out and n - 1 not in out and e - first + 1 - k >= 2:
            out.update(dict.fromkeys(range(first, first + k), "page"))
            first += k
        out.update(dict.fromkeys(range(first, e + 1), "header"))
    return out


def readings(tokens: list[str], labels: dict[int, str], low: set[int]) -> Iterator[tuple[int, str]]:
    """(position, reading) of all words to look up: single, ``stem|rest`` of broken words, ``a+b`` of torn ones.

    ``low``: positions of little confidence.
    """
    rest = -1
    for i, (t, (w, word, stem)) in enumerate(zip(tokens, map(_facts, tokens))):
        if not t or i in labels:
            continue
        if stem is not None and i != rest:
            nxt = tokens[i + 1] if i + 1 < len(tokens) and i + 1 not in labels else ""
            right = normal(nxt)
            if stem and right and nxt[0].isalnum() and right not in SUSPENDED and len(stem) + len(right) <= MOST_LENGTH:
                rest = i + 1
                yield i, stem + JOINED + right
                continue
        if i == rest:
            continue
        if word:
            yield i, w
        if low and (i in low or i + 1 in low):
            k, glued = i, w
            while len(glued) < MOST_LENGTH and _torn(tokens, k, labels, low):
                k += 1
                glued += GLUED + normal(tokens[k])
                if _eligible(glued.replace(GLUED, "")):
                    yield i, glued


def _torn(tokens: list[str], i: int, labels: dict[int, str], low: set[int]) -> bool:
    """Whether token i may go on in the next one."""
    if i + 1 >= len(tokens) or i + 1 in labels or not (i in low or i + 1 in low):
        return False
    return tokens[i + 1][:1].islower() and tokens[i][-1:].isalpha()


@lru_cache(1 << 16)
def _facts(token: str) -> tuple[str, bool, str | None]:
    """The normal form, whether it can be a word, and what can be the first half of one."""
    w, stem = normal(token), stem_of(token)
    return w, _eligible(w), _EDGE.sub("", stem.lower()) if stem else None


@lru_cache(1 << 16)
def _eligible(w: str) -> bool:
    return LEAST_LENGTH <= len(w) <= MOST_LENGTH and _WORD.fullmatch(w) is not None


def canonical(word: str) -> str:
    """Equal for words that confusions lead into each other."""
    out = word.translate(_CANONICAL)
    for x, y in LONGER:
        out = out.replace(x, y)
    return out


#: Characters that stand for another one of the same width, and those that are written with several.
SAME, AS = "rl1ea0th68v529", "iiicoofbbbyszg"
LONGER = (("n", "ii"), ("u", "ii"), ("m", "iii"), ("w", "yy"), ("d", "ci"))
_CANONICAL = str.maketrans(SAME, AS)


def canonical_column(c: Column) -> Column:
    out = F.translate(c, SAME, AS)
    for x, y in LONGER:
        out = F.replace(out, F.lit(x), F.lit(y))
    return out


@lru_cache(1 << 16)
def confusions(read: str, printed: str) -> tuple[int, int] | None:
    """Least number of confusions by which ``printed`` is read as ``read``, and how many of them put letters for letters."""
    best: dict[tuple[int, int], tuple[int, int]] = {(0, 0): (0, 0)}
    n, m = len(read), len(printed)
    for i in range(n):
        for j in range(m):
            now = best.get((i, j))
            if now is None:
                continue
            steps = [(1, 1, 0, 0)] if read[i] == printed[j] else []
            for k in (1, 2):
                seen = read[i : i + k]
                steps += [(k, len(p), 1, not seen.isdigit()) for p in CONFUSIONS.get(seen, ()) if len(seen) == k and printed.startswith(p, j)]
            for x, y, c, letters in steps:
                to, cost = (i + x, j + y), (now[0] + c, now[1] + letters)
                if to not in best or cost < best[to]:
                    best[to] = cost
    return best.get((n, m))


def spelling_cost(n: int, letters: int, length: int) -> float:
    """One for each confusion, and four more for each letter read for another beyond two or a quarter of the word."""
    return n + 4.0 * max(0, letters - max(2, length // 4))


def piece_cost(n: int, length: int) -> float:
    """What a word costs that ran together with others: half a missing space, its confusions, and its shortness."""
    return 1.25 + 3.0 * n + 2.0 * max(0, 5 - length)


#: What a word may cost at most to be better than a reading without evidence.
MOST_COST = 10.0
LEAST_PIECE = 3


def decode(tokens: list[str], labels: dict[int, str], found: dict[int, list[tuple[str, list[tuple[int, int, str, float, float]]]]]) -> tuple[list[tuple[int, str]], list[str]]:
    """Noisy lines (from 0) and the printed words of one record. ``found``: per position readings without evidence of their
    own, and all broken or torn words, each with its words (from, to, word, cost, evidence) over the reading's letters."""
    n = len(tokens)
    if not any(JOINED in source or words for own in found.values() for source, words in own):  # nothing to choose from
        return sorted(labels.items()), [t for i, t in enumerate(tokens) if i not in labels]
    here = {normal(t) for t in tokens}
    begin = list(itertools.accumulate((len(t) + 1 for t in tokens), initial=0))
    best: dict[int, float] = {0: 0.0}
    back: dict[int, tuple] = {}
    inner: dict[int, list[tuple]] = {}

    def edge(start: int, end: int, cost: float, what: tuple) -> None:
        if best[start] + cost < best.get(end, float("inf")):
            best[end], back[end] = best[start] + cost, (start, *what)

    def worth(word: str, evidence: float) -> float:
        return 0.01 * (10 - min(10.0, math.log1p(evidence))) - (0.1 if word in here else 0.0)

    for i, t in enumerate(tokens):
        if i not in found:  # nothing to choose from
            cost, end = best[begin[i]], begin[i + 1]
            if cost < best.get(end, float("inf")):
                best[end], back[end] = cost, (begin[i], "keep", i, t)
            continue
        options = dict(found[i])
        single = next((s for s in options if JOINED not in s and GLUED not in s), None)
        joined = next((s for s in options if JOINED in s), None)
        edge(begin[i], begin[i + 1], 3.0 if single is not None else 4.0 if joined else 0.0, ("keep", i, t))
        for source, words in options.items():
            if source == single:
                inner.clear()
                for word in words:
                    inner.setdefault(word[0], []).append(word)
                for at in sorted(inner):
                    if begin[i] + at not in best:
                        continue
                    for _, to, word, cost, evidence in inner[at]:
                        whole = to - at == len(source)
                        end = begin[i + 1] if to == len(source) else begin[i] + to
                        edge(begin[i] + at, end, (0.2 * cost + worth(word, evidence) if whole else 0.2 * cost) + (1.0 if at == 0 else 0.0), ("fix", i, word))
            elif source == joined:
                left, right = source.split(JOINED)
                edge(begin[i], begin[i + 2], 1.5, ("join", i, left + right, left, right))
                for _, _, word, cost, evidence in words:
                    edge(begin[i], begin[i + 2], 0.2 + 0.2 * cost + worth(word, evidence), ("join", i, word, left, right))
            else:
                k = source.count(GLUED) + 1
                if any(s == normal(tokens[j]) for j in range(i, i + k) for s, _ in found.get(j, ())):
                    for _, _, word, cost, evidence in words:
                        edge(begin[i], begin[i + k], 2.0 + 0.2 * cost + worth(word, evidence), ("glue", i, word, k))
    noisy: list[tuple[int, str]] = []
    words: list[tuple[int, int, str]] = []
    pieces: dict[int, list[str]] = {}
    j = begin[n]
    while j:
        start, kind, i, word, *more = back[j]
        if kind == "keep":
            words.append((start, i, word))
        elif kind == "fix":
            pieces.setdefault(i, []).append(word)
            if start == begin[i]:
                words.append((start, i, _dress(tokens[i], " ".join(reversed(pieces[i])))))
                noisy.append((i, "misread"))
        elif kind == "join":
            left, right = more
            words.append((start, i, _dress(tokens[i][:-1] + tokens[i + 1], word)))
            noisy.append((i, "hyphen"))
            if not word.endswith(right):
                noisy.append((i + 1, "misread"))
        else:
            words.append((start, i, _dress("".join(tokens[i : i + more[0]]), word)))
        j = start
    noisy = [(i, labels.get(i, kind)) for i, kind in noisy if i not in labels] + list(labels.items())
    return sorted(noisy), [w for _, i, w in sorted(words) if i not in labels]


def _dress(token: str, word: str) -> str:
    """``word`` with the punctuation and case of ``token``."""
    core = _EDGE.sub("", token)
    if not core:
        return word
    at = token.find(core)
    if core.isupper() and len(core) > 1:
        word = word.upper()
    elif core[0].isupper():
        word = word[:1].upper() + word[1:]
    return token[:at] + word + token[at + len(core) :]


TARGET_WORDS = 70
COHESION = 30.0


def paragraphs(words: list[str]) -> str:
    """Sentences joined into paragraphs by dynamic programming."""
    sentences: list[list[str]] = [[]]
    for w in words:
        sentences[-1].append(w)
        if _ends_sentence(w):
            sentences.append([])
    sentences = [s for s in sentences if s]
    if len(sentences) < 2:
        return " ".join(words)
    bags = [{w for w in map(normal, s) if len(w) > 4} for s in sentences]
    # what breaking in front of sentence k costs: more where it shares words with the one before
    shared = [0.0] + [len(a & b) / (1 + min(len(a), len(b))) for a, b in itertools.pairwise(bags)]
    sizes = list(itertools.accumulate((len(s) for s in sentences), initial=0))
    n = len(sentences)
    best, back = [0.0] + [float("inf")] * n, [0] * (n + 1)
    for j in range(1, n + 1):
        for i in range(j - 1, -1, -1):
            length = sizes[j] - sizes[i]
            cost = best[i] + ((length - TARGET_WORDS) / 10) ** 2 + (COHESION * shared[i] if i else 0)
            if cost < best[j]:
                best[j], back[j] = cost, i
            if length > 4 * TARGET_WORDS:
                break
    cuts, j = [], n
    while j:
        cuts.append((back[j], j))
        j = back[j]
    return "\n\n".join(" ".join(w for s in sentences[i:j] for w in s) for i, j in reversed(cuts))


def _objects(column: pa.Array) -> list:
    """Python objects of a column; much faster than ``to_pylist`` where NumPy can make them."""
    if pa.types.is_string(column.type) or column.null_count == 0 and pa.types.is_primitive(column.type):
        return column.to_numpy(zero_copy_only=False).tolist()
    return column.to_pylist()


def _texts(b: pa.RecordBatch, i: int) -> list:
    return _objects(b.column(i))


def _low(confidences: pa.ListArray) -> tuple[list[int], np.ndarray]:
    """Where each row's confidences begin (one more at the end), and whether they are known and little. A NULL row has none."""
    first = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(confidences), 0).to_numpy())])
    values = pc.list_flatten(confidences).to_numpy(zero_copy_only=False).astype(np.float64)
    return first.tolist(), (values >= 0) & (values < GLUE_CONFIDENCE)


def _options(found: pa.ListArray) -> Iterator[dict[int, list[tuple[str, list[tuple]]]]]:
    """``found`` of :func:`decode` for every row, without a Python object for each struct."""
    given = pc.list_flatten(found)
    lines, sources, words = (given.field(i) for i in range(3))
    inner = pc.list_flatten(words)
    tuples = list(zip(*(_objects(inner.field(i)) for i in range(5))))
    ends = np.cumsum(pc.fill_null(pc.list_value_length(words), 0).to_numpy()).tolist()
    lines, sources = _objects(lines), _objects(sources)
    at = start = 0
    for n in pc.fill_null(pc.list_value_length(found), 0).to_pylist():
        options: dict[int, list] = {}
        for k in range(at, at + n):
            options.setdefault(lines[k], []).append((sources[k], tuples[start : ends[k]]))
            start = ends[k]
        at += n
        yield options


def _spread_readings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, lines, sources, own = [], [], [], b.column(0)
        first, below = _low(b.column(2))
        for k, text in enumerate(_texts(b, 1)):
            if not text:
                continue
            tokens = text.split("\n")
            low = set(np.flatnonzero(below[first[k] : first[k + 1]]).tolist()) if first[k + 1] - first[k] == len(tokens) else set()
            if here := list(readings(tokens, layout(tokens), low)):
                own_lines, own_sources = zip(*here)
                ids += [k] * len(here)
                lines += own_lines
                sources += own_sources
        yield pa.RecordBatch.from_arrays([own.take(pa.array(ids, pa.int64())), pa.array(lines, pa.int32()), pa.array(sources, pa.string())], ["frame_id", "line", "source"])


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of plain texts, counted by batch."""
    for b in batches:
        count: Counter[str] = Counter()
        for column in b.columns:
            for text in _objects(column):
                if text:
                    count.update(text.lower().split())
        words: Counter[str] = Counter()
        for raw, k in count.items():
            w = _EDGE.sub("", raw)
            if len(w) > 2:
                words[w] += k
        yield pa.RecordBatch.from_arrays([pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())], ["word", "n"])


LOOKUP = "source string, frames bigint, at int, to int, letters string, canon string"
WORDS = "source string, at int, to int, word string, cost double, evidence double"


def _rows(out: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64()}
    fields = [f.split() for f in schema.split(", ")]
    columns = zip(*out) if out else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], [f for f, _ in fields])


def _letters(source: str) -> str:
    return source.replace(JOINED, "").replace(GLUED, "")


def _wholes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Readings as a whole, and broken words with the hyphen as their own."""
    for b in batches:
        out = []
        for source, frames in zip(_texts(b, 0), _texts(b, 1)):
            forms = [_letters(source)] + ([source.replace(JOINED, "-")] if JOINED in source else [])
            out += [(source, frames, 0, len(forms[0]), f, canonical(f)) for f in forms]
        yield _rows(out, LOOKUP)


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lexicon words of an equal canonical form: those that confusions, if any, explain, with their cost."""
    for b in batches:
        out = []
        for source, frames, at, to, letters, _, word, printed, seen in zip(*(_texts(b, i) for i in range(9))):
            broken, whole = JOINED in source, to - at == len(_letters(source))
            if not (printed > 0 or seen >= 3 * frames or broken) or (word == letters and whole and not broken and GLUED not in source):
                continue
            n = confusions(letters, word)
            if n is None or (n[0] and not (printed > 0 or seen >= 3 * frames)):
                continue
            if GLUED in source and n[0]:
                continue
            cost = spelling_cost(*n, len(word)) + (0.1 if "-" in letters and broken else 0.0) if whole else piece_cost(n[0], len(word))
            if cost < MOST_COST:
                out.append((source, at, to, word, cost, 3.0 * printed + seen))
        yield _rows(out, WORDS)


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces at both ends of readings of letters only, long enough for two words."""
    for b in batches:
        out = []
        for source, frames in zip(_texts(b, 0), _texts(b, 1)):
            n = len(source)
            if n >= 2 * LEAST_PIECE and source.isalpha():
                spans = [(0, k) for k in range(LEAST_PIECE, n - LEAST_PIECE + 1)] + [(k, n) for k in range(LEAST_PIECE, n - LEAST_PIECE + 1)]
                out += [(source, frames, i, k, source[i:k], canonical(source[i:k])) for i, k in spans]
        yield _rows(out, LOOKUP)


def _middles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces between known ones at the ends of a reading."""
    for b in batches:
        out = []
        for source, frames, firsts, lasts in zip(*(_texts(b, i) for i in range(4))):
            low, high = min(firsts), max(lasts)
            spans = [(i, k) for i in range(low, high - LEAST_PIECE + 1) for k in range(i + LEAST_PIECE, high + 1)]
            out += [(source, frames, i, k, source[i:k], canonical(source[i:k])) for i, k in spans]
        yield _rows(out, LOOKUP)


def _lattices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces that lie on a way from the beginning of their reading to its end."""
    for b in batches:
        out = []
        for source, pieces in zip(_texts(b, 0), _texts(b, 1)):
            ahead, behind = {0}, {len(source)}
            for x in sorted(pieces, key=lambda x: x["at"]):
                if x["at"] in ahead:
                    ahead.add(x["to"])
            for x in sorted(pieces, key=lambda x: -x["to"]):
                if x["to"] in behind:
                    behind.add(x["at"])
            out += [(source, x["at"], x["to"], x["word"], x["cost"], x["evidence"]) for x in pieces if x["at"] in ahead and x["to"] in behind]
        yield _rows(out, WORDS)


def _plain_digits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Letters in place of digits, for readings that are no code; the last resort, without evidence."""
    for b in batches:
        mixed = [x for x in _texts(b, 0) if JOINED not in x and GLUED not in x and any(c.isdigit() for c in x) and not _CODE.fullmatch(x)]
        yield _rows([(x, 0, len(x), "".join(CONFUSIONS.get(c, (c,))[0] if c.isdigit() else c for c in x), 9.0, 0.0) for x in mixed], WORDS)


def lexicon(spread: DataFrame, plain: list[DataFrame]) -> DataFrame:
    """``word, printed, frames``: evidence of every word. ``plain``: tables of columns with printed or spoken text."""
    recognised = spread.select("frame_id", F.regexp_replace("source", r"[|+]", "").alias("word")).filter(~F.col("source").contains(GLUED)).distinct()
    counts = recognised.groupBy("word").agg(F.lit(0).cast("bigint").alias("printed"), F.count("*").alias("frames"))
    for p in plain:
        counts = counts.unionByName(p.mapInArrow(_count_words, "word string, n bigint").select("word", F.col("n").alias("printed"), F.lit(0).cast("bigint").alias("frames")))
    return counts.groupBy("word").agg(F.sum("printed").alias("printed"), F.sum("frames").alias("frames"))


def decisions(spread: DataFrame, words: DataFrame) -> DataFrame:
    """``source, words array<struct<at, to, word, cost, evidence>>`` for every distinct reading without evidence of its own,
    and for all broken or torn words."""
    types = spread.groupBy("source").agg(F.countDistinct("frame_id").alias("seen"))
    single = types.join(words.withColumnRenamed("word", "source"), "source", "left")
    doubtful = cut_lineage(single.filter(F.col("source").rlike(r"[|+]") | (F.coalesce("printed", F.lit(0)) == 0)).select("source", F.coalesce("frames", "seen").alias("frames")), "doubtful")
    usable = words.filter((F.col("printed") > 0) | (F.col("frames") >= LEAST_FRAMES)).select("word", "printed", F.col("frames").alias("n_frames"), canonical_column(F.col("word")).alias("canon"))

    def looked_up(lookups: DataFrame) -> DataFrame:
        return lookups.join(usable, "canon").select("source", "frames", "at", "to", "letters", "canon", "word", "printed", "n_frames").mapInArrow(_checked, WORDS)

    wholes = cut_lineage(looked_up(doubtful.mapInArrow(_wholes, LOOKUP)).unionByName(doubtful.mapInArrow(_plain_digits, WORDS)), "wholes")
    open_ = doubtful.filter(~F.col("source").rlike(r"[|+]")).join(wholes.select("source").distinct(), "source", "left_anti")
    ends = cut_lineage(looked_up(open_.mapInArrow(_ends, LOOKUP)), "ends")
    gaps = ends.groupBy("source").agg(F.collect_set(F.when(F.col("at") == 0, F.col("to"))).alias("firsts"), F.collect_set(F.when(F.col("at") > 0, F.col("at"))).alias("lasts"))
    gaps = gaps.filter((F.size("firsts") > 0) & (F.size("lasts") > 0)).filter(F.array_max("lasts") - F.array_min("firsts") >= LEAST_PIECE)
    middles = looked_up(gaps.join(doubtful, "source").select("source", "frames", "firsts", "lasts").mapInArrow(_middles, LOOKUP))
    whole_row = F.struct("at", "to", "word", "cost", "evidence")
    pieces = ends.unionByName(middles).groupBy("source").agg(F.collect_list(whole_row).alias("pieces")).filter(F.size("pieces") > 1).mapInArrow(_lattices, WORDS)
    found = wholes.unionByName(pieces).groupBy("source").agg(F.collect_list(whole_row).alias("words"))
    return doubtful.select("source").join(found, "source", "left")


def repair(frames: DataFrame, plain: list[DataFrame]) -> DataFrame:
    """``frame_id, lines array<struct<line_no, noise_kind>>, cleaned_text`` of ``frames(frame_id, text, word_confidences)``."""
    spread = cut_lineage(frames.select("frame_id", "text", "word_confidences").mapInArrow(_spread_readings, "frame_id bigint, line int, source string"), "readings")
    words = cut_lineage(lexicon(spread, plain), "lexicon")
    found = spread.join(decisions(spread, words), "source").groupBy("frame_id").agg(F.collect_list(F.struct("line", "source", "words")).alias("found"))
    pages = frames.select("frame_id", "text").join(found, "frame_id", "left")
    schema = "frame_id bigint, lines array<struct<line_no:int,noise_kind:string>>, cleaned_text string"
    line_type = pa.list_(pa.struct([("line_no", pa.int32()), ("noise_kind", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lines, texts = [], []
            for text, options in zip(_texts(b, 1), _options(b.column(2))):
                if not text:
                    lines.append([])
                    texts.append(text)
                    continue
                tokens = text.split("\n")
                noisy, printed = decode(tokens, layout(tokens), options)
                lines.append([{"line_no": i + 1, "noise_kind": kind} for i, kind in noisy])
                texts.append(paragraphs(printed))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lines, line_type), pa.array(texts, pa.string())], ["frame_id", "lines", "cleaned_text"])

    return pages.mapInArrow(run, schema)
