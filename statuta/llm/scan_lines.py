"""Lines of scanned files as a sequence: layout features, and a hidden Markov model that labels them."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: ``BODY`` is a line of the body whose paragraph goes on in the next one, ``BREAK`` one that ends its paragraph.
TITLE, BODY, RUNNING, NUMBER, BREAK = range(5)
STATES = 5

# Letters that stand for digits in misread numbers.
DIGIT_LOOKS = str.maketrans("lIiOoSBZ", "11100582")
_CN = {c: i for i, c in enumerate("〇一二三四五六七八九")} | {"零": 0, "两": 2}
_ROMAN = re.compile(r"^(?=[ivxlc])(c{0,3})(xc|xl|l?x{0,3})(ix|iv|v?i{0,3})$")
_NUMBER = re.compile(
    r"^(?P<a>[-—–·〔【\[(（第页码Pp:： .~]*?(?:Page|page|PAGE|No\.)?\s*)(?P<n>[0-9０-９lIOoSB]{1,5}|[一二三四五六七八九十百零〇]{1,6}|[ivxlcIVXLC]{1,7})(?P<b>\s*(?:页\s*)?(?:(?:/|of|共|之)\s*[0-9０-９lIOoSB]{1,5}\s*页?)?[-—–·〕】\])） 页.~]*)$"
)
_END = re.compile(r"[。；！？;.!?：:，,、）)”\"]$")
_SENTENCE = re.compile(r"[。；;，,、：:.!?！？]$")
_PUNCT = re.compile(r"[。；，、！？,;!?：]")
# Marks that divide a word at a line's end.
MARKS = "-‐‑–—¬­"
DIVIDED = re.compile(rf"([A-Za-z0-9]*[A-Za-z])([{MARKS}])$")
STARTS = re.compile(r"([A-Za-z0-9]+)")
_OPENS = re.compile(r"第[零一二三四五六七八九十百千万\d]+[章节条]|(?:Section|Article|Chapter)\s+\d+|[（(][一二三四五六七八九十]+[）)]")
_CLOSES = re.compile(r"[。！？.!?]\s*$")
#: Marks that fill a line beside a page's number.
_FILL = re.compile(r"([-—–·.~ ])\1{3,}")
_NUMBER_TAIL = re.compile(r"[0-9０-９lSOB]$")
_NUMBER_HEAD = re.compile(r"^[.0-9０-９%]")


def cn_value(s: str) -> int:
    """The value of Chinese numerals below 1000, also of digits in a row."""
    if "十" not in s and "百" not in s:
        return int("".join(str(_CN[c]) for c in s))
    total = now = 0
    for c in s:
        if c in "十百":
            total += (now or 1) * (10 if c == "十" else 100)
            now = 0
        else:
            now = _CN[c]
    return total + now


def roman_value(s: str) -> int:
    worth = [{"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}[c] for c in s.lower()]
    return sum(-a if i + 1 < len(worth) and a < worth[i + 1] else a for i, a in enumerate(worth))


def page_number(line: str) -> tuple[str, int] | None:
    """Style and value of a line that looks like a page's number and nothing else."""
    if len(line) > 24:
        line = _FILL.sub(r"\1", line)
    if len(line) > 24 or not (m := _NUMBER.match(line)):
        return None
    n = m["n"]
    style = re.sub(r"[0-9０-９lIOoSB]+", "9", m["a"]) + "|" + re.sub(r"[0-9０-９lIOoSB]+", "9", m["b"])
    if n[0] in _CN or n[0] in "十百":
        return (style + "c", cn_value(n)) if style != "|" else None
    if _ROMAN.match(n.lower()) and (style == "|" or not n[0].isdigit()):
        return style + "r", roman_value(n)
    try:
        return style + "d", int(n.translate(DIGIT_LOOKS))
    except ValueError:
        return None


def plain_key(line: str) -> str:
    """Letters and ideographs of ``line`` alone, lower-cased."""
    return "".join(c for c in line.lower() if c.isalpha())


def grams(key: str) -> Counter:
    """Neighbouring characters of ``key``, its edges included, with their number."""
    return Counter(zip("^" + key, key + "$", strict=True))


def overlap(a: Counter, b: Counter) -> int:
    return sum(min(n, b[g]) for g, n in a.items() if g in b)


def same_text(a: Counter, b: Counter) -> bool:
    """Whether two lines are one text, some characters of it damaged."""
    na, nb = a.total(), b.total()
    if not 0.5 <= na / nb <= 2:
        return False
    both = overlap(a, b)
    return both >= 0.45 * (na + nb - both)


def written(pages: list[list[str]]) -> tuple[list[tuple[int, int]], list[str]]:
    """(page, line) and text of each line that isn't blank."""
    where = [(p, i) for p, ls in enumerate(pages) for i, x in enumerate(ls) if x.strip()]
    return where, [pages[p][i].strip() for p, i in where]


def observations(pages: list[list[str]], title: str) -> tuple[list[tuple[int, int]], list[str], np.ndarray]:
    """(page, line) and text of each line that isn't blank, and its observed symbol.

    A symbol holds whether the line looks like a page's number and goes on the file's numbering,
    whether it is like the title or repeats in the file, whether it is shorter than a line of the
    body without an end, and where on its page it stands (next to a page's number counts as an edge);
    further whether it ends with a sentence, at the width of the body or before, whether the next line
    that may be one of the body opens a section, and whether that line goes on a word divided by a mark.
    """
    where, lines = written(pages)
    n = len(lines)
    if not n:
        return where, lines, np.zeros(0, np.int64)
    page = np.array([p for p, _ in where])
    top = np.concatenate([[True], page[1:] != page[:-1]])
    bottom = np.concatenate([page[1:] != page[:-1], [True]])
    numbers = [page_number(x) for x in lines]
    chains: dict[str, list[tuple[int, int]]] = defaultdict(list)
    for i, x in enumerate(numbers):
        if x:
            chains[x[0]].append((i, x[1]))
    goes_on = np.zeros(n, bool)
    for style, own in chains.items():
        # bare digits may be a piece of a number of the text that the line's end divides
        inside = [style == "|d" and i > 0 and i + 1 < n and bool(_NUMBER_TAIL.search(lines[i - 1])) and bool(_NUMBER_HEAD.match(lines[i + 1])) for i, _ in own]
        gap = 0 if style != "|d" else 4
        for k, (i, a) in enumerate(own):
            for m in range(k + 1, min(k + 4, len(own))):
                j, b = own[m]
                if b == a + 1 and j - i > (10 if inside[k] or inside[m] else gap if page[i] == page[j] else 0):
                    goes_on[[i, j]] = True
                    break
    # the numbers of a file stand in one style; others that go on by chance count as looks only
    best = max(chains, key=lambda s: sum(goes_on[i] for i, _ in chains[s]), default=None)
    found = bool(goes_on.any())
    for s, own in chains.items():
        for i, _ in own:
            if found and s != best:
                goes_on[i] = False
            elif s not in ("|d", "|r"):
                goes_on[i] |= bool(top[i] or bottom[i])
            elif not found:
                goes_on[i] = bool(bottom[i] or (top[i] and i + 1 < n and not top[i + 1]))
    numeric = np.array([2 if goes_on[i] else 1 if numbers[i] else 0 for i in range(n)])
    size = np.array([len(x) for x in lines])
    body = size[(numeric == 0) & (size > 8)]
    width = float(np.median(body)) if len(body) else 1.0
    ended = np.array([bool(_END.search(x)) for x in lines])
    short = (size < 0.8 * width) & ~ended
    sentence = np.array([bool(_SENTENCE.search(x)) for x in lines])
    punct = np.array([bool(_PUNCT.search(x)) for x in lines])
    # lines that may accompany the pages: no longer than the body's and without a sentence's end
    keys = [plain_key(x) if size[i] < 1.2 * width and not sentence[i] and not numbers[i] else "" for i, x in enumerate(lines)]
    often = Counter(k for k in keys if len(k) > 3)
    heading = grams(t) if (t := plain_key(re.sub(r"_\d{8}$", "", title or ""))) else None
    groups: list[list] = [[grams(k), c] for k, c in often.items() if c > 1]
    like = np.zeros(n, np.int64)
    loose: list[tuple[int, Counter, list]] = []
    for i, k in enumerate(keys):
        if len(k) <= 3:
            continue
        few = short[i] and not punct[i]
        if heading is not None and len(k) <= 1.7 * len(t) and (few or len(k) < 2.5 * len(t)):
            c = grams(k)
            # a running line may say more than the title
            if same_text(c, heading) or overlap(c, heading) >= max(4, 0.75 * heading.total()):
                like[i] = 1
                continue
        if often[k] > 1:
            like[i] = 2
        elif few:
            c = grams(k)
            own = next((g for g in groups if same_text(c, g[0])), None)
            if own is None:
                groups.append(own := [c, 0])
            own[1] += 1
            loose.append((i, c, own))
    for i, _, own in loose:
        if own[1] > 1:
            like[i] = 2
    strong = numeric == 2
    after = np.concatenate([[False], strong[:-1]])
    before = np.concatenate([strong[1:], [False]])
    up = top | after | np.concatenate([[False], (top & strong)[:-1]])
    down = bottom | before
    edge = np.where(up, 1, np.where(down, 2, 0))
    edge[(np.arange(n) == 0) | ((np.arange(n) == 1) & strong[0])] = 3
    closes = np.array([bool(_CLOSES.search(x)) for x in lines])
    end = np.where(closes, np.where(size < 0.75 * width, 2, 1), 0)
    opens, divided = np.zeros(n, bool), np.zeros(n, bool)
    following = ""
    for i in range(n - 1, -1, -1):
        if following:
            opens[i] = bool(_OPENS.match(following))
            divided[i] = divides(lines[i], following) is not None
        if not numeric[i] and not like[i]:
            following = lines[i]
    layout = ((numeric * 3 + like) * 4 + edge) * 4 + short * 2 + punct
    return where, lines, ((layout * 3 + end) * 2 + opens) * 2 + divided


def divides(line: str, following: str) -> tuple[str, str, str] | None:
    """What stands before and behind a mark that divides a word at the end of ``line``, and the mark."""
    if line[-1] in MARKS and following[0].islower() and (m := DIVIDED.search(line)) and (s := STARTS.match(following)):
        return m[1], s[1], m[2]
    return None


LAYOUTS, TAILS = 3 * 3 * 4 * 4, 3 * 2 * 2
SYMBOLS = LAYOUTS * TAILS
#: Share that the first guess keeps in the model, and the number of lines of each state that it counts for besides.
KEPT, KEPT_LINES = 0.5, 1000.0


def first_guess() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, transition and emission probabilities from what the features mean; training goes on from here."""
    start = np.array([0.85, 0.019, 0.03, 0.10, 0.001])
    # after a line of the body one of five ends its paragraph
    into = lambda body: [body * 0.8, body * 0.2]
    move = np.zeros((STATES, STATES))
    for s, (title, body, running, number) in {TITLE: (0.001, 0.95, 0.02, 0.029), BODY: (0.0005, 0.92, 0.04, 0.0395), RUNNING: (0.0005, 0.6, 0.05, 0.3495), NUMBER: (0.2, 0.5, 0.28, 0.02), BREAK: (0.0005, 0.92, 0.04, 0.0395)}.items():
        move[s, [TITLE, BODY, BREAK, RUNNING, NUMBER]] = [title, *into(body), running, number]
    emit = np.zeros((STATES, LAYOUTS))
    for s in range(LAYOUTS):
        numeric, like, edge, short, punct = s // 48, s // 16 % 3, s // 4 % 4, s // 2 % 2, s % 2
        emit[TITLE, s] = (0.9 if edge == 3 else 0.01) * (0.9 if like == 1 else 0.1) * (0.02 if numeric else 1) * (0.05 if punct else 1)
        emit[BODY, s] = (1, 0.05, 0.001)[numeric] * (0.0005 if like else 1) * (0.03 if short and not punct else 1) * (0.5 if edge else 1)
        emit[RUNNING, s] = (1.0 if edge in (1, 2) else 0.4 if like else 0.02) * (0.02 if numeric else 1) * (0.03, 1.0, 1.0)[like] * (1.0 if short else 0.2) * (0.1 if punct else 1) * (0.02 if edge == 3 else 1)
        emit[NUMBER, s] = (0.00001, 0.02, 1)[numeric] * (1.0 if edge else 0.2) * (0.1 if like else 1)
    emit[BREAK] = emit[BODY]
    emit /= emit.sum(1, keepdims=True)
    tail = np.zeros((STATES, TAILS))
    for t in range(TAILS):
        end, opens, divided = t // 4, t // 2 % 2, t % 2
        tail[BODY, t] = (0.9, 0.09, 0.01)[end] * (0.998, 0.002)[opens] * (0.97, 0.03)[divided]
        tail[BREAK, t] = (0.05, 0.45, 0.5)[end] * (0.3, 0.7)[opens] * (0.9998, 0.0002)[divided]
    # what a line ends with tells the lines of the body apart, and nothing about the others
    tail[[TITLE, RUNNING, NUMBER]] = 0.8 * tail[BODY] + 0.2 * tail[BREAK]
    return start, move, (emit[:, :, None] * tail[:, None, :]).reshape(STATES, SYMBOLS)


def _padded(seqs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(s) for s in seqs])
    out = np.zeros((len(seqs), int(sizes.max()) if len(sizes) else 0), np.int64)
    for i, s in enumerate(seqs):
        out[i, : len(s)] = s
    return out, sizes


def expected(seqs: list[np.ndarray], model: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """How often the model expects each symbol in each state and each move between states in ``seqs``, as one flat array."""
    start, move, emit = model
    counts, moves = np.zeros((SYMBOLS, STATES)), np.zeros((STATES, STATES))
    seqs = sorted((s for s in seqs if len(s)), key=len, reverse=True)
    for first in range(0, len(seqs), 512):
        obs, sizes = _padded(seqs[first : first + 512])
        n, most = obs.shape
        live = [int((sizes > t).sum()) for t in range(most)]
        e = emit.T[obs]
        a = np.zeros((n, most, STATES))
        now = start * e[:, 0]
        a[:, 0] = now / now.sum(1, keepdims=True)
        for t in range(1, most):
            m = live[t]
            now = (a[:m, t - 1] @ move) * e[:m, t]
            a[:m, t] = now / now.sum(1, keepdims=True)
        back = np.ones((n, STATES))
        for t in range(most - 1, -1, -1):
            m = live[t]
            here = a[:m, t] * back[:m]
            a[:m, t] = here / here.sum(1, keepdims=True)
            if t:
                x = e[:m, t] * back[:m]
                # the forward part of t - 1 has not been put right yet
                pair = a[:m, t - 1, :, None] * move[None] * x[:, None, :]
                moves += (pair / pair.sum((1, 2), keepdims=True)).sum(0)
                step = x @ move.T
                back[:m] = step / step.sum(1, keepdims=True)
        inside = np.arange(most)[None, :] < sizes[:, None]
        at = obs[inside]
        for y in range(STATES):
            counts[:, y] += np.bincount(at, a[:, :, y][inside], SYMBOLS)
    return np.concatenate([counts.ravel(), moves.ravel()])


def maximised(sums: np.ndarray, first: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The model that the expected counts give; the first guess counts for ``KEPT`` of all and ``KEPT_LINES`` lines a state."""
    counts, moves = sums[: SYMBOLS * STATES].reshape(SYMBOLS, STATES).T, sums[SYMBOLS * STATES :].reshape(STATES, STATES)
    mixed = lambda c, f: (c * (1 - KEPT) + f * (KEPT * c.sum(1, keepdims=True) + KEPT_LINES)) / (c.sum(1, keepdims=True) + KEPT_LINES)
    return first[0], mixed(moves, first[1]), mixed(counts, first[2])


def trained(seqs: list[np.ndarray], rounds: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The model after ``rounds`` of expectation maximisation over ``seqs``."""
    first = model = first_guess()
    for _ in range(rounds):
        model = maximised(expected(seqs, model), first)
    return model


def trained_on(symbols: DataFrame, rounds: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``trained``, of the sequences in the column ``symbols`` (arrays): the tasks sum what they expect, only the sums reach the driver."""
    first = model = first_guess()
    for _ in range(rounds):

        def sums(batches: Iterator[pa.RecordBatch], model=model) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            total = np.zeros(SYMBOLS * STATES + STATES * STATES)
            for batch in batches:
                column = batch.column(0)
                total += expected(np.split(column.flatten().to_numpy().astype(np.int64), np.cumsum(pc.list_value_length(column).to_numpy())[:-1]) if len(column) else [], model)
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["i", "n"])

        # at most one row for each symbol and state
        rows = symbols.select("symbols").mapInArrow(sums, "i int, n double").groupBy("i").agg(F.sum("n").alias("n")).collect()
        total = np.zeros(SYMBOLS * STATES + STATES * STATES)
        for r in rows:
            total[r.i] = round(r.n, 3)
        model = maximised(total, first)
    return model


def labelled(seqs: list[np.ndarray], model: tuple[np.ndarray, np.ndarray, np.ndarray]) -> list[np.ndarray]:
    """The most likely states of each sequence (Viterbi), many sequences side by side."""
    start, move, emit = (np.log(np.maximum(x, 1e-300)) for x in model)
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(seqs)
    order = sorted((i for i in range(len(seqs)) if len(seqs[i])), key=lambda i: -len(seqs[i]))
    for a in range(0, len(order), 256):
        group = order[a : a + 256]
        obs, sizes = _padded([seqs[i] for i in group])
        n, most = obs.shape
        came = np.zeros((n, most, STATES), np.int8)
        best = start + emit.T[obs[:, 0]]
        ends = np.zeros((n, STATES))
        ends[sizes == 1] = best[sizes == 1]
        for t in range(1, most):
            m = int((sizes > t).sum())
            way = best[:m, :, None] + move
            came[:m, t] = way.argmax(1)
            best = way.max(1) + emit.T[obs[:m, t]]
            done = sizes[:m] == t + 1
            ends[:m][done] = best[done]
        for k, i in enumerate(group):
            path = np.zeros(sizes[k], np.int64)
            path[-1] = ends[k].argmax()
            for t in range(int(sizes[k]) - 1, 0, -1):
                path[t - 1] = came[k, t, path[t]]
            out[i] = path
    return out
