"""One consistent character form for text, computed on numpy code-point arrays.

A whole Arrow batch is handled at once: the text buffer becomes one array of code points with row offsets,
lookup tables give the expansion of every code point, and marks are put in order and composed with array
operations. No string function is called per row.

The form:
* characters that leave no mark (zero width, joiners, soft hyphen, bidi controls, variation selectors, control
  codes) are dropped; a joiner between two pictographs stays, since the picture depends on it;
* wide and narrow forms become the ordinary ones; letter and separate accent become the accented letter;
* inside a word that also has a Latin letter, letters of other scripts shaped like a Latin one become it;
* runs of spaces of any kind become one space, and none stays at either end of a line;
* carriage returns, line and paragraph separators become line feeds; case, accents and line breaks stay.
"""

from __future__ import annotations

import functools
import unicodedata

import numpy as np
import pyarrow as pa

# Letters shaped like a Latin one, as pairs "other letter, Latin letter".
LOOKALIKES = (
    "ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX οo νv ϲc ϳj "  # Greek
    "АA ВB ЕE ЅS ІI ЈJ КK МM НH ОO РP СC ТT УY ХX ҮY ӀI ԌG ԚQ ԜW "  # Cyrillic capitals
    "аa сc еe һh іi јj оo рp ѕs уy хx ԁd ԛq ԝw ѵv ӏl "  # Cyrillic small letters
    "Օo օo Տs ցg հh ոn սu"  # Armenian
).split()
# Format characters that show a mark, and fillers that show none.
VISIBLE_FORMAT = {0x600, 0x601, 0x602, 0x603, 0x604, 0x605, 0x6DD, 0x70F, 0x890, 0x891, 0x8E2, 0x110BD, 0x110CD}
INVISIBLE_OTHER = {0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180F, 0x3164, 0xFFA0}
LIMIT = 0x110000
SPACE, FEED, ZWJ = 0x20, 0x0A, 0x200D


def _expand(c: int) -> list[int]:
    ch = chr(c)
    cat = unicodedata.category(ch)
    if c in (0x0A, 0x0B, 0x0C, 0x0D, 0x85) or cat in ("Zl", "Zp"):
        return [FEED]
    if c == 0x09 or cat == "Zs":
        return [SPACE]
    if c == ZWJ:
        return [ZWJ]
    if c in INVISIBLE_OTHER or 0xFE00 <= c <= 0xFE0F or 0xE0100 <= c <= 0xE01EF:
        return []
    if cat == "Cc" or (cat == "Cf" and c not in VISIBLE_FORMAT):
        return []
    d = unicodedata.decomposition(ch)
    if not d:
        return [c]
    parts = d.split()
    if parts[0] in ("<wide>", "<narrow>"):
        parts = parts[1:]
    elif parts[0][0] == "<":
        return [c]
    return [y for x in parts for y in _expand(int(x, 16))]


@functools.cache
def tables() -> dict[str, np.ndarray]:
    """Lookup tables over all code points, built once per Python worker from the Unicode data of the runtime."""
    start = np.arange(LIMIT, dtype=np.int64)
    length = np.ones(LIMIT, dtype=np.int8)
    ccc = np.zeros(LIMIT, dtype=np.uint8)
    latin = np.zeros(LIMIT, dtype=bool)
    emoji = np.zeros(LIMIT, dtype=bool)
    pool: list[int] = []
    pairs: dict[int, int] = {}
    for c in [*range(0xD800), *range(0xE000, 0x32000), *range(0xE0000, 0xE0200)]:
        ch = chr(c)
        e = _expand(c)
        if e != [c]:
            start[c], length[c] = LIMIT + len(pool), len(e)
            pool += e
        k = unicodedata.combining(ch)
        if k:
            ccc[c] = k
        d = unicodedata.decomposition(ch)
        if d and d[0] != "<" and " " in d and unicodedata.normalize("NFC", ch) == ch:
            a, b = (int(x, 16) for x in d.split())
            pairs[a << 21 | b] = c
        if c < 0x250 or 0x1E00 <= c < 0x1F00 or 0x2C60 <= c < 0x2C80 or 0xA720 <= c < 0xA800:
            latin[c] = unicodedata.category(ch)[0] == "L" and unicodedata.name(ch, "").startswith("LATIN")
    emoji[0x1F000:0x1FB00] = True
    emoji[0x2600:0x27C0] = True
    emoji[0x2190:0x2200] = True
    look = np.arange(LIMIT, dtype=np.uint32)
    for a, b in LOOKALIKES:
        look[ord(a)] = ord(b)
    keys = np.array(sorted(pairs), dtype=np.int64)
    second = np.zeros(LIMIT, dtype=bool)
    second[[k & 0x1FFFFF for k in pairs if ccc[k & 0x1FFFFF] == 0]] = True
    return {
        "start": start,
        "length": length,
        "pool": np.concatenate([np.arange(LIMIT, dtype=np.uint32), np.array(pool, dtype=np.uint32)]),
        "ccc": ccc,
        "latin": latin,
        "emoji": emoji,
        "look": look,
        "pair_keys": keys,
        "pair_to": np.array([pairs[k] for k in keys.tolist()], dtype=np.uint32),
        "second": second,
    }


def decode(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all rows in one array, and where each row starts (one more entry than rows). Nulls are empty rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint32), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    points = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
    first = np.zeros(len(raw) + 1, np.int64)
    np.cumsum((raw & 0xC0) != 0x80, out=first[1:])
    return points, first[offsets - offsets[0]]


def encode(points: np.ndarray, rows: np.ndarray, valid: np.ndarray | None = None) -> pa.Array:
    """The reverse of decode(), as an Arrow string array; rows that aren't valid are null."""
    data = points.astype("<u4").tobytes().decode("utf-32-le").encode("utf-8")
    size = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
    ends = np.zeros(len(points) + 1, np.int64)
    np.cumsum(size, out=ends[1:])
    mask = None if valid is None or valid.all() else pa.py_buffer(np.packbits(valid, bitorder="little").tobytes())
    out = pa.LargeStringArray.from_buffers(len(rows) - 1, pa.py_buffer(ends[rows].tobytes()), pa.py_buffer(data), mask)
    return out.cast(pa.string())


def _keep(points: np.ndarray, rows: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    before = np.zeros(len(points) + 1, np.int64)
    np.cumsum(mask, out=before[1:])
    return points[mask], before[rows]


def _row_start(n: int, rows: np.ndarray) -> np.ndarray:
    flag = np.zeros(n + 1, bool)
    flag[rows] = True
    return flag[:n]


def _shifted(x: np.ndarray, by: int, fill) -> np.ndarray:
    out = np.full(len(x), fill, x.dtype)
    if by > 0:
        out[by:] = x[:-by]
    else:
        out[:by] = x[-by:]
    return out


def _pair(t: dict, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """What a followed by b composes to, or 0."""
    key = a.astype(np.int64) << 21 | b.astype(np.int64)
    at = np.minimum(np.searchsorted(t["pair_keys"], key), len(t["pair_keys"]) - 1)
    return np.where(t["pair_keys"][at] == key, t["pair_to"][at], 0).astype(np.uint32)


def _compose(t: dict, points: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Canonical order of marks and canonical composition over the whole array."""
    ccc = t["ccc"][points]
    marks = np.flatnonzero(ccc)
    alive = np.ones(len(points), bool)
    if len(marks):
        head = _row_start(len(points), rows) | (ccc == 0)  # a row that begins with marks has no starter
        run = np.cumsum(head)
        order = np.lexsort((ccc[marks], run[marks]))  # stable: equal classes keep their order
        points = points.copy()
        # a mark that opens a row belongs to a run of its own that starts with it; it is in place already
        points[marks] = points[marks][order]
        ccc = t["ccc"][points]
        starts = np.flatnonzero(head)
        length = np.diff(np.append(starts, len(points)))
        busy = length > 1
        at, size = starts[busy], length[busy]
        starter = points[at].copy()
        opened = ccc[at] == 0
        last = np.zeros(len(at), np.int16)
        for k in range(1, int(size.max(initial=1))):
            on = np.flatnonzero((size > k) & opened)
            if not len(on):
                break
            pos = at[on] + k
            c = ccc[pos].astype(np.int16)
            to = _pair(t, starter[on], points[pos])
            joins = (to != 0) & (last[on] < c)
            starter[on[joins]] = to[joins]
            alive[pos[joins]] = False
            last[on[~joins]] = c[~joins]
        points[at] = starter
    for _ in range(2):  # Hangul and the few pairs whose second part is no mark
        hangul_second = (points >= 0x1161) & (points <= 0x11C2)
        if not (hangul_second | t["second"][points]).any():
            break
        points, rows = _keep(points, rows, alive)
        alive = np.ones(len(points), bool)
        a, b = points[:-1].astype(np.int64), points[1:].astype(np.int64)
        to = _pair(t, a, b)
        lv = (a >= 0x1100) & (a < 0x1113) & (b >= 0x1161) & (b < 0x1176)
        to = np.where(lv, 0xAC00 + ((a - 0x1100) * 21 + (b - 0x1161)) * 28, to)
        lvt = (a >= 0xAC00) & (a < 0xD7A4) & ((a - 0xAC00) % 28 == 0) & (b > 0x11A7) & (b < 0x11C3)
        to = np.where(lvt, a + b - 0x11A7, to)
        ok = (to != 0) & ~_row_start(len(points), rows)[1:] & (t["ccc"][points[1:]] == 0)
        ok &= ~_shifted(ok, 1, False)
        points = points.copy()
        points[:-1][ok] = to[ok]
        alive[1:][ok] = False
    return _keep(points, rows, alive)


def canonical(points: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The consistent form of every row; see the module's text."""
    t = tables()
    if not len(points):
        return points, rows
    # expansion: lookup-table gather with expansion offsets
    size = t["length"][points].astype(np.int64)
    ends = np.zeros(len(points) + 1, np.int64)
    np.cumsum(size, out=ends[1:])
    where = np.repeat(t["start"][points] - ends[:-1], size) + np.arange(ends[-1])
    crlf = (points == 0x0D) & (_shifted(points, -1, 0) == 0x0A)
    crlf[np.maximum(rows[1:] - 1, 0)] &= False
    keep = ~np.repeat(crlf, size)
    points, rows = _keep(t["pool"][where], ends[rows], keep)
    # joiners stay only between pictographs
    if len(points):
        zwj = points == ZWJ
        if zwj.any():
            em = t["emoji"][points]
            edge = _row_start(len(points), rows)
            stay = zwj & _shifted(em, 1, False) & _shifted(em, -1, False) & ~edge & ~_shifted(edge, -1, True)
            points, rows = _keep(points, rows, ~zwj | stay)
    if not len(points):
        return points, rows
    # letters of other scripts inside words with a Latin letter; marks are still separate here
    swap = t["look"][points]
    if (swap != points).any():
        gap = (points == SPACE) | (points == FEED)
        word = np.cumsum(gap | _row_start(len(points), rows))
        has = np.zeros(word[-1] + 1, bool)
        has[word[t["latin"][points]]] = True
        points = np.where(has[word], swap, points)
    points, rows = _compose(t, points, rows)
    # runs of spaces become one, none at the ends of lines
    sp = points == SPACE
    if sp.any():
        edge = _row_start(len(points), rows)
        before = _shifted(sp, 1, False) & ~edge
        points, rows = _keep(points, rows, ~(sp & before))
        sp, feed, edge = points == SPACE, points == FEED, _row_start(len(points), rows)
        left = edge | _shifted(feed, 1, True)
        right = _shifted(edge, -1, True) | _shifted(feed, -1, True)
        points, rows = _keep(points, rows, ~(sp & (left | right)))
    return points, rows


def canonical_column(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """The consistent form of an Arrow string column; null stays null, empty stays empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    valid = np.asarray(column.is_valid())
    return encode(*canonical(*decode(column)), valid)
