"""Text garbled by decoding with the wrong character set (problem 7).

A best-first search over texts: each step undoes one wrong decoding (encode with the set it was read in, decode with
the one it was written in), unescapes entities or restores letter case that hides a byte sequence. The cost of a text is
how implausible its characters are where they stand; a step has a small cost of its own, so a text changes only if the
change pays. Texts already visited are not visited again.
"""

from __future__ import annotations

import heapq
import html
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letters usual in names and texts of this domain's languages, and signs usual in running text.
_LETTERS = "åäöéüëøæèêáířšžýěťąãþ"
_INITIALS = "ÅÄÖÉÜØÆÁŠŽÞĄ"
_SIGNS = "–—‘’“”„…•✓«»€°§™"
_BLANKS = "\u00a0\u2007\u2009\u202f\u200b\ufeff"
_SINGLE = ("cp1252", "cp850", "mac_roman", "cp1251", "cp437")
_REREAD = (("cp850", "cp1252"), ("mac_roman", "cp1252"), ("cp437", "cp1252"), ("cp1252", "cp850"), ("cp1252", "mac_roman"), ("cp1251", "cp1252"))

_PLAIN, _RARE, _FOREIGN, _SIGN, _CONTROL = 0.02, 1.0, 2.0, 2.0, 3.0
_UNDO, _REMAP, _RECASE = 0.25, 0.6, 0.3  # what a step costs; rereading one byte as another fits any text, so it must pay more


def _table(name: str) -> dict[str, int]:
    """Character to byte of a one-byte set; bytes the set leaves open stand for the control character of that number."""
    out = {}
    for b in range(128, 256):
        try:
            out[bytes([b]).decode(name)] = b
        except UnicodeDecodeError:
            out[chr(b)] = b
    for b in range(128, 160):
        out.setdefault(chr(b), b)
    return out


_TO_BYTE = {n: {ord(c): chr(b) for c, b in _table(n).items()} for n in _SINGLE}
_BACK = {n: {b: c for c, b in reversed(list(_table(n).items()))} for n in _SINGLE}
_MAPS = [{ord(c): _BACK[b][x] for c, x in _table(a).items() if c not in _BLANKS and ord(c) > 159 and _BACK[b][x] not in _BLANKS} for a, b in _REREAD]
_UTF8 = re.compile("[Â-ß][\u0080-¿]|[à-ï][\u0080-¿]{2}|[ð-ô][\u0080-¿]{3}")
_ENTITY = re.compile(r"&(?:#\d{2,6}|#[xX][0-9a-fA-F]{2,6}|[A-Za-z]{2,8}\d{0,2});")
_LOWER_LEADS = {ord(x): x.upper() for x in "ãâåäгвед"}
_VOWELS = set("aouåäAOUÅÄ")


_WORD = re.compile(r"[^\W\d_]+")


def _other_script(s: str) -> set[int]:
    """Places of the letters of words that are written in one other script throughout; letters of two scripts in one word
    are never plausible."""
    out: set[int] = set()
    for m in _WORD.finditer(s):
        w = m.group()
        if len(w) > 1 and all(ord(c) > 0x24F and not 0x1E00 <= ord(c) <= 0x1EFF for c in w) and len({ord(c) >> 8 for c in w}) == 1:
            out.update(range(m.start(), m.end()))
    return out


def _all_plain(s: str, title: bool) -> bool:
    """Whether every character beyond ASCII is one that is usual where it stands."""
    n = sum(c > "\x7f" and c not in _BLANKS for c in s)
    return _cost(s, title) <= n * _PLAIN + 0.3 * len(_ENTITY.findall(s)) + 1e-9


def _cost(s: str, title: bool = True) -> float:
    """How implausible the characters of a text are where they stand; 0 for plain ASCII. Names have no signs but the
    apostrophe; ``title``: running text, in which others are usual too."""
    if s.isascii():
        return 0.3 * len(_ENTITY.findall(s)) if "&" in s else 0.0
    total, n = 0.3 * len(_ENTITY.findall(s)) if "&" in s else 0.0, len(s)
    foreign = None
    for i, c in enumerate(s):
        if c < "\x80":
            continue
        if c in _BLANKS:
            if i and s[i - 1] in "ÃÂãâ":
                total += 1
            continue
        o = ord(c)
        if o < 160 or o == 0xAD:
            total += _CONTROL
            continue
        if o == 0xFFFD:
            total += 0.2
            continue
        p, q = s[i - 1] if i else " ", s[i + 1] if i + 1 < n else " "
        if c in _LETTERS:
            total += _PLAIN
            if c == "ã" and ((q > "\x7f" and q != "ã" and q not in _BLANKS) or not p.isalpha()):
                total += 1.2
            elif c == "ö" and p in _VOWELS and q in "eE":
                total += 1.2
            elif c == "þ" and p.isalpha() and p.islower():
                total += 1
        elif c.isalpha():
            low = c.lower()
            if o > 0x24F and not 0x1E00 <= o <= 0x1EFF:
                foreign = _other_script(s) if foreign is None else foreign
                total += 0.1 if i in foreign else _FOREIGN
            elif len(low) == 1 and low in _LETTERS:
                total += _PLAIN
                if p.islower() and p.isalpha() and not q.isupper():
                    total += 1.2
                elif c == "Ã" and q > "\x7f" and q != "Ã" and q not in _BLANKS:
                    total += 1.5
                elif not p.isalpha() and c not in _INITIALS:
                    total += 0.7
            else:
                total += _RARE if o < 0x180 else _FOREIGN
        elif c in (_SIGNS if title else "’–"):
            total += _PLAIN
            elided = c == "’" and q.isupper() and p.isupper() and (i == 1 or not s[i - 2].isalpha())  # O’Brien
            if not elided and (p.isalpha() or p in _SIGNS) and (q.isalpha() or q in _SIGNS or c in "„‘°§™"):
                total += 1.2
        else:
            total += _SIGN
    return total


def _steps(s: str, mapped: bool):
    """Texts one step away, with the step's price and whether it rereads single bytes; that is done once at most."""
    for n in _SINGLE:
        t = s.translate(_TO_BYTE[n])
        if _UTF8.search(t):
            out, at = [], 0
            for m in _UTF8.finditer(t):
                try:
                    c = m.group().encode("latin-1").decode("utf-8")
                except UnicodeDecodeError:
                    continue
                out += [s[at : m.start()], c]
                at = m.end()
            if out:
                yield _UNDO, mapped, "".join(out) + s[at:]
    if not mapped:
        for m in _MAPS:
            yield _REMAP, True, s.translate(m)
    if "&" in s:
        yield _UNDO, mapped, _ENTITY.sub(lambda m: html.unescape(m.group()), s)
    yield _RECASE, mapped, "".join(c.translate(_LOWER_LEADS) if c > "\x7f" and i + 1 < len(s) and s[i + 1] > "\x7f" else c for i, c in enumerate(s))


_LOST_NAME = re.compile("\ufffd|[?]")
_LOST_TEXT = re.compile(r"\ufffd|[^\W\d_]\?[^\W\d_]|(?:^|[^\w?!.])\?[^\W\d_]|(?:^|\s)\?(?=\s)")


def repair(s: str, question_marks: bool = False) -> tuple[str, bool, bool]:
    """``(text, damaged, lost)``: the cheapest text reachable, whether decoding changed it, whether characters are gone.

    ``question_marks``: the text may hold real ones, so only those inside or before a word, or alone, stand for a lost
    character; otherwise any does.
    """
    lost = bool((_LOST_TEXT if question_marks else _LOST_NAME).search(s))
    first = _cost(s, question_marks)
    best, best_cost = s, first
    if first > _UNDO:
        seen, heap, count = {s}, [(first, 0, 0.0, False, s)], 1
        while heap:
            estimate, _, spent, mapped, text = heapq.heappop(heap)
            if spent >= best_cost:  # it and all that follow from it cost more than the best
                continue
            if estimate - spent < _UNDO:  # nothing cheaper can be reached from a clean text
                break
            for price, remapped, t in _steps(text, mapped):
                if t in seen:
                    continue
                seen.add(t)
                count += 1
                c = _cost(t, question_marks) + spent + price
                if c < best_cost - 1e-9 and (not remapped or _all_plain(t, question_marks)):  # such a reading must leave no doubt
                    best, best_cost = t, c
                heapq.heappush(heap, (c, count, spent + price, remapped, t))
    return best, lost or best != s, lost


def suspicious(c: Column, question_marks: bool = False) -> Column:
    """Whether a text needs the search at all: a built-in test that lets no text pass by whose search would change it."""
    signs = "".join(x for x in _SIGNS if x not in "„™§°") if question_marks else ""
    usual = _LETTERS + _LETTERS.upper() + _BLANKS + signs
    rest = F.translate(c, usual, "")  # far cheaper than a class of as many characters in a pattern
    unusual = F.octet_length(rest) > F.length(rest)
    # each branch begins with the sign it is about, so that it is left at once where another stands
    lost = r"\?(?:(?<=\p{L}.)(?=\p{L})|(?<=(?:^|[^\p{L}\p{N}?!.]).)(?=\p{L})|(?<=(?:^|\s).)(?=\s))" if question_marks else "[?]"
    capital = r"[^\x00-\x7f](?<=\p{Ll}\p{Lu})(?!\p{Lu})"
    tilde = rf"[Ãã](?:(?=[^\x00-\x7fÃã{_BLANKS}])|(?<!\p{{L}}.))"
    rx = rf"{lost}|{capital}|{tilde}|ö(?<=[aouåäAOUÅÄ].)(?=[eE])|þ(?<=\p{{Ll}}.)|[ÍÝËÊÈŤĚŘ](?<!\p{{L}}.)|&(?=#?\w{{2,8}};)"
    if question_marks:
        rx += r"|[^\x00-\x7f](?<=\p{L}[^\p{L}\p{Z}])(?=\p{L})"
    plain = (F.octet_length(c) == F.length(c)) & ~c.contains("?") & ~c.contains("&")
    return F.coalesce(~plain & (unusual | c.rlike(rx)), F.lit(False))


_RESULT = T.StructType([T.StructField("text", T.StringType()), T.StructField("damaged", T.BooleanType()), T.StructField("lost", T.BooleanType())])
_memo: dict[tuple[str, bool], tuple[str, bool, bool]] = {}


def _repaired(texts: pd.Series, question_marks: bool) -> pd.DataFrame:
    """Snapshots repeat their names, so answers are kept for the worker's life, up to a bound."""
    out = []
    for s in texts:
        k = (s, question_marks)
        r = _memo.get(k)
        if r is None:
            r = repair(s, question_marks) if s is not None else (None, False, False)
            if len(_memo) > 200_000:
                _memo.clear()
            _memo[k] = r
        out.append(r)
    return pd.DataFrame(out, columns=["text", "damaged", "lost"])


@F.pandas_udf(_RESULT)
def repair_name(texts: pd.Series) -> pd.DataFrame:
    return _repaired(texts, False)


@F.pandas_udf(_RESULT)
def repair_title(texts: pd.Series) -> pd.DataFrame:
    return _repaired(texts, True)


def damaged_rows(df: DataFrame, row_key: str, column: str, question_marks: bool = False) -> DataFrame:
    """``(row_key, garbled, restored, lost)`` of every row whose ``column`` was changed by wrong decoding.

    No shuffle: a built-in expression sets the suspicious rows apart, and only they reach the search. ``restored`` is the
    text as far as it can be told; ``lost`` says that some of its characters are gone for good (they stay marked).

    Defined results: null and empty texts, and texts in plain ASCII without marks of loss, are never cases; texts of any
    length are searched whole; repeated rows come out each; an empty table gives no rows; other columns are ignored.
    """
    f = repair_title if question_marks else repair_name
    rows = df.select(F.col(row_key).cast("long").alias("row_key"), F.col(column).alias("garbled")).where(suspicious(F.col("garbled"), question_marks))
    return rows.withColumn("r", f("garbled")).where("r.damaged").select("row_key", "garbled", F.col("r.text").alias("restored"), F.col("r.lost").alias("lost"))


def restored(c: Column) -> Column:
    """A name with wrong decoding undone, the search run only where it may change something."""
    return F.when(suspicious(c), repair_name(F.when(suspicious(c), c))["text"]).otherwise(c)
