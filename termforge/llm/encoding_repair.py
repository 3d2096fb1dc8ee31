"""Garbled text from wrong character encoding: detection and restoration.

A smoothed character trigram model is trained on clean records. For every token with
non-ASCII characters each candidate encode-decode chain is applied (UTF-8 bytes read in a
single-byte code page, up to three times over, or bytes of one code page read in another),
original and candidates are scored by the model, and the likeliest candidate is accepted where
it beats the original by more than a margin validated on clean records that the
model wasn't trained on; what they miss of the same records damaged on purpose is measured by `validation`. Marks that nothing can restore (the replacement character, C1
controls) are damage by themselves.

The model is a count-min sketch of fixed size, so what is gathered and broadcast doesn't grow with the
collection. It is case-folded, so formatting changes of letter case don't look like damage.
"""

from __future__ import annotations

import hashlib
import html
import math
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termforge.llm.batches import slices
from termforge.session import materialize

BITS = 20
SALT = 0x5851F42D4C957F2D
SIZE = 1 << BITS
SMOOTH = (4.0, 4.0)
# Rows of the sketch for characters, pairs and trigrams; a gram counts as its least row.
ROWS = ((0,), (1, 2), (3, 4, 5))
TABLES = 6
# Clean records with other than ASCII characters are in HELD_OUT folds. One is held out of the model; each other one is judged by
# a model without it. All of them validate the margins: at most FALSE_ACCEPTS may be accepted, which takes about ENOUGH to
# tell. This and the least margin are the same at any size.
HELD_OUT = 10
FALSE_ACCEPTS = 0.002
ENOUGH = 2000
FIRST_MARGIN = 6.0
LEAST_MARGIN = 4.0
BEYOND_DOUBT = 18.0
DEPTH = 3
# What each character that a candidate saves costs it: about as much as an ordinary character does.
SHORTER = 2.0
# Less than this a candidate of another code page doesn't count for.
LEAST_PAGE_GAIN = 0.5
# The code pages of candidate chains, by Python's names.
WRONG = ["cp1252", "latin-1", "cp1250", "cp1251", "cp1253", "cp1254", "cp1257", "cp437", "cp850", "cp852", "cp866", "cp737", "koi8-r",
         "mac_roman", "mac_cyrillic", "iso8859-2", "iso8859-5", "iso8859-7", "iso8859-15"]
RIGHT = ["cp1252", "cp1250", "cp1251", "cp1253", "cp437", "cp850", "cp852", "cp866", "cp737", "koi8-r", "mac_roman", "mac_cyrillic", "iso8859-5"]
# Code pages in which clean Cyrillic or Greek words can look like UTF-8 bytes; they don't tell clean records.
SELF_SIMILAR = {"cp866", "cp737", "koi8-r", "mac_cyrillic", "iso8859-5", "iso8859-7", "cp1253"}
_UTF8 = re.compile("[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xef][\x80-\xbf]{2}|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf4][\x80-\xbf]{3}")
_LOST = re.compile(f"[{chr(0x80)}-{chr(0x9F)}{chr(0xFFFD)}]")
_BREAK = re.compile("[ \t\r\n]+")
_SPACES = "".join(map(chr, (0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000)))
_INVISIBLE = "".join(map(chr, (0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF)))
_NO_FIGURE = str.maketrans({**dict.fromkeys(_SPACES, " "), **dict.fromkeys(_INVISIBLE), **dict.fromkeys("123456789", "0")})


def _bytes_of(codec: str) -> dict[str, str]:
    """Character -> the character of its byte's number; unassigned bytes stand for themselves."""
    table = {}
    for b in range(128, 256):
        try:
            ch = bytes([b]).decode(codec)
        except UnicodeDecodeError:
            ch = chr(b)
        table[ch] = chr(b)
    return table


_TO_BYTES = {w: _bytes_of(w) for w in WRONG}
_FROM_BYTES = {r: {b: c for c, b in _bytes_of(r).items()} for r in RIGHT}
_PAIRS = [(i * len(RIGHT) + j, _TO_BYTES[w], _FROM_BYTES[r]) for i, w in enumerate(WRONG) for j, r in enumerate(RIGHT) if w != r]
_NO_BYTE = chr(0xFFFF)


@lru_cache(maxsize=100_000)
def _bytes_of_char(ch: str) -> tuple[str, ...]:
    """The byte of a character in each of WRONG, as a character; U+FFFF where it has none."""
    return (ch,) * len(WRONG) if ch < "\x80" else tuple(_TO_BYTES[w].get(ch, _NO_BYTE) for w in WRONG)


@lru_cache(maxsize=100_000)
def _read_otherwise(ch: str) -> tuple[str | None, ...]:
    """What a character may have been, for each pair of code pages; None where it can't come from that pair."""
    out = []
    for _, to, back in _PAIRS:
        b = to.get(ch)
        c = back.get(b) if b is not None else None
        out.append(None if c is None or _LOST.match(c) else c)
    return tuple(out)


def _other_case(token: str, chars: list[str], upper: bool, codec: str | None = None) -> str:
    """Non-ASCII letters in the other case; with a code page, only those that aren't continuation bytes in it."""
    for ch in chars:
        x = ch.upper() if upper else ch.lower()
        if len(x) == 1 and x != ch and (codec is None or _TO_BYTES[codec].get(ch, "\x80") > "\xbf"):
            token = token.replace(ch, x)
    return token


def _undone(token: str) -> Iterator[str]:
    """The token with every UTF-8 sequence read in a code page decoded properly, for the code pages in which
    it has any."""
    tried = set()
    for seen in map("".join, zip(*map(_bytes_of_char, token), strict=True)):
        if seen in tried or not _UTF8.search(seen):
            continue
        tried.add(seen)
        out, at = [], 0
        for m in _UTF8.finditer(seen):
            out.append(token[at : m.start()])
            try:
                out.append(m.group().encode("latin-1").decode("utf-8"))
            except UnicodeDecodeError:
                out.append(token[m.start() : m.end()])
            at = m.end()
        out.append(token[at:])
        undone = "".join(out)
        if undone != token:
            yield undone


_ADJACENT = re.compile(r"[^\x00-\x7f]{2}")
_RUNS = re.compile(r"[^\x00-\x7f]{2,}")
_TELLING = [k for k, w in enumerate(WRONG) if w not in SELF_SIMILAR]


def utf8_candidates(token: str, depth: int = DEPTH) -> set[str]:
    """Everything the token may be if UTF-8 bytes were read in a single-byte code page, also repeatedly
    and with the letter case changed afterwards. Such bytes stand in runs, so single characters are no cases."""
    found: set[str] = set()
    if not _ADJACENT.search(token):
        return found
    chars = list({c for c in token if c > "\x7f"})
    frontier = {token, _other_case(token, chars, True), _other_case(token, chars, False)}
    if any(c.islower() for c in chars):
        frontier.update(_other_case(token, chars, True, w) for w in WRONG)
    for _ in range(depth):
        ahead = set()
        for t in frontier:
            had_lost = _LOST.search(t) is not None
            ahead.update(u for u in _undone(t) if u not in found and (had_lost or not _LOST.search(u)))
        found |= ahead
        frontier = {t for t in ahead if _ADJACENT.search(t)}
        if not frontier:
            break
    return found


def _implausible(token: str, candidate: str) -> bool:
    """A no-break space or a capital after a small letter that the token didn't have."""
    if "\xa0" in candidate and "\xa0" not in token:
        return True
    for k in range(1, len(candidate)):
        if candidate[k] > "\x7f" and candidate[k].isupper() and candidate[k - 1].islower() and not (token[k].isupper() and token[k - 1].islower()):
            return True
    return False


@lru_cache(maxsize=50_000)
def _readings(chars: tuple[str, ...]) -> tuple[tuple[dict[int, str], tuple[int, ...]], ...]:
    """(translation of these characters, chains): what they may have been together, for bytes of one code page read in another."""
    ways: dict[tuple, list[int]] = {}
    for k, read in enumerate(zip(*map(_read_otherwise, chars), strict=True)):
        if None not in read:
            ways.setdefault(read, []).append(_PAIRS[k][0])
    return tuple(({ord(c): r for c, r in zip(chars, read, strict=True)}, tuple(chains)) for read, chains in ways.items())


def page_candidates(token: str) -> dict[str, tuple[int, ...]]:
    """candidate -> chains, for bytes of one code page read in another."""
    out = {}
    for read, chains in _readings(tuple(sorted({c for c in token if c > "\x7f"}))):
        candidate = token.translate(read)
        if candidate != token and not _implausible(token, candidate):
            out[candidate] = chains
    return out


# ---- model


_ASCII_SHAPE = bytes(ord(" ") if chr(b) in " \t\r\n" else ord("0") if chr(b) in "123456789" else ord(chr(b).lower()) for b in range(128)) + bytes(range(128, 256))


@lru_cache(maxsize=200_000)
def _shape(token: str) -> str:
    """Case-folded, figures as 0, invisible characters dropped, other spaces than those between tokens like these."""
    shaped = token.lower().translate(_NO_FIGURE)
    return "  ".join(filter(None, shaped.split(" "))) if " " in shaped else shaped


def _shape_text(text: str) -> str:
    """Shapes of all tokens of a text, each between two spaces."""
    if text.isascii() and "&" not in text:
        return "  " + "  ".join(text.encode().translate(_ASCII_SHAPE).decode().split()) + " "
    return "  " + "  ".join(map(_shape, tokens(text))) + " "


def tokens(text: str) -> list[str]:
    return [t for t in _BREAK.split(html.unescape(text)) if t]


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x + np.uint64(salt * SALT & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(32)
        return ((x * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - BITS)).astype(np.int64)


def gram_buckets(shaped: str) -> list[np.ndarray]:
    """Per table of the sketch the buckets of the character, pair or trigram that ends at each character from the third on."""
    x = np.frombuffer(shaped.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if len(x) < 3:
        return [np.zeros(0, np.int64)] * TABLES
    with np.errstate(over="ignore"):
        pair = x[1:-1] * np.uint64(0x110000) + x[2:]
        triple = x[:-2] * np.uint64(0x110000 * 0x110000) + pair
    return [_mix(grams, row + 1) for grams, rows in zip((x[2:], pair, triple), ROWS, strict=True) for row in rows]


class Model:
    """Interpolated trigram probabilities over the counts of a sketch."""

    def __init__(self, counts: np.ndarray):
        self.counts = counts.astype(np.float32)
        self.total = float(counts[0].sum())
        self.kinds = max(1, int((counts[0] > 0).sum()))
        self._memo: dict[str, float] = {}
        self._short: dict[str, float] = {}
        self._judge: Judge | None = None

    def __getstate__(self):
        return {"counts": self.counts, "total": self.total, "kinds": self.kinds, "_memo": {}, "_short": {}, "_judge": None}

    def judge(self, least: float = LEAST_MARGIN) -> Judge:
        """One judge per process, so tasks of a worker share what it has seen; another one for another least margin."""
        if self._judge is None or self._judge.least != least:
            self._judge = Judge(self, least)
        return self._judge

    def _n(self, k: int, gram: str) -> float:
        return float(min([self.counts.item(row, self._bucket(row, gram)) for row in ROWS[k]]))

    def _few(self, k: int, gram: str) -> float:
        """The same for characters and pairs, which are few and come again and again."""
        n = self._short.get(gram)
        if n is None:
            if len(self._short) > 200_000:
                self._short.clear()
            n = self._short[gram] = self._n(k, gram)
        return n

    @staticmethod
    def _bucket(row: int, gram: str) -> int:
        """The bucket gram_buckets gives it."""
        x = 0
        for ch in gram:
            x = x * 0x110000 + ord(ch)
        x = ((x + (row + 1) * SALT) * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF
        x ^= x >> 32
        return ((x * 0xD6E8FEB86659FD93) & 0xFFFFFFFFFFFFFFFF) >> (64 - BITS)

    def _log(self, gram: str) -> float:
        p1 = (self._few(0, gram[2]) + 0.5) / (self.total + 0.5 * self.kinds + 500)
        p2 = (self._few(1, gram[1:]) + SMOOTH[0] * p1) / (self._few(0, gram[1]) + SMOOTH[0])
        p3 = (self._n(2, gram) + SMOOTH[1] * min(1.0, p2)) / (self._few(1, gram[:2]) + SMOOTH[1])
        return math.log(min(1.0, p3))

    def logs(self, token: str) -> Iterator[tuple[str, float]]:
        s, memo = f"  {_shape(token)} ", self._memo
        for i in range(len(s) - 2):
            g = s[i : i + 3]
            x = memo.get(g)
            yield g, self._kept(g) if x is None else x

    def score(self, token: str) -> float:
        return sum([x for _, x in self.logs(token)])

    def gain(self, token: str, candidate: str) -> float:
        """score(candidate) - score(token), for characters other than ASCII replaced one by one: only trigrams with them differ."""
        s, c = f"  {_shape(token)} ", f"  {_shape(candidate)} "
        if len(s) != len(c) or " " in s[2:-1] or " " in c[2:-1]:
            return self.score(candidate) - self.score(token)
        memo, total = self._memo, 0.0
        for i in range(len(s) - 2):
            g = s[i : i + 3]
            if not g.isascii():
                h = c[i : i + 3]
                x, y = memo.get(g), memo.get(h)
                total += (self._kept(h) if y is None else y) - (self._kept(g) if x is None else x)
        return total

    def _kept(self, g: str) -> float:
        if len(self._memo) > 500_000:
            self._memo.clear()
        x = self._memo[g] = self._log(g)
        return x

    def most_gain(self, token: str) -> float:
        """What a candidate can gain at most: what the trigrams with non-ASCII characters cost now."""
        if any(c in _SPACES or c in _INVISIBLE for c in token):
            return math.inf
        return -sum([x for g, x in self.logs(token) if not g.isascii()])


_FAR = re.compile(r"\A[\x00-\x7f]{4,}|[\x00-\x7f]{6,}|[\x00-\x7f]{4,}\Z")


def _near(token: str) -> str:
    """The token without ASCII characters more than two away from any other: what is there is in no trigram that a candidate
    changes, so gains are the same, and tokens that agree in the rest are judged together."""

    def ends(m: re.Match) -> str:
        run = m.group()
        return ("" if m.start() == 0 else run[:2]) + "\x00" + ("" if m.end() == len(token) else run[-2:])

    return _FAR.sub(ends, token)


class Judge:
    """Scores records by a model; what a token may have been is kept for the next time it occurs."""

    def __init__(self, model: Model, least: float = LEAST_MARGIN):
        self.model, self.least = model, least
        self._seen: dict[str, tuple] = {}
        self._near: dict[str, tuple] = {}
        self._bests: dict[str, str] = {}

    def token(self, t: str) -> tuple[float, tuple[tuple[tuple[int, ...], float], ...]]:
        """Gain of the best UTF-8 candidate; (chains, gain) of code pages that gain."""
        known = self._seen.get(t)
        if known is None:
            if len(self._seen) > 50_000:
                self._seen.clear()
            near = _near(t)
            known = self._near.get(near)
            if known is None:
                if len(self._near) > 50_000:
                    self._near.clear()
                    self._bests.clear()
                known = self._near[near] = self._judged(near)
            self._seen[t] = known
        return known

    def _judged(self, t: str) -> tuple[float, tuple[tuple[tuple[int, ...], float], ...]]:
        if self.model.most_gain(t) <= self.least:
            return 0.0, ()
        gain, best = self._best(t)
        if gain > self.least:
            self._bests[t] = best
        return gain, tuple((chains, g) for c, chains in page_candidates(t).items() if (g := self.model.gain(t, c)) > LEAST_PAGE_GAIN)

    def _best(self, t: str) -> tuple[float, str]:
        """Gain and text of the best UTF-8 candidate, the token itself if none gains."""
        gain, best = 0.0, t
        base, length = self.model.score(t), len(_shape(t))
        for c in utf8_candidates(t):
            g = self.model.score(c) - base - SHORTER * max(0, length - len(_shape(c)))
            if g > gain or (g == gain and best != t and c < best):
                gain, best = g, c
        return gain, best

    def best(self, t: str) -> str:
        """Text of the best UTF-8 candidate."""
        known = self._bests.get(t)
        if known is None:
            if len(self._bests) > 50_000:
                self._bests.clear()
            known = self._bests[t] = self._best(t)[1]
        return known

    def _as_page(self, t: str, chain: int) -> str:
        """The token read by a chain of code pages, where that gains."""
        return next((c for c, chains in page_candidates(t).items() if chain in chains and self.model.gain(t, c) > LEAST_PAGE_GAIN), t)

    def record(self, text: str) -> tuple[float, float, float, int]:
        """Of a record: the largest gain of a token by UTF-8 chains, the gain by the best pair of code pages,
        the sum of the gains by UTF-8 chains, and that pair. A token counts once."""
        utf8, total, pages = 0.0, 0.0, {}
        for t in dict.fromkeys(tokens(text)):
            if t.isascii():
                continue
            gain, options = self.token(t)
            utf8 = max(utf8, gain)
            total += gain
            for chains, g in options:
                for chain in chains:
                    pages[chain] = pages.get(chain, 0.0) + g
        chain = max(pages, key=lambda c: (pages[c], -c), default=-1)
        return utf8, pages.get(chain, 0.0), total, chain

    def verdict(self, text: str, margins: tuple[float, float]) -> str | None:
        """The text restored if the margins accept a candidate, else None."""
        utf8, page, total, chain = self.record(text)
        if page > margins[1] and (page > total or utf8 <= margins[0]):
            return self.restore(text, margins, chain)
        return self.restore(text, margins, -1) if utf8 > margins[0] else None

    def restore(self, text: str, margins: tuple[float, float], chain: int) -> str:
        """The text, entities decoded, with the accepted candidates in place of their tokens."""
        out = []
        for part in re.split("([ \t\r\n]+)", html.unescape(text)):
            if part and not part.isascii():
                if chain >= 0:
                    part = self._as_page(part, chain)
                elif self.token(part)[0] > margins[0]:
                    part = self.best(part)
            out.append(part)
        return "".join(out)

    def sure_part(self, text: str) -> str:
        """What a damaged text teaches about clean ones: its ASCII tokens and those restored beyond doubt."""
        sure = []
        for t in tokens(text):
            if t.isascii():
                sure.append(t)
            else:
                if self.token(t)[0] > FIRST_MARGIN:
                    sure.append(self.best(t))
        return " ".join(sure)


def surely_damaged(text: str) -> bool:
    return bool(_LOST.search(html.unescape(text)))


@lru_cache(maxsize=200_000)
def _may_be_utf8(run: str) -> bool:
    """Whether a run of non-ASCII characters could hold UTF-8 read in a code page (as it stands)."""
    columns = list(zip(*map(_bytes_of_char, run), strict=True))
    return any(_UTF8.search("".join(columns[k])) for k in _TELLING)


def _looks_clean(text: str) -> bool:
    """No mark of damage and no token that could be UTF-8 read in a code page."""
    t = html.unescape(text) if "&" in text else text
    return t.isascii() or not (_LOST.search(t) or any(map(_may_be_utf8, _RUNS.findall(t))))


def _fold(text: str) -> int:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=4).digest()[0] % HELD_OUT


def _held_out(text: str) -> bool:
    return _fold(text) == 0


def _taught(text: str, judge: Judge | None) -> str | None:
    """The shape of what a text adds to the counts; None if it adds nothing."""
    if judge is not None and not (text.isascii() and "&" not in text):
        utf8, page, _, _ = judge.record(text)
        if utf8 > FIRST_MARGIN:
            text = judge.sure_part(text)
        elif page > FIRST_MARGIN:
            return None
    if not _looks_clean(text) or (not text.isascii() and _held_out(text)):
        return None
    return _shape_text(text)


def _counting(judge_of=None):
    """Partial gram counts of the clean records of a partition, as (plain, k, bucket, n), plain for those that can't be damaged;
    with a judge also of those it restores, and without those it takes for misread pages."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros((2, TABLES, SIZE), np.int64)
        judge = judge_of.value.judge() if judge_of is not None else None
        for batch in batches:
            for pdf in slices(batch, chars=1_000_000):
                for plain, texts in pdf.groupby("plain")["text"]:
                    shaped = [x for x in (_taught(text, judge) for text in texts.tolist()) if x is not None]
                    if shaped:
                        for k, b in enumerate(gram_buckets("".join(shaped))):
                            counts[int(plain), k] += np.bincount(b, minlength=SIZE)
        for plain in (0, 1):
            for k in range(TABLES):
                some = np.flatnonzero(counts[plain, k])
                yield pd.DataFrame({"plain": bool(plain), "k": np.full(len(some), k, np.int32), "bucket": some, "n": counts[plain, k][some]})

    return count


def _counts(rows: DataFrame, judge_of=None) -> np.ndarray:
    """Gram counts of texts (text) that may be damaged and of plain ones: at most two times six tables of 2^20 counts reach
    the driver, whatever the collection."""
    marked = rows.select("text", (~suspicious(F.col("text"))).alias("plain"))
    counted = marked.mapInPandas(_counting(judge_of), "plain boolean, k int, bucket bigint, n bigint")
    summed = counted.groupBy("plain", "k", "bucket").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((2, TABLES, SIZE), np.int64)
    counts[summed["plain"].to_numpy().astype(int), summed["k"].to_numpy(), summed["bucket"].to_numpy()] = summed["n"].to_numpy()
    return counts


_DECODED = {w: "".join(map(chr, range(128))) + "".join(dict((b, c) for c, b in t.items())[chr(k)] for k in range(128, 256)) for w, t in _TO_BYTES.items()}


def damage(text: str, rng: random.Random) -> str:
    """The text as it would be after a wrong decoding, for validation; the same if nothing can change."""
    for _ in range(20):
        read = _DECODED[rng.choice(WRONG)]
        try:
            data = text.encode("utf-8" if rng.random() < 0.6 else rng.choice(RIGHT))
        except UnicodeEncodeError:
            continue
        out = "".join([read[b] for b in data])
        if out != text and not _LOST.search(out):
            return out
    return text


def _scored(shared, least: float = LEAST_MARGIN):
    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        judge = shared.value.judge(least)
        for batch in batches:
            for pdf in slices(batch):
                out = []
                for i, t in zip(pdf["row_id"].tolist(), pdf["text"].tolist(), strict=True):
                    utf8, page, total, chain = judge.record(t)
                    lost = surely_damaged(t)
                    fold = _fold(t) if not t.isascii() and _looks_clean(t) else None
                    worth = lost or max(utf8, page) > least
                    out.append((i, t if worth else None, utf8, page, total, chain, lost, fold))
                frame = pd.DataFrame(out, columns=["row_id", "text", "utf8", "page", "total", "chain", "lost", "fold"])
                yield frame.astype({"fold": "Int32"})

    return score


def _folded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for pdf in slices(batch):
            some = [(_fold(t), t) for t in pdf["text"].tolist() if not t.isascii() and _looks_clean(t)]
            yield pd.DataFrame(some, columns=["fold", "text"])


def _fold_counting(first: Broadcast):
    """Gram counts of what texts (fold, text, n) taught, as (fold, k, bucket, n); texts of a fold come next to each other, so one
    fold is counted at a time."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        teacher, at, counts = first.value.judge(), None, np.zeros((TABLES, SIZE))

        def told() -> Iterator[pd.DataFrame]:
            for k in range(TABLES):
                some = np.flatnonzero(counts[k])
                yield pd.DataFrame({"fold": np.full(len(some), at, np.int32), "k": np.full(len(some), k, np.int32), "bucket": some, "n": counts[k, some].astype(np.int64)})

        for batch in batches:
            for pdf in slices(batch, chars=1_000_000):
                for fold, rows in pdf.groupby("fold"):
                    if fold != at and at is not None:
                        yield from told()
                        counts[:] = 0
                    at = fold
                    taught = [(x, n) for t, n in zip(rows["text"].tolist(), rows["n"].tolist(), strict=True) if (x := _taught(t, teacher)) is not None]
                    if taught:
                        sizes = [len(x) for x, _ in taught]
                        text_of, n_of = np.repeat(np.arange(len(taught)), sizes), np.repeat([n for _, n in taught], sizes)
                        inside = text_of[:-2] == text_of[2:]
                        for k, b in enumerate(gram_buckets("".join(x for x, _ in taught))):
                            counts[k] += np.bincount(b[inside], n_of[2:][inside], SIZE)
        if at is not None:
            yield from told()

    return count


def _without_own(shared: Broadcast, own: dict[int, Broadcast], least: float):
    """Gains of texts (fold, text, n) by the model less what their fold taught it, one fold's model at a time."""

    def judged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, judge = None, None
        for batch in batches:
            for pdf in slices(batch):
                for fold, rows in pdf.groupby("fold"):
                    if fold != at:
                        counts = shared.value.counts.copy()
                        where, n = own[int(fold)].value
                        counts.reshape(-1)[where] -= n
                        at, judge = fold, Judge(Model(np.maximum(counts, 0)), least)
                    gains = [judge.record(t)[:2] for t in rows["text"].tolist()]
                    yield pd.DataFrame({"utf8": [g[0] for g in gains], "page": [g[1] for g in gains], "n": rows["n"].to_numpy()})

    return judged


def _own_counts(counted: DataFrame, fold: int) -> tuple[np.ndarray, np.ndarray]:
    """(places in the tables, counts) of what a fold taught."""
    rows = counted.where(F.col("fold") == fold).select((F.col("k") * SIZE + F.col("bucket")).cast("int").alias("at"), F.col("n").cast("float")).toPandas()
    return rows["at"].to_numpy(), rows["n"].to_numpy()


def judged_folds(texts: DataFrame, folds: list[int], first: Broadcast, shared: Broadcast, least: float = LEAST_MARGIN) -> DataFrame:
    """(utf8, page, n) of the distinct clean texts (text) of these folds, each judged by a model without its fold.

    Folds are cut into ranges, so a task has a share of the texts, however many a fold has. What a fold taught reaches the
    driver fold by fold.
    """
    spark = texts.sparkSession
    clean = texts.mapInPandas(_folded, "fold int, text string").where(F.col("fold").isin(folds))
    distinct = clean.groupBy("fold", "text").agg(F.count(F.lit(1)).alias("n"))
    ranges = materialize(distinct.repartitionByRange("fold", F.xxhash64("text")).sortWithinPartitions("fold"), "folds")
    taught = ranges.mapInPandas(_fold_counting(first), "fold int, k int, bucket bigint, n bigint")
    counted = materialize(taught.groupBy("fold", "k", "bucket").agg(F.sum("n").alias("n")), "fold-counts", ("fold",))
    own = {fold: spark.sparkContext.broadcast(_own_counts(counted, fold)) for fold in folds}
    return ranges.mapInPandas(_without_own(shared, own, least), "utf8 double, page double, n bigint")


def cross_fitted(texts: DataFrame, n_held: int, first: Broadcast, shared: Broadcast, enough: int = ENOUGH, least: float = LEAST_MARGIN) -> DataFrame | None:
    """judged_folds of as many folds as make about `enough` records with n_held others, or all; None if these are enough.

    For looking at part of the folds only: the margins of damaged_rows come from all folds at any size (_clean_gains).
    """
    folds = min(HELD_OUT, -(-enough // n_held) if n_held else HELD_OUT) - 1
    return judged_folds(texts, list(range(1, folds + 1)), first, shared, least) if folds >= 1 else None


def validated_margins(gains: DataFrame, accepts: float = FALSE_ACCEPTS) -> tuple[float, float]:
    """Margins for UTF-8 and for code page chains from the gains (utf8, page, n) of clean records by models that
    weren't trained on them.

    Records that gain more than BEYOND_DOUBT are damaged, not clean. The margin is the gain that at most a share
    `accepts` of the rest exceeds, but at least LEAST_MARGIN. Gains are rounded up to tenths before, so the
    percentile works on few distinct values.
    """
    clean = gains.where(F.greatest("utf8", "page") <= BEYOND_DOUBT)
    tenths = clean.select("n", *[(F.ceil(F.col(c) * 10) / 10).alias(c) for c in ("utf8", "page")])
    r = tenths.agg(*[F.expr(f"percentile({c}, {1 - accepts}D, n)").alias(c) for c in ("utf8", "page")]).first()
    return max(LEAST_MARGIN, r["utf8"] or 0.0), max(LEAST_MARGIN, r["page"] or 0.0)


def validation_report(model: Model, clean: list[str], margins: tuple[float, float], seed: int = 7) -> dict[str, float]:
    """Share of clean texts accepted, and of the same texts damaged on purpose found and restored exactly."""
    rng, judge = random.Random(seed), model.judge()
    hurt = [(t, d) for t in clean if (d := damage(t, rng)) != t]
    found = [(t, judge.verdict(d, margins)) for t, d in hurt]
    return {
        "accepted_clean": sum(judge.verdict(t, margins) is not None for t in clean) / max(1, len(clean)),
        "found_damaged": sum(v is not None for _, v in found) / max(1, len(found)),
        "restored": sum(v == html.unescape(t) for t, v in found) / max(1, len(found)),
    }


def suspicious(text: Column) -> Column:
    """Texts that can be damaged at all: with a non-ASCII character or an entity."""
    return text.rlike(r"[^\x00-\x7F]") | text.contains("&")


def trained_model(texts: DataFrame) -> Model:
    """Model of the clean records among texts (text): trained once, and again without what the first finds damaged
    but with what it restores beyond doubt."""
    return _trained(texts)[1]


def _trained(texts: DataFrame) -> tuple[Broadcast, Model]:
    """The first model, and the one trained with it. Texts that can't be damaged are counted once, for both."""
    counts = _counts(texts)
    first = texts.sparkSession.sparkContext.broadcast(Model(counts.sum(axis=0)))
    return first, Model(counts[1] + _counts(texts.where(suspicious(F.col("text"))), first)[0])


def _clean_gains(texts: DataFrame, scored: DataFrame, first: Broadcast, shared: Broadcast) -> DataFrame:
    """(utf8, page, n) of all clean records, however many: those held out of the model judged by it, others by one without
    their fold."""
    held = scored.where(F.col("fold") == 0).select("utf8", "page", F.lit(1).cast("bigint").alias("n"))
    return held.unionByName(judged_folds(texts.where(suspicious(F.col("text"))), list(range(1, HELD_OUT)), first, shared))


def _found(rows: DataFrame, row_id: str, text: str, margins: tuple[float, float] | None) -> tuple[DataFrame, Broadcast, tuple[float, float]]:
    """The rows of damaged_rows with row_id as a string, and the model and margins they were found with."""
    texts = rows.select(F.col(row_id).cast("string").alias("row_id"), F.col(text).alias("text")).where(F.col("text").isNotNull() & (F.col("text") != ""))
    first, model = _trained(texts.select("text"))
    shared = rows.sparkSession.sparkContext.broadcast(model)
    schema = "row_id string, text string, utf8 double, page double, total double, chain int, lost boolean, fold int"
    least = min(LEAST_MARGIN, *margins) if margins else LEAST_MARGIN
    scored = materialize(texts.where(suspicious(F.col("text"))).mapInPandas(_scored(shared, least), schema), "scored-texts")
    m = margins or validated_margins(_clean_gains(texts.select("text"), scored, first, shared))
    page = (F.col("page") > m[1]) & ((F.col("page") > F.col("total")) | (F.col("utf8") <= m[0]))
    kind = F.when(page, "page").when(F.col("utf8") > m[0], "utf8").when(F.col("lost"), "lost")
    gain = F.when(F.col("kind") == "page", F.col("page")).when(F.col("kind") == "utf8", F.col("total")).otherwise(0.0)
    found = scored.withColumn("kind", kind).where(F.col("kind").isNotNull())
    return found.select("row_id", "text", "kind", gain.alias("gain"), F.when(F.col("kind") == "page", F.col("chain")).otherwise(-1).alias("chain")), shared, m


def _tried(shared: Broadcast, margins: tuple[float, float]):
    def tried(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        judge = shared.value.judge(min(LEAST_MARGIN, *margins))
        for batch in batches:
            for pdf in slices(batch):
                out = []
                for t in pdf["text"].tolist():
                    hurt = damage(t, random.Random(t))
                    was, found = judge.verdict(t, margins), judge.verdict(hurt, margins)
                    out.append((was is not None, hurt != t, hurt != t and found is not None, hurt != t and found == html.unescape(t)))
                yield pd.DataFrame(out, columns=["accepted", "damaged", "found", "restored"])

    return tried


def validation(rows: DataFrame, row_id: str = "row_id", text: str = "text") -> DataFrame:
    """One row (n_clean, n_accepted, n_damaged, n_found, n_restored, utf8_margin, page_margin): how the model and the margins of
    damaged_rows do on the clean records held out of it, as they are and damaged on purpose by a random chain each.

    Accepted are clean records taken for damaged; restored are damaged ones that come back exactly.
    """
    _, shared, margins = _found(rows, row_id, text, None)
    texts = rows.select(F.col(text).alias("text")).where(suspicious(F.col(text)))
    held = texts.mapInPandas(_folded, "fold int, text string").where(F.col("fold") == 0).select("text")
    tried = held.mapInPandas(_tried(shared, margins), "accepted boolean, damaged boolean, found boolean, restored boolean")
    n = lambda c: F.count_if(c).alias(f"n_{c}")
    return tried.agg(F.count(F.lit(1)).alias("n_clean"), *map(n, ("accepted", "damaged", "found", "restored"))).select(
        "*", F.lit(float(margins[0])).alias("utf8_margin"), F.lit(float(margins[1])).alias("page_margin")
    )


def damaged_rows(rows: DataFrame, row_id: str = "row_id", text: str = "text", margins: tuple[float, float] | None = None) -> DataFrame:
    """(row_id, text, kind, gain, chain) of every damaged row.

    kind is utf8 (UTF-8 read in a code page), page (one code page read as another) or lost (an
    unrestorable mark only). Null and empty texts are never damaged. The model is trained on all
    clean records and the margins are validated on records held out of it; all rows are
    judged, whole. Equal rows get equal results.
    """
    found, _, _ = _found(rows, row_id, text, margins)
    return found.withColumn("row_id", F.col("row_id").cast(dict(rows.dtypes)[row_id]))


def garbled(rows: DataFrame, row_id: str = "row_id", text: str = "text", margins: tuple[float, float] | None = None) -> DataFrame:
    """(row_id, text, kind, gain, restored): damaged_rows with the text restored where it can be, by the model and
    the margins the rows were found with.

    restored has entities decoded and accepted tokens replaced; it is null for lost.
    """
    found, shared, used = _found(rows, row_id, text, margins)

    def restored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        judge = shared.value.judge(min(LEAST_MARGIN, *used))
        for pdf in batches:
            cells = zip(pdf["text"], pdf["kind"], pdf["chain"], strict=True)
            yield pdf.drop(columns="chain").assign(restored=[None if k == "lost" else judge.restore(t, used, c) for t, k, c in cells])

    out = found.mapInPandas(restored, "row_id string, text string, kind string, gain double, restored string")
    return out.withColumn("row_id", F.col("row_id").cast(dict(rows.dtypes)[row_id]))
