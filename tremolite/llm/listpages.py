"""Problem 9: keyword-stuffed pages and link lists.

A text is cut into stretches (up to the end of a sentence or of a line that isn't continued on the next; long ones
in pieces), and every piece is reduced to a shape: its number of words, its capitals, its separators and
links, words said again, and whether its stretch ends like a sentence.  Shapes are grouped per page, and a page is
flagged whose words lie mostly in few non-sentence shapes.  Nothing depends on a language: no word is
known by itself, only by its length, its capital and what stands around it.  Lists of persons, votes and numbered
items are told by their shapes too (numbered lines, codes in parentheses, initials and short forms of address
before names) and aren't flagged.

One pass over whole texts, arrays only, no shuffle: a page's shapes are grouped where it is read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremolite.llm import text as T
from tremolite.session import spread

#: Words of one piece of a long stretch.
PIECE = 12
#: A page is flagged if at least this share of its words is in non-sentence shapes that aren't records,
#: at least SHAPES_SHARE of those in its SHAPES commonest ones, and they are LEAST words or more.
SHARE, SHAPES, SHAPES_SHARE, LEAST = 0.5, 5, 0.6, 10
#: A piece with separators after more than this share of its words is no sentence; a quarter more is allowed in a sentence, half as much more
#: in a piece of one.
LISTED = 0.22
#: A stretch of fewer words is no sentence by itself; one of up to ASIDE that ends like a sentence is an interjection; one of up to
#: WHOLE is judged as a whole, and of a longer one the last FAR words at most are a sentence.
SENTENCE, ASIDE, WHOLE, FAR = 4, 3, 40, 72
#: A line of at least this many words that doesn't end like a sentence goes on in the next line if that begins small, or whatever
#: it begins with if the line has at least FULL letters.
WRAPPED, FULL = 6, 40
#: Said over and over: words of at least LONG letters, and two words in sequence of which one is as long, that are said OFTEN times more within NEAR
#: words on either side.  A sentence or piece is stuffed if this share of its words is.
NEAR, OFTEN, LONG, STUFFED = 16, 2, 4, 0.2
#: Bytes from which a word is a clause of a script that doesn't part words; clauses said again don't stuff a page.
CLAUSE = 24
#: An unended stretch of at least RUN words with bars after at most SPARSE of them is prose (a scan without stops) if no more than this share of it was said
#: before in it, no more than CAPITALS of its words are capitals, and at least BRIEF of them have up to three letters.
RUN, SPARSE, SAID, CAPITALS, BRIEF = 12, 0.06, 0.25, 0.4, 0.15
#: A list page is a record if at least this share of its words marks one.
RECORD = 0.08
#: Letters at most of a form of address, and of a code in parentheses.
SHORT = 4
#: First words of links.
LINKS = "http https www".split()
_NL, _END, _COMMA, _BAR, _HASH, _PAREN, _COLON, _SPACE, _DASH = (1 << k for k in range(9))
_FLAG = np.zeros(256, np.uint16)
for _chars, _bit in (("\n\r", _NL), (".?!", _END), (",;", _COMMA), ("|>/*~=+", _BAR), ("-", _DASH), ("#", _HASH), ("()[]", _PAREN), (":", _COLON), (" \t\n\r", _SPACE)):
    for _c in _chars.encode():
        _FLAG[_c] |= _bit
for _c in (0xB7, 0xA2):  # last bytes of middle dot and bullet
    _FLAG[_c] |= _BAR
for _c in (0x93, 0x94):  # and of dashes
    _FLAG[_c] |= _DASH
#: Sentence ends and commas of scripts that have their own.
_MARKS = str.maketrans({"。": ". ", "、": ", ", "؟": "? ", "،": ", ", "।": ". ", "۔": ". ", "…": ". "})


def _known(ws: list[str]) -> T.Lookup:
    return T.Lookup(np.unique(T.words([" ".join(ws)]).h), 16)


_LINK = _known(LINKS)


def _is(known: T.Lookup, h: np.ndarray) -> np.ndarray:
    out = np.zeros(len(h), bool)
    out[known.find(h)[0]] = True
    return out


@dataclass
class Pages:
    """Per text: words, words in non-sentence shapes, words in its commonest shapes of these, record marks."""

    words: np.ndarray
    listed: np.ndarray
    top: np.ndarray
    records: np.ndarray

    def flagged(self) -> np.ndarray:
        n = np.maximum(self.words, 1)
        return (self.listed >= LEAST) & (self.listed >= SHARE * n) & (self.top >= SHAPES_SHARE * self.listed) & (self.records < RECORD * n)


def shapes(texts: list[str | None]) -> Pages:
    """The shape figures of each text; a null or empty text has no words."""
    plain = [T.plain(t).translate(_MARKS) if t and not t.isascii() else T.plain(t) for t in texts]
    x = T.words_of([p.lower() for p in plain])
    nt, nw = len(x.first) - 1, len(x.h)
    words = np.diff(x.first)
    if not nw:
        z = np.zeros(nt, np.int64)
        return Pages(words, z, z, z)
    b = np.frombuffer(x.buf, np.uint8)
    text = np.repeat(np.arange(nt), words)
    cap = T.capitals(plain, x)
    # what stands between a word and the next one; the byte after the last word is a line end
    nxt = np.r_[x.a[1:], len(b)]
    after = np.bitwise_or.reduceat(_FLAG[b], np.stack([x.z, nxt], 1).ravel()[: 2 * nw - 1])[::2]
    last = np.zeros(nw, bool)
    last[x.first[1:][words > 0] - 1] = True
    after[last] |= _NL
    after[((after & _DASH) > 0) & ((after & _SPACE) > 0)] |= _BAR  # a dash inside a word separates nothing
    before = np.r_[np.uint16(_NL), after[:-1]]
    before[x.first[:-1][words > 0]] |= _NL
    size = x.z - x.a
    link = _is(_LINK, x.h)
    digit = (b[x.a] >= 48) & (b[x.a] <= 57)
    # a short form of address or an initial before a name; its full stop ends no sentence
    plainly = (after & (_NL | _COMMA | _BAR | _HASH | _PAREN | _COLON)) == 0
    begins = (before & (_NL | _COMMA | _BAR | _COLON | _END)) > 0
    named = np.r_[cap[1:] & (size[1:] >= SHORT), False] & ~last
    address = cap & (size <= SHORT) & plainly & named & ~digit & begins
    initial = cap & (size == 1) & ((after & _END) > 0)
    end = ((after & _END) > 0) & ((after & (_SPACE | _NL)) > 0) & ~(address & (size <= SHORT)) & ~(size == 1) & ~digit & ~link
    newline = (after & _NL) > 0
    line = np.r_[0, np.cumsum(newline)[:-1]]
    per_line = np.bincount(line)
    at_line = np.flatnonzero(np.r_[True, newline[:-1]])
    full = (x.z[np.r_[at_line[1:] - 1, nw - 1]] - x.a[at_line])[line] >= FULL
    goes_on = newline & ~last & ~end & (per_line[line] >= WRAPPED) & (full | ~np.r_[cap[1:] | digit[1:], True]) & ((np.r_[before[1:], np.uint16(0)] & (_HASH | _BAR)) == 0)
    brk = end | (newline & ~goes_on)
    unit = np.r_[0, np.cumsum(brk)[:-1]]
    starts = np.r_[0, np.flatnonzero(brk)[:-1] + 1]
    place = np.arange(nw) - starts[unit]
    new = place % PIECE == 0
    first = np.flatnonzero(new)
    n = np.diff(np.r_[first, nw])
    count = lambda m: np.add.reduceat(m.astype(np.int32), first)
    nc, nb, nh, nl, nu = count((after & _COMMA) > 0), count((after & _BAR) > 0), count((before & _HASH) > 0), count(link), count(cap)
    own = unit[first]
    whole = np.bincount(unit)[own]
    ends = np.zeros(unit[-1] + 1, bool)
    ends[unit[end]] = True
    ended = ends[own]
    by_unit = lambda v: np.bincount(own, v, unit[-1] + 1)[own]
    judged = ended & (whole <= WHOLE)
    dense = np.where(judged, by_unit(nc + nb) > 1.25 * LISTED * whole, (nc + nb) > np.where(ended, 1.5 * LISTED, LISTED) * n)
    # words said over and over: twice more, or more often, within NEAR words on either side
    near, pairs = np.zeros(nw, np.int16), np.zeros(nw, np.int16)
    for k in range(1, min(NEAR, nw - 1) + 1):
        eq = (x.h[k:] == x.h[:-k]) & (text[k:] == text[:-k])
        near[k:] += eq
        near[:-k] += eq
        two = eq[1:] & eq[:-1]
        pairs[k + 1 :] += two
        pairs[1:-k] += two
    hot = (near >= OFTEN) & (size >= LONG) & (size < CLAUSE)
    both = pairs >= OFTEN
    both[1:] &= (size[1:] >= LONG) | (size[:-1] >= LONG)
    both &= size < CLAUSE
    hot |= both
    hot[:-1] |= both[1:]
    said = count(hot & ~digit)
    stuffed = np.where(judged, by_unit(said) >= STUFFED * whole, said >= STUFFED * n)
    # a scan without stops: words of all lengths, hardly one said before in the same stretch
    key = np.unique(x.h ^ (unit.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)[1]
    fresh = np.zeros(nw, bool)
    fresh[key] = True
    prose = ~ended & (whole >= RUN) & (by_unit(count(~fresh & (size >= LONG))) <= SAID * whole) & (by_unit(nu) <= CAPITALS * whole) & (by_unit(count((size < LONG) & ~digit)) >= BRIEF * whole) & (by_unit(nb + nh + nl) <= SPARSE * whole)
    ahead = whole - place[first]
    sentence = ((ended & (whole >= SENTENCE) & (ahead <= FAR)) | prose) & ~dense & (nh * 3 < n) & ~stuffed
    aside = ended & (whole <= ASIDE) & ~stuffed  # interjections and other short ends are neither
    listy = ~sentence & ~aside
    sep = np.select([nh * 3 >= n, (nl > 0) | stuffed, nb > LISTED * n, nc > LISTED * n, ~ended], [1, 2, 3, 4, 5], 0)
    kind = (np.digitize(n, [2, 3, 6, PIECE]) * 3 + np.digitize(nu / n, [0.1, 0.7])) * 6 + sep
    page = text[first]
    listed = np.bincount(page, np.where(listy, n, 0), nt)
    # words in each page's commonest shapes
    code = page[listy].astype(np.int64) * 128 + kind[listy]
    by = np.bincount(code, n[listy], minlength=nt * 128).reshape(nt, 128)
    top = np.sort(by, axis=1)[:, -SHAPES:].sum(1)
    # a number that heads a line, alone or after a short word ('No. 12')
    heads = (before & _NL) > 0
    numbered = digit & ((heads & ((after & _END) > 0)) | np.r_[False, (heads & cap & (size <= SHORT))[:-1]])
    coded = cap & ((before & _PAREN) > 0) & ((after & _PAREN) > 0) & (size <= SHORT)
    records = np.bincount(text, address | initial | coded | numbered, nt) + 2 * np.bincount(text, numbered, nt)
    return Pages(words, listed, top, records)


def list_pages(documents: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc: pages that are mostly keyword, tag, place or product lists or links.

    Null and empty texts, and texts with fewer than LEAST listed words, are never flagged; repeated pages
    each give their row; extra columns are ignored; an empty table gives no rows.
    """
    kind = documents.schema[doc].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, ts in T.blocks(b.column(1)):
                hit = np.flatnonzero(shapes(ts).flagged())
                if len(hit):
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at + hit))], names=[doc])

    return spread(documents.select(F.col(doc), F.col(text).alias("_t")).where(F.length("_t") > 0)).mapInArrow(run, f"`{doc}` {kind}")
